"""Markup in prose: which families a text holds, and clean text that keeps its structure.

A text is first split at its code (fenced, inline, preformatted, verbatim):
what stands inside is content, the marks around it belong to their family.
The rest is scanned for marks of HTML, Markdown, wiki text and LaTeX.  Of each
family the region with the highest sum of scores is reported: marks score
positive, the words between them negative, and one linear scan over the marks
finds the best contiguous stretch, so a family comes with the place where it is
densest.  Clean text keeps headings, lists, code blocks and formulas in one plain notation.
Of a whole HTML page the best content region is kept: over its tokens, words
score positive and tags negative (those of headings and lists nothing), and one
linear scan finds the contiguous stretch with the highest sum.  Headings, lists,
code and formulas outside it are kept too, unless they stand in a ``nav``,
``footer`` or ``aside`` element, where the scan alone decides.

Null and empty texts hold no markup and give themselves as clean text.
Texts are processed whole at any length.
"""

from __future__ import annotations

import html
import html.entities
import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame

from .common import map_rows

#: Scores of the region scan: a word, and a tag (the ratio published for news pages, words 1 to tags -3.25).
WORD_SCORE, TAG_SCORE = 1.0, -3.25
#: Scores of the scan for residue, with the same ratio: there marks count for a region and words against it.
MARK_SCORE, PLAIN_SCORE = 3.25, -1.0

# Element names of HTML, those without an end tag, and those whose end tag may be left out.
ELEMENTS = set(
    "a abbr acronym address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script search section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr".split()
)
VOID = set("area base br col embed frame hr img input link meta param source track wbr".split())
LOOSE_END = set("p li dt dd td th tr tbody thead tfoot option optgroup body html head colgroup caption rp rt".split())

BARE_ATTRIBUTES = set("async autofocus autoplay checked compact controls default defer disabled hidden ismap loop multiple muted noshade novalidate nowrap open readonly required reversed selected".split())

FRONT = re.compile(r"\A﻿?---[ \t]*\n(?:[\s\S]*?\n)?(?:---|\.\.\.)[ \t]*(?:\n|\Z)")
FENCE = re.compile(r"^([ \t]*(?:>[ \t]?)*)(`{3,}(?=[^`\n]*$)|~{3,})([^\n]*)\n([\s\S]*?)(?:^[ \t]*(?:>[ \t]?)*\2[`~]*[ \t]*$|\Z)", re.M)
INLINE = re.compile(r"(?<![`\\])(`+)(?!`)((?:(?!\n[ \t]*\n)[^`]|(?!\1(?!`))`)+?)(?<!`)\1(?!`)")
PRE = re.compile(r"<(pre|code|samp|kbd|tt|script|style|textarea|xmp)\b([^<>]*)>([\s\S]*?)</\1\s*>", re.I)
WIKI_CODE = re.compile(r"<(nowiki|syntaxhighlight|source)\b([^<>]*)>([\s\S]*?)</\1\s*>", re.I)
VERBATIM = re.compile(r"\\begin\{(verbatim\*?|lstlisting|minted|Verbatim|alltt)\}([\s\S]*?)\\end\{\1\}|\\(?:verb|lstinline)\*?([^\w\s*{])([^\n]*?)\3")

TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)?/?)>")
COMMENT = re.compile(r"<!--[\s\S]*?(?:-->|\Z)|<!DOCTYPE\b[^>]*>|<!\[CDATA\[[\s\S]*?\]\]>", re.I)
REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")

MD_LINK = re.compile(r"(!?)\[((?:[^\[\]\n]|\[[^\[\]\n]*\])*)\]\(\s*(<[^<>\n]*>|(?:[^()\s]|\([^()\s]*\))*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)")
MD_REF = re.compile(r"(?<![\]\[\w])!?\[([^\[\]\n]+)\]\[([^\[\]\n]*)\]")
MD_DEF = re.compile(r"^ {0,3}\[[^\[\]\n]+\]:[ \t]+\S[^\n]*$", re.M)
MD_AUTO = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+)>")
MD_STRONG = re.compile(r"(?<![\\*\w])\*\*(?=[^\s*])((?:(?!\n[ \t]*\n)[^*]|\*(?!\*))+?)(?<=[^\s])\*\*(?!\*)|(?<![\\_\w])__(?=[^\s_])((?:(?!\n[ \t]*\n)[^_]|_(?!_))+?)(?<=[^\s_])__(?![\w_])")
MD_EM = re.compile(r"(?<![\\*\w])\*(?=[^\s*])((?:(?!\n[ \t]*\n)[^*])+?)(?<=[^\s*])\*(?![\w*])|(?<![\\_\w])_(?=[^\s_])((?:(?!\n[ \t]*\n)[^_])+?)(?<=[^\s_])_(?![\w_])")
MD_STRIKE = re.compile(r"(?<![\\~\w])~~(?=\S)([^~\n]+?)(?<=\S)~~(?!~)")
MD_HEAD = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S[^\n]*?)[ \t]*#*[ \t]*$", re.M)
MD_SETEXT = re.compile(r"^(?![ \t]*(?:[-=|>#*+]|\d+[.)]))( {0,3}\S[^\n|]*)\n {0,3}(={2,}|-{2,})[ \t]*$", re.M)
MD_RULE = re.compile(r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$", re.M)
MD_TABLE = re.compile(r"^[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[ \t]*:?-+:?[ \t]*\|[ \t]*$", re.M)
MD_QUOTE = re.compile(r"^ {0,3}>(?!>)[ \t]?(?=\S)", re.M)
MD_TASK = re.compile(r"^[ \t]*[-*+][ \t]+\[[ xX]\][ \t]", re.M)
MD_NOTE = re.compile(r"\[\^[^\]\s]+\]")

WIKI_LINK = re.compile(r"\[\[([^\[\]\n|]+)(?:\|([^\[\]\n]*))?\]\]")
WIKI_TEMPLATE = re.compile(r"\{\{([^{}\n|]+)((?:\|[^{}]*)*)\}\}")
WIKI_BOLD = re.compile(r"(?<!')('{2,3}|'{5})(?=[^'\s])((?:[^'\n]|'(?!'))+?)(?<=[^\s])\1(?!')")
WIKI_HEAD = re.compile(r"^(={1,6})[ \t]*([^=\s][^\n]*?)[ \t]*\1[ \t]*$", re.M)
WIKI_TABLE = re.compile(r"^[ \t:]*\{\|[^\n]*$|^[ \t]*\|\}[ \t]*$|^[ \t]*\|-+[ \t]*$", re.M)
WIKI_URL = re.compile(r"(?<![\]\[\w!])\[((?:https?|ftp|mailto):(?://)?[^\s\[\]]+)(?:[ \t]+([^\[\]\n]+))?\](?!\()")
WIKI_TAG = re.compile(r"</?(?:ref|references|nowiki|gallery|syntaxhighlight|includeonly|noinclude)\b[^<>]*>", re.I)
WIKI_LIST = re.compile(r"^(?:\*{2,}|\*+[#:;]+|#+[*:;]+)[ \t]+(?=[^\s*])", re.M)
WIKI_MAGIC = re.compile(r"__(?:NO)?(?:TOC|FORCETOC|EDITSECTION|INDEX)__")

TEX_ENV = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})*")
TEX_DOLLAR = re.compile(r"(?<![\\$\w])\$(?![\s$])((?:[^$\n\\]|\\.)+?)(?<![\s\\])\$(?![\d$])")
TEX_COMMAND = re.compile(r"(?<![\w\\])\\([A-Za-z]{2,}|[a-zA-Z](?=\{))\*?(?:\[[^\[\]\n]*\])*\{")
TEX_BARE = re.compile(r"(?<![\w\\:/.])\\(?:item|par|noindent|newline|newpage|clearpage|maketitle|tableofcontents|LaTeX|TeX|ldots|dots|centering|hline|quad|qquad|smallskip|medskip|bigskip|today|appendix)(?![A-Za-z\\])")
_MATH_SIGN = re.compile(r"[\\^_={}+<>]|^[A-Za-z]$|^[A-Za-z]\(")


def _blank(s: str) -> str:
    return re.sub(r"[^\n]", " ", s)


def split_code(text: str) -> tuple[str, list[tuple[int, int, str, str]]]:
    """Text with code and its marks blanked (positions kept), and the pieces: start, end, family of the mark, code."""
    pieces: list[tuple[int, int, str, str]] = []

    def cut(pattern: re.Pattern, family: str, group, s: str) -> str:
        def one(m: re.Match) -> str:
            g = group(m)
            if g is None:
                return m.group()
            pieces.append((m.start(), m.end(), family, g))
            return _blank(m.group())

        return pattern.sub(one, s)

    out = text
    if "```" in out or "~~~" in out:
        out = cut(FENCE, "markdown", lambda m: m[4], out)
    if "\\begin{" in out or "\\verb" in out or "\\lstinline" in out:
        out = cut(VERBATIM, "latex", lambda m: m[2] if m[1] else m[4], out)
    low = out.lower()
    if "<nowiki" in low or "<syntaxhighlight" in low or "<source" in low:
        out = cut(WIKI_CODE, "wiki", lambda m: m[3], out)
    if "`" in out:
        out = cut(INLINE, "markdown", lambda m: m[2], out)
    if "</" in out:
        out = cut(PRE, "html", lambda m: m[3], out)
    return out, sorted(pieces)


Marks = Iterator[tuple[int, int]]
_MATH_OPEN = re.compile(r"\\\(|\\\[|(?<![\\$])\$\$(?!\$)")
_MATH_CLOSE = {"\\(": re.compile(r"\\\)"), "\\[": re.compile(r"\\\]"), "$$": re.compile(r"(?<!\\)\$\$")}
_PARAGRAPH = re.compile(r"\n[ \t]*\n")


def formulas(s: str) -> Marks:
    """Formulas between \\( \\), \\[ \\] or $$ $$ of any length; like in TeX, none goes past a blank line.  Linear in the text."""
    at, blank = 0, -1
    none: dict[str, int] = {}  # for each opener, up to where no closer was found
    while m := _MATH_OPEN.search(s, at):
        kind, at = m.group(), m.end()
        if blank < at:
            stop = _PARAGRAPH.search(s, at)
            blank = stop.start() if stop else len(s)
        if at < none.get(kind, 0):
            continue
        close = _MATH_CLOSE[kind].search(s, min(at + 1, blank), blank)
        if close is None:
            none[kind] = blank
        else:
            yield m.start(), close.end()
            at = close.end()


def _closed(s: str) -> set[str]:
    """Names of the elements that have an end tag."""
    return {x.lower() for x in re.findall(r"</([A-Za-z][A-Za-z0-9]*)\s*>", s)}


def _html_marks(s: str) -> Marks:
    if "<!" in s:
        yield from (m.span() for m in COMMENT.finditer(s))
    if "&" in s:
        for m in REFERENCE.finditer(s):
            name = m.group()[1:]
            if name[0] == "#" or name in html.entities.html5:
                yield m.span()
    if "<" in s:
        closed = _closed(s)
        yield from (m.span() for m in TAG.finditer(s) if _is_tag(m, closed))


def _is_tag(m: re.Match, closed: set[str]) -> bool:
    """An element and not a placeholder, a type in angle brackets or a comparison.

    Words after the name must be attributes with values or known bare ones; an
    element without attributes counts if it needs no end tag or has one.
    """
    name, rest = m[2].lower(), m[3].strip().rstrip("/").strip()
    if name not in ELEMENTS:
        return False
    if rest:
        return "=" in rest or set(rest.lower().split()) <= BARE_ATTRIBUTES
    return bool(m[1]) or name in VOID or name in LOOSE_END or m[3].endswith("/") or name in closed


# Signs without which a pattern cannot match, and the patterns, by family.
_MARKDOWN = (("](", MD_LINK), ("[^", MD_NOTE), ("][", MD_REF), ("#", MD_HEAD), (">", MD_QUOTE), ("~~", MD_STRIKE), ("--", MD_TABLE), ("--", MD_RULE), ("***", MD_RULE), ("__", MD_RULE), ("==", MD_SETEXT), ("--", MD_SETEXT), ("<", MD_AUTO), ("]: ", MD_DEF), ("[", MD_TASK))
_WIKI = (("[[", WIKI_LINK), ("''", WIKI_BOLD), ("{|", WIKI_TABLE), ("|}", WIKI_TABLE), ("**", WIKI_LIST), ("[", WIKI_URL), ("<", WIKI_TAG), ("__", WIKI_MAGIC))
_LATEX = (("\\", TEX_ENV), ("\\", TEX_COMMAND), ("\\", TEX_BARE))


def _matches(s: str, table: tuple) -> Marks:
    for sign, pattern in table:
        if sign in s:
            yield from (m.span() for m in pattern.finditer(s))


def _markdown_marks(s: str) -> Marks:
    yield from _matches(s, _MARKDOWN)
    if "*" in s or "_" in s:
        for p in (MD_STRONG, MD_EM):
            for m in p.finditer(s):
                if m.group()[0] == "*" or not _DUNDER.match(m.group()):
                    yield m.span()


# Names of Python between double underscores are no emphasis.
_DUNDER = re.compile(r"__(?:init|main|name|file|all|doc|dict|call|repr|str|len|iter|next|enter|exit|new|del|slots|version|author|future|import|getattr|setattr|post_init|getitem|setitem|class|module|path|builtins)__$")


def _wiki_marks(s: str) -> Marks:
    yield from _matches(s, _WIKI)
    if "{{" in s:
        yield from (m.span() for m in WIKI_TEMPLATE.finditer(s) if _is_template(m))
    if "==" in s:
        yield from (m.span() for m in WIKI_HEAD.finditer(s) if len(m[1]) >= 2)


def _is_template(m: re.Match) -> bool:
    """A template call; a single name in double braces is a placeholder."""
    return bool(m[2]) or ":" in m[1] or m[1].strip() != m[1].strip().lower() and " " in m[1].strip()


def _latex_marks(s: str) -> Marks:
    yield from _matches(s, _LATEX)
    if "\\(" in s or "\\[" in s or "$$" in s:
        yield from formulas(s)
    if "$" in s:
        yield from (m.span() for m in TEX_DOLLAR.finditer(s) if _is_formula(m))


def _is_formula(m: re.Match) -> bool:
    return bool(_MATH_SIGN.search(m[1])) and not re.fullmatch(r"\{?[A-Z_][A-Z0-9_]*\}?.*", m[1]) or bool(re.fullmatch(r"[A-Za-z]", m[1]))


MARKS = {"html": _html_marks, "markdown": _markdown_marks, "wiki": _wiki_marks, "latex": _latex_marks}
_ANY = re.compile(r"[<>&*_`#~\[\]{}|$\\=]|''|--")


class Region(NamedTuple):
    family: str
    start: int
    end: int
    n_marks: int
    score: float


def best_region(text: str, marks: list[tuple[int, int]]) -> tuple[int, int, int, float]:
    """Start, end, marks and score of the stretch with the highest sum: ``MARK_SCORE`` a mark, ``PLAIN_SCORE`` a word between marks; the first of equals.

    Any best stretch begins and ends with a mark, so one pass over the sorted marks finds it.
    """
    best, total, begin, n, last = (0, 0, 0, 0.0), 0.0, 0, 0, 0
    for a, b in sorted(marks):
        if n:
            total += PLAIN_SCORE * len(text[last:a].split()) if a > last else 0.0
        if not n or total <= 0:
            begin, total, n = a, 0.0, 0
        total += MARK_SCORE
        n += 1
        last = max(last, b)
        if total > best[3]:
            best = (begin, last, n, total)
    return best


def residue(text: str | None, front_matter: bool = False) -> list[Region]:
    """The best region of each family of markup in a text; ``front_matter`` leaves out a leading block between --- lines."""
    if not text:
        return []
    skipped = 0
    if front_matter and text.startswith(("---", "\ufeff---")) and (m := FRONT.match(text)):
        skipped = m.end()
        text = text[skipped:]
    if not _ANY.search(text):
        return []
    rest, code = split_code(text)
    # comment marks go, what they hold is read like the text around them; positions stay
    shown = rest.replace("<!--", "   \n").replace("-->", "  \n") if "<!--" in rest else rest
    out = []
    for family, find in MARKS.items():
        marks = [(a, b) for a, b, f, _ in code if f == family]
        marks += find(rest if family == "html" else shown)
        a, b, n, score = best_region(text, marks)
        if score > 0:
            out.append(Region(family, skipped + a, skipped + b, n, score))
    return out


def families(text: str | None, front_matter: bool) -> list[str]:
    """Families of markup whose best region scores above nothing."""
    return [r.family for r in residue(text, front_matter)]


# -- clean text ------------------------------------------------------------------------------------

_BLOCK_TAGS = set("address article aside blockquote body center details dd dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td th thead title tr ul br".split())
_TOKEN = re.compile(r"<[^<>]*>|\x00\d+\x00|[^\W_]+")
_HIDDEN = re.compile(r"<(script|style|head|noscript|template|svg|iframe)\b[^>]*>[\s\S]*?</\1\s*>", re.I)
_LISTS = {"ul", "ol", "dl"}
_ITEMS = {"li", "dt", "dd"}
_FREE = re.compile(r"</?(?:h[1-6]|ul|ol|dl|li|dt|dd)\b", re.I)
_FURNITURE = {"nav", "footer", "aside"}
# Headings and list items of the other families, and code or formulas set aside with the text around them.
_MARKED_LINE = re.compile(r"^[ \t]*(?:#{1,6}[ \t]|[-*+][ \t]|\d{1,9}[.)][ \t]|[*#:;]{2,}[ \t]|={2,6}[^=\n]+={2,6}[ \t]*$|\\(?:part|chapter|(?:sub)*section|paragraph|item)\b)[^\n<]*|^[^\n<]*\S[^\n<]*\n {0,3}(?:={2,}|-{2,})[ \t]*$", re.M)
_SET_ASIDE = re.compile(r"[^<>\x00]*(?:\x00\d+\x00[^<>\x00]*)+")
_EDGE = re.compile(r"(?:[^<>\w\x00]|_|</[A-Za-z][^<>]*>)*")


def content_region(text: str) -> tuple[int, int]:
    """Stretch of an HTML page with the highest sum of word and tag scores; one pass, first of equals.

    Tags of headings and lists cost nothing and stay with the words they lead.
    """
    best, best_span, total, begin, leading = 0.0, (0, 0), 0.0, None, False
    for m in _TOKEN.finditer(text):
        tag = m.group()[0] == "<"
        free = tag and bool(_FREE.match(m.group()))
        if begin is None or total < 0 or total == 0 and not leading:
            begin, total, leading = m.start(), 0.0, True
        leading = leading and free
        total += 0.0 if free else TAG_SCORE if tag else WORD_SCORE
        if total > best:
            best, best_span = total, (begin, m.end())
    return best_span


def _structure(s: str) -> list[tuple[int, int]]:
    """Spans of headings, lists, code and formulas of a page, without those in elements of page furniture."""
    spans: list[tuple[int, int]] = []
    closed: list[tuple[int, int]] = []
    furniture = lists = 0
    outer = list_at = 0
    open_at: int | None = None  # a heading, or an item without a list
    open_name = ""
    for m in TAG.finditer(s):
        name, end = m[2].lower(), bool(m[1])
        if open_at is not None and (name == open_name or name in _BLOCK_TAGS and name != "br"):
            spans.append((open_at, m.end() if end and name == open_name else m.start()))
            open_at = None
        if name in _FURNITURE:
            if not end:
                outer = outer if furniture else m.start()
                furniture += 1
            elif furniture:
                furniture -= 1
                if not furniture:
                    closed.append((outer, m.end()))
        elif name in _LISTS:
            if not end:
                list_at = list_at if lists else m.start()
                lists += 1
            elif lists:
                lists -= 1
                if not lists:
                    spans.append((list_at, m.end()))
        elif not end and not lists and (name in _ITEMS or re.fullmatch(r"h[1-6]", name)):
            open_at, open_name = m.start(), name
    if lists:
        spans.append((list_at, len(s)))
    if open_at is not None:
        spans.append((open_at, len(s)))
    spans += [m.span() for p in (_MARKED_LINE, _SET_ASIDE) for m in p.finditer(s)]
    spans.sort()
    out, k = [], 0
    for a, b in spans:
        while k < len(closed) and closed[k][1] <= a:
            k += 1
        if k == len(closed) or a < closed[k][0]:
            out.append((a, b))
    return out


def _content(s: str) -> str:
    """Content region of a page together with the structure outside it, in order; a page without words stays whole."""
    a, b = content_region(s)
    if b <= a:
        return s
    # only signs and closing tags stand between the last word and what the scan left out, only signs before the first
    b = _EDGE.match(s, b).end()
    while a and s[a - 1] not in "<>\x00" and not s[a - 1].isalnum():
        a -= 1
    merged: list[list[int]] = []
    for x, y in sorted([(a, b), *_structure(s)]):
        if merged and x <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], y)
        else:
            merged.append([x, y])
    return "\n".join(s[x:y] for x, y in merged)


def clean(text: str | None, front_matter: bool = False) -> str | None:
    """Clean text: headings as ``# ``, list items as ``- ``, code between fences or backquotes, formulas as written."""
    if not text:
        return text
    if front_matter:
        text = FRONT.sub("", text, count=1)
    if not _ANY.search(text):
        return text
    rest, code = split_code(text)
    page = bool(re.search(r"<html\b", rest, re.I) and re.search(r"<body\b", rest, re.I))
    if page:
        starts = {a for a, _, _, _ in code}
        text = _HIDDEN.sub(lambda m: " " if rest[m.start()] == "<" or m.start() in starts else m.group(), text)
        _, code = split_code(text)
    kept: list[str] = []

    def keep(piece: str) -> str:
        kept.append(piece)
        return f"\x00{len(kept) - 1}\x00"

    parts, at = [], 0
    for a, b, _, inner in code:
        if a < at:
            continue
        block = "\n" in inner.strip("\n") or text[a:b].lstrip().startswith(("```", "~~~", "\\begin"))
        inner = html.unescape(inner) if text[a] == "<" else inner
        parts += [text[at:a], keep(f"\n```\n{inner.strip(chr(10))}\n```\n" if block else f"`{inner.strip()}`")]
        at = b
    s = "".join([*parts, text[at:]])
    pieces, at = [], 0
    for a, b in formulas(s):
        pieces += [s[at:a], keep(s[a:b])]
        at = b
    s = "".join([*pieces, s[at:]])
    s = TEX_DOLLAR.sub(lambda m: keep(m.group()) if _is_formula(m) else m.group(), s)
    s = _content(s) if page else s
    s = _clean_tex(s)
    s = _clean_wiki(s)
    s = _clean_markdown(s)
    s = _clean_html(s)
    s = re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], s)
    s = re.sub(r"[ \t]+$", "", s, flags=re.M)
    return re.sub(r"\n{3,}", "\n\n", s).strip("\n")


def _clean_tex(s: str) -> str:
    if "\\" not in s:
        return s
    s = re.sub(r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}", lambda m: "\n" + "#" * {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}[m[1]] + " " + m[2] + "\n", s)
    s = re.sub(r"\\item\b(?:\[([^\]]*)\])?[ \t]*", lambda m: "- " + (m[1] + ": " if m[1] else ""), s)
    s = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", s)
    s = re.sub(r"\\(?:cite[a-z]*|ref|eqref|pageref|label|index|bibliography\w*|usepackage|documentclass|input|include\w*|vspace|hspace)\*?(?:\[[^\]]*\])*\{[^{}]*\}", "", s)
    s = TEX_ENV.sub("", s)
    return TEX_BARE.sub("", _unwrapped(s))


_TEX_BRACE = re.compile(r"(?<![\w\\])\\[A-Za-z]{2,}\*?(?:\[[^\[\]\n]*\])*\{|\\[{}]|\{|\}~?")
_MD_BRACKET = re.compile(r"!?\[|\]|\n")
_MD_TAIL = re.compile(r"\]\(\s*(?:<[^<>\n]*>|(?:[^()\s]|\([^()\s]*\))*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)")


def _unwrapped(s: str) -> str:
    """Commands with an argument give their argument, at any depth; one pass with a stack of open braces."""
    opened: list[tuple[int, int] | None] = []
    cuts: list[tuple[int, int, str]] = []
    for m in _TEX_BRACE.finditer(s):
        t = m.group()
        if t[0] == "}":
            if opened and (o := opened.pop()):
                cuts += [(*o, ""), (*m.span(), " ")]
        elif t == "{":
            opened.append(None)
        elif len(t) > 2:
            opened.append(m.span())
    return _cut(s, cuts)


def _unlinked(s: str) -> str:
    """Inline links and images give their label, nested ones too; one pass with a stack of open brackets."""
    opened: list[tuple[int, int]] = []
    cuts: list[tuple[int, int, str]] = []
    at = 0
    while m := _MD_BRACKET.search(s, at):
        at = m.end()
        if m.group() == "\n":
            opened.clear()
        elif m.group() != "]":
            opened.append(m.span())
        elif opened:
            o = opened.pop()
            if tail := _MD_TAIL.match(s, m.start()):
                cuts += [(*o, ""), (*tail.span(), "")]
                at = tail.end()
    return _cut(s, cuts)


def _cut(s: str, cuts: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, instead in sorted(cuts):
        out += [s[at:a], instead]
        at = b
    return "".join([*out, s[at:]])


def _clean_wiki(s: str) -> str:
    if "[[" in s:
        s = WIKI_LINK.sub(lambda m: "" if re.match(r"(?:File|Image|Category):", m[1], re.I) else (m[2] or m[1]).split("|")[-1], s)
    if "{{" in s:
        s = WIKI_TEMPLATE.sub(lambda m: m[2].split("|")[-1] if _is_template(m) else m.group(), s)
    if "[" in s:
        s = WIKI_URL.sub(lambda m: m[2] or m[1], s)
    if "''" in s:
        s = WIKI_BOLD.sub(lambda m: m[2], s)
    if "==" in s:
        s = WIKI_HEAD.sub(lambda m: "#" * len(m[1]) + " " + m[2] if len(m[1]) > 1 else m.group(), s)
    if "{|" in s:
        s = WIKI_TABLE.sub("", s)
        s = re.sub(r"^[ \t]*!\s*", "", s, flags=re.M)
    if "**" in s:
        s = WIKI_LIST.sub(lambda m: "  " * (len(m.group().strip()) - 1) + "- ", s)
    return WIKI_MAGIC.sub("", s)


def _clean_markdown(s: str) -> str:
    s = MD_SETEXT.sub(lambda m: ("# " if m[2][0] == "=" else "## ") + m[1].strip(), s)
    s = MD_HEAD.sub(lambda m: m[1] + " " + m[2], s)
    s = MD_DEF.sub("", s)
    s = _unlinked(s) if "](" in s else s
    s = MD_REF.sub(lambda m: m[1], s)
    s = MD_AUTO.sub(lambda m: m[1], s)
    s = MD_STRONG.sub(lambda m: m[1] or m[2], s)
    s = MD_EM.sub(lambda m: m[1] or m[2], s)
    s = MD_STRIKE.sub(lambda m: m[1], s)
    s = MD_TABLE.sub("", s)
    s = re.sub(r"^[ \t]*\|(.*)\|[ \t]*$", lambda m: " ; ".join(x.strip() for x in m[1].split("|")), s, flags=re.M)
    s = MD_RULE.sub("", s)
    s = re.sub(r"^( {0,3})>[ \t]?", r"\1", s, flags=re.M)
    return re.sub(r"^([ \t]*)[*+][ \t]+(?=\S)", r"\1- ", s, flags=re.M)


def _clean_html(s: str) -> str:
    if "<" in s:
        s = re.sub(r"<!--|-->", "", s)
        s = COMMENT.sub("", s)

        closed = _closed(s)

        def tag(m: re.Match) -> str:
            if not _is_tag(m, closed):
                return m.group()
            name = m[2].lower()
            if not m[1]:
                if re.fullmatch(r"h[1-6]", name):
                    return "\n" + "#" * int(name[1]) + " "
                if name == "li":
                    return "\n- "
            return "\n" if name in _BLOCK_TAGS else ""

        s = TAG.sub(tag, s)
    return html.unescape(s) if "&" in s else s


def markup_regions(df: DataFrame, id_col: str, text_col: str, kind: str, front_matter: bool = False) -> DataFrame:
    """``record_kind, record_id, markup, start_char, end_char, n_marks, score``: the best region of each family in each row of ``df``."""
    return map_rows(
        df.where(f"`{text_col}` is not null"),
        lambda i, text: [(kind, i, *r) for r in residue(text, front_matter)],
        "record_kind string, record_id long, markup string, start_char int, end_char int, n_marks int, score double",
        [id_col, text_col],
    )


def markup_families(df: DataFrame, id_col: str, text_col: str, kind: str, front_matter: bool = False) -> DataFrame:
    """``record_kind, record_id, markup``: a row for each family in each row of ``df``."""
    return markup_regions(df, id_col, text_col, kind, front_matter).select("record_kind", "record_id", "markup")


def clean_texts(df: DataFrame, id_col: str, text_col: str, kind: str, front_matter: bool = False) -> DataFrame:
    """``record_kind, record_id, text_clean`` of every row with text."""
    return map_rows(
        df.where(f"`{text_col}` is not null"),
        lambda i, text: [(kind, i, clean(text, front_matter))],
        "record_kind string, record_id long, text_clean string",
        [id_col, text_col],
    )

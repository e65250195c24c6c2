"""Markdown files: front matter, blocks, links, comments, load-time commands, code units."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import yaml
from pyspark.sql import DataFrame

from .inspect import _map

KINDS = ("skill_manifest", "instruction", "agent_identity", "doc")
FRONT_LIMIT = 16_384
FLOW_LIMIT = 256
TOKENS_KEPT = 25
_HEAD = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*#*[ \t]*$")
_FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})[ \t]*([^\n]*)$")
_LIST = re.compile(r"^[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+\S")
_DEF = re.compile(r"^ {0,3}\[[^\]\n]+\]:[ \t]*\S")
_LINK = re.compile(r"!?\[(?:[^\[\]\n]|\[[^\[\]\n]*\])*\]\(\s*(<[^<>\n]*>|(?:[^()\s]|\([^()\s]*\))*)")
_TABLE = re.compile(r"^[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[ \t]*:?-+:?[ \t]*\|[ \t]*$")


def front_matter_end(lines: list[str]) -> int:
    """Last line (from 1) of the front matter, 0 if there is none or it does not end."""
    if lines[0].rstrip() != "---":
        return 0
    return next((i + 1 for i in range(1, len(lines)) if lines[i].rstrip() in ("---", "...")), 0)


def front_matter(text: str) -> tuple[dict, dict[str, int], int, list[str]]:
    """Keys with plain values, line of each key, end line (0 if there is no block) and error codes.

    The block is read as a node graph, never constructed: an anchor or alias,
    a tag that would construct an object, more than one document or a block
    that is no mapping give a code instead of values.
    """
    lines = text.split("\n")
    if lines[0].rstrip() != "---":
        return {}, {}, 0, []
    end = front_matter_end(lines) - 1
    if end < 0:
        return {}, {}, 0, ["frontmatter_unterminated"]
    body = "\n".join(lines[1:end])
    if len(body) > FRONT_LIMIT:
        return {}, {}, end + 1, ["frontmatter_too_large"]
    if sum(body.count(c) for c in "[{") > FLOW_LIMIT:
        return {}, {}, end + 1, ["frontmatter_too_deep"]
    try:
        for event in yaml.parse(body, Loader=yaml.SafeLoader):
            if getattr(event, "anchor", None):
                return {}, {}, end + 1, ["yaml_alias_budget"]
        nodes = list(yaml.compose_all(body, Loader=yaml.SafeLoader))
    except yaml.YAMLError as e:
        mark = getattr(e, "problem_mark", None)
        return {}, {}, end + 1, [f"yaml_error:line {mark.line + 2}" if mark else "yaml_error"]
    except RecursionError:
        return {}, {}, end + 1, ["frontmatter_too_deep"]
    if len(nodes) > 1:
        return {}, {}, end + 1, ["yaml_error"]
    if not nodes or nodes[0] is None:
        return {}, {}, end + 1, []
    if not isinstance(nodes[0], yaml.MappingNode):
        return {}, {}, end + 1, ["frontmatter_not_a_mapping"]
    values, places = {}, {}
    for key, value in nodes[0].value:
        places[str(key.value)] = key.start_mark.line + 2
        values[str(key.value)] = _plain(value)
    codes = ["yaml_unsafe_tag"] if unsafe_tags(text) else []
    return values, places, end + 1, codes


def _plain(node: yaml.Node) -> object:
    if isinstance(node, yaml.ScalarNode):
        return node.value
    if isinstance(node, yaml.SequenceNode):
        return [_plain(x) for x in node.value]
    return {str(k.value): _plain(v) for k, v in node.value}


def unsafe_tags(text: str) -> list[tuple[str, int, int]]:
    """``(tag, line, column)`` of tags in the front matter that construct objects."""
    m = re.match(r"---[ \t]*\n(.*?)^(?:---|\.\.\.)[ \t]*$", text, re.S | re.M)
    if not m:
        return []
    out = []
    try:
        for t in yaml.scan(m[1], Loader=yaml.SafeLoader):
            if isinstance(t, yaml.TagToken) and not (t.value[0] == "!!" and t.value[1] in ("str", "int", "float", "bool", "null", "seq", "map", "timestamp", "set", "omap", "binary", "pairs")):
                out.append(("".join(x or "" for x in t.value), t.start_mark.line + 2, t.start_mark.column + 1))
    except yaml.YAMLError:
        pass
    return out


def blocks(text: str) -> list[tuple[str, int, int, str]]:
    """``(kind, first line, last line, detail)`` of the blocks of a document.

    Kinds: front_matter, heading, fence, code (indented), html, list, quote,
    table, reference, prose.  Detail is the level and text of a heading or the
    info string of a fence.
    """
    lines = text.split("\n")
    i = front_matter_end(lines)
    out: list[tuple[str, int, int, str]] = [("front_matter", 1, i, "")] if i else []

    def add(kind: str, a: int, b: int, detail: str = "") -> None:
        out.append((kind, a + 1, b, detail))

    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
            continue
        j = i + 1
        if m := _FENCE.match(line):
            if "`" in m[3] and m[2][0] == "`":
                m = None
            else:
                while j < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$", lines[j]):
                    j += 1
                add("fence", i, min(j + 1, len(lines)), m[3].strip())
                i = j + 1
                continue
        if m := _HEAD.match(line):
            add("heading", i, j, f"{len(m[1])} {m[2] or ''}".strip())
        elif re.match(r"^(?: {4}|\t)", line):
            while j < len(lines) and (re.match(r"^(?: {4}|\t)", lines[j]) or not lines[j].strip() and j + 1 < len(lines) and re.match(r"^(?: {4}|\t)", lines[j + 1])):
                j += 1
            add("code", i, j)
        elif _DEF.match(line):
            add("reference", i, j)
        elif re.match(r"^ {0,3}<(?:!--|[/?!A-Za-z])", line):
            close = "-->" if line.lstrip().startswith("<!--") else None
            while j < len(lines) and ((close not in "\n".join(lines[i:j])) if close else lines[j].strip()):
                j += 1
            add("html", i, j)
        elif re.match(r"^ {0,3}>", line):
            while j < len(lines) and lines[j].strip() and not _HEAD.match(lines[j]):
                j += 1
            add("quote", i, j)
        elif j < len(lines) and "|" in line and _TABLE.match(lines[j]):
            j += 1
            while j < len(lines) and "|" in lines[j]:
                j += 1
            add("table", i, j)
        elif _LIST.match(line):
            while j < len(lines) and (lines[j].strip() and not _HEAD.match(lines[j]) and not _FENCE.match(lines[j])):
                j += 1
            add("list", i, j)
        else:
            while j < len(lines) and lines[j].strip() and not _HEAD.match(lines[j]) and not _FENCE.match(lines[j]) and not _LIST.match(lines[j]) and not re.match(r"^ {0,3}>", lines[j]):
                if re.match(r"^ {0,3}(?:=+|-{2,})[ \t]*$", lines[j]) or "|" in lines[j] and j + 1 < len(lines) and _TABLE.match(lines[j + 1]):
                    break
                j += 1
            if j < len(lines) and re.match(r"^ {0,3}(?:=+|-{2,})[ \t]*$", lines[j]):
                add("heading", i, j + 1, f"{1 if '=' in lines[j] else 2} {' '.join(x.strip() for x in lines[i:j])}")
                j += 1
            else:
                add("prose", i, j)
        i = j
    return out


def links(text: str) -> list[tuple[str, int]]:
    """``(target, line)`` of inline links outside code."""
    lines = text.split("\n")
    code = {n for k, a, b, _ in blocks(text) if k in ("fence", "code", "front_matter") for n in range(a, b + 1)}
    out = []
    for n, line in enumerate(lines, 1):
        if n not in code and "](" in line:
            shown = re.sub(r"(`+)[^`]+\1", lambda m: " " * len(m.group()), line)
            out += [(m[1].strip("<>"), n) for m in _LINK.finditer(shown) if m[1]]
    return out


class _Comments(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.found: list[tuple[str, int, int]] = []

    def handle_comment(self, data: str) -> None:
        line, column = self.getpos()
        self.found.append((data, line, column + 1))


def comments(text: str) -> list[tuple[str, int, int]]:
    """``(body, line, column)`` of HTML comments outside code."""
    code = {n for k, a, b, _ in blocks(text) if k in ("fence", "code") for n in range(a, b + 1)}
    shown = "\n".join(re.sub(r"[^\n]", " ", line) if n in code else line for n, line in enumerate(text.split("\n"), 1))
    p = _Comments()
    p.feed(shown)
    return p.found


def bang_tokens(text: str) -> list[tuple[str, str, int, int, bool]]:
    """``(kind, code, line, column, runs)`` of load-time commands: inline ones and fenced ones.

    An inline one runs only at the start of a line or after a blank, outside
    fences, tables and longer code spans.  All of them are given; the scan keeps
    ``TOKENS_KEPT`` of each kind of a file and counts the rest in a note.
    """
    out: list[tuple[str, str, int, int, bool]] = []
    lines = text.split("\n")
    skip = set()
    for kind, a, b, info in blocks(text):
        if kind == "fence" and info.startswith("!"):
            code = "\n".join(lines[a : b - 1])
            if code.strip():
                out.append(("fenced", code, a, 1, True))
        if kind in ("fence", "code", "table"):
            skip.update(range(a, b + 1))
    for n, line in enumerate(lines, 1):
        if n in skip or "!`" not in line:
            continue
        for m in re.finditer(r"(?<!`)!`(?!`)([^`\n]+)`(?!`)", line):
            runs = m.start() == 0 or line[m.start() - 1].isspace()
            out.append(("inline", m[1], n, m.start() + 1, runs))
    return out


_LANGUAGES = {"sh": "shell", "bash": "shell", "shell": "shell", "zsh": "shell", "console": "shell", "py": "python", "python": "python", "python3": "python", "js": "javascript", "javascript": "javascript", "node": "javascript", "ts": "typescript", "typescript": "typescript"}


def code_units(rel: str, text: str) -> list[tuple[str, str, str]]:
    """``(language, origin, code)`` of the fenced code of a document: one unit a language, each fence at the line it stands on."""
    lines = text.split("\n")
    units: dict[str, list[str]] = {}
    for kind, a, b, info in blocks(text):
        language = _LANGUAGES.get(re.split(r"[\s{,]", info.strip().lower(), maxsplit=1)[0]) if kind == "fence" and info else None
        if language:
            body = lines[a : b - 1] if re.match(r"^ {0,3}[`~]{3,}[ \t]*$", lines[b - 1]) else lines[a:b]
            if language == "shell":
                body = [re.sub(r"^[$>#] ", "", x) for x in body]
            out = units.setdefault(language, [])
            out += [""] * (a - len(out)) + body
    return [(language, "fence", "\n".join(code)) for language, code in units.items()]


def _documents(df: DataFrame) -> DataFrame:
    return df.where(f"text is not null and kind in {KINDS}")


def document_blocks(df: DataFrame) -> DataFrame:
    return _map(_documents(df), ["pkg_id", "rel", "text"], lambda p, r, t: [(p, r, *b) for b in blocks(t)], "pkg_id string, rel string, block string, start_line int, end_line int, detail string")


def document_links(df: DataFrame) -> DataFrame:
    return _map(_documents(df), ["pkg_id", "rel", "text"], lambda p, r, t: [(p, r, *x) for x in links(t)], "pkg_id string, rel string, href string, line_no int")


def document_comments(df: DataFrame) -> DataFrame:
    return _map(_documents(df), ["artifact_id", "text"], lambda i, t: [(i, *c) for c in comments(t)], "artifact_id long, body string, line_no int, col_no int")


def document_keys(df: DataFrame) -> DataFrame:
    """Keys of the front matter with their lines; a block that cannot be read gives its code with an empty key."""

    def one(p: str, r: str, t: str) -> list[tuple]:
        values, places, end, codes = front_matter(t)
        return [(p, r, k, places[k], str(values[k]), None) for k in values] + [(p, r, "", None, None, c) for c in codes]

    return _map(_documents(df), ["pkg_id", "rel", "text"], one, "pkg_id string, rel string, key string, line_no int, value string, code string")


def load_time_commands(df: DataFrame) -> DataFrame:
    return _map(_documents(df), ["pkg_id", "rel", "text"], lambda p, r, t: [(p, r, *b) for b in bang_tokens(t)], "pkg_id string, rel string, token string, code string, line_no int, col_no int, runs boolean")


def fenced_code(df: DataFrame) -> DataFrame:
    return _map(_documents(df), ["pkg_id", "rel", "text"], lambda p, r, t: [(p, r, *u) for u in code_units(r, t)], "pkg_id string, rel string, language string, origin string, code string")


_BLOCK_ELEMENTS = "address|article|aside|blockquote|center|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|menu|nav|ol|p|section|summary|table|tbody|td|tfoot|th|thead|tr|ul"
_BLOCK_TAG = re.compile(rf"(?i)</?(?:{_BLOCK_ELEMENTS})\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>")
_HIDING = re.compile(r"(?i)\bhidden\b|\baria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*(?:display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0|opacity\s*:\s*0(?![.\d])|(?:width|height)\s*:\s*0|color\s*:\s*(?:transparent|#?fff(?:fff)?\b|white))")
_ACTIVE = re.compile(r"(?i)<(?:script|iframe|object|embed|applet|meta|base|form)\b|\bon[a-z]+\s*=\s*[\"']|(?:href|src|action)\s*=\s*[\"']?\s*(?:javascript|vbscript|data):")


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m.group())


def html_prose(text: str) -> list[tuple[str, int]]:
    """``(prose, line)`` of the HTML blocks of a document: the tags of block elements blanked, so that every sign keeps its place; comments and blocks without words give none."""
    lines = text.split("\n")
    out = []
    for kind, a, b, _ in blocks(text):
        if kind != "html" or re.match(r"^ {0,3}<[!?]", lines[a - 1]):
            continue
        shown = _BLOCK_TAG.sub(_blank, "\n".join(lines[a - 1 : b]))
        if re.search(r"\w", re.sub(r"<[^<>]*>", "", shown)):
            out.append((shown, a))
    return out


def html_notes(text: str) -> list[tuple[str, str, int]]:
    """``(code, severity, line)`` of the HTML blocks of a document: ``raw_html`` (high) where text is hidden or content active, the note ``raw_html_markup`` (low) for plain presentational markup."""
    lines = text.split("\n")
    out = []
    for kind, a, b, _ in blocks(text):
        if kind != "html":
            continue
        shown = re.sub(r"<!--[\s\S]*?(?:-->|\Z)", _blank, "\n".join(lines[a - 1 : b]))
        if not re.search(r"<[A-Za-z/]", shown):
            continue
        hidden = any(_HIDING.search(m.group()) for m in re.finditer(r"<[A-Za-z][^<>]*>", shown)) or _ACTIVE.search(shown) or re.search(r"<[A-Za-z][^<>]*\Z", shown)
        out.append(("raw_html", "high", a) if hidden else ("raw_html_markup", "low", a))
    return out


def document_prose(df: DataFrame) -> DataFrame:
    return _map(_documents(df), ["artifact_id", "text"], lambda i, t: [(i, *x) for x in html_prose(t)], "artifact_id long, text string, line_no int")

"""Directives in prose: what a document tells an agent to do, as a reader would take it.

A document is cut into prose blocks (soft line breaks joined, places kept).
Phrases are matched block by block; guards leave out what is quoted, cited,
given as an example, defended against, negated or reported as refused, with the
state of an introduction carried from block to block.  Relations within a file
(a cue and a bundled script under one heading, a credential and an address near
each other, a delivery verb with its recipient) are found within its sections,
lines and sentences.

Null and empty texts give nothing; equal phrases of one rule are reported once
a file, at their first place; positions are 1-based lines and columns.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from typing import NamedTuple

from . import detect, markdown
from .hooks import EVENTS


class Block(NamedTuple):
    kind: str
    text: str  # lines joined by single blanks
    starts: list[int]  # offset of each line in the text
    line: int  # of the first line
    indents: list[int]

    def place(self, at: int) -> tuple[int, int]:
        k = bisect.bisect_right(self.starts, at) - 1
        return self.line + k, at - self.starts[k] + self.indents[k] + 1


def flattened(lines: list[str], first: int, kind: str = "prose") -> Block:
    """Soft line breaks as single blanks, with the place of every line."""
    parts, starts, indents, at = [], [], [], 0
    for row in lines:
        stripped = row.strip()
        starts.append(at)
        indents.append(len(row) - len(row.lstrip()))
        parts.append(stripped)
        at += len(stripped) + 1
    return Block(kind, " ".join(parts), starts, first, indents)


def prose_blocks(text: str) -> list[Block]:
    """Prose of a document in order: paragraphs, headings, quotes, and each item of a list by itself; code, tables and front matter are none."""
    rows = text.split("\n")
    out: list[Block] = []
    for kind, a, b, _ in markdown.blocks(text):
        if kind in ("fence", "code", "front_matter", "table", "reference"):
            continue
        if kind == "html":
            shown = re.sub(r"<!--[\s\S]*?(?:-->|\Z)|<[^<>]*>", lambda m: re.sub(r"[^\n]", " ", m.group()), "\n".join(rows[a - 1 : b]))
            out.append(flattened(shown.split("\n"), a, kind))
        elif kind == "list":
            begin = a - 1
            for i in range(a, b + 1):
                if i == b or re.match(r"^[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+\S", rows[i]):
                    out.append(flattened(rows[begin:i], begin + 1, "item"))
                    begin = i
        else:
            out.append(flattened(rows[a - 1 : b], a, kind))
    return [x for x in out if x.text.strip()]


_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’)]*\s+(?=[A-Z\"'“‘(\[`*])")


def sentence_around(text: str, at: int) -> tuple[int, int]:
    begin = 0
    for m in _SENTENCE.finditer(text):
        if m.end() > at:
            return begin, m.start()
        begin = m.end()
    return begin, len(text)


# -- guards --------------------------------------------------------------------------------------------

_ATTACK = r"(?:attacks?|injections?|attempts?|payloads?|phrases?|patterns?|prompts?|instructions?|requests?|strings?|jailbreaks?|malicious|suspicious|hostile|adversarial|untrusted)"
_EXAMPLE = re.compile(rf"(?i)(?:for example|for instance|e\.g\.|i\.e\.|such as|examples?(?: of [^.:]*)?|(?:phrases?|patterns?|prompts?|payloads?|strings?|attempts?|inputs?|signs?|messages?)(?: such as| like| including)?|{_ATTACK}[^.:]{{0,40}}(?: like| such as| include[sd]?| including)?)\s*[:,]?\s*[\"'“‘`*_(]*$")
_ORDER = re.compile(r"(?i)\b(?:do|follow|perform|execute|complete)\s+(?:all\s+)?(?:of\s+)?(?:the\s+|these\s+)?(?:following|steps?|below)[^.]{0,20}:\s*$")
_DEFENCE = re.compile(rf"(?i)\b(?:detect|prevent|block|flag|reject|refuse|resist|guard|defend|protect|watch|look|scan|check|test|report|warn|filter|catch|recogni[sz]e|identif(?:y|ies)|avoid|mitigat)[a-z]*\b[^.!?]{{0,90}}\b{_ATTACK}\b[^.!?]{{0,60}}$")
_CITED = re.compile(r"(?i)\b(?:says?|said|writes?|wrote|contains?|includ(?:e|es|ing)|reads?|mentions?|phrases?|words?|text|strings?|prompts?|messages?|like|such as|called|named|example|attack(?:er)?s?|injections?|says)\b[^.!?\"“”'‘’`]{0,60}$")
_CONDITION = re.compile(r"(?i)\b(?:if|when|whenever|should|even if)\b[^.!?]{0,80}\b(?:asks?|says?|tells?|requests?|instructs?|wants?|demands?|claims?|tries|is told|are told|is asked|are asked)\b[^.!?]{0,60}$")
_REFUSAL = re.compile(r"(?i)^[^.!?]{0,120}?\b(?:refuse|decline|do not comply|don't comply|never comply|do not (?:do|follow|obey)|don't (?:do|follow|obey)|ignore (?:it|them|that|the request)|report (?:it|them)|stop and ask)\b")
_NEGATED = re.compile(r"(?i)\b(?:never|do not|don't|does not|doesn't|did not|must not|mustn't|should not|shouldn't|cannot|can't|will not|won't|no need to|without|refuse to|instead of|not)\s+(?:\w+\s+){0,2}$")
_LICENCE = re.compile(r"(?i)\b(?:licen[cs]e|warranty|copyright|liabilit)")
_QUOTES = re.compile(r"\"[^\"\n]{1,400}\"|“[^”\n]{1,400}”|(?<!\w)'[^'\n]{2,400}'(?!\w)|‘[^’\n]{1,400}’|`[^`\n]{1,400}`")


def quoted(text: str, a: int, b: int) -> tuple[int, int] | None:
    """The quotation that holds a place, if any."""
    return next((m.span() for m in _QUOTES.finditer(text) if m.start() < a and b < m.end()), None)


def introduces(text: str) -> bool:
    """Whether a block ends in words that cite what follows: an example cue or an attack noun before a colon, and no order to do what follows."""
    s = text.rstrip()
    return s.endswith(":") and not _ORDER.search(s) and bool(_EXAMPLE.search(s) or re.search(rf"(?i)\b{_ATTACK}\b[^.!?]*:$", s))


def guarded(block: Block, a: int, b: int, cited: bool, negation: bool = True) -> bool:
    """Whether a phrase is shown rather than meant."""
    begin, end = sentence_around(block.text, a)
    before, after = block.text[begin:a], block.text[b:end]
    inside = quoted(block.text, a, b)
    if cited and (inside or re.match(r"^(?:[-*+]|\d+[.)])?\s*[\"'“‘`]", block.text)):
        return True
    if inside:
        lead = block.text[begin : inside[0]]
        rest = block.text[inside[1] : end]
        fragments = sum(1 for m in _QUOTES.finditer(block.text[begin:end]))
        if cited or fragments >= 2 or _CITED.search(lead) or re.match(r"(?i)\s*(?:is|are|was|means?|should|must|counts?|will|,? (?:or|and))\b", rest):
            return True
    if _EXAMPLE.search(before) and not _ORDER.search(before) and re.search(r"(?i)example|e\.g\.|such as|like|includ|instance|:\s*[\"'“‘`*_(]*$", before):
        return True
    if _DEFENCE.search(before):
        return True
    if _CONDITION.search(before) and _REFUSAL.search(after):
        return True
    return negation and bool(_NEGATED.search(before))


# -- phrases -------------------------------------------------------------------------------------------


class Phrase(NamedTuple):
    rule: str
    vector: str
    severity: str
    pattern: re.Pattern
    negation: bool = True  # whether a negation before the phrase takes it back


_CORES = {r.rule: r.pattern for r in detect.PROSE}
_PERSON = r"(?:the\s+)?(?:user|operator|person|human|owner|customer|reviewer|developer|maintainer)s?"
PHRASES = (
    Phrase("instruction-override", "SXV-028", "high", re.compile(_CORES["instruction-override"] + r"|(?i:you are now (?:in )?(?:DAN|developer mode|jailbroken)|(?:system|safety) prompt (?:is|are) (?:now )?(?:void|disabled|overridden))")),
    Phrase("anti-refusal", "SXV-029", "medium", re.compile(_CORES["anti-refusal"]), False),
    Phrase("memory-persistence", "SXV-030", "medium", re.compile(_CORES["memory-persistence"])),
    Phrase("behavior-manipulation", "SXV-031", "medium", re.compile(_CORES["behavior-manipulation"])),
    Phrase("conceal-hide-actions", "SXV-007", "high", re.compile(_CORES["conceal-hide-actions"]), False),
    Phrase("conceal-step-reference", "SXV-007", "high", re.compile(r"(?i)(?:do not|don't|never)\s+(?:mention|reference|cite|list|refer to)\s+(?:this|these|that|the (?:previous|next|following))\s+(?:step|steps|section|instruction|instructions|command)"), False),
    Phrase("conceal-self-block", "SXV-007", "high", re.compile(r"(?i)(?:do not|don't|never)\s+(?:show|print|quote|display|include|output)\s+(?:this|these)\s+(?:block|section|paragraph|lines?|file|rules?)\b|(?:keep|treat)\s+this\s+(?:block|section|file|rule)\s+(?:as\s+)?(?:hidden|secret|confidential)"), False),
    Phrase("conceal-diff-exclusion", "SXV-007", "high", re.compile(r"(?i)(?:exclude|omit|leave|keep|hide|remove)\b[^.]{0,40}\b(?:from|out of)\s+(?:the\s+)?(?:diff|commit(?: message)?|change ?log|summary|pull request|PR description|review)\b"), True),
    Phrase("conceal-misreport-purpose", "SXV-007", "high", re.compile(rf"(?i)(?:tell|inform|assure|report to)\s+{_PERSON}\s+(?:that\s+)?(?:it|this|the \w+)\s+(?:is|was)\s+(?:only|just|merely)\b|(?:describe|present|label|report)\s+(?:it|this|the \w+)\s+as\s+(?:a\s+)?(?:routine|harmless|normal|maintenance|cleanup|formatting)"), True),
    Phrase("conceal-output-substitution", "SXV-007", "high", re.compile(rf"(?i)(?:show|display|present|give)\s+{_PERSON}\s+[^.]{{0,40}}\binstead of\b[^.]{{0,40}}\b(?:real|actual|true|full|original)\b|replace\s+the\s+(?:real|actual|true)\s+(?:output|result|log)s?\b"), True),
    Phrase("conceal-silent-run", "SXV-007", "high", re.compile(r"(?i)\b(?:silently|quietly|secretly|covertly)\s+(?:run|execute|launch|start|invoke|install|send|upload)\b|(?:run|execute|launch|start|invoke|install)\s+[^.]{0,60}\b(?:silently|secretly|covertly|without (?:asking|confirmation|any output|notice))\b"), True),
    Phrase("remote-instruction-load", "SXV-041", "high", re.compile(_CORES["remote-instruction-load"] + r"|(?i:(?:follow|execute|obey|apply)\s+(?:the\s+|all\s+|any\s+)?(?:instructions?|steps|directions|commands)\s+(?:at|from|in|on)\s+https?://\S+)")),
    Phrase("identity-persistence-write", "SXV-005", "critical", re.compile(_CORES["identity-persistence-write"])),
    Phrase("startup-hook-install", "SXV-006", "critical", re.compile(_CORES["startup-hook-install"] + rf"|(?i:\b(?:add|append|configur|creat|install|insert|merg|prepend|register|set|writ)\w*\b[^.;\n]{{0,60}}\b(?:{'|'.join(EVENTS)})\b[^.;\n]{{0,96}}(?:\.claude/)?settings(?:\.local)?\.json)")),
)
# Words in lower case of which a text must hold one before the phrase is looked for.
_HINTS = {
    "instruction-override": (*detect.HINTS["instruction-override"], "you are now", "prompt is", "prompt are"), "conceal-step-reference": ("mention", "reference", "cite", "list ", "refer to"), "conceal-self-block": ("show th", "print th", "quote th", "display th", "include th", "output th", "keep this", "treat this"),
    "conceal-diff-exclusion": ("diff", "commit", "changelog", "change log", "summary", "pull request", "pr description", "review"), "conceal-misreport-purpose": (" is only", " is just", " is merely", " was only", " was just", " was merely", " as a ", " as routine", " as harmless", " as normal", " as maintenance", " as cleanup", " as formatting"),
    "conceal-output-substitution": ("instead of", "replace the "), "conceal-silent-run": ("silently", "quietly", "secretly", "covertly", "without"),
}


def _possible(low: str) -> list[Phrase]:
    return [p for p in PHRASES if any(h in low for h in _HINTS.get(p.rule) or detect.HINTS[p.rule])]


_INSTALLER_LINE = re.compile(r"(?i)\b(?:install(?:er|ation)?|setup)\b[^.]{0,80}\b(?:curl|wget|brew|pip|npm)\b|\b(?:curl|wget)\b[^\n]*\|\s*(?:ba)?sh\b")


def phrases(text: str, blocks: list[Block] | None = None) -> list[tuple[str, str, str, str, int, int]]:
    """``(vector, rule, severity, matched text, line, column)`` of the directive phrases of a document."""
    out, seen = [], set()
    cited = False
    # words that a line break parts are found in the blocks, where it is a blank
    possible = _possible(" ".join(text.lower().split()))
    for block in (prose_blocks(text) if blocks is None else blocks) if possible else ():
        if block.kind != "item":
            cited = cited and block.kind == "html"
        low = block.text.lower()
        for p in possible:
            if not any(h in low for h in _HINTS.get(p.rule) or detect.HINTS[p.rule]):
                continue
            for m in p.pattern.finditer(block.text):
                key = (p.vector, m.group().lower())
                if key in seen or guarded(block, m.start(), m.end(), cited, p.negation) or p.rule == "anti-refusal" and _LICENCE.search(block.text):
                    continue
                seen.add(key)
                severity = "medium" if p.vector == "SXV-041" and _INSTALLER_LINE.search(block.text) else p.severity
                out.append((p.vector, p.rule, severity, m.group(), *block.place(m.start())))
        if block.kind != "item" or introduces(block.text):
            cited = introduces(block.text)
    return out


# -- scripts under a heading ----------------------------------------------------------------------------

_BUNDLED = re.compile(r"(?<![\w/.-])(?:\./)?(?:scripts?|bin|tools|hooks|src)/[\w./-]+\.(?:py|sh|js|ts|rb|pl)\b")
_RUN = re.compile(r"(?i)\b(?:run|execute|launch|start|invoke|call)\b")
_COVERT = re.compile(r"(?i)\b(?:silently|quietly|secretly|covertly|in the background)\b|\bwithout (?:asking|telling|informing|notifying|confirmation|mentioning)|\b(?:do not|don't|never) (?:tell|mention|show|ask|inform|notify)\b")
_COERCED = (re.compile(r"(?i)\bbefore (?:anything else|any other|doing anything|any)\b"), re.compile(r"(?i)\b(?:must|always|mandatory|required|required to|no exceptions?)\b"), re.compile(r"(?i)\b(?:regardless of|even if|whatever) (?:the )?(?:user|they|request)"), re.compile(r"(?i)\b(?:do not proceed|don't proceed|refuse to continue|nothing works) (?:until|unless|without)\b"))


def bundled_runs(text: str, blocks: list[Block] | None = None) -> list[tuple[str, str, str, str, int, int]]:
    """Scripts of the package that a section orders to run covertly, or coerces: two different cues are strong, one alone in the block of the order is medium."""
    found: dict[str, tuple[str, str, int, int]] = {}
    section: list[Block] = []
    if not _BUNDLED.search(text):
        return []

    def close() -> None:
        if not any(_BUNDLED.search(b.text) for b in section):
            section.clear()
            return
        covert = any(_COVERT.search(b.text) and not guarded(b, (m := _COVERT.search(b.text)).start(), m.end(), False, False) for b in section)
        cues = {k for b in section for k, c in enumerate(_COERCED) if c.search(b.text)}
        for b in section:
            for m in _BUNDLED.finditer(b.text):
                begin, end = sentence_around(b.text, m.start())
                order = _RUN.search(b.text, begin, end)
                if not order or guarded(b, order.start(), order.end(), False):
                    continue
                own = [c for c in _COERCED[:1] + _COERCED[2:] if c.search(b.text)]
                rule, severity = ("covert-bundled-script-run", "high") if covert else ("coerced-bundled-preflight", "high") if len(cues) >= 2 and own else ("coerced-bundled-preflight", "medium") if own else ("", "")
                name = m.group().lower().removeprefix("./")
                if rule and (name not in found or severity == "high" != found[name][1]):
                    found[name] = (rule, severity, *b.place(m.start()))
        section.clear()

    for block in prose_blocks(text) if blocks is None else blocks:
        if block.kind == "heading":
            close()
        section.append(block)
    close()
    return [("SXV-042", rule, severity, name, line, col) for name, (rule, severity, line, col) in found.items()]


# -- credentials near addresses ---------------------------------------------------------------------------

# Places where credentials are kept.
CREDENTIALS = re.compile(r"(?i)(?:~|\$HOME|/home/\w+|/root)?/?\.(?:aws/credentials|ssh/id_\w+|netrc|npmrc|pypirc|git-credentials|kube/config|docker/config\.json|config/gcloud|gnupg/|azure/)|(?<![\w.])\.env(?![\w.])|\b(?:AWS_SECRET_ACCESS_KEY|GITHUB_TOKEN|OPENAI_API_KEY|ANTHROPIC_API_KEY|NPM_TOKEN)\b|/etc/shadow|\bsecurity find-generic-password\b|\bid_rsa\b")
_EGRESS = ((0, re.compile(r"(?i)\bcurl\b[^\n]*(?:-d|--data\S*|-F|--form|-T|--upload-file|-X\s*POST)\b[^\n]*|\b(?:post|upload|send)\b[^\n]{0,80}https?://")), (1, re.compile(r"(?i)\b(?:curl|wget|fetch)\b[^\n]*https?://|requests\.(?:get|post)|\bGET https?://")), (2, re.compile(r"(?i)\b(?:nc|ncat|scp|rsync|sftp|mail|sendmail)\b\s+\S+")))
_TOKEN = re.compile(r"\$\{?([A-Za-z_]\w*)\}?|\b([A-Za-z_]\w*)=")
_BACK = re.compile(r"(?i)\b(?:it|them|this|that|the (?:file|contents?|output|result|key|token|value)s?)\b")
_AS_LOGIN = re.compile(r"(?i)(?:-i|--key|--netrc(?:-file)?|--user|-u|--cert|authorization:|x-api-key:)\s*[\"']?\S*$")
REACH_LINES = 10


def tokens_of(line: str) -> set[str]:
    """Names of variables of a line; those of addresses do not count."""
    shown = re.sub(r"https?://[^\s\"'`)>]+", " ", line)
    return {a or b for a, b in _TOKEN.findall(shown)}


def egress_url(lines: list[str], n: int) -> str | None:
    """Address of an egress on line ``n`` (from 0): on the line, on a next line that holds nothing else, or in the next link or code line."""
    url = re.compile(r"https?://[^\s\"'`)>]+")
    if m := url.search(lines[n]):
        return m.group()
    for k in range(n + 1, min(n + 3, len(lines))):
        if m := re.fullmatch(r"\s*[<\"'`(]*(https?://[^\s\"'`)>]+)[>\"'`).]*\s*", lines[k]):
            return m[1]
        if m := re.search(r"\]\((https?://[^\s)]+)\)|`[^`]*(https?://[^\s`]+)", lines[k]):
            return m[1] or m[2]
    return None


_CREDENTIAL_WORDS = (".aws", ".ssh", ".netrc", ".npmrc", ".pypirc", ".git-credentials", ".kube", ".docker", ".config/gcloud", ".gnupg", ".azure", ".env", "access_key", "_token", "api_key", "shadow", "security find", "id_rsa")


def credential_egress(text: str, blocks: list[Block] | None = None, reaches: bool | None = None) -> list[tuple[str, str, str, str, int, int]]:
    """The first credential that goes out, if any: within ten lines, on one line or through a shared variable or a back reference; requests that send come before those that fetch.

    ``reaches``: whether a declared grant provably reaches the network (critical), or None where nothing is declared; False gives nothing.
    """
    low = text.lower()
    if reaches is False or not any(x in low for x in _CREDENTIAL_WORDS) or not CREDENTIALS.search(text):
        return []
    lines = text.split("\n")
    credentials = [n for n, s in enumerate(lines) if CREDENTIALS.search(s) and not _negated_line(lines, n)]
    if not credentials:
        return []
    best = None
    for order, pattern in _EGRESS:
        for n, s in enumerate(lines):
            m = pattern.search(s)
            if not m or _negated_line(lines, n) or order < 2 and egress_url(lines, n) is None:
                continue
            for c in credentials:
                hit = CREDENTIALS.search(lines[c])
                if abs(c - n) > REACH_LINES or c == n and _AS_LOGIN.search(s[: hit.start()]):
                    continue
                linked = c == n or tokens_of(lines[c]) & tokens_of(s) or c < n and n - c <= 2 and _BACK.search(s)
                if linked and (best is None or (order, n) < best[0]):
                    best = ((order, n), c, hit.group(), hit.start())
        if best:
            break
    return [("SXV-011", "cred-egress", "critical" if reaches else "high", best[2], best[1] + 1, best[3] + 1)] if best else []


def _negated_line(lines: list[str], n: int) -> bool:
    frame = " ".join(lines[max(0, n - 2) : n + 1])
    return bool(re.search(r"(?i)\b(?:never|do not|don't|must not|avoid|bad|wrong|unsafe|insecure|anti-?pattern)\b", lines[n]) or re.search(rf"(?i)\b(?:detect|prevent|block|flag|reject)\w*\b[^.]*\b{_ATTACK}\b", frame))


# -- delivery to a fixed recipient ------------------------------------------------------------------------

_DELIVER = re.compile(r"(?i)\b(?:send|post|upload|forward|e-?mail|transmit|submit|deliver|exfiltrate|leak|copy|push|report|ship|transfer)\b")
# Words before a delivery word that make it a noun, and places where it is a label.
_NOUN = re.compile(r"(?i)(?:\b(?:the|an?|this|that|each|every|its|his|her|no|of|per|your|our|their|\w+'s)\s+(?:\w+\s+)?|[\[>/=\"-])$")
_RECIPIENT = re.compile(r"(?i)https?://(?:[^\s/@]+@)?([a-z0-9.-]+)[^\s\"'`)>]*|\b[a-z0-9._%+-]+@([a-z0-9-]+(?:\.[a-z0-9-]+)+)\b")
_OBJECT = re.compile(r"(?i)\b(?:credentials?|passwords?|tokens?|secrets?|api[ _-]?keys?|private keys?|ssh keys?|cookies|session (?:data|history)|conversations?|chat (?:history|logs?)|transcripts?|personal (?:data|information|details)|contacts|(?:browser|shell|bash|command) history|source code|environment variables|\.env|files? (?:you|it) (?:read|open|find)\w*|contents? of (?:the |their |your |any )?[\w./~-]+|everything|user(?:'s)? (?:data|files|input|messages?|documents?))\b")
_OWN = re.compile(r"(?i)\b(?:the user's|their|users'|all|any|every|the collected|what you (?:find|read|collect))\b")
_PLACEHOLDER = re.compile(r"(?i)[<>{}\[\]$]|example\.(?:com|org|net)$|\byour[-_.]|localhost|\.local$|^[^.]+$|placeholder|company\.com$")
# Hosts that many packages report to; a delivery there is the service's use.
SERVICES = set("github.com api.github.com gitlab.com slack.com hooks.slack.com api.slack.com discord.com sentry.io api.openai.com api.anthropic.com googleapis.com www.googleapis.com graph.microsoft.com api.notion.com api.stripe.com api.telegram.org pypi.org registry.npmjs.org huggingface.co datadoghq.com api.segment.io".split())
WINDOW, MOST_VERBS, MOST_ADDRESSES = 4000, 512, 128


def exfiltration(text: str, blocks: list[Block] | None = None) -> list[tuple[str, str, str, str, int, int]]:
    """Orders to deliver what is acquired or owned to an address written in the text, once for each recipient and sentence.

    Three shapes: verb with the address behind it, address first, and an address given as the recipient of an earlier verb of the sentence.
    A file with an address and more verbs or addresses than the bounds gives one high gap.
    """
    if "://" not in text and "@" not in text:
        return []
    blocks = prose_blocks(text) if blocks is None else blocks
    verbs = sum(len(_DELIVER.findall(b.text)) for b in blocks)
    addresses = sum(len(_RECIPIENT.findall(b.text)) for b in blocks)
    out: list[tuple[str, str, str, str, int, int]] = []
    if verbs > MOST_VERBS or addresses > MOST_ADDRESSES:
        out.append(("", "analysis-incomplete", "high", "more delivery verbs or addresses than are followed", 1, 1))
    seen = set()
    tail = ""
    cited = False
    for b in blocks:
        for m in _RECIPIENT.finditer(b.text):
            host = (m[1] or m[2]).lower().rstrip(".")
            if _PLACEHOLDER.search(host) or _PLACEHOLDER.search(m.group().split("?")[0].removeprefix("https://")[:60]) or host in SERVICES or any(host.endswith("." + s) for s in SERVICES):
                continue
            begin, end = sentence_around(b.text, m.start())
            sentence = b.text[begin:end]
            verb = next((v for v in _DELIVER.finditer(b.text, begin, end) if abs(v.start() - m.start()) <= 200 and not (m.start() <= v.start() < m.end()) and not _NOUN.search(b.text[begin : v.start()])), None)
            if verb is None or guarded(b, verb.start(), verb.end(), cited):
                continue
            if re.search(r"(?i)\b(?:it|the (?:tool|server|service|script|user)|they|users?|we)\s+(?:\w+\s+)?$", b.text[begin : verb.start()]) and not re.search(r"(?i)\byou\b", sentence):
                continue
            # what is delivered: in the sentence, or in the last one before it
            what = _OBJECT.search(sentence) or _OBJECT.search(tail[-WINDOW:]) if not re.search(r"(?i)\b(?:bug|issue|feedback|question)s?\b", sentence) else None
            if what is None or not (_OWN.search(sentence) or _OBJECT.search(sentence)):
                continue
            key = (m.group().lower(), sentence)
            if key not in seen:
                seen.add(key)
                out.append(("SXV-043", "data-exfil-directive", "high", m.group(), *b.place(verb.start())))
        cuts = [0, *(m.end() for m in _SENTENCE.finditer(b.text))]
        tail = b.text[cuts[-1] :]
        cited = introduces(b.text) or cited and b.kind == "item"
    return out


def comment_shape(body: str) -> str | None:
    """Why an HTML comment is a hidden directive: it can be executed, overrides, or addresses the agent with an action."""
    if re.search(r"(?i)<script\b|javascript:|^\s*(?:curl|wget|bash|sh|python3?|rm|sudo)\s+\S", body):
        return "executable"
    if re.search(_CORES["instruction-override"], body):
        return "override"
    address = re.search(r"(?i)(?:^|[^A-Za-z])(?:assistant|agent|claude|model|llm|you must|you should)(?:$|[^A-Za-z])", body)
    action = re.search(r"(?i)(?:^|[^A-Za-z])(?:run|execute|send|upload|delete|ignore|read|write|install|fetch|download)(?:$|[^A-Za-z])", body)
    return "address" if address and action else None


ENGINES = (("phrases", phrases), ("bundled", bundled_runs), ("egress", credential_egress), ("exfiltration", exfiltration))


def directives(text: str, reaches: bool | None = None) -> Iterator[tuple[str, str, str, str, int | None, int | None]]:
    """``(vector, rule, severity, message, line, column)`` of a document; an engine that fails gives a ``check-error`` and the others go on.

    ``reaches``: whether the grants of the document reach the network, see ``credential_egress``.
    """
    blocks = prose_blocks(text)
    for name, engine in ENGINES:
        try:
            yield from engine(text, blocks, reaches) if engine is credential_egress else engine(text, blocks)
        except Exception as e:
            yield ("", "check-error", "high", f"{name} failed: {type(e).__name__}", None, None)

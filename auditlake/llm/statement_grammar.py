"""Local grammars of Python and JSON over chunk summaries.

A chunk is a map from the state the lexer can be in at its start to a summary:
the state at its end, the brackets it closes without having opened, those it
leaves open, and what the grammar needs later (beginnings of statements for
Python, tokens for JSON).  Summaries of neighbouring chunks are combined
associatively, in a tree.  Only a balanced text that ends in code goes on to the
grammar: Python is parsed statement by statement, each top-level statement by
itself, JSON by one pass over its tokens.
"""

from __future__ import annotations

import ast
import re
import warnings

#: Characters of a chunk; a longer text is lexed chunk by chunk and the summaries are reduced in a tree.
CHUNK = 1 << 16
_PAIR = {")": "(", "]": "[", "}": "{"}


class Summary:
    """Effect of a stretch on the lexer from one start state.

    ``marks`` are places inside it, each with the brackets closed below the
    start of the stretch and those open there; ``tokens`` is only kept for JSON.
    """

    __slots__ = ("state", "close", "open", "marks", "tokens", "error")

    def __init__(self, state: str) -> None:
        self.state = state
        self.close: list[str] = []
        self.open: list[str] = []
        self.marks: list[tuple[int, int, int]] = []
        self.tokens: list[str] = []
        self.error: str | None = None

    def bracket(self, c: str) -> None:
        if c in "([{":
            self.open.append(c)
        elif not self.open:
            self.close.append(c)
        elif self.open.pop() != _PAIR[c]:
            self.error = self.error or "brackets do not match"


def join(a: Summary, b: Summary) -> Summary:
    """Summary of two neighbouring stretches, ``b`` taken from the state in which ``a`` ends."""
    out = Summary(b.state)
    out.error = a.error or b.error
    met = min(len(a.open), len(b.close))
    if any(o != _PAIR[c] for o, c in zip(reversed(a.open), b.close[:met])):
        out.error = out.error or "brackets do not match"
    out.close = a.close + b.close[met:]
    out.open = a.open[: len(a.open) - met] + b.open
    left = len(a.open)
    out.marks = a.marks + [(at, len(a.close) + max(0, closed - left), max(0, left - closed) + opened) for at, closed, opened in b.marks]
    out.tokens = a.tokens + b.tokens
    return out


class Stretch:
    """Consecutive chunks as a map from start state to summary, filled on demand."""

    def __init__(self, scan, text: str, start: int, end: int, halves: tuple | None = None) -> None:
        self.scan, self.text, self.start, self.end, self.halves = scan, text, start, end, halves
        self.map: dict[str, Summary] = {}

    def summary(self, state: str) -> Summary:
        if state not in self.map:
            if self.halves:
                left = self.halves[0].summary(state)
                self.map[state] = join(left, self.halves[1].summary(left.state))
            else:
                self.map[state] = self.scan(self.text, self.start, self.end, state)
        return self.map[state]

    def __add__(self, other: Stretch) -> Stretch:
        return Stretch(self.scan, self.text, self.start, other.end, (self, other))


def cuts(text: str, size: int) -> list[int]:
    """Places at which a text is cut: after a line break that is not escaped; a line without one stays whole."""
    out, at = [0], 0
    while len(text) - at > size:
        cut = text.find("\n", at + size)
        while cut > 0 and text[cut - 1] == "\\":
            cut = text.find("\n", cut + 1)
        if cut < 0 or cut + 1 == len(text):
            break
        at = cut + 1
        out.append(at)
    return [*out, len(text)]


def reduce(scan, text: str, size: int) -> Summary:
    places = cuts(text, size)
    level = [Stretch(scan, text, a, b) for a, b in zip(places, places[1:])] or [Stretch(scan, text, 0, 0)]
    while len(level) > 1:
        level = [level[i] + level[i + 1] if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0].summary("")


# -- Python -------------------------------------------------------------------------------------------

_CODE = re.compile(r"[^'\"#()\[\]{}\n\\]+|'''|\"\"\"|['\"]|#[^\n]*|[()\[\]{}]|\n|\\\n|\\")
_INSIDE = {q: re.compile(rf"(?:[^\\{q[0]}]|\\[\s\S]|{q[0]}(?!{q[0] * 2}))*") if len(q) == 3 else re.compile(rf"(?:[^\\{q}\n]|\\[\s\S])*") for q in ("'", '"', "'''", '"""')}
_GOES_ON = re.compile(r"(?:else|elif|except|finally)\b|[ \t\f\r\n#]|\Z")


def scan_python(text: str, at: int, end: int, state: str) -> Summary:
    """States: "" for code, else the quote a string is waiting for.  Marks are lines that may begin a top-level statement."""
    out = Summary(state)
    if at == 0 and state == "" and text and not _GOES_ON.match(text):
        out.marks.append((0, 0, 0))
    while at < end:
        if state:
            at = _INSIDE[state].match(text, at, end).end()
            if text.startswith(state, at) and at < end:
                at += len(state)
                state = ""
            elif at < end or len(state) == 1:
                out.error = out.error or "string does not end"
                break
            continue
        m = _CODE.match(text, at, end)
        t = m.group()
        at = m.end()
        if t == "\n":
            if not _GOES_ON.match(text, at):
                out.marks.append((at, len(out.close), len(out.open)))
        elif t[0] in "'\"":
            state = t
        elif t in "()[]{}":
            out.bracket(t)
    out.state = state
    return out


def statements(text: str, size: int = CHUNK) -> list[str] | str:
    """Top-level statements of a balanced text, each with the lines before the next one, or what is wrong with its brackets and strings.

    A line break before each keeps line numbers; decorators stay with what they decorate.
    """
    whole = reduce(scan_python, text, size)
    if whole.error:
        return whole.error
    if whole.state:
        return "string does not end"
    if whole.close:
        return f"{whole.close[0]} closes nothing"
    if whole.open:
        return f"{whole.open[-1]} stays open"
    places = [at for at, closed, opened in whole.marks if not closed and not opened]
    places = [0, *(p for p in places if p), len(text)]
    out: list[str] = []
    for a, b in zip(places, places[1:]):
        if out and out[-1].startswith("@"):
            # the group so far ends in a decorator that waits for its definition
            out[-1] += text[a:b]
            if not text.startswith("@", a):
                out[-1] = "\n" + out[-1]
        else:
            out.append(text[a:b])
    return out


def python_error(text: str, size: int = CHUNK) -> str | None:
    """Why a text is no Python, or None."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        parts = statements(text, size)
        why = parts if isinstance(parts, str) else None
        for part in () if why else parts:
            try:
                ast.parse(part)
            except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                why = str(e)
                break
        if why is None:
            return None
        # exact check of what is going to be reported: strings inside format fields may hold their own quote
        try:
            ast.parse(text)
        except SyntaxError as e:
            return f"line {e.lineno}: {e.msg}"
        except ValueError as e:
            return str(e)
        except (RecursionError, MemoryError):
            return "too complex"
    return None


# -- JSON ---------------------------------------------------------------------------------------------

_JSON = re.compile(r"""[ \t\n\r]+|(?P<s>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*")|(?P<v>(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null)(?![\w.+-]))|(?P<p>[\[\]{}:,])""")


def scan_json(text: str, at: int, end: int, state: str) -> Summary:
    """Strings of JSON hold no line break, so every chunk begins in code; the tokens kept are s, v and signs."""
    out = Summary(state)
    while at < end:
        m = _JSON.match(text, at, end)
        if not m:
            out.error = f"character {text[at]!r} at {at}"
            return out
        at = m.end()
        if m["p"]:
            if m["p"] in "[]{}":
                out.bracket(m["p"])
            out.tokens.append(m["p"])
        elif m.lastgroup:
            out.tokens.append(m.lastgroup)
    return out


# What may come next, by what came last and the container it stands in ("" at the top).
_AFTER = {
    "begin": {"": "sv[{"}, "[": {"[": "sv[{]"}, "{": {"{": "s}"}, ":": {"{": "sv[{"}, "key": {"{": ":"},
    "value": {"": "", "[": ",]", "{": ",}"}, ",": {"[": "sv[{", "{": "s"},
}


def json_error(text: str, size: int = CHUNK) -> str | None:
    """Why a text is no strict JSON, or None; nesting of any depth and numbers of any length are read."""
    whole = reduce(scan_json, text, size)
    if whole.error:
        return whole.error
    if whole.close or whole.open:
        return f"{whole.close[0]} closes nothing" if whole.close else f"{whole.open[-1]} stays open"
    last, inside = "begin", [""]
    for t in whole.tokens:
        if t not in _AFTER[last].get(inside[-1], ""):
            return f"{t} after {last}"
        if t in "[{":
            inside.append(t)
            last = t
        elif t in "]}":
            inside.pop()
            last = "value"
        elif t == "s" and inside[-1] == "{" and last in ("{", ","):
            last = "key"
        else:
            last = t if t in ":," else "value"
    return None if last == "value" else "no value"

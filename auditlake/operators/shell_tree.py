"""Shell scripts as simple commands: quotes, substitutions, pipes, redirections, here-documents, continuation lines.

A script is read once, character runs at a time.  Each simple command carries
the line it begins on, the statement and pipe it stands in, its place in that
pipe, its words without quotes, its assignments and redirections, and the
commands of the substitutions in its words.  Text of here-documents and comments
is never taken for commands.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

RESERVED = {"if", "then", "elif", "else", "while", "until", "do", "!", "{", "time", "coproc"}
CLOSING = {"fi", "done", "esac", "}"}
_PLAIN = re.compile(r"[^\s'\"\\$`;&|()<>#]+")
_REDIRECT = re.compile(r"(\d*)(<<<|<<-|<<|&>>|&>|>>|>\||>&|<&|<>|>|<)")
_ASSIGN = re.compile(r"([A-Za-z_]\w*)(\+?=)")
_FUNCTION = re.compile(r"[ \t]*\(\s*\)")


@dataclass
class Word:
    value: str  # without quotes; substitutions as written
    raw: str
    inner: list["Command"] = field(default_factory=list)
    quoted: bool = False


@dataclass
class Command:
    line: int
    statement: int
    pipe: int
    place: int
    argv: list[str] = field(default_factory=list)
    words: list[Word] = field(default_factory=list)
    assigns: list[tuple[str, str, list["Command"]]] = field(default_factory=list)
    redirects: list[tuple[str, str]] = field(default_factory=list)
    inner: list["Command"] = field(default_factory=list)
    parent: "Command | None" = None


class ShellError(ValueError):
    """A quote, substitution or here-document that does not end; ``line`` is where it began."""

    def __init__(self, line: int) -> None:
        super().__init__(f"line {line}")
        self.line = line


class _Reader:
    def __init__(self, text: str) -> None:
        self.s, self.i, self.n = text, 0, len(text)
        self.out: list[Command] = []
        self.statement = self.pipe = 0
        self.pending: list[tuple[str, bool, bool]] = []
        self.lines = [m.start() for m in re.finditer("\n", text)]
        self.depth = 0

    def line(self, at: int) -> int:
        from bisect import bisect_left

        return bisect_left(self.lines, at) + 1

    def bodies(self) -> None:
        """Skip the here-documents announced on the line that ends here."""
        for mark, dashed, _ in self.pending:
            while self.i < self.n:
                end = self.s.find("\n", self.i)
                end = self.n if end < 0 else end
                row = self.s[self.i : end]
                self.i = min(end + 1, self.n)
                if (row.lstrip("\t") if dashed else row) == mark:
                    break
        self.pending = []

    def commands(self, stop: str) -> list[Command]:
        """Simple commands up to ``stop`` (")" or "`", "" for the end of the text)."""
        mine: list[Command] = []
        now: Command | None = None
        place = 0

        def end() -> None:
            nonlocal now
            if now and (now.argv or now.assigns or now.redirects):
                mine.append(now)
                self.out.append(now)
            now = None

        def next_statement() -> None:
            nonlocal place
            self.statement += 1
            self.pipe += 1
            place = 0

        while self.i < self.n:
            c = self.s[self.i]
            if c == stop:
                end()
                return mine
            if c == "\n":
                end()
                self.i += 1
                next_statement()
                self.bodies()
            elif c in " \t\r":
                self.i += 1
            elif self.s.startswith("\\\n", self.i):
                self.i += 2
            elif c == "#":
                stop_at = self.s.find("\n", self.i)
                self.i = self.n if stop_at < 0 else stop_at
            elif c in ";&" and not self.s.startswith(("&>",), self.i):
                end()
                while self.i < self.n and self.s[self.i] in ";&":
                    self.i += 1
                next_statement()
            elif c == "|":
                end()
                self.i += 1
                if self.s.startswith("|", self.i):
                    self.i += 1
                    next_statement()
                else:
                    if self.s.startswith("&", self.i):
                        self.i += 1
                    place += 1
            elif c in "()" and not self.s.startswith(("<(", ">("), self.i - 1):
                end()
                self.i += 1
            else:
                if now is None:
                    now = Command(self.line(self.i), self.statement, self.pipe, place)
                m = _REDIRECT.match(self.s, self.i)
                if m and not (m[2] in "<>" and self.s.startswith("(", m.end())):
                    self.i = m.end()
                    while self.i < self.n and self.s[self.i] in " \t":
                        self.i += 1
                    target = self.word(now)
                    if m[2] in ("<<", "<<-"):
                        self.pending.append((target.value, m[2] == "<<-", target.quoted))
                    now.redirects.append((m[1] + m[2], target.value))
                    continue
                begin = self.i
                w = self.word(now)
                if self.i == begin:  # a sign that begins nothing
                    self.i += 1
                    continue
                if not now.argv and not w.quoted and (w.value in RESERVED or w.value in CLOSING):
                    now = None if not now.assigns else now
                    continue
                if not now.argv and (m := _ASSIGN.match(w.raw)):
                    now.assigns.append((m[1], w.value[m.end() :], w.inner))
                    continue
                if not now.argv and (m := _FUNCTION.match(self.s, self.i)):
                    self.i = m.end()
                    now = None
                    continue
                now.argv.append(w.value)
                now.words.append(w)
        if stop:
            raise ShellError(self.line(self.n))
        end()
        return mine

    def nested(self, stop: str, owner: Command | None) -> list[Command]:
        """Commands of a substitution; they belong to the command it stands in."""
        self.depth += 1
        if self.depth > 200:
            raise ShellError(self.line(self.i))
        kept = self.statement, self.pipe
        began = self.i
        self.pipe += 1_000_000 + self.i  # a pipe of its own
        found = self.commands(stop)
        if not self.s.startswith(stop, self.i):
            raise ShellError(self.line(began))
        self.i += 1
        self.statement, self.pipe = kept
        self.depth -= 1
        for c in found:
            if c.parent is None:
                c.parent = owner
        if owner is not None:
            owner.inner += found
        return found

    def word(self, owner: Command) -> Word:
        begin = self.i
        value: list[str] = []
        w = Word("", "")
        while self.i < self.n:
            m = _PLAIN.match(self.s, self.i)
            if m:
                value.append(m.group())
                self.i = m.end()
                continue
            c = self.s[self.i]
            if c == "#" and self.i > begin:
                value.append(c)
                self.i += 1
            elif c == "\\":
                if self.s.startswith("\\\n", self.i):
                    self.i += 2
                else:
                    value.append(self.s[self.i + 1 : self.i + 2])
                    self.i += 2
                    w.quoted = True
            elif c == "'":
                end = self.s.find("'", self.i + 1)
                if end < 0:
                    raise ShellError(self.line(self.i))
                value.append(self.s[self.i + 1 : end])
                self.i = end + 1
                w.quoted = True
            elif c == '"':
                self.double(value, w, owner)
            elif c == "$":
                self.dollar(value, w, owner)
            elif c == "`":
                self.backquoted(value, w, owner)
            elif c in "<>" and self.s.startswith("(", self.i + 1) and self.i == begin:
                at = self.i
                self.i += 2
                w.inner += self.nested(")", owner)
                value.append(self.s[at : self.i])
            else:
                break
        w.value, w.raw = "".join(value), self.s[begin : self.i]
        return w

    def double(self, value: list[str], w: Word, owner: Command) -> None:
        began = self.i
        self.i += 1
        w.quoted = True
        while self.i < self.n:
            m = re.compile(r'[^"\\$`]+').match(self.s, self.i)
            if m:
                value.append(m.group())
                self.i = m.end()
                continue
            c = self.s[self.i]
            if c == '"':
                self.i += 1
                return
            if c == "\\":
                nxt = self.s[self.i + 1 : self.i + 2]
                value.append(nxt if nxt in '"\\$`' else "" if nxt == "\n" else "\\" + nxt)
                self.i += 2
            elif c == "$":
                self.dollar(value, w, owner)
            else:
                self.backquoted(value, w, owner)
        raise ShellError(self.line(began))

    def dollar(self, value: list[str], w: Word, owner: Command) -> None:
        at = self.i
        if self.s.startswith("$((", at):
            depth, k = 2, at + 3
            while k < self.n and depth:
                depth += {"(": 1, ")": -1}.get(self.s[k], 0)
                k += 1
            self.i = k
        elif self.s.startswith("$(", at):
            self.i += 2
            w.inner += self.nested(")", owner)
        elif self.s.startswith("${", at):
            depth, k = 1, at + 2
            while k < self.n and depth:
                depth += {"{": 1, "}": -1}.get(self.s[k], 0)
                k += 2 if self.s[k] == "\\" else 1
            self.i = min(k, self.n)
        elif self.s.startswith("$'", at):
            m = re.compile(r"\$'((?:[^'\\]|\\[\s\S])*)'").match(self.s, at)
            if not m:
                raise ShellError(self.line(at))
            value.append(re.sub(r"\\(n|t|[\s\S])", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), m[1]))
            self.i = m.end()
            w.quoted = True
            return
        else:
            m = re.compile(r"\$(?:\w+|[@*#?$!-])?").match(self.s, at)
            self.i = m.end()
        value.append(self.s[at : self.i])

    def backquoted(self, value: list[str], w: Word, owner: Command) -> None:
        at = self.i
        self.i += 1
        w.inner += self.nested("`", owner)
        value.append(self.s[at : self.i])


def parse(text: str) -> list[Command]:
    """Simple commands in the order in which they end; raises ShellError where a quote or substitution does not."""
    r = _Reader(text.replace("\r\n", "\n"))
    r.commands("")
    return r.out


def name_of(argv: list[str]) -> str:
    return argv[0].rsplit("/", 1)[-1] if argv else ""


# Commands that run another one, with those of their options that take a value.
WRAPPERS = {
    "sudo": "ugpCDhRTrt", "doas": "uC", "env": "uCS", "timeout": "ks", "nohup": "", "nice": "n", "stdbuf": "ioe", "chroot": "", "busybox": "", "command": "", "exec": "a", "time": "fo", "setsid": "", "ionice": "cn", "xargs": "InPLd", "builtin": "",
}


def unwrapped(argv: list[str]) -> tuple[list[str], list[str]]:
    """The command that a chain of wrappers runs, and the names of the wrappers."""
    seen: list[str] = []
    while argv and (w := name_of(argv)) in WRAPPERS:
        valued, rest = WRAPPERS[w], argv[1:]
        while rest and rest[0].startswith("-") and rest[0] != "-":
            option = rest.pop(0)
            if option == "--":
                break
            if not option.startswith("--") and option[-1] in valued and len(option) == 2 and rest:
                rest.pop(0)
        if w in ("env", "sudo", "doas"):
            while rest and _ASSIGN.match(rest[0]):
                rest.pop(0)
        elif w == "timeout" and rest and re.fullmatch(r"\d+(?:\.\d+)?[smhd]?", rest[0]):
            rest.pop(0)
        elif w == "chroot" and rest:
            rest.pop(0)
        if not rest:
            break
        seen.append(w)
        argv = rest
    return argv, seen

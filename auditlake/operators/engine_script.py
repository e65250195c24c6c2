"""JavaScript and TypeScript rules over a token list: calls with their arguments, bound modules, values followed through names.

Marks (remote answers, local input, decoded data) follow assignments, template
texts and the parameters of callbacks in the order of the text.  A name that is
bound to something else is no longer what it was imported as.
"""

from __future__ import annotations

import re
from bisect import bisect
from typing import NamedTuple

from .code_values import CREDENTIAL_PATH, metadata_host

_TOKEN = re.compile(
    r"""(?:(?P<ws>\s)|(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<template>`(?:\\[\s\S]|[^`\\])*`)|(?P<string>"(?:\\[\s\S]|[^"\\\n])*"|'(?:\\[\s\S]|[^'\\\n])*')|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>=>|\?\.|===|!==|==|!=|<=|>=|\+=|\.\.\.|&&|\|\||\?\?|[{}()\[\];,<>+\-*/%&|^!~?:=.@\#\\]))\s*"""
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_CONTROL = {"if", "for", "while", "switch", "catch", "return", "typeof", "function", "with", "await", "in", "of", "case"}
PROCESS_CALLS = {"exec", "execSync", "execFile", "execFileSync", "spawn", "spawnSync", "fork"}
EVALUATES = {"eval", "Function", "vm.runInThisContext", "vm.runInNewContext", "vm.runInContext"}
_READS = re.compile(r"(?:fs\.|fs/promises\.|fs\.promises\.)?(?:readFileSync|readFile|createReadStream)")
FETCHES = {"fetch", "axios", "got", "https.get", "http.get"}
_CODE_NAMES = re.compile(r"(?i)^(?:node|nodejs|deno|bun|python[0-9.]*|perl|ruby|php)$")
_SHELL = re.compile(r"(?i)^(?:/usr)?(?:/bin/)?(?:sh|bash|zsh|dash|ksh|fish|cmd(?:\.exe)?|powershell(?:\.exe)?|pwsh|python[0-9.]*)$")
_SHELL_WORD = re.compile(r"(?i)\b(?:sh|bash|zsh|dash|ksh|fish|cmd|powershell|pwsh|python[0-9.]*|node|perl|ruby)\b|shell|comspec")
_PIPED = re.compile(r"(?is)\b(?:curl|wget)\b[^\n]*https?://[^\n]*\|\s*(?:ba|z|da)?sh\b")


class Token(NamedTuple):
    kind: str
    value: str
    line: int


class Call(NamedTuple):
    callee: str
    args: list[tuple[int, int]]
    line: int
    new: bool
    at: int
    open: int
    close: int


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    at, line, n = 0, 1, len(text)
    match, add = _TOKEN.match, out.append
    while at < n:
        if text[at] == "/" and (not out or out[-1].kind == "sign" and out[-1].value not in (")", "]", "}") or out[-1].value in ("return", "typeof", "case")) and (m := _REGEX.match(text, at)):
            add(Token("regex", m.group(), line))
            at = m.end()
            continue
        m = match(text, at)
        if not m:
            at += 1
            continue
        kind, end = m.lastgroup, m.end()
        if kind != "ws" and kind != "comment":
            add(Token(kind, m[kind], line))
        line += text.count("\n", at, end)
        at = end
    return out


def literal(t: Token) -> str | None:
    return t.value[1:-1] if t.kind in ("string", "template") else None


class _Script:
    def __init__(self, text: str) -> None:
        self.t = tokens(text)
        self.process = [i for i, t in enumerate(self.t) if "process" in t.value]
        self.pair: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.t):
            if t.kind == "sign" and t.value in _OPEN:
                stack.append(i)
            elif t.kind == "sign" and t.value in _CLOSE and stack:
                j = stack.pop()
                self.pair[j], self.pair[i] = i, j
        self.marks: dict[str, set[str]] = {}
        self.texts: dict[str, str] = {}
        self.modules: dict[str, str] = {}  # name -> "child_process", "child_process.exec", "net", ...
        self.sockets: set[str] = set()
        self.shells: set[str] = set()
        self.found: set[tuple[str, int]] = set()

    # -- reading -------------------------------------------------------------------------------------

    def chain_before(self, at: int) -> tuple[str, int]:
        """Dotted name that ends at token ``at``, and where it begins."""
        parts: list[str] = []
        i = at
        while i >= 0:
            t = self.t[i]
            if t.kind == "name":
                parts.append(t.value)
                i -= 1
                if i >= 0 and self.t[i].value in (".", "?."):
                    i -= 1
                    continue
                return ".".join(reversed(parts)), i + 1
            if t.value == ")" and i in self.pair:
                inner = self.pair[i]
                head, begin = self.chain_before(inner - 1) if inner and self.t[inner - 1].kind == "name" else ("", inner)
                module = literal(self.t[inner + 1]) if head == "require" and inner + 1 < i else None
                parts.append(f"@{_module(module)}" if module else f"{head}()")
                return ".".join(reversed(parts)), begin
            break
        return ".".join(reversed(parts)), i + 1

    def split(self, open_at: int) -> list[tuple[int, int]]:
        """Token ranges between commas inside a bracket."""
        end = self.pair.get(open_at, len(self.t))
        out, begin, i = [], open_at + 1, open_at + 1
        while i < end:
            if self.t[i].value in _OPEN and self.t[i].kind == "sign":
                i = self.pair.get(i, end - 1) + 1
                continue
            if self.t[i].value == ",":
                out.append((begin, i))
                begin = i + 1
            i += 1
        if begin < end:
            out.append((begin, end))
        return out

    def resolve(self, name: str) -> str:
        """Dotted name with its bound head replaced by the module it was imported from."""
        head, dot, rest = name.partition(".")
        if head.startswith("@"):
            return head[1:] + dot + rest
        return self.modules.get(head, head) + dot + rest

    def text_of(self, span: tuple[int, int]) -> str | None:
        """Text of an expression that is a literal, a known name, or joined of such; unknown parts are left out."""
        a, b = span
        parts, known = [], False
        for i in range(a, b):
            t = self.t[i]
            if (v := literal(t)) is not None:
                parts.append(v)
                known = True
            elif t.kind == "name" and t.value in self.texts and not (i and self.t[i - 1].value == "."):
                parts.append(self.texts[t.value])
                known = True
            elif t.value not in ("+", "(", ")"):
                parts.append("{}")
        return "".join(parts) if known else None

    def marks_of(self, span: tuple[int, int]) -> set[str]:
        a, b = span
        out: set[str] = set()
        i = a
        while i < b:
            t = self.t[i]
            if t.kind == "template":
                for m in re.finditer(r"\$\{\s*([A-Za-z_$][\w$.\[\]]*)", t.value):
                    out |= self._named(m[1].split("[")[0])
            elif t.kind == "name" and not (i and self.t[i - 1].value in (".", "?.")):
                j, chain = i, [t.value]
                while j + 2 < b and self.t[j + 1].value in (".", "?.") and self.t[j + 2].kind == "name":
                    j += 2
                    chain.append(self.t[j].value)
                called = j + 1 < b and self.t[j + 1].value == "("
                out |= self._named(".".join(chain), called, self.split(j + 1) if called else [], j + 1 < b and self.t[j + 1].value == "[")
                i = j
            i += 1
        return out

    def _named(self, chain: str, called: bool = False, args: list | None = None, indexed: bool = False) -> set[str]:
        head = chain.split(".")[0]
        out = set(self.marks.get(head, ()))
        full = self.resolve(chain)
        if called and head not in self.texts and (full in FETCHES or full.split(".")[0] in ("axios", "got") and "." in full):
            out.add("remote")
        if full.startswith(("process.argv", "process.stdin")) or full.startswith("process.env.") or full == "process.env" and indexed:
            out.add("local")
        if called and (full == "atob" or full == "String.fromCharCode" or full == "Buffer.from" and args and len(args) > 1 and self.text_of(args[1]) in ("base64", "hex")):
            out.add("decoded")
        return out

    # -- statements ----------------------------------------------------------------------------------

    def run(self) -> None:
        i = 0
        while i < len(self.t):
            t = self.t[i]
            if t.kind == "name" and t.value == "import":
                self.imports(i)
            elif t.value in ("=", "+=") and t.kind == "sign" and i:
                self.assign(i)
            elif t.value == "(" and i and (self.t[i - 1].kind == "name" and self.t[i - 1].value not in _CONTROL or self.t[i - 1].value == ")"):
                name, begin = self.chain_before(i - 1)
                if name and not name.endswith(")"):
                    defined = begin and self.t[begin - 1].value in ("function", "class")
                    if not defined:
                        new = bool(begin) and self.t[begin - 1].value == "new"
                        self.call(Call(name, self.split(i), self.t[begin].line, new, begin, i, self.pair.get(i, len(self.t))))
                    elif "." not in name:
                        self.forget(name)
            i += 1

    def forget(self, name: str) -> None:
        for table in (self.marks, self.texts, self.modules):
            table.pop(name, None)
        self.modules[name] = "\0local"

    def imports(self, i: int) -> None:
        j = i + 1
        names: list[tuple[str, str]] = []
        while j < len(self.t) and j < i + 60 and self.t[j].kind != "string":
            t = self.t[j]
            if t.value == "{":
                for a, b in self.split(j):
                    words = [x.value for x in self.t[a:b] if x.kind == "name" and x.value != "type"]
                    if words:
                        names.append((words[-1], "." + words[0]))
                j = self.pair.get(j, j)
            elif t.kind == "name" and t.value not in ("from", "as", "type"):
                names.append((t.value, ""))
            elif t.value in (";", "("):
                return
            j += 1
        if j < len(self.t) and self.t[j].kind == "string":
            module = _module(self.t[j].value[1:-1])
            for name, part in names:
                self.modules[name] = module + part

    def assign(self, i: int) -> None:
        end = i + 1
        while end < len(self.t):
            v = self.t[end]
            if v.kind == "sign" and v.value in _OPEN:
                end = self.pair.get(end, len(self.t) - 1)
            elif v.kind == "sign" and (v.value in (";", ",") or v.value in _CLOSE):
                break
            elif v.kind == "name" and v.value in ("const", "let", "var", "return", "function", "if", "for") and end > i + 1 and v.line > self.t[i].line:
                break
            elif end > i + 1 and v.line > self.t[end - 1].line and v.kind == "name" and (self.t[end - 1].kind in ("name", "string", "number", "template") or self.t[end - 1].value in (")", "]", "}")):
                break
            end += 1
        span = (i + 1, end)
        left = self.t[i - 1]
        marks = self.marks_of(span)
        required = self._required(span)
        if left.value in ("}", "]") and i - 1 in self.pair:
            for a, b in self.split(self.pair[i - 1]):
                words = [x.value for x in self.t[a:b] if x.kind == "name"]
                if words:
                    self.forget(words[-1])
                    self.marks[words[-1]] = set(marks)
                    self.modules.pop(words[-1], None)
                    if required:
                        self.modules[words[-1]] = f"{required}.{words[0]}"
            return
        if left.kind != "name" or i > 1 and self.t[i - 2].value in (".", "?."):
            return
        name = left.value
        if self.t[i].value == "+=":
            self.marks.setdefault(name, set()).update(marks)
            return
        self.marks[name] = marks
        self.texts.pop(name, None)
        self.modules.pop(name, None)
        if (text := self.text_of(span)) is not None and span[1] - span[0] <= 9:
            self.texts[name] = text
        if required:
            self.modules[name] = required
        head = self.resolve(self.chain_before(self._head_end(span))[0]) if span[1] > span[0] else ""
        if re.fullmatch(r"(?:net|tls)\.(?:connect|createConnection|Socket)", head):
            self.sockets.add(name)
        if head.split(".")[-1] == "spawn":
            call = next((k for k in range(span[0], span[1]) if self.t[k].value == "("), None)
            args = self.split(call) if call is not None else []
            if args and _SHELL_WORD.search(self.text_of(args[0]) or " ".join(x.value for x in self.t[args[0][0] : args[0][1]])):
                self.shells.add(name)

    def _head_end(self, span: tuple[int, int]) -> int:
        k = span[0]
        if self.t[k].value in ("new", "await"):
            k += 1
        while k + 2 < span[1] and self.t[k + 1].value in (".", "?.") and self.t[k + 2].kind == "name":
            k += 2
        return min(k, span[1] - 1)

    def _required(self, span: tuple[int, int]) -> str | None:
        a, b = span
        if b - a >= 4 and self.t[a].value == "require" and (m := literal(self.t[a + 2])):
            rest = "".join(x.value for x in self.t[a + 4 : b])
            return _module(m) + (rest if re.fullmatch(r"(?:\.\w+)*", rest) else "")
        return None

    # -- calls ---------------------------------------------------------------------------------------

    def call(self, c: Call) -> None:
        full = self.resolve(c.callee)
        last = full.rsplit(".", 1)[-1]
        hit = lambda rule: self.found.add((rule, c.line))
        process = full.startswith("child_process.") and last in PROCESS_CALLS
        asks = full in ("fetch", "axios", "got", "http.get", "https.get", "http.request", "https.request") or full.split(".")[0] == "axios"
        evaluates, reads = full in EVALUATES, _READS.fullmatch(full)
        # arguments of an outer call hold those of its inner calls: they are read only where a rule looks at them
        args = [self.marks_of(a) for a in c.args] if process or evaluates else []
        texts = [self.text_of(a) for a in c.args] if process or evaluates or asks or reads else []
        runs: list[tuple[set[str], str | None]] = []
        if full == "eval" and c.args:
            runs.append((args[0], texts[0]))
        elif full == "Function" and c.args:
            runs.append((args[-1], None))
        elif full in ("vm.runInThisContext", "vm.runInNewContext", "vm.runInContext") and c.args:
            runs.append((args[0], texts[0]))
        commands: list[tuple[set[str], str | None]] = []
        if process and c.args:
            whole = " ".join(t.value for t in self.t[c.open : c.close])
            listed = self.split(c.args[1][0]) if len(c.args) > 1 and self.t[c.args[1][0]].value == "[" else []
            if last in ("exec", "execSync"):
                commands.append((args[0], texts[0]))
                runs.append((args[0], texts[0]))
            elif re.search(r"\bshell\s*:\s*(?:true|[\"'])", whole):
                commands.append((args[0], texts[0]))
                if listed:
                    commands.append((args[1], texts[1]))
            if len(listed) > 1 and (flag := self.text_of(listed[0])) in ("-c", "-e", "/c"):
                inner = (self.marks_of(listed[1]), self.text_of(listed[1]))
                if flag != "-e" and _SHELL.match(texts[0] or ""):
                    commands.append(inner)
                if flag == "-e" and _CODE_NAMES.match(texts[0] or ""):
                    runs.append(inner)
        for marks, _ in runs:
            if "remote" in marks:
                hit("E64")
            if "decoded" in marks:
                hit("E69")
        for marks, text in commands:
            if "local" in marks:
                hit("E65")
            if text and _PIPED.search(text):
                hit("E71")
        self._sockets(c, full, last, hit)
        if reads and texts and texts[0] and CREDENTIAL_PATH.search(texts[0]):
            hit("E67")
        k = bisect(self.process, c.open)
        whole = "".join(t.value for t in self.t[c.open : c.close]) if k < len(self.process) and self.process[k] < c.close else ""
        dumped = re.search(r"(?<![\w.])process\.env(?![\w.\[])", whole)
        if dumped and (full == "fetch" and "JSON.stringify(" in whole or full.split(".")[0] == "axios" and "." in full or last in ("write", "end") and "JSON.stringify(process.env" in whole or full == "btoa" and "JSON.stringify(process.env" in whole):
            hit("E68")
        if dumped and full == "Buffer.from" and "JSON.stringify(process.env" in whole and re.match(r"\)\.toString\([\"']base64", "".join(t.value for t in self.t[c.close : c.close + 5])):
            hit("E68")
        if asks and texts and texts[0] and metadata_host(texts[0]):
            hit("E70")
        if process or full == "eval" or full == "Function" and c.new or re.fullmatch(r"vm\.run\w*", full):
            hit("E72")
        if asks or re.fullmatch(r"(?:net|tls)\.(?:connect|createConnection)", full) or full == "WebSocket" and c.new:
            hit("E73")
        self._callbacks(c, full, last)

    def _sockets(self, c: Call, full: str, last: str, hit) -> None:
        if last == "pipe" and c.args:
            head, inside = c.callee.split(".")[0], self._connect_callback(c.at)
            target = self.t[c.args[0][0]].value
            if (head in self.sockets or head == "this" and inside) and target in self.shells or head in self.shells and (target in self.sockets or target == "this" and inside):
                hit("E66")
        words = [t.value for t in self.t[c.open : c.close]] if last == "spawn" else []
        if "stdio" in words and any(w in self.sockets for w in words) and c.args and _SHELL_WORD.search(self.text_of(c.args[0]) or ""):
            hit("E66")

    def _connect_callback(self, at: int) -> bool:
        """Whether a place lies inside the arguments of a net or tls connection."""
        for j, k in self.pair.items():
            if j < at < k and self.t[j].value == "(" and j and self.t[j - 1].kind == "name":
                if re.fullmatch(r"(?:net|tls)\.(?:connect|createConnection)", self.resolve(self.chain_before(j - 1)[0])):
                    return True
        return False

    def _callbacks(self, c: Call, full: str, last: str) -> None:
        """Parameters of functions given to a call hold what its receiver holds, or what it fetches."""
        marks = self._named(c.callee, True, c.args) if last in ("then", "on", "once", "get", "map", "forEach") else set()
        if c.callee.startswith("()") or last == "then":
            marks |= self.marks_of((max(0, self._receiver(c)), c.open))
        if full in FETCHES:
            marks.add("remote")
        if not marks:
            return
        for a, b in c.args:
            i = a + (self.t[a].value == "async")
            if i >= b:
                continue
            if self.t[i].kind == "name" and i + 1 < b and self.t[i + 1].value == "=>":
                self.marks.setdefault(self.t[i].value, set()).update(marks)
            elif self.t[i].value in ("(", "function"):
                k = i if self.t[i].value == "(" else next((x for x in range(i, b) if self.t[x].value == "("), b)
                if k < b:
                    for x, y in self.split(k):
                        if self.t[x].kind == "name":
                            self.marks.setdefault(self.t[x].value, set()).update(marks)

    def _receiver(self, c: Call) -> int:
        i = c.at - 1
        while i > 0 and self.t[i].value in (".", "?."):
            j = i - 1
            if self.t[j].value == ")" and j in self.pair:
                i = self.chain_before(self.pair[j] - 1)[1] - 1
            else:
                i = self.chain_before(j)[1] - 1
        return i + 1


def _module(name: str | None) -> str:
    return (name or "").removeprefix("node:")


# A text without any of these names calls nothing that a rule looks for.
_TRIGGERS = re.compile(r"child_process|\beval\b|\bFunction\b|\bvm\b|fetch|axios|\bgot\b|\bhttps?\b|\bnet\b|\btls\b|WebSocket|readFile|createReadStream|process\.env|\bbtoa\b|Buffer")


def script_findings(text: str) -> list[tuple[str, int]]:
    """``(rule number, line)`` of a script."""
    if not _TRIGGERS.search(text):
        return []
    s = _Script(text)
    s.run()
    return sorted(s.found, key=lambda x: (x[1], x[0]))

"""Grammar check for shell scripts in bash syntax.

One pass over the text: words with their quoting, substitutions and nested
commands, here-documents, and the compound commands by recursive descent.
A here-document that runs to the end of the file is accepted, as the shell does.
"""

from __future__ import annotations

import re


class Invalid(Exception):
    pass


_BLANK = re.compile(r"(?:[ \t]|\\\n)+")
_PLAIN = re.compile(r"[^\s\\'\"`$|&;()<>{}=\[\]]+")
_OPERATOR = re.compile(r"\n|&&|\|\||;;&|;;|;&|\|&|&>>|&>|<<<|<<-|<<|<&|<>|<\(|>\(|>>|>&|>\||[|&;()<>]")
_REDIRECTS = {"<", ">", ">>", "<<", "<<-", "<<<", "<&", ">&", "<>", ">|", "&>", "&>>"}
_RESERVED = {"if", "then", "else", "elif", "fi", "for", "while", "until", "do", "done", "case", "esac", "select", "function", "{", "}", "!", "[[", "time", "coproc"}
_NAME = re.compile(r"[A-Za-z_]\w*$")
_FD = re.compile(r"(?:\d+|\{[A-Za-z_]\w*\})$")
_ASSIGN = re.compile(r"[A-Za-z_]\w*(?:\[[^\]]*\])?\+?=$")


class Shell:
    def __init__(self, text: str, at: int = 0, depth: int = 0) -> None:
        self.s, self.i, self.n = text, at, len(text)
        self.heredocs: list[tuple[str, bool]] = []
        self.depth = depth
        if depth > 60:
            raise Invalid("nested too deep")
        self.kind = self.value = ""
        self.quoted = False
        self.start = at

    # -- tokens ------------------------------------------------------------

    def next(self) -> None:
        """Move to the next token: ``word``, ``op`` or ``eof``."""
        s = self.s
        m = _BLANK.match(s, self.i)
        if m:
            self.i = m.end()
        if self.i < self.n and s[self.i] == "#":
            j = s.find("\n", self.i)
            self.i = self.n if j < 0 else j
        self.start = self.i
        if self.i >= self.n:
            self.kind, self.value, self.quoted = "eof", "", False
            return
        m = _OPERATOR.match(s, self.i)
        if m and m.group() not in ("<(", ">("):
            self.kind, self.value, self.quoted = "op", m.group(), False
            self.i = m.end()
            if self.value == "\n" and self.heredocs:
                self.bodies()
            return
        self.word()

    def bodies(self) -> None:
        for mark, tabs in self.heredocs:
            while self.i < self.n:
                j = self.s.find("\n", self.i)
                line = self.s[self.i : j if j >= 0 else self.n]
                self.i = j + 1 if j >= 0 else self.n
                if (line.lstrip("\t") if tabs else line) == mark:
                    break
        self.heredocs = []

    def word(self) -> None:
        s, begin = self.s, self.i
        self.kind, self.quoted = "word", False
        out = []
        while self.i < self.n:
            c = s[self.i]
            m = _PLAIN.match(s, self.i)
            if m:
                out.append(m.group())
                self.i = m.end()
            elif c in " \t\n|&;)":
                break
            elif c in "<>":
                if s[self.i + 1 : self.i + 2] == "(" and True:
                    self.i += 2
                    self.commands(")")
                    out.append("<()")
                else:
                    break
            elif c == "(":
                if out and _ASSIGN.match("".join(out)):
                    self.array()
                    out.append("()")
                elif out and out[-1] in ("?", "*", "+", "@", "!") or s[self.i - 1] in "?*+@!" and self.i > begin:
                    self.group()
                else:
                    break
            elif c == "\\":
                self.quoted = True
                if s[self.i + 1 : self.i + 2] != "\n":
                    out.append(s[self.i + 1 : self.i + 2])
                self.i += 2
            elif c == "'":
                j = s.find("'", self.i + 1)
                if j < 0:
                    raise Invalid("quote does not end")
                out.append(s[self.i + 1 : j])
                self.quoted = True
                self.i = j + 1
            elif c == '"':
                a = self.i
                self.double()
                out.append(s[a + 1 : self.i - 1])
                self.quoted = True
            elif c == "`":
                self.backquote()
                out.append("``")
            elif c == "$":
                out.append(self.dollar(False))
            else:
                out.append(c)
                self.i += 1
        self.value = "".join(out)
        if self.i == begin:
            raise Invalid(f"unexpected {s[self.i]!r}")

    def group(self) -> None:
        """Extended pattern in parentheses."""
        depth = 0
        while self.i < self.n:
            c = self.s[self.i]
            if c == "\\":
                self.i += 1
            elif c == "'":
                j = self.s.find("'", self.i + 1)
                if j < 0:
                    raise Invalid("quote does not end")
                self.i = j
            elif c == '"':
                self.double()
                continue
            elif c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
                if not depth:
                    self.i += 1
                    return
            self.i += 1
        raise Invalid("pattern does not end")

    def array(self) -> None:
        self.i += 1
        while True:
            self.next()
            if self.kind == "eof":
                raise Invalid("array does not end")
            if self.kind == "op":
                if self.value == ")":
                    self.kind = "word"
                    return
                if self.value != "\n":
                    raise Invalid(f"unexpected {self.value!r} in an array")

    def double(self) -> None:
        s = self.s
        self.i += 1
        while self.i < self.n:
            c = s[self.i]
            if c == '"':
                self.i += 1
                return
            if c == "\\":
                self.i += 2
            elif c == "`":
                self.backquote()
            elif c == "$":
                self.dollar(True)
            else:
                self.i += 1
        raise Invalid("quote does not end")

    def backquote(self) -> None:
        j = self.i + 1
        while j < self.n and self.s[j] != "`":
            j += 2 if self.s[j] == "\\" else 1
        if j >= self.n:
            raise Invalid("backquote does not end")
        inner = re.sub(r"\\([`\\$])", r"\1", self.s[self.i + 1 : j])
        Shell(inner, 0, self.depth + 1).script()
        self.i = j + 1

    def dollar(self, inside: bool) -> str:
        s = self.s
        follow = s[self.i + 1 : self.i + 2]
        if s.startswith("((", self.i + 1):
            kept = self.i
            self.i += 3
            if self.arithmetic():
                return "$(())"
            self.i = kept
        if follow == "(":
            self.i += 2
            self.commands(")")
            return "$()"
        if follow == "{":
            self.i += 2
            self.parameter()
            return "${}"
        if follow == "'" and not inside:
            j = self.i + 2
            while j < self.n and s[j] != "'":
                j += 2 if s[j] == "\\" else 1
            if j >= self.n:
                raise Invalid("quote does not end")
            self.i = j + 1
            self.quoted = True
            return "''"
        if follow == '"' and not inside:
            self.i += 1
            self.double()
            self.quoted = True
            return '""'
        self.i += 1
        return "$"

    def parameter(self) -> None:
        s = self.s
        if self.i < self.n and s[self.i] in "} \n\t":
            raise Invalid("bad substitution")
        while self.i < self.n:
            c = s[self.i]
            if c == "}":
                self.i += 1
                return
            if c == "\\":
                self.i += 2
            elif c == "'":
                j = s.find("'", self.i + 1)
                if j < 0:
                    raise Invalid("quote does not end")
                self.i = j + 1
            elif c == '"':
                self.double()
            elif c == "`":
                self.backquote()
            elif c == "$":
                self.dollar(True)
            else:
                self.i += 1
        raise Invalid("substitution does not end")

    def arithmetic(self) -> bool:
        """Skip to the )) of an arithmetic expression; False if a single ) closes first."""
        depth = 0
        s = self.s
        while self.i < self.n:
            c = s[self.i]
            if c == "(":
                depth += 1
                self.i += 1
            elif c == ")":
                if not depth:
                    if s.startswith("))", self.i):
                        self.i += 2
                        return True
                    return False
                depth -= 1
                self.i += 1
            elif c == "\\":
                self.i += 2
            elif c == '"':
                self.double()
            elif c == "'":
                j = s.find("'", self.i + 1)
                self.i = j + 1 if j >= 0 else self.n
            elif c == "`":
                self.backquote()
            elif c == "$":
                self.dollar(True)
            else:
                self.i += 1
        raise Invalid("arithmetic does not end")

    def commands(self, close: str) -> None:
        """Commands inside a substitution, up to its closing parenthesis."""
        inner = Shell(self.s, self.i, self.depth + 1)
        inner.next()
        inner.newlines()
        if not inner.op(close):
            inner.list()
        if not inner.op(close):
            raise Invalid("substitution does not end" if inner.kind == "eof" else f"unexpected {inner.value!r}")
        self.i = inner.i

    # -- grammar -----------------------------------------------------------

    def op(self, value: str) -> bool:
        return self.kind == "op" and self.value == value

    def reserved(self, value: str) -> bool:
        return self.kind == "word" and self.value == value and not self.quoted

    def newlines(self) -> None:
        while self.op("\n"):
            self.next()

    def script(self) -> None:
        self.next()
        self.newlines()
        if self.kind != "eof":
            self.list()
        if self.kind != "eof":
            raise Invalid(f"unexpected {self.value!r}")

    _STOP = ("then", "else", "elif", "fi", "do", "done", "esac", "}")

    def stops(self) -> bool:
        return self.kind == "eof" or self.kind == "op" and self.value in (")", ";;", ";&", ";;&") or self.kind == "word" and not self.quoted and self.value in self._STOP

    def list(self) -> None:
        """One or more commands; ends before a closing word, operator or the end."""
        self.newlines()
        if self.stops():
            raise Invalid(f"unexpected {self.value or 'end'!r}")
        while True:
            self.pipeline()
            while self.kind == "op" and self.value in ("&&", "||"):
                self.next()
                self.newlines()
                self.pipeline()
            if self.kind == "op" and self.value in (";", "&", "\n"):
                self.next()
                self.newlines()
                if self.stops():
                    return
            elif self.stops():
                return
            else:
                raise Invalid(f"unexpected {self.value!r}")

    def pipeline(self) -> None:
        while self.reserved("!") or self.reserved("time"):
            self.next()
            if self.reserved("-p"):
                self.next()
        self.command()
        while self.kind == "op" and self.value in ("|", "|&"):
            self.next()
            self.newlines()
            self.command()

    def redirects(self) -> None:
        while self.redirect():
            pass

    def redirect(self) -> bool:
        if self.kind == "word" and not self.quoted and _FD.match(self.value) and self.i < self.n and self.s[self.i] in "<>":
            kept = self.i, self.kind, self.value, self.quoted
            self.next()
            if self.kind == "op" and self.value in _REDIRECTS:
                return self.redirect()
            self.i, self.kind, self.value, self.quoted = kept
            return False
        if self.kind != "op" or self.value not in _REDIRECTS:
            return False
        how = self.value
        self.next()
        if self.kind != "word":
            raise Invalid(f"unexpected {self.value or 'end'!r} after {how}")
        if how in ("<<", "<<-"):
            self.heredocs.append((self.value, how == "<<-"))
        self.next()
        return True

    def body(self, opening: str, closing: str) -> None:
        if not self.reserved(opening):
            raise Invalid(f"expected {opening} before {self.value!r}")
        self.next()
        self.list()
        if not self.reserved(closing):
            raise Invalid(f"expected {closing} before {self.value or 'end'!r}")
        self.next()

    def command(self) -> None:
        if self.kind == "op":
            if self.value == "(":
                if self.s.startswith("(", self.i):
                    kept = self.i
                    self.i += 1
                    if self.arithmetic():
                        self.next()
                        return self.redirects()
                    self.i = kept
                self.next()
                self.list()
                if not self.op(")"):
                    raise Invalid("parenthesis stays open")
                self.next()
                return self.redirects()
            if self.value in _REDIRECTS:
                return self.simple()
            raise Invalid(f"unexpected {self.value!r}")
        if self.kind == "eof":
            raise Invalid("unexpected end")
        if not self.quoted and self.value in _RESERVED:
            return self.compound(self.value)
        return self.simple()

    def compound(self, word: str) -> None:
        if word == "{":
            self.body("{", "}")
        elif word == "if":
            self.next()
            self.list()
            if not self.reserved("then"):
                raise Invalid("if without then")
            self.next()
            self.list()
            while self.reserved("elif"):
                self.next()
                self.list()
                if not self.reserved("then"):
                    raise Invalid("elif without then")
                self.next()
                self.list()
            if self.reserved("else"):
                self.next()
                self.list()
            if not self.reserved("fi"):
                raise Invalid("if without fi")
            self.next()
        elif word in ("while", "until"):
            self.next()
            self.list()
            self.body("do", "done")
        elif word in ("for", "select"):
            self.next()
            if self.op("(") and self.s.startswith("(", self.i):
                self.i += 1
                if not self.arithmetic():
                    raise Invalid("arithmetic does not end")
                self.next()
            else:
                if self.kind != "word" or not _NAME.match(self.value):
                    raise Invalid("for without a name")
                self.next()
                self.newlines()
                if self.reserved("in"):
                    self.next()
                    while self.kind == "word":
                        self.next()
                    if not (self.op(";") or self.op("\n")):
                        raise Invalid(f"unexpected {self.value!r}")
            if self.op(";"):
                self.next()
            self.newlines()
            if self.reserved("{"):
                self.body("{", "}")
            else:
                self.body("do", "done")
        elif word == "case":
            self.case()
        elif word == "function":
            self.next()
            if self.kind != "word":
                raise Invalid("function without a name")
            self.next()
            if self.op("("):
                self.next()
                if not self.op(")"):
                    raise Invalid("expected )")
                self.next()
            self.newlines()
            self.function_body()
        elif word == "[[":
            self.test()
        elif word == "coproc":
            self.next()
            return self.command()
        else:
            raise Invalid(f"unexpected {word!r}")
        return self.redirects()

    def function_body(self) -> None:
        if self.op("(") or self.kind == "word" and not self.quoted and self.value in ("{", "if", "for", "while", "until", "case", "select", "[["):
            return self.command()
        raise Invalid("function without a body")

    def case(self) -> None:
        self.next()
        if self.kind != "word":
            raise Invalid("case without a word")
        self.next()
        self.newlines()
        if not self.reserved("in"):
            raise Invalid("case without in")
        self.next()
        self.newlines()
        while not self.reserved("esac"):
            if self.kind == "eof":
                raise Invalid("case without esac")
            if self.op("("):
                self.next()
            if self.kind != "word":
                raise Invalid(f"unexpected {self.value!r}")
            self.next()
            while self.op("|"):
                self.next()
                if self.kind != "word":
                    raise Invalid(f"unexpected {self.value!r}")
                self.next()
            if not self.op(")"):
                raise Invalid(f"unexpected {self.value!r}")
            self.next()
            self.newlines()
            if not self.stops():
                self.list()
            if self.kind == "op" and self.value in (";;", ";&", ";;&"):
                self.next()
                self.newlines()
            elif not self.reserved("esac"):
                raise Invalid(f"unexpected {self.value or 'end'!r}")
        self.next()

    def test(self) -> None:
        """Conditional expression between [[ and ]]."""
        depth = 0
        operands = 0
        operator = False
        self.next()
        while not (self.reserved("]]") and not depth):
            if self.kind == "eof":
                raise Invalid("[[ without ]]")
            if self.kind == "op":
                if self.value == "(":
                    depth += 1
                elif self.value == ")":
                    depth -= 1
                    if depth < 0:
                        raise Invalid("unexpected )")
                    operands, operator = 1, True
                elif self.value in ("&&", "||"):
                    if not operands:
                        raise Invalid(f"unexpected {self.value!r}")
                    operands, operator = 0, False
                elif self.value in ("<", ">"):
                    operator = True
                elif self.value != "\n":
                    raise Invalid(f"unexpected {self.value!r}")
                self.next()
                continue
            if not self.quoted and self.value == "=~":
                operator = True
                self.pattern()
                operands += 1
                continue
            if not self.quoted and (re.fullmatch(r"-[a-zA-Z]{1,2}|==|=|!=", self.value)):
                operator = True
            elif self.value != "!" or self.quoted:
                operands += 1
                if operands > 2 or operands == 2 and not operator:
                    raise Invalid("conditional operator expected")
            self.next()
        if not operands and not operator:
            raise Invalid("empty condition")
        self.next()

    def pattern(self) -> None:
        """Regular expression after =~ : one word in which ( | ) are plain."""
        s = self.s
        m = _BLANK.match(s, self.i)
        if m:
            self.i = m.end()
        depth = 0
        while self.i < self.n:
            c = s[self.i]
            if c in " \t\n" and not depth:
                break
            if c == "(":
                depth += 1
            elif c == ")":
                if not depth:
                    break
                depth -= 1
            elif c == "\\":
                self.i += 1
            elif c == "'":
                j = s.find("'", self.i + 1)
                if j < 0:
                    raise Invalid("quote does not end")
                self.i = j
            elif c == '"':
                self.double()
                continue
            elif c == "$":
                self.dollar(True)
                continue
            elif c == "[":
                j = s.find("]", self.i + 2)
                if j > 0 and "\n" not in s[self.i : j]:
                    self.i = j
            self.i += 1
        self.next()

    def simple(self) -> None:
        first = True
        words = 0
        while True:
            if self.redirect():
                first = False
                continue
            if self.kind == "word":
                words += 1
                self.next()
                if words == 1 and first and self.op("("):
                    # a function definition
                    self.next()
                    if not self.op(")"):
                        raise Invalid(f"unexpected {self.value!r}")
                    self.next()
                    self.newlines()
                    return self.function_body()
                continue
            break
        if self.op("("):
            raise Invalid("unexpected (")
        return None


def check(text: str) -> str | None:
    """Why the text is no valid script, or None."""
    try:
        Shell(text).script()
    except Invalid as e:
        return str(e)
    except RecursionError:
        return "nested too deep"
    return None

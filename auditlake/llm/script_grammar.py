"""Grammar check for JavaScript modules and TypeScript.

The lexer runs over chunks.  A chunk is a map from the state the lexer can be in
at its start to a summary: the tokens, the state at its end, the brackets it
closes without having opened and those it leaves open.  Summaries of
neighbouring chunks are combined associatively, in a tree; only a text that
ends in code with every bracket matched reaches the grammar, which parses one
statement after the other.
"""

from __future__ import annotations

import re


class Invalid(Exception):
    pass


_ID = r"(?:[^\W\d]|[$\\])(?:[\w$‌‍]|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))*"
_TOKEN = re.compile(
    rf"""(?P<ws>[^\S\n\r  ]+|﻿+)|(?P<nl>[\n\r  ])|(?P<lc>//[^\n\r  ]*)|(?P<bc>/\*)
    |(?P<id>\#?{_ID})
    |(?P<num>0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:(?:0|[1-9](?:_?\d)*)n(?![\w$]))|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)
    |(?P<str>"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')
    |(?P<tpl>`)
    |(?P<p>=>|\.\.\.|>>>=|\*\*=|<<=|>>=|===|!==|&&=|\|\|=|\?\?=|\*\*|\+\+|--|<<|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[{{}}()\[\];,<>+\-*/%&|^!~?:=.@])
    """,
    re.X,
)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
_KEYWORDS = set("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split())
_OPERAND_WORDS = {"this", "super", "null", "true", "false"}
_PAIR = {")": "(", "]": "[", "}": "{"}


#: Characters of a chunk; a longer text is lexed chunk by chunk and the summaries are reduced in a tree.
CHUNK = 1 << 16
#: State between two tokens: where the lexer stands, whether an operand came last (a slash divides then), newline seen.
START = ("code", False, False)


class Summary:
    """What a stretch of text does to the lexer from one start state.

    ``close`` are closing brackets without an opener in the stretch, as
    (bracket, tokens before it, chunk, offset after it); ``open`` are openers
    left, "`" standing for a template expression.  A "}" without an opener is
    taken to close a block; should it turn out to close a template expression,
    the stretch is lexed again from there, as template text.
    """

    __slots__ = ("tokens", "close", "open", "state", "error")

    def __init__(self, state: tuple) -> None:
        self.tokens: list = []
        self.close: list = []
        self.open: list = []
        self.state, self.error = state, None


class Stretch:
    """Consecutive chunks as a map from start state to summary, filled on demand."""

    def __init__(self, chunks: list[str], first: int = 0, halves: tuple | None = None) -> None:
        self.chunks, self.first, self.halves = chunks, first, halves
        self.map: dict[tuple, Summary] = {}

    def summary(self, state: tuple) -> Summary:
        if state not in self.map:
            if self.halves:
                left = self.halves[0].summary(state)
                self.map[state] = left if left.error else join(left, self.halves[1].summary(left.state), self.halves[1])
            else:
                self.map[state] = scan(self.chunks[0], 0, state, self.first)
        return self.map[state]

    def resume(self, chunk: int, at: int) -> Summary:
        """Summary from inside a chunk on, as the rest of a template."""
        out = scan(self.chunks[chunk - self.first], at, ("rest", False, False), chunk)
        for k in range(chunk + 1, self.first + len(self.chunks)):
            if out.error:
                break
            one = Stretch([self.chunks[k - self.first]], k)
            out = join(out, one.summary(out.state), one)
        return out

    def __add__(self, other: Stretch) -> Stretch:
        return Stretch(self.chunks + other.chunks, self.first, (self, other))


def join(a: Summary, b: Summary, right: Stretch) -> Summary:
    """Summary of two neighbouring stretches; brackets that meet must be of one kind."""
    left, k = list(a.open), 0
    while k < len(b.close) and left:
        bracket, n, chunk, at = b.close[k]
        if bracket == "}" and left[-1] == "`":
            left.pop()
            rest = right.resume(chunk, at)
            fixed = Summary(rest.state)
            fixed.tokens = b.tokens[:n] + rest.tokens
            fixed.close = b.close[:k] + [(x, m + n, c, o) for x, m, c, o in rest.close]
            fixed.open, fixed.error = rest.open, rest.error
            b = fixed
            continue
        if _PAIR[bracket] != left.pop():
            b.error = b.error or "brackets do not match"
            break
        k += 1
    out = Summary(b.state)
    out.tokens = a.tokens + b.tokens
    out.close = a.close + [(x, m + len(a.tokens), c, o) for x, m, c, o in b.close[k:]]
    out.open, out.error = left + b.open, b.error
    return out


def scan(text: str, at: int, state: tuple, chunk: int) -> Summary:
    """Lex one chunk from ``at`` on."""
    out = Summary(state)
    mode, operand, nl = state
    tokens, stack = out.tokens, out.open
    match, add, end = _TOKEN.match, tokens.append, len(text)
    while at < end:
        if mode != "code":
            if mode == "comment":
                close = text.find("*/", at)
                if close < 0:
                    nl = nl or "\n" in text[at:]
                    break
                nl = nl or "\n" in text[at:close]
                at, mode = close + 2, "code"
                continue
            at = _TEMPLATE.match(text, at).end()
            if text.startswith("`", at):
                at += 1
                add(("tpl" if mode == "head" else "tt", "`", nl))
                operand = True
            elif text.startswith("${", at):
                at += 2
                add(("th" if mode == "head" else "tm", "${", nl))
                stack.append("`")
                operand = False
            elif at < end:
                out.error = "template does not end"
                return out
            else:
                break
            mode, nl = "code", False
            continue
        m = match(text, at)
        if not m:
            out.error = f"character {text[at]!r}"
            return out
        kind = m.lastgroup
        begin, at = at, m.end()
        if kind == "ws" or kind == "lc":
            continue
        if kind == "nl":
            nl = True
            continue
        if kind == "bc":
            mode = "comment"
            continue
        if kind == "tpl":
            mode = "head"
            continue
        value = m.group()
        if kind == "id":
            if value in _KEYWORDS:
                kind = "kw"
            operand = kind == "id" or value in _OPERAND_WORDS
        elif kind == "num":
            if at < end and (text[at].isalnum() or text[at] in "_$"):
                out.error = "number runs into a name"
                return out
            operand = True
        elif kind == "str":
            operand = True
        else:
            if value in "([{":
                stack.append(value)
            elif value in ")]}":
                if not stack:
                    out.close.append((value, len(tokens), chunk, at))
                else:
                    top = stack.pop()
                    if value == "}" and top == "`":
                        mode, nl = "rest", False
                        continue
                    if _PAIR[value] != top:
                        out.error = "brackets do not match"
                        return out
            elif value in ("/", "/=") and not operand:
                r = _REGEX.match(text, begin)
                if not r:
                    out.error = "regular expression does not end"
                    return out
                at, kind, value = r.end(), "re", r.group()
            operand = kind == "re" or value in (")", "]", "}", "++", "--")
        add((kind, value, nl))
        nl = False
    out.state = (mode, operand, nl)
    return out


def chunks(text: str, size: int) -> list[str]:
    """Pieces of about ``size`` characters cut after a line break that is not escaped: no string, pattern or line comment is cut."""
    out, start = [], 0
    while len(text) - start > size:
        cut = text.rfind("\n", start, start + size) + 1
        while cut > start + 1 and text[cut - 2] in "\\\r":
            cut = text.rfind("\n", start, cut - 1) + 1
        if cut <= start:
            cut = text.find("\n", start + size) + 1
            while cut and text[cut - 2] in "\\\r":
                cut = text.find("\n", cut) + 1
            if not cut:
                break
        out.append(text[start:cut])
        start = cut
    return [*out, text[start:]]


def lex(text: str, size: int = CHUNK) -> list[tuple[str, str, bool]]:
    """Tokens ``(kind, value, newline before)`` of a balanced text; raises Invalid otherwise."""
    if text.startswith("#!"):
        text = text[text.find("\n") :] if "\n" in text else ""
    level = [Stretch([c], k) for k, c in enumerate(chunks(text, size))]
    while len(level) > 1:
        level = [level[i] + level[i + 1] if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    whole = level[0].summary(START)
    if whole.close:
        raise Invalid(f"{whole.close[0][0]} closes nothing")
    if whole.error:
        raise Invalid(whole.error)
    if whole.state[0] != "code":
        raise Invalid("comment does not end" if whole.state[0] == "comment" else "template does not end")
    if whole.open:
        raise Invalid(f"{whole.open[-1]} stays open")
    return whole.tokens


_BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8,
    "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
_PREFIX = {"!", "~", "+", "-", "++", "--"}
_MODIFIERS = {"public", "private", "protected", "readonly", "static", "abstract", "override", "declare", "async", "accessor"}
_END = ("eof", "", True)


class Parser:
    """Statements of one token list, by recursive descent; ``ts`` allows types."""

    def __init__(self, tokens: list, ts: bool) -> None:
        self.t, self.ts, self.i = tokens, ts, 0
        self.n = len(tokens)
        self.loops = self.switches = self.functions = 0
        self.asynchronous, self.generator = [True], [False]

    def peek(self, k: int = 0) -> tuple:
        j = self.i + k
        return self.t[j] if j < self.n else _END

    def at(self, value: str) -> bool:
        return self.i < self.n and self.t[self.i][1] == value and self.t[self.i][0] in ("p", "kw", "id")

    def take(self, value: str) -> bool:
        if self.at(value):
            self.i += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise Invalid(f"expected {value} before {self.peek()[1]!r}")

    def name(self, words: bool = False) -> str:
        kind, value, _ = self.peek()
        if kind == "id" and (words or value[0] != "#") or words and kind == "kw":
            self.i += 1
            return value
        raise Invalid(f"expected a name before {value!r}")

    def end(self) -> None:
        if self.take(";"):
            return
        kind, value, nl = self.peek()
        if kind == "eof" or nl or kind == "p" and value == "}":
            return
        raise Invalid(f"statement runs into {value!r}")

    # -- statements --------------------------------------------------------

    def program(self) -> None:
        while self.i < self.n:
            self.statement(True)

    def statement(self, top: bool = False) -> None:
        kind, value, _ = self.peek()
        if kind == "p":
            if value == "{":
                return self.block()
            if value == ";":
                self.i += 1
                return None
            if value == "@":
                self.decorators()
                return self.statement(top)
        elif kind == "kw":
            method = getattr(self, "s_" + value, None)
            if method and not (value == "import" and self.peek(1)[1] in ("(", ".")):
                if value in ("import", "export") and not top:
                    raise Invalid(f"{value} inside a block")
                return method()
            if value in ("else", "case", "catch", "finally", "extends", "in", "instanceof"):
                raise Invalid(f"{value} without its beginning")
        elif kind == "id":
            follow = self.peek(1)
            if value == "async" and follow[1] == "function" and not follow[2]:
                self.i += 1
                return self.s_function(True)
            if value == "let" and (follow[0] == "id" or follow[1] in ("[", "{")):
                return self.s_var()
            if follow[1] == ":" and follow[0] == "p":
                self.i += 2
                return self.statement()
            if self.ts and self.ts_statement(value, follow, top):
                return None
        self.expression()
        self.end()
        return None

    def block(self) -> None:
        self.need("{")
        while not self.at("}"):
            if self.i >= self.n:
                raise Invalid("block stays open")
            self.statement()
        self.i += 1

    def s_var(self, in_for: bool = False) -> None:
        const = self.peek()[1] == "const"
        if self.ts and const and self.peek(1)[1] == "enum":
            self.i += 1
            return self.ts_enum()
        self.i += 1
        while True:
            pattern = self.at("[") or self.at("{")
            self.binding()
            if self.ts:
                self.take("!")
                if self.take(":"):
                    self.type()
            if self.take("="):
                self.assign(not in_for)
            elif (const or pattern) and not (in_for and (self.at("of") or self.at("in"))) and not self.ts_ambient():
                raise Invalid("constant without a value")
            if not self.take(","):
                break
        if not in_for:
            self.end()
        return None

    s_const = s_var

    def ts_ambient(self) -> bool:
        return self.ts and getattr(self, "ambient", False)

    def s_function(self, is_async: bool = False, named: bool = True) -> None:
        self.i += 1
        star = self.take("*")
        if named or self.peek()[0] == "id":
            self.name()
        self.function_rest(is_async, star)

    def function_rest(self, is_async: bool, star: bool, body: bool = True) -> None:
        if self.ts and self.at("<"):
            self.type_params()
        self.params()
        if self.ts and self.take(":"):
            self.return_type()
        if self.ts and not self.at("{"):
            return self.end()
        self.body(is_async, star)
        return None

    def body(self, is_async: bool, star: bool) -> None:
        kept = self.loops, self.switches
        self.loops = self.switches = 0
        self.functions += 1
        self.asynchronous.append(is_async)
        self.generator.append(star)
        self.block()
        self.generator.pop()
        self.asynchronous.pop()
        self.functions -= 1
        self.loops, self.switches = kept

    def params(self) -> None:
        self.need("(")
        while not self.take(")"):
            while self.at("@"):
                self.decorators()
            if self.ts:
                while self.peek()[1] in _MODIFIERS and (self.peek(1)[0] == "id" or self.peek(1)[1] in ("{", "[")):
                    self.i += 1
            rest = self.take("...")
            if self.ts and self.at("this"):
                self.i += 1
            else:
                self.binding()
            if self.ts:
                self.take("?")
                if self.take(":"):
                    self.type()
            if not rest and self.take("="):
                self.assign()
            if not self.at(")"):
                if rest:
                    raise Invalid("a rest parameter must be last")
                self.need(",")

    def binding(self) -> None:
        if self.take("["):
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                self.binding()
                if self.take("="):
                    self.assign()
                if not self.at("]"):
                    self.need(",")
        elif self.take("{"):
            while not self.take("}"):
                if self.take("..."):
                    self.name()
                else:
                    plain = self.peek()[0] == "id"
                    self.property_name()
                    if self.take(":"):
                        self.binding()
                    elif not plain:
                        raise Invalid("expected a name")
                    if self.take("="):
                        self.assign()
                if not self.at("}"):
                    self.need(",")
        else:
            self.name()

    def property_name(self) -> None:
        kind, value, _ = self.peek()
        if kind in ("str", "num", "id", "kw"):
            self.i += 1
        elif value == "[" and kind == "p":
            self.i += 1
            self.assign()
            self.need("]")
        else:
            raise Invalid(f"expected a property before {value!r}")

    def s_if(self) -> None:
        self.i += 1
        self.condition()
        self.statement()
        if self.take("else"):
            self.statement()

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def loop(self) -> None:
        self.loops += 1
        self.statement()
        self.loops -= 1

    def s_while(self) -> None:
        self.i += 1
        self.condition()
        self.loop()

    def s_do(self) -> None:
        self.i += 1
        self.loop()
        self.need("while")
        self.condition()
        self.take(";")

    def s_for(self) -> None:
        self.i += 1
        waiting = self.take("await")
        self.need("(")
        if not self.at(";"):
            kind, value, _ = self.peek()
            if value in ("var", "const") and kind == "kw" or value == "let" and kind == "id" and (self.peek(1)[0] == "id" or self.peek(1)[1] in ("[", "{")):
                self.s_var(True)
            else:
                self.expression(False)
            if self.take("of"):
                self.assign()
                self.need(")")
                return self.loop()
            if not waiting and self.take("in"):
                self.expression()
                self.need(")")
                return self.loop()
        self.need(";")
        if not self.at(";"):
            self.expression()
        self.need(";")
        if not self.at(")"):
            self.expression()
        self.need(")")
        self.loop()
        return None

    def s_switch(self) -> None:
        self.i += 1
        self.condition()
        self.need("{")
        self.switches += 1
        while not self.take("}"):
            if self.take("case"):
                self.expression()
            else:
                self.need("default")
            self.need(":")
            while not (self.at("case") or self.at("default") or self.at("}")):
                if self.i >= self.n:
                    raise Invalid("switch stays open")
                self.statement()
        self.switches -= 1

    def s_try(self) -> None:
        self.i += 1
        self.block()
        handled = False
        if self.take("catch"):
            handled = True
            if self.take("("):
                self.binding()
                if self.ts and self.take(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.take("finally"):
            handled = True
            self.block()
        if not handled:
            raise Invalid("try without catch or finally")

    def s_return(self) -> None:
        if not self.functions:
            raise Invalid("return outside a function")
        self.i += 1
        if not self.peek()[2] and not self.at(";") and not self.at("}"):
            self.expression()
        self.end()

    def s_throw(self) -> None:
        self.i += 1
        if self.peek()[2]:
            raise Invalid("throw without a value")
        self.expression()
        self.end()

    def s_break(self) -> None:
        word = self.peek()[1]
        self.i += 1
        if self.peek()[0] == "id" and not self.peek()[2]:
            self.i += 1
        elif not self.loops and not (word == "break" and self.switches):
            raise Invalid(f"{word} outside a loop")
        self.end()

    s_continue = s_break

    def s_debugger(self) -> None:
        self.i += 1
        self.end()

    def s_class(self, named: bool = True) -> None:
        self.i += 1
        if self.peek()[0] == "id" and self.peek()[1] != "implements":
            self.name()
        elif named:
            raise Invalid("class without a name")
        if self.ts and self.at("<"):
            self.type_params()
        if self.take("extends"):
            self.unary_operand()
            if self.ts and self.at("<"):
                self.type_args()
        if self.ts and self.take("implements"):
            self.type_list()
        self.need("{")
        while not self.take("}"):
            if self.take(";"):
                continue
            self.member()

    def member(self) -> None:
        while self.at("@"):
            self.decorators()
        is_async = star = accessor = False
        while self.peek()[0] == "id" and (self.peek()[1] in ("static", "async", "get", "set", "accessor") or self.ts and self.peek()[1] in _MODIFIERS):
            follow = self.peek(1)
            if follow[1] in ("(", "=", ";", "}", "<", ":", "?", "!") and follow[0] == "p" or follow[2] and self.peek()[1] != "static":
                break
            word = self.peek()[1]
            if word == "static" and follow[1] == "{":
                self.i += 1
                return self.body(False, False)
            is_async = is_async or word == "async"
            accessor = accessor or word in ("get", "set")
            self.i += 1
        star = self.take("*")
        if self.ts and self.at("[") and self.peek(1)[0] == "id" and self.peek(2)[1] == ":":
            self.i += 3
            self.type()
            self.need("]")
            self.need(":")
            self.type()
            return self.end()
        self.property_name()
        if self.ts and (self.take("?") or self.take("!")):
            pass
        if self.at("(") or self.ts and self.at("<"):
            return self.function_rest(is_async, star)
        if star or is_async or accessor:
            raise Invalid("expected a method body")
        if self.ts and self.take(":"):
            self.type()
        if self.take("="):
            self.functions += 1
            self.assign()
            self.functions -= 1
        return self.end()

    def decorators(self) -> None:
        while self.take("@"):
            if self.at("("):
                self.condition()
            else:
                self.unary_operand()

    def s_import(self) -> None:
        self.i += 1
        if self.ts and self.at("type") and (self.peek(1)[0] == "id" and self.peek(1)[1] != "from" or self.peek(1)[1] in ("{", "*")):
            self.i += 1
        if self.peek()[0] == "str":
            self.i += 1
        else:
            if self.peek()[0] == "id":
                self.name()
                if self.ts and self.take("="):
                    self.expression()
                    return self.end()
                if not self.take(","):
                    self.need("from")
                    return self.module()
            if self.take("*"):
                self.need("as")
                self.name()
            else:
                self.specifiers(True)
            self.need("from")
            return self.module()
        self.attributes()
        return self.end()

    def module(self) -> None:
        if self.peek()[0] != "str":
            raise Invalid("expected a module name")
        self.i += 1
        self.attributes()
        self.end()

    def attributes(self) -> None:
        if (self.at("with") or self.at("assert")) and self.peek(1)[1] == "{":
            self.i += 1
            self.object()

    def specifiers(self, importing: bool) -> None:
        self.need("{")
        while not self.take("}"):
            if self.ts and self.at("type") and self.peek(1)[0] in ("id", "kw") and self.peek(1)[1] != "as":
                self.i += 1
            kind, value, _ = self.peek()
            if kind not in ("id", "kw", "str"):
                raise Invalid("expected a name")
            self.i += 1
            if self.take("as"):
                if importing:
                    self.name()
                elif self.peek()[0] == "str":
                    self.i += 1
                else:
                    self.name(True)
            elif importing and kind != "id":
                raise Invalid("expected a name")
            if not self.at("}"):
                self.need(",")

    def s_export(self) -> None:
        self.i += 1
        if self.take("default"):
            if self.at("function"):
                return self.s_function(named=False)
            if self.at("async") and self.peek(1)[1] == "function" and not self.peek(1)[2]:
                self.i += 1
                return self.s_function(True, False)
            if self.at("class"):
                return self.s_class(False)
            if self.ts and self.at("abstract") and self.peek(1)[1] == "class":
                self.i += 1
                return self.s_class(False)
            if self.ts and self.at("interface"):
                return self.statement(True)
            self.assign()
            return self.end()
        if self.take("*"):
            if self.take("as"):
                self.name(True)
            self.need("from")
            return self.module()
        if self.ts and self.at("type") and self.peek(1)[1] in ("{", "*"):
            self.i += 1
        if self.at("{"):
            self.specifiers(False)
            if self.take("from"):
                return self.module()
            return self.end()
        if self.ts and self.take("="):
            self.expression()
            return self.end()
        kind, value, _ = self.peek()
        if value in ("var", "const", "function", "class", "let", "async", "enum", "@") or self.ts and value in ("type", "interface", "abstract", "declare", "namespace", "module"):
            return self.statement()
        raise Invalid("export of nothing")

    # -- expressions -------------------------------------------------------

    def expression(self, allow_in: bool = True) -> None:
        self.assign(allow_in)
        while self.take(","):
            self.assign(allow_in)

    def closing(self) -> int:
        """Index after the bracket that closes the one at hand."""
        depth, j = 0, self.i
        while j < self.n:
            kind, value, _ = self.t[j]
            if kind == "p" or kind in ("th", "tt"):
                if value in ("(", "[", "{") or kind == "th":
                    depth += 1
                elif value in (")", "]", "}") or kind == "tt":
                    depth -= 1
                    if not depth:
                        return j + 1
            j += 1
        return j

    def arrow(self) -> bool:
        """Parse an arrow function if one begins here."""
        kind, value, _ = self.peek()
        k = 0
        is_async = False
        if value == "async" and kind == "id" and not self.peek(1)[2] and (self.peek(1)[0] == "id" or self.peek(1)[1] in ("(", "<")):
            k, is_async = 1, True
            kind, value, _ = self.peek(1)
        if kind == "id" and self.peek(k + 1)[1] == "=>" and not self.peek(k + 1)[2]:
            self.i += k + 1
        elif value == "(" and kind == "p":
            start = self.i
            self.i += k
            j = self.closing()
            follow = self.t[j] if j < self.n else _END
            if follow[1] == "=>" and not follow[2] and follow[0] == "p":
                self.params()
            elif self.ts and follow[1] == ":" and follow[0] == "p":
                try:
                    self.params()
                    self.need(":")
                    self.return_type()
                    if not self.at("=>"):
                        raise Invalid("no arrow")
                except Invalid:
                    self.i = start
                    return False
            else:
                self.i = start
                return False
        elif self.ts and value == "<" and kind == "p":
            start = self.i
            try:
                self.i += k
                self.type_params()
                self.params()
                if self.take(":"):
                    self.return_type()
                if not self.at("=>"):
                    raise Invalid("no arrow")
            except Invalid:
                self.i = start
                return False
        else:
            return False
        self.need("=>")
        if self.at("{"):
            self.body(is_async, False)
        else:
            self.functions += 1
            self.asynchronous.append(is_async)
            self.assign()
            self.asynchronous.pop()
            self.functions -= 1
        return True

    def assign(self, allow_in: bool = True) -> None:
        kind, value, _ = self.peek()
        if (kind == "id" or value in ("(", "<") and kind == "p") and self.arrow():
            return
        if value == "yield" and kind == "id" and self.generator[-1]:
            self.i += 1
            if not self.peek()[2] and self.peek()[1] not in (")", "]", "}", ",", ";", ":"):
                self.take("*")
                self.assign(allow_in)
            return
        start = self.i
        self.conditional(allow_in)
        if self.peek()[0] == "p" and (self.peek()[1] in _ASSIGN or self.at(">") and self.shift() in _ASSIGN):
            if self.shift() in (">>=", ">>>="):
                self.i += len(self.shift()) - 1 - 1
            if not self.assignable(start):
                raise Invalid("assignment to something that cannot be assigned")
            self.i += 1
            self.assign(allow_in)

    def shift(self) -> str:
        """The operator at hand; adjacent > signs are lexed one by one because types close with them."""
        value = self.peek()[1]
        return value

    def assignable(self, start: int) -> bool:
        kind, value, _ = self.t[start]
        last = self.t[self.i - 1]
        if kind == "p" and value in ("[", "{", "("):
            return True
        if self.i - start == 1:
            return kind == "id"
        return last[0] in ("id", "kw") or last[1] in ("]", ")", "!") or last[0] == "p" and last[1] == "}"

    def conditional(self, allow_in: bool) -> None:
        self.binary(0, allow_in)
        if self.take("?"):
            self.assign()
            self.need(":")
            self.assign(allow_in)

    def binary(self, least: int, allow_in: bool) -> None:
        self.unary()
        while True:
            kind, value, nl = self.peek()
            if kind == "p":
                if value == ">" and self.peek(1)[1] in (">", ">=", ">>=") and not self.peek(1)[2]:
                    # >> and >>> come as single signs
                    k = 1
                    while self.peek(k)[1] == ">" and k < 3:
                        k += 1
                    if self.peek(k)[1] in (">=",):
                        return
                    if 9 <= least:
                        return
                    self.i += k
                    self.binary(10, allow_in)
                    continue
            elif kind == "kw":
                if value == "in" and not allow_in or value not in ("in", "instanceof"):
                    return
            elif kind == "id" and self.ts and value in ("as", "satisfies") and not nl:
                self.i += 1
                if not (self.at("const") and self.take("const")):
                    self.type()
                continue
            else:
                return
            power = _BINARY.get(value)
            if power is None or power <= least and not (value == "**" and power == least):
                return
            self.i += 1
            self.binary(power - 1 if value == "**" else power, allow_in)

    def unary(self) -> None:
        kind, value, _ = self.peek()
        if kind == "p" and value in _PREFIX or kind == "kw" and value in ("typeof", "void", "delete"):
            self.i += 1
            return self.unary()
        if value == "await" and kind == "id" and self.peek(1)[0] != "eof" and (self.asynchronous[-1]) and not (self.peek(1)[0] == "p" and self.peek(1)[1] not in ("(", "[", "{", "+", "-", "!", "/")):
            self.i += 1
            return self.unary()
        if self.ts and kind == "p" and value == "<":
            self.i += 1
            self.type()
            self.need(">")
            return self.unary()
        self.unary_operand()
        if self.peek()[1] in ("++", "--") and self.peek()[0] == "p" and not self.peek()[2]:
            self.i += 1
        return None

    def unary_operand(self) -> None:
        kind, value, _ = self.peek()
        if kind == "id":
            if value == "async" and self.peek(1)[1] == "function" and not self.peek(1)[2]:
                self.i += 1
                self.s_function(True, False)
            else:
                self.i += 1
        elif kind in ("num", "str", "tpl", "re"):
            self.i += 1
        elif kind == "th":
            self.template()
        elif kind == "p":
            if value == "(":
                self.i += 1
                self.expression()
                self.need(")")
            elif value == "[":
                self.i += 1
                while not self.take("]"):
                    if self.take(","):
                        continue
                    self.take("...")
                    self.assign()
                    if not self.at("]"):
                        self.need(",")
            elif value == "{":
                self.object()
            elif value == "@":
                self.decorators()
                self.s_class(False)
            else:
                raise Invalid(f"unexpected {value!r}")
        elif kind == "kw":
            if value in _OPERAND_WORDS:
                self.i += 1
            elif value == "function":
                self.s_function(named=False)
            elif value == "class":
                self.s_class(False)
            elif value == "new":
                self.i += 1
                if self.take("."):
                    self.name()
                else:
                    self.unary_operand_plain()
                    if self.ts and self.at("<"):
                        self.try_type_args()
                    if self.at("("):
                        self.arguments()
            elif value == "import":
                self.i += 1
                if self.take("."):
                    self.name()
                else:
                    self.arguments()
            else:
                raise Invalid(f"unexpected {value!r}")
        else:
            raise Invalid("unexpected end" if kind == "eof" else f"unexpected {value!r}")
        self.chain(True)

    def unary_operand_plain(self) -> None:
        """Operand of ``new``: members, but no call."""
        kind, value, _ = self.peek()
        if value == "new" and kind == "kw":
            return self.unary_operand()
        if kind == "id" or kind == "kw" and value in _OPERAND_WORDS:
            self.i += 1
        elif value == "(":
            self.condition()
        elif value in ("class", "function"):
            return self.s_class(False) if value == "class" else self.s_function(named=False)
        else:
            raise Invalid(f"unexpected {value!r}")
        self.chain(False)
        return None

    def chain(self, calls: bool) -> None:
        while True:
            kind, value, nl = self.peek()
            if kind == "tpl":
                self.i += 1
            elif kind == "th":
                self.template()
            elif kind != "p":
                return
            elif value == ".":
                self.i += 1
                self.name(True)
            elif value == "?.":
                self.i += 1
                if self.at("("):
                    self.arguments()
                elif self.take("["):
                    self.expression()
                    self.need("]")
                else:
                    self.name(True)
            elif value == "[":
                self.i += 1
                self.expression()
                self.need("]")
            elif value == "(" and calls:
                self.arguments()
            elif self.ts and value == "!" and not nl:
                self.i += 1
            elif self.ts and value == "<" and calls:
                if not self.try_type_args():
                    return
            else:
                return

    def try_type_args(self) -> bool:
        start = self.i
        try:
            self.type_args()
            if self.at("(") or self.peek()[0] in ("tpl", "th"):
                return True
        except Invalid:
            pass
        self.i = start
        return False

    def arguments(self) -> None:
        self.need("(")
        while not self.take(")"):
            self.take("...")
            self.assign()
            if not self.at(")"):
                self.need(",")

    def template(self) -> None:
        self.i += 1
        while True:
            self.expression()
            kind = self.peek()[0]
            self.i += 1
            if kind == "tt":
                return
            if kind != "tm":
                raise Invalid("template expression does not end")

    def object(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.take("..."):
                self.assign()
            else:
                self.entry()
            if not self.at("}"):
                self.need(",")

    def entry(self) -> None:
        is_async = accessor = False
        while self.peek()[0] == "id" and self.peek()[1] in ("async", "get", "set") and not (self.peek(1)[0] == "p" and self.peek(1)[1] in ("(", ",", ":", "}", "=", "<")):
            is_async = is_async or self.peek()[1] == "async"
            accessor = accessor or self.peek()[1] != "async"
            self.i += 1
        star = self.take("*")
        kind = self.peek()[0]
        self.property_name()
        if self.at("(") or self.ts and self.at("<"):
            return self.function_rest(is_async, star)
        if self.take(":"):
            return self.assign()
        if kind != "id" or star or is_async or accessor:
            raise Invalid("expected a value")
        if self.take("="):
            self.assign()
        return None

    # -- types -------------------------------------------------------------

    def ts_statement(self, value: str, follow: tuple, top: bool) -> bool:
        if follow[2]:
            return False
        if value == "interface" and follow[0] == "id":
            self.i += 2
            if self.at("<"):
                self.type_params()
            if self.take("extends"):
                self.type_list()
            self.type_object()
            return True
        if value == "type" and follow[0] == "id":
            self.i += 2
            if self.at("<"):
                self.type_params()
            self.need("=")
            self.type()
            self.end()
            return True
        if value == "declare" and (follow[0] in ("id", "kw")):
            self.i += 1
            kept = getattr(self, "ambient", False)
            self.ambient = True
            self.statement(top)
            self.ambient = kept
            return True
        if value == "abstract" and follow[1] == "class":
            self.i += 1
            self.s_class()
            return True
        if value in ("namespace", "module") and follow[0] in ("id", "str"):
            self.i += 2
            while self.take("."):
                self.name()
            self.need("{")
            while not self.take("}"):
                if self.i >= self.n:
                    raise Invalid("block stays open")
                self.statement(True)
            return True
        return False

    def s_enum(self) -> None:
        if not self.ts:
            raise Invalid("enum is no word of the language")
        self.ts_enum()

    def ts_enum(self) -> None:
        self.need("enum")
        self.name()
        self.need("{")
        while not self.take("}"):
            self.property_name()
            if self.take("="):
                self.assign()
            if not self.at("}"):
                self.need(",")

    def type_list(self) -> None:
        self.type()
        while self.take(","):
            self.type()

    def type_params(self) -> None:
        self.need("<")
        while not self.take(">"):
            self.take("const")
            self.name()
            if self.take("extends"):
                self.type()
            if self.take("="):
                self.type()
            if not self.at(">"):
                self.need(",")

    def type_args(self) -> None:
        self.need("<")
        self.type_list()
        self.need(">")

    def return_type(self) -> None:
        if self.at("asserts") and self.peek(1)[0] in ("id", "kw") and not self.peek(1)[2]:
            self.i += 1
        if self.peek()[0] in ("id", "kw") and self.peek(1)[1] == "is":
            self.i += 2
        self.type()

    def type(self) -> None:
        self.take("|") or self.take("&")
        self.type_one()
        while self.take("|") or self.take("&"):
            self.type_one()
        if self.at("extends") and not self.peek()[2]:
            self.i += 1
            self.type()
            self.need("?")
            self.type()
            self.need(":")
            self.type()

    def type_one(self) -> None:
        kind, value, _ = self.peek()
        if kind == "id" and value in ("keyof", "unique", "readonly", "infer") and self.peek(1)[0] in ("id", "kw", "p") and self.peek(1)[1] not in (",", ";", ")", ">", "|", "&", "]", "=", "}", ".", "["):
            self.i += 1
            return self.type_one()
        if kind == "id" and value == "abstract" and self.peek(1)[1] == "new":
            self.i += 1
            kind, value, _ = self.peek()
        if kind == "kw" and value == "typeof":
            self.i += 1
            self.name(True)
            while self.take("."):
                self.name(True)
        elif kind == "kw" and value == "new" or value == "<" and kind == "p":
            self.take("new")
            if self.at("<"):
                self.type_params()
            self.params()
            self.need("=>")
            self.return_type()
            return None
        elif kind == "kw" and value == "import":
            self.i += 1
            self.need("(")
            self.type()
            self.need(")")
        elif kind == "id" or kind == "kw" and value in ("void", "null", "this", "true", "false"):
            self.i += 1
            while self.take("."):
                self.name(True)
            if self.at("<") and not self.peek()[2]:
                self.type_args()
        elif kind in ("str", "num", "tpl"):
            self.i += 1
        elif kind == "th":
            self.i += 1
            while True:
                self.type()
                kind = self.peek()[0]
                self.i += 1
                if kind == "tt":
                    break
                if kind != "tm":
                    raise Invalid("template type does not end")
        elif value == "-" and self.peek(1)[0] == "num":
            self.i += 2
        elif value == "(":
            j = self.closing()
            if j < self.n and self.t[j][1] == "=>":
                self.params()
                self.need("=>")
                self.return_type()
                return None
            self.i += 1
            self.type()
            self.need(")")
        elif value == "[":
            self.i += 1
            while not self.take("]"):
                self.take("...")
                if self.peek()[0] == "id" and (self.peek(1)[1] == ":" or self.peek(1)[1] == "?" and self.peek(2)[1] == ":"):
                    self.i += 1
                    self.take("?")
                    self.need(":")
                self.type()
                self.take("?")
                if not self.at("]"):
                    self.need(",")
        elif value == "{":
            self.type_object()
        else:
            raise Invalid(f"expected a type before {value!r}")
        while self.at("[") and not self.peek()[2]:
            self.i += 1
            if not self.take("]"):
                self.type()
                self.need("]")
        return None

    def type_object(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.take("-") or self.take("+"):
                pass
            while self.peek()[0] == "id" and self.peek()[1] in ("readonly", "get", "set") and self.peek(1)[1] not in (":", "?", "(", ";", ",", "}", "<"):
                self.i += 1
            if self.at("[") and self.peek(1)[0] == "id" and self.peek(2)[1] in (":", "in"):
                self.i += 3
                self.type()
                if self.take("as"):
                    self.type()
                self.need("]")
                if self.take("-") or self.take("+"):
                    pass
                self.take("?")
                if self.take(":"):
                    self.type()
            elif self.at("(") or self.at("<") or self.at("new"):
                self.take("new")
                if self.at("<"):
                    self.type_params()
                self.params()
                if self.take(":"):
                    self.return_type()
            else:
                self.property_name()
                self.take("?")
                if self.at("(") or self.at("<"):
                    if self.at("<"):
                        self.type_params()
                    self.params()
                    if self.take(":"):
                        self.return_type()
                elif self.take(":"):
                    self.type()
            if not self.at("}") and not (self.take(";") or self.take(",")) and not self.peek()[2]:
                raise Invalid("members are not separated")


def check(text: str, ts: bool) -> str | None:
    """Why the text is no valid module, or None."""
    try:
        Parser(lex(text), ts).program()
    except Invalid as e:
        return str(e)
    except RecursionError:
        return "nested too deep"
    return None

"""Python rules: values followed through names, containers, helpers and branches of one module.

Every expression has a ``Value``: marks (local input, remote answers, decoded
data, the whole environment), its text where it is known without running, and
what it stands for (a dotted name, a function of the module, an open file, a
socket, a path).  Statements are followed in order; branches are followed apart
and joined; a name bound anew loses what it was, so shadowed calls are no calls
of the module they hide.  Functions of the module are entered with the values
of their arguments, and once more with unknown ones.
"""

from __future__ import annotations

import ast
import re
import warnings
from dataclasses import dataclass, field, replace

from .code_values import AGENT_PATH, AUTOSTART_FILE, CREDENTIAL_PATH, CRON_FILE, HOOK_FILE, IDENTITY_FILE, LAUNCH_FILE, PAYLOAD, PRIORITY_TEXT, SHELLS, STARTUP_FILE, UNIT_FILE, metadata_host, staging_host

# Calls by what they give or do.
INPUTS = {"input", "raw_input", "os.getenv", "os.environ.get", "sys.stdin.read", "sys.stdin.readline", "sys.stdin.readlines", "sys.stdin.buffer.read", "sys.stdin.buffer.readline", "sys.stdin.buffer.readlines"}
CLEANED = {"shlex.quote", "int", "float", "bool", "len", "hash", "id", "isinstance", "pipes.quote"}
VERBS = {"get", "post", "put", "head", "request", "delete", "patch", "options", "stream"}
CLIENTS = {"requests", "httpx"}
DECODERS = {f"base64.{x}" for x in ("b64decode", "standard_b64decode", "urlsafe_b64decode", "b32decode", "b16decode", "b85decode", "a85decode", "decodebytes")} | {f"binascii.{x}" for x in ("a2b_base64", "unhexlify", "a2b_hex", "a2b_qp", "a2b_uu")} | {"bytes.fromhex", "bytearray.fromhex"}
ENCODERS = {f"base64.{x}" for x in ("b64encode", "standard_b64encode", "urlsafe_b64encode", "b32encode", "b16encode", "b85encode", "a85encode", "encodebytes")}
PROCESSES = {f"subprocess.{x}" for x in ("run", "call", "check_call", "check_output", "Popen")}
SHELL_CALLS = {"os.system", "os.popen", "subprocess.getoutput", "subprocess.getstatusoutput"}
EVALUATORS = {"eval", "exec", "builtins.eval", "builtins.exec"}
REPLACING = {f"os.{x}" for x in ("execl", "execlp", "execle", "execv", "execvp", "execve", "execvpe", "posix_spawn", "posix_spawnp")}
UPLOADS = {"upload_file", "upload_fileobj", "put_object", "upload_blob", "upload_from_filename", "upload_from_string", "upload_from_file"}
STATUS = {"status_code", "ok", "elapsed", "is_redirect", "is_permanent_redirect"}
_WRITE_MODE = re.compile(r"^(?:[awx](?:[bt]\+?|\+[bt]?)?|r(?:\+[bt]?|[bt]\+))$")
_READ_MODE = re.compile(r"(?i)^r[bt+]*$")
_STARTUP_FOLDER = re.compile(r"(?i)AppData[/\\]Roaming[/\\]Microsoft[/\\]Windows[/\\]Start Menu[/\\]Programs[/\\]Startup[/\\][^/\\]+\.(?:cmd|bat|exe|lnk|ps1|py|vbs|js|jse|wsf)$")
_WINDOWS_PAYLOAD = re.compile(r"(?is)exec\s*\(\s*base64\.b64decode|(?<![A-Za-z0-9_.-])powershell(?:\.exe)?\b[^\n;&|]*[ \t]-(?:enc(?:odedcommand)?|file)\b[ \t]+\S+|cmd(?:\.exe)?\s+/[ck]")
_RUN_KEY = re.compile(r"(?i)^Software\\Microsoft\\Windows\\CurrentVersion\\Run(?:Once)?$")
_RUN_VALUE = re.compile(r"(?is)(?<![A-Za-z0-9_.-])powershell(?:\.exe)?\b[^\n;&|]*[ \t]-(?:enc(?:odedcommand)?|file)\b|cmd(?:\.exe)?\s+/[ck]|(?:[A-Za-z]:\\|\\\\|%[A-Za-z_]\w*%[/\\])[^\n\"']+\.(?:exe|com|bat|cmd|ps1|vbs|js|py)(?:\s|[\"']|$)")
#: Calls entered at once; a longer chain of helpers is followed with unknown values.
DEPTH = 6


@dataclass(slots=True, unsafe_hash=True)
class Value:
    marks: frozenset = frozenset()
    text: str | None = None
    dotted: str | None = None
    kind: str = ""
    items: tuple = ()
    named: tuple = ()  # of a dict: (key, value)
    joins: int = 0
    node: object = field(default=None, compare=False)

    def __or__(self, other: Value) -> Value:
        if self == other:
            return self
        return Value(self.marks | other.marks, self.text if self.text == other.text else None, self.dotted if self.dotted == other.dotted else None, self.kind if self.kind == other.kind else "", node=self.node if self.node is other.node else None)


UNKNOWN = Value()


def _key(v: Value) -> tuple:
    return v, id(v.node), *map(_key, v.items), *(_key(x) for _, x in v.named)


def _same(a: dict[str, Value], b: dict[str, Value]) -> bool:
    return len(a) == len(b) and all(b.get(k) is v for k, v in a.items())


_SHADOW = Value(kind="object")


class _Module:
    def __init__(self) -> None:
        self.found: set[tuple[str, int]] = set()
        self.scopes: list[dict[str, Value]] = [{}]
        self.globals: list[set[str]] = [set()]
        self.stars: set[str] = set()
        self.depth = 0
        self.active: list[ast.AST] = []
        self.entered: set[int] = set()
        self.queue: list[ast.AST] = []
        self.connected = False
        self.cuts = 0  # calls not followed because they recur
        self.followed: dict[tuple, tuple] = {}
        self.downloads: set[str] = set()
        self.returns: list[Value] = []

    # -- names ---------------------------------------------------------------------------------------

    def lookup(self, name: str) -> Value:
        for scope in reversed(self.scopes):
            if name in scope:
                return scope[name]
        if "subprocess" in self.stars and f"subprocess.{name}" in PROCESSES:
            return Value(dotted=f"subprocess.{name}")
        if "os" in self.stars and f"os.{name}" in SHELL_CALLS:
            return Value(dotted=f"os.{name}")
        return Value(dotted=name)

    def bind(self, target: ast.AST, value: Value) -> None:
        if isinstance(target, ast.Name):
            scope = self.scopes[0] if target.id in self.globals[-1] else self.scopes[-1]
            scope[target.id] = value
        elif isinstance(target, (ast.Tuple, ast.List)):
            for k, t in enumerate(target.elts):
                part = value.items[k] if len(value.items) == len(target.elts) else Value(value.marks)
                self.bind(t.value if isinstance(t, ast.Starred) else t, part)
        elif isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name):
            self.scopes[-1][f"{target.value.id}.{target.attr}"] = value

    # -- statements ----------------------------------------------------------------------------------

    def block(self, body: list[ast.stmt]) -> None:
        for s in body:
            self.statement(s)

    def branches(self, *bodies: list[ast.stmt]) -> None:
        """Each body from the same state; afterwards a name may hold what any of them left."""
        before = [dict(s) for s in self.scopes]
        after: list[list[dict[str, Value]]] = []
        for b in bodies:
            self.scopes = [dict(s) for s in before]
            self.block(b)
            if not (b and isinstance(b[-1], (ast.Return, ast.Raise, ast.Continue, ast.Break))):
                after.append(self.scopes)
        after = after or [before]
        self.scopes = [dict(s) for s in after[0]]
        for other in after[1:]:
            for mine, theirs in zip(self.scopes, other):
                for name in set(mine) | set(theirs):
                    a, b = mine.get(name), theirs.get(name)
                    mine[name] = a | b if a and b else Value((a or b).marks, (a or b).text, (a or b).dotted, (a or b).kind, (a or b).items, node=(a or b).node)

    def statement(self, s: ast.stmt) -> None:
        kind = type(s)
        if kind is ast.Assign:
            v = self.value(s.value)
            for t in s.targets:
                self.bind(t, v)
        elif kind is ast.AnnAssign:
            if s.value is not None:
                self.bind(s.target, self.value(s.value))
        elif kind is ast.AugAssign:
            v = self.value(ast.BinOp(self.load(s.target), s.op, s.value, lineno=s.lineno, col_offset=0))
            self.bind(s.target, v)
        elif kind is ast.Expr:
            self.value(s.value)
        elif kind is ast.Return:
            self.returns.append(self.value(s.value) if s.value else UNKNOWN)
        elif kind in (ast.Import, ast.ImportFrom):
            self.imported(s)
        elif kind in (ast.FunctionDef, ast.AsyncFunctionDef):
            for d in s.decorator_list:
                self.value(d)
            self.bind(ast.Name(s.name), Value(kind="function", node=s))
            self.queue.append(s)
        elif kind is ast.ClassDef:
            self.bind(ast.Name(s.name), _SHADOW)
            for x in s.body:
                if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    self.queue.append(x)
                elif isinstance(x, (ast.Assign, ast.Expr)):
                    self.value(x.value)
        elif kind is ast.Delete:
            for t in s.targets:
                if isinstance(t, ast.Name):
                    for scope in reversed(self.scopes):
                        if scope.pop(t.id, None):
                            break
        elif kind is ast.Global:
            self.globals[-1].update(s.names)
        elif kind is ast.If:
            self.value(s.test)
            fixed = s.test.value if isinstance(s.test, ast.Constant) else None
            if fixed is None:
                self.branches(s.body, s.orelse)
            else:
                self.block(s.body if fixed else s.orelse)
        elif kind in (ast.For, ast.AsyncFor):
            v = self.value(s.iter)
            self.bind(s.target, v.items[0] if v.items else Value(v.marks))
            self.branches([*s.body, *s.body], [])
            self.block(s.orelse)
        elif kind is ast.While:
            self.value(s.test)
            self.branches([*s.body, *s.body], [])
            self.block(s.orelse)
        elif kind in (ast.With, ast.AsyncWith):
            for item in s.items:
                v = self.value(item.context_expr)
                if item.optional_vars is not None:
                    self.bind(item.optional_vars, v)
            self.block(s.body)
        elif isinstance(s, (ast.Try, getattr(ast, "TryStar", ast.Try))):
            self.branches([*s.body, *s.orelse], *[h.body for h in s.handlers])
            self.block(s.finalbody)
        elif kind is ast.Match:
            v = self.value(s.subject)
            for case in s.cases:
                for x in ast.walk(case.pattern):
                    if isinstance(x, ast.MatchAs) and x.name:
                        self.scopes[-1][x.name] = Value(v.marks)
            self.branches(*[c.body for c in s.cases], [])
        else:
            for x in ast.iter_child_nodes(s):
                if isinstance(x, ast.expr):
                    self.value(x)

    @staticmethod
    def load(target: ast.expr) -> ast.expr:
        return ast.Name(target.id, ast.Load(), lineno=target.lineno, col_offset=0) if isinstance(target, ast.Name) else target

    def imported(self, s: ast.Import | ast.ImportFrom) -> None:
        scope = lambda name: self.scopes[0] if name in self.globals[-1] else self.scopes[-1]
        if isinstance(s, ast.Import):
            for a in s.names:
                name = a.asname or a.name.split(".")[0]
                scope(name)[name] = Value(dotted=a.name if a.asname else name)
            return
        for a in s.names:
            if a.name == "*":
                self.stars.add(s.module or "")
                continue
            name = a.asname or a.name
            known = {("pathlib", "Path"): "Path", ("urllib.request", "urlopen"): "urllib.request.urlopen"}.get((s.module, a.name))
            inside = known or f"{'.' * s.level}{s.module or ''}.{a.name}"
            if name in self.globals[-1] and (s.module or "").split(".")[0] not in ("os", "subprocess", "sys", "builtins"):
                continue  # what a declared global held before may still be run
            scope(name)[name] = Value(dotted=inside)

    # -- expressions ---------------------------------------------------------------------------------

    def value(self, e: ast.expr | None) -> Value:
        if e is None:
            return UNKNOWN
        kind = type(e)
        if kind is ast.Constant:
            return Value(text=e.value) if isinstance(e.value, str) else Value(kind=repr(e.value)) if isinstance(e.value, (bool, int)) else UNKNOWN
        if kind is ast.Name:
            return self.lookup(e.id)
        if kind is ast.Attribute:
            return self.attribute(e)
        if kind is ast.Call:
            return self.call(e)
        if kind is ast.Subscript:
            v = self.value(e.value)
            self.value(e.slice)
            if v.named and isinstance(e.slice, ast.Constant):
                return dict(v.named).get(e.slice.value, UNKNOWN)
            if v.items and isinstance(e.slice, ast.Constant) and isinstance(e.slice.value, int) and -len(v.items) <= e.slice.value < len(v.items):
                return v.items[e.slice.value]
            return Value(v.marks - {"environ"} | ({"local"} if v.dotted == "os.environ" else set()))
        if kind is ast.BinOp:
            a, b = self.value(e.left), self.value(e.right)
            marks = a.marks | b.marks
            if isinstance(e.op, ast.Div) and (a.kind == "path" or b.kind == "path"):
                return Value(marks, _joined(a.text, b.text), kind="path", joins=a.joins + 1)
            if isinstance(e.op, ast.Add):
                if a.items or b.items:
                    return Value(marks, items=a.items + b.items)
                return Value(marks, None if a.text is None and b.text is None else (a.text or "{}") + (b.text or "{}"))
            return Value(marks, a.text if isinstance(e.op, ast.Mod) else None)
        if kind is ast.JoinedStr:
            parts = [self.value(x.value if isinstance(x, ast.FormattedValue) else x) for x in e.values]
            return Value(frozenset().union(*(p.marks for p in parts)), "".join("{}" if p.text is None else p.text for p in parts))
        if kind in (ast.List, ast.Tuple, ast.Set):
            items = tuple(self.value(x) for x in e.elts)
            return Value(frozenset().union(*(x.marks for x in items)), items=items, kind="list")
        if kind is ast.Dict:
            pairs = tuple((k.value, self.value(v)) for k, v in zip(e.keys, e.values) if isinstance(k, ast.Constant))
            rest = [self.value(v) for k, v in zip(e.keys, e.values) if not isinstance(k, ast.Constant)]
            return Value(frozenset().union(*(v.marks for _, v in pairs), *(v.marks for v in rest)), named=pairs)
        if kind is ast.IfExp:
            self.value(e.test)
            return self.value(e.body) | self.value(e.orelse)
        if kind is ast.BoolOp:
            out = self.value(e.values[0])
            for x in e.values[1:]:
                out = out | self.value(x)
            return out
        if kind is ast.NamedExpr:
            v = self.value(e.value)
            self.bind(e.target, v)
            return v
        if kind is ast.Lambda:
            return Value(kind="function", node=e)
        if kind in (ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp):
            self.scopes.append({})
            self.globals.append(set())
            for g in e.generators:
                v = self.value(g.iter)
                self.bind(g.target, v.items[0] if v.items else Value(v.marks))
                for c in g.ifs:
                    self.value(c)
            out = self.value(e.value if kind is ast.DictComp else e.elt)
            self.scopes.pop()
            self.globals.pop()
            return Value(out.marks)
        if kind in (ast.Await, ast.Starred, ast.YieldFrom):
            return self.value(e.value)
        if kind in (ast.Compare, ast.UnaryOp):
            for x in ast.iter_child_nodes(e):
                if isinstance(x, ast.expr):
                    self.value(x)
            return UNKNOWN
        out = UNKNOWN
        for x in ast.iter_child_nodes(e):
            if isinstance(x, ast.expr):
                out = Value(out.marks | self.value(x).marks)
        return out

    def attribute(self, e: ast.Attribute, of: Value | None = None) -> Value:
        if isinstance(e.value, ast.Name):
            for scope in reversed(self.scopes):
                if f"{e.value.id}.{e.attr}" in scope:
                    return scope[f"{e.value.id}.{e.attr}"]
        v = self.value(e.value) if of is None else of
        if v.kind == "response" and e.attr in STATUS:
            return UNKNOWN
        dotted = f"{v.dotted}.{e.attr}" if v.dotted else None
        marks = v.marks
        if dotted in ("sys.argv", "sys.stdin"):
            marks = marks | {"local"}
        elif dotted == "os.environ":
            marks = marks | {"environ"}
        return Value(marks, dotted=dotted, kind=v.kind if v.kind in ("path", "response") else "", text=v.text if v.kind == "path" and e.attr == "parent" else None)

    def call(self, e: ast.Call) -> Value:
        method = e.func.attr if isinstance(e.func, ast.Attribute) else ""
        base = self.value(e.func.value) if method else UNKNOWN
        f = self.attribute(e.func, base) if method else self.value(e.func)  # a chain of calls is followed once
        args = [self.value(a) for a in e.args]
        named = {k.arg: self.value(k.value) for k in e.keywords if k.arg}
        for k in e.keywords:
            if k.arg is None:
                named |= dict(self.value(k.value).named)
        every = frozenset().union(*(a.marks for a in args), *(a.marks for a in named.values()))
        name = f.dotted if f.kind != "object" else None
        self.sinks(e, name, method, base, args, named)
        if f.kind == "function" and f.node is not None:
            return self.enter(f.node, args, named)
        if name in CLEANED:
            return UNKNOWN
        if name in INPUTS:
            return Value(frozenset({"local"}))
        if name in ("argparse.ArgumentParser", "optparse.OptionParser"):
            return Value(kind="parser")
        if base.kind == "parser" and method in ("parse_args", "parse_known_args"):
            return Value(frozenset({"local"}))
        if self.network(name, method, base):
            return Value(every | {"remote"}, kind="response")
        if name in DECODERS:
            return Value(every | {"decoded"})
        if name == "socket.socket":
            return Value(kind="socket")
        if name == "socket.create_connection":
            self.connected = True
            return Value(kind="socket")
        if base.kind == "socket":
            self.connected = self.connected or method == "connect"
            return Value(kind="fileno" if method == "fileno" else "")
        if name in ("requests.Session", "requests.session", "httpx.Client", "httpx.AsyncClient", "urllib3.PoolManager"):
            return Value(kind="session")
        if name in ("Path", "pathlib.Path", "PurePath", "pathlib.PurePath"):
            text = args[0].text if args else "."
            for a in args[1:]:
                text = _joined(text, a.text)
            return Value(every, text, kind="path", joins=len(args) - 1 if args else 0)
        if name in ("Path.home", "pathlib.Path.home"):
            return Value(text="~", kind="path")
        if base.kind == "path":
            if method == "joinpath":
                text = base.text
                for a in args:
                    text = _joined(text, a.text)
                return Value(base.marks | every, text, kind="path", joins=base.joins + len(args))
            if method in ("expanduser", "resolve", "absolute"):
                return base
            if method == "open":
                return Value(text=base.text, kind="file:" + (args[0].text or "" if args else "r"), joins=base.joins)
            if method in ("with_name", "with_suffix"):
                return Value(base.marks, kind="path")
        if name in ("os.path.expanduser", "os.path.abspath", "os.path.realpath", "os.path.normpath", "str", "os.fspath") and args:
            return replace(args[0], dotted=None)
        if name == "os.path.join" and args:
            text = args[0].text
            for a in args[1:]:
                text = _joined(text, a.text)
            return Value(every, text, joins=len(args) - 1)
        if name == "os.read" and args and args[0].kind == "0" or name == "open" and args and (args[0].kind == "0" or args[0].text == "/dev/stdin"):
            return Value(frozenset({"local"}))
        if name == "open" and args:
            mode = args[1] if len(args) > 1 else named.get("mode", Value(text="r"))
            return Value(args[0].marks, args[0].text, kind=f"file:{mode.text}", joins=args[0].joins)
        if name in ("winreg.OpenKey", "winreg.OpenKeyEx", "winreg.CreateKey", "winreg.CreateKeyEx") and len(args) > 1:
            return Value(kind="runkey" if args[1].text and _RUN_KEY.match(args[1].text.replace("\\\\", "\\")) else "")
        if name == "dict" and args:
            return args[0]
        if method == "join" and args:
            return Value(base.marks | args[0].marks)
        if method in ("format", "replace", "strip", "lower", "upper", "encode", "decode"):
            return Value(base.marks | every, base.text if method in ("format", "encode", "decode", "strip") else None)
        if method == "read" and base.kind.startswith("file:"):
            return Value(base.marks | ({"downloaded"} if base.text is not None and base.text in self.downloads else frozenset()))
        return Value(base.marks | every, kind=base.kind if base.kind == "response" else "")

    def enter(self, node: ast.AST, args: list[Value], named: dict[str, Value]) -> Value:
        """Follow a function of the module with the values it is given."""
        self.entered.add(id(node))
        every = frozenset().union(*(a.marks for a in args), *(a.marks for a in named.values()))
        if self.depth >= DEPTH:  # as deep in every repetition: the key holds the depth
            return Value(every)
        if any(n is node for n in self.active):
            self.cuts += 1
            return Value(every)
        key = (id(node), self.depth, tuple(map(_key, args)), tuple((k, _key(v)) for k, v in sorted(named.items(), key=lambda x: x[0])))
        state = (self.connected, len(self.downloads), len(self.stars))
        if key in self.followed:
            before, then, out = self.followed[key]
            if then == state and _same(before, self.scopes[0]):
                return out
        before, cuts = dict(self.scopes[0]), self.cuts
        a = node.args
        params = [*a.posonlyargs, *a.args]
        scope: dict[str, Value] = {p.arg: UNKNOWN for p in (*params, *a.kwonlyargs)}
        for p, d in zip(params[len(params) - len(a.defaults) :], a.defaults):
            scope[p.arg] = self.value(d)
        for p, d in zip(a.kwonlyargs, a.kw_defaults):
            if d is not None:
                scope[p.arg] = self.value(d)
        scope.update({p.arg: v for p, v in zip(params, args)})
        scope.update({k: v for k, v in named.items() if k in scope})
        if a.vararg:
            scope[a.vararg.arg] = Value(frozenset().union(*(v.marks for v in args[len(params) :])), items=tuple(args[len(params) :]))
        if a.kwarg:
            scope[a.kwarg.arg] = Value(every)
        kept, returns, scopes = self.returns, [], self.scopes
        self.scopes = [self.scopes[0], scope]
        self.globals.append(set())
        self.returns = returns
        self.depth += 1
        self.active.append(node)
        if isinstance(node, ast.Lambda):
            returns.append(self.value(node.body))
        else:
            self.block(node.body)
        self.active.pop()
        self.depth -= 1
        self.globals.pop()
        top = self.scopes[0]
        self.scopes = [top, *scopes[1:]]
        self.returns = kept
        out = returns[0] if returns else UNKNOWN
        for r in returns[1:]:
            out = out | r
        if cuts == self.cuts and _same(before, top) and state == (self.connected, len(self.downloads), len(self.stars)):
            self.followed[key] = before, state, out  # the same call again finds nothing new
        return out

    def network(self, name: str | None, method: str, base: Value) -> bool:
        if base.kind == "session":
            return method in VERBS
        if name is None:
            return False
        head, _, verb = name.partition(".")
        return head in CLIENTS and verb in VERBS or name in ("urllib.request.urlopen", "urllib.request.urlretrieve") or name == "urlopen" and "urllib.request" in self.stars

    # -- rules ---------------------------------------------------------------------------------------

    def hit(self, rule: str, node: ast.AST) -> None:
        self.found.add((rule, node.lineno))

    def sinks(self, e: ast.Call, name: str | None, method: str, base: Value, args: list[Value], named: dict[str, Value]) -> None:
        first = args[0] if args else UNKNOWN
        run: list[Value] = []
        if name in SHELL_CALLS or name in EVALUATORS:
            run.append(first)
        elif name in PROCESSES:
            command = args[0] if args else named.get("args", UNKNOWN)
            shell = named.get("shell")
            spread = any(k.arg is None for k in e.keywords) and shell is None
            if shell is not None and shell.kind not in ("False", "0") or spread and not self._plain_keywords(e):
                run.append(command)
            if len(command.items) > 2 and _shell_name(command.items[0].text) and command.items[1].text == "-c":
                run.append(command.items[2])
            self._staged(e, command)
            streams = [named.get(k, UNKNOWN).kind for k in ("stdin", "stdout", "stderr")]
            if self.connected and streams == ["fileno"] * 3 and command.items and _shell_name(command.items[0].text):
                self.hit("E39", e)
        elif name in REPLACING:
            words = args[1].items if len(args) > 1 and args[1].items else tuple(args[1:])
            if _shell_name(first.text) and len(words) > 2 and words[1].text == "-c":
                run.append(words[2])
        for v in run:
            if "remote" in v.marks:
                self.hit("E03", e)
            if "local" in v.marks or "environ" in v.marks:
                self.hit("E02" if self.depth and self._parameter(e) else "E01", e)
            if "decoded" in v.marks:
                self.hit("E22", e)
            if "downloaded" in v.marks:
                self.hit("E23", e)
        if name == "runpy.run_path" and first.text in self.downloads and first.text is not None:
            self.hit("E23", e)
        if name == "urllib.request.urlretrieve" and len(args) > 1 and args[1].text:
            self.downloads.add(args[1].text)
        self._hosts(e, name, method, base, args, named)
        self._files(e, name, method, base, args, named)
        if name == "os.dup2" and self.connected and first.kind == "fileno" and len(args) > 1 and args[1].kind in ("0", "1", "2") or name == "pty.spawn" and self.connected:
            self.hit("E39", e)
        if name == "winreg.SetValueEx" and first.kind == "runkey" and args and (text := args[-1].text) and _RUN_VALUE.search(text):
            self.hit("E55", e)
        if name and (name in PROCESSES or name in SHELL_CALLS or name in EVALUATORS or name in REPLACING or re.fullmatch(r"os\.spawn\w+", name)):
            self.hit("E60", e)
        if self.network(name, method, base) or name == "socket.create_connection":
            self.hit("E61", e)

    def _parameter(self, e: ast.Call) -> bool:
        """Whether what is run is a parameter of the helper that runs it."""
        node = self.active[-1] if self.active else None
        names = {a.arg for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs)} if node is not None else set()
        return any(isinstance(x, ast.Name) and x.id in names for a in (*e.args, *(k.value for k in e.keywords)) for x in ast.walk(a))

    def _plain_keywords(self, e: ast.Call) -> bool:
        """Whether all spread keywords are known and none of them asks for a shell."""
        return all((v := self.value(k.value)).named and dict(v.named).get("shell", UNKNOWN).kind in ("", "False", "0") for k in e.keywords if k.arg is None)

    def _staged(self, e: ast.Call, command: Value) -> None:
        words = [i.text for i in command.items]
        if words and words[0] and re.fullmatch(r"(?:.*/)?(?:python3?|sh|bash|zsh|ksh|dash)", words[0]) and any(w in self.downloads for w in words[1:] if w):
            self.hit("E23", e)

    def _hosts(self, e: ast.Call, name: str | None, method: str, base: Value, args: list[Value], named: dict[str, Value]) -> None:
        asks = self.network(name, method, base) or method in ("get", "post", "put", "request", "urlretrieve") and base.kind != "path"
        urls = [v.text for v in (*args[:2], named.get("url", UNKNOWN)) if v.text and "://" in v.text]
        if asks and any(staging_host(u) for u in urls):
            self.hit("E25", e)
        if asks and any(metadata_host(u) for u in urls):
            self.hit("E27", e)
        if method in UPLOADS:
            self.hit("E32", e)
        sent = [v for k, v in named.items() if k in ("data", "json")]
        head = (name or "").partition(".")[0]
        if head in CLIENTS and any("environ" in v.marks for v in sent) or method in ("send", "sendall") and args and "environ" in args[0].marks or name in ENCODERS and args and "environ" in args[0].marks:
            self.hit("E35", e)

    def _files(self, e: ast.Call, name: str | None, method: str, base: Value, args: list[Value], named: dict[str, Value]) -> None:
        first = args[0] if args else UNKNOWN
        path = first.text
        if name == "open":
            mode = (args[1] if len(args) > 1 else named.get("mode", Value(text="r"))).text or ""
            if path and CREDENTIAL_PATH.search(path) and _READ_MODE.match(mode):
                self.hit("E31", e)
        if base.kind == "path" and method in ("read_text", "read_bytes") and base.text and CREDENTIAL_PATH.search(base.text):
            self.hit("E31", e)
        home = path in ("~", "~/") and name == "os.walk"
        if home or base.kind == "path" and base.text == "~" and method in ("glob", "rglob") or name in ("glob.glob", "glob.iglob") and path and re.search(r"(?i)~|\.ssh|\.aws", path):
            self.hit("E33", e)
        listed = path if name in ("open", "os.walk", "os.listdir", "glob.glob", "glob.iglob") else base.text if base.kind == "path" and method in ("glob", "rglob") else None
        if listed and AGENT_PATH.search(listed):
            self.hit("E37", e)
        opened = base.kind.startswith("file:") and method in ("write", "writelines") and _WRITE_MODE.match(base.kind[5:])
        if opened or base.kind == "path" and method in ("write_text", "write_bytes"):
            self._written(e, base, first, bool(opened))

    def _written(self, e: ast.Call, target: Value, content: Value, opened: bool) -> None:
        path, text = target.text, content.text or ""
        if path is None:
            return
        if "remote" in content.marks:
            self.downloads.add(path)
            if STARTUP_FILE.search(path):
                self.hit("E43", e)
        if IDENTITY_FILE.search(path) and PRIORITY_TEXT.search(text):
            self.hit("E41" if e.args and isinstance(e.args[0], ast.Name) else "E40", e)
        payload = bool(PAYLOAD.search(text))
        built = target.joins >= 3 and not opened
        if _STARTUP_FOLDER.search(path) and (payload or _WINDOWS_PAYLOAD.search(text)):
            self.hit("E44" if opened and target.joins >= 3 else "E48" if not target.joins else "E56", e)
        if not payload:
            return
        for rule, pattern, besides in (("E45", STARTUP_FILE, ""), ("E46", UNIT_FILE, "ExecStart="), ("E47", HOOK_FILE, ""), ("E51", LAUNCH_FILE, "<key>Program"), ("E57", CRON_FILE, ""), ("E58", AUTOSTART_FILE, "Exec=")):
            if pattern.search(path) and besides in text:
                self.hit("E48" if built and rule in ("E46", "E58") else rule, e)


def _joined(a: str | None, b: str | None) -> str | None:
    if b is not None and b.startswith("/"):
        return b
    return f"{'{}' if a is None else a.rstrip('/')}/{'{}' if b is None else b}"


def _shell_name(text: str | None) -> bool:
    return bool(text) and re.sub(r"^(?:/usr)?/bin/", "", text.lower()) in SHELLS


# A text without any of these names calls nothing that a rule looks for.
_TRIGGERS = re.compile(r"subprocess|\bos\b|\bexec|\beval\b|requests|httpx|url(?:lib|open)|\bget\(|\bpost\(|\bput\(|\brequest\(|upload|put_object|\bopen\b|\bPath\b|glob|socket|\bpty\b|winreg|runpy|\.send|b64|write|read_|pathlib")


def python_findings(text: str) -> list[tuple[str, int]]:
    """``(rule number, line)`` of a Python text; raises SyntaxError or RecursionError where it cannot be parsed."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    if not _TRIGGERS.search(text):
        return []
    m = _Module()
    m.block(tree.body)
    while m.queue:  # functions that nothing called, with unknown arguments
        f = m.queue.pop(0)
        if id(f) not in m.entered:
            m.enter(f, [], {})
    return sorted(m.found, key=lambda x: (x[1], x[0]))


def static_text(expression: str) -> str | None:
    """Text of a Python expression as far as it is known without running it; unknown parts are shown as braces, None where nothing is known."""
    return _Module().value(ast.parse(expression, mode="eval").body).text

"""Code rules over parsed programs: shell commands, Python syntax trees with value flow, JavaScript calls with value flow.

``shell_findings``, ``python_findings`` and ``script_findings`` give
``(rule, line)`` of one text; ``code_findings`` runs them over a table in one
pass.  A text that cannot be parsed gives no rule hit (the scan reports it as
a gap); null and empty texts give nothing; a rule fires once a line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from . import engine_python, engine_script, shell_tree
from .code_values import AGENT_PATH, AUTOSTART_FILE, CREDENTIAL_PATH, CRON_FILE, FETCHERS, HOOK_FILE, IDENTITY_FILE, INSTALLERS, LAUNCH_FILE, LISTERS, NETWORK, NOT_SOURCES, PAYLOAD, PRIORITY_TEXT, PROGRAMS, READERS, SHELLS, STARTUP_FILE, UNIT_FILE, metadata_host, staging_host
from .shell_tree import Command, name_of, unwrapped


class CodeRule(NamedTuple):
    rule: str
    vector: str
    severity: str


# Number, vector and severity of the code rules.
CODE_RULES = {
    r.split("-")[0]: CodeRule(r, v, s)
    for r, v, s in (
        ("E01-python-local-command-injection", "SXV-008", "critical"), ("E02-python-local-helper-command-injection", "SXV-008", "critical"), ("E03-python-remote-payload-execution", "SXV-018", "critical"),
        ("E04-shell-fetch-pipe-exec", "SXV-009", "high"), ("E05-shell-fetch-pipe-env-exec", "SXV-009", "high"), ("E06-shell-fetch-pipe-env-no-assignment-exec", "SXV-009", "high"),
        ("E07-shell-fetch-pipe-timeout-exec", "SXV-009", "high"), ("E08-shell-fetch-special-stdin-exec", "SXV-009", "high"), ("E09-shell-fetch-alias-pipe-exec", "SXV-009", "high"),
        ("E10-shell-command-substitution-taint", "SXV-009", "high"), ("E11-shell-direct-url-install", "SXV-009", "high"), ("E12-shell-staged-curl-exec", "SXV-010", "high"),
        ("E13-shell-staged-redirection-exec", "SXV-010", "high"), ("E14-shell-fetch-python-inline-exec", "SXV-009", "high"), ("E15-shell-fetch-python-stdin-exec", "SXV-009", "high"),
        ("E16-shell-staged-curl-direct-exec", "SXV-010", "high"), ("E17-shell-staged-curl-relative-direct-exec", "SXV-010", "high"), ("E18-shell-staged-wget-exec", "SXV-010", "high"),
        ("E19-shell-staged-remote-name-exec", "SXV-010", "high"), ("E20-shell-base-decode-pipe-exec", "SXV-019", "high"), ("E21-shell-xxd-decode-pipe-exec", "SXV-019", "high"),
        ("E22-python-decoded-payload-execution", "SXV-019", "high"), ("E23-python-remote-file-execution", "SXV-018", "critical"), ("E24-shell-staging-host", "SXV-020", "high"),
        ("E25-python-staging-host", "SXV-020", "high"), ("E26-shell-cloud-metadata", "SXV-021", "high"), ("E27-python-cloud-metadata", "SXV-021", "high"),
        ("E28-shell-container-escape", "SXV-022", "high"), ("E29-shell-container-root-access", "SXV-022", "high"), ("E30-shell-credential-read", "SXV-023", "high"),
        ("E31-python-credential-read", "SXV-023", "high"), ("E32-python-cloud-upload", "SXV-024", "medium"), ("E33-python-home-enumeration", "SXV-025", "high"),
        ("E34-shell-environment-harvest", "SXV-026", "high"), ("E35-python-environment-harvest", "SXV-026", "high"), ("E36-shell-agent-config-read", "SXV-032", "high"),
        ("E37-python-agent-config-read", "SXV-032", "high"), ("E38-shell-reverse-shell", "SXV-040", "critical"), ("E39-python-reverse-shell", "SXV-040", "critical"),
        ("E40-python-agent-identity-persistence", "SXV-005", "critical"), ("E41-python-agent-identity-persistence-assigned-content", "SXV-005", "critical"), ("E42-shell-agent-identity-persistence", "SXV-005", "critical"),
        ("E43-python-remote-shell-rc-persistence", "SXV-039", "critical"), ("E44-python-windows-startup-write", "SXV-039", "critical"), ("E45-python-shell-startup-persistence", "SXV-039", "critical"),
        ("E46-python-systemd-persistence", "SXV-039", "critical"), ("E47-python-git-hook-persistence", "SXV-039", "critical"), ("E48-python-component-path-persistence", "SXV-039", "critical"),
        ("E49-bash-shell-startup-persistence", "SXV-039", "critical"), ("E50-bash-cron-persistence", "SXV-039", "critical"), ("E51-python-launchd-persistence", "SXV-039", "critical"),
        ("E52-bash-launchd-persistence", "SXV-039", "critical"), ("E53-bash-systemd-persistence", "SXV-039", "critical"), ("E54-bash-git-hook-persistence", "SXV-039", "critical"),
        ("E55-python-windows-run-persistence", "SXV-039", "critical"), ("E56-python-windows-startup-persistence", "SXV-039", "critical"), ("E57-python-cron-persistence", "SXV-039", "critical"),
        ("E58-python-xdg-autostart-persistence", "SXV-039", "critical"), ("E59-bash-xdg-autostart-persistence", "SXV-039", "critical"), ("E60-python-execution-capability", "SXV-033", "medium"),
        ("E61-python-network-capability", "SXV-033", "medium"), ("E62-shell-network-capability", "SXV-033", "medium"), ("E63-shell-execution-capability", "SXV-033", "medium"),
        ("E64-js-remote-payload-execution", "SXV-018", "critical"), ("E65-js-command-injection", "SXV-008", "critical"), ("E66-js-reverse-shell", "SXV-040", "critical"), ("E67-js-credential-read", "SXV-023", "high"),
        ("E68-js-environment-harvest", "SXV-026", "high"), ("E69-js-decoded-payload-execution", "SXV-019", "high"), ("E70-js-cloud-metadata-access", "SXV-021", "high"), ("E71-js-shell-fetch-pipe-exec", "SXV-009", "high"),
        ("E72-js-execution-capability", "SXV-033", "medium"), ("E73-js-network-capability", "SXV-033", "medium"),
    )
}

_URL = re.compile(r"(?i)^(?:https?|ftp)://")
_URL_OR_NAME = re.compile(r"(?i)^(?:(?:https?|ftp)://|\$\{?[A-Za-z_]\w*\}?)")
_TO_OUT = {"-", "/dev/stdout"}
#: Statements after a download within which the file is run, for downloads named by a relative path or by the address.
NEAR_LINES = 8


def _option(args: list[str], short: str, long: str) -> str | None:
    """Value of an option written apart, glued or with an equals sign."""
    for k, a in enumerate(args):
        if a == short or a == long:
            return args[k + 1] if k + 1 < len(args) else ""
        if a.startswith(f"{long}="):
            return a[len(long) + 1 :]
        if short and re.match(rf"-[A-Za-z]*{short[1]}", a) and not a.startswith("--"):
            glued = a[a.index(short[1]) + 1 :]
            return glued or (args[k + 1] if k + 1 < len(args) else "")
    return None


def _remote(argv: list[str]) -> str | None:
    return next((a for a in argv[1:] if _URL_OR_NAME.match(a)), None)


def _fetches(argv: list[str]) -> bool:
    """A fetch of a remote address whose answer goes to standard output."""
    if name_of(argv) not in FETCHERS or not _remote(argv):
        return False
    out = _option(argv, "-o", "--output") if name_of(argv) == "curl" else _option(argv, "-O", "--output-document") if name_of(argv) == "wget" else None
    if name_of(argv) == "curl" and "-O" in argv:
        return False
    return out is None or out in _TO_OUT


def _reads_input(argv: list[str]) -> bool:
    """A shell that takes its program from standard input: options, ``-s`` with operands, ``-`` or /dev/stdin, but no script or ``-c``."""
    rest = argv[1:]
    while rest:
        a = rest.pop(0)
        if a in ("-", "/dev/stdin"):
            return True
        if a == "--" or a == "-s" or re.fullmatch(r"-[A-Za-z]*s[A-Za-z]*", a):
            return True
        if a.startswith("-") or a.startswith("+"):
            if not a.startswith("--") and set(a) & set("cnD") or a in ("-O", "+O") and not rest or a in ("--version", "--help", "--dump-strings"):
                return False
            if a.endswith("o") and not a.startswith("--") and rest:
                rest.pop(0)
            continue
        return False
    return True


def _python_runs_input(argv: list[str]) -> bool:
    """``python -c`` with a body that executes what it reads, by the value flow of the Python rules."""
    body = _option(argv, "-c", "\0")
    try:
        return bool(body) and any(rule in ("E01", "E02") for rule, _ in engine_python.python_findings(body.replace("\\n", "\n")))
    except (SyntaxError, ValueError, RecursionError):
        return False


#: Kinds of files that start programs: rule of the shell lane, the file, and what besides a payload its text must hold.
PERSISTENT = (
    ("E49", STARTUP_FILE, None), ("E50", CRON_FILE, None), ("E52", LAUNCH_FILE, re.compile(r"<key>Program(?:Arguments)?</key>")),
    ("E53", UNIT_FILE, re.compile("ExecStart=")), ("E54", HOOK_FILE, None), ("E59", AUTOSTART_FILE, re.compile("Exec=")),
)


def shell_findings(text: str) -> list[tuple[str, int]]:
    """``(rule number, line)`` of a shell text; raises ShellError where it cannot be read."""
    return sorted(set(_shell(shell_tree.parse(text), text)), key=lambda x: (x[1], x[0]))


def _shell(commands: list[Command], text: str) -> Iterator[tuple[str, int]]:
    commands = sorted(commands, key=lambda c: (c.line, c.statement))
    pipes: dict[int, list[Command]] = {}
    for c in commands:
        pipes.setdefault(c.pipe, []).append(c)
    values: dict[str, str] = {}  # literal values of variables, in order
    remote: set[str] = set()  # variables that hold what was fetched
    staged: list[tuple[str, str, int, int]] = []  # path, rule, statement, line of downloads
    bodies = _heredocs(text)
    for c in commands:
        for name, value, inner in c.assigns:
            if inner and any(_fetches(unwrapped(x.argv)[0]) for x in inner):
                remote.add(name)
            else:
                remote.discard(name)
            values[name] = value
        argv = [values.get(a[1:], a) if k == 0 and re.fullmatch(r"\$\w+", a) else a for k, a in enumerate(c.argv)]
        aliased = bool(c.argv) and argv[0] != c.argv[0]
        run, wrappers = unwrapped(argv)
        name, rest = name_of(run), run[1:]
        if not name:
            continue
        line = c.line
        # -- fetched programs
        before = [x for x in pipes[c.pipe] if x.place < c.place]
        fetched = [b for b in before if _fetches(unwrapped([values.get(a[1:], a) if re.fullmatch(r"\$\w+", a) else a for a in b.argv])[0])]
        if fetched:
            via_name = any(b.argv[0].startswith("$") for b in fetched)
            at = fetched[0].line
            if name in SHELLS and _reads_input(run):
                yield ("E09" if via_name else "E07" if "timeout" in wrappers else _env_rule(argv) if "env" in wrappers else "E08" if any(re.fullmatch(r"-[abfhkmptuvxBCHPo]\w*|-e\w+", a) for a in (rest[: rest.index("-s")] if "-s" in rest else rest)) else "E04"), at
            elif re.fullmatch(r"python[\d.]*", name):
                if _python_runs_input(run):
                    yield "E14", at
                elif not rest or rest == ["-"]:
                    yield "E15", at
        substituted = [x for x in c.inner if _fetches(unwrapped(x.argv)[0])]
        if substituted and (name in ("source", ".") or name in SHELLS and "-c" not in rest) and any(a.startswith("<(") for a in rest):
            yield ("E04" if name in SHELLS else "E08"), line
        command = rest[0] if name == "eval" and rest else _option(run, "-c", "\0") if name in SHELLS else None
        if command is not None and (substituted and ("$(" in command or "`" in command) or any(re.search(rf"\$\{{?{v}\b", command) for v in remote)):
            yield "E10", line
        pair = (name, rest[0]) if rest else (name, "")
        if pair in INSTALLERS or name == "uv" and rest[:2] == ["pip", "install"]:
            if any(_URL.match(a) and (k == 0 or rest[k - 1] not in NOT_SOURCES) for k, a in enumerate(rest)):
                yield "E11", line
        # -- downloads that are run later
        if name in ("curl", "wget") and (url := next((a for a in rest if _URL_OR_NAME.match(a)), None)):
            out = _option(run, "-o", "--output") if name == "curl" else _option(run, "-O", "--output-document")
            if out and out not in _TO_OUT and not out.startswith("-"):
                staged.append((out, name, c.statement, line))
            elif out is None and (target := next((t for op, t in c.redirects if op in (">", "1>", ">>", "1>>", "&>", "&>>", ">|")), None)):
                staged.append((target, "redirect", c.statement, line))
            elif (name == "wget" and out is None) or name == "curl" and ("-O" in rest or "--remote-name" in rest):
                base = re.split(r"[?#]", url)[0].rsplit("/", 1)[-1]
                if base:
                    staged.append((base, "name", c.statement, line))
        target = next((a for a in rest if not a.startswith("-")), None) if name in SHELLS | {"source", "."} else run[0] if "/" in run[0] else None
        for path, how, statement, at in staged if target else ():
            if statement < c.statement and _same(path, target):
                interpreted = name in SHELLS | {"source", "."}
                yield ("E19" if how == "name" else "E13" if how == "redirect" else "E18" if how == "wget" else "E12" if interpreted else "E16" if path.startswith("/") else "E17"), at
        # -- decoders
        for b in before:
            d, _ = unwrapped(b.argv)
            if name in SHELLS and _reads_input(run):
                if name_of(d) in ("base64", "base32") and any(re.fullmatch(r"(?i)-d|--dec(?:o(?:d(?:e)?)?)?|-[a-z]*d", a) for a in d[1:]):
                    yield "E20", b.line
                if name_of(d) == "xxd" and any(re.fullmatch(r"-[a-z]*r[a-z]*|--revert", a) for a in d[1:]):
                    yield "E21", b.line
        # -- hosts, containers, files
        if name in FETCHERS:
            if any(staging_host(a) for a in rest):
                yield "E24", line
            if any(metadata_host(a) for a in rest if not a.startswith("-")):
                yield "E26", line
        if name in ("docker", "podman") and any(a == "--privileged" or a.startswith("--cap-add") for a in rest) or name in ("nsenter", "pkexec") or any("/var/run/docker.sock" in a for a in rest):
            yield "E28", line
        if name in LISTERS and any(re.search(r"/proc/(?:self|\d+)/root(?:/|$)", a) for a in rest):
            yield "E29", line
        if name in READERS and any(CREDENTIAL_PATH.search(a) or "authorized_keys" in a for a in rest):
            yield "E30", line
        if name == "printenv" and not rest or name == "env" and not rest and any(x.place > c.place for x in pipes[c.pipe]):
            yield "E34", line
        if name in LISTERS and any(AGENT_PATH.search(a) for a in rest):
            yield "E36", line
        # -- shells on sockets
        if name in ("nc", "ncat") and any(a in ("-e", "-c", "--exec", "--sh-exec") and k + 1 < len(rest) and name_of([rest[k + 1]]) in SHELLS for k, a in enumerate(rest)):
            yield "E38", line
        if name in SHELLS and "-i" in rest and any(re.match(r"/dev/(?:tcp|udp)/", t) for _, t in c.redirects):
            yield "E38", line
        if name in ("nc", "ncat", "netcat") and any(name_of(unwrapped(b.argv)[0]) in SHELLS and "-i" in b.argv for b in before) and any(name_of(x.argv) == "mkfifo" and x.line <= line for x in commands):
            yield "E38", line
        # -- files that agents or systems load by themselves
        written = [t for op, t in c.redirects if op.lstrip("012") in (">", ">>", ">|")] + ([a for a in rest if not a.startswith("-")] if name == "tee" else [])
        whole = " ".join(" ".join(x.argv) for x in pipes[c.pipe]) + "\n" + bodies.get(c.line, "")
        for t in written:
            t = re.sub(r"^\$\{?(\w+)\}?$", lambda m: values.get(m[1], m[0]), t)
            says = whole if name not in ("echo", "printf") else " ".join(rest)
            if name in ("echo", "printf", "cat", "tee") and IDENTITY_FILE.search(t) and PRIORITY_TEXT.search(says):
                yield "E42", line
            for rule, path, besides in PERSISTENT:
                if path.search(t) and PAYLOAD.search(says) and (besides is None or besides.search(says)):
                    yield rule, line
        if name == "crontab" and "-" in rest:
            said = " ".join(" ".join(x.argv) for x in commands if x.line == line and x is not c)
            if PAYLOAD.search(said) or re.search(r"https?://", said) and re.search(r"\|\s*(?:ba)?sh\b", said):
                yield "E50", line
        # -- capabilities
        base = re.sub(r"[\d.]+$", "", name)
        if base in NETWORK or re.match(r"(?:curl|wget)\$\{?IFS", name):
            yield "E62", line
        if base in PROGRAMS and not aliased:
            yield "E63", line


def _env_rule(argv: list[str]) -> str:
    return "E05" if any(re.match(r"[A-Za-z_]\w*=", a) for a in argv[1:]) else "E06"


def _same(path: str, target: str) -> bool:
    return path == target or target == f"./{path}" or path == f"./{target}"


def _heredocs(text: str) -> dict[int, str]:
    """Text of the here-documents that begin on a line."""
    out: dict[int, str] = {}
    rows = text.split("\n")
    for n, row in enumerate(rows, 1):
        if "<<" in row and (m := re.search(r"<<-?\s*[\"']?([A-Za-z_][\w.-]*)", row)) and "<<<" not in row:
            body = []
            for r in rows[n:]:
                if r.strip("\t") == m[1]:
                    break
                body.append(r)
            out[n] = "\n".join(body)
    return out


LANGUAGES = {"script_shell": "shell", "script_python": "python", "script_javascript": "javascript", "script_typescript": "typescript"}


#: Longest text that is parsed as code, as in the parse bounds of the contract; a longer one is a gap.
MAX_CHARS = 524_288


def findings_of(language: str, text: str) -> list[tuple[str, int]]:
    """``(rule number, line)`` of one text in its language; raises SyntaxError or ValueError where it cannot be parsed."""
    if len(text) > MAX_CHARS:
        raise ValueError("too long")
    if language == "shell":
        return shell_findings(text)
    return engine_python.python_findings(text) if language == "python" else engine_script.script_findings(text)


# Lines of installers everybody knows; a fetch piped to a shell is medium there.
_INSTALLER = re.compile(r"(?i)^\s*(?:sudo\s+)?(?:curl|wget)\s+(?:-\S+\s+)*[\"']?https://(?:sh\.rustup\.rs|get\.docker\.com|install\.python-poetry\.org|astral\.sh/uv/install\.sh|bun\.sh/install|deno\.land/install\.sh|raw\.githubusercontent\.com/(?:nvm-sh/nvm|Homebrew/install)/\S+|get\.sdkman\.io|get\.pnpm\.io/install\.sh)[\"']?\s*\|\s*(?:sudo\s+)?(?:ba)?sh(?:\s+-s\s+--.*)?\s*$")


def graded(number: str, line: str) -> str:
    """Severity of a hit: a fetch piped to a shell is medium on the line of a well-known installer."""
    rule = CODE_RULES[number]
    return "medium" if rule.vector == "SXV-009" and _INSTALLER.match(line) else rule.severity


def code_rows(pkg: str, path: str, language: str, text: str) -> list[tuple]:
    """Rows of findings of one text; one that cannot be parsed gives a gap."""
    try:
        found = findings_of(language, text)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [(pkg, path, "", "analysis-incomplete", "high", f"code engine could not read the {language} text ({type(e).__name__}).", None, None)]
    rows = text.split("\n")
    return [(pkg, path, CODE_RULES[k].vector, CODE_RULES[k].rule, graded(k, rows[n - 1] if n <= len(rows) else ""), CODE_RULES[k].rule, n, None) for k, n in found]


def code_findings(artifacts):
    """Findings of all code rules of the scripts of ``artifacts`` (pkg_id, rel, kind, text): one pass, nothing exchanged but findings."""
    from .inspect import FINDING, _map

    return _map(
        artifacts.where(f"text is not null and kind in {tuple(LANGUAGES)}"),
        ["pkg_id", "rel", "kind", "text"],
        lambda p, r, k, t: code_rows(p, r, LANGUAGES[k], t),
        FINDING,
    ).distinct()

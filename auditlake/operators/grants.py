"""Grants of tools: how broad a granted command is, whether it hides what it runs, and whether it reaches the network.

A pattern is read as a shell text without its ``:*``; every simple command of it
is judged without its wrappers, and the broadest class wins.
"""

from __future__ import annotations

import re

from .shell_tree import Command, ShellError, name_of, parse, unwrapped

# Tools that run commands or reach the network, and commands by what they allow.
EXECUTION_TOOLS, NETWORK_TOOLS = {"bash", "shell", "execute", "sh"}, {"webfetch", "websearch", "fetch"}
INSTALLERS = {
    "pip": {"install", "download", "wheel"}, "pip3": {"install", "download", "wheel"}, "pipx": {"install", "run", "inject", "upgrade"}, "uv": {"pip", "tool", "add", "sync"}, "npm": {"install", "i", "ci", "add", "exec", "update"}, "pnpm": {"install", "add", "dlx"}, "yarn": {"add", "install", "dlx"},
    "gem": {"install"}, "cargo": {"install"}, "go": {"install", "get"}, "brew": {"install", "upgrade"}, "apt": {"install", "upgrade"}, "apt-get": {"install", "upgrade"}, "dnf": {"install"}, "yum": {"install"}, "apk": {"add"}, "conda": {"install"}, "uvx": set(), "bunx": set(),
}
INLINE = {
    **{s: {"-c"} for s in ("bash", "dash", "fish", "ksh", "sh", "zsh", "python", "python3", "py")}, "node": {"-e", "--eval", "-p", "--print"}, "bun": {"-e", "--eval", "-p", "--print"}, "perl": {"-e"}, "ruby": {"-e"}, "php": {"-r"}, "osascript": {"-e"}, "deno": {"eval"}, "cmd": {"/c", "/k"}, "powershell": {"-c", "-command", "-e", "-enc", "-encodedcommand"}, "pwsh": {"-c", "-command", "-e", "-enc", "-encodedcommand"},
}
REMOTE = {"ftp", "nc", "ncat", "socat", "ssh", "telnet", "aria2c", "curl", "http", "httpie", "scp", "sftp", "wget"}
GIT_REMOTE = {"clone", "fetch", "pull", "push", "remote", "submodule"}
CLASSES = ("privilege_escalation", "package_installer", "interpreter_or_downloader")
_GLUED = {"bash", "dash", "fish", "ksh", "sh", "zsh", "python", "python3", "py"}
_VARIABLE = re.compile(r"\$(?:\w+|\{[^}]+\}|\()|`")


def command_name(argv: list[str]) -> str:
    """Name of a command without folder, launcher suffix and version."""
    name = re.sub(r"(?i)\.(?:exe|cmd|bat|com|ps1)$", "", name_of(argv))
    return re.sub(r"(?<=\D)[\d.]+$", "", name) or name


def commands_of(pattern: str) -> list[Command]:
    text = re.sub(r":\*\s*$", "", pattern.strip())
    try:
        return [c for c in parse(text) if c.argv or c.assigns]
    except ShellError:
        words = text.split()
        return [Command(1, 0, 0, 0, words)] if words else []


def inline_payload(argv: list[str]) -> str | None:
    """Code given to an interpreter on its command line, '' where the option is there without it; options end at the first operand."""
    name = command_name(argv)
    flags = INLINE.get(name, set())
    for k, a in enumerate(argv[1:], 1):
        low = a.lower() if name in ("cmd", "powershell", "pwsh") else a
        if a == "--":
            return None
        if low in flags:
            return " ".join(argv[k + 1 :])
        if name in _GLUED and re.match(r"-[A-Za-z]*c", a):
            return a[a.index("c") + 1 :] or " ".join(argv[k + 1 :])
        if not a.startswith(("-", "/")):
            return None
    return None


def _installs(argv: list[str], name: str) -> bool:
    rest = [a for a in argv[1:] if not a.startswith("-")]
    return name in INSTALLERS and (len(argv) == 1 or not INSTALLERS[name] or bool(rest) and rest[0].lower() in INSTALLERS[name])


def command_class(c: Command) -> str | None:
    argv, wrappers = unwrapped(c.argv)
    if not argv:
        return None
    name = command_name(argv)
    if {"sudo", "doas"} & {*wrappers, name} or name == "su":
        return "privilege_escalation"
    if name in ("python", "python3", "py") and len(argv) > 2 and argv[1] == "-m":
        module = argv[2].lower()
        if module == "ensurepip" or module == "pip" and _installs(argv[2:], "pip"):
            return "package_installer"
        return "interpreter_or_downloader" if module == "http.server" else None
    if _installs(argv, name):
        return "package_installer"
    wide = (
        name in ("eval", "npx") or name in REMOTE or name in INLINE and (len(argv) == 1 or inline_payload(argv) is not None) or name == "git" and (len(argv) == 1 or argv[1].lower() in GIT_REMOTE) or len(argv) == 1 and name in ("env", "xargs", "find", "make", "docker", "timeout", "nohup", "command", "exec")
    )
    return "interpreter_or_downloader" if wide else None


def breadth(tool: str, pattern: str | None) -> str | None:
    """Class of a grant that is broader than a command, None for one that is not."""
    low, said = tool.lower(), (pattern or "").strip()
    if low in NETWORK_TOOLS:
        return "unrestricted_network" if pattern is None or said.lower() in ("*", "**", ":*", "domain:*") else None
    if tool == "*":
        return "wildcard_all_commands"
    if low not in EXECUTION_TOOLS:
        return None
    if pattern is None or re.sub(r":\*$", "", said) in ("", "*", "**"):
        return "wildcard_all_commands"
    found = {command_class(c) for c in commands_of(pattern)}
    return next((k for k in CLASSES if k in found), None)


def dynamic(tool: str, pattern: str | None) -> bool:
    """Whether what a granted command runs is told by a substitution or variable: in its head, or in code for eval or an interpreter."""
    if tool.lower() not in EXECUTION_TOOLS or not pattern:
        return False
    for c in commands_of(pattern):
        argv, _ = unwrapped(c.argv)
        if not argv:
            continue
        raw = {w.value: w.raw for w in c.words}
        head = raw.get(argv[0], argv[0])
        if _VARIABLE.search(re.sub(r"'[^']*'", "", head)):
            return True
        payload = " ".join(argv[1:]) if command_name(argv) == "eval" else inline_payload(argv)
        if payload:
            shown = " ".join(raw.get(a, a) for a in argv[1:])
            if _VARIABLE.search(re.sub(r"'[^']*'", "", shown)):
                return True
    return False


def reaches_network(tool: str, pattern: str | None) -> bool:
    if tool == "*" or tool.lower() in NETWORK_TOOLS:
        return True
    if tool.lower() not in EXECUTION_TOOLS:
        return False
    if breadth(tool, pattern) == "wildcard_all_commands":
        return True
    names = {command_name(unwrapped(c.argv)[0]) for c in commands_of(pattern) if c.argv}
    return bool(names & (REMOTE | set(INSTALLERS) | {"node", "npx", "perl", "python", "python3", "ruby", "git", "powershell", "pwsh"}))


def covers(denied: str | None, allowed: str | None) -> bool:
    """Whether a denied pattern covers an allowed one of the same tool: a blanket, the same, or a prefix that ends at a word."""
    d, a = (denied or "").strip(), (allowed or "").strip()
    if d.lower() in ("", "*", "**", ":*") or d == a:
        return True
    if not d.endswith(":*"):
        return False
    prefix, candidate = d[:-2].rstrip(), a[:-2].rstrip() if a.endswith(":*") else a
    return candidate == prefix or candidate.startswith(prefix + " ")

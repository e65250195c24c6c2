"""Hooks and auto-started servers of agent configurations: what their commands run, and whether it is pinned.

A command is read once into its words; the reasons for which it names no file of
the package are a table, tried in the order of the contract.
"""

from __future__ import annotations

import functools
import json
import re
import shlex
import tomllib
from typing import NamedTuple

# Events, interpreters and their options, fetchers, package runners, and where configurations count.
EVENTS = (
    "ConfigChange CwdChanged DirectoryAdded Elicitation ElicitationResult FileChanged InstructionsLoaded MessageDisplay Notification PermissionDenied PermissionRequest PostCompact PostModelSwitch PostToolBatch PostToolUse PostToolUseFailure PreCompact "
    "PreModelSwitch PreToolUse SessionEnd SessionStart Setup Stop StopFailure SubagentStart SubagentStop TaskCompleted TaskCreated TeammateIdle UserPromptExpansion UserPromptSubmit WorktreeCreate WorktreeRemove"
).split()
SHELLS = {"bash", "dash", "sh", "zsh"}
INTERPRETERS = SHELLS | {"node", "perl", "php", "powershell", "pwsh", "python", "python3", "ruby"}
FETCHERS = {"aria2c", "bitsadmin", "curl", "http", "httpie", "invoke-restmethod", "invoke-webrequest", "irm", "iwr", "wget"}
INLINE = {**{s: {"-c"} for s in (*SHELLS, "python", "python3")}, "node": {"-e", "--eval", "-p", "--print"}, "perl": {"-e"}, "ruby": {"-e"}, "php": {"-r"}, "powershell": {"-c", "-command", "-e", "-enc", "-encodedcommand"}, "pwsh": {"-c", "-command", "-e", "-enc", "-encodedcommand"}}
PRELOAD = {"-r", "--require", "--import", "--loader", "--experimental-loader", "--env-file", "--env-file-if-exists"}
VALUED = {"python": {"-W", "-X"}, "python3": {"-W", "-X"}, "bash": {"-o", "-O", "--rcfile", "--init-file"}, "zsh": {"-o"}, "powershell": {"-executionpolicy", "-version", "-windowstyle"}, "pwsh": {"-executionpolicy", "-workingdirectory"}, "ruby": {"-I"}, "perl": {"-I"}}
PLACES = {".mcp.json": {""}, "hooks.json": {""}, "settings.json": {"", ".claude"}, "settings.local.json": {"", ".claude"}, "mcp.json": {"", ".cursor", ".vscode"}, "claude_desktop_config.json": {""}, "config.toml": {".codex"}}
RUNNERS = {"bunx", "npx", "pipx", "pnpx", "uvx"}
RUNNER_WORDS = {"npm": {"exec", "x"}, "bun": {"x"}, "pnpm": {"dlx"}, "yarn": {"dlx"}}
RUNNER_VALUED = {"npx": {"-c", "--cache", "--call", "--prefix", "--registry", "--userconfig"}, "pnpx": {"--registry"}, "pipx": {"-p", "--python", "--index-url", "--pip-args"}, "uvx": {"-p", "--index", "--python", "--python-platform", "--index-url"}}
NAMED_PACKAGE = {"-p", "--package", "--from", "--spec"}
_ROOT = re.compile(r"^\$(?:\{(?:CLAUDE_PROJECT_DIR|CLAUDE_PLUGIN_ROOT|PLUGIN_ROOT|PROJECT_ROOT)\}|(?:CLAUDE_PROJECT_DIR|CLAUDE_PLUGIN_ROOT|PLUGIN_ROOT|PROJECT_ROOT))/")


def base_name(word: str) -> str:
    name = re.sub(r"(?i)\.(?:bat|cmd|com|exe)$", "", re.split(r"[/\\]", word)[-1]).lower()
    return re.sub(r"^python\d+(?:\.\d+)*$", "python3", name)


class Hook:
    """A hook command and what can be known of it without running it; each property is found when it is asked for."""

    def __init__(self, command: str) -> None:
        self.command = command

    @functools.cached_property
    def words(self) -> list[str] | None:
        """Words with signs of punctuation apart, None when a quote does not close."""
        lexer = shlex.shlex(self.command, posix=True, punctuation_chars=True)
        lexer.whitespace_split, lexer.commenters = True, ""
        try:
            return list(lexer)
        except ValueError:
            return None

    @functools.cached_property
    def head(self) -> str:
        return base_name(self.words[0])

    @functools.cached_property
    def _run(self) -> tuple[str, str | None]:
        """How the options of an interpreter end ('inline', 'dynamic', 'file'), and the file."""
        if self.head not in INTERPRETERS:
            return "file", self.words[0]
        power = self.head in ("powershell", "pwsh")
        rest = self.words[1:]
        while rest and rest[0].startswith("-"):
            option = rest.pop(0)
            low = option.lower() if power else option
            if low == "--" or power and low in ("-file", "-f"):
                break
            cluster = self.head in SHELLS | {"python", "python3"} and re.fullmatch(r"-[A-Za-z]+", option)
            if low in INLINE.get(self.head, ()) or cluster and "c" in option:
                return "inline", None
            if self.head in SHELLS and cluster and "s" in option or self.head == "node" and option.split("=")[0] in PRELOAD or self.head.startswith("python") and option == "-m":
                return "dynamic", None
            if low in VALUED.get(self.head, ()) and rest:
                rest.pop(0)
        return "file", rest[0] if rest else None

    @property
    def ending(self) -> str:
        return self._run[0]

    @functools.cached_property
    def path(self) -> str:
        """The file as a path inside the package, with the names of its root taken off."""
        return re.sub(r"^(?:\./)+", "", _ROOT.sub("", (self._run[1] or "").replace("\\", "/")))


#: Reasons for which a hook names no file of its package, in the order in which they are tried.
REASONS = (
    ("empty_command", lambda h: not h.command.strip()),
    ("dynamic_or_compound", lambda h: re.search(r"\n|\$\(|`", h.command)),
    ("malformed_command", lambda h: h.words is None),
    ("empty_command", lambda h: not h.words),
    ("network_fetch", lambda h: h.head in FETCHERS),
    ("dynamic_or_compound", lambda h: any(set(w) <= set("();<>|&") for w in h.words)),
    ("inline_interpreter", lambda h: h.ending == "inline"),
    ("dynamic_or_compound", lambda h: h.ending == "dynamic"),
    ("empty_command", lambda h: not h.path),
    ("external_path", lambda h: re.match(r"[/~$]|[A-Za-z]:", h.path) or ".." in h.path.split("/")),
)


def resolve_hook(command: str | None) -> tuple[str | None, str | None]:
    """``(path, reason)``: the package file a hook command runs, or why it names none."""
    hook = Hook(command or "")
    reason = next((r for r, holds in REASONS if holds(hook)), None)
    return (None, reason) if reason else (hook.path, None)


class Entry(NamedTuple):
    event: str
    kind: str
    command: str | None


def document(rel: str, text: str) -> dict | None:
    """A configuration by its extension, None where it is none."""
    try:
        doc = tomllib.loads(text) if rel.lower().endswith(".toml") else json.loads(text)
    except (ValueError, RecursionError):
        return None
    return doc if isinstance(doc, dict) else None


def counts_here(rel: str) -> bool:
    """Whether a configuration of this name is loaded where it lies."""
    folder, _, name = rel.lower().rpartition("/")
    return folder in PLACES.get(name, ()) or name not in PLACES


def entries(doc: dict) -> tuple[list[Entry], list[str]]:
    """Hooks of a configuration, and what of it is malformed."""
    out: list[Entry] = []
    wrong: list[str] = []
    hooks = doc.get("hooks", {})
    if not isinstance(hooks, dict):
        return out, ["hooks_not_a_mapping"] if hooks else []
    for event, groups in hooks.items():
        if not isinstance(groups, list):
            wrong.append("hook_groups_not_a_list")
            continue
        for group in groups:
            listed = group.get("hooks") if isinstance(group, dict) else None
            if not isinstance(listed, list):
                wrong.append("hook_group_malformed")
                continue
            for h in listed:
                if not isinstance(h, dict) or not isinstance(h.get("type"), str):
                    wrong.append("hook_malformed")
                else:
                    said = h.get("command") if h["type"] == "command" else h.get("prompt")
                    out.append(Entry(event, h["type"], said if isinstance(said, str) else None))
    return out, wrong


def hook_findings(rel: str, text: str) -> list[tuple[str, str, str, str]]:
    """``(vector, rule, severity, message)``: hooks that run nothing of the package, gaps for malformed ones; a file to be looked up is a ``hook-target``."""
    doc = document(rel, text)
    if doc is None or not counts_here(rel):
        return []
    found, wrong = entries(doc)
    out = []
    for e in found:
        if e.kind in ("http", "mcp_tool") or e.kind in ("prompt", "agent") and re.search(r"\$\{?[A-Za-z_]\w*\}?|`[^`]+`", e.command or ""):
            out.append(("SXV-012", "root-hook-autoexec", "medium", f"{e.event}: {e.kind}"))
        elif e.kind == "command":
            path, reason = resolve_hook(e.command)
            out.append(("SXV-012", "root-hook-autoexec", "medium", f"{e.event}: {reason}") if reason else ("", "hook-target", "medium", f"{e.event}: {path}"))
    return out + [("", "analysis-incomplete", "high", f"hook configuration analysis is incomplete ({w}).") for w in sorted(set(wrong))]


def exact_pin(spec: str) -> bool:
    """Whether a package argument names one exact version."""
    return bool(re.search(r"(?:(?<!^)@|===?)v?\d+(?:\.\d+)+(?:[-+.][0-9A-Za-z.+-]*)?$", spec.strip()))


def runner_package(command: str, args: list[str]) -> tuple[str, str] | None:
    """``(runner, package)`` of a server command: a package runner, one of its words, or either inside a shell string."""
    name = base_name(command)
    if name in SHELLS and len(args) > 1 and re.fullmatch(r"-[a-z]*c", args[0]):
        try:
            words = shlex.split(args[1])
        except ValueError:
            return None
        words = words[1:] if words[:1] == ["exec"] else words
        return runner_package(words[0], words[1:]) if words else None
    if name == "cmd" and args and args[0].lower() in ("/c", "/k"):
        return runner_package(args[1], args[2:]) if len(args) > 1 else None
    rest = list(args)
    if name in RUNNER_WORDS:
        while rest and rest[0].startswith("-"):
            rest.pop(0)
        if not rest or rest.pop(0) not in RUNNER_WORDS[name]:
            return None
    elif name not in RUNNERS:
        return None
    if name == "pipx" and rest[:1] == ["run"]:
        rest.pop(0)
    while rest:
        a = rest.pop(0)
        if a == "--":
            continue
        option, _, value = a.partition("=")
        if option in NAMED_PACKAGE and (value or rest) and not (option == "-p" and name in ("pipx", "uvx")):
            return name, value or rest[0]
        if a.startswith("-"):
            if a in RUNNER_VALUED.get(name, ()) and rest:
                rest.pop(0)
            continue
        return name, a
    return None


def servers(doc: dict) -> list[tuple[str, str, str, bool]]:
    """``(server, runner, package, pinned)`` of the servers that a package runner starts."""
    listed = doc.get("mcpServers", doc.get("mcp_servers"))
    out = []
    for name, s in listed.items() if isinstance(listed, dict) else ():
        if isinstance(s, dict) and isinstance(s.get("command"), str):
            args = [a for a in s.get("args", []) if isinstance(a, str)] if isinstance(s.get("args"), list) else []
            if met := runner_package(s["command"], args):
                out.append((name, *met, exact_pin(met[1])))
    return out

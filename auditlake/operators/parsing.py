"""The parser of each kind of file, and what it could not read: one pass, each file by itself."""

from __future__ import annotations

import ast
import json
import tomllib
import warnings

from pyspark.sql import DataFrame

from ..functions import requirements
from . import inspect, markdown, shell_tree
from .inspect import _map

MAX_CODE, MAX_DEPTH, MAX_PIPES = 524_288, 512, 3000
CONFIGS = ("hooks_config", "mcp_config", "plugin_manifest", "app_manifest", "plugin_lock", "agent_config")


def _python(rel: str, text: str) -> list[tuple[str, str | None]]:
    if len(text) > MAX_CODE:
        return [("python_too_large", None)]
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except SyntaxError as e:
        return [("python_syntax_error", f"line {e.lineno}")]
    except (ValueError, RecursionError, MemoryError):
        return [("python_too_complex", None)]
    depth, level = 0, [tree]
    while level:
        depth += 1
        level = [c for n in level for c in ast.iter_child_nodes(n)]
        if depth > MAX_DEPTH:
            return [("python_too_complex", None)]
    return []


def _shell(rel: str, text: str) -> list[tuple[str, str | None]]:
    if len(text.encode("utf-8", "surrogatepass")) > MAX_CODE:
        return [("shell_too_large", None)]
    if text.count("|") - 2 * text.count("||") > MAX_PIPES:
        return [("shell_too_complex", None)]
    try:
        shell_tree.parse(text)
    except shell_tree.ShellError as e:
        return [("shell_parse_error", f"line {e.line}")]
    return []


def _config(rel: str, text: str) -> list[tuple[str, str | None]]:
    try:
        tomllib.loads(text) if rel.lower().endswith(".toml") else json.loads(text)
    except (ValueError, RecursionError) as e:
        return [("config_parse_error", f"line {getattr(e, 'lineno', None)}" if getattr(e, "lineno", None) else None)]
    return []


def _document(rel: str, text: str) -> list[tuple[str, str | None]]:
    _, _, _, codes = markdown.front_matter(text)
    out = [tuple(c.split(":", 1)) if ":" in c else (c, None) for c in codes]
    out += [(code, f"line {n}") for code, _, n in markdown.html_notes(text)] if "<" in text else []
    return out + [("grants_unparsed_shape", g[0]) for g in inspect.front_matter_grants(text) if not g[2]]


def _dependencies(rel: str, text: str) -> list[tuple[str, str | None]]:
    return [("requirement_unparsed" if g.startswith(("line", "unparsed")) else "dep_manifest_unparsed", g) for g in requirements.manifest(rel, text)[1]]


#: Parser of each kind; kinds without one are read as plain text.
PARSERS = {
    "script_python": _python, "script_shell": _shell, "dep_manifest": _dependencies, **dict.fromkeys(CONFIGS, _config), **dict.fromkeys(markdown.KINDS, _document),
}


def diagnostics_of(rel: str, kind: str, text: str) -> list[tuple[str, str | None]]:
    """``(code, detail)`` of what the parser of a kind could not read; a parser that fails gives ``parse_crash``."""
    parser = PARSERS.get(kind)
    if parser is None:
        return []
    try:
        return parser(rel or "", text)
    except Exception as e:
        return [("parse_crash", type(e).__name__)]


def diagnostics(artifacts: DataFrame) -> DataFrame:
    """``artifact_id, kind, code, detail`` of all files (artifact_id, rel, kind, text)."""
    known = artifacts.where(f"text is not null and kind in {tuple(PARSERS)}")
    return _map(known, ["artifact_id", "rel", "kind", "text"], lambda i, r, k, t: [(i, k, *d) for d in diagnostics_of(r, k, t)], "artifact_id long, kind string, code string, detail string")

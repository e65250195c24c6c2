"""Per-file inspections that need a parser: invisible and look-alike characters, bytes, Python calls, shell commands, dependencies, grants."""

from __future__ import annotations

import ast
import json
import re
import shlex
import unicodedata
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import requirements
from .forensics import byte_findings
from .grants import breadth, dynamic
from .hooks import servers
from .lookalike import look_alikes

_TAGS = range(0xE0000, 0xE0080)
_BIDI = set("‪‫‬‭‮⁦⁧⁨⁩")
_ZERO = set("​⁠⁡⁢⁣⁤﻿")
_JOINERS = set("‌‍")
_MARKS = set("‎‏؜")


FINDING = "pkg_id string, path string, vector string, rule string, severity string, message string, line_no int, col_no int"


#: Bytes of input that a check takes out of an Arrow batch at once.
PART_BYTES = 4 << 20


def _map(df: DataFrame, columns: list[str], fn: Callable, schema: str) -> DataFrame:
    """``fn(*values of a row) -> tuples`` over Arrow batches.

    A check (schema ``FINDING``, columns starting with package and path) never
    fails the job: a file it cannot get through gives one high ``check-error`` row.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))
    check = schema == FINDING

    def each(args: tuple) -> list[tuple]:
        try:
            return fn(*args)
        except Exception as e:
            if not check:
                raise
            return [(args[0], args[1], "", "check-error", "high", f"a check failed: {type(e).__name__}", None, None)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # as many rows at once as hold about PART_BYTES, so that neither values nor output of a whole batch are held
            step = max(1, batch.num_rows * PART_BYTES // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                rows = [r for args in zip(*(c.to_pylist() for c in part.columns)) for r in each(args)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return df.select(*columns).mapInArrow(run, schema)


def invisible_class(line: str) -> list[tuple[str, str, int]]:
    """``(rule, severity, column)`` of hidden characters of a line: first place of each class."""
    out: dict[str, tuple[str, str, int]] = {}
    zero = [i for i, c in enumerate(line) if c in _ZERO or c in _JOINERS and not _joins(line, i)]
    for i, c in enumerate(line):
        n = ord(c)
        if n in _TAGS:
            out.setdefault("tag_block", ("tag_block", "critical", i + 1))
        elif c in _BIDI:
            out.setdefault("bidi_override", ("bidi_override", "critical", i + 1))
        elif 0xE0100 <= n <= 0xE01EF or 0xFE00 <= n <= 0xFE0F and not (i and (unicodedata.category(line[i - 1]) in ("So", "Sk", "Sm") or line[i - 1] in "0123456789#*©®‼⁉™ℹ")):
            run = sum(0xFE00 <= ord(x) <= 0xFE0F or 0xE0100 <= ord(x) <= 0xE01EF for x in line)
            out.setdefault("vs", ("variation_selector_smuggling", "critical", i + 1) if run >= 4 else ("variation_selector_isolated", "low", i + 1))
        elif c in _MARKS and 0 < i < len(line) - 1 and line[i - 1].isascii() and line[i - 1].isalnum() and line[i + 1].isascii() and line[i + 1].isalnum():
            out.setdefault("directional_mark_split", ("directional_mark_split", "critical", i + 1))
    if zero and not (zero == [0] and line[0] == "﻿"):
        out["zero"] = ("zero_width_run", "critical", zero[0] + 1) if len(zero) >= 2 else ("zero_width_isolated", "medium", zero[0] + 1)
    return list(out.values())


def _joins(line: str, i: int) -> bool:
    """A joiner that its script or an emoji sequence needs."""
    if not 0 < i < len(line) - 1:
        return False
    a, b = line[i - 1], line[i + 1]
    return any(unicodedata.category(x) == "So" for x in (a, b)) or any(0x600 <= ord(x) <= 0xDFF for x in (a, b))


_HIDDEN = re.compile("[\u061c\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u2069\ufe00-\ufe0f\ufeff\U000e0000-\U000e01ef]")


def character_findings(text: str, document: bool = True) -> list[tuple[str, str, str, str, int, int]]:
    """``(vector, rule, severity, message, line, column)`` of hidden and look-alike characters."""
    out = []
    if _HIDDEN.search(text):
        for n, line in enumerate(text.split("\n"), 1):
            if not line.isascii() and _HIDDEN.search(line):
                out += [("SXV-014", rule, sev, f"hidden characters: {rule}", n, col) for rule, sev, col in invisible_class(line)]
    return out + look_alikes(text, document)


def hidden_characters(df: DataFrame) -> DataFrame:
    """Findings of hidden characters; only lines with characters outside ASCII are looked at."""
    return _characters(df, "SXV-014")


def look_alike_tokens(df: DataFrame) -> DataFrame:
    return _characters(df, "SXV-015")


def _characters(df: DataFrame, vector: str) -> DataFrame:
    return _map(df.where("text is not null and text rlike '[^\\\\x00-\\\\x7F]'"), ["pkg_id", "rel", "text"], lambda pkg, rel, text: [(pkg, rel, *x) for x in character_findings(text) if x[0] == vector], FINDING)


# -- bytes ---


def forensics(df: DataFrame) -> DataFrame:
    def one(pkg: str, rel: str, raw: bytes) -> list[tuple]:
        return [(pkg, rel, f.vector, f.rule, f.severity, f.message, None, None) for f in byte_findings(rel, bytes(raw))]

    return _map(df.where("raw is not null"), ["pkg_id", "rel", "raw"], one, FINDING)


# -- code ---------------------------------------------------------------------------------------------


def python_calls(text: str) -> list[tuple[int, str, int, str]]:
    """``(line, dotted name, number of arguments, first literal argument)`` of every call; imports are resolved to full names."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return []
    names: dict[str, str] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                names[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
        elif isinstance(node, ast.ImportFrom) and node.module and not node.level:
            for a in node.names:
                names[a.asname or a.name] = f"{node.module}.{a.name}"
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            parts: list[str] = []
            at = node.func
            while isinstance(at, ast.Attribute):
                parts.append(at.attr)
                at = at.value
            parts.append(names.get(at.id, at.id) if isinstance(at, ast.Name) else "?")
            first = node.args[0] if node.args else None
            out.append((node.lineno, ".".join(reversed(parts)), len(node.args) + len(node.keywords), first.value if isinstance(first, ast.Constant) and isinstance(first.value, str) else None))
    return sorted(out, key=lambda r: (r[0], r[1]))


def calls(df: DataFrame) -> DataFrame:
    """``pkg_id, rel, line_no, callee, n_args, first_literal`` of the Python files of ``df``."""
    return _map(
        df.where("text is not null and kind = 'script_python'"),
        ["pkg_id", "rel", "text"],
        lambda pkg, rel, text: [(pkg, rel, *c) for c in python_calls(text)],
        "pkg_id string, rel string, line_no int, callee string, n_args int, first_literal string",
    )


_OPERATORS = {"|", "||", "&&", ";", "&", "|&", ";;", "(", ")", "{", "}"}


def shell_commands(text: str) -> list[tuple[int, int, int, list[str]]]:
    """``(line, statement, place in its pipe, words)`` of simple commands; lines that cannot be tokenised give none."""
    out = []
    statement = 0
    for n, line in enumerate(text.split("\n"), 1):
        try:
            lexer = shlex.shlex(line, posix=True, punctuation_chars="();<>|&")
            lexer.whitespace_split = True
            words = list(lexer)
        except ValueError:
            continue
        pipe, now = 0, []
        for w in [*words, ";"]:
            if w in _OPERATORS or set(w) <= set("();|&"):
                if now:
                    out.append((n, statement, pipe, now))
                now = []
                if w in ("|", "|&"):
                    pipe += 1
                else:
                    pipe = 0
                    statement += 1
            else:
                now.append(w)
    return out


def commands(df: DataFrame) -> DataFrame:
    """``pkg_id, rel, line_no, statement, pipe_no, command, argv`` of the shell scripts of ``df``."""
    return _map(
        df.where("text is not null and kind = 'script_shell'"),
        ["pkg_id", "rel", "text"],
        lambda pkg, rel, text: [(pkg, rel, n, s, p, w[0].rsplit("/", 1)[-1], w) for n, s, p, w in shell_commands(text)],
        "pkg_id string, rel string, line_no int, statement int, pipe_no int, command string, argv array<string>",
    )


# -- manifests ----------------------------------------------------------------------------------------

def dependencies(rel: str, text: str) -> list[tuple[str, str, bool]]:
    """``(name, specifier, pinned)`` from requirements files, pyproject.toml and package.json."""
    return [d[:3] for d in requirements.manifest(rel, text)[0]]


def canonical_specifiers(text: str) -> str:
    """Specifiers of a set, each once by its operator and version without trailing zeros, sorted."""
    out = set()
    for part in text.split(","):
        m = re.fullmatch(r"\s*(===|==|~=|!=|<=|>=|<|>)\s*(\S+)\s*", part)
        if m:
            op, version = m.groups()
            if op not in ("~=", "===") and not version.endswith(".*"):
                version = re.sub(r"(?:\.0+)+$", "", version)
            out.add(op + version.lower())
    return ",".join(sorted(out))


def unseen_dependencies(by_line: DataFrame, parsed: DataFrame) -> DataFrame:
    """Dependencies of the parser whose name and source the line scan of the file has not reported, after those of the line scan; ``seen_by`` says which."""
    rest = parsed.alias("a").join(by_line.alias("b"), (F.col("a.pkg_id") == F.col("b.pkg_id")) & (F.col("a.rel") == F.col("b.rel")) & (F.col("a.name") == F.col("b.name")) & F.col("a.source").eqNullSafe(F.col("b.source")), "left_anti")
    return by_line.withColumn("seen_by", F.lit("line")).unionByName(rest.withColumn("seen_by", F.lit("parsed")))


def effective_grants(grants_: DataFrame) -> DataFrame:
    """Grants that no parsed denial of the same tool covers: a blanket denial, an equal pattern, or a prefix pattern."""
    deny = grants_.where("not allowed and parsed").select("pkg_id", "rel", "tool", F.col("pattern").alias("denied"))
    denied, pattern = F.trim(F.coalesce("denied", F.lit(""))), F.trim(F.coalesce("pattern", F.lit("")))
    prefix = F.rtrim(F.expr("substring(trim(denied), 1, length(trim(denied)) - 2)"))
    bare = F.when(pattern.endswith(":*"), F.rtrim(F.expr("substring(trim(pattern), 1, length(trim(pattern)) - 2)"))).otherwise(pattern)
    covers = F.lower(denied).isin("", "*", "**", ":*") | (denied == pattern) | denied.endswith(":*") & ((bare == prefix) | bare.startswith(F.concat(prefix, F.lit(" "))))
    hit = grants_.where("allowed").join(deny, ["pkg_id", "rel", "tool"]).where(covers).select("pkg_id", "rel", "tool", "pattern").distinct()
    a, b = grants_.where("allowed").alias("a"), hit.alias("b")
    return a.join(b, (F.col("a.pkg_id") == F.col("b.pkg_id")) & (F.col("a.rel") == F.col("b.rel")) & (F.col("a.tool") == F.col("b.tool")) & F.col("a.pattern").eqNullSafe(F.col("b.pattern")), "left_anti")


def deps(df: DataFrame) -> DataFrame:
    """``pkg_id, rel, name, specifier, pinned`` of the dependency manifests of ``df``."""
    return _map(
        df.where("text is not null and kind = 'dep_manifest'"),
        ["pkg_id", "rel", "text"],
        lambda pkg, rel, text: [(pkg, rel, *d) for d in dependencies(rel, text)],
        "pkg_id string, rel string, name string, specifier string, pinned boolean",
    )


def split_grants(value: str) -> list[str]:
    """Grants of a front-matter line, split at commas and blanks outside parentheses and quotes."""
    out, now, depth, quote = [], "", 0, ""
    for c in value:
        if quote:
            ended = c == quote
            quote = "" if ended else quote
            if ended and not depth:
                continue
        elif c in "\"'":
            quote = c
            if not depth:
                continue
        elif c in "([":
            depth += c == "("
            if c == "[" and not now:
                continue
        elif c in ")]":
            depth -= c == ")"
            if c == "]":
                continue
        elif not depth and (c == "," or c.isspace()):
            if now:
                out.append(now)
            now = ""
            continue
        now += c
    return [*out, now] if now else out


def grant(raw: str) -> tuple[str, str | None, bool, str | None]:
    """``(tool, pattern, parsed, breadth)`` of one grant."""
    m = re.fullmatch(r"([A-Za-z_*][\w*-]*)(?:\((.*)\))?", raw)
    if not m:
        return raw, None, False, "unparsed"
    wide = breadth(m[1], m[2])
    return m[1], m[2], True, wide or ("variable_substitution" if dynamic(m[1], m[2]) else None)


def front_matter_grants(text: str) -> list[tuple[str, str | None, bool, str | None, bool]]:
    """Grants of ``allowed-tools`` and ``disallowed-tools`` in the front matter; the last value says whether it is allowed."""
    if not text.startswith("---\n"):
        return []
    end = re.search(r"^(?:---|\.\.\.)\s*$", text[4:], re.M)
    head = text[4 : 4 + end.start()] if end else ""
    out = []
    for m in re.finditer(r"^(dis)?allowed-tools:[ \t]*([^\n]*(?:\n[ \t]+[^\n]*)*)", head, re.M):
        value = re.sub(r"^[ \t]*-[ \t]*", "", m[2], flags=re.M)
        out += [(*grant(g), not m[1]) for g in split_grants(value)]
    return out


def grants(df: DataFrame) -> DataFrame:
    """``pkg_id, rel, tool, pattern, parsed, breadth, allowed`` of the manifests of ``df``."""
    return _map(
        df.where("text is not null and kind = 'skill_manifest'"),
        ["pkg_id", "rel", "text"],
        lambda pkg, rel, text: [(pkg, rel, *g) for g in front_matter_grants(text)],
        "pkg_id string, rel string, tool string, pattern string, parsed boolean, breadth string, allowed boolean",
    )


SERVER_KINDS = ("mcp_config", "agent_config", "plugin_manifest")
HOOK_KINDS = ("hooks_config", "agent_config", "plugin_manifest")
def _json(text: str) -> dict:
    try:
        doc = json.loads(text)
    except (ValueError, RecursionError):
        return {}
    return doc if isinstance(doc, dict) else {}


def servers_of(text: str) -> list[tuple[str, str, str, bool]]:
    """``(server, runner, package, pinned)`` of auto-start servers run through a package runner."""
    return servers(_json(text))


def hooks_of(text: str) -> list[tuple[str, str, str | None]]:
    """``(event, type, command)`` of a hook configuration."""
    out = []
    hooks = _json(text).get("hooks")
    for event, entries in hooks.items() if isinstance(hooks, dict) else ():
        for entry in entries if isinstance(entries, list) else ():
            for h in entry["hooks"] if isinstance(entry, dict) and isinstance(entry.get("hooks"), list) else ():
                if isinstance(h, dict):
                    out.append((event, str(h.get("type")), h.get("command") if isinstance(h.get("command"), str) else None))
    return out


def server_packages(df: DataFrame) -> DataFrame:
    return _map(df.where(f"text is not null and kind in {SERVER_KINDS}"), ["pkg_id", "rel", "text"], lambda p, r, t: [(p, r, *x) for x in servers_of(t)], "pkg_id string, rel string, server string, command string, package string, pinned boolean")


def hook_commands(df: DataFrame) -> DataFrame:
    return _map(df.where(f"text is not null and kind in {HOOK_KINDS}"), ["pkg_id", "rel", "text"], lambda p, r, t: [(p, r, *x) for x in hooks_of(t)], "pkg_id string, rel string, event string, hook_type string, command string")

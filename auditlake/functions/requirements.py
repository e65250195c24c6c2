"""Dependency specifications: names, extras, versions, sources and markers of Python and Node manifests, and what of a manifest is no dependency."""

from __future__ import annotations

import json
import re
import tomllib
from typing import NamedTuple

_NAME = r"[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?"
_SPEC = re.compile(r"\s*(===|==|~=|!=|<=|>=|<|>)\s*([A-Za-z0-9.*+!_-]+)\s*")
_HEAD = re.compile(rf"\s*({_NAME})\s*(?:\[\s*([A-Za-z0-9._,\s-]*)\])?\s*")
_MARKER = re.compile(r"(?:python_version|python_full_version|os_name|sys_platform|platform_\w+|implementation_\w+|extra|[\"'][^\"']*[\"']|[<>=!~]=?=?|in|not|and|or|[()\s])+")
NPM_EXACT = re.compile(r"(?:npm:(?:@[\w.-]+/)?[\w.-]+@)?v?=?\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.+-]+)?")
NPM_SOURCE = re.compile(r"(?i)^(?:git\+|git:|git@|https?:|ssh:|file:|link:|github:|gitlab:|bitbucket:|gist:)|^[\w.-]+/[\w.-]+(?:#.*)?$")


class Requirement(NamedTuple):
    name: str
    extras: tuple[str, ...]
    specifiers: tuple[tuple[str, str], ...]
    url: str | None
    marker: str | None

    @property
    def pinned(self) -> bool:
        """One exact version: ``==`` without a wildcard, or ``===``; an address is a pin only of a commit or digest."""
        if self.url is not None:
            return bool(re.search(r"@[0-9a-f]{40}(?:$|#)|#(?:.*&)?sha(?:256|384|512)=[0-9a-f]{64,}", self.url))
        return len(self.specifiers) == 1 and (self.specifiers[0][0] == "===" or self.specifiers[0][0] == "==" and not self.specifiers[0][1].endswith("*"))


def parse(line: str) -> Requirement | None:
    """A requirement by the grammar of its specification, None where the text is none."""
    m = _HEAD.match(line)
    if not m:
        return None
    name, extras = m[1], tuple(sorted(x.strip() for x in (m[2] or "").split(",") if x.strip()))
    rest = line[m.end() :]
    if rest.startswith("@"):
        address, _, marker = rest[1:].strip().partition(" ;")
        if not address or " " in address.strip():
            return None
        return Requirement(name, extras, (), address.strip(), marker.strip() or None)
    body, _, marker = rest.partition(";")
    body = body.strip()
    if body.startswith("(") and body.endswith(")"):
        body = body[1:-1]
    specifiers = []
    for part in body.split(",") if body.strip() else ():
        s = _SPEC.fullmatch(part)
        if not s or s[2].endswith("*") and s[1] not in ("==", "!="):
            return None
        specifiers.append((s[1], s[2]))
    if marker.strip() and not _MARKER.fullmatch(marker.strip()):
        return None
    return Requirement(name, extras, tuple(specifiers), None, marker.strip() or None)


def npm_pinned(spec: str) -> bool:
    return bool(NPM_EXACT.fullmatch(spec.strip()))


def npm_from_source(spec: str) -> bool:
    return bool(NPM_SOURCE.search(spec.strip()))


def requirement_lines(text: str) -> list[tuple[int, str]]:
    """Logical lines of a requirements file with the number of their first physical one: continuations joined, comments gone; a comment line does not continue."""
    out: list[tuple[int, str]] = []
    begin, parts = 0, []
    for n, row in enumerate(text.split("\n"), 1):
        if not parts and row.lstrip().startswith("#"):
            continue
        begin = begin or n
        if row.endswith("\\"):
            parts.append(row[:-1])
            continue
        out.append((begin, re.sub(r"(?:^|\s)#.*$", "", "".join([*parts, row])).strip()))
        begin, parts = 0, []
    if parts:
        out.append((begin, "".join(parts).strip()))
    return [(n, s) for n, s in out if s]


def manifest(rel: str, text: str) -> tuple[list[tuple[str, str, bool, int | None]], list[str]]:
    """``(name, specifier, pinned, line)`` of the dependencies of a manifest in its order, and what of it could not be read as one."""
    base = rel.rsplit("/", 1)[-1].lower()
    if base == "package.json":
        return _package_json(text)
    if base == "pyproject.toml":
        return _pyproject(text)
    found, gaps = [], []
    for n, line in requirement_lines(text):
        body = re.split(r"\s--?[A-Za-z]", line, maxsplit=1)[0].strip()
        if line.startswith("-"):
            if re.match(r"-e\b|--editable\b", line):
                gaps.append(f"line {n}: editable")
            elif re.match(r"-[rc]\b|--(?:requirement|constraint)\b", line):
                gaps.append(f"line {n}: included file")
            continue
        r = parse(body)
        if r:
            found.append((r.name, _shown(r), r.pinned, n))
        else:
            gaps.append(f"line {n}: unparsed")
    return found, gaps


def _shown(r: Requirement) -> str:
    return f"@ {r.url}" if r.url else ",".join(op + v for op, v in r.specifiers)


def _package_json(text: str) -> tuple[list[tuple[str, str, bool, int | None]], list[str]]:
    try:
        doc = json.loads(text)
    except (ValueError, RecursionError):
        return [], ["not json"]
    found, gaps = [], []
    for section in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
        part = doc.get(section) if isinstance(doc, dict) else None
        if part is not None and not isinstance(part, dict):
            gaps.append(f"{section}: not a mapping")
        for k, v in part.items() if isinstance(part, dict) else ():
            if isinstance(v, str):
                found.append((k, v, npm_pinned(v), None))
            else:
                gaps.append(f"{section}.{k}: not a text")
    return found, gaps


def _pyproject(text: str) -> tuple[list[tuple[str, str, bool, int | None]], list[str]]:
    try:
        doc = tomllib.loads(text)
    except (tomllib.TOMLDecodeError, RecursionError):
        return [], ["not toml"]
    gaps: list[str] = []
    table = lambda x: x if isinstance(x, dict) else {}
    project = table(doc.get("project"))
    listed: list[object] = [*_list(project.get("dependencies")), *_list(table(doc.get("build-system")).get("requires"))]
    for group in (*table(project.get("optional-dependencies")).values(), *table(doc.get("dependency-groups")).values()):
        listed += _list(group)
    if {"dependencies", "optional-dependencies"} & {x for x in _list(project.get("dynamic")) if isinstance(x, str)}:
        gaps.append("dynamic dependencies")
    if table(table(doc.get("tool")).get("poetry")).get("dependencies") is not None:
        gaps.append("poetry dependencies")
    found = []
    for x in listed:
        if isinstance(x, dict) and set(x) == {"include-group"}:
            continue
        r = parse(x) if isinstance(x, str) else None
        if r:
            found.append((r.name, _shown(r), r.pinned, None))
        else:
            gaps.append(f"unparsed: {str(x)[:40]}")
    return found, gaps


def _list(x: object) -> list:
    return x if isinstance(x, list) else []

"""Package folders and archives as rows of files.

``spark.read.format("skill_package")`` walks one folder (option ``path``):
sorted, no links followed, caches pruned, every name kept that starts with a
dot; each subfolder of the first level is a partition of the read.
"""

from __future__ import annotations

import io
import os
import re
import stat
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Folders left out, and limits of one read.
EXCLUDED_DIRS = {".git", ".hg", ".svn", ".venv", "venv", ".mypy_cache", ".pytest_cache", ".idea", ".tox", ".ruff_cache"}
BUNDLED_DIRS = {"node_modules", "dist", "build", "vendor", "target"}
MAX_FILE_BYTES = 1 << 20
MAX_MEMBERS = 10_000
MAX_ARCHIVE_BYTES = 100 << 20
MARKERS = (".claude-plugin", ".codex-plugin", "plugin.json", ".mcp.json", "hooks.json")

SCHEMA = "rel string, size long, exception string, raw binary"


def read_bounded(path: str, limit: int = MAX_FILE_BYTES) -> tuple[int | None, str | None, bytes | None]:
    """Size, reason it was not read, bytes.  Links and special files are never opened, and a swap after the check is refused."""
    try:
        before = os.lstat(path)
    except OSError as e:
        return None, f"unreadable:{type(e).__name__}", None
    if stat.S_ISLNK(before.st_mode):
        return None, "symlink", None
    if not stat.S_ISREG(before.st_mode):
        return None, "not_regular_file", None
    if before.st_size > limit:
        return before.st_size, "too_large", None
    try:
        handle = os.open(path, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0))
    except OSError as e:
        return before.st_size, f"unreadable:{type(e).__name__}", None
    with os.fdopen(handle, "rb") as f:
        now = os.fstat(f.fileno())
        if (now.st_dev, now.st_ino) != (before.st_dev, before.st_ino):
            return before.st_size, "file_changed", None
        data = f.read(limit + 1)
    return (len(data), "too_large", None) if len(data) > limit else (len(data), None, data)


def walk(root: str, below: str = "") -> Iterator[tuple[str, int | None, str | None, bytes | None]]:
    """``rel, size, exception, raw`` of everything under a folder, in sorted order; pruned folders give a row that says why."""
    try:
        names = sorted(os.listdir(os.path.join(root, below)))
    except OSError as e:
        yield below, None, f"walk_error:{type(e).__name__}", None
        return
    folded: dict[str, int] = {}
    for n in names:
        folded[n.casefold()] = folded.get(n.casefold(), 0) + 1
    for n in names:
        rel = f"{below}/{n}" if below else n
        path = os.path.join(root, rel)
        if os.path.isdir(path) and not os.path.islink(path):
            if n in EXCLUDED_DIRS or n in BUNDLED_DIRS:
                yield rel, None, "excluded_dir" if n in EXCLUDED_DIRS else "bundled_dir", None
            else:
                yield from walk(root, rel)
        elif folded[n.casefold()] > 1:
            yield rel, None, "portable_path_collision", None
        else:
            yield rel, *read_bounded(path)


MAX_DIRS, MAX_ENTRIES = 20_000, 100_000


def package_roots(root: str, max_dirs: int = MAX_DIRS, max_entries: int = MAX_ENTRIES) -> Iterator[str]:
    """Folders that are packages: they hold a manifest or a marker; nothing below one is looked at.

    Runs on the driver over names only; more folders or entries than the bounds are an error, never a part of the answer.
    """
    todo, dirs, entries = [root], 0, 0
    while todo:
        here = todo.pop()
        names = sorted(os.listdir(here)) if os.path.isdir(here) else []
        dirs, entries = dirs + 1, entries + len(names)
        if dirs > max_dirs or entries > max_entries:
            raise ValueError("too many folders or entries to look for packages in")
        if any(n.lower() == "skill.md" for n in names) or set(names) & set(MARKERS):
            yield here
            continue
        todo += [os.path.join(here, n) for n in reversed(names) if n not in EXCLUDED_DIRS and n not in BUNDLED_DIRS and os.path.isdir(os.path.join(here, n)) and not os.path.islink(os.path.join(here, n))]


def resolve(target: str) -> tuple[str, str]:
    """Kind of a target and its path: a folder, a zip archive, or a single file that is wrapped; addresses and other archives are refused."""
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]+://", target) or target.endswith(".git"):
        raise ValueError("addresses are not fetched")
    p = Path(target)
    if p.is_symlink() or not p.exists():
        raise ValueError("no such folder or file")
    if p.is_dir():
        return "directory", str(p)
    if zipfile.is_zipfile(p):
        return "zip", str(p)
    if re.search(r"(?i)\.(?:tar|tgz|gz|bz2|xz|7z|rar|whl)$", p.name):
        raise ValueError("archives other than zip are refused")
    return "file", str(p)


def archive_members(data: bytes) -> tuple[list[tuple[str, bytes]], str | None]:
    """Members of a zip archive, or the reason it is refused: absolute, drive or climbing names, links, names equal but for case, too many or too large."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return [], "not_an_archive"
    infos = [i for i in z.infolist() if not i.is_dir()]
    if len(infos) > MAX_MEMBERS:
        return [], "too_many_members"
    seen, out, written = set(), [], 0
    for i in infos:
        name = i.filename.replace("\\", "/")
        parts = name.split("/")
        if name.startswith("/") or ".." in parts or len(name) > 1 and name[1] == ":":
            return [], "unsafe_path"
        if stat.S_ISLNK(i.external_attr >> 16):
            return [], "symlink_member"
        if name.casefold() in seen:
            return [], "colliding_names"
        seen.add(name.casefold())
        with z.open(i) as f:
            body = f.read(MAX_ARCHIVE_BYTES - written + 1)
        written += len(body)
        if written > MAX_ARCHIVE_BYTES:
            return [], "too_large"
        out.append((name, body))
    return out, None


class _Part(InputPartition):
    def __init__(self, below: str, only_files: bool) -> None:
        super().__init__(below)
        self.below, self.only_files = below, only_files


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        dirs = [n for n in sorted(os.listdir(self.path)) if os.path.isdir(os.path.join(self.path, n)) and not os.path.islink(os.path.join(self.path, n))]
        return [_Part("", True), *(_Part(n, False) for n in dirs)]

    def read(self, part: _Part) -> Iterator[tuple]:
        if part.only_files:
            for rel, *rest in walk(self.path):
                if "/" not in rel and not os.path.isdir(os.path.join(self.path, rel)):
                    yield rel, *rest
        elif part.below in EXCLUDED_DIRS or part.below in BUNDLED_DIRS:
            yield part.below, None, "excluded_dir" if part.below in EXCLUDED_DIRS else "bundled_dir", None
        else:
            yield from walk(self.path, part.below)


class SkillPackage(DataSource):
    """Files of one package folder."""

    @classmethod
    def name(cls) -> str:
        return "skill_package"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SkillPackage)


def wrapped(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Single texts as packages of one file each, named like a manifest: ``pkg_id, rel, kind, text``."""
    return texts.select(F.col(id_col).cast("string").alias("pkg_id"), F.lit("SKILL.md").alias("rel"), F.lit("skill_manifest").alias("kind"), F.col(text_col).alias("text"))


def wrap_file(path: str) -> dict[str, bytes]:
    """One regular file as a package of one file; anything else is refused."""
    p = Path(path)
    if p.is_symlink() or not p.is_file():
        raise ValueError("only a regular file can be wrapped")
    if p.stat().st_size > MAX_FILE_BYTES:
        raise ValueError("the file is too large")
    return {p.name: p.read_bytes()}

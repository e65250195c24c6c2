"""Words that read as ASCII words but are written with letters of other scripts, or with letters that only look Latin.

A word is judged by what its letters are: all of one foreign script, Latin with
look-alikes of the phonetic blocks, Latin mixed with others, or compatibility
letters.  Ordinary use of a script on the line or around it, notation with a
single Greek letter and phonetic transcriptions between slashes are left alone,
except in the fields of the front matter that an operator trusts.
"""

from __future__ import annotations

import functools
import re
import unicodedata

from .scripts import ASCII_LIKE, script_ranges

# Fields whose text an operator trusts.
GOVERNED = {"name", "description", "allowed-tools", "triggers", "command", "tools"}
_WORD = re.compile(r"[^\s\"'`,;:()\[\]{}<>|=+*/\\!?@#$%^&~]+")
_UNSEEN = re.compile("[­​-‏⁠-⁤﻿‪-‮⁦-⁩︀-️]")
_PARTS = re.compile(r"[^._-]+")
_ASCII_WORD = re.compile(r"[A-Za-z0-9]+")


@functools.cache
def script_of(c: str) -> str:
    cp = ord(c)
    return next((s for lo, hi, s in script_ranges() if lo <= cp <= hi), "OTHER")


@functools.cache
def compatibility(c: str) -> bool:
    """Full-width and mathematical letters."""
    return c.isalpha() and (0xFF21 <= ord(c) <= 0xFF5A or 0x1D400 <= ord(c) <= 0x1D7FF)


def prototype(c: str) -> str | None:
    return ASCII_LIKE.get(c)


def _reads(word: str) -> bool:
    return bool(_ASCII_WORD.fullmatch(word)) and sum(c.isalpha() for c in word) >= 2


def imitated(word: str, line: str, at: int, governed: bool = False, code: bool = False, domain: bool = False, native_near: bool = False) -> str | None:
    """The ASCII word that a word (at a place of its line) imitates, or None."""
    letters = [c for c in word if c.isalpha()]
    if len(letters) < 2:
        return None
    if any(map(compatibility, word)):
        folded = unicodedata.normalize("NFKC", word)
        return folded if _reads(folded) else None
    foreign = [i for i, c in enumerate(word) if c in ASCII_LIKE]
    if not foreign:
        return None
    folded = "".join(ASCII_LIKE.get(c, c) for c in word)
    if not _reads(folded):
        return None
    kinds = {script_of(c) for c in letters}
    if "LATIN" not in kinds:
        return folded if len(kinds) == 1 and not _ordinary(next(iter(kinds)), line, governed, code, domain, native_near) else None
    if kinds == {"LATIN"}:
        between = at > 0 and line[at - 1] == "/" and line[at + len(word) : at + len(word) + 1] == "/"
        spoof = any(0x250 <= ord(word[i]) <= 0x2AF or 0x1D00 <= ord(word[i]) <= 0x1DBF for i in foreign)
        return folded if spoof and any(c.isascii() for c in letters) and (governed or code or domain or not between) else None
    single = len(foreign) == 1 and script_of(word[foreign[0]]) == "GREEK" and foreign[0] in (0, len(word) - 1)
    return None if single and not governed and not domain else folded


def _ordinary(script: str, line: str, governed: bool, code: bool, domain: bool, native_near: bool) -> bool:
    """Whether a word of one foreign script stands among ordinary text of it: native letters on its line, or around a line of that script alone."""
    own = {script_of(c) for c in line if c.isalpha()}
    native = sum(c.isalpha() and script_of(c) == script and c not in ASCII_LIKE for c in line) >= 2 or own == {script} and native_near
    return native and not governed and not domain and (not code or own == {script})


_ANY = re.compile("[" + "".join(ASCII_LIKE) + "Ａ-ｚ\U0001d400-\U0001d7ff]")


def governing_keys(text: str) -> dict[int, str]:
    """Key of the front matter that each of its lines belongs to; comments and blank lines belong to none."""
    from . import markdown

    if not text.startswith("---"):
        return {}
    _, places, end, _ = markdown.front_matter(text)
    lines = text.split("\n")
    order = sorted((n, k.lower()) for k, n in places.items())
    out = {}
    for (n, key), (stop, _) in zip(order, [*order[1:], (end, "")]):
        for k in range(n, stop):
            if lines[k - 1].strip() and not lines[k - 1].lstrip().startswith("#"):
                out[k] = key
    return out


def look_alikes(text: str, document: bool = False) -> list[tuple[str, str, str, str, int, int]]:
    """``(vector, rule, severity, message, line, column)`` of the words that imitate another one."""
    if not _ANY.search(text):
        return []
    lines = text.split("\n")
    keys = governing_keys(text) if document else {}
    out = []
    for n, line in enumerate(lines, 1):
        if line.isascii() or not _ANY.search(line):
            continue
        governed = keys.get(n) in GOVERNED
        near = (x for x in (*lines[max(0, n - 3) : n - 1], *lines[n : n + 2]) if not x.isascii())
        native = any(c.isalpha() and ord(c) > 0x24F and c not in ASCII_LIKE for x in near for c in x)
        for m in _WORD.finditer(line):
            if m.group().isascii() or not _ANY.search(m.group()):
                continue
            token = m.group().strip(".,;:!?…")
            lead = m.group().index(token) if token else 0
            for p in _PARTS.finditer(token):
                word = _UNSEEN.sub("", p.group())
                if word.isascii():
                    continue
                seen = imitated(word, line, m.start() + lead + p.start(), governed, not document, "." in token, native)
                if seen:
                    out.append(("SXV-015", "mixed_script_token", "critical" if governed else "high", f"imitates {seen}", n, m.start() + lead + p.start() + 1))
    return out

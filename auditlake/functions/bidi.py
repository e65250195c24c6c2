"""Order in which a line is shown: the bidirectional algorithm with embeddings, overrides and isolates.

Paragraph level 0.  Levels are resolved by the explicit rules, the weak and
neutral types run by run, and runs are turned round from the highest level
down.  Paired brackets are taken for plain neutral characters.
"""

from __future__ import annotations

import unicodedata

_OPEN = {"LRE", "RLE", "LRO", "RLO"}
_ISOLATE = {"LRI", "RLI", "FSI"}
MAX_DEPTH = 125


def _explicit(types: list[str]) -> tuple[list[int], list[str]]:
    """Levels by the embedding controls, and types after overrides; controls become BN."""
    stack: list[tuple[int, str, bool]] = [(0, "", False)]
    levels, out = [], []
    isolates = 0
    for i, t in enumerate(types):
        level, override, _ = stack[-1]
        if t in _OPEN or t in _ISOLATE:
            right = t in ("RLE", "RLO", "RLI") or t == "FSI" and _first_strong(types, i + 1) == "R"
            new = (level + 1) | 1 if right else (level + 2) & ~1
            levels.append(level)
            out.append((override or "ON") if t in _ISOLATE else "BN")
            if new <= MAX_DEPTH:
                stack.append((new, {"LRO": "L", "RLO": "R"}.get(t, ""), t in _ISOLATE))
                isolates += t in _ISOLATE
        elif t == "PDF":
            levels.append(level)
            out.append("BN")
            if len(stack) > 1 and not stack[-1][2]:
                stack.pop()
        elif t == "PDI":
            if isolates:
                while not stack[-1][2]:
                    stack.pop()
                stack.pop()
                isolates -= 1
            levels.append(stack[-1][0])
            out.append(stack[-1][1] or "ON")
        else:
            levels.append(level)
            out.append(override or t)
    return levels, out


def _first_strong(types: list[str], at: int) -> str:
    depth = 0
    for t in types[at:]:
        if t in _ISOLATE:
            depth += 1
        elif t == "PDI":
            if not depth:
                break
            depth -= 1
        elif not depth and t in ("L", "R", "AL"):
            return "L" if t == "L" else "R"
    return "L"


def _weak(t: list[str], sos: str) -> None:
    strong = last = sos
    for i, x in enumerate(t):  # marks, numbers behind Arabic letters, Arabic letters
        if x == "NSM":
            t[i] = last
        elif x == "EN" and strong == "AL":
            t[i] = "AN"
        if t[i] in ("L", "R", "AL"):
            strong = t[i]
        last = t[i]
    t[:] = ["R" if x == "AL" else x for x in t]
    for i in range(1, len(t) - 1):  # one separator between numbers
        if t[i - 1] == t[i + 1] and (t[i] == "ES" and t[i - 1] == "EN" or t[i] == "CS" and t[i - 1] in ("EN", "AN")):
            t[i] = t[i - 1]
    i = 0
    while i < len(t):  # terminators beside European numbers
        if t[i] == "ET":
            j = i
            while j < len(t) and t[j] == "ET":
                j += 1
            if i and t[i - 1] == "EN" or j < len(t) and t[j] == "EN":
                t[i:j] = ["EN"] * (j - i)
            i = j
        else:
            i += 1
    strong = sos
    for i, x in enumerate(t):
        if x in ("ES", "ET", "CS"):
            t[i] = "ON"
        elif x in ("L", "R"):
            strong = x
        elif x == "EN" and strong == "L":
            t[i] = "L"


def _neutral(t: list[str], level: int, sos: str, eos: str) -> None:
    side = lambda x: "R" if x in ("R", "EN", "AN") else "L"
    i = 0
    while i < len(t):
        if t[i] in ("ON", "WS", "S", "B", "BN"):
            j = i
            while j < len(t) and t[j] in ("ON", "WS", "S", "B", "BN"):
                j += 1
            before = side(t[i - 1]) if i else sos
            after = side(t[j]) if j < len(t) else eos
            t[i:j] = [before if before == after else "R" if level & 1 else "L"] * (j - i)
            i = j
        else:
            i += 1


def visual_order(line: str) -> str:
    """The characters of a line from left to right as they are shown; controls that show nothing are left out."""
    types = [unicodedata.bidirectional(c) or "L" for c in line]
    levels, t = _explicit(types)
    at = [i for i, x in enumerate(t) if x != "BN"]
    begin = 0
    while begin < len(at):
        end = begin
        while end < len(at) and levels[at[end]] == levels[at[begin]]:
            end += 1
        level = levels[at[begin]]
        before = levels[at[begin - 1]] if begin else 0
        after = levels[at[end]] if end < len(at) else 0
        sos, eos = ("R" if max(level, x) & 1 else "L" for x in (before, after))
        run = [t[i] for i in at[begin:end]]
        _weak(run, sos)
        _neutral(run, level, sos, eos)
        for i, x in zip(at[begin:end], run):
            levels[i] += (x == "R") if not level & 1 else (x in ("L", "EN", "AN"))
            if not level & 1 and x in ("EN", "AN"):
                levels[i] += 2
        begin = end
    shown = [(levels[i], line[i]) for i in at if types[i] not in _OPEN | _ISOLATE | {"PDF", "PDI"}]
    order = list(range(len(shown)))
    for level in range(max((x for x, _ in shown), default=0), 0, -1):
        i = 0
        while i < len(order):
            j = i
            while j < len(order) and shown[order[j]][0] >= level:
                j += 1
            order[i:j] = order[i:j][::-1]
            i = max(j, i + 1)
    return "".join(shown[k][1] for k in order)


def misleads(line: str) -> bool:
    """Whether controls make a line show its characters in another order than it would without them."""
    controls = {"LRE", "RLE", "LRO", "RLO", "PDF", "LRI", "RLI", "FSI", "PDI"}
    if not any(unicodedata.bidirectional(c) in controls for c in line):
        return False
    plain = "".join(c for c in line if unicodedata.bidirectional(c) not in controls)
    return visual_order(line) != visual_order(plain)

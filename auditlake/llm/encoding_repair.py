"""Text decoded with the wrong character encoding: find it and restore what the author wrote.

Suspicious lines start a best-first search over steps "encode with one
charset, decode with another" and "unescape references".  States are texts,
kept once by hash; the queue is ordered by a plausibility cost of the
characters (controls, signs inside words, letters of two scripts in a word,
capitals in the middle of a word, rare letters and ideographs), and the
cheapest reachable text wins if it is clearly cheaper than the line itself.
The steps that repaired one line of a file are tried first on its next lines.

A line that costs too little for the search is still read for runs that are
UTF-8 when encoded back and give a common sign (signs and European letters by
cp1252 and latin-1, punctuation and symbols of three bytes by every charset of
``_ENCODE``): one such run is evidence by itself, whatever the line costs.

Bytes that were not decoded at all are read with every candidate charset and
kept when they are text: no control bytes and a low cost a character.

Null text without readable bytes, empty texts and correct texts give nothing.
Files of any length are read whole, long lines in pieces of about ``PIECE`` characters cut at blanks, or else where a run of foreign characters ends.
"""

from __future__ import annotations

import heapq
import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

PIECE = 2000
#: A repaired line must cost at most this share of the line as it stands, and this much less.
SHARE, GAIN = 0.62, 1.6

# Letters that are common in texts of European languages written with Latin letters.
_COMMON = set("àáâãäåæçèéêëìíîïñòóôõöøùúûüýßąćęłńóśźżčďěňřšťůžőűăâîșțşţğıāēīūģķļņœ")
_RUSSIAN = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"
# Signs that stand in correct prose beside words.
_SIGNS = set("–—‘’‚“”„…•·«»‹›§¶©®™°±×÷£€¥¢¡¿№†‡²³¹½¼¾µªº¬¦¤´¨¸¯‰≤≥≠≈∞→←↑↓⇒✓✔✗")
# Letters of other scripts drawn like Latin letters, and characters that show nothing.
_DRAWN_ALIKE = set("аеорсухѕіјһԁԛԝАВЕКМНОРСТУХЅІЈονΑΒΕΖΗΙΚΜΝΟΡΤΥΧօոսցհ\u200b\u200c\u200d\u2060\ufeff\xad\xa0\u2007\u2009\u202f")


def _kind(c: str) -> str:
    n = ord(c)
    if n < 0x80:
        return "a" if c.islower() else "A" if c.isupper() else "d" if c.isdigit() else c if c == "\n" else " " if c.isspace() else "p"
    if n < 0xA0:
        return "0"
    if n == 0xFFFD:
        return "f"
    if c in "’‘":
        return "q"
    if n in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF):
        return "z"
    if c in _SIGNS:
        return "s"
    if c.isspace():
        return "n"
    if 0x2500 <= n < 0x25A0:
        return "b"
    if 0x300 <= n < 0x370:
        return "m"
    if 0x1EA0 <= n < 0x1F00 or c in "ăâđêôơưĂÂĐÊÔƠƯ":
        return "v" if c.islower() else "V"
    if n < 0x250 and c.isalpha():
        if c in "çñ":
            return "j"
        if c.lower() in _COMMON:
            return ("l" if c.islower() else "L") if n < 0x100 else "e" if c.islower() else "E"
        return "r"
    if 0x370 <= n < 0x400 and c.isalpha():
        return "g" if c.islower() else "G"
    if 0x410 <= n <= 0x44F or c in "ёЁіїєґІЇЄҐ":
        return "c" if c.islower() else "C"
    if 0x400 <= n < 0x530:
        return "x"
    if n in (0x3001, 0x3002):
        return "u"
    if 0x3040 <= n < 0x3100:
        return "k"
    if 0x3100 <= n < 0x3130 or 0xFF61 <= n < 0xFFA0:
        return "K"
    if 0x4E00 <= n < 0xA000:
        for codec, top in (("gb2312", 0xD7), ("big5", 0xC6), ("shift_jis", 0x97)):
            try:
                if c.encode(codec)[0] <= top:
                    return "h"
            except UnicodeEncodeError:
                pass
        return "H"
    if 0xAC00 <= n < 0xD7A4:
        return "o"
    if 0xFF00 <= n < 0xFF61 or 0x3000 <= n < 0x3040:
        return "u"
    if c.isalpha():
        return "r"
    return "S"


class _Kinds(dict):
    """Class of a character by code point, found once."""

    def __missing__(self, n: int) -> str:
        k = self[n] = _kind(chr(n))
        return k


_KINDS = _Kinds()
_WEIGHT = {"0": 3.0, "f": 1.6, "l": 0.12, "L": 0.25, "e": 0.12, "E": 0.25, "j": 0.12, "r": 0.6, "v": 0.12, "V": 0.3, "c": 0.06, "C": 0.12, "x": 0.9, "g": 0.25, "G": 0.5, "h": 0.12, "H": 1.0, "k": 0.12, "u": 0.08, "K": 1.2, "o": 0.3, "s": 0.25, "S": 0.8, "b": 0.4, "z": 0.3, "n": 0.1, "m": 0.25, "q": 0.15}
_PAIRS = [
    (re.compile(r"(?<=[aAlLeEjvVcCgGr])[sSb](?=[alejvcgr])"), 1.6),  # a sign inside a word
    (re.compile(r"(?<=[ p])[sSb](?=[ale]{2})"), 0.25),
    (re.compile(r"[lLr](?=[lLr])"), 0.8),  # accented letters side by side
    (re.compile(r"[lLeErvV](?=[sSbnq0])|[sSb0](?=[lLeErvV])"), 0.6),
    (re.compile(r"(?<=[aelv])[LEVGC]|(?<=[cx])C"), 1.2),  # a capital after a small letter
    (re.compile(r"(?<=A)[LEV](?=[aelv])"), 1.2),
    (re.compile(r"[aAlLeEvV](?=[cCgGx])|[cCgGx](?=[aAlLeEvV])"), 0.7),  # two scripts in a word
    (re.compile(r"[aAlLeEvVcCgGx](?=[hHKo])|[hHKo](?=[aAlLeEvVcCgGx])"), 1.3),
    (re.compile(r"(?<=[hHko])[sSbp0](?=[hHko])"), 0.5),
    (re.compile(r"[lLr]{3,}"), 1.0),
    (re.compile(r"(?<=a)f|f(?=a)|ff+"), 1.0),
]
_GATE = re.compile(r"[0fxKHSbr]|[lL]{2}|[aAlLeEjvVcCgGr][sSb][alejvcgr]|[aelv][LEVGC]|[cx]C|A[LEV][aelv]|[aAlLeEvV][cCgGxhHo]|[cCgGxhHo][aAlLeEvV]|[lL][sSnq]|s[lLeE]|[hHk][sSp0][hHk]|[cg][hHo]|[hHo][cg]")
_RARE = {c: k / len(_RUSSIAN) * 0.25 for k, c in enumerate(_RUSSIAN)}
_WORDS = re.compile(r"\S*[^\x00-\x7f]\S*")


def cost(text: str) -> float:
    """How implausible a text is as something written by a person; plain ASCII costs nothing."""
    if text.isascii():
        return 0.0
    total = 0.0
    for w in _WORDS.findall(text):
        k = f" {w.translate(_KINDS)} "
        if ("c" in k or "C" in k or "g" in k or "x" in k or "r" in k) and ("a" in k or "A" in k) and all(x < "\x80" or x in _DRAWN_ALIKE or x < "\u0250" and x.isalpha() for x in w) and any(x in _DRAWN_ALIKE for x in w):
            total += 0.05 * len(w)  # letters of another script drawn like Latin ones are no wrong decoding
            continue
        for c in set(k):
            if c in _WEIGHT:
                total += _WEIGHT[c] * k.count(c)
        for pattern, weight in _PAIRS:
            n = len(pattern.findall(k))
            if n:
                total += weight * n
        if "k" in k:  # beside kana, ideographs are those of Japanese
            total += sum(0.9 for x, y in zip(w, k[1:]) if y == "h" and not _japanese(x))
        if "c" in k or "C" in k:
            total += sum(_RARE.get(x, 0.12) for x in w.lower() if "Ѐ" <= x <= "ӿ")
    return total


def _japanese(c: str) -> bool:
    try:
        return c.encode("shift_jis")[0] <= 0x97
    except UnicodeEncodeError:
        return False


def _bytes_of(codec: str) -> dict[int, int]:
    """Code point -> byte of a single-byte charset; bytes without a character stand for the control of their number."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            out[b] = b
    if codec == "cp1252":
        for b in range(0x80, 0xA0):
            out.setdefault(b, b)
    return out


_ENCODE = {c: _bytes_of(c) for c in ("cp1252", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8_r", "cp866", "iso8859_2", "iso8859_5", "cp1254", "cp1257")}
_SINGLE = ("cp1251", "koi8_r", "iso8859_5", "cp866", "mac_cyrillic", "cp1250", "iso8859_2", "cp850", "cp437", "mac_roman", "mac_latin2", "cp852", "cp1253", "cp1254", "cp1257", "cp1258")
_DOUBLE = ("big5", "gbk", "shift_jis", "euc_jp", "euc_kr")
MOVES = (
    [(e, "utf-8") for e in (*_ENCODE, *_DOUBLE)]
    + [("cp1252", d) for d in (*_SINGLE, *_DOUBLE)]
    + [(e, d) for e in ("cp1251", "koi8_r", "cp866", "iso8859_5") for d in ("cp1251", "koi8_r", "cp866", "iso8859_5") if e != d]
    + [("mac_roman", d) for d in ("cp1252", "cp1251", "gbk", "big5", "shift_jis")]
    + [("cp1250", d) for d in ("iso8859_2", "cp1252", "cp850", "mac_roman")]
    + [("cp437", d) for d in ("cp1252", "cp850", "cp1251")]
    + [("unescape", "")]
)


_WIDE_RUN = re.compile(r"[^\x00-\x7f]{2,}")


def _rewritten(run: str, codec: str) -> str:
    """UTF-8 that was read with a charset of two bytes; the run itself if its bytes are none."""
    try:
        return run.encode(codec).decode()
    except UnicodeError:
        return run


def move(text: str, step: tuple[str, str]) -> str | None:
    """One step, or None when it cannot be taken.  A lost character stays lost; what the charset does not have stays as it is."""
    how, into = step
    if how == "unescape":
        out = html.unescape(text)
        return out if out != text else None
    if how in _DOUBLE:
        new = _WIDE_RUN.sub(lambda m: _rewritten(m.group(), how), text)
        return new if new != text else None
    table = _ENCODE[how]
    lost = "�" in text and into == "utf-8"
    parts, start = [], 0
    taken = False
    for m in re.finditer(r"[^\x00-\x7f]+", text):
        if all(ord(c) in table or c == "�" and into == "utf-8" for c in m.group()):
            taken = True
        else:
            # leave this run, convert what lies before it
            parts += [text[start : m.start()], m.group()]
            start = m.end()
    if not taken:
        return None
    parts.append(text[start:])
    out = []
    for i, p in enumerate(parts):
        if i % 2 or p.isascii():
            out.append(p)
            continue
        data = bytes(ord(c) if c < "\x80" else 0xFF if c == "�" else table[ord(c)] for c in p)
        try:
            read = data.decode(into, "replace" if lost else "strict")
            # one lost byte breaks the sequence it stood in, of three bytes more at most: one sign for it, not one a byte
            if lost and read.count("\ufffd") > 4 * p.count("\ufffd"):
                return None
            out.append(re.sub("\ufffd{2,}", "\ufffd", read) if lost else read)
        except UnicodeDecodeError:
            if into != "utf-8":
                return None
            words = []
            for w in re.split(rb"(\s+)", data):  # some words of the line are right as they are
                try:
                    words.append(w.decode(into))
                except UnicodeDecodeError:
                    words.append(w.decode("latin-1") if w.isascii() else None)
            if None in words:
                pieces = re.split(r"(\s+)", p, flags=re.A)
                if len(pieces) != len(words):
                    return None
                words = [x if x is not None else y for x, y in zip(words, pieces)]
            out.append("".join(words))
    new = "".join(out)
    return new if new != text else None


def repair(text: str, first: tuple = ()) -> tuple[str, tuple]:
    """Cheapest reachable text and the steps to it; ``first`` are steps worth trying before the search.

    A path takes at most one step into a table of one or two bytes a character
    (``_table``) and any number of steps to UTF-8 or of unescaping: those only
    succeed on texts that hold such sequences and make the text shorter, so the
    search ends by itself, when no state is left that was not seen.  Once a repair
    is known, states that look worse than the line itself are not followed any
    more: they are detours for lines that nothing else repairs.
    """
    before = cost(text)
    if first:
        new: str | None = text
        for step in first:
            new = move(new, step) if new is not None else None
        if new is not None and cost(new) <= min(SHARE * before, before - GAIN):
            return new, first
    seen = {hash(text)}
    queue: list = [(before, 0, 0, text, (), before)]
    best, best_cost, best_steps = text, before, ()
    serial = 0
    while queue:
        _, _, _, here, steps, c = heapq.heappop(queue)
        if steps and c >= before and best_cost <= SHARE * before and before - best_cost >= GAIN:
            continue
        if steps and c <= best_cost + 0.2 * len(steps) and c < 0.25 * before and c < 0.25 * sum(x > "\x7f" for x in here):
            break
        turned = any(_table(s) for s in steps)
        for step in MOVES:
            if turned and _table(step):
                continue
            new = move(here, step)
            if new is None or hash(new) in seen:
                continue
            seen.add(hash(new))
            if any(x < " " and x not in "\t\r\n" for x in new):
                continue  # control characters: no text at all
            plain = cost(new)
            k = plain + 0.2 * (len(steps) + 1)
            if steps and steps[-1][1] == "utf-8" != step[1]:
                k += 2  # what came out as UTF-8 seldom needs another table
            if k < best_cost:
                best, best_cost, best_steps = new, k, (*steps, step)
            serial += 1
            # bytes that happen to be UTF-8 are strong evidence, so such a state is looked at early
            heapq.heappush(queue, (k * (0.4 if step[1] == "utf-8" else 1), len(steps) + 1, serial, new, (*steps, step), plain))
    if best_steps and best_cost <= SHARE * before and before - best_cost >= GAIN:
        return best, best_steps
    return text, ()


def _table(step: tuple[str, str]) -> bool:
    return step[1] not in ("utf-8", "")


_LOST = re.compile(r"[^\W\d_]�|�[^\W\d_]|�{2,}")
_REFS = re.compile(r"(?:&(?:[AEIOUaeiou](?:grave|acute|circ|tilde|uml|ring)|Atilde|Acirc|copy|euro|trade);\S{0,3}){2,}")


def suspicious(line: str) -> bool:
    if line.isascii():
        return bool(_REFS.search(line))
    c = cost(line.replace("�", "") if line.count("�") > 2 * sum(x > "\x7f" for x in line.replace("�", "")) else line)
    return c > 1.5 and c > 0.33 * len(re.findall(r"[^\x00-\x7f]", line))


# First code points and last of punctuation and symbols that stand in prose.
_SYMBOLS = ((0x2010, 0x2027), (0x2030, 0x203A), (0x20A0, 0x20BF), (0x2100, 0x23FF), (0x2460, 0x27BF))


def _sequences() -> dict[str, tuple[str, str]]:
    """Garbled form -> charset and sign, for signs whose UTF-8 bytes show that they were read with the charset."""
    out: dict[str, tuple[str, str]] = {}
    for codec, table in _ENCODE.items():
        chars: dict[int, set[str]] = {}
        for n, b in table.items():
            chars.setdefault(b, set()).add(chr(n))
        if codec == "cp1252":
            for b in range(0x80, 0xA0):
                chars[b].add(chr(b))
        signs = [c for a, b in _SYMBOLS for c in range(a, b + 1)]
        if codec == "cp1252":
            signs = [*range(0xA0, 0x180), 0xFEFF, *signs]
        for n in signs:
            forms = [""]
            for b in chr(n).encode():
                forms = [f + c for f in forms for c in sorted(chars.get(b, ()))]
            for f in forms:
                out.setdefault(f, (codec, chr(n)))
    return out


_SIGN_OF = _sequences()
_LEADS = sorted({f[0] for f in _SIGN_OF})
_RUN = re.compile("|".join(f"{re.escape(a)}(?:{'|'.join(f'[{re.escape(chr(0).join(sorted(x))).replace(chr(0), str())}]' + '{' + str(k) + '}' for k, x in ((2, {c for f in _SIGN_OF if f[0] == a and len(f) == 3 for c in f[1:]}), (1, {f[1] for f in _SIGN_OF if f[0] == a and len(f) == 2})) if x)})" for a in _LEADS))


def _by_itself(line: str, m: re.Match) -> bool:
    """Whether a run of two characters is no letter of the text followed by a sign, as in names in capitals or a quoted letter."""
    if len(m.group()) > 2:
        return True
    before, after = line[m.start() - 1 : m.start()], line[m.end() : m.end() + 1]
    blank = m.group()[1] == "\xa0"
    if before.isupper() and (blank or not after.isalpha()):
        return False
    return m.group()[0] in "ÂÃ" or before.islower() or after.islower() and not blank


def restore_runs(line: str) -> tuple[str, tuple]:
    """A line with its runs of garbled UTF-8 restored, wherever they stand, and the step to it; the rest stays as it is."""
    used: tuple = ()

    def one(m: re.Match) -> str:
        nonlocal used
        got = _SIGN_OF.get(m.group())
        if got is None or not _by_itself(line, m):
            return m.group()
        used = used or ((got[0], "utf-8"),)
        return got[1]

    while (new := _RUN.sub(one, line)) != line:  # each round makes the line shorter
        line = new
    return line, used


def repair_text(text: str) -> tuple[str, int, str]:
    """Restored text, number of garbled lines, and the steps most used ('lost' if characters are gone for good)."""
    if text.isascii() and "&" not in text:
        return text, 0, ""
    kinds = text.translate(_KINDS)
    refs = "&" in text and _REFS.search(text)
    run = _RUN.search(text)
    if not refs and not run and not _GATE.search(kinds):
        return text, 0, ""
    out, bad, used = [], 0, {}
    first: tuple = ()
    for line, k in zip(text.split("\n"), kinds.split("\n")):
        if not _GATE.search(k) and not (refs and _REFS.search(line)) and not (run and _RUN.search(line)):
            out.append(line)
            continue
        gone = bool(_LOST.search(line))
        new = []
        hit = gone
        for piece in re.findall(rf"[\s\S]{{1,{PIECE}}}(?:\s|\Z)|[\s\S]{{1,{PIECE}}}[^\x00-\x7f]*", line) if len(line) > PIECE else [line]:
            fixed, steps = repair(piece, first) if suspicious(piece) else (piece, ())
            if steps:
                first = steps
            elif run:
                fixed, steps = restore_runs(piece)
            if steps:
                hit = True
                used[steps] = used.get(steps, 0) + 1
            new.append(fixed)
        bad += hit
        out.append("".join(new))
    if not bad:
        return text, 0, ""
    best = max(used, key=used.get) if used else ()
    return "\n".join(out), bad, " > ".join("/".join(x for x in s if x) for s in best) or "lost"


RAW_CODECS = ("utf-8", "cp1252", *_SINGLE, *_DOUBLE)


def read_bytes(raw: bytes | None) -> tuple[str, str] | None:
    """Text and charset of undecoded bytes, or None when they are no text."""
    if not raw:
        return None
    for bom, codec in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\0\0", "utf-32"), (b"\0\0\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(bom):
            return _checked(raw, codec)
    if b"\0" in raw:
        found = []
        for codec in ("utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be"):
            got = _checked(raw, codec)
            if got:
                found.append((cost(got[0]) / max(1, len(got[0])) - got[0].count(" ") / len(got[0]) - got[0].count("\n") / len(got[0]), got))
        return min(found, key=lambda x: x[0])[1] if found else None
    if sum(b < 32 and b not in (9, 10, 12, 13) for b in raw) > 0.002 * len(raw):
        return None
    found = []
    for codec in RAW_CODECS:
        got = _checked(raw, codec)
        if got:
            found.append((cost(got[0]), got))
            if codec == "utf-8":
                break
    if not found:
        return None
    k, got = min(found, key=lambda x: x[0])
    return got if k <= 0.4 * len(got[0]) else None


def _checked(raw: bytes, codec: str) -> tuple[str, str] | None:
    try:
        text = raw.decode(codec)
    except UnicodeDecodeError:
        return None
    if not text.strip() or sum(c < " " and c not in "\t\n\r\f" or "\x7f" <= c < "\xa0" for c in text) > 0.002 * len(text):
        return None
    letters = sum(c.isalnum() or c.isspace() for c in text)
    if letters < 0.5 * len(text):
        return None
    if codec.startswith(("utf-16", "utf-32")) and cost(text) > 0.5 * len(text):
        return None
    return text, codec


def one_file(artifact_id: int, text: str | None, exception: str | None, raw: bytes | None) -> list[tuple]:
    if text is None:
        if exception not in ("binary_content", "undecodable_text"):
            return []
        got = read_bytes(raw)
        return [(artifact_id, got[0].count("\n") + 1, got[1], got[0].replace("\r\n", "\n"))] if got else []
    fixed, bad, steps = repair_text(text)
    if not bad:
        return []
    if "�" in fixed and raw:
        got = read_bytes(raw)
        if got and "�" not in got[0] and cost(got[0]) < cost(fixed):
            return [(artifact_id, bad, got[1], got[0].replace("\r\n", "\n"))]
    return [(artifact_id, bad, steps, fixed)]


def repaired(df: DataFrame) -> DataFrame:
    """``artifact_id, garbled_lines, steps, text_restored`` of the affected files (artifact_id, text, exception, raw)."""
    # plain ASCII text without references is right as it is and never reaches a worker
    odd = F.col("text").rlike(r"[^\x00-\x7f]|&[A-Za-z]{2,8};")
    lost = F.col("text").isNull() & F.col("exception").isin("binary_content", "undecodable_text")
    kept = df.where(odd | lost).withColumn("raw", F.when(lost | F.col("text").contains("�"), F.col("raw")))
    return map_rows(kept, one_file, "artifact_id long, garbled_lines int, steps string, text_restored string", ["artifact_id", "text", "exception", "raw"])

"""One consistent form for text that looks the same but differs in its characters.

The visual form of a text is: canonical decomposition, then per code point
  * full-width and half-width forms and ligatures become the plain letters,
  * every blank of any width becomes U+0020,
  * characters that show nothing (zero-width, soft hyphen, byte-order mark,
    direction and variation marks) go, but for joiners between letters of
    scripts in which they change the shape,
  * letters of other scripts drawn like a Latin letter become that letter,
then canonical reordering and composition.  Case, accents, punctuation shape
and the shape of digits and signs (raised, circled, fraction) stay.

All work is done on a whole Arrow slice at once: code points are one numpy
array, the mapping is a table gather with expansion offsets, and marks are
reordered and composed with array operations; no Python call per text.

Null text gives a null form; an empty text and one of invisible characters
both give ''.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_dir, slices

# Letters drawn like a basic Latin letter in common fonts, by script.
LOOKALIKES = {
    "аеорсухѕіјһԁԛԝ": "aeopcyxsijhdqw",
    "АВЕКМНОРСТУХЅІЈԌԚԜ": "ABEKMHOPCTYXSIJGQW",
    "ονιϲϳ": "ovicj",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ": "ABEZHIKMNOPTYXCJ",
    "օոսցհյ": "onughj",
    "ՕՍ": "OU",
    "ɑɡıȷ": "agij",
    "ⅰⅴⅹⅼⅽⅾⅿ": "ivxlcdm",
    "ⅠⅤⅩⅬⅭⅮⅯ": "IVXLCDM",
}
# Signs that are drawn the same.
SAME_SIGNS = {"‐": "-", "‑": "-", "µ": "μ", "ʹ": "'", "ʼ": "’", "⁄": "/", "∕": "/", "∶": ":", "⁃": "-"}

#: Rows of one text that meet its pairs in one task.
SALT_ROWS = 20_000
_ZWNJ, _ZWJ = 0x200C, 0x200D
_MARK = 0x110000  # bit for "kept joiner": not a character


class _Tables:
    """Lookup tables over all code points, filled on first sight of a code point."""

    def __init__(self) -> None:
        self.known = np.zeros(0x110000, bool)
        self.length = np.ones(0x110000, np.int32)
        self.start = np.zeros(0x110000, np.int32)
        self.ccc = np.zeros(0x110000, np.uint8)
        self.joining = np.zeros(0x110000, bool)
        self.pool = np.zeros(1024, np.uint32)
        self.used = 0
        self.look = {a: b for k, v in LOOKALIKES.items() for a, b in zip(k, v)} | SAME_SIGNS
        pairs = {}
        for cp in range(0xA0, 0x30000):
            if 0xAC00 <= cp < 0xD7A4 or 0xD800 <= cp < 0xE000:
                continue
            parts = unicodedata.decomposition(chr(cp)).split()
            if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
                pairs[int(parts[0], 16) << 21 | int(parts[1], 16)] = cp
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_values = np.array([pairs[k] for k in sorted(pairs)], np.uint32)

    def image(self, ch: str) -> str:
        out = []
        for c in unicodedata.normalize("NFD", ch):
            tag, _, code = unicodedata.decomposition(c).partition(" ")
            if tag in ("<wide>", "<narrow>") or (tag == "<compat>" and 0xFB00 <= ord(c) <= 0xFB06):
                out += [self.look.get(x, x) for x in unicodedata.normalize("NFKD", c)]
            elif unicodedata.category(c) == "Zs":
                out.append(" ")
            elif shows_nothing(c):
                continue
            else:
                out.append(self.look.get(c, c))
        return "".join(out)

    def learn(self, points: np.ndarray) -> None:
        for cp in np.unique(points[~self.known[points]]).tolist():
            ch = chr(cp)
            image = ch if cp in (_ZWNJ, _ZWJ) or 0xAC00 <= cp < 0xD7A4 else self.image(ch)
            n = len(image)
            if self.used + n > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) + n, np.uint32)])
            self.pool[self.used : self.used + n] = [ord(x) for x in image]
            self.start[cp], self.length[cp] = self.used, n
            self.used += n
            for x in image:
                self.ccc[ord(x)] = unicodedata.combining(x)
            self.joining[cp] = _joining(ch)
            self.known[cp] = True


def shows_nothing(c: str) -> bool:
    """Default-ignorable characters: nothing is drawn for them, or only the neighbour changes."""
    cp = ord(c)
    return (
        unicodedata.category(c) == "Cf" and not (0x600 <= cp <= 0x605 or cp in (0x6DD, 0x70F, 0x8E2, 0x110BD, 0x110CD) or 0xFFF9 <= cp <= 0xFFFB)
        or cp in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)
        or 0x180B <= cp <= 0x180F or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF
    )


def _joining(c: str) -> bool:
    """Characters beside which a joiner changes what is drawn: Arabic and Indic scripts, emoji."""
    cp = ord(c)
    return 0x600 <= cp <= 0x8FF or 0x900 <= cp <= 0xDFF or 0x1800 <= cp <= 0x18AF or 0x1F000 <= cp <= 0x1FAFF or 0x2600 <= cp <= 0x27BF


_tables: _Tables | None = None


def tables() -> _Tables:
    global _tables
    if _tables is None:
        _tables = _Tables()
    return _tables


def code_points(data: bytes) -> np.ndarray:
    return np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)


def visual_points(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The visual form of code points ``cp``; ``row`` names the text each belongs to (ascending)."""
    t = tables()
    t.learn(cp)
    # joiners stay only between two characters whose drawing they change
    drop = np.zeros(len(cp), bool)
    z = np.flatnonzero((cp == _ZWNJ) | (cp == _ZWJ))
    if len(z):
        before, after = np.maximum(z - 1, 0), np.minimum(z + 1, len(cp) - 1)
        keep = (z > 0) & (z < len(cp) - 1) & (row[before] == row[z]) & (row[after] == row[z]) & t.joining[cp[before]] & (t.joining[cp[after]] | (cp[z] == _ZWNJ) & t.joining[cp[after]])
        drop[z[~keep]] = True
    n = np.where(drop, 0, t.length[cp])
    total = int(n.sum())
    ends = np.cumsum(n)
    inside = np.arange(total) - np.repeat(ends - n, n)
    out = t.pool[np.repeat(t.start[cp], n) + inside]
    rows = np.repeat(row, n)
    out = _reorder(out, rows, t)
    return _compose(out, rows, t)


def _reorder(cp: np.ndarray, row: np.ndarray, t: _Tables) -> np.ndarray:
    ccc = t.ccc[cp]
    marks = np.flatnonzero(ccc)
    if not len(marks):
        return cp
    starter = np.cumsum(ccc == 0)[marks]
    order = np.lexsort((np.arange(len(marks)), ccc[marks], starter, row[marks]))
    cp = cp.copy()
    cp[marks] = cp[marks[order]]
    return cp


def _compose(cp: np.ndarray, row: np.ndarray, t: _Tables) -> tuple[np.ndarray, np.ndarray]:
    ccc = t.ccc[cp]
    alive = np.ones(len(cp), bool)
    marks = np.flatnonzero(ccc)
    if len(marks):
        index = np.arange(len(cp))
        base = np.maximum.accumulate(np.where(ccc == 0, index, -1))[marks]
        ok = (base >= 0) & (row[np.maximum(base, 0)] == row[marks])
        marks, base = marks[ok], base[ok]
        cp = cp.copy()
        blocked = np.zeros(len(cp), np.uint8)  # class of the last mark left standing after each starter
        while len(marks):  # one round a mark of the longest run
            first = np.r_[True, base[1:] != base[:-1]]
            m, b = marks[first], base[first]
            key = cp[b].astype(np.int64) << 21 | cp[m]
            at = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
            hit = (t.pair_keys[at] == key) & (blocked[b] != ccc[m])
            cp[b[hit]] = t.pair_values[at[hit]]
            alive[m[hit]] = False
            blocked[b[~hit]] = ccc[m[~hit]]
            marks, base = marks[~first], base[~first]
    cp, row = cp[alive], row[alive]
    return _compose_jamo(cp, row)


def _compose_jamo(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hangul letters to syllables: lead + vowel, then syllable without tail + tail."""
    for tail in (False, True):
        c = cp.astype(np.int64)
        if tail:
            first, second = (c >= 0xAC00) & (c < 0xD7A4) & ((c - 0xAC00) % 28 == 0), (c > 0x11A7) & (c < 0x11C3)
        else:
            first, second = (c >= 0x1100) & (c < 0x1113), (c >= 0x1161) & (c < 0x1176)
        at = np.flatnonzero(first[:-1] & second[1:] & (row[:-1] == row[1:])) if len(c) > 1 else np.zeros(0, np.int64)
        if len(at):
            cp = cp.copy()
            cp[at] = c[at] + c[at + 1] - 0x11A7 if tail else 0xAC00 + ((c[at] - 0x1100) * 21 + c[at + 1] - 0x1161) * 28
            keep = np.ones(len(cp), bool)
            keep[at + 1] = False
            cp, row = cp[keep], row[keep]
    return cp, row


def visual_array(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Visual form of a string array, and which rows changed.  Rows of plain ASCII are their own form."""
    col = col.cast(pa.large_string())
    n = len(col)
    null = col.is_null().to_numpy(zero_copy_only=False)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = memoryview(col.buffers()[2] or b"")[int(offsets[0]) : int(offsets[-1])]
    offsets = offsets - offsets[0]
    raw = np.frombuffer(data, np.uint8)
    high = np.concatenate([[0], np.cumsum(raw >= 0x80)])
    rows = np.flatnonzero((high[offsets[1:]] > high[offsets[:-1]]) & ~null)
    changed = np.zeros(n, bool)
    if not len(rows):
        return col, changed
    size = offsets[rows + 1] - offsets[rows]
    owner = np.repeat(np.arange(len(rows)), size)
    chosen = raw[np.repeat(offsets[rows], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)]
    lead = (chosen & 0xC0) != 0x80
    cp, row = visual_points(code_points(chosen.tobytes()), owner[lead])
    new = np.frombuffer(cp.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
    width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    new_size = np.bincount(row, width, len(rows)).astype(np.int64) if len(row) else np.zeros(len(rows), np.int64)
    new_ends = np.cumsum(new_size)
    texts = col.to_numpy(zero_copy_only=False) if len(rows) < n else None
    forms = pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(np.r_[0, new_ends].astype(np.int64)), pa.py_buffer(new.tobytes()))
    old = col.take(pa.array(rows))
    changed[rows] = pc.not_equal(old, forms).to_numpy(zero_copy_only=False)
    if texts is None:
        return forms, changed
    mask = np.zeros(n, bool)
    mask[rows] = True
    return pc.replace_with_mask(col, pa.array(mask), forms), changed


def _digests(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each value, as two signed longs."""
    both = np.array([xxhash.xxh3_128_intdigest(v.as_buffer() if v.is_valid else b"") for v in col.cast(pa.large_binary())], object)
    low = np.array([x & (1 << 64) - 1 for x in both], np.uint64).view(np.int64)
    return np.array([x >> 64 for x in both], np.uint64).view(np.int64), low


def visual_form(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text_form, changed``: the normalised text of every row (null text stays null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                form, changed = visual_array(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), form.cast(pa.string()), pa.array(changed)], ["id", "text_form", "changed"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, "id long, text_form string, changed boolean")


def visual_keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, k1, k2, raw``: 128-bit key of the visual form and 64-bit key of the characters, for rows with text.

    Only these 32 bytes a row are ever shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                form, _ = visual_array(part.column(1))
                k1, k2 = _digests(form)
                _, raw = _digests(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(k1), pa.array(k2), pa.array(raw)], ["id", "k1", "k2", "raw"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col)).filter(F.col(text_col).isNotNull()).mapInArrow(run, "id long, k1 long, k2 long, raw long")


def _kept_keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct keys, written to the checkpoint folder: 32 bytes a row are read again where texts would be, and a lost executor costs no new pass."""
    checkpoint_dir(df.sparkSession)
    return visual_keys(df, id_col, text_col).distinct().checkpoint()


def _mixed_texts(keys: DataFrame) -> DataFrame:
    """``k1, k2, raw, first, n``: each different text once (its least id and its rows), of the forms that have several."""
    texts = keys.groupBy("k1", "k2", "raw").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    mixed = texts.groupBy("k1", "k2").agg(F.count("*").alias("texts")).where("texts > 1").select("k1", "k2")
    return texts.join(mixed, ["k1", "k2"], "left_semi")


def text_pairs(texts: DataFrame) -> DataFrame:
    """Pairs of different texts of one form, each pair once: ``raw_a, first_a, n_a, raw_b, first_b, n_b``.

    Both sides are single texts, so the rows of a hot text play no part.
    """
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("raw", "first", "n")]
    return texts.select("k1", "k2", *side("a")).join(texts.select("k1", "k2", *side("b")), ["k1", "k2"]).where("raw_a < raw_b").drop("k1", "k2")


def visual_links(df: DataFrame, id_col: str = "artifact_id", text_col: str = "text") -> DataFrame:
    """Pairs between the representatives (least id) of different texts that look the same; ``visual_classes`` has the members."""
    pairs = text_pairs(_mixed_texts(_kept_keys(df, id_col, text_col)))
    a, b = F.struct("first_a", "n_a"), F.struct(F.col("first_b").alias("first_a"), F.col("n_b").alias("n_a"))
    ordered = pairs.where("first_a <> first_b").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return ordered.select(F.col("a.first_a").alias(f"{id_col}_a"), F.col("b.first_a").alias(f"{id_col}_b"), F.col("a.n_a").alias("rows_a"), F.col("b.n_a").alias("rows_b"))


def visual_twins(df: DataFrame, id_col: str = "artifact_id", text_col: str = "text") -> DataFrame:
    """All pairs ``id_a < id_b`` whose texts look the same but differ in characters.

    Different texts are paired first, each text once; pairs of texts then meet
    the rows of either text by equality on the text.  The rows of a hot text are
    cut into salts of ``SALT_ROWS``, and the pairs that name it are offered to each
    salt, so no task holds more than one salt of it.  Without a text that differs
    from all its copies nothing is joined, however often a text is repeated.
    """
    keys = _kept_keys(df, id_col, text_col)
    texts = _mixed_texts(keys)
    pairs = text_pairs(texts)
    salts = texts.select("raw", F.ceil(F.col("n") / SALT_ROWS).alias("salts"))
    rows = keys.join(salts, "raw").select("raw", "id", F.pmod(F.xxhash64("id"), F.col("salts")).alias("salt"))

    def spread_over(side: str) -> DataFrame:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(f"n_{side}") / SALT_ROWS) - 1)).alias("salt")

    left = rows.select(F.col("raw").alias("raw_a"), F.col("id").alias("x"), "salt")
    right = rows.select(F.col("raw").alias("raw_b"), F.col("id").alias("y"), "salt")
    half = pairs.select("raw_a", "raw_b", "n_b", spread_over("a")).join(left, ["raw_a", "salt"]).select("x", "raw_b", "n_b")
    both = half.select("x", "raw_b", spread_over("b")).join(right, ["raw_b", "salt"])
    return both.select(F.least("x", "y").alias(f"{id_col}_a"), F.greatest("x", "y").alias(f"{id_col}_b")).where(F.col(f"{id_col}_a") < F.col(f"{id_col}_b")).distinct()


def visual_classes(df: DataFrame, id_col: str = "artifact_id", text_col: str = "text") -> DataFrame:
    """One row per document and text: its class (the least id with the same visual form), the class's rows and different texts.

    Counts are summed by text and then by form, so the rows of a hot form meet
    one row of their class; the join is by equality on the form, and adaptive
    execution splits the rows of a hot one over tasks.
    """
    keys = _kept_keys(df, id_col, text_col)
    texts = keys.groupBy("k1", "k2", "raw").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    per = texts.groupBy("k1", "k2").agg(F.min("first").alias("class_id"), F.sum("n").alias("rows_in_class"), F.count("*").alias("texts_in_class"))
    return keys.join(per, ["k1", "k2"]).select(F.col("id").alias(id_col), "class_id", "rows_in_class", "texts_in_class")

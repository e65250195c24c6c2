"""Held-out passages inside a training corpus, by an FM-index per corpus shard.

A shard is the documents of one task, about ``SHARD_WORDS`` words at a time.
Its words become numbers (words of the held-out records; all other words are
one number), a suffix array gives the Burrows-Wheeler transform, a wavelet
matrix gives its ranks, and all test phrases (every run of ``SEED`` words of a
record) are searched backwards at once.  Occurrences are located by walking to
sampled suffix positions, chained along diagonals over single changed, missing
or added words, and merged to spans.  Every document of the shard is indexed
whole; nothing but the matches leaves the task, and no shuffle is needed.

Word comparison ignores case, punctuation, layout and markup (HTML elements
and references, link targets).  Phrases found in more than a share ``MANY`` of all
records (held out or not, at least ``MANY_LEAST`` of them) are shared wording
and start no match; how many records hold a phrase is counted by an aggregate
over all records before the search, so the answer depends neither on the order
nor on the blocks in which records are read.

Null and empty texts match nothing; records without text are passed over;
repeated records count once; identical documents each get their row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

SEED = 5
LEAST = 12
#: Share of the records in which a phrase is wording of the collection and not of a record, and the least number of records for it.
MANY, MANY_LEAST = 1 / 60, 10
SHARD_WORDS = 600_000
#: Held-out text searched in one pass; a larger test set is searched block by block.
BLOCK_BYTES = 32 << 20
SAMPLE = 16

_WORD = re.compile(r"[^\W_぀-ヿ㐀-鿿]+|[぀-ヿ㐀-鿿]")
_MARKUP = re.compile(r"<!--|-->|</?[A-Za-z][^<>\n]*>|&(?:[A-Za-z]{2,8}|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});|(?<=\])\([^()\s]*\)")


def _blank(m: re.Match) -> str:
    return " " * len(m.group())


def unmarked(text: str) -> str:
    """Markup turned to blanks of the same width, so that positions stay those of the text."""
    return _MARKUP.sub(_blank, text) if "<" in text or "&" in text or "](" in text else text


def words(text: str) -> list[str]:
    text = unmarked(text)
    low = text.lower()
    return _WORD.findall(low) if len(low) == len(text) else [w.lower() for w in _WORD.findall(text)]


def word_places(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(unmarked(text))]


class Phrases:
    """Test phrases of a block of records ``(name, text, places of shared phrases)``: vocabulary, distinct seeds and where each occurs."""

    def __init__(self, records: list[tuple[str, str, list[int]]]) -> None:
        self.names = [r for r, _, _ in records]
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary.setdefault
        rows = [np.array([number(w, len(self.vocabulary) + 3) for w in words(t)], np.int64) for _, t, _ in records]
        self.symbols = len(self.vocabulary) + 3
        windows, owner, place = [], [], []
        for i, (r, (_, _, shared)) in enumerate(zip(rows, records)):
            if len(r) >= SEED:
                own = np.ones(len(r) - SEED + 1, bool)
                own[np.array(shared, np.int64)] = False
                at = np.flatnonzero(own)
                windows.append(np.lib.stride_tricks.sliding_window_view(r, SEED)[at])
                owner.append(np.full(len(at), i))
                place.append(at)
        if not sum(map(len, windows)):
            self.seeds = np.zeros((0, SEED), np.int64)
            return
        self.seeds, seed_of = np.unique(np.concatenate(windows), axis=0, return_inverse=True)
        seed_of = seed_of.reshape(-1)
        order = np.argsort(seed_of, kind="stable")
        self.seed_of = seed_of[order]
        self.owner, self.place = np.concatenate(owner)[order], np.concatenate(place)[order]
        self.first = np.searchsorted(self.seed_of, np.arange(len(self.seeds) + 1))


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Order of all suffixes: packed prefixes first, then prefix doubling over what is still tied."""
    n = len(text)
    bits = max(1, int(symbols - 1).bit_length())
    depth = max(1, 62 // bits)
    padded = np.concatenate([text.astype(np.int64), np.zeros(depth, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key = key << bits | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    rank = np.zeros(n, np.int64)
    head = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    while True:
        # rows of groups with more than one suffix; their rank is the place of the group's head
        tied = np.flatnonzero(~head | np.r_[~head[1:], False])
        if not len(tied):
            return order
        suffix = order[tied]
        nxt = suffix + depth
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, n - nxt)
        sub = np.lexsort((second, rank[suffix]))
        group, second, suffix = rank[suffix][sub], second[sub], suffix[sub]
        order[tied] = suffix
        fresh = np.r_[True, (group[1:] != group[:-1]) | (second[1:] != second[:-1])]
        head[tied] = fresh
        rank[suffix] = tied[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        depth *= 2


class FMIndex:
    """Backward search over a number sequence that ends in its only 0; wavelet-matrix ranks, sampled positions."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        self.n = len(text)
        order = suffix_array(text, symbols)
        bwt = text[order - 1]
        self.count = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        row = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(self.n - int(bit.sum()))
            row = np.concatenate([row[~bit], row[bit]])
        # where each symbol's block begins on the last level
        self.begin = self._descend(np.arange(symbols), np.zeros(symbols, np.int64))
        sampled = order % SAMPLE == 0
        self.marked = sampled
        self.mark_rank = np.cumsum(sampled) - 1
        self.samples = order[sampled]

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = self.ones[k][at]
            at = np.where(symbol >> level & 1, self.zeros[k] + one, at - one)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands in the transform before row ``at``."""
        return self._descend(symbol, at) - self.begin[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all phrases (rows of equal length), last word first."""
        last = phrases[:, -1]
        lo, hi = self.count[last].copy(), self.count[last + 1].copy()
        live = np.flatnonzero(lo < hi)
        for k in range(phrases.shape[1] - 2, -1, -1):
            if not len(live):
                break
            c = phrases[live, k]
            lo[live] = self.count[c] + self.rank(c, lo[live])
            hi[live] = self.count[c] + self.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back until a row whose position is kept."""
        place = np.zeros(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            done = self.marked[at]
            place[todo[done]] = self.samples[self.mark_rank[at[done]]] + steps
            todo, at = todo[~done], at[~done]
            if len(todo):
                c, walk = np.zeros(len(at), np.int64), at.copy()
                for k in range(self.levels):
                    one = self.ones[k][walk]
                    bit = self.ones[k][walk + 1] - one
                    c = c << 1 | bit
                    walk = np.where(bit, self.zeros[k] + one, walk - one)
                at = self.count[c] + walk - self.begin[c]
            steps += 1
        return place


def find(texts: list[str], phrases: Phrases) -> list[tuple[int, int, int, int, int]]:
    """``(text number, record number, first word, end word, matched words)`` of every passage in one shard."""
    if not len(phrases.seeds) or not texts:
        return []
    get = phrases.vocabulary.get
    rows = [np.array([1, *[get(w, 2) for w in words(t)]], np.int64) for t in texts]
    size = np.array([len(r) for r in rows])
    start = np.cumsum(size) - size
    text = np.concatenate([*rows, np.zeros(1, np.int64)])
    index = FMIndex(text, phrases.symbols)
    lo, hi = index.search(phrases.seeds)
    hit = np.flatnonzero(lo < hi)
    if not len(hit):
        return []
    n = hi[hit] - lo[hit]
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = index.locate(np.repeat(lo[hit], n) + inside)
    seed = np.repeat(hit, n)
    # each occurrence meets the record places of its phrase; those of shared wording are not among them
    k = phrases.first[seed + 1] - phrases.first[seed]
    which = np.repeat(phrases.first[seed], k) + np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
    at = np.repeat(at, k)
    doc = np.searchsorted(start, at, side="right") - 1
    word = at - start[doc] - 1
    return chain(doc, phrases.owner[which], word, phrases.place[which])


def chain(doc: np.ndarray, rec: np.ndarray, word: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Join seed hits that follow each other in text and record with at most one word changed, lost or added between."""
    # walk each text/record pair by diagonal band and position; two neighbouring diagonals may belong to one passage
    order = np.lexsort((word, word - place, rec, doc))
    doc, rec, word, place = doc[order], rec[order], word[order], place[order]
    diag = word - place
    same = (doc[1:] == doc[:-1]) & (rec[1:] == rec[:-1]) & (diag[1:] == diag[:-1]) & (word[1:] - word[:-1] <= SEED + 1)
    head = np.flatnonzero(np.r_[True, ~same]) if len(doc) else np.zeros(0, np.int64)
    if not len(head):
        return []
    tail = np.r_[head[1:], len(doc)]
    step = np.r_[SEED, np.minimum(SEED, word[1:] - word[:-1])]
    step[head] = SEED
    got = np.add.reduceat(step, head)
    runs = sorted(zip(doc[head].tolist(), rec[head].tolist(), word[head].tolist(), (word[tail - 1] + SEED).tolist(), place[head].tolist(), (place[tail - 1] + SEED).tolist(), got.tolist()))
    out: list[list[int]] = []
    near: list[list[int]] = []  # runs of this text and record whose end can still be reached
    for d, r, w0, w1, p0, p1, g in runs:
        near = [x for x in near if x[0] == d and x[1] == r and w0 - x[3] <= 1]
        for x in reversed(near):
            if -SEED < w0 - x[3] <= 1 and -SEED < p0 - x[5] <= 1 and w1 > x[3] and p1 > x[5]:
                x[6] += g - max(0, x[3] - w0, x[5] - p0)
                x[3], x[5] = w1, p1
                break
        else:
            near.append([d, r, w0, w1, p0, p1, g])
            out.append(near[-1])
    return [(d, r, w0, w1, g) for d, r, w0, w1, p0, p1, g in out if max(w1 - w0, p1 - p0) >= LEAST and g >= LEAST - 2]


def phrase_places(records: DataFrame, name_col: str, text_col: str) -> DataFrame:
    """``name, text_key, phrase, place`` of every run of ``SEED`` words of every record; phrases are 64-bit keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(text)
                if len(w) < SEED:
                    continue
                key = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
                phrases = np.array([xxhash.xxh3_64_intdigest("\x1f".join(w[i : i + SEED])) for i in range(len(w) - SEED + 1)], np.uint64).view(np.int64)
                n = len(phrases)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.full(n, key, np.uint64).view(np.int64)), pa.array(phrases), pa.array(np.arange(n, dtype=np.int32))], ["name", "text_key", "phrase", "place"])

    return records.select(name_col, text_col).mapInArrow(run, "name string, text_key long, phrase long, place int")


def shared_places(records: DataFrame, name_col: str, text_col: str) -> DataFrame:
    """``name, text_key, shared``: places of the phrases of each record that more than the allowed share of all records hold.

    The phrases are counted by distinct record; a hot phrase is one row a record, partly counted before the exchange.
    """
    n = records.select(name_col).distinct().count()
    every = phrase_places(records, name_col, text_col)
    many = every.select("phrase", "name").distinct().groupBy("phrase").count().where(F.col("count") > max(MANY_LEAST, MANY * n)).select("phrase")
    return every.join(many, "phrase", "left_semi").groupBy("name", "text_key").agg(F.sort_array(F.collect_set("place")).alias("shared"))


def passages(docs: DataFrame, records: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_col: str = "benchmark_id", record_text: str = "text", others: DataFrame | None = None) -> DataFrame:
    """``id, name, start_char, end_char, matched_words``: one row for each passage of a record found in a document.

    ``records`` are the held-out texts; ``others`` are texts that only tell what
    wording is shared, and all of both are counted for it.  The held-out texts are
    read to the driver block by block; a block never exceeds ``BLOCK_BYTES`` of
    text (or one record) and each gives one pass over the documents.
    """
    usable = F.col(record_text).isNotNull() & F.col(name_col).isNotNull()
    held = records.select(name_col, record_text).where(usable).distinct()
    known = held if others is None else held.unionByName(others.select(name_col, record_text).where(usable)).distinct()
    shared = shared_places(known, name_col, record_text).select(F.col("name").alias("_name"), "text_key", "shared")
    keyed = held.withColumn("text_key", _text_key(record_text))
    marked = keyed.join(shared, (F.col(name_col) == F.col("_name")) & (keyed["text_key"] == shared["text_key"]), "left").select(name_col, record_text, F.coalesce("shared", F.array().cast("array<int>")))
    blocks: list[list[tuple[str, str, list[int]]]] = [[]]
    size = 0
    for name, t, at in marked.toLocalIterator():
        if size and size + len(t) > BLOCK_BYTES:
            blocks.append([])
            size = 0
        blocks[-1].append((name, t, at))
        size += len(t)
    schema = f"{id_col} long, {name_col} string, start_char int, end_char int, matched_words int"
    source = docs.select(F.col(id_col).cast("long").alias(id_col), text_col).where(F.col(text_col).isNotNull())
    out = None
    for block in blocks:
        shared = source.sparkSession.sparkContext.broadcast(sorted(block))
        part = source.mapInArrow(_search(shared, id_col, name_col), schema)
        out = part if out is None else out.unionByName(part)
    return out


@F.pandas_udf(LongType())
def _text_key(s: pd.Series) -> pd.Series:
    return pd.Series([xxhash.xxh3_64_intdigest(v.encode("utf-8", "surrogatepass")) for v in s], dtype="uint64").astype("int64")


_built: tuple = (None, None)


def _phrases(shared) -> Phrases:
    """Phrases of a broadcast block, built once in each Python worker; only the last block is kept."""
    global _built
    if _built[0] is not shared.value:
        _built = (shared.value, Phrases(shared.value))
    return _built[1]


def _search(shared, id_col: str, name_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = _phrases(shared)
        texts: dict[str, list[int]] = {}
        held = 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t in texts:
                    texts[t].append(i)
                    continue
                texts[t] = [i]
                held += len(t) // 6 + 1
                if held >= SHARD_WORDS:
                    yield from shard(texts, phrases)
                    texts, held = {}, 0
        if texts:
            yield from shard(texts, phrases)

    def shard(texts: dict[str, list[int]], phrases: Phrases) -> Iterator[pa.RecordBatch]:
        keys = list(texts)
        rows = []
        spans: dict[int, list[tuple[int, int]]] = {}
        for k, r, w0, w1, got in find(keys, phrases):
            if k not in spans:
                spans = {k: word_places(keys[k])}
            a, b = spans[k][w0][0], spans[k][w1 - 1][1]
            rows += [(i, phrases.names[r], a, b, got) for i in texts[keys[k]]]
        if rows:
            cols = list(zip(*rows))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [id_col, name_col, "start_char", "end_char", "matched_words"])

    return run


def removal_spans(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Passages of a document merged to spans that do not overlap: ``id, start_char, end_char, n_records``.

    Works per document on the passages alone, with a window over that document's few rows.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(id_col).orderBy("start_char", "end_char")
    seen = F.max("end_char").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("fresh", F.when(seen.isNull() | (F.col("start_char") > seen), 1).otherwise(0))
    return (
        marked.withColumn("island", F.sum("fresh").over(w))
        .groupBy(id_col, "island")
        .agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"), F.countDistinct("benchmark_id").alias("n_records"))
        .drop("island")
    )

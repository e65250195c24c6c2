"""Keyword-stuffed and link-list pages, by a hidden Markov model over lines.

Each line of a page is reduced to one observed symbol (see ``SYMBOLS``) from
its own words and from the page's word repetition; a five-state model
(prose, keywords, links, tags, neutral) with sticky transitions is decoded by
Viterbi for a whole slice of pages at once, and a page is spam when more than
half of its words lie on lines labelled keywords, links or tags.

The probabilities of the model are fitted by Baum-Welch on all the pages
themselves, without labels; the table in this module is the starting point and,
``PRIOR`` times as heavy as the pages, the prior that keeps the states what
their names say.

Code blocks, file lists, tables of contents with page text, logs and front
matter are neutral: they count as words of the page but never as spam.
Null, empty and word-free texts are never spam.  Each row is decided by itself, so
repeated rows get the same answer.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_dir, slices

STATES = ("prose", "keywords", "links", "tags", "neutral")
SYMBOLS = ("sentence", "text", "short", "soup", "items", "repeat", "bare_link", "link_text", "hash", "row", "menu", "code", "file", "blank")

# Prior of P(symbol | state), rows in the order of STATES, columns in the order of SYMBOLS (per mille).
EMIT = np.array(
    [
        [520, 250, 60, 2, 20, 10, 3, 60, 2, 8, 5, 20, 10, 30],
        [5, 20, 120, 320, 220, 230, 20, 5, 10, 10, 30, 1, 1, 13],
        [10, 20, 90, 10, 20, 10, 700, 30, 10, 10, 50, 1, 1, 38],
        [10, 30, 120, 20, 200, 20, 30, 5, 250, 200, 90, 1, 1, 23],
        [20, 30, 60, 1, 10, 5, 5, 5, 2, 10, 5, 450, 380, 17],
    ],
    float,
)
EMIT = np.log(EMIT / EMIT.sum(1, keepdims=True))
STAY = 0.86
MOVE = np.log(np.full((5, 5), (1 - STAY) / 4) + np.eye(5) * (STAY - (1 - STAY) / 4))
START = np.log(np.array([0.6, 0.1, 0.1, 0.1, 0.1]))
THRESHOLD = 0.5
#: Weight of the prior against the pages, and the change of a probability at which fitting ends.
PRIOR, SETTLED = 3.0, 1e-4
#: Parts that an expected count is rounded to, and the lines that are counted at once: so many sums of parts are exact.
UNIT, SLICE_LINES = 2.0**30, 1 << 18


class Model(NamedTuple):
    """Logarithms of P(symbol | state), P(next state | state) and P(first state)."""

    emit: np.ndarray = EMIT
    move: np.ndarray = MOVE
    start: np.ndarray = START


PRIOR_MODEL = Model()

_WORD = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
_URL = re.compile(r"(?:https?://|ftp://|www\.)[^\s<>\"')\]|]+|\b[\w-]+(?:\.[\w-]+)+/[^\s<>\"')\]|]*", re.I)
_LINKS = re.compile(r"<a\s[^<>]*>([^<]*)</a>|!?\[([^\[\]\n]*)\]\([^()\n]*(?:\([^()\n]*\)[^()\n]*)?\)", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]*>")
_HASH = re.compile(r"(?<!\S)#[^\W_]\w*")
_FILE = re.compile(r"^\s*(?:[-*+]\s+|[│├└─|` ]+)?[\w.@-]*(?:/[\w.@-]+)*[\w-]*\.\w{1,6}\s*(?:\s{2,}.*|\(\d+[^)]*\)|[:=]\s*\d+.*|\d+\s*\w*)?$")
_LOG = re.compile(r"^\s*(?:\[?\d{1,4}[-:/.]\d{1,2}[-:/.T\d Z\]]*|(?:low|medium|high|critical|info|warn(?:ing)?|error|debug|notice)\b[: ])", re.I)
_END = re.compile(r"[.!?…。！？:;]['\"”’)»]*\s*$")
_CJK = re.compile("[぀-ヿ㐀-鿿가-힣]")
_SEP = re.compile(r"\s*(?:[,;|•·»>/]|\s-\s)\s*")


class _Line:
    """What one line holds: its links, the text outside them and the words of that text."""

    __slots__ = ("text", "plain", "links", "words", "wide", "size")

    def __init__(self, s: str) -> None:
        plain, links = s, 0
        if "](" in s or "<a" in s or "<A" in s:
            plain, links = _LINKS.subn(" ", s)
        if "<" in plain:
            plain = _TAG.sub(" ", plain)
        if "/" in plain or "www." in plain:
            plain, k = _URL.subn(" ", plain)
            links += k
        self.text, self.plain, self.links = s, plain, links
        self.words = _WORD.findall(plain.lower())
        self.wide = 0 if plain.isascii() else len(_CJK.findall(plain))
        #: words of the whole line, those of its addresses too; scripts without blanks count two characters a word
        self.size = (len(_WORD.findall(s)) if links else len(self.words)) + self.wide // 2


def page_symbols(text: str) -> tuple[list[int], list[int]]:
    """Symbol and number of words of each line that is not blank."""
    out: list = []
    fence = ""
    for line in text.split("\n"):
        s = line.strip()
        if not s:
            continue
        mark = s[:3]
        if mark in ("```", "~~~") and (not fence or mark == fence):
            fence = "" if fence else mark
            out.append(None)
        else:
            out.append(len(s.split()) if fence else _Line(s))
    lines = [x for x in out if isinstance(x, _Line)]
    count = Counter(w for x in lines for w in x.words)
    least = max(4, sum(count.values()) / 50)
    # words that carry the page: each makes up at least a fiftieth of it and comes back at least four times
    hot = {w for w, k in count.items() if k >= least}
    symbols = [line_symbol(x, hot) if isinstance(x, _Line) else 11 for x in out]
    sizes = [x.size if isinstance(x, _Line) else x or 0 for x in out]
    return symbols, sizes


def line_symbol(line: _Line, hot_words: set[str]) -> int:
    s, words, c = line.text, line.words, line.wide
    # signs without blanks between them count three a word; where blanks part them into short words, those are the words
    c = c if c > 6 * len(words) else 0
    n = len(words) + c // 3
    if line.links:
        # bare or barely labelled, against an entry described in words of its own
        return 6 if n <= 3 * line.links or n <= 4 else 7
    if "#" in s:
        hashes = len(_HASH.findall(s))
        # scripts without blanks count several words a tag, so tags are also counted against what stands between blanks
        if hashes >= 2 and 2 * hashes >= min(n, len(s.split())):
            return 8
    if n == 0:
        return 13
    if "." in s and _FILE.match(s):
        return 12
    if _LOG.match(s):
        return 0 if n >= 6 and _END.search(s) else 12
    hot = sum(w in hot_words for w in words)
    if s.count(" | ") >= 2 or s.count("\t") >= 2:
        return 9 if s[0] != "|" or hot >= 0.6 * n else 1
    if s[:2] in (">>", "<<", "»»", "**") and n <= 4 or s[0] == "#" and n <= 3 and s[1:2].isalpha():
        return 10
    distinct = len(set(words))
    pieces = [p for p in _SEP.split(s.strip(" .")) if p]
    mean = n / max(1, len(pieces))
    if c == 0:
        if len(pieces) >= 3 and mean <= 2.6 and not (s[-1] in ".!?" and mean > 2.2):
            return 4 if "," in s or ";" in s else 10
        if n >= 4 and len(pieces) >= 2 and distinct < n and hot / n >= 0.3 and s[-1] not in ".!?…:;”\"'":
            heads = [p.split()[0].lower() for p in pieces]
            if len(set(heads)) < len(heads):
                return 5
    elif len(pieces) >= 3 and max(map(len, pieces)) <= 14 and s[-1] not in "。.!?！？":
        return 4 if "," in s or ";" in s else 10
    # stuffed text comes back to the same pairs of words, prose of a small vocabulary does not
    if n >= 8 and distinct / n < 0.7 and hot / n >= 0.6 and len(set(zip(words, words[1:]))) < 0.75 * (len(words) - 1):
        return 3
    if _END.search(s):
        return 0
    return 2 if n <= 4 and not c else 1


class _Stack:
    """Lines of many pages by their place in the page: first lines, second lines and so on, each time those of longer pages first.

    The pages that have a line ``t`` are then the first ``running[t]`` of ``order``, and their lines one slice.
    A line counts as one observation for every fifteen words, eight at most: a
    paragraph of stuffed text on one line must outweigh the cost of leaving prose.
    """

    #: Weight of a line by its number of words, the last for any more.
    WEIGHT = 1 + np.minimum(np.arange(106) / 15, 7)

    def __init__(self, symbols: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> None:
        """``symbols`` and ``words`` of the lines of all pages one after the other, ``sizes`` lines a page."""
        self.pages = len(sizes)
        self.order = np.argsort(-sizes, kind="stable")[: np.count_nonzero(sizes)]
        size = sizes[self.order]
        self.steps = int(size[0]) if len(size) else 0
        self.running = np.searchsorted(-size, -np.arange(self.steps), side="left")
        self.begin = np.cumsum(self.running) - self.running
        line = np.repeat(np.arange(self.steps), self.running)
        rank = np.arange(len(line)) - self.begin[line]
        self.page = self.order[rank]
        #: place in ``symbols`` of each line
        self.source = (np.cumsum(sizes) - sizes)[self.page] + line
        self.symbol = symbols[self.source].astype(np.int64)
        self.words = words[self.source]
        self.kind = self.symbol * len(self.WEIGHT) + np.minimum(self.words, len(self.WEIGHT) - 1)

    @classmethod
    def of(cls, observed: list[np.ndarray], words: list[np.ndarray]) -> _Stack:
        none = np.zeros(0, np.int64)
        return cls(np.concatenate([none, *observed]), np.concatenate([none, *words]), np.array([len(x) for x in observed], np.int64))

    @classmethod
    def packed(cls, symbols: pa.Array, sizes: pa.Array) -> _Stack:
        """From two columns of ``page_lines``."""
        bytes_ = symbols.to_pylist()
        flat = np.frombuffer(b"".join(bytes_), np.uint8), np.frombuffer(b"".join(sizes.to_pylist()), "<i4").astype(np.int64)
        return cls(*flat, np.array([len(x) for x in bytes_], np.int64))

    def at(self, t: int, pages: int | None = None) -> slice:
        """Lines ``t`` of the pages that have one, or of the first ``pages``."""
        return slice(self.begin[t], self.begin[t] + (self.running[t] if pages is None else pages))

    def kinds(self, model: Model) -> np.ndarray:
        """Logarithm of P(line | state) by state and kind of line."""
        return (model.emit[:, :, None] * self.WEIGHT).reshape(len(STATES), -1)


def _path(s: _Stack, model: Model) -> np.ndarray:
    """Viterbi states of the lines of a stack; one array step a line of the longest page."""
    path = np.zeros(len(s.kind), np.int8)
    if not s.steps:
        return path
    emitted = s.kinds(model).T[s.kind]
    back = np.zeros((len(s.kind), 5), np.int8)
    score = model.start + emitted[s.at(0)]
    for t in range(1, s.steps):
        at, k = s.at(t), s.running[t]
        step = score[:k, :, None] + model.move
        best = step.argmax(1)
        back[at] = best
        score[:k] = np.take_along_axis(step, best[:, None, :], 1)[:, 0] + emitted[at]
    state = score.argmax(1)
    for t in range(s.steps - 1, -1, -1):
        at, k = s.at(t), s.running[t]
        path[at] = state[:k]
        state[:k] = np.take_along_axis(back[at], state[:k, None], 1)[:, 0]
    return path


def decode(observed: list[np.ndarray], words: list[np.ndarray], model: Model = PRIOR_MODEL) -> list[np.ndarray]:
    """Viterbi paths of many symbol sequences at once."""
    s = _Stack.of(observed, words)
    path = np.zeros(len(s.kind), np.int8)
    path[s.source] = _path(s, model)
    return np.split(path, np.cumsum([len(x) for x in observed])[:-1]) if observed else []


def _through(move: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Sum over i of move[i, j] * a[i], added in the same order however many pages there are (a product of matrices is not)."""
    out = move[0][:, None] * a[0]
    for i in range(1, len(move)):
        out += move[i][:, None] * a[i]
    return out


def _counts(s: _Stack, model: Model) -> tuple[np.ndarray, float]:
    """Expected emissions, moves and first states of a stack (forward-backward, scaled) one after the other, and its log-likelihood.

    Counts are whole numbers of 1 / ``UNIT``, rounded line by line and page by
    page: their sums are the same whatever pages are counted together.
    """
    states, n = model.emit.shape
    if not s.steps:
        return np.zeros(states * (n + states + 1), np.int64), 0.0
    kinds = s.kinds(model)
    top = kinds.max(0)
    emitted = np.exp(kinds - top)[:, s.kind]
    move, moving = np.exp(model.move), np.exp(model.move.T)
    ahead, scale = np.zeros_like(emitted), np.zeros(len(s.kind))
    for t in range(s.steps):
        at = s.at(t)
        now = _through(move, ahead[:, s.at(t - 1, s.running[t])]) if t else np.exp(model.start)[:, None]
        now = now * emitted[:, at]
        scale[at] = functools.reduce(np.add, now)
        ahead[:, at] = now / scale[at]
    moves, behind, state = np.zeros((states, states, len(s.order))), np.ones((states, len(s.order))), np.zeros_like(ahead)
    for t in range(s.steps - 1, -1, -1):
        at, k = s.at(t), s.running[t]
        state[:, at] = ahead[:, at] * behind[:, :k]
        if t:
            given = emitted[:, at] * behind[:, :k] / scale[at]
            moves[:, :, :k] += ahead[:, None, s.at(t - 1, k)] * given
            behind[:, :k] = _through(moving, given)
    weighed = np.rint(state * s.WEIGHT[s.kind % len(s.WEIGHT)] * UNIT)
    seen = np.stack([np.bincount(s.symbol, x, n) for x in weighed])
    moved = np.rint(moves * move[:, :, None] * UNIT).sum(2)
    first = np.rint(state[:, s.at(0)] * UNIT).sum(1)
    return np.concatenate([seen.ravel(), moved.ravel(), first]).astype(np.int64), float(np.log(scale).sum() + top[s.kind].sum())


def _tables(counts: np.ndarray, symbols: int = len(SYMBOLS)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emissions, moves and first states from what ``_counts`` gives."""
    seen, moves, first = np.split(counts / UNIT, [5 * symbols, 5 * symbols + 25])
    return seen.reshape(5, symbols), moves.reshape(5, 5), first


def expected(observed: list[np.ndarray], words: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected emissions, moves and first states of all sequences, and their log-likelihood."""
    counts, log = _counts(_Stack.of(observed, words), model)
    return *_tables(counts, model.emit.shape[1]), log


def _settle(count: Callable[[Model], np.ndarray], prior: Model, weight: float) -> Model:
    """Baum-Welch until no probability changes by more than ``SETTLED``; ``prior`` counts ``weight`` times as much as the sequences."""
    model = prior
    while True:
        counts = count(model)
        if not counts.any():
            return prior
        seen, moves, first = _tables(counts, prior.emit.shape[1])
        seen = seen + np.exp(prior.emit) * seen.sum() / 5 * weight
        moves = moves + np.exp(prior.move) * moves.sum() / 5 * weight + np.exp(prior.move) * 1e-9
        first = first + np.exp(prior.start) * first.sum() * weight
        new = Model(np.log(seen / seen.sum(1, keepdims=True)), np.log(moves / moves.sum(1, keepdims=True)), np.log(first / first.sum()))
        change = max(np.abs(np.exp(a) - np.exp(b)).max() for a, b in zip(model, new))
        model = new
        if change <= SETTLED:
            return model


def fit(observed: list[np.ndarray], words: list[np.ndarray], prior: Model = PRIOR_MODEL, weight: float = PRIOR) -> Model:
    """The model fitted on sequences at hand."""
    s = _Stack.of(observed, words)
    return _settle(lambda model: _counts(s, model)[0], prior, weight)


def page_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per page: id, symbols of its lines (a byte each) and their numbers of words (four bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                both = [page_symbols(t) if t else ([], []) for t in part.column(1).to_pylist()]
                packed = [bytes(x) for x, _ in both], [np.array(x, "<i4").tobytes() for _, x in both]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(x, pa.binary()) for x in packed)], ["id", "symbols", "sizes"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, "id long, symbols binary, sizes binary")


def fit_lines(lines: DataFrame) -> Model:
    """The model fitted on all pages of ``lines`` (see ``page_lines``), which each round of Baum-Welch reads once.

    A task counts its own pages and gives one row of counts, so the driver
    gets a hundred numbers a task and round.
    """

    def count(model: Model) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum(_counts(_Stack.packed(*part.columns), model)[0] for batch in batches for part in slices(batch, "symbols", SLICE_LINES))
            if isinstance(total, np.ndarray):
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], ["counts"])

        got = lines.select("symbols", "sizes").mapInArrow(run, "counts array<long>").collect()
        return np.array([float(sum(x)) for x in zip(*(r[0] for r in got))])

    return _settle(count, PRIOR_MODEL, PRIOR)


def fit_model(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", pages: int | None = None) -> Model:
    """The model fitted on all pages of ``df``, the same one however the table is stored.

    Texts are read once; their symbols are written to the checkpoint folder.
    Only a caller that names a number of ``pages`` has it fitted on so many ids, those with the least hash.
    """
    if pages is not None:
        chosen = df.select(F.col(id_col).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(pages)
        df = df.select(F.col(id_col).alias("id"), F.col(text_col)).join(F.broadcast(chosen), "id", "left_semi").withColumnRenamed("id", id_col)
    checkpoint_dir(df.sparkSession)
    return fit_lines(page_lines(df, id_col, text_col).checkpoint())


def line_labels(lines: DataFrame, id_col: str = "doc_id", model: Model = PRIOR_MODEL) -> DataFrame:
    """One row per page of ``lines``: words by label (prose, keywords, links, tags, neutral), share of spam words and the flag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "symbols", SLICE_LINES):
                s = _Stack.packed(*part.columns[1:])
                n = np.bincount(s.page * 5 + _path(s, model), s.words, s.pages * 5).astype(np.int64).reshape(-1, 5)
                total = n.sum(1)
                share = np.where(total > 0, n[:, 1:4].sum(1) / np.maximum(total, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(n[:, k]) for k in range(5)), pa.array(share), pa.array(share > THRESHOLD)],
                    ["id", *(f"{s}_words" for s in STATES), "spam_share", "is_spam"],
                )

    schema = "id long, " + ", ".join(f"{s}_words long" for s in STATES) + ", spam_share double, is_spam boolean"
    return lines.select("id", "symbols", "sizes").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def page_labels(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model = PRIOR_MODEL) -> DataFrame:
    """The labels of ``line_labels`` by a model at hand."""
    return line_labels(page_lines(df, id_col, text_col), id_col, model)


def fitted_labels(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The labels of ``line_labels`` by the model fitted on all pages of ``df``; texts are read once for both."""
    checkpoint_dir(df.sparkSession)
    lines = page_lines(df, id_col, text_col).checkpoint()
    return line_labels(lines, id_col, fit_lines(lines))

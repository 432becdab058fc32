"""Periodic runs of words, caught online: a catcher per completed power-of-two block."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.base import packed, view

#: A run has this many words at least, and this many times its period.
MIN_WORDS, MIN_EXPONENT = 24, 3
#: Words of the smallest block. A run of period p repeats itself over MIN_WORDS - p or 2 * p words or more, in which
#: an aligned block of 8 words lies whole if p < 16, and one of L words if p >= L.
SMALLEST = 8
#: Words that a comparison looks at first; each further look takes twice as many.
LOOK = 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def need(cls, n: int) -> None:
        if len(cls.up) < n:
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                powers = np.full(2 * n, base, np.uint64)
                powers[0] = 1
                setattr(cls, name, np.multiply.accumulate(powers))


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading items of two arrays of one length are equal."""
    at, look = 0, LOOK
    while at < len(a):
        differ = a[at : at + look] != b[at : at + look]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, look = at + look, 2 * look
    return len(a)


class Catchers:
    """Finds the runs of a growing sequence of word numbers.

    A block is L = 8, 16, 32, ... words that begin at a multiple of L. When it is
    complete, its catcher compares it, as the suffix of what has come so far, with
    the words p places before, for every p in [L, 2L) (below 16 for the smallest):
    by rolling hashes, then word by word. Agreement is a candidate square of
    period p, which backward and forward comparison makes a repetition; the
    repetition stays open while appended words go on agreeing. Later squares of
    the same repetition, or of a multiple of its period inside it, merge into it.
    The result does not depend on how many words come at once.
    """

    def __init__(self):
        self.n = 0
        self._words = np.zeros(64, np.int64)
        self._sums = np.zeros(65, np.uint64)  # prefix polynomials of the words
        self._next: dict[int, int] = {}  # first block of each length without a catcher
        self.found: list[list[int]] = []  # [start, end, period]
        self._open: list[list[int]] = []

    def append(self, numbers: np.ndarray) -> None:
        old, self.n = self.n, self.n + len(numbers)
        if self.n > len(self._words):
            self._words = np.concatenate([self._words[:old], np.zeros(2 * self.n - old, np.int64)])
            self._sums = np.concatenate([self._sums[: old + 1], np.zeros(2 * self.n - old, np.uint64)])
        _Powers.need(self.n + 1)
        self._words[old : self.n] = numbers
        terms = (numbers.astype(np.uint64) + np.uint64(1)) * _Powers.up[old : self.n]
        self._sums[old + 1 : self.n + 1] = self._sums[old] + np.cumsum(terms)
        for run in self._open:
            self._advance(run)
        self._open = [run for run in self._open if run[1] == self.n]
        size = SMALLEST
        while MIN_EXPONENT * size <= max(self.n, MIN_WORDS) and size <= self.n:
            self._catch(size)
            size *= 2

    def _advance(self, run: list[int]) -> None:
        end, words = run[1], self._words[: self.n]
        run[1] = end + _agree(words[end:], words[end - run[2] : self.n - run[2]])

    def _catch(self, size: int) -> None:
        """Set a catcher on each block of ``size`` words that has become complete."""
        first, last = self._next.get(size, 0), self.n // size
        if first >= last:
            return
        self._next[size] = last
        low = 1 if size == SMALLEST else size
        begin = max(first * size - 2 * size + 1, 0)  # the earliest window that a new block is compared with
        stop = (last - 1) * size + 1
        sums, down = self._sums, _Powers.down
        hashes = (sums[begin + size : stop + size] - sums[begin:stop]) * down[begin:stop]
        ahead = max(2 * size - 1 - first * size, 0)
        if ahead:
            hashes = np.concatenate([np.zeros(ahead, np.uint64), hashes])
        # Row i of the view: windows at period 2 * size - 1 down to ``low`` before block first + i.
        windows = np.lib.stride_tricks.sliding_window_view(hashes, 2 * size - low)[::size][: last - first]
        block, column = np.nonzero(windows == hashes[2 * size - 1 :: size][: last - first, None])
        if not len(block):
            return
        start, period = (first + block) * size, 2 * size - 1 - column
        order = np.lexsort((period, start))
        start, period = start[order], period[order]
        real = start >= period
        start, period = start[real], period[real]
        for run in self.found:
            start, period = self._outside(start, period, size, run)
        while len(start):
            run = self._repetition(int(start[0]), int(period[0]), size)
            if run:
                self.found.append(run)
                if run[1] == self.n:
                    self._open.append(run)
                start, period = self._outside(start[1:], period[1:], size, run)
            else:
                start, period = start[1:], period[1:]

    @staticmethod
    def _outside(start: np.ndarray, period: np.ndarray, size: int, run: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Candidates that do not merge into ``run``."""
        if not len(start):
            return start, period
        new = (start - period < run[0]) | (start + size > run[1]) | (period % run[2] != 0)
        return start[new], period[new]

    def _repetition(self, start: int, period: int, size: int) -> list[int] | None:
        """The widest stretch of the period around a block, if the block does agree."""
        words = self._words[: self.n]
        ahead = _agree(words[start:], words[start - period : self.n - period])
        if ahead < size:  # equal hashes of different words
            return None
        before = _agree(words[period:start][::-1], words[: start - period][::-1])
        return [start - before - period, start + ahead, period]

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of every run so far, by start, then period."""
        least: dict[tuple[int, int], int] = {}
        for start, end, period in self.found:
            if end - start >= max(MIN_WORDS, MIN_EXPONENT * period):
                least[start, end] = min(period, least.get((start, end), period))
        return sorted((start, end - start, period) for (start, end), period in least.items())


def numbers_of(words: list[bytes]) -> np.ndarray:
    """Each word's place among the distinct words of the text."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return [words[i] for i in kept]


def detect(
    docs: DataFrame, text_col: str = "text", id_col: str | None = None, change: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """The columns of ``docs`` plus ``_runs``: n_words, runs and collapsed, in the place of one that it has.

    ``runs`` is an array of start, length and period in words, by start, then
    period; ``collapsed`` the text with each run cut to its first period, words
    joined by one space. Words are what lies between space, tab, line feed and the
    three after it. A null, empty or blank text has no word, no run and an empty
    collapsed text; repeated rows get equal results; a text is one row whatever
    its length, and no row needs another. ``change(id, words)`` may replace the
    words of a text before the search.
    """
    kept = [c for c in docs.columns if c != "_runs"]
    names = [text_col] if id_col is None else [text_col, id_col]
    rows = packed(docs.select(*[F.col(f"`{c}`") for c in kept]), *names)
    rows = rows.select("_row", *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            n_words, starts, lengths, periods, ends, texts = [], [], [], [], [0], []
            ids = batch.column(2).to_pylist() if id_col is not None else [None] * batch.num_rows
            for text, doc_id in zip(batch.column(1).to_pylist(), ids, strict=True):
                words = text.encode("utf-8", "surrogatepass").split() if text else []
                if change is not None:
                    words = change(doc_id, words)
                catchers = Catchers()
                if len(words) >= MIN_WORDS:
                    catchers.append(numbers_of(words))
                found = catchers.runs()
                n_words.append(len(words))
                for at, length, period in found:
                    starts.append(at)
                    lengths.append(length)
                    periods.append(period)
                ends.append(len(starts))
                texts.append(b" ".join(collapse(words, found)))
            flat = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (starts, lengths, periods)], fields=list(kind.value_type))
            runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat).cast(kind)
            own = pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), runs, pa.array(texts, pa.binary()).cast(pa.string())], names=["n_words", "runs", "collapsed"])
            yield pa.RecordBatch.from_arrays([batch.column(0), own], names=["_row", "_runs"])

    schema = f"_row {rows.schema['_row'].dataType.simpleString()}, _runs struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"
    return rows.mapInArrow(run, schema).select("_row.*", "_runs")


def greatest(runs: Column) -> Column:
    """The run of greatest length/period, the first of equal ones; null without a run."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The fixed change of the registered query: ids whose crc32 ends in 0 get a periodic end; a null id none."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]


def query(docs: DataFrame) -> DataFrame:
    found = detect(view(docs, doc_id="doc_id", text="text"), "text", "doc_id", repeat_tail).select("doc_id", "_runs.runs", "_runs.collapsed")
    best = found.withColumn("_best", greatest(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

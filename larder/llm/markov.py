"""Hidden Markov language model: distributed Baum-Welch training and exact scoring."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.base import lowered_words, view
from larder.sources.shared import materialize

#: The end of a text is a token too; no word is empty.
END = b""
#: Words with more than 1 / HEAD of all training tokens, so fewer than HEAD, have their counts in every task.
HEAD = 1 << 20
#: Words with more than 1 / SYMBOLS of all are symbols of the model, so fewer than SYMBOLS; others go by class.
SYMBOLS = 1 << 13
CLASSES = 64
STATES = 8
ITERATIONS = 5
#: Training sequences are cut to this length; scoring never cuts.
SEGMENT = 256
#: Tokens that a task trains on, or scores, at once.
TRAIN_TOKENS, SCORE_TOKENS = 1 << 19, 1 << 22
#: Distinct words that a task counts before it passes them on.
COUNT_WORDS = 1 << 19


class Model(NamedTuple):
    start: np.ndarray  # (states)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (symbols, states)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 1 modulo 5; a null id trains."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def token_counts(docs: DataFrame) -> DataFrame:
    """``token, c`` over all whole texts of ``text``: counted in tasks, added up by token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["token", "c"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(lowered_words(text))
                counts[END] += 1
                if len(counts) >= COUNT_WORDS:
                    yield flush()
        yield flush()

    parts = docs.select("text").mapInArrow(run, "token binary, c long")
    return parts.groupBy("token").agg(F.sum("c").alias("c"))


def class_of(word: bytes) -> int:
    """Class of a word that is no symbol: by its last two bytes."""
    return zlib.crc32(word[-2:]) % CLASSES


def _class_column(token: Column) -> Column:
    last = F.when(F.length(token) > 2, F.substring(token, F.length(token) - 1, F.lit(2))).otherwise(token)
    return (F.crc32(last) % CLASSES).cast("int")


class Lexicon(NamedTuple):
    """What tasks need of the counts; bounded by HEAD words."""

    index: dict[bytes, int]  # head words, symbols first
    log_count: np.ndarray  # log10(c + 0.5) of each
    n_symbols: int
    class_log: np.ndarray  # log10 of each class's denominator
    prior: np.ndarray  # share of each symbol and class
    total: int
    distinct: int


def lexicon(counts: DataFrame, head: int = HEAD, symbols: int = SYMBOLS) -> Lexicon:
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    rows = counts.where(F.col("c") * head > total).collect() if total else []  # fewer than ``head`` rows
    rows = sorted(((r.c, bytes(r.token)) for r in rows), key=lambda x: (-x[0], x[1]))
    n_symbols = sum(1 for c, _ in rows if c * symbols > total)
    sums = np.zeros((CLASSES, 2))
    rest = counts.where(F.col("c") * symbols <= total).groupBy(_class_column(F.col("token")).alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"))
    for r in rest.collect():  # one row per class
        sums[r.k] = r.n, r.v
    shares = np.concatenate([[c for c, _ in rows[:n_symbols]], sums[:, 0]]) + 0.5
    return Lexicon(
        {w: i for i, (_, w) in enumerate(rows)}, np.log10(np.array([c for c, _ in rows], float) + 0.5), n_symbols,
        np.log10(sums[:, 0] + 0.5 * (sums[:, 1] + 1)), shares / shares.sum(), total, distinct,
    )


def coded(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """Texts as symbols: doc_id, held_out, n_tokens, n_known, head_log, class_log, symbols, tail.

    A word of the lexicon that is no symbol adds log10 P(word | class) to class_log. ``tail`` holds
    the words outside it, whose counts a join brings; class_log has their denominators.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, n_symbols = lex.index.get, lex.n_symbols
        for batch in batches:
            out = []
            for doc_id, held, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                words = lowered_words(text)
                words.append(END)
                at = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                rare = np.flatnonzero((at < 0) | (at >= n_symbols))
                classes = np.fromiter((class_of(words[i]) for i in rare), np.int64, len(rare))
                symbols = at.copy()
                symbols[rare] = n_symbols + classes
                known = at[at >= 0]
                inner = at[rare]
                by_class = lex.log_count[inner[inner >= 0]].sum() - lex.class_log[classes].sum()
                out.append((doc_id, held, len(words), len(known), float(lex.log_count[known].sum()), float(by_class), symbols.astype(np.int32), [words[i] for i in rare[inner < 0]]))
            kinds = (batch.schema.field(0).type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.binary()))
            names = ["doc_id", "held_out", "n_tokens", "n_known", "head_log", "class_log", "symbols", "tail"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, head_log double, class_log double, symbols array<int>, tail array<binary>"
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, schema)


def first_model(lex: Lexicon, states: int = STATES) -> Model:
    """States that last and emit the shares of the corpus, each disturbed in its own way, the same on every run."""
    rng = np.random.Generator(np.random.PCG64(7))
    emit = lex.prior[:, None] * (0.1 + rng.exponential(1.0, (len(lex.prior), states)))
    move = 0.8 * np.eye(states) + rng.uniform(0.5, 1.5, (states, states)) * 0.2 / states
    return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


class _Lockstep:
    """Sequences side by side, the longest first, so that those alive at step t are the first ones."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.flat = np.concatenate([sequences[i] for i in self.order])
        self.offsets = np.r_[0, np.cumsum(self.lengths)[:-1]]
        self.steps = int(self.lengths[0])
        self.alive = np.searchsorted(-self.lengths, -np.arange(self.steps), side="left")

    def at(self, t: int) -> np.ndarray:
        return self.flat[self.offsets[: self.alive[t]] + t]


def log_likelihoods(sequences: list[np.ndarray], model: Model) -> np.ndarray:
    """Exact log10 probability of each sequence by the forward recursion, scaled at every step."""
    run, logs = _Lockstep(sequences), np.zeros(len(sequences))
    alpha = model.start[None, :] * model.emit[run.at(0)]
    for t in range(run.steps):
        if t:
            alpha = (alpha[: run.alive[t]] @ model.move) * model.emit[run.at(t)]
        scale = alpha.sum(1)
        logs[: len(scale)] += np.log10(scale)
        alpha /= scale[:, None]
    out = np.empty(len(sequences))
    out[run.order] = logs
    return out


def expected_counts(sequences: list[np.ndarray], model: Model, sums: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """Add the expected starts, moves and emissions of the sequences to ``sums`` (forward-backward)."""
    start, move, emit = sums
    small = Model(*(x.astype(np.float32) for x in model))
    run = _Lockstep(sequences)
    seen = [run.at(t) for t in range(run.steps)]
    alphas, scales = [], []
    for t, x in enumerate(seen):
        alpha = (small.start[None, :] if t == 0 else alphas[-1][: len(x)] @ small.move) * small.emit[x]
        scale = alpha.sum(1)
        alphas.append(alpha / scale[:, None])
        scales.append(scale)
    beta, gammas = np.ones_like(alphas[-1]), [None] * run.steps
    for t in range(run.steps - 1, -1, -1):
        n = len(seen[t])
        if len(beta) < n:
            beta = np.concatenate([beta, np.ones((n - len(beta), beta.shape[1]), np.float32)])
        gammas[t] = alphas[t] * beta
        if t:
            ahead = small.emit[seen[t]] * beta / scales[t][:, None]
            move += (alphas[t - 1][:n].T @ ahead) * small.move
            beta = ahead @ small.move.T
    start += gammas[0].sum(0)
    symbols, weights = np.concatenate(seen), np.concatenate(gammas)
    for s in range(emit.shape[1]):
        emit[:, s] += np.bincount(symbols, weights[:, s], len(emit))


def _cut(symbols: np.ndarray) -> list[np.ndarray]:
    return [symbols[i : i + SEGMENT] for i in range(0, len(symbols), SEGMENT)]


def improve(train: DataFrame, model: Model, lex: Lexicon) -> Model:
    """One step of Baum-Welch over all rows of ``symbols``.

    Each task adds up its expected counts; the sums by symbol and state come to
    the driver, at most SYMBOLS + CLASSES + states + 1 rows whatever the corpus.
    """
    n, states = model.emit.shape
    names = [f"s{i}" for i in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = (np.zeros(states), np.zeros((states, states)), np.zeros((n, states)))
        held, size = [], 0
        for batch in batches:
            column = batch.column(0)
            flat, offsets = column.flatten().to_numpy(), np.asarray(column.offsets) - column.offsets[0].as_py()
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                held += _cut(flat[a:b])
                size += b - a
                if size >= TRAIN_TOKENS:
                    expected_counts(held, model, sums)
                    held, size = [], 0
        if held:
            expected_counts(held, model, sums)
        rows = np.concatenate([sums[2], sums[1], sums[0][None, :]])
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(rows[used, s]) for s in range(states))], names=["row", *names])

    parts = train.select("symbols").mapInArrow(run, ", ".join(["row long", *(f"{x} double" for x in names)]))
    rows = np.zeros((n + states + 1, states))
    for r in parts.groupBy("row").agg(*[F.sum(x).alias(x) for x in names]).collect():
        rows[r.row] = [r[x] for x in names]
    emit, move, start = rows[:n] + 0.1 * lex.prior[:, None], rows[n : n + states] + 0.01, rows[-1] + 0.01
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def score_rows(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (from ``coded``) with ``hmm_log`` in place of the symbols and the tail."""
    kept = [c for c in rows.columns if c not in ("symbols", "tail")]
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept), "hmm_log double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            column = table.column("symbols").chunk(0)
            flat, offsets = column.flatten().to_numpy(), np.asarray(column.offsets) - column.offsets[0].as_py()
            logs = log_likelihoods([flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], model)
            return pa.RecordBatch.from_arrays([*(table.column(c).chunk(0) for c in kept), pa.array(logs)], names=[*kept, "hmm_log"])

        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += len(batch.column(batch.schema.get_field_index("symbols")).flatten())
            if size >= SCORE_TOKENS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return rows.select(*kept, "symbols").mapInArrow(run, schema)


def score(docs: DataFrame, iterations: int = ITERATIONS, states: int = STATES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of ``doc_id, text`` rows.

    The model's alphabet is bounded: common words, and classes of the others. A
    class emits each of its training words by its smoothed count and keeps one
    share for all unseen ones, so that a text's probability is the forward
    recursion over its symbols times its words' shares of their classes, exactly.
    Counts cover every training text; rare words meet their counts in a join by
    word, in which no key is common. A null or empty text is its end alone. With
    no training text the counts are zero and the model keeps its first parameters.
    """
    rows = view(docs, doc_id="doc_id", text="text")
    counts = materialize(token_counts(rows.where(~held_out(F.col("doc_id")))), "token-counts")
    lex = lexicon(counts)
    texts = materialize(coded(rows, lex).withColumn("_row", F.monotonically_increasing_id()), "symbols")
    model = first_model(lex, states)
    for _ in range(iterations if lex.total else 0):
        model = improve(texts.where(~F.col("held_out")), model, lex)
    tail = texts.where(F.size("tail") > 0).select("_row", F.explode("tail").alias("token"))
    rare = counts.where(F.col("c") * HEAD <= lex.total)
    c = F.coalesce("c", F.lit(0))
    sums = tail.join(rare, "token", "left").groupBy("_row").agg(F.sum(F.log10(c + 0.5)).alias("tail_log"), F.count("c").alias("tail_known"))
    scored = score_rows(texts, model).join(sums, "_row", "left")
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    base = F.col("head_log") + tail_log - F.col("n_tokens") * math.log10(lex.total + 0.5 * (lex.distinct + 1))
    return scored.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("hmm_log") + F.col("class_log") + tail_log).alias("score"),
    )


def query(docs: DataFrame) -> DataFrame:
    return score(docs)

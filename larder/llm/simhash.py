"""SimHash near-dedup with pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.common import is_small
from larder.llm.base import lowered_words, packed, view
from larder.llm.components import components
from larder.sources.shared import materialize, scratch

SHINGLE, SEED, MAX_BITS = 3, 42, 3
#: Reference fingerprints of the pivot table; more discard more pairs before the exact comparison.
N_PIVOTS = 12
#: Up to this many fingerprints with one key are compared shift by shift, more by a search from each one found.
SHORT_RUN = 8
#: Fingerprints with one key that are searched in one task; a larger run is dealt out as pairs of such blocks.
KEY_BLOCK = 1 << 14
#: Serial numbers of rows to drop that may go to every task, 8 bytes each.
BROADCAST_ROWS = 1 << 20
#: Keys of more than KEY_BLOCK fingerprints that may go to every task, 16 bytes each.
BROADCAST_KEYS = 1 << 18


def _references(n: int) -> np.ndarray:
    """``n`` pseudo-random fingerprints, the same on every machine."""
    return np.random.Generator(np.random.PCG64(2024)).integers(0, 1 << 64, n, dtype=np.uint64)


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles of a text, 0 without words."""
    words = lowered_words(text)
    if not words:
        return 0
    if len(words) < size:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    shingles = map(b" ".join, zip(*[words[i:] for i in range(size)], strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``fp`` (the fingerprint's bits as a long)."""
    kept = [c for c in docs.columns if c != text_col]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "fp long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t) for t in batch.column(text_col).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(fps.view(np.int64))], names=[*kept, "fp"])

    return docs.mapInArrow(run, schema)


def _keys(fp: Column) -> Column:
    """The 16 keys of a fingerprint of which two share one if at most 3 bits differ.

    Of four 16-bit blocks one is equal; of the other 48 bits, in four blocks of
    12, one is equal too. A key is both places and both values: 32 bits.
    """
    block = lambda i: F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))
    keys = []
    for i in range(4):
        rest = [block(k) for k in range(4) if k != i]
        joined = F.shiftleft(rest[2], 32).bitwiseOR(F.shiftleft(rest[1], 16)).bitwiseOR(rest[0])
        for j in range(4):
            second = F.shiftrightunsigned(joined, 12 * j).bitwiseAND(F.lit(0xFFF))
            keys.append(F.shiftleft(F.lit(4 * i + j).cast("long"), 28).bitwiseOR(F.shiftleft(block(i), 12)).bitwiseOR(second))
    return F.array(*keys)


def _close(fps: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs (a, b) differ in at most ``max_bits`` bits.

    The distances of both to a reference differ by no more than their own
    distance, so a larger difference in any column of the table rules a pair out.
    """
    at = np.flatnonzero(np.abs(table[a] - table[b]).max(axis=1) <= max_bits)
    near = np.bitwise_count(fps[a[at]] ^ fps[b[at]]) <= max_bits
    return at[near]


def _search(fps: np.ndarray, table: np.ndarray, max_bits: int) -> tuple[list, list]:
    """Links that connect all linked fingerprints of one run: each is found once."""
    left, right, rest = [], [], np.arange(len(fps))
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            hit = _close(fps, table, np.broadcast_to(x, rest.shape), rest, max_bits)
            if len(hit):
                found = rest[hit]
                left.extend([x] * len(found))
                right.extend(found)
                todo.extend(found)
                rest = np.delete(rest, hit)
    return left, right


def _links(keys: np.ndarray, fps: np.ndarray, pivots: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints of equal key; ``keys`` is sorted."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    table = np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)
    size_at = np.repeat(sizes, sizes)
    left, right = [], []
    for shift in range(1, SHORT_RUN):
        a = np.flatnonzero((size_at[:-shift] > shift) & (size_at[:-shift] <= SHORT_RUN) & (keys[:-shift] == keys[shift:])) if len(keys) > shift else []
        if len(a):
            hit = _close(fps, table, a, a + shift, max_bits)
            left.append(a[hit])
            right.append(a[hit] + shift)
    for s, n in zip(starts[sizes > SHORT_RUN], sizes[sizes > SHORT_RUN], strict=True):
        a, b = _search(fps[s : s + n], table[s : s + n], max_bits)
        left.append(s + np.array(a, np.int64))
        right.append(s + np.array(b, np.int64))
    if not left:
        return fps[:0], fps[:0]
    return fps[np.concatenate(left)], fps[np.concatenate(right)]


def dealt_keys(distinct: DataFrame) -> DataFrame:
    """``key, fp``: each fingerprint of ``fp`` under its 16 keys.

    A key with more than KEY_BLOCK fingerprints is split by their hashes, and each
    pair of its blocks is a key of its own, so that no task holds more than two
    blocks however hot the key and every pair still meets. Those keys are hashes; if two
    fall together, their fingerprints are compared too, which changes nothing.
    """
    keyed = distinct.select(F.explode(_keys(F.col("fp"))).alias("key"), "fp")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > KEY_BLOCK)
    hot = materialize(sizes.select("key", F.ceil(F.col("n") / KEY_BLOCK).alias("blocks")), "hot-keys")
    if hot.isEmpty():
        return keyed
    hot = F.broadcast(hot) if is_small(hot, BROADCAST_KEYS) else hot
    split = keyed.join(hot, "key", "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))))
    each = split.withColumn("other", F.explode(F.expr("sequence(0L, coalesce(blocks, 1L) - 1)")))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return each.select(F.when(F.col("blocks").isNull(), F.col("key")).otherwise(pair).alias("key"), "fp")


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``a, b``: links that connect all fingerprints of ``fp`` within ``max_bits`` (at most 3) bits.

    Pairs with a common key are the candidates, which is complete. A task reads
    its keys in order and holds one run of equal keys, at most two blocks of
    KEY_BLOCK or so, 8 bytes and a table row each; a long run is searched from one
    fingerprint to the next, so that a dense group costs little more than its
    size, and yields a spanning forest, not all pairs.
    """
    pivots = _references(N_PIVOTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held_fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in _then_none(batches):
            if batch is not None:
                if not batch.num_rows:
                    continue
                held_keys = np.concatenate([held_keys, batch.column(0).to_numpy()])
                held_fps = np.concatenate([held_fps, batch.column(1).to_numpy().view(np.uint64)])
            if not len(held_keys):
                continue
            end = len(held_keys) if batch is None else np.searchsorted(held_keys, held_keys[-1])
            keys, fps = held_keys[:end], held_fps[:end]
            held_keys, held_fps = held_keys[end:], held_fps[end:]
            if len(keys):
                same = keys[1:] == keys[:-1]
                several = np.r_[False, same] | np.r_[same, False]
                if several.any():
                    a, b = _links(keys[several], fps[several], pivots, max_bits)
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return dealt_keys(distinct).repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _then_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def component_labels(printed: DataFrame) -> DataFrame:
    """``fp, root, component_id`` of the fingerprints whose component has several rows of ``printed`` (``doc_id, fp``)."""
    with scratch(printed.sparkSession) as keep:
        return keep(_labels(printed))


def _labels(printed: DataFrame) -> DataFrame:
    nodes = materialize(printed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    up = components(links(nodes.select("fp")))
    n, u = nodes.alias("n"), up.alias("u")
    rooted = materialize(
        n.join(u, F.col("n.fp") == F.col("u.node"), "left").select("n.fp", "least", "n", F.coalesce("u.root", "n.fp").alias("root")), "rooted"
    )
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("rows"))
    groups = materialize(groups.where("rows > 1").select("root", "component_id"), "groups")
    return materialize(rooted.join(groups, "root").select("fp", "root", "component_id"), "labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (smallest id reachable, its own included) for each row.

    Texts without words, null ones too, have fingerprint 0 and are linked like
    any other. Equal fingerprints are one node, so copies cost nothing; the
    components come back by joins on written tables that Spark can split, and
    only for fingerprints that occur twice or are linked.
    """
    printed = materialize(fingerprints(view(docs, doc_id=id_col, text=text_col)), "fingerprints")
    labels = component_labels(printed)
    return printed.join(labels, "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (with ``doc_id, text``) that come first in their component, by id (null last) and then by a serial number.

    Rows are written once with the serial number, so that each is kept or dropped
    by itself: rows without an id, rows that repeat one, and texts of one id in
    different components.
    """
    rows = materialize(packed(docs, "doc_id", "text").withColumn("_serial", F.monotonically_increasing_id()), "numbered")
    with scratch(docs.sparkSession) as keep:
        printed = materialize(fingerprints(rows.select("doc_id", "_serial", "text")), "fingerprints")
        members = materialize(printed.join(component_labels(printed), "fp").select("root", "doc_id", "_serial"), "members")
        place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_serial")
        firsts = materialize(members.groupBy("root").agg(F.min(place).alias("first")).select("root", F.col("first._serial").alias("_keep")), "firsts")
        drop = keep(materialize(members.join(firsts, "root").where(F.col("_serial") != F.col("_keep")).select("_serial"), "dropped"))
    drop = F.broadcast(drop) if is_small(drop, BROADCAST_ROWS) else drop  # else Spark decides by the written table's size
    return rows.join(drop, "_serial", "left_anti").select("_row.*")


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

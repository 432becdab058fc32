"""Line dedup: fuzzy lines by MinHash over character shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.common import global_row_number, is_small
from larder.llm.base import SPACE_CHARS, packed, rows_of, view
from larder.llm.components import components
from larder.sources.shared import materialize, scratch

SHINGLE, SIMILARITY = 7, 0.8
#: 12 bands of 4 rows: a pair of similarity 0.8 shares a band with probability 0.998, one of 0.3 with 0.1.
BANDS, ROWS = 12, 4
SLOTS = BANDS * ROWS
#: Lines of at most LONG different shingles have one minimum per hash function; of at least SHORT shingles,
#: repeats counted, one hash function with a minimum per slot; many lines have both. The sets of two like lines
#: differ in size by no more than the factor SIMILARITY: both have the first kind, or both have SHORT or more.
SHORT, LONG = 112, 160
#: Shingles of a longer line that are looked at before all of them are.
FIRST = 256
#: Characters that a task hashes at once.
BLOCK_CHARS = 1 << 18
#: Bits of a line's sketch; lines, and about as many characters, that are sketched at once.
SKETCH_BITS, SKETCH_LINES, SKETCH_CHARS = 1 << 12, 1 << 9, 1 << 17
#: Ids of 8 bytes that may go to every task.
BROADCAST_IDS = 1 << 20
#: Lines of a band that are compared with each other in one task; a larger band is dealt out as pairs of such blocks.
BAND_BLOCK = 1 << 11

_MASK32 = np.uint64(0xFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _constants(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(11)).integers(1 << 32, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


_FACTORS = (_constants(SLOTS) >> np.uint64(16)).astype(np.uint32) | np.uint32(1)
_STEPS = _constants(SHINGLE)
_BAND_FACTORS = _constants(ROWS + 2)
#: Where an empty slot looks for a value, try after try.
_DONORS = np.random.Generator(np.random.PCG64(13)).permuted(np.tile(np.arange(SLOTS), (SLOTS, 1)), axis=1).T


def _shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all lines, and how many each line has; a line shorter than a shingle is one."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    padded = "".join(x if len(x) >= SHINGLE else x + "\0" * (SHINGLE - len(x)) for x in lines)
    codes = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    total = len(codes) - SHINGLE + 1
    sums = np.zeros(total, np.uint64)
    for k in range(SHINGLE):
        sums += codes[k : k + total] * _STEPS[k]
    counts = np.maximum(sizes, SHINGLE) - SHINGLE + 1
    ends = np.cumsum(np.maximum(sizes, SHINGLE))
    inside = np.ones(total, bool)
    for k in range(1, SHINGLE):
        inside[ends[:-1] - k] = False
    return _mix(sums[inside]), counts


def _few_distinct(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether each line has at most LONG different shingles; a line that shows more in its first ones is not looked through."""
    few, starts = counts <= LONG, np.cumsum(counts) - counts
    rest = np.flatnonzero(~few)
    for part in np.array_split(rest, len(rest) // 4096 + 1):
        at = starts[part, None] + np.minimum(np.arange(FIRST)[None, :], counts[part, None] - 1)
        first = np.sort((hashes[at] >> np.uint64(32)).astype(np.uint32), axis=1)
        for i in part[(first[:, 1:] != first[:, :-1]).sum(axis=1) < LONG]:
            few[i] = len(np.unique(hashes[starts[i] : starts[i] + counts[i]])) <= LONG
    return few


def _many_functions(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    at, high = np.r_[0, np.cumsum(counts)[:-1]], (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(counts), SLOTS), np.uint32)
    for i in range(SLOTS):
        out[:, i] = np.minimum.reduceat(high * _FACTORS[i], at)
    return out


def _one_function(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    line = np.repeat(np.arange(len(counts)), counts)
    slot = (((hashes >> np.uint64(32)) * np.uint64(SLOTS)) >> np.uint64(32)).astype(np.int64)
    empty = np.uint64(1 << 40)
    flat = np.full(len(counts) * SLOTS, empty, np.uint64)
    np.minimum.at(flat, line * SLOTS + slot, hashes & _MASK32)
    found = flat.reshape(-1, SLOTS)
    out = found.copy()
    for donors in _DONORS:
        gaps = out == empty
        if not gaps.any():
            break
        out = np.where(gaps, found[:, donors], out)
    return out.astype(np.uint32)


def _band_keys(signatures: np.ndarray, kind: int) -> np.ndarray:
    parts = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * _BAND_FACTORS[ROWS] + np.uint64(kind) * _BAND_FACTORS[ROWS + 1]
    for r in range(ROWS):
        key = _mix(key + parts[:, :, r] * _BAND_FACTORS[r])
    return key.view(np.int64)


def band_rows(lines: DataFrame) -> DataFrame:
    """``key, id`` for each band of each line of ``id, line``."""

    def block(ids: list[int], lines: list[str]) -> Iterator[pa.RecordBatch]:
        hashes, counts = _shingle_hashes(lines)
        owner, ids = np.repeat(np.arange(len(counts)), counts), np.array(ids, np.int64)
        for kind, chosen, sign in ((0, _few_distinct(hashes, counts), _many_functions), (1, counts >= SHORT, _one_function)):
            if chosen.any():
                keys = _band_keys(sign(hashes[chosen[owner]], counts[chosen]), kind)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids[chosen], BANDS))], names=["key", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lines, size = [], [], 0
        for i, line in rows_of(batches, "id", "line"):
            ids.append(i)
            lines.append(line)
            size += len(line)
            if size >= BLOCK_CHARS:
                yield from block(ids, lines)
                ids, lines, size = [], [], 0
        if ids:
            yield from block(ids, lines)

    return lines.select("id", "line").mapInArrow(run, "key long, id long")


def shared_bands(bands: DataFrame) -> DataFrame:
    """``key, id, hub`` of the keys that several lines have; the hub of a key is its smallest id.

    Rows come in order of key and id, so the first of a key is its hub and a task
    remembers one row, however many have the key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, id and hub of the row before, and whether it went out
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids = (c.to_numpy() for c in batch.columns)
            if last:
                keys, ids = np.r_[last[0], keys], np.r_[last[1], ids]
            new = np.r_[True, keys[1:] != keys[:-1]]
            run_of = np.cumsum(new) - 1
            hubs = ids[np.flatnonzero(new)][run_of]
            if last:
                hubs[: np.searchsorted(run_of, 1)] = last[2]
            several = ~new | np.r_[~new[1:], False]
            if last:
                several[0] |= last[1] != last[2]
            out = several.copy()
            if last and last[3]:
                out[0] = False
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (keys, ids, hubs)], names=["key", "id", "hub"])
            last = int(keys[-1]), int(ids[-1]), int(hubs[-1]), bool(several[-1])

    return bands.repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "key long, id long, hub long")


def shingles(line: str) -> frozenset[str]:
    """What ``shingle_sets`` numbers."""
    return frozenset(line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1)))


def sketches(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """SKETCH_BITS bits of each line, set where its shingles hash to, and its number of shingles, repeats counted."""
    bits, counts, at = np.empty((len(lines), SKETCH_BITS // 64), np.uint64), np.empty(len(lines), np.int64), 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and end - at < SKETCH_LINES and size < SKETCH_CHARS:
            size += len(lines[end])
            end += 1
        hashes, counts[at:end] = _shingle_hashes(lines[at:end])
        flags = np.zeros((end - at, SKETCH_BITS), bool)
        places = (hashes & np.uint64(SKETCH_BITS - 1)).astype(np.int64)
        flags.reshape(-1)[places + np.repeat(np.arange(end - at) * SKETCH_BITS, counts[at:end])] = True
        bits[at:end] = np.packbits(flags, axis=1).view(np.uint64)
        at = end
    return bits, counts


def may_be_similar(bits: np.ndarray, counts: np.ndarray, others: np.ndarray, other_counts: np.ndarray) -> np.ndarray:
    """Whether lines may reach SIMILARITY by their sketches; of those that do, none is refused.

    A bit that only one of two lines has stands for a shingle that the other
    lacks, so two lines differ in at least as many shingles as bits. Similar sets
    differ in at most (1 / SIMILARITY - 1) times the smaller one.
    """
    apart = np.bitwise_count(bits ^ others).sum(axis=1, dtype=np.int64)
    return apart <= (1 / SIMILARITY - 1) * np.minimum(counts, other_counts) + 1e-6


def _windows(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each shingle of each line, equal exactly where the shingles are, and how many each line has."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    counts = np.maximum(sizes, SHINGLE) - SHINGLE + 1
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = np.flatnonzero(np.bincount(codes))
    rank = np.zeros(int(symbols[-1]) + 1, np.int64)
    rank[symbols] = np.arange(1, len(symbols) + 1)  # 0 stands behind the end of a line
    padded = np.maximum(sizes, SHINGLE)  # a line shorter than a shingle is one
    starts = np.cumsum(padded) - padded
    values = np.zeros(int(padded.sum()), np.int64)
    values[np.arange(len(codes)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)] = rank[codes]
    bits, total = len(symbols).bit_length(), len(values) - SHINGLE + 1
    if SHINGLE * bits <= 63:
        numbers = np.zeros(total, np.int64)
        for k in range(SHINGLE):
            numbers = (numbers << bits) | values[k : k + total]
    else:  # more symbols than fit: stretches are ranked, then twice as long ones, the last two of which overlap
        numbers, width = values, 1
        while width < SHINGLE:
            step = min(width, SHINGLE - width)
            _, numbers = np.unique(numbers[:-step] * (int(numbers.max()) + 1) + numbers[step:], return_inverse=True)
            width += step
    return numbers[np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)], counts


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """The shingles of each line as sorted different numbers, equal exactly where the shingles of these lines are."""
    numbers, counts = _windows(lines)
    sets, at = [], 0
    for count in counts.tolist():
        own = np.sort(numbers[at : at + count])
        sets.append(own[np.r_[True, own[1:] != own[:-1]]])
        at += count
    return sets


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose exact Jaccard similarity reaches SIMILARITY; sets are built for those that their sketches let pass."""
    for batch in batches:
        for at in range(0, batch.num_rows, SKETCH_LINES):
            a, b, left, right = (batch.column(n).slice(at, SKETCH_LINES).to_pylist() for n in ("a", "b", "left", "right"))
            place: dict[str, int] = {}
            which = np.fromiter((place.setdefault(x, len(place)) for x in left), np.int64, len(left))
            bits, counts = sketches(list(place))
            pairs = np.flatnonzero(may_be_similar(bits[which], counts[which], *sketches(right))).tolist()
            if not pairs:
                continue
            asked = dict.fromkeys(x for k in pairs for x in (left[k], right[k]))
            sets = dict(zip(asked, shingle_sets(list(asked)), strict=True))
            found = []
            for k in pairs:
                own, other = sets[left[k]], sets[right[k]]
                both = np.sort(np.concatenate((own, other)))
                common = np.count_nonzero(both[1:] == both[:-1])
                if common >= SIMILARITY * (len(both) - common):
                    found.append((a[k], b[k]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])


def candidate_lines(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """``id, line`` of the lines in pairs, written. Few ids go to the lines by broadcast, more meet them in a shuffle."""
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "candidates")
    wanted = F.broadcast(wanted) if is_small(wanted, BROADCAST_IDS) else wanted
    return materialize(lines.select("id", "line").join(wanted, "id", "left_semi"), "candidate-lines")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of ids whose lines are similar."""
    left, right = texts.toDF("a", "left"), texts.toDF("b", "right")
    return materialize(pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right").mapInArrow(_similar, "a long, b long"), "similar")


def _more_links(ids: np.ndarray, lines: list[str], roots: np.ndarray, sides: np.ndarray, starts: list[int]) -> list[tuple[int, int]]:
    """Links between the components of blocks of a band, or across two, by exact similarity; ``starts``: where blocks begin.

    Every line outside the largest component of its block asks all lines of other
    ones, first by their sketches. Where any may be similar, it tells how many
    shingles it shares with each, so all pairs that are still apart are compared,
    without a row or a set operation for each. Where ``sides`` tells two blocks
    apart, pairs inside one are left to its own task.
    """
    bits, counts = sketches(lines)
    wanted, part, asking = np.zeros(len(ids), bool), np.empty(len(ids), np.int64), []
    for block in (slice(*x) for x in zip(starts, [*starts[1:], len(ids)], strict=True)):
        across = sides[block].any() and not sides[block].all()
        _, part[block], members = np.unique(roots[block], return_inverse=True, return_counts=True)
        for q in block.start + np.flatnonzero(part[block] != members.argmax()):
            near = may_be_similar(bits[q], counts[q], bits[block], counts[block]) & (part[block] != part[q])
            if across:
                near &= sides[block] != sides[q]
            if near.any():
                wanted[block] |= near
                wanted[q] = True
                asking.append((q, block, across))
    if not asking:
        return []
    chosen = np.flatnonzero(wanted)
    sets = shingle_sets([lines[i] for i in chosen])
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    different, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mine, found = np.zeros(len(different), bool), []
    for q, block, across in asking:
        at = int(np.searchsorted(chosen, q))
        low, high = np.searchsorted(chosen, [block.start, block.stop])
        those, own = chosen[low:high], flat[begins[at] : ends[at]]
        mine[own] = True
        shared = np.add.reduceat(mine[flat[begins[low] : ends[high - 1]]], begins[low:high] - begins[low], dtype=np.int64)
        mine[own] = False
        near = (shared >= SIMILARITY * (sizes[low:high] + sizes[at] - shared)) & (part[those] != part[q])
        if across:
            near &= sides[those] != sides[q]
        _, first = np.unique(part[those[near]], return_index=True)
        found += [(int(ids[q]), int(i)) for i in ids[those[near][first]]]
    return found


def band_links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b``: links in bands of three or more lines that the tests against hubs left in several components.

    ``members``: key, id, root. Each line of such a band is joined to its text
    once. A band of up to BAND_BLOCK lines is searched in one task; a larger one is
    split by the lines' hashes, and each pair of its blocks is a task of its own, so
    that no task holds more than two blocks however hot the band and no pair is left out.
    """
    same = (F.bit_xor(F.xxhash64("id")).alias("one"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("two"))
    apart = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), *same)
    # Bands with the same lines are searched once.
    apart = apart.where("n > 2 AND low != high").groupBy("n", "low", "high", "one", "two").agg(F.min("key").alias("key"))
    apart = materialize(apart.select("key", F.ceil(F.col("n") / BAND_BLOCK).alias("blocks")), "open-bands")
    rows = members.select("key", "id", "root").join(apart, "key").join(texts, "id")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("id"), "blocks")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    dealt = dealt.select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("side"), "id", "root", "line"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, starts, held, size, links = None, [], [], 0, []

        def search() -> list[tuple[int, int]]:
            ids, lines, roots, sides = (list(x) for x in zip(*held, strict=True))
            return _more_links(np.array(ids), lines, np.array(roots), np.array(sides), starts)

        for key, i, j, *line in rows_of(batches, "key", "i", "j", "id", "line", "root", "side"):
            if (key, i, j) != now:
                if size >= SKETCH_CHARS:
                    links += search()
                    starts, held, size = [], [], 0
                now = key, i, j
                starts.append(len(held))
            held.append(line)
            size += len(line[1])
            if len(links) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*links, strict=True)], names=["a", "b"])
                links = []
        if held:
            links += search()
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*links, strict=True)], names=["a", "b"])

    found = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")
    return materialize(found, "band-links")


def _times(number: Column) -> Column:
    return number * F.lit(1 << 31).cast("decimal(10,0)")


def row_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` plus ``_own``, one key per row, ordered by id (null last) and then by a serial number.

    An id that one row has needs no number. The others, rows without an id and
    rows that share one, are written with a serial number each; rows that repeat
    an id together with its text are one document and have the first one's key.
    Ids that are no whole numbers are ranked first. Up to 2^31 rows may share
    their ids with other texts; rows without an id may be any number.
    """
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        own = materialize(docs.select(F.col(f"`{id_col}`").alias("_named")).where("_named IS NOT NULL").distinct(), "ids")
        ranks = materialize(global_row_number(own, ["_named"], "_ranked"), "ranked-ids")
        ranked = docs.join(ranks, F.col(f"`{id_col}`") == F.col("_named"), "left").drop("_named")
        return row_keys(ranked, "_ranked", text_col).drop("_ranked")
    doc, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    key = lambda serial: (_times(F.coalesce(doc.cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)"))) + serial).cast("decimal(30,0)")
    counted = docs.select(doc.alias("_doc")).where("_doc IS NOT NULL").groupBy("_doc").agg(F.count(F.lit(1)).alias("_n"))
    shared = materialize(counted.where("_n > 1").select("_doc"), "shared-ids")
    nulls, known = docs.where(doc.isNull()), docs.where(doc.isNotNull())
    if shared.isEmpty() and nulls.isEmpty():
        return docs.withColumn("_own", key(F.lit(0)))
    ids = F.broadcast(shared) if is_small(shared, BROADCAST_IDS) else shared
    several, alone = (known.join(ids, doc == F.col("_doc"), how) for how in ("left_semi", "left_anti"))
    unnamed = materialize(nulls.withColumn("_serial", F.monotonically_increasing_id()), "unnamed-rows")
    named = materialize(several.withColumn("_serial", F.monotonically_increasing_id()), "shared-rows")
    # The number of the task leads the serial number; offsets of the tasks make it dense.
    part, offsets, total = F.shiftright("_serial", 33), [], 0
    for r in named.groupBy(part.cast("long").alias("part")).count().orderBy("part").collect():
        offsets.append((r["part"], total))
        total += r["count"]
    if total >= 1 << 31:
        raise ValueError(f"{total} rows that share an id with another text are more than the serial numbers")
    starts = F.broadcast(docs.sparkSession.createDataFrame(offsets, "_part long, _start long"))
    named = named.join(starts, part == F.col("_part")).withColumn("_serial", F.col("_start") + F.col("_serial").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_start")
    firsts = named.groupBy(doc.alias("_doc"), text.alias("_same")).agg(F.min("_serial").alias("_first"))
    named = named.join(firsts, (doc == F.col("_doc")) & (text == F.col("_same")), "left").withColumn("_serial", F.coalesce("_first", "_serial"))
    numbered = named.drop("_doc", "_same", "_first").unionByName(unnamed)
    return alone.withColumn("_own", key(F.lit(0))).unionByName(numbered.withColumn("_own", key(F.col("_serial"))).drop("_serial"))


def first_lines(docs: DataFrame) -> DataFrame:
    """The lines to keep: ``_own, lines`` (array of line numbers from 0) per row key of ``row_keys`` that has any.

    Lines are compared without white space at their ends; those without words
    are not judged. Equal lines are one node. Lines are similar when their sets of
    SHINGLE-character shingles have a Jaccard similarity of SIMILARITY or more;
    a component of similar lines keeps its first line by row key and place.

    Each band links its lines to one hub, a frequent line where there is one;
    candidates are verified exactly; then lines of a band that are still apart are
    compared with each other, so that no candidate pair goes untested, while a
    family of near copies costs little more than a comparison for each.
    """
    with scratch(docs.sparkSession) as keep_table:
        own = docs.select("_own", F.posexplode(F.split("text", "\n", -1)).alias("at", "raw"))
        own = own.select("_own", "at", F.btrim("raw", F.lit(SPACE_CHARS)).alias("line")).where("line != ''")
        place = (_times(F.col("_own")) + F.col("at")).cast("decimal(38,0)")
        grouped = own.groupBy("line").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).sortWithinPartitions(F.desc("n"))
        # Frequent lines come first in their partition; the row number leads the id, so that they have small ids.
        serial = F.monotonically_increasing_id()
        spread = F.shiftleft(serial.bitwiseAND(F.lit((1 << 33) - 1)), 30).bitwiseOR(F.shiftright(serial, 33))
        lines = materialize(grouped.select(spread.alias("id"), "line", "first"), "lines")

        members = materialize(shared_bands(band_rows(lines)), "bands")
        pairs = materialize(members.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
        texts = candidate_lines(pairs, lines)
        similar = verified(pairs, texts)
        up = components(similar)
        m, u = members.alias("m"), up.alias("u")
        rooted = m.join(u, F.col("m.id") == F.col("u.node"), "left").select("m.key", "m.id", F.coalesce("u.root", "m.id").alias("root"))
        more = band_links(materialize(rooted, "rooted-bands"), texts)
        if not more.isEmpty():
            up = components(similar.unionByName(more))

        nodes = up.unionByName(up.select(F.col("root").alias("node"), "root").distinct())
        linked = materialize(lines.select("id", "first").join(nodes, F.col("id") == F.col("node")).select("first", "root"), "linked")
        keep = materialize(linked.groupBy("root").agg(F.min("first").alias("keep")), "kept-lines")
        losers = linked.join(keep, "root").where("first != keep").select("first")
        firsts = lines.select("first").join(losers, "first", "left_anti")
        row = F.floor(F.col("first") / F.lit(1 << 31).cast("decimal(10,0)")).cast("decimal(30,0)")
        firsts = firsts.select(row.alias("_own"), (F.col("first") - _times(row)).cast("int").alias("at"))
        return keep_table(materialize(firsts.groupBy("_own").agg(F.sort_array(F.collect_list("at")).alias("lines")), "first-lines"))


def mark_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` plus ``_lines``, the numbers of the lines to keep (empty where none is; null text has none).

    Rows are judged one by one, those without an id or with an id of several texts too;
    only rows that repeat an id and its text are one document, whose lines stand or fall together.
    """
    keyed = row_keys(docs, id_col, text_col)
    keep = first_lines(view(keyed, _own="_own", text=text_col)).toDF("_key", "_lines")
    # Documents meet their lines in a shuffle at every size: a written table that is broadcast while it is small
    # would make a step in what moves.
    joined = keyed.join(keep.hint("merge"), F.col("_own") == F.col("_key"), "left")
    return joined.withColumn("_lines", F.coalesce("_lines", F.array().cast("array<int>"))).drop("_own", "_key")


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, n_chars and others) without lines kept elsewhere, nor documents left with no words.

    Blank lines between kept ones stay.
    """
    pieces = F.filter(F.split("text", "\n", -1), lambda x, i: (F.btrim(x, F.lit(SPACE_CHARS)) == "") | F.array_contains("_lines", i))
    marked = mark_lines(packed(docs, "doc_id", "text")).where(F.size("_lines") > 0)
    left = marked.select("_row", F.array_join(pieces, "\n").alias("text"))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return left.select(*[changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    whole = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    judged = F.filter(F.transform(whole, lambda x, i: F.when(F.btrim(x, F.lit(SPACE_CHARS)) != "", i)), lambda i: i.isNotNull())
    marked = mark_lines(view(docs, doc_id="doc_id", text="text"))
    return marked.select(
        "doc_id", F.size(judged).cast("long").alias("n_lines"), F.size("_lines").cast("long").alias("n_kept"), F.col("_lines").alias("kept_lines")
    )

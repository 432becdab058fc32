"""SentencePiece vocabularies: streaming Viterbi encoding, and decoding."""

from __future__ import annotations

import math
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from larder.llm.base import view

MARK = "▁"
#: Where the public vocabulary files are, and the piece model among them.
TOKENIZERS = "/opt/tokenizers"
MODEL = "piece_bpe_32k.model"
#: Segments whose ids a worker remembers, and the longest that it does.
MEMO_SIZE, MEMO_CHARS = 1 << 18, 32
#: Costs are whole multiples of 2^-20, so that sums are exact and a path does not depend on where a window began.
COST_UNIT = 1 << 20


class Vocabulary:
    """Pieces with costs, and a byte piece for each byte.

    A unigram model has a log probability per piece, and a piece costs its
    negative. A merge model has merge ranks only; a piece of rank r then costs
    log(r + 2), its share under Zipf's law but for a constant, so that the cheapest
    segmentation has few and common pieces. Characters in no piece become bytes.
    """

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        scores = [model.get_score(i) for i in range(size)]
        ranked = all(s <= 0 and s == int(s) for s in scores)
        self.cost: dict[str, tuple[int, int]] = {}
        self.bytes_of: list[bytes] = [b""] * size
        self.byte_ids: list[int] = [model.unk_id()] * 256
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.cost[piece] = (round(COST_UNIT * (math.log(2 - scores[i]) if ranked else -scores[i])), i)
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
        self.covered = set("".join(self.cost))
        self.longest = max(map(len, self.cost), default=1)
        #: Pieces as a tree of characters; the empty key holds a piece's cost and ids.
        self.following: dict = {}
        for piece, (cost, i) in self.cost.items():
            node = self.following
            for char in piece:
                node = node.setdefault(char, {})
            node[""] = (cost, (i,))
        self.byte_cost = round(COST_UNIT * 4 * math.log(2 + size))
        #: No piece goes on over a mark that follows another character: each such mark starts a new segment.
        self.cuts_at_mark = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.cost)
        lone = "".join(c for c in "\n\t\r" if c not in self.covered)
        body = f"[^{MARK}{lone}]"
        self.segments = re.compile(f"{MARK}+{body}*|{body}+|[{lone}]" if lone else f"{MARK}+{body}*|{body}+").findall


_FAR = 1 << 62


class Stream:
    """Viterbi over characters as they come; ``feed`` and ``end`` return ids that no later text can change."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text, self.best, self.back = "", [0], [(0, ())]

    def feed(self, text: str) -> list[int]:
        """Extend every path to the ends of ``text``, in steps of the longest piece, and commit where all agree."""
        out, step = [], self.v.longest
        for i in range(0, len(text), step):
            self.extend(text[i : i + step])
            out += self._commit(self._agreed())
        return out

    def end(self) -> list[int]:
        return self._commit(len(self.text))

    def extend(self, more: str) -> list[int]:
        """Extend every path over ``more`` and commit nothing."""
        best, back, following, byte_ids = self.best, self.back, self.v.following, self.v.byte_ids
        start, self.text = len(self.text), self.text + more
        text, total = self.text, len(self.text)
        best.extend([_FAR] * (total - start))
        back.extend([None] * (total - start))
        # Pieces that end in the new text may start in the old.
        for begin in range(max(0, start - self.v.longest + 1), total):
            here, node = best[begin], following
            for end in range(begin, total):
                node = node.get(text[end])
                if node is None:
                    break
                found = node.get("")
                if found is not None and end >= start and (cost := here + found[0]) < best[end + 1]:
                    best[end + 1], back[end + 1] = cost, (begin, found[1])
            if begin >= start and best[begin + 1] == _FAR:
                codes = text[begin].encode("utf-8", "surrogatepass")
                best[begin + 1], back[begin + 1] = here + self.v.byte_cost * len(codes), (begin, tuple(byte_ids[b] for b in codes))
        return []

    def _agreed(self) -> int:
        """The last boundary that all paths still alive share.

        A later piece starts at one of the last ``longest`` positions, so the paths
        to those are the ones alive; the furthest steps back until one is left.
        """
        alive = set(range(max(0, len(self.text) - self.v.longest + 1), len(self.text) + 1))
        while len(alive) > 1:
            furthest = max(alive)
            alive.remove(furthest)
            alive.add(self.back[furthest][0])
        return alive.pop()

    def _commit(self, upto: int) -> list[int]:
        parts, at = [], upto
        while at > 0:
            at, ids = self.back[at]
            parts.append(ids)
        self.text, base = self.text[upto:], self.best[upto]
        self.best = [b - base for b in self.best[upto:]]
        self.back = [(0, ()), *((p - upto, ids) for p, ids in self.back[upto + 1 :])]
        return [i for ids in reversed(parts) for i in ids]


class _Memo(dict):
    """Ids of short segments, as int32 bytes; when full, what was not used since the last time is let go."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.older = vocabulary, {}

    def __missing__(self, segment: str) -> bytes:
        packed = self.older.get(segment)
        if packed is None:
            packed = array("i", encode_whole(self.v, segment)).tobytes()
        if len(segment) <= MEMO_CHARS:
            if len(self) >= MEMO_SIZE:
                self.older = dict(self)
                self.clear()
            self[segment] = packed
        return packed


def encode_whole(vocabulary: Vocabulary, segment: str) -> list[int]:
    """Ids of a segment: one that fits the window is committed at its end, a longer one on its way."""
    stream = Stream(vocabulary)
    ids = stream.feed(segment) if len(segment) > vocabulary.longest else stream.extend(segment)
    return ids + stream.end()


class Codec:
    """Text to ids and back, exactly."""

    def __init__(self, model_file: str):
        self.v = Vocabulary(model_file)
        self.memo = _Memo(self.v)
        self.literal = array("i", [self.v.byte_ids[b] for b in MARK.encode()]).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; empty for an empty one.

        A space becomes the mark and one is put before the text; a mark that the
        text has itself goes by bytes. Segments that no piece can cross are coded
        one by one, each by the stream.
        """
        if not text:
            return np.empty(0, np.int32)
        out, find = [], self.memo.__getitem__
        for i, part in enumerate((" " + text).split(MARK)):
            if i:
                out.append(self.literal)
            part = part.replace(" ", MARK)
            if self.v.cuts_at_mark:
                out.extend(map(find, self.v.segments(part)))
            else:
                out.append(array("i", encode_whole(self.v, part)).tobytes())
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: list[int] | np.ndarray) -> str:
        whole = b"".join(map(self.v.bytes_of.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        return whole[1:].decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def codec(model_file: str) -> Codec:
    """One codec per Python worker and model."""
    return Codec(model_file)


def _ids_column(found: list[np.ndarray | None]) -> pa.ListArray:
    sizes = np.fromiter((0 if x is None else len(x) for x in found), np.int64, len(found))
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    flat = np.concatenate([x for x in found if x is not None]) if any(x is not None for x in found) else np.empty(0, np.int32)
    gone = pa.array([x is None for x in found], pa.bool_()) if found else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=gone)


def encode(docs: DataFrame, text_col: str = "text", model_file: str = f"{TOKENIZERS}/{MODEL}") -> DataFrame:
    """``docs`` with ``ids`` (array of int) in place of the text; null text has null ids, an empty one none.

    A map over Arrow batches, no shuffle. Every executor needs the vocabulary file at ``model_file``.
    """
    kept = [c for c in docs.columns if c != text_col]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "ids array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(model_file).encode
        for batch in batches:
            found = [None if t is None else code(t) for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), _ids_column(found)], names=[*kept, "ids"])

    return docs.mapInArrow(run, schema)


def decode(coded: DataFrame, model_file: str = f"{TOKENIZERS}/{MODEL}") -> DataFrame:
    """``coded`` with ``text`` in place of ``ids``."""
    kept = [c for c in coded.columns if c != "ids"]
    schema = ", ".join([*(f"`{c}` {coded.schema[c].dataType.simpleString()}" for c in kept), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of = codec(model_file).decode
        for batch in batches:
            texts = [None if x is None else text_of(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, "text"])

    return coded.mapInArrow(run, schema)


def coded_and_checked(docs: DataFrame, model_file: str = f"{TOKENIZERS}/{MODEL}") -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids, round_trip (the ids decode to the text) of ``doc_id, text`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        is_byte = np.zeros(len(c.v.bytes_of), bool)
        is_byte[c.v.byte_ids] = True
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [None if t is None else c.encode(t) for t in texts]
            same = [None if t is None else c.decode(x) == t for t, x in zip(texts, found, strict=True)]
            sizes = [0 if x is None else len(x) for x in found]
            by_byte = [0 if x is None else int(is_byte[x].sum()) for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(by_byte, pa.int64()), _ids_column(found), pa.array(same, pa.bool_())],
                names=["doc_id", "n_tokens", "n_byte_tokens", "ids", "round_trip"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_byte_tokens long, ids array<int>, round_trip boolean")


def model_path(folder: str | None = None, name: str = MODEL) -> str:
    return os.path.join(folder or TOKENIZERS, name)


def query(docs: DataFrame) -> DataFrame:
    return coded_and_checked(view(docs, doc_id="doc_id", text="text"), model_path())

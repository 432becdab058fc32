"""Periodic runs against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from larder.llm import runs


def slow_runs(words):
    ids, out = {}, {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words], np.int64)
    for p in range(1, len(w) // 3 + 1):
        same = np.r_[False, w[p:] == w[:-p], False]
        ends = np.flatnonzero(same[1:] != same[:-1])
        for start, stop in zip(ends[::2].tolist(), ends[1::2].tolist(), strict=True):
            if stop + p - start >= max(24, 3 * p):
                out.setdefault((start, stop + p), p)
    return sorted((s, e - s, p) for (s, e), p in out.items())


def planted(rng, n):
    words = [rng.randrange(50) for _ in range(n)]
    for _ in range(rng.randrange(1, 4)):
        p, a, size = rng.randrange(1, 40), rng.randrange(n + 1), rng.randrange(200)
        for i in range(a + p, min(n, a + size)):
            words[i] = words[i - p]
    return words


def fibonacci(rng, n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def blocks(rng, n):
    words = []
    while len(words) < n:
        words += [rng.randrange(2) for _ in range(rng.randrange(1, 6))] * rng.randrange(1, 12)
    return words


KINDS = {"two letters": lambda rng, n: [rng.randrange(2) for _ in range(n)], "planted": planted, "fibonacci": fibonacci, "one word": lambda rng, n: [0] * n, "blocks": blocks}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("step", [None, 1, 7, 64])
def test_words_at_any_pace_give_all_runs(kind, step):
    rng = random.Random(kind)
    for _ in range(40):
        words = KINDS[kind](rng, rng.randrange(0, 260))
        catchers = runs.Catchers()
        for i in range(0, len(words), step or len(words) or 1):
            catchers.append(np.array(words[i : i + (step or len(words))], np.int64))
        assert catchers.runs() == slow_runs(words)


def test_equal_hashes_of_different_words(monkeypatch):
    """A base of 1 makes hashes of all blocks with the same words equal, in any order."""
    monkeypatch.setattr(runs, "_BASE", 1)
    monkeypatch.setattr(runs, "_INVERSE", 1)
    monkeypatch.setattr(runs._Powers, "up", np.ones(1, np.uint64))
    monkeypatch.setattr(runs._Powers, "down", np.ones(1, np.uint64))
    rng = random.Random(3)
    for _ in range(40):
        words = blocks(rng, 150)
        catchers = runs.Catchers()
        catchers.append(np.array(words, np.int64))
        assert catchers.runs() == slow_runs(words)


def test_a_long_text():
    words = np.arange(200_000)
    words[50_000:] = words[50_000 + np.arange(150_000) % 37_001]
    catchers = runs.Catchers()
    catchers.append(words)
    assert catchers.runs() == [(50_000, 150_000, 37_001)]
    catchers = runs.Catchers()
    catchers.append(np.zeros(200_000, np.int64))
    assert catchers.runs() == [(0, 200_000, 1)]


def slow_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = slow_runs(words)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = None
    for s, length, p in found:
        if best is None or length * best[2] > best[1] * p:
            best = s, length, p
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{length},{p}\n" for s, length, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_query(spark, odd_docs, odd_rows, no_docs):
    rng = random.Random(6)
    made = [(100 + i, " ".join(map(str, KINDS[kind](rng, rng.randrange(0, 200)))), "en", None, None) for i in range(30) for kind in KINDS]
    made = [(100 + i, *r[1:]) for i, r in enumerate(made)]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame([r[:2] for r in made], "doc_id long, text string")).repartition(4)
    got = sorted((tuple(r) for r in runs.query(docs).collect()), key=repr)
    want = sorted((slow_row(*r[:2]) for r in [*odd_rows, *made]), key=repr)
    assert got == want
    assert sum(r[1] > 0 for r in want) > 20
    assert runs.query(no_docs).collect() == []


def test_columns_and_collapsed_text(spark):
    text = "one two " + "a b c " * 9 + "end"
    docs = spark.createDataFrame([(1, text, "clash", "clash"), (2, None, None, None)], "doc_id long, text string, _runs string, _row string")
    found = {r.doc_id: r for r in runs.detect(docs).collect()}
    assert runs.detect(docs).columns == ["doc_id", "text", "_row", "_runs"]
    assert found[1]._runs.collapsed == "one two a b c end" and found[1]._row == "clash"
    assert [tuple(x) for x in found[1]._runs.runs] == [(2, 27, 3)]
    assert (found[2]._runs.n_words, found[2]._runs.runs, found[2]._runs.collapsed) == (0, [], "")

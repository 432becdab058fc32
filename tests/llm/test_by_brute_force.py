"""Operators that SQL cannot express, against plain Python."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from larder.llm import components, lines, markov, pieces, secrets, simhash, warc


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randrange(2000, 2600), rng.randrange(2000, 2600)) for _ in range(400)] + [(7, 7)]
    rng.shuffle(edges)
    want = {n: r for n, r in roots({x for e in edges for x in e}, edges).items() if n != r}
    got = components.components(spark.createDataFrame(edges, "a long, b long").repartition(6))
    assert {r.node: r.root for r in got.collect()} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_on_awkward_rows(odd_docs, odd_rows, no_docs):
    fps = {r[0]: slow_fingerprint(r[1]) for r in odd_rows}
    nodes = [d for d in fps if d is not None]
    edges = [(a, b) for a, b in itertools.combinations(nodes, 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    want = roots(nodes, edges)
    got = simhash.query(odd_docs).collect()
    assert len(got) == len(odd_rows)
    assert all(int(r.fingerprint, 16) == fps[r.doc_id] and len(r.fingerprint) == 16 for r in got)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert simhash.query(no_docs).collect() == []


@pytest.mark.parametrize("block", [simhash.KEY_BLOCK, 9])  # a key is one block, or is dealt out as pairs of blocks
def test_links_connect_all_near_fingerprints(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "KEY_BLOCK", block)
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    fps = {flip(centre, rng.randrange(0, 5)) for _ in range(400)} | {rng.getrandbits(64) for _ in range(300)}
    chain = [rng.getrandbits(64)]
    for _ in range(60):
        chain.append(flip(chain[-1], 3))
    fps = sorted(fps | set(chain))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = roots(signed, [(a, b) for (a, x), (b, y) in itertools.combinations(zip(signed, fps, strict=True), 2) if (x ^ y).bit_count() <= 3])
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    got = roots(signed, [(r.a, r.b) for r in found.collect()])
    assert got == want


def slow_lines(rows):
    first = {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        for i, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\n\x0b\x0c\r"):
                first.setdefault(line.strip(" \t\n\x0b\x0c\r"), (doc is None, doc, i))
    names = list(first)
    sets = [lines.shingles(x) for x in names]
    edges = [(i, j) for i, j in itertools.combinations(range(len(names)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    keep = {}
    for i, r in roots(range(len(names)), edges).items():
        keep[r] = min(keep.get(r, first[names[i]]), first[names[i]])
    out = collections.defaultdict(list)
    for _, doc, i in sorted(keep.values()):
        out[doc].append(i)
    return out


def test_lines_on_awkward_rows(odd_docs, odd_rows, no_docs):
    want = slow_lines([r[:2] for r in odd_rows if r[0] != 10])
    got = lines.query(odd_docs.where("doc_id IS NULL OR doc_id != 10")).collect()
    assert {r.doc_id: list(r.kept_lines) for r in got} == {r.doc_id: want[r.doc_id] for r in got}
    assert lines.query(no_docs).collect() == []


@pytest.mark.parametrize("block", [lines.BAND_BLOCK, 7])  # a band is one block, or is dealt out as pairs of blocks
def test_families_of_edited_lines(spark, monkeypatch, block):
    monkeypatch.setattr(lines, "BAND_BLOCK", block)
    rng = random.Random(3)
    rows = []
    for family in range(6):
        words = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(16 + 4 * family)]
        for _ in range(40):
            own = list(words)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = "".join(rng.choices("klmnop", k=5))
            rows.append((len(rows), " ".join(own)))
    want = slow_lines(rows)
    got = lines.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.n_kept} == set(want)


def whole_viterbi(v, text):
    best, back = [0] + [1 << 62] * len(text), [None] * (len(text) + 1)
    for i in range(len(text)):
        for n in range(1, min(v.longest, len(text) - i) + 1):
            found = v.cost.get(text[i : i + n])
            if found and best[i] + found[0] < best[i + n]:
                best[i + n], back[i + n] = best[i] + found[0], (i, (found[1],))
        if back[i + 1] is None:
            codes = text[i].encode()
            best[i + 1], back[i + 1] = best[i] + v.byte_cost * len(codes), (i, tuple(v.byte_ids[b] for b in codes))
    out, at = [], len(text)
    while at:
        at, ids = back[at]
        out[:0] = ids
    return out


def test_stream_equals_whole_viterbi():
    v, rng = pieces.Vocabulary(pieces.model_path()), random.Random(2)
    source = "The quick▁brown fox, über die Straße; 漢字 and\tnumbers 12345 internationalization" * 4
    for _ in range(60):
        text = "".join(rng.sample(source, rng.randrange(1, 200))) if rng.random() < 0.5 else source[rng.randrange(60) :][: rng.randrange(1, 240)].replace(" ", "")
        stream, got, at = pieces.Stream(v), [], 0
        while at < len(text):
            n = rng.randrange(1, 50)
            got += stream.feed(text[at : at + n])
            assert len(stream.text) <= 8 * v.longest
            at += n
        early = len(got)
        assert got + stream.end() == whole_viterbi(v, text)
        assert early or len(text) < 3 * v.longest


def test_ids_give_the_text_back(odd_docs, odd_rows, no_docs):
    got = pieces.query(odd_docs).collect()
    assert all(r.round_trip is not False for r in got)
    assert sum(r.ids is None for r in got) == sum(t[1] is None for t in odd_rows)
    back = pieces.decode(pieces.encode(odd_docs.select("doc_id", "text")))
    assert sorted(map(repr, (tuple(r) for r in back.collect()))) == sorted(repr(r[:2]) for r in odd_rows)
    assert pieces.query(no_docs).collect() == []


def test_archives_give_the_pages_back(spark):
    html = [None, "", "<p>a</p>", "<p>a</p>", "x" * 300_000, "Ünï\r\n\r\nWARC/1.1\r\n", "<p>a</p>", ""]
    rows = [(i, None if i == 2 else f"http://x/{i}\r\nX: y", h, "clash") for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    index = warc.archive(pages)
    got = {r.page_id: r for r in warc.read_records(index).collect()}
    last = {h or "": i for i, h in enumerate(html)}
    for i, h in enumerate(html):
        payload, r = (h or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), warc.sha1_base32(payload))
        assert (r.record_type, r.refers_to) == (("response", None) if last[h or ""] == i else ("revisit", last[h or ""]))
        assert r.payload == (payload if last[h or ""] == i else None)
    assert warc.query(pages.limit(0)).collect() == []


def test_one_stream_becomes_members(tmp_path):
    from pyarrow.fs import LocalFileSystem

    records = [warc.build_record(i, f"http://x/{i}", bytes([65 + i]) * (i * 700_000), None, "2024-01-01T00:00:00Z") for i in range(4)]
    packer = lambda data: (gz := zlib.compressobj(wbits=31)).compress(data) + gz.flush()
    (tmp_path / "one.warc.gz").write_bytes(packer(b"".join(records[:3])) + packer(records[3]))
    rows = list(warc.normalise_one(LocalFileSystem(), f"{tmp_path}/one.warc.gz", f"{tmp_path}/out.warc.gz"))
    whole = (tmp_path / "out.warc.gz").read_bytes()
    assert [zlib.decompress(whole[o : o + n], 31) for o, n, *_ in rows] == records
    assert len((tmp_path / "out.warc.gz.idx").read_text().splitlines()) == 4
    (tmp_path / "cut.warc.gz").write_bytes((tmp_path / "one.warc.gz").read_bytes()[:500])
    with pytest.raises(EOFError):
        list(warc.normalise_one(LocalFileSystem(), f"{tmp_path}/cut.warc.gz", f"{tmp_path}/bad.warc.gz"))


def test_forward_is_exact_and_training_helps():
    rng = np.random.default_rng(1)
    model = markov.Model(rng.dirichlet([1] * 3), rng.dirichlet([1] * 3, 3), rng.dirichlet([1] * 5, 3).T)
    sequences = [rng.integers(0, 5, n) for n in (1, 4, 2, 6)]
    for logs, seq in zip(markov.log_likelihoods(sequences, model), sequences, strict=True):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(seq)):
            p = model.start[path[0]] * model.emit[seq[0], path[0]]
            for a, b, x in zip(path[:-1], path[1:], seq[1:], strict=True):
                p *= model.move[a, b] * model.emit[x, b]
            total += p
        assert math.isclose(logs, math.log10(total), rel_tol=1e-9)
    sums = (np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)))
    markov.expected_counts(sequences, model, sums)
    assert np.isclose(sums[0].sum(), 4) and np.isclose(sums[1].sum(), 9, atol=1e-3) and np.isclose(sums[2].sum(), 13, atol=1e-3)
    better = markov.Model(sums[0] / sums[0].sum(), sums[1] / sums[1].sum(1, keepdims=True), sums[2] / sums[2].sum(0))
    assert markov.log_likelihoods(sequences, better).sum() > markov.log_likelihoods(sequences, model).sum()


def test_markov_counts(odd_docs, odd_rows, no_docs):
    tokens = [(r[0], [*(r[1] or "").encode().lower().split(), b""]) for r in odd_rows]
    trains = lambda d: d is None or zlib.crc32(str(d).encode()) % 5 != 1
    c = collections.Counter(w for d, words in tokens if trains(d) for w in words)
    n, v = sum(c.values()), len(c)
    got = markov.query(odd_docs).collect()
    assert len(got) == len(tokens)
    want = {d: (len(w), sum(x in c for x in w), sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for d, w in tokens}
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (*want[r.doc_id][:2], n, not trains(r.doc_id))
        assert math.isclose(r.base_score, want[r.doc_id][2], rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    assert markov.query(no_docs).collect() == []


def test_the_forest_tells_unseen_findings(spark):
    rng = random.Random(4)
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    rows = []
    for i in range(400):
        kind = i % 4
        text = {0: f'set token = "{hexes(40)}" now', 1: f"paid with {rng.randrange(10**15, 10**16)} at noon", 2: f"see build_config_update_index_{rng.randrange(99)} here", 3: f"found AKIA{''.join(rng.choices('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', k=16))}2 lately".replace("2 lately", " lately")}[kind]
        rows.append((i, text, "app/config" if kind == 0 else "docs/example"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    described = secrets.features(secrets.candidates(docs, docs["source"])).cache()
    truth = described.withColumn("label", (described.doc_id % 4).isin(0, 3).cast("double"))
    model = secrets.train(truth.where("doc_id % 10 < 5"))
    judged = secrets.judge(truth.where("doc_id % 10 >= 5"), model)
    right, total = judged.where("is_secret = (label = 1)").count(), judged.count()
    assert total >= 100 and right / total > 0.95


def test_secrets_on_awkward_rows(odd_docs, no_docs):
    assert all(not r.is_secret for r in secrets.query(odd_docs).collect())
    assert secrets.query(no_docs).collect() == []


def test_no_two_records_share_an_id(spark):
    rows = [(i % 7 or None, f"http://x/{i % 3}" if i % 4 else None, f"<p>{i % 5}</p>") for i in range(60)] + [(7, "http://x/0", "<p>1</p>")] * 20
    index = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4))
    assert index.select("record_id").distinct().count() == index.count() == len(rows)
    found = {(r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(index).collect()}
    last = {}
    for page, _, html in rows:
        last[html] = max(last.get(html, 0), page or 0)
    assert found == {(p, warc.sha1_base32(h.encode()), *(("revisit", last[h]) if p and p < last[h] else ("response", None))) for p, _, h in rows}

"""Lines of repeating content are as like as their sets of shingles, whatever their lengths."""

import itertools

import pytest

from larder.llm import lines

PAIRS = [("=" * 100, "=" * 200), ("-" * 80, "-" * 180), (". " * 50, ". " * 100), ("ha " * 35, "ha " * 70)]


@pytest.mark.parametrize("short,long", PAIRS)
def test_a_repeating_line_meets_its_longer_copy(spark, short, long):
    assert lines.shingles(short.strip()) == lines.shingles(long.strip()) or short.strip() != short
    got = lines.query(spark.createDataFrame([(1, short), (2, long)], "doc_id long, text string")).collect()
    assert {r.doc_id: list(r.kept_lines) for r in got} == {1: [0], 2: []}


def test_like_lines_share_a_kind():
    texts = [x.strip() for pair in PAIRS for x in pair] + ["".join(chr(65 + i * k % 57) for i in range(n)) * m for n in (90, 118, 150, 165) for k in (1, 5) for m in (1, 2, 3)]
    hashes, counts = lines._shingle_hashes(texts)
    few = lines._few_distinct(hashes, counts)
    sets = [lines.shingles(x) for x in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= lines.SIMILARITY * len(sets[i] | sets[j]):
            assert (few[i] and few[j]) or min(counts[i], counts[j]) >= lines.SHORT
    assert [bool(f) for f in few] == [len(x) <= lines.LONG for x in sets]

"""Sets of shingles are built only for lines whose sketches let them pass, and no similar pair is refused."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from larder.llm import lines


def family(alphabet, seed):
    """Near copies of a line, its double, short lines and lines that end in the character that fills gaps."""
    rng = random.Random(seed)
    base = [rng.choice(alphabet) for _ in range(rng.randrange(1, 200))]
    found = ["".join(base), "".join(base) * 2, "".join(base[:5]), "".join(base[:6]) + "\0", "".join(base[:3]) + "\0\0"]
    for _ in range(12):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = rng.choice(alphabet)
        found.append("".join(copy)[rng.randrange(5) :] or "q")
    return found


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh \0", ["a", "\0", "\ud800", *map(chr, range(0x4E00, 0x5200))]])
def test_numbers_stand_for_shingles_and_no_similar_pair_is_refused(alphabet):
    for seed in range(12):
        texts = family(alphabet, seed)
        sets, numbers = [lines.shingles(x) for x in texts], [set(x.tolist()) for x in lines.shingle_sets(texts)]
        bits, counts = lines.sketches(texts)
        for i, j in itertools.product(range(len(texts)), repeat=2):
            common = len(sets[i] & sets[j])
            assert (len(numbers[i]), len(numbers[i] & numbers[j])) == (len(sets[i]), common)
            if common >= lines.SIMILARITY * len(sets[i] | sets[j]):
                assert lines.may_be_similar(bits[i], counts[i], bits[[j]], counts[[j]])[0]


@pytest.fixture
def counted(monkeypatch):
    """How many lines get sets."""
    seen, real = [], lines.shingle_sets

    def count(texts):
        seen.extend(texts)
        return real(texts)

    monkeypatch.setattr(lines, "shingle_sets", count)
    return seen


def unlike(n):
    rng = random.Random(n)
    return ["".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randrange(60, 300))) for _ in range(n)]


def test_unlike_pairs_get_no_sets(counted):
    left, right = unlike(300), unlike(301)[1:]
    right[7] = left[7] + "x"
    batch = pa.record_batch({"a": list(range(300)), "b": list(range(300, 600)), "left": left, "right": right})
    got = [tuple(x.values()) for b in lines._similar(iter([batch, batch.slice(0, 0)])) for x in b.to_pylist()]
    assert got == [(7, 307)] and counted == [left[7], right[7]]


def test_unlike_lines_of_bands_get_no_sets(counted):
    texts = unlike(40)
    texts[33] = texts[21][1:]
    ids, roots, sides = np.arange(100, 140), np.arange(40), np.zeros(40, bool)
    got = lines._more_links(ids, texts, roots, sides, [0, 20])
    assert {frozenset(x) for x in got} == {frozenset((121, 133))} and counted == [texts[21], texts[33]]
    counted.clear()
    assert lines._more_links(ids, texts, roots, np.arange(40) >= 34, [0, 20]) == [] == counted  # pairs inside one block have their own task
    assert lines._more_links(ids, texts, roots, sides, [0, 30]) == [] == counted  # other bands

"""Near copies are dropped row by row, whatever their ids."""

import collections

from larder.llm import simhash

A, B, C, D, E = (" ".join(f"{w}{i}" for i in range(40)) for w in ("stone", "light", "tide", "quiet", "harbour"))


def test_one_row_of_each_component_stays(spark):
    rows = [
        (None, A), (None, A), (None, A), (2, A),  # copies without an id beside one with an id
        (None, B), (None, B),  # copies that all lack an id
        (3, C), (3, C), (9, C),  # the smallest id is repeated
        (1, D), (5, D), (5, E),  # one id with two texts, one of them in an older component
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    left = collections.Counter((r.doc_id, r.text) for r in simhash.keep_one(docs).collect())
    assert left == collections.Counter([(2, A), (None, B), (3, C), (1, D), (5, E)])

"""Lines of rows without an id, or with an id of several texts, are judged row by row."""

import collections
import random

from larder.llm import lines

LINE = "the quiet harbour waits {} under the morning light for boats that walked slowly"
UNLIKE = ("seven grey stones counted twice before noon", "a ledger of debts nobody meant to settle", "copper wire wound round an oak drum", "glass beads poured into a paper cone")


def test_rows_without_an_id_of_their_own(spark):
    shared = LINE.format("here")
    rows = [
        (1, shared), (None, LINE.format("her")), (None, UNLIKE[0]), (None, UNLIKE[0]), (None, UNLIKE[1] + "\n" + shared),
        (7, UNLIKE[2] + "\n" + shared), (7, shared + "\n" + UNLIKE[3]), (7, UNLIKE[2]), (None, None), (7, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = lines.drop_repeated_lines(docs).collect()
    kept = collections.Counter((r.doc_id, x) for r in left for x in r.text.split("\n"))
    assert kept == collections.Counter([(1, shared), (None, UNLIKE[0]), (None, UNLIKE[1]), (7, UNLIKE[2]), (7, UNLIKE[3])])
    got = lines.query(docs).collect()
    assert len(got) == len(rows) and sum(r.n_kept for r in got) == 5


def test_repeated_rows_are_one_document(spark):
    docs = spark.createDataFrame([(3, UNLIKE[0]), (3, UNLIKE[0]), (3, UNLIKE[1]), (4, UNLIKE[1])], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_kept) for r in lines.query(docs).collect()) == [(3, 1), (3, 1), (3, 1), (4, 0)]


def test_ids_of_text(spark):
    docs = spark.createDataFrame([("b", UNLIKE[0]), ("a", UNLIKE[0] + "\n" + UNLIKE[1]), (None, UNLIKE[1]), ("a", UNLIKE[2])], "doc_id string, text string")
    got = lines.query(docs.repartition(3)).collect()
    assert sorted((r.doc_id or "", r.n_lines, list(r.kept_lines)) for r in got) == [("", 1, []), ("a", 1, [0]), ("a", 2, [0, 1]), ("b", 1, [])]


def test_the_hub_search_remembers_one_row(spark):
    """Keys that go on over many Arrow batches give what whole groups give."""
    rng = random.Random(2)
    rows = [(rng.randrange(60), i) for i in range(400)] + [(1000, i) for i in range(300)] + [(2000 + i, i) for i in range(50)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = lines.shared_bands(spark.createDataFrame(rows, "key long, id long").repartition(4)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = collections.defaultdict(list)
    for key, i in rows:
        groups[key].append(i)
    assert sorted(tuple(r) for r in got) == sorted((key, i, min(ids)) for key, ids in groups.items() if len(ids) > 1 for i in ids)

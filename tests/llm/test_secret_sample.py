"""The training sample holds both labels, whatever the mix and however often a finding is copied."""

import random

from larder.llm import secrets


def described(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return secrets.features(secrets.candidates(docs, docs["source"]))


def test_few_secrets_and_many_copies_still_train(spark):
    rng = random.Random(6)
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    rows = [(i, f'set token = "{hexes(40)}" now', "app/config") for i in range(4)]
    rows += [(10 + i, f"paid with {rng.randrange(10**15, 10**16)} at noon", "docs") for i in range(400)]
    rows += [(1000 + i, "paid with 1234509876123450 at noon", "docs") for i in range(3000)]
    marked = secrets.labelled(described(spark, rows))
    assert {r.label: r["count"] for r in marked.groupBy("label").count().collect()}[1.0] == 4
    model = secrets.train(marked, rows=40)  # 40 of 3,404 rows: by hash alone a secret among them is unlikely
    assert model is not None
    found = secrets.judge(marked, model).where("is_secret").select("doc_id").collect()
    assert {r.doc_id for r in found} == {0, 1, 2, 3}

"""Planted secrets are counted against the documents, not against the candidates found."""

import random

from larder.llm import secrets

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def test_no_planted_secret_is_lost_before_the_forest(spark):
    rng = random.Random(8)
    pick = lambda chars, n: "".join(rng.choices(chars, k=n))
    planted = []
    for i in range(120):
        kind = i % 6
        secret = (
            "AKIA" + pick(LETTERS, 16), "sk_live_" + pick(LETTERS.lower(), 24), "xoxb-" + pick(LETTERS.lower(), 10),
            pick("bcdfghjk", 5) + str(rng.randrange(10, 99)), pick("mnpqrstv", 6) + str(rng.randrange(9)), pick("ghjkmnpq", 9),
        )[kind]
        planted.append((i, ("found {} lately", "uses {} now", "sent ({}) off", "set password={} there", "token: {} given", 'with secret = "{}" then')[kind].format(secret), secret))
    docs = spark.createDataFrame([(i, text, "app/config") for i, text, _ in planted], "doc_id long, text string, source string")
    found = {(r.doc_id, r.candidate) for r in secrets.candidates(docs, docs["source"]).collect()}
    assert [(i, s) for i, _, s in planted if (i, s) not in found] == []


def test_short_and_letter_only_secrets_are_told_from_prose(spark):
    rng = random.Random(12)
    pick = lambda chars, n: "".join(rng.choices(chars, k=n))
    rows, truth = [], set()
    for i in range(300):
        secret = ("AKIA" + pick(LETTERS, 16), pick("bcdfghjk", 5) + str(rng.randrange(10, 99)), "sample_of_words_and_page_" + str(i))[i % 3]
        rows.append((i, ("found {} lately", "set password={} there", "see {} and note: nothing follows here")[i % 3].format(secret), "app/config"))
        truth |= {i} if i % 3 != 2 else set()
    judged = secrets.query(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    told = {r.doc_id for r in judged.where("is_secret").collect()}
    assert len(truth - told) <= 4 and not told - truth

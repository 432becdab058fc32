"""Operators that SQL can express, on awkward rows."""

import duckdb
import pyarrow as pa
import pytest

from larder.llm import exact, mixing, quality, urls


def plain(row):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in row)


def same(df, sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted((plain(r) for r in df.select(*names).collect()), key=repr)
    assert got == sorted((plain(r) for r in res.fetchall()), key=repr)


def documents(rows):
    names = ("doc_id", "text", "lang", "source", "n_chars")
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


@pytest.mark.parametrize("module", [quality, exact, mixing])
def test_awkward_rows(odd_docs, odd_rows, module):
    rows = odd_rows
    if module is mixing:  # the twin joins by id, so that repeated rows would multiply there
        rows = [r for i, r in enumerate(odd_rows) if r not in odd_rows[:i]]
        odd_docs = odd_docs.distinct()
    if module is exact:
        rows = [r for r in odd_rows if r[0] is not None]
        odd_docs = odd_docs.where("doc_id IS NOT NULL")
    same(module.query(odd_docs), module.SQL, documents=documents(rows))


@pytest.mark.parametrize("module", [quality, exact, mixing])
def test_no_rows(no_docs, module):
    assert module.query(no_docs).collect() == []


def test_a_null_id_goes_last(spark):
    rows = exact.query(spark.createDataFrame([(None, "x y"), (3, "x  y"), (None, "alone")], "doc_id long, text string")).collect()
    assert sorted((r.group_size, r.kept, repr(r.doc_id), repr(r.keep_id)) for r in rows) == [(1, True, "None", "None"), (2, False, "None", "3"), (2, True, "3", "3")]


def test_chunks_join_to_the_text_and_a_change_stays_local(spark, odd_rows):
    text = max((r[1] or "" for r in odd_rows), key=len)
    changed = text[:9000] + "inserted words. " + text[9000:]
    rows = spark.createDataFrame([(1, text), (2, changed)], "doc_id long, text string")
    cut = {r.doc_id: r.c for r in rows.select("doc_id", exact.chunks_of(exact.normalised(rows.text)).alias("c")).collect()}
    assert "".join(cut[1]) == " ".join(text.split())
    assert max(map(len, cut[1])) <= exact.MAX_CHUNK
    assert len(set(cut[2]) - set(cut[1])) <= 3


def test_urls(spark):
    found = [
        None, "", "no scheme", "http://", "http://a.com", "http://A.COM/", "https://example.com/en/x?y=/z", "https://www.example.com/en/", "https://sub.www.example.com/en/a#b",
        "http://x.net/es/1", "http://net/fr/", "http://x.net/esx", "ftp://x.org?q=porn", "http://x.org/Free-Casino", "http://x.org/free", "http://x.org/freedom-casinos", "http://x.org/mypornhubclone",
        "http://notcom/", "a://b://c.com/", "http://x.org/cheap/cheap", "http://x.org/" + "path/" * 3000 + "xxx",
    ]
    rows = [(i, u, None) for i, u in enumerate(found)]
    same(urls.query(spark.createDataFrame(rows, "page_id long, url string, html string")), urls.SQL, pages=pa.table({"page_id": pa.array(range(len(found))), "url": pa.array(found, pa.string())}))
    assert urls.query(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_a_rule_table_becomes_one_projection(odd_docs):
    judged = quality.judge(odd_docs, (quality.Rule("short", "n_words", 5, None), quality.Rule("symbols", "symbol_ratio", None, 0.5)))
    assert "Exchange" not in judged._jdf.queryExecution().executedPlan().toString()
    broken = {r.doc_id: r._broken for r in judged.collect()}
    assert broken[3] == ["short"] and broken[12] == ["symbols"] and broken[5] == []


def test_mix_comes_near_its_targets(spark):
    rows = [(i, "w " * (1 + i % 9), f"s{min(i % 7, 3)}") for i in range(4000)]
    out = mixing.query(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in out.groupBy("source_size", "target").sum("taken").collect():
        assert abs(r["sum(taken)"] - r.target) <= 9
    assert out.where("taken > 3 * size").isEmpty()


def test_mix_comes_near_its_targets_without_ids_of_their_own(spark):
    """A source whose rows share an id, one with a third of null ids, one that repeats one row."""
    rows = [(1, f"{i} " * (1 + i % 9), "one id") for i in range(2000)]
    rows += [(None if i % 3 == 0 else i, f"{i} " * (1 + i % 9), "a") for i in range(2000)]
    rows += [(7, "same row again", "repeated")] * 2000 + [(i, "w " * 5, None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = mixing.query(docs).collect()
    assert sorted(map(plain, out), key=repr) == sorted(map(plain, mixing.query(docs.repartition(3)).collect()), key=repr)
    by = {}
    for r in out:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert len(by) == 4 and all(abs(sum(taken) - target) <= 9 for (_, target), taken in by.items())
    table = pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate((("doc_id", pa.int64()), ("text", pa.string()), ("source", pa.string())))})
    same(mixing.query(docs), mixing.SQL, documents=table)


def test_clean_texts_without_listed_words(spark):
    """Short texts, other languages and other scripts are not judged by stop words they cannot have; junk is."""
    russian = "В гавани утром было тихо и лодки долго стояли под туманом который не рассеялся пока солнце высоко поднялось над старым городом рыбаки чинили сети ждали прилива говорили про цены рыбу погоду детей школу новую дорогу через лес"
    finnish = "satama oli hiljainen aamulla ja veneet seisoivat sumussa joka ei hälvennyt ennen kuin aurinko nousi korkealle vanhan kaupungin ylle kalastajat korjasivat verkkoja odottivat vuorovettä puhuivat hinnoista kalasta säästä lapsista koulusta"
    junk = " ".join(f"zq{i}x" for i in range(60))
    rows = [(1, russian, None), (2, finnish, "fi"), (3, "zq1 zq2 zq3 zq4 zq5 zq6 zq7 zq8 zq9 zq10 zq11 zq12", "en"), (4, junk, None), (5, junk, "en"), (6, "AB\u00a0cd " * 3 + "the quick one of them and the other is in a far far away land", "en"), (7, russian, "ru")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality.query(docs).collect()}
    assert kept == {1: True, 2: True, 3: True, 4: False, 5: False, 6: True, 7: True}
    assert {r.doc_id for r in quality.filter_documents(docs).collect()} == {1, 2, 3, 6, 7}
    table = pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate((("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string())))})
    same(quality.query(docs), quality.SQL, documents=table)
    assert quality.query(docs.drop("lang")).count() == len(rows)

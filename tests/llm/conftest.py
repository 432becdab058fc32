import pytest

WORDS = "the of and river stone light under morning walked slowly toward a quiet harbour where boats were waiting for evening tide".split()


def prose(start, n):
    return " ".join(WORDS[(start * 7 + i * (1 + start % 3)) % len(WORDS)] for i in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, copies, repeated rows, ties, one very long text, other white space and scripts."""
    long = "\n".join(prose(i, 40) + f" number {i}" for i in range(600))
    texts = [
        None, "", "   \n\t ", "one", "two words", prose(1, 60), prose(1, 60), prose(1, 60).replace(" ", "\n"), prose(2, 80) + "\u00a0end", long, long + " tail",
        "same line here today\n" * 6, "!!! ### $$$ %%% &&& *** | < > " * 4, "Ünï cödé TEXT " * 9, "a b c d e a b c d e " * 10, prose(3, 30) + "\x0bx\x0cy\r\nz", "▁ marks ▁▁ and 漢字 😀 \x00 tab\tend ",
    ]
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, prose(4, 50), None, "s1", 3)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(odd_rows, schema)
    inside = "words line id key size fp token h root path _row _text _words _quality _kept _broken _lines _doc _own _mix _copy _drop".split()
    for name in inside:  # names that operators use inside
        docs = docs.selectExpr("*", f"'clash' AS {name}")
    return docs


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")

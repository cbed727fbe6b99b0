"""Documents with every awkward case: nulls, blanks, repeats, ties, long texts and clashing column names."""

import random

import pytest

SF = "/root/testdata/sf0.001"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward() -> list[tuple]:
    base, line = prose(1, 200), prose(2, 60)
    words = base.split()
    near = " ".join(words[:100] + ["changed"] + words[101:])
    texts = [
        None, "", "   \n\t ", "one", "one two three four", base, base, near, base.upper(), line + "\n" + prose(3, 50), prose(4, 30) + "\n" + line,
        "héé ñandú straße " * 30, "a" * 300, "a" * 300, "x " * 40, prose(5, 30_000), "日本語 " * 20 + line, " tab\x0bvt\x85nel  nb", "😀" * 60, "1234567890 !?",
    ]
    rows = [(i * 3, t, "en" if i % 2 else None, None if i % 3 else "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[9], (None, "no id " + line, "en", "s", None)]


CLASH = ("block", "bucket", "h", "h2", "shard", "ids", "rep", "part", "guest", "next", "sketch", "keys", "spans", "token", "n", "v", "c", "g", "u", "salt", "page_id")
DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(*r, *("x" for _ in CLASH)) for r in awkward()], DDL + "".join(f", {c} string" for c in CLASH)).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.filter("false")


@pytest.fixture(scope="session")
def rows():
    return awkward()


@pytest.fixture(scope="session")
def table(spark):
    """The whole small documents table, as Spark and as a list."""
    t = spark.read.parquet(f"{SF}/documents.parquet")
    return t, [(r.doc_id, r.text) for r in t.select("doc_id", "text").collect()]

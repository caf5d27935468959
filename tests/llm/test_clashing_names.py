"""Columns of the input may bear any name the operators return or use on the way."""

import pytest
from pyspark.sql import functions as F

from channel_signals.llm.mixing import mix
from channel_signals.llm.quality import quality
from channel_signals.llm.queries import URL_RULES
from channel_signals.llm.secrets import find_secrets
from channel_signals.llm.url_filter import url_verdicts

INNER = ["_s", "_n", "_rank", "_part", "_in", "_size", "_ahead", "_q", "_key", "_ruled", "_block", "w0", "w3", "extra",
         "times", "n", "most", "total", "row", "judged", "found", "a.b", "odd`name"]
TEXTS = ["good prose of a few words, and more of it.", "buy!! buy!! now | now |", None, "", 'token = "0123456789abcdefgh"']


def dressed(df, returned, upper):
    """`df` with a column of every inner and returned name, some of them in capitals."""
    names = [n.upper() if upper else n for n in [*INNER, *returned]]
    return df.select("*", *[F.lit(f"kept {n}").alias(n) for n in names])


def check(run, df, returned, upper):
    plain = run(df)
    got = run(dressed(df, returned, upper))
    low = [c.lower() for c in got.columns]
    assert len(set(low)) == len(low)
    assert set(low) == {c.lower() for c in [*plain.columns, *INNER]}
    want = sorted(map(repr, plain.collect()))
    columns = [F.col(c) for c in plain.columns]
    assert sorted(map(repr, got.select(*columns).collect())) == want
    for name in INNER:
        name = name.upper() if upper else name
        own = got.columns[low.index(name.lower())].replace("`", "``")
        assert {r[0] for r in got.select(f"`{own}`").collect()} == {f"kept {name}"}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate(TEXTS * 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("upper", [False, True])
@pytest.mark.parametrize("run,returned", [
    (quality, ["votes", "posterior", "score", "kept"]),
    (find_secrets, ["n_assign", "n_access", "n_hex", "n_grammar", "base_sha256", "spans", "clean_text"]),
    (mix, ["size", "source_size", "target", "copies", "taken"]),
])
def test_documents(docs, run, returned, upper):
    check(run, docs, returned, upper)


@pytest.mark.parametrize("upper", [False, True])
def test_urls(spark, upper):
    urls = ["http://a.example.com/en/x", "https://b.net/es/", "http://c.org/list.html", None, "none"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = pages.where("page_id = 2")
    check(lambda df: url_verdicts(df, listed, URL_RULES), pages,
          ["host", "path", "rule", "verdict", "possible", "listed"], upper)

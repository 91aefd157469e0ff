"""Pages that share a URL, and titles cut inside a reference: queries against their SQL."""

from __future__ import annotations

import duckdb
import pytest

from tests.test_queries import rows
from webstrata.plans import rows as registry

TITLES = ("a &amp; b", "cut &amp", "&amp;lt x", "&lt&gt;&quot", "no reference & none")


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("repeated"))
    pages = [(k, f"http://h{k % 7}.example.com/en/{k % 11}", f"<html><head><title>{TITLES[k % len(TITLES)]}</title></head><body>{k}</body></html>") for k in range(120)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    return root


@pytest.mark.parametrize("name", ["compacted_documents", "html_title", "ingested_captures", "upserted_documents"])
def test_repeated_urls(spark, repeated, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{repeated}/pages.parquet/*.parquet'").fetchall()
    want = con.execute(registry.SQL[name]).fetchdf()
    assert rows(registry.QUERIES[name](spark, repeated).toPandas()) == rows(want)


def test_words_whose_signs_cancel_out_have_a_vector_of_unit_length(spark, tmp_path):
    texts = ["w7 w100", "w100 w7 w7 w100", " ", "  \x1f", "a", "", " ", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'").fetchall()
    want = con.execute(registry.SQL["embedded_documents"]).fetchdf()
    assert rows(registry.QUERIES["embedded_documents"](spark, str(tmp_path)).toPandas()) == rows(want)
    assert sorted(want["norm"]) == [0.0] * 4 + [1.0] * 3

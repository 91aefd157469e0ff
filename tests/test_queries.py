"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from webstrata.plans import rows as registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    def cell(x):
        if x is None or x != x:
            return ""
        return str(round(float(x), 6)) if isinstance(x, int | float) or hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x)

    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        if frame[c].dtype.kind == "M":
            frame = frame.assign(**{c: frame[c].astype("datetime64[us]").astype(str)})
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name not in registry.SQL:
        assert len(got)
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'").fetchall()
    want = con.execute(registry.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5 and set(entry.oracle_sql()) <= set(entry.queries())

"""Helpers shared by the operators: shared-folder tables and Arrow slices."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.sources.shared import discard, materialize, shared_dir

__all__ = ["WORD", "discard", "hashed_sample", "materialize", "shared_dir", "sized", "slices"]

#: White space that separates words in every contract here: space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


def hashed_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df``, all if there are no more: those whose key's hash is small enough.

    The bound on the hash follows from the number of rows, so tasks filter on their own and what is
    gathered is bounded however many tasks there are.  ``limit`` only cuts where one key repeats.
    """
    total = df.count()
    if total <= rows:
        return df
    bound = max(1, (1 << 31) * rows // total)
    return df.filter(F.pmod(F.xxhash64(key), F.lit(1 << 31)) < bound).limit(2 * rows)


def sized(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """The smaller side of a join, a few columns wide: broadcast if it has ``rows`` rows at most, else merged by key."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a worker never holds more than ``rows`` texts as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)

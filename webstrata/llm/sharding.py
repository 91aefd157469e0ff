"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A row's shard follows from its key and the number of shards alone: no ring table, and one more
shard takes rows only into itself.  Only keys, sizes and checksums are shuffled, never texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the published algorithm: the multiplier of its generator.
LCG = np.uint64(2862933555777941757)
#: Bytes counted for a row besides its text.
ROW_OVERHEAD = 16


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key, for all keys at once."""
    key = keys.astype(np.uint64).copy()
    shard = np.zeros(len(key), np.int64)
    jump = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        shard[live] = jump[live]
        with np.errstate(over="ignore"):
            key[live] = key[live] * LCG + np.uint64(1)
        scale = float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        jump[live] = ((shard[live] + 1) * scale).astype(np.int64)
        live = live[jump[live] < shards]
    return shard


def _md5_bits(key: Column, first: int, digits: int) -> Column:
    """``digits`` hexadecimal digits of the key's MD5 as a signed long."""
    return F.conv(F.substring(F.md5(key), first, digits), 16, -10).cast("long")


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a text key; its 64-bit hash is the first half of its MD5."""

    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return place(_md5_bits(key, 1, 16))


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = 100_000) -> DataFrame:
    """Place every row in a shard and number the rows of each shard from 0 without gaps.

    Returns doc_id, size, text_crc32, law ('key'), shard, slot, grown_shard (with one more shard).

    Slots: equal rows (key, size, checksum) are counted first.  A shard's distinct rows fall into
    cells by a hash of all three, so many that a cell holds about ``cell_rows`` rows of an even table;
    each is numbered on its own and starts after the rows of the cells before it, so no task holds a
    whole shard, nor all rows of a key that repeats.  A cell's rows go by key, size and checksum.

    Null text counts as no bytes (size 16, checksum 0).  A null key is hashed like an empty one.
    Repeated rows get a slot each.  An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        key.alias("key"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    cells = max(256, docs.count() // (shards * cell_rows))
    same = rows.groupBy("doc_id", "key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    placed = same.select(
        "doc_id", "size", "text_crc32", "n",
        jump_shard(F.col("key"), shards).alias("shard"),
        jump_shard(F.col("key"), shards + 1).alias("grown_shard"),
        F.pmod(_md5_bits(F.concat_ws(":", "key", "size", "text_crc32"), 17, 8), F.lit(cells)).cast("int").alias("cell"),
    )
    counts = placed.groupBy("shard", "cell").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    in_cell = Window.partitionBy("shard", "cell").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("start") + F.coalesce(F.sum("n").over(in_cell), F.lit(0))
    return (
        placed.join(starts, ["shard", "cell"])
        .withColumn("first", first)
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"), "grown_shard")
    )

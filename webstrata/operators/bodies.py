"""A store of clean bodies by their hash: what was normalized once is looked up, not normalized again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions.values import bit_at

BODIES = "content_sha256 string, kind string, clean string, prefix string"
#: Hex digits of a hash that number its bit: 2^24 bits, which fill 512 bitmaps of 4 KB at most.
DIGITS = 6


def _place(sha: str) -> Column:
    return F.conv(F.substring(sha, 1, DIGITS), 16, 10).cast("long") + 1


def hash_filter(keys: DataFrame) -> DataFrame:
    """A filter of hashes: bucket, bitmap. Two megabytes at most, whatever the number of keys."""
    place = _place("content_sha256")
    return keys.groupBy(F.bitmap_bucket_number(place).alias("filter_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("filter_bits"))


def known_bodies(spark: SparkSession, root: str, keys: DataFrame) -> DataFrame:
    """Stored bodies (content_sha256, kind, clean) of the keys (content_sha256, kind).

    Folders are named by the first two digits of a hash, those that no key begins with aren't read.  A
    row goes into the join only if its hash's bit is set in the keys' filter, so nearly only rows with a key are
    shuffled.  A body that two batches stored at once counts once: equal hashes have equal bodies.
    """
    stored = spark.read.schema(BODIES).option("basePath", root).parquet(root)
    prefixes = [r["p"] for r in keys.select(F.substring("content_sha256", 1, 2).alias("p")).distinct().collect()]  # 256 at most
    place = _place("content_sha256")
    near = stored.filter(F.col("prefix").isin(prefixes)).withColumn("filter_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(hash_filter(keys)), "filter_bucket")
    near = near.filter(bit_at("filter_bits", F.bitmap_bit_position(place)))
    return near.join(keys.select("content_sha256", "kind"), ["content_sha256", "kind"]).select("content_sha256", "kind", "clean").dropDuplicates(["content_sha256", "kind"])


def store_bodies(clean: DataFrame, root: str) -> None:
    """Append clean bodies (content_sha256, kind, clean), ordered by hash within a folder's files."""
    rows = clean.select("content_sha256", "kind", "clean", F.substring("content_sha256", 1, 2).alias("prefix"))
    rows.repartition("prefix").sortWithinPartitions("prefix", "content_sha256").write.mode("append").partitionBy("prefix").parquet(root)

"""Continuous ingest and counts with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from webstrata.operators.documents import chunk_documents, derive_documents, new_by_id, normalize_documents
from webstrata.operators.sinks import _exists, quarantine, store_exists, stored_like, upsert_documents
from webstrata.sources.captures import route_formats
from webstrata.sources.shared import discard, materialize


def stream_items(spark: SparkSession, directory: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of raw items, one a line, from files that arrive in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(directory)


def ingest(items: DataFrame, root: str, checkpoint: str, rejects: str, as_of: Column, buckets: int = 16, bodies: str | None = None) -> StreamingQuery:
    """Tier 1: parse, derive, drop what is stored, normalize, log, upsert; rejects go to a side table.

    The new documents of a batch are written once, to ``<checkpoint>/log/batch=<n>``, and appended to
    the store from there as one delta.  A batch that is run again after a failure takes what its log has, and
    is not appended twice.  ``bodies`` names a store of clean bodies, so that one that came in an earlier
    batch isn't normalized again.  Tier 2 reads the log.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark, log = df.sparkSession, f"{checkpoint}/log/batch={number}"
        good, bad = route_formats(df, as_of)
        if not _exists(df, f"{log}/_SUCCESS"):
            exchanges = materialize(good, "exchanges")  # short plans: each step reads what the one before wrote
            docs = derived = materialize(derive_documents(exchanges, as_of), "derived")
            if store_exists(spark, root):
                docs = new_by_id(docs, stored_like(docs, root, buckets))
            normalize_documents(docs, bodies).write.mode("overwrite").parquet(log)
            for done in (exchanges, derived):
                discard(done)
        upsert_documents(spark.read.parquet(log), root, buckets, (checkpoint, number))
        if not _exists(df, f"{rejects}/batch={number}/_SUCCESS"):
            quarantine(bad, f"{rejects}/batch={number}", as_of)

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start()


def ingest_chunks(spark: SparkSession, log: str, schema, chunks: str, checkpoint: str, kind: Column) -> StreamingQuery:
    """Tier 2, optional: content rows of tier 1's log become chunks, with a checkpoint of its own.

    The log only grows, so each row is chunked once.
    """
    rows = spark.readStream.schema(schema).parquet(log).filter("doc_type = 'content'").withColumn("doc_type", kind)

    def batch(df: DataFrame, number: int) -> None:
        chunk_documents(df).write.mode("overwrite").parquet(f"{chunks}/batch={number}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(docs: DataFrame, horizon: str = "1 day") -> DataFrame:
    """Stream dedupe by id within a horizon; beyond it the join against the corpus decides."""
    return docs.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["doc_id"])


TYPED = "version int, url string, content_sha256 string, ts timestamp"


NO_TIME = -(2**63)  # stands for a null time among microseconds; no timestamp reaches it


class _NewTyped(StatefulProcessor):
    """For one version and URL: the hashes and the times (microseconds) that were seen, a block or more for each batch that had new ones."""

    def __init__(self, ttl_ms: int | None, block: int = 4096):
        self.ttl_ms, self.block = ttl_ms, block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "hashes array<string>, times array<bigint>", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Rows of a batch are told apart from what earlier batches held; among themselves they all count as new."""
        hashes, times, kept = set(), set(), []
        for h, t in self.seen.get():
            hashes.update(h)
            times.update(t)
        more_hashes, more_times = set(), set()
        for frame in rows:
            new = [h not in hashes and t not in times for h, t in zip(frame["content_sha256"], frame["ts"], strict=True)]
            if any(new):
                kept.append(frame[new])
                more_hashes.update(h for h in kept[-1]["content_sha256"] if isinstance(h, str) and h)
                more_times.update(kept[-1]["ts"].tolist())
        h, t, n = list(more_hashes), list(more_times - {NO_TIME}), self.block
        blocks = [(h[k : k + n], t[k : k + n]) for k in range(0, max(len(h), len(t)), n)]
        if blocks:
            self.seen.appendList(blocks)
        yield from kept

    def close(self) -> None:
        pass


def new_typed_stream(docs: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Stream form of ``documents.new_typed``: rows with neither the hash nor the time of an earlier row of the same version and URL.

    State is a list of blocks for each (version, url), spread by key over the shuffle partitions in RocksDB (the
    session's state store provider must be it); a batch reads it once for each key that it has, and writes it once, not
    once a row.  Entries go ``ttl_ms`` after they were written, and beyond that the join against the corpus decides.
    Rows of one micro-batch are not compared with each other.  Columns are those of ``TYPED``; a null or empty hash
    and a null time match nothing.
    """
    micros = F.coalesce(F.unix_micros("ts"), F.lit(NO_TIME))
    rows = docs.select("version", "url", "content_sha256", micros.alias("ts"))
    found = rows.groupBy("version", "url").transformWithStateInPandas(_NewTyped(ttl_ms), TYPED.replace("timestamp", "bigint"), "Append", "ProcessingTime" if ttl_ms else "None")
    return found.withColumn("ts", F.when(F.col("ts") != NO_TIME, F.timestamp_micros("ts")))


def day_counts(events: DataFrame, key: str, ts: str = "ts", late: str = "7 days") -> DataFrame:
    """Streaming counts by day and key."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), key, "n")

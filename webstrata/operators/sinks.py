"""Sinks: a store of collections with upserts by appended deltas, logs, exports, quarantine."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PARTITIONS = ("version", "doc_type", "token_length", "bucket")
FOLDERS = ("bucket", "version", "doc_type", "token_length")


def _exists(df: DataFrame, path: str) -> bool:
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    return fs.exists(p)


def _write_new(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole or not at all, by a rename."""
    jvm = spark._jvm
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(target) or not fs.rename(part, target):
        fs.delete(part, False)
        raise FileExistsError(f"{path} was written by another job")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _listed(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def _manifest(spark: SparkSession, root: str) -> dict:
    """The newest version of a store: the deltas that count, for each bucket its base, and the last batch of each writer."""
    versions = sorted(int(m[1]) for name in _listed(spark, f"{root}/_manifest") if (m := re.fullmatch(r"v(\d+)\.json", name)))
    if not versions:
        return {"version": 0, "deltas": [], "bases": {}, "writers": {}, "old": [], "schema": None}
    return json.loads(spark.read.text(f"{root}/_manifest/v{versions[-1]}.json", wholetext=True).first()[0])


def _commit(spark: SparkSession, root: str, manifest: dict) -> None:
    """The next version becomes what readers see; of two writers at once the second fails."""
    manifest["version"] += 1
    _write_new(spark, f"{root}/_manifest/v{manifest['version']}.json", json.dumps(manifest))


def partition_by_collection(df: DataFrame, buckets: int = 16) -> DataFrame:
    """Columns that name a collection are set: an unsplit token length is 0 as a partition value; bucket is of the id's hash."""
    return df.withColumns({"token_length": F.coalesce("token_length", F.lit(0)), "bucket": F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")})


def _first_of(rows: DataFrame, *order: Column) -> DataFrame:
    """One row of each id in its collection."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*PARTITIONS, "doc_id").orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def _parts(spark: SparkSession, root: str, manifest: dict) -> tuple[DataFrame, DataFrame]:
    """Rows of the bases, and of the deltas newer than their bucket's base; both conditions leave folders unread."""
    rows = spark.read.schema(StructType.fromJson(manifest["schema"])).option("basePath", f"{root}/data").parquet(f"{root}/data")
    number, kind = F.lit(0), F.lit("")
    for base in sorted({tuple(x) for x in manifest["bases"].values()}):
        here = F.col("bucket").isin([int(b) for b, x in manifest["bases"].items() if tuple(x) == base])
        number, kind = F.when(here, base[0]).otherwise(number), F.when(here, base[1]).otherwise(kind)
    bases = rows.filter((F.col("kind") == kind) & (F.col("number") == number))
    return bases, rows.filter((F.col("kind") == "delta") & F.col("number").isin(manifest["deltas"]) & (F.col("number") > number))


def store_exists(spark: SparkSession, root: str) -> bool:
    return _manifest(spark, root)["version"] > 0


def stored_documents(spark: SparkSession, root: str, touched: DataFrame | None = None) -> DataFrame:
    """The store's rows as of one version: merged on read, the newest of each id.

    Bases hold an id once and aren't sorted again: ids that a delta has are taken out of them by an anti
    join, and only deltas, which compaction keeps small, are ranked.  ``touched`` (rows of the partition
    columns, as many as there are collections and buckets) leaves other partitions unread.
    """
    manifest = _manifest(spark, root)
    bases, deltas = _parts(spark, root, manifest)
    if touched is not None:
        bases, deltas = (x.join(F.broadcast(touched), list(PARTITIONS), "left_semi") for x in (bases, deltas))
    new = _first_of(deltas, F.desc("number")) if len(manifest["deltas"]) > 1 else deltas
    names = [f["name"] for f in manifest["schema"]["fields"] if f["name"] not in ("number", "kind")]
    if not manifest["bases"]:
        return new.select(*names)
    kept = bases.join(new.select(*PARTITIONS, "doc_id"), [*PARTITIONS, "doc_id"], "left_anti")
    return kept.select(*names).unionByName(new.select(*names))


def stored_like(df: DataFrame, root: str, buckets: int = 16) -> DataFrame:
    """Stored rows of the partitions (collection and bucket) that rows of ``df`` fall in; others aren't read."""
    return stored_documents(df.sparkSession, root, partition_by_collection(df, buckets).select(*PARTITIONS).distinct())


def upsert_documents(df: DataFrame, root: str, buckets: int = 16, batch: tuple[str, int] | None = None) -> None:
    """Overwrite by id within each collection, by appending: a batch of n rows writes n rows and reads none.

    A new row replaces the stored one of its id, whatever their times; of several new ones the newest
    counts.  The batch is a delta of its own that becomes visible with the next manifest: a reader sees all
    of it or nothing.  ``batch`` names its writer and its number there; numbers rise, and one that the
    writer has committed already is not written again.  ``buckets`` holds for the whole life of a store; later
    batches may have more columns.
    """
    spark = df.sparkSession
    manifest = _manifest(spark, root)
    if batch and manifest["writers"].get(batch[0], -1) >= batch[1]:
        return
    number = manifest["version"] + 1
    rows = _first_of(partition_by_collection(df, buckets), F.desc_nulls_last("ts"), F.col("content_sha256"))
    rows.write.mode("overwrite").partitionBy(*FOLDERS).parquet(f"{root}/data/number={number}/kind=delta")
    fields = list(StructType.fromJson(manifest["schema"]).fields) if manifest["schema"] else []
    named = rows.withColumns({"number": F.lit(number), "kind": F.lit("")}).schema.fields
    fields += [f for f in named if f.name not in {x.name for x in fields}]
    manifest["deltas"].append(number)
    manifest["writers"] |= {batch[0]: batch[1]} if batch else {}
    _commit(spark, root, manifest | {"schema": json.loads(StructType(fields).json())})


def compact(spark: SparkSession, root: str, buckets: int = 4) -> list[int]:
    """Merge the deltas of the ``buckets`` buckets with most rows in them into new bases; returns these buckets.

    Only these buckets are read and written, so a run's work is bounded.  Files that the new version no
    longer needs are deleted by the compaction after this one: who reads the version before keeps them.
    """
    manifest = _manifest(spark, root)
    if not manifest["deltas"]:
        return []
    bases, deltas = _parts(spark, root, manifest)
    #: One row for each uncompacted delta and bucket at most.
    counts = deltas.groupBy("number", "bucket").agg(F.count(F.lit(1)).alias("n")).collect()
    rows = {b: sum(r["n"] for r in counts if r["bucket"] == b) for b in {r["bucket"] for r in counts}}
    chosen = sorted(sorted(rows, key=lambda b: (-rows[b], b))[:buckets])
    number, kind = max(manifest["deltas"]), f"base{manifest['version']}"
    every = bases.unionByName(deltas).filter(F.col("bucket").isin(chosen))
    _first_of(every, F.desc("number")).drop("number", "kind").write.mode("overwrite").partitionBy(*FOLDERS).parquet(f"{root}/data/number={number}/kind={kind}")
    needed = sorted({r["number"] for r in counts if r["bucket"] not in chosen})
    old = [f"number={d}/kind=delta" for d in manifest["deltas"] if d not in needed]
    old += [f"number={manifest['bases'][str(b)][0]}/kind={manifest['bases'][str(b)][1]}/bucket={b}" for b in chosen if str(b) in manifest["bases"]]
    for path in manifest["old"]:
        _delete(spark, f"{root}/data/{path}")
    for name in _listed(spark, f"{root}/_manifest"):
        if (m := re.fullmatch(r"v(\d+)\.json", name)) and int(m[1]) < manifest["version"]:
            _delete(spark, f"{root}/_manifest/{name}")
    _commit(spark, root, manifest | {"deltas": needed, "bases": manifest["bases"] | {str(b): [number, kind] for b in chosen}, "old": old})
    return chosen


def append_log(df: DataFrame, path: str, as_json: bool = True) -> None:
    """Append to a log: JSON lines, or the single string column as text."""
    writer = df.write.mode("append")
    writer.json(path) if as_json else writer.text(path)


def write_files(texts: DataFrame, path: str) -> None:
    """A file for each text (value), all in one folder.

    Tasks put their own files in place (committer version 2), so none waits for the driver.  A local folder gets
    no checksum files: with them each text costs two processes that set permissions, without them one.
    """
    texts.select("value").write.options(
        maxRecordsPerFile=1, **{"mapreduce.fileoutputcommitter.algorithm.version": 2, "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": True}
    ).text(path)


def rename_parts(spark: SparkSession, path: str, column: str, ending: str) -> None:
    """Files of a table written in folders ``column=value`` get the folder's value as their name: one file for each value."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in [n for n in _listed(spark, path) if n.startswith(f"{column}=")]:
        parts = [n for n in _listed(spark, f"{path}/{name}") if n.startswith("part-")]
        if len(parts) != 1:
            raise ValueError(f"{name} has {len(parts)} files")
        old, new = (jvm.org.apache.hadoop.fs.Path(x) for x in (f"{path}/{name}/{parts[0]}", f"{path}/{name[len(column) + 1:]}{ending}"))
        old.getFileSystem(conf).rename(old, new)
        _delete(spark, f"{path}/{name}")


def quarantine(rejects: DataFrame, path: str, as_of: Column) -> None:
    """Append rejected items with their reason and time; they are not retried."""
    rejects.select("item", "reason", as_of.alias("rejected_at")).write.mode("append").parquet(path)


def to_katana(exchanges: DataFrame) -> DataFrame:
    """One JSON text an exchange; rtt, technologies and forms only where there are any."""
    headers = lambda c: F.map_from_entries(F.transform(F.col(c), lambda h: F.struct(h["name"], h["value"])))
    fixed = lambda *pairs: [F.concat(F.lit(f'"{name}":'), F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1), F.lit(""))) for name, c in pairs]
    must = lambda name, c: F.coalesce(F.when(c.isNotNull(), fixed((name, c))[0]), F.lit(f'"{name}":null'))
    some = lambda name, c: F.when(c.isNotNull(), fixed((name, c))[0])
    request = F.concat(F.lit("{"), F.concat_ws(",", must("endpoint", F.col("url")), must("method", F.col("method")), must("headers", headers("request_headers")), must("body", F.col("request_body"))), F.lit("}"))
    response = F.concat(F.lit("{"), F.concat_ws(",", must("status_code", F.col("status_code")), must("headers", headers("response_headers")), must("body", F.col("response_body")), some("rtt", F.col("response_rtt")), some("technologies", F.col("technologies")), some("forms", F.col("forms"))), F.lit("}"))
    return exchanges.select(F.concat(F.lit("{"), F.concat_ws(",", must("timestamp", F.col("timestamp")), F.concat(F.lit('"request":'), request), F.concat(F.lit('"response":'), response)), F.lit("}")).alias("value"))

"""Registered queries of readers of whole files, the typed tier, user functions and stored sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.operators import documents, listing, search, sinks, term_index
from webstrata.plans.more import QUERIES, SQL, as_of, folder
from webstrata.plans.registry import _BM25, dealt, page_exchanges, register, table
from webstrata.sources import captures, findings
from webstrata.sources.shared import materialize
from webstrata.streaming import ingest

__all__ = ["QUERIES", "SQL"]


@register(r"""
WITH p AS (SELECT DISTINCT ['en', 'fr', 'de', 'es'][item_id % 4 + 1] AS label, CASE WHEN item_id % 3 = 0 THEN 'html' ELSE 'css' END AS doc_type, regexp_replace(text, '^\s+|\s+$', '', 'g') AS pattern FROM benchmark)
SELECT label, doc_type, md5(pattern) AS pattern_md5 FROM p WHERE pattern <> ''""")
def pattern_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts in files named by label and type, parted by lines of ---- and ====, read as patterns."""
    path, item = folder(spark, "patterns"), table(spark, sf_dir, "benchmark")
    label = F.get(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), (F.col("item_id") % 4).cast("int"))
    line = F.concat("text", F.lit("\n"), F.when(F.col("item_id") % 2 == 0, "-----").otherwise("===="))
    file = F.concat_ws("_", label, F.when(F.col("item_id") % 3 == 0, "html").otherwise("css"))
    item.select(file.alias("file"), line.alias("value")).repartition("file").write.partitionBy("file").text(path)
    sinks.rename_parts(spark, path, "file", ".txt")
    return findings.read_patterns(spark, path).select("label", "doc_type", F.md5("pattern").alias("pattern_md5"))


@register("SELECT url, 'GET' AS method, CAST(200 AS INTEGER) AS status_code, md5(html) AS body_md5, 1.5 AS rtt FROM pages")
def har_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as HAR files of some twenty entries, read back."""
    path = folder(spark, "har")
    none = F.array().cast("array<struct<name:string,value:string>>")
    entry = F.struct(
        F.struct(F.lit("get").alias("method"), F.col("url"), none.alias("headers")).alias("request"),
        F.struct(F.lit(200).alias("status"), none.alias("headers"), F.struct(F.col("html").alias("text")).alias("content")).alias("response"),
        F.lit("2025-01-01T00:00:00Z").alias("startedDateTime"), F.lit(1500.0).alias("time"),
    )
    files = table(spark, sf_dir, "pages").groupBy(F.floor(F.col("page_id") / 20).alias("file")).agg(F.collect_list(entry).alias("entries"))
    files.select("file", F.to_json(F.struct(F.struct("entries").alias("log"))).alias("value")).write.partitionBy("file").text(path)
    good, _ = captures.read_har(spark, path, as_of())
    return good.select("url", "method", "status_code", F.md5("response_body").alias("body_md5"), F.col("response_rtt").cast("decimal(4,1)").alias("rtt"))


@register("SELECT 'http://p' || page_id || '.example.com/x' AS url, CAST(200 + page_id % 3 AS INTEGER) AS status_code, md5(url) AS body_md5 FROM pages")
def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw HTTP file for every page, read back."""
    path = folder(spark, "raw")
    text = F.concat(F.lit("GET /x HTTP/1.1\r\nHost: p"), "page_id", F.lit(".example.com\r\n\r\nHTTP/1.1 "), 200 + F.col("page_id") % 3, F.lit(" OK\r\nA: b\r\n\r\n"), "url")
    sinks.write_files(dealt(spark, sf_dir, "pages").select(text.alias("value")), path)
    good, _ = captures.read_http_raw(spark, path, as_of())
    return good.select("url", "status_code", F.md5(F.regexp_replace("response_body", r"\n$", "")).alias("body_md5"))


_KINDS = "['lines', 'raw', 'csv', 'none'][page_id % 4 + 1]"


@register(f"""
SELECT 'http://p' || page_id || '.example.com/' || {_KINDS} AS url, CAST(201 AS INTEGER) AS status_code FROM pages WHERE page_id % 4 <> 3
UNION ALL SELECT 'http://p' || page_id || '.example.com/second', 202 FROM pages WHERE page_id % 4 = 0
UNION ALL SELECT 'nothing ' || page_id, -1 FROM pages WHERE page_id % 4 = 3""")
def routed_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of katana lines, raw HTTP, CSV and none of these, each taken for what it is."""
    pages = table(spark, sf_dir, "pages").select("page_id")
    at = lambda name: F.concat(F.lit("http://p"), F.col("page_id"), F.lit(f".example.com/{name}"))
    line = lambda name, status: F.concat(F.lit('{"timestamp":"2025-01-01T00:00:00Z","request":{"endpoint":"'), at(name), F.lit(f'","method":"GET","headers":{{}}}},"response":{{"status_code":{status},"headers":{{}}}}}}'))
    raw = F.concat(F.lit("GET /raw HTTP/1.1\nHost: p"), "page_id", F.lit(".example.com\n\nHTTP/1.1 201 OK\n\n"))
    head = "A: a\nB: b\nC: c"
    csv = F.concat(F.lit("url,method,time,status,request,response\n"), at("csv"), F.lit(f',GET,2025-01-01T00:00:00Z,201,"{head}","{head}"\n'))
    body = F.when(F.col("page_id") % 4 == 0, F.concat(line("lines", 201), F.lit("\n"), line("second", 202))).when(F.col("page_id") % 4 == 1, raw).when(F.col("page_id") % 4 == 2, csv).otherwise(F.concat(F.lit("nothing "), "page_id"))
    good, bad = captures.route_uploads(pages.select(body.alias("value")), as_of())
    rejected = bad.filter("item NOT LIKE 'url,%'").select("item", F.lit(-1))  # a CSV's header row is no exchange
    return good.select("url", "status_code").union(rejected)


@register("""
SELECT url, 'OWN' AS method, CAST(page_id % 5 AS INTEGER) AS status_code FROM pages WHERE page_id % 2 = 0
UNION ALL SELECT url, 'GET', 200 FROM pages WHERE page_id % 2 = 1""")
def custom_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in a format of the user's own, by a route that is tried first, among items that the library knows."""
    pages = page_exchanges(spark, sf_dir)
    own = pages.filter("page_id % 2 = 0").select(F.concat_ws("|", F.lit("own"), F.col("page_id") % 5, "url").alias("value"))
    known = sinks.to_katana(pages.filter("page_id % 2 = 1"))

    def parse(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        part = F.split("value", r"\|", 3)
        katana = F.to_json(F.struct(F.lit("2025-01-01T00:00:00Z").alias("timestamp"), F.struct(part[2].alias("endpoint"), F.lit("own").alias("method")).alias("request"), F.struct(part[1].cast("int").alias("status_code")).alias("response")))
        return captures.parse_katana(rows.select(katana.alias("value")))

    good, _ = captures.route_formats(own.unionByName(known), as_of(), routes=[(F.col("value").startswith("own|"), parse)])
    return good.select("url", "method", "status_code")


@register("""
WITH d AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL AND text <> ''),
i AS (SELECT doc_id, w, size, words, step, unnest(range(CASE WHEN len(w) <= words THEN 1 ELSE 1 + CAST(ceil((len(w) - words) / CAST(step AS DOUBLE)) AS BIGINT) END)) AS i
  FROM d, (VALUES (0, 952, 830), (256, 119, 104)) v(size, words, step))
SELECT 'http://d' || doc_id || '.example.com' AS url, CAST(size AS INTEGER) AS token_length, md5(array_to_string(list_slice(w, i * step + 1, i * step + words), ' ')) AS chunk_md5 FROM i""")
def typed_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged documents in two batches of the first tier, chunked by the second tier's stream in two runs."""
    log, chunks, state = (folder(spark, n) for n in ("tier-log", "tier-chunks", "tier-state"))
    docs = table(spark, sf_dir, "documents").filter("text <> ''")
    rows = docs.select(
        "doc_id", F.lit("content").alias("doc_type"), F.concat(F.lit("http://d"), F.col("doc_id"), F.lit(".example.com")).alias("url"), F.lit("text/plain").alias("content_type"), as_of().alias("ts"),
        F.lit("2025-01-01T00:00:00+00:00").alias("ts_text"), F.col("text").alias("content"), F.array().cast("array<struct<name:string,value:string>>").alias("response_headers"),
    )
    for batch in range(2):
        rows.filter(F.col("doc_id") % 2 == batch).write.parquet(f"{log}/batch={batch}")
        ingest.ingest_chunks(spark, log, rows.schema, chunks, state, F.lit("default")).awaitTermination()
    return spark.read.parquet(f"{chunks}/*").select("url", F.coalesce("token_length", F.lit(0)).alias("token_length"), F.md5("chunk").alias("chunk_md5"))


@register("SELECT doc_id, CAST(least(length(text), 4096) AS DOUBLE) AS size, CAST(length(regexp_replace(substr(text, 1, 4096), '[^ ]', '', 'g')) AS DOUBLE) AS spaces FROM documents WHERE text IS NOT NULL")
def embedded_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's embedder, which gets what the feature gives it: a text's first 4096 characters."""

    def make():
        return lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]

    rows = search.embed(dealt(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text"), "text", make)
    return rows.select("doc_id", F.col("embedding")[0].cast("double").alias("size"), F.col("embedding")[1].cast("double").alias("spaces"))


@register("""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source WHEN text = '' THEN NULL ELSE 'T ' || substr(text, 1, 5) END AS title,
  CASE WHEN text = '' THEN NULL ELSE 'about ' || least(length(text), 2048) END AS description FROM documents WHERE text IS NOT NULL""")
def written_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and descriptions that a user's function writes where they are missing."""
    docs = dealt(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("title"), F.lit(None).cast("string").alias("description"))
    return search.describe(docs, lambda texts: [(f"T {t[:5]}", f"about {len(t)}") for t in texts], "text").select("doc_id", "title", "description")


_LONG = "list_filter(regexp_split_to_array(text, '[^a-z]+'), lambda w: length(w) >= 7)"


@register(f"""
WITH d AS (SELECT doc_id, w AS term, count(*) AS weight FROM (SELECT doc_id, unnest({_LONG}) AS w FROM documents) GROUP BY ALL),
q AS (SELECT item_id, w AS term, count(*) AS weight FROM (SELECT item_id, unnest({_LONG}) AS w FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, CAST(sum(d.weight * q.weight) AS DOUBLE) AS score FROM d JOIN q USING (term) GROUP BY ALL)
SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""")
def sparse_embedder_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's sparse embedder (long words and how often they come) over all texts, and the ten nearest by dot product."""

    def make():
        import re
        from collections import Counter

        return lambda text: Counter(w for w in re.split("[^a-z]+", text) if len(w) >= 7)

    docs = search.term_weights(dealt(spark, sf_dir, "documents"), "doc_id", "text", make)
    items = search.term_weights(table(spark, sf_dir, "benchmark"), "item_id", "text", make)
    return search.sparse_dot_topk(items, docs, 10, "item_id", "doc_id")


@register("""
SELECT event_type, count(DISTINCT user_id) AS n, true AS near FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND user_id IS NOT NULL GROUP BY 1""")
def sketched_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users of a range of days from stored day sketches, within two percent of the count over the rows."""
    events = table(spark, sf_dir, "events")
    sketches = materialize(listing.day_sketches(events, ["event_type"], "user_id", "ts"), "sketches")
    found = listing.distinct_in_days(sketches, ["event_type"], F.lit("2024-01-03").cast("date"), F.lit("9999-12-31").cast("date"))
    exact = events.filter("ts >= TIMESTAMP '2024-01-03'").groupBy("event_type").agg(F.countDistinct("user_id").alias("exact"))
    return found.join(exact, "event_type").select("event_type", F.col("exact").alias("n"), (F.abs(F.col("n") - F.col("exact")) <= F.ceil(F.col("exact") * 0.02)).alias("near"))


@register(_BM25.replace("FROM benchmark)", "FROM (SELECT item_id, text FROM benchmark UNION ALL SELECT -1 - page_id, url FROM pages))") + "SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10")
def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two searches, by benchmark texts and by pages' URLs, over postings that are stored once."""
    docs = dealt(spark, sf_dir, "documents")
    index = term_index.build_term_index(docs, folder(spark, "term-index"), "doc_id", block_docs=1024)
    urls = table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("item_id"), F.col("url").alias("text"))
    found = [term_index.indexed_topk(asked, index, 10, "item_id") for asked in (table(spark, sf_dir, "benchmark").select("item_id", "text"), urls)]
    return found[0].unionByName(found[1]).select("item_id", "doc_id", "score", "rank")

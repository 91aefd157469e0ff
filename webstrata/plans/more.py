"""More registered queries: readers, sinks, streams, content jobs and lookups over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions import urls, values
from webstrata.operators import documents, listing, search, sinks
from webstrata.plans.registry import _BM25, _DOMAIN, _HOST, _PORT, AS_OF, QUERIES, SQL, bm25_topk, dealt, page_exchanges, page_facts, register, table
from webstrata.sources import captures, findings
from webstrata.sources.shared import shared_dir
from webstrata.streaming import ingest

__all__ = ["QUERIES", "SQL"]

NO_HEADERS = "array<struct<name:string,value:string>>"


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/webstrata-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def event_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as exchanges: a URL each, a status by id, the value as time taken."""
    event = dealt(spark, sf_dir, "events")
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 404, 429, 503, 301)]), (F.col("event_id") % 5 + 1).cast("int"))
    none = F.array().cast(NO_HEADERS)
    return event.select(
        F.concat(F.lit("https://u"), F.col("user_id"), F.lit(".example.com/"), F.col("event_type"), F.lit("/"), F.col("event_id")).alias("url"), F.lit("get").alias("method"), none.alias("request_headers"),
        F.lit(None).cast("string").alias("request_body"), status.alias("status_code"), none.alias("response_headers"), F.col("props").alias("response_body"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.col("value").alias("response_rtt"), F.lit(None).cast("array<string>").alias("technologies"), F.lit(None).cast("array<map<string,string>>").alias("forms"),
    )


_EVENT_URL = "'https://u' || user_id || '.example.com/' || event_type || '/' || event_id"
_STATUS = "[200, 404, 429, 503, 301][event_id % 5 + 1]"

# --- readers and sinks --------------------------------------------------------------------------


@register(rf"""
SELECT page_id, 'http://' || {_HOST} || regexp_extract(url, '^[a-z]+://[^/?#]+([^#]*)', 1) AS url, 'GET' AS method, CAST(200 AS INTEGER) AS status_code, '1, 2' AS twice, md5(html) AS body_md5, 'asked ' || page_id AS request_body,
  'Wed, 1 Jan 2025 00:00:00 GMT' AS timestamp FROM pages""")
def raw_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as raw HTTP texts, a repeated header among them, and parsed."""
    pages = page_facts(spark, sf_dir).join(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    target = F.concat("path", F.coalesce(F.concat(F.lit("?"), F.col("query")), F.lit("")))
    text = F.concat(F.lit("get "), target, F.lit(" HTTP/1.1\nhost: "), F.col("host"), F.lit("\nx-id: "), F.col("page_id"), F.lit("\nx-two: 1\nX-Two: 2\n\nasked "), F.col("page_id"), F.lit("\nHTTP/1.1 200 OK\nDate: Wed, 1 Jan 2025 00:00:00 GMT\n\n"), F.col("html"))
    good, _ = captures.parse_http_raw(pages.select(text.alias("value")), as_of())
    header = lambda name: F.filter("request_headers", lambda h: h["name"] == name)[0]["value"]
    return good.select(header("X-Id").cast("long").alias("page_id"), "url", "method", "status_code", header("X-Two").alias("twice"), F.md5("response_body").alias("body_md5"), "request_body", "timestamp")


@register("SELECT url, 'GET' AS method, CAST(200 AS INTEGER) AS status_code, md5(html) AS body_md5, '2025-01-01T00:00:00Z' AS timestamp FROM pages")
def katana_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages appended to a log as katana lines, with lines that are none between them, and read from the files."""
    path = folder(spark, "katana")
    sinks.append_log(sinks.to_katana(page_exchanges(spark, sf_dir)), path, as_json=False)
    sinks.append_log(table(spark, sf_dir, "pages").select(F.concat(F.lit("{\"page\": "), F.col("page_id"), F.lit("}")).alias("value")), path, as_json=False)
    return captures.read_katana(spark, path)[0].select("url", "method", "status_code", F.md5("response_body").alias("body_md5"), "timestamp")


@register("""SELECT url, md5(html) AS body_md5, 'good' AS kind FROM pages UNION ALL SELECT 'line ' || page_id, md5('unknown format'), 'bad' FROM pages WHERE page_id % 5 = 0""")
def replayed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of raw items in two formats, and some in none, indexed again."""
    path, pages = folder(spark, "log"), page_exchanges(spark, sf_dir)
    entry = F.struct(F.col("timestamp").alias("startedDateTime"), F.struct("method", "url").alias("request"), F.struct(F.col("status_code").alias("status"), F.struct(F.col("response_body").alias("text")).alias("content")).alias("response"))
    sinks.append_log(sinks.to_katana(pages.filter("page_id % 2 = 0")), path, as_json=False)
    sinks.append_log(pages.filter("page_id % 2 = 1").select(F.to_json(F.struct(F.struct(F.array(entry).alias("entries")).alias("log"))).alias("value")), path, as_json=False)
    sinks.append_log(pages.filter("page_id % 5 = 0").select(F.concat(F.lit("line "), F.col("page_id")).alias("value")), path, as_json=False)
    good, bad = captures.replay_log(spark, path, as_of())
    return good.select("url", F.md5("response_body").alias("body_md5"), F.lit("good").alias("kind")).unionByName(bad.select(F.col("item").alias("url"), F.md5("reason").alias("body_md5"), F.lit("bad").alias("kind")))


@register(f"SELECT {_EVENT_URL} AS url, CAST({_STATUS} AS INTEGER) AS status_code, value AS rtt_ms FROM events WHERE {_STATUS} NOT IN (404, 429, 503)")
def capture_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as a proxy's export and read back: ignored statuses go, times are in ms."""
    path = folder(spark, "export")
    sinks.append_log(sinks.to_katana(event_exchanges(spark, sf_dir)), path, as_json=False)
    return captures.read_capture_export(spark, path)[0].select("url", "status_code", F.col("response_rtt_ms").alias("rtt_ms"))


@register(f"""
SELECT {_EVENT_URL} AS url, 'POST' AS method, CAST({_STATUS} AS INTEGER) AS status_code, 'a, "b"' AS accept, 's' || user_id AS server, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, value AS rtt FROM events WHERE event_id % 7 <> 0""")
def csv_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as a capture CSV (some rows without a status, so rejected), and read by the roles of its cells."""
    path = folder(spark, "csv")
    rows = event_exchanges(spark, sf_dir).withColumn("event_id", F.regexp_extract("url", r"(\d+)$", 1).cast("long")).withColumn("user", F.regexp_extract("url", r"u(\d+)\.", 1))
    head = spark.createDataFrame([("Response.RTT", "url", "method", "time", "code", "request", "response")], "rtt string, url string, method string, timestamp string, status string, q string, r string")
    cells = rows.select(
        F.col("response_rtt").cast("string").alias("rtt"), "url", F.lit("POST").alias("method"), "timestamp", F.when(F.col("event_id") % 7 != 0, F.col("status_code").cast("string")).otherwise("none").alias("status"),
        F.concat(F.lit("Host: h\nAccept: a\nAccept: \"b\"\nX: y")).alias("q"), F.concat(F.lit("Server: s"), F.col("user"), F.lit("\nA: b\nC: d")).alias("r"),
    )
    head.unionByName(cells).write.option("escape", '"').option("quoteAll", True).option("maxRecordsPerFile", 100_000).csv(path)
    header = lambda c, name: F.filter(c, lambda h: h["name"] == name)[0]["value"]
    good, _ = captures.read_http_csv(spark, path)
    return good.select("url", "method", "status_code", header("request_headers", "Accept").alias("accept"), header("response_headers", "Server").alias("server"), "timestamp", F.col("response_rtt").alias("rtt"))


_ADDR = "'10.' || (l_orderkey // 65536) % 256 || '.' || (l_orderkey // 256) % 256 || '.' || l_orderkey % 256"


@register(f"""
SELECT 'h' || l_orderkey || '.example.com' AS hostname, {_ADDR} AS ip_address, {_ADDR} || ':' || l_suppkey AS netloc, CAST(l_suppkey AS INTEGER) AS port, CASE WHEN l_linestatus = 'O' THEN 'open' ELSE 'unknown' END AS state,
  's' || l_linenumber AS service_name, 'a' || chr(10) || l_returnflag AS service_notes FROM lineitem""")
def scan_xml_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scanned hosts and their items as ports, written as XML and read back."""
    path, key = folder(spark, "scan"), F.col("l_orderkey")
    script = lambda name, said: F.struct(F.lit(name).alias("_id"), said.alias("_output"))
    port = F.struct(
        F.col("l_suppkey").alias("_portid"), F.lit("tcp").alias("_protocol"), F.when(F.col("l_linestatus") == "O", F.struct(F.lit("open").alias("_state"))).alias("state"), F.struct(F.concat(F.lit("s"), "l_linenumber").alias("_name")).alias("service"),
        F.array(script("x", F.lit("a")), script("y", F.col("l_returnflag"))).alias("script"),
    )
    byte = lambda n: (F.floor(key / n) % 256).cast("string")
    address = F.struct(F.concat_ws(".", F.lit("10"), byte(65536), byte(256), byte(1)).alias("_addr"), F.lit("ipv4").alias("_addrtype"))
    name = F.struct(F.struct(F.concat(F.lit("h"), key, F.lit(".example.com")).alias("_name")).alias("hostname"))
    items = dealt(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(port).alias("ports"))  # a few items an order
    items.select(address.alias("address"), name.alias("hostnames"), F.struct(F.col("ports").alias("port")).alias("ports")).write.format("xml").option("maxRecordsPerFile", 50_000).option("rootTag", "run").option("rowTag", "host").save(path)
    _, found = findings.read_scan_xml(spark, path, as_of())
    return found.select("hostname", "ip_address", "netloc", "port", "state", "service_name", "service_notes")


@register("""
WITH e AS (SELECT *, event_id % 3 AS m, 'u' || user_id || '.example.com' AS h FROM events),
t AS (SELECT *, CASE m WHEN 0 THEN ['https://' || h || '/' || event_id, 'http://' || h] WHEN 1 THEN ['https://' || h, h || ':443', h] ELSE ['http://' || h || ':8080', h || ':8080', h, '10.1.1.1:8080', '10.1.1.1'] END AS targets FROM e)
SELECT event_id, event_type || ' on ' || targets[1] AS title, CASE WHEN m = 1 THEN 'Info' ELSE 'High' END AS severity, array_to_string(targets, ' ') AS targets,
  'cve=CVE-2024-' || event_id || ' cwe=79 cvss=7.5 reference=r1 reference=r2 shodan-query=q' AS classification FROM t""")
def scanner_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as objects of a scanner, normalized: title, severity, ordered targets, classification."""
    event = dealt(spark, sf_dir, "events")
    kind, host = F.col("event_id") % 3, F.concat(F.lit("u"), F.col("user_id"), F.lit(".example.com"))
    info = F.struct(
        F.col("event_type").alias("name"), F.when(kind != 1, "high").alias("severity"), F.array(F.lit("r1"), F.lit("r2"), F.lit("r1")).alias("reference"),
        F.struct(F.array(F.concat(F.lit("cve-2024-"), F.col("event_id"))).alias("cve-id"), F.array(F.lit("CWE-79")).alias("cwe-id"), F.lit(7.5).alias("cvss-score")).alias("classification"),
        F.create_map(F.lit("shodan-query"), F.lit("q"), F.lit("vendor"), F.lit("v")).alias("metadata"),
    )
    item = F.to_json(F.struct(
        F.concat(F.lit("t-"), F.col("event_id")).alias("template-id"), info.alias("info"), F.when(kind == 0, F.concat(F.lit("https://"), host, F.lit("/"), F.col("event_id"))).alias("matched-at"), F.when(kind == 0, F.concat(F.lit("http://"), host)).alias("url"),
        host.alias("host"), F.when(kind == 1, "443").otherwise("8080").alias("port"), F.when(kind == 1, "https").otherwise("http").alias("scheme"), F.when(kind == 2, "10.1.1.1").alias("ip"),
    ))
    got = findings.normalize_scanner_findings(event.select(item.alias("item")))
    rows = F.array_join(F.transform("classification", lambda c: F.concat(c["kind"], F.lit("="), c["value"])), " ")
    return got.select(F.regexp_extract("template", r"(\d+)", 1).cast("long").alias("event_id"), "title", "severity", F.array_join("targets", " ").alias("targets"), rows.alias("classification"))


@register("""
SELECT CASE WHEN event_id % 2 = 0 THEN 'u' || user_id || '.example.com:80' ELSE 'https://u' || user_id || '.example.com' END AS target, event_type AS title, 'found ' || event_id AS markdown, 'good' AS kind FROM events WHERE event_id % 10 > 1
UNION ALL SELECT NULL, NULL, CASE WHEN event_id % 10 = 0 THEN 'line ' || event_id ELSE '{"target":"a.example.com","title":"' || event_id || '"}' END, 'bad' FROM events WHERE event_id % 10 <= 1""")
def finding_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in files of lines, with lines that are none, read back."""
    event, path = table(spark, sf_dir, "events"), folder(spark, "findings")
    host = F.concat(F.lit("u"), F.col("user_id"), F.lit(".example.com"))
    plain = F.struct(F.when(F.col("event_id") % 2 == 0, F.array(F.concat(host, F.lit(":80")))).alias("targets"), F.when(F.col("event_id") % 2 == 1, F.concat(F.lit(" https://"), host)).alias("target"), F.concat(F.lit(" "), F.col("event_type")).alias("title"), F.concat(F.lit("found "), F.col("event_id"), F.lit("\n")).alias("markdown"))
    line = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("line "), F.col("event_id"))).when(F.col("event_id") % 10 == 1, F.to_json(F.struct(F.lit("a.example.com").alias("target"), F.col("event_id").cast("string").alias("title")))).otherwise(F.to_json(plain))
    sinks.append_log(event.select(line.alias("value")), path, as_json=False)
    good, bad = findings.read_findings(spark, path)
    return good.select("target", "title", "markdown", F.lit("good").alias("kind")).unionByName(bad.select(F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("title"), F.col("item").alias("markdown"), F.lit("bad").alias("kind")))


@register("""
WITH u AS (SELECT url, bool_or(page_id % 3 = 0) AS replaced FROM pages GROUP BY url)
SELECT sha256(url || ':network:2025-01-01T') AS doc_id, 'network' AS doc_type, replaced FROM u
UNION ALL SELECT sha256(url || ':content:2025-01-01T:'), 'content', replaced FROM u""")
def upserted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all pages stored, those of every third one stored again with an older time, and scanned."""
    root, pages = folder(spark, "corpus"), page_exchanges(spark, sf_dir)
    sinks.upsert_documents(documents.derive_documents(pages, as_of()), root, buckets=4)
    again = documents.derive_documents(pages.filter("page_id % 3 = 0"), as_of()).withColumns({"ts": F.col("ts") - F.expr("INTERVAL 3 DAYS"), "title": F.lit("again")})
    sinks.upsert_documents(again, root, buckets=4)
    rows = listing.scan_corpus(spark, root, 1, ["doc_id", "doc_type", "title"], F.col("version") == 1)
    return rows.select("doc_id", "doc_type", F.coalesce(F.col("title") == "again", F.lit(False)).alias("replaced"))


@register("""
WITH u AS (SELECT url, CASE WHEN bool_or(page_id % 3 = 0) THEN 'third' WHEN bool_or(page_id % 2 = 0) THEN 'second' ELSE 'first' END AS title FROM pages GROUP BY url)
SELECT title, doc_type, count(*) AS n FROM u, (SELECT unnest(['content', 'network']) AS doc_type) GROUP BY ALL""")
def compacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches with ids in common, two compactions of half the buckets between them, and a batch that comes again."""
    root, pages = folder(spark, "compacted"), page_exchanges(spark, sf_dir)
    for number, (title, rows) in enumerate([("first", pages), ("second", pages.filter("page_id % 2 = 0")), ("third", pages.filter("page_id % 3 = 0"))]):
        docs = documents.derive_documents(rows, as_of()).withColumn("title", F.lit(title))
        sinks.upsert_documents(docs, root, 4, ("pages", number))
        sinks.upsert_documents(docs.withColumn("title", F.lit("again")), root, 4, ("pages", number))
        if number:
            sinks.compact(spark, root, 2)
    return sinks.stored_documents(spark, root).groupBy("title", "doc_type").agg(F.count(F.lit(1)).alias("n"))


@register("""
SELECT doc_id, sha256('{"id":' || doc_id % 50 || ',"lang":' || CASE WHEN doc_id % 2 = 0 THEN '"' || lang || '"' ELSE 'null' END || '}') AS clean_sha256, doc_id % 3 <> 0 AS was_stored FROM documents WHERE lang IS NOT NULL""")
def reused_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON bodies of all documents in two batches over one store of clean bodies: the second finds those of the first."""
    root, docs = folder(spark, "bodies"), table(spark, sf_dir, "documents").filter("lang IS NOT NULL")
    body = F.concat(F.lit("{lang: "), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("'"), "lang", F.lit("'"))).otherwise("null"), F.lit(", id: "), F.col("doc_id") % 50, F.lit("}"))
    rows = content_rows(docs.select("doc_id", "lang"), body, "application/json")
    parts = [documents.normalize_documents(rows.filter(F.col("doc_id") % 3 != 0), root), documents.normalize_documents(rows.filter(F.col("doc_id") % 3 == 0), root)]
    return parts[0].withColumn("was_stored", F.lit(True)).unionByName(parts[1].withColumn("was_stored", F.lit(False))).select("doc_id", F.sha2("content", 256).alias("clean_sha256"), "was_stored")


@register("""
WITH e AS (SELECT event_id, 'u' || user_id AS url, md5(event_type) AS h, date_trunc('hour', ts) AS t, event_id % 3 AS batch FROM events),
a AS (SELECT * FROM e WHERE batch = 0),
b AS (SELECT * FROM e WHERE batch = 1 AND NOT EXISTS (SELECT 1 FROM a WHERE a.url = e.url AND (a.h = e.h OR a.t = e.t))),
ab AS (SELECT * FROM a UNION ALL SELECT * FROM b),
c AS (SELECT * FROM e WHERE batch = 2 AND NOT EXISTS (SELECT 1 FROM ab WHERE ab.url = e.url AND (ab.h = e.h OR ab.t = e.t)))
SELECT url, h AS content_sha256, count(*) AS n FROM (SELECT url, h FROM ab UNION ALL SELECT url, h FROM c) GROUP BY ALL""")
def stream_new_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in three batches through a stateful stream: rows with neither the hash nor the hour of an earlier one of their URL."""
    inbox, out, state = (folder(spark, n) for n in ("typed-in", "typed-out", "typed-state"))
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 3).alias("batch"), F.lit(1).alias("version"), F.concat(F.lit("u"), "user_id").alias("url"), F.md5("event_type").alias("content_sha256"), F.date_trunc("hour", "ts").alias("ts"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for batch in range(3):
            rows.filter(F.col("batch") == batch).drop("batch").write.mode("append").parquet(inbox)
            found = ingest.new_typed_stream(spark.readStream.schema(ingest.TYPED).parquet(inbox))
            found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(out).groupBy("url", "content_sha256").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT 'content' AS doc_type, CAST(0 AS INTEGER) AS token_length, count(*) AS n FROM pages UNION ALL SELECT 'network', 0, count(*) FROM pages UNION ALL SELECT 'forms', 256, count(*) FROM pages WHERE page_id % 2 = 0")
def stored_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by collection, of the collections that there are."""
    form = F.when(F.col("page_id") % 2 == 0, F.array(F.create_map(F.lit("action"), F.lit("/a"))))
    rows = sinks.partition_by_collection(documents.derive_documents(page_exchanges(spark, sf_dir).withColumn("forms", form), as_of()))
    return listing.count_by_collection(rows).join(listing.list_collections(rows), ["doc_type", "token_length"])


@register("""
SELECT sha256(url || ':forms:2025-01-01T') AS doc_id, '[{"action":"/b"},{"action":"/z","id":"' || page_id || '"},{"action":"/a","method":"POST"}]' AS content FROM pages""")
def form_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with three forms each: compact JSON, ordered by method (GET if none) and action."""
    form = lambda **f: F.create_map(*[x for k, v in f.items() for x in (F.lit(k), v)])
    forms = F.array(form(action=F.lit("/z"), id=F.col("page_id").cast("string")), form(method=F.lit("POST"), action=F.lit("/a")), form(action=F.lit("/b")))
    docs = documents.derive_documents(page_exchanges(spark, sf_dir).withColumn("forms", forms), as_of())
    return docs.filter("doc_type = 'forms'").select("doc_id", "content")


@register("""
SELECT DISTINCT url, doc_type, 1 AS n FROM pages, (SELECT unnest(['content', 'network']) AS doc_type) WHERE page_id % 2 = 0
UNION ALL SELECT 'bad ' || page_id, 'rejected', 1 FROM pages WHERE page_id % 2 = 1""")
def ingested_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that arrive twice in a folder, and some that are none, through the continuous ingest."""
    inbox, root, state, rejects = (folder(spark, n) for n in ("inbox", "ingested", "state", "rejects"))
    pages = page_exchanges(spark, sf_dir)
    sinks.append_log(sinks.to_katana(pages.filter("page_id % 2 = 0")), inbox, as_json=False)
    sinks.append_log(pages.filter("page_id % 2 = 1").select(F.concat(F.lit("bad "), F.col("page_id")).alias("value")), inbox, as_json=False)
    ingest.ingest(ingest.stream_items(spark, inbox), root, state, rejects, as_of(), buckets=4).awaitTermination()
    sinks.append_log(sinks.to_katana(pages.filter("page_id % 4 = 0")), inbox, as_json=False)
    ingest.ingest(ingest.stream_items(spark, inbox), root, state, rejects, as_of(), buckets=4).awaitTermination()
    kept = sinks.stored_documents(spark, root).groupBy("url", "doc_type").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return kept.unionByName(spark.read.parquet(rejects).select(F.col("item").alias("url"), F.lit("rejected").alias("doc_type"), F.lit(1).alias("n")))


# --- content jobs -------------------------------------------------------------------------------


@register(r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, '<html><head><title>' || doc_id || '</title></head><body><p class="b a" id="x">' || text || '</p><p><b>' || lang || '</b></p><b><i>' || doc_id || '</i></b><table><tbody><tr><td>'
  || source || '</td></tr><tr></tr></tbody></table><ul><li><b><i>one</i></b></li><li><b><i>two</i></b></li></ul></body></html>' AS page FROM d),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(page, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g'), '\b\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}\b', '<NUMERIC_TOKEN>', 'g'), '\b[0-9a-f]{32,64}\b', '<NUMERIC_TOKEN>', 'g') AS clean FROM p)
SELECT doc_id, sha256(clean) AS clean_sha256, CAST(length(clean) AS BIGINT) AS n_chars FROM c""")
def rebuilt_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of tag soup around every document's text, whose tree is known: implied parts, a table's strays before it, formatting opened again."""
    doc = dealt(spark, sf_dir, "documents").select("doc_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(
        F.lit("<!DOCTYPE html><title>"), "doc_id", F.lit('</title><p nonce=1 id=x class="  b a ">'), escaped, F.lit("<p><b>"), "lang",
        F.lit("<table><td>"), "source", F.lit("<tr><i>"), "doc_id", F.lit("</table><UL><li>one<li>two</ul>"),
    )
    clean = documents.normalized_bodies(doc.select(F.col("doc_id").cast("string").alias("key"), F.lit("html").alias("kind"), page.alias("content")), "key", "kind", "content")
    return clean.select(F.col("key").cast("long").alias("doc_id"), F.sha2("clean", 256).alias("clean_sha256"), F.length("clean").cast("long").alias("n_chars"))


def content_rows(df: DataFrame, content: Column, mime: Column | str) -> DataFrame:
    """Rows with a body and what the content jobs need beside it."""
    mime = F.lit(mime) if isinstance(mime, str) else mime
    length = F.array(F.struct(F.lit("Content-Length").alias("name"), F.lit("0").alias("value")))
    return df.withColumns({"content": content, "content_type": mime, "doc_type": F.lit("content"), "normalized": F.lit(False), "response_headers": length}).withColumn("content_sha256", F.sha2("content", 256))


@register("""
SELECT event_id, '{"a":{"x":' || json_extract_string(props, '$.k') || ',"y":[1,2]},"b":"' || event_type || '"}' AS content, true AS normalized, CAST(length('{"a":{"x":' || json_extract_string(props, '$.k') || ',"y":[1,2]},"b":"' || event_type || '"}') AS VARCHAR) AS size FROM events""")
def json_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON bodies with comments, bare names and trailing commas: names in order, tight separators, a fitting length."""
    k = F.get_json_object("props", "$.k")
    body = F.concat(F.lit("{b : '"), F.col("event_type"), F.lit("', // c\n \"a\": {\"y\": [1, 2, ], \"x\": "), k, F.lit("}, }"))
    got = documents.normalize_documents(content_rows(dealt(spark, sf_dir, "events").select("event_id", "event_type", "props"), body, "application/vnd.x+json"))
    return got.select("event_id", "content", "normalized", F.col("response_headers")[0]["value"].alias("size"))


@register("""
SELECT p_partkey, 'a,h1>p{background:url(x.png);color:#abc;margin:' || p_size || ';width:0;}b{id:<HASH>;}' AS content FROM part""")
def css_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSS bodies: ordered selectors and declarations, short values, no queries, no hashes."""
    body = F.concat(F.lit("h1 > p , a { width: 0px; color:#000; Margin: "), F.col("p_size"), F.lit(".0; color:#AABBCC; background:url(\"x.png?v="), F.col("p_partkey"), F.lit("\") } /* c */\nb{id:"), F.md5(F.col("p_name")), F.lit("}"))
    return documents.normalize_documents(content_rows(dealt(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), body, "text/css")).select("p_partkey", "content")


@register("""
SELECT c_custkey, '<a>' || chr(10) || '  <b x="1">' || chr(10) || '    ' || c_name || ' &amp; ' || c_mktsegment || chr(10) || '  </b>' || chr(10) || '</a>' AS content FROM customer""")
def xml_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML bodies: blank text dropped, indented again."""
    body = F.concat(F.lit("<a>\n\n<b x='1'>"), F.col("c_name"), F.lit(" &amp; "), F.col("c_mktsegment"), F.lit("</b>   </a>"))
    return documents.normalize_documents(content_rows(dealt(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), body, "application/xml")).select("c_custkey", "content")


@register(r"""
SELECT doc_id, md5(nfc_normalize(trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t\x0B\f\r]+', ' ', 'g'), ' ?(\n ?)+', chr(10), 'g'), '^\n|\n$', '', 'g'), ' '))) AS content_md5 FROM documents""")
def plain_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with empty lines dropped and white space squeezed, each distinct body once."""
    rows = content_rows(dealt(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"), "text/x-unknown").withColumn("text", F.lit(None).cast("string"))
    return documents.normalize_documents(rows).select("doc_id", F.md5("content").alias("content_md5"))


@register("""
WITH d AS (SELECT doc_id, string_split(text, ' ') AS w, CASE WHEN doc_id % 2 = 0 THEN 'html' ELSE 'default' END AS kind FROM documents WHERE text IS NOT NULL AND text <> ''),
c AS (SELECT doc_id, w, kind, size, words, step FROM d JOIN (VALUES ('html', NULL, 1904, 1659), ('html', 256, 119, 104), ('default', NULL, 952, 830), ('default', 256, 119, 104)) v(k, size, words, step) ON k = kind),
i AS (SELECT *, unnest(range(CASE WHEN len(w) <= words THEN 1 ELSE 1 + CAST(ceil((len(w) - words) / CAST(step AS DOUBLE)) AS BIGINT) END)) AS i FROM c)
SELECT sha256('http://d' || doc_id || '.example.com:' || kind || ':' || coalesce(CAST(size AS VARCHAR), '') || ':2025-01-01T:e' || doc_id) || '_' || i AS chunk_id, CAST(coalesce(size, 0) AS INTEGER) AS token_length, md5(array_to_string(list_slice(w, i * step + 1, i * step + words), ' ')) AS chunk_md5 FROM i""")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as typed rows, chunked at the token lengths of their types, with their ids."""
    docs = dealt(spark, sf_dir, "documents").filter("text <> ''")
    headers = F.array(F.struct(F.lit("ETag").alias("name"), F.concat(F.lit("e"), F.col("doc_id")).alias("value")), F.struct(F.lit("Server").alias("name"), F.lit("s").alias("value")))
    rows = docs.select(
        F.concat(F.lit("http://d"), F.col("doc_id"), F.lit(".example.com")).alias("url"), F.when(F.col("doc_id") % 2 == 0, "html").otherwise("default").alias("doc_type"), F.lit("text/plain").alias("content_type"),
        as_of().alias("ts"), F.lit("2025-01-01T00:00:00+00:00").alias("ts_text"), F.col("text").alias("content"), headers.alias("response_headers"),
    )
    return documents.chunk_documents(rows).select("chunk_id", F.coalesce("token_length", F.lit(0)).alias("token_length"), F.md5("chunk").alias("chunk_md5"))


@register("""SELECT doc_id, 'T ' || source AS title, source || ' & ' || lang AS description FROM documents""")
def page_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads without a title: the first title and the last description of their meta tags."""
    head = F.concat(
        F.lit('<html><head><meta name="Description" content="first"><META property="og:title" content=" T  '), F.col("source"), F.lit('"><meta content="x" name="twitter:title"><meta property=\'og:description\' content="'),
        F.col("source"), F.lit(" &amp; "), F.col("lang"), F.lit('"><meta itemprop="description" content=""></head>'),
    )
    rows = dealt(spark, sf_dir, "documents").select("doc_id", head.alias("page"), F.lit("text/html").alias("mime"))
    return documents.with_title_description(rows, "page", "mime").select("doc_id", "title", "description")


_MIMES = ("text/html", "image/svg+xml", "image/png", "application/json", "application/ld+json", "application/atom+xml", "application/pdf", "text/css", "video/mp4", "application/x-javascript", "application/x-what", "")


@register("""SELECT doc_id, ['html', 'xml', 'default', 'json', 'json', 'xml', 'default', 'css', 'default', 'javascript', 'default', 'default'][doc_id % 12 + 1] AS doc_type, doc_id % 12 IN (2, 6, 8) AS is_binary FROM documents WHERE text IS NOT NULL""")
def typed_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical types and the binary test by MIME type; the bodies themselves are plain ASCII."""
    mime = F.element_at(F.array(*[F.lit(m) for m in _MIMES]), (F.col("doc_id") % 12 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", mime.alias("mime"))
    return rows.select("doc_id", values.doc_type_of(F.col("mime")).alias("doc_type"), values.is_binary(F.lit("plain"), F.col("mime")).alias("is_binary"))


@register("""SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN md5('') ELSE md5(text) END AS body_md5, CAST(1 AS INTEGER) AS n_headers FROM documents WHERE text IS NOT NULL""")
def replayed_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored in base64 on even ids, badly on some odd ones, as bytes to replay; hop headers go."""
    coded = (F.col("doc_id") % 2 == 0) | (F.col("doc_id") % 10 == 3)
    body = F.when(F.col("doc_id") % 10 == 3, "?!").when(coded, F.base64(F.encode("text", "UTF-8"))).otherwise(F.col("text"))
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), F.lit(value).alias("value"))
    headers = F.when(coded, F.array(pair("Transfer-Encoding", "base64"), pair("A", "b"))).otherwise(F.array(pair("A", "b"), pair("Connection", "close")))
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", body.alias("content"), headers.alias("response_headers"))
    return listing.replay_body(rows).select("doc_id", F.md5("body").alias("body_md5"), F.size("response_headers").alias("n_headers"))


@register("""
SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN last_value(CASE WHEN event_type = 'click' THEN 't' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id, event_type IN ('click', 'view') ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
  WHEN event_type = 'click' THEN 't' || event_id END AS title FROM events""")
def carried_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles known from clicks carried to the user's later views; rows of other kinds are left alone."""
    known = F.when(F.col("event_type") == "click", F.concat(F.lit("t"), F.col("event_id")))
    kind = F.when(F.col("event_type").isin("click", "view"), "content").otherwise("network")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("url"), "ts", F.col("event_id").alias("doc_id"), F.lit(200).alias("status_code"), kind.alias("doc_type"), known.alias("title"), F.lit(None).cast("string").alias("description"))
    return documents.carry_forward_title(rows).select("event_id", "title")


# --- targets and filters ------------------------------------------------------------------------


@register(f"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN CASE WHEN {_PORT} % 1000 = 443 THEN 'https://' ELSE 'http://' END || {_HOST} || ':' || {_PORT} ELSE 'https://' || {_HOST} END AS url FROM pages""")
def target_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of targets given as a URL, as host and port, or as a host."""
    text = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.col("netloc")).otherwise(F.col("host"))
    return page_facts(spark, sf_dir).select("page_id", urls.target_url(urls.target_struct(text)).alias("url"))


@register(f"""SELECT page_id, {_HOST} AS host, unnest([url, NULL]) AS url FROM pages""")
def extracted_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets among the words of a sentence, less the mark after them."""
    text = F.concat(F.lit("please see "), F.col("url"), F.lit(". or ask\n"), F.col("host"), F.lit("! now 99:x"))
    return urls.extract_targets(page_facts(spark, sf_dir).select("page_id", "host", text.alias("said")), "said").select("page_id", F.col("target.host").alias("host"), F.col("target.url").alias("url"))


@register("SELECT event_id FROM events WHERE event_type IN ('click', 'purchase') AND event_id % 5 = 0 AND user_id = 7")
def filtered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions of several values, one value and none, joined."""
    rows = table(spark, sf_dir, "events").withColumns({"http_method": F.col("event_type"), "status_code": (F.col("event_id") % 5).cast("int")})
    return rows.filter(listing.all_of(listing.in_values("http_method", ["click", None, "purchase"]), listing.in_values("status_code", [0]), listing.in_values("user_id", [7]), listing.in_values("value", [None]))).select("event_id")


@register("SELECT url FROM pages WHERE starts_with(url, 'https://m.') AND url <> (SELECT min(url) FROM pages WHERE starts_with(url, 'https://m.'))")
def urls_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("url")
    exact = pages.filter(F.col("url").startswith("https://m.")).agg(F.min("url")).first()[0]
    return pages.filter(listing.below_prefix("https://m.", [exact] if exact else []))


@register("""
SELECT c_custkey, c_custkey % 6 IN (0, 1, 3, 4) AND NOT (c_custkey % 6 = 0 AND c_custkey % 300 > 255) AS is_host, CASE c_custkey % 6 WHEN 0 THEN c_custkey % 300 <= 255 AND c_custkey % 40 <= 32 WHEN 4 THEN c_custkey % 200 <= 128 ELSE false END AS is_network FROM customer""")
def valid_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and network validity of addresses, names and texts that are neither."""
    key = F.col("c_custkey")
    kind = key % 6
    name = F.when(kind == 0, F.concat(F.lit("10.0.0."), key % 300)).when(kind == 1, "localhost").when(kind == 2, "a..b").when(kind == 3, F.concat(F.lit("h"), key, F.lit(".example.com"))).when(kind == 4, "fe80::1").otherwise("x y")
    network = F.concat(name, F.lit("/"), F.when(kind == 4, key % 200).otherwise(key % 40))
    return table(spark, sf_dir, "customer").select("c_custkey", urls.is_valid_host(name).alias("is_host"), urls.is_valid_network(network).alias("is_network"))


@register("SELECT event_id FROM events WHERE event_id % 4 NOT IN (1, 2) AND event_id % 7 <> 0 AND ts IS NOT NULL")
def complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with URL, type and time whose content shows no script error."""
    part = F.col("event_id") % 4
    rows = table(spark, sf_dir, "events").select(
        "event_id", "ts", F.when(part != 1, "u").alias("url"), F.when(part == 2, "").otherwise("text/html").alias("content_type"), F.when(F.col("event_id") % 7 == 0, "x ERROR: Script execution failed y").when(part == 0, "fine").alias("content"),
    )
    return listing.without_errors(listing.complete(rows)).select("event_id")


@register(f"SELECT DISTINCT {_DOMAIN} AS domain FROM pages WHERE contains({_DOMAIN}, 'example.o')")
def domains_holding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains that hold a text, whatever its case."""
    return listing.distinct_values(page_facts(spark, sf_dir), "domain", holds="EXAMPLE.O")


# --- lookups ------------------------------------------------------------------------------------


def event_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stored rows of URLs by user and type."""
    event = dealt(spark, sf_dir, "events")
    rows = event.select(
        F.col("event_id").alias("doc_id"), F.concat(F.lit("https://u"), F.col("user_id"), F.lit(".example.com/"), F.col("event_type")).alias("url"), "ts", F.when(F.col("event_id") % 2 == 0, "GET").otherwise("POST").alias("http_method"),
        F.lit(200).alias("status_code"), F.lit("content").alias("doc_type"), F.concat(F.lit("value "), F.col("event_id")).alias("content"), F.lit("text/plain").alias("content_type"), F.lit(0.0).alias("score"),
    )
    return urls.with_domain(urls.with_url_facts(rows))


_DOCS = """WITH d AS (SELECT event_id AS doc_id, 'https://u' || user_id || '.example.com/' || event_type AS url, 'u' || user_id || '.example.com' AS host, ts, CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS http_method, event_type, user_id FROM events)
"""


@register(_DOCS + "SELECT url, ts FROM d ORDER BY ts DESC, url LIMIT 5")
def recent_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.recent_urls(event_docs(spark, sf_dir))


@register(_DOCS + """, f AS (SELECT *, row_number() OVER (PARTITION BY url, http_method ORDER BY ts DESC NULLS LAST, doc_id) AS r FROM d WHERE user_id = 3 AND http_method = 'GET')
SELECT url, http_method, doc_id FROM f WHERE r = 1 ORDER BY ts DESC NULLS LAST, doc_id LIMIT 100""")
def found_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A URL that isn't stored, on a host that is: the cascade ends at its host and port, one row a URL and method."""
    return listing.find_resources(event_docs(spark, sf_dir), "https://u3.example.com/none", methods=["GET"]).select("url", "http_method", "doc_id")


@register(_DOCS + """, s AS (SELECT doc_id, max(doc_id % 13) AS score FROM d WHERE doc_id % 50 = 0 GROUP BY 1), f AS (SELECT d.*, s.score, row_number() OVER (PARTITION BY url, http_method ORDER BY s.score DESC, ts DESC NULLS LAST, doc_id) AS r FROM d JOIN s USING (doc_id))
SELECT url, http_method, doc_id FROM f WHERE r = 1 ORDER BY score DESC, ts DESC NULLS LAST, doc_id LIMIT 20""")
def searched_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question that names nothing stored: what a search found, best first."""
    docs = event_docs(spark, sf_dir)
    hits = docs.filter("doc_id % 50 = 0").select("doc_id", (F.col("doc_id") % 13).cast("double").alias("score"))
    return listing.find_resources(docs, "pages about rivers", limit=20, hits=hits).select("url", "http_method", "doc_id")


@register(_DOCS + ", n AS (SELECT * FROM d WHERE user_id = 5 AND http_method = 'GET' ORDER BY ts DESC, doc_id LIMIT 1000) SELECT DISTINCT url FROM n WHERE event_type LIKE 'c%'")
def recommended_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.recommend_urls(event_docs(spark, sf_dir), "https://u5.example.com/c")


@register(_DOCS + ", n AS (SELECT * FROM d WHERE http_method = 'GET' ORDER BY ts DESC, doc_id LIMIT 10000) SELECT DISTINCT 'https://' || host || ':443' AS url FROM n")
def recommended_netlocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing is stored of the asked netloc: a URL for each netloc among the newest rows."""
    return listing.recommend_urls(event_docs(spark, sf_dir), "https://zzz.example.net/")


@register(_DOCS + "SELECT DISTINCT 'https://' || host || ':443' AS url FROM d")
def recommended_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hosts are of one domain, so each netloc is recommended."""
    return listing.recommended_targets(event_docs(spark, sf_dir))


@register(_DOCS + "SELECT doc_id, 'url' AS label, (SELECT count(*) > 7 FROM d WHERE url = 'https://u2.example.com/click') AS has_more FROM d WHERE url = 'https://u2.example.com/click' ORDER BY ts DESC, doc_id LIMIT 7")
def queried_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a URL (asked with a slash more), newest first, and whether there are more."""
    found, label, more = listing.query_findings(event_docs(spark, sf_dir), "https://u2.example.com/click/", 7)
    return found.select("doc_id", F.lit(label).alias("label"), F.lit(more).alias("has_more"))


@register(_DOCS + "SELECT doc_id, url, substr('value ' || doc_id, 3, 5) AS text, CAST(length('value ' || doc_id) AS INTEGER) AS total_length, CAST(2 AS INTEGER) AS \"offset\", length('value ' || doc_id) > 7 AS has_more FROM d WHERE url = 'https://u4.example.com/view' ORDER BY ts DESC, doc_id LIMIT 1")
def fetched_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice of the newest content of a URL."""
    return listing.fetch_content(event_docs(spark, sf_dir), url="https://u4.example.com/view", start=2, length=5)


@register(_DOCS + "SELECT doc_id, host, CAST(CASE WHEN doc_id % 3 = 0 THEN -1 ELSE 443 END AS INTEGER) AS port, CASE WHEN doc_id % 2 = 0 THEN 'web://content/' || doc_id END AS link, CASE WHEN doc_id % 3 = 0 THEN 100.0 ELSE 0.0 END AS score FROM d")
def shown_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows with defaults: no port, no content, no score on some."""
    third = F.col("doc_id") % 3 == 0
    rows = event_docs(spark, sf_dir).withColumns({"port": F.when(~third, F.col("port")), "score": F.when(~third, F.col("score")), "content": F.when(F.col("doc_id") % 2 == 0, F.col("content"))})
    return listing.http_resource(rows).select("doc_id", "host", "port", "link", "score")


@register("""
WITH r AS (SELECT o_orderkey, o_orderdate, list(DISTINCT l_linenumber) AS ports FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = (SELECT max(o_custkey) FROM orders) AND o_orderstatus <> 'P' GROUP BY ALL)
SELECT o_orderkey AS run_id FROM r WHERE list_has_all(ports, [1, 2]) AND o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 87600 HOURS ORDER BY o_orderdate DESC, o_orderkey LIMIT 1""")
def covering_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest run of a customer's targets without error that covers two ports."""
    orders = table(spark, sf_dir, "orders")
    target, newest = orders.agg(F.max("o_custkey"), F.max("o_orderdate")).first()
    ports = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.collect_set("l_linenumber").alias("ports"))
    runs = orders.select(F.col("o_orderkey").alias("run_id"), F.lit(2).alias("version"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").cast("string").alias("targets"), (F.col("o_orderstatus") == "P").alias("has_error")).join(ports, "run_id")
    return listing.latest_covering_run(runs, str(target), [1, 2], F.lit(newest), days=3650).select("run_id")


@register("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_suppkey % 9 AS s, range(l_linenumber, l_linenumber + 4) AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, s, array_to_string(list_sort(CASE WHEN s = 0 THEN a ELSE list_intersect(a, [2, 4, s]) END), ',') AS common, s = 0 OR list_has_all([2, 4, s], a) AS covered FROM p""")
def port_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ports in two sets, and whether one covers the other; no set at all means all ports."""
    a = values.port_ranges(F.concat_ws("-", "l_linenumber", F.col("l_linenumber") + 3))
    b = values.port_ranges(F.when(F.col("s") != 0, F.concat_ws(",", F.lit("2"), F.lit("4"), "s")).otherwise(" , "))
    rows = dealt(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 9).alias("s"))
    sets = rows.select("*", F.inline(F.array(F.struct(a.alias("a"), b.alias("b")))))
    common = F.array_join(values.listed_ports(values.common_ranges(F.col("a"), F.col("b"))), ",")
    return sets.select("l_orderkey", "l_linenumber", "s", common.alias("common"), values.covers_ranges(F.col("a"), F.col("b")).alias("covered"))


@register(f"""
WITH l AS (SELECT DISTINCT lang AS label FROM documents WHERE lang IN ('en', 'fr')),
p AS (SELECT ['en', 'fr', 'de', 'es'][item_id % 4 + 1] AS label, CASE WHEN item_id % 2 = 0 THEN 'html' ELSE 'css' END AS doc_type, CASE WHEN item_id % 3 = 0 THEN 'at {{target}} ' || text ELSE text END AS pattern FROM benchmark),
f AS (SELECT DISTINCT doc_type, pattern FROM p JOIN l USING (label)), h AS (SELECT DISTINCT {_HOST} AS host FROM pages),
x AS (SELECT doc_type, pattern, 1 AS o FROM f WHERE pattern NOT LIKE '%{{target}}%' UNION ALL SELECT doc_type, replace(pattern, '{{target}}', host), 1 FROM f, h WHERE pattern LIKE '%{{target}}%' UNION ALL SELECT DISTINCT doc_type, 'asked', 0 FROM f),
y AS (SELECT doc_type, pattern, min(o) AS o FROM x GROUP BY ALL)
SELECT doc_type, pattern, CAST(row_number() OVER (PARTITION BY doc_type ORDER BY o, pattern) AS INTEGER) AS rank FROM y""")
def expanded_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of two labels (given as JSON) by document type, each filled by every host."""
    label = F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), (F.col("item_id") % 4 + 1).cast("int"))
    patterns = table(spark, sf_dir, "benchmark").select(label.alias("label"), F.when(F.col("item_id") % 2 == 0, "html").otherwise("css").alias("doc_type"), F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("at {target} "), F.col("text"))).otherwise(F.col("text")).alias("pattern"))
    said = table(spark, sf_dir, "documents").filter("lang IN ('en', 'fr')").select(F.to_json(F.array(F.upper("lang"))).alias("said"))
    hosts = page_facts(spark, sf_dir).select(F.col("host").alias("target"))
    return search.expand_patterns(search.label_list(said, "said"), patterns, hosts, 10, "asked")


@register(_BM25 + """, f1 AS (SELECT doc_id, score, row_number() OVER (PARTITION BY doc_id ORDER BY item_id, rank) AS first FROM k WHERE rank <= 10),
u AS (SELECT doc_id, score, row_number() OVER (PARTITION BY doc_id % 100 ORDER BY score DESC, doc_id) AS r FROM f1 WHERE first = 1)
SELECT doc_id, score FROM u WHERE r = 1 ORDER BY score DESC, doc_id LIMIT 50""")
def multi_query_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all benchmark items as queries: each document at its first query, the best by URL."""
    none = F.lit(None).cast("string")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 100).cast("string").alias("url"), none.alias("http_method"), none.cast("int").alias("status_code"), none.cast("timestamp").alias("ts"))
    hits = bm25_topk(spark, sf_dir).withColumnRenamed("item_id", "query_ix")
    return search.multi_query_search(hits, docs, 50).select("doc_id", "score")


@register("SELECT max(ts) AS latest, count(*) AS n, count(*) > 10 AS is_recent FROM events WHERE user_id = 1 AND ts >= (SELECT max(ts) FROM events) - INTERVAL 240 HOURS")
def prefix_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest time and number of rows of the last ten days under a URL prefix."""
    docs = event_docs(spark, sf_dir)
    newest = docs.agg(F.max("ts")).first()[0]
    return listing.freshness(docs, "https://u1.example.com/", F.lit(newest), hours=240)

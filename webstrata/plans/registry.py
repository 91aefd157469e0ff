"""The registered queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions import urls, values
from webstrata.operators import documents, listing, search
from webstrata.sources.shared import spread
from webstrata.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Captures need a time; pages have none, so all are of one fixed instant.
AS_OF = "2025-01-01 00:00:00"
EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that is heavy row by row."""
    return spread(table(spark, sf_dir, name))


def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.with_domain(urls.with_url_facts(table(spark, sf_dir, "pages").select("page_id", "url")))


def page_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captured exchanges: GET, status 200, an HTML body."""
    none = F.array().cast("array<struct<name:string,value:string>>")
    kind = F.array(F.struct(F.lit("Content-Type").alias("name"), F.lit("text/html; charset=utf-8").alias("value")))
    return dealt(spark, sf_dir, "pages").select(
        "page_id", "url", F.lit("GET").alias("method"), none.alias("request_headers"), F.lit(None).cast("string").alias("request_body"), F.lit(200).alias("status_code"),
        kind.alias("response_headers"), F.col("html").alias("response_body"), F.lit("2025-01-01T00:00:00Z").alias("timestamp"), F.lit(None).cast("double").alias("response_rtt"),
        F.lit(None).cast("double").alias("response_rtt_ms"), F.lit(None).cast("array<string>").alias("technologies"), F.lit(None).cast("array<map<string,string>>").alias("forms"),
    )


_HOST = r"lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))"
_DOMAIN = rf"array_to_string(list_slice(string_split({_HOST}, '.'), -2, -1), '.')"
_PORT = r"""coalesce(try_cast(nullif(regexp_extract(url, '^[a-z]+://[^/?#:]+:([0-9]+)', 1), '') AS INTEGER), CASE WHEN url LIKE 'https:%' THEN 443 ELSE 80 END)"""


@register(rf"""
SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, {_HOST} AS host, {_PORT} AS port, {_HOST} || ':' || {_PORT} AS netloc,
  regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS query, {_DOMAIN} AS domain FROM pages""")
def url_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_facts(spark, sf_dir).select("page_id", "url", "scheme", "host", "port", "netloc", "path", "query", "domain")


@register(f"SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1")
def host_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.count_by(page_facts(spark, sf_dir), "host")


@register(f"SELECT {_DOMAIN} AS domain, count(*) AS n FROM pages GROUP BY 1")
def domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.count_by(page_facts(spark, sf_dir), "domain")


@register(f"SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, host LIMIT 5")
def top_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.top_counts(host_counts(spark, sf_dir), "host")


@register(f"SELECT DISTINCT {_HOST} || ':' || {_PORT} AS netloc FROM pages")
def distinct_netlocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.distinct_values(page_facts(spark, sf_dir), "netloc", "host")


@register(f"SELECT count(DISTINCT {_DOMAIN}) AS n_domains, count(DISTINCT {_HOST}) AS n_hosts FROM pages")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.corpus_summary(page_facts(spark, sf_dir))


@register(rf"""
SELECT url FROM (SELECT url, max(page_id) AS ts FROM pages WHERE {_HOST} LIKE '%example.org' AND regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) LIKE '%/en%'
  GROUP BY url ORDER BY ts DESC, url LIMIT 100)""")
def find_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.find_urls(page_facts(spark, sf_dir).withColumn("ts", F.col("page_id")), "example.org", "/en")


@register(r"""
WITH v AS (SELECT page_id, url, regexp_extract(url, '^[^?]*') AS base, contains(url, '?') AS q FROM pages),
w AS (SELECT page_id, CASE WHEN q THEN base || '?' WHEN base LIKE '%/' THEN base ELSE base || '/' END AS prefix, url,
  CASE WHEN q THEN base END AS bare, CASE WHEN base LIKE '%/' THEN base[:-2] ELSE base || '/' END AS other FROM v)
SELECT page_id, prefix, unnest(list_filter([url, bare, other], lambda x: x IS NOT NULL)) AS variant FROM w""")
def url_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "pages").select("page_id", urls.url_variants(F.col("url")).alias("v"))
    return v.select("page_id", F.col("v.prefix").alias("prefix"), F.explode("v.urls").alias("variant"))


@register(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), ''), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS title FROM pages""")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.with_title_description(dealt(spark, sf_dir, "pages").withColumn("mime", F.lit("text/html")), "html", "mime").select("page_id", "title")


@register(rf"""
WITH h AS (SELECT DISTINCT {_HOST} AS host FROM pages), a AS (SELECT DISTINCT array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS asked FROM h)
SELECT asked, host FROM a JOIN h ON host = asked OR ends_with(host, '.' || asked)""")
def public_suffix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = page_facts(spark, sf_dir).select("host", "domain").distinct()
    return listing.hosts_under(hosts.select("host").distinct(), hosts.select(F.col("domain").alias("asked")))


@register(rf"""
WITH d AS (SELECT url, {_HOST} AS host, {_PORT} AS port FROM pages)
SELECT sha256(url || ':network:2025-01-01T') AS doc_id, 'network' AS doc_type, url, host FROM d
UNION ALL SELECT sha256(url || ':content:2025-01-01T:'), 'content', url, host FROM d""")
def derived_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents.derive_documents(page_exchanges(spark, sf_dir), F.lit(AS_OF).cast("timestamp"))
    return docs.select("doc_id", "doc_type", "url", "host")


@register("""
SELECT 'content' AS doc_type, count(*) AS n, count(DISTINCT sha256(html)) AS n_bodies FROM pages
UNION ALL SELECT 'network', count(*), 0 FROM pages""")
def collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents.derive_documents(page_exchanges(spark, sf_dir), F.lit(AS_OF).cast("timestamp"))
    return docs.groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("content_sha256").alias("n_bodies"))


@register()
def normalized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents.derive_documents(page_exchanges(spark, sf_dir), F.lit(AS_OF).cast("timestamp"))
    clean = documents.normalize_documents(docs.filter("doc_type = 'content'"))
    return clean.select("url", "normalized", F.sha2("content", 256).alias("content_sha256"), F.length("content").alias("n_chars"))


@register("""
SELECT sha256(text) AS content_sha256, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def content_hash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.sha2("text", 256).alias("content_sha256"), "doc_id")
    return docs.groupBy("content_sha256").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@register("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.lit("default").alias("doc_type"))
    stored = table(spark, sf_dir, "labels").select("doc_id", F.lit("default").alias("doc_type"))
    return documents.new_by_id(docs, stored).select("doc_id", "lang", "source")


@register("""
WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, w, unnest(range(CASE WHEN len(w) <= 119 THEN 1 ELSE 1 + CAST(ceil((len(w) - 119) / 104.0) AS BIGINT) END)) AS i FROM w)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_ix, CAST(i * 104 AS INTEGER) AS word_start, md5(array_to_string(list_slice(w, i * 104 + 1, i * 104 + 119), ' ')) AS chunk_md5 FROM c""")
def word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, overlap = documents.chunk_sizes(256, 2048)
    docs = dealt(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return documents.chunk_words(docs, "text", words, overlap, ["doc_id"]).select("doc_id", "chunk_ix", "word_start", F.md5("chunk").alias("chunk_md5"))


@register(r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\b\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}\b', '<NUMERIC_TOKEN>', 'g'), '\b[0-9a-f]{32,64}\b', '<NUMERIC_TOKEN>', 'g')) AS scrubbed_md5 FROM documents""")
def scrub_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, "documents").select("doc_id", F.md5(values.scrubbed(F.col("text"))).alias("scrubbed_md5"))


@register(r"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w, regexp_split_to_array(text, '[\p{L}\p{N}_]+') AS s FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d), k AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) // 2 + 1)) AS k FROM d),
b AS (SELECT doc_id, k, n - k * unnest(range(2, n // k + 1)) AS i FROM k),
c AS (SELECT b.* FROM b JOIN p x ON x.doc_id = b.doc_id AND x.i = b.i JOIN p y ON y.doc_id = b.doc_id AND y.i = b.i + b.k AND y.word = x.word),
f AS (SELECT doc_id, min([i, k]) AS f FROM c JOIN d USING (doc_id) WHERE list_slice(w, i + 1, i + k) = list_slice(w, i + k + 1, i + 2 * k) GROUP BY 1),
g AS (SELECT doc_id, f[1] AS i, f[2] AS k FROM f)
SELECT doc_id, md5(CASE WHEN k IS NOT NULL AND list_slice(w, i + 1, len(w) - k) = list_slice(w, i + k + 1, len(w))
  THEN array_to_string(list_transform(range(1, i + k + 1), lambda j: s[j] || w[j]), '') || regexp_extract(s[i + k + 1], '^[^\s]*') ELSE text END) AS collapsed_md5 FROM d LEFT JOIN g USING (doc_id)""")
def collapsed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, "documents").select("doc_id", F.md5(values.collapse_repeats("text")).alias("collapsed_md5"))


@register("""
SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''""")
def pattern_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.text_hits(dealt(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


_BM25 = r"""
WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY ALL),
l AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY doc_id), s AS (SELECT count(*) AS n, avg(dl) AS a FROM l),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark)),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
r AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score
  FROM q JOIN p USING (term) JOIN f USING (term) JOIN l USING (doc_id), s GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r)
"""


@register(_BM25 + "SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.sparse_topk(table(spark, sf_dir, "benchmark"), dealt(spark, sf_dir, "documents"), 10, "item_id", "doc_id").select("item_id", "doc_id", "score", "rank")


_DENSE = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 6) AS score FROM e q JOIN e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
"""


@register(_DENSE + "SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return search.dense_topk(asked, vectors, 10, "query_id", "vec_id").select("query_id", "vec_id", "score", "rank")


@register(_DENSE.replace("k AS (", "kd AS (").rstrip() + "," + _BM25.replace("WITH p AS", "p AS").replace("doc_id, term, count(*) AS tf FROM (SELECT doc_id", "doc_id, term, count(*) AS tf FROM (SELECT doc_id").replace("q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark))", "q AS (SELECT DISTINCT item_id, term FROM (SELECT doc_id AS item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents WHERE doc_id % 100 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)))").replace("s AS (SELECT count(*)", "st AS (SELECT count(*)").replace("JOIN l USING (doc_id), s GROUP", "JOIN l USING (doc_id), st GROUP").rstrip() + """,
u AS (SELECT query_id, vec_id AS doc_id, rank FROM kd WHERE rank <= 20 UNION ALL SELECT item_id, doc_id, rank FROM k WHERE rank <= 20),
g AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM u GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM g)
SELECT query_id, doc_id, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM h WHERE rank <= 10""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, docs = table(spark, sf_dir, "embeddings"), dealt(spark, sf_dir, "documents").select("doc_id", "text")
    asked = vectors.filter("vec_id % 100 = 0")
    dense = search.dense_topk(asked.withColumnRenamed("vec_id", "query_id"), vectors, 20, "query_id", "vec_id").withColumnRenamed("vec_id", "doc_id")
    texts = docs.join(asked.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").withColumnRenamed("doc_id", "query_id")
    sparse = search.sparse_topk(texts, docs, 20, "query_id", "doc_id")
    return search.fuse([dense, sparse], "query_id", "doc_id", 10).select("query_id", "doc_id", "score", "rank")


@register("""
SELECT doc_id, lang, CASE WHEN lang IN ('de', 'fr') AND n_chars <> 0 THEN n_chars * 10.0 ELSE CAST(n_chars AS DOUBLE) END AS score FROM documents""")
def boosted_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("lang").alias("doc_type"), F.col("n_chars").cast("double").alias("score"), F.lit(None).cast("timestamp").alias("ts"))
    parts = [docs.filter("lang IN ('en', 'es')"), docs.filter("lang NOT IN ('en', 'es') OR lang IS NULL")]
    return search.merge_collections(parts, ["de", "fr"]).select("doc_id", "lang", "score")


@register("""
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id) AS r FROM events) WHERE r = 1""")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.latest_snapshot(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@register("""
SELECT user_id, event_type, day, event_id FROM (SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts DESC NULLS LAST, event_id) AS r FROM events) WHERE r = 1""")
def daily_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return documents.latest_by(events, ["user_id", "event_type", "day"], "ts", "event_id").select("user_id", "event_type", "day", "event_id")


def _last_ts(events: DataFrame) -> Column:
    """The newest time as a literal: one value from one aggregate."""
    return F.lit(events.agg(F.max("ts")).first()[0])


@register("""
SELECT user_id, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 720 HOURS GROUP BY user_id HAVING count(*) > 10""")
def fresh_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return listing.fresh_keys(events, "user_id", "ts", _last_ts(events), hours=720).select("user_id", "n")


@register("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def props_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(values.map_column(F.col("props")), F.lit("k")).alias("k"))


@register("""
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_value FROM events""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("last_value", F.when(F.col("event_type") == "purchase", F.col("value")))
    return documents.carry_forward(events, ["user_id"], ["ts", "event_id"], ["last_value"]).select("event_id", "user_id", "last_value")


@register("""
WITH s AS (SELECT l_orderkey, list(DISTINCT l_linenumber) AS lines FROM lineitem GROUP BY 1), w AS (SELECT unnest([1, 2, 3]) AS wanted_id)
SELECT CAST(wanted_id AS INTEGER) AS wanted_id, l_orderkey AS run_id FROM s JOIN w ON list_has_all(lines, CASE wanted_id WHEN 1 THEN [1, 5] WHEN 2 THEN [2, 7] ELSE [6] END)""")
def covering_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("item"))
    wanted = spark.createDataFrame([(1, 1), (1, 5), (2, 2), (2, 7), (3, 6)], "wanted_id int, item int")
    return listing.covering_runs(wanted, runs)


@register("""
SELECT o_orderkey AS run_id, o_orderstatus, l_linenumber AS port, l_linestatus AS state FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'""")
def run_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run_id"), "o_orderstatus", F.col("o_orderdate").alias("ts"))
    ports = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_shipdate").alias("ts"), F.col("l_linenumber").alias("port"), F.col("l_linestatus").alias("state"))
    return listing.run_ports(runs, ports).select("run_id", "o_orderstatus", "port", "state")


@register("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def missing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").select("c_custkey")
    known = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return listing.missing_targets(asked, known, "c_custkey")


@register(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages WHERE contains(lower(url), 'en')),
c AS (SELECT page_id, path, list_filter(string_split(lower(path), '/'), lambda x: x <> '') AS parts FROM p WHERE contains(lower(path), 'en')),
d AS (SELECT page_id, path, list_concat(['/'], parts) AS parts FROM c),
e AS (SELECT page_id, path, parts, unnest(range(len(parts))) AS i FROM d),
s AS (SELECT page_id, path, max(CASE WHEN contains(parts[i + 1], 'en') THEN (CASE WHEN i = len(parts) - 1 THEN 0.6 ELSE 1.0 END) / (1 + i) + (CASE WHEN parts[i + 1] = 'en' THEN 0.5 ELSE 0 END) + 0.1 / strpos(parts[i + 1], 'en') ELSE 0 END) AS score FROM e GROUP BY ALL)
SELECT path, CAST(round(max(score), 9) AS DOUBLE) AS score FROM s GROUP BY path ORDER BY score DESC, length(path), path LIMIT 50""")
def ranked_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.rank_paths(page_facts(spark, sf_dir).select("path").distinct(), "en", 50).select("path", "score")


@register("""
SELECT user_id, sum(value) AS score_sum, avg(value) AS score_mean FROM (SELECT user_id, round(value, 2) AS value FROM events) GROUP BY 1""".replace("sum(value)", "round(sum(value), 4)").replace("avg(value)", "round(avg(value), 4)"))
def score_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.round("value", 2).alias("score"))
    return search.score_parts(events, "user_id").select("user_id", F.round("score_sum", 4).alias("score_sum"), F.round("score_mean", 4).alias("score_mean"))


@register("""
SELECT url, http_method, status_code, doc_id FROM (
  SELECT *, row_number() OVER (PARTITION BY url, http_method, status_code ORDER BY score DESC, ts DESC NULLS LAST, doc_id) AS r FROM (
    SELECT 'u' || user_id AS url, event_type AS http_method, CAST(200 AS INTEGER) AS status_code, event_id AS doc_id, ts, round(coalesce(value, 0), 1) AS score FROM events)) WHERE r = 1""")
def sorted_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("url"), F.col("event_type").alias("http_method"), F.lit(200).alias("status_code"), F.col("event_id").alias("doc_id"), "ts", F.round("value", 1).alias("score"))
    return documents.sort_unique(rows).select("url", "http_method", "status_code", "doc_id")


@register(f"""
WITH p AS (SELECT page_id, url, {_HOST} AS host, {_PORT} AS port FROM pages)
SELECT page_id, host, unnest(CASE WHEN page_id % 2 = 0 THEN [port] ELSE [80, 443] END) AS port FROM p""")
def port_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages asked for by URL on even ids, by bare host on odd ones: those fan out to two ports."""
    asked = table(spark, sf_dir, "pages").select("page_id", urls.target_struct(F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1))).alias("target"))
    return urls.with_port(asked).select("page_id", F.col("target.host").alias("host"), F.col("target.port").alias("port"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of files that arrive in the order of their weeks.

    So a watermark of some days drops state behind it, and no event is late.
    """
    from webstrata.sources.shared import shared_dir

    base = f"{shared_dir(spark)}/webstrata-{spark.sparkContext.applicationId}/events-{uuid.uuid4().hex}"
    week = F.floor(F.unix_timestamp("ts") / (7 * 86_400)).alias("week")
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props", week)
    weeks = [r[0] for r in events.select("week").distinct().orderBy("week").collect()]  # one value a week of time
    for w in weeks:
        events.filter(F.col("week").eqNullSafe(w)).drop("week").write.mode("append").parquet(base)
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 8).parquet(base)


@register("""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY ALL""")
def stream_day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by day and type of a file stream, run until nothing is left, kept by the newest update."""
    from webstrata.sources.shared import shared_dir

    base = f"{shared_dir(spark)}/webstrata-stream-{uuid.uuid4().hex}"
    events = event_stream(spark, sf_dir)

    def keep(df: DataFrame, number: int) -> None:
        df.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/b={number}")

    counts = ingest.day_counts(events, "event_type", late="8 days")
    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{base}/out")
    return rows.groupBy("day", "event_type").agg(F.max_by("n", "batch").alias("n"))


@register(f"SELECT page_id, {_HOST} AS host, {_PORT} AS port FROM pages")
def query_netlocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "pages").select("page_id", urls.query_netloc(F.col("url")).alias("q"))
    return asked.select("page_id", "q.host", "q.port")


@register(rf"""
WITH h AS (SELECT DISTINCT {_HOST} AS host FROM pages UNION SELECT '10.0.' || page_id % 250 || '.1' FROM pages UNION SELECT '9.9.' || page_id % 250 || '.1' FROM pages)
SELECT host, CASE WHEN host LIKE '10.%' THEN false WHEN host LIKE '9.%' THEN true ELSE NOT ends_with(host, '.example.org') AND host <> 'example.org' AND len(string_split(host, '.')) > CASE WHEN ends_with(host, '.example.net') THEN 3 ELSE 1 END END AS is_public,
  CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN '' WHEN ends_with(host, '.example.net') AND len(string_split(host, '.')) > 3 THEN array_to_string(list_slice(string_split(host, '.'), -4, -1), '.') ELSE array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') END AS domain FROM h""")
def public_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts and addresses under rules of a suffix table: a plain one, one with '*', and none for org."""
    rules = spark.createDataFrame([("com", False), ("net", False), ("*.example.net", False), ("other.org", True)], "suffix string, private boolean")
    pages = page_facts(spark, sf_dir).select("page_id", "host")
    address = lambda head: pages.select(F.concat(F.lit(head), F.col("page_id") % 250, F.lit(".1")).alias("host"))
    hosts = pages.select("host").unionByName(address("10.0.")).unionByName(address("9.9.")).distinct()
    return urls.with_domain(urls.with_public_target(hosts, rules), suffixes=rules).select("host", "is_public", "domain")


@register("""
SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct(list_concat(range(l_linenumber, l_linenumber + 3), [CAST(l_suppkey AS BIGINT)]))), ',') AS ports FROM lineitem""")
def expanded_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.concat_ws(",", F.concat_ws("-", "l_linenumber", F.col("l_linenumber") + 2), F.col("l_suppkey").cast("string"))
    rows = dealt(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", values.expand_ports(spec).alias("p"))
    return rows.select("l_orderkey", "l_linenumber", F.array_join("p", ",").alias("ports"))


@register("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || '|' || source ELSE lang || '|| ' || source END AS joined, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 3 END AS n FROM documents""")
def list_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as a JSON array on even ids, comma-separated on odd ones: parts stay as they stand, empty ones too."""
    text = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.array("lang", "source"))).otherwise(F.concat_ws(",", "lang", F.lit(""), F.concat(F.lit(" "), "source")))
    rows = table(spark, sf_dir, "documents").select("doc_id", values.list_column(text).alias("v"))
    return rows.select("doc_id", F.array_join("v", "|").alias("joined"), F.size("v").alias("n"))


@register(r"""
WITH h AS (SELECT doc_id, text, regexp_replace(substr(hex(encode(text)), 1, 2048), '([0-9A-F])[0-9A-F]', '\1', 'g') AS h FROM documents),
c AS (SELECT doc_id, text, length(regexp_replace(h, '[0-7]', '', 'g')) AS hi, length(h) AS n FROM h)
SELECT doc_id, coalesce(trim(text) <> '' AND hi > 0.15 * greatest(n - hi, 1), false) AS is_binary FROM c""")
def binary_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", values.is_binary(F.col("text"), F.lit("")).alias("is_binary"))


@register("""SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts FROM events""")
def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times written in three formats by id, and read back."""
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    kind = F.col("event_id") % 3
    text = (
        F.when(kind == 0, F.concat(F.lit("Sat "), F.date_format("ts", "MMM d HH:mm:ss"), F.lit(" UTC "), F.date_format("ts", "yyyy")))
        .when(kind == 1, F.concat(F.lit("Sat, "), F.date_format("ts", "d MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    return events.select("event_id", values.parsed_time(text).alias("ts"))


@register("""
SELECT doc_id, md5(substr(text, 101, 200)) AS slice_md5, CAST(length(text) AS INTEGER) AS total_length, length(text) > 300 AS has_more FROM documents""")
def content_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", values.page_slice(F.col("text"), 100, 200).alias("p"))
    return rows.select("doc_id", F.md5("p.text").alias("slice_md5"), "p.total_length", "p.has_more")


@register("""
WITH e AS (SELECT event_id, user_id, CAST(round(value) AS BIGINT) AS h, CAST(ts AS DATE) AS d FROM events),
old AS (SELECT * FROM e WHERE event_id % 2 = 0), new AS (SELECT * FROM e WHERE event_id % 2 = 1)
SELECT event_id FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.user_id = new.user_id AND old.h = new.h) AND NOT EXISTS (SELECT 1 FROM old WHERE old.user_id = new.user_id AND old.d = new.d)""")
def new_typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd events whose user has no even event of the same value (as hash) or day."""
    rows = table(spark, sf_dir, "events").select("event_id", F.lit(1).alias("version"), F.col("user_id").alias("url"), F.expr("bigint(round(value))").cast("string").alias("content_sha256"), F.to_date("ts").alias("ts"))
    return documents.new_typed(rows.filter("event_id % 2 = 1"), rows.filter("event_id % 2 = 0")).select("event_id")


@register(_BM25 + """, f1 AS (SELECT doc_id, item_id, score, row_number() OVER (PARTITION BY doc_id ORDER BY item_id, rank) AS first FROM k WHERE rank <= 10)
SELECT doc_id, item_id AS query_ix, score FROM f1 WHERE first = 1""")
def first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.first_hit(bm25_topk(spark, sf_dir).withColumnRenamed("item_id", "query_ix")).select("doc_id", "query_ix", "score")


@register("""SELECT url, 'GET' AS method, CAST(200 AS INTEGER) AS status_code, md5(html) AS body_md5 FROM pages""")
def routed_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as captures, katana JSON on even ids and HAR on odd ones, and read by the router."""
    from webstrata.operators.sinks import to_katana
    from webstrata.sources.captures import route_formats

    pages = page_exchanges(spark, sf_dir)
    entry = F.struct(
        F.col("timestamp").alias("startedDateTime"), F.struct("method", "url").alias("request"),
        F.struct(F.col("status_code").alias("status"), F.col("response_headers").alias("headers"), F.struct(F.col("response_body").alias("text")).alias("content")).alias("response"),
    )
    har = pages.filter("page_id % 2 = 1").select(F.to_json(F.struct(F.struct(F.array(entry).alias("entries")).alias("log"))).alias("value"))
    good, _ = route_formats(to_katana(pages.filter("page_id % 2 = 0")).unionByName(har), F.lit(AS_OF).cast("timestamp"))
    return good.select("url", "method", "status_code", F.md5("response_body").alias("body_md5"))


@register("""SELECT url AS target, md5(html) AS markdown_md5 FROM pages""")
def parsed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding on each page, written as JSON and read by the findings reader."""
    from webstrata.sources.findings import parse_findings

    items = table(spark, sf_dir, "pages").select(F.to_json(F.struct(F.col("url").alias("target"), F.col("html").alias("markdown"))).alias("item"))
    return parse_findings(items)[0].select("target", F.md5("markdown").alias("markdown_md5"))


@register("""
WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, w, unnest(range(CASE WHEN len(w) <= 119 THEN 1 ELSE 1 + CAST(ceil((len(w) - 119) / 104.0) AS BIGINT) END)) AS i FROM w)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_ix, CAST(256 AS INTEGER) AS size, CASE WHEN regexp_matches(array_to_string(list_slice(w, i * 104 + 1, i * 104 + 119), ' '), '[^\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]') THEN 1.0 ELSE 0.0 END AS norm, '' AS embedding_error FROM c""")
def embedded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents with the default embedder, whole: vectors of 256 components and of unit length."""
    words, overlap = documents.chunk_sizes(256, 2048)
    chunks = documents.chunk_words(dealt(spark, sf_dir, "documents").filter("text IS NOT NULL"), "text", words, overlap, ["doc_id"])
    rows = search.embed(chunks, "chunk", first_chars=None)
    norm = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4)
    return rows.select("doc_id", "chunk_ix", F.size("embedding").alias("size"), norm.alias("norm"), F.coalesce("embedding_error", F.lit("")).alias("embedding_error"))


@register("""SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events""")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file stream of events deduped by user, type and day, run until nothing is left."""
    from webstrata.sources.shared import shared_dir

    base = f"{shared_dir(spark)}/webstrata-stream-{uuid.uuid4().hex}"
    events = event_stream(spark, sf_dir)
    keyed = events.withColumn("day", F.to_date("ts")).withColumn("doc_id", F.concat_ws("|", "user_id", "event_type", "day"))
    first = ingest.first_seen(keyed, "8 days").select("user_id", "event_type", "day")
    first.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")

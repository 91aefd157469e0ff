"""Listings, counts, freshness and lookups over the stored corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webstrata.functions.urls import target_struct, target_url, url_struct, url_variants
from webstrata.functions.values import page_slice
from webstrata.operators.documents import sort_unique
from webstrata.operators.sinks import stored_documents


def clamp(limit: int | None, low: int = 10, high: int = 1000, default: int = 100) -> int:
    return default if limit is None else max(low, min(high, limit))


def scan_corpus(spark: SparkSession, path: str, version: int, columns: Sequence[str] | None = None, predicate: Column | None = None, newest_first: bool = False) -> DataFrame:
    """Stored rows of one version, some columns and a predicate; columns and partitions reach the Parquet scan."""
    rows = stored_documents(spark, path).filter(F.col("version") == version)
    rows = rows if predicate is None else rows.filter(predicate)
    rows = rows.orderBy(F.desc("ts")) if newest_first else rows
    return rows if columns is None else rows.select(*columns)


# --- predicates ---------------------------------------------------------------------------------


def in_values(column: str, values: Sequence | None) -> Column | None:
    """Equality with one value, IN for several, no condition for none; nulls don't count."""
    some = [v for v in values or () if v is not None]
    return None if not some else F.col(column) == some[0] if len(some) == 1 else F.col(column).isin(some)


def all_of(*conditions: Column | None) -> Column:
    """Conjunction of the conditions given."""
    out = F.lit(True)
    for c in conditions:
        out = out if c is None else out & c
    return out


def host_ends_with(host: str, port: int | None = None, boundary: bool = False) -> Column:
    """Hosts that end with a text (or are it, or lie under it, with ``boundary``) and the exact port."""
    named = (F.col("host") == host) | F.col("host").endswith("." + host) if boundary else F.col("host").endswith(host)
    return named & (F.col("port") == port) if port and port > 0 else named


def holds_text(column: str, text: str | None, case_blind: bool = False) -> Column:
    """Values that hold a text (domains are compared without case); no text means all."""
    if not text:
        return F.lit(True)
    return F.lower(column).contains(text.lower()) if case_blind else F.col(column).contains(text)


def below_prefix(prefix: str, exact: Sequence[str]) -> Column:
    return F.col("url").startswith(prefix) & ~F.col("url").isin(list(exact))


def recent(ts: str, as_of: Column, hours: int) -> Column:
    return F.col(ts) >= as_of - F.expr(f"INTERVAL {hours} HOURS")


def complete(df: DataFrame) -> DataFrame:
    """Rows that have a URL, a MIME type and a time."""
    return df.filter("url IS NOT NULL AND url <> '' AND content_type IS NOT NULL AND content_type <> '' AND ts IS NOT NULL")


def without_errors(df: DataFrame, content: str = "content") -> DataFrame:
    return df.filter(~F.coalesce(F.col(content).contains("ERROR: Script execution failed"), F.lit(False)))


# --- counts -------------------------------------------------------------------------------------


def count_by(df: DataFrame, column: str) -> DataFrame:
    """Rows by lower-cased, non-empty value."""
    return df.select(F.lower(column).alias(column)).filter(F.col(column) != "").groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def count_by_collection(df: DataFrame) -> DataFrame:
    return df.groupBy("doc_type", "token_length").agg(F.count(F.lit(1)).alias("n"))


def list_collections(df: DataFrame) -> DataFrame:
    return df.select("doc_type", "token_length").distinct()


def distinct_values(df: DataFrame, column: str, fallback: str | None = None, holds: str | None = None) -> DataFrame:
    """Sorted distinct lower-cased values, of those that hold a text; an empty one is taken from ``fallback``."""
    own = F.when(F.trim(column) != "", F.col(column))
    value = F.lower(own if fallback is None else F.coalesce(own, F.col(fallback)))
    return df.select(value.alias(column)).filter((F.col(column) != "") & holds_text(column, holds, case_blind=True)).distinct().orderBy(column)


def day_sketches(df: DataFrame, keys: Sequence[str], value: str, ts: str, precision: int = 14) -> DataFrame:
    """A sketch of the distinct values of each day and key, to be stored: day, keys, sketch. Nulls don't count.

    Sketches of several days merge, so a distinct count over any range needs no scan of the rows.
    """
    return df.groupBy(F.to_date(ts).alias("day"), *keys).agg(F.hll_sketch_agg(value, precision).alias("sketch"))


def distinct_in_days(sketches: DataFrame, keys: Sequence[str], first: Column, last: Column) -> DataFrame:
    """Estimated distinct values of each key from ``first`` to ``last`` (dates), by merging the days' sketches.

    The standard error is 0.65 / 2^(precision / 2): half a percent at precision 14.
    """
    return sketches.filter(F.col("day").between(first, last)).groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


def corpus_summary(df: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(count(F.lower(F.when(F.col("domain") != "", F.col("domain")))).alias("n_domains"), count(F.lower(F.when(F.col("host") != "", F.col("host")))).alias("n_hosts"))


def freshness(df: DataFrame, prefix: str, as_of: Column, hours: int = 24, more_than: int = 10) -> DataFrame:
    """Latest time and number of rows under a URL prefix in the last hours; recent if more than 10."""
    rows = df.filter(F.col("url").startswith(prefix)).filter(recent("ts", as_of, hours))
    return rows.agg(F.max("ts").alias("latest"), F.count(F.lit(1)).alias("n")).withColumn("is_recent", F.col("n") > more_than)


def fresh_keys(df: DataFrame, key: str, ts: str, as_of: Column, hours: int = 24, more_than: int = 10) -> DataFrame:
    """The same for every key at once: keys with more than 10 rows in the last hours."""
    counts = df.filter(recent(ts, as_of, hours) & (F.col(ts) <= as_of)).groupBy(key).agg(F.max(ts).alias("latest"), F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > more_than)


def top_counts(counts: DataFrame, column: str, n: int = 5) -> DataFrame:
    return counts.orderBy(F.desc("n"), column).limit(n)


def recent_urls(df: DataFrame, n: int = 5) -> DataFrame:
    return df.orderBy(F.desc("ts"), "url").select("url", "ts").limit(n)


def find_urls(df: DataFrame, host: str, path: str | None = None, limit: int | None = None) -> DataFrame:
    """The newest distinct URLs under a host whose path holds a text, sorted by text."""
    rows = df.filter(host_ends_with(host))
    rows = rows.filter(holds_text("path", path))
    newest = rows.groupBy("url").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), "url").limit(clamp(limit))
    return newest.select("url").orderBy("url")


# --- joins --------------------------------------------------------------------------------------


def missing_targets(targets: DataFrame, known: DataFrame, on: str = "netloc") -> DataFrame:
    """Requested targets of which nothing is stored."""
    return targets.join(known.select(on).distinct(), on, "left_anti")


def hosts_under(hosts: DataFrame, asked: DataFrame, host: str = "host", suffix: str = "asked") -> DataFrame:
    """Known hosts at or under asked ones: a host's own suffixes meet the asked names by equality."""
    labels = F.split(host, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = hosts.select(F.col(host), F.explode(tails).alias(suffix))
    return each.join(asked.select(suffix).distinct(), suffix).select(suffix, host)


def covering_runs(wanted: DataFrame, runs: DataFrame) -> DataFrame:
    """(wanted_id, run_id) where every wanted item is covered. wanted: id, item; runs: run_id, item."""
    sizes = wanted.select("wanted_id", "item").distinct().groupBy("wanted_id").agg(F.count(F.lit(1)).alias("size"))
    hits = wanted.select("wanted_id", "item").distinct().join(runs.select("run_id", "item").distinct(), "item").groupBy("wanted_id", "run_id").agg(F.count(F.lit(1)).alias("hits"))
    return hits.join(sizes, "wanted_id").filter("hits = size").select("wanted_id", "run_id")


def latest_covering_run(runs: DataFrame, targets: str, ports: Sequence[int], as_of: Column, version: int = 2, days: int = 7) -> DataFrame:
    """The newest run of the same targets, at most 7 days old, without error, that covers the ports.

    ports [0] means any.  runs: run_id, version, ts, targets, ports (array, null for all), has_error.
    """
    fits = runs.filter((F.col("targets") == targets) & (F.col("version") == version) & ~F.col("has_error")).filter(recent("ts", as_of, 24 * days))
    if list(ports) != [0]:
        fits = fits.filter(F.col("ports").isNull() | (F.size(F.array_except(F.array(*[F.lit(p) for p in ports]), "ports")) == 0))
    return fits.orderBy(F.desc("ts"), "run_id").limit(1)


def run_ports(runs: DataFrame, ports: DataFrame) -> DataFrame:
    """Runs with their port observations."""
    return runs.join(ports.drop("ts"), "run_id")


# --- lookups ------------------------------------------------------------------------------------


def fetch_content(df: DataFrame, doc_type: str | None = None, doc_id: str | None = None, url: str | None = None, start: int = 0, length: int = 10_000) -> DataFrame:
    """A slice of one document: by type and id, else the newest by URL."""
    rows = df.filter((F.col("doc_type") == doc_type) & (F.col("doc_id") == doc_id)) if doc_id is not None else df.filter(F.col("url") == url)
    one = rows.orderBy(F.desc("ts"), "doc_id").limit(1)
    return one.select("doc_id", "url", page_slice(F.col("content"), start, length).alias("page")).select("doc_id", "url", "page.*")


def find_resources(df: DataFrame, url: str, limit: int | None = None, methods: Sequence[str] | None = None, hits: DataFrame | None = None) -> DataFrame:
    """Lookup cascade, first non-empty wins: the URL and what lies below it, its host:port, its host, search.

    ``hits`` (doc_id, score) are what a search for the query found; they count where nothing is known by name.
    """
    spark, n = df.sparkSession, clamp(limit)
    row = spark.range(1).select(url_variants(F.lit(url)).alias("v"), url_struct(F.lit(url)).alias("u")).first()
    prefix, exact, facts = row["v"]["prefix"], list(row["v"]["urls"]), row["u"]
    base = df if "score" in df.columns else df.withColumn("score", F.lit(0.0))
    base = base.filter(all_of(in_values("http_method", methods)))
    stages = [F.col("url").isin(exact) | below_prefix(prefix, exact)] if "://" in url else []
    if facts is not None:
        stages += [F.col("netloc") == facts["netloc"], F.col("host") == facts["host"]]
    for condition in stages:
        found = base.filter(condition)
        if not found.limit(1).isEmpty():
            return sort_unique(found, n)
    if hits is None:
        return base.limit(0)
    best = hits.groupBy("doc_id").agg(F.max("score").alias("score"))
    return sort_unique(base.drop("score").join(best, "doc_id"), n).select(*base.columns)


def http_resource(df: DataFrame) -> DataFrame:
    """Result rows with defaults; a link only where content, URL and type exist; no score means 100."""
    linked = (F.col("content") != "") & (F.col("url") != "") & (F.col("content_type") != "")
    return df.select(
        "doc_id", "url", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("port", F.lit(-1)).alias("port"), F.coalesce("domain", F.lit("")).alias("domain"),
        F.coalesce("http_method", F.lit("GET")).alias("http_method"), F.coalesce("status_code", F.lit(200)).alias("status_code"),
        F.when(linked, F.concat(F.lit("web://"), F.col("doc_type"), F.lit("/"), F.col("doc_id"))).alias("link"), F.coalesce("score", F.lit(100.0)).alias("score"),
    )


#: Headers that hold for one hop only.
HOP = ("connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade", "proxy-connection", "content-length", "content-encoding")


def replay_body(df: DataFrame) -> DataFrame:
    """Bytes to replay: base64 bodies decoded (bad ones empty), hop headers removed."""
    coded = F.exists("response_headers", lambda h: (F.lower(h["name"]).isin("transfer-encoding", "content-transfer-encoding")) & (F.lower(h["value"]) == "base64"))
    body = F.when(coded, F.coalesce(F.expr("try_to_binary(content, 'base64')"), F.lit(b""))).otherwise(F.encode("content", "UTF-8"))
    kept = F.filter("response_headers", lambda h: ~F.lower(h["name"]).isin(*HOP, "content-transfer-encoding"))
    return df.withColumns({"body": body, "response_headers": kept})


def recommend_urls(df: DataFrame, url: str, limit: int = 1000, most_recent: int = 10_000) -> DataFrame:
    """GET URLs of the same netloc whose path begins like the asked one; else all of the netloc.

    Where nothing of the netloc is stored: a URL for each netloc among the newest rows.
    """
    facts = df.sparkSession.range(1).select(url_struct(F.lit(url)).alias("u")).first()["u"]
    got = df.filter(F.col("http_method") == "GET")
    if facts is not None:
        rows = got.filter(F.col("netloc") == facts["netloc"]).orderBy(F.desc("ts"), "doc_id").limit(limit)
        under = rows.filter(url_struct(F.col("url"))["path"].startswith(facts["path"]))
        for found in (under, rows):
            if not found.isEmpty():
                return found.select("url").distinct().orderBy("url")
    newest = got.orderBy(F.desc("ts"), "doc_id").limit(most_recent).select("netloc").distinct()
    return newest.select(target_url(target_struct(F.col("netloc"))).alias("url")).filter("url IS NOT NULL").distinct().orderBy("url")


def recommended_targets(df: DataFrame) -> DataFrame:
    """One URL a netloc, given only when all netlocs share exactly one domain."""
    one = df.agg(F.countDistinct("domain").alias("n")).filter("n = 1")
    secure = F.pmod("port", F.lit(1000)) == 443
    urls = df.select(F.concat(F.when(secure, "https://").otherwise("http://"), F.col("netloc")).alias("url"), F.lit(1).alias("n")).distinct()
    return urls.join(one, "n", "left_semi").select("url")


def query_findings(df: DataFrame, target: str, limit: int | None = None) -> tuple[DataFrame, str, bool]:
    """Findings by URL variants, else netloc, host, domain; the label that hit; whether there are more."""
    n = clamp(limit, 1)
    row = df.sparkSession.range(1).select(url_variants(F.lit(target)).alias("v"), url_struct(F.lit(target if "://" in target else f"http://{target}")).alias("u")).first()
    stages: list[tuple[str, Column]] = []
    if "://" in target:
        stages.append(("url", F.col("url").isin(list(row["v"]["urls"]))))
    if row["u"] is not None:
        stages += [("netloc", F.col("netloc") == row["u"]["netloc"]), ("host", F.col("host") == row["u"]["host"]), ("domain", (F.col("domain") == row["u"]["host"]))]
    for label, condition in stages:
        found = df.filter(condition)
        if not found.limit(1).isEmpty():
            return found.orderBy(F.desc("ts"), "doc_id").limit(n), label, len(found.select("doc_id").limit(n + 1).collect()) > n
    return df.limit(0), "none", False


def rank_paths(paths: DataFrame, query: str, limit: int = 20, path: str = "path") -> DataFrame:
    """Paths by how well their components match the words of a query, best first.

    A word scores by its best component: 1 for a directory or 0.6 for the file, over its place, plus
    0.5 if equal, plus 0.1 over where it begins.  Ties: the shorter path, then by text.
    """
    words = query.lower().split()
    windows = F.col(path).contains("\\") & (F.col(path).contains(":") | (F.length(F.regexp_replace(path, r"[^\\]", "")) >= F.length(F.regexp_replace(path, "[^/]", ""))))
    rooted = F.when(F.col(path).startswith("/"), F.array(F.lit("/"))).otherwise(F.array().cast("array<string>"))
    comps = F.when(windows, F.split(path, r"\\+")).otherwise(F.concat(rooted, F.filter(F.split(path, "/"), lambda c: c != "")))
    rows = paths.filter(all_of(*[F.lower(path).contains(w) for w in words]) if words else F.lit(True)).withColumn("_c", F.transform(comps, lambda c: F.lower(c)))

    def best(w: str) -> Column:
        def one(c: Column, i: Column) -> Column:
            place = F.when(i == F.size("_c") - 1, 0.6).otherwise(1.0) / (i + 1)
            begins = F.length(F.substring_index(c, w, 1)) + 1
            return F.when(c.contains(w), place + F.when(c == w, 0.5).otherwise(0.0) + F.lit(0.1) / begins).otherwise(0.0)

        return F.array_max(F.transform("_c", one))

    total = F.lit(0.0)
    for w in words:
        total = total + best(w)
    score = total / max(1, len(words))
    ranked = rows.withColumn("score", F.round(score, 9)).drop("_c")
    return ranked.orderBy(F.desc("score"), F.length(path), path).limit(limit)


def row_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """The first k rows of each key."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(out) <= k)

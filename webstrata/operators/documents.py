"""Documents from exchanges: derivation, dedupe, chunks, and content jobs."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator
from math import floor
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from webstrata.functions.urls import with_domain, with_url_facts
from webstrata.functions.values import cache_key, day_bucket, doc_type_of, header_value, is_binary, plain_text, scrubbed, sha_id, with_timestamp
from webstrata.operators.bodies import known_bodies, store_bodies
from webstrata.operators.html_tree import rebuilt
from webstrata.operators.sinks import _exists
from webstrata.sources.schema import CODE_TOKENS, DEFAULT_TOKENS, DOC_TYPES, WEB_RESOURCE_VERSION

TITLE_METAS = (("property", "og:title"), ("name", "twitter:title"), ("itemprop", "name"))
DESCRIPTION_METAS = ("description", "og:description", "twitter:description")


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """Character references decoded."""
    return texts.map(lambda t: None if t is None else html.unescape(t))


def _attribute(tag: Column, name: str) -> Column:
    return F.concat(F.regexp_extract(tag, rf'(?is)\b{name}\s*=\s*"([^"]*)"', 1), F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*'([^']*)'", 1))


def title_and_description(page: Column) -> tuple[Column, Column]:
    """The <title>, else the first title in meta tags; the last description in meta tags."""
    metas = F.regexp_extract_all(page, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    filled = lambda c: F.when(c != "", c)
    titles = [filled(squeeze(F.regexp_extract(page, r"(?is)<title\b[^>]*>(.*?)</title>", 1)))]

    def first_of(key: str, value: str) -> Column:
        named = F.filter(metas, lambda m: (F.lower(_attribute(m, key)) == value) | (F.lower(_attribute(m, "name" if key == "property" else key)) == value))
        return filled(squeeze(_attribute(F.get(named, F.lit(0)), "content")))

    titles += [first_of(key, value) for key, value in TITLE_METAS]
    told = F.filter(metas, lambda m: (F.lower(_attribute(m, "name")).isin(*DESCRIPTION_METAS) | F.lower(_attribute(m, "property")).isin(*DESCRIPTION_METAS) | (F.lower(_attribute(m, "itemprop")) == "description")) & (F.trim(_attribute(m, "content")) != ""))
    description = F.when(F.size(told) > 0, filled(squeeze(_attribute(F.element_at(told, -1), "content"))))
    return F.coalesce(*titles), description


def with_title_description(df: DataFrame, page: str, mime: str) -> DataFrame:
    """Add title and description of text/html pages; others get nulls."""
    title, description = title_and_description(F.col(page))
    is_html = F.col(mime) == "text/html"
    return df.withColumns({"title": unescape(F.when(is_html, title)), "description": unescape(F.when(is_html, description))})


def header_text(headers: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(headers), lambda h: F.concat(h["name"], F.lit(": "), F.coalesce(h["value"], F.lit("")))), "\n")


def forms_json(forms: Column) -> Column:
    """Compact JSON of forms ordered by method and action, keys in order."""
    order = lambda f: F.concat(F.coalesce(f["method"], F.lit("GET")), F.lit("."), F.coalesce(f["action"], F.lit("")))
    entry = lambda e: F.concat(F.to_json(F.create_map(e["key"], e["value"])))
    one = lambda f: F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(f)), lambda e: F.regexp_extract(entry(e), r"(?s)^\{(.*)\}$", 1)), ","), F.lit("}"))
    ordered = F.array_sort(F.transform(forms, lambda f: F.struct(order(f).alias("o"), one(f).alias("j"))))
    return F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["j"]), ","), F.lit("]"))


def derive_documents(exchanges: DataFrame, as_of: Column) -> DataFrame:
    """Up to three rows for each exchange: content (a text body), network (always), forms (if any).

    Exchanges without a valid URL give none.  Ids follow from URL, kind, day and cache key alone.
    """
    rows = with_domain(with_url_facts(exchanges, "url")).filter("host IS NOT NULL")
    rows = with_timestamp(rows, "timestamp", as_of)
    mime = F.lower(F.trim(F.split_part(F.coalesce(header_value(F.col("response_headers"), "content-type"), F.lit("")), F.lit(";"), F.lit(1))))
    body = F.make_valid_utf8(F.col("response_body")) if hasattr(F, "make_valid_utf8") else F.col("response_body")
    rows = with_title_description(rows.withColumns({"mime": mime, "body": body}), "body", "mime")
    url, day = F.col("url"), day_bucket(F.col("ts_text"))
    has_body = (F.coalesce(F.col("body"), F.lit("")) != "") & ~is_binary(F.col("body"), F.col("mime"))
    network = F.concat(F.lit("--- HTTP Request Headers ---\n"), header_text(F.col("request_headers")), F.lit("\n--- HTTP Response Headers ---\n"), header_text(F.col("response_headers")))

    def part(kind: str, doc_id: Column, content: Column, content_type: Column, description: Column) -> Column:
        return F.struct(F.lit(kind).alias("doc_type"), doc_id.alias("doc_id"), content.alias("content"), content_type.alias("content_type"), description.alias("description"))

    parts = F.array(
        F.when(has_body, part("content", sha_id(url, F.lit("content"), day, cache_key(F.col("response_headers"))), F.col("body"), F.col("mime"), F.col("description"))),
        part("network", sha_id(url, F.lit("network"), day), network, F.lit("text/plain"), F.lit("HTTP request and response headers")),
        F.when(F.size("forms") > 0, part("forms", sha_id(url, F.lit("forms"), day), forms_json(F.col("forms")), F.lit("text/json"), F.lit("HTTP form information in JSON format"))),
    )
    each = rows.withColumn("_p", F.explode(F.array_compact(parts)))
    keep_headers = F.col("_p.doc_type") != "forms"
    return each.select(
        "_p.doc_id", F.lit(None).cast("string").alias("parent_id"), "_p.doc_type",
        F.when(F.col("_p.doc_type") == "forms", 256).cast("int").alias("token_length"), F.lit(WEB_RESOURCE_VERSION).alias("version"),
        "url", "netloc", "host", "port", "domain", "ts", "ts_text", "_p.content_type", "status_code", F.col("method").alias("http_method"), "technologies",
        "title", "_p.description", "response_rtt",
        F.when(keep_headers, F.col("request_headers")).alias("request_headers"), F.when(keep_headers, F.col("response_headers")).alias("response_headers"),
        F.when(F.col("_p.doc_type") == "content", F.sha2("_p.content", 256)).alias("content_sha256"), F.lit(False).alias("normalized"), "_p.content",
    )


# --- dedupe -------------------------------------------------------------------------------------


def new_by_id(df: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows whose (doc_type, doc_id) is not stored yet."""
    return df.join(existing.select("doc_type", "doc_id").distinct(), ["doc_type", "doc_id"], "left_anti")


def new_typed(df: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows with neither the hash nor the time of a stored row of the same version and URL.

    Two anti joins, since one with OR would be a nested loop; rows without a hash skip the first.
    """
    known = existing.select("version", "url", "content_sha256", "ts")
    hashed = df.join(known.filter("content_sha256 <> ''").select("version", "url", "content_sha256").distinct(), ["version", "url", "content_sha256"], "left_anti")
    return hashed.join(known.select("version", "url", "ts").distinct(), ["version", "url", "ts"], "left_anti").select(*df.columns)


def latest_by(df: DataFrame, keys: list[str], ts: str = "ts", tie: str = "doc_id") -> DataFrame:
    """The newest row of each key; ties go to the smallest ``tie``."""
    order = Window.partitionBy(*keys).orderBy(F.col(ts).desc_nulls_last(), tie)
    return df.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def daily_dedupe(df: DataFrame) -> DataFrame:
    """One document for each id (URL, kind, day, cache key), the newest."""
    return latest_by(df, ["doc_type", "doc_id"], tie="content_sha256")


def latest_snapshot(df: DataFrame, keys: list[str], ts: str = "ts", tie: str = "doc_id") -> DataFrame:
    return latest_by(df, keys, ts, tie)


def sort_unique(df: DataFrame, limit: int | None = None) -> DataFrame:
    """First row of each (url, method, status) by score and time, in that order; then the limit."""
    key = [F.col("url"), F.coalesce("http_method", F.lit("GET")), F.coalesce("status_code", F.lit(200))]
    order = [F.coalesce("score", F.lit(0.0)).desc(), F.col("ts").desc_nulls_last(), F.col("doc_id")]
    best = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rank = 1").drop("_rank").orderBy(*order)
    return best if limit is None else best.limit(limit)


def first_hit(df: DataFrame) -> DataFrame:
    """Each document's hit of the earliest query (query_ix), at its score there."""
    order = Window.partitionBy("doc_id").orderBy("query_ix", "rank")
    return df.withColumn("_first", F.row_number().over(order)).filter("_first = 1").drop("_first")


def carry_forward(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Missing values filled by the last one known for the same key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def carry_forward_title(df: DataFrame) -> DataFrame:
    """Title and description of status 200, non-network rows carried forward by URL."""
    fits = (F.col("status_code") == 200) & (F.col("doc_type") != "network")
    filled = carry_forward(df.filter(fits), ["url"], ["ts", "doc_id"], ["title", "description"])
    return filled.unionByName(df.filter(~F.coalesce(fits, F.lit(False))))


# --- chunks -------------------------------------------------------------------------------------


def chunk_sizes(token_length: int | None, model_max: int) -> tuple[int, int]:
    """Words and overlap of a chunk for a token length (none: the model's)."""
    longest = 512 if model_max > 1_000_000 else model_max
    target = min(token_length or longest, longest)
    return int(floor(target * 0.93) / 2), int(floor(target * 0.06))


def chunk_words(df: DataFrame, content: str, words: int, overlap: int, keep: list[str]) -> DataFrame:
    """A row for each window of ``words`` words; neighbours share ``overlap``. No shuffle."""
    step = words - overlap
    parts = F.split(F.col(content), " ")
    count = F.when(F.size("_w") <= words, 1).otherwise(1 + F.ceil((F.size("_w") - words) / step)).cast("int")
    split = df.withColumn("_w", parts).withColumn("_n", count)
    each = split.select(*keep, F.posexplode(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.array_join(F.slice("_w", i * step + 1, F.lit(words)), " "))).alias("chunk_ix", "chunk"))
    return each.withColumn("word_start", F.col("chunk_ix") * step)


def chunk_documents(df: DataFrame) -> DataFrame:
    """Chunks of typed documents at each token length of their type; ids are <typed id>_<i>.

    doc_type is the logical type (html, json, ...); rows need url, MIME and time.
    """
    ready = df.filter("url <> '' AND content_type <> '' AND ts IS NOT NULL AND content IS NOT NULL")
    out = None
    for kind, (lengths, code) in DOC_TYPES.items():
        for length in lengths:
            words, overlap = chunk_sizes(length, CODE_TOKENS if code else DEFAULT_TOKENS)
            rows = ready.filter(F.col("doc_type") == kind)
            key = cache_key(F.col("response_headers"))
            rows = rows.withColumn("parent_id", sha_id(F.col("url"), F.lit(kind), F.lit(length), day_bucket(F.col("ts_text")), key))
            part = chunk_words(rows, "content", words, overlap, ["parent_id", "doc_type", "url", "ts"]).withColumn("token_length", F.lit(length).cast("int"))
            out = part if out is None else out.unionByName(part)
    return out.withColumn("chunk_id", F.concat("parent_id", F.lit("_"), F.col("chunk_ix").cast("string")))


# --- content jobs -------------------------------------------------------------------------------

DYNAMIC = {"nonce", "data-reactroot", "data-hydration-id"}

def _html(text: str) -> str:
    """The page's whole tree, see html_tree: no doctype, lower-case names, ordered attributes, squeezed text. References are escaped."""
    return rebuilt(text, DYNAMIC)


def _xml(text: str) -> str:
    """Indented again, blank text dropped; documents with a DTD are refused."""
    out: list[str] = []
    depth = 0
    pending: list[str] = []
    parser = expat.ParserCreate()

    def refuse(*_: object) -> None:
        raise ValueError("document type declarations are refused")

    def text_out() -> None:
        data = "".join(pending).strip()
        pending.clear()
        if data:
            out.append("  " * depth + html.escape(data, quote=False))

    def start(name: str, attrs: dict[str, str]) -> None:
        nonlocal depth
        text_out()
        out.append("  " * depth + f"<{name}" + "".join(f' {k}="{html.escape(v)}"' for k, v in attrs.items()) + ">")
        depth += 1

    def end(name: str) -> None:
        nonlocal depth
        text_out()
        depth -= 1
        out.append("  " * depth + f"</{name}>")

    parser.StartDoctypeDeclHandler = refuse
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, pending.append
    parser.Parse(text.encode(), True)
    return "\n".join(out)


_LENIENT = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/|,(?=\s*[}\]])|\'((?:\\.|[^\'\\])*)\'|([A-Za-z_$][\w$]*)(?=\s*:)', re.S)


def _json(text: str) -> str:
    """Ordered keys and tight separators; comments, trailing commas, bare keys and '..' are let in."""

    def strict(m: re.Match[str]) -> str:
        if m[0].startswith('"'):
            return m[0]
        if m[1] is not None:
            return json.dumps(m[1].replace("\\'", "'"))
        return json.dumps(m[2]) if m[2] else ""

    return json.dumps(json.loads(re.sub(r",(?=\s*[}\]])", "", _LENIENT.sub(strict, text)) if _needs(text) else text), sort_keys=True, separators=(",", ":"))


def _needs(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return True
    return False


def _css_value(value: str) -> str:
    value = re.sub(r"\s+", " ", value.strip())
    if re.fullmatch(r"0px", value, re.I):
        return "0"
    if re.fullmatch(r"[+-]?\d+\.0*", value):
        return str(int(float(value)))
    if m := re.fullmatch(r"#([0-9a-fA-F]+)", value):
        h = m[1].lower()
        return "#" + (h[0] + h[2] + h[4] if len(h) == 6 and h[0] == h[1] and h[2] == h[3] and h[4] == h[5] else h)
    if m := re.fullmatch(r"(?i)url\(\s*['\"]?(.*?)['\"]?\s*\)", value):
        return "url(" + re.sub(r"[?#].*$", "", m[1]) + ")"
    return value


def _css_block(block: str) -> str:
    found: dict[str, str] = {}
    for part in re.split(r";(?![^(]*\))", block):
        name, colon, value = part.partition(":")
        if colon and re.fullmatch(r"[\w-]+", name.strip()):
            found[name.strip().lower()] = _css_value(value)
    return "".join(f"{k}:{v};" for k, v in sorted(found.items()))


def _css(text: str) -> str:
    """Rules with ordered selectors and declarations; the last declaration of a name wins."""
    text = re.sub(r"/\*.*?\*/", "", text, flags=re.S)
    out, at = [], 0
    while at < len(text):
        m = re.compile(r"[^{};]*[{;]").match(text, at)
        if not m:
            break
        head, at = m[0][:-1].strip(), m.end()
        if m[0][-1] == ";":
            if head.startswith("@"):
                name, _, rest = head[1:].partition(" ")
                out.append(f"@{name.lower()} {rest.strip()};")
            continue
        depth, end = 1, at
        while end < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[end], 0)
            end += 1
        block = text[at : end - (not depth)]
        at = end
        if head.startswith("@"):
            name, _, rest = head[1:].partition(" ")
            out.append(f"@{name.lower()} {rest.strip()}{{{_css(block) if '{' in block else _css_block(block)}}}")
        else:
            parts = sorted(re.sub(r"\s+", " ", re.sub(r"\s*([>+~])\s*", r"\1", s)).strip() for s in head.split(","))
            out.append(",".join(parts) + "{" + _css_block(block) + "}")
    done = re.sub(r"(?i)\b[0-9a-f]{32,64}\b", "<HASH>", "".join(out))
    return re.sub(r"\b\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}\b", "<TIMESTAMP>", done).strip()


_BRANCHES: dict[str, Callable[[str], str]] = {"html": _html, "xml": _xml, "json": _json, "css": _css}


def normalized_bodies(df: DataFrame, key: str, kind: str, content: str) -> DataFrame:
    """(key, clean) for each distinct (key, kind, content): branches html, xml, json, css by kind.

    A body whose branch fails stays as it is.  Text kinds are cleaned by column functions alone.
    """

    def one(k: str, c: str) -> str:
        try:
            clean = _BRANCHES[k](c)
        except Exception:  # a body that can't be parsed is kept, whatever is wrong with it
            clean = c
        return html.unescape(clean) if k == "html" else clean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # a few bodies at a time are Python's
                part = batch.slice(at, 64)
                clean = [one(k.as_py(), c.as_py()) for k, c in zip(part.column(1), part.column(2), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(clean, pa.string())], names=["key", "kind", "clean"])

    rows = df.select(F.col(key).alias("key"), F.col(kind).alias("kind"), F.col(content).alias("content")).filter("content IS NOT NULL")
    parsed = rows.filter(F.col("kind").isin(*_BRANCHES)).mapInArrow(run, "key string, kind string, clean string")
    parsed = parsed.withColumn("clean", F.when(F.col("kind") == "html", scrubbed(F.col("clean"))).otherwise(F.col("clean")))
    text = rows.filter(F.col("kind") == "default").select("key", "kind", plain_text(F.col("content")).alias("clean"))
    return parsed.unionByName(text)


def clean_bodies(distinct: DataFrame, store: str) -> DataFrame:
    """Clean bodies (content_sha256, kind, clean) of distinct ones, taken from a store as far as it has them.

    What the store lacks is normalized and appended to it, so a body that came in an earlier batch costs a
    look-up.  A batch that runs again finds its own bodies.
    """
    spark, keys = distinct.sparkSession, distinct.select("content_sha256", "kind")
    lacking = distinct
    if _exists(distinct, store):
        lacking = distinct.join(known_bodies(spark, store, keys).select("content_sha256", "kind"), ["content_sha256", "kind"], "left_anti")
    store_bodies(normalized_bodies(lacking, "content_sha256", "kind", "content").withColumnRenamed("key", "content_sha256"), store)
    return known_bodies(spark, store, keys)


def normalize_documents(df: DataFrame, store: str | None = None) -> DataFrame:
    """Clean the bodies of content rows by MIME class, each distinct body once.

    Rows of other kinds, already normalized, without MIME or binary pass unchanged.  A changed row
    gets normalized = true and a Content-Length that fits.  ``store`` names a folder of clean bodies
    (see ``clean_bodies``) that spares bodies of earlier batches.
    """
    fits = (F.col("doc_type") == "content") & ~F.col("normalized") & (F.coalesce(F.col("content_type"), F.lit("")) != "") & ~is_binary(F.col("content"), F.col("content_type"))
    marked = df.withColumn("_fits", F.coalesce(fits, F.lit(False))).withColumn("_kind", doc_type_of(F.col("content_type")))
    todo = marked.filter("_fits")
    distinct = todo.groupBy("content_sha256", "_kind").agg(F.first("content").alias("content"))
    if store:
        clean = clean_bodies(distinct.withColumnRenamed("_kind", "kind"), store).withColumnRenamed("kind", "_kind")
    else:
        clean = normalized_bodies(distinct, "content_sha256", "_kind", "content").select(F.col("key").alias("content_sha256"), F.col("kind").alias("_kind"), "clean")
    done = todo.join(clean, ["content_sha256", "_kind"], "left")
    done = done.withColumn("_changed", F.col("clean").isNotNull() & (F.col("clean") != F.col("content")))  # before content is replaced
    changed = F.col("_changed")
    length = F.octet_length("clean").cast("string")
    patched = F.transform("response_headers", lambda h: F.struct(h["name"].alias("name"), F.when(changed & (F.lower(h["name"]) == "content-length"), length).otherwise(h["value"]).alias("value")))
    done = done.withColumns({"response_headers": patched, "normalized": changed, "content": F.when(changed, F.col("clean")).otherwise(F.col("content"))})
    return done.select(*df.columns).unionByName(marked.filter("NOT _fits").select(*df.columns))

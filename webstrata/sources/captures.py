"""Readers of HTTP captures: each gives one canonical table of exchanges, and what it rejects."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from webstrata.functions.urls import url_struct
from webstrata.functions.values import bound, parsed_time, title_case
from webstrata.sources.har_entries import har_entries
from webstrata.sources.schema import EXCHANGE, HAR, HEADERS, KATANA
from webstrata.sources.shared import lines_or_whole, spread


def _exchange(df: DataFrame, **columns: Column) -> DataFrame:
    """Select the canonical columns; those not given are null."""
    names = [c.strip().split(" ", 1) for c in _split_schema(EXCHANGE)]
    return df.select([columns.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in names])


def _split_schema(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for k, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[at:k])
            at = k + 1
    return [*out, schema[at:]]


def joined_headers(headers: Column, separator: str | None, name: str = "title") -> Column:
    """Ordered headers with one entry a name: values joined, or the last one (separator null)."""
    shape = {"title": lambda h: title_case(F.trim(h["name"])), "lower": lambda h: F.lower(F.trim(h["name"])), "as is": lambda h: F.trim(h["name"])}[name]
    named = F.filter(F.transform(headers, lambda h: F.struct(shape(h).alias("name"), h["value"].alias("value"))), lambda h: h["name"] != "")

    def entry(clean: Column, n: Column) -> Column:
        values = F.transform(F.filter(clean, lambda h: h["name"] == n), lambda h: F.coalesce(h["value"], F.lit("")))
        return F.struct(n.alias("name"), (F.element_at(values, -1) if separator is None else F.array_join(values, separator)).alias("value"))

    return F.coalesce(bound(named, lambda clean: F.transform(F.array_distinct(F.transform(clean, lambda h: h["name"])), lambda n: entry(clean, n))), F.array().cast(HEADERS))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """More columns, evaluated once a row: filters and later columns don't repeat what a generator gives."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _map_headers(headers: Column) -> Column:
    """Katana headers: underscores to hyphens, title case, Raw dropped, the last of a name wins."""
    listed = F.transform(F.map_entries(headers), lambda e: F.struct(F.regexp_replace(e["key"], "_", "-").alias("name"), e["value"].alias("value")))
    return F.filter(joined_headers(listed, None), lambda h: h["name"] != "Raw")


def parse_katana(items: DataFrame, value: str = "value", rtt_in_ms: bool = False) -> tuple[DataFrame, DataFrame]:
    """Exchanges of katana JSON items (one object a row), and rejected items with a reason."""
    got = items.withColumn("_j", F.from_json(value, KATANA))
    j = F.col("_j")
    reason = (
        F.when(j.isNull() | (j["request"].isNull() & j["response"].isNull()), "not a katana object")
        .when(j["request"].isNull() | j["response"].isNull(), "request or response missing")
        .when(j["response"]["status_code"].isNull(), "status code missing")
        .when(j["request"]["endpoint"].isNull() | url_struct(j["request"]["endpoint"]).isNull(), "endpoint missing or not a URL")
        .when(j["timestamp"].isNull(), "timestamp missing")
    )
    got = got.withColumn("_reason", reason)
    tech = j["response"]["technologies"]
    rtt = j["response"]["rtt"]
    good = _exchange(
        got.filter("_reason IS NULL"),
        url=F.trim(j["request"]["endpoint"]),
        method=F.upper(F.coalesce(j["request"]["method"], F.lit(""))),
        request_headers=_map_headers(j["request"]["headers"]),
        request_body=j["request"]["body"],
        status_code=j["response"]["status_code"],
        response_headers=_map_headers(j["response"]["headers"]),
        response_body=j["response"]["body"],
        timestamp=j["timestamp"],
        response_rtt=rtt,
        response_rtt_ms=rtt if rtt_in_ms else rtt * 1000,
        technologies=F.when(tech.startswith("["), F.from_json(tech, "array<string>")).when(tech.isNotNull(), F.array(tech)),
        forms=j["response"]["forms"],
    )
    return good, got.filter("_reason IS NOT NULL").select(F.col(value).alias("item"), F.col("_reason").alias("reason"))


def read_katana(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Katana JSONL: a JSON object a line; a file in which no line is an object is one object."""
    return parse_katana(lines_or_whole(spark, path))


def read_capture_export(spark: SparkSession, path: str, ignore: tuple[int, ...] = (404, 429, 503)) -> tuple[DataFrame, DataFrame]:
    """A capture proxy's export in katana shape; ignored statuses (always 404 too) are dropped."""
    good, bad = parse_katana(spark.read.text(path).filter(F.trim("value") != ""), rtt_in_ms=True)
    return good.filter(~F.col("status_code").isin(*{*ignore, 404})), bad


def parse_har(items: DataFrame, as_of: Column, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Exchanges of HAR texts (one a row), and rejected texts and entries with a reason."""
    got = items.withColumn("_j", F.from_json(value, HAR))
    bad = got.filter("_j IS NULL OR _j.log IS NULL").select(F.col(value).alias("item"), F.lit("not a HAR log").alias("reason"))
    good, wrong = _har_exchanges(got.filter("_j.log IS NOT NULL").select(F.explode("_j.log.entries").alias("e")).withColumn("item", F.to_json("e")), as_of)
    return good, bad.unionByName(wrong)


def _har_exchanges(each: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Exchanges of HAR entries (e, and item: its text), and those rejected."""
    e = F.col("e")
    ok = e["request"].isNotNull() & e["response"].isNotNull() & url_struct(e["request"]["url"]).isNotNull()
    each = each.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    good = _exchange(
        each.filter("_ok"),
        url=F.trim(e["request"]["url"]),
        method=F.upper(F.coalesce(e["request"]["method"], F.lit("GET"))),
        request_headers=joined_headers(e["request"]["headers"], ";"),
        request_body=F.coalesce(e["request"]["content"]["text"], e["request"]["postData"]["text"]),
        status_code=F.coalesce(e["response"]["status"], F.lit(200)),
        response_headers=joined_headers(e["response"]["headers"], ";"),
        response_body=e["response"]["content"]["text"],
        timestamp=F.coalesce(e["startedDateTime"], F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")),
        response_rtt=e["time"] / 1000,
        response_rtt_ms=e["time"],
    )
    return good, each.filter("NOT _ok").select("item", F.lit("entry without request, response or valid URL").alias("reason"))


def read_har(spark: SparkSession, path: str, as_of: Column, whole_bytes: int = 1 << 23) -> tuple[DataFrame, DataFrame]:
    """Exchanges of HAR files, and what is rejected; files of more than ``whole_bytes`` are read entry by entry."""
    rows = har_entries(spark, path, whole_bytes)
    entry = StructType.fromDDL(HAR)["log"].dataType["entries"].dataType.elementType
    good, wrong = _har_exchanges(rows.filter("reason IS NULL").select(F.from_json("value", entry).alias("e"), F.col("value").alias("item")), as_of)
    return good, rows.filter("reason IS NOT NULL").select(F.col("value").alias("item"), "reason").unionByName(wrong)


def _header_lines(lines: Column) -> Column:
    parsed = F.transform(F.filter(lines, lambda x: x.contains(":")), lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("name"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("value")))
    return joined_headers(parsed, ", ")


def parse_http_raw(items: DataFrame, as_of: Column, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Exchanges of raw HTTP texts: a request, then the response from a line that begins HTTP/.

    A head ends at its first blank line; bodies are cut off whole, not line by line.
    """
    text = F.col(value)
    at = F.regexp_instr(text, F.lit(r"\nHTTP/"))
    got = _once(items, _at=F.when(~text.startswith("HTTP/") & (at > 0), at))
    got = _once(got, _q=F.regexp_replace(F.substring(text, F.lit(1), F.col("_at") - 1), r"\r$", ""), _r=F.substring(text, F.col("_at") + 1, F.length(text)))
    head = lambda c: F.regexp_extract(c, r"(?s)^(.*?)(?:\r?\n *(?:\r?\n.*)?)?$", 1)
    body = lambda c: F.when(F.col(c).rlike(r"\n *\r?\n"), F.regexp_replace(F.regexp_extract(c, r"(?s)^.*?\n *\r?\n(.*)$", 1), "\r\n", "\n"))
    got = _once(got, _ql=F.split(head("_q"), r"\r?\n"), _rl=F.split(head("_r"), r"\r?\n"), _qb=body("_q"), _rb=body("_r"))
    rest = lambda c: F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))
    got = _once(got, _start=F.split(F.trim(F.get("_ql", F.lit(0))), r"\s+"), _rh=_header_lines(rest("_ql")), _sh=_header_lines(rest("_rl")), _status=F.get(F.split(F.get("_rl", F.lit(0)), r"\s+"), F.lit(1)).try_cast("int"))
    host = F.get(F.transform(F.filter("_rh", lambda h: h["name"] == "Host"), lambda h: h["value"]), F.lit(0))
    date = F.get(F.transform(F.filter("_sh", lambda h: h["name"] == "Date"), lambda h: h["value"]), F.lit(0))
    path = F.get("_start", F.lit(1))
    got = _once(got, _url=F.when(path.contains("://"), path).when(host.isNotNull(), F.concat(F.lit("http://"), host, path)), _date=date)
    reason = (
        F.when(F.col("_at").isNull(), "no response")
        .when(F.size("_start") != 3, "request line without three parts")
        .when(F.col("_status").isNull(), "status not a number")
        .when(F.col("_url").isNull() | url_struct(F.col("_url")).isNull(), "no Host, or not a URL")
    )
    got = _once(got, _reason=reason)
    good = _exchange(
        got.filter("_reason IS NULL"),
        url=F.col("_url"),
        method=F.upper(F.col("_start")[0]),
        request_headers=F.col("_rh"),
        request_body=F.col("_qb"),
        status_code=F.col("_status"),
        response_headers=F.col("_sh"),
        response_body=F.col("_rb"),
        timestamp=F.when(parsed_time(F.col("_date")).isNotNull(), F.col("_date")).otherwise(F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")),
    )
    return good, got.filter("_reason IS NOT NULL").select(F.col(value).alias("item"), F.col("_reason").alias("reason"))


def read_http_raw(spark: SparkSession, path: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    return parse_http_raw(spark.read.text(path, wholetext=True), as_of)


def read_http_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A capture CSV without fixed columns: each cell's role is inferred, first match in column order.

    Roles: rtt (a column whose header cell names it), url, time, status, plain headers (the first
    such cell is the request's), base64 request, base64 response.  A row needs a url, a method,
    both headers and a status; its time falls back to the response's Date.  A file is read by one task, as quoted
    cells may hold line ends; rows of fewer files than cores are dealt out before the roles are inferred.
    """
    raw = spread(spark.read.csv(path, multiLine=True, escape='"', header=False))
    cells = F.array(*[F.col(c) for c in raw.columns])
    return parse_csv_cells(raw.select(F.monotonically_increasing_id().cast("string").alias("row"), cells.alias("cells")))


def csv_cells(body: Column) -> Column:
    """Records of a CSV text as an array of arrays of cells; quoted cells may hold commas, lines and doubled quotes."""
    records = F.regexp_extract_all(body, F.lit(r'((?:"[^"]*+"|[^"\r\n]++)++)'), F.lit(1))
    cells = lambda r: F.regexp_extract_all(F.concat(F.lit(","), r), F.lit(r',((?:"[^"]*+")++|[^",]*+)'), F.lit(1))
    plain = lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(F.when(c != "", c))
    return F.transform(records, lambda r: F.transform(cells(r), plain))


def parse_csv_cells(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exchanges of CSV rows (row: an id; cells: array<string>), by the roles of ``read_http_csv``."""
    named = F.array_position(F.transform("cells", lambda c: F.lower(c).rlike(r"^(response\.)?rtt$")), F.lit(True))
    at = rows.select(F.max(named)).first()[0]  # one number for all rows
    rows = rows.withColumn("rtt_at", F.lit(at or None).cast("int"))

    def role(c: Column, pos: Column) -> Column:
        decoded = F.when(F.length(c) >= 16, F.try_to_binary(c, F.lit("base64")).cast("string"))
        lines = F.filter(F.split(c, r"\r?\n"), lambda x: x.contains(":"))
        token = r"^[!#$%&'*+\-.^_`|~0-9a-zA-Z]+$"

        def of(x: Column) -> Column:
            kind = (
                F.when(pos + 1 == F.col("rtt_at"), "rtt")
                .when(c.contains("://") & ~c.contains("\n") & url_struct(c).isNotNull(), "url")
                .when((F.length(c) < 40) & parsed_time(c).isNotNull(), "time")
                .when(c.rlike(r"^[1-5]\d\d$"), "status")
                .when((F.size(x["lines"]) > 2) & F.forall(x["lines"], lambda h: F.trim(F.split_part(h, F.lit(":"), F.lit(1))).rlike(token)), "headers")
                .when(x["decoded"].rlike(r"(?s)^[A-Z]+ \S+ HTTP/\d"), "request")
                .when(x["decoded"].rlike(r"(?s)^HTTP/\d"), "response")
                .when(c.rlike(r"^(GET|HEAD|POST|PUT|DELETE|PATCH|OPTIONS|TRACE|CONNECT)$"), "method")
            )
            return F.struct(c.alias("cell"), x["decoded"].alias("decoded"), kind.alias("role"))

        return bound(F.struct(decoded.alias("decoded"), lines.alias("lines")), of)

    rows = _once(rows, _cells=F.transform("cells", role))
    pick = lambda name, value="cell": F.get(F.filter("_cells", lambda x: x["role"] == name), F.lit(0))[value]
    found = _once(
        rows, **{n: pick(n) for n in ("rtt", "url", "time", "status", "method")}, request=pick("request", "decoded"), response=pick("response", "decoded"),
        plain=F.filter("_cells", lambda x: x["role"] == "headers"), item=F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), ","),
    )
    parse = lambda text: joined_headers(F.transform(F.filter(F.split(text, r"\r?\n"), lambda x: x.contains(":")), lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("name"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("value"))), ", ", "as is")
    head = lambda x: F.regexp_replace(F.regexp_extract(x, r"(?s)^[^\n]*\n(.*?)(\r?\n\r?\n|$)", 1), r"^\r?\n", "")
    body = lambda x: F.regexp_extract(x, r"(?s)\r?\n\r?\n(.*)$", 1)
    q, r = F.col("request"), F.col("response")
    request_text = F.coalesce(F.when(q.isNotNull(), head(q)), F.get("plain", F.lit(0))["cell"])
    response_text = F.coalesce(F.when(r.isNotNull(), head(r)), F.get("plain", F.when(q.isNull(), F.lit(1)).otherwise(F.lit(0)))["cell"])
    method = F.coalesce(F.regexp_extract(q, r"^([A-Z]+) ", 1), F.col("method"), F.lit("GET"))
    status = F.coalesce(F.col("status").try_cast("int"), F.regexp_extract(r, r"^HTTP/\S+ (\d{3})", 1).try_cast("int"))
    found = _once(found, _rh=F.when(request_text.isNotNull(), parse(request_text)), _sh=F.when(response_text.isNotNull(), parse(response_text)), _status=status)
    date = F.get(F.transform(F.filter("_sh", lambda h: F.lower(h["name"]) == "date"), lambda h: h["value"]), F.lit(0))
    time = F.coalesce("time", F.when(parsed_time(date).isNotNull(), date))
    reason = F.when(F.col("url").isNull(), "no URL").when(F.col("_rh").isNull() | F.col("_sh").isNull(), "headers missing").when(F.col("_status").isNull(), "no status").when(F.col("_time").isNull(), "no time")
    found = _once(_once(found, _time=time), _reason=reason)
    good = _exchange(
        found.filter("_reason IS NULL"),
        url=F.trim("url"),
        method=F.upper(method),
        request_headers=F.col("_rh"),
        request_body=F.when(body(q) != "", body(q)),
        status_code=F.col("_status"),
        response_headers=F.col("_sh"),
        response_body=F.when(body(r) != "", body(r)),
        timestamp=F.col("_time"),
        response_rtt=F.col("rtt").try_cast("double"),
        response_rtt_ms=F.col("rtt").try_cast("double"),
    )
    return good, found.filter("_reason IS NOT NULL").select("item", F.col("_reason").alias("reason"))


Parser = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def route_formats(items: DataFrame, as_of: Column, value: str = "value", routes: Sequence[tuple[Column, Parser]] = ()) -> tuple[DataFrame, DataFrame]:
    """Exchanges of items in any format, tried in the order katana, HAR, raw; the rest is rejected.

    ``routes`` are tried first: a condition on the column ``value``, and a parser that takes such rows
    and gives exchanges and rejects.
    """
    t = F.trim(F.col("value"))
    keys = F.when(t.startswith("{"), F.json_object_keys(F.when(t.startswith("{"), t)))
    known: list[tuple[Column, Parser]] = [
        *routes,
        (F.array_contains(keys, "request") & F.array_contains(keys, "response"), parse_katana),
        (F.array_contains(keys, "log"), lambda d: parse_har(d, as_of)),
        (t.rlike(r"^[A-Z]+ \S+ HTTP/\d"), lambda d: parse_http_raw(d, as_of)),
    ]
    kind = F.lit(None).cast("int")
    for k, (condition, _) in reversed(list(enumerate(known))):
        kind = F.when(condition, k).otherwise(kind)
    marked = items.select(F.col(value).alias("value")).withColumn("kind", kind)
    exchanges, rejects = None, marked.filter("kind IS NULL").select(F.col("value").alias("item"), F.lit("unknown format").alias("reason"))
    for k, (_, parse) in enumerate(known):
        good, bad = parse(marked.filter(F.col("kind") == k).select("value"))
        exchanges = good if exchanges is None else exchanges.unionByName(good)
        rejects = rejects.unionByName(bad)
    return exchanges, rejects


def route_uploads(bodies: DataFrame, as_of: Column, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Exchanges of uploaded bodies (one a row): katana lines, else CSV, else one item in any format.

    A body is of katana lines if its first line is such an object, and CSV if its first two lines hold
    commas outside of JSON and raw HTTP.
    """
    t = F.trim(F.col(value))
    first, second = (F.split_part(t, F.lit("\n"), F.lit(k)) for k in (1, 2))
    keys = F.when(first.startswith("{"), F.json_object_keys(F.when(first.startswith("{"), first)))
    by_line = F.coalesce(F.array_contains(keys, "request"), F.lit(False))
    is_csv = ~t.startswith("{") & ~t.startswith("[") & ~first.rlike(r"^[A-Z]+ \S+ HTTP/\d") & first.contains(",") & (second.contains(",") | (second == ""))
    kind = F.when(by_line, "lines").when(is_csv, "csv").otherwise("item")
    marked = bodies.select(F.col(value).alias("value"), kind.alias("kind"))
    lines = marked.filter("kind = 'lines'").select(F.explode(F.split("value", r"\r?\n")).alias("value")).filter(F.trim("value") != "")
    good, bad = route_formats(lines.unionByName(marked.filter("kind = 'item'").select("value")), as_of)
    records = marked.filter("kind = 'csv'").select(F.sha2("value", 256).alias("id"), F.posexplode(csv_cells(F.col("value"))).alias("at", "cells"))
    more, rest = parse_csv_cells(records.select(F.concat_ws(":", "id", "at").alias("row"), "cells"))
    return good.unionByName(more), bad.unionByName(rest)


def replay_log(spark: SparkSession, path: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Exchanges of an append log of raw items, one JSON item a line."""
    return route_formats(spark.read.text(path), as_of)

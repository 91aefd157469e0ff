"""Column steps for times, types, ids, lists, maps and text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Logical type by MIME type, after the +json and +xml rules.
MIME_TYPES = {
    "text/html": "html",
    "application/xml": "xml",
    "image/svg+xml": "xml",
    "text/css": "css",
    "application/javascript": "javascript",
    "application/x-javascript": "javascript",
    "text/javascript": "javascript",
    "application/json": "json",
    "text/json": "json",
    "text/x-finding": "finding",
}
#: MIME types of binary bodies.
BINARY_CATEGORIES = ("video", "audio", "font", "binary")
BINARY_TYPES = (
    "application/octet-stream", "application/pdf", "application/x-pdf", "application/zip", "application/x-zip-compressed",
    "application/x-protobuf", "application/font-woff", "application/font-woff2", "application/vnd.ms-fontobject",
)
TEXT_TYPES = ("application/javascript", "application/x-javascript")
#: Response headers whose values make the cache key.
CACHE_HEADERS = ("authorization", "etag", "cookie", "last-modified", "content-encoding", "content-language", "vary")
#: Zone of each abbreviation in the two mail-like formats.
ZONES = {
    "CDT": "America/Chicago", "CST": "America/Chicago", "EDT": "America/New_York", "EST": "America/New_York", "MDT": "America/Denver",
    "MST": "America/Denver", "PDT": "America/Los_Angeles", "PST": "America/Los_Angeles", "GMT": "UTC", "UTC": "UTC",
}


def parsed_time(text: Column) -> Column:
    """Instant of 'EEE MMM d HH:mm:ss zzz yyyy', 'EEE, d MMM yyyy HH:mm:ss zzz' or ISO-8601; null else."""
    first = r"^\w{3} (\w{3}) (\d{1,2}) (\d{2}:\d{2}:\d{2}) (\w{3}) (\d{4})$"
    second = r"^\w{3}, (\d{1,2}) (\w{3}) (\d{4}) (\d{2}:\d{2}:\d{2}) (\w{3})$"

    def at(pattern: str, day: int, month: int, year: int, clock: int, zone: int) -> Column:
        part = lambda n: F.regexp_extract(text, pattern, n)
        local = F.try_to_timestamp(F.concat_ws(" ", part(day), part(month), part(year), part(clock)), F.lit("d MMM yyyy HH:mm:ss"))
        names = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
        return F.when(text.rlike(pattern), F.to_utc_timestamp(local, names[part(zone)]))

    return F.coalesce(at(first, 2, 1, 5, 3, 4), at(second, 1, 2, 3, 4, 5), F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp")))


def with_timestamp(df: DataFrame, text: str, as_of: Column, out: str = "ts") -> DataFrame:
    """Add the instant and keep the text it came from; an unparsable text becomes ``as_of``."""
    got = parsed_time(F.col(text))
    iso = F.date_format(F.coalesce(got, as_of), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    own = F.when(got.isNotNull() & F.col(text).rlike(r"^\d{4}-\d{2}-\d{2}T"), F.col(text)).otherwise(F.concat(iso, F.lit("+00:00")))
    return df.withColumns({out: F.coalesce(got, as_of), f"{out}_text": own})


def doc_type_of(mime: Column) -> Column:
    out = F.when(F.coalesce(mime, F.lit("")) == "", "default").when(mime.endswith("+json"), "json").when(mime.endswith("+xml"), "xml")
    for name, kind in MIME_TYPES.items():
        out = out.when(mime == name, kind)
    return out.otherwise("default")


def is_binary(content: Column, mime: Column) -> Column:
    """By category and type; else if more than 0.15 of the first 1024 bytes' low ones are high ones."""
    category = F.split_part(mime, F.lit("/"), F.lit(1))
    head = F.hex(F.substring(F.encode(F.substring(content, 1, 1024), "UTF-8"), 1, 1024))  # no more characters than bytes are needed
    high = F.length(F.regexp_replace(F.regexp_replace(head, r"([0-9A-F])[0-9A-F]", "$1"), "[0-7]", ""))
    low = F.length(head) / 2 - high
    sniffed = (F.trim(content) != "") & (high > 0.15 * F.greatest(low, F.lit(1.0)))
    return (
        F.when((category == "text") | mime.isin(*TEXT_TYPES), False)
        .when(category.isin(*BINARY_CATEGORIES), True)
        .when(category == "image", ~mime.isin("image/svg+xml", "image/svg"))
        .when(mime.isin(*BINARY_TYPES), True)
        .when(mime.endswith("+json") | mime.endswith("+xml"), False)
        .otherwise(F.coalesce(sniffed, F.lit(False)))
    )


def day_bucket(ts_text: Column) -> Column:
    """The first 11 characters of the ISO text: the day at the source's offset, and the T."""
    return F.substring(ts_text, 1, 11)


def cache_key(headers: Column) -> Column:
    """Values of the cache headers in header order, comma-joined. headers: array of name, value."""
    return F.coalesce(F.array_join(F.transform(F.filter(headers, lambda h: F.lower(h["name"]).isin(*CACHE_HEADERS)), lambda h: h["value"]), ","), F.lit(""))


def sha_id(*parts: Column) -> Column:
    """sha256 of the parts joined by colons; a null part is empty."""
    return F.sha2(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def title_case(name: Column) -> Column:
    """Upper-case after each non-letter, as header names are written."""
    return F.array_join(F.transform(F.split(name, "-"), lambda p: F.initcap(p)), "-")


def header_value(headers: Column, name: str) -> Column:
    return F.element_at(F.transform(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), lambda h: h["value"]), F.lit(1))


def list_column(text: Column, kind: str = "string") -> Column:
    """JSON array text, or comma-separated values as they stand, as an array; empty text or null is an empty list."""
    values = F.when(text.startswith("[") & text.endswith("]"), F.from_json(text, "array<string>")).otherwise(F.split(text, ","))
    empty = F.array().cast(f"array<{kind}>")
    return F.when(F.coalesce(text, F.lit("")) == "", empty).otherwise(F.coalesce(F.transform(values, lambda x: x.try_cast(kind)), empty))


def map_column(text: Column, separator: str = "=", pair_separator: str = ",") -> Column:
    """JSON object text, or pairs with the given separators, else '=', else ':' with commas, as a map.

    Text in braces that is no JSON is read without them.  The first of the separators that the text
    holds is taken, once in each part, and names and values are trimmed.  Text that holds none is a
    name with an empty value.  Empty text or null is an empty map.
    """
    braced = text.startswith("{") & text.endswith("}")
    parsed = F.when(braced, F.from_json(text, "map<string,string>"))
    is_json = F.coalesce((F.size(parsed) > 0) | text.rlike(r"^\{\s*\}$"), F.lit(False))
    plain = F.when(braced, F.substring(text, 2, F.length(text) - 2)).otherwise(text)

    def pairs(kv: str, sep: str) -> Column:
        each = F.filter(F.split(plain, re.escape(sep)), lambda p: p.contains(kv))
        value = lambda p: F.substring(p, F.length(F.substring_index(p, kv, 1)) + 1 + len(kv), F.length(p))
        made = F.transform(each, lambda p: F.struct(F.trim(F.substring_index(p, kv, 1)).alias("k"), F.trim(value(p)).alias("v")))
        last = F.filter(made, lambda e, i: ~F.exists(F.slice(made, i + 2, F.size(made)), lambda o: o["k"] == e["k"]))
        return F.map_from_entries(last)

    empty = F.create_map().cast("map<string,string>")
    out = F.when(F.coalesce(text, F.lit("")) == "", empty).when(is_json, parsed)
    for kv, sep in ((separator, pair_separator), ("=", ","), (":", ",")):
        out = out.when(plain.contains(kv), pairs(kv, sep))
    return out.otherwise(F.map_from_arrays(F.array(plain), F.array(F.lit(""))))


def bound(column: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a column that is evaluated once, however often the body names it."""
    return F.transform(F.array(column), body)[0]


def bit_at(bitmap: str, position: Column) -> Column:
    """Whether a bit of a bitmap column is set; positions as ``bitmap_bit_position`` gives them."""
    byte = F.conv(F.hex(F.substring(bitmap, (position.cast("int") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(position, F.lit(8)).cast("int")) == 1


def port_ranges(spec: Column) -> Column:
    """'80,443,8000-8002' as sorted ranges (low, high) that neither overlap nor touch; a spec that names none is null: all ports."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p.rlike(r"^\d+(\s*-\s*\d+)?$"))

    def one(p: Column) -> Column:
        ends = F.transform(F.split(p, "-"), lambda x: F.trim(x).try_cast("int"))
        return bound(ends, lambda e: F.struct(e[0].alias("low"), F.least(F.coalesce(F.get(e, F.lit(1)), e[0]), F.lit(65535)).alias("high")))

    def merge(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.struct(last["low"].alias("low"), F.greatest(last["high"], r["high"]).alias("high"))
        return F.when((F.size(done) > 0) & (r["low"] <= F.get(done, F.size(done) - 1)["high"] + 1), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(r)))

    ranges = F.array_sort(F.filter(F.transform(parts, one), lambda r: r["low"] <= r["high"]))
    merged = bound(ranges, lambda x: F.when(F.size(x) < 2, x).otherwise(F.aggregate(x, F.slice(x, 1, 0), merge)))
    return bound(merged, lambda x: F.when(F.size(x) > 0, x))


def listed_ports(ranges: Column) -> Column:
    """The ports of ranges, one by one."""
    return F.flatten(F.transform(ranges, lambda r: F.sequence(r["low"], r["high"])))


def expand_ports(spec: Column) -> Column:
    """'80,443,8000-8002' as a sorted array of ports in range; a spec that names none is null: all ports."""
    return listed_ports(port_ranges(spec))


def common_ranges(a: Column, b: Column) -> Column:
    """Ranges of the ports in both sets; null is all ports. Work goes with the ranges, not with their ports."""
    both = lambda x, y: F.struct(F.greatest(x["low"], y["low"]).alias("low"), F.least(x["high"], y["high"]).alias("high"))
    meet = lambda a, b: F.flatten(F.transform(a, lambda x: F.transform(F.filter(b, lambda y: (y["low"] <= x["high"]) & (y["high"] >= x["low"])), lambda y: both(x, y))))
    return bound(a, lambda a: bound(b, lambda b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(meet(a, b))))


def covers_ranges(wanted: Column, covered: Column) -> Column:
    """Whether every wanted port is covered; null is all ports. A wanted range lies in one covered range or is not covered."""
    inside = lambda w, c: F.forall(w, lambda x: F.exists(c, lambda y: (y["low"] <= x["low"]) & (y["high"] >= x["high"])))
    return bound(wanted, lambda w: bound(covered, lambda c: c.isNull() | (w.isNotNull() & inside(w, c))))


def common_ports(a: Column, b: Column) -> Column:
    """Ports in both sets; a null set is all ports."""
    return bound(a, lambda a: bound(b, lambda b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.array_sort(F.array_intersect(a, b)))))


def covers_ports(wanted: Column, covered: Column) -> Column:
    """Whether every wanted port is covered; a null set is all ports."""
    return bound(wanted, lambda w: bound(covered, lambda c: c.isNull() | (w.isNotNull() & (F.size(F.array_except(w, c)) == 0))))


def page_slice(content: Column, start: int, length: int) -> Column:
    """Struct of text, total_length, offset, has_more; past the end the text is empty."""
    total = F.length(content)
    return F.struct(F.substring(content, start + 1, length).alias("text"), total.alias("total_length"), F.lit(start).alias("offset"), (total > start + length).alias("has_more"))


def scrubbed(text: Column, token: str = "<NUMERIC_TOKEN>") -> Column:
    """Date-times and runs of 32 to 64 hexadecimal digits replaced by one token."""
    return F.regexp_replace(F.regexp_replace(text, r"\b\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}\b", token), r"\b[0-9a-f]{32,64}\b", token)


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def plain_text(text: Column) -> Column:
    """Empty lines dropped, white space squeezed, compatibility forms composed."""
    squeezed = F.regexp_replace(F.regexp_replace(text, r"[ \t\x0B\f\r]+", " "), r" ?(\n ?)+", "\n")
    return nfkc(F.trim(F.regexp_replace(squeezed, r"^\n|\n$", "")))


def aligned_repeats(words: list[str]) -> Iterator[tuple[int, int]]:
    """(start, size) of blocks that come twice in a row and whose size divides what is left from there, in order.

    Cut into blocks of one size from the end, the words have n / size blocks; neighbours are compared by
    sums that slide over the words, all sizes at once: n * log(n) comparisons in all.
    """
    n = len(words)
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    base = np.uint64(0xD1342543DE82EF95)
    powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base))])
    sums = np.concatenate([[np.uint64(0)], np.cumsum(ids * powers[:n])])  # word i weighs base ** i
    sizes = np.arange(1, n // 2 + 1)
    counts = n // sizes - 1
    size = np.repeat(sizes, counts)
    start = n - size * (np.arange(len(size)) - np.repeat(np.cumsum(counts) - counts, counts) + 2)
    alike = np.flatnonzero((sums[start + size] - sums[start]) * powers[size] == sums[start + 2 * size] - sums[start + size])
    for k in alike[np.lexsort((size[alike], start[alike]))].tolist():
        i, width = int(start[k]), int(size[k])
        if words[i : i + width] == words[i + width : i + 2 * width]:
            yield i, width


def collapse_text(text: str) -> str:
    """One copy of a word block, with the marks after it, if the text's tail only repeats it.

    The first block that repeats at once decides (of a size that divides the rest of the words); if
    other words follow its copies, the text stays as it is.
    """
    found = list(re.finditer(r"\w+", text))
    words = [m[0] for m in found]
    first = next(aligned_repeats(words), None) if len(words) > 1 else None
    if first is None or words[first[0] :] != words[first[0] : sum(first)] * ((len(words) - first[0]) // first[1]):
        return text
    end = found[sum(first) - 1].end()
    return text[:end] + re.match(r"[^\w\s]*", text[end:])[0]


@F.pandas_udf(StringType())
def collapse_repeats(texts: pd.Series) -> pd.Series:
    """``collapse_text`` over a column."""
    return texts.map(lambda t: None if t is None else collapse_text(t))

"""Secret scans by sliding-window entropy per character class. DataFrame functions only.

Three base patterns give spans of their own.  Besides, long unbroken strings are candidates: a
window slides over each, the counts of its characters are updated by the one that enters and the
one that leaves, and the window with the highest Shannon entropy decides against the limit of the
string's character class.  An allow-list suppresses known harmless shapes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns. Kinds in their order; the assign value is group 1.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_CHARS = 6
#: Runs match from their start or not at all, so a length in the pattern drops what is shorter.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
#: Candidates: runs of these characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits a character that a window needs, by character class; words: a run without a digit, as in prose.
LIMITS = {"words": 4.0, "hex": 2.9, "alnum": 3.7, "base64": 3.8}
#: Harmless: numbers, UUIDs, dates and versions, checksums named as such, documented sample keys.
ALLOW = (
    r"^[0-9_+/=-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(sha1|sha256|sha384|sha512|md5)[-_=]",
    r"(?i)example|sample|placeholder|x{6,}",
)
SPAN = "struct<s:int,k:int,e:int>"


def _scan(count: str, zero: str, move: Callable[[str, str], str], emit: Callable[[str, str], str], item: str, part: str = "0") -> str:
    """SQL of a running pass over items 0 to count - 1: a state moves on, arrays of ``item`` are emitted.

    Appending to one array copies it each time, which is quadratic.  So the items go in blocks of
    about the square root of their number: a first pass notes the state before each block, a second
    one emits block by block.  ``part`` is kept with each block (as x.part; x.s is the state before it,
    and last the block's last item).
    """
    until = f"least(b + w, {count}) - 1"
    return f"""CASE WHEN {count} > 0 THEN transform(array(int(ceil(sqrt({count})))), w -> flatten(transform(
        aggregate(sequence(0, {count} - 1, w), named_struct('s', {zero}, 'blocks', slice(array(named_struct('b', 0, 'last', 0, 's', {zero})), 1, 0)),
            (a, b) -> named_struct('s', aggregate(sequence(b, {until}), a.s, (s, i) -> {move('s', 'i')}), 'blocks', array_append(a.blocks, named_struct('b', b, 'last', {until}, 's', a.s))),
            a -> transform(a.blocks, y -> named_struct('b', y.b, 'last', y.last, 's', y.s, 'part', {part}))),
        x -> aggregate(sequence(x.b, x.last), named_struct('s', x.s, 'out', cast(array() AS array<{item}>)),
            (a, i) -> named_struct('s', {move('a.s', 'i')}, 'out', concat(a.out, {emit('a.s', 'i')})), a -> a.out))))[0]
        ELSE cast(array() AS array<{item}>) END"""


def _spans(pieces: str, hits: str, kind: int, keep: str = "true") -> Column:
    """Spans of matches from the text between them and the matches: running lengths."""
    none = f"cast(array() AS array<{SPAN}>)"
    return F.expr(_scan(
        f"size({hits})", "0", lambda s, i: f"{s} + length({pieces}[{i}]) + length({hits}[{i}])",
        lambda s, i: f"CASE WHEN {keep} THEN array(named_struct('s', {s} + length({pieces}[{i}]), 'k', {kind}, 'e', {s} + length({pieces}[{i}]) + length({hits}[{i}]))) ELSE {none} END", SPAN,
    ))


def _least_sum(c: str) -> str:
    """Least sum of n*log2(n) over the windows of a candidate, by incremental counts.

    Entering makes a count n into n+1, leaving back into n-1; only those two terms change.
    """
    term = "CASE WHEN {0} > 1 THEN {0} * log2({0}) ELSE 0D END"
    enter, leave = "x.at[i]", f"CASE WHEN i >= {WINDOW} THEN x.at[i - {WINDOW}] ELSE -1 END"
    moved = f"transform(a.n, (v, k) -> v + CASE WHEN k = {enter} THEN 1 ELSE 0 END - CASE WHEN k = {leave} THEN 1 ELSE 0 END)"
    changed = (
        f"CASE WHEN {enter} = {leave} THEN 0D ELSE "
        f"{term.format(f'(a.n[{enter}] + 1)')} - {term.format(f'a.n[{enter}]')}"
        f" + CASE WHEN {leave} >= 0 THEN {term.format(f'(a.n[{leave}] - 1)')} - {term.format(f'a.n[{leave}]')} ELSE 0D END END"
    )
    return f"""transform(transform(array(split({c}, '')), c -> transform(array(array_distinct(c)), names -> named_struct('names', names, 'at', transform(c, y -> int(array_position(names, y)) - 1)))[0]), x ->
        aggregate(sequence(0, size(x.at) - 1),
            named_struct('n', transform(x.names, v -> 0), 'sum', 0D, 'best', double('Infinity')),
            (a, i) -> named_struct('n', {moved}, 'sum', a.sum + {changed},
                'best', CASE WHEN i >= {WINDOW - 1} THEN least(a.best, a.sum + {changed}) ELSE a.best END),
            a -> a.best))[0]"""


def _suspicious(c: str) -> str:
    """Condition on a candidate: not allowed, and some window reaches the limit of its class."""
    allowed = " OR ".join(f"{c} rlike r'{p}'" for p in ALLOW)
    limit = f"CASE WHEN NOT {c} rlike '[0-9]' THEN {LIMITS['words']}D WHEN {c} rlike '^[0-9a-fA-F]+$' THEN {LIMITS['hex']}D WHEN {c} rlike '^[A-Za-z0-9]+$' THEN {LIMITS['alnum']}D ELSE {LIMITS['base64']}D END"
    few = f"log2(size(array_distinct(split({c}, '')))) < {limit}"  # no window can reach the limit
    return f"CASE WHEN {allowed} THEN false WHEN {few} THEN false ELSE log2({WINDOW}) - {_least_sum(c)} / {WINDOW} >= {limit} END"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", text: bool = False) -> DataFrame:
    """All spans of every whole text: doc_id, base and added (arrays of s, k, e), and text if asked.

    Offsets are code points, end exclusive; k counts KINDS.  A candidate inside a base span adds
    nothing.  Null text is empty: no spans.  Repeated rows and null ids pass through; an empty
    table gives no rows.  A projection: no shuffle, and nothing is kept between rows.  Very long texts
    and runs take time in proportion to their length, and to hits times the root of their number.
    """
    none = F.expr("cast(array() AS array<string>)")
    t = F.col("text")

    def hits(pattern: str, when: Column | None = None, group: int = 0) -> Column:
        got = F.regexp_extract_all(t, F.lit(pattern), F.lit(group))
        return got if when is None else F.when(when, got).otherwise(none)

    def between(name: str, pattern: str) -> Column:
        return F.when(F.size(name) > 0, F.split(t, pattern, -1)).otherwise(none)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select(
        "*",
        hits(ASSIGN, t.contains("=") | t.contains(":")).alias("assign_hits"),
        hits(ACCESS, t.contains("AKIA")).alias("access_hits"),
        hits(HEX).alias("hex_hits"),
        hits(CANDIDATE).alias("entropy_hits"),
    )
    rows = rows.select(
        "*",
        F.when(F.size("assign_hits") > 0, hits(ASSIGN, group=1)).otherwise(none).alias("assign_values"),
        between("assign_hits", ASSIGN).alias("assign_pieces"),
        between("access_hits", ACCESS).alias("access_pieces"),
        between("hex_hits", HEX).alias("hex_pieces"),
        between("entropy_hits", CANDIDATE).alias("entropy_pieces"),
    )
    rows = rows.select(
        "doc_id",
        "text",
        _spans("assign_pieces", "assign_hits", 0, f"length(assign_values[i]) >= {ASSIGN_CHARS}").alias("a"),
        _spans("access_pieces", "access_hits", 1).alias("b"),
        _spans("hex_pieces", "hex_hits", 2).alias("c"),
        _spans("entropy_pieces", "entropy_hits", 3, _suspicious("entropy_hits[i]")).alias("d"),
    )
    rows = rows.select("doc_id", "text", F.array_sort(F.concat("a", "b", "c")).alias("base"), "d")
    rows = rows.withColumn("both", F.when(F.size("d") > 0, F.array_sort(F.concat("base", "d"))).otherwise(F.col("d")))
    outside = _scan(  # base spans come first where starts are equal; the state is the farthest end of one so far
        "size(both)", "0", lambda s, i: f"CASE WHEN both[{i}].k < 3 THEN greatest({s}, both[{i}].e) ELSE {s} END",
        lambda s, i: f"CASE WHEN both[{i}].k = 3 AND both[{i}].e > {s} THEN array(both[{i}]) ELSE cast(array() AS array<{SPAN}>) END", SPAN,
    )
    return rows.select("doc_id", "base", F.expr(outside).alias("added"), *(["text"] if text else []))


def _listed(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', array({names})[x.k], string(x.s), string(x.e))), ',')")


def summarize_secrets(found: DataFrame) -> DataFrame:
    """Counts, digest of base spans and the list of all spans for each row of ``find_secrets``."""

    def count(kind: int) -> Column:
        return F.expr(f"bigint(size(filter(base, x -> x.k = {kind})))")

    rows = found.withColumn("all_spans", F.array_sort(F.concat("base", "added")))
    return rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_listed("base"), 256).alias("base_sha256"),
        _listed("all_spans").alias("spans"),
        F.size("added").cast("long").alias("n_entropy"),
    )


def redacted(text: str, spans: str, mark: str = "[SECRET]") -> Column:
    """The text column with every stretch covered by spans (sorted by start) replaced by one mark.

    A block of spans works on its own part of the text, so that no step walks the whole of it.
    """
    end, start = f"{spans}[{{i}}].e".format, f"{spans}[{{i}}].s".format
    pieces = _scan(
        f"size({spans})", "0", lambda s, i: f"greatest({s}, {end(i=i)})",
        lambda s, i: f"CASE WHEN {start(i=i)} >= {s} AND {end(i=i)} > {s} THEN array(concat(substring(x.part, {s} - x.s + 1, {start(i=i)} - {s}), '{mark}')) ELSE cast(array() AS array<string>) END",
        "string", part=f"substring({text}, y.s + 1, greatest(0, {spans}[y.last].s - y.s))",
    )
    return F.expr(f"CASE WHEN size({spans}) = 0 THEN {text} ELSE array_join(concat({pieces}, array(substring({text}, array_max(transform({spans}, y -> y.e)) + 1))), '') END")

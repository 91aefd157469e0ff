"""MinHash near-duplicate detection with sequential Bayesian verification.

Documents with equal shingle sets are one class, kept by one representative.  Representatives meet
in bands of their MinHash signatures.  A pair is compared batch by batch of signature bits, and
dropped as soon as the posterior probability that it is similar enough falls under the chosen miss
probability (Satuluri and Parthasarathy, 2012); survivors are verified on their full sets.

Pairs are never listed within a group.  First each member of a bucket meets the bucket's smallest
member only, and what links becomes one component.  Then members that lie in another component than
their bucket's smallest meet the rest of the bucket, in parts of bounded size; a test of sketches inside
the join lets almost only real links through.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webstrata.llm.common import WORD, discard, materialize, sized, slices

_WORDS = re.compile(WORD)
SHINGLE = 5
ROWS, BANDS = 5, 51
PART = 2000  # members of a bucket that meet others in one part
BATCHES = 4  # of 64 signature bits each
PARITY_WORDS = 16
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_MIX = np.uint64(0x9E3779B97F4A7C15)
SKETCH = "doc_id long, n_shingles long, set_key binary, bands array<long>, bits array<long>, parity array<long>"


@cache
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240)
    n = 64 * BATCHES
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles (A-Z lower-cased)."""
    words = _WORDS.findall(text.translate(_LOWER) if not text.isascii() else text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    out = np.full(len(h) - width + 1, np.uint64(width), np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + len(out)]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out * _MIX)


def sketch(shingles: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Digest of the set, band keys, one bit of each MinHash, and parity bits of the set."""
    a, b = _multipliers()
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(least, (shingles[at : at + 512, None] * a + b).min(axis=0), out=least)
    banded = least[: ROWS * BANDS].reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for k in range(ROWS):
        keys = (keys ^ banded[:, k]) * _MIX
        keys ^= keys >> np.uint64(31)
    bits = np.packbits((least >> np.uint64(21) & np.uint64(1)).astype(bool)).view(np.int64)
    odd = np.bincount((shingles >> np.uint64(17)).astype(np.int64) % (64 * PARITY_WORDS), minlength=64 * PARITY_WORDS) & 1
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), keys.view(np.int64), bits, np.packbits(odd.astype(bool)).view(np.int64)


def sketch_documents(docs: DataFrame) -> DataFrame:
    """A sketch per row of (doc_id, text); without words: n_shingles 0 and nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SKETCH.split(", ")]
        types = [pa.int64(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 3]
        for batch in slices(batches):
            cols: list[list] = [batch.column(0).to_pylist(), [], [], [], [], []]
            for text in batch.column(1).to_pylist():
                s = shingle_set(text or "")
                row = (len(s), *(sketch(s) if len(s) else (None,) * 4))
                for col, v in zip(cols[1:], row, strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return docs.mapInArrow(run, SKETCH)


def prune_limits(threshold: float, miss: float, batches: int = BATCHES) -> list[int]:
    """Most differing bits after 64, 128, ... compared ones with which a pair goes on.

    A signature bit agrees with probability (1 + s) / 2 at similarity s.  With a flat prior on s the
    posterior after m of n agree is proportional to p**m * (1-p)**(n-m) over p in [1/2, 1]; a pair is
    pruned where the mass at s >= threshold is under ``miss``.
    """
    p = np.linspace(0.5, 1, 2001)[:-1]
    high = p >= (1 + threshold) / 2
    limits = []
    for n in range(64, 64 * batches + 1, 64):
        differing = np.arange(n + 1)
        log = (n - differing)[:, None] * np.log(p) + differing[:, None] * np.log1p(-p)
        mass = np.exp(log - log.max(axis=1, keepdims=True))
        limits.append(int(differing[mass[:, high].sum(axis=1) / mass.sum(axis=1) >= miss].max()))
    return limits


def may_link(threshold: float, miss: float) -> Column:
    """Condition on sketches of a and b: sizes fit, no batch prunes the pair, parities allow it.

    Each element in one set only flips one parity bit, so differing parity bits never outnumber the
    symmetric difference, which a link bounds by (|A| + |B|) * (1 - t) / (1 + t): that test is exact.
    """
    ok = (F.least("a.n_shingles", "b.n_shingles") >= F.ceil(F.greatest("a.n_shingles", "b.n_shingles") * F.lit(threshold)))
    differing = F.lit(0)
    for k, limit in enumerate(prune_limits(threshold, miss)):
        differing = differing + F.bit_count(F.expr(f"a.bits[{k}] ^ b.bits[{k}]"))
        ok = ok & (differing <= limit)
    parity = F.lit(0)
    for k in range(PARITY_WORDS):
        parity = parity + F.bit_count(F.expr(f"a.parity[{k}] ^ b.parity[{k}]"))
    return ok & (parity <= (F.expr("a.n_shingles + b.n_shingles") * F.lit((1 - threshold) / (1 + threshold)) + F.lit(1e-9)))


def in_parts(pairs: DataFrame, rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Pairs (u, v) with the row of their u; a u of the table hot (u, parts) meets its pairs part by part, one copy of the row in each."""
    hot = sized(hot)
    left = pairs.join(hot, "u", "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("v"), F.col("parts"))).otherwise(0)).drop("parts")
    right = rows.join(hot, "u", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts")
    return left.join(right, ["u", "part"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets hold 100 * |A and B| >= percent * |A or B|; ``pairs`` is a written table."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("rep").alias("u"), F.col("shingles").alias("x")), sets.select(F.col("rep").alias("v"), F.col("shingles").alias("y"))
    hot = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts")).filter("parts > 1")
    return in_parts(pairs.join(right, "v"), left, hot).select("u", "v", "x", "y").mapInArrow(check, "u long, v long")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (u, v); component: its smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each a min by key and a join;
    a round's links are written to the shared folder, so lineage stays short.
    """
    links = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = materialize(small.filter("u <> v").distinct(), "links")
        parents = after.select(F.col("v").alias("u")).distinct()
        several = after.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u").limit(1)
        done = several.unionByName(after.join(parents, "u", "left_semi").select("u").limit(1)).isEmpty()
        discard(links)
        links = after
        if done:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, percent: int = 75, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of near-duplicate documents: doc_id, n_shingles, component_id, kept.

    Two documents link if 100 * |A and B| >= percent * |A or B| over their shingle sets (distinct
    shingles of five words; with fewer words, the whole sequence).  component_id is the smallest
    doc_id reachable; kept: doc_id = component_id.

    ``miss`` bounds the posterior probability with which a similar pair is pruned unverified.

    Null or wordless text: empty set, linked with nothing, kept.  Repeated rows of a doc_id are one
    document, which links where any of its texts does.  A null doc_id never becomes a component's
    id; alone it has a null component_id and is kept.  Other columns are ignored.
    """
    threshold = percent / 100
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = materialize(sketch_documents(rows), "sketches")
    filled = sketches.filter("set_key IS NOT NULL")
    one = filled.groupBy("set_key").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "bits", "parity")])
    reps = materialize(one.filter("rep IS NOT NULL"), "representatives")
    banded = reps.select("rep", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "hub", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    met = materialize(banded.join(buckets, "band"), "met")
    data = reps.select("rep", "n_shingles", "bits", "parity")
    plausible = may_link(threshold, miss)

    pairs = met.filter("rep <> hub").select(F.col("hub").alias("u"), F.col("rep").alias("v")).distinct()
    hot = met.filter("rep = hub AND parts > 1").groupBy(F.col("hub").alias("u")).agg(F.max("parts").cast("long").alias("parts"))
    kept = ("n_shingles", "bits", "parity")
    a = data.select(F.col("rep").alias("u"), F.struct(*kept).alias("a"))
    b = data.select(F.col("rep").alias("v"), F.struct(*kept).alias("b"))
    first = materialize(in_parts(pairs.join(b, "v"), a, hot).filter(plausible).select("u", "v"), "pairs")

    def joined(wanted: DataFrame) -> DataFrame:
        """Full sets of the representatives that some pair needs."""
        ids = wanted.select(F.col("u").alias("rep")).unionByName(wanted.select(F.col("v").alias("rep"))).distinct()

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                sets = [shingle_set(t or "").tobytes() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["rep", "shingles"])

        texts = rows.withColumnRenamed("doc_id", "rep").join(sized(ids), "rep", "left_semi")
        return texts.select("rep", "text").mapInArrow(build, "rep long, shingles binary").dropDuplicates(["rep", "shingles"])

    sets = materialize(joined(first), "sets")
    links = materialize(verified(first, sets, percent), "linked")
    component = materialize(connected_components(links), "components")

    placed = met.join(component.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    hubs = component.select(F.col("node").alias("hub"), F.col("component").alias("hub_component"))
    placed = placed.join(hubs, "hub", "left").withColumn("hub_component", F.coalesce("hub_component", "hub"))
    placed = materialize(placed.filter("rep <> hub"), "placed")
    discard(met)
    apart = placed.filter("component <> hub_component")
    rest = apart.select("band", "rep", "component", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    part = F.pmod(F.xxhash64("rep"), "parts").cast("int").alias("part")  # a large bucket meets part by part
    others = placed.join(apart.select("band").distinct(), "band", "left_semi").select("band", "rep", "component", (F.col("component") == F.col("hub_component")).alias("with_hub"), part)
    a, b = rest.join(data, "rep").alias("a"), others.join(data, "rep").alias("b")
    once = F.expr("a.component <> b.component AND (b.with_hub OR a.rep < b.rep)")
    second = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.part") == F.col("b.part")) & once & plausible)
    second = second.select(F.least("a.rep", "b.rep").alias("u"), F.greatest("a.rep", "b.rep").alias("v")).distinct().join(first, ["u", "v"], "left_anti")
    second = materialize(second, "pairs")
    for done in (placed, first, sets):
        discard(done)
    if not second.isEmpty():
        more = verified(second, joined(second), percent)
        links = materialize(links.unionByName(more), "linked")
        component = materialize(connected_components(links), "components")
    discard(second)

    found = reps.select("set_key", "rep").join(component.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    return (
        sketches.select("doc_id", "n_shingles", "set_key")
        .join(found, "set_key", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.col("component").isNull()).alias("kept"))
    )


def keep_one(docs: DataFrame, percent: int = 75, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, one of each group of near-duplicates.

    A row is known by two hashes of all its columns, so rows without an id and rows that share one are
    documents of their own.  Of a group the row with the smallest id stays (rows without one come last,
    then the smallest hash).  Repeated rows are one.  Rows without words are in no group and stay, and so
    do different rows that share the first hash: 128 bits would have to agree for a text to be lost.

    Texts are shuffled only where more than a million rows go, or rows repeat.
    """
    row, other = (next(n for n in (name + "_" * k for k in range(len(docs.columns) + 1)) if n not in docs.columns) for name in ("row", "other"))
    whole = [*docs.columns, *[F.col(c).isNull() for c in docs.columns]]  # nulls alone add nothing to a hash
    named = docs.withColumn(row, F.xxhash64(*whole)).withColumn(other, F.xxhash64(F.lit(1), *whole))
    found = materialize(near_duplicates(named, percent, miss, row, text_col).groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "groups")
    ids = named.groupBy(F.col(row).alias("doc_id")).agg(F.min(id_col).alias("id"), (F.min(other) != F.max(other)).alias("clash"))
    placed = found.join(ids, "doc_id")
    first = placed.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "doc_id")).alias("m"))
    gone = materialize(placed.filter("NOT clash").select(F.col("doc_id").alias(row)).join(first.select(F.col("m.doc_id").alias(row)), row, "left_anti"), "gone")
    left = named.join(sized(gone), row, "left_anti")
    twice = found.filter("n > 1").select(F.col("doc_id").alias(row))
    if twice.isEmpty():
        return left.select(*docs.columns)
    some = sized(twice)
    return left.join(some, row, "left_anti").unionByName(left.join(some, row, "left_semi").dropDuplicates([row, other])).select(*docs.columns)

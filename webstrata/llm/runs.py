"""Periodic runs of words, by Lyndon roots: phase one of Baier's suffix sorter, then longest common extensions.

Baier's phase one (2016) refines groups of suffixes from the highest down; when it is done, a
suffix's group stands for its longest Lyndon prefix.  So phase one alone gives the Lyndon array, in linear time,
under the order of the words' numbers and, with the numbers turned round, under the reverse one
(Franek and others, 2017).  Every run has a Lyndon root in one of the two (Bannai and others, 2017):
roots are extended to both sides as far as the period holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.llm.common import slices

RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def lyndon_lengths(text: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place; the end is smaller than any symbol.

    Groups are processed from the highest down.  Each member's nearest place to the left that is in
    a lower group has its context grow by this group's context, as often as members name it; places
    of one group that grow alike become a group of their own just above theirs.  Lower places are a
    linked list from which processed ones go.
    """
    places: dict[int, list[int]] = {}
    for i, symbol in enumerate(text):
        places.setdefault(symbol, []).append(i)
    members = [places[symbol] for symbol in sorted(places)]
    left = [len(m) for m in members]
    size = [1] * len(members)
    lower, upper = list(range(-1, len(members))), list(range(1, len(members) + 2))
    top = len(members)
    members.append([])
    left.append(0)
    size.append(0)
    of = [0] * len(text)
    for g, group in enumerate(members):
        for i in group:
            of[i] = g
    #: Neighbours among the lower places; -1 is the start of the text, whose slot is the last one.
    before, after = list(range(-1, len(text) + 1)), list(range(1, len(text) + 3))
    lengths = [0] * len(text)
    g = lower[top]
    while g >= 0:
        length, grown, last = size[g], [], -1
        for i in members[g]:
            if of[i] == g:
                lengths[i] = length
                p, q = before[i], after[i]
                after[p], before[q] = q, p
                if p >= 0:
                    if p == last:
                        grown[-1][0] += 1
                    else:
                        grown.append([1, p])
                        last = p
        if len(grown) == 1:
            times, p = grown[0]
            alike = [((times, of[p]), [p])]
        else:
            by: dict[tuple[int, int], list[int]] = {}
            for times, p in grown:
                by.setdefault((times, of[p]), []).append(p)
            alike = sorted(by.items(), reverse=True) if len(by) > 1 else by.items()
        for (times, h), group in alike:
            if left[h] == len(group):
                size[h] += times * length
                continue
            new, above = len(members), upper[h]
            members.append(group)
            left.append(len(group))
            left[h] -= len(group)
            size.append(size[h] + times * length)
            lower.append(h)
            upper.append(above)
            lower[above], upper[h] = new, new
            for p in group:
                of[p] = new
        g = lower[g]
    return lengths


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many items two arrays agree in from their start: longest common extension, in doubling steps."""
    n, at, step = min(len(a), len(b)), 0, 16
    while at < n:
        same = a[at : at + step][: n - at] == b[at : at + step][: n - at]
        if not same.all():
            return at + int(np.argmin(same))
        at, step = at + len(same), 2 * step
    return n


def _stretches(words: np.ndarray, times: int, least: int) -> list[tuple[int, int]]:
    """Stretches of at least ``least`` words in which every two neighbours occur ``times`` times in the text, as neighbours.

    A run of e periods holds each of its neighbouring pairs e - 1 times at least, so it lies in one stretch.
    """
    pairs = words[:-1] * (int(words.max()) + 1) + words[1:]
    _, number, counts = np.unique(pairs, return_inverse=True, return_counts=True)
    often = np.concatenate([[False], counts[number] >= times, [False]])
    edges = np.flatnonzero(often[1:] != often[:-1])
    return [(s, e + 1) for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if e + 1 - s >= least]


def find_runs(text: list[int], least_exponent: int = 4, least_length: int = 6) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of at least that many periods (2 or more) and words, by start, then period.

    Only stretches of pairs that occur often enough are sorted.  A run of ``e`` periods holds e - 1
    whole Lyndon roots one after another, so places where the array doesn't show so many, or where these
    differ in their first or last word, are passed over; a root that lies in the last run of its period is of that run.
    """
    if len(text) < max(2, least_length):
        return []
    found: set[tuple[int, int, int]] = set()
    whole = np.array(text)
    for low, high in _stretches(whole, least_exponent - 1, least_length):
        words, n = whole[low:high], high - low
        top = int(words.max())
        for ordered in (words, top - words):
            period = np.array(lyndon_lengths(ordered.tolist()))
            at = np.flatnonzero(np.arange(n) + (least_exponent - 1) * period <= n)
            for k in range(1, least_exponent - 1):
                p = period[at]
                at = at[(period[at + k * p] == p) & (words[at + k * p] == words[at]) & (words[at + k * p + p - 1] == words[at + p - 1])]
            reach: dict[int, int] = {}
            for i, p in zip(at.tolist(), period[at].tolist(), strict=True):
                if i + p <= reach.get(p, 0):
                    continue
                start, end = i - _agree(words[:i][::-1], words[: i + p][::-1]), i + p + _agree(words[i:], words[i + p :])
                reach[p] = end
                if end - start >= max(least_length, least_exponent * p):
                    found.add((low + start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def number_words(words: list[bytes]) -> list[int]:
    numbers: dict[bytes, int] = {}
    return [numbers.setdefault(w, len(numbers)) for w in words]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)])


def detect_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_exponent: int = 4, least_length: int = 6) -> DataFrame:
    """Runs of every text's words, and the text with each run collapsed to one period; a map, nothing is shuffled.

    A run is a stretch of words with smallest period q, of at least ``least_exponent`` times q and
    ``least_length`` words, that no neighbouring word extends.  Returns doc_id, n_words, runs (by start, then
    period) and collapsed (the words that no run holds after its first q, joined by one space).

    Null or empty texts have no words, no runs and an empty collapsed text.  Repeated rows and null
    ids are kept.  An empty table gives no rows.  Other columns are ignored.  A text is taken whole;
    time and memory are linear in its words.
    """

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in slices(batches, 64):
            counts, found, collapsed = [], [], []
            for text in batch.column(1).to_pylist():
                words = (text or "").encode().split()
                runs = find_runs(number_words(words), least_exponent, least_length)
                counts.append(len(words))
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                collapsed.append(collapse(words, runs).decode())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(found, run_type), pa.array(collapsed, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(detect, RUNS)


def with_periods(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth, by a checksum of the id, is periodic from some word on.

    With h the CRC-32 of the written id and g = h div 10: where h is divisible by 10, each word i >= a
    of n becomes word a + (i - a) mod p, with a = g mod n and p = 1 + (n - a) div (3 + g mod 8).
    A null id or text, or one without words, stays as it is.
    """
    g = "crc32(cast(cast(doc_id AS string) AS binary)) div 10"
    changed = F.expr(rf"""
        transform(array(filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x <> '')), w -> CASE WHEN size(w) > 0 THEN
            transform(array(cast(({g}) % size(w) AS int)), a -> transform(array(cast(1 + (size(w) - a) div (3 + ({g}) % 8) AS int)), p ->
                concat_ws(' ', slice(w, 1, a), transform(sequence(a, size(w) - 1), i -> w[a + (i - a) % p])))[0])[0]
            ELSE text END)[0]""")
    periodic = F.expr("crc32(cast(cast(doc_id AS string) AS binary)) % 10 = 0 AND text IS NOT NULL")
    return docs.select("doc_id", F.when(periodic, changed).otherwise(F.col("text")).alias("text"))


def summarize(found: DataFrame) -> DataFrame:
    """The digest of ``detect_runs``: counts, the run of most periods, checksums of all runs and of the collapsed text."""

    def ahead(a: Column, b: Column) -> Column:
        """a comes before b: more periods (compared as whole numbers), then smaller start, then smaller period."""
        more = a["length"] * b["period"] - b["length"] * a["period"]
        return (more > 0) | ((more == 0) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))))

    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(ahead(r, best), r).otherwise(best))
    written = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{c}") for c in ("start", "length", "period")),
        F.floor(F.expr("1000 * best.length div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(written, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

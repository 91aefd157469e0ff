"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Rotations are learned on a bounded sample (iterative quantisation).  A code splits into substrings,
each with an index of its own.  Probing every bucket within ``flips`` bits of the query's substring, in
all of L substrings, finds every code within Hamming radius L * (flips + 1) - 1 (the pigeonhole
principle), and of the farther ones those that agree well enough in some substring.  What is found is
reranked by the inner product of the original vectors.  How many substrings there are and how many
bits are flipped is learned too: the choice that reads the fewest rows among those that find enough of
the sample's own neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webstrata.llm.common import hashed_sample, materialize

#: Bits of a substring, and most substrings.
BITS, MOST = 15, 320
#: Masks of BITS bits by number of ones, and how many have at most so many.
MASKS = np.argsort(np.bitwise_count(np.arange(1 << BITS)), kind="stable").astype(np.int64)
WITHIN = np.cumsum(np.bincount(np.bitwise_count(np.arange(1 << BITS))))


class Coder(NamedTuple):
    """Projection to the bits of ``tables`` substrings, the bits that are flipped, and what the sample showed."""

    mean: np.ndarray
    projection: np.ndarray
    flips: int
    recall: float
    share: float

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Rows by substrings, each an unsigned 16-bit value."""
        bits = ((x - self.mean).astype(np.float32) @ self.projection > 0).reshape(len(x), -1, BITS)
        return (bits * (1 << np.arange(BITS))).sum(axis=2, dtype=np.int64).astype(np.uint16)

    @property
    def radius(self) -> int:
        return self.projection.shape[1] // BITS * (self.flips + 1) - 1


def learn_coder(sample: np.ndarray, total: int, k: int = 20, recall: float = 0.94, rounds: int = 8, most_probes: int = 20_000, seed: int = 7) -> Coder:
    """Learn rotations of the sample's principal axes, the number of substrings and the bits to flip.

    A sample of a table of ``total`` rows is thinner than the table, so of each sampled row not the k
    nearest count but as many as lie among the k nearest of the table, one at least.  Of the choices that
    find the share ``recall`` of these, with ``most_probes`` buckets a query at most, the one that reads
    the least share of other rows is taken; if there is none, the least flips that do.
    """
    rng = np.random.default_rng(seed)
    mean = sample.mean(axis=0)
    v = (sample - mean)[:1024]
    axes = np.linalg.svd(v, full_matrices=False)[2].T
    v = v @ axes
    parts = []
    while sum(p.shape[1] for p in parts) < MOST * BITS:
        rotation = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))[0]
        for _ in range(rounds):  # nearest orthogonal map from axes to signs
            u, _, w = np.linalg.svd(np.sign(v @ rotation).T @ v)
            rotation = (u @ w).T
        parts.append(axes @ rotation)
    coder = Coder(mean, np.concatenate(parts, axis=1)[:, : MOST * BITS].astype(np.float32), BITS, 1.0, 1.0)
    if len(sample) < 2:
        return coder._replace(projection=coder.projection[:, :BITS])
    asked = np.arange(min(256, len(sample)))
    codes, wanted = coder.encode(sample), max(1, -(-k * len(sample) // max(1, total)))
    scores = sample[asked] @ sample.T
    scores[asked, asked] = -np.inf
    near = np.argsort(-scores, axis=1, kind="stable")[:, : min(wanted, len(sample) - 1)]
    other = rng.integers(0, len(sample), (len(asked), 64))

    def first_table(flips: int, rows: np.ndarray) -> np.ndarray:
        """Of each pair the first substring that finds it; MOST if none does."""
        hit = np.bitwise_count(codes[asked][:, None, :] ^ codes[rows]) <= flips
        return np.where(hit.any(axis=2), hit.argmax(axis=2), MOST).ravel()

    best = None
    for flips in range(BITS + 1):
        found = np.bincount(first_table(flips, near), minlength=MOST + 1)[:MOST].cumsum() / near.size
        tables = int(np.searchsorted(found, recall)) + 1
        if tables <= MOST and (best is None or tables * WITHIN[flips] <= most_probes):
            share = float((first_table(flips, other) < tables).mean())
            if best is None or share < best[0]:
                best = share, tables, flips, float(found[tables - 1])
        if best and WITHIN[flips] > most_probes:
            break
    share, tables, flips, found = best
    return coder._replace(projection=coder.projection[:, : tables * BITS], flips=flips, recall=found, share=share)


class SubstringIndex:
    """The rows of a block by the value of each substring of their codes."""

    def __init__(self, codes: np.ndarray):
        self.rows, self.tables = codes.shape
        columns = np.ascontiguousarray(codes.T)
        self.order = np.argsort(columns, axis=1, kind="stable").astype(np.int32).ravel()
        starts = np.zeros((self.tables, (1 << BITS) + 1), np.int32)
        for j, column in enumerate(columns):
            np.cumsum(np.bincount(column, minlength=1 << BITS), out=starts[j, 1:])
        self.starts = (starts + np.arange(self.tables, dtype=np.int32)[:, None] * self.rows).ravel()
        self.base = np.arange(self.tables, dtype=np.int64)[:, None] * ((1 << BITS) + 1)

    def probe(self, code: np.ndarray, flips: int) -> np.ndarray:
        """Rows in the buckets within ``flips`` bits of the code in some substring, ascending."""
        at = (self.base + (code.astype(np.int64)[:, None] ^ MASKS[: WITHIN[min(flips, BITS)]])).ravel()
        begin = self.starts[at]
        size = self.starts[at + 1] - begin
        some = np.flatnonzero(size)
        begin, size = begin[some], size[some]
        ends = np.cumsum(size)
        if not len(ends):
            return np.zeros(0, np.int64)
        read = np.arange(ends[-1]) - np.repeat(ends - size - begin, size)
        found = np.zeros(self.rows, bool)
        found[self.order[read]] = True
        return np.flatnonzero(found)

    def candidates(self, code: np.ndarray, flips: int, least: int, others: np.ndarray) -> np.ndarray:
        """Rows of ``others`` that probing finds; while these are fewer than ``least``, with one bit more flipped."""
        least = min(least, int(others.sum()))
        while True:
            found = self.probe(code, flips)
            found = found[others[found]]
            if len(found) >= least:
                return found
            flips += 1


def exact_scores(x: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Inner products summed from the first component to the last, so that equal rows score alike anywhere."""
    return np.add.accumulate(x * vector, axis=1)[:, -1]


def best_of(x: np.ndarray, ids: np.ndarray, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k rows of the largest exact score, ties to the smaller id, and their scores."""
    rough = x @ vector
    if len(rough) > k:
        least = np.partition(rough, len(rough) - k)[len(rough) - k]
        sure = np.flatnonzero(rough >= least - 1e-9 * max(1.0, float(np.abs(x).max() * np.abs(vector).sum())))
    else:
        sure = np.arange(len(rough))
    score = exact_scores(x[sure], vector)
    best = np.lexsort((ids[sure], -score))[:k]
    return sure[best], score[best]


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and embedding (doubles) of rows that take part: not null, finite, not zero."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("embedding")).filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.filter(finite & F.exists("embedding", lambda x: x != 0))


def index_vectors(rows: DataFrame, coder: Coder) -> DataFrame:
    """Every row with its code, written once: vec_id, embedding, code (two bytes a substring), slot.

    ``slot`` tells rows apart, so that copies of one row can be dealt to different blocks.
    """
    shared = rows.sparkSession.sparkContext.broadcast(coder)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                code = pa.array([c.tobytes() for c in shared.value.encode(_matrix(part.column(1)))], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), code, part.column(2)], names=["vec_id", "embedding", "code", "slot"])

    numbered = rows.withColumn("slot", F.monotonically_increasing_id())
    return materialize(numbered.mapInArrow(encode, "vec_id long, embedding array<double>, code binary, slot long"), "codes")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _answers(x: np.ndarray, ids: np.ndarray, index: SubstringIndex, asked: pa.RecordBatch, k: int, flips: int) -> pa.RecordBatch:
    """The k best rows of a block for each query of a batch."""
    got: tuple[list, list, list] = ([], [], [])
    for query, vector, code in zip(asked.column("vec_id").to_pylist(), _matrix(asked.column("embedding")), _codes(asked.column("code")), strict=True):
        near = index.candidates(code, flips, k, ids != query)
        best, score = best_of(x[near], ids[near], vector, k)
        got[0].extend([query] * len(best))
        got[1].extend(ids[near[best]].tolist())
        got[2].extend(score.tolist())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(got, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])


def _meet(k: int, flips: int, at_once: int = 256) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by (block, asked): a block's rows come first and are indexed once, then its queries stream past."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, index = None, [], None
        for batch in batches:
            key, asks = batch.column("block").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (asks[1:] != asks[:-1])) + 1
            for begin, end in pairwise([0, *cuts.tolist(), batch.num_rows]):
                if begin == end:
                    continue
                if key[begin] != block:
                    block, held, index = key[begin], [], None
                part = batch.slice(begin, end - begin)
                if not asks[begin]:
                    held.append(part)
                    continue
                if index is None and held:
                    base = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, x, ids, index = [], _matrix(base.column("embedding")), base.column("vec_id").to_numpy(), SubstringIndex(_codes(base.column("code")))
                for at in range(0, part.num_rows if index else 0, at_once):
                    yield _answers(x, ids, index, part.slice(at, at_once), k, flips)

    return run


def search(vectors: DataFrame, k: int = 20, every: int = 20, block: int = 8192, query_block: int = 65_536, sample_rows: int = 4096, most_tasks: int = 20_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest of all other rows, by inner product, for each id that ``every`` divides.

    Returns query_id, rank (from 1), vec_id, score, nearest first, ties to the smaller vec_id.

    All rows are coded once, and lie in blocks of about ``block`` rows by a hash.  A block is indexed by
    each substring once for ``query_block`` queries, which stream past it (fewer, where the table has too
    few blocks for all cores), so a task holds one block and a batch of queries.  A query reads the rows
    of the buckets it probes and no others, with more bits flipped where these are fewer than k, and k
    rows a query leave the task.  ``sample_rows`` bounds the rows that rotations, substrings and flips are
    learned on.

    Vectors that are null, zero or hold null or non-finite components take no part; nor do those whose
    length differs from the sample's most common one.  Repeated rows of one id count as candidates
    each; a query's own id never is one.  Where an id that asks repeats with different vectors, the
    smallest of them (by components) asks.  An empty table gives no rows; other columns are ignored.
    """
    rows = usable_vectors(vectors, id_col, vector_col)
    out = "query_id long, vec_id long, score double"
    sample = sorted(hashed_sample(rows, "vec_id", sample_rows).collect(), key=lambda r: (r["vec_id"], r["embedding"]))
    if not sample:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    sizes = [len(r["embedding"]) for r in sample]
    size = max(set(sizes), key=lambda n: (sizes.count(n), n))
    rows = rows.filter(F.size("embedding") == size)
    total = rows.count()
    chosen = np.random.default_rng(1).permutation(np.array([r["embedding"] for r in sample if len(r["embedding"]) == size]))
    coder = learn_coder(chosen, total, k)
    index = index_vectors(rows, coder)
    queries = index.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("embedding", "code")).alias("one")).select("vec_id", "one.*")
    n_asked, n_blocks = queries.count(), max(1, -(-total // block))
    dealt = min(-(-n_asked // 256), -(-2 * vectors.sparkSession.sparkContext.defaultParallelism // n_blocks))
    groups = max(1, -(-n_asked // query_block), dealt)
    number, group = F.pmod(F.xxhash64("slot"), F.lit(n_blocks)), F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(groups))
    columns = ["block", "asks", "vec_id", "embedding", "code"]
    every_group, every_block = (F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))) for n in (groups, n_blocks))
    left = index.withColumn("_g", every_group).withColumns({"block": number * groups + F.col("_g"), "asks": F.lit(False)}).select(columns)
    right = queries.withColumn("_b", every_block).withColumns({"block": F.col("_b") * groups + group, "asks": F.lit(True)}).select(columns)
    parts = min(n_blocks * groups, most_tasks)
    met = left.unionByName(right).repartitionById(parts, F.pmod("block", F.lit(parts)).cast("int")).sortWithinPartitions("block", "asks")
    found = met.mapInArrow(_meet(k, coder.flips), out)
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Two multinomials over hashed byte n-grams are counted: one over all documents, one over trusted
rows.  A document's score is the mean log ratio of its n-grams (so length does not matter), and
every document is kept or dropped by one fixed threshold: no sampling, no randomness.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm.common import WORD, sized, slices

_WORDS = re.compile(WORD)
_HAS_WORD = re.compile(WORD).search
#: Fixed value: characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
VERDICTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def hashed_ngrams(text: str, n: int, bits: int) -> np.ndarray:
    """Bucket of every byte n-gram of the text (none if it has fewer than n bytes)."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    count = len(raw) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    h = np.zeros(count, np.uint64)
    for k in range(n):
        h = (h << np.uint64(8)) | raw[k : k + count]
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = _WORDS.findall(text)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    dup = 0
    if len(set(lines)) < len(lines):
        seen = set()
        for line in lines:
            if line in seen:
                dup += 1
            elif _HAS_WORD(line):
                seen.add(line)
    return len(words), chars, symbols, dup, repeated_words(words)


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of WINDOW words found twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n <= 1:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    width = WINDOW
    part = 1
    while part < width:  # names of windows of 1, 2, 4, 8 words: equal names mean equal windows
        pairs = ids[: len(ids) - part] * (int(ids.max()) + 1) + ids[part:]
        ordered = np.sort(pairs)
        if part * 2 == width and not (ordered[1:] == ordered[:-1]).any():
            return 0
        ids = np.searchsorted(ordered, pairs)
        part *= 2
    many = np.bincount(ids, minlength=len(ids))[ids] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(many), 1)
    np.add.at(covered, np.flatnonzero(many) + width, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def ngram_ratios(docs: DataFrame, labels: DataFrame, n: int = 4, bits: int = 16, smoothing: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log ratio of target to raw probability for each of the 2**bits buckets.

    The raw multinomial counts every n-gram of every document; the target those of every trusted
    row (quality 1 in some label of its id).  Up to a million trusted ids are broadcast, and texts stay where they are; more meet
    the texts by a merge join.  Tasks add their rows up to vectors of fixed length, so what the driver gets (2**bits rows) does not depend on texts.
    """
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, size), np.int64)
        for batch in slices(batches):
            grams: tuple[list, list] = ([], [])
            for text, trusted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    g = hashed_ngrams(text, n, bits)
                    grams[0].append(g)
                    if trusted:
                        grams[1].append(g)
            for k in (0, 1):
                if grams[k]:
                    totals[k] += np.bincount(np.concatenate(grams[k]), minlength=size)
        at = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[0][at]), pa.array(totals[1][at])], names=["bucket", "raw", "target"])

    good = labels.filter(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("id")).filter("id IS NOT NULL").distinct().withColumn("trusted", F.lit(True))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(sized(good), "id", "left").select("text", "trusted")
    got = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(size), np.zeros(size)
    raw[got.bucket], target[got.bucket] = got.raw, got.target
    seen = max(1, int((raw > 0).sum()))
    if not target.sum():
        return np.zeros(size)
    return np.log((target + smoothing) / (target.sum() + smoothing * seen)) - np.log((raw + smoothing) / (raw.sum() + smoothing * seen))


def judge_documents(docs: DataFrame, labels: DataFrame, threshold: float = -0.7, n: int = 3, bits: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base rule, score and verdict for every document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    score.  base_failed: n_words < 20, or 100 * n_repeat_words > 30 * n_words.  kept: not
    base_failed, and the mean log ratio of the text's n-grams is at least ``threshold``.

    The target is fitted on all trusted rows, the corpus on all rows.
    Without trusted rows every score is 0.  Null text has no words and fails the base rule.
    Repeated rows get equal verdicts; null ids pass through; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ratios = docs.sparkSession.sparkContext.broadcast(ngram_ratios(rows, labels, n, bits))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in VERDICTS.split(", ")]
        for batch in slices(batches):
            out = zip(*[verdict(t, ratios.value, threshold, n, bits) for t in batch.column(1).to_pylist()], strict=True)
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(out, types, strict=True)]], names=names)

    return rows.mapInArrow(judge, VERDICTS)


def verdict(text: str | None, ratios: np.ndarray, threshold: float, n: int, bits: int) -> tuple[int, int, int, int, int, bool, bool, float]:
    """Base counts, base_failed, kept and score of one text."""
    text = text or ""
    counts = base_counts(text)
    grams = hashed_ngrams(text, n, bits)
    score = float(ratios[grams].mean()) if len(grams) else 0.0
    failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
    return *counts, failed, not failed and score >= threshold, score


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = -0.7, n: int = 3, bits: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose verdict is kept. No shuffle of texts."""
    ratios = docs.sparkSession.sparkContext.broadcast(ngram_ratios(docs, labels, n, bits, id_col=id_col, text_col=text_col))
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array([verdict(t, ratios.value, threshold, n, bits)[6] for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)

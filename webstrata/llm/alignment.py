"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, by merge-path partitioning.

The ends of both tokenizers' tokens, as byte offsets, are two sorted lists.  Diagonals of their merge
matrix, found by binary search, cut the merge into pieces of equal work that need nothing of each
other (Odeh and others, 2012).  A piece emits overlaps, the stretches that one token of each side
covers; overlaps that a cut parted are stitched, and those at whose end both tokens end close a group.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from webstrata.llm.common import materialize, slices
from webstrata.llm.packing import ByteTokenizer

PIECE = 1 << 16
BATCH_BYTES = 1 << 20
ALIGNED = "part string, num long, doc_id long, n_a long, n_b long, n_groups long, groups string, pairs array<long>, times array<long>"


def diagonal_cuts(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) where the merge of two sorted lists has taken 0, piece, 2 piece, ... items; equal ones of ``a`` first.

    All diagonals are searched at once: i is the first place at which ``a`` lies beyond the item of ``b`` across it.
    """
    at = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        i = np.where(open_, middle, 0)
        beyond = a[np.minimum(i, len(a) - 1)] > b[np.clip(at - i - 1, 0, len(b) - 1)]
        low, high = np.where(open_ & ~beyond, middle + 1, low), np.where(open_ & beyond, middle, high)
    return low, at - low


def piece_overlaps(a: np.ndarray, b: np.ndarray, i: slice, j: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps that end within one piece: their end, and the tokens of both sides that cover them."""
    ends = np.sort(np.concatenate([a[i], b[j]]), kind="stable")
    ends = ends[np.append(True, ends[1:] != ends[:-1])]
    return ends, i.start + np.searchsorted(a[i], ends), j.start + np.searchsorted(b[j], ends)


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All overlaps of two token sequences with the same last end: end, token of a, token of b, and whether a group closes."""
    cut_i, cut_j = diagonal_cuts(a, b, piece)
    found = [piece_overlaps(a, b, slice(cut_i[k], cut_i[k + 1]), slice(cut_j[k], cut_j[k + 1])) for k in range(len(cut_i) - 1)]
    ends, of_a, of_b = (np.concatenate(x) for x in zip(*found, strict=True))
    #: A cut between two equal ends makes the overlap appear in both pieces: it is one.
    whole = np.append(True, ends[1:] != ends[:-1])
    ends, of_a, of_b = ends[whole], of_a[whole], of_b[whole]
    return ends, of_a, of_b, (a[of_a] == ends) & (b[of_b] == ends)


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and the digits of their ids."""

    def __init__(self, byte_path: str, piece_path: str):
        from sentencepiece import SentencePieceProcessor

        self.byte_path, self.byte_library = byte_path, None
        self.byte = ByteTokenizer(byte_path).bpe
        self.piece = SentencePieceProcessor(model_file=piece_path)
        n_a, n_b = self.byte.n_vocab, self.piece.get_piece_size()
        known = set(self.byte.token_byte_values())
        self.bytes_a = np.full(n_a, b"", object)
        for token in known:
            self.bytes_a[self.byte.encode_single_token(token)] = token
        self.bytes_b = np.full(n_b, b"", object)
        for i in range(n_b):
            piece = self.piece.id_to_piece(i)
            byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
            self.bytes_b[i] = bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        #: Written ids with what follows them: within a group a comma, at its end | after a, ; after b.
        self.digits = np.array([f"{i}{end}" for n, last in ((n_a, "|"), (n_b, ";")) for i in range(n) for end in (",", last)], object)
        self.of_b = 2 * n_a

    def encode_a(self, text: str) -> np.ndarray:
        try:
            return self.byte.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.int64)
        except ValueError:  # a run of white space that the fast library can't take
            if self.byte_library is None:
                self.byte_library = Tokenizer.from_file(self.byte_path)
                self.byte_library.no_truncation()
                self.byte_library.no_padding()
                self.byte_library.encode_special_tokens = True
            return np.array(self.byte_library.encode(text, add_special_tokens=False).ids, np.int64)

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both tokenizers; None for a text without tokens or whose bytes a tokenizer doesn't keep."""
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        pieces = self.piece.encode([t or "" for t in texts], num_threads=1)
        for text, ids in zip(texts, pieces, strict=True):
            if not text:
                out.append(None)
                continue
            whole, a, b = (" " + text).encode(), self.encode_a(" " + text), np.array(ids, np.int64)
            kept = b"".join(self.bytes_b[b]) == whole and b"".join(self.bytes_a[a]) == whole
            out.append((a, b) if kept else None)
        return out


_tokenizers: dict[tuple[str, str], Tokenizers] = {}


def _align(tok: Tokenizers, ids: list[tuple[np.ndarray, np.ndarray] | None], piece: int) -> Iterator[tuple[int, int, int, str, np.ndarray, np.ndarray]]:
    """n_a, n_b, n_groups, groups, linked id pairs and how often each, for every text of a batch."""
    have = [x for x in ids if x is not None]
    if have:
        a, b = np.concatenate([x[0] for x in have]), np.concatenate([x[1] for x in have])
        _, of_a, of_b, closes = overlaps(np.cumsum(tok.sizes_a[a]), np.cumsum(tok.sizes_b[b]), piece)
        last_a, last_b = of_a[closes], of_b[closes]
        pairs = a[last_a] << 32 | b[last_b]
        ends_a, ends_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        ends_a[last_a] = ends_b[last_b] = 1
        #: In the written form a token follows its own side's tokens and the other side's of the groups before it (a) or up to its own (b).
        written = np.empty(len(a) + len(b), np.int64)
        group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        written[np.arange(len(a)) + np.append(0, last_b + 1)[group_a]] = 2 * a + ends_a
        written[np.arange(len(b)) + (last_a + 1)[group_b]] = tok.of_b + 2 * b + ends_b
        digits = tok.digits[written]
    at_a = at_b = group = 0
    for x in ids:
        if x is None:
            yield 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)
            continue
        to_a, to_b = at_a + len(x[0]), at_b + len(x[1])
        to_group = int(np.searchsorted(last_a, to_a))
        linked, times = np.unique(pairs[group:to_group], return_counts=True)
        yield len(x[0]), len(x[1]), to_group - group, "".join(digits[at_a + at_b : to_a + to_b])[:-1], linked, times
        at_a, at_b, group = to_a, to_b, to_group


def align_documents(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """Tokens of every text by both tokenizers, cut into groups where they end together; a map, nothing is shuffled.

    Side a encodes a space and the text with a byte-level BPE file, side b the text with a
    sentencepiece model, which adds the space.  Strings of special tokens are ordinary text.  Returns
    part and num (they name a row once the table is written), doc_id, n_a, n_b, n_groups, groups (ids
    in order, written ``a1,a2|b1;a3|b2,b3``), pairs (linked ids, a * 2^32 + b) and times (how often).

    A null or empty text, and one whose bytes the tokenizers don't give back, has no tokens: zeros,
    an empty text, empty arrays.  Repeated rows and null ids are kept.  Other columns are ignored.
    Texts are encoded whole, about ``BATCH_BYTES`` of them at a time, or one longer text.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizers.get((byte_path, piece_path)) or _tokenizers.setdefault((byte_path, piece_path), Tokenizers(byte_path, piece_path))
        part, num = uuid.uuid4().hex, 0
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        names = [c.split()[0] for c in ALIGNED.split(", ")]
        for batch in slices(batches):
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sizes = np.cumsum([len(t or "") for t in texts])
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_BYTES)))
                rows = list(_align(tok, tok.encode(texts[at:to]), piece))
                columns = [[part] * len(rows), range(num, num + len(rows)), doc_ids[at:to], *zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)
                at, num = to, num + len(rows)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(align, ALIGNED)


def link_counts(aligned: DataFrame) -> DataFrame:
    """How many links of the corpus hold each id pair: pair, count, best (no pair of its b id has more)."""
    counts = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count"))
    counts = materialize(counts, "links")
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    #: One row for each id of the second vocabulary at most.
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return counts.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, hot_pairs: int = 1 << 19) -> DataFrame:
    """Each row of a written ``align_documents`` table with n_links, n_best and count_sum.

    n_best are links whose pair is the most frequent one of its b id in the whole corpus, ties
    included; count_sum adds up the pairs' counts over all links.  Counts of the most frequent pairs, at most
    ``hot_pairs``, are broadcast (down to a power of two of the count that keeps to that bound); rarer
    pairs, if there are any, are joined by key, so no table grows past its bound and no key is hot.
    """
    counts = materialize(link_counts(aligned), "counts")
    power = F.floor(F.log2("count")).cast("int")
    sizes = {r["power"]: r["n"] for r in counts.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, held = 64, 0
    for p in sorted(sizes, reverse=True):
        held += sizes[p]
        if held > hot_pairs:
            break
        least = p
    keys = [c for c in aligned.columns if c not in ("pairs", "times")]
    links = aligned.select(*keys, F.explode_outer(F.arrays_zip("pairs", "times")).alias("x")).select(*keys, F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    scored = links.join(F.broadcast(counts.filter(power >= least)), "pair", "left")
    if sum(sizes.values()) > sum(n for p, n in sizes.items() if p >= least):
        rare = scored.filter("pair IS NOT NULL AND count IS NULL").drop("count", "best").join(counts.filter(power < least).hint("merge"), "pair")
        scored = scored.filter("pair IS NULL OR count IS NOT NULL").unionByName(rare)
    zero = F.lit(0).cast("long")
    return scored.groupBy(*keys).agg(
        F.coalesce(F.sum("n"), zero).alias("n_links"), F.coalesce(F.sum(F.when(F.col("best"), F.col("n"))), zero).alias("n_best"),
        F.coalesce(F.sum(F.col("n") * F.col("count")), zero).alias("count_sum"),
    )


def summarize(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """The digest of aligned documents and their links; the written groups are hashed as they come, and not stored."""
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    aligned = materialize(align_documents(docs, byte_path, piece_path).withColumn("groups_sha256", digest).drop("groups"), "aligned")
    return score_links(aligned).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

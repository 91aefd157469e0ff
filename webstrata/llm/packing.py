"""Harmonic packing of tokenised documents into fixed-length sequences.

Lengths fall into reciprocal-capacity classes: class j holds lengths of which exactly j fit a
sequence.  Every bin of class j takes exactly j pieces, so bins are filled by numbering alone, in
many independent cells, and no packer sees more than its own cell (Lee and Lee, 1985).
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from webstrata.llm.common import materialize, slices

#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int"


def harmonic_cuts(capacity: int, slack: float) -> list[list[int]]:
    """How a rest of each length 0..capacity is cut.

    A piece stays whole if a bin of its class wastes at most ``slack`` of the capacity; else the
    largest length of the next class is cut off, which fills its bins.
    """
    cuts: list[list[int]] = [[]]
    for length in range(1, capacity + 1):
        fits = capacity // length
        if fits * length >= capacity * (1 - slack):
            cuts.append([length])
        else:
            first = capacity // (fits + 1)
            cuts.append([first, *cuts[length - first]])
    return cuts


class ByteTokenizer:
    """Ids of a byte-level BPE file, as the tokenizers library gives without added special tokens.

    The file's vocabulary is read as byte ranks and encoded by tiktoken, which gives the same ids
    several times faster.  Strings of special tokens in a text become their own ids.  A text that
    tiktoken's pattern can't take (a run of some 700,000 spaces, say) goes to the library itself.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(spare)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.bpe = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        try:
            return self.bpe.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        except ValueError:
            return np.array(self._library().encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _library(self) -> Tokenizer:
        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return self.library


_tokenizers: dict[str, ByteTokenizer] = {}


def tokenize_and_cut(docs: DataFrame, tokenizer_path: str, capacity: int, slack: float, end_id: int) -> DataFrame:
    """One row per piece: its document, place, checksum and class. Every id lies in one piece."""
    cuts = harmonic_cuts(capacity, slack)
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizers.get(tokenizer_path) or _tokenizers.setdefault(tokenizer_path, ByteTokenizer(tokenizer_path))
        for batch in slices(batches):
            cols: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = tok.encode(text or "") + end
                total = len(ids) // 4
                at = 0
                for length in [capacity] * (total // capacity) + cuts[total % capacity]:
                    row = (doc_id, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), total, capacity // length)
                    for col, v in zip(cols, row, strict=True):
                        col.append(v)
                    at += length
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class"])

    return docs.mapInArrow(cut, PIECES)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, slack: float = 0.02, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = 200_000) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    A document is the ids of its text and then ``end_id``.  Returns one row per piece: doc_id,
    start, length, ids_crc32, doc_tokens, sequence_id, offset, class.

    Full stretches of ``capacity`` ids are class 1; the rest is cut by ``harmonic_cuts``.  Equal
    pieces are counted before anything is numbered, and the distinct ones of a class fall into cells
    by a hash of all they hold, about ``cell_rows`` in each; a cell is numbered on its own, and the
    counts of the cells before it say where its numbers start.  Number k of class j lies in bin k
    div j, so one bin of a class at most stays part-filled.

    Null or empty text packs as the end id alone.  Repeated rows are packed once each.  A null
    doc_id is kept.  An empty table gives no rows; other columns are ignored.  Very long texts are
    encoded whole, in memory in proportion to them.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialize(tokenize_and_cut(rows, tokenizer_path, capacity, slack, end_id), "pieces")
    cells = max(1024, pieces.count() // cell_rows)
    cell = F.pmod(F.xxhash64(*pieces.columns), F.lit(cells)).cast("int")
    distinct = pieces.groupBy(*pieces.columns).agg(F.count(F.lit(1)).alias("n")).withColumn("cell", cell)
    counts = pieces.withColumn("cell", cell).groupBy("class", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("class").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    #: A row per class, at most ``capacity`` of them whatever the input.
    classes = counts.groupBy("class").agg(F.ceil(F.sum("n") / F.col("class")).cast("long").alias("bins"))
    first = Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select("class", F.coalesce(F.sum("bins").over(first), F.lit(0)).alias("first_bin"))
    starts = counts.select("class", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at")).join(classes, "class")
    in_cell = Window.partitionBy("class", "cell").orderBy("doc_id", "start", "ids_crc32", "doc_tokens", "length").rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        distinct.withColumn("rank", F.coalesce(F.sum("n").over(in_cell), F.lit(0)))
        .join(starts, ["class", "cell"])
        .withColumn("number", F.explode(F.sequence(F.col("at") + F.col("rank"), F.col("at") + F.col("rank") + F.col("n") - 1)))
        .withColumn("sequence_id", F.col("first_bin") + F.floor(F.col("number") / F.col("class")))
    )
    in_bin = Window.partitionBy("sequence_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return numbered.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long").alias("sequence_id"),
        F.coalesce(F.sum("length").over(in_bin), F.lit(0)).cast("long").alias("offset"), F.col("class").alias("pieces_per_sequence"),
    )

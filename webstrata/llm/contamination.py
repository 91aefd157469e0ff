"""Benchmark decontamination: an FM-index for each shard of the corpus, searched with test phrases.

A shard is the words of some documents, numbered by the shard's own vocabulary, with a separator
after each document.  Its index is the Burrows-Wheeler transform of that sequence as a wavelet matrix,
and suffix positions of every eighth place.  Phrases are searched backward, all of them at once: a
step is two ranks in the wavelet matrix.  Occurrences are located by walking to the next sampled
position (Ferragina and Manzini, 2000), and spans that touch are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webstrata.llm.common import materialize, slices

WINDOW = 10
SAMPLE = 8
PART = "struct<n:long,width:int,words:binary,word_ends:binary,bits:binary,marks:binary,samples:binary,docs:binary,offsets:binary,starts:binary>"
INDEX = f"shard string, doc_ids array<long>, n_words array<long>, texts array<string>, parts array<{PART}>"
FOUND = "shard string, doc int, doc_id long, n_words long, hits array<struct<start:long,end:long>>, items array<string>, text string"
#: Separators become spaces, A-Z become a-z; bytes of other code points are parts of words.
FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def split_words(text: str) -> list[bytes]:
    """Words of a text: runs of digits, letters a-z and code points from U+0080 on, A-Z lower-cased."""
    return text.encode().translate(FOLD).split()


def suffix_order(text: np.ndarray, width: int) -> np.ndarray:
    """Suffix array of symbols of ``width`` bits. A suffix ends with its first separator (0); equal ones rank by place.

    The first symbols are sorted as one key; then ranks of suffixes are doubled, of those only that
    are not told apart yet (Larsson and Sadakane).
    """
    n, first = len(text), max(1, 62 // width)
    padded = np.concatenate([text, np.zeros(first, np.int64)])
    key, going = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(first):
        key = key << width | np.where(going, padded[j : j + n], 0)
        going &= padded[j : j + n] > 0
    order = np.argsort(key)
    ended = np.flatnonzero(~going[order])
    places = order[ended]
    order[ended] = places[np.lexsort((places, key[places]))]
    new = ~going[order]
    new[1:] |= key[order[1:]] != key[order[:-1]]
    new[0] = True
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    slots, h = np.flatnonzero(~(new & np.append(new[1:], True))), first
    while len(slots):
        places = order[slots]
        key = rank[places] * n + rank[places + h]
        by = np.argsort(key)
        order[slots], key = places[by], key[by]
        new = np.append(True, key[1:] != key[:-1])
        rank[order[slots]] = np.maximum.accumulate(np.where(new, slots, 0))
        slots, h = slots[~(new & np.append(new[1:], True))], 2 * h
    return order


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bits as 64-bit words, with a spare one at the end for ranks at the length."""
    packed = np.zeros(len(bits) // 64 * 8 + 8, np.uint8)
    found = np.packbits(bits, bitorder="little")
    packed[: len(found)] = found
    return packed.view(np.uint64)


class _Bits:
    """A bit vector with constant-time ranks."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)


def build_part(text: np.ndarray, width: int) -> dict[str, bytes]:
    """Wavelet levels of the transform, marked rows, and the positions of those."""
    order = suffix_order(text, width)
    last = text[order - 1]
    last[order == 0] = 0
    marked = (order % SAMPLE == 0) | (last == 0)
    levels, at = [], last
    for level in range(width - 1, -1, -1):
        bit = (at >> level & 1).astype(bool)
        levels.append(_packed(bit).tobytes())
        at = np.concatenate([at[~bit], at[bit]])
    return {"bits": b"".join(levels), "marks": _packed(marked).tobytes(), "samples": order[marked].astype("<u4").tobytes()}


class FMIndex:
    """Backward search and location in one part of a shard."""

    def __init__(self, part: dict):
        self.n, self.width = part["n"], part["width"]
        size = self.n // 64 + 1
        bits = np.frombuffer(part["bits"], np.uint64)
        self.levels = [_Bits(bits[k * size : (k + 1) * size]) for k in range(self.width)]
        self.zeros = [self.n - int(b.ones(np.array([self.n]))[0]) for b in self.levels]
        self.marks, self.samples = _Bits(np.frombuffer(part["marks"], np.uint64)), np.frombuffer(part["samples"], "<u4")
        ends = np.frombuffer(part["word_ends"], "<u4").astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(np.int32(0), ends).tobytes()), pa.py_buffer(part["words"])])
        self.words = words
        symbols = np.arange(1 << self.width)
        reversed_bits = np.zeros_like(symbols)
        for k in range(self.width):
            reversed_bits = reversed_bits << 1 | symbols >> k & 1
        #: Where a symbol's block begins once all levels have parted it, and where it begins in the sorted column.
        self.block = self._down(np.zeros_like(symbols), symbols)
        after = np.append(self.block[np.argsort(reversed_bits)], self.n)
        counts = np.empty_like(symbols)
        counts[np.argsort(reversed_bits)] = np.diff(after)
        self.first = np.cumsum(counts) - counts

    def _down(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = level.ones(at)
            at = np.where(symbol >> (self.width - 1 - k) & 1, zeros + ones, at - ones)
        return at

    def search(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each phrase; ``words`` has its symbols from the last to the first."""
        low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n)
        for j in range(words.shape[1]):
            live = np.flatnonzero((lengths > j) & (low < high))
            symbol = words[live, j]
            ends = self._down(np.concatenate([low[live], high[live]]), np.concatenate([symbol, symbol]))
            base = self.first[symbol] - self.block[symbol]
            low[live], high[live] = ends[: len(live)] + base, ends[len(live) :] + base
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: steps back to a marked row, whose position is known."""
        found, going, at = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows
        step = 0
        while len(going):
            marked = self.marks.get(at) == 1
            found[going[marked]] = self.samples[self.marks.ones(at[marked])] + step
            going, at, step = going[~marked], at[~marked], step + 1
            symbol, down = np.zeros(len(at), np.int64), at
            for level, zeros in zip(self.levels, self.zeros, strict=True):
                bit, ones = level.get(down), level.ones(down)
                symbol, down = symbol << 1 | bit, np.where(bit == 1, zeros + ones, down - ones)
            at = self.first[symbol] + down - self.block[symbol]
        return found


def _part(pieces: list[tuple[int, int, np.ndarray, np.ndarray]]) -> dict:
    """One indexed part: pieces of documents (number, first word, bytes of words, their lengths)."""
    lengths = np.concatenate([p[3] for p in pieces])
    ends = np.cumsum(lengths)
    data = np.concatenate([p[2] for p in pieces]).tobytes()
    coded = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int64).tobytes()), pa.py_buffer(data)]).dictionary_encode()
    sizes = np.array([len(p[3]) for p in pieces])
    text = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1, np.cumsum(sizes), 0)
    width = max(1, int(len(coded.dictionary)).bit_length())
    word_sizes = pc.binary_length(coded.dictionary).to_numpy()
    return {
        "n": len(text), "width": width, "words": b"".join(coded.dictionary.to_pylist()), "word_ends": np.cumsum(word_sizes).astype("<u4").tobytes(),
        **build_part(text, width), "docs": np.array([p[0] for p in pieces], "<u4").tobytes(), "offsets": np.array([p[1] for p in pieces], "<u8").tobytes(),
        "starts": (np.cumsum(sizes + 1) - sizes - 1).astype("<u4").tobytes(),
    }


def _words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text's words one after another, and the words' lengths."""
    folded = np.frombuffer(text.encode().translate(FOLD), np.uint8)
    inside = folded != 0x20
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return folded[inside], edges[1::2] - edges[::2]


class _Shard:
    """Documents gathered for one index row, and the parts that are full."""

    def __init__(self, shard_words: int, window: int, keep_texts: bool):
        self.limit, self.overlap, self.keep_texts = shard_words, window - 1, keep_texts
        self.ids: list = []
        self.counts: list[int] = []
        self.texts: list = []
        self.parts: list[dict] = []
        self.pieces: list = []
        self.size = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        data, lengths = _words(text or "")
        ends = np.append(0, np.cumsum(lengths))
        at = 0
        while at < len(lengths):
            stop = min(len(lengths), at + self.limit)
            self.pieces.append((len(self.ids), at, data[ends[at] : ends[stop]], lengths[at:stop]))
            self.size += stop - at
            if stop < len(lengths):
                self.close()
                at = stop - self.overlap
            else:
                at = stop
        self.ids.append(doc_id)
        self.counts.append(len(lengths))
        self.texts.append(text)

    def close(self) -> None:
        if self.pieces:
            self.parts.append(_part(self.pieces))
        self.pieces, self.size = [], 0

    def row(self, name: str) -> pa.RecordBatch:
        self.close()
        values = [[name], [self.ids], [self.counts], [self.texts if self.keep_texts else None], [self.parts]]
        binary = ("words", "word_ends", "bits", "marks", "samples", "docs", "offsets", "starts")
        part = pa.struct([("n", pa.int64()), ("width", pa.int32()), *((name, pa.binary()) for name in binary)])
        types = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(part))
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=["shard", "doc_ids", "n_words", "texts", "parts"])


def index_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_words: int = 1 << 20, keep_texts: bool = False, window: int = WINDOW) -> DataFrame:
    """FM-indexes of all documents: a row per shard of about ``shard_words`` words; a map, nothing is shuffled.

    Every document lies in one shard.  One of more words than a shard is cut into several indexed
    parts of its row, which overlap by a window less one word, so that memory beyond the text
    itself stays bounded.  ``keep_texts`` stores the texts too, for ``search_index`` to give them back.
    The table can be written and searched again with other phrases of up to ``window`` words.

    Null or empty texts have no words and are listed nevertheless; so are null and repeated ids.
    An empty table gives no rows.  Other columns are ignored.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        shard = _Shard(shard_words, window, keep_texts)
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard.add(doc_id, text)
                if shard.size >= shard_words or len(shard.ids) >= shard_words or shard.parts:
                    yield shard.row(uuid.uuid4().hex)
                    shard = _Shard(shard_words, window, keep_texts)
        if shard.ids:
            yield shard.row(uuid.uuid4().hex)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(build, INDEX)


class Phrases:
    """Windows of the items: words numbered in one vocabulary, equal windows once, with the items that hold them."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        vocabulary: dict[bytes, int] = {}
        numbers: dict[tuple[int, ...], int] = {}
        pairs: set[tuple[int, int]] = set()
        names: dict[str | None, int] = {}
        for name, text in items:
            words = [vocabulary.setdefault(w, len(vocabulary)) for w in split_words(text or "")]
            item = names.setdefault(name, len(names))
            for at in range(max(1, len(words) - window + 1) if words else 0):
                phrase = tuple(words[at : at + window])
                pairs.add((numbers.setdefault(phrase, len(numbers)), item))
        self.vocabulary, self.names = pa.array(list(vocabulary), pa.binary()), list(names)
        self.lengths = np.array([len(p) for p in numbers], np.int64)
        self.words = np.array([[*reversed(p), *[0] * (window - len(p))] for p in numbers], np.int64).reshape(len(numbers), window)
        of = np.array(sorted(pairs), np.int64).reshape(len(pairs), 2)
        self.items, self.item_ends = of[:, 1], np.searchsorted(of[:, 0], np.arange(len(numbers) + 1))

    def find(self, index: FMIndex, chunk: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and phrases of all occurrences, ``chunk`` at a time."""
        known = pc.index_in(self.vocabulary, value_set=index.words).to_numpy(zero_copy_only=False)
        symbols = np.where(np.isnan(known), 0, known + 1).astype(np.int64) if known.dtype.kind == "f" else known.astype(np.int64) + 1
        words = symbols[self.words]
        used = np.arange(words.shape[1])[None, :] < self.lengths[:, None]
        whole = np.flatnonzero(~((words == 0) & used).any(axis=1))
        low, high = index.search(words[whole], self.lengths[whole])
        ends = np.cumsum(high - low)
        for at in range(0, int(ends[-1]) if len(ends) else 0, chunk):
            number = np.arange(at, min(at + chunk, int(ends[-1])))
            of = np.searchsorted(ends, number, side="right")
            yield index.locate(high[of] - (ends[of] - number)), whole[of]


def _search_shard(phrases: Phrases, row: dict) -> tuple[list[list[tuple[int, int]]], list[set[int]]]:
    """Merged word spans and item numbers of each document of a shard."""
    spans: list[np.ndarray] = []
    items: list[set[int]] = [set() for _ in row["doc_ids"]]
    for part in row["parts"]:
        index = FMIndex(part)
        docs, starts = np.frombuffer(part["docs"], "<u4").astype(np.int64), np.frombuffer(part["starts"], "<u4").astype(np.int64)
        offsets = np.frombuffer(part["offsets"], "<u8").astype(np.int64)
        depth = np.zeros(index.n + 1, np.int64)
        held = [np.empty(0, np.int64)]
        for places, found in phrases.find(index):
            depth += np.bincount(places, minlength=index.n + 1) - np.bincount(places + phrases.lengths[found], minlength=index.n + 1)
            held.append(np.unique((np.searchsorted(starts, places, side="right") - 1) * len(phrases.lengths) + found))
        for piece, phrase in zip(*divmod(np.unique(np.concatenate(held)), max(1, len(phrases.lengths))), strict=True):
            items[docs[piece]].update(phrases.items[phrases.item_ends[phrase] : phrases.item_ends[phrase + 1]].tolist())
        edges = np.flatnonzero(np.diff(np.cumsum(depth) > 0, prepend=False))
        piece = np.searchsorted(starts, edges[::2], side="right") - 1
        shift = offsets[piece] - starts[piece]
        spans.append(np.stack([docs[piece], edges[::2] + shift, edges[1::2] + shift], axis=1))
    merged: list[list[tuple[int, int]]] = [[] for _ in row["doc_ids"]]
    for doc, start, end in sorted(map(tuple, np.concatenate(spans).tolist())) if spans else []:
        merged[doc] = merge_spans([*merged[doc][-1:], (start, end)], merged[doc][:-1])
    return merged, items


def merge_spans(spans: list[tuple[int, int]], done: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Sorted spans with those that overlap or touch made one, after ``done``."""
    out = done if done is not None else []
    for start, end in spans:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _searched(index: DataFrame, phrases: Broadcast, window: int) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = Phrases(phrases.value, window)
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            spans, items = _search_shard(test, row)
            n = len(spans)
            hits = pa.array([[{"start": s, "end": e} for s, e in doc] for doc in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            named = pa.array([sorted(name for i in doc if (name := test.names[i]) is not None) for doc in items], pa.list_(pa.string()))
            columns = [pa.array([row["shard"]] * n), pa.array(range(n), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["n_words"], pa.int64()), hits, named, pa.array(row["texts"] or [None] * n, pa.string())]
            out = pa.RecordBatch.from_arrays(columns, names=["shard", "doc", "doc_id", "n_words", "hits", "items", "text"])
            yield from slices([out], 1024)

    return index.mapInArrow(search, FOUND)


@F.udf(T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])), useArrow=True)
def _merged(spans):
    return merge_spans(sorted(map(tuple, spans)))


def search_index(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = 1 << 25) -> DataFrame:
    """All occurrences of the items' windows in an index, as one row per indexed document.

    A window is ``window`` consecutive words of an item; an item of fewer words is one window.
    Returns shard, doc (number in the shard), doc_id, n_words, hits (merged spans of words, end
    exclusive), items (ids of items with occurrences, sorted as strings) and text (if the index keeps it).

    Items are a stated query set: they reach the tasks in blocks of about ``block_bytes`` of text, by
    a hash, so what the driver and a broadcast hold is bounded.  With more blocks than one the index
    is written first, and each block's hits are merged by document.

    Items without words match nothing; windows of an item without an id are hits, but no id is listed.
    """
    rows = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text <> ''").distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_bytes))
    if blocks > 1:
        index, rows = materialize(index, "shards"), materialize(rows, "items")
    found = []
    for k in range(blocks):
        block = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        found.append(_searched(index, index.sparkSession.sparkContext.broadcast([(r["id"], r["text"]) for r in block.collect()]), window))
    if blocks == 1:
        return found[0]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more.withColumn("text", F.lit(None).cast("string")))
    one = [F.first(c, ignorenulls=True).alias(c) for c in ("doc_id", "n_words")]
    merged = every.groupBy("shard", "doc").agg(*one, F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.first("text", ignorenulls=True).alias("text"))
    return merged.withColumn("hits", _merged("hits"))


def find_contamination(docs: DataFrame, items: DataFrame, **options: int) -> DataFrame:
    """Index all documents and search the items in them; see ``index_shards`` and ``search_index``."""
    return search_index(index_shards(docs, **options), items)


@F.udf(T.StringType(), useArrow=True)
def cut_words(text: str | None, hits: list | None) -> str | None:
    """The text without the given word spans, from each span's first word to the end of its last one."""
    if not text or not hits:
        return text
    data = text.encode()
    inside = np.frombuffer(data.translate(FOLD), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    kept, at = [], 0
    for start, end in hits:
        kept.append(data[at : edges[2 * start]])
        at = int(edges[2 * end - 1])
    return b"".join([*kept, data[at:]]).decode()


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Texts without what they share with the items: doc_id, text, n_words, hits, items."""
    found = search_index(index_shards(docs, keep_texts=True), items)
    return found.select("doc_id", cut_words("text", "hits").alias("text"), "n_words", "hits", "items")


def summarize(found: DataFrame) -> DataFrame:
    """The digest of ``search_index``'s rows: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )

"""Entries of HAR files of any size, as rows of JSON text, without a whole file in one row."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Large files are read in pieces that end here: each entry has the key once, so a piece is about an entry.
SEPARATOR = '"request"'
_TOKEN = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\Z)|[{}\[\]]', re.DOTALL)
_CLOSES = {"}": "{", "]": "["}


class EntrySplitter:
    """Cuts the objects of ``log.entries`` out of a JSON text that comes in pieces.

    Only the entry that is open is held, and what stands ahead of the log while there is none.
    """

    def __init__(self) -> None:
        self.rest = ""  # text from the open entry's start, or from an unfinished string
        self.ahead: list[str] = []
        self.at = 0  # how far ``rest`` has been read
        self.stack: list[str] = []
        self.last = ""
        self.listed = self.log = self.broken = False

    def feed(self, piece: str) -> Iterator[str]:
        """Entries that the piece completes."""
        if not self.log:
            self.ahead.append(piece)
        if self.broken:
            return
        text, start, stack = self.rest + piece, 0 if self.listed and len(self.stack) > 3 else None, self.stack
        at = self.at
        for token in _TOKEN.finditer(text, self.at):
            kind = text[token.start()]
            if kind == '"':
                if token.end() == len(text) and not _closed(token.group()):
                    break
                self.last = token.group() if len(stack) < 3 else ""
            elif kind in "{[":
                if len(stack) == 3 and self.listed and kind == "{":
                    start = token.start()
                elif len(stack) == 1 and stack == ["{"] and self.last == '"log"' and kind == "{":
                    self.log, self.ahead = True, []
                    stack.append("log")
                    self.last, at = "", token.end()
                    continue
                elif len(stack) == 2 and stack[1] == "log" and self.last == '"entries"' and kind == "[":
                    self.listed = True
                stack.append(kind)
                self.last = ""
            else:
                opened = stack.pop() if stack else None
                if ("{" if opened == "log" else opened) != _CLOSES[kind]:
                    self.broken = True
                    self.rest, self.at = text[start if start is not None else token.start() : token.end()], 0
                    return
                if len(stack) == 3 and start is not None:
                    yield text[start : token.end()]
                    start = None
                elif len(stack) == 2:
                    self.listed = False
            at = token.end()
        keep = at if start is None else start
        unfinished = text.find('"', at)
        if start is None:
            keep = unfinished if unfinished >= 0 else len(text)
        self.rest = text[keep:]
        self.at = (unfinished if unfinished >= 0 else len(text)) - keep

    def end(self) -> tuple[str, str] | None:
        """What is rejected at the end of the file, and why."""
        if not self.log:
            return "".join(self.ahead), "not a HAR log"
        if self.broken or self.stack:
            return self.rest, "HAR log breaks off"
        return None


def _closed(text: str) -> bool:
    """Whether a string that reaches the end of a piece ends in a quote of its own."""
    if len(text) < 2 or text[-1] != '"':
        return False
    body = text[1:-1]
    return (len(body) - len(body.rstrip("\\"))) % 2 == 0


def _split(batch_bytes: int = 1 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (file, value) in order, several of one file in a row; gives (value, reason), reason null for entries."""

    def batch_of(rows: list[tuple[str, str | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["value", "reason"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str | None]]:
        file, splitter = None, EntrySplitter()
        for batch in batches:
            for k in range(batch.num_rows):
                name, piece = batch.column(0)[k].as_py(), batch.column(1)[k].as_py() or ""
                if name == file:
                    piece = SEPARATOR + piece
                else:
                    if file is not None and (left := splitter.end()):
                        yield left
                    file, splitter = name, EntrySplitter()
                for entry in splitter.feed(piece):
                    yield entry, None
        if file is not None and (left := splitter.end()):
            yield left

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, str | None]] = []
        size = 0
        for row in found(batches):
            rows.append(row)
            size += len(row[0])
            if size >= batch_bytes:
                yield batch_of(rows)
                rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return run


def har_entries(spark: SparkSession, path: str, whole_bytes: int = 1 << 23) -> DataFrame:
    """(value, reason): the JSON text of each entry of the HAR files, or what is rejected and why.

    Files of at most ``whole_bytes`` are read whole, a row each, and not shuffled.  Larger ones are read
    by Spark's splits in pieces of about an entry, put in order by file, and joined again as they stream
    through one task a file, which holds the open entry only.  Both ways give the same rows.

    A file without a log object is rejected whole.  One that breaks off, or closes a bracket that isn't
    open, gives the entries before that and a reject with what is left of the open one.  Elements of
    ``entries`` that aren't objects are no entries; a log without entries gives no rows.
    """
    size = F.col("_metadata.file_size")
    small = spark.read.text(path, wholetext=True).filter(size <= whole_bytes).select(F.col("_metadata.file_path").alias("file"), "value")
    large = spark.read.text(path, lineSep=SEPARATOR).filter(size > whole_bytes)
    large = large.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"), "value")
    ordered = large.repartition("file").sortWithinPartitions("file", "start", "n").select("file", "value")
    out = "value string, reason string"
    return small.mapInArrow(_split(), out).unionByName(ordered.mapInArrow(_split(), out))

"""Packing: bounded-space online packing of token ids into sequences, a fixed number of open windows a partition.

Each partition reads its documents once. Full sequences are cut off a long document's front; what remains goes, whole,
into the open window where it fits best. When it fits in none, the fullest window is completed with the piece's first
ids if it lacks more than ``slack`` ids, and is emitted; the rest of the piece opens a window. A partition's windows
that are still open at its end (at most ``open_windows``) are written out with their ids, and a second, small step
merges the leftovers of 64 partitions at a time: only the last window of each such group stays short.

The ids are those that the ``tokenizers`` library gives with the vocabulary's own file, special tokens in the text
included; they are made from the same vocabulary's ranks by another library, as that takes a fifth of the time (732 against 136 CPU
seconds a GB). The pattern of its first step looks ahead only to part runs of white space, and the
look-ahead is what makes it slow; texts in which all white space is single spaces and line ends between visible
characters get the same ids from the pattern without that alternative.

Defined results: a null or empty text has only the closing id; repeated rows are packed as they are; an empty
table gives an empty result; sequence ids are unique, not gapless.
"""

from __future__ import annotations

import base64
import json
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.llm.common import materialise, text_or_empty

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, home int"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("home", pa.int32())])
#: Sequences a task can number; leftovers of so many partitions meet.
PER_TASK, TOGETHER = 1 << 40, 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Ids:
    """The ids of a text as little-endian unsigned 32-bit words, the same as the tokeniser's own.

    ``path``: the ranks; ``tokenizer``: the tokeniser's file, which names the tokens added to them."""

    def __init__(self, path: str, tokenizer: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = public_tokenizers.PATTERN
        self.added = {}
        if tokenizer:
            with open(tokenizer, encoding="utf-8") as f:
                self.added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        make = lambda name, pat: tiktoken.Encoding(name, pat_str=pat, mergeable_ranks=ranks, special_tokens=self.added)
        self.any = make("any", pattern)
        self.plain = make("plain", pattern.replace(r"|\s+(?!\S)", ""))

    def __call__(self, text: str) -> bytes:
        if any(x in text for x in self.added):
            return self.packed(self.any.encode(text, allowed_special="all"))
        words, spaces = text.split(), text.count(" ") + text.count("\n")
        plain = len(words) == spaces + 1 and len("".join(words)) + spaces == len(text)
        return self.packed((self.plain if plain else self.any).encode_ordinary(text))

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return (array("I", ids) if sys.byteorder == "little" else np.asarray(ids, dtype="<u4")).tobytes()


class Window:
    __slots__ = ("free", "pieces")

    def __init__(self, size: int):
        self.free, self.pieces = size, []


class Packer:
    """Best fit into a fixed number of open windows. A piece is (doc_id, start, ids as bytes, tokens of its document)."""

    def __init__(self, size: int, open_windows: int, slack: int, first_id: int, keep_ids: bool):
        self.size, self.most, self.slack, self.next_id, self.keep_ids = size, open_windows, slack, first_id, keep_ids
        self.open: list[Window] = []
        self.rows: list[tuple] = []

    def emit(self, w: Window, left_over: int | None = None) -> None:
        """Rows of a window; with ``left_over`` (its home) the window isn't final and the rows carry their ids."""
        offset = 0
        for doc_id, start, ids, total in w.pieces:
            n = len(ids) // 4
            final = left_over is None
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.next_id if final else None, offset, None if final else ids, left_over))
            offset += n
        if left_over is None:
            self.next_id += 1

    def add(self, doc_id: int | None, start: int, ids: bytes, total: int) -> None:
        size = self.size
        whole = len(ids) // 4 // size * size
        for at in range(0, whole, size):
            full = Window(size)
            full.pieces.append((doc_id, start + at, ids[4 * at : 4 * (at + size)], total))
            self.emit(full)
        ids, start = ids[4 * whole :], start + whole
        n = len(ids) // 4
        if not n:
            return
        best = min((w for w in self.open if w.free >= n), key=lambda w: w.free, default=None)
        if best is None and len(self.open) >= self.most:
            fullest = min(self.open, key=lambda w: w.free)
            self.open.remove(fullest)
            if fullest.free > self.slack:
                take = fullest.free
                fullest.pieces.append((doc_id, start, ids[: 4 * take], total))
                ids, start, n = ids[4 * take :], start + take, n - take
            self.emit(fullest)
        if best is None:
            best = Window(size)
            self.open.append(best)
        best.pieces.append((doc_id, start, ids, total))
        best.free -= n
        if not best.free:
            self.open.remove(best)
            self.emit(best)

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _pack(size: int, open_windows: int, slack: int, end_id: int, vocabulary: Callable[[], str], tokenizer: Callable[[], str]):
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        ids_of, packer = Ids(vocabulary(), tokenizer()), Packer(size, open_windows, slack, task * PER_TASK, False)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = ids_of(text) + end if text else end
                packer.add(doc_id, 0, ids, len(ids) // 4)
            if packer.rows:
                yield packer.batch()
        for w in packer.open:
            packer.emit(w, left_over=task)
        if packer.rows:
            yield packer.batch()

    return run


def _merge(size: int, slack: int):
    """Fill windows one after another with leftovers of the same group, cutting freely."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, packer = None, None
        for b in batches:
            for doc_id, start, ids, total, at in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens", "group")), strict=True):
                if at != group:
                    if packer:
                        for w in packer.open:
                            packer.emit(w)
                        yield packer.batch()
                    # merged sequences are numbered below 0, where no first-step task numbers
                    group, packer = at, Packer(size, 1, slack, -(at + 1) * PER_TASK, False)
                packer.add(doc_id, start, ids, total)
            if packer and packer.rows:
                yield packer.batch()
        if packer:
            for w in packer.open:
                packer.emit(w)
            if packer.rows:
                yield packer.batch()

    return run


def pack(docs: DataFrame, size: int = 1024, open_windows: int = 64, slack: int = 8, end_id: int = 0, vocabulary: Callable[[], str] = default_vocabulary, tokenizer: Callable[[], str] = default_tokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    ``vocabulary`` and ``tokenizer``: give the paths of the ranks and of the tokeniser's file on the machine where they are called. ``slack``: ids that an emitted
    window may lack before a document is cut to complete it."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    first = materialise(slim.mapInArrow(_pack(size, open_windows, slack, end_id, vocabulary, tokenizer), PIECE), "packed")
    left = first.where(F.col("sequence_id").isNull()).withColumn("group", F.expr(f"home div {TOGETHER}"))
    met = left.repartition("group").sortWithinPartitions("group", "home", "doc_id", "start")
    merged = met.select("doc_id", "start", "ids", "doc_tokens", "group").mapInArrow(_merge(size, slack), PIECE)
    return first.where(F.col("sequence_id").isNotNull()).unionByName(merged).drop("ids", "home")

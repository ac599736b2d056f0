"""Line dedup: hashes of lines, range-partitioned and sorted by document and position, streamed once.

Each line becomes (two 64-bit hashes of its key, document, position): no text is shuffled. The rows are
range-partitioned on all of these, so a line that a third of all documents share is spread over many tasks.
One pass over each sorted partition decides every run of equal hashes that lies within it. Only the first and the
last run of a partition may go on in a neighbour: their counts (at most two a partition) are summed up, and the
few undecided rows are settled by a broadcast of that bounded summary, as are those of a run that has more rows in few documents
than a task holds. What is dropped comes back as one
compressed bitmap a document.

Defined results: a null or empty text is one empty line; an empty key never repeats (it has no code point);
a document is a distinct (doc_id, text), so repeated rows count once and share the outcome; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.llm.common import by_batch, materialise, row_key, same_key, text_or_empty

_KEY = "translate(trim(BOTH ' \\t\\n\\u000B\\f\\r' FROM line), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RUN = "kind int, h1 long, h2 long, doc_id long, thash long, pos int, first boolean, pid int, n_docs long, last_doc long, last_thash long"
#: Kinds of rows that the streaming pass returns.
DROP, OPEN, EDGE = 0, 1, 2
#: Rows of an undecided run that a task holds; beyond these they are written as undecided.
MOST_HELD = 1 << 20


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """(h1, h2, doc_id, thash, pos) of every line whose key has at least ``min_chars`` code points."""
    lines = docs.select(*row_key(id_col, text_col), F.posexplode(F.split(text_or_empty(text_col), "\n", -1)).alias("pos", "line"))
    keyed = lines.withColumn("key", F.expr(_KEY)).where(F.length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "thash", "pos")


class _Stream:
    """Runs of equal (h1, h2) in one sorted partition."""

    def __init__(self, pid: int, min_docs: int, keep_first: bool):
        self.pid, self.min_docs, self.keep_first = pid, min_docs, keep_first
        self.key, self.runs = None, 0

    def begin(self, key: tuple[int, int], doc: tuple, pos: int) -> None:
        self.key, self.first_doc, self.first_pos, self.last_doc = key, doc, pos, None
        self.n_docs, self.held, self.n_held, self.written = 0, [], 0, False
        self.runs += 1

    def add(self, part: pa.RecordBatch, docs: int, last: tuple) -> Iterator[dict]:
        """Rows of the current run; they are held while they span fewer than min_docs documents and are MOST_HELD at most."""
        self.n_docs, self.last_doc = self.n_docs + docs, last
        # repeated rows of the first occurrence are first too; equal rows always lie in one partition
        doc, thash = self.first_doc
        ids = part.column("doc_id")
        same = ids.is_null() if doc is None else pc.fill_null(pc.equal(ids, doc), False)
        first = same.to_numpy(zero_copy_only=False) & (part.column("thash").to_numpy() == thash) & (part.column("pos").to_numpy() == self.first_pos)
        self.held.append((part, first))
        self.n_held += part.num_rows
        if self.n_docs >= self.min_docs:
            yield from self.flush(DROP)
        elif self.n_held > MOST_HELD:
            self.written = True
            yield from self.flush(OPEN)

    def flush(self, kind: int) -> Iterator[dict]:
        for part, first in self.held:
            # the first row of a partition's first run may or may not be the key's first anywhere: that is settled later
            keep = first if kind == DROP and self.keep_first and self.runs > 1 else np.zeros(len(first), dtype=bool)
            out_kind = np.full(len(first), kind, dtype=np.int32)
            if kind == DROP and self.keep_first and self.runs == 1:
                out_kind[first] = OPEN
            yield {"part": part.filter(pa.array(~keep)), "first": first[~keep], "kind": out_kind[~keep]}
        self.held, self.n_held = [], 0

    def end(self, is_last: bool) -> Iterator[dict]:
        if self.key is None:
            return
        edge = self.runs == 1 or is_last
        if edge and self.held:
            yield from self.flush(OPEN)
        self.held = []
        if edge or self.written and self.n_docs >= self.min_docs:
            yield {"edge": True}


def _stream(min_docs: int, keep_first: bool):
    schema = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("thash", pa.int64()), ("pos", pa.int32()), ("first", pa.bool_()), ("pid", pa.int32()), ("n_docs", pa.int64()), ("last_doc", pa.int64()), ("last_thash", pa.int64())])

    def batch(s: _Stream, x: dict) -> pa.RecordBatch:
        if "edge" in x:
            row = [EDGE, *s.key, *s.first_doc, None, None, s.pid, s.n_docs, *s.last_doc]
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, schema, strict=True)], schema=schema)
        part, n = x["part"], x["part"].num_rows
        nulls = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x["kind"]), *(part.column(c) for c in ("h1", "h2", "doc_id", "thash", "pos")), pa.array(x["first"]), pa.array(np.full(n, s.pid, dtype=np.int32)), nulls, nulls, nulls], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _Stream(TaskContext.get().partitionId(), min_docs, keep_first)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            h1, h2, thash, pos = (b.column(c).to_numpy() for c in ("h1", "h2", "thash", "pos"))
            ids = b.column("doc_id")
            doc, null = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
            new_run = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            new_doc = new_run | np.r_[True, (doc[1:] != doc[:-1]) | (thash[1:] != thash[:-1]) | (null[1:] != null[:-1])]
            doc_at = lambda i: (None if null[i] else int(doc[i]), int(thash[i]))
            starts = np.flatnonzero(new_run)
            ends = np.r_[starts[1:], n]
            counts = np.add.reduceat(new_doc.astype(np.int64), starts)
            # whole runs of the batch that are too small to matter are passed over at once
            for i in np.flatnonzero((counts >= min_docs) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1)):
                a, z, key, docs = int(starts[i]), int(ends[i]), (int(h1[starts[i]]), int(h2[starts[i]])), int(counts[i])
                if key != s.key:
                    for x in s.end(False):
                        yield batch(s, x)
                    s.begin(key, doc_at(a), int(pos[a]))
                elif s.last_doc == doc_at(a):
                    docs -= 1
                for x in s.add(b.slice(a, z - a), docs, doc_at(z - 1)):
                    yield batch(s, x)
        for x in s.end(True):
            yield batch(s, x)

    return run


def _pack(b: pa.RecordBatch) -> pa.RecordBatch:
    """Compressed bitmaps (bit 1: the line stays) from lists of dropped positions."""
    out, count = [], []
    for pos in b.column("dropped").to_pylist():
        at = np.unique(np.asarray(pos, dtype=np.int64))
        bits = np.ones((int(at[-1]) // 8 + 1) * 8, dtype=np.uint8)  # whole bytes, so that no padding bit drops a line
        bits[at] = 0
        out.append(zlib.compress(np.packbits(bits).tobytes(), 6))
        count.append(len(at))
    return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("thash"), pa.array(out, pa.binary()), pa.array(count, pa.int64())], names=["doc_id", "thash", "keep_bitmap", "n_dropped"])


def unpack(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """Which of ``n_lines`` lines stay; positions beyond the bitmap stay, as does all without a bitmap."""
    keep = np.ones(n_lines, dtype=bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8))[:n_lines].astype(bool)
        keep[: len(bits)] = bits
    return keep


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc_id, thash, keep_bitmap, n_dropped) of each document that loses a line.

    Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents lose all their lines, or with
    ``keep_first`` all but the first by document id and position."""
    order = ["h1", "h2", "doc_id", "thash", "pos"]
    hashes = materialise(line_hashes(docs, id_col, text_col, min_chars), "line-hashes")  # range partitioning reads them twice
    ranged = hashes.repartitionByRange(*order).sortWithinPartitions(*order)
    runs = materialise(ranged.mapInArrow(_stream(min_docs, keep_first), _RUN), "line-runs")
    edges = runs.where(F.col("kind") == EDGE)
    # at most two rows a partition, and one for MOST_HELD rows: a document that a border cuts was counted on both sides of it
    by_key = edges.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("pid", "n_docs", F.struct("doc_id", "thash").alias("head"), F.struct(F.col("last_doc").alias("doc_id"), F.col("last_thash").alias("thash")).alias("tail")))).alias("e"))
    total = F.expr("aggregate(e, 0L, (s, x) -> s + x.n_docs) - size(filter(e, (x, i) -> i > 0 and e[i - 1].tail <=> x.head))")
    common = by_key.where(total >= min_docs).select("h1", "h2", F.col("e")[0]["pid"].alias("first_pid"))
    still = runs.where(F.col("kind") == OPEN).join(F.broadcast(common), ["h1", "h2"])
    if keep_first:
        still = still.where(~(F.col("first") & (F.col("pid") == F.col("first_pid"))))
    cols = ["doc_id", "thash", "pos"]
    dropped = runs.where(F.col("kind") == DROP).select(*cols).unionByName(still.select(*cols))
    lists = dropped.groupBy("doc_id", "thash").agg(F.collect_list("pos").alias("dropped"))
    return lists.mapInArrow(by_batch(_pack), "doc_id long, thash long, keep_bitmap binary, n_dropped long")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with ``keep_bitmap`` and ``n_dropped`` (null and 0 where nothing is dropped)."""
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *row_key(id_col, text_col))
    joined = keyed.join(bitmaps, same_key(keyed, bitmaps, "doc_id", "thash"), "left")
    return joined.select("row", "keep_bitmap", F.coalesce(bitmaps["n_dropped"], F.lit(0)).alias("n_dropped"))


def _digest(b: pa.RecordBatch) -> pa.RecordBatch:
    lines, sha = [], []
    for text, bitmap in zip(b.column("text").to_pylist(), b.column("keep_bitmap").to_pylist(), strict=True):
        text = text or ""
        parts = text.split("\n")
        if bitmap is not None:
            text = "\n".join(x for x, k in zip(parts, unpack(bitmap, len(parts)), strict=True) if k)
        lines.append(len(parts))
        sha.append(hashlib.sha256(text.encode()).hexdigest())
    return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lines, pa.int64()), b.column("n_dropped"), pa.array(sha)], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each row of ``docs``."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = apply_bitmaps(slim, keep_bitmaps(slim, min_docs=min_docs, min_chars=min_chars))
    return found.select("row.doc_id", "row.text", "keep_bitmap", "n_dropped").mapInArrow(by_batch(_digest), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """The documents with their columns and without the repeats of lines found in ``min_docs`` documents; first occurrences stay.

    Only the text changes, and the count of characters ``n_chars`` with it where that column exists. A null text stays null."""
    found = apply_bitmaps(docs, keep_bitmaps(docs, min_docs=min_docs, min_chars=min_chars, keep_first=True))
    schema = "text string"

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, bitmap in zip(b.column("text").to_pylist(), b.column("keep_bitmap").to_pylist(), strict=True):
            if bitmap is not None:
                parts = (text or "").split("\n")
                text = "\n".join(x for x, k in zip(parts, unpack(bitmap, len(parts)), strict=True) if k)
            out.append(text)
        return pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *(b.column(c) for c in rest)], names=["text", *rest])

    rest = [f"_{i}" for i, c in enumerate(docs.columns) if c != "text"]
    others = [c for c in docs.columns if c != "text"]
    flat = found.select(F.col("row.text").alias("text"), "keep_bitmap", *(F.col(f"row.`{c}`").alias(r) for c, r in zip(others, rest, strict=True)))
    types = dict(docs.dtypes)
    kept = flat.mapInArrow(by_batch(cut), schema + "".join(f", {r} {types[c]}" for c, r in zip(others, rest, strict=True)))
    back = dict(zip(others, rest, strict=True))
    n_chars = lambda c: F.length("text").cast(types[c]).alias(c) if c == "n_chars" else F.col(back[c]).alias(c)
    return kept.select(*(F.col("text") if c == "text" else n_chars(c) for c in docs.columns))

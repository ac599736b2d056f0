"""Best-two-fit packing: documents in as few sequences as the method can, a plan made for lengths rather than for rows.

Tasks tokenise the documents and cut only those that are longer than a sequence: into full sequences, but for a first piece
with what is left over. What fits where depends on lengths alone, and there are at most ``size`` of them, so the plan is
made on the table of counts by length, whose rows don't grow with the corpus: a bin takes the longest piece that still
fits, again and again; then its smallest piece goes back if two others fill the gap that it leaves more tightly. The same
bin is made as often as the counts allow, so the plan has a row for each different bin and length. At most ``size / l``
times can length ``l`` be the one that ends a run of equal bins, so it has no more than size * (ln(size) + 1) different bins.

Pieces of a length are numbered over all tasks: a task numbers its own while it tokenises, and the counts before it come
from a running sum over tasks. Number and length give the bin and the place in it, so no task holds more than a batch of
pieces and the plan, and a length that a third of all documents have is spread like any other.

Defined results: a null or empty text has only the closing id; repeated rows and ids used twice are packed as they are, a
null id stays null; an empty table gives an empty result; further columns are not looked at. Sequences are numbered
from 0 without gaps.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casegraph.llm.common import materialise, text_or_empty
from casegraph.llm.packing import Ids, default_tokenizer, default_vocabulary

_CUT = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())])
CUT = "doc_id long, piece int, start long, length long, ids_crc32 long, doc_tokens long, task int, nth long"
_PLACED = pa.schema([*list(_CUT)[:6], ("sequence_id", pa.int64()), ("offset", pa.int64())])
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Ids whose pieces are handed over at once; rows of the table of counts that a file of it may get.
BATCH_IDS, COUNTS_A_FILE = 1 << 20, 1 << 18


def cuts(total: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces: one, or full sequences after what is left over."""
    first = total % size or size
    yield 0, min(first, total)
    for start in range(first, total, size):
        yield start, size


def _cut(size: int, end_id: int, vocabulary: Callable[[], str], tokenizer: Callable[[], str]):
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ids_of, seen, rows, held = TaskContext.get().partitionId(), Ids(vocabulary(), tokenizer()), [0] * (size + 1), [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _CUT, strict=True)], schema=_CUT)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = memoryview(ids_of(text) + end if text else end)
                total = len(ids) // 4
                for piece, (start, n) in enumerate(cuts(total, size)):
                    rows.append((doc_id, piece, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), total, task, seen[n]))
                    seen[n] += 1
                held += total
                if held >= BATCH_IDS:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()

    return run


def two_fit(counts: np.ndarray, size: int) -> list[tuple[int, dict[int, int]]]:
    """The bins of the plan as (how many, {length: pieces of it in a bin}); ``counts[l]``: pieces of length l."""
    left, out = counts.astype(np.int64), []
    lengths = np.arange(size + 1)
    while left.any():
        # the lengths that are left and, for the two that may come in, the longest at or below each length
        have = np.maximum.accumulate(np.where(left > 0, lengths, 0))
        bin_, gap, touched = {}, size, {}
        while gap and (best := int(have[gap])):
            while best and left[best] <= bin_.get(best, 0):  # used up within this bin
                best = int(have[best - 1])
            if not best:
                break
            take = min(gap // best, int(left[best]) - bin_.get(best, 0))
            bin_[best] = touched[best] = bin_.get(best, 0) + take
            gap -= take * best
        if gap and sum(bin_.values()) > 1:
            smallest = min(bin_)
            room = gap + smallest
            free = left.copy()
            for n, k in bin_.items():
                free[n] -= k
            ones = np.flatnonzero(free[: room + 1] > 0)
            if len(ones):
                below = np.maximum.accumulate(np.where(free > 0, lengths, 0))
                other = below[room - ones]
                same = (other == ones) & (free[ones] < 2)
                other[same] = below[np.maximum(ones[same] - 1, 0)]
                total = np.where(other > 0, ones + other, 0)
                at = len(total) - 1 - int(np.argmax(total[::-1]))  # of equal sums the pair with the longest piece
                if total[at] > smallest:
                    bin_[smallest] -= 1
                    for n in (int(ones[at]), int(other[at])):
                        bin_[n] = bin_.get(n, 0) + 1
                    touched = {n: max(k, touched.get(n, 0)) for n, k in bin_.items()} | {smallest: touched[smallest]}
        times = min(int(left[n]) // k for n, k in touched.items())
        out.append((times, {n: k for n, k in bin_.items() if k}))
        for n, k in bin_.items():
            left[n] -= times * k
    return out


def plan(counts: np.ndarray, size: int) -> list[np.ndarray]:
    """For each length the rows (first number, pieces in a bin, first sequence, offset of the first of them), in order of numbers."""
    rows, used, sequence = [[] for _ in range(size + 1)], [0] * (size + 1), 0
    for times, bin_ in two_fit(counts, size):
        offset = 0
        for n, k in sorted(bin_.items(), reverse=True):
            rows[n].append((used[n], k, sequence, offset))
            used[n] += times * k
            offset += n * k
        sequence += times
    return [np.asarray(r, dtype=np.int64).reshape(-1, 4) for r in rows]


def _place(plan_: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = b.column("length").to_numpy(), b.column("number").to_numpy()
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                rows = plan_[n]
                row = rows[np.searchsorted(rows[:, 0], number[mine], side="right") - 1]
                copy, place = np.divmod(number[mine] - row[:, 0], row[:, 1])
                sequence[mine], offset[mine] = row[:, 2] + copy, row[:, 3] + place * n
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in list(_PLACED)[:6]), pa.array(sequence), pa.array(offset)], schema=_PLACED)

    return run


def pack(docs: DataFrame, size: int = 2048, end_id: int = 0, vocabulary: Callable[[], str] = default_vocabulary, tokenizer: Callable[[], str] = default_tokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents with their places: (doc_id, piece, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    cut = materialise(slim.mapInArrow(_cut(size, end_id, vocabulary, tokenizer), CUT), "cut")
    # a row a length and task, in files by their number and not one a shuffle partition, as these are more costly to write than the rows
    files = 1 + len(cut.inputFiles()) * size // COUNTS_A_FILE
    per_task = materialise(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")).coalesce(files), "counts")
    counts = np.zeros(size + 1, dtype=np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row a length: size of them at most
        counts[r["length"]] = r["n"]
    before = per_task.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    numbered = cut.join(before, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).alias("number"))
    return numbered.mapInArrow(_place(plan(counts, size)), PLACED)

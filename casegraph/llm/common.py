"""What the corpus operators share: the shared folder, materialised tables, Arrow helpers, byte hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.sources.shared import materialise, scratch, shared_dir

__all__ = ["ASCII_SPACE", "by_batch", "crc32_mod", "materialise", "mix64", "range_hashes", "row_key", "same_key", "scratch", "shared_dir", "slices", "text_bytes", "text_or_empty"]

#: The white space of the contracts: space and the code points 9 to 13.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Columns that identify a document: its id and a hash of its text, so that repeated rows share one outcome and ids used twice don't mix."""
    return [F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("thash")]


def same_key(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """Null-safe equality of the named columns."""
    cond = None
    for n in names:
        c = a[n].eqNullSafe(b[n])
        cond = c if cond is None else cond & c
    return cond


def crc32_mod(id_col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def by_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None and out.num_rows:
                yield out

    return run


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text, empty for null."""
    return [b"" if x is None else x for x in column.cast(pa.binary() if column.type != pa.large_string() else pa.large_binary()).to_pylist()]


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes sum to about ``most``; a larger item gets a range of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words (the finaliser of splitmix64)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_B = 0x9E3779B97F4A7C15 | 1
_B_INV = pow(_B, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = []
        for base in (_B, _B_INV):
            a = np.ones(size, dtype=_U)
            a[1:] = _U(base)
            np.multiply.accumulate(a, out=a)
            out.append(a)
        have = _POWERS[0] = (out[0], out[1])
    return have


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many ranges at once: differences of a prefix sum, shifted back to power 0, then mixed."""
    up, down = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(_BYTE[data] * up[: len(data)], out=prefix[1:])
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(_U))

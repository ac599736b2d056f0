"""Hashed byte n-grams of many texts at once: buckets, sums of a weight table, sparse counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from casegraph.llm.common import slices

#: Bytes of text worked on at once; a longer text is cut in overlapping stretches, so that none of its n-grams is lost.
STRETCH = 1 << 20
_ODD = np.array([0, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], dtype=np.uint32)


def buckets(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket of the n-gram (n <= 4) that begins at each position."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint32)
    v = data[:m].astype(np.uint32)
    for k in range(1, n):
        v = (v << np.uint32(8)) | data[k : k + m]
    v = (v + np.uint32(n)) * _ODD[n]
    v ^= v >> np.uint32(15)
    v *= _ODD[1]
    return v >> np.uint32(32 - bits)


def _stretches(texts: list[bytes], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(bytes, starts, ends, numbers of the texts, positions that count) of runs of texts; a long text comes in stretches that overlap by longest - 1."""
    for a, z in slices([len(t) for t in texts], STRETCH):
        if z == a + 1 and len(texts[a]) > 2 * STRETCH:
            whole = np.frombuffer(texts[a], dtype=np.uint8)
            for at in range(0, len(whole), STRETCH):
                yield whole[at : at + STRETCH + longest - 1], np.array([0]), np.array([min(STRETCH + longest - 1, len(whole) - at)]), np.array([a]), STRETCH
            continue
        ends = np.cumsum([len(t) for t in texts[a:z]])
        yield np.frombuffer(b"".join(texts[a:z]), dtype=np.uint8), np.r_[0, ends[:-1]], ends, np.arange(a, z), 2 * STRETCH


def gram_counts(lengths: np.ndarray, orders: tuple[int, ...]) -> np.ndarray:
    return sum(np.maximum(lengths - n + 1, 0) for n in orders)


def mean_weights(texts: list[bytes], table: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """The mean row of ``table`` (2**bits rows) over each text's n-grams; zeros for a text without any."""
    table = np.vstack([table.reshape(1 << bits, -1), np.zeros((1, table.reshape(1 << bits, -1).shape[1]), table.dtype)])
    out = np.zeros((len(texts), table.shape[1]))
    for data, starts, ends, who, counted in _stretches(texts, max(orders)):
        for n in orders:
            h = buckets(data, n, bits)[:counted]
            for k in range(1, n):  # n-grams that run over a text's end count as nothing
                cut = ends[ends >= k] - k
                h[cut[cut < len(h)]] = 1 << bits
            live = (starts < len(h)) & (ends > starts)
            if live.any():
                at = starts[live]
                for c in range(table.shape[1]):
                    # sums of float64 running totals: one gather a class, no matrix of positions by classes
                    w = table[:, c][h]
                    total = np.add.reduceat(w, at, dtype=np.float64)
                    out[who[live], c] += total
    return out / np.maximum(gram_counts(np.array([len(t) for t in texts]), orders), 1)[:, None]


def sparse_counts(text: bytes, orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams and their shares of all of them."""
    data = np.frombuffer(text, dtype=np.uint8)
    h = np.concatenate([buckets(data, n, bits) for n in orders]) if len(data) else np.zeros(0, np.uint32)
    ids, counts = np.unique(h, return_counts=True)
    return ids.astype(np.int32), (counts / max(1, len(h))).astype(np.float32)

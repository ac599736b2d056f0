"""Language-model scores: the marginal likelihood of a text over all its segmentations into an existing vocabulary's pieces.

A word (with the vocabulary's mark of a word's start) is a lattice whose edges are the pieces that match, and the UTF-8
bytes of characters that no piece has. The forward recursion, in log space, sums the probabilities of all paths; words
and the end of the text are independent, so a text's log probability is the sum over its words and one end.

The vocabulary's own scores give the first piece probabilities: here its scores are ranks, read as a Zipf law.
Expectation-maximisation over the counts of all training words then fits them: each round is one distributed pass of
forward and backward over the table of word counts, and only expected counts of the pieces (the vocabulary's size) are
gathered. The table of word counts itself stays distributed. Words at least as common as a threshold, chosen so that
no more than ``hot_words`` and ``hot_bytes`` reach it, are broadcast with their counts and prices; the others' come by a join, in which
no word is frequent. A word's marginal is computed once, in the table of words, not once a document. Nothing is left out.

Defined results: a null or empty text has one token, the end; repeated rows are learned and scored as rows; without
training rows all counts are 0 and the pieces keep their first probabilities; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.llm.common import by_batch, crc32_mod, materialise, text_bytes, text_or_empty

START = "▁"
END = "</s>"
#: Words in a worker's counter, and bytes of the texts that it counts at a time; longest word for which words of one length are worked on together.
MOST_COUNTED, MOST_READ, GRID = 400_000, 1 << 28, 48


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Pieces:
    """Natural logs of the pieces' probabilities; single bytes and the end are pieces too."""

    log_p: dict[str, float]
    longest: int

    def __post_init__(self):
        self.number = {p: i for i, p in enumerate(self.log_p)}
        self.table = np.array([*self.log_p.values(), -np.inf])

    def ending(self, s: str, j: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """(start, log probability, pieces) of the edges that end at ``j``; bytes stand for a character without a piece."""
        out = []
        for i in range(max(0, j - self.longest), j):
            k = self.number.get(s[i:j])
            if k is not None:
                out.append((i, float(self.table[k]), (k,)))
        if s[j - 1] not in self.number:
            ks = tuple(self.number[b] for b in byte_pieces(s[j - 1]))
            out.append((j - 1, float(self.table[list(ks)].sum()), ks))
        return out

    def one(self, word: str, n: float = 0.0, into: np.ndarray | None = None) -> float:
        """The forward recursion over one word's edges; with ``into`` also the backward one, adding n times the expected counts.

        Edges are made where they are needed and not kept: the forward recursion holds the last ``longest`` values, and for the
        backward one a float a character."""
        s, ring = START + word, self.longest + 1
        width = ring if into is None else len(s) + 1
        alpha = array("d", [0.0]) * width
        for j in range(1, len(s) + 1):
            total = -math.inf
            for i, lp, _ in self.ending(s, j):
                total = log_add(total, alpha[i % width] + lp)
            alpha[j % width] = total
        whole = alpha[len(s) % width]
        if into is not None:
            beta = array("d", [-math.inf]) * ring
            beta[len(s) % ring] = 0.0
            for j in range(len(s), 0, -1):
                after = beta[j % ring]
                beta[j % ring] = -math.inf  # its place is that of j - longest - 1, which the next step reaches
                for i, lp, ks in self.ending(s, j):
                    beta[i % ring] = log_add(beta[i % ring], lp + after)
                    x = n * math.exp(alpha[i] + lp + after - whole)
                    for k in ks:
                        into[k] += x
        return whole

    def many(self, words: list[str], n: np.ndarray | None = None, into: np.ndarray | None = None) -> np.ndarray:
        """``one`` for many words: those of one length share each step of the recursion."""
        out = np.zeros(len(words))
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w) + 1, []).append(k)
        get, none = self.number.get, len(self.log_p)
        for length, group in by_length.items():
            if length > GRID:
                for k in group:
                    out[k] = self.one(words[k], 0.0 if n is None else float(n[k]), into)
                continue
            spans = [(i, j) for j in range(1, length + 1) for i in range(max(0, j - self.longest), j)]
            starts, ends = np.array([i for i, _ in spans]), np.array([j for _, j in spans])
            for at in range(0, len(group), 2048):
                part = group[at : at + 2048]
                ids = np.array([[get(s[i:j], none) for i, j in spans] for s in (START + words[k] for k in part)], dtype=np.int32)
                odd = (ids[:, ends - starts == 1] == none).any(axis=1)  # a character without a piece
                for k in np.asarray(part)[odd].tolist():
                    out[k] = self.one(words[k], 0.0 if n is None else float(n[k]), into)
                ids, rows = ids[~odd], np.asarray(part)[~odd]
                lp = self.table[ids]
                alpha = np.zeros((len(rows), length + 1))
                for j in range(1, length + 1):
                    cols = np.flatnonzero(ends == j)
                    alpha[:, j] = np.logaddexp.reduce(alpha[:, starts[cols]] + lp[:, cols], axis=1)
                out[rows] = alpha[:, -1]
                if into is not None:
                    beta = np.zeros((len(rows), length + 1))
                    for i in range(length - 1, -1, -1):
                        cols = np.flatnonzero(starts == i)
                        beta[:, i] = np.logaddexp.reduce(beta[:, ends[cols]] + lp[:, cols], axis=1)
                    x = np.exp(alpha[:, starts] + lp + beta[:, ends] - alpha[:, -1:]) * n[rows][:, None]
                    into += np.bincount(ids.ravel(), x.ravel(), none + 1)
        return out


def byte_pieces(char: str) -> list[str]:
    return [f"<0x{b:02X}>" for b in char.encode("utf-8", "surrogatepass")]


def log_add(a: float, b: float) -> float:
    if b > a:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def first_pieces(path: str) -> Pieces:
    """The vocabulary with probabilities from its scores: logs where they vary as logs do, else ranks under Zipf's law."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    names = [(p, s) for p, s in names if not (p.startswith("<0x") and p.endswith(">"))]
    ranks = bool(names) and min(s for _, s in names) < -1000
    p = {x: 1 / (2 - s) if ranks else math.exp(s) for x, s in names}
    low = min(p.values(), default=1.0)
    p |= {f"<0x{b:02X}>": low for b in range(256)} | {START: max(low, p.get(START, low)), END: low * 100}
    total = sum(p.values())
    return Pieces({x: math.log(v / total) for x, v in p.items()}, max(map(len, (x for x in p if not x.startswith("<0x"))), default=1))


def tokens(data: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words between the six ASCII white-space bytes."""
    return data.lower().split()


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) of every word of the texts, n in those that aren't ``held_out``; summed in each task before they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        others: set[bytes] = set()
        read = 0

        def out() -> pa.RecordBatch:
            unseen = others.difference(seen)
            b = pa.RecordBatch.from_arrays([pa.array([*seen.keys(), *unseen], pa.binary()), pa.array([*seen.values(), *[0] * len(unseen)], pa.int64())], names=["word", "n"])
            seen.clear()
            others.clear()
            return b

        for b in batches:
            for data, held in zip(text_bytes(b.column("text")), b.column("held_out").to_pylist(), strict=True):
                (others if held else seen).update(tokens(data))
                read += len(data)
                if len(seen) + len(others) > MOST_COUNTED or read > MOST_READ:
                    yield out()
                    read = 0
        if seen or others:
            yield out()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def spelt(words: pa.Array) -> list[str]:
    return [w.decode("utf-8", "surrogateescape") for w in words.to_pylist()]


def refit(counts: DataFrame, ends: int, pieces: Pieces, smooth: float = 0.1) -> Pieces:
    """One round of expectation-maximisation over the table of word counts."""
    shared = counts.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        into = np.zeros(len(p.log_p) + 1)
        for b in batches:
            p.many(spelt(b.column("word")), b.column("n").to_numpy().astype(float), into)
        at = np.flatnonzero(into[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(into[at], pa.float64())], names=["piece", "x"])

    # a row a piece at most, whatever the corpus
    rows = counts.where("n > 0").mapInArrow(run, "piece long, x double").groupBy("piece").agg(F.sum("x").alias("x")).collect()
    x = np.full(len(pieces.log_p), smooth)
    for r in rows:
        x[r["piece"]] += r["x"]
    x[pieces.number[END]] += ends
    return Pieces(dict(zip(pieces.log_p, np.log(x / x.sum()).tolist(), strict=True)), pieces.longest)


def priced(counts: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, n, lp): each word once with its marginal log probability."""
    shared = counts.sparkSession.sparkContext.broadcast(pieces)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(shared.value.many(spelt(b.column("word"))), pa.float64())], names=["word", "n", "lp"])

    return counts.mapInArrow(by_batch(run), "word binary, n long, lp double")


def _score(shared, end: float):
    """Rows of a text's own figures, and its words whose counts and prices aren't at hand."""
    pair = pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, rid = shared.value.get, TaskContext.get().partitionId() << 40
        for b in batches:
            rows = []
            for data in text_bytes(b.column("text")):
                own = Counter(tokens(data))
                score, logs, known, rare = end, 0.0, 0, []
                for w, tf in own.items():
                    hot = get(w)
                    if hot is None:
                        rare.append({"word": w, "tf": tf})
                    else:
                        known += tf
                        logs += tf * hot[0]
                        score += tf * hot[1]
                rows.append((rid, sum(own.values()) + 1, known, logs, score, rare))
                rid += 1
            if rows:
                cols = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pair], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *cols], names=["doc_id", "held_out", "rid", "n_tokens", "known", "logs", "score", "rare"])

    return run


def lm_scores(docs: DataFrame, rounds: int = 2, hot_words: int = 200_000, hot_bytes: int = 1 << 26, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); learned where crc32(doc_id) mod 5 isn't 1."""
    context = docs.sparkSession.sparkContext
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), (crc32_mod(id_col, 5) == 1).alias("held_out"))
    ends = slim.where(~F.col("held_out")).count()
    counts = materialise(count_words(slim.select("text", "held_out")), "word-counts")
    # words by the power of two of their count: at most 64 rows; the hot ones are those of the highest powers that fit
    level = F.floor(F.log2("n")).cast("int")
    levels = sorted(((r["level"], r["words"], r["n"], r["bytes"]) for r in counts.where("n > 0").groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n"), F.sum(F.octet_length("word")).alias("bytes")).collect()), reverse=True)
    total = ends + sum(n for _, _, n, _ in levels)
    distinct = sum(w for _, w, _, _ in levels) + (ends > 0)
    least, room, space = None, hot_words, hot_bytes
    for lv, words, _, size in levels:
        room, space = room - words, space - size
        if min(room, space) < 0:
            break
        least = 1 << lv
    pieces = first_pieces(vocabulary or default_vocabulary())
    for _ in range(rounds if ends else 0):
        pieces = refit(counts, ends, pieces)
    table = materialise(priced(counts, pieces), "word-prices")
    hot = {} if least is None else {bytes(r["word"]): (math.log10(r["n"] + 0.5), r["lp"]) for r in table.where(F.col("n") >= least).collect()}
    own = materialise(slim.mapInArrow(_score(context.broadcast(hot), pieces.log_p[END]), "doc_id long, held_out boolean, rid long, n_tokens long, known long, logs double, score double, rare array<struct<word binary, tf long>>"), "lm-rows")
    rare = own.select("rid", F.explode("rare").alias("r")).select("rid", "r.word", "r.tf")
    met = rare.join(table if least is None else table.where(F.col("n") < least), "word")
    sums = met.groupBy("rid").agg(F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("more_known"), F.sum(F.col("tf") * F.log10(F.col("n") + 0.5)).alias("more_logs"), F.sum(F.col("tf") * F.col("lp")).alias("more_score"))
    joined = own.drop("rare").join(sums, "rid", "left")
    below = math.log10(total + 0.5 * (distinct + 1))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0)) + (1 if ends else 0)).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + F.lit(math.log10(ends + 0.5)) - F.col("n_tokens") * F.lit(below)).alias("base_score"),
        ((F.col("score") + F.coalesce("more_score", F.lit(0.0))) / F.lit(math.log(10))).alias("score"),
    )

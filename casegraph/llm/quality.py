"""Quality classifier by co-training: a text view and a page-metadata view teach each other.

The text view is a logistic regression on the shares of hashed byte n-grams (2 and 3) of the whole text, on how much
its words repeat, and on the shares of capitals, digits, white space and other signs. The metadata view
is one on what can be known without reading the words: source and language (hashed), size, number of lines and
line lengths. Both start from the labelled rows of a
bounded sample. In each round either view labels the rows of a sample without labels (the pool) about which it is
most confident, as many of each class as the labels' proportions say, and the *other* view learns from them.

A part of the labelled sample is kept from all training: it calibrates each view (Platt scaling) and fits the
combination of the calibrated views. Every document is then scored, whole, by both.

``max_labelled`` labelled documents are drawn by a hash of doc_id, twice as many at most. The pool is the documents
whose hash lies below ``pool`` divided by the number of documents, about ``pool`` of them; which they are doesn't depend
on partitions, and repeated rows count once. Sample and pool are turned to n-gram counts where they lie; one task of an
executor fits the model on them, and the driver gets its weights only. Labels are never broadcast beyond the sample.

Defined results: a null or empty text is scored as an empty one; a null source or language is a value of its own;
with labels of one class only, none, or fewer than 8 (or no two classes) among the documents of the sample, there is no
model: every document is kept, with the share of good labels as its probability (0.5 without a label);
several labels of one doc_id count as their rounded mean; of several texts of a labelled doc_id one is learned;
repeated rows get equal scores; an empty table an empty result.
"""

from __future__ import annotations

import operator
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.llm.common import by_batch, slices, text_bytes, text_or_empty
from casegraph.llm.grams import buckets

ORDERS, BITS, REPEATS, SIGNS = (2, 3), 15, 3, 5
WIDTH = (1 << BITS) + REPEATS + SIGNS
#: Metadata features: numbers, then hashed sources and languages.
NUMBERS, SOURCES, LANGUAGES = 4, 64, 16
_CLASS = np.zeros(256, dtype=np.int64)  # 0: small letters and bytes of other letters
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = 4


def content(text: bytes) -> np.ndarray:
    """The text view's features: square roots of n-gram shares, the shares of words that repeat the one before, that repeat any, and of the commonest word, then the shares of kinds of signs."""
    data, out = np.frombuffer(text, dtype=np.uint8), np.zeros(WIDTH, dtype=np.float32)
    grams = sum(np.bincount(buckets(data, n, BITS), minlength=1 << BITS) for n in ORDERS)
    out[: 1 << BITS] = np.sqrt(grams / max(1, int(grams.sum()))) * 10
    if words := text.split():
        counts = Counter(words)
        out[1 << BITS : (1 << BITS) + REPEATS] = [8 * sum(map(operator.eq, words, words[1:])) / len(words), 4 - 4 * len(counts) / len(words), 4 * counts.most_common(1)[0][1] / len(words)]
    share = np.bincount(_CLASS[data], minlength=5) / max(1, len(data))
    out[(1 << BITS) + REPEATS :] = [*(share[1:] * 4), share[1] > 0.3]
    return out


def metadata(texts: list[bytes], sources: list[str | None], langs: list[str | None]) -> np.ndarray:
    """One row a document: layout numbers, then one-hot hashes of source and language."""
    out = np.zeros((len(texts), NUMBERS + SOURCES + LANGUAGES))
    for i, (t, s, lang) in enumerate(zip(texts, sources, langs, strict=True)):
        x = np.frombuffer(t, dtype=np.uint8)
        breaks = np.flatnonzero(x == 10)
        lines = np.diff(np.r_[-1, breaks, len(x)]) - 1
        out[i, :NUMBERS] = [np.log1p(len(x)) / 10, np.log1p(len(lines)) / 5, np.log1p(lines.mean()) / 8, np.log1p(lines.max()) / 10]
        out[i, NUMBERS + zlib.crc32(repr(s).encode()) % SOURCES] = 0.5
        out[i, NUMBERS + SOURCES + zlib.crc32(repr(lang).encode()) % LANGUAGES] = 0.5
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


#: Entries of the text view that are worked on at once, so that temporary arrays stay small.
STRIDE = 1 << 19


@dataclass
class Sparse:
    """Rows of the text view: columns and values one after another, and the bounds of each row's (one more than rows)."""

    cols: np.ndarray
    vals: np.ndarray
    bounds: np.ndarray

    def take(self, at: np.ndarray) -> Sparse:
        pick = np.concatenate([np.arange(self.bounds[i], self.bounds[i + 1], dtype=np.int32) for i in at] or [np.zeros(0, np.int32)])
        return Sparse(self.cols[pick], self.vals[pick], np.r_[0, np.cumsum(np.diff(self.bounds)[at])])

    def parts(self) -> list[tuple[int, int, slice]]:
        """Ranges of rows of about STRIDE entries, with their entries."""
        return [(a, z, slice(int(self.bounds[a]), int(self.bounds[z]))) for a, z in slices(np.diff(self.bounds).tolist(), STRIDE)]

    def dot(self, w: np.ndarray) -> np.ndarray:
        out, w = np.zeros(len(self.bounds) - 1), w.astype(np.float32)
        for a, z, part in self.parts():
            x = w[self.cols[part]]
            x *= self.vals[part]
            total = np.r_[0.0, np.cumsum(x, dtype=np.float64)]
            at = self.bounds[a : z + 1] - self.bounds[a]
            out[a:z] = total[at[1:]] - total[at[:-1]]
        return out

    def back(self, e: np.ndarray) -> np.ndarray:
        """The sum of the rows, each times its ``e``."""
        out = np.zeros(WIDTH)
        for a, z, part in self.parts():
            out += np.bincount(self.cols[part], self.vals[part] * np.repeat(e[a:z].astype(np.float32), np.diff(self.bounds[a : z + 1])), WIDTH)
        return out


def fit_logistic(x: Sparse | np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 80, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adam on the mean weighted log loss."""
    if isinstance(x, Sparse):
        dot, back, width = x.dot, x.back, WIDTH
    else:
        dot, back, width = lambda w: x @ w, lambda e: x.T @ e, x.shape[1]
    w, b, m, v, mb, vb = np.zeros(width), 0.0, np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, steps + 1):
        e = (sigmoid(dot(w) + b) - y) * weight / weight.sum()
        g, gb = back(e) + ridge * w, e.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c, d = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (m / c) / (np.sqrt(v / d) + 1e-8)
        b -= rate * (mb / c) / (np.sqrt(vb / d) + 1e-8)
    return w, b


@dataclass
class Model:
    """Two views with their Platt scaling (slope, intercept), and the weights of their calibrated logits."""

    text: tuple[np.ndarray, float]
    meta: tuple[np.ndarray, float]
    centre: np.ndarray
    spread: np.ndarray
    scaling: dict[str, tuple[float, float]]
    blend: tuple[float, float, float]

    def logits(self, text_dot: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return text_dot + self.text[1], (meta - self.centre) / self.spread @ self.meta[0] + self.meta[1]

    def probabilities(self, text_dot: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of good quality: by text, by metadata, by both."""
        a, b = self.logits(text_dot, meta)
        a, b = a * self.scaling["text"][0] + self.scaling["text"][1], b * self.scaling["meta"][0] + self.scaling["meta"][1]
        return sigmoid(a), sigmoid(b), sigmoid(self.blend[0] * np.clip(a, -12, 12) + self.blend[1] * np.clip(b, -12, 12) + self.blend[2])


def co_train(text: Sparse, meta: np.ndarray, y: np.ndarray, labelled: int, rounds: int = 4, confident: float = 0.98, give: int = 400, trust: float = 0.5) -> Model:
    """Rows before ``labelled`` have the labels ``y``; the rest is the pool. Every fourth labelled row only calibrates."""
    apart = np.arange(3, labelled, 4)
    seed = np.setdiff1d(np.arange(labelled), apart)
    pool = np.arange(labelled, len(meta))
    centre, spread = meta[seed].mean(axis=0), meta[seed].std(axis=0) + 0.05
    scaled = (meta - centre) / spread
    learned = {v: {"at": seed, "y": y[seed], "w": np.ones(len(seed))} for v in ("text", "meta")}
    share_low = float(1 - y[seed].mean())

    def fit(v: str) -> tuple[np.ndarray, float]:
        x = learned[v]
        return fit_logistic(text.take(x["at"]), x["y"], x["w"], 1e-5, steps=60) if v == "text" else fit_logistic(scaled[x["at"]], x["y"], x["w"], 1e-5, steps=300, rate=0.1)

    def logit(v: str, model: tuple[np.ndarray, float], at: np.ndarray) -> np.ndarray:
        return (text.take(at).dot(model[0]) if v == "text" else scaled[at] @ model[0]) + model[1]

    models = {v: fit(v) for v in learned}
    for _ in range(rounds if len(pool) else 0):
        told = {}
        for v, other in (("text", "meta"), ("meta", "text")):
            free = np.setdiff1d(pool, learned[other]["at"])
            p = sigmoid(logit(v, models[v], free))
            order = np.argsort(p, kind="stable")
            low = order[: max(1, round(give * share_low))]
            high = order[::-1][: max(1, give - len(low))]
            told[other] = free[low[p[low] < 1 - confident]], free[high[p[high] > confident]]
        for v, (low, high) in told.items():
            x = learned[v]
            learned[v] = {"at": np.r_[x["at"], low, high], "y": np.r_[x["y"], np.zeros(len(low)), np.ones(len(high))], "w": np.r_[x["w"], np.full(len(low) + len(high), trust)]}
        models = {v: fit(v) for v in learned}
    out = Model(models["text"], models["meta"], centre, spread, {}, (0.5, 0.5, 0.0))
    z = {v: logit(v, models[v], apart) for v in models}
    for v in z:
        # scaled logits keep the fit well-conditioned; the scale goes into the slope
        size = float(np.abs(z[v]).mean()) or 1.0
        w, b = fit_logistic((z[v] / size)[:, None], y[apart], np.ones(len(apart)), 1e-3, steps=300, rate=0.05)
        out.scaling[v] = (float(w[0]) / size, b)
    both = np.stack([np.clip(z[v] * out.scaling[v][0] + out.scaling[v][1], -12, 12) for v in ("text", "meta")], axis=1)
    w, b = fit_logistic(both / 4, y[apart], np.ones(len(apart)), 1e-3, steps=300, rate=0.05)
    out.blend = (float(w[0]) / 4, float(w[1]) / 4, b)
    return out


def _features(b: pa.RecordBatch) -> pa.RecordBatch:
    texts = text_bytes(b.column("text"))
    meta = metadata(texts, b.column("source").to_pylist(), b.column("lang").to_pylist())
    cols, vals = [], []
    for t in texts:
        x = content(t)
        at = np.flatnonzero(x).astype(np.int32)
        cols.append(at.tobytes())
        vals.append(x[at].tobytes())
    return pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "thash", "draw", "y")), pa.array(cols, pa.binary()), pa.array(vals, pa.binary()), pa.array([m.tobytes() for m in meta], pa.binary())], names=["doc_id", "thash", "draw", "y", "cols", "vals", "meta"])


def _flat(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and values of a column of packed arrays, without a copy for each row."""
    whole = column.combine_chunks()
    whole = whole if isinstance(whole, pa.Array) else whole.chunk(0)
    offsets = np.frombuffer(whole.buffers()[1], dtype=np.int32)[whole.offset : whole.offset + len(whole) + 1]
    size = np.dtype(kind).itemsize
    return (offsets - offsets[0]).astype(np.int64) // size, np.frombuffer(whole.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].view(kind)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the model of all rows, pickled; None where there are too few labels."""
    model, parts = None, [b for b in batches if b.num_rows]
    if parts:
        rows = pa.Table.from_batches(parts)
        order = sorted(zip(pc.is_null(rows["y"]).to_pylist(), rows["draw"].to_pylist(), ((x is not None, x or 0) for x in rows["doc_id"].to_pylist()), rows["thash"].to_pylist(), range(rows.num_rows), strict=True))
        rows = rows.take(pa.array([x[-1] for x in order], pa.int64())).combine_chunks()
        target = np.array([np.nan if v is None else v for v in rows["y"].to_pylist()])
        n = int((~np.isnan(target)).sum())
        if n >= 8 and len(set(target[np.setdiff1d(np.arange(n), np.arange(3, n, 4))])) == 2:
            bounds, cols = _flat(rows["cols"], np.int32)
            model = co_train(Sparse(cols, _flat(rows["vals"], np.float32)[1], bounds), _flat(rows["meta"], np.float64)[1].reshape(rows.num_rows, -1), target, n)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 3000, pool: int = 3000) -> Model | float:
    """The co-trained model from a bounded labelled sample and a pool, or the share of good labels where they give no model."""
    draw = lambda *c: F.pmod(F.xxhash64(F.lit(5), *c), F.lit(1 << 30)) / float(1 << 30)
    y = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(F.round(F.avg("quality")).cast("double").alias("y"))
    stats = y.agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"), F.avg("y").alias("share")).first()
    if not stats["n"] or stats["lo"] == stats["hi"]:
        return 0.5 if not stats["n"] else float(stats["share"])
    some = y.where(draw("label_id") < max_labelled / stats["n"]).orderBy(draw("label_id"), "label_id").limit(2 * max_labelled)
    slim = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("thash"), F.struct("source", "lang", "text").alias("d"))
    known = slim.join(F.broadcast(some), slim["doc_id"] == some["label_id"]).groupBy("doc_id", "y").agg(F.min(F.struct("thash", "d")).alias("x"))
    known = known.select("doc_id", "x.thash", "x.d", draw("doc_id").alias("draw"), "y")
    drawn = slim.where(draw("doc_id", "thash") < pool / max(1, docs.count())).groupBy("doc_id", "thash").agg(F.min("d").alias("d"))
    unknown = drawn.join(y, drawn["doc_id"] == y["label_id"], "left_anti").select("doc_id", "thash", "d", draw("doc_id", "thash").alias("draw"), F.lit(None).cast("double").alias("y"))
    rows = known.unionByName(unknown).select("doc_id", "thash", "draw", "y", "d.text", "d.source", "d.lang")
    features = rows.mapInArrow(by_batch(_features), "doc_id long, thash long, draw double, y double, cols binary, vals binary, meta binary")
    model = pickle.loads(features.repartition(1).mapInArrow(_train, "model binary").first()[0])  # bounded by max_labelled and pool
    return float(stats["share"]) if model is None else model


def score(docs: DataFrame, model: Model | float, carry: bool = False) -> DataFrame:
    """(doc_id, text_prob, metadata_prob, quality_prob) of each row; with ``carry`` also the whole row, as a struct."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two weight vectors of fixed length

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m, texts = shared.value, text_bytes(b.column("text"))
        if isinstance(m, float):
            probs = [np.full(len(texts), m)] * 3
        else:
            dots = np.array([float(m.text[0] @ content(t)) for t in texts])
            probs = m.probabilities(dots, metadata(texts, b.column("source").to_pylist(), b.column("lang").to_pylist()))
        rest = [b.column("row")] if carry else []
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(p, pa.float64()) for p in probs), *rest], names=["doc_id", "text_prob", "metadata_prob", "quality_prob", *["row"] * carry])

    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), *[row] * carry)
    schema = "doc_id long, text_prob double, metadata_prob double, quality_prob double"
    return slim.mapInArrow(by_batch(run), schema + (f", row {slim.schema['row'].dataType.simpleString()}" if carry else ""))


def kept(model: Model | float, keep_at: float):
    return F.lit(True) if isinstance(model, float) else F.col("quality_prob") >= keep_at


def classify(docs: DataFrame, labels: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """Scores of every document and ``keep``: whether its probability of good quality is at least ``keep_at``; all without a model."""
    model = fit(docs.select("doc_id", "text", "source", "lang"), labels.select("doc_id", "quality"))
    return score(docs, model).withColumn("keep", kept(model, keep_at))


def keep_good(docs: DataFrame, labels: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """The documents that the classifier doesn't reject, with their own columns."""
    model = fit(docs.select("doc_id", "text", "source", "lang"), labels.select("doc_id", "quality"))
    if isinstance(model, float):
        return docs
    return score(docs, model, carry=True).where(kept(model, keep_at)).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))

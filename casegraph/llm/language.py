"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

Subwords are byte n-grams (1 to 4) of the lower-cased text between spaces, hashed in 2**16 buckets. A text is the mean
of its subwords' embeddings; a linear softmax over that mean gives the languages' probabilities. Both are trained
together on a bounded sample: about ``per_language`` documents of each language in the training part and no more than
twice as many, chosen by a hash of id and text among the texts of up to ``max_bytes`` bytes, repeated rows once; each is learned as a whole and line by line, so that short texts are known too. A slice of
the sample, kept apart, fits the softmax temperature and the score below which a prediction is rejected.

For prediction the embeddings times the softmax weights are one small table, which is all that executors get; each
text is read whole and is the only input.

Defined results: ``und`` and score 0 for a null text and one without a letter; a model that knows one language
gives it always; without training rows all is ``und``; repeated rows get equal results; an empty table an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casegraph.llm.common import by_batch, crc32_mod
from casegraph.llm.grams import mean_weights, sparse_counts

ORDERS, BITS, DIMENSIONS = (1, 2, 3, 4), 16, 16
UNKNOWN = "und"


def prepare(text: str) -> bytes:
    """Lower case, one space between words and at both ends."""
    return (" " + " ".join(text.lower().split()) + " ").encode()


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, texts: list[bytes]) -> np.ndarray:
        return mean_weights(texts, self.table, ORDERS, BITS) + self.bias

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], epochs: int = 4, rate: float = 0.5, batch: int = 64, seed: int = 7) -> Model:
    """Fit on whole texts and their lines; every fifth text is kept for the temperature and the rejection."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    y_of = {x: i for i, x in enumerate(languages)}
    known, apart, held = [], [], []
    for i, (t, lang) in enumerate(zip(texts, labels, strict=True)):
        if i % 5 == 4:
            apart.append((t, y_of[lang]))
            continue
        for part in dict.fromkeys([t, *t.split("\n")]):
            if part.strip():
                held.append(y_of[lang])
                known.append(sparse_counts(prepare(part), ORDERS, BITS))
    y = np.array(held, dtype=np.int64)
    table = np.concatenate([rng.normal(0, 0.1, (1 << BITS, DIMENSIONS))]).astype(np.float32)
    weights, bias = np.zeros((DIMENSIONS, len(languages)), dtype=np.float32), np.zeros(len(languages), dtype=np.float32)
    weights += rng.normal(0, 0.1, weights.shape).astype(np.float32)
    steps, done = max(1, epochs * -(-len(known) // batch)), 0
    for _ in range(epochs):
        order = rng.permutation(len(known))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            ids = np.concatenate([known[i][0] for i in pick])
            share = np.concatenate([known[i][1] for i in pick])
            owner = np.repeat(np.arange(len(pick)), [len(known[i][0]) for i in pick])
            starts = np.r_[0, np.flatnonzero(np.diff(owner)) + 1]
            mean = np.add.reduceat(table[ids] * share[:, None], starts)
            p = softmax(mean @ weights + bias)
            p[np.arange(len(pick)), y[pick]] -= 1
            step = rate * (1 - done / steps)
            back = p @ weights.T
            # a subword's gradient is divided by the batch only for the shared softmax: embeddings are rarely touched
            np.add.at(table, ids, (-step * 20 * share[:, None] * back[owner]).astype(np.float32))
            weights -= step * (mean.T @ p).astype(np.float32) / len(pick) * 5
            bias -= (step * p.mean(axis=0)).astype(np.float32)
            done += 1
    model = Model(languages, (table @ weights).astype(np.float32), bias)
    if apart:
        pieces = [(prepare(part), k) for t, k in apart for part in {t, *t.split("\n")} if part.strip()]
        z, truth = model.logits([p for p, _ in pieces]), np.array([k for _, k in pieces])
        loss = lambda t: -np.log(softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.02, 8, 60), key=loss))
        p = softmax(z / model.temperature)
        top, right = p.max(axis=1), p.argmax(axis=1) == truth
        order = np.argsort(-top)
        good = np.flatnonzero(np.cumsum(right[order]) >= 0.99 * np.arange(1, len(order) + 1))
        model.reject_below = float(top[order[good[-1]]]) if len(good) else 1.0
    return model


def sample(docs: DataFrame, per_language: int, id_col: str = "doc_id", max_bytes: int = 1 << 20) -> tuple[list[str], list[str]]:
    """About ``per_language`` texts of each language and no more than twice as many, by a hash of id and text."""
    docs = docs.where(F.octet_length("text") <= max_bytes)
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    if not counts:
        return [], []
    # the share of a language's ids that is taken: all, or as many as give the number asked for on average
    limit = F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))))
    draw = F.pmod(F.xxhash64(F.lit(11), F.col(id_col).cast("string"), "text"), F.lit(1 << 30)) / float(1 << 30)
    drawn = docs.where(draw < limit[F.col("lang")]).select(draw.alias("draw"), "lang", "text").distinct()  # repeated rows share a draw
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    rows = drawn.withColumn("nth", nth).where(F.col("nth") <= 2 * per_language).collect()
    rows.sort(key=lambda r: (r["draw"], r["lang"], r["text"]))
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**16 rows of a float a language

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m, texts = shared.value, b.column("text").to_pylist()
        pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and has_letter(t)] if m else []
        if at:
            p = m.probabilities([prepare(texts[i]) for i in at])
            for i, k, s in zip(at, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                pred[i], score[i] = m.languages[k], s
        rejected = [s < (m.reject_below if m else 1.0) for s in score]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred), pa.array(score, pa.float64()), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(by_batch(run), "doc_id long, lang_pred string, score double, rejected boolean")


def fit(docs: DataFrame, per_language: int = 400, id_col: str = "doc_id", max_bytes: int = 1 << 20) -> Model | None:
    """A model from rows with a text and a language: a bounded sample of ``per_language`` documents of each."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    texts, labels = sample(usable, per_language, id_col, max_bytes)
    return train(texts, labels) if texts else None


def held_out_predictions(docs: DataFrame, per_language: int = 400) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected): learned where crc32(doc_id) mod 4 isn't 2."""
    held = crc32_mod("doc_id", 4) == 2
    model = fit(docs.where(~held).select("doc_id", "text", "lang"), per_language)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")

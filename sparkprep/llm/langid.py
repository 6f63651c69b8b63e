"""Language ID by multinomial logistic regression on TF-IDF of character n-grams.

A text's features are its lower-cased n-grams of ``ORDERS`` code points, hashed to ``FEATURES`` slots, with
weight tf * idf, where tf is the share among the text's n-grams. The model is trained by follow-the-regularised-leader with
L1 and L2 penalties (which leaves most weights at zero), and a temperature is then fitted on labelled rows that training
didn't see, so that scores are probabilities.

The training rows are a documented, bounded sample: at most ``train_rows`` labelled texts, in equal shares of the languages, of
each language those with the least 64-bit hashes. A text counts once however often it occurs, so copies can't fill the
sample, and neither partitions nor the order of rows matter. Where the rows lie, texts become counts of slots, at most
FEATURES for each; one task trains on those, and the driver gets the weights alone. Prediction is one pass without a
shuffle; the weights, FEATURES x languages, are broadcast. Inputs of a prediction are the text alone.

Text that is null or has no letter (classes L*) is ``und`` with score 0. Very long texts are read whole, ``CHUNK`` n-grams at a
time. Without labelled rows every text is ``und``. Repeated rows and ties are predicted alike (the first language by name
wins). Empty tables give empty results; other columns pass.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textnum import release, slices

ORDERS, FEATURES, SCALE = (1, 2, 3), 1 << 16, 64.0
CHUNK = 1 << 18  # n-grams of each order at a time
LETTER = regex.compile(r"\p{L}")
UND = "und"
_ODD = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def grams(text: str) -> Iterator[np.ndarray]:
    """The slots of all n-grams of the lower-cased text, a space before and after it."""
    padded = f" {text.lower()} "
    for at in range(0, len(padded), CHUNK):
        p = np.frombuffer(padded[at : at + CHUNK + max(ORDERS) - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        for n in ORDERS:
            m = min(CHUNK, len(p) - n + 1)  # those that start in this chunk
            if m <= 0:
                continue
            h = np.full(m, n, np.uint32)
            for i in range(n):
                h = (h ^ p[i : m + i]) * _ODD[i]
                h ^= h >> np.uint32(15)
            yield h % np.uint32(FEATURES)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(slots, how many n-grams of the text are in each)."""
    total = np.zeros(FEATURES, np.int64)
    for g in grams(text):
        total += np.bincount(g, minlength=FEATURES)
    slot = np.flatnonzero(total)
    return slot, total[slot]


@dataclass
class Model:
    """Weights include the idf."""

    langs: list[str]
    weights: np.ndarray  # FEATURES x languages, float32
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for g in grams(text):
            total += self.weights.take(g, axis=0).sum(axis=0, dtype=np.float64)
            n += len(g)
        return total * (SCALE / n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not LETTER.search(text):
            return UND, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])

    def to_json(self) -> str:
        return json.dumps({"langs": self.langs, "temperature": self.temperature, "bias": self.bias.tolist(), "weights": {str(i): self.weights[i].tolist() for i in np.flatnonzero(self.weights.any(axis=1))}})

    @classmethod
    def from_json(cls, text: str) -> Model:
        d = json.loads(text)
        weights = np.zeros((FEATURES, len(d["langs"])), np.float32)
        for i, w in d["weights"].items():
            weights[int(i)] = w
        return cls(d["langs"], weights, np.array(d["bias"]), d["temperature"])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def train(texts: list[str], labels: list[str], **settings) -> Model:
    return train_counts([counts(t) for t in texts], labels, **settings)


def train_counts(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, epochs: int = 3, hold: int = 5) -> Model:
    """rows: the ``counts`` of each text. Every ``hold``-th one is kept for the temperature."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((FEATURES, 0), np.float32), np.zeros(0), 1.0)
    seen = [i for i in range(len(rows)) if i % hold] or list(range(len(rows)))
    df = np.bincount(np.concatenate([rows[i][0] for i in seen]), minlength=FEATURES)
    idf = np.log((1 + len(seen)) / (1 + df)) + 1
    z, n2 = np.zeros((FEATURES + 1, len(langs))), np.zeros((FEATURES + 1, len(langs)))
    wanted = np.array([langs.index(x) for x in labels])

    def weights(z, n2):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n2)) / alpha + l2))

    def inputs(i):
        slot, n = rows[i]
        return np.append(slot, FEATURES), np.append(n / n.sum() * idf[slot] * SCALE, 1.0)

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(seen):
            at, x = inputs(i)
            w = weights(z[at], n2[at])
            p = softmax(x @ w)
            p[wanted[i]] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n2[at] + g * g) - np.sqrt(n2[at])) / alpha
            z[at] += g - sigma * w
            n2[at] += g * g
    w = weights(z, n2)
    model = Model(langs, (w[:-1] * idf[:, None]).astype(np.float32), w[-1], 1.0)
    held = [i for i in range(len(rows)) if not i % hold]
    if held:
        logits = np.array([x @ w[at] for at, x in map(inputs, held)])

        def loss(t: float) -> float:
            s = logits / t
            s = s - s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(held)), wanted[held]]).mean())

        model.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
    return model


def held_out(doc_id: Column) -> Column:
    """A third of the ids, which training must not see."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [counts(t) for t in batch.column("text").to_pylist()]
        slot, n = (pa.array([x[k].astype("<u4").tobytes() for x in found], pa.binary()) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("draw"), slot, n], ["lang", "draw", "slots", "n"])


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the model. The rows come in the order of their draws."""
    rows, labels = [], []
    for batch in batches:
        for slot, n in zip(batch.column("slots").to_pylist(), batch.column("n").to_pylist(), strict=True):
            rows.append((np.frombuffer(slot, "<u4").astype(np.uint16 if FEATURES <= 1 << 16 else np.uint32), np.frombuffer(n, "<u4")))
        labels += batch.column("lang").to_pylist()
    yield pa.RecordBatch.from_arrays([pa.array([train_counts(rows, labels).to_json()])], ["model"])
    release()


def fit(labelled: DataFrame, train_rows: int = 6000) -> Model:
    """``labelled`` has text and lang; at most ``train_rows`` different texts of it are used, and one of each language."""
    rows = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang", F.xxhash64("text").alias("draw"))
    known = rows.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).orderBy(F.desc("n"), "lang").limit(train_rows).collect()
    if not known:
        return train([], [])
    each = max(1, train_rows // len(known))
    near = F.lit(False)
    for r in known:  # twice as many as are wanted, as the counts are estimates
        share = min(1.0, max(2 * each, 100) / r["n"])
        near = near | ((F.col("lang") == r["lang"]) & (F.col("draw") <= min(int(share * 2**64) - 2**63, 2**63 - 1)))
    drawn = rows.filter(near).groupBy("lang", "draw").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))  # few rows by now
    drawn = drawn.withColumn("place", place).filter(F.col("place") <= each).select("text", "lang", "draw")
    found = drawn.mapInArrow(_counted, "lang string, draw long, slots binary, n binary")
    model = found.repartition(1).sortWithinPartitions("draw", "lang").mapInArrow(_trained, "model string").first()["model"]
    return Model.from_json(model)


def predict(docs: DataFrame, model: Model, column: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the columns ``lang`` and ``score``, which replace any of their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(lang, score)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            said = [shared.value.predict(t) for t in batch.column(column).to_pylist()]
            new = [pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*names, lang, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]))

"""Quality classifier: naive Bayes scaled n-gram indicators under a hinge-loss linear model."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, mix64, table
from .linear import fit_hinge, folds_of, platt

#: Most labelled rows that the model is fitted on, hashed feature space, smoothing of the counts.
SAMPLE_ROWS, WIDTH, ALPHA = 6_000, 1 << 18, 1.0
THRESHOLD = 0.3


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled documents: those of least doc_id hash, then of least text hash.

    Rows with a null id or label are not used; of several labels of an id the greatest counts;
    rows equal in id and text are one. The ids' number is bounded, so they are broadcast to the
    documents, which do not move; rows of one id may be many, so the rows found are bounded again.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    n = own.count()
    picked = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(min(1.0, rows / max(n, 1)) * (1 << 40)))
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id", "text"])
    return found.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id", F.xxhash64("text"), "text").limit(rows)


class Grams:
    """Distinct hashed n-gram indices of a text: words, word pairs, and one to three token shapes.

    A shape is a token with its letters as a or A, its digits as 0 and repeats dropped; a token
    that repeats the one before has a shape of its own.
    """

    MEMO_LIMIT = 300_000

    def __init__(self, width: int = WIDTH):
        import xxhash

        self.hash, self.mask, self.memo = xxhash.xxh3_64_intdigest, np.uint64(width - 1), {}
        self.shapes = [(re.compile(p).sub, to) for p, to in (("[^\\W\\d_]", lambda m: "A" if m[0].isupper() else "a"), (r"\d", "0"), (r"(.)\1+", r"\1"))]

    def _learn(self, token: str) -> tuple:
        shape = token
        for sub, to in self.shapes:
            shape = sub(to, shape)
        out = self.memo[token] = (self.hash(token.lower()), self.hash(shape, 7))
        return out

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = (text or "").split()
        if len(self.memo) > self.MEMO_LIMIT:
            self.memo.clear()
        if not tokens:
            return np.zeros(0, np.int64)
        memo, learn = self.memo, self._learn
        both = np.array([memo.get(t) or learn(t) for t in tokens], np.uint64)
        word, shape = both[:, 0], both[:, 1].copy()
        shape[1:][word[1:] == word[:-1]] = np.uint64(0xABCDEF)
        pair = lambda a, b, k: mix64(a * np.uint64(k) + b)
        shape2 = pair(shape[:-1], shape[1:], 5)
        grams = [mix64(word), pair(word[:-1], word[1:], 3), mix64(shape + np.uint64(1)), shape2, pair(shape2[:-1], shape[2:], 7)]
        return np.unique((np.concatenate(grams) & self.mask).astype(np.int64))


def fit(sample: DataFrame, width: int = WIDTH) -> dict:
    """Model of a labelled sample: one weight per hashed feature, and the scaling to probabilities.

    Rows are taken in order of a hash of doc_id, then doc_id and text, so ties and repeats change nothing; a
    null text is empty. Without rows of both classes the model is constant.
    """

    def run(batches):
        grams = Grams(width)
        for batch in batches:
            rows = [grams(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r.astype(np.int32) for r in rows], pa.list_(pa.int32())), batch.column(1)], ["grams", "label"])

    found = sample.select("text", "label").orderBy(F.xxhash64("doc_id"), "doc_id", "text").mapInArrow(run, "grams array<int>, label int").toArrow()
    labels = np.asarray(found.column("label").to_pylist(), int)
    rows = [np.asarray(x.values if hasattr(x, "values") else x, np.int64) for x in found.column("grams")]
    constant = {"weights": np.zeros(width, np.float32), "bias": 0.0, "scale": (0.0, float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))) if len(labels) else 0.0)}
    if len(set(labels.tolist())) < 2:
        return constant

    def train(at):
        counts = np.full((2, width), ALPHA)
        for i in at:
            counts[labels[i], rows[i]] += 1
        ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        values = [ratio[rows[i]] / max(1.0, len(rows[i])) ** 0.5 for i in at]
        balance = len(at) / (2.0 * np.bincount(labels[at], minlength=2).clip(1))
        w, b = fit_hinge([rows[i] for i in at], values, labels[at], width, balance[labels[at]])
        return w * ratio, b

    margin = lambda w, b, r: w[r].sum() / max(1.0, len(r)) ** 0.5 + b
    fold, margins = folds_of(len(rows)), np.zeros(len(rows))
    for k in range(3):
        at, rest = np.nonzero(fold != k)[0], np.nonzero(fold == k)[0]
        if len(set(labels[at].tolist())) < 2:
            return constant
        w, b = train(at)
        margins[rest] = [margin(w, b, rows[i]) for i in rest]
    w, b = train(np.arange(len(rows)))
    return {"weights": w.astype(np.float32), "bias": float(b), "scale": platt(margins, labels)}


def score(docs: DataFrame, model: dict, keys: list, text_col: str = "text") -> DataFrame:
    """(*keys, score) of each whole text; a null text scores as an empty one."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(*keys, F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in picked.drop("_text").dtypes) + ", score double"

    def run(batches):
        m = shipped.value
        w, b, (scale, shift) = m["weights"], m["bias"], m["scale"]
        grams = Grams(len(w))
        for batch in batches:
            out = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                r = grams(text)
                z = scale * (float(w[r].sum()) / max(1.0, len(r)) ** 0.5 + b) + shift
                out.append(1.0 / (1.0 + np.exp(-min(30.0, max(-30.0, z)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return picked.mapInArrow(run, schema)


def op3_quality(spark, sf_dir):
    """Quality of each document by a model of labelled rows that are not held out; null and empty texts score alike."""
    docs = table(spark, sf_dir, "documents")
    held_out = lambda c: F.coalesce(crc_mod(c, 5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    model = fit(labelled_sample(docs, labels, "quality", SAMPLE_ROWS))
    scored = score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

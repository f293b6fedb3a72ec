"""Toxicity: a gap-weighted subsequence kernel, Nystroem landmarks and a hinge-loss model of sentences.

The kernel compares character subsequences of length three, each weighted by how far it is spread,
so an insult with gaps or inserted characters stays close to the plain one.  A sentence is the bag
of its units (words, and runs of single characters read as one); its feature for a landmark is the
greatest kernel value of any unit, so one insult in a long sentence is not diluted.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, table
from .linear import fit_hinge, folds_of, isotonic
from .quality import labelled_sample

SAMPLE_ROWS, LANDMARKS, NEUTRAL = 6_000, 56, 8
#: Longest unit that is compared whole, decay of the kernel per character spanned, most characters a
#: subsequence may span, least kernel value kept.
UNIT_CHARS, DECAY, SPREAD, FLOOR = 20, 0.5, 6, 0.5
#: Stands before a unit, so that its beginning counts.
BEGIN = "^"
THRESHOLD = 0.7
INNER = re.compile(r"[\W_]+").sub
SENTENCE_END = (".", "!", "?")


def unit_of(token: str) -> str:
    """BEGIN and a token in lower case, without what is not a letter or digit."""
    token = token.lower()
    return BEGIN + (token if token.isalpha() else INNER("", token))


class SubsequenceKernel:
    """Normalised kernel values of many strings against fixed landmarks.

    k(s, t) sums, over pairs of equal three-character subsequences of s and t, the decay to the
    power of the characters that both span; strings of one or two characters use those lengths.
    """

    def __init__(self, landmarks: list):
        self.landmarks = landmarks
        self.at: dict = {}
        self.alphabet = {c: i for i, c in enumerate(sorted({c for x in landmarks for c in x}), 1)}
        self.base = len(self.alphabet) + 1
        self.table = np.zeros((self.base**3, len(landmarks)), np.float32)
        for j, x in enumerate(landmarks):
            f = self.features(x)  # a landmark has no character without a code
            size = sum(v * v for v in f.values()) ** 0.5
            for key, v in f.items():
                self.table[key, j] = v / size
        self.most = self.table.max(axis=1)

    def features(self, text: str) -> dict:
        out: dict = {}
        text = text[:UNIT_CHARS]
        for at in self.places(len(text))[0].tolist():
            key = 0
            for i in at:
                key = key * self.base + self.alphabet.get(text[i], 0)
            out[key] = out.get(key, 0.0) + DECAY ** (at[-1] - at[0])
        return out

    def places(self, n: int):
        if n not in self.at:
            at = np.array([c for c in combinations(range(n), min(3, n)) if c[-1] - c[0] <= SPREAD], np.int64)
            self.at[n] = (at, DECAY ** (at[:, -1] - at[:, 0]))
        return self.at[n]

    def __call__(self, units: list, least: float = 0.0) -> np.ndarray:
        """len(units) x len(landmarks); rows with no value of at least `least` may be zero. Units longer than UNIT_CHARS take the greatest of their overlapping parts."""
        out = np.zeros((len(units), len(self.landmarks)), np.float32)
        by: dict = {}
        for i, u in enumerate(units):
            if len(u) <= UNIT_CHARS:
                by.setdefault(len(u), []).append((i, u))
            else:
                for k in range(0, len(u) - UNIT_CHARS // 2, UNIT_CHARS // 2):
                    by.setdefault(len(u[k : k + UNIT_CHARS]), []).append((i, u[k : k + UNIT_CHARS]))
        for n, group in by.items():
            if n == 0:
                continue
            at, weight = self.places(n)
            step = max(1, 300_000 // len(at))
            for first in range(0, len(group), step):
                part = group[first : first + step]
                codes = np.array([[self.alphabet.get(c, 0) for c in u] for _, u in part], np.int32)
                keys = np.zeros((len(part), len(at)), np.int32)
                for p in range(at.shape[1]):
                    keys = keys * self.base + codes[:, at[:, p]]
                # A bound over all landmarks, with the least norm a unit can have, leaves few units to compare with each.
                near = np.nonzero(self.most[keys] @ weight >= least * float(weight @ weight) ** 0.5)[0]
                if not len(near):
                    continue
                # Equal subsequences of a unit add up before squaring: its own norm, over its characters themselves.
                points = np.array([[ord(c) for c in part[i][1]] for i in near.tolist()], np.int64)
                own = np.zeros((len(near), len(at)), np.int64)
                for p in range(at.shape[1]):
                    own = own << 21 | points[:, at[:, p]]
                order = np.argsort(own, axis=1)
                k, w = np.take_along_axis(own, order, 1), weight[order]
                new = np.ones(k.shape, bool)
                new[:, 1:] = k[:, 1:] != k[:, :-1]
                sums = np.add.reduceat(w.ravel(), np.nonzero(new.ravel())[0])
                norm = np.zeros(len(part))
                norm[near] = np.bincount(np.nonzero(new)[0], sums * sums, len(near)) ** 0.5
                for i in range(0, len(near), 256):
                    some = near[i : i + 256]
                    got = np.einsum("ucl,c->ul", self.table[keys[some]], weight.astype(np.float32), optimize=True) / norm[some, None]
                    np.maximum.at(out, np.array([part[x][0] for x in some]), got.astype(np.float32))
        return out


class Sentences:
    """Features of a text's sentences: only units near a landmark count, and they are remembered."""

    MEMO_LIMIT = 300_000

    def __init__(self, kernel: SubsequenceKernel):
        self.kernel, self.memo, self.near = kernel, {}, []

    def learn(self, tokens) -> None:
        """Remember for each token its row among the near units, or -1; -2 marks a single character."""
        if len(self.memo) + len(tokens) > self.MEMO_LIMIT:
            self.memo.clear()
            self.near.clear()
        tokens = list(tokens)
        units = [unit_of(t) for t in tokens]
        for i in range(0, len(units), 20_000):
            values = self.kernel(units[i : i + 20_000], FLOOR)
            close = values.max(axis=1, initial=0.0) >= FLOOR
            for token, unit, v, c in zip(tokens[i : i + 20_000], units[i : i + 20_000], values, close.tolist()):
                if c and len(unit) > 3:
                    self.memo[token] = len(self.near)
                    self.near.append(np.where(v >= FLOOR, v, 0))
                else:
                    self.memo[token] = -2 if len(unit) == 2 else -1

    def spelled(self, tokens: list, at: np.ndarray):
        """(place, joined) of each run of three or more single characters."""
        single = np.concatenate([[False], at == -2, [False]]).astype(np.int8)
        edges = np.diff(single)
        for i, j in zip(np.nonzero(edges == 1)[0].tolist(), np.nonzero(edges == -1)[0].tolist()):
            if j - i >= 3:
                yield i, BEGIN + "".join(unit_of(t)[1:] for t in tokens[i:j])

    def __call__(self, tokens: list) -> list:
        """The feature vectors of the sentences that have a unit near a landmark."""
        memo = self.memo
        at = np.fromiter(map(memo.__getitem__, tokens), np.int64, len(tokens))
        found = [(i, self.near[r]) for i, r in zip(np.nonzero(at >= 0)[0].tolist(), at[at >= 0].tolist())]
        if np.count_nonzero(at == -2) >= 3:
            for i, word in self.spelled(tokens, at):
                v = self.kernel([word])[0]
                if v.max(initial=0.0) >= FLOOR:
                    found.append((i, np.where(v >= FLOOR, v, 0)))
            found.sort(key=lambda x: x[0])
        out, last = [], -1
        for i, v in found:
            if out and not any(t.endswith(SENTENCE_END) for t in tokens[last:i]):
                out[-1] = np.maximum(out[-1], v)
            else:
                out.append(v)
            last = i
        return out


def choose_landmarks(texts: list, labels: list, n: int = LANDMARKS, neutral: int = NEUTRAL) -> list:
    """Beginnings of units that tell toxic texts from others, chosen so that each covers texts the ones before leave; and frequent clean units."""
    toxic = [set(units) for units, label in zip(texts, labels) if label]
    clean = [set(units) for units, label in zip(texts, labels) if not label]
    starts = lambda units: {u[:k] for u in units for k in range(4, min(len(u), 13) + 1)}  # noqa: E731  BEGIN and three characters at least
    up = Counter()
    for units in toxic:
        up.update(starts(units))
    up = Counter({u: c for u, c in up.items() if c >= 3})
    down = Counter()
    for units in clean:
        down.update(u for u in starts(units) if u in up)
    a, b = len(toxic) + 1, len(clean) + 1
    gain = lambda u, c: c * log(((c + 0.5) / a) / ((down[u] + 0.5) / b))
    ranked = sorted(up, key=lambda u: (-gain(u, up[u]), -len(u), u))[:3_000]
    holders: dict = {u: set() for u in ranked}
    for i, units in enumerate(toxic):
        for u in starts(units):
            if u in holders:
                holders[u].add(i)
    chosen: list = []
    left = set(range(len(toxic)))
    while ranked and len(chosen) < n - neutral:
        best = max(ranked, key=lambda u: (gain(u, max(0.01, len(holders[u] & left))), len(u), u))
        if gain(best, max(0.01, len(holders[best] & left))) < 8:
            break
        chosen.append(best)
        left -= holders[best]
        ranked = [u for u in ranked if not (u.startswith(best) or best.startswith(u))]
    for u in ranked:  # then what is as telling, though texts are covered
        if len(chosen) < n - neutral and gain(u, up[u]) >= max(20, 2.3 * up[u]) and not any(u.startswith(c) or c.startswith(u) for c in chosen):
            chosen.append(u)
    frequent = Counter()
    for units in clean:
        frequent.update(u for u in units if len(u) > 4)
    common = [u for u, _ in sorted(frequent.items(), key=lambda x: (-x[1], x[0]))[:neutral]]
    return chosen + common if chosen else []


def distinct_texts(tokens: list, labels: list) -> list:
    """Places of texts whose words are not those of a text before with the same label: copies would count as evidence."""
    seen, out = set(), []
    for i, (row, label) in enumerate(zip(tokens, labels)):
        mark = (label, " ".join(row))
        if mark not in seen:
            out.append(i)
        seen.add(mark)
    return out


def fit(sample: DataFrame) -> dict:
    """Model of a bounded labelled sample of documents: landmarks, their weights, the scaling to probabilities.

    Rows are taken in order of a hash of doc_id, then doc_id, then text, so ties and repeats change nothing;
    a null text is empty. Without rows of both classes the model is constant.
    """
    rows = sample.select("doc_id", "text", "label").orderBy(F.xxhash64("doc_id"), "doc_id", "text").toArrow().to_pylist()
    tokens = [(r["text"] or "").split() for r in rows]
    labels = [int(r["label"] > 0) for r in rows]
    kept = distinct_texts(tokens, labels)
    tokens, labels = [tokens[i] for i in kept], [labels[i] for i in kept]
    base = (sum(labels) + 1) / (len(labels) + 2)
    memo: dict = {}
    for row in tokens:
        for t in row:
            if t not in memo:
                memo[t] = unit_of(t)
    units = [[memo[t] for t in row] for row in tokens]
    landmarks = choose_landmarks(units, labels)
    none = {"landmarks": landmarks or [BEGIN + "none"], "weights": np.zeros(max(1, len(landmarks))), "bias": 0.0, "scale": ([0.0], [base])}
    if not landmarks or len(set(labels)) < 2:
        return none
    kernel = SubsequenceKernel(landmarks)
    own = kernel(landmarks).astype(float)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    root = vector @ np.diag(np.maximum(value, 1e-3) ** -0.5) @ vector.T  # Nystroem map: features times root
    reader = Sentences(kernel)
    reader.MEMO_LIMIT = 1 << 60  # the sample is bounded
    reader.learn(memo)
    bags = [reader(row) for row in tokens]
    telling = np.arange(len(landmarks)) < len(landmarks) - NEUTRAL

    def train(docs):
        """A toxic document's sentences that hold a telling landmark are toxic, the nearest in any case; a clean one's nearest are clean."""
        x, y = [np.zeros(len(landmarks))], [0]
        for d in docs:
            near = sorted(((float((v * telling).max()), i) for i, v in enumerate(bags[d])), reverse=True)
            for rank, (value, i) in enumerate(near[:6]):
                if not labels[d] or value >= 0.9 or (rank == 0 and value >= 0.6):
                    x.append(bags[d][i])
                    y.append(labels[d])
        z, y = np.array(x) @ root, np.array(y)
        if y.sum() == 0:
            return None
        index = np.arange(z.shape[1])
        balance = len(y) / (2.0 * np.bincount(y, minlength=2).clip(1))
        w, b = fit_hinge([index] * len(z), list(z), y, z.shape[1], 10 * np.minimum(balance[y], 10.0), epochs=40)
        return root @ w, b

    def margin(model, d):
        return max([0.0, *(float(v @ model[0]) for v in bags[d])]) + model[1]

    fold, margins = folds_of(len(bags)), np.zeros(len(bags))
    for k in range(3):
        model = train(np.nonzero(fold != k)[0])
        if model is None:
            return none
        for d in np.nonzero(fold == k)[0]:
            margins[d] = margin(model, d)
    model = train(np.arange(len(bags)))
    return {"landmarks": landmarks, "weights": model[0], "bias": float(model[1]), "scale": isotonic(margins, np.array(labels))}


def score(docs: DataFrame, model: dict, keys: list, text_col: str = "text") -> DataFrame:
    """(*keys, score): the probability of a text's most toxic sentence; null and empty texts score as one without any near unit."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(*keys, F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in picked.drop("_text").dtypes) + ", score double"

    def run(batches):
        m = shipped.value
        reader, w, b, (knots, heights) = Sentences(SubsequenceKernel(m["landmarks"])), m["weights"], m["bias"], m["scale"]
        for batch in batches:
            out = []
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for first in range(0, len(texts), 200):
                tokens = [(t or "").split() for t in texts[first : first + 200]]
                new = set().union(*tokens)
                unknown = new - reader.memo.keys()
                if len(reader.memo) + len(unknown) > reader.MEMO_LIMIT:
                    reader.learn(new)
                elif unknown:
                    reader.learn(unknown)
                for row in tokens:
                    out.append(float(np.interp(max([0.0, *(float(v @ w) for v in reader(row))]) + b, knots, heights)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return picked.mapInArrow(run, schema)


def op9_toxicity(spark, sf_dir):
    """Toxicity of each document by a model of labelled rows that are not held out; null and empty texts score as clean ones."""
    docs = table(spark, sf_dir, "documents")
    held_out = lambda c: F.coalesce(crc_mod(c, 3) == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    model = fit(labelled_sample(docs, labels, "toxic", SAMPLE_ROWS))
    scored = score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Bounds that hold by rows, and steps that end only when nothing is left."""

import numpy as np
from pyspark.sql import functions as F

from touchline.llm import quality, toxicity
from touchline.llm.minhash import OnePermutation


def test_labelled_sample_is_bounded_in_rows(spark):
    docs = spark.range(500).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("x").alias("label"))
    docs = docs.union(spark.createDataFrame([(8, "other", "x"), (8, "other", "x"), (None, "none", "x")], "doc_id long, text string, label string"))
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 0), (None, 1), (9, None)], "doc_id long, quality int")
    few = quality.labelled_sample(docs, labels, "quality", 10).collect()
    assert len(few) == 10 and few == quality.labelled_sample(docs.repartition(7), labels, "quality", 10).collect()
    every = quality.labelled_sample(docs, labels, "quality", 1_000).collect()
    assert len(every) == 501 and {(r.doc_id, r.label) for r in every} == {(7, 1), (8, 0)}


def test_only_equal_texts_are_copies():
    shared = [f"common{i}" for i in range(20)]
    rows = [shared + [f"own{k}_{i}" for i in range(80)] for k in range(300)]
    assert toxicity.distinct_texts(rows + rows[:5], [1] * 305) == list(range(300))
    assert toxicity.distinct_texts([["a"], ["a"], ["a", "b"], []], [1, 0, 1, 0]) == [0, 1, 2, 3]


def test_densification_goes_on_to_a_full_bin():
    make = OnePermutation()
    for n in (1, 2, 4, 16):
        text = " ".join(f"w{i}" for i in range(n + 4))
        h = make.shingles(text)
        bins = (h >> np.uint64(56)).astype(int)
        low = [0] * 256
        for b in range(256):
            t, at = 0, b
            while at not in bins:
                at = int(make.tries(t // 64)[t % 64, b])
                t += 1
            least = min(int(x) << 8 & (1 << 64) - 1 for x, y in zip(h.tolist(), bins) if y == at)
            from touchline.llm.common import mix64

            low[b] = int(mix64(np.array([least], np.uint64))[0]) & 15
        assert make(text) == bytes(low[i] | low[i + 1] << 4 for i in range(0, 256, 2))

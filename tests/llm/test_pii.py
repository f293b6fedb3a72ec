"""Learnt kinds of personal data against a plain version, and redaction of many and of overlapping spans."""

import random
import time

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from touchline.llm import pii

from . import brute

SMALL = "/root/testdata/sf0.001"


def buckets(spark, texts):
    words = sorted({(c[4],) for t in texts for c in brute._learnt_candidates(t or "") if c[4]})
    return {r.w: r.b for r in spark.createDataFrame(words, "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(pii.CONTEXTS)).alias("b")).collect()}


def mixed_texts():
    rnd, out = random.Random(7), []
    word = lambda: "".join(rnd.choices("abcdefghij", k=rnd.randrange(3, 9)))
    hexa = lambda n: "".join(rnd.choices("0123456789abcdef", k=n))

    def account(sound):
        body = "".join(rnd.choices("0123456789", k=18))
        check = 98 - int(body + "131400") % 97  # DE is 1314
        flat = f"DE{check if sound else (check + 1) % 97:02d}{body}"
        return " ".join(flat[i : i + 4] for i in range(0, len(flat), 4))

    makers = (
        lambda: f"token = \"{hexa(40)}\"", lambda: f"api_key: {hexa(32)}", lambda: f"item {word()}{hexa(14)}zz9q", lambda: f"IBAN: {account(True)}", lambda: f"code {account(False)}",
        lambda: "Dr. Anna Smith", lambda: "named Peter Jones", lambda: f"{word()} Grand Hotel", lambda: f"x. {word().title()} {word().title()} went", lambda: "mail a.b@c.example",
    )
    for _ in range(60):
        out.append(" ".join(x for _ in range(6) for x in (word(), word(), rnd.choice(makers)())))
    return [None, "", *out]


def test_learnt_spans_against_a_plain_version(spark):
    for texts in (mixed_texts(), [d["text"] for d in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()]):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        want = brute.learnt_spans(texts, buckets(spark, texts))
        model = pii.learn(docs)
        for r in pii.find_spans(docs, model, ["doc_id"]).collect():
            assert [(k, s.start, s.end) for k in pii.LEARNT for s in r[k]] == want[r.doc_id], texts[r.doc_id]
    kinds = {k for spans in brute.learnt_spans(mixed_texts(), buckets(spark, mixed_texts())) for k, _, _ in spans}
    assert kinds == set(pii.LEARNT)


def test_accounts_and_names_are_told_from_others(spark):
    texts = mixed_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = " ".join(r.text or "" for r in pii.redact(docs, pii.learn(docs)).collect())
    assert "Dr. [NAME]" in clean and "named [NAME]" in clean and "IBAN: [ACCOUNT]" in clean and 'token = "[SECRET]"' in clean and "Grand Hotel" in clean and "Anna Smith" not in clean


def test_overlapping_and_many_spans(spark):
    texts = ["a 1.2.3.4@mail.example b", "+49 4111 1111 1111 1111 end", "x 😀 a@b.example 😀 +49 170 1234567", " ".join(f"user{i}@mail{i}.example and" for i in range(16_000)), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    start = time.perf_counter()
    got = {r.doc_id: r.text for r in pii.redact(docs, {}).collect()}
    assert time.perf_counter() - start < 40
    for i, t in enumerate(texts):
        assert got[i] == (brute.redacted(t, brute.base_spans(t)) if t else t)

"""From raw documents to token ids: language ID, near-dedup, decontamination, PII, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import bpe, decontaminate, langid, pii, simhash
from touchline.llm.common import staged, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a clear margin; dictionaries are learnt from labelled rows of docs.

    Where these have fewer than two languages, every document with a letter stays.
    """
    return langid.accepted(docs, langid.learn_dictionaries(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of 5-word Jaccard similarity 0.8 or more: that of the least doc_id."""
    return simhash.deduplicate(docs)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars is counted anew."""
    out = pii.redact(docs, pii.learn(docs))
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Token ids of each document, and a digest of what they decode to."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    out = bpe.encode(docs, tokenizer_path, keep=("lang", "source"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", clean_of_benchmarks),
    ("PII", redacted),
    ("BPE encoding and decoding", tokens),
]

#: The first, second, fourth and last stage can't be told in SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each stage's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, f"stage{i}")
    return docs

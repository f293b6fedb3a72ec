"""The pipeline's rows against its stages done plainly, one after the other."""

import corpus_pipeline
import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from touchline.llm import decontaminate, langid

from . import brute
from .test_pii import buckets
from .test_similar import kept

SMALL = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    classify = langid.CompressionClassifier(langid.learn_dictionaries(spark.read.parquet(f"{SMALL}/documents.parquet")))
    docs = [d for d in docs if not classify(d["text"])[2]]
    stay, _ = kept(sorted((d["doc_id"], d["text"]) for d in docs))  # the stage's own rule: 5-word similarity of 0.8
    docs = [d for d in docs if d["doc_id"] in stay]
    db = duckdb.connect()
    db.register("documents", pa.Table.from_pylist([{"doc_id": d["doc_id"], "text": d["text"]} for d in docs]))
    db.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SMALL}/benchmark.parquet'")
    held = {r[0] for r in db.execute(f"SELECT doc_id FROM ({decontaminate.op8_sql()})").fetchall()}
    docs = [d for d in docs if d["doc_id"] not in held]

    texts = [d["text"] for d in docs]
    learnt = brute.learnt_spans(texts, buckets(spark, texts))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    want = {}
    for d, more in zip(docs, learnt):
        ids = tokenizer.encode(brute.redacted(d["text"], brute.base_spans(d["text"]) + more), add_special_tokens=False).ids
        want[d["doc_id"]] = (d["lang"], d["source"], len(ids), ids, brute.sha(tokenizer.decode(ids, skip_special_tokens=False)))
    got = {r.doc_id: (r.lang, r.source, r.n_tokens, r.ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == want


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns

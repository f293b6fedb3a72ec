"""Language ID where no margin can be judged: one learnt language, or none."""

import random

import corpus_pipeline
import pytest


@pytest.mark.parametrize("lang", ["en", None])
def test_long_documents_stay(spark, lang):
    from touchline.llm import langid

    rnd = random.Random(4)
    long = " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(6_000))
    rows = [(1, "A short text", lang), (2, long, lang), (3, long + " end", None), (4, "12 34", lang), (5, None, lang)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()} == {1, 2, 3}
    got = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in langid.identify(docs, langid.learn_dictionaries(docs)).collect()}
    assert got[2] == got[3] == ((lang, 1.0, False) if lang else ("und", 0.0, False)) and got[4] == got[5] == ("und", 0.0, True)

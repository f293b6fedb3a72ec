"""Secrets of any length are put to the labelers."""

from touchline.llm import pii


def test_long_keys_are_found(spark):
    keys = {i: ("0123456789abcdef" * 64)[i : i + n] for i, n in enumerate((16, 64, 65, 128, 1_000))}
    docs = spark.createDataFrame([(i, f"Set api_key = {k} and go") for i, k in keys.items()] + [(9, "x" * 50_000 + "1@example")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(docs, pii.learn(docs)).collect()}
    assert {i: got[i] for i in keys} == {i: "Set api_key = [SECRET] and go" for i in keys}
    assert got[9] == "x" * 50_000 + "1@example"

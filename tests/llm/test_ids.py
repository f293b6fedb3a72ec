"""Near-dedup of rows without an id, and of rows that share one."""

from touchline.llm import simhash


def test_null_and_shared_ids(spark):
    text = lambda name, n=40: " ".join(f"{name}{i}" for i in range(n))
    rows = [
        (1, text("a")), (None, text("a")), (None, text("a") + " more"),  # copies of an identified row go
        (None, text("b")), (None, text("b") + " more"),  # one of a component of null ids stays
        (2, text("c")), (2, text("d")), (2, text("c")),  # one id, different texts: both stay, the repeat goes
        (3, text("d")),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in simhash.deduplicate(docs).collect()), key=repr)
    assert got == sorted([(1, text("a")), (2, text("c")), (2, text("d")), (None, text("b"))], key=repr)

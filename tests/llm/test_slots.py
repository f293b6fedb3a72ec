"""Slot values that are shared or contradicted within one copy of a benchmark item."""

import time

import duckdb

from touchline.llm import decontaminate


def found(spark, item, texts):
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r.doc_id for r in decontaminate.decontaminate(docs, items).collect()}
    with duckdb.connect() as db:  # the SQL goes by the same rule
        db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
        db.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
        db.execute("INSERT INTO benchmark VALUES (1, ?)", [item])
        rows = decontaminate.contamination(docs, items)
        assert sorted(map(tuple, rows.collect())) == sorted(db.execute(f"SELECT {', '.join(rows.columns)} FROM ({decontaminate.op8_sql()})").fetchall())
    return {r.doc_id: (r.n_matched, r.n_windows, r.n_slots, r.reparameterised) for r in decontaminate.contamination(docs, items).collect()}, left


def test_two_slots_that_now_share_a_value(spark):
    item = "If Anna has 12 apples and gives away 5 apples, how many apples are left for Anna to eat at home"
    got, left = found(spark, item, [item.replace("Anna", "Berta").replace("12", "8").replace("5", "8"), "A clean text about apples and homes that has 12 of them"])
    assert got == {0: (17, 17, 3, True)} and left == {1}


def test_a_repeated_value_changed_in_one_place(spark):
    item = "There are 12 red boxes on the table in the hall and there are 12 blue boxes on the floor of the old barn behind the house"
    copy = item.replace("12 blue", "30 blue")
    got, left = found(spark, item, ["Quiz. " + copy, item])
    # Five windows hold the changed number and three, at the start, the other: those three do not count.
    assert got == {0: (20, 23, 1, True), 1: (23, 23, 1, False)} and left == set()


def test_a_name_for_two_people_costs_only_its_windows(spark):
    item = "If Anna has 12 apples and gives away 5 apples, how many apples are left for Anna to eat at home"
    got, left = found(spark, item, ["Quiz. If Berta has 30 apples and gives away 30 apples, how many apples are left for Clara to eat at home"])
    # Clara stands in five windows and Berta, at the start, in two: those two do not count.
    assert got == {0: (15, 17, 3, True)} and left == set()


def test_many_slots(spark):
    """Thousands of slots and a table of like rows are bound in linear steps: a join and windows, no search within a row."""
    found(spark, "one 1 two 2 three 3", ["warm up"])
    item = " ".join(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]} costs {i} euros" for i in range(1_000))
    start = time.perf_counter()
    got, left = found(spark, item, [item.replace(" 7 ", " 8 "), "clean"])
    assert got[0][:2] == (len(item.split()) - 4,) * 2 and left == {1}
    alike = " ".join(f"{i} apples" for i in range(100))
    got, left = found(spark, alike, [alike, " ".join(f"{2 * i} apples" for i in range(400)), "clean"])
    assert left == {2} and got[0] == (196, 196, got[0][2], True)
    assert time.perf_counter() - start < 60

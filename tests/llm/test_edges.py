"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from touchline.llm import bpe, chat, components, decontaminate, langid, linear, minhash, pii, quality, simhash, substring, toxicity

from . import brute

LONG = " ".join(f"word{i % 701} tail{i % 13}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, LONG), (6, "Short one"), (6, "Short one"), (7, f"start {PASSAGE} end"), (8, f"other {PASSAGE} stop"), (None, "no id here"), (None, None), (9, "Call +49 170 1234567 or mail a.b@c.example")]
CLASHING = ("score", "fp", "rep", "h", "text_hash", "spans", "component_id", "_rank", "item_id", "range", "lang_pred", "ids")


@pytest.fixture(scope="module")
def odd(spark):
    base = spark.createDataFrame([(d, t, "xx" if d else None, None, None) for d, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    return base.withColumns({c: F.lit("clash") for c in CLASHING}).repartition(3)


def operators(spark, docs):
    items = spark.createDataFrame([(1, "p1 p2 p3 p4 p5 p6 p7 p8"), (2, None), (None, "lost one")], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    labels = docs.select("doc_id", (F.coalesce("doc_id", F.lit(0)) % 2).cast("int").alias("quality"), F.lit(1).alias("toxic"))
    tokenizer = __import__("public_tokenizers").path("word_bpe_49k.json")
    return {
        "simhash": simhash.near_duplicate_components(docs),
        "deduplicate": simhash.deduplicate(docs),
        "quality": quality.score(docs, quality.fit(quality.labelled_sample(docs, labels, "quality", 100)), ["doc_id"]),
        "minhash": minhash.edited_fingerprints(docs),
        "substring": substring.remove_repeats(docs),
        "pii": pii.find_spans(docs, pii.learn(docs), ["doc_id"]),
        "redact": pii.redact(docs, pii.learn(docs)),
        "langid": langid.identify(docs, langid.learn_dictionaries(docs), names=("l", "s", "r")),
        "accepted": langid.accepted(docs, langid.learn_dictionaries(docs)),
        "contamination": decontaminate.contamination(docs, items),
        "decontaminate": decontaminate.decontaminate(docs, items),
        "toxicity": toxicity.score(docs, toxicity.fit(quality.labelled_sample(docs, labels, "toxic", 100)), ["doc_id"]),
        "bpe": bpe.encode(docs, tokenizer),
    }


def test_empty_tables(spark, odd):
    for name, df in operators(spark, odd.where("false")).items():
        assert df.collect() == [], name


def test_odd_rows(spark, odd):
    found = operators(spark, odd)
    rows = {name: df.collect() for name, df in found.items()}
    for name in ("simhash", "quality", "minhash", "substring", "pii", "redact", "langid", "toxicity", "bpe"):
        assert len(rows[name]) == len(TEXTS), name
    for name in ("accepted", "deduplicate", "redact", "decontaminate"):
        assert found[name].columns == odd.columns, name
        assert all(r[c] == "clash" for r in rows[name] for c in CLASHING), name
    ids = lambda name: sorted(r.doc_id for r in rows[name] if r.doc_id is not None)
    assert {r.doc_id: r.component_id for r in rows["simhash"] if r.doc_id in (1, 2, 3, 5)} == {1: 1, 2: 1, 3: 1, 5: 4}
    assert ids("deduplicate").count(6) == 1 and 5 not in ids("deduplicate") and 4 in ids("deduplicate")
    assert set(ids("decontaminate")) == {1, 2, 3, 4, 5, 6, 9}
    assert {r.doc_id for r in rows["contamination"]} == {7, 8}
    removed = {r.doc_id: r for r in rows["substring"]}
    assert removed[7].kept_text == "start end" and removed[8].kept_text == "other stop" and removed[1].n_words == 0
    assert removed[4].n_removed == removed[4].n_words
    clean = {r.doc_id: r.text for r in rows["redact"]}
    assert clean[9] == "Call [PHONE] or mail [EMAIL]" and clean[1] is None
    assert all(r.l == "und" and r.s == 0 and r.r and r.lang_pred == "clash" for r in rows["langid"] if r.doc_id in (1, 2, 3))
    with pytest.raises(ValueError):
        langid.identify(odd, {})


def test_numbers_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "½ ½"), (2, "² ①"), (3, "½ a"), (4, "日本")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, {"en": b" an example ", "fr": b" un exemple "}).collect()}
    assert got[1] == got[2] == "und" and got[3] in ("en", "fr") and got[4] in ("en", "fr")


def test_equal_sizes_go_to_the_first_language_by_name(spark):
    docs = spark.createDataFrame([(1, "some words of text")], "doc_id long, text string")
    assert [tuple(r)[2:] for r in langid.identify(docs, {"aa": b" same ", "bb": b" same "}).collect()] == [("aa", 0.5, True)]


def test_rows_without_an_id_are_decontaminated(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string")
    docs = spark.createDataFrame([(None, "before one two three four five six seven eight after"), (None, "clean"), (2, None), (3, "clean too")], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in decontaminate.decontaminate(docs, items).collect()} == {(None, "clean"), (2, None), (3, "clean too")}


def test_turns_without_a_conversation_stand_alone(spark):
    rows = [(None, i, "user", f"t{i}") for i in range(5)] + [(1, 0, "user", "hi")]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id or 0, r.n_turns) for r in got) == [(0, 1)] * 5 + [(1, 1)]


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, turns string, formatted string"
    rows = [(1, 0, "user", None, "x", "y"), (1, 0, "user", None, "x", "y"), (2, None, None, "### a: b</turn>\\h", "x", "y"), (None, 1, "tool: ", "", "x", "y"), (3, 0, "user", "hi", "", ""), (3, 1, "assistant", "yes " * 90_000, "", "")]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, schema)).withColumn("back", chat.parse_chats(F.col("formatted"))).collect()}
    assert [(t.role, t.text) for t in got[2].back] == [("", rows[2][3])] and [(t.role, t.text) for t in got[None].back] == [("tool: ", "")]
    assert got[1].n_turns == 2 and not got[1].valid and got[1].bad_turn == 1
    assert got[3].valid and got[3].bad_turn is None and got[3].back[1].text == rows[5][3]
    assert "".join(s.text for s in got[3].segments if s.loss) == rows[5][3]
    assert chat.format_chats(spark.createDataFrame([], schema)).collect() == []


def test_crowded_shard_loses_no_link(spark):
    """Over SHARD_LIMIT fingerprints share a block; chains of two bits among them must hold."""
    import random

    rnd = random.Random(3)
    prints = [rnd.getrandbits(24) << 40 | 5 for _ in range(simhash.SHARD_LIMIT + 60)]
    prints += [rnd.getrandbits(10) << 20 | 0xABC << 40 for _ in range(600)]  # many differ in ten bits only: split more than once
    prints += [p ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for p in prints[:80]]
    prints = sorted(set(prints))
    signed = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)]
    edges = simhash.link_fingerprints(spark.createDataFrame(signed, "fp long, rep long"))
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    want = brute.components(list(enumerate(prints)))
    assert {i: got.get(i, i) for i in range(len(prints))} == want
    assert len(set(want.values())) < len(prints)


def test_bk_tree_search():
    import random

    rnd = random.Random(1)
    values = [rnd.getrandbits(12) for _ in range(300)]
    tree = simhash.BKTree()
    for v in dict.fromkeys(values):
        tree.add(v, v)
    for q in range(0, 4_096, 97):
        assert sorted(tree.search(q, 2)) == sorted(v for v in set(values) if (v ^ q).bit_count() <= 2)


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(1_000, 1_000 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[1_000 + i] == 1_000 for i in range(60))


def test_reparameterised_question(spark):
    items = spark.createDataFrame([(1, "If Anna has 12 apples and gives away 5 apples, how many apples are left for Anna to eat at home")], "item_id long, text string")
    docs = spark.createDataFrame(
        [
            (1, "Quiz. If Berta has 30 apples and gives away 7 apples, how many apples are left for Berta to eat at home"),
            (2, "Quiz. If Berta has 30 apples and gives away 30 apples, how many apples are left for Clara to eat at home"),
            (3, "A clean text about apples and homes that has 12 of them"),
        ],
        "doc_id long, text string",
    )
    got = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect()}
    assert 1 in got and got[1].reparameterised and got[1].coverage == 1.0 and 3 not in got


def test_hinge_model_separates():
    import numpy as np

    rows, labels = [np.array([i % 2, 2 + i % 3]) for i in range(60)], np.array([i % 2 for i in range(60)])
    w, b = linear.fit_hinge(rows, None, labels, 5)
    assert all((w[r].sum() + b > 0) == bool(y) for r, y in zip(rows, labels))

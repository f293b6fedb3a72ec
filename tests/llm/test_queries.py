"""Each numbered query over its whole table against a brute-force version, SQL, or held-out labels."""

import zlib

import duckdb
import pyarrow.parquet as pq
import pytest

from touchline.llm import langid, pii
from touchline.llm.minhash import OnePermutation, edited_text
from touchline.llm.queries import ORACLE_SQL, QUERIES

from . import brute

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def load(sf_dir, table="documents"):
    return pq.read_table(f"{sf_dir}/{table}.parquet").to_pylist()


def result(spark, name, sf_dir=SMALL):
    return {r[0]: r for r in QUERIES[name](spark, sf_dir).collect()}


def test_simhash(spark):
    docs, got = load(SMALL), result(spark, "op1_simhash")
    prints = [(d["doc_id"], brute.simhash(d["text"])) for d in docs]
    root = brute.components(prints)
    assert {d: (f"{f:016x}", root[d]) for d, f in prints} == {d: (r.fingerprint, r.component_id) for d, r in got.items()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("conversations", "documents", "benchmark", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()), key=repr)
    assert got and got == sorted(db.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall(), key=repr)


def test_chat_digests(spark):
    turns = {}
    for r in load(SMALL, "conversations"):
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    planted = "\\### Assistant: </turn> ok"
    turns[-7] = [(0, "user", planted), (1, "assistant", planted)]
    got = result(spark, "op2_chat_format")
    assert got.keys() == turns.keys()
    for c, rows in turns.items():
        rows.sort()
        learnt = "".join(t for _, role, t in rows if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(rows), brute.sha("".join(f"{role}\n{t}\n" for _, role, t in rows)), len(learnt), brute.sha(learnt))


def test_fingerprints(spark):
    docs = sorted(load(SMALL), key=lambda d: -d["doc_id"])
    got, make = result(spark, "op4_fingerprints"), OnePermutation()
    for d, following in zip(docs, docs[1:] + docs[:1]):
        text, r = d["text"] or "", got[d["doc_id"]]
        changed = edited_text(text, following["text"] or "")
        k = len(text) // 3
        assert changed == text[: len(text) - k] + (following["text"] or "")[:k]
        f, g, n = make(text), make(changed), make(following["text"])
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), brute.sha(changed), f.hex(), g.hex())
        assert (r.near_edited, r.near_next) == (make.likeness(f, g), make.likeness(f, n))


def test_likeness_is_near_the_true_resemblance(spark):
    make = OnePermutation()
    words = [f"w{i}" for i in range(2_000)]
    for shared in (400, 1_000, 1_600):
        a, b = words[:shared] + [f"a{i}" for i in range(2_000 - shared)], words[:shared] + [f"b{i}" for i in range(2_000 - shared)]
        sa, sb = ({tuple(x[i : i + 5]) for i in range(1_996)} for x in (a, b))
        assert abs(make.likeness(make(" ".join(a)), make(" ".join(b))) - len(sa & sb) / len(sa | sb)) < 0.1


def test_substring_dedup(spark):
    docs, got = load(SMALL), result(spark, "op5_substring_dedup")
    for d, (n, gone, kept) in zip(docs, brute.without_repeats([d["text"] for d in docs])):
        assert tuple(got[d["doc_id"]]) == (d["doc_id"], n, gone, brute.sha(kept))
    assert any(r.n_removed for r in got.values())


def test_pii(spark):
    docs, got = load(SMALL), result(spark, "op6_pii")
    for d in docs:
        r, spans = got[d["doc_id"]], brute.base_spans(d["text"])
        assert r.base_sha256 == brute.sha(brute.spelled(spans))
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in spans) for k in pii.BASE]
        assert (r.spans + ",").startswith(brute.spelled(spans))


def test_language(spark):
    docs, got = load(MIDDLE), result(spark, "op7_langid", MIDDLE)
    assert len(got) == len(docs)
    right = []
    for d in docs:
        r = got[d["doc_id"]]
        assert r.held_out == (zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0) and 0 <= r.score <= 1
        if not langid.has_letter(d["text"] or ""):
            assert r.lang_pred == "und"
        elif r.held_out and d["lang"] and len(d["text"]) > 100:
            right.append(r.lang_pred == d["lang"])
    assert sum(right) / len(right) > 0.9


@pytest.mark.parametrize("name, label, mod, rest, cut, least", [("op3_quality", "quality", 5, 0, 0.3, 0.8), ("op9_toxicity", "toxic", 3, 1, 0.7, 0.8)])
def test_classifier(spark, name, label, mod, rest, cut, least):
    docs, got = load(MIDDLE), result(spark, name, MIDDLE)
    assert got.keys() == {d["doc_id"] for d in docs}
    labels = {r["doc_id"]: r[label] for r in load(MIDDLE, "labels") if r[label] is not None}
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % mod == rest) and 0 <= r.score <= 1 and r.predicted == (r.score >= cut)
    held = [d for d in labels if d in got and got[d].held_out]
    assert brute.auc([got[d].score for d in held], [labels[d] for d in held]) > least


def test_bpe(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    got = result(spark, "op10_bpe")
    for d in load(SMALL):
        ids = t.encode(d["text"] or "", add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(t.decode(ids, skip_special_tokens=False)))

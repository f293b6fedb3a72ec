"""The pipeline's near-dedup stage against true Jaccard similarities."""

from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow.parquet as pq

from touchline.llm import simhash

from . import brute

MIDDLE = "/root/testdata/sf0.01"


def shingles(text):
    words = brute.WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def kept(rows):
    """Least ids of components of Jaccard similarity 0.8 or more, from all pairs that share a shingle; and the links."""
    sets, by = [shingles(t) for _, t in rows], defaultdict(list)
    for i, s in enumerate(sets):
        for x in s or {()}:
            by[x].append(i)
    shared = Counter((i, j) for at in by.values() for n, j in enumerate(at) for i in at[:n])
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    links = [(i, j) for (i, j), n in shared.items() if not sets[i] or 9 * n >= 4 * (len(sets[i]) + len(sets[j]))]
    for i, j in links:
        top[max(find(i), find(j))] = min(find(i), find(j))
    return {d for i, (d, _) in enumerate(rows) if find(i) == i}, links


def test_stage_against_all_pairs(spark):
    rows = sorted((d["doc_id"], d["text"]) for d in pq.read_table(f"{MIDDLE}/documents.parquet").to_pylist())
    want, links = kept(rows)
    assert any(brute.simhash(rows[i][1]) != brute.simhash(rows[j][1]) for i, j in links)
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{MIDDLE}/documents.parquet"), MIDDLE).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_pairs_about_the_threshold_and_a_crowded_shard(spark):
    import random

    rnd, rows = random.Random(5), []
    base = lambda n: [f"v{rnd.randrange(10**6)}" for _ in range(n)]
    for n in (7, 9, 12, 30, 100, 400):
        for share in (0.0, 0.01, 0.02, 0.025, 0.03, 0.05):
            words = base(n)
            rows.append((len(rows), " ".join(words)))
            rows.append((len(rows), " ".join(w if rnd.random() >= share else "changed" for w in words) + " more"))
    crowd = base(120)
    for _ in range(simhash.CROWDED + 40):
        copy = list(crowd)
        copy[rnd.randrange(120)] = f"own{len(rows)}"
        rows.append((len(rows), " ".join(copy)))
    want, links = kept(rows)
    assert len(links) > 100
    got = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r.doc_id for r in got.collect()} == want


def test_groups_in_blocks(spark, monkeypatch):
    """A group of candidates that spans several blocks gives the components that it gives as one."""
    import random

    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 9)
    rnd, rows = random.Random(8), []
    for _ in range(6):
        words = [f"b{rnd.randrange(10**6)}" for _ in range(90)]
        for _ in range(25):
            words[rnd.randrange(90)] = f"own{rnd.randrange(10**9)}"
            rows.append((len(rows), " ".join(words)))
    want, links = kept(rows)
    got = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert len(links) > 150 and {r.doc_id for r in got.collect()} == want
    texts = spark.createDataFrame([(1, k, "x" * k) for k in range(40)] + [(2, 99, "y")], "component long, key long, text string")
    pairs = [(r.component, r.pair, r.key) for r in simhash._in_block_pairs(texts).collect()]
    met = {(a[2], b[2]) for a in pairs for b in pairs if a[:2] == b[:2] and a[2] < b[2]}
    assert met == {(i, j) for j in range(40) for i in range(j)} and (2, simhash.ONE_BLOCK, 99) in pairs
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 1024)
    monkeypatch.setattr(simhash, "BLOCK_CHARS", 300)
    assert simhash._in_block_pairs(texts).where("component = 1").agg({"pair": "max"}).first()[0] > 0


def test_a_pair_misses_the_shards_rarely():
    """Recall at the threshold itself: sets of similarity 0.8 share a shard and lie within the radius."""
    make, rnd = simhash.ShingleSet(), np.random.default_rng(2)
    for size in (8, 80, 800):
        for _ in range(300):
            h = np.unique(rnd.integers(0, 1 << 63, size + size // 4, dtype=np.uint64))
            a, b = h[: len(h)], np.sort(rnd.permutation(h)[:size])
            assert simhash.alike(a, b)
            assert np.any(make.shards(a) == make.shards(b))
            assert (make.fingerprint(a) ^ make.fingerprint(b)).bit_count() <= simhash.WIDE_RADIUS

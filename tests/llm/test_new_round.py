"""Source divergence, WARC archives and the conversation trie: plain versions, hostile inputs and edge cases."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from touchline.llm import divergence, radix, trie, warc

sha = lambda text: hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.mark.parametrize("k", [1, 3, 10])
def test_radix_top_equals_a_sort(spark, k):
    rows = [(g, v * (1 << 33 if g == "big" else 1), i) for g, n in (("a", 40), ("big", 25), ("few", 2), ("ties", 60)) for v, i in ((0 if g == "ties" else j % 7, f"{'é' * (j % 3)}w{j:02d}" if g != "ties" else "x" * (j + 1)) for j in range(n))]
    df = spark.createDataFrame(rows, "g string, v long, item string").withColumn("rank", F.lit("clash")).repartition(5)
    got = {tuple(r) for r in radix.radix_top(df, ["g"], "v", "item", k).collect()}
    want = set()
    for g in {r[0] for r in rows}:
        best = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2].encode()))[:k]
        want |= {(*r, n + 1) for n, r in enumerate(best)}
    assert got == want


def test_radix_top_of_nothing_and_of_equal_rows(spark):
    empty = spark.createDataFrame([], "g string, v long, item string")
    assert radix.radix_top(empty, ["g"], "v", "item", 3).collect() == []
    same = spark.createDataFrame([("a", 5, "x")] * 4, "g string, v long, item string")
    assert [tuple(r) for r in radix.radix_top(same, ["g"], "v", "item", 3).collect()] == [("a", 5, "x", 1), ("a", 5, "x", 2), ("a", 5, "x", 3)]


def plain_divergence(docs, least, top):
    import re

    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    count, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        words = term.findall(low(text or ""))
        count[lang or "", source or ""].update(words)
        df[lang or ""].update(set(words))
    kept = {lang: {w for w, n in c.items() if n >= least} for lang, c in df.items()}
    share = lambda c, words: {w: 1 + 10**9 * (c[w] + 2) // (sum(c[x] for x in words) + 2 * len(words)) for w in words}
    gap = lambda p, q: (p - q) ** 2 // (p + q)
    p = {g: share(c, kept[g[0]]) for g, c in count.items()}
    out = set()
    for (lang, source), own in p.items():
        whole = share(sum((count[g] for g in count if g[0] == lang), Counter()), kept[lang])
        pairs = [(s, sum(gap(own[w], p[lang, s][w]) for w in kept[lang])) for la, s in p if la == lang and s != source]
        terms = [(w, gap(own[w], whole[w])) for w in kept[lang] if count[lang, source][w] and own[w] > whole[w]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                out.add((lang, source, part, item, value, rank))
    return out


def test_divergence_edges(spark):
    words = ["Alpha", "beta", "gämma", "δelta", "it's", "x1y", "日本", "Éa", "éa"]
    docs = [(" ".join(words[(i * j) % 9] for j in range(1 + i % 11)), "en" if i % 3 else "de", f"s{i % 4}") for i in range(60)]
    docs += [(None, "en", "s9"), ("", None, None), ("only here", None, "s1"), ("long " * 30_000, "en", "s0")] + [("repeated row", "fr", "a")] * 12 + [("repeated row", "fr", "b"), ("other", "fr", "b")]
    df = spark.createDataFrame(docs, "text string, lang string, source string").withColumns({c: F.lit("clash") for c in ("term", "n", "docs", "value", "rank", "p", "base")}).repartition(3)
    assert {tuple(r) for r in divergence.source_divergence(df, 3, 4).collect()} == plain_divergence(docs, 3, 4)
    assert divergence.source_divergence(df.where("false")).collect() == []


def test_archives_with_records_inside_payloads(spark, tmp_path):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99:x>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    bodies = ["", None, "short", "a" * 99, "b" * 100, "b" * 100, "c" * 300, f"x{fake}y" * 3, fake, f"{fake}{'z' * 200}\r\n\r\nWARC/1.0\r\n", "WARC/1.0\r\n" * 50, "é" * 60, "é" * 60, "WWARC/1.0\r\n\r\n\r\n", "d" * 5_000 + fake]
    pages = [(i, f"http://x/{i}?<a>\r\nWARC/1.0" if i % 2 else None, b) for i, b in enumerate(bodies)] + [(None, "u", "b" * 100), (None, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("digest", "first", "value", "own")})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "257")
    try:
        path = f"file://{tmp_path}/archives"
        warc.write_archives(df.repartition(2), path)
        records = warc.read_archives(spark, path, payloads=True)
        got = records.collect()
        found = {(r.page, r.first, r.type, r.payload_bytes, r.payload_sha256) for r in warc.resolved(records).collect()}
        plain = {(r.page, r.payload_bytes, r.payload_sha256) for r in warc.resolved(warc.read_archives(spark, path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == len(pages) and all(sha(bytes(r.payload)) == r.payload_sha256 for r in got)
    assert sorted(r.record_id.split(":")[2] for r in got) == sorted("" if p is None else str(p) for p, _, _ in pages)
    assert {r.target_uri for r in got if r.target_uri and r.target_uri != "u"} == {f"http://x/{i}?%3Ca%3E%0D%0AWARC/1.0" for i in range(1, 15, 2)}
    again = {(5, 4), (12, 11), (None, 4)}
    want = set()
    for i, _, b in pages:
        b = (b or "").encode()
        first = next((f for x, f in again if x == i and len(b) >= 100), None)
        want.add(("" if i is None else str(i), None if first is None else str(first), "response" if first is None else "revisit", len(b), sha(b)))
    assert found == want and plain == {(p, n, d) for p, _, _, n, d in want}


def test_no_archives(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.resolved(warc.read_archives(spark, path)).collect() == []


def plain_trie(rows, group=100, most=6):
    """{(conv_id, depth): (parent, n_convs, n_children, n_leaves, saved, ends)} of rows (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    seqs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % most
        seqs[c] = tuple(own.get(c - c % group, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    out = {}
    for p, cs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        leaves = sum(not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in members) for q in under)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q)
        ends = ",".join(map(str, sorted(c for c in cs if len(seqs[c]) == len(p))))
        children = sum(len(q) == len(p) + 1 for q in under)
        out[min(cs), len(p)] = (min(members[p[:-1]]) if p else None, len(cs), children, leaves, saved, sha(ends))
    return out


@pytest.mark.parametrize("local", [0, 6, 4_096])
def test_trie_edges(spark, local):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"t{t}" if c % 3 else f"u{t}{c % 4}") for c in range(0, 330, 3) for t in range(c % 7)]
    rows += [(200, None, "user", "null turn first"), (201, 0, None, None), (202, 1, "user", "tie"), (202, 1, "user", "tie"), (202, 1, "system", "tie b"), (None, 0, "user", "nobody"), (299, 0, "user", "")]
    rows += [(1_000 + c, t, "user", f"same {t}") for c in range(0, 5_000, 100) for t in range(9)] + [(9_001, t, "user", f"long {t}") for t in range(3_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("key", "part", "weight", "depth")}).repartition(4)
    turns = trie.encoded_turns(df)
    got = {(r.conv_id, r.depth): tuple(r)[2:] for r in trie.prefix_trie(trie.shared_starts(turns), turns.select("conv_id").distinct(), local).collect()}
    short = [r for r in rows if r[0] != 9_001]
    want = plain_trie(short)
    h = zlib.crc32(b"9001") % 6
    root = next(k for k in want if k[1] == 0)
    assert len(got) == len(want) + 3_000 - h  # 9001 has nobody's start before its own rest
    for key, row in want.items():
        if key[1]:
            assert got[key] == row, key
    assert got[root][1:5] == (want[root][1] + 1, want[root][2] + 1, want[root][3] + 1, want[root][4])
    assert got[9_001, 3_000 - h] == (9_001, 1, 0, 1, 0, sha("9001"))


def test_no_conversations(spark):
    turns = trie.encoded_turns(spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string"))
    assert trie.prefix_trie(trie.shared_starts(turns), turns.select("conv_id").distinct()).collect() == []

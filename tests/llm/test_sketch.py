"""The count-min prefilter of repeated windows: its load at any size, and the way without a broadcast."""

import random

import numpy as np

from touchline.llm import substring

from . import brute


def false_pass(chars):
    """Share of single anchors that a merged sketch of a corpus of so many characters lets through."""
    rnd = np.random.default_rng(1)
    blocks = substring.sketch_blocks(chars)
    anchors = rnd.integers(0, 1 << 64, chars // 73, dtype=np.uint64)  # as many as sample texts have, of all 64 bits
    parts = [substring._counted(p, blocks) for p in np.array_split(anchors, 4)]
    bits = np.zeros(blocks * substring.DEPTH * substring.BLOCK // 8, np.uint8)
    per = len(bits) // blocks
    import pyarrow as pa

    table = pa.Table.from_batches(parts)
    for block in range(blocks):
        found = substring._merged(table.filter(pa.compute.equal(table.column("block"), block)), 2)
        bits[block * per : (block + 1) * per] = np.packbits(found, bitorder="little")
    return substring.Bits(bits, blocks)(anchors).mean()


def test_false_passes_do_not_rise_with_the_corpus():
    small, large = false_pass(40_000_000), false_pass(400_000_000)
    assert small < 0.2 and large < 0.2 and abs(small - large) < 0.05


def test_estimates_are_never_below_the_count():
    values = np.repeat(np.arange(1, 2_000, dtype=np.uint64), np.arange(1, 2_000) % 5 + 1)
    part = substring._counted(values, 1)
    counts = np.zeros(substring.DEPTH * substring.BLOCK, int)
    counts[np.frombuffer(part.column("cells")[0].as_py(), np.uint32)] = np.frombuffer(part.column("counts")[0].as_py(), np.uint8)
    estimate = np.minimum(*(counts[c] for c in substring.cells(values, 1)))
    true = (values % 5 + 1).astype(int)
    assert (estimate >= true).all() and (estimate == true).mean() > 0.95


def test_join_instead_of_broadcast(spark):
    rnd = random.Random(2)
    passages = [" ".join(f"w{rnd.randrange(900)}" for _ in range(n)) for n in (35, 36, 60, 120)]
    texts = [None, "", "one two"] + [" ".join(f"x{rnd.randrange(5_000)}" for _ in range(rnd.randrange(20, 200))) + " " + rnd.choice(passages) + f" end{i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[5])], "doc_id long, text string").repartition(3)
    found = [{r.doc_id: tuple(r)[1:] for r in substring.remove_repeats(docs, broadcast_bytes=b).collect()} for b in (0, 1 << 40)]
    want = brute.without_repeats(texts + [texts[5]])
    assert found[0] == found[1]
    assert found[1] == {**dict(enumerate(want[:-1])), None: want[-1]}

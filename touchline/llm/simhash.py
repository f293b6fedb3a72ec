"""SimHash near-duplicates: fingerprints, BK-trees over shards, components.

Two fingerprints at distance d <= 2 agree on at least two of four bit blocks, so every pair of
blocks and its value is a shard of 32 equal bits, and no link is missed.  A shard's BK-tree is built
where its rows land and travels with its shard: the trees of all shards grow with the corpus, so they
are never broadcast whole.  Children are keyed by their integer Hamming distance to the parent, and a
search follows only edges within the radius.  A shard of more than SHARD_LIMIT different fingerprints
is split by the same rule: of three parts of its other bits at least one agrees too, so each part is
a shard of its own, down to groups that hold at most 512 fingerprints.

The pipeline's stage, deduplicate(), is held to Jaccard similarity 0.8 of 5-word shingles instead.
Such pairs differ in too many bits for blocks to bring them together, so its shards are keyed by
several least hash values each; their BK-trees are searched with a wide radius, and what they
propose is checked exactly, large groups of candidates in pairs of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, staged, word_chunks
from .components import connected_components
from .minhash import OnePermutation

RADIUS = 2
#: Blocks of 16 bits. Shards of more members than this are split further, or left whole where the stage below checks exactly.
BLOCKS, SHARD_LIMIT = 4, 1_024
CROWDED = 192
#: Least bits outside of a shard's key that are still split: 2**9 fingerprints at most are left together.
LEAST_FREE = 10
#: The exact check's blocks: texts, and code points of their texts, that a block holds on average at most.
BLOCK_TEXTS, BLOCK_CHARS = 1_024, 16_000_000
#: The pair number of a group that is one block.
ONE_BLOCK = -1
#: Stands in for the id of fingerprints that only rows without an id have.
NO_ID = 1 << 62

#: The pipeline's stage: words of a shingle; keys of a text and hash values of each. A pair of similarity
#: 0.8 shares no key with a chance of (1 - 0.8**5)**32 = 3e-6.
SHINGLE, BANDS, BAND_ROWS = 5, 32, 5
#: A pair of similarity 0.8 differs in about 10 of 64 bits, in 12 where the sets are tiny; this is over four deviations more.
WIDE_RADIUS = 26


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the word shingles of one text; 0 without words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    counts, total, held = np.zeros(64, np.int64), 0, []
    for words in word_chunks((text or "").encode("utf-8", "surrogatepass").lower()):
        words = held + words
        if len(words) >= shingle:
            line = b" ".join(words)
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(lengths + 1) - 1
            starts = ends - lengths
            values = np.array([digest(line[i:j], seed) for i, j in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())], "<u8")
            for at in range(0, len(values), 65536):
                bits = np.unpackbits(values[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                counts += bits.sum(axis=0, dtype=np.int64)
            total += len(values)
            words = words[len(words) - shingle + 1 :]
        held = words
    if not total and held:
        return digest(b" ".join(held), seed)
    return int(sum(1 << int(i) for i in np.nonzero(counts * 2 > total)[0]))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) with the 64 bits as a signed long; null and wordless texts get 0."""

    def run(batches):
        for batch in batches:
            values = np.array([simhash(t, shingle, seed) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Burkhard-Keller tree over integers under Hamming distance."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None

    def add(self, value: int, item) -> None:
        if self.root is None:
            self.root = (value, item, {})
            return
        node = self.root
        while True:
            distance = (node[0] ^ value).bit_count()
            child = node[2].get(distance)
            if child is None:
                node[2][distance] = (value, item, {})
                return
            node = child

    def search(self, value: int, radius: int):
        """Items within radius; only edges labelled distance - radius to distance + radius are followed."""
        stack = [self.root] if self.root else []
        while stack:
            node_value, item, children = stack.pop()
            distance = (node_value ^ value).bit_count()
            if distance <= radius:
                yield item
            for label in range(distance - radius, distance + radius + 1):
                child = children.get(label)
                if child is not None:
                    stack.append(child)


def _shard_links(members: list, radius: int):
    """Edges of a spanning forest of one shard's link graph. members: (fingerprint, representative)."""
    tree, parent = BKTree(), {}

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for value, item in members:
        parent[item] = item
        for other in tree.search(value, radius):
            x, y = top(item), top(other)
            if x != y:
                parent[max(x, y)] = min(x, y)
                yield item, other
        tree.add(value, item)


def _tree_edges(batches):
    shard, members = None, []
    for batch in batches:
        out = []
        for plan, key, value, item in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (plan, key) != shard:
                out += _shard_links(members, RADIUS)
                shard, members = (plan, key), []
            members.append((value & 0xFFFFFFFFFFFFFFFF, item))
        yield _edge_batch(out)
    yield _edge_batch(list(_shard_links(members, RADIUS)))


def _edge_batch(pairs):
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _thirds(bits: tuple) -> list:
    """Bit positions in three runs of about equal length."""
    cut = [len(bits) * i // 3 for i in range(4)]
    return [bits[i:j] for i, j in zip(cut, cut[1:])]


def _mask(bits) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def _keyed(rows: DataFrame, level: int, fixed: list) -> DataFrame:
    """(plan, shard, fp, rep): each row once for each set of bits in fixed[level], plan its number, shard the row's bits there."""
    keys = [F.struct(F.lit(i).alias("plan"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("shard")) for i, bits in enumerate(fixed)]
    if level == 0:
        return rows.select(F.explode(F.array(*keys)).alias("k"), "fp", "rep").select("k.plan", "k.shard", "fp", "rep")
    # A row of plan p goes on under the three plans that split p.
    own = F.slice(F.array(*keys), F.col("plan") * 3 + 1, F.lit(3))
    return rows.select(F.explode(own).alias("k"), "fp", "rep").select("k.plan", "k.shard", "fp", "rep")


def link_fingerprints(distinct: DataFrame) -> DataFrame:
    """distinct(fp, rep) -> edges(a, b) between representatives; spans every link at distance <= 2."""
    width = 64 // BLOCKS
    blocks = [tuple(range(i * width, (i + 1) * width)) for i in range(BLOCKS)]
    fixed = [a + b for i, a in enumerate(blocks) for b in blocks[i + 1 :]]
    rows, level, edges = distinct, 0, None
    while True:
        keyed = staged(_keyed(rows, level, fixed), "keyed")
        sizes = keyed.groupBy("plan", "shard").agg(F.count("*").alias("members")).where("members > 1")
        sizes = staged(sizes, "shards")
        splits = 64 - len(fixed[0]) >= LEAST_FREE and sizes.where(F.col("members") > SHARD_LIMIT).limit(1).count() > 0
        small = keyed.join(sizes.where(F.col("members") <= SHARD_LIMIT) if splits else sizes, ["plan", "shard"]).select("plan", "shard", "fp", "rep")
        found = small.repartition("plan", "shard").sortWithinPartitions("plan", "shard", "rep").mapInArrow(_tree_edges, "a long, b long")
        edges = found if edges is None else edges.union(found)
        if not splits:
            return edges
        rows = keyed.join(sizes.where(F.col("members") > SHARD_LIMIT), ["plan", "shard"], "left_semi")
        fixed = [bits + third for bits in fixed for third in _thirds(tuple(b for b in range(64) if b not in bits))]
        level += 1


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id is the least doc_id reachable over links.  Null texts and texts without words have
    fingerprint 0 and link like others.  Rows without an id take part in links; a component of only
    such rows has a null component_id.  Repeated rows give repeated results.
    """
    prints = staged(fingerprints(docs, id_col, text_col), "prints")
    distinct = staged(prints.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID) + F.pmod(F.col("fp"), F.lit(1 << 61))).alias("rep")), "fps")
    parts = connected_components(link_fingerprints(distinct))
    of = distinct.join(parts, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    of = staged(of.select("fp", F.when(F.col("component_id") < NO_ID, F.col("component_id")).alias("component_id")), "components")
    return prints.join(of, "fp", "left").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


class ShingleSet:
    """The stage's view of a text: its set of SHINGLE-word shingles, a SimHash of it, and shard keys."""

    def __init__(self):
        self.shingles = OnePermutation(SHINGLE).shingles
        at = np.arange(2 * BANDS * BAND_ROWS, dtype=np.uint64)
        salts = mix64(at + np.uint64(0x5EED))
        self.flip, self.times = salts[: BANDS * BAND_ROWS, None], salts[BANDS * BAND_ROWS :, None] | np.uint64(1)
        self.weights = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) & 0xFFFFFFFFFFFFFFFF for i in range(BAND_ROWS)], np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted different hashes; a text of fewer words is one shingle, one without words has none."""
        return np.unique(self.shingles((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))

    def fingerprint(self, h: np.ndarray) -> int:
        counts = np.zeros(64, np.int64)
        for at in range(0, len(h), 65536):
            counts += np.unpackbits(h[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])

    def shards(self, h: np.ndarray) -> np.ndarray:
        """BANDS keys, each of BAND_ROWS least values under hash functions of their own."""
        least = np.full(BANDS * BAND_ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
        for at in range(0, len(h), 1024):
            least = np.minimum(least, ((h[None, at : at + 1024] ^ self.flip) * self.times).min(axis=1))
        return mix64((mix64(least).reshape(BANDS, BAND_ROWS) * self.weights).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Is the Jaccard similarity of two sorted sets 0.8 or more? Two empty sets are alike."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    shared = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)) if len(a) else 0
    return 9 * shared >= 4 * (len(a) + len(b))


def alike_groups(sets: list) -> list:
    """For each set the number of the first one that it reaches over alike() links, all pairs considered.

    Sets come in by size. A group is left as soon as one link to it is found, its last successful
    member being tried first, so that a large group of near copies costs few comparisons a member.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    groups: list = []  # [member tried first, members by size]
    for x in order:
        size, met = len(sets[x]), []
        for group in groups:
            if alike(sets[group[0]], sets[x]):
                met.append(group)
                continue
            for y in reversed(group[1]):
                if 5 * len(sets[y]) < 4 * size:
                    break
                if alike(sets[y], sets[x]):
                    group[0] = y
                    met.append(group)
                    break
        if not met:
            groups.append([x, [x]])
        elif len(met) == 1:
            met[0][1].append(x)
        else:
            gone = {id(g) for g in met}
            members = sorted([y for g in met for y in g[1]] + [x], key=lambda y: len(sets[y]))
            groups = [g for g in groups if id(g) not in gone] + [[x, members]]
    first = [0] * len(sets)
    for _, members in groups:
        least = min(members)
        for y in members:
            first[y] = least
    return first


def _set_prints(batches):
    make = ShingleSet()
    for batch in batches:
        prints, shards = [], []
        for text in batch.column(2).to_pylist():
            h = make(text)
            prints.append(make.fingerprint(h))
            shards.append(make.shards(h).view(np.int64))
        keys = pa.array(np.concatenate(shards) if shards else [], pa.int64())
        offsets = pa.array(np.arange(len(shards) + 1) * BANDS, pa.int32())
        prints = pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), prints, pa.ListArray.from_arrays(offsets, keys)], ["doc_id", "key", "fp", "shards"])


def _shard_candidates(batches):
    """Edges that span each shard's pairs within WIDE_RADIUS; a crowded shard is left whole, as a star."""
    shard, members, first = None, [], None

    def close():
        return list(_shard_links(members, WIDE_RADIUS)) if len(members) > 1 else []

    for batch in batches:
        out = []
        for at, key, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if at != shard:
                out += close()
                shard, members, first = at, [], None
            if first is not None:
                out.append((key, first))
                continue
            members.append((value & 0xFFFFFFFFFFFFFFFF, key))
            if len(members) > CROWDED:
                first = members[0][1]
                out += [(other, first) for _, other in members[1:]]
                members = []
        yield _edge_batch(out)
    yield _edge_batch(close())


def _exact_components(batches):
    make, group, keys, sets = ShingleSet(), None, [], []

    def close():
        return [(keys[i], keys[j], group[1]) for i, j in enumerate(alike_groups(sets)) if i != j]

    def links(rows):
        columns = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "pair"])

    for batch in batches:
        out = []
        for at, pair, key, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (at, pair) != group:
                out += close()
                group, keys, sets = (at, pair), [], []
            keys.append(key)
            sets.append(make(text))
        yield links(out)
    yield links(close())


def _in_block_pairs(texts: DataFrame) -> DataFrame:
    """texts(component, key, text) -> (component, pair, key, text): each group's texts once for each pair of its blocks.

    A group of one block is one pair, ONE_BLOCK. Of n blocks, each two make a pair, so that any two
    texts meet in a task, and a task holds two blocks whatever the group's size.
    """
    size = texts.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("chars") / BLOCK_CHARS), F.lit(1)).cast("long")
    size = staged(size.select("component", blocks.alias("blocks")), "sizes")
    dealt = texts.join(size, "component").withColumn("own", F.pmod(F.xxhash64("key", F.lit(7)), F.col("blocks")))
    # Block i is paired with i + 1 to i + blocks - 1, going round; a block alone with itself.
    steps = F.sequence(F.least(F.lit(1).cast("long"), F.col("blocks") - 1), F.col("blocks") - 1)
    others = F.transform(steps, lambda d: F.pmod(F.col("own") + d, F.col("blocks")))
    pair = F.when(F.col("blocks") == 1, F.lit(ONE_BLOCK).cast("long")).otherwise(F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
    return dealt.withColumn("other", F.explode(others)).select("component", pair.alias("pair"), "key", "text")


def similar_components(docs: DataFrame) -> tuple:
    """(rows(doc_id, key), links(key, component)) of texts by Jaccard similarity 0.8 of 5-word shingles.

    key is a hash of the text, null as empty. links has the keys whose component is another key.
    Candidates share a shard and lie within WIDE_RADIUS bits. One copy of each text of a candidate
    group is then compared exactly: a group in one task, or where it is large, each two of its blocks
    in a task of their own, whose links are joined afterwards.
    """
    prints = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), "text").mapInArrow(_set_prints, "doc_id long, key long, fp long, shards array<long>"), "sets")
    members = prints.dropDuplicates(["key"]).select(F.explode("shards").alias("shard"), "key", "fp")
    edges = members.repartition("shard").sortWithinPartitions("shard", "key").mapInArrow(_shard_candidates, "a long, b long")
    groups = connected_components(edges)
    texts = docs.select(text_key().alias("key"), F.coalesce("text", F.lit("")).alias("text")).join(groups, F.col("key") == F.col("node"))
    texts = staged(texts.groupBy("component", "key").agg(F.first("text").alias("text")), "candidates")
    checked = _in_block_pairs(texts).repartition("component", "pair").sortWithinPartitions("component", "pair", "key")
    links = staged(checked.mapInArrow(_exact_components, "a long, b long, pair long"), "exact")
    joined = connected_components(links.where(F.col("pair") != ONE_BLOCK).select("a", "b")).where("node <> component")
    links = links.where(F.col("pair") == ONE_BLOCK).select(F.col("a").alias("key"), F.col("b").alias("component")).union(joined)
    return prints.select("doc_id", "key"), staged(links, "alike")


def text_key():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each component of documents of 5-word Jaccard similarity 0.8 or more: the first by doc_id, then text.

    Rows without an id come last in that order and are deduplicated like others, as are rows that share an id.
    """
    from pyspark.sql import Window

    rows, links = similar_components(docs)
    found = rows.join(links, "key", "left").select("key", "doc_id", F.coalesce("component", "key").alias("component"))
    best = found.groupBy("component").agg(F.min("doc_id").alias("best"))
    of = found.select("key", "component").distinct().join(best, "component")
    own = docs.select(F.struct(*docs.columns).alias("row"), text_key().alias("key"))
    held = own.join(staged(of, "kept"), "key").where(F.col("row.doc_id").cast("long").eqNullSafe(F.col("best")))
    order = Window.partitionBy("component").orderBy(F.col("row.text").asc_nulls_last())
    return held.select("row", F.row_number().over(order).alias("rank")).where("rank = 1").select("row.*")


def op1_simhash(spark, sf_dir):
    """Fingerprint and component of each document; null and wordless texts have fingerprint zero and link like others."""
    from .common import table

    found = near_duplicate_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")

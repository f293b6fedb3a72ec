"""Prefix trie of conversations: distributed MSD radix partitioning of turn ids, multikey quicksort in small buckets."""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table, unstage

#: Turns that a bucket may have to be finished in one task; a larger one is split by its next turn.
LOCAL_TURNS = 4_096
#: Characters of joined ids that are hashed at once.
ID_CHUNK = 1 << 20
NONE = hashlib.sha256(b"").hexdigest()


def encoded_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_id, chars) of each turn of conversations(conv_id, turn, role, text), staged.

    turn_id stands for a distinct (role, text); pos counts from 0 by turn (null first), then role,
    then the SHA-256 of both; a null role or text is empty; rows without a conv_id are left out.

    Turns are dealt into ranges, counted within each and shifted by the ranges before, so that a
    conversation of any length is spread over tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), key.alias("key"), F.length(text).cast("long").alias("chars"))
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("key")]
    dealt = staged(rows.repartitionByRange(n, "conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    codes = staged(dealt.groupBy("key").agg(F.first("chars").alias("chars")).withColumn("turn_id", F.monotonically_increasing_id()), "codes")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n")).select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))
    local = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)) - 1
    placed = dealt.select("conv_id", "part", "key", local.alias("local")).join(base, ["conv_id", "part"])
    out = staged(placed.join(codes, "key").select("conv_id", (F.col("base") + F.col("local")).cast("int").alias("pos"), "turn_id", "chars"), "encoded")
    unstage(dealt, codes)
    return out


def distinct_sequences(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, weight, n_turns, ends_sha256): one row per distinct sequence of turn ids, named by its least conversation.

    turns(conv_id, pos, turn_id) and convs(conv_id), which also has the conversations without turns.
    Sequences are equal if their length and two 64-bit sums over (pos, turn_id) are. weight counts a
    sequence's conversations; ends_sha256 hashes their ids, sorted as numbers and comma-joined.

    Ids of one sequence are dealt into ranges too: tasks join the ids of their range into long
    strings, so that what is hashed in a row is a few strings to a sequence, not its ids.
    """
    sums = [F.expr(f"bit_xor(xxhash64(pos, turn_id, {seed}))").alias(f"s{seed}") for seed in (1, 2)]
    seen = turns.groupBy("conv_id").agg(F.count("*").cast("int").alias("n_turns"), *sums)
    every = convs.join(seen, "conv_id", "left").select("conv_id", *(F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in (("n_turns", "int"), ("s1", "long"), ("s2", "long"))))
    every = staged(every, "sequences")
    same = ["n_turns", "s1", "s2"]
    classes = staged(every.groupBy(*same).agg(F.min("conv_id").alias("first"), F.count("*").alias("weight")), "classes")
    n = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    members = every.join(classes, same).select("first", "conv_id").repartitionByRange(n, "first", "conv_id").sortWithinPartitions("first", "conv_id")
    joined = staged(members.mapInArrow(_joined_ids, "first long, least long, ids string"), "ids")
    hashed = joined.repartition(n, "first").sortWithinPartitions("first", "least").mapInArrow(_hashed_ids, "first long, ends_sha256 string")
    out = staged(classes.select("first", "weight", "n_turns").join(hashed, "first").withColumnRenamed("first", "conv_id"), "distinct")
    unstage(every, classes, joined)
    return out


def _joined_ids(batches):
    """Sorted (first, conv_id) rows to comma-joined ids of about ID_CHUNK characters."""
    held: tuple | None = None
    for batch in batches:
        out = []
        for first, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held and (held[0] != first or held[3] >= ID_CHUNK):
                out.append((held[0], held[1], ",".join(held[2])))
                held = None
            if held is None:
                held = (first, conv, [], 0)
            held[2].append(str(conv))
            held = (*held[:3], held[3] + len(held[2][-1]) + 1)
        if out:
            yield _columns(out, ["first", "least", "ids"], [pa.int64(), pa.int64(), pa.string()])
    if held:
        yield _columns([(held[0], held[1], ",".join(held[2]))], ["first", "least", "ids"], [pa.int64(), pa.int64(), pa.string()])


def _hashed_ids(batches):
    """SHA-256 of each first's strings, joined by commas in order of their least id."""
    at, state = None, None
    for batch in batches:
        out = []
        for first, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if first != at:
                if state:
                    out.append((at, state.hexdigest()))
                at, state = first, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if out:
            yield _columns(out, ["first", "ends_sha256"], [pa.int64(), pa.string()])
    if state:
        yield _columns([(at, state.hexdigest())], ["first", "ends_sha256"], [pa.int64(), pa.string()])


def _columns(rows: list, names: list, types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


_NODE_NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "chars", "n_children", "n_leaves", "saved", "ended"]
_NODE_TYPES = [pa.int64(), pa.int32(), *[pa.int64()] * 7]
#: ended is the name of the sequence that ends at the node, null if none does.
NODES = "conv_id long, depth int, parent_conv_id long, n_convs long, chars long, n_children long, n_leaves long, saved long, ended long"


def sorted_nodes(sequences: list, weights: list, convs: list, chars: list, depth: int, parent: int | None) -> list:
    """Rows of NODES of a bucket whose sequences share their first `depth` turns, its own node first.

    sequences: distinct turn id lists from `depth` on; chars: their code points, aligned.  Multikey
    quicksort: a range of sequences is split into those whose next id is less than, equal to and
    greater than a pivot's; an equal range is a child node, sorted on from its next turn.  Totals
    are summed as nodes end, children before parents; no recursion, so depth is unbounded.
    """
    order = list(range(len(sequences)))
    length = [len(s) for s in sequences]
    nodes: list = []  # [conv, depth, parent's index, n_convs, chars, children, leaves, saved, ended]

    def opened(lo, hi, at, above):
        """A node for order[lo:hi], which share `at` turns beyond depth; -> its index."""
        own = order[lo:hi]
        mine = chars[own[0]][at - 1] if at else 0
        nodes.append([min(convs[i] for i in own), depth + at, above, sum(weights[i] for i in own), mine, 0, 0, 0, None])
        return len(nodes) - 1

    todo = [(0, len(order), 0, opened(0, len(order), 0, -1))]
    while todo:
        lo, hi, at, node = todo.pop()
        if hi - lo == 1:  # a chain of nodes of its own
            i = order[lo]
            for k in range(at + 1, length[i] + 1):
                node = opened(lo, hi, k, node)
            nodes[node][8] = convs[i]
            continue
        ended = [i for i in order[lo:hi] if length[i] == at]
        if ended:  # goes first; it is one at most, as sequences are distinct
            order[lo:hi] = ended + [i for i in order[lo:hi] if length[i] != at]
            lo += len(ended)
            nodes[node][8] = convs[ended[0]]
        ranges = [(lo, hi)]
        while ranges:
            a, b = ranges.pop()
            if a >= b:
                continue
            pivot = sequences[order[(a + b) // 2]][at]
            less, same, more = [], [], []
            for i in order[a:b]:
                x = sequences[i][at]
                (less if x < pivot else more if x > pivot else same).append(i)
            order[a:b] = less + same + more
            m, e = a + len(less), a + len(less) + len(same)
            ranges += [(a, m), (e, b)]
            todo.append((m, e, at + 1, opened(m, e, at + 1, node)))
    for x in reversed(nodes):
        x[6] = x[6] or 1
        x[7] += (x[3] - 1) * x[4]
        if x[2] >= 0:
            above = nodes[x[2]]
            above[5] += 1
            above[6] += x[6]
            above[7] += x[7]
    return [(x[0], x[1], parent if x[2] < 0 else nodes[x[2]][0], *x[3:]) for x in nodes]


def _finished(batches):
    """Nodes of each bucket: rows (bucket, depth, parent, chars_at, conv_id, weight, pos, turn_id, chars), sorted by bucket, conv_id and pos."""
    at, rows = None, []

    def done():
        bucket, depth, parent, own = at
        seqs, weights, convs, chars = [], [], [], []
        for conv, weight, turn_id, n in rows:
            if not convs or convs[-1] != conv:
                convs.append(conv)
                weights.append(weight)
                seqs.append([])
                chars.append([])
            if turn_id is not None:
                seqs[-1].append(turn_id)
                chars[-1].append(n)
        found = sorted_nodes(seqs, weights, convs, chars, depth, parent)
        top = list(found[0])
        top[4] = own  # the bucket's last turn is not among its rows
        top[7] += (top[3] - 1) * own
        return [tuple(top), *found[1:]]

    for batch in batches:
        out = []
        for bucket, depth, parent, own, conv, weight, turn_id, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "depth", "parent_conv_id", "own", "conv_id", "weight", "turn_id", "chars"))):
            if at is None or at[:2] != (bucket, depth):
                if at is not None:
                    out += done()
                at, rows = (bucket, depth, parent, own), []
            rows.append((conv, weight, turn_id, n))
        for i in range(0, len(out), 20_000):
            yield _columns(out[i : i + 20_000], _NODE_NAMES, _NODE_TYPES)
    if at is not None:
        yield _columns(done(), _NODE_NAMES, _NODE_TYPES)


def prefix_trie(turns: DataFrame, convs: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """The trie of the conversations' turns: a row for each distinct sequence of first turns, the empty one included.

    turns(conv_id, pos, turn_id, chars) with pos from 0 without gaps, convs(conv_id) distinct and
    not null.  Columns: conv_id (least member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, as the query below says.  Without
    conversations there is no node, not even a root.

    Equal conversations are one sequence with a weight.  Then each round splits every bucket, the
    sequences that share their turns so far, by the next turn id.  A child of one sequence goes on
    as a chain, a row per turn; one of local_turns turns or fewer is finished in a task by
    multikey quicksort; larger ones go into the next round.  So a first turn that a third of all
    conversations share costs rounds, not a large task.  Totals are then summed from the deepest
    round up.  A node is keyed by its least member and depth, as a conversation has one node at each.
    """
    distinct = distinct_sequences(turns, convs)
    seqs = staged(turns.join(distinct.select("conv_id", "weight", "n_turns"), "conv_id"), "trie-turns")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    # A level's buckets: their node (conv_id, depth), parent, members' count and last turn's length; kind says how they go on.
    kind = F.when(F.col("n_seqs") == 1, "chain").when(F.col("left") <= local_turns, "local").otherwise("open")
    top = distinct.agg(F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count("*").alias("n_seqs"), F.sum("n_turns").alias("left")).where("conv_id IS NOT NULL")
    level = staged(top.select("conv_id", F.lit(0).alias("depth"), none.alias("parent_conv_id"), "n_convs", zero.alias("chars"), kind.alias("kind")), "level0")
    root = level.first()
    open_seqs = distinct.select("conv_id", "weight", "n_turns", *(F.lit(root[c] if root else None).cast(t).alias(n) for c, t, n in (("conv_id", "long", "bucket"), ("kind", "string", "kind"))))
    levels, finished, stops, depth = [level], [], [], 0
    while True:
        finished.append(_ends(open_seqs, level, seqs, depth))
        going = open_seqs.where("kind = 'open'").select("conv_id", "weight", "n_turns", "bucket")
        if going.isEmpty():
            break
        stops.append(staged(going.where(F.col("n_turns") == depth).select(F.col("bucket").alias("conv_id"), F.col("conv_id").alias("ended")), "stops"))
        step = staged(going.where(F.col("n_turns") > depth).join(seqs.where(F.col("pos") == depth).select("conv_id", "turn_id", "chars"), "conv_id"), "step")
        children = step.groupBy("bucket", "turn_id").agg(
            F.min("conv_id").alias("child"), F.sum("weight").alias("n_convs"), F.count("*").alias("n_seqs"), F.sum(F.col("n_turns") - depth - 1).alias("left"), F.first("chars").alias("chars")
        )
        depth += 1
        children = staged(children.withColumn("kind", kind), "children")
        level = staged(children.select(F.col("child").alias("conv_id"), F.lit(depth).alias("depth"), F.col("bucket").alias("parent_conv_id"), "n_convs", "chars", "kind"), f"level{depth}")
        levels.append(level)
        named = children.select("bucket", "turn_id", "child", "kind")
        open_seqs = staged(step.join(named, ["bucket", "turn_id"]).select("conv_id", "weight", "n_turns", F.col("child").alias("bucket"), "kind"), "open")
        unstage(step, children)
    below = None
    nodes = []
    for at in reversed(range(len(levels))):
        ends = finished[at]
        tops = ends.where(F.col("depth") == at)
        own = levels[at].where("kind = 'open'").select("conv_id", "depth", "parent_conv_id", "n_convs", "chars")
        if below is not None:
            sums = below.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
            own = own.join(sums, "conv_id").join(stops[at], "conv_id", "left").withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("chars"))
            upper = staged(own.select(*_NODE_NAMES), "upper")
            nodes.append(upper)
            below = tops.select(*_NODE_NAMES).union(upper)
        else:
            below = tops.select(*_NODE_NAMES)
        nodes.append(ends)
    found = reduce(DataFrame.unionByName, nodes)
    return found.join(distinct.select(F.col("conv_id").alias("ended"), "ends_sha256"), "ended", "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256")
    )


def _ends(open_seqs: DataFrame, level: DataFrame, seqs: DataFrame, depth: int) -> DataFrame:
    """NODES of the buckets of a level that end there: chains as rows, local buckets by multikey quicksort."""
    one = F.lit(1).cast("long")
    chain = level.where("kind = 'chain'").join(open_seqs.where("kind = 'chain'").select("conv_id", "weight", "n_turns"), "conv_id")
    more = lambda has: F.when(has, 1).otherwise(0).cast("long")
    saved = (F.col("weight") - 1) * F.col("chars")
    rest = chain.select("conv_id", "weight", "n_turns").join(seqs.where(F.col("pos") >= depth).select("conv_id", "pos", "chars"), "conv_id")
    # A chain of one conversation saves nothing, however long it is; that of several sums over its rest, from the end.
    onward = Window.partitionBy("conv_id").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rest = rest.where("weight = 1").withColumn("saved", F.lit(0).cast("long")).union(rest.where("weight > 1").withColumn("saved", F.sum(saved).over(onward)))
    tops = chain.join(rest.where(F.col("pos") == depth).select("conv_id", F.col("saved").alias("onward")), "conv_id", "left")
    tops = tops.select("conv_id", "depth", "parent_conv_id", "n_convs", "chars", more(F.col("n_turns") > depth).alias("n_children"), one.alias("n_leaves"), (F.coalesce("onward", F.lit(0).cast("long")) + saved).alias("saved"), F.when(F.col("n_turns") == depth, F.col("conv_id")).alias("ended"))
    lower = rest.select("conv_id", (F.col("pos") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("weight").alias("n_convs"), "chars", more(F.col("n_turns") > F.col("pos") + 1).alias("n_children"), one.alias("n_leaves"), "saved", F.when(F.col("n_turns") == F.col("pos") + 1, F.col("conv_id")).alias("ended"))
    buckets = level.where("kind = 'local'").select(F.col("conv_id").alias("bucket"), "depth", "parent_conv_id", F.col("chars").alias("own"))
    rows = open_seqs.where("kind = 'local'").select("conv_id", "weight", "bucket").join(buckets, "bucket")
    rows = rows.join(seqs.where(F.col("pos") >= depth).select("conv_id", "pos", "turn_id", "chars"), "conv_id", "left")
    n = max(int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    local = rows.repartition(n, "bucket").sortWithinPartitions("bucket", "conv_id", "pos").mapInArrow(_finished, NODES)
    return staged(tops.union(lower).union(local), "nodes")


def shared_starts(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, pos, turn_id, chars) of conversations rebuilt on the start of their group's first one, staged.

    Conversation c gets the first h turns of conversation c - c % group (all if fewer, none if there
    is none) before its own turns after its first h; h is the unsigned crc32 of decimal c, modulo most.
    """
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.pmod(F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")), F.lit(most)).cast("int")
    plan = convs.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("of"))
    plan = plan.join(convs.select(F.col("conv_id").alias("of"), F.col("n").alias("had")), "of", "left").withColumn("given", F.least("h", F.coalesce("had", F.lit(0))).cast("int"))
    plan = staged(plan, "starts")
    first = turns.where(F.col("pos") < most).select(F.col("conv_id").alias("of"), "pos", "turn_id", "chars")
    start = plan.where("given > 0").join(first, "of").where("pos < given").select("conv_id", "pos", "turn_id", "chars")
    own = turns.join(plan.select("conv_id", "h", "given"), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "turn_id", "chars")
    out = staged(start.union(own), "rebuilt")
    unstage(plan)
    return out


def op13_trie(spark, sf_dir):
    """The prefix trie of all conversations, each rebuilt on the start of its hundred's first.

    A node is a distinct sequence of first turns (role, text); its members are the conversations
    that start with it; saved_tokens sums, over a node's subtree, the code points of each node's
    last text for every member but one.  Nulls, ties and repeated rows: as encoded_turns() says.
    """
    turns = encoded_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    convs = staged(turns.select("conv_id").distinct(), "convs")
    return prefix_trie(shared_starts(turns), convs)


OP13_SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos,
  {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 100 AS of,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda a, b:
    list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 6 AS h FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, c.h, least(c.h, coalesce(o.n, 0)) AS given, c.of FROM c LEFT JOIN c o ON o.conv_id = c.of),
b AS (SELECT r.conv_id, t.pos, t.turn FROM r JOIN t ON t.conv_id = r.of AND t.pos < r.given
  UNION ALL SELECT r.conv_id, t.pos - r.h + r.given, t.turn FROM r JOIN t ON t.conv_id = r.conv_id AND t.pos >= r.h),
s AS (SELECT r.conv_id, coalesce(list(b.turn ORDER BY b.pos) FILTER (WHERE b.pos IS NOT NULL), []) AS turns FROM r LEFT JOIN b USING (conv_id) GROUP BY r.conv_id),
p AS (SELECT conv_id, d AS depth, turns[1:d] AS prefix, len(turns) = d AS ends FROM s, unnest(range(0, len(turns) + 1)) u(d)),
n AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY depth, prefix),
k AS (SELECT depth - 1 AS depth, prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN n.depth > 0 THEN (n.n_convs - 1) * length(n.prefix[n.depth].text) ELSE 0 END AS own FROM n LEFT JOIN k USING (depth, prefix)),
a AS (SELECT m.prefix, m.n_children, m.own, unnest(range(0, m.depth + 1)) AS up FROM m),
u AS (SELECT up AS depth, prefix[1:up] AS prefix, sum((n_children = 0)::INT) AS n_leaves, sum(own) AS saved_tokens FROM a GROUP BY ALL)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN u USING (depth, prefix) LEFT JOIN n q ON q.depth = m.depth - 1 AND q.prefix = m.prefix[1:m.depth - 1]
"""

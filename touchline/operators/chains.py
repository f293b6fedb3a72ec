"""Camera chains: homographies carried from anchors by products of frame-to-frame steps, merged, filled into gaps; choice of anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps that are multiplied in one row, before blocks are.
BLOCK = 32
#: Drift and frames over which confidence falls to 1/e, weight of the perspective in a step's drift, inliers where unknown.
DRIFT_SCALE, FRAME_SCALE, PERSPECTIVE_DRIFT, UNKNOWN_INLIERS = 100.0, 100.0, 1_000.0, 0.5
#: Thresholds that are tried after the asked one.
FALLING = (0.4, 0.3, 0.2, 0.1, 0.0)


def _product(a: Column, b: Column) -> Column:
    """a b of 3 x 3 matrices as arrays of nine, row by row."""
    at = lambda m, i, j: F.get(m, F.lit(3 * i + j))
    return F.array(*(at(a, i, 0) * at(b, 0, j) + at(a, i, 1) * at(b, 1, j) + at(a, i, 2) * at(b, 2, j) for i in range(3) for j in range(3)))


def unit_determinant(h: Column) -> Column:
    """h over the cube root of its determinant, as it is where that is next to nothing."""
    e = [F.get(h, F.lit(i)) for i in range(9)]
    det = e[0] * (e[4] * e[8] - e[5] * e[7]) - e[1] * (e[3] * e[8] - e[5] * e[6]) + e[2] * (e[3] * e[7] - e[4] * e[6])
    scale = F.signum(det) * F.pow(F.abs(det), F.lit(1.0 / 3.0))
    return F.when(F.abs(det) > 1e-6, F.transform(h, lambda v: v / scale)).otherwise(h)


def prefix_products(rows: DataFrame, keys: list, n: str, matrix: str) -> DataFrame:
    """rows with `product`: the matrices of the group so far, later ones to the left; n counts a group's rows from 0 without gaps.

    A scan in blocks: each block's running products, then those of the blocks' totals, found the
    same way, from which each block goes on. So a group of any length is spread over blocks.
    """
    own = rows.select(*keys, F.col(n).cast("long").alias("_n"), F.col(matrix).alias("_m"), F.floor(F.col(n) / BLOCK).cast("long").alias("_b"))
    blocks = own.groupBy(*keys, "_b").agg(F.sort_array(F.collect_list(F.struct("_n", "_m"))).alias("_rows"))
    step = lambda acc, r: F.array_append(acc, F.struct(r["_n"].alias("_n"), F.when(F.size(acc) == 0, r["_m"]).otherwise(_product(r["_m"], F.element_at(acc, -1)["_m"])).alias("_m")))
    blocks = blocks.select(*keys, "_b", F.aggregate("_rows", F.slice("_rows", 1, 0), step).alias("_rows"))
    if (blocks.agg(F.max("_b")).first()[0] or 0) > 0:
        totals = prefix_products(blocks.select(*keys, "_b", F.element_at("_rows", -1)["_m"].alias("_t")), keys, "_b", "_t")
        before = totals.select(*keys, (F.col("_b") + 1).alias("_b"), F.col("product").alias("_before"))
        blocks = blocks.join(before, [*keys, "_b"], "left")
    else:
        blocks = blocks.withColumn("_before", F.lit(None).cast("array<double>"))
    flat = blocks.select(*keys, "_before", F.explode("_rows").alias("_r"))
    products = flat.select(*keys, F.col("_r._n").alias("_n"), F.when(F.col("_before").isNull(), F.col("_r._m")).otherwise(_product(F.col("_r._m"), F.col("_before"))).alias("product"))
    return rows.join(products.withColumnRenamed("_n", n), [*keys, n])


def propagated(anchors: DataFrame, steps: DataFrame, backward: bool = False) -> DataFrame:
    """run_id, frame, anchor_frame, n, h, drift, confidence: each frame's homography from the anchor before it, or after it if backward.

    anchors(run_id, frame, h), h nine entries from the field to the image; steps(run_id, frame, h,
    inlier_ratio): h takes points of the frame gone through before to this one, in the direction of the
    chain. Anchors start anew; frames without an anchor to come from have no row, nor have anchors.
    Steps are scaled to a determinant of 1, products to a last entry of 1. Drift adds up each step's
    shift and a thousand times its perspective; confidence is the inliers' share, falling with drift and n.
    """
    order = F.desc("frame") if backward else F.asc("frame")
    w = Window.partitionBy("run_id").orderBy(order)
    marks = steps.select("run_id", "frame", F.col("h").alias("step"), "inlier_ratio").join(anchors.select("run_id", "frame", F.col("h").alias("anchor_h")), ["run_id", "frame"], "full")
    marks = marks.withColumn("from", F.last(F.when(F.col("anchor_h").isNotNull(), F.struct("frame", "anchor_h")), ignorenulls=True).over(w)).where("from IS NOT NULL AND anchor_h IS NULL")
    rows = marks.select("run_id", F.col("from.frame").alias("anchor_frame"), "frame", F.col("from.anchor_h").alias("anchor_h"), "step", "inlier_ratio", unit_determinant(F.col("step")).alias("unit"))
    own = Window.partitionBy("run_id", "anchor_frame").orderBy(order)
    e = lambda i: F.get("step", F.lit(i))
    move = F.sqrt(e(2) * e(2) + e(5) * e(5)) + F.sqrt(e(6) * e(6) + e(7) * e(7)) * PERSPECTIVE_DRIFT
    rows = rows.withColumns({"n": F.row_number().over(own) - 1, "drift": F.sum(move).over(own)})
    found = prefix_products(rows, ["run_id", "anchor_frame"], "n", "unit").withColumn("h", _product(F.col("product"), F.col("anchor_h")))
    n = F.col("n") + 1
    sure = F.coalesce("inlier_ratio", F.lit(UNKNOWN_INLIERS)) * F.exp(-F.col("drift") / DRIFT_SCALE) * F.exp(-n / FRAME_SCALE)
    return found.select("run_id", "frame", "anchor_frame", n.cast("long").alias("n"), F.transform("h", lambda v: v / F.get("h", F.lit(8))).alias("h"), "drift", sure.alias("confidence"))


def merged_chains(anchors: DataFrame, forward: DataFrame, backward: DataFrame) -> DataFrame:
    """run_id, frame, h, confidence, source, left_anchor, right_anchor: anchors first, then what only one direction reaches, else both.

    Where both do, the anchors' homographies are blended by the inverse distance, one added, and
    scaled to a last entry of 1, as are the confidences. anchors have a confidence too.
    """
    own = anchors.select("run_id", "frame", "h", "confidence", F.lit("anchor").alias("source"), F.col("frame").alias("left_anchor"), F.col("frame").alias("right_anchor"))
    side = lambda df, s: df.select("run_id", "frame", F.struct("h", "confidence", F.col("anchor_frame").alias("anchor")).alias(s))
    both = side(forward, "f").join(side(backward, "b"), ["run_id", "frame"], "full").join(own.select("run_id", "frame"), ["run_id", "frame"], "left_anti")
    mark = lambda s: anchors.select("run_id", F.col("frame").alias(f"{s}_anchor"), F.col("h").alias(f"{s}_h"))
    both = both.withColumns({"left_anchor": F.col("f.anchor"), "right_anchor": F.col("b.anchor")}).join(mark("left"), ["run_id", "left_anchor"], "left").join(mark("right"), ["run_id", "right_anchor"], "left")
    near = lambda c: 1.0 / (F.abs(F.col("frame") - F.col(c)) + 1)
    share = near("left_anchor") / (near("left_anchor") + near("right_anchor"))
    mixed = F.zip_with("left_h", "right_h", lambda a, b: F.col("_w") * a + (1 - F.col("_w")) * b)
    both = both.withColumn("_w", share).withColumn("_mixed", mixed)
    two = F.col("f").isNotNull() & F.col("b").isNotNull()
    found = both.select(
        "run_id", "frame", F.when(two, F.transform("_mixed", lambda v: v / F.get("_mixed", F.lit(8)))).otherwise(F.coalesce("f.h", "b.h")).alias("h"),
        F.when(two, F.col("_w") * F.col("f.confidence") + (1 - F.col("_w")) * F.col("b.confidence")).otherwise(F.coalesce("f.confidence", "b.confidence")).alias("confidence"),
        F.when(two, "merged").when(F.col("f").isNotNull(), "forward").otherwise("backward").alias("source"), "left_anchor", "right_anchor",
    )
    return own.union(found)


def filled_gaps(sampled: DataFrame, anchors: DataFrame, chain: DataFrame, max_gap: int | None = None) -> DataFrame:
    """run_id, frame, h, confidence, source, left_anchor, right_anchor, interpolated: anchors among the sampled frames, and what the chain gives between them.

    sampled(run_id, frame); chain as merged_chains() gives. A gap between two anchors wider than max_gap
    stays empty; one open to a side is filled up to max_gap from its anchor. Anchors are never overwritten.
    """
    w = Window.partitionBy("run_id").orderBy("frame")
    known = F.when(F.col("own"), F.col("frame"))
    rows = sampled.select("run_id", "frame").distinct().join(anchors.select("run_id", "frame", F.lit(True).alias("own")), ["run_id", "frame"], "left")
    rows = rows.withColumns({"left": F.last(known, True).over(w), "right": F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    if max_gap is not None:
        inner = (F.col("right") - F.col("left")) <= max_gap
        open_ = (F.col("frame") - F.coalesce("left", "right")).between(-max_gap, max_gap)
        rows = rows.where(F.col("own") | F.when(F.col("left").isNotNull() & F.col("right").isNotNull(), inner).otherwise(open_))
    return rows.join(chain, ["run_id", "frame"]).select("run_id", "frame", "h", "confidence", "source", F.col("left").alias("left_anchor"), F.col("right").alias("right_anchor"), F.col("own").isNull().alias("interpolated"))


def selected_anchors(scores: DataFrame, least: int = 2, most: int = 5, quality: float = 0.5, spacing: int = 100, edges: bool = True, edge_ratio: float = 0.1) -> DataFrame:
    """run_id, frame, quality, threshold: frames to calibrate by, best first but apart by the spacing, at the highest threshold that gives enough.

    scores(run_id, frame, quality, success). Only successful frames count; those in the first or last
    tenth of the run go first if edges. Where no threshold gives enough, the best `least` frames of the
    run, whatever their spacing, with a null threshold. Of equal ones the earlier frame goes first.
    """
    run = Window.partitionBy("run_id")
    first, last = F.min("frame").over(run), F.max("frame").over(run)
    margin = F.floor((last - first + 1) * edge_ratio)
    edge = ((F.col("frame") <= first + margin) | (F.col("frame") >= last - margin)) if edges else F.lit(False)
    rows = scores.select("run_id", "frame", "quality", "success", F.when(edge, 0).otherwise(1).alias("inner")).where("success")
    order = F.array_sort(F.collect_list(F.struct("inner", (-F.col("quality")).alias("less"), "frame", "quality")))
    lists = rows.groupBy("run_id").agg(order.alias("c"))

    def chosen(threshold):
        fit = F.filter("c", lambda s: s["quality"] >= threshold)
        free = lambda acc, s: (F.size(acc) < most) & ~F.exists(acc, lambda t: F.abs(t["frame"] - s["frame"]) < spacing)
        taken = F.aggregate(fit, F.slice("c", 1, 0), lambda acc, s: F.when(free(acc, s), F.array_append(acc, s)).otherwise(acc))
        return F.when((F.size(fit) >= least) & (F.size(taken) >= least), F.struct(taken.alias("rows"), F.lit(float(threshold)).alias("threshold")))

    best = F.slice(F.array_sort(F.transform("c", lambda s: F.struct(s["less"].alias("less"), s["frame"].alias("frame"), s["quality"].alias("quality")))), 1, least)
    tried = F.coalesce(*(chosen(t) for t in (quality, *FALLING)))
    picked = lists.select("run_id", tried.alias("t"), best.alias("best"))
    pairs = F.coalesce(F.transform("t.rows", lambda s: F.struct(s["frame"].alias("frame"), s["quality"].alias("quality"))), F.transform("best", lambda s: F.struct(s["frame"].alias("frame"), s["quality"].alias("quality"))))
    return picked.select("run_id", F.col("t.threshold").alias("threshold"), F.explode(pairs).alias("s")).select("run_id", "s.frame", "s.quality", "threshold")

"""Teams from the looks of tracks: two clusters per run by Lloyd's rounds where the run's tracks are, and who is no player of either."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

#: Least tracks of a team, weight of the place beside the look, starts, most rounds.
LEAST, PLACE_WEIGHT, STARTS, ROUNDS = 5, 0.1, 10, 100
#: Fixed values of a referee: colour against the run's median, least box height and frames, farthest from the long axis, most of them,
#: and where colour tells none: share of tracks that are nearer to their centre, and times the median distance.
DULL, LEAST_HEIGHT, LEAST_FRAMES, FARTHEST, MOST, NEARER, TIMES_MEDIAN = 0.7, 40.0, 15, 23.0, 2, 0.85, 1.5


def looks(tracks: DataFrame, use_place: bool = True, least: int = LEAST) -> DataFrame:
    """run_id, track_id, v, and tracks' other columns: the normalised feature, with the z-scored place beside it in runs where enough tracks have one.

    Then tracks without a place are left out. Runs of too few tracks have none.
    """
    other = [c for c in tracks.columns if c not in ("run_id", "track_id", "feature", "x", "v")]
    length = F.sqrt(F.aggregate("feature", F.lit(0.0), lambda acc, v: acc + v * v))
    rows = tracks.select("run_id", "track_id", "x", *other, F.transform("feature", lambda v: v / (length + 1e-8)).alias("v"))
    run, placed = Window.partitionBy("run_id"), F.col("x").isNotNull() & F.col("y").isNotNull()
    rows = rows.withColumns({"all": F.count("*").over(run), "placed": F.sum(placed.cast("int")).over(run)}).where(F.col("all") >= 2 * least)
    spread = {f"{c}_{n}": f(F.when(placed, F.col(c))).over(run) for c in ("x", "y") for n, f in (("mid", F.avg), ("dev", F.stddev_pop))}
    rows = rows.withColumns(spread).withColumn("both", (F.col("placed") >= 2 * least) & F.lit(use_place)).where(~F.col("both") | placed)
    z = lambda c: (F.col(c) - F.col(f"{c}_mid")) / F.when(F.col(f"{c}_dev") > 0, F.col(f"{c}_dev")).otherwise(1.0) * PLACE_WEIGHT
    joined = F.concat(F.transform("v", lambda v: v * (1 - PLACE_WEIGHT)), F.array(z("x"), z("y")))
    return rows.select("run_id", "track_id", F.when(F.col("both"), joined).otherwise(F.col("v")).alias("v"), *other)


def _sides(v: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label, square of the distance) of each row of v after the best start's rounds; one and two are chances of (rows, starts)."""
    square = lambda c: ((v - c) ** 2).sum(axis=1)
    best = None
    for start in range(one.shape[1]):
        first = v[one[:, start].argmin()]
        d = square(first)
        wait = np.divide(-np.log(two[:, start]), d, out=np.full(len(v), np.inf), where=d > 0)
        centres, label = [first, v[wait.argmin()] if (d > 0).any() else first], None
        for _ in range(ROUNDS):
            d0, d1 = (square(c) for c in centres)
            was, label = label, d1 < d0
            if was is not None and (was == label).all():
                break
            means = [v[side].mean(axis=0) if side.any() else None for side in (~label, label)]
            centres = [means[k] if means[k] is not None else means[1 - k] for k in (0, 1)]
        d = np.minimum(d0, d1)
        if best is None or round(d.sum(), 9) < best[0]:
            best = round(d.sum(), 9), label, d
    return best[1], best[2]


def two_means(rows: DataFrame, starts: int = STARTS) -> DataFrame:
    """run_id, track_id, label (0 or 1), distance to the centre, and rows' other columns: two clusters of each run's rows(run_id, track_id, v).

    A run's rows go through its rounds in the task that has them, so nothing is stored or moved between
    rounds: each row joins the nearer of two centres, and the means of both sides are the next ones,
    until no row changes sides. A start is a row by chance and another, the likelier the farther away
    its square; chance is a hash of track and start, so results don't change. Of a run's starts the one
    with the least sum of squares stays.
    """
    chance = lambda salt: F.transform(F.sequence(F.lit(1), F.lit(starts)), lambda start: (F.pmod(F.xxhash64("track_id", start, F.lit(salt)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1))
    kept = [c for c in rows.columns if c != "v"]
    schema = StructType([rows.schema[c] for c in kept]).add("label", IntegerType()).add("distance", DoubleType())

    def run(table):
        table = table.sort_by("track_id")
        v, one, two = (table[c].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1) for c in ("v", "one", "two"))
        label, d = _sides(v, one, two)
        return table.select(kept).append_column("label", pa.array(label.astype(np.int32))).append_column("distance", pa.array(np.sqrt(d)))

    return rows.where("v IS NOT NULL").withColumns({"one": chance(1), "two": chance(2)}).groupBy("run_id").applyInArrow(run, schema)


def team_clusters(tracks: DataFrame, use_place: bool = True, least: int = LEAST) -> DataFrame:
    """run_id, track_id, team, distance: team_A the larger cluster, team_B the other, or referee.

    tracks(run_id, track_id, feature, x, y, height, frames, saturation); all but run, track and feature
    may be null, and then hold nobody back. Up to two referees are the tracks of least colour, well
    under the run's median; where colour tells none, those farthest from their centre, if outliers.
    Low boxes, short tracks and places beyond the side never are. Of equal clusters that of the lowest track is team_A.
    """
    run, side = Window.partitionBy("run_id"), Window.partitionBy("run_id", "label")
    own = [F.col(c) for c in ("run_id", "track_id", "feature", "x", "y", "height", "frames", "saturation")]
    rows = two_means(looks(tracks.select(*own, F.median("saturation").over(run).alias("colour")), use_place, least))
    n, low = (lambda w: F.count("*").over(w)), (lambda w: F.min("track_id").over(w))
    rows = rows.withColumns({"n": n(side), "low": low(side)}).withColumns({"all": n(run), "lowest": low(run), "middle": F.median("distance").over(run), "edge": F.percentile("distance", F.lit(NEARER)).over(run)})
    larger = (F.col("n") * 2 > F.col("all")) | (F.col("n") * 2 == F.col("all")) & (F.col("low") == F.col("lowest"))
    rows = rows.withColumn("team", F.when(larger, "team_A").otherwise("team_B"))
    fit = ~(F.coalesce(F.col("height") < LEAST_HEIGHT, F.lit(False)) | F.coalesce(F.col("frames") < LEAST_FRAMES, F.lit(False)) | F.coalesce(F.abs("y") > FARTHEST, F.lit(False)))
    dull = fit & F.coalesce(F.col("saturation") < F.col("colour") * DULL, F.lit(False))
    apart = fit & (F.col("distance") > F.col("edge")) & (F.col("distance") > F.col("middle") * TIMES_MEDIAN)
    rows = rows.withColumns({"dull": dull, "any": F.max(dull).over(run), "apart": apart})
    odd = F.when(F.col("any"), F.col("dull")).otherwise(F.col("apart"))
    order = [F.when(odd, 0).otherwise(1), F.when(F.col("any"), F.col("saturation")).otherwise(-F.col("distance")), F.col("track_id")]
    rows = rows.withColumn("k", F.row_number().over(run.orderBy(*order)))
    return rows.select("run_id", "track_id", F.when(odd & (F.col("k") <= MOST), "referee").otherwise(F.col("team")).alias("team"), F.round("distance", 6).alias("distance"))

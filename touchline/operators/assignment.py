"""Minimum-cost assignment of tracks to detections, frame by frame."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The cost of a pair that may not be chosen, fixed value: dearer than any sum of allowed ones.
BARRED = 1e5


def _augmented(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a least-cost assignment of all rows; cost has at least as many columns as rows.

    Rows are added one at a time by a shortest path over reduced costs, which stay non-negative
    through a price per row and column (Jonker-Volgenant).
    """
    rows, columns = cost.shape
    row_price, price = np.zeros(rows), np.zeros(columns)
    holder, column_of = np.full(columns, -1), np.full(rows, -1)
    for new in range(rows):
        distance, came, open_ = np.full(columns, np.inf), np.full(columns, -1), np.ones(columns, bool)
        row, reach, seen_rows, at_reach = new, 0.0, [], []
        while True:
            seen_rows.append(row)
            at_reach.append(reach)
            through = reach + cost[row] - row_price[row] - price
            better = open_ & (through < distance)
            distance[better], came[better] = through[better], row
            end = int(np.argmin(np.where(open_, distance, np.inf)))
            reach = distance[end]
            open_[end] = False
            if holder[end] < 0:
                break
            row = holder[end]
        row_price[seen_rows] += reach - np.array(at_reach)
        closed = ~open_
        price[closed] -= reach - distance[closed]
        while True:
            row = came[end]
            holder[end], column_of[row], end = row, end, column_of[row]
            if row == new:
                break
    return column_of


def least_cost_pairs(cost: np.ndarray, limit: float, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the assignment with the most allowed pairs and, of those, the least sum; each costs less than limit.

    Pairs of limit or more, or not allowed, are barred before the choice, so that a good pair is
    never given up for a chain of bad ones.
    """
    fit = cost < limit if allowed is None else (cost < limit) & allowed
    r, c = np.nonzero(fit.any(axis=1))[0], np.nonzero(fit.any(axis=0))[0]
    if not len(r):
        return r, c[:0]
    part = np.where(fit, cost, BARRED)
    if part.shape != (len(r), len(c)):
        part = part[r[:, None], c]
    first = part.argmin(axis=1)
    if np.bincount(first).max() == 1:  # everyone's best is free
        return r, c[first]
    flip = len(r) > len(c)
    chosen = _augmented(part.T if flip else part)
    rows, columns = (chosen, np.arange(len(c))) if flip else (np.arange(len(r)), chosen)
    good = part[rows, columns] < limit
    order = np.argsort(rows[good])
    return r[rows[good][order]], c[columns[good][order]]


def _lone(frame: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether a row is the only one of its frame and key."""
    own = np.unique(key, return_inverse=True)[1]
    _, at, n = np.unique(frame * (own.max() + 1) + own, return_inverse=True, return_counts=True)
    return n[at] == 1


def assignments(pairs: DataFrame, cost: str, limit: float) -> DataFrame:
    """run_id, frame, track_id, ord, cost: the least-cost assignment of each frame.

    pairs(run_id, frame, track_id, ord, <cost>, allowed) has a row per candidate pair, as pair_costs()
    gives; pairs of limit or more, without a cost or not allowed are never chosen.
    """

    names = ["run_id", "frame", "track_id", "ord", "cost"]

    def whole_frames(batches):
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            run_id, frame = (part.column(c).to_numpy() for c in names[:2])
            cuts = np.nonzero((np.diff(run_id) != 0) | (np.diff(frame) != 0))[0] + 1
            if len(cuts):
                yield part.slice(0, cuts[-1])
            held = part.slice(cuts[-1]) if len(cuts) else part
        if held is not None and held.num_rows:
            yield held

    def run(batches):
        for rows in whole_frames(batches):
            run_id, frame, track, ord_, value = (rows.column(c).to_numpy() for c in names)
            of_frame = np.cumsum(np.concatenate([[0], (np.diff(run_id) != 0) | (np.diff(frame) != 0)]))
            alone = _lone(of_frame, track) & _lone(of_frame, ord_)
            # Who has one partner that has no other is always given it; only the rest is weighed, frame by frame.
            chosen = [np.nonzero(alone)[0]]
            rest = np.nonzero(~alone)[0]
            for at in np.split(rest, np.nonzero(np.diff(of_frame[rest]))[0] + 1) if len(rest) else ():
                tracks, t = np.unique(track[at], return_inverse=True)
                ords, d = np.unique(ord_[at], return_inverse=True)
                matrix, place = np.full((len(tracks), len(ords)), BARRED), np.zeros((len(tracks), len(ords)), np.int64)
                matrix[t, d], place[t, d] = value[at], at
                chosen.append(place[least_cost_pairs(matrix, limit)])
            yield rows.take(np.sort(np.concatenate(chosen))).combine_chunks().to_batches()[0]

    # A pair of limit or more is never chosen, so it needn't be moved.
    picked = pairs.where(F.col("allowed") & (F.col(cost) < limit)).select("run_id", "frame", F.col("track_id").cast("long").alias("track_id"), F.col("ord").cast("long").alias("ord"), F.col(cost).cast("double").alias("cost"))
    return picked.repartition("run_id", "frame").sortWithinPartitions("run_id", "frame").mapInArrow(run, "run_id long, frame long, track_id long, ord long, cost double")

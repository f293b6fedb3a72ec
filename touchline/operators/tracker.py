"""Multi-object tracking: each run's frames in order, with box filters, appearance and a four-stage match.

A task's runs go through their frames side by side: rows are sorted by the frames since their run's
first and read batch by batch. What is carried from frame to frame is the state of the living tracks,
and the numbers of the frames yet to come where they are given, so rows in memory don't grow with a run's length.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass, fields, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .assignment import BARRED, least_cost_pairs


@dataclass(frozen=True)
class TrackerPreset:
    """Fixed values of the tracker; distances in metres, ages in processed frames."""

    max_age: int = 30
    n_init: int = 3
    max_iou_distance: float = 0.7
    max_iou_distance_tentative: float = 0.7
    max_cosine_distance: float = 0.3
    feature_alpha: float = 0.9
    kept_features: int = 100
    pitch_gate: float = 4.0
    reid_iou_min: float = 0.1
    reid_pitch_max: float = 1.5
    absolute_max: float = 8.0
    frame_interval: float = 1.0
    width: int = 1920
    height: int = 1080


class BoxFilter:
    """Constant-velocity Kalman filters of (centre x, centre y, aspect, height) for many boxes at once.

    All noise is independent by component, so each component is a filter of its own with a place
    and a velocity: its covariance is three numbers, and no matrix is inverted.  State: an array of
    (boxes, 5, 4): place, velocity, variance of the place, covariance, variance of the velocity.
    """

    def __init__(self, interval: float = 1.0):
        self.interval, self.place, self.speed = interval, interval / 20, interval / 160

    def _noise(self, height: np.ndarray, by_height: float, aspect: float) -> np.ndarray:
        """Variances (boxes, 4): in proportion to the height, but for the aspect's."""
        out = np.empty((len(height), 4))
        side = by_height * height
        out[:] = (side * side)[:, None]
        out[:, 2] = aspect * aspect
        return out

    @staticmethod
    def measured(boxes: np.ndarray) -> np.ndarray:
        out = np.empty((len(boxes), 4))
        out[:, :2] = (boxes[:, :2] + boxes[:, 2:]) / 2
        np.maximum(boxes[:, 3] - boxes[:, 1], 1.0, out=out[:, 3])
        out[:, 2] = (boxes[:, 2] - boxes[:, 0]) / out[:, 3]
        return out

    def started(self, boxes: np.ndarray) -> np.ndarray:
        z = self.measured(boxes)
        out = np.zeros((len(z), 5, 4))
        out[:, 0], out[:, 2], out[:, 4] = z, self._noise(z[:, 3], 2 * self.place, 1e-2), self._noise(z[:, 3], 10 * self.speed, 1e-5)
        return out

    def predicted(self, state: np.ndarray) -> np.ndarray:
        height, dt = state[:, 0, 3], self.interval
        place, speed, pp, pv, vv = (state[:, i] for i in range(5))
        out = np.empty_like(state)
        out[:, 0], out[:, 1], out[:, 3] = place + dt * speed, speed, pv + dt * vv
        out[:, 2] = pp + 2 * dt * pv + dt * dt * vv + self._noise(height, self.place, 1e-2)
        out[:, 4] = vv + self._noise(height, self.speed, 1e-5)
        return out

    def _innovation(self, state: np.ndarray) -> np.ndarray:
        return state[:, 2] + self._noise(state[:, 0, 3], self.place, 1e-1)

    def updated(self, state: np.ndarray, boxes: np.ndarray) -> np.ndarray:
        place, speed, pp, pv, vv = (state[:, i] for i in range(5))
        spread, off = self._innovation(state), self.measured(boxes) - place
        gain, speed_gain = pp / spread, pv / spread
        out, rest = np.empty_like(state), 1 - gain
        out[:, 0], out[:, 1], out[:, 2], out[:, 3], out[:, 4] = place + gain * off, speed + speed_gain * off, rest * pp, rest * pv, vv - speed_gain * pv
        return out

    def gating_distance(self, state: np.ndarray, boxes: np.ndarray) -> np.ndarray:
        """Squared Mahalanobis distance of each box to its state."""
        off = self.measured(boxes) - state[:, 0]
        return (off * off / self._innovation(state)).sum(axis=1)

    @staticmethod
    def boxes(state: np.ndarray, width: int, height: int) -> np.ndarray:
        """Boxes within the image, of a pixel at least."""
        x, y, a, h = state[:, 0].T
        w, h = np.maximum(1, np.abs(a * h)), np.maximum(1, np.abs(h))
        out = np.empty((len(state), 4))
        x1, y1 = np.minimum(np.maximum(x - w / 2, 0), width - 1), np.minimum(np.maximum(y - h / 2, 0), height - 1)
        out[:, 0], out[:, 1], out[:, 2], out[:, 3] = x1, y1, np.maximum(x1 + 1, np.minimum(width, x + w / 2)), np.maximum(y1 + 1, np.minimum(height, y + h / 2))
        return out


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of each box of a with each of b; 0 where both are empty."""
    wide = np.maximum(0, np.minimum(a[:, 2, None], b[:, 2]) - np.maximum(a[:, 0, None], b[:, 0]))
    high = np.maximum(0, np.minimum(a[:, 3, None], b[:, 3]) - np.maximum(a[:, 1, None], b[:, 1]))
    inner = wide * high
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = area(a)[:, None] + area(b)[None, :] - inner
    return np.divide(inner, union, out=np.zeros_like(inner), where=union > 0)


def cosine_costs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - cosine of each row of a with each of b; barred where either is missing (NaN)."""
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.nan_to_num(1.0 - unit(a) @ unit(b).T, nan=BARRED)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Metres between places; NaN where either is missing."""
    return np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])


def pitch_gate(metres: np.ndarray, missed: np.ndarray, gate: float, most: float) -> np.ndarray:
    """Whether a track may have come so far: gate metres for each frame since its last update and one more, never over most; yes where a place is missing."""
    return ~(metres > np.minimum(gate * (missed + 1), most)[:, None])


def motion_gate(overlap: np.ndarray, metres: np.ndarray, missed: np.ndarray, p: TrackerPreset) -> np.ndarray:
    """Near on the field or overlapping in the image, and in no case beyond three times the near reach."""
    near = np.minimum(p.reid_pitch_max * (missed + 1), p.absolute_max)[:, None]
    far = np.minimum(3 * p.reid_pitch_max * (missed + 1), p.absolute_max)[:, None]
    return ~(metres > far) & ((metres <= near) | (overlap >= p.reid_iou_min))


class Recent:
    """The last embeddings of each track, a ring of places per track; a dead track's ring is taken again."""

    def __init__(self, kept: int, dim: int):
        self.values, self.seen, self.free = np.zeros((0, kept, dim)), np.zeros(0, np.int64), []

    def rings(self, n: int) -> np.ndarray:
        if len(self.free) < n:
            old, more = len(self.seen), max(n, len(self.seen), 32)
            self.values = np.concatenate([self.values, np.zeros((more, *self.values.shape[1:]))])
            self.seen = np.concatenate([self.seen, np.zeros(more, np.int64)])
            self.free += range(old + more - 1, old - 1, -1)
        out = np.array([self.free.pop() for _ in range(n)], np.int64)
        self.seen[out] = 0
        return out

    def add(self, rings: np.ndarray, features: np.ndarray) -> None:
        self.values[rings, self.seen[rings] % self.values.shape[1]] = features
        self.seen[rings] += 1

    def mean(self, ring: int) -> np.ndarray | None:
        n = min(self.seen[ring], self.values.shape[1])
        return self.values[ring, :n].mean(axis=0) if n else None


class LiveTracks:
    """The living tracks of some runs as arrays, a row per track in order of runs and ids.

    Runs know nothing of one another, but step together, so that arrays are long and calls are few.
    With kept, means() tells the mean of the last so many embeddings of each confirmed track.
    """

    def __init__(self, preset: TrackerPreset, dim: int, kept: int = 0):
        self.p, self.filter, self.next_id = preset, BoxFilter(preset.frame_interval), {}
        shapes = {"run": (0,), "id": (0,), "hits": (0,), "age": (0,), "missed": (0,), "class_": (0,), "ring": (0,)}
        self.rows = {k: np.zeros(s, np.int64) for k, s in shapes.items()}
        self.rows |= {"confirmed": np.zeros(0, bool), "state": np.zeros((0, 5, 4)), "box": np.zeros((0, 4)), "place": np.zeros((0, 2)), "feature": np.zeros((0, dim))}
        self.present, self.waiting = np.zeros(0, np.int64), {}
        self.recent, self.ended = Recent(kept, dim) if kept else None, []
        # Farther pairs that don't overlap are matched by no stage, unless a limit lets any pair pass.
        self.reach = max(preset.absolute_max, preset.pitch_gate)
        self.any_pair = preset.reid_iou_min <= 0 or max(preset.max_iou_distance, preset.max_iou_distance_tentative) > 1
        self._lay_out()

    def _lay_out(self) -> None:
        """Where each track stands in arrays of (runs, tracks)."""
        self.at = np.searchsorted(self.present, self.rows["run"])
        n = np.bincount(self.at, minlength=len(self.present))
        self.slot, self.most = np.arange(len(self.at)) - (np.cumsum(n) - n)[self.at], int(n.max(initial=0))
        self.of_slot = np.zeros(len(n) * self.most, np.int64)
        self.of_slot[self.at * self.most + self.slot] = np.arange(len(self.at))

    def _enter(self, present: np.ndarray) -> None:
        """Tracks of other runs wait, and those of runs that are back are taken up."""
        if len(present) == len(self.present) and (present == self.present).all():
            return
        parts = []
        for run in np.union1d(self.present, present).tolist():
            if run in self.waiting:
                parts.append(self.waiting.pop(run))
                continue
            a, b = np.searchsorted(self.rows["run"], (run, run + 1))
            own = {k: v[a:b] for k, v in self.rows.items()}
            i = np.searchsorted(present, run)
            if i < len(present) and present[i] == run:
                parts.append(own)
            elif b > a:
                self.waiting[run] = {k: v.copy() for k, v in own.items()}
        self.present, self.rows = present, {k: np.concatenate([v[:0], *(q[k] for q in parts)]) for k, v in self.rows.items()}
        self._lay_out()

    def step(self, boxes: np.ndarray, places: np.ndarray, features: np.ndarray, classes: np.ndarray, runs: np.ndarray | None = None, present: np.ndarray | None = None) -> tuple:
        """One frame of each run that is present. -> for each detection: track id (0 if its track ends at once), confirmed, hits, age.

        runs tells each detection's run, in ascending order, present all runs that have a frame; without
        them there is one run. Missing places and features are NaN. Confirmed tracks are matched by
        appearance, then by overlap; these matches are applied before tentative tracks are matched by
        overlap and by place.
        """
        p = self.p
        runs = np.zeros(len(boxes), np.int64) if runs is None else runs
        self._enter(np.zeros(1, np.int64) if present is None else present)
        t = self.rows
        t["state"] = self.filter.predicted(t["state"])
        t["box"] = self.filter.boxes(t["state"], p.width, p.height) if len(t["id"]) else t["box"]
        to = self._matched(boxes, places, features, runs) if len(t["id"]) and len(boxes) else np.full(len(boxes), -1)
        got = np.nonzero(to >= 0)[0]
        if len(got) == len(to):
            self._apply(to, boxes, places, features)
        else:
            self._apply(to[got], boxes[got], places[got], features[got])
            to = self._spawn(np.nonzero(to < 0)[0], to, boxes, places, features, classes, runs)
        t = self.rows
        t["age"] += 1
        t["missed"] += 1
        t["missed"][to] -= 1
        lives = (t["missed"] <= p.max_age) & (t["confirmed"] | (t["age"] <= p.n_init + 2))
        out = np.where(lives[to], t["id"][to], 0), t["confirmed"][to], t["hits"][to], t["age"][to]
        if not lives.all():
            if self.recent is not None:
                dead = np.nonzero(~lives)[0]
                self.ended += self._means({k: t[k][dead] for k in ("run", "id", "confirmed", "ring")})
                self.recent.free += t["ring"][dead].tolist()
            self.rows = {k: v[lives] for k, v in t.items()}
            self._lay_out()
        return out

    def _pairs(self, boxes: np.ndarray, places: np.ndarray, runs: np.ndarray) -> tuple:
        """(track, detection, overlap, metres) of all pairs in a run that a stage may match, in order of both."""
        t, at = self.rows, np.searchsorted(self.present, runs)
        n = np.bincount(at, minlength=len(self.present))
        first, most = np.cumsum(n) - n, int(n.max())
        a, b = np.full((6, len(n), self.most), np.nan), np.full((6, len(n), most), np.nan)
        a[:4, self.at, self.slot], a[4:, self.at, self.slot] = t["box"].T, t["place"].T
        slot = np.arange(len(at)) - first[at]
        b[:4, at, slot], b[4:, at, slot] = boxes.T, places.T
        a, b = a[..., None], b[:, :, None, :]
        wide, high = np.minimum(a[2], b[2]) - np.maximum(a[0], b[0]), np.minimum(a[3], b[3]) - np.maximum(a[1], b[1])
        if self.any_pair:
            may = np.zeros(wide.shape, bool)
            may[self.at, self.slot] = (np.arange(most) < n[:, None])[self.at]
        else:
            may = np.minimum(wide, high) > 0
            may |= np.maximum(np.abs(a[4] - b[4]), np.abs(a[5] - b[5])) <= self.reach
        k = np.flatnonzero(may)
        track = self.of_slot[k // most]
        seen = first[self.at[track]] + k % most
        inner = np.maximum(0, wide.ravel()[k]) * np.maximum(0, high.ravel()[k])
        area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
        union = area(t["box"])[track] + area(boxes)[seen] - inner
        off = t["place"][track] - places[seen]
        return track, seen, np.divide(inner, union, out=np.zeros_like(inner), where=union > 0), np.hypot(off[:, 0], off[:, 1])

    def _matched(self, boxes: np.ndarray, places: np.ndarray, features: np.ndarray, runs: np.ndarray) -> np.ndarray:
        """Each detection's track, -1 without one."""
        p, t = self.p, self.rows
        pairs = self._pairs(boxes, places, runs)
        to, free, sure = np.full(len(boxes), -1), np.ones(len(t["id"]), bool), t["confirmed"]

        def cosine(track, seen, overlap, metres):
            a, b = t["feature"][track], features[seen]
            dot = lambda x, y: np.einsum("ij,ij->i", x, y)
            with np.errstate(invalid="ignore", divide="ignore"):
                return 1.0 - dot(a, b) / np.sqrt(dot(a, a)) / np.sqrt(dot(b, b))

        reachable = lambda track, seen, overlap, metres: pitch_gate(metres[:, None], t["missed"][track], p.pitch_gate, p.absolute_max)[:, 0]
        stages = (
            (sure & ~np.isnan(t["feature"][:, 0]), cosine, lambda track, seen, overlap, metres: motion_gate(overlap[:, None], metres[:, None], t["missed"][track], p)[:, 0], p.max_cosine_distance),
            (sure, lambda track, seen, overlap, metres: 1 - overlap, reachable, p.max_iou_distance),
            (~sure, lambda track, seen, overlap, metres: 1 - overlap, None, p.max_iou_distance_tentative),
            (~sure, lambda track, seen, overlap, metres: metres, reachable, p.pitch_gate),
        )
        for who, cost, gate, limit in stages:
            may = who[pairs[0]]
            some = tuple(v[may] for v in pairs)
            if gate is not None and len(some[0]):
                may = gate(*some)
                some = tuple(v[may] for v in some)
            if not len(some[0]):
                continue
            costs = cost(*some)
            fit = costs < limit
            track, seen = self._chosen(some[0][fit], some[1][fit], costs[fit], limit)
            to[seen], free[track] = track, False
            rest = free[pairs[0]] & (to < 0)[pairs[1]]
            pairs = tuple(v[rest] for v in pairs)
            if not len(pairs[0]):
                break
        return to

    def _chosen(self, track: np.ndarray, seen: np.ndarray, costs: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """(tracks, detections) of the least-cost assignment in each run; the pairs, in order, cost less than limit."""
        if len(track) > 1:
            new = np.flatnonzero(np.concatenate([[True], track[1:] != track[:-1]]))
            best = np.arange(len(track))
            if len(new) < len(track):  # the first of each track's cheapest
                least = np.repeat(np.minimum.reduceat(costs, new), np.diff(new, append=len(track)))
                best = np.flatnonzero(costs == least)
                best = best[np.concatenate([[True], track[best][1:] != track[best][:-1]])]
            asked = np.bincount(seen[best])[seen[best]] > 1
            if not asked.any():  # everyone's best is free
                return track[best], seen[best]
            run = self.at[track]
            hard = np.unique(run[best[asked]])
            easy = best[~np.isin(run[best], hard)]
            chosen = [(track[easy], seen[easy])]
            for r in hard:
                a, b = np.searchsorted(run, (r, r + 1))
                rows, i = np.unique(track[a:b], return_inverse=True)
                columns, j = np.unique(seen[a:b], return_inverse=True)
                matrix = np.full((len(rows), len(columns)), BARRED)
                matrix[i, j] = costs[a:b]
                i, j = least_cost_pairs(matrix, limit)
                chosen.append((rows[i], columns[j]))
            track, seen = (np.concatenate(v) for v in zip(*chosen))
        return track, seen

    def _apply(self, at: np.ndarray, boxes: np.ndarray, places: np.ndarray, features: np.ndarray) -> None:
        t, alpha = self.rows, self.p.feature_alpha
        t["state"][at], t["box"][at] = self.filter.updated(t["state"][at], boxes), boxes
        t["hits"][at] += 1
        t["missed"][at] = 0
        there = np.flatnonzero(~np.isnan(places[:, 0]))
        t["place"][at[there]] = places[there]
        # A feature is missing as a whole, so its first number tells.
        seen = np.flatnonzero(~np.isnan(features[:, 0]))
        mine, new = at[seen], features[seen]
        mixed = t["feature"][mine]
        begins = np.flatnonzero(np.isnan(mixed[:, 0]))
        mixed *= alpha
        mixed += (1 - alpha) * new
        mixed /= np.sqrt((mixed * mixed).sum(axis=1, keepdims=True)) + 1e-8
        mixed[begins] = new[begins]
        t["feature"][mine] = mixed
        t["confirmed"][at] |= t["hits"][at] >= self.p.n_init
        if self.recent is not None:
            self.recent.add(t["ring"][mine], new)

    def _spawn(self, new: np.ndarray, to: np.ndarray, boxes: np.ndarray, places: np.ndarray, features: np.ndarray, classes: np.ndarray, runs: np.ndarray) -> np.ndarray:
        """Starts tracks of the new detections. -> each detection's track."""
        n, t = len(new), self.rows
        to[new] = len(t["id"]) + np.arange(n)
        ids = np.empty(n, np.int64)
        for run, a, k in zip(*(v.tolist() for v in np.unique(runs[new], return_index=True, return_counts=True))):
            ids[a : a + k] = self.next_id.get(run, 1) + np.arange(k)
            self.next_id[run] = int(ids[a + k - 1]) + 1
        ring = np.full(n, -1) if self.recent is None else self.recent.rings(n)
        if self.recent is not None:
            with_look = ~np.isnan(features[new, 0])
            self.recent.add(ring[with_look], features[new][with_look])
        own = {"run": runs[new], "id": ids, "hits": np.ones(n, np.int64), "age": np.ones(n, np.int64), "missed": np.zeros(n, np.int64), "class_": classes[new], "ring": ring, "confirmed": np.zeros(n, bool), "state": self.filter.started(boxes[new]), "box": boxes[new], "place": places[new], "feature": features[new]}
        order = np.argsort(np.concatenate([t["run"], own["run"]]), kind="stable")
        self.rows = {k: np.concatenate([t[k], own[k]])[order] for k in t}
        self._lay_out()
        moved = np.empty(len(order), np.int64)
        moved[order] = np.arange(len(order))
        return moved[to]

    def _means(self, rows: dict) -> list:
        found = ((run, id_, self.recent.mean(ring)) for run, id_, ring, sure in zip(*(rows[k].tolist() for k in ("run", "id", "ring", "confirmed"))) if sure)
        return [f for f in found if f[2] is not None]

    def means(self, last: bool = False) -> list:
        """(run, track id, mean of the last kept embeddings) of confirmed tracks that have ended since the last call; of the living ones too, at last."""
        out, self.ended = self.ended, []
        for rows in (self.rows, *self.waiting.values()) if last else ():
            out += self._means(rows)
        return out


TRACKED = "run_id long, frame long, ord long, track_id long, confirmed boolean, hits long, age long"


#: What the tracker reads of a detection but its embedding, as two lists: a column costs more to pass than a number.
WHOLE, NUMBER = ("tick", "run_id", "frame", "ord", "class"), ("x1", "y1", "x2", "y2", "x", "y")
#: Rows, and tracks' means, that a batch of results gathers.
RESULT_ROWS, RESULT_MEANS = 20_000, 1_000


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, NaN where null, of another length or with a null inside."""
    out = np.full((len(column), dim), np.nan)
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    whole = np.flatnonzero(sizes == dim)
    if len(whole):
        if len(whole) + np.count_nonzero(sizes < 0) < len(sizes):
            column = column.take(pa.array(whole))
        out[whole] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        out[np.isnan(out).any(axis=1)] = np.nan
    return out


def _ticks(batches, dim: int):
    """(runs, frames, ords, boxes, places, features, classes, schedules) of each tick from batches sorted by tick, in order of runs and ords; a tick may span batches.

    schedules has the processed frames of runs that begin and have them, by run.
    """
    held: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values, sizes = (v.to_numpy(zero_copy_only=False) for v in (batch.column("whole").flatten(), batch.column("whole").value_lengths()))
        start = np.cumsum(sizes) - sizes
        whole = values[start[:, None] + np.arange(len(WHOLE))]
        number = batch.column("number").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NUMBER))
        places = number[:, 4:].copy()
        places[np.isnan(places).any(axis=1)] = np.nan
        part = (*whole.T[:4], number[:, :4], places, _matrix(batch.column("embedding"), dim), whole[:, 4])
        longer = np.nonzero(sizes > len(WHOLE))[0]
        schedules = {int(whole[i, 1]): values[start[i] + len(WHOLE) : start[i] + sizes[i]] for i in longer}
        if held is not None:
            part = tuple(np.concatenate(pair) for pair in zip(held[0], part))
            schedules |= held[1]
        cuts = [0, *(np.nonzero(np.diff(part[0]))[0] + 1).tolist()]
        if len(cuts) > 1:
            order = np.lexsort((part[3][: cuts[-1]], part[1][: cuts[-1]], part[0][: cuts[-1]]))
            done = tuple(v[order] for v in part[1:])
            for a, b in zip(cuts, cuts[1:]):
                yield *(v[a:b] for v in done), schedules
                schedules = {}
        held = tuple(v[cuts[-1] :] for v in part), schedules
    if held is not None:
        order = np.lexsort((held[0][3], held[0][1]))
        yield *(v[order] for v in held[0][1:]), held[1]


def _steps(batches, live: LiveTracks, dim: int):
    """(runs, frames, ords, ids, confirmed, hits, age) of each tick's detections; runs age in frames of their schedule without detections."""
    later: dict = {}  # of each run, the processed frames after its last one, the next one last
    for runs, frames, ords, boxes, places, features, classes, schedules in _ticks(batches, dim):
        new = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
        present = runs[new]
        first = {run: array("q", np.unique(at)[::-1].tobytes()) for run, at in schedules.items()}
        empty = []
        for run, frame in zip(present.tolist(), frames[new].tolist()):
            if run in first:  # frames before a run's first detection leave no trace
                at = later[run] = first[run]
                while at and at[-1] < frame:
                    at.pop()
            at, n = later.get(run, ()), 0
            while at and at[-1] <= frame:
                n += at.pop() < frame
            empty.append(n)
        for k in range(max(empty)):
            live.step(boxes[:0], places[:0], features[:0], classes[:0], runs[:0], present[np.array(empty) > k])
        yield runs, frames, ords, *live.step(boxes, places, features, classes, runs, present)


def _by_tick(detections: DataFrame, frames: DataFrame | None) -> DataFrame:
    """whole, number, embedding: detections with a tick, the frames since their run's first, and sorted by it. Where a run begins, its frames follow in whole.

    All rows of a run are in one part: joining its first frame to them deals runs to tasks, and a
    table that lies by run stays where it is. An outer join of whole sides isn't split where a part is
    greater than others, as an inner one may be.
    """
    about = detections.groupBy("run_id").agg(F.min("frame").alias("first"))
    if frames is None:
        about = about.withColumn("frames", F.lit(None).cast("array<long>"))
    else:
        about = about.join(frames.groupBy("run_id").agg(F.collect_list(F.col("frame").cast("long")).alias("frames")).hint("shuffle_hash"), "run_id", "left")
    rows = detections.select("run_id", "frame", "ord", "class", F.array(*(F.col(c).cast("double") for c in NUMBER)).alias("number"), "embedding").join(about.hint("shuffle_hash"), "run_id", "full")
    rows = rows.withColumns({"tick": F.col("frame") - F.col("first"), "class": F.coalesce("class", F.lit(-1))})
    begins = F.when(F.col("frame") == F.col("first"), F.col("frames"))
    whole = F.concat(F.array(*(F.col(c).cast("long") for c in WHOLE)), F.coalesce(begins, F.array().cast("array<long>")))
    return rows.select("tick", whole.alias("whole"), "number", "embedding").sortWithinPartitions("tick").drop("tick")


def _dim(detections: DataFrame) -> int:
    return detections.where("embedding IS NOT NULL").select(F.max(F.size("embedding"))).first()[0] or 1


def tracked(detections: DataFrame, frames: DataFrame | None = None, preset: TrackerPreset = TrackerPreset()) -> DataFrame:
    """run_id, frame, ord, track_id, confirmed, hits, age: the track of each detection, if it is alive after its frame.

    detections(run_id, frame, ord, x1, y1, x2, y2, class, x, y, embedding): boxes in pixels; x, y in
    metres and embedding (array of numbers, as long in all rows) may be null.  frames(run_id, frame)
    names processed frames without detections too, in which tracks age; without it, frames are those
    of the detections.  Ids count from 1 in each run, in order of frame, then ord.  A tentative track
    becomes confirmed at n_init hits and its earlier rows stay tentative: ever_confirmed() fills them in.
    """
    dim = _dim(detections)

    def run(batches):
        rows, gathered = [], 0
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]

        def result():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(zip(*rows), kinds)], names=[f.split(" ")[0] for f in TRACKED.split(", ")])

        for own in _steps(batches, LiveTracks(preset, dim), dim):
            keep = own[3] > 0
            rows.append(own if keep.all() else tuple(v[keep] for v in own))
            gathered += int(keep.sum())
            if gathered >= RESULT_ROWS:
                yield result()
                rows, gathered = [], 0
        if gathered:
            yield result()

    return _by_tick(detections, frames).mapInArrow(run, TRACKED)


def tracked_features(detections: DataFrame, frames: DataFrame | None = None, preset: TrackerPreset = TrackerPreset()) -> DataFrame:
    """run_id, track_id, feature: what track_features() tells of tracked(), in the tracker's own pass; each living track's last embeddings are kept there."""
    dim = _dim(detections)

    def run(batches):
        live, found = LiveTracks(preset, dim, preset.kept_features), []

        def result():
            values = pa.array(np.concatenate([f[2] for f in found]))
            ids = [pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*ids, pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * dim, pa.int32()), values)], names=["run_id", "track_id", "feature"])

        for _ in _steps(batches, live, dim):
            found += live.means()
            if len(found) >= RESULT_MEANS:
                yield result()
                found = []
        found += live.means(last=True)
        if found:
            yield result()

    return _by_tick(detections, frames).mapInArrow(run, "run_id long, track_id long, feature array<double>")


def track_features(rows: DataFrame, detections: DataFrame, kept: int = TrackerPreset.kept_features) -> DataFrame:
    """run_id, track_id, feature: the mean of a confirmed track's last `kept` embeddings; rows as tracked() gives them."""
    own = rows.join(detections.where("embedding IS NOT NULL").select("run_id", "frame", "ord", "embedding"), ["run_id", "frame", "ord"])
    own = own.withColumn("ever", F.max("confirmed").over(Window.partitionBy("run_id", "track_id"))).where("ever")
    last = own.withColumn("k", F.row_number().over(Window.partitionBy("run_id", "track_id").orderBy(F.col("frame").desc()))).where(F.col("k") <= kept)
    parts = last.select("run_id", "track_id", F.posexplode("embedding").alias("i", "v")).groupBy("run_id", "track_id", "i").agg(F.avg("v").alias("v"))
    return parts.groupBy("run_id", "track_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("feature"))


def preset_of(config: dict) -> TrackerPreset:
    """The preset with a configuration's values; unknown keys are an error."""
    known = {f.name for f in fields(TrackerPreset)}
    if unknown := set(config) - known:
        raise ValueError(f"unknown tracker settings: {', '.join(sorted(unknown))}")
    return replace(TrackerPreset(), **config)

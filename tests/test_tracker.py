"""Assignment against exhaustive search; the tracker against a plain one with full covariance matrices, and known cases."""

import itertools

import numpy as np
import pytest

from touchline.operators import assignment, tracker
from touchline.operators.tracker import TrackerPreset


def exhaustive(cost, limit):
    """(most pairs, their least sum) over all partial assignments of costs under limit."""
    rows, columns = cost.shape
    if rows > columns:
        return exhaustive(cost.T, limit)
    best = (0, 0.0)
    for chosen in itertools.permutations(range(columns), rows):
        good = [cost[i, j] for i, j in enumerate(chosen) if cost[i, j] < limit]
        best = min(best, (-len(good), sum(good)))
    return -best[0], best[1]


@pytest.mark.parametrize("rows", range(1, 7))
@pytest.mark.parametrize("columns", range(1, 7))
def test_assignment_equals_exhaustive_search(rows, columns):
    rng = np.random.default_rng(rows * 10 + columns)
    for k in range(12 if rows * columns > 20 else 40):
        cost = rng.integers(0, 9, (rows, columns)) / 10 if k % 2 else rng.random((rows, columns))
        cost[rng.random((rows, columns)) < 0.3 * (k % 3)] = assignment.BARRED
        r, c = assignment.least_cost_pairs(cost, 0.75)
        assert len(set(r)) == len(r) == len(set(c)) == len(c) and (cost[r, c] < 0.75).all()
        n, total = exhaustive(cost, 0.75)
        assert len(r) == n and abs(cost[r, c].sum() - total) < 1e-9


def test_assigned_rows(spark):
    rows = [(1, 5, 1, 0, 0.1, True), (1, 5, 1, 1, 0.2, True), (1, 5, 2, 0, 0.15, True), (1, 5, 2, 1, 0.9, True), (1, 6, 1, 0, 0.1, False), (1, 7, 1, 0, None, True), (2, 5, 1, 0, 0.7, True), (2, 5, 3, 9, 0.3, True)]
    df = spark.createDataFrame(rows, "run_id long, frame long, track_id int, ord int, c double, allowed boolean")
    assert {tuple(r) for r in assignment.assignments(df, "c", 0.7).collect()} == {(1, 5, 1, 1, 0.2), (1, 5, 2, 0, 0.15), (2, 5, 3, 9, 0.3)}
    assert assignment.assignments(df.where("false"), "c", 0.7).collect() == []


def test_costs_and_gates():
    box = lambda *x: np.array([x], float)
    nan = np.full((1, 2), np.nan)
    assert tracker.overlaps(box(0, 0, 10, 10), box(5, 0, 15, 10))[0, 0] == pytest.approx(1 / 3)
    assert tracker.overlaps(box(0, 0, 10, 10), box(100, 100, 110, 110))[0, 0] == 0 == tracker.overlaps(box(3, 3, 3, 3), box(3, 3, 3, 3))[0, 0]
    assert tracker.cosine_costs(np.array([[1.0, 0, 0]]), np.array([[1.0, 0, 0], [0, 1, 0], [np.nan] * 3]))[0].tolist() == pytest.approx([0, 1, 1e5])
    gate = lambda a, b, limit, missed=0: bool(tracker.pitch_gate(tracker.distances(a, b), np.array([missed]), limit, 8.0)[0, 0])
    origin = box(0, 0)
    assert gate(origin, box(3, 0), 3) and not gate(origin, box(4, 0), 3) and gate(origin, box(3, 4), 5) and not gate(origin, box(3, 4), 4)
    assert gate(nan, box(100, 100), 3) and gate(origin, nan, 3) and gate(origin, box(6, 0), 3, 1) and not gate(origin, box(8.1, 0), 3, 30)
    p = TrackerPreset()
    motion = lambda over, metres, missed=0: bool(tracker.motion_gate(np.array([[over]]), np.array([[metres]]), np.array([missed]), p)[0, 0])
    assert motion(0, 1.5) and not motion(0, 1.6) and motion(0.1, 4.5) and not motion(0.9, 4.6) and motion(0.1, np.nan) and not motion(0.05, np.nan) and motion(0, 3.0, 1)


def test_settings():
    assert tracker.preset_of({"n_init": 2}).n_init == 2
    with pytest.raises(ValueError):
        tracker.preset_of({"n_inits": 2})


class Plain:
    """One run's tracks as dicts, with 8 x 8 covariances and exhaustive assignment."""

    def __init__(self, p):
        self.p, self.tracks, self.next = p, [], 1
        self.F, self.H = np.eye(8), np.eye(4, 8)
        self.F[:4, 4:] += p.frame_interval * np.eye(4)
        self.wp, self.wv = p.frame_interval / 20, p.frame_interval / 160

    def z(self, b):
        h = max(b[3] - b[1], 1.0)
        return np.array([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2, (b[2] - b[0]) / h, h])

    def box(self, m):
        w, h = max(1, abs(m[2] * m[3])), max(1, abs(m[3]))
        x1, y1 = max(0, min(self.p.width - 1, m[0] - w / 2)), max(0, min(self.p.height - 1, m[1] - h / 2))
        return [x1, y1, max(x1 + 1, min(self.p.width, m[0] + w / 2)), max(y1 + 1, min(self.p.height, m[1] + h / 2))]

    def iou(self, a, b):
        inner = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inner
        return inner / union if union > 0 else 0

    def match(self, tracks, dets, cost, gate, limit):
        c = np.array([[x if (x := cost(t, d)) < limit and gate(t, d) else 1e5 for d in dets] for t in tracks])
        small, flip = (c.T, True) if c.shape[0] > c.shape[1] else (c, False)
        best = min(itertools.permutations(range(small.shape[1]), small.shape[0]), key=lambda q: sum(small[i, j] for i, j in enumerate(q)))
        return [(tracks[j if flip else i], dets[i if flip else j]) for i, j in enumerate(best) if small[i, j] < limit]

    def step(self, dets):
        p = self.p
        for t in self.tracks:
            h = t["m"][3]
            q = np.array([self.wp * h, self.wp * h, 1e-2, self.wp * h, self.wv * h, self.wv * h, 1e-5, self.wv * h])
            t["m"], t["P"] = self.F @ t["m"], self.F @ t["P"] @ self.F.T + np.diag(q * q)
            t["box"] = self.box(t["m"])
        d = lambda t, x: None if t["at"] is None or x["at"] is None else np.hypot(t["at"][0] - x["at"][0], t["at"][1] - x["at"][1])
        near = lambda t, x: (m := d(t, x)) is None or m <= min(p.pitch_gate * (t["missed"] + 1), p.absolute_max)

        def motion(t, x):
            m, k = d(t, x), t["missed"] + 1
            if m is not None and m > min(3 * p.reid_pitch_max * k, p.absolute_max):
                return False
            return (m is not None and m <= min(p.reid_pitch_max * k, p.absolute_max)) or self.iou(t["box"], x["box"]) >= p.reid_iou_min

        cosine = lambda t, x: 1e5 if x["e"] is None else 1 - t["f"] @ x["e"] / np.linalg.norm(t["f"]) / np.linalg.norm(x["e"])
        over = lambda t, x: 1 - self.iou(t["box"], x["box"])
        free, left, found = list(self.tracks), list(dets), []
        for who, cost, gate, limit in (
            (lambda t: t["ok"] and t["f"] is not None, cosine, motion, p.max_cosine_distance), (lambda t: t["ok"], over, near, p.max_iou_distance),
            (lambda t: not t["ok"], over, lambda t, x: True, p.max_iou_distance_tentative), (lambda t: not t["ok"], lambda t, x: 1e5 if (m := d(t, x)) is None else m, near, p.pitch_gate),
        ):
            some = [t for t in free if who(t)]
            if some and left:
                got = self.match(some, left, cost, gate, limit)
                found += got
                free = [t for t in free if not any(t is g for g, _ in got)]
                left = [x for x in left if not any(x is g for _, g in got)]
        for t, x in found:
            h = t["m"][3]
            r = np.array([self.wp * h, self.wp * h, 1e-1, self.wp * h])
            S = self.H @ t["P"] @ self.H.T + np.diag(r * r)
            K = t["P"] @ self.H.T @ np.linalg.inv(S)
            t["m"], t["P"] = t["m"] + K @ (self.z(x["box"]) - self.H @ t["m"]), (np.eye(8) - K @ self.H) @ t["P"]
            t["hits"], t["missed"], t["at"], t["det"] = t["hits"] + 1, 0, x["at"] or t["at"], x
            if x["e"] is not None:
                f = x["e"] if t["f"] is None else p.feature_alpha * t["f"] + (1 - p.feature_alpha) * x["e"]
                t["f"] = f if t["f"] is None else f / (np.linalg.norm(f) + 1e-8)
            t["ok"] = t["ok"] or t["hits"] >= p.n_init
        for x in left:
            h = self.z(x["box"])[3]
            s = np.array([2 * self.wp * h, 2 * self.wp * h, 1e-2, 2 * self.wp * h, 10 * self.wv * h, 10 * self.wv * h, 1e-5, 10 * self.wv * h])
            self.tracks.append({"id": self.next, "hits": 1, "age": 1, "missed": 0, "ok": False, "m": np.r_[self.z(x["box"]), np.zeros(4)], "P": np.diag(s * s), "at": x["at"], "f": x["e"], "det": x})
            self.next += 1
        touched = [t for t, _ in found] + self.tracks[len(self.tracks) - len(left) :]
        for t in self.tracks:
            t["age"] += 1
            t["missed"] += not any(t is x for x in touched)
        self.tracks = [t for t in self.tracks if t["missed"] <= p.max_age and (t["ok"] or t["age"] <= p.n_init + 2)]
        return {(t["det"]["ord"], t["id"], t["ok"], t["hits"], t["age"]) for t in self.tracks if t["missed"] == 0}


def scene(seed, frames=60, bodies=4):
    rng = np.random.default_rng(seed)
    start, speed = rng.uniform(-20, 20, (bodies, 2)), rng.uniform(-0.5, 0.5, (bodies, 2))
    look = rng.normal(size=(bodies, 6))
    for frame in range(frames):
        dets = []
        for b in range(bodies):
            if rng.random() < 0.2 or (frame // 10 + b) % 5 == 4:
                continue
            x, y = start[b] + speed[b] * frame + rng.normal(0, 0.05, 2)
            h = 60 + y
            left, top = 900 + 12 * x, 500 + 8 * y
            e = look[b] + rng.normal(0, 0.2, 6)
            dets.append({"ord": len(dets), "box": [left, top, left + 0.4 * h, top + h], "at": None if rng.random() < 0.1 else (float(x), float(y)), "e": None if rng.random() < 0.1 else e})
        yield frame * 3, dets


def test_tracker_equals_a_plain_one(spark):
    p, rows, frames, want = TrackerPreset(max_age=5), [], [], set()
    for run in range(3):
        plain = Plain(p)
        for frame, dets in scene(run):
            frames.append((run, frame))
            rows += [(run, frame, d["ord"], *map(float, d["box"]), 0, *(d["at"] or (None, None)), None if d["e"] is None else d["e"].tolist(), "clash") for d in dets]
            want |= {(run, frame, *r) for r in plain.step(dets)}
    df = spark.createDataFrame(rows, "run_id long, frame long, ord long, x1 double, y1 double, x2 double, y2 double, class int, x double, y double, embedding array<double>, track_id string").repartition(5)
    at = spark.createDataFrame(frames, "run_id long, frame long")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("7", old):  # frames and runs that span batches
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = {(r.run_id, r.frame, r.ord, r.track_id, r.confirmed, r.hits, r.age) for r in tracker.tracked(df, at, p).collect()}
        assert got == want and any(r[4] for r in got)
    rows = tracker.tracked(df, at, p)
    ever = {(r[0], r[3]) for r in want if r[4]}
    features = {(r.run_id, r.track_id): r.feature for r in tracker.track_features(rows, df, 4).collect()}
    assert features.keys() <= ever and features
    assert tracker.tracked(df.where("false"), at.where("false"), p).collect() == []


def test_lifecycle():
    live = tracker.LiveTracks(TrackerPreset(max_age=10), 1)
    box, place, none = np.array([[100.0, 100, 130, 180]]), np.array([[0.0, 0.0]]), np.full((1, 1), np.nan)
    step = lambda seen: live.step(box[:seen], place[:seen], none[:seen], np.zeros(seen, int))
    assert [step(1)[1][0] for _ in range(3)] == [False, False, True]
    for _ in range(10):
        step(0)
    assert len(live.rows["id"]) == 1
    step(0)  # 11 frames without a detection
    assert len(live.rows["id"]) == 0
    step(1)
    ages = []
    while len(live.rows["id"]):
        ages.append(int(live.rows["age"][0]))
        step(0)
    assert ages == [2, 3, 4, 5] and step(1)[0][0] == 3


def test_runs_step_side_by_side(spark):
    """Runs that begin, pause and end at different frames, with crowds whose best ones clash: each is tracked as it is alone."""
    p = TrackerPreset(max_age=4)
    scenes = {run: [(frame, dets) for frame, dets in scene(seed, frames, bodies) if frame % 11 != run] for run, (seed, frames, bodies) in enumerate(((5, 40, 6), (6, 25, 3), (7, 55, 9)))}
    look = np.random.default_rng(3).normal(size=6)
    for at, (frame, dets) in enumerate(scenes[2]):  # a crowd of one look, near one another
        for k, d in enumerate(dets):
            left = 900 + 9 * k + at % 3
            d.update(box=[left, 500, left + 22, 560], at=(float(k) * 0.8, 0.0), e=look + 0.01 * k)
    arrays = lambda dets: (
        np.array([d["box"] for d in dets], float).reshape(-1, 4), np.array([d["at"] or (np.nan, np.nan) for d in dets], float).reshape(-1, 2),
        np.array([np.full(6, np.nan) if d["e"] is None else d["e"] for d in dets], float).reshape(-1, 6), np.zeros(len(dets), int),
    )
    alone = {}
    for run, own in scenes.items():
        live = tracker.LiveTracks(p, 6, 4)
        alone[run] = [[v.tolist() for v in live.step(*arrays(dets))] for _, dets in own], {f[1]: f[2].tolist() for f in live.means(last=True)}
    live, got, means = tracker.LiveTracks(p, 6, 4), {run: [] for run in scenes}, {run: {} for run in scenes}
    left = {run: list(own) for run, own in scenes.items()}
    for tick in range(200):
        here = [run for run in left if left[run] and (tick + run) % 4]
        dets = {run: left[run].pop(0)[1] for run in here}
        n = [len(dets[run]) for run in here]
        out = live.step(*arrays([d for run in here for d in dets[run]]), np.repeat(np.array(here, int), n), np.array(here, int))
        for run, a, b in zip(here, np.cumsum(n) - n, np.cumsum(n)):
            got[run].append([v[a:b].tolist() for v in out])
        for run, track, mean in live.means(last=tick == 199):
            means[run][track] = mean.tolist()
    for run in scenes:
        assert got[run] == alone[run][0] and means[run] == alone[run][1] and means[run]


def test_features_of_the_trackers_own_pass(spark):
    """The mean of the last embeddings, as rows and detections tell it, in one pass and without moving detections."""
    rows = [(run, frame, d["ord"], *map(float, d["box"]), 0, *(d["at"] or (None, None)), None if d["e"] is None else d["e"].tolist()) for run in range(4) for frame, dets in scene(20 + run, 50) for d in dets]
    df = spark.createDataFrame(rows, "run_id long, frame long, ord long, x1 double, y1 double, x2 double, y2 double, class int, x double, y double, embedding array<double>").repartition(3)
    for kept in (3, 100):
        p = TrackerPreset(max_age=5, kept_features=kept)
        want = {(r.run_id, r.track_id): r.feature for r in tracker.track_features(tracker.tracked(df, None, p), df, kept).collect()}
        got = {(r.run_id, r.track_id): r.feature for r in tracker.tracked_features(df, None, p).collect()}
        assert got.keys() == want.keys() and len(got) > 8
        assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert tracker.tracked_features(df.where("false")).collect() == []


def test_detections_that_lie_by_run_are_not_moved(spark):
    """However many shuffle partitions there are: with more than buckets, all detections were shuffled to meet the frames' numbers."""
    from pyspark.sql import functions as F

    from touchline.plans.staging import stored_by_run

    rows = spark.range(3_000).select((F.col("id") % 6).alias("run_id"), F.floor(F.col("id") / 30).alias("frame"), F.floor(F.col("id") / 6 % 5).alias("ord"))
    corner = F.col("ord") * 40.0
    rows = rows.select("*", corner.alias("x1"), corner.alias("y1"), (corner + 20).alias("x2"), (corner + 50).alias("y2"), F.lit(0).alias("class"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.array(F.lit(1.0)).alias("embedding"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(old, ("17", "-1")):
            spark.conf.set(k, v)
        table = stored_by_run(rows.repartition(3, "run_id"), "test_boxes", 3)
        frames = stored_by_run(rows.select("run_id", "frame").distinct().repartition(3, "run_id"), "test_frames", 3)
        for found in (tracker.tracked(table, frames), tracker.tracked_features(table)):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "MapInArrow" in plan
        assert tracker.tracked(table, frames).groupBy("run_id").agg(F.max("track_id"), F.max("hits"), F.count("*")).where("`max(track_id)` = 5 AND `max(hits)` = 100 AND `count(1)` = 500").count() == 6
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_empty_frames_of_runs_side_by_side(spark):
    """Processed frames without detections age the tracks of their own run only, wherever its neighbours are; as the plain tracker does it."""
    p, rows, frames, want = TrackerPreset(max_age=5), [], [], set()
    for run in range(4):
        plain = Plain(p)
        for k, (frame, dets) in enumerate(scene(40 + run, 50)):
            if k < 3 * run or (k + 5 * run) % 23 < 2 * run:  # late to begin, and pauses of up to six frames
                dets = []
            if run < 3 or dets:  # one run's frames are those of its detections
                frames.append((run, 10_000 * run + frame))
                want |= {(run, 10_000 * run + frame, *r) for r in plain.step(dets)}
            rows += [(run, 10_000 * run + frame, d["ord"], *map(float, d["box"]), 0, *(d["at"] or (None, None)), None if d["e"] is None else d["e"].tolist()) for d in dets]
    df = spark.createDataFrame(rows, "run_id long, frame long, ord long, x1 double, y1 double, x2 double, y2 double, class int, x double, y double, embedding array<double>").repartition(3)
    at = spark.createDataFrame(frames + frames[::7], "run_id long, frame long")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("1", old):  # all runs in one task, and dealt to some
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        for named in (at, at.where("run_id < 3")):  # a run that isn't named has the frames of its detections
            got = {(r.run_id, r.frame, r.ord, r.track_id, r.confirmed, r.hits, r.age) for r in tracker.tracked(df, named, p).collect()}
            assert got == want

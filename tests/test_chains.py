"""Camera chains against plain products of matrices; anchors against a plain choice."""

import random

import numpy as np
import pytest

from touchline.operators import chains as C


def wobble(rng):
    h = np.eye(3) + rng.normal(0, 0.01, (3, 3))
    h[:2, 2] += rng.normal(0, 3, 2)
    h[2, :2] *= 0.001
    return h * rng.uniform(0.5, 2)


def carried(anchors, steps, frames):
    """{frame: (anchor, n, h, drift, confidence)} going through frames in order."""
    out, at = {}, None
    for f in frames:
        if f in anchors:
            at = [f, 0, np.eye(3), 0.0]
        elif at is not None:
            h, inliers = steps[f]
            det = np.linalg.det(h)
            at[1] += 1
            at[2] = h / (np.sign(det) * abs(det) ** (1 / 3)) @ at[2]
            at[3] += np.hypot(h[0, 2], h[1, 2]) + 1000 * np.hypot(h[2, 0], h[2, 1])
            whole = at[2] @ anchors[at[0]]
            out[f] = (at[0], at[1], whole / whole[2, 2], at[3], (0.5 if inliers is None else inliers) * np.exp(-at[3] / 100) * np.exp(-at[1] / 100))
    return out


@pytest.fixture(scope="module")
def chain(spark):
    rng = np.random.default_rng(4)
    frames = [f for f in range(0, 2_600, 2) if f % 36]  # over a thousand frames behind one anchor: blocks of blocks
    anchors = {f: wobble(rng) for f in (10, 50, 54, 2_300)}
    steps = {w: {f: (wobble(rng), None if f % 10 == 0 else float(rng.uniform(0.3, 1))) for f in frames} for w in ("f", "b")}
    rows = lambda w: spark.createDataFrame([(3, f, h.ravel().tolist(), i) for f, (h, i) in steps[w].items()], "run_id long, frame long, h array<double>, inlier_ratio double").repartition(3)
    own = spark.createDataFrame([(3, f, h.ravel().tolist(), 0.9) for f, h in anchors.items()], "run_id long, frame long, h array<double>, confidence double")
    return frames, anchors, steps, own, rows("f"), rows("b")


def test_propagation(chain):
    frames, anchors, steps, own, forward, backward = chain
    for rows, want, back in ((forward, carried(anchors, steps["f"], frames), False), (backward, carried(anchors, steps["b"], frames[::-1]), True)):
        got = {r.frame: r for r in C.propagated(own, rows, back).collect()}
        assert got.keys() == want.keys() and max(w[1] for w in want.values()) > C.BLOCK**2
        for f, (anchor, n, h, drift, sure) in want.items():
            r = got[f]
            assert (r.anchor_frame, r.n) == (anchor, n) and r.drift == pytest.approx(drift) and r.confidence == pytest.approx(sure)
            assert np.allclose(r.h, h.ravel(), rtol=1e-6, atol=1e-9 * np.abs(h).max())


def test_merge_and_gaps(spark, chain):
    frames, anchors, steps, own, forward, backward = chain
    f, b = carried(anchors, steps["f"], frames), carried(anchors, steps["b"], frames[::-1])
    merged = C.merged_chains(own, C.propagated(own, forward), C.propagated(own, backward, True))
    got = {r.frame: r for r in merged.collect()}
    assert got.keys() == f.keys() | b.keys() | anchors.keys()
    assert all(got[x].source == "anchor" and np.allclose(got[x].h, h.ravel()) for x, h in anchors.items())
    assert got[2].source == "backward" and got[2].right_anchor == 10 and got[2_400].source == "forward"
    x, near, far = 30, 1 / 21, 1 / 21
    w = near / (near + far)
    h = w * anchors[10] + (1 - w) * anchors[50]
    assert got[x].source == "merged" and np.allclose(got[x].h, (h / h[2, 2]).ravel()) and got[x].confidence == pytest.approx(w * f[x][4] + (1 - w) * b[x][4])
    sampled = spark.createDataFrame([(3, x) for x in range(0, 2_600, 2)] + [(3, 10), (4, 2)], "run_id long, frame long")
    filled = {r.frame: r for r in C.filled_gaps(sampled, own, merged, 100).collect()}
    assert [x for x in filled if filled[x].source == "anchor"] and not filled[10].interpolated
    want = {x for x in got if x in anchors or x < 10 or 10 < x < 54 or 2_300 < x <= 2_400}
    assert filled.keys() == want and all(filled[x].interpolated for x in want - anchors.keys())
    assert C.filled_gaps(sampled, own, merged).count() == len(got)


def plain_choice(scores, least=2, most=5, quality=0.5, spacing=100, ratio=0.1):
    lo, hi = min(s[0] for s in scores), max(s[0] for s in scores)
    margin = int((hi - lo + 1) * ratio)
    for t in (quality, 0.4, 0.3, 0.2, 0.1, 0.0):
        fit = [s for s in scores if s[2] and s[1] >= t]
        if len(fit) < least:
            continue
        taken = []
        for s in sorted(fit, key=lambda s: (not (s[0] <= lo + margin or s[0] >= hi - margin), -s[1], s[0])):
            if len(taken) < most and all(abs(s[0] - x[0]) >= spacing for x in taken):
                taken.append(s)
        if len(taken) >= least:
            return {(s[0], s[1], t) for s in taken}
    return {(s[0], s[1], None) for s in sorted((s for s in scores if s[2]), key=lambda s: (-s[1], s[0]))[:least]}


def test_selected_anchors(spark):
    rng, runs = random.Random(5), {}
    for run in range(30):
        frames = sorted(rng.sample(range(60 if run % 5 == 0 else 1_500), 40))
        runs[run] = [(f, round(rng.random() * (0.45 if run % 3 == 0 else 1.0), 2), rng.random() < (0.05 if run % 4 == 0 else 0.8)) for f in frames]
    df = spark.createDataFrame([(r, *s) for r, own in runs.items() for s in own], "run_id long, frame long, quality double, success boolean").repartition(4)
    got: dict = {}
    for r in C.selected_anchors(df).collect():
        got.setdefault(r.run_id, set()).add((r.frame, r.quality, r.threshold))
    for run, own in runs.items():
        assert got.get(run, set()) == plain_choice(own), run

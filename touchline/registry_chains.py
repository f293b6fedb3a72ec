"""Queries of camera chains and anchors over the ball's path, and their SQL; registry.py takes them in."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import chains as C
from .plans.staging import stored


def steps(t, backward=False):
    """A step per ball observation: the shift from the one before (after, if backward), a small turn and perspective by its confidence."""
    near = (F.lead if backward else F.lag)(F.struct("x", "y")).over(Window.partitionBy("run_id").orderBy("frame"))
    c = F.col("confidence") - 0.5
    h = F.array(F.lit(1.0), -c / 200, F.coalesce(F.col("x") - F.col("near.x"), F.lit(0.0)), c / 200, F.lit(1.0), F.coalesce(F.col("y") - F.col("near.y"), F.lit(0.0)), F.lit(0.0), c / 100_000, F.lit(1.0))
    return t["ball"].withColumn("near", near).select("run_id", "frame", h.alias("h"), F.when(F.col("frame") % 17 != 0, F.col("confidence")).alias("inlier_ratio"))


def anchors(t):
    h = F.array(12 + F.col("x") / 100, F.lit(1.5), 960 + F.col("x"), F.lit(0.5), F.col("y") / 100 - 9, 540 + F.col("y"), F.lit(0.0005), F.lit(-0.004), F.lit(1.0))
    return t["ball"].where("frame % 250 BETWEEN 97 AND 98").select("run_id", "frame", h.alias("h"), "confidence")


def _shown(df):
    """df with the entries of h but the last as columns, rounded as the other figures are."""
    own = [F.round(c, 6).alias(c) if c in ("drift", "confidence") else F.col(c) for c in df.columns if c != "h"]
    return df.select(*own, *((F.round(F.get("h", F.lit(i)), 6) + 0.0).alias(f"h{i}") for i in range(8)))


def _merged(t):
    own = stored(anchors(t), "anchors")
    return C.merged_chains(own, C.propagated(own, steps(t)), C.propagated(own, steps(t, True), backward=True))


def _filled(t):
    return C.filled_gaps(t["players"].select("run_id", "frame"), anchors(t), _merged(t), max_gap=120)


def _scores(t):
    return t["ball"].select("run_id", "frame", F.col("confidence").alias("quality"), (F.col("frame") % 4 != 1).alias("success"))


def _times(a: str, b: str) -> str:
    return "[" + ", ".join(" + ".join(f"{a}[{3 * i + k + 1}] * {b}[{3 * k + j + 1}]" for k in range(3)) for i in range(3) for j in range(3)) + "]"


def _chain(name: str, near: str, order: str) -> dict:
    det = "(h[1] * (h[5] * h[9] - h[6] * h[8]) - h[2] * (h[4] * h[9] - h[6] * h[7]) + h[3] * (h[4] * h[8] - h[5] * h[7]))"
    return {
        f"{name}s": f"""(SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY frame {order}) AS i, CASE WHEN abs(det) > 1e-6 THEN list_transform(h, lambda v: v / (sign(det) * pow(abs(det), 1.0::DOUBLE / 3.0::DOUBLE))) ELSE h END AS unit FROM (SELECT *, {det} AS det FROM (
          SELECT b.run_id, b.frame, [1.0::DOUBLE, -(b.confidence - 0.5) / 200, coalesce(b.x - {near}(b.x) OVER w, 0), (b.confidence - 0.5) / 200, 1.0, coalesce(b.y - {near}(b.y) OVER w, 0), 0.0, (b.confidence - 0.5) / 100000, 1.0]::DOUBLE[] AS h, CASE WHEN b.frame % 17 <> 0 THEN b.confidence END AS inliers, a.h AS ah
          FROM ball b LEFT JOIN an a ON a.run_id = b.run_id AND a.frame = b.frame WINDOW w AS (PARTITION BY b.run_id ORDER BY b.frame))))""",
        name: f"""(SELECT run_id, frame, anchor_frame, CAST(n AS BIGINT) AS n, list_transform(p, lambda v: v / p[9]) AS h, drift, coalesce(inliers, 0.5) * exp(-drift / 100) * exp(-n / 100.0::DOUBLE) AS confidence FROM (SELECT *, {_times('acc', 'ah')} AS p FROM (
          WITH RECURSIVE go AS (SELECT DISTINCT run_id, 0::BIGINT AS i, NULL::BIGINT AS frame, NULL::BIGINT AS anchor_frame, NULL::DOUBLE[] AS ah, NULL::DOUBLE[] AS acc, 0 AS n, 0.0::DOUBLE AS drift, NULL::DOUBLE AS inliers FROM {name}s UNION ALL
            SELECT s.run_id, s.i, s.frame, CASE WHEN s.ah IS NULL THEN g.anchor_frame ELSE s.frame END, coalesce(s.ah, g.ah), CASE WHEN s.ah IS NOT NULL OR g.anchor_frame IS NULL THEN NULL WHEN g.acc IS NULL THEN s.unit ELSE {_times('s.unit', 'g.acc')} END,
              CASE WHEN s.ah IS NOT NULL THEN 0 ELSE g.n + 1 END, CASE WHEN s.ah IS NOT NULL THEN 0 ELSE g.drift + (sqrt(s.h[3] * s.h[3] + s.h[6] * s.h[6]) + sqrt(s.h[7] * s.h[7] + s.h[8] * s.h[8]) * 1000) END, s.inliers
            FROM go g JOIN {name}s s ON s.run_id = g.run_id AND s.i = g.i + 1)
          SELECT * FROM go) WHERE acc IS NOT NULL))""",
    }


_SHOWN = ", ".join(f"round(h[{i + 1}], 6) + 0.0 AS h{i}" for i in range(8)) + ", round(confidence, 6) AS confidence"
CTES = {
    "an": "(SELECT run_id, frame, [12 + x / 100, 1.5, 960 + x, 0.5, y / 100 - 9, 540 + y, 0.0005, -0.004, 1.0]::DOUBLE[] AS h, confidence FROM ball WHERE frame % 250 BETWEEN 97 AND 98)",
    **_chain("fw", "lag", ""),
    **_chain("bw", "lead", "DESC"),
    "mc": """(SELECT run_id, frame, h, confidence, 'anchor' AS source, frame AS left_anchor, frame AS right_anchor FROM an UNION ALL
      SELECT run_id, frame, CASE WHEN source = 'merged' THEN list_transform(m, lambda v: v / m[9]) ELSE coalesce(fh, bh) END, CASE source WHEN 'merged' THEN w * fc + (1 - w) * bc ELSE coalesce(fc, bc) END, source, la, ra FROM (
      SELECT *, list_transform(range(1, 10), lambda i: w * lh[i] + (1 - w) * rh[i]) AS m FROM (SELECT coalesce(f.run_id, b.run_id) AS run_id, coalesce(f.frame, b.frame) AS frame, f.h AS fh, b.h AS bh, f.confidence AS fc, b.confidence AS bc, f.anchor_frame AS la, b.anchor_frame AS ra, l.h AS lh, r.h AS rh,
        CASE WHEN f.h IS NULL THEN 'backward' WHEN b.h IS NULL THEN 'forward' ELSE 'merged' END AS source, (1.0::DOUBLE / (abs(f.frame - f.anchor_frame) + 1)) / (1.0::DOUBLE / (abs(f.frame - f.anchor_frame) + 1) + 1.0::DOUBLE / (abs(b.frame - b.anchor_frame) + 1)) AS w
        FROM fw f FULL JOIN bw b ON f.run_id = b.run_id AND f.frame = b.frame LEFT JOIN an l ON l.run_id = f.run_id AND l.frame = f.anchor_frame LEFT JOIN an r ON r.run_id = b.run_id AND r.frame = b.anchor_frame)))""",
}

ENTRIES = {
    "propagated_forward": (lambda t: _shown(C.propagated(stored(anchors(t), "anchors"), steps(t))), f"SELECT run_id, frame, anchor_frame, n, round(drift, 6) AS drift, {_SHOWN} FROM fw"),
    "merged_chains": (lambda t: _shown(_merged(t)), f"SELECT run_id, frame, source, left_anchor, right_anchor, {_SHOWN} FROM mc"),
    "filled_gaps": (
        lambda t: _shown(_filled(t)),
        f"""SELECT f.run_id, f.frame, mc.source, l AS left_anchor, r AS right_anchor, NOT own AS interpolated, {_SHOWN} FROM (SELECT *, max(CASE WHEN own THEN frame END) OVER (PARTITION BY run_id ORDER BY frame) AS l, min(CASE WHEN own THEN frame END) OVER (PARTITION BY run_id ORDER BY frame DESC) AS r
          FROM (SELECT p.run_id, p.frame, an.frame IS NOT NULL AS own FROM (SELECT DISTINCT run_id, frame FROM players) p LEFT JOIN an ON an.run_id = p.run_id AND an.frame = p.frame)) f JOIN mc ON mc.run_id = f.run_id AND mc.frame = f.frame
          WHERE own OR CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN r - l <= 120 ELSE abs(f.frame - coalesce(l, r)) <= 120 END""",
    ),
    "selected_anchors": (
        lambda t: C.selected_anchors(_scores(t)),
        """SELECT p.run_id, p.frame, b.confidence AS quality, p.threshold FROM (SELECT run_id, threshold, unnest(frames) AS frame FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY threshold DESC) AS first FROM (SELECT * FROM (
          WITH RECURSIVE sc AS (SELECT run_id, frame, confidence AS q, CASE WHEN frame <= lo + floor((hi - lo + 1) * 0.1::DOUBLE) OR frame >= hi - floor((hi - lo + 1) * 0.1::DOUBLE) THEN 0 ELSE 1 END AS inside, frame % 4 <> 1 AS good FROM (SELECT *, min(frame) OVER (PARTITION BY run_id) AS lo, max(frame) OVER (PARTITION BY run_id) AS hi FROM ball)),
          th AS (SELECT run_id, t AS threshold, count(*) FILTER (good AND q >= t) AS n FROM sc, (VALUES (0.5::DOUBLE), (0.4), (0.3), (0.2), (0.1), (0.0)) v(t) GROUP BY ALL),
          go AS (SELECT run_id, threshold, []::BIGINT[] AS frames FROM th WHERE n >= 2 UNION ALL
            SELECT g.run_id, g.threshold, list_append(g.frames, c.frame) FROM go g, LATERAL (SELECT frame FROM sc WHERE sc.run_id = g.run_id AND good AND q >= g.threshold AND len(list_filter(g.frames, lambda f: abs(f - sc.frame) < 100)) = 0 ORDER BY inside, q DESC, frame LIMIT 1) c WHERE len(g.frames) < 5)
          SELECT run_id, threshold, arg_max(frames, len(frames)) AS frames FROM go GROUP BY ALL) WHERE len(frames) >= 2)) WHERE first = 1) p JOIN ball b ON b.run_id = p.run_id AND b.frame = p.frame""",
    ),
}

"""Queries of running speed and carrier, and their recursive SQL; registry.py takes them in."""

from __future__ import annotations

from pyspark.sql import functions as F

from .streaming import live as V


def _speeds(t):
    hidden = (F.col("frame") + F.col("ord") * 37) % 400 < 30  # as behind others
    place = lambda c: F.when(~hidden, F.col(c)).alias(c)
    rows = t["players"].select("run_id", F.col("ord").alias("track_id"), "frame", place("x"), place("y"))
    return V.running_speeds(rows).select("run_id", "track_id", "frame", F.round("speed", 6).alias("speed"))


def _carriers(t):
    return V.carriers(V.nearest_carriers(t["players"].select("run_id", "frame"), t["ball"], t["players"], t["teams"]))


ENTRIES = {
    "running_speeds": (
        _speeds,
        """SELECT run_id, track_id, frame, round(speed, 6) AS speed FROM (WITH RECURSIVE a AS (SELECT run_id, ord AS track_id, frame, x, y, coalesce(frame - lag(frame) OVER w > 25, true) AS new, row_number() OVER w AS i FROM players WHERE (frame + ord * 37) % 400 >= 30 WINDOW w AS (PARTITION BY run_id, ord ORDER BY frame)),
          b AS (SELECT *, sum(new::INT) OVER (PARTITION BY run_id, track_id ORDER BY frame) AS part FROM a),
          c AS (SELECT *, first_value(frame) OVER w AS f0, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0 FROM b WINDOW w AS (PARTITION BY run_id, track_id, part ORDER BY frame ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
          d AS (SELECT *, CASE WHEN frame > f0 THEN least(15.0::DOUBLE, sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0)) / ((frame - f0) / 25.0::DOUBLE)) END AS now FROM c),
          go AS (SELECT run_id, track_id, frame, i, now AS speed FROM d WHERE i = 1 UNION ALL
            SELECT d.run_id, d.track_id, d.frame, d.i, CASE WHEN d.now IS NULL THEN NULL WHEN d.new OR g.speed IS NULL THEN d.now ELSE 0.4::DOUBLE * d.now + 0.6::DOUBLE * g.speed END FROM go g JOIN d ON d.run_id = g.run_id AND d.track_id = g.track_id AND d.i = g.i + 1)
          SELECT * FROM go)""",
    ),
    "carriers": (
        _carriers,
        """SELECT run_id, frame, carrier FROM (WITH RECURSIVE n AS (SELECT f.run_id, f.frame, first(p.player_id ORDER BY sqrt((p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y)), p.ord) FILTER (sqrt((p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y)) <= 2.0) AS near
            FROM (SELECT DISTINCT run_id, frame FROM players) f LEFT JOIN ball b ON b.run_id = f.run_id AND b.frame = f.frame LEFT JOIN (SELECT p.* FROM players p JOIN teams t ON t.player_id = p.player_id AND t.team IN ('team_A', 'team_B')) p ON p.run_id = f.run_id AND p.frame = f.frame GROUP BY ALL),
          s AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY frame) AS i FROM n),
          go AS (SELECT DISTINCT run_id, 0::BIGINT AS i, NULL::BIGINT AS frame, NULL::VARCHAR AS carrier, NULL::VARCHAR AS pending, 0 AS c FROM s UNION ALL
            SELECT s.run_id, s.i, s.frame, CASE WHEN near IS NULL THEN NULL WHEN near = carrier THEN carrier WHEN CASE WHEN near = pending THEN c + 1 ELSE 1 END >= 5 THEN near ELSE carrier END,
              CASE WHEN near IS NULL OR near IS NOT DISTINCT FROM carrier OR CASE WHEN near = pending THEN c + 1 ELSE 1 END >= 5 THEN NULL ELSE near END,
              CASE WHEN near IS NULL OR near IS NOT DISTINCT FROM carrier OR CASE WHEN near = pending THEN c + 1 ELSE 1 END >= 5 THEN 0 WHEN near = pending THEN c + 1 ELSE 1 END
            FROM go g JOIN s ON s.run_id = g.run_id AND s.i = g.i + 1)
          SELECT * FROM go WHERE i > 0)""",
    ),
}

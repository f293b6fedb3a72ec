"""Match tables derived from the test star schema, the same arithmetic in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import staging
from ..plans.staging import stored, stored_by_run

#: Frames a run holds; every windowed operator works within a run.
RUN_FRAMES = 1_500
#: Runs to a bucket, so that a task's rows don't grow with the table, and the least number of buckets where there are as many runs.
BUCKET_RUNS, LEAST_BUCKETS = 10, 64

#: {D} marks a double literal: D in Spark, ::DOUBLE in DuckDB.
VIEWS = """
fr AS (SELECT CAST(o_orderkey AS BIGINT) AS frame, CAST(floor(o_orderkey / 150.0) AS BIGINT) AS b, CAST(o_orderkey % 150 AS BIGINT) AS t FROM orders),
en AS (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation),
pos AS (SELECT f.frame, e.k,
   abs((f.frame*(5+e.k%16) + 911*e.k) % 20000 - 10000) - 5000 AS xc,
   abs((f.frame*(3+e.k%7) + 977*e.k) % 12800 - 6400) - 3200 AS yc
   FROM fr f CROSS JOIN en e),
teams AS (SELECT concat('P', CAST(k AS VARCHAR(4))) AS player_id,
   CASE WHEN k<11 THEN 'team_A' WHEN k<22 THEN 'team_B' WHEN k=22 THEN 'referee' WHEN k=23 THEN 'linesman' ELSE 'unknown' END AS team FROM en),
players AS (SELECT CAST(floor(frame / {R}.0) AS BIGINT) AS run_id, frame, k AS ord, concat('P', CAST(k AS VARCHAR(4))) AS player_id,
   CAST(xc AS DOUBLE)/100.0{D} AS x, CAST(yc AS DOUBLE)/100.0{D} AS y FROM pos WHERE (frame*31 + k*17) % 23 <> 0),
seg AS (SELECT frame, b, t, (b*7)%22 AS h0, ((b+1)*7)%22 AS h1, b*150+100 AS f0, (b+1)*150 AS f1 FROM fr),
kk AS (SELECT s.frame, s.b, s.t,
   abs((s.frame*(5+s.h0%16) + 911*s.h0) % 20000 - 10000) - 5000 AS hx, abs((s.frame*(3+s.h0%7) + 977*s.h0) % 12800 - 6400) - 3200 AS hy,
   abs((s.f0*(5+s.h0%16) + 911*s.h0) % 20000 - 10000) - 5000 AS ax, abs((s.f0*(3+s.h0%7) + 977*s.h0) % 12800 - 6400) - 3200 AS ay,
   CASE WHEN s.b%6=5 THEN (CASE WHEN s.b%12=5 THEN 5400 ELSE -5400 END) ELSE abs((s.f1*(5+s.h1%16) + 911*s.h1) % 20000 - 10000) - 5000 END AS bx,
   CASE WHEN s.b%6=5 THEN (s.b%5-2)*200 ELSE abs((s.f1*(3+s.h1%7) + 977*s.h1) % 12800 - 6400) - 3200 END AS by_
   FROM seg s),
ball AS (SELECT CAST(floor(frame / {R}.0) AS BIGINT) AS run_id, frame,
   CASE WHEN t<100 THEN CAST(hx+20 AS DOUBLE)/100.0{D} ELSE (CAST(ax+20 AS DOUBLE) + CAST(bx-ax-20 AS DOUBLE)*CAST(t-100 AS DOUBLE)/50.0{D})/100.0{D} END AS x,
   CASE WHEN t<100 THEN CAST(hy+10 AS DOUBLE)/100.0{D} ELSE (CAST(ay+10 AS DOUBLE) + CAST(by_-ay-10 AS DOUBLE)*CAST(t-100 AS DOUBLE)/50.0{D})/100.0{D} END AS y,
   CAST(5 + (frame*13)%95 AS DOUBLE)/100.0{D} AS confidence
   FROM kk WHERE frame % 97 >= 3)"""


#: Whole divisions of frames: a decimal for each row in Spark as they stand, so there they are done in whole numbers.
_DIVISIONS = {f"CAST(floor({c} / {n}.0) AS BIGINT)": f"CAST(({c} - pmod({c}, {n})) DIV {n} AS BIGINT)" for c, n in (("o_orderkey", "150"), ("frame", "{R}"))}


def duckdb_views() -> str:
    return VIEWS.replace("{D}", "::DOUBLE").replace("{R}", str(RUN_FRAMES))


def spark_views() -> str:
    """The views over {orders} and {nation}."""
    views = VIEWS
    for decimal, whole in _DIVISIONS.items():
        views = views.replace(decimal, whole)
    return views.replace("{D}", "D").replace("{R}", str(RUN_FRAMES)).replace("FROM orders", "FROM {orders}").replace("FROM nation", "FROM {nation}")


_STORED: dict = {}


def match_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """ball(run_id, frame, x, y, confidence), players(run_id, frame, ord, player_id, x, y), teams(player_id, team).

    Derived once per session and folder, and stored: queries read them as they would a real match's
    tables. ball and players are bucketed by run, so windows, groups and joins within a run or a frame
    move no rows; only the frames' numbers are shuffled, before players are derived from them.
    """
    key = (spark.sparkContext.applicationId, sf_dir, staging.removed)
    if key not in _STORED:
        orders, nation = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("orders", "nation"))
        run_id = F.floor(F.col("o_orderkey") / float(RUN_FRAMES)).cast("long")
        runs = orders.select(F.approx_count_distinct(run_id)).first()[0]
        buckets = max(min(runs, LEAST_BUCKETS), -(-runs // BUCKET_RUNS), 1)
        frames = orders.select("o_orderkey").repartition(buckets, run_id)
        derived = {name: spark.sql(f"WITH {spark_views()} SELECT * FROM {name}", orders=frames, nation=F.broadcast(nation)) for name in ("ball", "players", "teams")}
        _STORED[key] = {name: stored_by_run(derived[name], name, buckets) for name in ("ball", "players")} | {"teams": stored(derived["teams"], "teams")}
    return _STORED[key]

"""Folders of one match run: tracks, teams, ball and events as JSON, read to rows and written from rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.presets import TEMPLATE, Preset

TRACK = "track_id string, bbox array<double>, confidence double, pitch_position array<double>, player_id string, orig_track_id long, team string, role string, jersey_number int, jersey_confidence double"
BALL = "confidence double, pitch_position array<double>, height double, on_ground boolean, predicted boolean"
EVENT = (
    "event_id string, type string, frame long, match_time double, player_id string, team_id string, start_frame long, end_frame long, "
    "start_position array<double>, end_position array<double>, confidence double, metadata map<string,string>"
)
#: Where each table may lie in a run's folder, the preferred place first.
PLACES = {
    "tracks": ("track_consolidation/tracks.json", "tracking/tracks.json", "stage2/tracks.json"),
    "teams": ("track_consolidation/team_assignments.json", "tracking/team_assignments.json"),
    "ball": ("tracking/ball_tracks.json", "stage2/ball_tracks.json"),
    "events": ("event_detection/events.json", "stage3/events.json"),
}


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def place_of(spark: SparkSession, run_dir: str, table: str, prefer: str | None = None) -> str | None:
    """The first place of a table that exists, those whose folder is `prefer` before others; None where there is none."""
    places = sorted(PLACES[table], key=lambda p: not (prefer and p.startswith(prefer)))
    return next((f"{run_dir}/{p}" for p in places if exists(spark, f"{run_dir}/{p}")), None)


def _document(spark: SparkSession, path: str | None, kind: str) -> DataFrame:
    """One row (doc) with a JSON document of a given type; none where there is no file. A document is one file and so one task."""
    if path is None:
        return spark.createDataFrame([], f"doc {kind}")
    return spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("doc")).where("doc IS NOT NULL")


def read_tracks(spark: SparkSession, run_dir: str, run_id: str, prefer: str = "track_consolidation") -> DataFrame:
    """run_id, frame, ord, player_id, x1, y1, x2, y2, confidence, x, y, team, role, jersey_number of consolidated tracks, or raw ones where there are none.

    ord is the place in the frame's list. A raw track's id stands for the player's.
    """
    docs = _document(spark, place_of(spark, run_dir, "tracks", prefer), f"map<string,array<struct<{TRACK}>>>")
    frames = docs.select(F.explode("doc").alias("frame", "rows"))
    rows = frames.select(F.col("frame").cast("long").alias("frame"), F.posexplode("rows").alias("ord", "t"))
    at = lambda c, i, n: F.get(f"t.{c}", F.lit(i)).alias(n)
    return rows.select(
        F.lit(run_id).alias("run_id"), "frame", F.col("ord").cast("long").alias("ord"), F.coalesce("t.player_id", "t.track_id").alias("player_id"),
        *(at("bbox", i, n) for i, n in enumerate(("x1", "y1", "x2", "y2"))), "t.confidence", at("pitch_position", 0, "x"), at("pitch_position", 1, "y"), "t.team", "t.role", "t.jersey_number",
    )


def read_teams(spark: SparkSession, run_dir: str) -> DataFrame:
    """player_id, team."""
    return _document(spark, place_of(spark, run_dir, "teams"), "map<string,string>").select(F.explode("doc").alias("player_id", "team"))


def read_ball(spark: SparkSession, run_dir: str, run_id: str) -> DataFrame:
    """run_id, frame, x, y, height, confidence, predicted."""
    rows = _document(spark, place_of(spark, run_dir, "ball"), f"map<string,struct<{BALL}>>").select(F.explode("doc").alias("frame", "b"))
    return rows.select(F.lit(run_id).alias("run_id"), F.col("frame").cast("long").alias("frame"), F.get("b.pitch_position", F.lit(0)).alias("x"), F.get("b.pitch_position", F.lit(1)).alias("y"), "b.height", "b.confidence", "b.predicted")


def read_events(spark: SparkSession, run_dir: str, run_id: str) -> DataFrame:
    """Events of a run with its id, from a JSON list or from lines as write_events() writes them."""
    path = place_of(spark, run_dir, "events")
    if path is None:
        return spark.createDataFrame([], "run_id string, " + EVENT)
    return spark.read.schema(EVENT).option("multiLine", "true").json(path).select(F.lit(run_id).alias("run_id"), "*")


def match_context(spark: SparkSession, run_dir: str, run_id: str) -> dict[str, DataFrame]:
    """All tables of a run; one whose file is missing is empty, but a run without tracks is an error."""
    if place_of(spark, run_dir, "tracks") is None:
        raise FileNotFoundError(f"{run_dir} has no tracks")
    return {"players": read_tracks(spark, run_dir, run_id), "teams": read_teams(spark, run_dir), "ball": read_ball(spark, run_dir, run_id), "events": read_events(spark, run_dir, run_id)}


#: The field's and the goal's sizes where nothing says otherwise.
DEFAULT_SIZES = {"pitch_length": 105.0, "pitch_width": 68.0, "goal_length": 7.32, "goal_height": 2.44}


def resolve_sizes(given: dict | None = None, config: dict | None = None, profiles: dict | None = None, video_info: dict | None = None) -> dict:
    """Sizes by the first that names them: the caller, the configuration's pitch or its named profile, the video's facts, the default."""
    config, profiles = config or {}, profiles or {}
    named = profiles.get(config.get("pitch_type"), {})
    sources = (given or {}, config.get("pitch") or {}, named, video_info or {}, DEFAULT_SIZES)
    return {k: next(float(s[k]) for s in sources if s.get(k) is not None) for k in DEFAULT_SIZES}


def runs_by_video(runs: DataFrame) -> DataFrame:
    """video, place, run_id, started of runs(run_id, video, started): each video's runs, the newest first and those without a time last."""
    place = F.row_number().over(Window.partitionBy("video").orderBy(F.desc_nulls_last("started"), "run_id")).cast("long")
    return runs.select("video", place.alias("place"), "run_id", "started")


def event_records(events: DataFrame) -> DataFrame:
    """events as they are written: times and confidences to three places, positions to two."""
    have = lambda c, of: of(c).alias(c)
    rounded = {"match_time": lambda c: F.round(c, 3), "confidence": lambda c: F.round(c, 3)} | {c: lambda c: F.transform(c, lambda v: F.round(v, 2)) for c in ("start_position", "end_position")}
    return events.select(*(have(c, rounded[c]) if c in rounded else F.col(c) for c in events.columns))


def write_events(events: DataFrame, run_dir: str) -> None:
    """events.json and goals.json of a run, a line per event; fields without a value are left out."""
    records = event_records(events)
    records.write.mode("overwrite").json(f"{run_dir}/event_detection/events.json")
    records.where("type = 'goal'").write.mode("overwrite").json(f"{run_dir}/event_detection/goals.json")


def consolidated(tracks: DataFrame, mapping: DataFrame) -> DataFrame:
    """tracks(run_id, track_id, ...) with player_id, team and role of mapping(run_id, track_id, player_id, team, role); others are 'unmapped-' and their id, of role other and team unknown."""
    own = tracks.drop("player_id", "team", "role")
    joined = own.join(mapping, ["run_id", "track_id"], "left")
    return joined.select(*own.columns, F.coalesce("player_id", F.concat(F.lit("unmapped-"), F.col("track_id").cast("string"))).alias("player_id"), F.coalesce("team", F.lit("unknown")).alias("team"), F.coalesce("role", F.lit("other")).alias("role"))


def tracking_statistics(tracks: DataFrame, frames: DataFrame) -> DataFrame:
    """run_id, unique_tracks, avg_tracks_per_frame over all frames(run_id, frame), those without a track included."""
    counts = frames.groupBy("run_id").agg(F.count("*").alias("all"))
    own = tracks.groupBy("run_id").agg(F.count_distinct("player_id").alias("unique_tracks"), F.count("*").alias("rows"))
    return counts.join(own, "run_id", "left").select("run_id", F.coalesce("unique_tracks", F.lit(0)).alias("unique_tracks"), (F.coalesce("rows", F.lit(0)) / F.col("all")).alias("avg_tracks_per_frame"))


def exported_boxes(boxes: DataFrame, p: Preset = TEMPLATE) -> DataFrame:
    """run_id, frame_id (from one), track_id, x, y, w, h, confidence: boxes by corner and size, for other trackers' tools; a missing confidence is 1."""
    return boxes.select("run_id", (F.col("frame") + 1).alias("frame_id"), "track_id", F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))

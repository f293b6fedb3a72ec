"""From tracks to people: likeness edges, constrained components, votes, merges, names; officials and goalkeepers.

Pairs, edges, votes and centroids are Spark joins and groups. What depends on an order within a
match - which merge comes first - is decided per run over its tracks, a few hundred rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.presets import TEMPLATE, Preset
from ..plans.staging import stored
from .squads import cluster_numbers, cluster_teams

#: Cosine of one person's tracks, of a track absorbed by a named person, and of tracks that also share a number;
#: least confidence of a track's number to count in its cluster, and least score of a number to hold tracks apart.
SAME_PERSON, ABSORBED, SAME_NUMBER, NUMBER_CONFIDENCE, STRONG_NUMBER = 0.9, 0.92, 0.8, 0.6, 1.0
#: Frames whose bits make one whole number.
BLOCK_FRAMES = 63
#: Reach of a goalkeeper from the own goal line and from the field's long axis, and bonuses of the choice.
GOAL_AREA, KEEPER_OFF_AXIS, KEEPER_TRACK_BONUS, KEEPER_ROLE_BONUS = 16.5, 6.0, 0.25, 5.0


def cooccurring(rows: DataFrame) -> DataFrame:
    """run_id, a, b: tracks a < b seen in one frame; rows(run_id, frame, track_id).

    Each track's frames are bits of blocks of 63 frames, so tracks meet once in a block and not in
    each of its frames; a pair counts where bits of both agree.
    """
    at = F.pmod("frame", F.lit(BLOCK_FRAMES))
    bits = rows.where("run_id IS NOT NULL AND frame IS NOT NULL AND track_id IS NOT NULL").groupBy("run_id", (F.col("frame") - at).alias("block"), "track_id").agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(frame, {BLOCK_FRAMES}) AS INT))")).alias("bits"))
    met = bits.groupBy("run_id", "block").agg(F.collect_list(F.struct("track_id", "bits")).alias("tracks"))
    pairs = met.select("run_id", "tracks", F.explode("tracks").alias("x")).select("run_id", F.col("x.track_id").alias("a"), F.explode(F.filter("tracks", lambda y: (y["track_id"] > F.col("x.track_id")) & (y["bits"].bitwiseAND(F.col("x.bits")) != 0))["track_id"]).alias("b"))
    return pairs.distinct()


def _cosine(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def _by_run(df: DataFrame):
    """df grouped by run, its columns named anew: both sides of a cogroup may come from one table."""
    return df.select(*(F.col(c).alias(c) for c in df.columns)).groupBy("run_id")


def _known(team: Column) -> Column:
    return ~F.coalesce(team, F.lit("")).isin("unknown", "")


def strong_number(candidates: Column) -> Column:
    """The best candidate's number if its score is strong enough to hold tracks apart."""
    first = F.get(candidates, F.lit(0))
    return F.when(first["score"] >= STRONG_NUMBER, first["number"])


def same_person_edges(tracks: DataFrame, pairs: DataFrame, threshold: float = SAME_PERSON) -> DataFrame:
    """run_id, a, b, likeness: tracks of one run with alike centroids that nothing holds apart.

    tracks(run_id, track_id, team, candidates, centroid): candidates is array<struct<number, score>>,
    best first; centroid has length 1 or is null. pairs(run_id, a, b), a < b, were seen together.
    Different known teams, different strong numbers and pairs seen together make no edge.
    """
    own = tracks.where("centroid IS NOT NULL").select("run_id", "track_id", "team", strong_number(F.col("candidates")).alias("strong"), "centroid")
    side = lambda s: own.select("run_id", *(F.col(c).alias(f"{s}_{c}") for c in own.columns[1:]))
    both = side("x").join(side("y"), "run_id").where("x_track_id < y_track_id")
    both = both.where(~(_known(F.col("x_team")) & _known(F.col("y_team")) & (F.col("x_team") != F.col("y_team")))).where("x_strong IS NULL OR y_strong IS NULL OR x_strong = y_strong")
    edges = both.select("run_id", F.col("x_track_id").alias("a"), F.col("y_track_id").alias("b"), _cosine(F.col("x_centroid"), F.col("y_centroid")).alias("likeness"))
    return edges.where(F.col("likeness") >= threshold).join(pairs, ["run_id", "a", "b"], "left_anti")


def _components(tracks: pa.Table, links: pa.Table) -> pa.Table:
    """Cluster of each track of one run: edges by falling likeness join components unless a member of one is barred from a member of the other."""
    run_id = (tracks if tracks.num_rows else links).column("run_id")[0].as_py()
    ids = tracks.column("track_id").to_pylist()
    group = {t: [t] for t in ids}  # members by least member
    of, foes = {t: t for t in ids}, {t: set() for t in ids}
    team, number = (dict(zip(ids, tracks.column(c).to_pylist())) for c in ("known_team", "strong"))
    edges = []
    for a, b, likeness in zip(*(links.column(c).to_pylist() for c in ("a", "b", "likeness"))):
        if a in of and b in of:
            if likeness is None:
                foes[a].add(b)
                foes[b].add(a)
            else:
                edges.append((-likeness, a, b))
    differ = lambda of_, a, b: of_[a] is not None and of_[b] is not None and of_[a] != of_[b]
    for _, a, b in sorted(edges):
        a, b = sorted((of[a], of[b]))
        if a == b or differ(team, a, b) or differ(number, a, b) or not foes[a].isdisjoint(group[b]):
            continue
        for t in group[b]:
            of[t] = a
        group[a] += group.pop(b)
        foes[a] |= foes.pop(b)
        team[a], number[a] = (x[b] if x[a] is None else x[a] for x in (team, number))
    return pa.table({"run_id": pa.array([run_id] * len(ids), pa.int64()), "track_id": pa.array(ids, pa.int64()), "cluster": pa.array([of[t] for t in ids], pa.int64())})


def constrained_components(tracks: DataFrame, pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """run_id, track_id, cluster: clusters of edges, strongest first, that never hold two tracks of a pair, of two teams or of two strong numbers.

    A cluster is named by its least track. tracks and pairs are as same_person_edges() takes them; a
    track without an edge is a cluster of its own. Of equal edges that of the lower tracks comes first.
    """
    links = pairs.select("run_id", "a", "b", F.lit(None).cast("double").alias("likeness")).union(edges.select("run_id", "a", "b", "likeness"))
    own = tracks.select("run_id", F.col("track_id").cast("long").alias("track_id"), F.when(_known(F.col("team")), F.col("team")).alias("known_team"), strong_number(F.col("candidates")).alias("strong"))
    return _by_run(own).cogroup(_by_run(links)).applyInArrow(_components, "run_id long, track_id long, cluster long")


def voted_clusters(tracks: DataFrame, members: DataFrame, min_confidence: float = NUMBER_CONFIDENCE) -> DataFrame:
    """run_id, cluster, ord, n_tracks, team, role, number, confidence, centroid: what the tracks of a cluster vote for.

    tracks(run_id, track_id, ord, team, role, frames, number, confidence, candidates, centroid). A
    track votes with all its candidates, or with its number where it has none; not at all where it has
    a number under the least confidence. The centroid is the normalised mean of the tracks'.
    """
    rows = tracks.join(members, ["run_id", "track_id"])
    own = F.when(F.col("number").isNotNull(), F.array(F.struct(F.col("number").alias("number"), F.col("confidence").alias("score"))))
    votes = rows.select("run_id", "cluster", "track_id", "ord", F.when(F.col("number").isNull(), 1.0).otherwise(F.col("confidence")).alias("track_confidence"), F.posexplode(F.when(F.size("candidates") > 0, F.col("candidates")).otherwise(own)).alias("pos", "c"))
    votes = votes.select("run_id", "cluster", "track_id", (F.col("ord") * 1_000 + F.col("pos")).alias("ord"), F.col("c.number").alias("number"), F.col("c.score").alias("score"), "track_confidence")
    numbers, teams = cluster_numbers(votes, min_confidence), cluster_teams(rows)
    cells = rows.select("run_id", "cluster", F.posexplode("centroid").alias("pos", "v")).groupBy("run_id", "cluster", "pos").agg(F.avg("v").alias("m"))
    mean = cells.groupBy("run_id", "cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))
    length = F.sqrt(_cosine(F.col("mean"), F.col("mean")))
    mean = mean.select("run_id", "cluster", F.when(length >= 1e-6, F.transform("mean", lambda v: v / length)).alias("centroid"))
    found = rows.groupBy("run_id", "cluster").agg(F.min("ord").alias("ord"), F.count("*").alias("n_tracks"))
    found = found.join(teams, ["run_id", "cluster"], "left").join(numbers, ["run_id", "cluster"], "left").join(mean, ["run_id", "cluster"], "left")
    return found.select("run_id", "cluster", "ord", "n_tracks", "team", "role", "number", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "centroid")


class _People:
    """The clusters of one run while they merge; a cluster is a dict with its parts and the parts it may not meet."""

    def __init__(self, clusters: list, barred: list, absorbed: float, same_number: float):
        foes: dict = {c["cluster"]: set() for c in clusters}
        for a, b in barred:
            foes[a].add(b)
            foes[b].add(a)
        self.live = [c | {"parts": [c["cluster"]], "foes": foes[c["cluster"]], "centroid": None if c["centroid"] is None else np.asarray(c["centroid"], float)} for c in sorted(clusters, key=lambda c: c["ord"])]
        self.absorbed, self.same_number, self.ordinals, self.named = absorbed, same_number, {}, []

    @staticmethod
    def alike(a: dict, b: dict) -> float:
        x, y = a["centroid"], b["centroid"]
        return 0.0 if x is None or y is None else float(x @ y / max(np.sqrt(x @ x) * np.sqrt(y @ y), 1e-12))

    @staticmethod
    def apart(a: dict, b: dict) -> bool:
        return not a["foes"].isdisjoint(b["parts"])

    @staticmethod
    def absorb(into: dict, other: dict) -> None:
        """The centroid is the normalised mean of the two, whatever their sizes."""
        into["parts"] += other["parts"]
        into["foes"] |= other["foes"]
        into["n_tracks"] += other["n_tracks"]
        into["least"] = min(into["least"], other["least"])
        into["confidence"] = max(into["confidence"], other["confidence"])
        both = [x["centroid"] for x in (into, other) if x["centroid"] is not None]
        if len(both) == 2:
            mean = (both[0] + both[1]) / 2
            length = np.sqrt(mean @ mean)
            into["centroid"] = mean / length if length >= 1e-6 else None
        elif both:
            into["centroid"] = both[0]

    def by_label(self) -> list:
        out: dict = {}
        for c in self.live:
            if c["number"] is not None:
                out.setdefault((c["team"], c["number"]), []).append(c)
        return list(out.values())

    def merge_same_numbers(self) -> None:
        """Clusters of one team and number fold into the largest, again and again while its centroid moves."""
        for group in self.by_label():
            while True:
                group.sort(key=lambda c: -c["n_tracks"])  # stable: of equal ones the first by ord
                into, gone = group[0], []
                for other in group[1:]:
                    if not self.apart(into, other) and self.alike(into, other) >= self.same_number:
                        self.absorb(into, other)
                        gone.append(id(other))
                if not gone:
                    break
                group[:] = [c for c in group if id(c) not in gone]
                self.live = [c for c in self.live if id(c) not in gone]
                group.sort(key=lambda c: c["ord"])

    def name(self, c: dict, unknown: bool) -> None:
        side = c["team"][5:] if c["team"].startswith("team_") else c["team"]
        if unknown:
            key = c["team"] if c["team"] in ("team_A", "team_B") else "unknown"
            self.ordinals[key] = self.ordinals.get(key, 0) + 1
            end = "GK" if c["role"] == "goalkeeper" else f"unk-{self.ordinals[key]:02d}"
        else:
            end = str(c["number"])
        c["player_id"] = f"{side}-{end}"
        self.named.append(c)

    def name_all(self) -> None:
        for group in self.by_label():
            for i, c in enumerate(sorted(group, key=lambda c: (-c["n_tracks"], c["least"]))):
                self.name(c, unknown=i > 0)
        for c in sorted((c for c in self.live if c["number"] is None), key=lambda c: -c["n_tracks"]):
            fit = [x for x in self.named if (x["team"] == c["team"] or c["team"] == "unknown") and not self.apart(x, c)]
            best = max(fit, key=lambda x: self.alike(x, c), default=None)
            if best is not None and self.alike(best, c) >= self.absorbed:
                self.absorb(best, c)
            else:
                self.name(c, unknown=True)
        seen: dict = {}
        for c in self.named:
            seen.setdefault(c["player_id"], []).append(c)
        for same in seen.values():
            if len(same) > 1:
                for i, c in enumerate(c for c in same if c["role"] not in ("referee", "linesman")):
                    c["player_id"] += "-" + (chr(97 + i) if i < 26 else chr(96 + i // 26) + chr(97 + i % 26))


NAMED = "run_id long, cluster long, into long, player_id string, team string, role string, number int"


def named_people(clusters: DataFrame, members: DataFrame, pairs: DataFrame, absorbed: float = ABSORBED, same_number: float = SAME_NUMBER) -> DataFrame:
    """run_id, cluster, into, player_id, team, role, number: the person that each cluster belongs to, named by the cluster `into`.

    Clusters of one team and number merge where they are alike enough and no two of their tracks were
    seen together. The largest of those left with a label has its name, the others and clusters without
    a number are `unk`; the latter may join a named one of their team. Names held twice get letters.
    """
    owner = lambda c: members.select("run_id", F.col("track_id").alias(c), F.col("cluster").alias(f"of_{c}"))
    barred = pairs.join(owner("a"), ["run_id", "a"]).join(owner("b"), ["run_id", "b"]).select("run_id", "of_a", "of_b").distinct()
    least = members.groupBy("run_id", "cluster").agg(F.min("track_id").alias("least"))
    columns = [f.split(" ")[0] for f in NAMED.split(", ")]

    def run(own: pa.Table, foes: pa.Table) -> pa.Table:
        people = _People(own.to_pylist(), list(zip(foes.column("of_a").to_pylist(), foes.column("of_b").to_pylist())), absorbed, same_number)
        people.merge_same_numbers()
        people.name_all()
        rows = [{"run_id": c["run_id"], "cluster": part, "into": c["cluster"], **{k: c[k] for k in columns[3:]}} for c in people.named for part in c["parts"]]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32()]
        return pa.table({n: pa.array([r[n] for r in rows], k) for n, k in zip(columns, kinds)})

    own = clusters.join(least, ["run_id", "cluster"]).withColumn("team", F.coalesce("team", F.lit("unknown"))).withColumn("number", F.col("number").cast("int"))
    return _by_run(own).cogroup(_by_run(barred)).applyInArrow(run, NAMED)


def consolidated_people(tracks: DataFrame, rows: DataFrame, threshold: float = SAME_PERSON, min_confidence: float = NUMBER_CONFIDENCE) -> DataFrame:
    """run_id, track_id, cluster, player_id, team, role, number for each track: all steps over tracks(...) and rows(run_id, frame, track_id)."""
    tracks, pairs = stored(tracks, "piece-tracks"), stored(cooccurring(rows), "pairs")
    members = stored(constrained_components(tracks, pairs, same_person_edges(tracks, pairs, threshold)), "members")
    people = named_people(voted_clusters(tracks, members, min_confidence), members, pairs)
    return members.join(people, ["run_id", "cluster"]).select("run_id", "track_id", F.col("into").alias("cluster"), "player_id", "team", "role", "number")


def _coloured(tracks: pa.Table, links: pa.Table) -> pa.Table:
    """Each track in order gets the first colour that no track before it, seen together with it, has."""
    foes: dict = {}
    for a, b in zip(links.column("a").to_pylist(), links.column("b").to_pylist()):
        foes.setdefault(a, []).append(b)
        foes.setdefault(b, []).append(a)
    tracks = tracks.sort_by([("ord", "ascending"), ("track_id", "ascending")])
    colour: dict = {}
    for t in tracks.column("track_id").to_pylist():
        taken = {colour.get(f) for f in foes.get(t, ())}
        colour[t] = next(i for i in range(1, len(taken) + 2) if i not in taken)
    ids = tracks.column("track_id").to_pylist()
    return pa.table({"run_id": tracks.column("run_id"), "track_id": pa.array(ids, pa.int64()), "player_id": pa.array([f"REF-{colour[t]:02d}" for t in ids], pa.string())})


def officials(tracks: DataFrame, pairs: DataFrame) -> DataFrame:
    """run_id, track_id, player_id: referees as REF-01, REF-02 ... such that none holds two tracks seen together, all linesmen as LIN-01.

    tracks(run_id, track_id, ord, role); other roles are left out. Referees go by ord.
    """
    own = tracks.where("role = 'referee'").select("run_id", "track_id", "ord")
    held = own.select("run_id", "track_id")
    both = pairs.join(held.withColumnRenamed("track_id", "a"), ["run_id", "a"], "left_semi").join(held.withColumnRenamed("track_id", "b"), ["run_id", "b"], "left_semi")
    refs = _by_run(own).cogroup(_by_run(both.select("run_id", "a", "b"))).applyInArrow(_coloured, "run_id long, track_id long, player_id string")
    return refs.union(tracks.where("role = 'linesman'").select("run_id", "track_id", F.lit("LIN-01")))


def goalkeepers(clusters: DataFrame, places: DataFrame, p: Preset = TEMPLATE) -> DataFrame:
    """run_id, cluster, team, goal_x, player_id: each run's keepers, for the goals that have a cluster near enough.

    clusters(run_id, cluster, ord, team, role, number, n_tracks); places(run_id, cluster, x, y). The team
    of lower mean x keeps the left goal; runs without both teams have no keepers. Near a goal means
    16.5 m in x and 6 m off the axis; the best has the least distance less a bonus for each track and
    for the role, of equal ones the first by ord. A keeper joins the team of the goal.
    """
    seen = places.where((F.abs("x") <= 2 * p.half_length) & (F.abs("y") <= 2 * p.half_width))
    mean = clusters.join(seen.groupBy("run_id", "cluster").agg(F.avg("x").alias("mx"), F.avg("y").alias("my")), ["run_id", "cluster"])
    sides = mean.where("team IN ('team_A', 'team_B')").groupBy("run_id", "team").agg(F.avg("mx").alias("tx"))
    w = Window.partitionBy("run_id")
    sides = sides.withColumns({"n": F.count("*").over(w), "left": F.row_number().over(w.orderBy("tx", "team")) == 1}).where("n = 2")
    goals = sides.select("run_id", F.col("team").alias("keeps"), F.when(F.col("left"), -p.half_length).otherwise(p.half_length).alias("goal_x"))
    far = F.abs(F.col("mx") - F.col("goal_x"))
    near = mean.join(goals, "run_id").where((far <= GOAL_AREA) & (F.abs("my") <= KEEPER_OFF_AXIS) & ~F.col("role").isin("referee", "linesman") & F.col("team").isin("team_A", "team_B", "unknown", "gk_left", "gk_right"))
    near = near.withColumn("score", KEEPER_TRACK_BONUS * F.col("n_tracks") - far + F.when(F.col("role") == "goalkeeper", KEEPER_ROLE_BONUS).otherwise(0.0))
    best = lambda df: df.withColumn("k", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("score"), "ord"))).where("k = 1").drop("k")
    left = best(near.where("goal_x < 0"))
    right = best(near.where("goal_x > 0").join(left.select("run_id", "cluster"), ["run_id", "cluster"], "left_anti"))  # a field may be so short that one is near both
    name = F.concat(F.when(F.col("keeps").startswith("team_"), F.substring("keeps", 6, 1 << 20)).otherwise(F.col("keeps")), F.lit("-GK"), F.coalesce(F.concat(F.lit("-"), F.col("number").cast("string")), F.lit("")))
    return left.unionByName(right).select("run_id", "cluster", F.col("keeps").alias("team"), "goal_x", name.alias("player_id"))

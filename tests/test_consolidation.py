"""Consolidation against a plain version that compares all members of all clusters, and known cases."""

import numpy as np
import pytest

from touchline.operators import consolidation as C

SCHEMA = "run_id long, track_id long, ord long, team string, role string, frames long, number int, confidence double, candidates array<struct<number int, score double>>, centroid array<double>"
TEAMS = ("unknown", "")


def unit(v):
    return v / np.sqrt(v @ v)


def plain(tracks, pairs, same=C.SAME_PERSON, absorbed=C.ABSORBED, number=C.SAME_NUMBER, least=C.NUMBER_CONFIDENCE):
    """{track_id: player_id} of one run; tracks are dicts in order of ord."""
    by = {t["track_id"]: t for t in tracks}
    together = {frozenset(p) for p in pairs}
    strong = lambda t: t["candidates"][0][0] if t["candidates"] and t["candidates"][0][1] >= 1.0 else None

    def barred(x, y):
        a, b = strong(by[x]), strong(by[y])
        return frozenset((x, y)) in together or (a is not None and b is not None and a != b) or (by[x]["team"] not in TEAMS and by[y]["team"] not in TEAMS and by[x]["team"] != by[y]["team"])

    groups = [[t["track_id"]] for t in tracks]
    edges = []
    for i, x in enumerate(tracks):
        for y in tracks[i + 1 :]:
            a, b = sorted((x["track_id"], y["track_id"]))
            if x["centroid"] and y["centroid"] and not barred(a, b):
                s = float(np.dot(x["centroid"], y["centroid"]))
                if s >= same:
                    edges.append((-s, a, b))
    for _, a, b in sorted(edges):
        ga, gb = (next(g for g in groups if t in g) for t in (a, b))
        if ga is not gb and not any(barred(x, y) for x in ga for y in gb):
            ga += gb
            groups.remove(gb)
    people = []
    for g in sorted(groups, key=lambda g: min(by[t]["ord"] for t in g)):
        g.sort(key=lambda t: by[t]["ord"])
        score, top, team, role = {}, {}, {}, {}
        for t in (by[x] for x in g):
            if not (t["number"] is not None and t["confidence"] < least):
                for n, s in t["candidates"] or ([(t["number"], t["confidence"])] if t["number"] is not None else []):
                    score[n] = score.get(n, 0) + s
            if t["team"] not in TEAMS:
                team[t["team"]] = team.get(t["team"], 0) + max(1, t["frames"])
            role[t["role"]] = role.get(t["role"], 0) + max(1, t["frames"])
        cents = [np.array(by[x]["centroid"]) for x in g if by[x]["centroid"]]
        people.append({
            "tracks": list(g), "number": max(score, key=lambda n: round(score[n], 6)) if score else None, "team": max(team, key=team.get) if team else "unknown",
            "role": "goalkeeper" if "goalkeeper" in role else max(role, key=role.get), "mid": unit(np.mean(cents, axis=0)) if cents else None,
        })
    alike = lambda a, b: 0.0 if a["mid"] is None or b["mid"] is None else float(a["mid"] @ b["mid"])
    meet = lambda a, b: any(frozenset((x, y)) in together for x in a["tracks"] for y in b["tracks"])

    def take(a, b):
        a["tracks"] += b["tracks"]
        a["mid"] = b["mid"] if a["mid"] is None else a["mid"] if b["mid"] is None else unit((a["mid"] + b["mid"]) / 2)

    changed = True
    while changed:
        changed = False
        labels = dict.fromkeys((p["team"], p["number"]) for p in people if p["number"] is not None)
        for label in labels:
            group = sorted((p for p in people if (p["team"], p["number"]) == label), key=lambda p: -len(p["tracks"]))
            for other in group[1:]:
                if not meet(group[0], other) and alike(group[0], other) >= number:
                    take(group[0], other)
                    people = [p for p in people if p is not other]
                    changed = True
    named, count = [], {}

    def unknown(p):
        key = p["team"] if p["team"] in ("team_A", "team_B") else "unknown"
        count[key] = count.get(key, 0) + 1
        return C_name(p, "GK" if p["role"] == "goalkeeper" else f"unk-{count[key]:02d}")

    def C_name(p, end):
        p["id"] = f"{p['team'].removeprefix('team_')}-{end}"
        named.append(p)

    for label in dict.fromkeys((p["team"], p["number"]) for p in people if p["number"] is not None):
        group = sorted((p for p in people if (p["team"], p["number"]) == label), key=lambda p: (-len(p["tracks"]), min(p["tracks"])))
        C_name(group[0], str(label[1]))
        for p in group[1:]:
            unknown(p)
    for p in sorted((p for p in people if p["number"] is None), key=lambda p: -len(p["tracks"])):
        best, top = None, -1.0
        for q in named:
            if (q["team"] == p["team"] or p["team"] == "unknown") and not meet(q, p) and alike(q, p) > top:
                best, top = q, alike(q, p)
        if best is not None and top >= absorbed:
            take(best, p)
        else:
            unknown(p)
    for name in {p["id"] for p in named}:
        same_name = [p for p in named if p["id"] == name]
        if len(same_name) > 1:
            for i, p in enumerate(p for p in same_name if p["role"] not in ("referee", "linesman")):
                p["id"] += f"-{'abcdefghijklmnopqrstuvwxyz'[i]}"
    return {t: p["id"] for p in named for t in p["tracks"]}


def run_of(seed):
    """Tracks of a planted run, with who was seen with whom."""
    rng = np.random.default_rng(seed)
    n, people = 40, 9
    look = [unit(rng.normal(size=8)) for _ in range(people)]
    look[1] = unit(look[0] + 0.2 * rng.normal(size=8) / 3)  # two that look alike
    tracks, spans = [], []
    for i in range(n):
        who = int(rng.integers(people))
        team = "unknown" if rng.random() < 0.2 else "" if rng.random() < 0.05 else ("team_A", "team_B", "team_A")[who % 3]
        shirt = 7 if who in (0, 1, 3) else who + 10
        candidates = [(shirt if rng.random() < 0.85 else 99, float(round(rng.uniform(0.3, 2.5), 3)))] + [(int(rng.integers(1, 30)), 0.2)] * int(rng.integers(2)) if rng.random() < 0.6 else []
        number = candidates[0][0] if candidates else (shirt if rng.random() < 0.2 else None)
        centroid = None if rng.random() < 0.07 else unit(look[who] + rng.uniform(0, 0.45) * unit(rng.normal(size=8))).tolist()
        tracks.append({"track_id": 3 * n - 3 * i if seed % 2 else 2 * i, "ord": i, "team": team, "role": "goalkeeper" if rng.random() < 0.08 else "player", "frames": int(rng.integers(0, 50)), "number": number, "confidence": float(round(rng.uniform(0.3, 1), 3)), "candidates": candidates, "centroid": centroid})
        a = int(rng.integers(0, 200))
        spans.append((a, a + int(rng.integers(2, 40)), who))
    for i in range(n):  # one person is not seen twice at once, as a rule
        for j in range(i):
            if spans[i][2] == spans[j][2] and spans[i][0] <= spans[j][1] and spans[j][0] <= spans[i][1] and rng.random() < 0.9:
                spans[i] = (300 + 10 * i, 305 + 10 * i, spans[i][2])
    pairs = [tuple(sorted((tracks[i]["track_id"], tracks[j]["track_id"]))) for i in range(n) for j in range(i) if spans[i][0] <= spans[j][1] and spans[j][0] <= spans[i][1]]
    return tracks, spans, pairs


def frame(spark, runs):
    rows = [(r, *(t[k] for k in ("track_id", "ord", "team", "role", "frames", "number", "confidence", "candidates", "centroid"))) for r, (tracks, _, _) in enumerate(runs) for t in tracks]
    seen = [(r, f, t["track_id"]) for r, (tracks, spans, _) in enumerate(runs) for t, (a, b, _) in zip(tracks, spans) for f in range(a, b + 1)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(seen, "run_id long, frame long, track_id long")


def test_consolidation_equals_a_plain_version(spark):
    runs = [run_of(seed) for seed in range(8)]
    tracks, rows = frame(spark, runs)
    pairs = {(r.run_id, r.a, r.b) for r in C.cooccurring(rows).collect()}
    assert pairs == {(r, *p) for r, (_, _, own) in enumerate(runs) for p in own}
    got: dict = {}
    for r in C.consolidated_people(tracks.repartition(3), rows).collect():
        got.setdefault(r.run_id, {})[r.track_id] = r.player_id
    for r, (own, _, held) in enumerate(runs):
        assert got[r] == plain(own, held), r
    names = {n for g in got.values() for n in g.values()}
    assert any("unk" in n for n in names) and any("GK" in n for n in names) and any(len(set(g.values())) < len(g) for g in got.values())


def test_no_tracks(spark):
    tracks, rows = frame(spark, [run_of(0)])
    assert C.consolidated_people(tracks.where("false"), rows.where("false")).collect() == []
    alone = C.consolidated_people(tracks.where("ord = 0"), rows.where("false")).collect()
    assert len(alone) == 1


@pytest.mark.parametrize("seed", [0, 3])
def test_officials_share_no_frame(spark, seed):
    tracks, spans, pairs = run_of(seed)
    rows = [(5, t["track_id"], t["ord"], "referee" if t["ord"] % 4 else "linesman" if t["ord"] % 8 else "player") for t in tracks]
    df = spark.createDataFrame(rows, "run_id long, track_id long, ord long, role string")
    held = spark.createDataFrame([(5, *p) for p in pairs], "run_id long, a long, b long")
    got = {r.track_id: r.player_id for r in C.officials(df, held).collect()}
    groups: list = []
    for _, t, _, role in rows:  # in order of ord, each joins the first group it may
        if role == "referee":
            for g in groups:
                if not any(tuple(sorted((t, x))) in pairs for x in g):
                    g.append(t)
                    break
            else:
                groups.append([t])
    want = {t: f"REF-{i:02d}" for i, g in enumerate(groups, 1) for t in g} | {t: "LIN-01" for _, t, _, role in rows if role == "linesman"}
    assert got == want and len(groups) > 1


def test_goalkeepers(spark):
    rows = [(1, 1, 0, "team_A", "player", None, 1), (1, 2, 1, "team_B", "goalkeeper", 1, 1), (1, 3, 2, "unknown", "player", None, 9), (1, 4, 3, "team_B", "player", 5, 1), (1, 5, 4, "referee", "referee", None, 20), (2, 1, 0, "team_A", "player", None, 1)]
    clusters = spark.createDataFrame(rows, "run_id long, cluster long, ord long, team string, role string, number int, n_tracks long")
    at = {1: (-10, 0), 2: (45, 2), 3: (-43, 1), 4: (47, 5.9), 5: (-52, 0)}
    places = spark.createDataFrame([(1, c, float(x), float(y)) for c, (x, y) in at.items()] + [(1, 4, 900.0, 0.0), (2, 1, 50.0, 0.0)], "run_id long, cluster long, x double, y double")
    assert {tuple(r) for r in C.goalkeepers(clusters, places).collect()} == {(1, 3, "team_A", -52.5, "A-GK"), (1, 2, "team_B", 52.5, "B-GK-1")}

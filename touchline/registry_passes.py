"""Queries of transition passes, and their SQL; registry.py takes them in."""

from __future__ import annotations

from .operators import events as E
from .operators import passes as M
from .plans.presets import TEMPLATE as P
from .plans.staging import stored


def tables_of(t):
    """Ball states, nearest players and bridge passes, each computed once."""
    states = stored(E.ball_states(t["ball"]), "states")
    near = stored(E.nearest_player(states, t["players"], t["teams"]), "near")
    return states, near, stored(E.bridge_passes(E.possession_spans(near), states), "passes")


def _envelopes(t):
    return M.speed_envelopes(E.ball_states(t["ball"]))


def _transitions(t):
    states, near, passes = tables_of(t)
    return M.transition_passes(states, near, passes)


def _all(t):
    return M.all_passes(*tables_of(t)).drop("receive_frame")


#: The scan as a recursion over candidate starts: each step goes to the first start at or behind the last one's `nxt`.
CTES = {
    "es": "(SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY frame) AS i, lag(frame) OVER w AS pf, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(speed) OVER w AS pv FROM st WINDOW w AS (PARTITION BY run_id ORDER BY frame))",
    "ek": """(SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY i) AS k, coalesce(si + 1, beyond + 1) AS nxt FROM (
      SELECT c.run_id, c.i, c.pf, c.px, c.py, min(s.i) FILTER (s.speed <= 7.0 AND s.i > c.i AND s.frame <= c.pf + 100) AS si, coalesce(min(s.i) FILTER (s.frame > c.pf + 100), max(s.i) + 1) AS beyond
      FROM es c JOIN es s ON s.run_id = c.run_id AND s.i >= c.i WHERE c.pv <= 7.0 AND c.speed >= 10.0 GROUP BY ALL))""",
    "fl": """(SELECT * FROM (WITH RECURSIVE go AS (SELECT run_id, k, nxt FROM ek WHERE k = 1 UNION ALL
        SELECT g.run_id, n.k, n.nxt FROM go g, LATERAL (SELECT e.k, e.nxt FROM ek e WHERE e.run_id = g.run_id AND e.i >= g.nxt ORDER BY e.i LIMIT 1) n)
      SELECT e.run_id, e.pf AS frame, e.px AS x, e.py AS y, s.frame AS settle_frame, s.x AS settle_x, s.y AS settle_y FROM go JOIN ek e ON go.run_id = e.run_id AND go.k = e.k JOIN es s ON s.run_id = e.run_id AND s.i = e.si))""",
}


def transitions(covering: str) -> str:
    return f"""(SELECT e.run_id, e.frame, h.player_id, h.team, r.receiver_id, r.receiver_team, e.settle_frame AS end_frame, e.x, e.y, e.settle_x AS end_x, e.settle_y AS end_y,
        sqrt((settle_x-x)*(settle_x-x) + (settle_y-y)*(settle_y-y)) AS pass_length, CASE WHEN h.team = r.receiver_team THEN 'successful' ELSE 'failed' END AS outcome, r.receive_frame
      FROM fl e JOIN (SELECT run_id, kick, first(player_id ORDER BY votes DESC, f) AS player_id, first(team ORDER BY votes DESC, f) AS team FROM (
          SELECT e.run_id, e.frame AS kick, n.player_id, round(sum(0.1 + 0.9 * (n.frame - greatest(0, e.frame - 25)) / greatest(1, e.frame - greatest(0, e.frame - 25))::DOUBLE), 9) AS votes, min(n.frame) AS f, arg_max(n.team, n.frame) AS team
          FROM fl e JOIN nr n ON n.run_id = e.run_id AND n.frame BETWEEN greatest(0, e.frame - 25) AND e.frame AND n.distance <= 1.0 GROUP BY ALL) GROUP BY ALL) h ON h.run_id = e.run_id AND h.kick = e.frame
      JOIN (SELECT e.run_id, e.settle_frame AS s, arg_min(n.player_id, n.frame) AS receiver_id, arg_min(n.team, n.frame) AS receiver_team, min(n.frame) AS receive_frame
          FROM fl e JOIN nr n ON n.run_id = e.run_id AND n.frame BETWEEN e.settle_frame AND e.settle_frame + {int(1.5 * P.fps)} AND n.distance <= 2.0 GROUP BY ALL) r ON r.run_id = e.run_id AND r.s = e.settle_frame
      WHERE r.receiver_id <> h.player_id AND NOT EXISTS (SELECT 1 FROM {covering} c WHERE c.run_id = e.run_id AND abs(c.frame - e.frame) <= 12))"""


ENTRIES = {
    "speed_envelopes": (_envelopes, "SELECT * FROM fl"),
    "transition_passes": (_transitions, f"SELECT * FROM {transitions('ps')}"),
    "all_passes": (
        _all,
        f"""SELECT *, printf('pass_%04d', row_number() OVER (PARTITION BY run_id ORDER BY frame, player_id, receiver_id)) AS event_id FROM (SELECT *, 'possession_bridge' AS source, 1.0::DOUBLE AS confidence FROM ps
          UNION ALL SELECT * EXCLUDE (receive_frame), 'speed_transition', 0.9::DOUBLE FROM {transitions('ps')})""",
    ),
}

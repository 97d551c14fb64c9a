"""DuckDB fragments of the record workload (`memjoin.sources.records`)."""

from __future__ import annotations

from memjoin.operators.graph import CHAIN_WEIGHTS, CORRECTION_TERMS
from memjoin.plans import sqltext as S

_corrects = " OR ".join(f"contains(lower(text), '{t}')" for t in CORRECTION_TERMS)

CARDS = (
    S.TURNS
    + """,
cards AS (SELECT uid AS q, pos, id, session, speaker, text, speaker AS cluster, ((pos * 37 + uid) % 11) / 10.0::DOUBLE AS importance,
  (pos * 41 + uid) % 400 AS age_days, (uid + pos) % 9 AS use_count, pos % 5 AS evidence_count,
  ['', 'helpful', 'corrected', 'ignored'][((uid + pos) % 4 + 1)::INT] AS last_outcome, (uid * 7 + pos) % 17 = 0 AS protected FROM turns),
task AS (SELECT uid AS q, arg_max(text, pos + CASE WHEN speaker = 'user' THEN 1000000 ELSE 0 END) AS query,
  arg_max(session, pos + CASE WHEN speaker = 'user' THEN 1000000 ELSE 0 END) AS anchor_session, 'user' AS anchor_speaker FROM turns GROUP BY uid)"""
)

REL = "rel AS (SELECT uid AS q, id FROM turns WHERE speaker = 'assistant' AND pos % 2 = 1)"


def state(a: str = "age_days", u: str = "use_count", e: str = "evidence_count", o: str = "last_outcome", p: str = "protected") -> dict[str, str]:
    """SQL text of the state features."""
    out = f"(CASE lower({o}) WHEN 'helpful' THEN 1.0::DOUBLE WHEN 'corrected' THEN 0.35::DOUBLE WHEN 'ignored' THEN -0.65::DOUBLE ELSE 0.0::DOUBLE END)"
    age = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {a} / 365.0::DOUBLE))"
    return {
        "age_norm": age,
        "use_norm": f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ln(1.0::DOUBLE + {u}) / ln(101.0::DOUBLE)))",
        "evidence_norm": f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ln(1.0::DOUBLE + {e}) / ln(51.0::DOUBLE)))",
        "outcome": out,
        "protected": f"({p})::INT::DOUBLE",
        "stale": f"({a} >= 180 AND {u} <= 0 AND NOT {p})::INT::DOUBLE",
        "recency": f"(1.0::DOUBLE - {age})",
    }


def state_score(**names: str) -> str:
    s = state(**names)
    return (
        f"(0.18::DOUBLE * {s['use_norm']} + 0.16::DOUBLE * {s['evidence_norm']} + 0.12::DOUBLE * greatest(0.0::DOUBLE, {s['outcome']}) + 0.08::DOUBLE * {s['protected']}"
        f" + 0.07::DOUBLE * {s['recency']} - 0.22::DOUBLE * {s['stale']} - 0.10::DOUBLE * greatest(0.0::DOUBLE, -{s['outcome']}))"
    )


PAIRS = ",\n".join(
    [
        CARDS,
        REL,
        S.hash_vectors("cv", "cards", "id"),
        S.hash_vectors("tv", "task", "q", "query"),
        S.masks("cm", "cards", "id"),
        S.masks("tm", "task", "q", "query"),
        "sem AS (SELECT c.id, sum(cv.v * tv.v) AS semantic FROM cards c JOIN cv USING (id) JOIN tv ON tv.q = c.q AND tv.idx = cv.idx GROUP BY c.id)",
        f"""pairs AS (SELECT c.*, t.query, t.anchor_session, t.anchor_speaker, cm.mask, tm.mask AS q_mask, coalesce(sem.semantic, 0.0::DOUBLE) AS semantic,
  {S.jac(S.tset('t.query'), S.tset('c.text'))} AS lexical, {S.overlap('tm.mask', 'cm.mask')} AS activation, {S.coverage('tm.mask', 'cm.mask')} AS coverage,
  (c.speaker = t.anchor_speaker)::INT::DOUBLE AS same_cluster,
  ((c.speaker = t.anchor_speaker)::INT + (c.session = t.anchor_session)::INT) / 2.0::DOUBLE AS metadata_match,
  CASE WHEN c.importance = 0 THEN 0.5::DOUBLE ELSE c.importance END AS weighty, {state_score(a='c.age_days', u='c.use_count', e='c.evidence_count', o='c.last_outcome', p='c.protected')} AS state, {S.cost('c.text')} AS cost
  FROM cards c JOIN task t USING (q) JOIN cm ON cm.id = c.id JOIN tm ON tm.q = c.q LEFT JOIN sem ON sem.id = c.id)""",
    ]
)


def _edge(slot: int, name: str, kind: str, source: str, target: str, mask: str, when: str) -> str:
    weight, confidence = CHAIN_WEIGHTS[name]
    return (
        f"SELECT q, {source} AS source, {target} AS target, '{kind}' AS type, {weight}::DOUBLE AS weight, {confidence}::DOUBLE AS confidence, {mask} AS mask,"
        f" pos * 8 + {slot} AS epos FROM seen WHERE {when}"
    )


CHAIN = f"""seen AS (SELECT c.q, c.pos, c.id, m.mask, ({_corrects}) AS corrects, lag(c.id) OVER o AS prev, lag(m.mask) OVER o AS prev_mask,
  lag(session) OVER o = session AS same_session, CASE WHEN speaker <> '' THEN lag(c.id) OVER (PARTITION BY q, speaker ORDER BY pos) END AS speaker_prev,
  lag(c.id) OVER (PARTITION BY q, session ORDER BY pos) AS session_prev FROM cards c JOIN cm m ON m.id = c.id WINDOW o AS (PARTITION BY q ORDER BY pos)),
edges AS (
{_edge(0, 'next', 'temporal_next', 'prev', 'id', 'mask', 'prev IS NOT NULL')}
UNION ALL {_edge(1, 'context', 'same_context', 'prev', 'id', 'mask', 'prev IS NOT NULL AND same_session')}
UNION ALL {_edge(2, 'context_back', 'same_context', 'id', 'prev', 'prev_mask', 'prev IS NOT NULL AND same_session')}
UNION ALL {_edge(3, 'correction', 'correction', 'prev', 'id', 'mask', 'prev IS NOT NULL AND corrects')}
UNION ALL {_edge(4, 'back', 'same_context', 'id', 'prev', 'prev_mask', 'prev IS NOT NULL')}
UNION ALL {_edge(5, 'speaker', 'same_context', 'speaker_prev', 'id', 'mask', 'speaker_prev IS NOT NULL')}
UNION ALL {_edge(6, 'session', 'same_context', 'session_prev', 'id', 'mask', 'session_prev IS NOT NULL')})"""

BOOST = "(CASE WHEN e.type IN ('preference','correction') THEN 1.22::DOUBLE WHEN e.type IN ('same_context','same_cluster') THEN 1.12::DOUBLE WHEN e.type = 'temporal_next' THEN 0.84::DOUBLE ELSE 1.0::DOUBLE END)"

EDGES = CHAIN + f""",
sedge AS (SELECT e.q, e.source, e.target, e.epos, e.type, e.weight, e.confidence, {BOOST} AS boost, {S.overlap('p.q_mask', 'e.mask')} AS overlap,
  p.weighty AS t_importance, p.state AS t_state FROM edges e JOIN pairs p ON p.q = e.q AND p.id = e.target)"""


def hop_gain(depth: int) -> str:
    return f"e.weight * e.boost * (0.70::DOUBLE + 0.45::DOUBLE * e.overlap) * (0.70::DOUBLE + 0.30::DOUBLE * e.confidence) / {1.25 + depth}::DOUBLE"


def expand(prefix: str, best: str, seeds: str, edges: str, depth: int, step, fanout: int = 0) -> str:
    """CTEs ending in `{prefix}best` (q, id, score, hop, votes); `step(depth)` is the SQL of the new score from f.* and e.*."""
    parts = [
        f"{prefix}b0 AS (SELECT q, id, score, 0 AS hop, 0 AS votes FROM {best})",
        f"{prefix}f0 AS (SELECT q, id, score, [id] AS path, [rank::BIGINT] AS ord FROM {seeds})",
    ]
    for d in range(depth):
        parts.append(
            f"""{prefix}r{d} AS (SELECT f.q, e.target AS id, list_append(f.path, e.target) AS path, f.ord AS parent, list_append(f.ord, e.epos::BIGINT) AS ord, {step(d)} AS score
  FROM {prefix}f{d} f JOIN {edges} e ON e.q = f.q AND e.source = f.id WHERE NOT list_contains(f.path, e.target))"""
        )
        parts.append(
            f"""{prefix}i{d} AS (SELECT * EXCLUDE (flo, prior) FROM (SELECT r.*, b.score AS prior, greatest(coalesce(round(b.score, 9), -99.0), coalesce(max(round(r.score, 9)) OVER
  (PARTITION BY r.q, r.id ORDER BY r.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -99.0)) AS flo FROM {prefix}r{d} r LEFT JOIN {prefix}b{d} b ON b.q = r.q AND b.id = r.id)
  WHERE round(score, 9) > flo)"""
        )
        parts.append(
            f"""{prefix}b{d + 1} AS (SELECT q, id, max(score) AS score, arg_max(hop, score) AS hop, sum(votes)::INT AS votes FROM (SELECT q, id, score, hop, votes FROM {prefix}b{d}
  UNION ALL SELECT q, id, score, {d + 1}, 1 FROM {prefix}i{d}) GROUP BY q, id)"""
        )
        if fanout:
            parts.append(
                f"""{prefix}f{d + 1} AS (SELECT q, id, score, path, list_append(parent, place) AS ord FROM (SELECT *, row_number() OVER
  (PARTITION BY q, parent ORDER BY round(score, 9) DESC, id) AS place FROM {prefix}i{d}) WHERE place <= {fanout})"""
            )
        else:
            parts.append(f"{prefix}f{d + 1} AS (SELECT q, id, score, path, ord FROM {prefix}i{d})")
    parts.append(f"{prefix}best AS (SELECT * FROM {prefix}b{depth})")
    return ",\n".join(parts)


SPARSE = """(0.27::DOUBLE * semantic + 0.24::DOUBLE * activation + 0.18::DOUBLE * lexical + 0.13::DOUBLE * same_cluster + 0.09::DOUBLE * metadata_match + 0.09::DOUBLE * weighty + state
  - CASE WHEN same_cluster = 0 THEN 0.18::DOUBLE ELSE 0.0::DOUBLE END)"""

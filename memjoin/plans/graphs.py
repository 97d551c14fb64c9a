"""Edge and expansion queries over conversation records."""

from __future__ import annotations

from pyspark.sql import functions as F

from memjoin.functions.state import card_state
from memjoin.operators import basins as B
from memjoin.operators import graph as G
from memjoin.operators.merge import compact, compact_score
from memjoin.operators.ranking import ranked, top_k
from memjoin.plans import records_sql as Q
from memjoin.plans import sqltext as S
from memjoin.plans.registry import query
from memjoin.sources import records
from memjoin.sources.caches import cached_frame_scores, neighbour_rows

OUT = "SELECT q, id, round(score, 6) AS score, rank FROM "


def shape(df):
    return df.select("q", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "j27_chain_edges",
    S.with_(Q.CARDS, S.masks("cm", "cards", "id"), Q.CHAIN)
    + f"SELECT q, source, target, type, weight, confidence, {S.signed('mask::HUGEINT')} AS mask, epos FROM edges",
)
def chain_edges(spark, sf_dir):
    return records.chain(spark, sf_dir)


@query(
    "f24_edge_type_constants",
    S.with_(Q.CARDS, S.masks("cm", "cards", "id"), Q.CHAIN)
    + f"""SELECT source, target, epos, {Q.BOOST} AS boost, CASE WHEN e.type IN ('preference','correction') THEN 0.005 WHEN e.type IN ('same_cluster','same_context') THEN 0.01
      WHEN e.type = 'temporal_next' THEN 0.03 ELSE 0.02 END::DOUBLE AS decay FROM edges e""",
)
def edge_constants(spark, sf_dir):
    return records.chain(spark, sf_dir).select(
        "source", "target", "epos", G.type_boost(F.col("type")).alias("boost"), G.type_decay(F.col("type")).alias("decay")
    )


@query("j23_sparse_basin_scores", S.with_(Q.PAIRS, f"s AS (SELECT q, id, {Q.SPARSE} AS score FROM pairs)") + OUT + f"({S.ranked('s')})")
def sparse(spark, sf_dir):
    return shape(B.sparse_ranked(records.pairs(spark, sf_dir)))


ASSOC = ",\n".join(
    [
        Q.PAIRS,
        Q.EDGES,
        f"sp AS ({S.ranked(f'(SELECT q, id, {Q.SPARSE} AS score FROM pairs)')})",
        f"de AS ({S.ranked('(SELECT q, id, semantic AS score FROM pairs)')})",
        """base AS (SELECT q, id, max(score) AS score FROM (SELECT q, id, score + 0.012::DOUBLE * greatest(0, 9 - rank) AS score FROM sp
           UNION ALL SELECT q, id, 0.72::DOUBLE * score + 0.008::DOUBLE * greatest(0, 9 - rank) FROM de) GROUP BY q, id)""",
        f"seeds AS (SELECT * FROM ({S.ranked('base')}) WHERE rank <= 8)",
    ]
)


def assoc_step(d: int) -> str:
    return f"0.62::DOUBLE * f.score + {Q.hop_gain(d)} + 0.07::DOUBLE * e.t_importance + e.t_state"


@query("j24_associative_recall", S.with_(ASSOC, Q.expand("x", "base", "seeds", "sedge", 3, assoc_step)) + OUT + f"({S.ranked('xbest')})")
def associative(spark, sf_dir):
    pairs = records.pairs(spark, sf_dir)
    return shape(B.associative_recall(pairs, records.scored_edges(spark, sf_dir, pairs)))


def pool_sql(condition: str) -> str:
    return S.with_(
        Q.PAIRS,
        Q.EDGES,
        f"sp AS ({S.ranked(f'(SELECT q, id, {Q.SPARSE} AS score FROM pairs)')})",
        f"""st AS (SELECT *, avg(score) OVER (PARTITION BY q) AS mean, stddev_pop(score) OVER (PARTITION BY q) AS sd, count(*) OVER (PARTITION BY q) AS n,
            max(score) OVER (PARTITION BY q) AS top FROM sp)""",
        "pc AS (SELECT q, max(CASE WHEN n - rank = floor(0.6 * (n - 1)) THEN round(score, 9) END) AS cut FROM st GROUP BY q)",
        f"held AS (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, id) AS rank FROM st JOIN pc USING (q) WHERE rank <= 3 OR {condition})",
        "base AS (SELECT h.q, h.id, greatest(h.score + 0.012::DOUBLE * greatest(0, 4 - h.rank), 0.72::DOUBLE * p.semantic) AS score FROM held h JOIN pairs p USING (q, id))",
        f"seeds AS (SELECT * FROM ({S.ranked('base')}) WHERE rank <= 3)",
        Q.expand("x", "base", "seeds", "sedge", 2, assoc_step),
    ) + OUT + f"({S.ranked('xbest')})"


def _pool_query(name: str, strategy: str, condition: str) -> None:
    @query(name, pool_sql(condition))
    def run(spark, sf_dir):
        pairs = records.pairs(spark, sf_dir)
        return shape(B.calibrated_pool_recall(pairs, records.scored_edges(spark, sf_dir, pairs), strategy, 3, 2))


_pool_query("j25_pool_top", "top4", "rank <= 4")
_pool_query("j25_pool_percentile", "pct60", "round(score, 9) >= cut")
_pool_query("j25_pool_zscore", "z0.5", "round(score, 9) >= round(mean + 0.5 * sd, 9)")
_pool_query("j25_pool_margin", "margin0.1", "round(score, 9) >= round(top - 0.1, 9)")


@query(
    "j28_typed_edge_expansion",
    S.with_(
        Q.PAIRS,
        Q.EDGES,
        f"sp AS (SELECT * FROM ({S.ranked(f'(SELECT q, id, {Q.SPARSE} AS score FROM pairs)')}) WHERE rank <= 2)",
        """off AS (SELECT s.q, e.target AS id, max(0.82::DOUBLE * s.score + e.weight * e.boost * (0.60::DOUBLE + 0.40::DOUBLE * e.overlap) + 0.04::DOUBLE * e.t_importance
           + 0.02::DOUBLE * e.confidence) AS score FROM sp s JOIN sedge e ON e.q = s.q AND e.source = s.id ANTI JOIN sp k ON k.q = e.q AND k.id = e.target
           WHERE e.type IN ('correction', 'temporal_next', 'same_context') GROUP BY ALL)""",
        f"inj AS (SELECT * FROM ({S.ranked('off')}) WHERE rank <= 2)",
        "al AS (SELECT q, id, score, false AS injected FROM sp UNION ALL SELECT q, id, score, true FROM inj)",
    )
    + f"SELECT q, id, round(score, 6) AS score, injected, rank FROM ({S.ranked('al')})",
)
def typed_expansion(spark, sf_dir):
    pairs = records.pairs(spark, sf_dir)
    held = B.sparse_ranked(pairs).where(F.col("rank") <= 2)
    edges = records.scored_edges(spark, sf_dir, pairs)
    out = G.typed_edge_expansion(held, edges, ["correction", "temporal_next", "same_context"], 32, 2)
    return out.select("q", "id", F.round("score", 6).alias("score"), "injected", F.col("rank").cast("bigint").alias("rank"))


_s = Q.state()
FRAME_SQL = f"""(0.36::DOUBLE * semantic + 0.22::DOUBLE * lexical + 0.16::DOUBLE * activation + 0.10::DOUBLE * weighty + 0.09::DOUBLE * {_s['use_norm']} + 0.07::DOUBLE * {_s['evidence_norm']}
  + 0.08::DOUBLE * greatest(0.0::DOUBLE, {_s['outcome']}) - 0.12::DOUBLE * {_s['stale']})"""


def frame_base(spark, sf_dir, pairs=None):
    pairs = records.pairs(spark, sf_dir) if pairs is None else pairs
    parts = card_state()
    extended = pairs.select(
        "q", "id", "semantic", "lexical", "activation", "weighty", parts["use_norm"].alias("use_norm"), parts["evidence_norm"].alias("evidence_norm"),
        parts["outcome"].alias("outcome"), parts["stale"].alias("stale"), F.lit(0.0).alias("role_penalty"),
    )
    return extended.select("q", "id", B.frame_score().alias("score"))


@query("j30_frame_base_scores", S.with_(Q.PAIRS, f"s AS (SELECT q, id, {FRAME_SQL} AS score FROM pairs)") + OUT + f"({S.ranked('s')})")
def frame_base_scores(spark, sf_dir):
    return shape(ranked(frame_base(spark, sf_dir), "q"))


BOTH_SQL = """adj AS (SELECT q, source, target, weight, confidence, overlap, epos * 2 AS apos FROM sedge
  UNION ALL SELECT e.q, e.target, e.source, e.weight * 0.72::DOUBLE, e.confidence * 0.72::DOUBLE, e.overlap, e.epos * 2 + 1 FROM sedge e)"""


def bidirectional_sql(depth: int, seeds: int) -> str:
    parts = [Q.PAIRS, Q.EDGES, BOTH_SQL, f"b AS (SELECT q, id, {FRAME_SQL} AS score FROM pairs)",
             f"f0 AS (SELECT q, id, score, rank AS qpos FROM ({S.ranked('b')}) WHERE rank <= {seeds})", "v0 AS (SELECT q, id FROM f0)"]
    for d in range(depth):
        parts.append(
            f"""r{d} AS (SELECT f.q, a.target AS id, f.qpos, a.apos, b.score AS base, b.score + 0.35::DOUBLE * f.score
  + 0.85::DOUBLE * (0.48::DOUBLE * a.weight + 0.34::DOUBLE * a.confidence + 0.18::DOUBLE * a.overlap) / {d + 1}.0::DOUBLE AS score
  FROM f{d} f JOIN adj a ON a.q = f.q AND a.source = f.id JOIN b ON b.q = a.q AND b.id = a.target)"""
        )
        parts.append(
            f"""n{d} AS (SELECT q, id, min(qpos * 100000 + apos) AS o, arg_min(greatest(base, score), qpos * 100000 + apos) AS score, min(qpos) AS qpos, arg_min(apos, qpos * 100000 + apos) AS apos
  FROM r{d} ANTI JOIN v{d} USING (q, id) GROUP BY q, id)"""
        )
        parts.append(f"f{d + 1} AS (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY qpos, id, apos) AS qpos FROM n{d})")
        parts.append(f"v{d + 1} AS (SELECT * FROM v{d} UNION ALL SELECT q, id FROM f{d + 1})")
    union = " UNION ALL ".join(["SELECT q, id, score FROM b"] + [f"SELECT q, id, score FROM r{d}" for d in range(depth)])
    parts.append(f"fin AS (SELECT q, id, max(score) AS score FROM ({union}) GROUP BY q, id)")
    return S.with_(*parts) + OUT + f"({S.ranked('fin')})"


@query("j29_bidirectional_graph_expansion", bidirectional_sql(3, 2))
def bidirectional(spark, sf_dir):
    pairs = records.pairs(spark, sf_dir)
    edges = G.both_ways(records.scored_edges(spark, sf_dir, pairs).select("q", "source", "target", "weight", "confidence", "overlap", "epos"))
    return shape(ranked(G.bidirectional_expansion(frame_base(spark, sf_dir, pairs), edges, 2, 3, 0.85), "q"))


def closure_ctes(depth: int, *base: str) -> list[str]:
    parts = [
        *base,
        """adj AS (SELECT source, target, weight, confidence, epos * 2 AS apos FROM edges
           UNION ALL SELECT target, source, weight * 0.72::DOUBLE, confidence * 0.72::DOUBLE, epos * 2 + 1 FROM edges)""",
        "b0 AS (SELECT id AS root, id, 1.0::DOUBLE AS score, 0 AS hop FROM cards)",
        "f0 AS (SELECT id AS root, id, 1.0::DOUBLE AS score, [id] AS path, 0::BIGINT AS ord FROM cards)",
    ]
    for d in range(depth):
        parts += [
            f"""r{d} AS (SELECT f.root, a.target AS id, list_append(f.path, a.target) AS path, f.score * greatest(0.0::DOUBLE, 0.55::DOUBLE * a.weight + 0.45::DOUBLE * a.confidence) / {d + 1}.0::DOUBLE AS score,
  row_number() OVER (PARTITION BY f.root ORDER BY f.ord, a.target, a.apos) AS qpos FROM f{d} f JOIN adj a ON a.source = f.id WHERE NOT list_contains(f.path, a.target))""",
            f"""i{d} AS (SELECT * FROM (SELECT r.*, greatest(coalesce(round(b.score, 9), -99.0), coalesce(max(round(r.score, 9)) OVER
  (PARTITION BY r.root, r.id ORDER BY r.qpos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -99.0)) AS flo FROM r{d} r LEFT JOIN b{d} b ON b.root = r.root AND b.id = r.id) WHERE round(score, 9) > flo)""",
            f"b{d + 1} AS (SELECT root, id, max(score) AS score, arg_max(hop, score) AS hop FROM (SELECT * FROM b{d} UNION ALL SELECT root, id, score, {d + 1} FROM i{d}) GROUP BY root, id)",
            f"f{d + 1} AS (SELECT root, id, score, path, qpos AS ord FROM i{d})",
        ]
    return [*parts, f"clo AS (SELECT root, id, score AS boost, hop FROM b{depth})"]


def closure_sql(depth: int) -> str:
    return S.with_(*closure_ctes(depth, Q.CARDS, S.masks("cm", "cards", "id"), Q.CHAIN))


def closure(spark, sf_dir, depth=3):
    edges = G.both_ways(records.chain(spark, sf_dir))
    return G.neighbour_closure(records.cards(spark, sf_dir).select("id"), edges, depth)


@query("j31_neighbour_closure", closure_sql(3) + "SELECT root, id, round(boost, 6) AS boost, hop::BIGINT AS hop FROM clo")
def neighbour_closure(spark, sf_dir):
    return closure(spark, sf_dir).select("root", "id", F.round("boost", 6).alias("boost"), F.col("hop").cast("bigint").alias("hop"))


@query(
    "s9_neighbor_cache_table",
    closure_sql(2)
    + """SELECT root AS memory_id, string_agg(id || ':' || hop, ' ' ORDER BY round(boost, 8) DESC, hop, id) AS neighbors, count(*) AS n, 2::BIGINT AS version FROM clo GROUP BY root""",
)
def neighbour_cache(spark, sf_dir):
    rows = neighbour_rows(closure(spark, sf_dir, 2), version=2)
    listed = F.transform("neighbors", lambda n: F.concat(n["id"], F.lit(":"), n["hop"].cast("string")))
    return rows.select(
        "memory_id", F.array_join(listed, " ").alias("neighbors"), F.size("neighbors").cast("bigint").alias("n"), F.col("version").cast("bigint").alias("version")
    )


@query(
    "j32_cached_frame",
    S.with_(
        *closure_ctes(2, Q.PAIRS, Q.CHAIN),
        f"fb AS (SELECT q, id, {FRAME_SQL} AS score FROM pairs)",
        f"sd AS (SELECT q, id AS root, score AS seed FROM ({S.ranked('fb')}) WHERE rank <= 2)",
        "fin AS (SELECT s.q, c.id, max(f.score + 0.35::DOUBLE * s.seed + 0.85::DOUBLE * c.boost / (c.hop + 1)) AS score FROM sd s JOIN clo c USING (root) JOIN fb f ON f.q = s.q AND f.id = c.id GROUP BY ALL)",
    )
    + OUT + f"({S.ranked('fin')})",
)
def cached_frame(spark, sf_dir):
    pairs = records.pairs(spark, sf_dir)
    base = frame_base(spark, sf_dir, pairs)
    out = cached_frame_scores(base, top_k(base, "q", 2), closure(spark, sf_dir, 2), 0.85)
    return shape(ranked(out, "q"))


@query(
    "j38_truth_edge_expansion",
    S.with_(
        ASSOC,
        "tedge AS (SELECT * EXCLUDE (epos), row_number() OVER (PARTITION BY q, source ORDER BY target, type, epos) AS epos FROM sedge)",
        Q.expand(
            "x", "base", "seeds", "tedge", 2,
            lambda d: f"0.78::DOUBLE * f.score + e.weight * e.boost * (0.62::DOUBLE + 0.50::DOUBLE * e.overlap) * (0.70::DOUBLE + 0.30::DOUBLE * e.confidence) / {1.35 + d}::DOUBLE + 0.02::DOUBLE * e.t_importance + e.t_state",
            fanout=2,
        ),
    )
    + OUT + f"({S.ranked('xbest')})",
)
def truth_expansion(spark, sf_dir):
    from memjoin.operators.routing import truth_expansion as expand

    pairs = records.pairs(spark, sf_dir)
    base = B.associative_base(pairs, 8)
    return shape(ranked(expand(base, top_k(base, "q", 8), records.scored_edges(spark, sf_dir, pairs), 2, 2), "q"))


@query(
    "j42_rank_compaction",
    S.with_(
        Q.PAIRS,
        f"sp AS (SELECT q, id, {Q.SPARSE} AS score, lexical, activation, protected, lower(text) AS t FROM pairs)",
        """c AS (SELECT *, CASE WHEN protected THEN score ELSE 0.42::DOUBLE * score + 0.24::DOUBLE * lexical + 0.18::DOUBLE * activation
           + CASE WHEN contains(t, 'accepted resolution') OR contains(t, 'support note') OR contains(t, 'succeeded') OR contains(t, 'escalation') THEN 0.20::DOUBLE ELSE 0.0::DOUBLE END
           - CASE WHEN contains(t, 'decoy') OR contains(t, 'wrong') OR contains(t, 'conflict') OR contains(t, 'superseded') OR contains(t, 'growth-noise') THEN 0.18::DOUBLE ELSE 0.0::DOUBLE END END AS kept FROM sp)""",
        "p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY protected DESC, round(kept, 9) DESC, id) AS slot FROM c)",
    )
    + "SELECT q, id, round(kept, 6) AS kept_score, slot FROM p WHERE slot <= 3",
)
def compaction(spark, sf_dir):
    pairs = records.pairs(spark, sf_dir)
    scored = pairs.select("q", "id", B.sparse_score().alias("score"), "lexical", "activation", "text", F.col("protected").alias("protected_hit"))
    scored = scored.withColumn("compacted", compact_score(F.col("score"), F.col("lexical"), F.col("activation"), F.col("text")))
    return compact(scored, 3).select("q", "id", F.round("kept_score", 6).alias("kept_score"), F.col("slot").cast("bigint").alias("slot"))

"""Context packing queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memjoin.operators import ranking as R
from memjoin.plans import sqltext as S
from memjoin.plans import workload as W
from memjoin.plans.registry import query
from memjoin.sources import tables

PACKED_SQL = S.with_(W.LEX, W.COST, W.pack_sql())


@query("w2_token_budget_packing", PACKED_SQL + "SELECT q, id, rank, cost, used FROM ctx")
def token_budget_packing(spark, sf_dir):
    out = W.packed(spark, sf_dir, W.lexical_ranked(spark, sf_dir))
    return out.select("q", "id", F.col("rank").cast("bigint").alias("rank"), "cost", "used")


@query(
    "w3_packing_with_blocks",
    S.with_(
        W.LEX,
        W.COST,
        "r AS (SELECT l.q, l.id, l.rank, c.cost, m.cluster, m.last_outcome FROM lex l JOIN cost c USING (id) JOIN mem m USING (id))",
        "b AS (SELECT a.q, a.id, o.id AS blocked_id FROM r a JOIN r o ON a.q = o.q AND a.cluster = o.cluster AND a.id <> o.id WHERE a.last_outcome = 'ignored')",
        "bl AS (SELECT DISTINCT q, id FROM b)",
        "fb AS (SELECT b.q, b.blocked_id AS id, min(r.rank) AS block_rank FROM b JOIN r ON r.q = b.q AND r.id = b.id GROUP BY ALL)",
        "f AS (SELECT r.*, bl.id IS NOT NULL OR coalesce(fb.block_rank < r.rank, false) AS skip FROM r LEFT JOIN bl USING (q, id) LEFT JOIN fb USING (q, id))",
        """p AS (SELECT *, sum(CASE WHEN skip THEN 0 ELSE cost END) OVER w AS used, sum((NOT skip)::INT) OVER w AS slot FROM f
           WINDOW w AS (PARTITION BY q ORDER BY rank ROWS UNBOUNDED PRECEDING))""",
    )
    + "SELECT q, id, rank, used::BIGINT AS used, slot::BIGINT AS slot FROM p WHERE NOT skip AND used <= 2500 AND slot <= 6",
)
def packing_with_blocks(spark, sf_dir):
    """Cards last ignored stand in for blocker cards: each blocks the other ranked cards of its cluster."""
    mem = tables.memories(spark, sf_dir).select("id", "cluster", "last_outcome")
    rows = W.costed(spark, sf_dir, W.lexical_ranked(spark, sf_dir)).join(mem, "id")
    other = rows.select("q", "cluster", F.col("id").alias("blocked_id"))
    blockers = (
        rows.where(F.col("last_outcome") == "ignored").select("q", "id", "cluster").join(other, ["q", "cluster"])
        .where(F.col("id") != F.col("blocked_id")).select("q", "id", "blocked_id")
    )
    out = R.pack_with_blocks(rows.select("q", "id", "rank", "cost"), blockers, 2500, 6)
    return out.select("q", "id", F.col("rank").cast("bigint").alias("rank"), "used", F.col("slot").cast("bigint").alias("slot"))


@query(
    "w4_threshold_packing",
    S.with_(
        W.LEX,
        W.COST,
        "r AS (SELECT l.q, l.id, l.rank, c.cost, 1.0 / (1.0 + exp(-(l.score - 20.0) / 8.0)) AS p FROM lex l JOIN cost c USING (id))",
        "pol AS (SELECT * FROM (VALUES (3, 0.25), (3, 0.5), (5, 0.25), (5, 0.5), (8, 0.25), (8, 0.5)) t(top_n, threshold))",
        """pl AS (SELECT *, row_number() OVER (PARTITION BY q, top_n, threshold ORDER BY (round(p, 9) >= threshold)::INT DESC, rank) AS position,
           round(p, 9) >= threshold AS chosen FROM r CROSS JOIN pol)""",
        """u AS (SELECT *, sum(cost) OVER (PARTITION BY q, top_n, threshold ORDER BY position) AS used FROM pl
           WHERE (chosen OR position <= 2) AND position <= top_n)""",
    )
    + "SELECT q, top_n::BIGINT AS top_n, threshold::DOUBLE AS threshold, id, position, used::BIGINT AS used FROM u WHERE used <= 2500",
)
def threshold_packing(spark, sf_dir):
    """Six packing policies over one ranking; the include probability is a logistic of the lexical score."""
    rows = W.costed(spark, sf_dir, W.lexical_ranked(spark, sf_dir))
    policies = F.array(*[F.struct(F.lit(n).alias("top_n"), F.lit(t).alias("threshold")) for n in (3, 5, 8) for t in (0.25, 0.5)])
    rows = rows.withColumn("include_probability", F.round(1.0 / (1.0 + F.exp(-(F.col("score") - 20.0) / 8.0)), 9))
    rows = rows.select("q", "id", "rank", "cost", "include_probability", F.inline(policies))
    out = R.pack_threshold(rows, 2500, F.col("threshold"), 2, F.col("top_n"), ["q", "top_n", "threshold"])
    return out.select("q", F.col("top_n").cast("bigint").alias("top_n"), "threshold", "id", F.col("position").cast("bigint").alias("position"), "used")


@query(
    "w6_neighbour_frames",
    S.with_(S.TURNS)
    + """SELECT id, coalesce(lag(id) OVER u, '') AS previous, coalesce(lag(id) OVER (PARTITION BY uid, speaker ORDER BY pos), '') AS same_speaker,
      count(*) OVER (PARTITION BY uid ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) - 1 AS around FROM turns WINDOW u AS (PARTITION BY uid ORDER BY pos)""",
)
def neighbour_frames(spark, sf_dir):
    order = Window.partitionBy("uid").orderBy("pos")
    speaker = Window.partitionBy("uid", "speaker").orderBy("pos")
    return tables.turns(spark, sf_dir).select(
        "id",
        F.coalesce(F.lag("id").over(order), F.lit("")).alias("previous"),
        F.coalesce(F.lag("id").over(speaker), F.lit("")).alias("same_speaker"),
        (F.count(F.lit(1)).over(order.rowsBetween(-2, 2)) - 1).alias("around"),
    )


@query(
    "u1_union_of_sources",
    S.with_(W.POOL)
    + """SELECT q, id, string_agg(s, ',' ORDER BY s) AS sources, count(*) AS n FROM (SELECT q, id, 'token' AS s FROM lex UNION ALL SELECT q, id, 'vector' FROM vec) GROUP BY q, id""",
)
def union_of_sources(spark, sf_dir):
    parts = W.lexical_ranked(spark, sf_dir).select("q", "id", F.lit("token").alias("s")).unionByName(
        W.vector_ranked(spark, sf_dir).select("q", "id", F.lit("vector").alias("s"))
    )
    return parts.groupBy("q", "id").agg(F.array_join(F.array_sort(F.collect_set("s")), ",").alias("sources"), F.count(F.lit(1)).alias("n"))


@query("u2_intersect_hits", S.with_(W.LEX) + f"SELECT q, id, rank FROM lex SEMI JOIN rel USING (q, id) WHERE rank <= {W.TOP_K}")
def intersect_hits(spark, sf_dir):
    top = W.lexical_ranked(spark, sf_dir).where(F.col("rank") <= W.TOP_K)
    return top.join(tables.relevance(spark, sf_dir), ["q", "id"], "left_semi").select("q", "id", F.col("rank").cast("bigint").alias("rank"))


@query("u3_except_missed", PACKED_SQL + "SELECT q, id FROM rel ANTI JOIN ctx USING (q, id)")
def except_missed(spark, sf_dir):
    context = W.packed(spark, sf_dir, W.lexical_ranked(spark, sf_dir))
    return tables.relevance(spark, sf_dir).join(context, ["q", "id"], "left_anti")


@query(
    "u4_append_new_ids",
    S.with_(W.POOL)
    + """, ext AS (SELECT q, id, rank FROM vec ANTI JOIN lex USING (q, id))
      SELECT q, id, 'lexical' AS origin, rank FROM lex UNION ALL SELECT q, id, 'vector', rank + 32 FROM ext""",
)
def append_new_ids(spark, sf_dir):
    held = W.lexical_ranked(spark, sf_dir)
    new = W.vector_ranked(spark, sf_dir).join(held.select("q", "id"), ["q", "id"], "left_anti")
    return held.select("q", "id", F.lit("lexical").alias("origin"), F.col("rank").cast("bigint").alias("rank")).unionByName(
        new.select("q", "id", F.lit("vector").alias("origin"), (F.col("rank") + W.FETCH).cast("bigint").alias("rank"))
    )


@query(
    "j39_margin_cutoff",
    S.with_(W.LEX)
    + "SELECT q, id, rank FROM (SELECT *, max(score) OVER (PARTITION BY q) AS top FROM lex) WHERE rank <= 3 OR (round(score, 9) >= 12.0 AND round(top - score, 9) <= 4.0)",
)
def margin_cutoff(spark, sf_dir):
    from memjoin.operators.merge import margin_cutoff as cut

    return cut(W.lexical_ranked(spark, sf_dir), 3, 12.0, 4.0).select("q", "id", F.col("rank").cast("bigint").alias("rank"))

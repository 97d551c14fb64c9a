"""Token candidate queries (J3, J4) and their ranking, packing and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from memjoin.operators.lexical import idf_token_scores, token_postings
from memjoin.operators.ranking import ranked, top_k
from memjoin.plans import sqltext as S
from memjoin.plans import workload as W
from memjoin.plans.registry import query
from memjoin.sources import tables


@query(
    "j3_token_postings",
    S.with_(S.MEM, S.QRY, S.lexical(W.POSTINGS_CAP))
    + "SELECT tok, count(*)::BIGINT AS df, min(id) AS first_id, max(id) AS last_id, sum(id * pos)::BIGINT AS weight FROM post GROUP BY tok",
)
def postings(spark, sf_dir):
    rows = token_postings(tables.memories(spark, sf_dir).select("id", "text"), W.POSTINGS_CAP)
    return rows.groupBy("tok").agg(
        F.count(F.lit(1)).alias("df"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum(F.col("id") * F.col("pos")).alias("weight")
    )


@query("j4_idf_token_scores", S.with_(W.LEX) + "SELECT q, id, round(score, 6) AS score, rank FROM lex")
def idf_scores(spark, sf_dir):
    return W.lexical_ranked(spark, sf_dir).select("q", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("j4_idf_token_scores_capped", S.with_(S.MEM, S.QRY, S.lexical(W.POSTINGS_CAP, W.FETCH)) + "SELECT q, id, round(score, 6) AS score, rank FROM lex")
def idf_scores_capped(spark, sf_dir):
    """The variant that keeps the first memories of every token and counts df after that cut."""
    rows = idf_token_scores(tables.card_texts(spark, sf_dir), tables.queries(spark, sf_dir).select("q", "text"), W.POSTINGS_CAP, W.FETCH)
    return rows.select("q", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "w1_deterministic_rank",
    S.with_(S.MEM, "s AS (SELECT project, id, 0.1 * importance - 0.0005 * age_days AS score FROM mem)")
    + f"SELECT project, id, round(score, 6) AS score, rank FROM ({S.ranked('s', 'project')})",
)
def deterministic_rank(spark, sf_dir):
    scored = tables.memories(spark, sf_dir).select("project", "id", (0.1 * F.col("importance") - 0.0005 * F.col("age_days")).alias("score"))
    return ranked(scored, "project").select("project", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "w5_per_group_topk",
    S.with_(S.MEM, "s AS (SELECT project, brand, id, 0.1 * importance - 0.0005 * age_days AS score FROM mem)")
    + f"SELECT project, brand, id, rank FROM ({S.ranked('s', 'project, brand')}) WHERE rank <= 5",
)
def group_topk(spark, sf_dir):
    scored = tables.memories(spark, sf_dir).select(
        "project", "brand", "id", (0.1 * F.col("importance") - 0.0005 * F.col("age_days")).alias("score")
    )
    return top_k(scored, ["project", "brand"], 5).select("project", "brand", "id", F.col("rank").cast("bigint").alias("rank"))


@query("relevance_verbatim", S.with_(S.REL) + "SELECT q, id FROM rel")
def relevance(spark, sf_dir):
    return tables.relevance(spark, sf_dir)

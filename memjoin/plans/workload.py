"""Shared steps of the registered queries: the retrieval inputs and the two base rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memjoin.functions.hashing import activation_mask, hash_embedding
from memjoin.functions.text import token_cost, tokens
from memjoin.operators.lexical import idf_token_scores
from memjoin.operators.ranking import pack_budget
from memjoin.operators.vector import exact_vector_topk
from memjoin.plans import sqltext as S
from memjoin.session import written
from memjoin.sources import tables

POSTINGS_CAP = 512  # of the capped queries only; the original defaults to 4096, which the small tables never reach
FETCH = 32
TOP_K = 8
BUDGET = 900
DIMS = 64


def embedded(df: DataFrame, key: str, text: str = "text", dims: int = DIMS) -> DataFrame:
    return df.select(key, hash_embedding(tokens(F.col(text)), dims).alias("vec"))


def masked(df: DataFrame, key: str, text: str = "text", name: str = "mask") -> DataFrame:
    return df.select(key, activation_mask(tokens(F.col(text))).alias(name))


def lexical_ranked(spark: SparkSession, sf_dir: str, limit: int = FETCH) -> DataFrame:
    return idf_token_scores(tables.card_texts(spark, sf_dir), tables.queries(spark, sf_dir).select("q", "text"), None, limit)


def vector_ranked(spark: SparkSession, sf_dir: str, limit: int = FETCH) -> DataFrame:
    return exact_vector_topk(embedded(tables.card_texts(spark, sf_dir), "id"), embedded(tables.queries(spark, sf_dir), "q"), limit, DIMS)


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, id): union of both base rankings, the candidate list of every rescoring query."""
    return lexical_ranked(spark, sf_dir).select("q", "id").unionByName(vector_ranked(spark, sf_dir).select("q", "id")).distinct()


def costed(spark: SparkSession, sf_dir: str, ranked: DataFrame) -> DataFrame:
    """Ranked ids with their token cost, both written once; only texts that a ranking names are split into tokens."""
    pairs = written(ranked, "ranked")
    named = tables.card_texts(spark, sf_dir).join(pairs.select("id").distinct(), "id", "left_semi")
    return written(pairs.join(named.select("id", token_cost(F.col("text")).alias("cost")), "id"), "costed")


def packed(spark: SparkSession, sf_dir: str, ranked: DataFrame, budget: int = BUDGET) -> DataFrame:
    return pack_budget(costed(spark, sf_dir, ranked), budget)


# SQL counterparts -----------------------------------------------------------------------------------------------
BASE = ",\n".join([S.MEM, S.QRY, S.REL])
LEX = ",\n".join([BASE, S.lexical(limit=FETCH)])
VEC = ",\n".join([BASE, S.vector(FETCH)])
POOL = ",\n".join([LEX, S.vector(FETCH), "pool AS (SELECT q, id FROM lex UNION SELECT q, id FROM vec)"])
COST = f"cost AS (SELECT id, {S.cost('text')} AS cost FROM mem)"


def pack_sql(source: str = "lex", budget: int = BUDGET, name: str = "ctx") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT r.*, c.cost, sum(c.cost) OVER (PARTITION BY r.q ORDER BY r.rank)::BIGINT AS used
  FROM {source} r JOIN cost c USING (id)) WHERE used <= {budget})"""


def flag_sql(source: str = "lex", ctx: str = "ctx", name: str = "fl") -> str:
    return f"""{name} AS (SELECT r.*, (l.id IS NOT NULL)::INT AS is_relevant, (c.id IS NOT NULL)::INT AS in_context FROM {source} r
  LEFT JOIN rel l ON l.q = r.q AND l.id = r.id LEFT JOIN {ctx} c ON c.q = r.q AND c.id = r.id)"""

"""Vector candidate queries (J1, J2) and the embedding hook."""

from __future__ import annotations

from pyspark.sql import functions as F

from memjoin.operators import vector as V
from memjoin.plans import sqltext as S
from memjoin.plans import workload as W
from memjoin.plans.registry import query
from memjoin.sources import tables

SELF_SQL = """WITH s AS (SELECT a.vec_id AS q, b.vec_id AS id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings b)
SELECT q, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= 10"""


def shape(df):
    return df.select("q", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("j1_exact_vector_topk", SELF_SQL)
def exact_topk(spark, sf_dir):
    mem = tables.vectors(spark, sf_dir)
    return shape(V.exact_vector_topk(mem, mem.withColumnRenamed("id", "q"), 10, 64))


@query("j1_exact_vector_topk_blocks", SELF_SQL)
def exact_topk_blocks(spark, sf_dir):
    """The same answer by the block route that serves query sets too large to broadcast."""
    mem = tables.vectors(spark, sf_dir)
    return shape(V.exact_vector_topk(mem, mem.withColumnRenamed("id", "q"), 10, 64, broadcast_bytes=0))


@query("j1_text_vector_topk", S.with_(W.VEC) + "SELECT q, id, round(score, 6) AS score, rank FROM vec")
def text_topk(spark, sf_dir):
    return shape(W.vector_ranked(spark, sf_dir))


# Cells around drawn centres; the probes are the 95 % quantile of the places of true neighbours' cells over drawn queries.
CELLED = f"""dr AS (SELECT vec_id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY (vec_id * {V.MIX}) % {V.MODULUS}, vec_id) AS n FROM embeddings),
ce AS (SELECT v AS centre, row_number() OVER (ORDER BY vec_id) - 1 AS cell FROM dr WHERE n <= {V.CELLS}),
od AS (SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_dot_product(v, centre), 9) DESC, cell) AS place FROM dr CROSS JOIN ce),
ho AS (SELECT vec_id, cell FROM od WHERE place = 1),
ex AS (SELECT * FROM (SELECT a.vec_id AS q, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.v, b.v), 9) DESC, b.vec_id) AS rank FROM dr a, dr b) WHERE rank <= 10),
pr AS (SELECT quantile_disc(place, {V.TARGET}) AS probes FROM ex JOIN dr ON dr.vec_id = q AND n <= {V.SAMPLE} JOIN ho ON ho.vec_id = ex.id JOIN od ON od.vec_id = ex.q AND od.cell = ho.cell),
sc AS (SELECT o.vec_id AS q, h.vec_id AS id, list_dot_product(a.v, b.v) AS score FROM od o JOIN pr ON o.place <= probes JOIN ho h USING (cell) JOIN dr a ON a.vec_id = o.vec_id JOIN dr b ON b.vec_id = h.vec_id),
tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, id) AS rank FROM sc) WHERE rank <= 10)"""


@query("j2_approximate_vector_candidates", S.with_(CELLED) + "SELECT q, id, round(score, 6) AS score, rank FROM tk")
def approximate(spark, sf_dir):
    mem = tables.vectors(spark, sf_dir)
    return shape(V.celled_vector_topk(mem, mem.withColumnRenamed("id", "q"), 10, 64))


@query(
    "j2_recall_against_exact",
    S.with_(CELLED)
    + "SELECT ex.q, count(tk.id) / 10.0::DOUBLE AS recall FROM ex LEFT JOIN tk ON tk.q = ex.q AND tk.id = ex.id GROUP BY ex.q",
)
def approximate_recall(spark, sf_dir):
    """Per query share of the exact ten nearest that the approximate search also returns."""
    mem = tables.vectors(spark, sf_dir)
    asked = mem.withColumnRenamed("id", "q")
    exact = V.exact_vector_topk(mem, asked, 10, 64).select("q", "id")
    found = V.celled_vector_topk(mem, asked, 10, 64).select("q", "id").withColumn("hit", F.lit(1))
    return exact.join(found, ["q", "id"], "left").groupBy("q").agg((F.sum(F.coalesce("hit", F.lit(0))) / 10.0).alias("recall"))

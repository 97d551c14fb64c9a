"""Scalar function queries (F1-F28) over documents, benchmark passages, turns and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from memjoin.functions import hashing as H
from memjoin.functions import text as X
from memjoin.operators import vector as V
from memjoin.plans import sqltext as S
from memjoin.plans import workload as W
from memjoin.plans.registry import query
from memjoin.sources import tables


@query(
    "f1_tokens",
    f"SELECT doc_id, len({S.toks('text')})::BIGINT AS n, md5(array_to_string({S.toks('text')}, ' ')) AS digest FROM documents",
)
def f1(spark, sf_dir):
    toks = X.tokens(F.col("text"))
    return tables.table(spark, sf_dir, "documents").select(
        "doc_id", F.size(toks).cast("bigint").alias("n"), F.md5(F.array_join(toks, " ")).alias("digest")
    )


@query(
    "f2_token_set",
    f"SELECT doc_id, len({S.tset('text')})::BIGINT AS n, md5(array_to_string(list_sort({S.tset('text')}), ' ')) AS digest FROM documents",
)
def f2(spark, sf_dir):
    toks = X.token_set(F.col("text"))
    return tables.table(spark, sf_dir, "documents").select(
        "doc_id", F.size(toks).cast("bigint").alias("n"), F.md5(F.array_join(F.array_sort(toks), " ")).alias("digest")
    )


@query("f3_fnv1a64", f"SELECT page_id, {S.signed('h')} AS h FROM (SELECT page_id, {S.fnv('url')} AS h FROM pages)")
def f3(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages").select("page_id", H.fnv1a64(F.col("url")).alias("h"))


@query(
    "f3_fnv1a64_token_array",
    S.with_(
        f"t AS (SELECT DISTINCT conv_id, turn, tok FROM (SELECT conv_id, turn, unnest({S.toks('text')}) AS tok FROM conversations))",
        f"d AS (SELECT tok, {S.fnv('tok')} AS h FROM (SELECT DISTINCT tok FROM t))",
    )
    + "SELECT conv_id, turn, sum(h % 1000003)::BIGINT AS digest, count(*)::BIGINT AS n FROM t JOIN d USING (tok) GROUP BY conv_id, turn",
)
def f3_tokens(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.explode(H.fnv1a64_tokens(F.array_distinct(X.tokens(F.col("text"))))).alias("h")
    )
    return rows.groupBy("conv_id", "turn").agg(F.sum(H.umod(F.col("h"), 1000003)).alias("digest"), F.count(F.lit(1)).alias("n"))


@query(
    "f4_hash_to_unit",
    f"""SELECT page_id, round((h // 2048)::DOUBLE / 9007199254740992.0::DOUBLE, 9) AS u53, (h % 10000000)::DOUBLE / 1e7 AS u7, (h % 1000000)::DOUBLE / 1e6 AS u6
    FROM (SELECT page_id, {S.fnv("'unit:' || page_id")} AS h FROM pages)""",
)
def f4(spark, sf_dir):
    h = H.fnv1a64(F.concat(F.lit("unit:"), F.col("page_id").cast("string")))
    return tables.table(spark, sf_dir, "pages").select("page_id", h.alias("h")).select(
        "page_id",
        F.round(H.unit53(F.col("h")), 9).alias("u53"),
        H.unit_mod(F.col("h"), 10_000_000).alias("u7"),
        H.unit_mod(F.col("h"), 1_000_000).alias("u6"),
    )


@query("f5_activation_mask", S.with_(S.TURNS, S.masks("mm", "turns", "id")) + f"SELECT id, {S.signed('mask::HUGEINT')} AS mask FROM mm")
def f5(spark, sf_dir):
    return W.masked(tables.turns(spark, sf_dir), "id")


MASK_PAIRS = S.with_(
    S.TURNS,
    S.masks("mm", "turns", "id"),
    """p AS (SELECT t.id, lag(m.mask) OVER w AS a, m.mask AS b FROM turns t JOIN mm m USING (id) WINDOW w AS (PARTITION BY uid ORDER BY pos))""",
)


def mask_pairs(spark, sf_dir):
    """Each turn with the mask of the turn before it."""
    from pyspark.sql import Window

    rows = tables.turns(spark, sf_dir).select("uid", "pos", "id", H.activation_mask(X.tokens(F.col("text"))).alias("b"))
    return rows.withColumn("a", F.lag("b").over(Window.partitionBy("uid").orderBy("pos"))).where(F.col("a").isNotNull())


@query("f6_activation_overlap", MASK_PAIRS + f"SELECT id, round({S.overlap('a', 'b')}, 6) AS overlap FROM p WHERE a IS NOT NULL")
def f6(spark, sf_dir):
    return mask_pairs(spark, sf_dir).select("id", F.round(X.mask_overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


@query("f7_activation_coverage", MASK_PAIRS + f"SELECT id, round({S.coverage('a', 'b')}, 6) AS coverage FROM p WHERE a IS NOT NULL")
def f7(spark, sf_dir):
    return mask_pairs(spark, sf_dir).select("id", F.round(X.mask_coverage(F.col("a"), F.col("b")), 6).alias("coverage"))


@query(
    "f8_jaccard",
    S.with_(S.TURNS, f"p AS (SELECT id, {S.tset('text')} AS b, lag({S.tset('text')}) OVER (PARTITION BY uid ORDER BY pos) AS a FROM turns)")
    + f"SELECT id, round({S.jac('a', 'b')}, 6) AS jaccard FROM p WHERE a IS NOT NULL",
)
def f8(spark, sf_dir):
    from pyspark.sql import Window

    rows = tables.turns(spark, sf_dir).select("uid", "pos", "id", X.token_set(F.col("text")).alias("b"))
    pairs = rows.withColumn("a", F.lag("b").over(Window.partitionBy("uid").orderBy("pos"))).where(F.col("a").isNotNull())
    return pairs.select("id", F.round(X.jaccard_sets(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query(
    "f9_hash_embedding",
    S.with_(S.MEM, S.hash_vectors("mv", "mem", "id"))
    + "SELECT id, idx::BIGINT AS idx, round(v, 6) AS v FROM mv WHERE v <> 0",
)
def f9(spark, sf_dir):
    vec = W.embedded(tables.memories(spark, sf_dir), "id")
    return vec.select("id", F.posexplode("vec").alias("idx", "v")).where(F.col("v") != 0).select(
        "id", F.col("idx").cast("bigint").alias("idx"), F.round("v", 6).alias("v")
    )


SCALED = "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id % 7 + 0.5)) AS v FROM embeddings"


def scaled(spark, sf_dir):
    """Embeddings scaled by a row factor, so that normalisation has work to do."""
    factor = F.col("vec_id") % 7 + 0.5
    return tables.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * factor).alias("v"))


@query(
    "f10_l2_normalize",
    f"""SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS norm2, round(u[1], 6) AS first, round(u[64], 6) AS last
    FROM (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM ({SCALED}))""",
)
def f10(spark, sf_dir):
    unit = scaled(spark, sf_dir).select("vec_id", V.l2_normalize(F.col("v")).alias("u"))
    return unit.select(
        "vec_id", F.round(V.dot(F.col("u"), F.col("u")), 6).alias("norm2"), F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(F.get("u", F.lit(63)), 6).alias("last")
    )


PAIRED = """pr AS (SELECT vec_id, embedding::DOUBLE[] AS b, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS a FROM embeddings)"""


def paired(spark, sf_dir):
    """Each vector with the previous vector of its label."""
    from pyspark.sql import Window

    rows = tables.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("b"))
    return rows.withColumn("a", F.lag("b").over(Window.partitionBy("label").orderBy("vec_id"))).where(F.col("a").isNotNull())


@query("f11_dot_cosine", S.with_(PAIRED) + "SELECT vec_id, round(list_dot_product(a, b), 6) AS score FROM pr WHERE a IS NOT NULL")
def f11(spark, sf_dir):
    return paired(spark, sf_dir).select("vec_id", F.round(V.dot(F.col("a"), F.col("b")), 6).alias("score"))


@query(
    "f12_cosine_prefix",
    S.with_(PAIRED) + "SELECT vec_id, round(list_cosine_similarity(a[1:32], b[1:32]), 6) AS score FROM pr WHERE a IS NOT NULL",
)
def f12(spark, sf_dir):
    return paired(spark, sf_dir).select("vec_id", F.round(V.cosine_prefix(F.col("a"), F.col("b"), 32), 6).alias("score"))


@query(
    "f13_fit_embedding",
    "SELECT vec_id, 80::BIGINT AS wide, 48::BIGINT AS narrow, round(embedding[48]::DOUBLE, 6) AS kept, 0.0::DOUBLE AS padded FROM embeddings",
)
def f13(spark, sf_dir):
    base = tables.table(spark, sf_dir, "embeddings")
    return base.select("vec_id", V.fit(F.col("embedding"), 80).alias("w"), V.fit(F.col("embedding"), 48).alias("n")).select(
        "vec_id",
        F.size("w").cast("bigint").alias("wide"),
        F.size("n").cast("bigint").alias("narrow"),
        F.round(F.get("n", F.lit(47)), 6).alias("kept"),
        F.get("w", F.lit(79)).alias("padded"),
    )


@query(
    "f14_quantize_int8",
    S.with_(
        PAIRED,
        "qz AS (SELECT vec_id, list_transform(a, lambda x: greatest(-127, least(127, round_even(x / sqrt(list_dot_product(a, a)) * 127.0, 0)::INT))) AS qa,"
        " list_transform(b, lambda x: greatest(-127, least(127, round_even(x / sqrt(list_dot_product(b, b)) * 127.0, 0)::INT))) AS qb FROM pr WHERE a IS NOT NULL)",
    )
    + "SELECT vec_id, list_sum(qb)::BIGINT AS total, round(list_dot_product(qa::DOUBLE[], qb::DOUBLE[]) / 16129.0, 6) AS score FROM qz",
)
def f14(spark, sf_dir):
    pairs = paired(spark, sf_dir).select("vec_id", V.quantize_int8(F.col("a")).alias("qa"), V.quantize_int8(F.col("b")).alias("qb"))
    return pairs.select(
        "vec_id",
        F.aggregate("qb", F.lit(0), lambda s, v: s + v).cast("bigint").alias("total"),
        F.round(V.dot_int8(F.col("qa"), F.col("qb")), 6).alias("score"),
    )


@query(
    "f17_clamp",
    "SELECT event_id, greatest(-5.0, least(20.0, value)) AS clamped, greatest(-32768, least(32767, (value * 4000)::BIGINT))::BIGINT AS clamped16 FROM (SELECT event_id, floor(value) AS value FROM events)",
)
def f17(spark, sf_dir):
    v = F.floor("value").cast("double")
    return tables.table(spark, sf_dir, "events").select(
        "event_id", X.clamp(v, -5.0, 20.0).alias("clamped"), F.greatest(F.lit(-32768), F.least(F.lit(32767), (v * 4000).cast("bigint"))).alias("clamped16")
    )


@query(
    "f28_short_text",
    r"""SELECT page_id, CASE WHEN length(t) > 140 THEN substr(t, 1, 137) || '...' ELSE t END AS short
    FROM (SELECT page_id, trim(regexp_replace(html, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM pages)""",
)
def f28(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages").select("page_id", X.short_text(F.col("html"), 140).alias("short"))

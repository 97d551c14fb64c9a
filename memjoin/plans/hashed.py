"""Hashed field token queries (J12-J22, X4) over documents and benchmark passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from memjoin.functions.hashing import activation_mask, hash_embedding
from memjoin.functions.text import tokens
from memjoin.operators import hashed as H
from memjoin.operators.merge import max_merge
from memjoin.operators.ranking import top_k
from memjoin.operators.vector import exact_vector_topk
from memjoin.plans import sqltext as S
from memjoin.plans import workload as W
from memjoin.plans.registry import query
from memjoin.session import cut_lineage
from memjoin.sources import tables

DIMS, ACTIONS, WIDTH, KEEP, BUCKET, RADIUS = 64, 32, 8, 12, 0.1, 1
LAYERS, CHANCE, BIAS, BEAM = 4, 0.35, 0.5, 12
CAP, MIN_CANDIDATES = 64, 200


def plan():
    return H.projection_plan(DIMS, ACTIONS, WIDTH)


def indexed(df, key):
    """The field index of one side: tokens, vector and mask of every text from one scan, written once."""
    toks = df.select(key, "text", tokens(F.col("text")).alias("toks"))
    rows = toks.select(key, "text", hash_embedding(F.col("toks"), DIMS).alias("vec"), activation_mask(F.col("toks")).alias("mask"))
    field = H.with_field_tokens(rows, plan(), ACTIONS, KEEP, BUCKET)
    mean = F.coalesce(F.aggregate("field", F.lit(0.0), lambda total, t: total + t["weight"]) / F.nullif(F.size("field"), F.lit(0)), F.lit(0.0))
    level = H.promoted_level(F.col(key).cast("string"), F.length("text"), mean, LAYERS, CHANCE, BIAS)
    return cut_lineage(field.select(key, "vec", "mask", "field", level.alias("level")))


def memory_index(spark, sf_dir):
    return indexed(tables.card_texts(spark, sf_dir), "id")


def query_index(spark, sf_dir):
    return indexed(tables.queries(spark, sf_dir).select("q", "text"), "q")


def field_rows(index, key):
    return index.select(key, F.explode("field").alias("t")).select(key, "t.action", "t.bucket", "t.weight")


def memory_tokens(spark, sf_dir):
    return field_rows(memory_index(spark, sf_dir), "id")


def query_tokens(spark, sf_dir):
    return field_rows(query_index(spark, sf_dir), "q")


def tokens_sql(name: str, source: str, key: str, vectors: str) -> str:
    slot = " UNION ALL ".join(f"SELECT tok, ({S.fnv(chr(39) + 'field-lex:' + chr(39) + ' || tok || ' + chr(39) + ':' + str(i) + chr(39))} % {ACTIONS})::INT AS action FROM {name}_u" for i in range(3))
    return f"""{name}_s AS (SELECT DISTINCT {key}, tok FROM (SELECT {key}, unnest({S.toks('text')}) AS tok FROM {source}) WHERE length(tok) > 1),
{name}_u AS (SELECT DISTINCT tok FROM {name}_s),
{name}_a AS ({slot}),
{name}_h AS (SELECT {key}, action, count(*) AS n FROM {name}_s JOIN {name}_a USING (tok) GROUP BY {key}, action),
{name}_v AS (SELECT s.{key}, p.action, sum(p.sign * coalesce(v.v, 0.0)) / sqrt({WIDTH}.0) AS value FROM {source} s CROSS JOIN pts p
  LEFT JOIN {vectors} v ON v.{key} = s.{key} AND v.idx = p.dim GROUP BY s.{key}, p.action),
{name} AS (SELECT {key}, action, bucket, weight FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(weight, 9) DESC, action, bucket) AS n FROM (
  SELECT v.{key}, v.action, floor(round(v.value / {BUCKET}, 9))::INT AS bucket, abs(v.value) + least(0.25::DOUBLE, coalesce(h.n, 0) * 0.035::DOUBLE) AS weight
  FROM {name}_v v LEFT JOIN {name}_h h ON h.{key} = v.{key} AND h.action = v.action)) WHERE n <= {KEEP})"""


PTS = S.points(str(ACTIONS), DIMS, WIDTH)
TOK = ",\n".join([W.BASE, S.hash_vectors("mv", "mem", "id"), S.hash_vectors("qv", "qry", "q"), PTS, tokens_sql("mt", "mem", "id", "mv"), tokens_sql("qt", "qry", "q", "qv")])
LEVEL = f"""lim AS (SELECT m.id, least(0.95::DOUBLE, {CHANCE}::DOUBLE * (1.0::DOUBLE + {BIAS}::DOUBLE * (0.5::DOUBLE * coalesce(t.w, 0.0)
  + 0.5::DOUBLE * ({S.fnv("'field-importance:' || m.id || ':' || length(m.text)")} % 1000)::DOUBLE / 1000.0::DOUBLE))) AS p
  FROM mem m LEFT JOIN (SELECT id, avg(weight) AS w FROM mt GROUP BY id) t ON t.id = m.id),
lvl AS (SELECT id, CASE WHEN u1 > p THEN 0 WHEN u2 > p THEN 1 WHEN u3 > p THEN 2 ELSE 3 END AS level FROM (SELECT *, """ + ", ".join(
    f"({S.fnv(chr(39) + 'field-promote:' + chr(39) + ' || id || ' + chr(39) + ':' + str(i) + chr(39))} // 2048)::DOUBLE / 9007199254740992.0::DOUBLE AS u{i}" for i in (1, 2, 3)
) + " FROM lim))"
POSTED = "posted AS (SELECT layer, action, bucket, id, weight FROM mt JOIN lvl USING (id) CROSS JOIN (SELECT unnest(range(0, 4)) AS layer) WHERE layer <= level)"
ASK = f"""ask AS (SELECT q, action, weight AS q_weight, bucket + d AS bucket, 1.0::DOUBLE / (1 + abs(d)) AS damping FROM qt CROSS JOIN (SELECT unnest(range(-{RADIUS}, {RADIUS + 1})) AS d))"""


def hits_sql(name: str, source: str) -> str:
    return f"{name} AS (SELECT q, id, sum(q_weight * damping) AS score, sum(q_weight * weight * damping) AS overlap FROM ask JOIN {source} USING (action, bucket) GROUP BY q, id)"


ROUTE = ",\n".join(
    [hits_sql(f"h{n}", f"(SELECT * FROM posted WHERE layer = {n})") for n in (3, 2, 1)]
    + [f"fr3 AS (SELECT q, id, score FROM ({S.ranked('h3')}) WHERE rank <= {BEAM})"]
    + [
        f"""mg{n} AS (SELECT q, id, sum(score) AS score FROM (SELECT q, id, score FROM h{n} UNION ALL SELECT q, id, 0.5 * score FROM fr{n + 1} JOIN lvl USING (id) WHERE level >= {n - 1}) GROUP BY q, id),
fs{n} AS (SELECT q, id, score FROM ({S.ranked(f'mg{n}')}) WHERE rank <= {BEAM}),
fr{n} AS (SELECT * FROM fs{n} UNION ALL SELECT q, id, score FROM fr{n + 1} WHERE q NOT IN (SELECT q FROM fs{n}))"""
        for n in (2, 1)
    ]
)
COLLIDE = ",\n".join([TOK, LEVEL, POSTED, ASK, hits_sql("hit", "mt"), ROUTE])
CAND = COLLIDE + f""",
kept AS (SELECT h.q, h.id, h.score + 0.35 * coalesce(r.score, 0.0) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, id) AS rank FROM hit) h
  LEFT JOIN fr1 r ON r.q = h.q AND r.id = h.id WHERE r.id IS NOT NULL OR (h.rank <= 400 AND h.score >= 0.2 AND h.overlap >= 0.02)),
starved AS (SELECT q.q FROM (SELECT DISTINCT q FROM qt) q LEFT JOIN (SELECT q, count(*) AS n FROM kept GROUP BY q) k USING (q) WHERE coalesce(k.n, 0) < {MIN_CANDIDATES}),
wide AS (SELECT t.q, m.id, sum(0.05 * t.weight) AS score FROM qt t JOIN starved USING (q) JOIN (SELECT DISTINCT action, id FROM mt) m USING (action) GROUP BY t.q, m.id),
cs AS (SELECT q, id, score FROM kept ANTI JOIN wide USING (q, id) UNION ALL SELECT q, id, score FROM wide),
cand AS (SELECT * FROM ({S.ranked('cs')}) WHERE rank <= {CAP})"""
MASKS = ",\n".join([S.masks("mm", "mem", "id"), S.masks("qm", "qry", "q")])


def score_sql(source: str, weights: tuple, fetch: int, name: str = "fin") -> str:
    field, semantic, activation, origin = weights
    return f"""{name}_o AS (SELECT c.q, c.id, sum(a.q_weight * m.weight * a.damping) AS overlap FROM {source} c JOIN ask a ON a.q = c.q JOIN mt m ON m.id = c.id AND m.action = a.action AND m.bucket = a.bucket GROUP BY ALL),
{name}_c AS (SELECT c.q, c.id, sum(a.v * b.v) AS cosine FROM {source} c JOIN qv a ON a.q = c.q JOIN mv b ON b.id = c.id AND b.idx = a.idx GROUP BY ALL),
{name}_s AS (SELECT c.q, c.id, {field}::DOUBLE * coalesce(o.overlap, 0.0) + {semantic}::DOUBLE * coalesce(k.cosine, 0.0)
  + {activation}::DOUBLE * bit_count(qm.mask & mm.mask)::DOUBLE / greatest(1, bit_count(qm.mask)) + {origin}::DOUBLE * c.score AS score
  FROM {source} c LEFT JOIN {name}_o o ON o.q = c.q AND o.id = c.id LEFT JOIN {name}_c k ON k.q = c.q AND k.id = c.id JOIN qm ON qm.q = c.q JOIN mm ON mm.id = c.id),
{name} AS (SELECT * FROM ({S.ranked(name + '_s')}) WHERE rank <= {fetch})"""


def shape(df):
    return df.select("q", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


OUT = "SELECT q, id, round(score, 6) AS score, rank FROM "


@query(
    "j13_projection_plan",
    S.with_(PTS)
    + ", n AS (SELECT count(*) AS n FROM embeddings) SELECT vec_id, action::BIGINT AS action, round(sum(sign * embedding[dim + 1]::DOUBLE) / sqrt(8.0), 6) AS value FROM embeddings CROSS JOIN pts GROUP BY vec_id, action",
)
def projection_values(spark, sf_dir):
    """The plan applied to every stored vector."""
    values = F.transform(plan(), lambda points: H.project(F.col("embedding"), points))
    return tables.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(values).alias("action", "value")).select(
        "vec_id", F.col("action").cast("bigint").alias("action"), F.round("value", 6).alias("value")
    )


@query("j14_field_token_emission", S.with_(TOK) + "SELECT id, action::BIGINT AS action, bucket::BIGINT AS bucket, round(weight, 6) AS weight FROM mt")
def emission(spark, sf_dir):
    return memory_tokens(spark, sf_dir).select("id", F.col("action").cast("bigint").alias("action"), F.col("bucket").cast("bigint").alias("bucket"), F.round("weight", 6).alias("weight"))


@query("j15_hash_level", S.with_(TOK, LEVEL) + "SELECT id, level::BIGINT AS level FROM lvl")
def hash_level(spark, sf_dir):
    return memory_index(spark, sf_dir).select("id", F.col("level").cast("bigint").alias("level"))


@query(
    "j16_token_field_index",
    S.with_(TOK, LEVEL, POSTED)
    + "SELECT layer::BIGINT AS layer, action::BIGINT AS action, bucket::BIGINT AS bucket, count(*) AS n, sum(id)::BIGINT AS ids, round(sum(weight), 6) AS weight FROM posted GROUP BY ALL",
)
def field_index(spark, sf_dir):
    index = memory_index(spark, sf_dir)
    rows = H.layered_postings(field_rows(index, "id"), index.select("id", "level"))
    return rows.groupBy(*[F.col(c).cast("bigint").alias(c) for c in ("layer", "action", "bucket")]).agg(
        F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.round(F.sum("weight"), 6).alias("weight")
    )


@query("j17_bucket_collisions", S.with_(TOK, ASK, hits_sql("hit", "mt")) + "SELECT q, id, round(score, 6) AS score FROM hit")
def collisions(spark, sf_dir):
    out = H.bucket_collisions(query_tokens(spark, sf_dir), memory_tokens(spark, sf_dir), RADIUS)
    return out.select("q", "id", F.round("score", 6).alias("score"))


PREFILTER, LEAST_COLLISION, LEAST_OVERLAP = 400, 0.2, 0.02


def matches(index, asked):
    return cut_lineage(H.field_matches(index, asked, RADIUS, LAYERS, BEAM, PREFILTER, CAP))


def candidates(index, asked):
    return H.collision_candidates(matches(index, asked), asked, LAYERS, BEAM, MIN_CANDIDATES, CAP, PREFILTER, LEAST_COLLISION, LEAST_OVERLAP)


@query("j18_layer_routing", S.with_(COLLIDE) + "SELECT q, id, round(score, 6) AS routed FROM fr1")
def routing(spark, sf_dir):
    out = H.routed_beam(matches(memory_index(spark, sf_dir), query_tokens(spark, sf_dir)), LAYERS, BEAM)
    return out.select("q", "id", F.round("routed", 6).alias("routed"))


@query("j19_collision_candidates", S.with_(CAND) + OUT + "cand")
def collision_candidates(spark, sf_dir):
    return shape(candidates(memory_index(spark, sf_dir), query_tokens(spark, sf_dir)))


@query(
    "j20_field_overlap",
    S.with_(TOK, ASK, "p AS (SELECT q, id FROM rel)")
    + """SELECT p.q, p.id, round(coalesce(sum(a.q_weight * m.weight * a.damping), 0.0), 6) AS overlap FROM p LEFT JOIN (ask a JOIN mt m ON m.action = a.action AND m.bucket = a.bucket)
      ON a.q = p.q AND m.id = p.id GROUP BY p.q, p.id""",
)
def overlap(spark, sf_dir):
    pairs = tables.relevance(spark, sf_dir)
    scored = H.field_overlap(pairs, query_tokens(spark, sf_dir), memory_tokens(spark, sf_dir), RADIUS)
    return pairs.join(scored, ["q", "id"], "left").select("q", "id", F.round(F.coalesce("overlap", F.lit(0.0)), 6).alias("overlap"))


def scored(found, index, asked_index, fetch, weights, near=None):
    """Field score of given pairs; the overlap comes with the candidates, or is looked up for pairs from elsewhere."""
    found = cut_lineage(found)
    if "overlap" not in found.columns:
        near = H.field_overlap(found.select("q", "id"), field_rows(asked_index, "q"), field_rows(index.join(found.select("id").distinct(), "id", "left_semi"), "id"), RADIUS)
        found = found.join(near, ["q", "id"], "left")
    q_side = asked_index.select("q", F.col("vec").alias("q_vec"), F.col("mask").alias("q_mask"))
    return H.token_field_scores(found.select("q", "id", "score", "overlap"), q_side, index.select("id", "vec", "mask"), fetch, weights)


PLAIN, HYBRID = (0.50, 0.30, 0.14, 0.06), (0.08, 0.15, 0.02, 0.75)


@query("j21_token_field_scores", S.with_(CAND, MASKS, score_sql("cand", PLAIN, 32)) + OUT + "fin")
def token_field(spark, sf_dir):
    index, asked = memory_index(spark, sf_dir), query_index(spark, sf_dir)
    return shape(scored(candidates(index, field_rows(asked, "q")), index, asked, 32, PLAIN))


MERGE = f"""vec_s AS (SELECT q.q, m.id, coalesce(s.score, 0.0) AS score FROM qry q CROSS JOIN mem m
  LEFT JOIN (SELECT q, id, sum(qv.v * mv.v) AS score FROM qv JOIN mv USING (idx) GROUP BY q, id) s ON s.q = q.q AND s.id = m.id),
vec AS (SELECT * FROM ({S.ranked('vec_s')}) WHERE rank <= 32),
uni AS (SELECT q, id, max(score) AS score FROM (SELECT q, id, 0.7::DOUBLE * score AS score FROM vec
  UNION ALL SELECT q, id, 0.3::DOUBLE * score / max(abs(score)) OVER (PARTITION BY q) FROM cand) GROUP BY q, id)"""


@query("j12_union_max_merge", S.with_(CAND, MERGE) + "SELECT q, id, round(score, 6) AS score FROM uni")
def union_merge(spark, sf_dir):
    found = candidates(memory_index(spark, sf_dir), query_tokens(spark, sf_dir))
    return max_merge(W.vector_ranked(spark, sf_dir), found).select("q", "id", F.round("score", 6).alias("score"))


@query("j22_hybrid_vector_token", S.with_(CAND, MERGE, MASKS, score_sql("vec", HYBRID, 16)) + OUT + "fin")
def hybrid_vector(spark, sf_dir):
    index, asked = memory_index(spark, sf_dir), query_index(spark, sf_dir)
    nearest = exact_vector_topk(index.select("id", "vec"), asked.select("q", "vec"), W.FETCH, DIMS)
    return shape(scored(nearest.select("q", "id", "score"), index, asked, 16, HYBRID))


@query("j22_hybrid_union_token", S.with_(CAND, MERGE, MASKS, score_sql("uni", HYBRID, 16)) + OUT + "fin")
def hybrid_union(spark, sf_dir):
    index, asked = memory_index(spark, sf_dir), query_index(spark, sf_dir)
    nearest = exact_vector_topk(index.select("id", "vec"), asked.select("q", "vec"), W.FETCH, DIMS)
    merged = max_merge(nearest, candidates(index, field_rows(asked, "q")))
    limited = top_k(merged, "q", 192).select("q", "id", "score")
    return shape(scored(limited, index, asked, 16, HYBRID))

"""Metadata, graph and merge candidate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from memjoin.operators import fields as P
from memjoin.operators import metadata as M
from memjoin.operators.merge import weighted_merge
from memjoin.plans import fields as FP
from memjoin.plans import sqltext as S
from memjoin.plans import workload as W
from memjoin.plans.metrics import rounded
from memjoin.plans.registry import query
from memjoin.sources import tables

LIMIT, PER_BUCKET, PER_SEED, HEAD = 64, 24, 12, 4

ORIGINAL = """ix AS (SELECT id, 'metadata' AS source, field, value, max(c) AS confidence FROM (
  SELECT id, 'user_id' AS field, user_id AS value, 1.0::DOUBLE AS c FROM mem UNION ALL SELECT id, 'project', project, 1.0 FROM mem UNION ALL SELECT id, 'brand', brand, 1.0 FROM mem
  UNION ALL SELECT id, 'entity', unnest([user_id, project, brand]), 1.0 FROM mem) GROUP BY ALL),
qm AS (SELECT *, row_number() OVER (PARTITION BY q, field ORDER BY confidence DESC, source, value) AS place FROM (SELECT q, 'metadata' AS source, field, value, max(c) AS confidence FROM (
  SELECT q, 'user_id' AS field, user_id AS value, 1.0::DOUBLE AS c FROM qry UNION ALL SELECT q, 'project', project_id, 1.0 FROM qry UNION ALL SELECT q, 'brand', brand, 1.0 FROM qry
  UNION ALL SELECT q, 'entity', unnest([user_id, project_id, brand]), 0.65 FROM qry) GROUP BY ALL))"""
_weights = "CASE field " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in M.FIELD_WEIGHTS.items()) + " ELSE 0.3 END::DOUBLE"
BUCKETS = f"""bk AS (SELECT * FROM (SELECT m.q, m.source, m.field, m.value, m.confidence AS q_confidence, i.id, row_number() OVER (PARTITION BY m.q, m.source, m.field, m.value ORDER BY (q.project_id <> c.project)::INT, (q.brand <> c.brand)::INT, c.importance DESC, c.age_days, c.id) AS n
  FROM qm m JOIN ix i USING (source, field, value) JOIN mem c ON c.id = i.id JOIN qry q ON q.q = m.q) WHERE n <= {PER_BUCKET})"""
META = f"""ms AS (SELECT b.q, b.id, sum({_weights} * q_confidence) + CASE WHEN any_value(q.project_id) = any_value(c.project) THEN 1.25 ELSE 0.0 END::DOUBLE + CASE WHEN any_value(q.user_id) = any_value(c.user_id) THEN 0.95 ELSE 0.0 END::DOUBLE
  + CASE WHEN any_value(q.brand) = any_value(c.brand) THEN 0.75 ELSE 0.0 END::DOUBLE + 0.10::DOUBLE * any_value(c.importance) - 0.0005::DOUBLE * any_value(c.age_days) AS score, string_agg(DISTINCT source || ':' || field, ',' ORDER BY source || ':' || field) AS sources
  FROM bk b JOIN qry q ON q.q = b.q JOIN mem c ON c.id = b.id GROUP BY b.q, b.id),
mt AS (SELECT * FROM ({S.ranked('ms')}) WHERE rank <= {LIMIT})"""
_specs = ", ".join(f"('{f}', '{t}', {w}::DOUBLE, {r}, {n})" for n, (f, t, w, r) in enumerate(M.EDGE_SPECS))
GRAPH = f"""spec AS (SELECT * FROM (VALUES {_specs}) t(field, type, weight, reach, ord)),
ln AS (SELECT source, field, value, id, row_number() OVER (PARTITION BY source, field, value ORDER BY id) AS pos FROM ix),
ge AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY weight DESC, ord) AS k FROM (SELECT a.id AS source, b.id AS target, s.type, s.weight, s.ord FROM ln a JOIN spec s USING (field)
  JOIN ln b ON b.source = a.source AND b.field = a.field AND b.value = a.value AND abs(a.pos - b.pos) <= s.reach AND a.id <> b.id)),
gr AS (SELECT source, target, type, weight, row_number() OVER (PARTITION BY source ORDER BY weight DESC, type, target) AS edge_rank FROM ge WHERE k = 1)"""
BOTH_RANKED = ",\n".join([W.LEX, S.vector(W.FETCH), ORIGINAL, BUCKETS, META])
SEEDS = f"""sd AS (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY part, rank) AS seed_rank FROM (SELECT q, id, score, 0 AS part, rank FROM vec WHERE rank <= {HEAD}
  UNION ALL SELECT q, id, score, 1, rank FROM lex WHERE rank <= {HEAD} UNION ALL SELECT q, id, score, 2, rank FROM mt WHERE rank <= {HEAD})),
gs AS (SELECT s.q, g.target AS id, sum(g.weight / sqrt(s.seed_rank) + 0.05::DOUBLE * CASE WHEN s.score = 0 THEN 0.0 ELSE greatest(0.0, s.score) / greatest(1.0, abs(s.score)) END + 0.05::DOUBLE * c.importance) AS score,
  string_agg(DISTINCT 'graph:' || g.type, ',' ORDER BY 'graph:' || g.type) AS sources FROM sd s JOIN gr g ON g.source = s.id AND g.edge_rank <= {PER_SEED} JOIN mem c ON c.id = g.target GROUP BY ALL),
gt AS (SELECT * FROM ({S.ranked('gs')}) WHERE rank <= {LIMIT})"""


def derived(spark, sf_dir, only=None):
    """Field predictions of every card, or of the cards in `only` (id)."""
    texts = FP.labelled_texts(spark, sf_dir)
    if only is not None:
        texts = texts.join(only.select(F.col("id").alias("item")).distinct(), "item", "left_semi")
    rows = P.stable_predictions(P.extract(texts, "item"))
    return rows.select(F.col("item").alias("id"), "field", "value", "confidence")


@query(
    "j5_metadata_index",
    S.with_(S.MEM, S.QRY, ORIGINAL, FP.ITEMS, FP.PRED)
    + "SELECT id, source, field, value, confidence FROM ix UNION ALL SELECT item, 'derived_metadata', field, value, max(confidence) FROM pred GROUP BY ALL",
)
def j5(spark, sf_dir):
    return M.metadata_index(tables.memories(spark, sf_dir), derived(spark, sf_dir))


Q_ITEMS = "items AS (SELECT item_id AS item, 'user_001 wants navy, formal. ' || text AS text FROM benchmark)"


def query_derived(spark, sf_dir):
    texts = tables.queries(spark, sf_dir).select(F.col("q").alias("item"), F.concat(F.lit("user_001 wants navy, formal. "), "text").alias("text"))
    return P.stable_predictions(P.extract(texts, "item")).withColumnRenamed("item", "q")


@query(
    "j6_query_metadata",
    S.with_(S.MEM, S.QRY, ORIGINAL, Q_ITEMS, FP.PRED, "al AS (SELECT q, source, field, value, confidence FROM qm UNION ALL SELECT item, 'derived_metadata', field, value, max(confidence) FROM pred GROUP BY ALL)")
    + "SELECT *, row_number() OVER (PARTITION BY q, field ORDER BY confidence DESC, source, value) AS place FROM al",
)
def j6(spark, sf_dir):
    out = M.query_metadata(tables.queries(spark, sf_dir), query_derived(spark, sf_dir))
    return out.select("q", "source", "field", "value", "confidence", F.col("place").cast("bigint").alias("place"))


def buckets(spark, sf_dir):
    mem, values = tables.memories(spark, sf_dir), M.query_metadata(tables.queries(spark, sf_dir))
    return mem, values, M.bounded_buckets(values, M.metadata_index(mem), mem, PER_BUCKET)


@query("j7_bounded_bucket", S.with_(S.MEM, S.QRY, ORIGINAL, BUCKETS) + "SELECT q, field, value, id, n FROM bk")
def j7(spark, sf_dir):
    return buckets(spark, sf_dir)[2].select("q", "field", "value", "id", F.col("n").cast("bigint").alias("n"))


def scored(spark, sf_dir):
    mem, values, met = buckets(spark, sf_dir)
    return M.metadata_scores(values, met, mem, LIMIT)


@query("j8_metadata_scores", S.with_(S.MEM, S.QRY, ORIGINAL, BUCKETS, META) + "SELECT q, id, round(score, 6) AS score, sources, rank FROM mt")
def j8(spark, sf_dir):
    return rounded(scored(spark, sf_dir).select("q", "id", "score", F.array_join("sources", ",").alias("sources"), F.col("rank").cast("bigint").alias("rank")))


def graph(spark, sf_dir, only=None):
    return M.metadata_graph(M.metadata_index(tables.memories(spark, sf_dir)), only=only)


@query("j9_metadata_graph", S.with_(S.MEM, S.QRY, ORIGINAL, GRAPH) + "SELECT source, target, type, weight, edge_rank FROM gr")
def j9(spark, sf_dir):
    return graph(spark, sf_dir).select("source", "target", "type", "weight", F.col("edge_rank").cast("bigint").alias("edge_rank"))


def graph_scored(spark, sf_dir, vector, token, meta):
    from memjoin.session import cut_lineage

    seeds = cut_lineage(M.graph_seeds([(vector, HEAD), (token, HEAD), (meta, HEAD)]))
    return M.graph_scores(seeds, graph(spark, sf_dir, seeds), tables.memories(spark, sf_dir), PER_SEED, LIMIT)


@query("j10_graph_scores", S.with_(BOTH_RANKED, GRAPH, SEEDS) + "SELECT q, id, round(score, 6) AS score, sources, rank FROM gt")
def j10(spark, sf_dir):
    out = graph_scored(spark, sf_dir, W.vector_ranked(spark, sf_dir), W.lexical_ranked(spark, sf_dir), scored(spark, sf_dir))
    return rounded(out.select("q", "id", "score", F.array_join("sources", ",").alias("sources"), F.col("rank").cast("bigint").alias("rank")))


SHARES = {"vector": 0.35, "token": 0.25, "metadata": 0.25, "graph": 0.15}
MERGED = """un AS (""" + " UNION ALL ".join(
    f"SELECT q, id, {SHARES[n]}::DOUBLE * score / max(abs(score)) OVER (PARTITION BY q) AS part, rank AS source_rank, {lab} AS labels FROM {t}"
    for n, t, lab in (("vector", "vec", "'vector'"), ("token", "lex", "'token'"), ("metadata", "mt", "sources"), ("graph", "gt", "sources"))
) + f"""),
mg AS (SELECT q, id, sum(part) AS score, min(source_rank) AS source_rank FROM un GROUP BY q, id),
lb AS (SELECT q, id, string_agg(DISTINCT l, ',' ORDER BY l) AS sources FROM (SELECT q, id, unnest(string_split(labels, ',')) AS l FROM un) GROUP BY q, id),
hy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, source_rank, id) AS rank FROM mg) WHERE rank <= 96)"""


def hybrid(spark, sf_dir, limit=96):
    """Four candidate sources merged; the two base rankings are written once because the graph step reads them again."""
    from memjoin.session import cut_lineage

    vector, token, meta = (cut_lineage(df) for df in (W.vector_ranked(spark, sf_dir), W.lexical_ranked(spark, sf_dir), scored(spark, sf_dir)))
    hops = graph_scored(spark, sf_dir, vector, token, meta)
    return weighted_merge({"vector": (vector, SHARES["vector"]), "token": (token, SHARES["token"]), "metadata": (meta, SHARES["metadata"]), "graph": (hops, SHARES["graph"])}, limit)


@query("j11_four_source_merge", S.with_(BOTH_RANKED, GRAPH, SEEDS, MERGED) + "SELECT q, id, round(score, 6) AS score, source_rank, sources, rank FROM hy JOIN lb USING (q, id)")
def j11(spark, sf_dir):
    out = hybrid(spark, sf_dir)
    return rounded(out.select("q", "id", "score", F.col("source_rank").cast("bigint").alias("source_rank"), F.array_join("sources", ",").alias("sources"), F.col("rank").cast("bigint").alias("rank")))


@query(
    "v15_query_match_annotation",
    S.with_(
        W.LEX, ORIGINAL, FP.ITEMS, FP.PRED,
        "px AS (SELECT item AS id, field, value, max(confidence) AS c FROM pred GROUP BY ALL)",
        "aq AS (SELECT DISTINCT q, field, value FROM qm)", "ai AS (SELECT DISTINCT id, field, value FROM ix UNION SELECT id, field, value FROM px)",
        "dm AS (SELECT l.q, l.id, bool_or(field = 'user_id') AS du, bool_or(field = 'project') AS dp, bool_or(field = 'brand') AS db FROM lex l JOIN aq ON aq.q = l.q JOIN ai USING (field, value) WHERE ai.id = l.id GROUP BY ALL)",
        "dc AS (SELECT id, count(*) AS n, avg(c) AS c FROM px GROUP BY id)",
        "b AS (SELECT l.q, l.id, q.user_id = m.user_id AS um, q.project_id = m.project AS pm, q.brand = m.brand AS bm, coalesce(du, false) AS du, coalesce(dp, false) AS dp, coalesce(db, false) AS db, coalesce(n, 0) AS n, coalesce(c, 0.0) AS c FROM lex l JOIN qry q ON q.q = l.q JOIN mem m ON m.id = l.id LEFT JOIN dm ON dm.q = l.q AND dm.id = l.id LEFT JOIN dc ON dc.id = l.id)",
    )
    + "SELECT q, id, um AS query_user_match, pm AS query_project_match, bm AS query_brand_match, du AS derived_user_match, dp AS derived_project_match, db AS derived_brand_match, n AS derived_count, round(c, 6) AS derived_confidence, (um <> du) OR (pm <> dp) OR (bm <> db) AS metadata_disagreement FROM b",
)
def v15(spark, sf_dir):
    """Matches of the ranked pairs; they are written first, and only cards that a pair names are indexed."""
    from memjoin.session import cut_lineage

    pairs, qry = cut_lineage(W.lexical_ranked(spark, sf_dir).select("q", "id")), tables.queries(spark, sf_dir)
    mem = tables.memories(spark, sf_dir).join(pairs.select("id").distinct(), "id", "left_semi")
    index = M.metadata_index(mem, derived(spark, sf_dir, pairs))
    return rounded(M.query_matches(pairs, qry, mem, M.query_metadata(qry), index))

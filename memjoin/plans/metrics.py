"""Metric queries (A22-A35) over the lexical ranking of benchmark passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from memjoin.functions.text import word_cost
from memjoin.operators import metrics as M
from memjoin.operators.ranking import pack_budget
from memjoin.plans import sqltext as S
from memjoin.plans import workload as W
from memjoin.plans.registry import query
from memjoin.session import written
from memjoin.sources import tables

BUDGET = 2500
FULL = ",\n".join([W.LEX, W.COST, W.pack_sql(budget=BUDGET), W.flag_sql(), "rc AS (SELECT q, count(*) AS n FROM rel GROUP BY q)"])
SUMS = """sm AS (SELECT q.q, coalesce(s.hits, 0) AS hits, s.first_hit, coalesce(s.included, 0) AS included, coalesce(s.ch, 0) AS ch, coalesce(rc.n, 0) AS n FROM qry q
  LEFT JOIN (SELECT q, sum((rank <= 8)::INT * is_relevant) AS hits, min(CASE WHEN is_relevant = 1 THEN rank END) AS first_hit, sum(in_context) AS included, sum(in_context * is_relevant) AS ch FROM fl GROUP BY q) s USING (q)
  LEFT JOIN rc USING (q))"""
M23 = """m23 AS (SELECT q, CASE WHEN n > 0 THEN hits / greatest(1, n) ELSE 0 END::DOUBLE AS recall_at_k, CASE WHEN n > 0 THEN coalesce(1.0 / first_hit, 0) ELSE 0 END::DOUBLE AS mrr,
  CASE WHEN n > 0 THEN ch / greatest(1, included) ELSE 0 END::DOUBLE AS context_precision, CASE WHEN n > 0 THEN ch / greatest(1, n) ELSE 0 END::DOUBLE AS context_recall,
  CASE WHEN n > 0 THEN included - ch ELSE 0 END::DOUBLE AS context_noise, included::BIGINT AS included_count, n::BIGINT AS relevant_count FROM sm)"""
METRIC_SQL = ",\n".join([FULL, SUMS, M23])


def inputs(spark, sf_dir):
    ranked = W.costed(spark, sf_dir, W.lexical_ranked(spark, sf_dir))
    return tables.queries(spark, sf_dir).select("q"), ranked, written(tables.relevance(spark, sf_dir), "relevance"), pack_budget(ranked, BUDGET)


def ranked_metrics(spark, sf_dir):
    qry, ranked, rel, ctx = inputs(spark, sf_dir)
    return M.ranked_metrics(qry, ranked, rel, ctx, W.TOP_K)


def rounded(df, *keys):
    doubles = {f.name for f in df.schema.fields if f.dataType.simpleString() == "double"}
    return df.select(*[F.round(c, 6).alias(c) if c in doubles else F.col(c) for c in df.columns])


def r6(*names: str) -> str:
    return ", ".join(f"round(({n.split(' AS ')[0]})::DOUBLE, 6) AS {n.split(' AS ')[-1]}" for n in names)


@query(
    "a23_ranked_metrics",
    S.with_(METRIC_SQL) + f"SELECT q, {r6('recall_at_k', 'mrr', 'context_precision', 'context_recall', 'context_noise')}, included_count, relevant_count FROM m23",
)
def a23(spark, sf_dir):
    return rounded(ranked_metrics(spark, sf_dir))


COVERAGE = """cov AS (SELECT id, id AS covered FROM mem WHERE last_outcome <> 'ignored' UNION SELECT id, id + 1 FROM mem WHERE id % 10 = 0 AND last_outcome <> 'ignored')"""


def coverage(spark, sf_dir):
    """Every card covers itself; each tenth also the next one; cards last ignored stand for blockers, which cover nothing."""
    mem = tables.memories(spark, sf_dir).where(F.col("last_outcome") != "ignored").select("id")
    own = F.array(F.col("id"), F.col("id") + 1)
    return mem.select("id", F.explode(F.when(F.col("id") % 10 == 0, own).otherwise(F.array("id"))).alias("covered"))


def hard(spark, sf_dir):
    return tables.memories(spark, sf_dir).where(F.col("last_outcome") == "ignored").select("id")


@query("p28_evidence_coverage", S.with_(S.MEM, COVERAGE) + "SELECT id, covered FROM cov")
def p28(spark, sf_dir):
    return coverage(spark, sf_dir)


A24 = ",\n".join(
    [
        FULL, COVERAGE,
        "rw AS (SELECT f.q, f.id, f.rank, f.in_context, (m.last_outcome = 'ignored')::INT AS hard FROM fl f JOIN mem m USING (id))",
        "met AS (SELECT DISTINCT r.q, r.id, r.rank, r.in_context, c.covered FROM rw r JOIN cov c USING (id) JOIN rel ON rel.q = r.q AND rel.id = c.covered)",
        "bi AS (SELECT q, sum((rank <= 8)::INT) AS hits, sum(in_context) AS ch, min(rank) AS fr FROM (SELECT q, covered, min(rank) AS rank, max(in_context) AS in_context FROM met GROUP BY ALL) GROUP BY q)",
        "bc AS (SELECT q, sum((rank <= 8)::INT) AS items, sum(in_context) AS ci FROM (SELECT DISTINCT q, id, rank, in_context FROM met) GROUP BY q)",
        "sz AS (SELECT q, count(*) AS c, sum((rank <= 8)::INT) AS top, sum(in_context) AS inc, sum((rank <= 8)::INT * hard) AS ht, sum(in_context * hard) AS hc FROM rw GROUP BY q)",
        """b AS (SELECT q.q, coalesce(c, 0) AS c, coalesce(top, 0) AS top, coalesce(inc, 0) AS inc, coalesce(ht, 0) AS ht, coalesce(hc, 0) AS hc, coalesce(hits, 0) AS hits, coalesce(ch, 0) AS ch, fr,
           coalesce(items, 0) AS items, coalesce(ci, 0) AS ci, coalesce(n, 0) AS n FROM qry q LEFT JOIN sz USING (q) LEFT JOIN bi USING (q) LEFT JOIN bc USING (q) LEFT JOIN rc USING (q))""",
    ]
)


@query(
    "a24_evidence_metrics",
    S.with_(A24)
    + "SELECT q, "
    + r6(
        "CASE WHEN n > 0 THEN hits / greatest(1, n) ELSE 0 END AS recall_at_k", "CASE WHEN n > 0 THEN items / greatest(1, least(8, c)) ELSE 0 END AS precision_at_k",
        "CASE WHEN n > 0 THEN coalesce(1.0 / fr, 0) ELSE 0 END AS mrr", "CASE WHEN n > 0 THEN ci / greatest(1, inc) ELSE 0 END AS context_precision",
        "CASE WHEN n > 0 THEN ch / greatest(1, n) ELSE 0 END AS context_recall", "CASE WHEN n > 0 THEN inc - ci ELSE inc END AS context_noise", "inc AS included_count",
        "ht / greatest(1, top) AS hard_negative_top_k_rate", "hc / greatest(1, inc) AS hard_negative_context_rate", "(n = 0)::INT AS abstention_query",
        "CASE WHEN n > 0 THEN 0 ELSE (inc > 0)::INT END AS false_memory_rate", "CASE WHEN n > 0 THEN 0 ELSE (inc = 0)::INT END AS no_relevant_context_rate",
    )
    + " FROM b",
)
def a24(spark, sf_dir):
    qry, ranked, rel, ctx = inputs(spark, sf_dir)
    return rounded(M.evidence_metrics(qry, ranked, rel, coverage(spark, sf_dir), ctx, hard(spark, sf_dir), W.TOP_K))


@query(
    "a25_evidence_pool_metrics",
    S.with_(
        FULL, COVERAGE,
        "st AS (SELECT DISTINCT l.q, c.covered, l.rank FROM lex l JOIN cov c USING (id))",
        """mk AS (SELECT r.q, r.id, max((s.covered IS NOT NULL)::INT) AS raw, max(coalesce((s.rank <= 16)::INT, 0)) AS pool, max(coalesce((s.rank <= 8)::INT, 0)) AS top
           FROM rel r LEFT JOIN st s ON s.q = r.q AND s.covered = r.id GROUP BY ALL)""",
        "ag AS (SELECT q, count(*) AS n, sum(raw) AS raw, sum(pool) AS pool, sum(top) AS top FROM mk GROUP BY q)",
        "b AS (SELECT q.q, coalesce(n, 0) AS n, coalesce(raw, 0) AS raw, coalesce(pool, 0) AS pool, coalesce(top, 0) AS top FROM qry q LEFT JOIN ag USING (q))",
    )
    + "SELECT q, " + r6("raw / greatest(1, n) AS raw_rate", "pool / greatest(1, n) AS pool_rate", "n - raw AS missing_from_raw", "greatest(0, raw - pool) AS lost_before_pool", "greatest(0, pool - top) AS ranked_out") + " FROM b",
)
def a25(spark, sf_dir):
    qry, ranked, rel, _ = inputs(spark, sf_dir)
    ids = ranked.select("q", "id", "rank")
    stages = {"raw": ids, "pool": ids.where(F.col("rank") <= 16), "top": ids.where(F.col("rank") <= W.TOP_K)}
    return rounded(M.pool_stage_metrics(qry, rel, coverage(spark, sf_dir), stages))


@query(
    "a26_multihop_metrics",
    S.with_(
        FULL,
        "rr AS (SELECT q, id, id % 2 AS hop FROM rel)",
        """ag AS (SELECT r.q, sum((hop = 0)::INT) AS b, sum((hop = 1)::INT) AS t, sum((hop = 0 AND f.rank <= 8)::INT) AS bt, sum((hop = 1 AND f.rank <= 8)::INT) AS tt,
           sum((hop = 0 AND f.in_context = 1)::INT) AS bc, sum((hop = 1 AND f.in_context = 1)::INT) AS tc FROM rr r LEFT JOIN fl f ON f.q = r.q AND f.id = r.id GROUP BY r.q)""",
        "ex AS (SELECT f.q, sum((m.last_outcome = 'ignored')::INT) AS stale, sum((m.last_outcome = 'corrected')::INT) AS wrong FROM fl f JOIN mem m USING (id) WHERE in_context = 1 GROUP BY f.q)",
        "b AS (SELECT q.q, coalesce(b, 0) AS b, coalesce(t, 0) AS t, coalesce(bt, 0) AS bt, coalesce(tt, 0) AS tt, coalesce(bc, 0) AS bc, coalesce(tc, 0) AS tc, coalesce(stale, 0) AS stale, coalesce(wrong, 0) AS wrong FROM qry q LEFT JOIN ag USING (q) LEFT JOIN ex USING (q))",
    )
    + "SELECT q, " + r6(
        "bt / greatest(1, b) AS bridge_recall_at_k", "tt / greatest(1, t) AS target_recall_at_k", "(bt > 0 AND tt > 0)::INT AS path_success_at_k", "bc / greatest(1, b) AS bridge_context_recall",
        "tc / greatest(1, t) AS target_context_recall", "(bc > 0 AND tc > 0)::INT AS path_context_success", "stale AS stale_exposure", "wrong AS wrong_context_exposure",
    ) + " FROM b",
)
def a26(spark, sf_dir):
    """Even relevant ids count as bridges, odd ones as targets; outcomes stand for the stale and wrong-context roles."""
    qry, ranked, rel, ctx = inputs(spark, sf_dir)
    rows = M.flagged(ranked.select("q", "id", "rank"), rel, ctx)
    roles = tables.memories(spark, sf_dir).select("id", "last_outcome")
    hop = rel.withColumn("hop", F.col("id") % 2).join(rows, ["q", "id"], "left")

    def count(condition):
        return F.sum(F.coalesce(condition, F.lit(False)).cast("int"))

    bridge, target, top, packed = F.col("hop") == 0, F.col("hop") == 1, F.col("rank") <= W.TOP_K, F.col("in_context") == 1
    sums = hop.groupBy("q").agg(
        count(bridge).alias("b"), count(target).alias("t"), count(bridge & top).alias("bt"), count(target & top).alias("tt"), count(bridge & packed).alias("bc"), count(target & packed).alias("tc")
    )
    exposed = rows.where(packed).join(roles, "id").groupBy("q").agg(
        count(F.col("last_outcome") == "ignored").alias("stale"), count(F.col("last_outcome") == "corrected").alias("wrong")
    )
    c = F.col
    out = qry.join(sums, "q", "left").join(exposed, "q", "left").fillna(0).select(
        "q", M.ratio(c("bt"), c("b")).alias("bridge_recall_at_k"), M.ratio(c("tt"), c("t")).alias("target_recall_at_k"),
        ((c("bt") > 0) & (c("tt") > 0)).cast("double").alias("path_success_at_k"), M.ratio(c("bc"), c("b")).alias("bridge_context_recall"),
        M.ratio(c("tc"), c("t")).alias("target_context_recall"), ((c("bc") > 0) & (c("tc") > 0)).cast("double").alias("path_context_success"),
        c("stale").cast("double").alias("stale_exposure"), c("wrong").cast("double").alias("wrong_context_exposure"),
    )
    return rounded(out)


WORDS = r"CASE WHEN trim(text, E' \t\n\x0B\f\r') = '' THEN 1 ELSE len(regexp_split_to_array(trim(text, E' \t\n\x0B\f\r'), '[ \t\n\x0B\f\r]+')) END"


@query(
    "a27_context_exposure",
    S.with_(
        W.LEX,
        f"wc AS (SELECT id, last_outcome, {WORDS} AS cost FROM mem)",
        "pk AS (SELECT * FROM (SELECT l.q, l.id, w.last_outcome, sum(w.cost) OVER (PARTITION BY l.q ORDER BY l.rank) AS used FROM lex l JOIN wc w USING (id)) WHERE used <= 2500)",
    )
    + "SELECT q.q, count(p.id)::BIGINT AS included, coalesce(count_if(last_outcome = 'ignored'), 0)::BIGINT AS decoys, coalesce(count_if(last_outcome = ''), 0)::BIGINT AS background FROM qry q LEFT JOIN pk p USING (q) GROUP BY q.q",
)
def a27(spark, sf_dir):
    mem = tables.memories(spark, sf_dir).select("id", "last_outcome", word_cost(F.col("text")).alias("cost"))
    packed = pack_budget(W.lexical_ranked(spark, sf_dir).join(mem, "id"), BUDGET)
    return tables.queries(spark, sf_dir).select("q").join(packed, "q", "left").groupBy("q").agg(
        F.count("id").alias("included"), F.count_if(F.col("last_outcome") == "ignored").alias("decoys"), F.count_if(F.col("last_outcome") == "").alias("background")
    )


CUTS = [("score", 10.0), ("score", 20.0), ("score", 30.0), ("rank", 4.0), ("rank", 16.0)]


@query(
    "a28_pool_threshold_metrics",
    S.with_(
        FULL,
        "cuts AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in CUTS) + ") t(kind, cut))",
        """ag AS (SELECT f.q, kind, cut, count(*) AS pulled, sum(is_relevant) AS hits, sum((m.last_outcome = 'ignored')::INT) AS wrong FROM fl f JOIN mem m USING (id) CROSS JOIN cuts
           WHERE (kind = 'score' AND round(score, 9) >= cut) OR (kind = 'rank' AND rank <= cut) GROUP BY ALL)""",
    )
    + "SELECT a.q, kind, cut, pulled::BIGINT AS pulled, round(hits / greatest(1, pulled), 6)::DOUBLE AS precision, round(hits / greatest(1, coalesce(n, 0)), 6)::DOUBLE AS recall, wrong::BIGINT AS wrong FROM ag a LEFT JOIN rc ON rc.q = a.q",
)
def a28(spark, sf_dir):
    _, ranked, rel, ctx = inputs(spark, sf_dir)
    rows = M.flagged(ranked, rel, ctx).join(tables.memories(spark, sf_dir).select("id", "last_outcome"), "id")
    cuts = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("cut")) for k, v in CUTS])
    swept = rows.select("q", "id", "rank", "score", "is_relevant", "last_outcome", F.inline(cuts))
    pulled = F.when(F.col("kind") == "score", F.round("score", 9) >= F.col("cut")).otherwise(F.col("rank") <= F.col("cut"))
    sums = swept.where(pulled).groupBy("q", "kind", "cut").agg(
        F.count(F.lit(1)).alias("pulled"), F.sum("is_relevant").alias("hits"), F.count_if(F.col("last_outcome") == "ignored").alias("wrong")
    )
    joined = sums.join(M.relevant_counts(rel), "q", "left").fillna(0, ["relevant_count"])
    return joined.select(
        "q", "kind", "cut", "pulled", F.round(M.ratio(F.col("hits"), F.col("pulled")), 6).alias("precision"), F.round(M.ratio(F.col("hits"), F.col("relevant_count")), 6).alias("recall"), "wrong"
    )


@query(
    "a29_candidate_pool_metrics",
    S.with_(
        W.POOL, "rc AS (SELECT q, count(*) AS n FROM rel GROUP BY q)",
        "ag AS (SELECT p.q, count(*) AS c, count(r.id) AS h FROM pool p LEFT JOIN rel r ON r.q = p.q AND r.id = p.id GROUP BY p.q)",
    )
    + "SELECT q.q, " + r6("coalesce(h, 0) / greatest(1, coalesce(n, 0)) AS candidate_recall", "coalesce(h, 0) / greatest(1, coalesce(c, 0)) AS candidate_precision")
    + ", coalesce(c, 0)::BIGINT AS candidates, coalesce(h, 0)::BIGINT AS hits FROM qry q LEFT JOIN ag USING (q) LEFT JOIN rc USING (q)",
)
def a29(spark, sf_dir):
    rel = written(tables.relevance(spark, sf_dir), "relevance")
    sums = W.pool(spark, sf_dir).join(rel.withColumn("hit", F.lit(1)), ["q", "id"], "left").groupBy("q").agg(F.count(F.lit(1)).alias("candidates"), F.count("hit").alias("hits"))
    base = tables.queries(spark, sf_dir).select("q").join(sums, "q", "left").join(M.relevant_counts(rel), "q", "left").fillna(0)
    return base.select(
        "q", F.round(M.ratio(F.col("hits"), F.col("relevant_count")), 6).alias("candidate_recall"), F.round(M.ratio(F.col("hits"), F.col("candidates")), 6).alias("candidate_precision"), "candidates", "hits"
    )


@query(
    "a30_session_metrics",
    S.with_(
        FULL, S.vector(W.FETCH),
        """ag AS (SELECT f.q, sum(is_relevant) AS ph, sum((rank <= 8)::INT * is_relevant) AS h8, sum((rank <= 16)::INT * is_relevant) AS h16, sum((rank <= 32)::INT * is_relevant) AS h32,
           sum((rank <= 8)::INT) AS top, sum(in_context) AS inc, sum(in_context * is_relevant) AS ch, sum(in_context * c.cost) AS tok FROM fl f JOIN cost c USING (id) GROUP BY f.q)""",
        "sv AS (SELECT v.q, count(*) AS v FROM vec v SEMI JOIN rel r ON r.q = v.q AND r.id = v.id GROUP BY v.q)",
        "st AS (SELECT v.q, count(*) AS t FROM lex v SEMI JOIN rel r ON r.q = v.q AND r.id = v.id GROUP BY v.q)",
        "b AS (SELECT q.q, coalesce(ph, 0) AS ph, coalesce(h8, 0) AS h8, coalesce(h16, 0) AS h16, coalesce(h32, 0) AS h32, coalesce(top, 0) AS top, coalesce(inc, 0) AS inc, coalesce(ch, 0) AS ch, coalesce(tok, 0) AS tok, coalesce(n, 0) AS n, coalesce(v, 0) AS v, coalesce(t, 0) AS t FROM qry q LEFT JOIN ag USING (q) LEFT JOIN rc USING (q) LEFT JOIN sv USING (q) LEFT JOIN st USING (q))",
    )
    + "SELECT q, " + r6(
        "ph / greatest(1, n) AS evidence_in_pool", "h8 / greatest(1, n) AS recall_at_8", "h16 / greatest(1, n) AS recall_at_16", "h32 / greatest(1, n) AS recall_at_32", "h8 / greatest(1, least(8, top)) AS precision_at_k",
        "ch / greatest(1, n) AS context_recall", "ch / greatest(1, inc) AS context_precision", "tok AS context_token_count", "inc AS included_count", "(ch = 0)::INT AS no_relevant_context_rate", "(h8 > 0)::INT AS hit_any_relevant",
        "(h8 = n)::INT AS all_relevant_found", "t / greatest(1, n) AS evidence_in_token", "v / greatest(1, n) AS evidence_in_vector",
    ) + " FROM b",
)
def a30(spark, sf_dir):
    qry, ranked, rel, ctx = inputs(spark, sf_dir)
    sources = ranked.select("q", "id", F.lit("token").alias("source")).unionByName(W.vector_ranked(spark, sf_dir).select("q", "id", F.lit("vector").alias("source")))
    return rounded(M.session_metrics(qry, ranked, rel, ctx, sources, W.TOP_K))


@query(
    "a31_growth_retention",
    S.with_(
        W.POOL,
        "bo AS (SELECT q, id, l.rank AS b, v.rank AS a, (r.id IS NOT NULL) AS rl FROM lex l FULL JOIN vec v USING (q, id) LEFT JOIN rel r USING (q, id))",
        """ag AS (SELECT q, count_if(b IS NOT NULL AND rl) AS r, count_if(b IS NOT NULL AND rl AND a IS NOT NULL) AS rk, count_if(b <= 16) AS t, count_if(b <= 16 AND a IS NOT NULL) AS tk,
           count_if(b <= 16 AND a <> b) AS mv, count_if(b IS NOT NULL AND a IS NULL) AS dr, count_if(a IS NOT NULL AND b IS NULL) AS ad FROM bo GROUP BY q)""",
    )
    + "SELECT q, " + r6("CASE WHEN r = 0 THEN 1 ELSE rk / r END AS relevant_retention", "CASE WHEN t = 0 THEN 1 ELSE tk / t END AS top_retention", "mv / greatest(1, tk) AS position_change_rate", "dr AS dropped", "ad AS added") + " FROM ag",
)
def a31(spark, sf_dir):
    qry = tables.queries(spark, sf_dir).select("q")
    return rounded(M.growth_retention(qry, W.lexical_ranked(spark, sf_dir), W.vector_ranked(spark, sf_dir), tables.relevance(spark, sf_dir), 16))


@query(
    "a32_frame_metrics",
    S.with_(FULL, "ag AS (SELECT q, sum(is_relevant) AS l, count_if(is_relevant = 1 AND rank <= 8) AS h, count_if(rank <= 8) AS a FROM fl WHERE rank <= 16 GROUP BY q)")
    + "SELECT q.q, " + r6("coalesce(l, 0) / greatest(1, coalesce(n, 0)) AS frame_recall", "coalesce(h, 0) / greatest(1, coalesce(a, 0)) AS frame_precision_at_k") + " FROM qry q LEFT JOIN ag USING (q) LEFT JOIN rc USING (q)",
)
def a32(spark, sf_dir):
    from memjoin.operators.features import frame_metrics, padded_frame

    qry, ranked, rel, _ = inputs(spark, sf_dir)
    rows = M.flagged(ranked, rel, ranked.limit(0)).withColumn("label", F.col("is_relevant").cast("double"))
    frames = padded_frame(qry, rows, 16, {"label": 0.0})
    return rounded(frame_metrics(frames.join(M.relevant_counts(rel), "q", "left").fillna(0, ["relevant_count"]), W.TOP_K))


@query(
    "a33_learned_ranking_metrics",
    S.with_(
        FULL,
        "ag AS (SELECT q, sum((rank <= 8)::INT * is_relevant) AS h, min(rank) AS k, count_if(rank <= 8) AS top, min(CASE WHEN is_relevant = 1 THEN rank END) AS fr, avg(((round(score, 9) >= 20.0) = (is_relevant = 1))::INT) AS acc FROM fl GROUP BY q)",
        "p AS (SELECT q, h / greatest(1, n) AS recall, h / greatest(1, top) AS precision, coalesce(1.0 / fr, 0) AS mrr, coalesce((fr <= 1)::INT, 0) AS top1, coalesce((fr <= 3)::INT, 0) AS top3, acc FROM ag JOIN rc USING (q))",
    )
    + "SELECT count(*)::BIGINT AS cases, " + r6("avg(recall) AS recall", "avg(precision) AS precision", "avg(2.0 * precision * recall / greatest(1e-6, precision + recall)) AS f1", "avg(mrr) AS mrr", "avg(top1) AS top1", "avg(top3) AS top3", "avg(acc) AS accuracy") + " FROM p",
)
def a33(spark, sf_dir):
    from memjoin.operators.features import learned_metrics

    _, ranked, rel, _ = inputs(spark, sf_dir)
    rows = M.flagged(ranked, rel, ranked.limit(0))
    return rounded(learned_metrics(rows, M.relevant_counts(rel), W.TOP_K, 20.0))


@query(
    "a22_determinism_check",
    S.with_(W.LEX) + "SELECT q, md5(string_agg(id || ':' || printf('%.6f', round(score, 6)), ' ' ORDER BY rank)) AS signature, false AS differs FROM lex GROUP BY q",
)
def a22(spark, sf_dir):
    """The ranking computed twice, the second time from shuffled input in other partitions."""
    from memjoin.operators.lexical import idf_token_scores

    mem, qry = tables.card_texts(spark, sf_dir), tables.queries(spark, sf_dir).select("q", "text")
    one = M.signature(idf_token_scores(mem, qry, None, W.FETCH), 6)
    shuffled = mem.repartition(13, F.xxhash64("id", F.lit(7)))
    two = M.signature(idf_token_scores(shuffled, qry.repartition(5), None, W.FETCH), 6)
    return one.join(two.withColumnRenamed("signature", "again"), "q").select("q", "signature", (F.col("signature") != F.col("again")).alias("differs"))


@query(
    "a35_metric_flattening",
    S.with_(METRIC_SQL, S.vector(W.FETCH), "vs AS (SELECT v.q, min(v.rank) AS fr FROM vec v SEMI JOIN rel r ON r.q = v.q AND r.id = v.id GROUP BY v.q)")
    + "SELECT m.q, " + r6("recall_at_k AS lexical_recall_at_k", "mrr AS lexical_mrr", "coalesce(1.0 / fr, 0) AS vector_mrr") + " FROM m23 m LEFT JOIN vs USING (q)",
)
def a35(spark, sf_dir):
    """Metric groups of two systems prefixed and joined to one wide row per query."""
    qry, ranked, rel, ctx = inputs(spark, sf_dir)
    lexical = M.ranked_metrics(qry, ranked, rel, ctx, W.TOP_K).select("q", "recall_at_k", "mrr")
    vector = W.costed(spark, sf_dir, W.vector_ranked(spark, sf_dir))
    other = M.ranked_metrics(qry, vector, rel, pack_budget(vector, BUDGET), W.TOP_K).select("q", "mrr")

    def prefixed(df, prefix):
        return df.select("q", *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != "q"])

    return rounded(prefixed(lexical, "lexical").join(prefixed(other, "vector"), "q"))

"""Feedback, state and policy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from memjoin.operators import feedback as B
from memjoin.operators.merge import biased_rerank
from memjoin.operators.ranking import pack_budget, ranked
from memjoin.plans import features as FE
from memjoin.plans import metrics as Q
from memjoin.plans import records_sql as RQ
from memjoin.plans import fields as FP
from memjoin.plans import sqltext as S
from memjoin.plans import workload as W
from memjoin.plans.graphs import shape
from memjoin.plans.ingest import scratch
from memjoin.plans.metrics import r6, rounded
from memjoin.plans.registry import query
from memjoin.sources import records, tables


def fold_sql(step: dict[str, float], bound: float) -> str:
    """Event-by-event clamped fold over the ordered outcomes `outs` of a memory."""
    part = f"CASE o WHEN 'helpful' THEN {step['helpful']}::DOUBLE WHEN 'corrected' THEN {step['corrected']}::DOUBLE ELSE {step['ignored']}::DOUBLE END"
    return f"list_reduce(list_prepend(0.0::DOUBLE, list_transform(outs, lambda o: {part})), lambda a, b: greatest(-{bound}::DOUBLE, least({bound}::DOUBLE, a + b)))"


STATE = f"""gp AS (SELECT memory_id, list(outcome ORDER BY seq) AS outs, arg_max(outcome, seq) AS last_outcome, bool_or(protected) AS protected FROM fb GROUP BY memory_id),
ste AS (SELECT memory_id, len(list_filter(outs, lambda o: o <> 'ignored'))::BIGINT AS use_count_delta, (len(list_filter(outs, lambda o: o = 'helpful')) + 2 * len(list_filter(outs, lambda o: o = 'corrected')))::BIGINT AS evidence_count_delta,
  {fold_sql(B.IMPORTANCE_STEP, B.IMPORTANCE_BOUND)} AS importance_delta, {fold_sql(B.BIAS_STEP, B.BIAS_BOUND)} AS score_bias, last_outcome, protected,
  len(list_filter(outs, lambda o: o = 'helpful'))::BIGINT AS n_helpful, len(list_filter(outs, lambda o: o = 'corrected'))::BIGINT AS n_corrected, len(list_filter(outs, lambda o: o = 'ignored'))::BIGINT AS n_ignored FROM gp)"""
SHOW_STATE = "SELECT memory_id, use_count_delta, evidence_count_delta, round(importance_delta, 6) AS importance_delta, round(score_bias, 6) AS score_bias, last_outcome, protected, n_helpful, n_corrected, n_ignored FROM ste"


@query("t2_memory_state_fold", S.with_(S.FEEDBACK, STATE) + SHOW_STATE)
def t2(spark, sf_dir):
    return rounded(B.memory_state(tables.feedback_events(spark, sf_dir)))


@query("x5_ordered_fold", S.with_(S.FEEDBACK, STATE) + "SELECT memory_id, round(importance_delta, 6) AS importance_delta FROM ste")
def x5(spark, sf_dir):
    """The same fold through slices of 16 sequence numbers: many levels, one answer."""
    return rounded(B.memory_state(tables.feedback_events(spark, sf_dir), slices=16).select("memory_id", "importance_delta"))


@query("a34_feedback_counts", S.with_(S.FEEDBACK) + "SELECT outcome, count(*) AS n, count(DISTINCT memory_id) AS memories FROM fb GROUP BY outcome")
def a34(spark, sf_dir):
    rows = tables.feedback_events(spark, sf_dir).groupBy("outcome", "memory_id").agg(F.count(F.lit(1)).alias("c"))
    return rows.groupBy("outcome").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("memories"))


LABELS = "fl1 AS (SELECT coalesce(c.q, r.q) AS q, coalesce(c.id, r.id) AS id, CASE WHEN c.id IS NULL THEN 'corrected' WHEN r.id IS NULL THEN 'ignored' ELSE 'helpful' END AS outcome FROM ctx c FULL JOIN rel r ON r.q = c.q AND r.id = c.id)"


@query("t1_feedback_labelling", S.with_(W.LEX, W.COST, W.pack_sql(budget=Q.BUDGET), LABELS) + "SELECT q, id, outcome FROM fl1")
def t1(spark, sf_dir):
    _, _, rel, ctx = Q.inputs(spark, sf_dir)
    return B.feedback_labels(ctx, rel)


# Signatures of consecutive turns as the stream of signature feedback, in turn order.
SIG = FE.NINE + f""",
sg AS (SELECT qq.id, row_number() OVER (ORDER BY qq.q, c.pos) - 1 AS seq, CASE WHEN a_cluster = c_cluster THEN 'same_project' ELSE 'cross_project' END || '|' || CASE WHEN len(a_terms) = 0 OR len(c_terms) = 0 THEN 'preference_unknown' ELSE 'other' END
  || '|' || CASE WHEN c_age_days >= 180 AND c_use_count <= 0 AND NOT c_protected THEN 'stale' ELSE 'fresh_or_used' END || '|' || CASE WHEN lexical >= 0.65 THEN 'duplicate_like' ELSE 'distinct' END AS signature,
  CASE c_last_outcome WHEN '' THEN 'ignored' ELSE c_last_outcome END AS outcome FROM qq JOIN cards c ON c.id = qq.id),
so AS (SELECT signature, list(outcome ORDER BY seq) AS outs, count(*) AS n FROM sg GROUP BY signature),
sb AS (SELECT signature, n, {fold_sql(B.SIGNATURE_STEP, B.SIGNATURE_BOUND)} AS bias FROM so)"""


def signature_events(spark, sf_dir):
    from memjoin.operators.features import neighbour_pairs, relationship_signature
    from memjoin.session import cut_lineage
    from memjoin.sources.jsonl import numbered

    rows = neighbour_pairs(records.cards(spark, sf_dir)).select(
        "q", "id", "c_pos", relationship_signature().alias("signature"), F.when(F.col("c_last_outcome") == "", "ignored").otherwise(F.col("c_last_outcome")).alias("outcome")
    )
    return numbered(cut_lineage(rows.orderBy("q", "c_pos"))).withColumnRenamed("pos", "seq")


@query("t3_signature_state_fold", S.with_(SIG) + "SELECT signature, round(bias, 6) AS bias, n FROM sb")
def t3(spark, sf_dir):
    return rounded(B.signature_state(signature_events(spark, sf_dir)))


@query(
    "j45_state_join",
    S.with_(S.MEM, S.FEEDBACK, STATE)
    + """SELECT m.id, m.use_count + coalesce(use_count_delta, 0) AS use_count, m.evidence_count + coalesce(evidence_count_delta, 0) AS evidence_count,
      round(CASE WHEN s.memory_id IS NULL THEN m.importance ELSE greatest(0.05, least(0.95, CASE WHEN m.importance = 0 THEN 0.5 ELSE m.importance END + importance_delta)) END, 6)::DOUBLE AS importance,
      coalesce(nullif(s.last_outcome, ''), m.last_outcome) AS last_outcome, m.protected OR coalesce(s.protected, false) AS protected FROM mem m LEFT JOIN ste s ON s.memory_id = m.id""",
)
def j45(spark, sf_dir):
    out = B.apply_state(tables.memories(spark, sf_dir), B.memory_state(tables.feedback_events(spark, sf_dir)))
    return rounded(out.select("id", "use_count", "evidence_count", "importance", "last_outcome", "protected"))


@query(
    "j46_bias_rerank",
    S.with_(
        SIG, "sp AS (SELECT q, id, " + RQ.SPARSE + " AS score FROM pairs)",
        "mb AS (SELECT id, ((pos * 7) % 13 - 6) / 20.0::DOUBLE AS bias FROM cards)",
        "j AS (SELECT s.q, s.id, s.score + 0.5::DOUBLE * (mb.bias + sb.bias) AS score FROM sp s JOIN sg USING (id) JOIN mb USING (id) JOIN sb USING (signature))",
    )
    + f"SELECT q, id, round(score, 6) AS score, rank FROM ({S.ranked('j')})",
)
def j46(spark, sf_dir):
    """Sparse scores of the turns with a signature, moved by a memory bias and the folded signature bias."""
    from memjoin.operators.basins import sparse_ranked

    events = signature_events(spark, sf_dir)
    scored = sparse_ranked(records.pairs(spark, sf_dir)).join(events.select("id", "signature"), "id")
    memory = records.cards(spark, sf_dir).select("id", (((F.col("pos") * 7) % 13 - 6) / 20.0).alias("bias"))
    return shape(biased_rerank(scored, memory, B.signature_state(events), 0.5))


@query("j47_oracle_scores", S.with_(W.POOL) + "SELECT p.q, p.id, (r.id IS NOT NULL)::INT::DOUBLE AS score FROM pool p LEFT JOIN rel r ON r.q = p.q AND r.id = p.id")
def j47(spark, sf_dir):
    return B.oracle_scores(W.pool(spark, sf_dir), tables.relevance(spark, sf_dir))


CONF = """cn AS (SELECT q, count(*) AS n, max(CASE WHEN rank = 1 THEN score END) AS top, max(CASE WHEN rank = 2 THEN score END) AS second, min(score) AS low FROM sp GROUP BY q),
ct AS (SELECT c.*, (SELECT max(score) FROM sp s WHERE s.q = c.q AND s.rank = least(3, c.n)) AS cut, (SELECT max(score) FROM sp s WHERE s.q = c.q AND s.rank = least(3, c.n) + 1) AS after FROM cn c),
cf AS (SELECT t.q, any_value(top) AS top_score, any_value(CASE WHEN n > 1 THEN top - second ELSE abs(top) END) AS top_margin, any_value(cut - coalesce(after, low)) AS cutoff_margin, any_value(top - low) AS score_spread,
  count_if(round(abs(s.score - cut), 9) <= 0.03)::DOUBLE AS cutoff_crowding FROM ct t JOIN sp s ON s.q = t.q GROUP BY t.q)"""
SP = f"sp AS ({S.ranked(f'(SELECT q, id, {RQ.SPARSE} AS score FROM pairs)')})"


def record_ranked(spark, sf_dir):
    from memjoin.operators.basins import sparse_ranked

    return sparse_ranked(records.pairs(spark, sf_dir))


@query("v17_confidence_features", S.with_(RQ.PAIRS, SP, CONF) + "SELECT q, " + r6("top_score", "top_margin", "cutoff_margin", "score_spread", "cutoff_crowding") + " FROM cf")
def v17(spark, sf_dir):
    return rounded(B.confidence_features(record_ranked(spark, sf_dir), 3))


# Marker phrases are added to some cards and questions, because the supplied texts are invented words.
RISK = """tx AS (SELECT p.*, CASE pos % 4 WHEN 0 THEN 'Current preference: ' WHEN 1 THEN 'No longer true. ' ELSE '' END || text AS marked FROM pairs p),
pk AS (SELECT * FROM (SELECT s.q, s.id, t.marked, t.same_cluster, t.use_count, t.evidence_count, t.last_outcome, t.age_days, sum(t.cost) OVER (PARTITION BY s.q ORDER BY s.rank) AS used FROM sp s JOIN tx t USING (q, id)) WHERE used <= 200),
ag AS (SELECT q, count(*) AS inc, sum(cur::INT) AS cur, sum(stale::INT) AS stale, sum((same AND NOT cur AND age_days >= 90 AND (use_count >= 21 OR evidence_count >= 8 OR last_outcome = 'helpful'))::INT) AS old, sum((NOT same)::INT) AS crs FROM
  (SELECT *, same_cluster = 1 AS same, same_cluster = 1 AND (""" + " OR ".join(f"contains(lower(marked), '{m}')" for m in B.CURRENT_MARKERS) + ") AS cur, " + " OR ".join(f"contains(lower(marked), '{m}')" for m in B.STALE_MARKERS) + """ AS stale FROM pk) GROUP BY q),
rk AS (SELECT t.q, coalesce(inc, 0)::DOUBLE AS included_count, coalesce(cur, 0)::DOUBLE AS current_count, coalesce(stale, 0)::DOUBLE AS stale_count, coalesce(old, 0)::DOUBLE AS positive_old_count, coalesce(crs, 0)::DOUBLE AS cross_count,
  (coalesce(stale, 0) + coalesce(old, 0))::DOUBLE AS stale_pressure, coalesce(cur, 0) / greatest(1, coalesce(inc, 0))::DOUBLE AS current_rate, (t.q % 3 = 0)::INT::DOUBLE AS preference_change FROM task t LEFT JOIN ag a USING (q))"""


def risk(spark, sf_dir):
    pairs = records.pairs(spark, sf_dir)
    prefix = F.when(F.col("pos") % 4 == 0, "Current preference: ").when(F.col("pos") % 4 == 1, "No longer true. ").otherwise("")
    marked = pairs.select(
        "q", "id", F.concat(prefix, "text").alias("text"), (F.col("same_cluster") == 1).alias("same_context"), (F.col("same_cluster") == 0).alias("other_context"), "use_count", "evidence_count", "last_outcome",
        "age_days", "cost",
    )
    packed = pack_budget(record_ranked(spark, sf_dir).join(marked, ["q", "id"]), 200)
    asked = records.tasks(spark, sf_dir).select("q", F.when(F.col("q") % 3 == 0, F.concat(F.lit("The preference changed. "), "query")).otherwise(F.col("query")).alias("asked"))
    return B.state_risk(asked, packed)


_risk = ["included_count", "current_count", "stale_count", "positive_old_count", "cross_count", "stale_pressure", "current_rate", "preference_change"]


@query("v18_state_risk_features", S.with_(RQ.PAIRS, SP, RISK) + "SELECT q, " + r6(*_risk) + " FROM rk")
def v18(spark, sf_dir):
    return rounded(risk(spark, sf_dir))


_unc, _weak = "(round(cutoff_margin, 9) <= 0.05 OR cutoff_crowding >= 4)", "(round(top_score, 9) <= 0.6 OR round(score_spread, 9) <= 0.2)"


@query(
    "t4_evolution_policy",
    S.with_(RQ.PAIRS, SP, CONF, RISK)
    + f"""SELECT c.q, false AS off, true AS always, {_unc} AS uncertainty_gated, {_weak} AS low_confidence_only,
      CASE WHEN preference_change <= 0 THEN {_unc} OR {_weak} ELSE NOT (current_count >= 2 OR current_rate >= 0.25) AND ({_weak} OR (round(cutoff_margin, 9) <= 0.05 AND cutoff_crowding >= 6 AND round(top_score, 9) <= 0.68)) END AS risk_aware,
      CASE WHEN preference_change <= 0 THEN {_unc} OR {_weak} ELSE (current_count < 3 OR current_rate < 0.55) AND (round(top_score, 9) <= 0.75 OR round(score_spread, 9) <= 0.4 OR (round(cutoff_margin, 9) <= 0.05 AND cutoff_crowding >= 6)
        OR (stale_pressure >= 4 AND positive_old_count >= 2 AND round(top_score, 9) <= 0.75)) END AS risk_rescue FROM cf c JOIN rk r USING (q)""",
)
def t4(spark, sf_dir):
    rows = B.confidence_features(record_ranked(spark, sf_dir), 3).join(risk(spark, sf_dir), "q")
    names = ["off", "always", "uncertainty_gated", "low_confidence_only", "risk_aware", "risk_rescue"]
    return rows.select("q", *[B.policy_allows(n, 0.05, 0.6, 0.2).alias(n) for n in names])


@query("t2_memory_state_stream", S.with_(S.FEEDBACK, STATE) + SHOW_STATE)
def t2_stream(spark, sf_dir):
    """The event table as a file stream in four segments, folded into keyed state on disk; the state then equals the batch fold."""
    from memjoin.streaming import folds

    source, progress = scratch(spark, "events"), scratch(spark, "progress")
    events = tables.feedback_events(spark, sf_dir)
    in_segments(spark, events, source, lambda stream: folds.fold_stream(stream, progress))
    return rounded(folds.state_table(spark, progress))


def in_segments(spark, events, source, fold, count: int = 4):
    """Append the events to a log in sequence order, segment by segment, and run the stream after each."""
    size = (events.agg(F.max("seq")).first()[0] or 0) // count + 1
    for part in range(count):
        events.where(F.floor(F.col("seq") / size) == part).write.mode("append").parquet(source)
        fold(spark.readStream.schema(events.schema).parquet(source)).awaitTermination()


@query("t3_signature_state_stream", S.with_(SIG) + "SELECT signature, round(bias, 6) AS bias, n FROM sb")
def t3_stream(spark, sf_dir):
    """The signature feedback of consecutive turns as a stream into keyed state on disk."""
    from memjoin.session import cut_lineage
    from memjoin.streaming import folds

    source, progress = scratch(spark, "events"), scratch(spark, "progress")
    events = cut_lineage(signature_events(spark, sf_dir).select("signature", "seq", "outcome", F.lit(False).alias("protected")))
    in_segments(spark, events, source, lambda stream: folds.fold_stream(stream, progress, folds.SIGNATURE))
    held = folds.state_table(spark, progress, folds.SIGNATURE)
    return rounded(held.select("signature", F.col("score_bias").alias("bias"), F.expr("n_helpful + n_corrected + n_ignored").alias("n")))


STREAMED = """best AS (SELECT item, field, value, max(confidence) AS confidence FROM pred GROUP BY ALL),
reg AS (SELECT coalesce(s.name, c.field) AS name, CASE WHEN s.name IS NULL THEN 'proposed' ELSE 'promoted' END AS status, coalesce(c.n, 0) AS seen_count,
  round(coalesce(c.c, 0.0), 6) AS confidence_sum, coalesce(c.d, 0) AS distinct_count FROM seed s FULL JOIN
  (SELECT field, count(*) AS n, sum(confidence) AS c, count(DISTINCT value) AS d FROM best GROUP BY field) c ON c.field = s.name)"""


@query("t7_streaming_field_extraction", S.with_(FP.ITEMS, FP.PRED, FP.SEED, STREAMED) + "SELECT name, status, seen_count, confidence_sum, distinct_count FROM reg")
def t7(spark, sf_dir):
    """Labelled document texts as a file stream in three batches of a file for each core; the counters after the last one are
    those of all texts."""
    from memjoin.operators import fields as P
    from memjoin.plans.fields import labelled_texts
    from memjoin.streaming.feedback import VALUES_DDL, VersionedTable, extraction_stream

    source = scratch(spark, "texts")
    files = spark.sparkContext.defaultParallelism
    labelled_texts(spark, sf_dir).repartition(3 * files).write.parquet(source)
    stream = spark.readStream.schema("item bigint, text string").option("maxFilesPerTrigger", files).parquet(source)
    seed = P.seed_registry(spark)
    registry = VersionedTable(spark, scratch(spark, "registry"), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in seed.schema.fields))
    values = VersionedTable(spark, scratch(spark, "values"), VALUES_DDL)
    extraction_stream(stream, registry, values, seed, scratch(spark, "predictions"), scratch(spark, "progress")).awaitTermination()
    return registry.read().select("name", "status", "seen_count", F.round("confidence_sum", 6).alias("confidence_sum"), "distinct_count")

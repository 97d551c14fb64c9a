"""Online evaluation and evolved rows (T5, T6): queries in order, state between batches, against an unrolled SQL fold."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memjoin.functions.state import card_state, falsy_default, state_score
from memjoin.functions.text import jaccard, token_cost
from memjoin.operators import feedback as B
from memjoin.operators.features import DUPLICATE_LIMIT, preference_relation, preference_terms
from memjoin.plans import features as FE
from memjoin.plans import records_sql as RQ
from memjoin.plans import sqltext as S
from memjoin.plans import workload as W
from memjoin.plans.ingest import scratch
from memjoin.plans.registry import query
from memjoin.session import written
from memjoin.sources import tables
from memjoin.streaming import online as O

GATED = O.Policy("uncertainty_gated", bias_scale=0.35, gate_margin=0.002, top_k=3)
PARTS = 4
PASSES, PRIME, STEP, OFFSET = 2, 2_147_483_647, 7919, 104_729


def scorer():
    """Share of the lexical peak, context, importance and usage state: the part that evolves."""
    return 0.45 * F.col("lexical_share") + 0.13 * F.col("same_context").cast("double") + 0.09 * falsy_default(F.col("importance"), 0.5) + state_score(card_state())


def oracle():
    return F.col("relevant").cast("double")


def pairs(spark, sf_dir, rel):
    """One row per query and candidate: the lexical top of a benchmark passage with card state and static pair features.

    The ranking is written first, so that only texts it names are joined. `rel`: the relevant pairs (q, id).
    """
    ranked = written(W.lexical_ranked(spark, sf_dir), "ranked")
    lex = ranked.select("q", "id", (F.col("score") / F.max("score").over(Window.partitionBy("q"))).alias("lexical_share"))
    asked = tables.queries(spark, sf_dir).select("q", F.col("text").alias("asked_text"), "project_id")
    rel = rel.distinct().withColumn("relevant", F.lit(True))
    both = lex.join(tables.memories(spark, sf_dir, ranked), "id").join(asked, "q").join(rel, ["q", "id"], "left")
    same = F.col("cluster") == F.col("project_id")
    marked = F.concat(F.when(F.col("id") % 4 == 0, "Current preference: ").when(F.col("id") % 4 == 1, "No longer true. ").otherwise(""), F.col("text"))
    return both.select(
        "q", "id", "lexical_share", marked.alias("text"), token_cost(F.col("text")).alias("cost"), F.col("last_outcome").alias("role"), same.alias("same_context"), (~same).alias("other_context"),
        F.when(same, "same_project").otherwise("cross_project").alias("context"), preference_relation(preference_terms(F.col("asked_text")), preference_terms(F.col("text"))).alias("relation"),
        F.when(jaccard(F.col("asked_text"), F.col("text")) >= DUPLICATE_LIMIT, "duplicate_like").otherwise("distinct").alias("duplicate"), F.coalesce("relevant", F.lit(False)).alias("relevant"), *O.CARD,
    )


def rows_in_order(spark, sf_dir):
    """(q, asked, source_index): the rows of the loop; every third asks about a change."""
    from memjoin.session import cut_lineage
    from memjoin.sources.jsonl import numbered

    qry = tables.queries(spark, sf_dir).select("q", "text")
    asked = F.when(F.col("q") % 3 == 0, F.concat(F.lit("The preference changed. "), "text")).otherwise(F.col("text"))
    return numbered(cut_lineage(qry.select("q", asked.alias("asked")).orderBy("q"))).withColumnRenamed("pos", "source_index")


PAIRS = f"""pr AS (SELECT l.q, l.id, l.score / max(l.score) OVER (PARTITION BY l.q) AS lexn, CASE l.id % 4 WHEN 0 THEN 'Current preference: ' WHEN 1 THEN 'No longer true. ' ELSE '' END || m.text AS marked, c.cost,
  m.last_outcome AS role, m.project = y.project_id AS same, CASE WHEN len({FE.terms('y.text')}) = 0 OR len({FE.terms('m.text')}) = 0 THEN 'preference_unknown' ELSE 'known' END AS relation,
  CASE WHEN {S.jac(S.tset('y.text'), S.tset('m.text'))} >= 0.65 THEN 'duplicate_like' ELSE 'distinct' END AS duplicate, r.id IS NOT NULL AS relevant,
  m.importance, m.age_days, m.use_count, m.evidence_count, m.last_outcome, m.protected
  FROM lex l JOIN mem m USING (id) JOIN cost c USING (id) JOIN qry y ON y.q = l.q LEFT JOIN (SELECT DISTINCT q, id FROM rel) r ON r.q = l.q AND r.id = l.id),
src AS (SELECT q, row_number() OVER (ORDER BY q) - 1 AS source_index FROM qry)"""
SCORE = f"(0.45::DOUBLE * lexn + 0.13::DOUBLE * same::INT::DOUBLE + 0.09::DOUBLE * (CASE WHEN importance = 0 THEN 0.5::DOUBLE ELSE importance END) + {RQ.state_score()})"
ORACLE = "relevant::INT::DOUBLE"


def ranks(name: str, source: str, score: str, budget: int) -> str:
    """CTE with rank, running cost and whether the row fits the budget."""
    return f"{name} AS (SELECT *, sum(cost) OVER (PARTITION BY q ORDER BY rank) <= {budget} AS inside FROM ({S.ranked(source, score=score)}))"


def confidence(name: str, source: str, k: int) -> str:
    return f"""{name} AS (SELECT q, top_score, CASE WHEN n > 1 THEN top_score - second ELSE abs(top_score) END AS top_margin, cut - coalesce(after, low) AS cutoff_margin, top_score - low AS score_spread,
  (SELECT count(*) FROM {source} s WHERE s.q = m.q AND round(abs(s.score - m.cut), 9) <= 0.03)::DOUBLE AS cutoff_crowding FROM (SELECT q, count(*) AS n, max(score) AS top_score, min(score) AS low,
  max(CASE WHEN rank = 2 THEN score END) AS second, max(CASE WHEN rank = k THEN score END) AS cut, max(CASE WHEN rank = k + 1 THEN score END) AS after
  FROM (SELECT *, least({k}, count(*) OVER (PARTITION BY q)) AS k FROM {source}) GROUP BY q) m)"""


def clamped(start: str, step: dict[str, float], bound: float) -> str:
    """Event-by-event fold of the ordered outcomes `outs` from a stored value."""
    part = f"CASE o WHEN 'helpful' THEN {step['helpful']}::DOUBLE WHEN 'corrected' THEN {step['corrected']}::DOUBLE ELSE {step['ignored']}::DOUBLE END"
    return f"list_reduce(list_prepend({start}, list_transform(outs, lambda o: {part})), lambda a, b: greatest(-{bound}::DOUBLE, least({bound}::DOUBLE, a + b)))"


def loop_sql(batches: list[str], score: str, policy: O.Policy, gated: str) -> str:
    """CTEs of the loop: `gt` (q, gated), and for each batch b `ev{b}` (ranked rows), `fb{b}` (events), `me{b + 1}` and `sg{b + 1}` (states).

    `batches` are SQL texts giving (q, turn) of each batch; `gated` decides a row of `cf` (baseline confidence).
    """
    out = [
        f"b0 AS (SELECT *, {score} AS score FROM pr)", ranks("br", "b0", "score", policy.budget), confidence("cf", "br", policy.top_k),
        f"gt AS (SELECT y.q, coalesce({gated}, false) AS gated FROM qry y LEFT JOIN cf USING (q))",
        """me0 AS (SELECT 0::BIGINT AS memory_id, 0::BIGINT AS u, 0::BIGINT AS e, 0.0::DOUBLE AS imp, 0.0::DOUBLE AS bias, '' AS last, false AS prot WHERE false)""",
        "sg0 AS (SELECT '' AS signature, 0.0::DOUBLE AS bias, 0::BIGINT AS n WHERE false)",
    ]
    for b, queries in enumerate(batches):
        out += [
            f"qu{b} AS ({queries})",
            f"""ca{b} AS (SELECT p.* EXCLUDE (importance, use_count, evidence_count, last_outcome, protected), t.turn, g.gated, coalesce(s.bias, 0.0) AS memory_bias, p.importance AS importance_was, p.use_count AS use_was,
  p.evidence_count AS evidence_was, p.last_outcome AS outcome_was, CASE WHEN s.memory_id IS NULL THEN p.importance ELSE greatest(0.05::DOUBLE, least(0.95::DOUBLE, CASE WHEN p.importance = 0 THEN 0.5::DOUBLE ELSE p.importance END + s.imp)) END AS importance,
  p.use_count + coalesce(s.u, 0) AS use_count, p.evidence_count + coalesce(s.e, 0) AS evidence_count, coalesce(nullif(s.last, ''), p.last_outcome) AS last_outcome, p.protected OR coalesce(s.prot, false) AS protected
  FROM pr p JOIN qu{b} t USING (q) JOIN gt g USING (q) LEFT JOIN me{b} s ON g.gated AND s.memory_id = p.id)""",
            f"""cb{b} AS (SELECT c.*, {score} AS base, CASE WHEN same THEN 'same_project' ELSE 'cross_project' END || '|' || relation || '|' || CASE WHEN age_days >= 180 AND use_count <= 0 AND NOT protected THEN 'stale' ELSE 'fresh_or_used' END
  || '|' || duplicate AS signature FROM ca{b} c)""",
            f"cc{b} AS (SELECT c.*, base + CASE WHEN gated THEN {policy.scale}::DOUBLE * (memory_bias + coalesce(s.bias, 0.0)) ELSE 0.0 END AS score FROM cb{b} c LEFT JOIN sg{b} s USING (signature))",
            ranks(f"ev{b}", f"cc{b}", "score", policy.budget),
            f"""fb{b} AS (SELECT coalesce(e.q, r.q) AS q, coalesce(e.id, r.id) AS id, CASE WHEN r.id IS NULL THEN 'ignored' WHEN e.id IS NULL THEN 'corrected' ELSE 'helpful' END AS outcome
  FROM (SELECT q, id FROM ev{b} WHERE inside AND gated) e FULL JOIN (SELECT DISTINCT q, id FROM rel JOIN gt USING (q) JOIN qu{b} USING (q) WHERE gated) r ON r.q = e.q AND r.id = e.id)""",
            f"fe{b} AS (SELECT f.*, t.turn, e.rank, e.signature, coalesce(e.protected, false) AS protected FROM fb{b} f JOIN qu{b} t USING (q) LEFT JOIN ev{b} e ON e.q = f.q AND e.id = f.id)",
            f"""mg{b} AS (SELECT id AS memory_id, list(outcome ORDER BY turn) AS outs, arg_max(outcome, turn) AS last, bool_or(protected) AS prot FROM fe{b} GROUP BY id)""",
            f"""mx{b} AS (SELECT coalesce(g.memory_id, s.memory_id) AS memory_id, coalesce(g.outs, []) AS outs, coalesce(s.u, 0) AS u0, coalesce(s.e, 0) AS e0, coalesce(s.imp, 0.0) AS i0, coalesce(s.bias, 0.0) AS b0,
  coalesce(g.last, s.last) AS last, coalesce(s.prot, false) OR coalesce(g.prot, false) AS prot FROM mg{b} g FULL JOIN me{b} s USING (memory_id))""",
            f"""me{b + 1} AS (SELECT memory_id, u0 + len(list_filter(outs, lambda o: o <> 'ignored'))::BIGINT AS u, e0 + (len(list_filter(outs, lambda o: o = 'helpful')) + 2 * len(list_filter(outs, lambda o: o = 'corrected')))::BIGINT AS e,
  {clamped('i0', B.IMPORTANCE_STEP, B.IMPORTANCE_BOUND)} AS imp, {clamped('b0', B.BIAS_STEP, B.BIAS_BOUND)} AS bias, last, prot FROM mx{b})""",
            f"sx{b} AS (SELECT signature, list(outcome ORDER BY turn, rank) AS outs FROM fe{b} WHERE signature IS NOT NULL GROUP BY signature)",
            f"sy{b} AS (SELECT coalesce(g.signature, s.signature) AS signature, coalesce(g.outs, []) AS outs, coalesce(s.bias, 0.0) AS b0, coalesce(s.n, 0) AS n0 FROM sx{b} g FULL JOIN sg{b} s USING (signature))",
            f"sg{b + 1} AS (SELECT signature, {clamped('b0', B.SIGNATURE_STEP, B.SIGNATURE_BOUND)} AS bias, n0 + len(outs)::BIGINT AS n FROM sy{b})",
        ]
    count = len(batches)
    out.append("ev AS (" + " UNION ALL ".join(f"SELECT *, {b} AS batch FROM ev{b}" for b in range(count)) + ")")
    out.append("fe AS (" + " UNION ALL ".join(f"SELECT *, {b} AS batch FROM fe{b}" for b in range(count)) + ")")
    return ",\n".join(out)


def summary_sql(policy: O.Policy, last: int) -> str:
    """CTEs and the final selection of (section, key, metric, value)."""
    return f""",
rn AS (SELECT q, count(DISTINCT id) AS n FROM rel GROUP BY q),
sm AS (SELECT y.q, coalesce(rn.n, 0) AS n, coalesce(s.hits, 0) AS hits, s.first_hit, coalesce(s.included, 0) AS included, coalesce(s.ch, 0) AS ch FROM qry y LEFT JOIN rn USING (q) LEFT JOIN (SELECT q, sum((relevant AND rank <= {policy.top_k})::INT) AS hits,
  min(CASE WHEN relevant THEN rank END) AS first_hit, sum(inside::INT) AS included, sum((inside AND relevant)::INT) AS ch FROM ev GROUP BY q) s USING (q)),
m AS (SELECT q, row_number() OVER (ORDER BY q) AS i, count(*) OVER () AS c, CASE WHEN n > 0 THEN hits / greatest(1, n) ELSE 0 END::DOUBLE AS recall_at_k, CASE WHEN n > 0 THEN coalesce(1.0 / first_hit, 0) ELSE 0 END::DOUBLE AS mrr,
  CASE WHEN n > 0 THEN ch / greatest(1, included) ELSE 0 END::DOUBLE AS context_precision, CASE WHEN n > 0 THEN ch / greatest(1, n) ELSE 0 END::DOUBLE AS context_recall, CASE WHEN n > 0 THEN included - ch ELSE 0 END::DOUBLE AS context_noise, included AS included_count FROM sm),
ml AS (SELECT i <= greatest(1, c // 2) AS first, unnest([{', '.join(f"struct_pack(metric := '{m}', value := {m}::DOUBLE)" for m in O.METRICS)}], recursive := true) FROM m),
eb AS ({S.ranked('(SELECT * EXCLUDE (score, rank), base AS score FROM ev)')}),
{confidence('ce', 'eb', policy.top_k)},
rl AS (SELECT role, count(*)::DOUBLE AS total, sum(relevant::INT)::DOUBLE AS relevant, sum(inside::INT)::DOUBLE AS budget FROM ev GROUP BY role),
ou AS (SELECT 'evolved' AS section, 'overall' AS key, metric, avg(value) AS value FROM ml GROUP BY metric
  UNION ALL SELECT 'evolved', 'first_half', metric, avg(value) FROM ml WHERE first GROUP BY metric UNION ALL SELECT 'evolved', 'second_half', metric, avg(value) FROM ml WHERE NOT first GROUP BY metric
  UNION ALL SELECT 'confidence', 'overall', metric, avg(value) FROM (SELECT unnest([{', '.join(f"struct_pack(metric := '{m}', value := {m}::DOUBLE)" for m in O.CONFIDENCE)}], recursive := true) FROM ce) GROUP BY metric
  UNION ALL SELECT 'rate', 'state', 'applied', avg(gated::INT::DOUBLE) FROM gt UNION ALL SELECT 'rate', 'bias', 'applied', avg((gated AND {policy.scale} > 0)::INT::DOUBLE) FROM gt
  UNION ALL SELECT 'role', role, unnest(['total', 'relevant', 'budget', 'relevant_rate', 'budget_rate']), unnest([total, relevant, budget, relevant / greatest(1, total), budget / greatest(1, total)]) FROM rl
  UNION ALL SELECT 'feedback', outcome, 'count', count(*)::DOUBLE FROM fe GROUP BY outcome
  UNION ALL SELECT 'state', 'memory', 'touched', count(*)::DOUBLE FROM me{last} UNION ALL SELECT 'state', 'signature', 'touched', count(*)::DOUBLE FROM sg{last})
SELECT section, key, metric, round(value, 6) AS value FROM ou"""


LOOP = ",\n".join([W.LEX, W.COST, PAIRS])
QUARTERS = [f"SELECT q, source_index AS turn FROM src WHERE source_index // ((SELECT count(*) FROM src) // {PARTS} + 1) = {b}" for b in range(PARTS)]
UNCERTAIN = f"(round(cutoff_margin, 9) <= {GATED.gate_margin} OR cutoff_crowding >= 4)"


@query("t5_online_evaluation", S.with_(LOOP, loop_sql(QUARTERS, SCORE, GATED, UNCERTAIN)) + summary_sql(GATED, PARTS))
def t5(spark, sf_dir):
    """Benchmark passages as a stream in four batches: gated state, both biases, metrics by halves, roles, feedback."""
    from memjoin.session import cut_lineage

    rel = written(tables.relevance(spark, sf_dir), "relevance")
    rows, own = rows_in_order(spark, sf_dir), cut_lineage(pairs(spark, sf_dir, rel))
    rows = cut_lineage(rows.withColumn("turn", F.col("source_index")))
    span = rows.count() // PARTS + 1
    log, source, progress = O.BatchLog(spark, scratch(spark, "online")), scratch(spark, "arrivals"), scratch(spark, "progress")
    for part in range(PARTS):  # the log of queries grows; each run of the stream takes what is new as one batch
        rows.where(F.floor(F.col("turn") / span) == part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        O.online_stream(stream, log, own, rel, scorer, GATED, progress).awaitTermination()
    return O.summary(log, GATED).select("section", "key", "metric", F.round("value", 6).alias("value"))


ALWAYS = O.Policy("always", bias_scale=0.0, top_k=3)
TURN = f"(source_index * {STEP} + {{p}} * {OFFSET}) % {PRIME}"
HALVES = [
    f"SELECT q, turn FROM (SELECT q, {TURN.format(p=p)} AS turn, row_number() OVER (ORDER BY {TURN.format(p=p)}) - 1 AS place, count(*) OVER () AS n FROM src) WHERE place // (n // 2 + 1) = {half}" for p in range(1, PASSES + 1) for half in range(2)
]
_evolved = "round(importance, 6) AS importance, use_count, evidence_count, last_outcome, protected"


@query(
    "t6_evolved_dataset",
    S.with_(LOOP, loop_sql(HALVES, ORACLE, ALWAYS, "true"))
    + f"""SELECT 0 AS pass, source_index, '' AS feedback_scorer, q, id, {_evolved} FROM pr JOIN src USING (q)
UNION ALL SELECT batch // 2 + 1, source_index, 'oracle', q, id, {_evolved} FROM ev JOIN src USING (q)""",
)
def t6(spark, sf_dir):
    """The original rows and two replay passes, each in an order of its own and in two batches: cards as they stood before
    their row was fed back, with pass, source index and scorer."""
    from memjoin.session import cut_lineage
    from memjoin.sources.jsonl import numbered

    rel = written(tables.relevance(spark, sf_dir), "relevance")
    rows, own = rows_in_order(spark, sf_dir), cut_lineage(pairs(spark, sf_dir, rel))
    log = O.BatchLog(spark, scratch(spark, "replay"))
    columns = ["pass", "source_index", "feedback_scorer", "q", "id", "importance", "use_count", "evidence_count", "last_outcome", "protected"]
    out = own.join(rows.select("q", "source_index"), "q").withColumns({"pass": F.lit(0), "feedback_scorer": F.lit("")}).select(columns)
    for number in range(1, PASSES + 1):
        turned = rows.withColumn("turn", (F.col("source_index") * STEP + number * OFFSET) % PRIME)
        placed = cut_lineage(numbered(cut_lineage(turned.orderBy("turn"))))
        size = placed.count() // 2 + 1
        for half in range(2):
            O.run_batch(log, 2 * (number - 1) + half, placed.where(F.floor(F.col("pos") / size) == half), own, rel, oracle, ALWAYS, "oracle")
    done = O.parts(log, "ranked").withColumn("pass", (F.floor(F.col("batch") / 2) + 1).cast("int"))
    both = out.unionByName(done.select(columns))
    return both.withColumn("importance", F.round("importance", 6))

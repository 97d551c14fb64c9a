"""Roll-up queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memjoin.operators import metrics as M
from memjoin.operators import rollups as R
from memjoin.operators.ranking import pack_budget
from memjoin.plans import metrics as Q
from memjoin.plans import sqltext as S
from memjoin.plans import workload as W
from memjoin.plans.metrics import r6, rounded
from memjoin.plans.registry import query
from memjoin.session import written
from memjoin.sources import tables

NAMES = ["recall_at_k", "mrr", "context_precision", "context_recall", "context_noise"]
LONG = ",\n".join([Q.METRIC_SQL, "lg AS (" + " UNION ALL ".join(f"SELECT q, '{n}' AS metric, {n} AS value FROM m23" for n in NAMES) + ")"])


def long_rows(spark, sf_dir):
    return R.long_metrics(Q.ranked_metrics(spark, sf_dir).select("q", *NAMES), ["q"])


def place_sql(source: str, group: str, value: str, rules: dict[str, str]) -> str:
    """group + quantile columns by explicit position; `n` is the group size."""
    picks = ", ".join(f"max(CASE WHEN pos = {rule} THEN v END) AS {name}" for name, rule in rules.items())
    return f"""SELECT {group}, {picks} FROM (SELECT {group}, {value}::DOUBLE AS v, row_number() OVER (PARTITION BY {group} ORDER BY {value}) - 1 AS pos, count(*) OVER (PARTITION BY {group}) AS n FROM {source}) GROUP BY {group}"""


def ceil_rule(q: float) -> str:
    return f"least(n - 1, greatest(0, ceil(round({q} * n, 9))::BIGINT - 1))"


def floor_rule(q: float) -> str:
    return f"least(n - 1, floor(round({q} * (n - 1), 9))::BIGINT)"


def round_rule(q: float) -> str:
    return f"least(n - 1, round_even(round({q} * (n - 1), 9), 0)::BIGINT)"


def rollup_sql(p50: str) -> str:
    return S.with_(LONG, f"qt AS ({place_sql('lg', 'metric', 'value', {'p50': p50, 'p95': ceil_rule(0.95)})})") + "SELECT metric, " + r6("avg(value) AS avg", "any_value(p50) AS p50", "any_value(p95) AS p95", "min(value) AS min", "max(value) AS max") + " FROM lg JOIN qt USING (metric) GROUP BY metric"


@query("a5_metric_rollup", rollup_sql(ceil_rule(0.5)))
def a5(spark, sf_dir):
    return rounded(R.metric_rollup(R.long_metrics(Q.ranked_metrics(spark, sf_dir).select("q", *NAMES), ["q"])))


@query("a7_session_rollup", rollup_sql(floor_rule(0.5)))
def a7(spark, sf_dir):
    return rounded(R.metric_rollup(long_rows(spark, sf_dir), R.floor_place))


@query(
    "a6_bootstrap_ci",
    S.with_(
        LONG,
        "lo AS (SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY metric) AS n FROM lg)",
        "m0 AS (SELECT metric, n, rep, (rep * 1000003 + place) % 2147483647 AS x FROM lo CROSS JOIN (SELECT unnest(range(0, 300)) AS rep))",
        "m1 AS (SELECT metric, n, rep, (x * x + x * 12345 + 7) % 2147483647 AS x FROM m0)",
        "m2 AS (SELECT metric, rep, ((x * x + x * 54321 + 7) % 2147483647) % n AS place FROM m1)",
        "me AS (SELECT metric, rep, avg(value) AS mean FROM m2 JOIN lo USING (metric, place) GROUP BY ALL)",
    )
    + "SELECT metric, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM (" + place_sql("me", "metric", "mean", {"ci_low": ceil_rule(0.025), "ci_high": ceil_rule(0.975)}) + ")",
)
def a6(spark, sf_dir):
    return rounded(R.bootstrap_ci(long_rows(spark, sf_dir).select("metric", "value")))


FIVE = {"low": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "high": 1.0}


@query("a8_quantile_summary", place_sql("events", "event_type", "value", {**{k: ceil_rule(v) for k, v in FIVE.items()}, "p50_round": round_rule(0.5), "p95_round": round_rule(0.95)}))
def a8(spark, sf_dir):
    wanted = {k: (v, R.ceil_place) for k, v in FIVE.items()}
    wanted |= {"p50_round": (0.5, R.round_place), "p95_round": (0.95, R.round_place)}
    return R.exact_quantiles(tables.table(spark, sf_dir, "events"), "event_type", "value", wanted)


@query("a9_metric_average", S.with_(LONG) + "SELECT metric, round(avg(value), 6) AS mean, count(*) AS cases FROM lg GROUP BY metric")
def a9(spark, sf_dir):
    return rounded(long_rows(spark, sf_dir).groupBy("metric").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("cases")))


SEEDS = """sd AS (SELECT user_id % 7 AS seed, event_type AS variant, avg(value) AS v FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL)"""


@query(
    "a10_seed_summary",
    S.with_(SEEDS, "al AS (SELECT variant, v FROM sd UNION ALL SELECT 'delta', c.v - r.v FROM sd r JOIN sd c ON c.seed = r.seed AND c.variant = 'click' AND r.variant = 'view')")
    + "SELECT variant, " + r6("avg(v) AS mean", "coalesce(stddev_samp(v), 0) AS stdev", "min(v) AS low", "max(v) AS high") + " FROM al GROUP BY variant",
)
def a10(spark, sf_dir):
    """Views and clicks as the two variants, users modulo seven as the seeds; deltas are paired per seed."""
    rows = tables.table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    per = rows.groupBy((F.col("user_id") % 7).alias("seed"), F.col("event_type").alias("variant")).agg(F.avg("value").alias("v"))
    wide = per.groupBy("seed").pivot("variant", ["view", "click"]).agg(F.first("v"))
    delta = wide.select("seed", F.lit("delta").alias("variant"), (F.col("click") - F.col("view")).alias("v"))
    out = per.unionByName(delta).groupBy("variant").agg(F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("stdev"), F.min("v").alias("low"), F.max("v").alias("high"))
    return rounded(out)


def systems_sql() -> str:
    """CTE `sys` (system, q, recall_at_k, precision_at_k, mrr, context_precision, context_recall, hard_negative_top_k_rate)."""
    parts = [W.LEX, S.vector(W.FETCH), W.COST, "rc AS (SELECT q, count(*) AS n FROM rel GROUP BY q)"]
    for name, source in (("lexical", "lex"), ("vector", "vec")):
        parts += [W.pack_sql(source, Q.BUDGET, f"cx_{name}"), W.flag_sql(source, f"cx_{name}", f"fl_{name}")]
    rows = " UNION ALL ".join(
        f"""SELECT '{name}' AS system, q.q, coalesce(h, 0) / greatest(1, coalesce(n, 0)) AS recall_at_k, coalesce(h, 0) / greatest(1, coalesce(t, 0)) AS precision_at_k, coalesce(1.0 / fr, 0) AS mrr,
  coalesce(ch, 0) / greatest(1, coalesce(inc, 0)) AS context_precision, coalesce(ch, 0) / greatest(1, coalesce(n, 0)) AS context_recall, coalesce(hd, 0) / greatest(1, coalesce(t, 0)) AS hard_negative_top_k_rate
  FROM qry q LEFT JOIN (SELECT f.q, sum((rank <= 8)::INT * is_relevant) AS h, sum((rank <= 8)::INT) AS t, min(CASE WHEN is_relevant = 1 THEN rank END) AS fr, sum(in_context) AS inc, sum(in_context * is_relevant) AS ch,
  sum((rank <= 8 AND m.last_outcome = 'ignored')::INT) AS hd FROM fl_{name} f JOIN mem m USING (id) GROUP BY f.q) s ON s.q = q.q LEFT JOIN rc ON rc.q = q.q"""
        for name in ("lexical", "vector")
    )
    return ",\n".join([*parts, f"sys AS ({rows})"])


SYS = systems_sql()
METRICS = ["recall_at_k", "precision_at_k", "mrr", "context_precision", "context_recall", "hard_negative_top_k_rate"]


def system_rows(spark, sf_dir, rel=None):
    """Metrics of both base rankings for every query; the relevant pairs are searched once and written."""
    qry = tables.queries(spark, sf_dir).select("q")
    rel = written(tables.relevance(spark, sf_dir), "relevance") if rel is None else rel
    out = None
    for name, ranked in (("lexical", W.lexical_ranked(spark, sf_dir)), ("vector", W.vector_ranked(spark, sf_dir))):
        ranked = W.costed(spark, sf_dir, ranked)
        cover = ranked.select("id", F.col("id").alias("covered")).distinct()
        rows = M.evidence_metrics(qry, ranked, rel, cover, pack_budget(ranked, Q.BUDGET), Q.hard(spark, sf_dir), W.TOP_K)
        rows = rows.select(F.lit(name).alias("system"), "q", *METRICS)
        out = rows if out is None else out.unionByName(rows)
    return out


_avg = [f"avg({m}) AS {m}" for m in METRICS]
# Latencies are the values of the view and the click events, as the measured column of the two systems.
LATENCY = {"lexical": "view", "vector": "click"}
LAT = "lt AS (SELECT CASE event_type WHEN 'view' THEN 'lexical' ELSE 'vector' END AS system, avg(value) AS latency FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL)"


def mismatches(spark, sf_dir):
    """(system, mismatches): queries whose ranking differs when it is computed again from rows dealt out anew."""
    from memjoin.operators.lexical import idf_token_scores
    from memjoin.operators.vector import exact_vector_topk

    mem, qry = tables.card_texts(spark, sf_dir), tables.queries(spark, sf_dir).select("q", "text")
    dealt, asked = mem.repartition(13, F.xxhash64("id", F.lit(7))), qry.repartition(5)
    again = {"lexical": idf_token_scores(dealt, asked, None, W.FETCH), "vector": exact_vector_topk(W.embedded(dealt, "id"), W.embedded(asked, "q"), W.FETCH, W.DIMS)}
    out = None
    for name, ranked in (("lexical", W.lexical_ranked(spark, sf_dir)), ("vector", W.vector_ranked(spark, sf_dir))):
        both = M.signature(ranked, 6).join(M.signature(again[name], 6).withColumnRenamed("signature", "again"), "q", "full_outer")
        one = both.agg(F.count_if(~F.col("signature").eqNullSafe(F.col("again"))).alias("mismatches")).select(F.lit(name).alias("system"), "mismatches")
        out = one if out is None else out.unionByName(one)
    return out


def latencies(spark, sf_dir):
    system = F.when(F.col("event_type") == LATENCY["lexical"], "lexical").otherwise("vector")
    rows = tables.table(spark, sf_dir, "events").where(F.col("event_type").isin(*LATENCY.values()))
    return rows.select(system.alias("system"), "value")


PLACES = {"p50": ceil_rule(0.5), "p95": ceil_rule(0.95)}


@query("a11_system_rollup", S.with_(SYS, "lr AS (SELECT CASE event_type WHEN 'view' THEN 'lexical' ELSE 'vector' END AS system, value FROM events WHERE event_type IN ('view', 'click'))", "pl AS (" + place_sql("lr", "system", "value", PLACES) + ")") + "SELECT system, count(*) AS queries, " + r6(*_avg) + ", 0::BIGINT AS mismatches, (SELECT count(*) FROM documents) AS memories, any_value(p50) AS latency_p50, any_value(p95) AS latency_p95 FROM sys JOIN pl USING (system) GROUP BY system")
def a11(spark, sf_dir):
    out = system_rows(spark, sf_dir).groupBy("system").agg(F.count(F.lit(1)).alias("queries"), *[F.avg(m).alias(m) for m in METRICS])
    late = R.exact_quantiles(latencies(spark, sf_dir), "system", "value", {"latency_p50": (0.5, R.ceil_place), "latency_p95": (0.95, R.ceil_place)})
    counted = tables.card_texts(spark, sf_dir).agg(F.count(F.lit(1)).alias("memories"))
    return rounded(out).join(mismatches(spark, sf_dir), "system").join(late, "system").withColumn("memories", counted.scalar())


@query(
    "a21_leaderboard_score",
    S.with_(SYS, LAT, "av AS (SELECT system, " + ", ".join(_avg) + " FROM sys GROUP BY system)", "sc AS (SELECT system, " + " + ".join(f"{w}::DOUBLE * {m}" for m, w in R.LEADERBOARD.items()) + " - 0.1::DOUBLE * greatest(0.0, (latency - 20.0) / 20.0) AS score FROM av JOIN lt USING (system))")
    + "SELECT system, round(score, 6)::DOUBLE AS score, row_number() OVER (ORDER BY round(score, 9) DESC, system) AS place FROM sc",
)
def a21(spark, sf_dir):
    rolled = system_rows(spark, sf_dir).groupBy("system").agg(*[F.avg(m).alias(m) for m in METRICS])
    late = latencies(spark, sf_dir).groupBy("system").agg(F.avg("value").alias("latency"))
    rolled = rolled.join(late, "system").join(mismatches(spark, sf_dir), "system")
    scored = rolled.select("system", R.leaderboard_score(F.col("latency"), 20.0, F.col("mismatches")).alias("score"))
    order = Window.orderBy(F.round("score", 9).desc(), "system")  # one row per system
    return rounded(scored.select("system", "score", F.row_number().over(order).cast("bigint").alias("place")))


@query(
    "s12_summary_table_sink",
    S.with_(SYS, "sc AS (SELECT s.*, CASE WHEN rc.q IS NULL THEN 'abstention' ELSE 'answerable' END AS scenario FROM sys s LEFT JOIN rc ON rc.q = s.q)")
    + "SELECT scenario, system, count(*) AS queries, " + r6(*_avg) + " FROM sc GROUP BY ALL",
)
def s12(spark, sf_dir):
    """Roll-up table per system and scenario, written to parquet and read back."""
    from memjoin.plans.ingest import scratch

    rel = written(tables.relevance(spark, sf_dir), "relevance")
    answerable = rel.select("q").distinct().withColumn("known", F.lit(True))
    rows = system_rows(spark, sf_dir, rel).join(answerable, "q", "left").withColumn("scenario", F.when(F.col("known"), "answerable").otherwise("abstention"))
    out = rows.groupBy("scenario", "system").agg(F.count(F.lit(1)).alias("queries"), *[F.avg(m).alias(m) for m in METRICS])
    path = scratch(spark, "summary")
    rounded(out).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@query(
    "a12_role_exposure",
    S.with_(
        Q.FULL,
        """x AS (SELECT m.last_outcome AS role, count(*) AS total, 0 AS relevant, 0 AS top_k, 0 AS budget FROM pool_all p JOIN mem m USING (id) GROUP BY ALL)""".replace("pool_all", "lex"),
        "y AS (SELECT m.last_outcome AS role, sum(is_relevant) AS relevant, sum((rank <= 8)::INT) AS top_k, sum(in_context) AS budget FROM fl f JOIN mem m USING (id) GROUP BY ALL)",
    )
    + "SELECT role, total, y.relevant::BIGINT AS relevant, y.top_k::BIGINT AS top_k, y.budget::BIGINT AS budget, " + r6("y.relevant / greatest(1, total) AS relevant_rate", "y.top_k / greatest(1, total) AS top_k_rate", "y.budget / greatest(1, total) AS budget_rate") + " FROM x JOIN y USING (role)",
)
def a12(spark, sf_dir):
    _, ranked, rel, ctx = Q.inputs(spark, sf_dir)
    rows = M.flagged(ranked.select("q", "id", "rank"), rel, ctx).join(tables.memories(spark, sf_dir).select("id", F.col("last_outcome").alias("role")), "id")
    sums = rows.groupBy("role").agg(F.count(F.lit(1)).alias("total"), F.sum("is_relevant").alias("relevant"), F.sum((F.col("rank") <= W.TOP_K).cast("bigint")).alias("top_k"), F.sum("in_context").alias("budget"))
    return rounded(sums.select("*", *[M.ratio(F.col(c), F.col("total")).alias(f"{c}_rate") for c in ("relevant", "top_k", "budget")]))


SAMPLES = """sp AS (SELECT label, CASE WHEN label = 'quality' THEN quality ELSE toxic END AS expected, ((d.n_chars * 31 + d.doc_id * 17 + CASE WHEN label = 'quality' THEN 23 * quality ELSE 41 * toxic END) % 100) / 100.0::DOUBLE AS score
  FROM labels JOIN documents d USING (doc_id) CROSS JOIN (SELECT unnest(['quality', 'toxic']) AS label))"""


def samples(spark, sf_dir):
    """Two label heads over every labelled document, with an arithmetic score that leans towards the label."""
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rows = tables.table(spark, sf_dir, "labels").join(docs, "doc_id")
    both = rows.select("doc_id", "n_chars", F.explode(F.array(F.struct(F.lit("quality").alias("label"), F.col("quality").alias("expected"), F.lit(23).alias("lean")), F.struct(F.lit("toxic").alias("label"), F.col("toxic").alias("expected"), F.lit(41).alias("lean")))).alias("h"))
    return both.select("h.label", "h.expected", ((F.col("n_chars") * 31 + F.col("doc_id") * 17 + F.col("h.lean") * F.col("h.expected")) % 100 / 100.0).alias("score"))


def counts_sql(t: str) -> str:
    return f"count_if(score >= {t} AND expected = 1)::BIGINT AS tp, count_if(score >= {t} AND expected = 0)::BIGINT AS fp, count_if(score < {t} AND expected = 1)::BIGINT AS fn, count_if(score < {t} AND expected = 0)::BIGINT AS tn"


F1 = "2.0 * (tp / greatest(1, tp + fp)) * (tp / greatest(1, tp + fn)) / greatest(1e-6, tp / greatest(1, tp + fp) + tp / greatest(1, tp + fn))"
RATES = r6("tp / greatest(1, tp + fp) AS precision", "tp / greatest(1, tp + fn) AS recall", f"{F1} AS f1")


@query(
    "a13_multilabel_summary",
    S.with_(SAMPLES, f"ct AS (SELECT label, {counts_sql('0.5')} FROM sp GROUP BY label)", f"pl AS (SELECT label, tp, fp, fn, tn, {RATES} FROM ct)")
    + "SELECT *, (SELECT round(sum(tp + tn)::DOUBLE / sum(tp + fp + fn + tn), 6) FROM pl) AS bit_accuracy, (SELECT round(avg(f1), 5) FROM pl) AS macro_f1 FROM pl",
)
def a13(spark, sf_dir):
    per = R.with_f1(samples(spark, sf_dir).groupBy("label").agg(*R.confusion_counts(F.col("score"), F.col("expected"), 0.5)))
    whole = Window.partitionBy()  # one row per label
    total = F.sum(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).over(whole)
    out = per.select("*", (F.sum(F.col("tp") + F.col("tn")).over(whole) / total).alias("bit_accuracy"), F.round(F.avg("f1").over(whole), 5).alias("macro_f1"))
    return rounded(out)


@query(
    "a14_threshold_tuning",
    S.with_(
        SAMPLES, "th AS (SELECT unnest(range(1, 20)) / 20.0::DOUBLE AS threshold)", f"ct AS (SELECT label, threshold, {counts_sql('threshold')} FROM sp CROSS JOIN th GROUP BY ALL)",
        f"rk AS (SELECT *, {F1} AS f1, row_number() OVER (PARTITION BY label ORDER BY round({F1}, 9) DESC, round(abs(threshold - 0.5), 9), threshold) AS n FROM ct)",
    )
    + "SELECT label, threshold, round(f1, 6) AS f1 FROM rk WHERE n = 1",
)
def a14(spark, sf_dir):
    return rounded(R.tune_thresholds(samples(spark, sf_dir)))


@query(
    "a16_threshold_sweep",
    S.with_(SAMPLES, "th AS (SELECT unnest([0.2, 0.4, 0.6, 0.8])::DOUBLE AS threshold)", f"ct AS (SELECT label, threshold, {counts_sql('threshold')} FROM sp CROSS JOIN th GROUP BY ALL)")
    + f"SELECT label, threshold, {RATES}, round((tp + fp)::DOUBLE / (tp + fp + fn + tn), 6) AS positive_rate FROM ct",
)
def a16(spark, sf_dir):
    swept = R.with_f1(R.threshold_counts(samples(spark, sf_dir), [0.2, 0.4, 0.6, 0.8], ["label"]))
    share = (F.col("tp") + F.col("fp")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return rounded(swept.select("label", "threshold", "precision", "recall", "f1", share.alias("positive_rate")))


CLASSES = ["helpful", "corrected", "ignored", ""]


@query(
    "a15_confusion_matrix",
    S.with_(S.MEM, "pr AS (SELECT last_outcome AS expected, CASE WHEN importance >= 0.7 THEN 'helpful' WHEN importance >= 0.4 THEN 'corrected' WHEN use_count = 0 THEN 'ignored' ELSE '' END AS predicted FROM mem)",
            "c AS (SELECT expected, count_if(predicted = 'helpful')::BIGINT AS p_helpful, count_if(predicted = 'corrected')::BIGINT AS p_corrected, count_if(predicted = 'ignored')::BIGINT AS p_ignored, count_if(predicted = '')::BIGINT AS p_none, avg((predicted = expected)::INT) AS recall FROM pr GROUP BY expected)")
    + "SELECT *  EXCLUDE (recall), round(recall, 6) AS recall, round((SELECT avg((predicted = expected)::INT) FROM pr), 6) AS accuracy, round((SELECT avg(recall) FROM c), 6) AS macro_recall FROM c",
)
def a15(spark, sf_dir):
    predicted = F.when(F.col("importance") >= 0.7, "helpful").when(F.col("importance") >= 0.4, "corrected").when(F.col("use_count") == 0, "ignored").otherwise("")
    rows = tables.memories(spark, sf_dir).select(F.col("last_outcome").alias("expected"), predicted.alias("predicted"))
    wide = rows.groupBy("expected").pivot("predicted", CLASSES).count().fillna(0)
    named = wide.select("expected", *[F.col(f"`{c}`").alias(f"p_{c or 'none'}") for c in CLASSES])
    right = F.lit(0)
    for c in CLASSES:
        right = F.when(F.col("expected") == c, F.col(f"p_{c or 'none'}")).otherwise(right)
    size = sum((F.col(f"p_{c or 'none'}") for c in CLASSES), F.lit(0))
    per = named.withColumn("hits", right).withColumn("size", size).withColumn("recall", F.col("hits") / F.col("size"))
    whole = Window.partitionBy()  # one row per class
    out = per.select(*named.columns, "recall", (F.sum("hits").over(whole) / F.sum("size").over(whole)).alias("accuracy"), F.avg("recall").over(whole).alias("macro_recall"))
    return rounded(out)


@query(
    "a17_error_breakdown",
    S.with_(
        Q.FULL,
        """er AS (SELECT 'false_top' AS kind, m.last_outcome AS role FROM fl f JOIN mem m USING (id) WHERE rank <= 8 AND is_relevant = 0 UNION ALL SELECT 'false_context', m.last_outcome FROM fl f JOIN mem m USING (id) WHERE in_context = 1 AND is_relevant = 0
           UNION ALL SELECT 'missed_top', m.last_outcome FROM rel r JOIN mem m USING (id) ANTI JOIN (SELECT q, id FROM fl WHERE rank <= 8) t ON t.q = r.q AND t.id = r.id
           UNION ALL SELECT 'missed_context', m.last_outcome FROM rel r JOIN mem m USING (id) ANTI JOIN (SELECT q, id FROM fl WHERE in_context = 1) t ON t.q = r.q AND t.id = r.id)""",
    )
    + "SELECT kind, role, count(*) AS n FROM er GROUP BY ALL",
)
def a17(spark, sf_dir):
    _, ranked, rel, ctx = Q.inputs(spark, sf_dir)
    rows = M.flagged(ranked.select("q", "id", "rank"), rel, ctx)
    top, packed = F.col("rank") <= W.TOP_K, F.col("in_context") == 1

    def ids(df, kind):
        return df.select("id", F.lit(kind).alias("kind"))

    wrong = F.col("is_relevant") == 0
    errors = ids(rows.where(top & wrong), "false_top").unionByName(ids(rows.where(packed & wrong), "false_context"))
    for kind, seen in (("missed_top", top), ("missed_context", packed)):
        errors = errors.unionByName(ids(rel.join(rows.where(seen).select("q", "id"), ["q", "id"], "left_anti"), kind))
    roles = tables.memories(spark, sf_dir).select("id", F.col("last_outcome").alias("role"))
    return errors.join(roles, "id").groupBy("kind", "role").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a17_worst_cases",
    S.with_(Q.METRIC_SQL) + "SELECT q, " + r6("recall_at_k", "context_precision", "context_noise") + " FROM m23 WHERE relevant_count > 0 ORDER BY round(recall_at_k, 9), round(context_precision, 9), round(context_noise, 9) DESC, q LIMIT 10",
)
def a17_worst(spark, sf_dir):
    rows = Q.ranked_metrics(spark, sf_dir).where(F.col("relevant_count") > 0)
    worst = rows.orderBy(F.round("recall_at_k", 9), F.round("context_precision", 9), F.round("context_noise", 9).desc(), "q").limit(10)
    return rounded(worst.select("q", "recall_at_k", "context_precision", "context_noise"))


@query(
    "a18_half_windows",
    S.with_(LONG, "nn AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY q) AS i, count(*) OVER (PARTITION BY metric) AS n FROM lg)")
    + "SELECT metric, " + r6("avg(value) AS overall", "avg(CASE WHEN i <= greatest(1, n // 2) THEN value END) AS first_half", "avg(CASE WHEN i > greatest(1, n // 2) THEN value END) AS second_half") + " FROM nn GROUP BY metric",
)
def a18(spark, sf_dir):
    """Queries in id order; the halves meet at max(1, n // 2)."""
    base = Q.ranked_metrics(spark, sf_dir).select("q", *NAMES)
    from memjoin.session import cut_lineage
    from memjoin.sources.jsonl import numbered

    placed = numbered(cut_lineage(base.orderBy("q")))
    total = placed.agg(F.count(F.lit(1))).scalar()
    first = F.col("pos") < F.greatest(F.lit(1), F.floor(total / 2))
    long = R.long_metrics(placed.withColumn("half", F.when(first, 1).otherwise(2)), ["q", "pos", "half"])
    out = long.groupBy("metric").agg(
        F.avg("value").alias("overall"), F.avg(F.when(F.col("half") == 1, F.col("value"))).alias("first_half"), F.avg(F.when(F.col("half") == 2, F.col("value"))).alias("second_half")
    )
    return rounded(out)


RUNS = """ru AS (SELECT CASE WHEN brand = 'en' THEN 'adversarial' ELSE 'preference_shift' END AS scenario, ['none', 'mild', 'strong'][(id % 3 + 1)::INT] AS corruption,
  avg(importance) - 0.45 AS recall_at_k, avg(use_count) / 10.0 - 0.4 AS context_precision, avg(evidence_count) / 10.0 - 0.2 AS noise FROM mem GROUP BY ALL),
rl AS (SELECT scenario, corruption, 'recall_at_k' AS metric, recall_at_k AS value FROM ru UNION ALL SELECT scenario, corruption, 'context_precision', context_precision FROM ru UNION ALL SELECT scenario, corruption, 'noise', noise FROM ru)"""


def runs(spark, sf_dir):
    """Card averages by language and id class as the metric deltas of six runs."""
    mem = tables.memories(spark, sf_dir)
    scenario = F.when(F.col("brand") == "en", "adversarial").otherwise("preference_shift")
    corruption = F.element_at(F.array(F.lit("none"), F.lit("mild"), F.lit("strong")), (F.col("id") % 3 + 1).cast("int"))
    wide = mem.groupBy(scenario.alias("scenario"), corruption.alias("corruption")).agg(
        (F.avg("importance") - 0.45).alias("recall_at_k"), (F.avg("use_count") / 10.0 - 0.4).alias("context_precision"), (F.avg("evidence_count") / 10.0 - 0.2).alias("noise")
    )
    return R.long_metrics(wide, ["scenario", "corruption"])


def gates_sql(gates) -> str:
    return "gt AS (SELECT * FROM (VALUES " + ", ".join(f"('{g}', '{s}', '{c}', '{m}', '{o}', {t}::DOUBLE)" for g, s, c, m, o, t in gates) + ") t(gate, scenario, corruption, metric, op, threshold))"


GATED = "SELECT r.scenario, r.corruption, g.gate, round(r.value, 6) AS value, CASE WHEN op = '>=' THEN round(value, 9) >= threshold ELSE round(value, 9) <= threshold END AS passed FROM rl r JOIN gt g ON g.metric = r.metric AND g.scenario IN (r.scenario, '*') AND g.corruption IN (r.corruption, '*')"


@query("a19_quality_gates", S.with_(S.MEM, RUNS, gates_sql(R.QUALITY_GATES)) + GATED)
def a19(spark, sf_dir):
    return rounded(R.evaluate_gates(runs(spark, sf_dir), R.gate_table(spark, R.QUALITY_GATES)))


@query(
    "a19_gate_summary",
    S.with_(S.MEM, RUNS, gates_sql(R.QUALITY_GATES), f"ck AS ({GATED})")
    + "SELECT scenario, corruption, bool_and(passed) AS passed, count(*) AS checks, count_if(NOT passed)::BIGINT AS failed FROM ck GROUP BY ALL",
)
def a19_summary(spark, sf_dir):
    checked = R.evaluate_gates(runs(spark, sf_dir), R.gate_table(spark, R.QUALITY_GATES))
    return checked.groupBy("scenario", "corruption").agg(F.bool_and("passed").alias("passed"), F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("passed")).alias("failed"))


LIMITS = [("recall_floor", "*", "*", "recall_at_k", ">=", 0.05), ("precision_floor", "*", "*", "context_precision", ">=", 0.0), ("noise_ceiling", "adversarial", "*", "noise", "<=", 0.01)]


@query("a20_regression_gates", S.with_(S.MEM, RUNS, gates_sql(LIMITS), f"ck AS ({GATED})") + "SELECT scenario, corruption, gate, value FROM ck WHERE NOT passed")
def a20(spark, sf_dir):
    """Only the failures, as a regression run reports them."""
    checked = R.evaluate_gates(runs(spark, sf_dir), R.gate_table(spark, LIMITS))
    return rounded(checked.where(~F.col("passed")).select("scenario", "corruption", "gate", "value"))

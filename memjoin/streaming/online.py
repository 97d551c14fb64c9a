"""Online evaluation and evolved rows: queries arrive in order, are ranked under the state that earlier queries left behind,
measured, and fed back.

State is frozen inside a batch and moves between batches; a batch of one query is the fully serial loop. A batch leaves its
parts in one folder - the memory and signature states that it touched, its decisions, ranked rows and feedback events -
and counts only once its row stands in the manifest, which is written last. A batch number that is in the manifest is skipped,
so a replayed micro-batch changes nothing; parts of a batch that broke off are overwritten.

A state part holds the touched keys only; the newest row of a key is its state. Every `FULL` batches the whole state is
written, and reading starts there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from memjoin.operators import feedback as B
from memjoin.operators.metrics import flagged_metrics
from memjoin.operators.ranking import pack_budget, ranked
from memjoin.session import cut_lineage

FULL = 32
TURN_BITS = 12  # of a signature's sequence number: the rank inside a query's list
MEMORY = "memory_id bigint, use_count_delta bigint, evidence_count_delta bigint, importance_delta double, score_bias double, last_outcome string, protected boolean, n_helpful bigint, n_corrected bigint, n_ignored bigint"
SIGNATURE = "signature string, bias double, n bigint"
CARD = ["importance", "age_days", "use_count", "evidence_count", "last_outcome", "protected"]


@dataclass(frozen=True)
class Policy:
    """When a query may read and change the state, and how far a bias may move its scores."""

    name: str = "always"
    bias_scale: float = 0.35
    gate_margin: float = 0.05
    low_score: float = 0.6
    low_spread: float = 0.2
    top_k: int = 8
    budget: int = 2500
    allow_bias: bool = True

    @property
    def scale(self) -> float:
        return self.bias_scale if self.allow_bias and self.name != "off" and self.bias_scale > 0 else 0.0


class BatchLog:
    """Parts of committed batches under one folder of a shared file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], "batch bigint, base bigint").write.mode("append").parquet(f"{path}/manifest")

    def manifest(self) -> dict[int, int]:
        """Committed batch -> the batch from which its state is read."""
        rows = self.spark.read.schema("batch bigint, base bigint").parquet(f"{self.path}/manifest").collect()
        return {r.batch: r.base for r in rows}

    def part(self, name: str, schema: str, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], f"{schema}, batch bigint")
        return self.spark.read.schema(f"{schema}, batch bigint").parquet(*[f"{self.path}/batch={n}/{name}" for n in batches])

    def state(self, name: str, schema: str, key: str, before: int | None = None) -> DataFrame:
        """The newest row of every key in the batches before `before`."""
        held = {n: base for n, base in self.manifest().items() if before is None or n < before}
        base = held[max(held)] if held else 0
        rows = self.part(name, schema, sorted(n for n in held if n >= base))
        values = [f.split()[0] for f in schema.split(", ") if f.split()[0] != key]
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*values), "batch").alias("s"))
        return newest.select(key, *[F.col(f"s.{v}").alias(v) for v in values])

    def stage(self, batch: int, name: str, df: DataFrame) -> DataFrame:
        """Write a part of a batch that is not committed yet, and read it back."""
        path = f"{self.path}/batch={batch}/{name}"
        df.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def commit(self, batch: int, parts: dict[str, DataFrame], full: dict[str, Callable[[], DataFrame]]) -> None:
        """Write the parts of a batch, then its row of the manifest; every FULL batches the states in `full` are written whole."""
        whole = batch > 0 and batch % FULL == 0
        for name, df in parts.items():
            rows = full[name]() if whole and name in full else df
            self.stage(batch, name, rows)
        known = self.manifest()
        base = batch if whole else known[max(known)] if known else batch
        self.spark.createDataFrame([(batch, base)], "batch bigint, base bigint").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")


def signature() -> Column:
    """The relationship signature of a pair whose card state may have evolved; the other parts are columns."""
    stale = (F.coalesce("age_days", F.lit(0)) >= 180) & (F.coalesce("use_count", F.lit(0)) <= 0) & ~F.coalesce("protected", F.lit(False))
    return F.concat_ws("|", "context", "relation", F.when(stale, "stale").otherwise("fresh_or_used"), "duplicate")


def gates(queries: DataFrame, pairs: DataFrame, scorer: Callable[[], Column], policy: Policy) -> DataFrame:
    """(q, confidence and risk columns, gated) under the cards as they stand without any state."""
    base = ranked(pairs.withColumn("score", scorer()), "q")
    risk = B.state_risk(queries.select("q", "asked"), pack_budget(base, policy.budget))
    both = queries.select("q").join(B.confidence_features(base, policy.top_k), "q", "left").join(risk, "q", "left")
    allowed = B.policy_allows(policy.name, policy.gate_margin, policy.low_score, policy.low_spread)
    return both.withColumn("gated", F.coalesce(allowed, F.lit(policy.name == "always")))


def run_batch(log: BatchLog, batch: int, queries: DataFrame, pairs: DataFrame, relevance: DataFrame, scorer: Callable[[], Column], policy: Policy, tag: str = "") -> None:
    """Rank, measure and feed back one batch of queries, then commit it.

    `queries`: q, turn (unique, ascending in the order of the loop), asked, source_index. `pairs`: q, id, text, cost, role,
    same_context, other_context, context, relation, duplicate, the card columns and whatever `scorer` reads.
    `relevance`: q, id. The batch's parts: `queries` (decision and relevant count of each), `ranked` (every candidate with its
    evolved card, rank, and whether it is relevant and inside the budget), `events`, `memory`, `signature`.
    """
    if batch in log.manifest():
        return
    asked = cut_lineage(queries.select("q", "turn", "asked", "source_index"))
    own = cut_lineage(pairs.join(asked.select("q", "turn", "source_index"), "q"))
    relevant = relevance.join(asked.select("q"), "q", "left_semi").distinct()
    counts = relevant.groupBy("q").agg(F.count(F.lit(1)).alias("relevant_count"))
    decided = gates(asked, own, scorer, policy).join(asked.select("q", "turn", "source_index"), "q").join(counts, "q", "left").fillna(0, ["relevant_count"])
    decided = log.stage(batch, "queries", decided)
    memory = log.state("memory", MEMORY, "memory_id", batch)
    signatures = log.state("signature", SIGNATURE, "signature", batch)

    flagged = own.join(decided.select("q", "gated"), "q")
    evolved = B.apply_state(flagged.where("gated"), memory).unionByName(flagged.where("not gated"))
    scored = evolved.withColumn("base", scorer()).withColumn("signature", signature())
    bias = F.when(F.col("gated"), F.lit(policy.scale) * (F.coalesce("memory_bias", F.lit(0.0)) + F.coalesce("signature_bias", F.lit(0.0)))).otherwise(0.0)
    moved = (
        scored.join(memory.select(F.col("memory_id").alias("id"), F.col("score_bias").alias("memory_bias")), "id", "left")
        .join(signatures.select("signature", F.col("bias").alias("signature_bias")), "signature", "left")
        .join(relevant.withColumn("hit", F.lit(True)), ["q", "id"], "left")
        .withColumn("score", F.col("base") + bias)
    )
    used = F.sum("cost").over(Window.partitionBy("q").orderBy("rank"))
    final = ranked(moved, "q").withColumn("inside", used <= policy.budget).select(
        "q", "turn", "source_index", "id", "rank", "score", "base", "role", "gated", "signature", "inside", F.coalesce("hit", F.lit(False)).alias("hit"), *CARD, F.lit(tag).alias("feedback_scorer")
    )
    final = log.stage(batch, "ranked", final)

    open_ = decided.where("gated").select("q", "turn")
    labels = B.feedback_labels(final.where("inside and gated").select("q", "id"), relevant.join(open_.select("q"), "q", "left_semi"))
    seen = final.select("q", "id", "rank", "signature", F.coalesce("protected", F.lit(False)).alias("protected"))
    events = log.stage(batch, "events", labels.join(open_, "q").join(seen, ["q", "id"], "left").fillna(False, ["protected"]))
    place = F.when(F.col("rank") >= 1 << TURN_BITS, F.raise_error(F.lit("a list is longer than a signature's sequence numbers allow"))).otherwise(F.col("rank"))
    by_memory = events.select(F.col("id").alias("memory_id"), F.col("turn").alias("seq"), "outcome", "protected")
    by_signature = events.where("signature is not null").select("signature", (F.shiftleft("turn", TURN_BITS) + place).alias("seq"), "outcome")
    new_memory = B.merge_state(memory.join(by_memory.select("memory_id"), "memory_id", "left_semi"), by_memory)
    new_signatures = B.merge_signatures(signatures.join(by_signature.select("signature"), "signature", "left_semi"), by_signature)
    log.commit(
        batch,
        {"memory": new_memory, "signature": new_signatures},
        {
            "memory": lambda: memory.join(by_memory.select("memory_id"), "memory_id", "left_anti").unionByName(new_memory),
            "signature": lambda: signatures.join(by_signature.select("signature"), "signature", "left_anti").unionByName(new_signatures),
        },
    )


def online_stream(queries: DataFrame, log: BatchLog, pairs: DataFrame, relevance: DataFrame, scorer: Callable[[], Column], policy: Policy, checkpoint: str) -> StreamingQuery:
    """The loop over a stream of queries: every micro-batch is one batch of the log."""
    step = lambda batch, number: run_batch(log, number, batch, pairs, relevance, scorer, policy)
    return queries.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


METRICS = ["recall_at_k", "mrr", "context_precision", "context_recall", "context_noise", "included_count"]
CONFIDENCE = ["top_score", "top_margin", "cutoff_margin", "score_spread", "cutoff_crowding"]


def parts(log: BatchLog, name: str) -> DataFrame:
    """A part of all committed batches."""
    return log.spark.read.parquet(*[f"{log.path}/batch={n}/{name}" for n in sorted(log.manifest())])


def metric_rows(log: BatchLog, policy: Policy) -> DataFrame:
    """One row per committed query: turn, gated, biased, the ranking metrics and the confidence of the evolved ranking."""
    rows, asked = parts(log, "ranked"), parts(log, "queries").select("q", "turn", "gated", "relevant_count")
    flags = rows.select("q", "id", "rank", F.col("hit").cast("int").alias("is_relevant"), F.col("inside").cast("int").alias("in_context"))
    metrics = flagged_metrics(asked, flags, asked.select("q", "relevant_count"), policy.top_k)
    confidence = B.confidence_features(ranked(rows.select("q", "id", F.col("base").alias("score")), "q"), policy.top_k)
    return asked.drop("relevant_count").join(metrics, "q").join(confidence, "q", "left").withColumn("biased", F.col("gated") & F.lit(policy.scale > 0))


def summary(log: BatchLog, policy: Policy) -> DataFrame:
    """(section, key, metric, value): metric averages overall and by halves of the loop, applied rates, confidence, role
    exposure, feedback and state counts of everything committed."""
    from memjoin.sources.jsonl import numbered

    rows = cut_lineage(metric_rows(log, policy).orderBy("turn"))
    count = rows.count()
    placed = numbered(rows).withColumn("first", F.col("pos") < max(1, count // 2))
    value = {name: F.col(name).cast("double") for name in METRICS + CONFIDENCE}
    windows = {"overall": F.lit(True), "first_half": F.col("first"), "second_half": ~F.col("first")}
    sums = placed.agg(
        *[F.coalesce(F.avg(F.when(keep, value[m])), F.lit(0.0)).alias(f"evolved/{w}/{m}") for w, keep in windows.items() for m in METRICS],
        *[F.coalesce(F.avg(value[m]), F.lit(0.0)).alias(f"confidence/overall/{m}") for m in CONFIDENCE],
        F.coalesce(F.avg(F.col("gated").cast("double")), F.lit(0.0)).alias("rate/state/applied"),
        F.coalesce(F.avg(F.col("biased").cast("double")), F.lit(0.0)).alias("rate/bias/applied"),
    )
    long = _long(sums, sums.columns)
    one = {"total": F.lit(1.0), "relevant": F.col("hit").cast("double"), "budget": F.col("inside").cast("double")}
    roles = parts(log, "ranked").groupBy("role").agg(*[F.sum(v).alias(c) for c, v in one.items()])
    whole = F.greatest(F.lit(1.0), "total")
    rated = roles.withColumn("relevant_rate", F.col("relevant") / whole).withColumn("budget_rate", F.col("budget") / whole)
    exposure = rated.select(F.lit("role").alias("section"), F.col("role").alias("key"), F.explode(F.create_map(*[x for c in ("total", "relevant", "budget", "relevant_rate", "budget_rate") for x in (F.lit(c), F.col(c))])).alias("metric", "value"))
    feedback = parts(log, "events").groupBy("outcome").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("feedback").alias("section"), F.col("outcome").alias("key"), F.lit("count").alias("metric"), "value")
    touched = [
        log.state(name, schema, key).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("state").alias("section"), F.lit(name).alias("key"), F.lit("touched").alias("metric"), "value")
        for name, schema, key in (("memory", MEMORY, "memory_id"), ("signature", SIGNATURE, "signature"))
    ]
    return long.unionByName(exposure).unionByName(feedback).unionByName(touched[0]).unionByName(touched[1])


def _long(row: DataFrame, names: list[str]) -> DataFrame:
    cells = [F.struct(*[F.lit(p).alias(a) for a, p in zip(("section", "key", "metric"), name.split("/"))], F.col(f"`{name}`").alias("value")) for name in names]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")

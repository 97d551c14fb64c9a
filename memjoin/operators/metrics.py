"""Retrieval metrics as one aggregation per query.

Ranked input: q, id, rank (score optional). Relevance: q, id. Context: q, id of the packed rows. Every query of
`queries` (q) gets a row, also one without a result or without relevant ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / max(1, whole)."""
    return part / F.greatest(whole, F.lit(1))


def flagged(ranked: DataFrame, relevance: DataFrame, context: DataFrame) -> DataFrame:
    """ranked + `is_relevant`, `in_context` as 0/1."""
    rel = relevance.select("q", "id").distinct().withColumn("is_relevant", F.lit(1))
    ctx = context.select("q", "id").distinct().withColumn("in_context", F.lit(1))
    return ranked.join(rel, ["q", "id"], "left").join(ctx, ["q", "id"], "left").fillna(0, ["is_relevant", "in_context"])


def relevant_counts(relevance: DataFrame) -> DataFrame:
    return relevance.groupBy("q").agg(F.countDistinct("id").alias("relevant_count"))


def ranked_metrics(queries: DataFrame, ranked: DataFrame, relevance: DataFrame, context: DataFrame, k: int) -> DataFrame:
    """recall@k, reciprocal rank, context precision / recall, noise; zeros for a query without relevant ids."""
    return flagged_metrics(queries, flagged(ranked, relevance, context), relevant_counts(relevance), k)


def flagged_metrics(queries: DataFrame, rows: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """`ranked_metrics` of rows that carry their flags; `relevant`: q, relevant_count."""
    top = F.col("rank") <= k
    sums = rows.groupBy("q").agg(
        F.sum((top & (F.col("is_relevant") == 1)).cast("int")).alias("hits"),
        F.min(F.when(F.col("is_relevant") == 1, F.col("rank"))).alias("first_hit"),
        F.sum("in_context").alias("included"),
        F.sum(F.col("in_context") * F.col("is_relevant")).alias("context_hits"),
    )
    base = queries.select("q").join(sums, "q", "left").join(relevant, "q", "left")
    base = base.fillna(0, ["hits", "included", "context_hits", "relevant_count"])
    has = F.col("relevant_count") > 0

    def guarded(value: Column) -> Column:
        return F.when(has, value).otherwise(F.lit(0.0))

    return base.select(
        "q",
        guarded(ratio(F.col("hits"), F.col("relevant_count"))).alias("recall_at_k"),
        guarded(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0))).alias("mrr"),
        guarded(ratio(F.col("context_hits"), F.col("included"))).alias("context_precision"),
        guarded(ratio(F.col("context_hits"), F.col("relevant_count"))).alias("context_recall"),
        guarded((F.col("included") - F.col("context_hits")).cast("double")).alias("context_noise"),
        F.col("included").cast("bigint").alias("included_count"),
        F.col("relevant_count").cast("bigint").alias("relevant_count"),
    )


def evidence_metrics(
    queries: DataFrame, ranked: DataFrame, relevance: DataFrame, coverage: DataFrame, context: DataFrame, hard: DataFrame, k: int
) -> DataFrame:
    """Recall and precision with coverage: a card counts for every id it covers (`coverage`: id, covered).

    `hard` (id) lists hard negatives. A query without relevant ids is an abstention query.
    """
    rel = relevance.select("q", F.col("id").alias("covered")).distinct()
    ctx = context.select("q", "id").distinct().withColumn("in_context", F.lit(1))
    rows = ranked.select("q", "id", "rank").join(ctx, ["q", "id"], "left").fillna(0, ["in_context"])
    rows = rows.join(hard.select("id").distinct().withColumn("is_hard", F.lit(1)), "id", "left").fillna(0, ["is_hard"])
    met = rows.join(coverage, "id").join(rel, ["q", "covered"])
    by_id = met.groupBy("q", "covered").agg(F.min("rank").alias("rank"), F.max("in_context").alias("in_context")).groupBy("q").agg(
        F.sum((F.col("rank") <= k).cast("int")).alias("hits"), F.sum("in_context").alias("context_hits"), F.min("rank").alias("first")
    )
    by_card = met.select("q", "id", "rank", "in_context").distinct().groupBy("q").agg(
        F.sum((F.col("rank") <= k).cast("int")).alias("items"), F.sum("in_context").alias("context_items")
    )
    sizes = rows.groupBy("q").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("rank") <= k).cast("int")).alias("top"),
        F.sum("in_context").alias("included"),
        F.sum(((F.col("rank") <= k) & (F.col("is_hard") == 1)).cast("int")).alias("hard_top"),
        F.sum(F.col("in_context") * F.col("is_hard")).alias("hard_context"),
    )
    base = queries.select("q").join(sizes, "q", "left").join(by_id, "q", "left").join(by_card, "q", "left").join(relevant_counts(relevance), "q", "left")
    base = base.fillna(0, ["n", "top", "included", "hard_top", "hard_context", "hits", "context_hits", "items", "context_items", "relevant_count"])
    has, c = F.col("relevant_count") > 0, F.col

    def known(value: Column) -> Column:
        return F.when(has, value).otherwise(F.lit(0.0))

    empty = (c("included") == 0).cast("double")
    return base.select(
        "q",
        known(ratio(c("hits"), c("relevant_count"))).alias("recall_at_k"),
        known(ratio(c("items"), F.least(F.lit(k), c("n")))).alias("precision_at_k"),
        known(F.coalesce(1.0 / c("first"), F.lit(0.0))).alias("mrr"),
        known(ratio(c("context_items"), c("included"))).alias("context_precision"),
        known(ratio(c("context_hits"), c("relevant_count"))).alias("context_recall"),
        F.when(has, c("included") - c("context_items")).otherwise(c("included")).cast("double").alias("context_noise"),
        c("included").cast("double").alias("included_count"),
        ratio(c("hard_top"), c("top")).alias("hard_negative_top_k_rate"),
        ratio(c("hard_context"), c("included")).alias("hard_negative_context_rate"),
        (~has).cast("double").alias("abstention_query"),
        F.when(has, 0.0).otherwise(1.0 - empty).alias("false_memory_rate"),
        F.when(has, 0.0).otherwise(empty).alias("no_relevant_context_rate"),
    )


def pool_stage_metrics(queries: DataFrame, relevance: DataFrame, coverage: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """Evidence present in the raw pool, the rerank pool and the top; where it got lost. `stages`: raw, pool, top (q, id)."""
    rel = relevance.select("q", F.col("id").alias("covered")).distinct()
    marked = rel
    for name, ids in stages.items():
        held = ids.select("q", "id").join(coverage, "id").select("q", "covered").distinct().withColumn(name, F.lit(1))
        marked = marked.join(held, ["q", "covered"], "left").fillna(0, [name])
    sums = marked.groupBy("q").agg(F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(s) for s in stages])
    base = queries.select("q").join(sums, "q", "left").fillna(0, ["n", *stages])
    return base.select(
        "q",
        ratio(F.col("raw"), F.col("n")).alias("raw_rate"),
        ratio(F.col("pool"), F.col("n")).alias("pool_rate"),
        (F.col("n") - F.col("raw")).cast("double").alias("missing_from_raw"),
        F.greatest(F.lit(0), F.col("raw") - F.col("pool")).cast("double").alias("lost_before_pool"),
        F.greatest(F.lit(0), F.col("pool") - F.col("top")).cast("double").alias("ranked_out"),
    )


def session_metrics(queries: DataFrame, ranked: DataFrame, relevance: DataFrame, context: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """Recall at k, 16 and 32, precision, context and per-source evidence. `ranked`: q, id, rank, cost; `sources`: q, id, source."""
    rows = flagged(ranked, relevance, context)
    rel, ctx = F.col("is_relevant") == 1, F.col("in_context") == 1

    def count(condition: Column) -> Column:
        return F.sum(condition.cast("int"))

    sums = rows.groupBy("q").agg(
        count(rel).alias("pool_hits"),
        *[count(rel & (F.col("rank") <= n)).alias(f"hits_{n}") for n in (k, 16, 32)],
        count(F.col("rank") <= k).alias("top"),
        count(ctx).alias("included"),
        count(ctx & rel).alias("context_hits"),
        F.sum(F.when(ctx, F.col("cost")).otherwise(0)).alias("tokens"),
    )
    names = ["token", "vector"]
    by_source = (
        sources.join(relevance, ["q", "id"], "left_semi").groupBy("q").pivot("source", names).agg(F.countDistinct("id"))
    )
    base = queries.select("q").join(sums, "q", "left").join(relevant_counts(relevance), "q", "left").join(by_source, "q", "left")
    base = base.fillna(0)
    n, c = F.col("relevant_count"), F.col
    return base.select(
        "q",
        ratio(c("pool_hits"), n).alias("evidence_in_pool"),
        *[ratio(c(f"hits_{m}"), n).alias(f"recall_at_{m}") for m in (k, 16, 32)],
        ratio(c(f"hits_{k}"), F.least(F.lit(k), c("top"))).alias("precision_at_k"),
        ratio(c("context_hits"), n).alias("context_recall"),
        ratio(c("context_hits"), c("included")).alias("context_precision"),
        c("tokens").cast("double").alias("context_token_count"),
        c("included").cast("double").alias("included_count"),
        (c("context_hits") == 0).cast("double").alias("no_relevant_context_rate"),
        (c(f"hits_{k}") > 0).cast("double").alias("hit_any_relevant"),
        (c(f"hits_{k}") == n).cast("double").alias("all_relevant_found"),
        *[ratio(c(s), n).alias(f"evidence_in_{s}") for s in names],
    )


def growth_retention(queries: DataFrame, base: DataFrame, grown: DataFrame, relevance: DataFrame, n: int) -> DataFrame:
    """How a ranking changed between two runs, by a full join on (q, id). Both: q, id, rank."""
    rel = relevance.select("q", "id").distinct().withColumn("is_relevant", F.lit(1))
    both = (
        base.select("q", "id", F.col("rank").alias("before"))
        .join(grown.select("q", "id", F.col("rank").alias("after")), ["q", "id"], "full_outer")
        .join(rel, ["q", "id"], "left")
    )
    kept, had = F.col("after").isNotNull(), F.col("before").isNotNull()
    top = had & (F.col("before") <= n)
    relevant = had & F.col("is_relevant").isNotNull()

    def count(condition: Column) -> Column:
        return F.sum(F.coalesce(condition, F.lit(False)).cast("int"))

    sums = both.groupBy("q").agg(
        count(relevant).alias("rel"), count(relevant & kept).alias("rel_kept"), count(top).alias("top"), count(top & kept).alias("top_kept"),
        count(top & kept & (F.col("before") != F.col("after"))).alias("moved"), count(had & ~kept).alias("dropped"), count(kept & ~had).alias("added"),
    )
    base_ = queries.select("q").join(sums, "q", "left").fillna(0)
    c = F.col

    def share(part: str, whole: str) -> Column:
        return F.when(c(whole) == 0, 1.0).otherwise(c(part) / F.greatest(c(whole), F.lit(1)))

    return base_.select(
        "q", share("rel_kept", "rel").alias("relevant_retention"), share("top_kept", "top").alias("top_retention"),
        ratio(c("moved"), c("top_kept")).alias("position_change_rate"), c("dropped").cast("double").alias("dropped"), c("added").cast("double").alias("added"),
    )


def signature(ranked: DataFrame, places: int = 12) -> DataFrame:
    """(q, signature): digest of the ordered (id, rounded score) list of every query."""
    entry = F.struct(F.col("rank"), F.concat_ws(":", F.col("id").cast("string"), F.format_string(f"%.{places}f", F.round("score", places))).alias("s"))
    listed = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["s"])
    return ranked.groupBy("q").agg(F.md5(F.array_join(listed, " ")).alias("signature"))

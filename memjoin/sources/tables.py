"""The supplied tables in the roles of the data model (memory cards, queries, relevance, turns, feedback)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memjoin.operators.lexical import verbatim_hits

LANGS = ("en", "fr", "de", "es")
PROJECTS = 20
USERS = 13


WIDE_TEXT = {"documents", "pages"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return widen(df) if name in WIDE_TEXT else df


def widen(df: DataFrame) -> DataFrame:
    """In local sessions, spread a table of one row group over the cores; on a cluster a scan keeps its splits."""
    context = df.sparkSession.sparkContext
    return df.repartition(context.defaultParallelism) if context.master.startswith("local[") else df


def card_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text) of the memory cards, for rankings that need nothing else."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def memories(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """`documents` as memory cards; usage state is arithmetic over the row, outcomes come from `labels`.

    With `only` (id), nothing but those cards is joined.
    """
    docs = table(spark, sf_dir, "documents")
    if only is not None:
        docs = docs.join(only.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    labels = table(spark, sf_dir, "labels")
    outcome = (
        F.when(F.col("toxic") == 1, "ignored").when(F.col("quality") == 1, "helpful").when(F.col("quality") == 0, "corrected").otherwise("")
    )
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        "text",
        F.lit("").alias("summary"),
        F.col("source").alias("project"),
        F.col("source").alias("cluster"),
        F.col("lang").alias("brand"),
        F.concat(F.lit("user_"), (F.col("doc_id") % USERS).cast("string")).alias("user_id"),
        ((F.col("doc_id") * 37) % 11 / 10.0).alias("importance"),
        ((F.col("n_chars") * 7 + F.col("doc_id")) % 500).alias("age_days"),
        ((F.col("doc_id") * 13 + F.col("n_chars")) % 9).alias("use_count"),
        (F.col("n_chars") % 5).alias("evidence_count"),
        outcome.alias("last_outcome"),
        (F.col("doc_id") % 17 == 0).alias("protected"),
    )


def queries(spark: SparkSession, sf_dir: str, budget: int = 900) -> DataFrame:
    """`benchmark` passages as retrieval tasks."""
    item = F.col("item_id")
    brand = F.element_at(F.array(*[F.lit(x) for x in LANGS]), (item % len(LANGS) + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select(
        item.alias("q"),
        F.col("text"),
        F.concat(F.lit("user_"), (item % USERS).cast("string")).alias("user_id"),
        F.concat(F.lit("src"), (item % PROJECTS).cast("string")).alias("project_id"),
        brand.alias("brand"),
        F.lit(budget).cast("bigint").alias("budget"),
    )


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, id): documents holding the query passage verbatim."""
    return verbatim_hits(card_texts(spark, sf_dir), queries(spark, sf_dir).select("q", "text"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`conversations` as one card per turn: uid, session, position, id."""
    conv, turn = F.col("conv_id"), F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        conv.alias("uid"),
        turn.alias("pos"),
        F.concat(conv.cast("string"), F.lit("_t"), F.lpad(turn.cast("string"), F.greatest(F.lit(4), F.length(turn.cast("string"))), "0")).alias("id"),
        (turn / F.lit(3)).cast("bigint").alias("session"),
        F.col("role").alias("speaker"),
        "text",
    )


# Event type -> feedback outcome.
EVENT_OUTCOME = {"view": "helpful", "click": "helpful", "purchase": "corrected", "error": "ignored"}


def feedback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as feedback on memory user_id, ordered by (ts, event_id)."""
    outcome = F.lit(None).cast("string")
    for kind, name in EVENT_OUTCOME.items():
        outcome = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(outcome)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("memory_id"),
        F.col("ts"),
        F.col("event_id").alias("seq"),
        outcome.alias("outcome"),
        (F.col("value") > 40.0).alias("protected"),
    ).where(F.col("outcome").isNotNull())


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")

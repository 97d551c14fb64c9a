"""Labelling prompts and dataset exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memjoin.operators.fields import registry_json

# Item id patterns.
QUERY_ITEM = r"^(query|evidence|hard)::(\d+)"
BACKGROUND_ITEM = r"^background::(\d+)$"
HARD_SLOTS = 12


def prompt(items: DataFrame, registry: DataFrame, text: str = "text") -> DataFrame:
    """Items with `prompt`: the registry JSON and the text. The registry is one row, read as a scalar."""
    known = registry_json(registry).scalar()
    return items.withColumn(
        "prompt", F.concat_ws("\n", F.lit("Known field registry:"), known, F.lit(""), F.lit("Text to label:"), F.coalesce(F.col(text), F.lit("")))
    )


def item_kind(identifier: Column) -> Column:
    out = F.lit("unknown")
    for prefix, kind in (("query", "query"), ("evidence", "evidence"), ("hard", "hard_negative"), ("background", "background")):
        out = F.when(identifier.startswith(f"{prefix}::"), kind).otherwise(out)
    return out


def query_index(identifier: Column) -> Column:
    return F.when(identifier.rlike(QUERY_ITEM), F.regexp_extract(identifier, QUERY_ITEM, 2).try_cast("bigint"))


def item_split(identifier: Column, train_queries: int, holdout_start: int, holdout_queries: int, train_background: int, holdout_background: int) -> Column:
    """train, holdout or unused, from the number inside the id."""
    index = query_index(identifier)
    background = F.when(identifier.rlike(BACKGROUND_ITEM), F.regexp_extract(identifier, BACKGROUND_ITEM, 1).try_cast("bigint"))
    by_query = F.when(index < train_queries, "train").when((index >= holdout_start) & (index < holdout_start + holdout_queries), "holdout").otherwise("unused")
    by_background = F.when(background < train_background, "train").when(background < train_background + holdout_background, "holdout").otherwise("unused")
    return F.when(index.isNotNull(), by_query).when(background.isNotNull(), by_background).otherwise("unused")


def label_rows(items: DataFrame, cached: DataFrame, dataset_version: str, keep_missing: bool = False) -> DataFrame:
    """Split items (item_id, text, split, kind) with their cached predictions; items without any are dropped unless asked for."""
    joined = items.where((F.col("split") != "unused") & (F.col("text") != "")).join(cached.select("item_id", "fields"), "item_id", "left")
    if not keep_missing:
        joined = joined.where(F.size("fields") > 0)
    return joined.select(
        F.lit(dataset_version).alias("dataset_version"), "split", "kind", "item_id", query_index(F.col("item_id")).alias("query_index"), "text", "fields"
    )


def chat_rows(labels: DataFrame, system: str, prompts: DataFrame) -> DataFrame:
    """(messages, metadata) rows: system, user prompt, and the fields as the answer."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    answer = F.concat(F.lit('{"fields":'), F.to_json("fields"), F.lit("}"))
    return labels.join(prompts.select("item_id", "prompt"), "item_id").select(
        F.array(message("system", F.lit(system)), message("user", F.col("prompt")), message("assistant", answer)).alias("messages"),
        F.struct("dataset_version", "split", "kind", "item_id", "query_index").alias("metadata"),
    )


def retrieval_pairs(queries: DataFrame, memories: DataFrame, dataset_version: str) -> DataFrame:
    """Query x (relevant ids and its hard slots) joined to the memories that exist.

    `queries`: query_id, query_index, split, text, relevant_ids; `memories`: id, text, fields.
    """
    slots = F.transform(
        F.sequence(F.lit(0), F.lit(HARD_SLOTS - 1)), lambda s: F.concat(F.lit("hard::"), F.col("query_index").cast("string"), F.lit("::"), s.cast("string"))
    )
    asked = queries.where(F.col("split") != "unused").select(
        "query_id", "split", F.col("text").alias("query_text"), "relevant_ids", F.explode(F.concat("relevant_ids", slots)).alias("candidate_id")
    )
    evidence = F.array_contains("relevant_ids", F.col("candidate_id"))
    return asked.join(memories.withColumnRenamed("id", "candidate_id").withColumnRenamed("text", "candidate_text"), "candidate_id").select(
        F.lit(dataset_version).alias("dataset_version"),
        "split",
        "query_id",
        "query_text",
        "candidate_id",
        "candidate_text",
        F.when(evidence, "evidence").otherwise("hard_negative").alias("candidate_kind"),
        evidence.alias("is_evidence"),
        evidence.cast("double").alias("include_label"),
    )


def triplets(df: DataFrame, per_positive: int, prefix: str = "") -> DataFrame:
    """(anchor, positive, negative): `per_positive` negatives per positive, taken round-robin from the query's list.

    `df`: q, query, positives array<string>, negatives array<string>. Rows with an empty side give nothing.
    """

    def shown(text: Column) -> Column:
        flat = F.trim(F.regexp_replace(text, r"\s+", " "))
        return F.concat(F.lit(f"{prefix}: "), flat) if prefix else flat

    usable = df.where((F.trim("query") != "") & (F.size("positives") > 0) & (F.size("negatives") > 0))
    rows = usable.select("q", "query", "negatives", F.posexplode("positives").alias("p", "positive"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(per_positive - 1))).alias("o"))
    pick = F.pmod(F.col("p") * per_positive + F.col("o"), F.size("negatives"))
    return rows.select("q", "p", "o", shown(F.col("query")).alias("anchor"), shown(F.col("positive")).alias("positive"), shown(F.get("negatives", pick)).alias("negative"))


DATASETS = {  # dataset family -> the columns that name one of its rows
    "field_labels": ["split", "kind", "item_id"],
    "sft": ["metadata.split", "metadata.kind", "metadata.item_id"],
    "retrieval_pairs": ["split", "query_id", "candidate_id", "is_evidence"],
}
SPLITS = ("train", "holdout")
MANIFEST = "dataset string, rows bigint, checksum bigint, path string"


def row_checksum(names: list[str]) -> Column:
    """A number of 32 bits for what names a row; sums of it do not depend on order."""
    key = F.concat_ws("|", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names])
    return F.conv(F.substring(F.md5(F.encode(key, "UTF-8")), 1, 8), 16, 10).cast("bigint")


def export_datasets(families: dict[str, DataFrame], path: str, version: str) -> DataFrame:
    """Write every family once, partitioned by split, and a manifest beside them; the manifest as (dataset, rows, checksum, path).

    Seven datasets: all, train and holdout of the field labels, train and holdout of the chat rows and of the retrieval pairs.
    A split is a folder of its family, so no row is written twice; counts and checksums are read back from what was written.
    """
    spark = next(iter(families.values())).sparkSession
    entries = None
    for family, names in DATASETS.items():
        rows = families[family]
        split = F.col(names[0])
        rows.withColumn("split_name", split).where(split.isin(*SPLITS)).write.partitionBy("split_name").json(f"{path}/{family}")
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        back = spark.read.schema(f"{kinds}, split_name string").json(f"{path}/{family}")
        sums = back.groupBy("split_name").agg(F.count(F.lit(1)).alias("rows"), F.sum(row_checksum(names)).alias("checksum"))
        wanted = spark.createDataFrame([(name,) for name in SPLITS], "split_name string")
        full = wanted.join(sums, "split_name", "left").fillna(0, ["rows", "checksum"])
        parts = full.select(F.concat(F.lit(f"{family}_"), "split_name").alias("dataset"), "rows", "checksum", F.concat(F.lit(f"{path}/{family}/split_name="), "split_name").alias("path"))
        if family == "field_labels":
            whole = full.agg(F.sum("rows").alias("rows"), F.sum("checksum").alias("checksum"))
            parts = parts.unionByName(whole.select(F.lit(f"{family}_all").alias("dataset"), "rows", "checksum", F.lit(f"{path}/{family}").alias("path")))
        entries = parts if entries is None else entries.unionByName(parts)
    entries.withColumn("dataset_version", F.lit(version)).coalesce(1).write.json(f"{path}/manifest")
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")

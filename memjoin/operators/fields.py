"""Field predictions over text, the field registry and derived metadata.

A prediction row is (item, field, value, confidence, span). The registry is a small table of field definitions; its
distinct values live in a table of their own, (field, value), because they grow with the data.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memjoin.functions.text import squeeze

# Extraction patterns, word lists, marker terms, confidences and the seed registry.
PROMPT_VERSION = "field-classifier-v1"
SESSION_PATTERN = r"\buser_\d{3}_project_\d{3}_[a-z0-9_:-]+\b"
BRANDS = ["aurora", "cinder", "northstar", "ember", "harbor", "kinetic", "mosaic", "signal"]
TOOLS = ["qwen", "figma", "slack", "jira", "github", "bigquery", "drive", "salesforce"]
COLORS = ["teal", "black", "white", "coral", "navy", "silver", "lime", "violet", "amber", "graphite"]
TONES = ["concise", "formal", "technical", "plainspoken", "visual", "compliance-first", "executive"]
CURRENT_TERMS = ["current", "accepted", "now", "latest"]
STALE_TERMS = ["older", "old", "stale", "previous", "superseded"]
CORRECTION_SIGNALS = ["correction", "corrected", "superseded", "override"]
SEED_FIELDS = {
    "user_id": (["user", "person"], "Stable user identifier"),
    "project": (["workstream", "project_id"], "Project or bounded work objective"),
    "brand": (["company", "client_brand"], "Brand or customer identity"),
    "session_id": (["session"], "Conversation or event session"),
    "entity": (["named_entity"], "Named entity useful for retrieval"),
    "preference": (["constraint", "likes"], "Preference or constraint"),
    "correction": (["supersedes", "override"], "Correction or supersession signal"),
    "tool": (["software", "system"], "Tool or platform mentioned"),
    "time_scope": (["recency", "temporal_scope"], "Temporal scope such as current or stale"),
    "topic": (["subject"], "Main topic or task"),
}
PROMOTION = {"min_count": 25, "min_confidence": 0.82, "min_distinct": 5, "min_lift": 0.03, "max_hard_delta": 0.01}

PREDICTION = "array<struct<field:string,value:string,confidence:double,span:string>>"


def normal_name(name: Column) -> Column:
    """Lower-case, other characters to `_`, runs collapsed, ends stripped."""
    plain = F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9_]+", "_")
    return F.regexp_replace(F.regexp_replace(plain, "_+", "_"), "^_|_$", "")


def normal_value(value: Column) -> Column:
    return squeeze(value)


def bounded_confidence(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def seed_registry(spark: SparkSession) -> DataFrame:
    """The ten built-in fields, all promoted at version 1."""
    rows = [
        (name, sorted(aliases), text, [], "promoted", 1, 0, 0.0, 0, 0.0, 0.0) for name, (aliases, text) in sorted(SEED_FIELDS.items())
    ]
    return spark.createDataFrame(
        rows,
        "name string, aliases array<string>, description string, examples array<string>, status string, version int, "
        "seen_count bigint, confidence_sum double, distinct_count bigint, validation_lift double, hard_negative_delta double",
    )


def _found(field: str, value: Column, confidence: float, span: Column | None = None) -> Column:
    return F.struct(
        F.lit(field).alias("field"), value.alias("value"), F.lit(confidence).alias("confidence"), (value if span is None else span).alias("span")
    )


def one_of(options: list[str]) -> str:
    """A whole-word pattern of all options that looks at a word's first letter before it tries any of them."""
    tails = {head: sorted(o[1:] for o in options if o[0] == head) for head in sorted({o[0] for o in options})}
    return f"(?=[{''.join(tails)}])" + r"\b(?:" + "|".join(f"{head}(?:{'|'.join(ends)})" for head, ends in tails.items()) + r")\b"


# All words of the rules in one pass: none of them can start inside another one, so they are the same as one by one.
WORD_PATTERN = one_of([*BRANDS, *TOOLS, *COLORS, *TONES, r"user_\d{3}", r"project_\d{3}"])


def marks(items: DataFrame, item: str, text: str = "text") -> DataFrame:
    """(item, words, sessions, current, stale, corrects): what the rules look for, every text lowered and searched once."""
    lowered = items.select(F.col(item).alias("item"), F.lower(F.col(text)).alias("lowered"))

    def found(expression: str) -> Column:
        return F.array_distinct(F.regexp_extract_all("lowered", F.lit(expression), F.lit(0)))

    def holds(terms: list[str]) -> Column:
        return reduce(Column.__or__, [F.col("lowered").contains(t) for t in terms])

    return lowered.select(
        "item", found(WORD_PATTERN).alias("words"), found(SESSION_PATTERN).alias("sessions"),
        holds(CURRENT_TERMS).alias("current"), holds(STALE_TERMS).alias("stale"), holds(CORRECTION_SIGNALS).alias("corrects"),
    )


def rule_predictions() -> Column:
    """array<struct<field, value, confidence, span>> from the columns of `marks`, each distinct."""

    def listed(options: list[str]) -> Column:
        return F.filter("words", lambda w: w.isin(options))

    def numbered(prefix: str) -> Column:
        return F.filter("words", lambda w: w.startswith(prefix))

    def flag(field: str, value: str, confidence: float, hit: str) -> Column:
        none = F.array().cast(PREDICTION)
        return F.when(F.col(hit), F.array(_found(field, F.lit(value), confidence)).cast(PREDICTION)).otherwise(none)

    parts = [
        F.transform(numbered("user_"), lambda v: _found("user_id", v, 0.96)),
        F.transform(numbered("user_"), lambda v: _found("entity", v, 0.82)),
        F.transform(numbered("project_"), lambda v: _found("project", v, 0.96)),
        F.transform(numbered("project_"), lambda v: _found("entity", v, 0.84)),
        F.transform("sessions", lambda v: _found("session_id", v, 0.88)),
        F.transform(listed(BRANDS), lambda v: _found("brand", v, 0.92)),
        F.transform(listed(BRANDS), lambda v: _found("entity", v, 0.80)),
        F.transform(listed(TOOLS), lambda v: _found("tool", v, 0.84)),
        F.transform(listed(COLORS), lambda v: _found("preference", F.concat(F.lit("color:"), v), 0.74, v)),
        F.transform(listed(TONES), lambda v: _found("preference", F.concat(F.lit("tone:"), v), 0.72, v)),
        flag("time_scope", "current", 0.78, "current"),
        flag("time_scope", "stale", 0.78, "stale"),
        flag("correction", "has_correction_signal", 0.80, "corrects"),
    ]
    return F.concat(*[p.cast(PREDICTION) for p in parts])


def extract(items: DataFrame, item: str, text: str = "text") -> DataFrame:
    """(item, pos, field, value, confidence, span): one row per rule prediction."""
    return marks(items, item, text).select("item", F.posexplode(rule_predictions()).alias("pos", "p")).select("item", "pos", "p.*")


def parsed_predictions(payload: Column) -> Column:
    """Predictions out of a JSON list, `{fields: [...]}` or `{predictions: [...]}`; empty and unsure ones dropped."""
    entry = "array<struct<field:string,field_name:string,value:string,confidence:double,source_span:string,span:string>>"
    as_object = F.from_json(payload, f"struct<fields:{entry},predictions:{entry}>")
    as_list = F.from_json(payload, entry)
    filled = F.when(F.size(as_object["fields"]) > 0, as_object["fields"]).otherwise(as_object["predictions"])
    entries = F.when(F.ltrim(payload).startswith("["), as_list).otherwise(filled)

    def text_or(*options: Column) -> Column:
        return F.coalesce(*[F.when(o != "", o) for o in options], F.lit(""))

    shaped = F.transform(
        F.coalesce(entries, F.array().cast(entry)),
        lambda e: F.struct(
            normal_name(F.coalesce(e["field"], e["field_name"], F.lit(""))).alias("field"),
            normal_value(F.coalesce(e["value"], F.lit(""))).alias("value"),
            bounded_confidence(F.coalesce(e["confidence"], F.lit(0.0))).alias("confidence"),
            text_or(e["source_span"], e["span"], e["value"]).alias("span"),
        ),
    )
    return F.filter(shaped, lambda p: (p["field"] != "") & (p["value"] != "") & (p["confidence"] > 0))


def stable_predictions(predictions: DataFrame) -> DataFrame:
    """Highest confidence per (item, field, value), the earliest of equals."""
    best = F.max_by(F.struct("confidence", "span", "pos"), F.struct("confidence", -F.col("pos")))
    return predictions.groupBy("item", "field", "value").agg(best.alias("b")).select("item", "field", "value", "b.confidence", "b.span")


def resolved(predictions: DataFrame, registry: DataFrame) -> DataFrame:
    """Field names mapped to the registered name: itself if known, else the first field listing it as an alias."""
    known = registry.select(F.col("name").alias("known"))
    alias = registry.select("name", F.explode("aliases").alias("wanted")).groupBy("wanted").agg(F.min("name").alias("owner"))
    named = predictions.withColumn("wanted", normal_name(F.col("field")))
    return (
        named.join(known, F.col("wanted") == F.col("known"), "left")
        .join(alias, "wanted", "left")
        .withColumn("field", F.coalesce("known", "owner", "wanted"))
        .drop("known", "owner", "wanted")
    )


def field_values(predictions: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(field, value): every different value, with those of the `known` table."""
    values = predictions.select("field", "value")
    return (values if known is None else values.unionByName(known.select("field", "value"))).distinct()


def count_fields(predictions: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(field, seen, confidence, fresh): rows, confidences and values that the `known` (field, value) table does not hold.

    Partial sums per task; values are deduplicated before they are counted.
    """
    per_value = predictions.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("c"))
    if known is not None:
        per_value = per_value.join(known.select("field", "value", F.lit(0).alias("new")), ["field", "value"], "left")
    new = F.coalesce("new", F.lit(1)) if known is not None else F.lit(1)
    return per_value.groupBy("field").agg(F.sum("n").alias("seen"), F.sum("c").alias("confidence"), F.sum(new).alias("fresh"))


def record_predictions(registry: DataFrame, predictions: DataFrame, known: DataFrame | None = None, version: int = 1) -> DataFrame:
    """Registry with the counters of these (resolved) predictions added; unknown fields enter as proposed.

    `known` is the (field, value) table of what the registry has counted (`field_values`), so that values of several
    batches add up in any order; `version` is the registry's own, which new fields take.
    """
    joined = registry.join(count_fields(predictions, known), F.col("name") == F.col("field"), "full_outer")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        F.coalesce("name", "field").alias("name"),
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("examples", F.array().cast("array<string>")).alias("examples"),
        F.coalesce("status", F.lit("proposed")).alias("status"),
        F.coalesce("version", F.lit(version)).alias("version"),
        (F.coalesce("seen_count", zero) + F.coalesce("seen", zero)).alias("seen_count"),
        F.round(F.coalesce("confidence_sum", F.lit(0.0)) + F.coalesce("confidence", F.lit(0.0)), 8).alias("confidence_sum"),
        (F.coalesce("distinct_count", zero) + F.coalesce("fresh", zero)).alias("distinct_count"),
        F.coalesce("validation_lift", F.lit(0.0)).alias("validation_lift"),
        F.coalesce("hard_negative_delta", F.lit(0.0)).alias("hard_negative_delta"),
    )


def raised_version(before: DataFrame, after: DataFrame, version: int = 1) -> int:
    """The registry's version after promotion: one more if any field was promoted."""
    done = F.col("status") == "promoted"
    return version + int(not after.where(done).join(before.where(done), "name", "left_anti").isEmpty())


def promote_ready(registry: DataFrame, lifts: DataFrame, hard_deltas: DataFrame, limits: dict[str, float] = PROMOTION, version: int = 1) -> DataFrame:
    """Promote fields that pass every gate; they take the version after the registry's own, `version`."""
    joined = (
        registry.join(lifts.select(F.col("field").alias("name"), F.col("value").alias("lift")), "name", "left")
        .join(hard_deltas.select(F.col("field").alias("name"), F.col("value").alias("hard")), "name", "left")
        .fillna(0.0, ["lift", "hard"])
    )
    mean = F.col("confidence_sum") / F.greatest(F.col("seen_count"), F.lit(1))
    ready = (
        (F.col("status") != "promoted")
        & (F.col("seen_count") >= limits["min_count"])
        & (F.round(mean, 9) >= limits["min_confidence"])
        & (F.col("distinct_count") >= limits["min_distinct"])
        & (F.col("lift") >= limits["min_lift"])
        & (F.col("hard") <= limits["max_hard_delta"])
    )
    flagged = joined.withColumn("ready", ready)
    return flagged.select(
        *[c for c in registry.columns if c not in ("status", "version", "validation_lift", "hard_negative_delta")],
        F.when(F.col("ready"), "promoted").otherwise(F.col("status")).alias("status"),
        F.when(F.col("ready"), F.lit(version + 1)).otherwise(F.col("version")).alias("version"),
        F.when(F.col("ready"), F.col("lift")).otherwise(F.col("validation_lift")).alias("validation_lift"),
        F.when(F.col("ready"), F.col("hard")).otherwise(F.col("hard_negative_delta")).alias("hard_negative_delta"),
    )


def derived_metadata(predictions: DataFrame, registry: DataFrame, source_type: str = "rule", teacher_version: str = PROMPT_VERSION, schema_version: int = 1) -> DataFrame:
    """(item, fields, source_type, teacher_version, schema_version): map of promoted field -> predictions ordered by value."""
    promoted = registry.where(F.col("status") == "promoted").select(F.col("name").alias("field"))
    entry = F.struct("value", F.round("confidence", 8).alias("confidence"), "span")
    per_field = (
        predictions.join(promoted, "field", "left_semi").groupBy("item", "field").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    )
    out = per_field.groupBy("item").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "entries")))).alias("fields"))
    return out.select("item", "fields", F.lit(source_type).alias("source_type"), F.lit(teacher_version).alias("teacher_version"), F.lit(schema_version).cast("bigint").alias("schema_version"))


def registry_json(registry: DataFrame) -> DataFrame:
    """One row: the registry as sorted compact JSON of name, aliases, description and status."""
    entry = F.struct("aliases", "description", "name", "status")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col("name").alias("k"), entry.alias("e")))), lambda x: x["e"])
    return registry.agg(F.to_json(ordered).alias("registry"))


def stable_key(text: Column) -> Column:
    """Cache key of a text alone: sha256 of canonical JSON with non-ASCII escaped."""
    return _digest({"cache_key_mode": "stable-text-v1", "prompt_version": PROMPT_VERSION})(text)


def registry_key(text: Column, version: int, fields: list[str]) -> Column:
    """Cache key of a text under a registry version and its field names."""
    return _digest({"prompt_version": PROMPT_VERSION, "registry_version": version, "fields": sorted(fields)})(text)


def _digest(fixed: dict):
    @F.arrow_udf(T.StringType())
    def digest(batch: pa.Array) -> pa.Array:
        def one(text):
            body = json.dumps({**fixed, "text": text or ""}, sort_keys=True, separators=(",", ":"))
            return hashlib.sha256(body.encode()).hexdigest()

        return pa.array([one(t) for t in batch.to_pylist()], pa.string())

    return digest


def cached_predictions(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Items (item, registry_key, stable_key) with the cached predictions: by registry key, else by stable key, else none."""
    by_registry = cache.select(F.col("key").alias("registry_key"), F.col("predictions").alias("first"))
    by_text = cache.select(F.col("key").alias("stable_key"), F.col("predictions").alias("second"))
    joined = items.join(by_registry, "registry_key", "left").join(by_text, "stable_key", "left")
    return joined.withColumn("predictions", F.coalesce("first", "second")).drop("first", "second")

"""Roll-ups of metric rows: quantiles, bootstrap, thresholds, gates, leaderboards."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memjoin.session import cut_lineage
from memjoin.sources.jsonl import numbered

# Leaderboard weights and the ten quality gates (scenario, corruption, metric, op, threshold).
LEADERBOARD = {"recall_at_k": 0.28, "precision_at_k": 0.24, "context_precision": 0.22, "mrr": 0.16, "context_recall": 0.10, "hard_negative_top_k_rate": -0.18}
QUALITY_GATES = [
    ("adversarial_recall_gain", "adversarial", "*", "recall_at_k", ">=", 0.01),
    ("adversarial_precision_non_negative", "adversarial", "*", "context_precision", ">=", 0.0),
    ("adversarial_noise_reduction", "adversarial", "*", "noise", "<=", 0.0),
    ("adversarial_strong_noise_reduction", "adversarial", "strong", "noise", "<=", -0.2),
    ("preference_clean_precision_floor", "preference_shift", "none", "context_precision", ">=", -0.02),
    ("preference_clean_noise_ceiling", "preference_shift", "none", "noise", "<=", 0.05),
    ("preference_mild_precision_floor", "preference_shift", "mild", "context_precision", ">=", -0.02),
    ("preference_mild_noise_ceiling", "preference_shift", "mild", "noise", "<=", 0.05),
    ("preference_strong_recall_gain", "preference_shift", "strong", "recall_at_k", ">=", 0.02),
    ("preference_strong_noise_reduction", "preference_shift", "strong", "noise", "<=", 0.0),
]


def long_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per metric column: keys, metric, value."""
    names = [c for c in df.columns if c not in keys]
    return df.unpivot(keys, [F.col(n).cast("double").alias(n) for n in names], "metric", "value")


def ceil_place(q: float, n: Column) -> Column:
    """Nearest rank: ceil(q n) - 1, inside the range."""
    return F.least(n - 1, F.greatest(F.lit(0), F.ceil(F.round(F.lit(q) * n, 9)) - 1))


def floor_place(q: float, n: Column) -> Column:
    return F.least(n - 1, F.floor(F.round(F.lit(q) * (n - 1), 9)))


def round_place(q: float, n: Column) -> Column:
    """Half-to-even rounding of q (n - 1)."""
    return F.least(n - 1, F.rint(F.round(F.lit(q) * (n - 1), 9)).cast("bigint"))


def exact_quantiles(df: DataFrame, group: str, value: str, wanted: dict[str, tuple[float, object]], stats: bool = False) -> DataFrame:
    """group + one column per (quantile, place rule), with avg, min and max if asked for.

    One distributed sort numbers all groups at once, so a group of any size never meets in one task.
    """
    placed = numbered(cut_lineage(df.select(group, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull()).orderBy(group, "v")))
    bounds = placed.groupBy(group).agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("n"))
    joined = placed.join(bounds, group).withColumn("at", F.col("pos") - F.col("start"))
    plain = [F.avg("v").alias("avg"), F.min("v").alias("min"), F.max("v").alias("max")] if stats else []
    return joined.groupBy(group).agg(*[F.max(F.when(F.col("at") == rule(q, F.col("n")), F.col("v"))).alias(name) for name, (q, rule) in wanted.items()], *plain)


def metric_rollup(long: DataFrame, p50_rule=ceil_place) -> DataFrame:
    """(metric, avg, p50, p95, min, max) in one pass over the sorted values."""
    return exact_quantiles(long, "metric", "value", {"p50": (0.5, p50_rule), "p95": (0.95, ceil_place)}, stats=True)


PRIME, SPREAD, MIXES = (1 << 31) - 1, 1_000_003, (12345, 54321)  # fixed values of the resampling hash
# A row enters a resample as often as a Poisson variable of mean one says: the hash is compared with its distribution function.
COUNTS = [math.floor(PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(10)]
RESAMPLE_ROWS = 4096


def resample_sums(repeats: int):
    """Task function: rows (key, metric, value) -> (metric, rep, weight, total), one row for each metric, resample and task."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        reps = np.arange(repeats, dtype=np.int64) * SPREAD
        for batch in batches:
            metric = batch.column("metric").dictionary_encode()
            codes, names = metric.indices.to_numpy(zero_copy_only=False), metric.dictionary.to_pylist()
            keys, values = batch.column("key").to_numpy(zero_copy_only=False), batch.column("value").to_numpy(zero_copy_only=False)
            for at in range(0, batch.num_rows, RESAMPLE_ROWS):
                part = slice(at, at + RESAMPLE_ROWS)
                mixed = (reps + keys[part, None]) % PRIME
                for step in MIXES:
                    mixed = (mixed * mixed + mixed * step + 7) % PRIME
                weight = np.searchsorted(COUNTS, mixed, side="right").astype(np.float64)
                for code in np.unique(codes[part]):
                    own = codes[part] == code
                    held = sums.setdefault(names[code], np.zeros((2, repeats)))
                    held += [weight[own].sum(axis=0), values[part][own] @ weight[own]]
        for name, (weight, total) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * repeats), pa.array(np.arange(repeats)), pa.array(weight), pa.array(total)], ["metric", "rep", "weight", "total"])

    return run


def poisson_ci(long: DataFrame, repeats: int = 300) -> DataFrame:
    """The interval of `bootstrap_ci` by Poisson weights, whose resamples differ in size. `long`: key (integer), metric, value.

    Resamples are weights, not copies of rows: all sums are made in one pass inside the tasks, and a task sends `repeats` rows
    for each metric. A row's weights depend on its key alone, so the answer does not depend on order or partitions.
    """
    rows = long.where("value is not null").select(F.coalesce(F.col("key").cast("bigint"), F.lit(0)).alias("key"), "metric", F.col("value").cast("double").alias("value"))
    sums = rows.mapInArrow(resample_sums(repeats), "metric string, rep bigint, weight double, total double")
    means = sums.groupBy("metric", "rep").agg((F.sum("total") / F.nullif(F.sum("weight"), F.lit(0.0))).alias("mean")).where("mean is not null")
    return exact_quantiles(means, "metric", "mean", {"ci_low": (0.025, ceil_place), "ci_high": (0.975, ceil_place)})


def resample_draws(repeats: int, block: int):
    """Task function: rows (metric, n, at) -> (metric, part, draws), the places that the resamples draw, by block of places.

    A draw is the resample times `block` plus the place in its block, a 32-bit integer.
    """

    def run(batches):
        reps = np.arange(repeats, dtype=np.int64)
        for batch in batches:
            metric = batch.column("metric").dictionary_encode()
            codes, names = metric.indices.to_numpy(zero_copy_only=False), metric.dictionary.to_pylist()
            count, at = batch.column("n").to_numpy(), batch.column("at").to_numpy()
            for first in range(0, batch.num_rows, RESAMPLE_ROWS):
                rows = slice(first, first + RESAMPLE_ROWS)
                mixed = (reps * SPREAD + at[rows, None]) % PRIME
                for step in MIXES:
                    mixed = (mixed * mixed + mixed * step + 7) % PRIME
                drawn = mixed % count[rows, None]
                for code in np.unique(codes[rows]):
                    own = drawn[codes[rows] == code]
                    parts = (own // block).ravel()
                    draws = (reps * block + own % block).ravel().astype(np.int32)
                    order = np.argsort(parts, kind="stable")
                    there, starts = np.unique(parts[order], return_index=True)
                    held = [part.tobytes() for part in np.split(draws[order], starts[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array([names[code]] * len(there)), pa.array(there), pa.array(held, pa.binary())], ["metric", "part", "draws"])

    return run


def bootstrap_ci(long: DataFrame, repeats: int = 300, block: int = RESAMPLE_ROWS) -> DataFrame:
    """(metric, ci_low, ci_high): nearest-rank 2.5 and 97.5 % of `repeats` resampled means. `long`: metric, value.

    A resample draws as many values as there are, with replacement, by place in the order of the values; the place is a hash of
    the resample and the number of the draw. Draws travel packed to the block of places they fall into and meet its values
    there, so no row is copied and a task holds the values and draws of one block.
    """
    rows = long.select("metric", F.col("value").cast("double").alias("value"))
    placed = numbered(cut_lineage(rows.orderBy("metric", F.col("value").asc_nulls_last())))
    bounds = placed.groupBy("metric").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("n"))
    local = placed.join(bounds, "metric").select("metric", "value", "n", (F.col("pos") - F.col("start")).alias("at"))
    draws = local.select("metric", "n", "at").mapInArrow(resample_draws(repeats, block), "metric string, part bigint, draws binary")
    values = local.where("value is not null").select("metric", F.floor(F.col("at") / block).alias("part"), (F.col("at") % block).cast("int").alias("place"), "value")

    def sums(drawn: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        held, known = np.zeros(block), np.zeros(block, bool)
        held[own["place"]], known[own["place"]] = own["value"], True
        rep, place = np.divmod(np.frombuffer(b"".join(drawn["draws"]), np.int32), block)
        rep, place = rep[known[place]], place[known[place]]
        total, weight = np.bincount(rep, held[place], repeats), np.bincount(rep, minlength=repeats)
        name = own["metric"].iloc[0] if len(own) else drawn["metric"].iloc[0] if len(drawn) else None
        return pd.DataFrame({"metric": name, "rep": np.arange(repeats), "weight": weight, "total": total})

    met = draws.groupBy("metric", "part").cogroup(values.groupBy("metric", "part")).applyInPandas(sums, "metric string, rep bigint, weight bigint, total double")
    means = met.groupBy("metric", "rep").agg((F.sum("total") / F.nullif(F.sum("weight"), F.lit(0))).alias("mean")).where("mean is not null")
    return exact_quantiles(means, "metric", "mean", {"ci_low": (0.025, ceil_place), "ci_high": (0.975, ceil_place)})


def confusion_counts(score: Column, expected: Column, threshold: Column | float) -> list[Column]:
    hit, want = score >= threshold, expected == 1
    return [
        F.count_if(hit & want).alias("tp"), F.count_if(hit & ~want).alias("fp"), F.count_if(~hit & want).alias("fn"), F.count_if(~hit & ~want).alias("tn")
    ]


def with_f1(df: DataFrame) -> DataFrame:
    """precision, recall and f1 from tp, fp, fn."""
    one = F.lit(1)
    rates = df.withColumn("precision", F.col("tp") / F.greatest(one, F.col("tp") + F.col("fp"))).withColumn("recall", F.col("tp") / F.greatest(one, F.col("tp") + F.col("fn")))
    return rates.withColumn("f1", 2.0 * F.col("precision") * F.col("recall") / F.greatest(F.lit(1e-6), F.col("precision") + F.col("recall")))


def threshold_counts(samples: DataFrame, thresholds: list[float], keys: list[str]) -> DataFrame:
    """keys, threshold, tp, fp, fn, tn; rows are counted per score first, so the sweep multiplies distinct scores, not rows."""
    distinct = samples.groupBy(*keys, "score", "expected").agg(F.count(F.lit(1)).alias("c"))
    swept = distinct.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    hit, want = F.col("score") >= F.col("threshold"), F.col("expected") == 1

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("c")).otherwise(0))

    return swept.groupBy(*keys, "threshold").agg(
        total(hit & want).alias("tp"), total(hit & ~want).alias("fp"), total(~hit & want).alias("fn"), total(~hit & ~want).alias("tn")
    )


def tune_thresholds(samples: DataFrame) -> DataFrame:
    """(label, threshold, f1): best f1 of .05 .. .95, ties to the threshold nearest .5, then the lower one."""
    swept = with_f1(threshold_counts(samples, [i / 20.0 for i in range(1, 20)], ["label"]))
    order = Window.partitionBy("label").orderBy(F.round("f1", 9).desc(), F.round(F.abs(F.col("threshold") - 0.5), 9), "threshold")
    return swept.withColumn("n", F.row_number().over(order)).where(F.col("n") == 1).select("label", "threshold", "f1")


def evaluate_gates(runs: DataFrame, gates: DataFrame) -> DataFrame:
    """(scenario, corruption, gate, value, passed). `runs`: scenario, corruption, metric, value; `gates`: `*` matches anything.

    The wildcard is expanded on the run side, so matching is an equi-join.
    """
    spread = runs.select(
        "scenario", "corruption", "metric", "value",
        F.explode(F.array(F.col("scenario"), F.lit("*"))).alias("g_scenario"),
    ).select("*", F.explode(F.array(F.col("corruption"), F.lit("*"))).alias("g_corruption"))
    wanted = gates.select("gate", F.col("scenario").alias("g_scenario"), F.col("corruption").alias("g_corruption"), "metric", "op", "threshold")
    checked = spread.join(wanted, ["g_scenario", "g_corruption", "metric"])
    value = F.round("value", 9)
    passed = F.when(F.col("op") == ">=", value >= F.col("threshold")).otherwise(value <= F.col("threshold"))
    return checked.select("scenario", "corruption", "gate", "value", passed.alias("passed"))


def gate_table(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "gate string, scenario string, corruption string, metric string, op string, threshold double")


def leaderboard_score(latency: Column, target: float, mismatches: Column) -> Column:
    score = F.lit(0.0)
    for name, weight in LEADERBOARD.items():
        score = score + weight * F.col(name)
    late = F.greatest(F.lit(0.0), (latency - target) / max(1.0, target))
    return score - 0.10 * late - 0.25 * (mismatches > 0).cast("double")

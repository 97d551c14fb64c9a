"""Rerankers on Spark ML: weighted linear heads over the feature arrays, blended scores, cascades and model choice."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memjoin.operators.ranking import ranked, top_k

# Rerank weights with and without a trained include head, class caps, selection blend.
BLEND = {"relevance": 0.35, "include": 0.60, "base": 0.05, "utility": 0.05}
BLEND_PLAIN = {"relevance": 0.90, "include": 0.0, "base": 0.05, "utility": 0.05}
SELECTION = {"f1": 0.5, "mrr": 0.3, "recall": 0.2}
POSITIVE_CAP = 16.0


def split(rows: DataFrame, by: str = "q", held: int = 3) -> tuple[DataFrame, DataFrame]:
    """Training and held-out rows; every `held`-th query by its hash is held out with all its rows."""
    out = F.pmod(F.xxhash64(by), F.lit(held)) == 0
    return rows.where(~out), rows.where(out)


def three_ways(rows: DataFrame, by: str = "q") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows to train on, to choose on and to report on: three, one and one fifths of the queries."""
    part = F.pmod(F.xxhash64(by), F.lit(5))
    return rows.where(part > 1), rows.where(part == 0), rows.where(part == 1)


def _numbers(df: DataFrame, features: str) -> DataFrame:
    return df.withColumn("_x", array_to_vector(F.col(features)))


def balanced(rows: DataFrame, label: str, weight: str | None = None, cap: float = POSITIVE_CAP) -> DataFrame:
    """Row weight times the class balance: positives count negatives / positives times, capped."""
    positives = F.sum(F.col(label))
    ratio = rows.agg(F.least(F.lit(cap), F.greatest(F.lit(1.0), (F.count(F.lit(1)) - positives) / F.greatest(F.lit(1.0), positives)))).scalar()
    base = F.col(weight) if weight else F.lit(1.0)
    return rows.withColumn("_w", base * F.when(F.col(label) == 1, ratio).otherwise(1.0))


def fit_head(rows: DataFrame, features: str, label: str, weight: str | None = None, reg: float = 0.01, iterations: int = 30):
    """Binary head with row weights and class balance."""
    data = _numbers(balanced(rows, label, weight), features)
    return LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_w", regParam=reg, maxIter=iterations).fit(data)


def fit_classes(rows: DataFrame, features: str, label: str, classes: int, reg: float = 0.01, iterations: int = 30):
    """Multinomial head with inverse-frequency class weights, every class starting from one, capped at eight."""
    counts = rows.groupBy(label).agg((F.count(F.lit(1)) + 1).alias("_n"))
    total = rows.agg(F.count(F.lit(1)) + classes).scalar()
    weighted = rows.join(counts, label).withColumn("_w", F.least(F.lit(8.0), total / (classes * F.col("_n"))))
    return LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_w", family="multinomial", regParam=reg, maxIter=iterations).fit(_numbers(weighted, features))


def utility_target(label: Column, cost: Column, budget: float) -> Column:
    """What a candidate is worth to the context: one if it is needed, else minus the share of the budget that it wastes."""
    return F.when(label == 1, F.lit(1.0)).otherwise(-F.least(F.lit(1.0), cost / budget))


def fit_utility(rows: DataFrame, features: str, target: str, weight: str | None = None, reg: float = 0.01, iterations: int = 30):
    """Regressor of the utility of a candidate."""
    data = _numbers(rows.withColumn("_w", F.col(weight) if weight else F.lit(1.0)), features)
    return LinearRegression(featuresCol="_x", labelCol=target, weightCol="_w", regParam=reg, maxIter=iterations).fit(data)


def utility(model, df: DataFrame, features: str, name: str = "utility") -> DataFrame:
    """Add the predicted utility, squeezed into (-1, 1)."""
    return model.transform(_numbers(df, features)).withColumn(name, F.tanh("prediction")).drop("_x", "prediction")


def fit_flags(rows: DataFrame, features: str, labels: list[str], reg: float = 0.01, iterations: int = 30) -> dict:
    """A weighted binary head for each label column, over one matrix; a label that never varies has none."""
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(name).alias(name) for name in labels]).first()
    return {name: fit_head(rows, features, name, reg=reg, iterations=iterations) for name in labels if 0 < (sums[name] or 0) < sums["n"]}


def flag_samples(heads: dict, rows: DataFrame, features: str) -> DataFrame:
    """(label, score, expected) of every row and head, as threshold tuning reads them."""
    scored = rows
    for name, model in heads.items():
        scored = logit(model, scored, features, f"_{name}")
    cells = [F.struct(F.lit(name).alias("label"), sigmoid(F.col(f"_{name}")).alias("score"), F.col(name).cast("int").alias("expected")) for name in heads]
    return scored.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def logit(model, df: DataFrame, features: str, name: str) -> DataFrame:
    """Add the model's logit."""
    out = model.transform(_numbers(df, features))
    return out.withColumn(name, F.get(vector_to_array("rawPrediction"), F.lit(1))).drop("_x", "rawPrediction", "probability", "prediction")


def sigmoid(value: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-value))


def calibrated_rerank(pool: DataFrame, relevance_model, include_model, features: str, limit: int, blend: dict[str, float] | None = None, utility_model=None) -> DataFrame:
    """Pool cut to `limit` before the models run, then score = weighted logits + base score + utility, with include probability.

    `pool`: q, id, score, rank and the feature array. A missing include head uses the relevance logit at weight zero, a
    missing utility model counts nothing.
    """
    weights = blend or (BLEND if include_model is not None else BLEND_PLAIN)
    cut = pool.where(F.col("rank") <= limit).withColumnRenamed("score", "base_score")
    scored = logit(relevance_model, cut, features, "relevance_logit")
    scored = logit(include_model, scored, features, "include_logit") if include_model is not None else scored.withColumn("include_logit", F.col("relevance_logit"))
    score = weights["relevance"] * F.col("relevance_logit") + weights["include"] * F.col("include_logit") + weights["base"] * F.col("base_score")
    if utility_model is not None:
        scored = utility(utility_model, scored, features)
        score = score + weights["utility"] * F.col("utility")
    return ranked(scored.drop("rank").withColumn("score", score).withColumn("include_probability", sigmoid(F.col("include_logit"))), "q")


def cascade_rerank(pool: DataFrame, cheap, models: tuple, features: str, wide: int, survivors: int) -> DataFrame:
    """A cheap head over the wide pool keeps `survivors` per query; the full heads rank only those."""
    first = logit(cheap, pool.where(F.col("rank") <= wide), features, "cheap")
    kept = top_k(first.withColumnRenamed("score", "held").withColumn("score", F.col("cheap")).drop("rank"), "q", survivors)
    back = kept.drop("score").withColumnRenamed("held", "score")
    return calibrated_rerank(back, *models, features, survivors)


def selection_score(metrics: DataFrame, name: str) -> Column:
    """Value a model is chosen by: one metric, or the balanced blend of f1, mrr and recall."""
    if name != "balanced":
        return F.col(name)
    total = F.lit(0.0)
    for metric, weight in SELECTION.items():
        total = total + weight * F.col(metric)
    return total

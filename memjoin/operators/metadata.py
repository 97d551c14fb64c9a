"""Metadata candidates: field/value buckets, scores over them and the neighbour graph inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memjoin.operators.ranking import rounded, top_k
from memjoin.session import cut_lineage
from memjoin.sources.jsonl import numbered

# Field weights, match boosts, query entity confidence, graph edges (field, type, weight, reach).
FIELD_WEIGHTS = {
    "user_id": 1.00, "project": 1.20, "brand": 0.90, "session_id": 0.80, "entity": 0.65, "preference": 0.45, "correction": 0.50, "tool": 0.45, "time_scope": 0.35,
    "topic": 0.35,
}
OTHER_WEIGHT = 0.30
PROJECT_BOOST, USER_BOOST, BRAND_BOOST, IMPORTANCE_SHARE, AGE_SHARE = 1.25, 0.95, 0.75, 0.10, 0.0005
QUERY_ENTITY = 0.65
EDGE_SPECS = [
    ("session_id", "same_session", 1.00, 18),
    ("project", "same_project", 0.65, 24),
    ("brand", "same_brand", 0.45, 24),
    ("user_id", "same_user", 0.35, 24),
    ("entity", "same_entity", 0.40, 18),
    ("tool", "same_tool", 0.30, 12),
    ("preference", "same_preference", 0.28, 12),
]
BLOCK = 4096  # lines of a bucket that one window holds


def field_weight(field: Column) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for name, weight in FIELD_WEIGHTS.items():
        out = F.when(field == name, weight).otherwise(out)
    return out


def _original(id_col: str, fields: dict[str, Column], entities: Column, confidence: float) -> Column:
    one = [F.struct(F.lit(name).alias("field"), value.alias("value"), F.lit(1.0).alias("confidence")) for name, value in fields.items()]
    listed = F.transform(entities, lambda v: F.struct(F.lit("entity").alias("field"), v.alias("value"), F.lit(confidence).alias("confidence")))
    return F.concat(F.array(*one), listed)


def metadata_index(memories: DataFrame, derived: DataFrame | None = None) -> DataFrame:
    """(id, source, field, value, confidence) of the original metadata, and of derived predictions (id, field, value, confidence)."""
    names = [c for c in ("user_id", "project", "brand", "session_id") if c in memories.columns]
    fields = {c: F.col(c) for c in names}
    entities = F.col("entities") if "entities" in memories.columns else F.array("user_id", "project", "brand")
    rows = memories.select("id", F.lit("metadata").alias("source"), F.explode(_original("id", fields, entities, 1.0)).alias("m")).select("id", "source", "m.*")
    if derived is not None:
        rows = rows.unionByName(derived.select("id", F.lit("derived_metadata").alias("source"), "field", "value", "confidence"))
    return rows.where(F.coalesce("value", F.lit("")) != "").groupBy("id", "source", "field", "value").agg(F.max("confidence").alias("confidence"))


def query_metadata(queries: DataFrame, derived: DataFrame | None = None) -> DataFrame:
    """(q, source, field, value, confidence, place) of a query; its user, project and brand also stand as entities at .65."""
    fields = {"user_id": F.col("user_id"), "project": F.col("project_id"), "brand": F.col("brand")}
    rows = queries.select("q", F.lit("metadata").alias("source"), F.explode(_original("q", fields, F.array(*fields.values()), QUERY_ENTITY)).alias("m")).select("q", "source", "m.*")
    if derived is not None:
        rows = rows.unionByName(derived.select("q", F.lit("derived_metadata").alias("source"), "field", "value", "confidence"))
    best = rows.where(F.coalesce("value", F.lit("")) != "").groupBy("q", "source", "field", "value").agg(F.max("confidence").alias("confidence"))
    order = Window.partitionBy("q", "field").orderBy(F.col("confidence").desc(), "source", "value")
    return best.withColumn("place", F.row_number().over(order))


def first_value(values: DataFrame, field: str, name: str) -> DataFrame:
    return values.where((F.col("field") == field) & (F.col("place") == 1)).select("q", F.col("value").alias(name))


def bounded_buckets(values: DataFrame, index: DataFrame, cards: DataFrame, limit: int) -> DataFrame:
    """(q, source, field, value, q_confidence, id): at most `limit` cards per query value, preferred project and brand first.

    Then importance, age and id decide. Buckets are first cut to `limit` per (value, project, brand): whatever a query
    prefers, its best cards are among those, so a bucket holding a third of all cards never meets every query.
    """
    standing = cards.select("id", "project", "brand", "importance", "age_days")
    own = Window.partitionBy("source", "field", "value", "project", "brand").orderBy(F.col("importance").desc(), "age_days", "id")
    cut = index.join(standing, "id").withColumn("n", F.row_number().over(own)).where(F.col("n") <= limit).drop("n", "confidence")
    wanted = values.join(first_value(values, "project", "q_project"), "q", "left").join(first_value(values, "brand", "q_brand"), "q", "left")
    met = wanted.withColumnRenamed("confidence", "q_confidence").join(cut, ["source", "field", "value"])

    def miss(asked: str, held: str) -> Column:
        return (F.col(asked).isNotNull() & (F.col(asked) != F.col(held))).cast("int")

    order = Window.partitionBy("q", "source", "field", "value").orderBy(miss("q_project", "project"), miss("q_brand", "brand"), F.col("importance").desc(), "age_days", "id")
    return met.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).select("q", "source", "field", "value", "q_confidence", "id", "n")


def metadata_scores(values: DataFrame, buckets: DataFrame, cards: DataFrame, limit: int) -> DataFrame:
    """(q, id, score, sources, rank): field weight x confidence over the met buckets plus match, importance and age terms."""
    part = field_weight(F.col("field")) * F.col("q_confidence")
    sums = buckets.groupBy("q", "id").agg(F.sum(part).alias("score"), F.array_sort(F.collect_set(F.concat_ws(":", "source", "field"))).alias("sources"))
    joined = sums.join(cards.select("id", "project", "brand", "user_id", "importance", "age_days"), "id")
    for field in ("project", "brand", "user_id"):
        joined = joined.join(first_value(values, field, f"q_{field}"), "q", "left")

    def boost(field: str, value: float) -> Column:
        return F.when(F.col(f"q_{field}") == F.col(field), value).otherwise(0.0)

    total = (
        F.col("score") + boost("project", PROJECT_BOOST) + boost("user_id", USER_BOOST) + boost("brand", BRAND_BOOST) + IMPORTANCE_SHARE * F.col("importance") - AGE_SHARE * F.col("age_days")
    )
    return top_k(joined.select("q", "id", total.alias("score"), "sources"), "q", limit)


def metadata_graph(index: DataFrame, specs: list[tuple[str, str, float, int]] = EDGE_SPECS, only: DataFrame | None = None) -> DataFrame:
    """(source, target, type, weight, edge_rank): every card linked to its neighbours in id order inside each value bucket.

    One distributed sort numbers all buckets, and the numbered lines are dealt to blocks of equal length that overlap by the
    longest reach. A line meets its neighbours inside its block, so a large bucket costs its rows times the reach, never its
    square, and what travels to a source is one list for each of its buckets. The sorted rows are written first because
    numbering reads them twice. With `only` (id), nothing but the edges of those sources is made.
    """
    names, most = [s[0] for s in specs], max(s[3] for s in specs)
    held = index.where(F.col("field").isin(names)).select(F.concat_ws(":", "source", "field").alias("bucket"), "field", "value", "id")
    placed = numbered(cut_lineage(held.orderBy("bucket", "value", "id")))
    start = placed.groupBy("bucket", "value").agg(F.min("pos").alias("start"))
    pos = F.col("pos")
    lines = placed.join(start, ["bucket", "value"]).select("bucket", "value", "field", "id", (pos - F.col("start")).alias("pos"))
    blocks = F.sequence(F.floor(F.greatest(pos - most, F.lit(0)) / BLOCK), F.floor((pos + most) / BLOCK))
    around = Window.partitionBy("bucket", "value", "block").orderBy("pos").rowsBetween(-most, most)
    seen = lines.select("*", F.explode(blocks).alias("block")).withColumn("near", F.collect_list(F.struct("pos", "id")).over(around))
    seen = seen.where(F.col("block") == F.floor(pos / BLOCK))
    if only is not None:
        seen = seen.join(only.select("id").distinct(), "id", "left_semi")
    reach = F.create_map(*[F.lit(x) for s in specs for x in (s[0], s[3])])[F.col("field")]
    met = seen.withColumn("reach", reach).select(
        F.col("id").alias("source"), "field", F.transform(F.filter("near", lambda n: F.abs(n["pos"] - pos) <= F.col("reach")), lambda n: n["id"]).alias("targets")
    )
    listed = met.groupBy("source").agg(*[F.flatten(F.collect_list(F.when(F.col("field") == name, F.col("targets")))).alias(f"by_{name}") for name in names])
    # The heaviest edge of a pair stays, of equal ones the first in `specs`.
    strong = [s for _, s in sorted(enumerate(specs), key=lambda e: (-e[1][2], e[0]))]
    own = {s: F.array_except(f"by_{s[0]}", F.concat(F.array("source"), *[f"by_{t[0]}" for t in strong[:n]])) for n, s in enumerate(strong)}

    def shown(spec: tuple[str, str, float, int]) -> Column:
        return F.transform(F.array_sort(own[spec]), lambda t: F.struct(t.alias("target"), F.lit(spec[1]).alias("type"), F.lit(spec[2]).alias("weight")))

    edges = [shown(s) for s in sorted(specs, key=lambda s: (-s[2], s[1]))]
    out = listed.select("source", F.posexplode(F.concat(*edges)).alias("place", "e"))
    return out.select("source", "e.target", "e.type", "e.weight", (F.col("place") + 1).alias("edge_rank"))


def graph_seeds(heads: list[tuple[DataFrame, int]]) -> DataFrame:
    """(q, id, score, seed_rank): heads of several rankings one after the other, repeats kept."""
    union = None
    for order, (df, n) in enumerate(heads):
        part = df.where(F.col("rank") <= n).select("q", "id", "score", F.lit(order).alias("part"), "rank")
        union = part if union is None else union.unionByName(part)
    place = F.row_number().over(Window.partitionBy("q").orderBy("part", "rank"))
    return union.select("q", "id", "score", place.alias("seed_rank"))


def graph_scores(seeds: DataFrame, edges: DataFrame, cards: DataFrame, per_seed: int, limit: int) -> DataFrame:
    """(q, id, score, sources, rank): first `per_seed` edges of every seed, damped by the root of the seed's place."""
    bonus = F.when(F.col("score") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("score")) / F.greatest(F.lit(1.0), F.abs("score")))
    asked = seeds.select("q", F.col("id").alias("source"), "seed_rank", bonus.alias("bonus"))
    met = asked.join(edges.where(F.col("edge_rank") <= per_seed), "source").join(cards.select(F.col("id").alias("target"), "importance"), "target")
    part = F.col("weight") / F.sqrt("seed_rank") + 0.05 * F.col("bonus") + 0.05 * F.col("importance")
    sums = met.groupBy("q", F.col("target").alias("id")).agg(F.sum(part).alias("score"), F.array_sort(F.collect_set(F.concat(F.lit("graph:"), "type"))).alias("sources"))
    return top_k(sums, "q", limit)


def query_matches(pairs: DataFrame, queries: DataFrame, cards: DataFrame, q_values: DataFrame, index: DataFrame) -> DataFrame:
    """(q, id, *_match, derived_*_match, derived_count, derived_confidence, metadata_disagreement) for given pairs.

    `q_values` and `index` hold the values of the source in use; matching is an equi-join on field and value.
    """
    fields = {"user": ("user_id", "user_id"), "project": ("project", "project_id"), "brand": ("brand", "brand")}
    asked = queries.select("q", *[F.col(q).alias(f"asked_{n}") for n, (_, q) in fields.items()])
    held = cards.select("id", *[F.col(c).alias(f"held_{n}") for n, (c, _) in fields.items()])
    direct = pairs.join(asked, "q").join(held, "id").select(
        "q", "id", *[F.coalesce((F.col(f"asked_{n}") != "") & (F.col(f"asked_{n}") == F.col(f"held_{n}")), F.lit(False)).alias(f"query_{n}_match") for n in fields]
    )
    met = pairs.join(q_values.select("q", "field", "value").distinct(), "q").join(index.select("id", "field", "value").distinct(), ["id", "field", "value"])
    derived = met.groupBy("q", "id").agg(*[F.bool_or(F.col("field") == c).alias(f"derived_{n}_match") for n, (c, _) in fields.items()])
    own = index.where(F.col("source") == "derived_metadata").groupBy("id").agg(F.count(F.lit(1)).alias("derived_count"), F.avg("confidence").alias("derived_confidence"))
    out = direct.join(derived, ["q", "id"], "left").join(own, "id", "left")
    out = out.fillna(False, [f"derived_{n}_match" for n in fields]).fillna(0, ["derived_count"]).fillna(0.0, ["derived_confidence"])
    disagree = F.lit(False)
    for n in fields:
        disagree = disagree | (F.col(f"query_{n}_match") != F.col(f"derived_{n}_match"))
    return out.withColumn("metadata_disagreement", disagree)

"""Seeds, expansion and neighbour candidates of the layered memory graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memjoin.functions.hashing import FNV_OFFSET, fnv1a64
from memjoin.operators.graph import expand_paths
from memjoin.operators.hashed import _fnv
from memjoin.operators.ranking import ranked, rounded, top_k


def truth_step(score: Column, hop: int) -> Column:
    confidence = F.coalesce("confidence", F.lit(0.5))
    gain = F.col("weight") * F.col("boost") * (0.62 + 0.50 * F.col("overlap")) * (0.70 + 0.30 * confidence) / (1.35 + hop)
    return 0.78 * score + gain + 0.02 * F.col("t_importance") + F.col("t_state")


def truth_expansion(base: DataFrame, seeds: DataFrame, edges: DataFrame, depth: int, fanout: int) -> DataFrame:
    """Expansion with at most `fanout` continuations per path; a node's edges are read by (target, type)."""
    order = F.row_number().over(Window.partitionBy("q", "source").orderBy("target", "type", "epos"))
    return expand_paths(base, seeds, edges.withColumn("epos", order), depth, truth_step, fanout=fanout)


def objective_seeds(pairs: DataFrame, count: int) -> DataFrame:
    """(q, id, score, rank): cards whose mask meets the query's, backfilled by the full score when they are too few.

    `pairs`: q, id, activation, same_project (0/1), weighty, state, semantic.
    """
    narrow = 0.62 * F.col("activation") + 0.08 * F.col("same_project") + 0.05 * F.col("weighty") + F.col("state")
    full = 0.66 * F.col("semantic") + 0.18 * F.col("activation") + 0.06 * F.col("same_project") + 0.04 * F.col("weighty") + F.col("state")
    met = F.col("activation") > 0
    counted = pairs.withColumn("met", F.sum(met.cast("int")).over(Window.partitionBy("q")))
    scored = counted.where(met | (F.col("met") < count)).select("q", "id", F.when(met, narrow).otherwise(full).alias("score"))
    return top_k(scored, "q", count)


def deterministic_level(key: Column, layers: int, threshold: int) -> Column:
    """Level = leading run of id-hash bytes under the threshold."""
    hashed = fnv1a64(key)
    level = F.lit(0)
    passed = F.lit(True)
    for step in range(layers - 1):
        octet = F.shiftrightunsigned(hashed, step * 8).bitwiseAND(F.lit(0xFF))
        passed = passed & (octet < threshold)
        level = level + passed.cast("int")
    return level


def route_points(layer: int, projection: int, dims: int, width: int = 16) -> list[tuple[int, float]]:
    """Sparse projection of a routing layer, from the hash of `route:layer:projection:offset`."""
    hashes = [_fnv(f"route:{layer}:{projection}:{offset}") for offset in range(min(width, dims))]
    return [(h % dims, -1.0 if (h >> 17) & 1 else 1.0) for h in hashes]


def route_value(vec: Column, points: list[tuple[int, float]]) -> Column:
    total = F.lit(0.0)
    for dim, sign in points:
        total = total + sign * F.get(vec, F.lit(dim)).cast("double")
    return total


def projection_positions(nodes: DataFrame, layers: int, projections: int, dims: int) -> DataFrame:
    """(layer, projection, id, pos): place of every node of the layer along each projection.

    One distributed sort numbers all (layer, projection) lines; no line passes through a single task. The sorted rows are
    materialised first, since numbering reads them twice.
    """
    from memjoin.session import cut_lineage
    from memjoin.sources.jsonl import numbered

    lines = F.array(
        *[
            F.struct(F.lit(layer).alias("layer"), F.lit(p).alias("projection"), rounded(route_value(F.col("vec"), route_points(layer, p, dims))).alias("value"))
            for layer in range(layers)
            for p in range(projections)
        ]
    )
    rows = nodes.select("id", "level", F.explode(lines).alias("l")).where(F.col("level") >= F.col("l.layer")).select("l.*", "id")
    placed = numbered(cut_lineage(rows.orderBy("layer", "projection", "value", "id")))
    start = placed.groupBy("layer", "projection").agg(F.min("pos").alias("start"))
    return placed.join(start, ["layer", "projection"]).select("layer", "projection", "id", (F.col("pos") - F.col("start")).alias("pos"))


def routing_neighbours(nodes: DataFrame, positions: DataFrame, window: int, degree: int) -> DataFrame:
    """(layer, source, target, score, rank): the `degree` nearest by summed 1 / (1 + distance) within the window.

    `nodes`: id, project, weighty, state. Each node meets 2 x window places per line through an equi-join.
    """
    steps = F.filter(F.sequence(F.lit(-window), F.lit(window)), lambda d: d != 0)
    asked = positions.select("layer", "projection", F.col("id").alias("source"), "pos", F.explode(steps).alias("d")).select(
        "layer", "projection", "source", (F.col("pos") + F.col("d")).alias("pos"), (1.0 / (1 + F.abs("d"))).alias("near")
    )
    met = asked.join(positions.withColumnRenamed("id", "target"), ["layer", "projection", "pos"]).groupBy("layer", "source", "target").agg(F.sum("near").alias("near"))
    left = nodes.select(F.col("id").alias("source"), F.col("project").alias("s_project"))
    right = nodes.select(F.col("id").alias("target"), F.col("project").alias("t_project"), "weighty", "state")
    jitter = fnv1a64(F.concat(F.col("source").cast("string"), F.lit("->"), F.col("target").cast("string"), F.lit(":"), F.col("layer").cast("string")))
    score = (
        F.col("near")
        + 0.06 * (F.col("s_project") == F.col("t_project")).cast("double")
        + 0.04 * F.col("weighty")
        + F.col("state")
        + jitter.bitwiseAND(F.lit(0xFFFF)) / 1e9
    )
    scored = met.join(left, "source").join(right, "target").select("layer", "source", "target", score.alias("score"))
    return top_k(scored, ["layer", "source"], degree, tie="target")


def with_reciprocals(edges: DataFrame, nodes: DataFrame, degree: int) -> DataFrame:
    """(layer, source, target): edges and their reverses; a node over twice the degree keeps its best-standing targets."""
    both = edges.select("layer", "source", "target").unionByName(edges.select("layer", F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    standing = nodes.select(F.col("id").alias("target"), (F.col("weighty") + F.col("state")).alias("score"))
    return top_k(both.join(standing, "target"), ["layer", "source"], 2 * degree, tie="target").select("layer", "source", "target")

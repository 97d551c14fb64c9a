"""Quantised scans and grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memjoin.functions.hashing import fnv1a64, umod
from memjoin.functions.text import contains_any
from memjoin.operators.graph import expand_paths, hop_gain
from memjoin.operators.ranking import ranked, rounded, top_k

# State flag bits and the penalties of each scan.
PROTECTED, CONFLICT, IGNORED, STALE = 1, 2, 4, 8
SCAN_PENALTY = {CONFLICT: 0.06, IGNORED: 0.04, STALE: 0.04}
GRID_PENALTY = {CONFLICT: 0.08, IGNORED: 0.05, STALE: 0.05}
CONFLICT_TEXT = ["superseded", "contradicts"]


def state_flags(text: Column, role: Column) -> Column:
    """Bits: protected 1, conflict 2, ignored 4, stale 8."""
    conflict = F.lower(role).contains("conflict") | F.lower(role).contains("decoy") | contains_any(text, CONFLICT_TEXT)
    stale = (F.coalesce("age_days", F.lit(0)) >= 180) & (F.coalesce("use_count", F.lit(0)) <= 0)
    return (
        F.when(F.coalesce("protected", F.lit(False)), PROTECTED).otherwise(0)
        + F.when(conflict, CONFLICT).otherwise(0)
        + F.when(F.lower("last_outcome") == "ignored", IGNORED).otherwise(0)
        + F.when(stale, STALE).otherwise(0)
    )


def flag_penalty(flags: Column, penalties: dict[int, float]) -> Column:
    total = F.lit(0.0)
    for bit, value in penalties.items():
        total = total + F.when(flags.bitwiseAND(F.lit(bit)) != 0, value).otherwise(0.0)
    return total


def scan_score() -> Column:
    """Coarse score over `int8`, `activation`, `same_cluster`, `weighty`, `state`, `flags`."""
    return (
        0.48 * F.col("int8")
        + 0.22 * F.col("activation")
        + 0.11 * F.col("same_cluster")
        + 0.07 * F.col("weighty")
        + F.col("state")
        - flag_penalty(F.col("flags"), SCAN_PENALTY)
    )


def segment_scan(pairs: DataFrame, edges: DataFrame, segments: int, per_segment: int, seed_count: int, depth: int, fetch: int) -> DataFrame:
    """Best rows of every hash segment, then edge expansion at .58 source + .42 target. `pairs` carries q, id, base."""
    cut = top_k(pairs.select("q", "id", F.col("base").alias("score"), umod(fnv1a64(F.col("id")), segments).alias("segment")), ["q", "segment"], per_segment)
    best = cut.select("q", "id", "score")
    walk = edges.join(pairs.select("q", F.col("id").alias("target"), "base"), ["q", "target"])
    grown = expand_paths(best, top_k(best, "q", seed_count), walk, depth, lambda score, hop: 0.58 * score + 0.42 * F.col("base") + hop_gain(hop))
    return top_k(grown, "q", fetch)


def dim_triples(dims: int, layers: int, schedule: str = "spread") -> list[tuple[int, int, int]]:
    """Three dimensions per layer: consecutive runs, or spread over the vector by three odd strides."""
    if schedule == "auto":
        schedule = "consecutive" if layers * 3 >= dims else "spread"
    if schedule == "consecutive":
        return [tuple((layer * 3 + k) % dims for k in range(3)) for layer in range(layers)]
    step, second, third = (max(1, n | 1) for n in (dims // max(1, layers), dims // 3 + 1, dims // 2 + 1))
    return [((layer * step) % dims, (layer * step + second) % dims, (layer * step + third) % dims) for layer in range(layers)]


def _layers(vec: Column, origin: Column, triples: list[tuple[int, int, int]], width: float) -> Column:
    """array<struct<energy, layer, x, y, z>> for every layer."""

    def part(dim: int) -> Column:
        return F.coalesce(F.get(vec, F.lit(dim)), F.lit(0.0)) - F.coalesce(F.get(origin, F.lit(dim)), F.lit(0.0))

    def cell(dim: int) -> Column:
        return F.greatest(F.lit(-32768), F.least(F.lit(32767), F.floor(rounded(part(dim) / width)).cast("int")))

    return F.array(
        *[
            F.struct(
                (-rounded(F.abs(part(a)) + F.abs(part(b)) + F.abs(part(c)))).alias("drain"),
                F.lit(layer).alias("layer"),
                cell(a).alias("x"),
                cell(b).alias("y"),
                cell(c).alias("z"),
            )
            for layer, (a, b, c) in enumerate(triples)
        ]
    )


def grid_cells(df: DataFrame, key: str, triples: list[tuple[int, int, int]], width: float, min_delta: float, min_layers: int, max_layers: int) -> DataFrame:
    """(q, key, layer, x, y, z): cells of the layers whose energy reaches `min_delta`, at least and at most so many.

    `df`: q, key, vec, origin. Layers are taken strongest first.
    """
    strongest = F.array_sort(_layers(F.col("vec"), F.col("origin"), triples, width))
    rows = df.select("q", key, F.posexplode(strongest).alias("place", "c"))
    wanted = (-F.col("c.drain") >= min_delta) | (F.col("place") < min_layers)
    if max_layers > 0:
        wanted = wanted & (F.col("place") < max_layers)
    return rows.where(wanted).select("q", key, "c.layer", "c.x", "c.y", "c.z")


def node_priority(flags: Column) -> Column:
    return F.col("weighty") + F.col("state") - flag_penalty(flags, GRID_PENALTY)


def cell_heads(cells: DataFrame, cards: DataFrame, cap: int) -> DataFrame:
    """At most `cap` cards per cell, strongest standing first, then id hash (unsigned), then id."""
    joined = cells.join(cards.select("q", "id", node_priority(F.col("flags")).alias("standing"), fnv1a64(F.col("id")).alias("hash")), ["q", "id"])
    unsigned = F.col("hash").bitwiseXOR(F.lit(-(1 << 63)))
    window = Window.partitionBy("q", "layer", "x", "y", "z").orderBy(rounded("standing").desc(), unsigned, "id")
    return joined.withColumn("n", F.row_number().over(window)).where(F.col("n") <= cap).drop("n", "standing", "hash")


def offsets(radius: int) -> Column:
    """Cell offsets within an L1 radius, with their distance."""
    span = range(-radius, radius + 1)
    near = [(x, y, z) for x in span for y in span for z in span if abs(x) + abs(y) + abs(z) <= radius]
    return F.array(
        *[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy"), F.lit(z).alias("dz"), F.lit(abs(x) + abs(y) + abs(z)).alias("distance")) for x, y, z in near]
    )


def grid_probe(
    query_cells: DataFrame, cells: DataFrame, pairs: DataFrame, edges: DataFrame, radius: int, seed_count: int, depth: int, fetch: int
) -> DataFrame:
    """(q, id, score, rank): cards in near cells, best distance score plus a vote bonus, then edge expansion.

    `pairs`: q, id, activation, same_cluster, weighty, state, flags.
    """
    near = query_cells.select("q", "layer", "x", "y", "z", F.explode(offsets(radius)).alias("o")).select(
        "q", "layer", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("z") + F.col("o.dz")).alias("z"), "o.distance"
    )
    hits = near.join(cells, ["q", "layer", "x", "y", "z"]).groupBy("q", "id").agg(F.min("distance").alias("distance"), F.count(F.lit(1)).alias("seen"))
    standing = (
        0.45 / (1.0 + F.col("distance"))
        + 0.25 * F.col("activation")
        + 0.13 * F.col("same_cluster")
        + 0.08 * F.col("weighty")
        + F.col("state")
        - flag_penalty(F.col("flags"), GRID_PENALTY)
    )
    found = hits.join(pairs, ["q", "id"]).select("q", "id", "seen", standing.alias("score"))
    lifted = found.select("q", "id", (F.col("score") + 0.035 * (F.col("seen") - 1)).alias("score"))
    grown = expand_paths(found, top_k(lifted, "q", seed_count), edges, depth, lambda score, hop: 0.68 * score + hop_gain(hop))
    votes = F.coalesce("seen", F.lit(0)) + F.col("votes")
    final = grown.join(found.select("q", "id", "seen"), ["q", "id"], "left").select(
        "q", "id", (F.col("score") + 0.035 * F.greatest(F.lit(0), votes - 1)).alias("score")
    )
    return top_k(final, "q", fetch)

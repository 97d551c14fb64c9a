"""Edge building and bounded expansion over typed memory edges.

Expansion runs one join per hop on the frontier only. Each hop writes its improved rows to the checkpoint folder, so
the plan does not double with every hop and a lost executor does not replay the walk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memjoin.functions.text import contains_any
from memjoin.operators.ranking import ranked, rounded, top_k
from memjoin.session import cut_lineage

# Terms of a correcting turn; traversal boost and decay by edge type; chain edge weights.
CORRECTION_TERMS = ["correct", "correction", "actually", "instead", "updated", "replaced", "superseded"]
TYPE_BOOST = {"preference": 1.22, "correction": 1.22, "same_context": 1.12, "same_cluster": 1.12, "temporal_next": 0.84}
TYPE_DECAY = {"preference": 0.005, "correction": 0.005, "same_cluster": 0.01, "same_context": 0.01, "temporal_next": 0.03}
CHAIN_WEIGHTS = {
    "next": (0.42, 0.85),
    "context": (0.34, 0.78),
    "context_back": (0.30, 0.74),
    "correction": (0.62, 0.72),
    "back": (0.24, 0.75),
    "speaker": (0.30, 0.65),
    "session": (0.36, 0.80),
}
REVERSE_SHARE = 0.72


def by_type(kind: Column, values: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(kind == name, F.lit(value)).otherwise(out)
    return out


def type_boost(kind: Column) -> Column:
    return by_type(kind, TYPE_BOOST, 1.0)


def type_decay(kind: Column) -> Column:
    return by_type(kind, TYPE_DECAY, 0.02)


def chain_edges(cards: DataFrame) -> DataFrame:
    """(q, source, target, type, weight, confidence, mask, epos) between neighbouring cards of a record.

    Up to seven edges per card: to and from the card before it, from the last card of its speaker and of its session.
    """
    order = Window.partitionBy("q").orderBy("pos")
    speaker = Window.partitionBy("q", "speaker").orderBy("pos")
    session = Window.partitionBy("q", "session").orderBy("pos")
    seen = cards.select(
        "q",
        "pos",
        "id",
        "mask",
        contains_any(F.col("text"), CORRECTION_TERMS).alias("corrects"),
        F.lag("id").over(order).alias("prev"),
        F.lag("mask").over(order).alias("prev_mask"),
        (F.lag("session").over(order) == F.col("session")).alias("same_session"),
        F.when(F.col("speaker") != "", F.lag("id").over(speaker)).alias("speaker_prev"),
        F.lag("id").over(session).alias("session_prev"),
    )
    has_prev = F.col("prev").isNotNull()

    def edge(slot: int, name: str, kind: str, source: str, target: str, mask: str, when: Column) -> Column:
        weight, confidence = CHAIN_WEIGHTS[name]
        return F.when(
            when,
            F.struct(
                F.col(source).alias("source"),
                F.col(target).alias("target"),
                F.lit(kind).alias("type"),
                F.lit(weight).alias("weight"),
                F.lit(confidence).alias("confidence"),
                F.col(mask).alias("mask"),
                (F.col("pos") * 8 + slot).alias("epos"),
            ),
        )

    edges = F.array(
        edge(0, "next", "temporal_next", "prev", "id", "mask", has_prev),
        edge(1, "context", "same_context", "prev", "id", "mask", has_prev & F.col("same_session")),
        edge(2, "context_back", "same_context", "id", "prev", "prev_mask", has_prev & F.col("same_session")),
        edge(3, "correction", "correction", "prev", "id", "mask", has_prev & F.col("corrects")),
        edge(4, "back", "same_context", "id", "prev", "prev_mask", has_prev),
        edge(5, "speaker", "same_context", "speaker_prev", "id", "mask", F.col("speaker_prev").isNotNull()),
        edge(6, "session", "same_context", "session_prev", "id", "mask", F.col("session_prev").isNotNull()),
    )
    return seen.select("q", F.explode(F.filter(edges, lambda e: e.isNotNull())).alias("e")).select("q", "e.*")


def hop_gain(depth: int) -> Column:
    """Traversal gain of one edge; a missing confidence counts as one half."""
    confidence = F.coalesce("confidence", F.lit(0.5))
    return F.col("weight") * F.col("boost") * (0.70 + 0.45 * F.col("overlap")) * (0.70 + 0.30 * confidence) / (1.25 + depth)


def expand_paths(
    best: DataFrame,
    seeds: DataFrame,
    edges: DataFrame,
    depth: int,
    step: Callable[[Column, int], Column],
    keys: tuple[str, ...] = ("q",),
    fanout: int = 0,
) -> DataFrame:
    """(keys, id, score, hop, votes) after walking `depth` hops from the seeds.

    A path never meets a node twice. Within a hop, rows are read in seed order, then edge order, and one is kept only if
    it beats the node's score so far - including the rows before it in the same hop. `step(score, hop)` gives the new
    score from the edge columns. `fanout` keeps the best n continuations of each path. Seeds carry `rank`.
    """
    node = [*keys, "id"]
    best = cut_lineage(best.select(*node, "score", F.lit(0).alias("hop"), F.lit(0).alias("votes")))
    edges = cut_lineage(edges)
    frontier = seeds.select(*node, "score", F.array("id").alias("path"), F.array(F.col("rank").cast("bigint")).alias("ord"))
    for hop in range(depth):
        reached = (
            frontier.withColumnRenamed("id", "source")
            .join(edges, [*keys, "source"])
            .where(~F.array_contains("path", F.col("target")))
            .select(
                *keys,
                F.col("target").alias("id"),
                F.concat("path", F.array("target")).alias("path"),
                F.col("ord").alias("parent"),
                F.concat("ord", F.array(F.col("epos").cast("bigint"))).alias("ord"),
                step(F.col("score"), hop).alias("score"),
            )
        )
        earlier = Window.partitionBy(*node).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
        floor = F.greatest(F.coalesce(rounded("prior"), F.lit(-99.0)), F.coalesce(F.max(rounded("score")).over(earlier), F.lit(-99.0)))
        improved = (
            reached.join(best.select(*node, F.col("score").alias("prior")), node, "left")
            .withColumn("floor", floor)
            .where(rounded("score") > F.col("floor"))
            .drop("floor", "prior")
        )
        improved = cut_lineage(improved)
        best = (
            best.unionByName(improved.select(*node, "score", F.lit(hop + 1).alias("hop"), F.lit(1).alias("votes")))
            .groupBy(*node)
            .agg(F.max("score").alias("score"), F.max_by("hop", "score").alias("hop"), F.sum("votes").cast("int").alias("votes"))
        )
        if fanout:
            place = F.row_number().over(Window.partitionBy(*keys, "parent").orderBy(rounded("score").desc(), "id"))
            improved = improved.withColumn("place", place).where(F.col("place") <= fanout)
            improved = improved.withColumn("ord", F.concat("parent", F.array(F.col("place").cast("bigint")))).drop("place")
        frontier = improved.drop("parent")
    return best


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges plus their reverses at 0.72 of weight and confidence; `apos` orders a node's list by target, then edge."""
    share = F.lit(REVERSE_SHARE)
    forward = edges.withColumn("apos", F.col("epos") * 2)
    back = edges.select(
        *[F.col(c) for c in edges.columns if c not in ("source", "target", "weight", "confidence")],
        F.col("target").alias("source"),
        F.col("source").alias("target"),
        (F.col("weight") * share).alias("weight"),
        (F.coalesce("confidence", F.lit(0.0)) * share).alias("confidence"),
        (F.col("epos") * 2 + 1).alias("apos"),
    )
    return forward.unionByName(back)


def bidirectional_expansion(base: DataFrame, edges: DataFrame, seed_count: int, depth: int, boost: float) -> DataFrame:
    """(q, id, score): breadth-first from the top seeds over edges both ways.

    `edges` carry q, source, target, weight, confidence, overlap, apos. A node is walked once, from the first edge that
    reaches it, with the score it had then; every edge may raise the node's final score.
    """
    frontier = top_k(base, "q", seed_count).select("q", "id", "score", F.col("rank").cast("bigint").alias("at"))
    visited = frontier.select("q", "id")
    scores = base.select("q", "id", "score")
    origin = base.select("q", "id", F.col("score").alias("base"))
    for hop in range(depth):
        strength = boost * (0.48 * F.col("weight") + 0.34 * F.coalesce("confidence", F.lit(0.0)) + 0.18 * F.col("overlap")) / (hop + 1)
        reached = (
            frontier.withColumnRenamed("id", "source")
            .join(edges, ["q", "source"])
            .select("q", F.col("target").alias("id"), "at", "apos", F.col("score").alias("source_score"), strength.alias("strength"))
            .join(origin, ["q", "id"])
            .select("q", "id", "at", "apos", "base", (F.col("base") + 0.35 * F.col("source_score") + F.col("strength")).alias("score"))
        )
        reached = cut_lineage(reached)
        scores = scores.unionByName(reached.select("q", "id", "score")).groupBy("q", "id").agg(F.max("score").alias("score"))
        first = F.min(F.struct("at", "apos", F.greatest("base", "score").alias("score"))).alias("first")
        fresh = reached.join(visited, ["q", "id"], "left_anti").groupBy("q", "id").agg(first)
        queue = F.row_number().over(Window.partitionBy("q").orderBy("first.at", "id", "first.apos"))
        frontier = fresh.select("q", "id", F.col("first.score").alias("score"), queue.cast("bigint").alias("at"))
        visited = visited.unionByName(frontier.select("q", "id"))
    return scores


def typed_edge_expansion(
    ranked_df: DataFrame, edges: DataFrame, types: list[str], seed_count: int, max_injections: int, seed_weight: float = 0.82
) -> DataFrame:
    """Ranked list plus at most `max_injections` new targets of the seeds' edges of the allowed types.

    `edges` carry q, source, target, type, weight, confidence, boost, overlap, t_importance.
    """
    seeds = ranked_df.where(F.col("rank") <= seed_count).select("q", F.col("id").alias("source"), F.col("score").alias("seed"))
    allowed = edges.where(F.col("type").isin(types)) if types else edges
    offered = (
        seeds.join(allowed, ["q", "source"])
        .join(ranked_df.select("q", F.col("id").alias("target")), ["q", "target"], "left_anti")
        .select(
            "q",
            F.col("target").alias("id"),
            (
                seed_weight * F.col("seed")
                + F.col("weight") * F.col("boost") * (0.60 + 0.40 * F.col("overlap"))
                + 0.04 * F.col("t_importance")
                + 0.02 * F.coalesce("confidence", F.lit(0.5))
            ).alias("score"),
        )
        .groupBy("q", "id")
        .agg(F.max("score").alias("score"))
    )
    injected = top_k(offered, "q", max_injections).select("q", "id", "score", F.lit(True).alias("injected"))
    return ranked(ranked_df.select("q", "id", "score", F.lit(False).alias("injected")).unionByName(injected), "q")


def neighbour_closure(nodes: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(root, id, boost, hop): every memory with its neighbours within `depth`, edges walked both ways.

    Strength multiplies max(0, .55 weight + .45 confidence) / (hop + 1) along the path; the root itself has boost 1, hop 0.
    """
    start = nodes.select(F.col("id").alias("root"), "id", F.lit(1.0).alias("score"))
    best = start.select("root", "id", "score", F.lit(0).alias("hop"))
    frontier = start.select("root", "id", "score", F.array("id").alias("path"), F.array(F.lit(0).cast("bigint")).alias("ord"))
    for hop in range(depth):
        gain = F.col("score") * F.greatest(F.lit(0.0), 0.55 * F.col("weight") + 0.45 * F.coalesce("confidence", F.lit(0.0))) / (hop + 1)
        reached = (
            frontier.withColumnRenamed("id", "source")
            .join(edges.select("source", "target", "weight", "confidence", "apos"), "source")
            .where(~F.array_contains("path", F.col("target")))
            .select(
                "root",
                F.col("target").alias("id"),
                F.concat("path", F.array("target")).alias("path"),
                F.struct("ord", "target", "apos").alias("place"),
                gain.alias("score"),
            )
        )
        order = F.row_number().over(Window.partitionBy("root").orderBy("place"))
        reached = reached.withColumn("at", order.cast("bigint"))
        earlier = Window.partitionBy("root", "id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        improved = (
            reached.join(best.select("root", "id", F.col("score").alias("prior")), ["root", "id"], "left")
            .withColumn("floor", F.greatest(F.coalesce(rounded("prior"), F.lit(-99.0)), F.coalesce(F.max(rounded("score")).over(earlier), F.lit(-99.0))))
            .where(rounded("score") > F.col("floor"))
        )
        improved = cut_lineage(improved.select("root", "id", "score", "path", F.array("at").alias("ord")))
        best = (
            best.unionByName(improved.select("root", "id", "score", F.lit(hop + 1).alias("hop")))
            .groupBy("root", "id")
            .agg(F.max("score").alias("score"), F.max_by("hop", "score").alias("hop"))
        )
        frontier = improved
    return best.select("root", "id", F.col("score").alias("boost"), "hop")

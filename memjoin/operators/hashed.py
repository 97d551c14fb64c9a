"""Hashed field tokens: a vector and its text become a few (action, bucket, weight) tokens that join by equality."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memjoin.functions.hashing import FNV_OFFSET, FNV_PRIME, fnv1a64, hash_octets, list_parts, list_pieces, umod, unit53
from memjoin.functions.text import token_set
from memjoin.operators.ranking import first_places, ranked, rounded, top_k
from memjoin.operators.vector import dot, project
from memjoin.session import cut_lineage

# Lexical boost per token slot, its cap, slots per token, sign bit of a projection point.
LEXICAL_STEP = 0.035
LEXICAL_CAP = 0.25
LEXICAL_SLOTS = 3
SIGN_BIT = 23


def _fnv(key: str) -> int:
    value = FNV_OFFSET
    for octet in key.encode():
        value = ((value ^ octet) * FNV_PRIME) % (1 << 64)
    return value


def projection_points(dims: int, actions: int, width: int) -> list[list[tuple[int, float]]]:
    """For every action, `width` (dimension, sign) points read off the hash of `field-action:action:offset`."""
    width = min(max(1, width), dims)

    def point(action: int, offset: int) -> tuple[int, float]:
        hashed = _fnv(f"field-action:{action}:{offset}")
        return hashed % dims, -1.0 if (hashed >> SIGN_BIT) & 1 else 1.0

    return [[point(a, o) for o in range(width)] for a in range(actions)]


def projection_plan(dims: int, actions: int, width: int) -> Column:
    """`projection_points` as one constant array<array<struct<dim, sign>>>; its size is actions x width, not data."""
    points = [[{"dim": d, "sign": s} for d, s in line] for line in projection_points(dims, actions, width)]
    return F.from_json(F.lit(json.dumps(points)), "array<array<struct<dim:int,sign:double>>>")


def lexical_hits(tokens: Column, actions: int) -> Column:
    """array<int>: how often the distinct tokens hit each action, three hashed actions per token.

    Tokens are dictionary-encoded per Arrow batch, so each is hashed once per batch.
    """

    def piece_hits(piece: pa.Array) -> np.ndarray:
        flat, lengths = list_parts(piece)
        rows = np.repeat(np.arange(len(lengths)), lengths)
        encoded = flat.dictionary_encode()
        words = encoded.dictionary.to_pylist()
        codes = encoded.indices.to_numpy(zero_copy_only=False)
        total = np.zeros(len(lengths) * actions, dtype=np.int64)
        for slot in range(LEXICAL_SLOTS):
            if words:
                hashed = hash_octets(pa.array([f"field-lex:{word}:{slot}" for word in words], pa.string()))
                action = (hashed % np.uint64(actions)).astype(np.int64)
                total += np.bincount(rows * actions + action[codes], minlength=total.size)
        return total.astype(np.int32)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def hits(batch: pa.Array) -> pa.Array:
        total = np.concatenate([np.zeros(0, np.int32), *map(piece_hits, list_pieces(batch))])
        offsets = np.arange(0, total.size + 1, actions, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(total))

    return hits(tokens)


def field_tokens(df: DataFrame, key: str, plan: Column, actions: int, keep: int, bucket_width: float, text: str = "text", vec: str = "vec") -> DataFrame:
    """(key, action, bucket, weight): the `keep` heaviest action tokens of every row."""
    rows = with_field_tokens(df.select(key, F.col(text).alias("text"), F.col(vec).alias("vec")), plan, actions, keep, bucket_width)
    return rows.select(key, F.explode("field").alias("t")).select(key, "t.action", "t.bucket", "t.weight")


def with_field_tokens(df: DataFrame, plan: Column, actions: int, keep: int, bucket_width: float) -> DataFrame:
    """`df` (text, vec, more columns) with `field`: the `keep` heaviest action tokens (action, bucket, weight) of every row.

    value = projection of the vector, weight = |value| + lexical boost, bucket = floor(value / bucket_width).
    """
    base = df.withColumn("hits", lexical_hits(token_set(F.col("text")), actions))
    values = base.withColumn("values", F.transform(plan, lambda points: project(F.col("vec"), points)))
    tokens = F.transform(
        F.arrays_zip("values", "hits"),
        lambda pair, action: F.struct(
            (-rounded(F.abs(pair["values"]) + F.least(F.lit(LEXICAL_CAP), pair["hits"] * LEXICAL_STEP))).alias("order"),
            action.cast("int").alias("action"),
            F.floor(rounded(pair["values"] / max(1e-6, bucket_width))).cast("int").alias("bucket"),
            (F.abs(pair["values"]) + F.least(F.lit(LEXICAL_CAP), pair["hits"] * LEXICAL_STEP)).alias("weight"),
        ),
    )
    heaviest = F.transform(F.slice(F.array_sort(tokens), 1, max(1, keep)), lambda t: F.struct(t["action"].alias("action"), t["bucket"].alias("bucket"), t["weight"].alias("weight")))
    return values.withColumn("field", heaviest).drop("hits", "values")


def promoted_level(id_col: Column, text_length: Column, mean_weight: Column, layers: int, probability: float, bias: float) -> Column:
    """Highest level reached by consecutive hash draws under the biased probability."""
    text_bias = umod(fnv1a64(F.concat(F.lit("field-importance:"), id_col, F.lit(":"), text_length.cast("string"))), 1000) / 1000.0
    base = min(0.95, max(0.0, probability))
    limit = F.least(F.lit(0.95), F.lit(base) * (1.0 + max(0.0, bias) * (0.5 * mean_weight + 0.5 * text_bias)))
    level = F.lit(0)
    passed = F.lit(base > 0.0)
    for step in range(1, layers):
        draw = unit53(fnv1a64(F.concat(F.lit("field-promote:"), id_col, F.lit(f":{step}"))))
        passed = passed & (draw <= limit)
        level = level + passed.cast("int")
    return level


def layered_postings(tokens: DataFrame, levels: DataFrame) -> DataFrame:
    """(layer, action, bucket, id, weight) for every layer up to the memory's level."""
    return tokens.join(levels, "id").select(
        F.explode(F.sequence(F.lit(0), F.col("level"))).alias("layer"), "action", "bucket", "id", "weight"
    )


def spread_buckets(query_tokens: DataFrame, radius: int) -> DataFrame:
    """Query tokens copied to each bucket within the radius, with the damping 1 / (1 + |delta|)."""
    return query_tokens.select(
        "q", "action", F.col("weight").alias("q_weight"), F.col("bucket").alias("asked"), F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("delta")
    ).select("q", "action", "q_weight", (F.col("asked") + F.col("delta")).alias("bucket"), (1.0 / (1 + F.abs("delta"))).alias("damping"))


def bucket_collisions(query_tokens: DataFrame, postings: DataFrame, radius: int) -> DataFrame:
    """(q, id, score, overlap): collision score and token overlap in one equi-join and one partial aggregation."""
    return (
        spread_buckets(query_tokens, radius)
        .join(postings, ["action", "bucket"])
        .groupBy("q", "id")
        .agg(
            F.sum(F.col("q_weight") * F.col("damping")).alias("score"),
            F.sum(F.col("q_weight") * F.col("weight") * F.col("damping")).alias("overlap"),
        )
    )


QUERY_BYTES = 8 << 20
MEMORY_ROWS, QUERY_ROWS = 20_000, 1024  # rows of a block where queries are too many to travel whole
SLICE_BYTES = 8 << 20  # of a slice's matrix over the asked (action, bucket) pairs
ACTION_SPAN = 1 << 32


class AskedField:
    """The tokens of some queries as matrices over the (action, bucket) pairs that they ask for."""

    def __init__(self, asked: pa.Table, radius: int):
        self.q, row = np.unique(asked["q"].to_numpy(), return_inverse=True)
        action, bucket, weight = (asked[c].to_numpy() for c in ("action", "bucket", "weight"))
        deltas = np.arange(-radius, radius + 1)
        code = (action[:, None].astype(np.int64) * ACTION_SPAN + bucket[:, None] + deltas).ravel()
        self.codes, place = np.unique(code, return_inverse=True)
        rows = np.repeat(row, len(deltas))
        self.weights = np.zeros((len(self.codes), len(self.q)))
        np.add.at(self.weights, (place, rows), (weight[:, None] / (1 + np.abs(deltas))).ravel())
        self.asks = np.zeros_like(self.weights)
        self.asks[place, rows] = 1.0
        self.actions = np.zeros((int(action.max(initial=0)) + 1, len(self.q)))
        np.add.at(self.actions, (action, row), weight)

    def scores(self, field: pa.Array) -> tuple[np.ndarray, ...]:
        """(memory x query) matrices: collision score, overlap, whether any token meets, 0.05 x weight of the shared actions, whether any is shared."""
        lengths = np.asarray(field.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
        flat = field.flatten()
        action, bucket, weight = (np.asarray(flat.field(c).to_numpy(zero_copy_only=False)) for c in range(3))
        rows = np.repeat(np.arange(len(lengths)), lengths)
        code = action.astype(np.int64) * ACTION_SPAN + bucket
        place = np.minimum(np.searchsorted(self.codes, code), max(len(self.codes) - 1, 0))
        met = self.codes[place] == code if len(self.codes) else np.zeros(len(code), bool)
        one, heavy = np.zeros((len(lengths), len(self.codes))), np.zeros((len(lengths), len(self.codes)))
        one[rows[met], place[met]] = 1.0
        heavy[rows[met], place[met]] = weight[met]
        known = action < len(self.actions)
        acts = np.zeros((len(lengths), len(self.actions)))
        acts[rows[known], action[known]] = 1.0
        return one @ self.weights, heavy @ self.weights, one @ self.asks > 0, 0.05 * (acts @ self.actions), acts @ (self.actions > 0) > 0


def _field_block(asked: AskedField, ids: np.ndarray, levels: np.ndarray, field: pa.Array, layers: int, beam: int, prefilter: int, cap: int) -> tuple[np.ndarray, ...]:
    """What one block of memories can add to any query's answer: its best collisions, its best of each layer, its best by shared actions."""
    order = np.argsort(ids, kind="stable")
    ids, levels, field = ids[order], levels[order], field.take(pa.array(order))
    if not len(ids):
        return tuple(np.zeros(0) for _ in FOUND)
    score, overlap, met, wide, shared = whole = [np.empty((len(asked.q), len(ids)), kind) for kind in (float, float, bool, float, bool)]
    step = max(1, SLICE_BYTES // (8 * max(1, len(asked.codes))))
    for at in range(0, len(ids), step):
        for matrix, part in zip(whole, asked.scores(field.slice(at, step))):
            matrix[:, at : at + step] = part.T
    out = []
    for k in range(len(asked.q)):
        picked = [first_places(met[k], score[k], prefilter), first_places(shared[k], wide[k], cap)]
        picked += [first_places(met[k] & (levels >= layer), score[k], 2 * beam) for layer in range(1, layers)]
        at = np.unique(np.concatenate(picked))
        out.append((np.full(len(at), asked.q[k]), ids[at], levels[at], score[k, at], overlap[k, at], met[k, at], wide[k, at], shared[k, at]))
    return tuple(np.concatenate(column) for column in zip(*out)) if out else tuple(np.zeros(0) for _ in FOUND)


FOUND = ["q", "id", "level", "score", "overlap", "met", "wide", "shared"]


def field_matches(memories: DataFrame, query_tokens: DataFrame, radius: int, layers: int, beam: int, prefilter: int, cap: int, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(q, id, level, score, overlap, met, wide, shared): every row that can be among a query's first `prefilter` collisions,
    `2 * beam` of a layer, or `cap` by shared actions.

    `memories`: id, level, field; `query_tokens`: q, action, bucket, weight. Collisions are counted by matrix products inside
    a block of memories and never leave it as pairs: a block sends a bounded number of rows for each query, so what is
    shuffled grows with the blocks. Few queries (their bytes are counted first) travel to the memories; more are cut into
    blocks, each block of queries meeting each block of memories once.
    """
    q_type, id_type = query_tokens.schema["q"].dataType.simpleString(), memories.schema["id"].dataType.simpleString()
    schema = f"q {q_type}, id {id_type}, level int, score double, overlap double, met boolean, wide double, shared boolean"
    memories, asked = memories.select("id", "level", "field"), query_tokens.select("q", "action", "bucket", "weight")
    limit = max(1, query_bytes // 32)
    head = asked.limit(limit + 1).toArrow()

    def block(asked_field: AskedField, rows) -> pa.RecordBatch:
        field = rows.column("field")
        field = field.combine_chunks() if isinstance(field, pa.ChunkedArray) else field
        ids, levels = (rows.column(c).to_numpy() if isinstance(rows, pa.Table) else rows.column(c).to_numpy(zero_copy_only=False) for c in ("id", "level"))
        found = _field_block(asked_field, ids, levels, field, layers, beam, prefilter, cap)
        kinds = [head.schema.field("q").type, rows.schema.field("id").type, pa.int32(), pa.float64(), pa.float64(), pa.bool_(), pa.float64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(column).cast(kind) for column, kind in zip(found, kinds)], FOUND)

    if head.num_rows <= limit:
        shared = memories.sparkSession.sparkContext.broadcast(head)

        def stream(batches):
            asked_field = AskedField(shared.value, radius)
            for batch in batches:
                if batch.num_rows and len(asked_field.q):
                    yield block(asked_field, batch)

        return memories.mapInArrow(stream, schema)
    m_blocks = max(1, -(-memories.count() // MEMORY_ROWS))
    q_blocks = max(1, -(-asked.select("q").distinct().count() // QUERY_ROWS))
    left = memories.select("*", F.pmod(F.xxhash64("id"), F.lit(m_blocks)).cast("int").alias("mb"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))
    right = asked.select("*", F.pmod(F.xxhash64("q"), F.lit(q_blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(m_blocks - 1))).alias("mb"))

    def meet(found: pa.Table, wanted: pa.Table) -> pa.Table:
        rows = block(AskedField(wanted, radius), found)
        return pa.Table.from_batches([rows])

    return left.groupBy("mb", "qb").cogroup(right.groupBy("mb", "qb")).applyInArrow(meet, schema)


def routed_beam(matches: DataFrame, layers: int, beam: int) -> DataFrame:
    """(q, id, routed): the beam kept after walking the layers from the top down to layer 1.

    A memory's collisions are the same in every layer it stands in, so a layer adds its own score once more to half of what
    the layer above has carried down; a layer without any collision leaves the beam as it was.
    """
    own = matches.where("met").select("q", "id", "level", "score")
    frontier = None
    for layer in range(layers - 1, 0, -1):
        hits = own.where(F.col("level") >= layer).select("q", "id", "score")
        if frontier is not None:
            carried = frontier.select("q", "id", (0.5 * F.col("routed")).alias("score"))
            hits = hits.unionByName(carried).groupBy("q", "id").agg(F.sum("score").alias("score"))
        frontier = top_k(hits, "q", beam).select("q", "id", F.col("score").alias("routed"))
    return frontier


def collision_candidates(matches: DataFrame, query_tokens: DataFrame, layers: int, beam: int, min_candidates: int, cap: int, prefilter: int, min_collision: float = 0.0, min_overlap: float = 0.0) -> DataFrame:
    """(q, id, score, overlap, rank) from `field_matches`: gated collisions plus 0.35 of the routed score, widened for starved queries.

    A routed memory that a gate dropped comes back when it collides at all. A query left with fewer than
    `min_candidates` takes every memory sharing an action at 0.05 x weight instead; whatever collides shares an action.
    """
    base = ranked(matches.where("met"), "q").join(routed_beam(matches, layers, beam), ["q", "id"], "left")
    passed = (F.col("rank") <= prefilter) & (F.col("score") >= min_collision) & ((F.lit(min_overlap) <= 0.0) | (F.col("overlap") >= min_overlap))
    kept = base.where(passed | F.col("routed").isNotNull()).select("q", "id", (F.col("score") + 0.35 * F.coalesce("routed", F.lit(0.0))).alias("score"), "overlap")
    counts = kept.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    starved = query_tokens.select("q").distinct().join(counts, "q", "left").where(F.coalesce("n", F.lit(0)) < min_candidates).select("q")
    widened = matches.where("shared").join(starved, "q", "left_semi").select("q", "id", F.col("wide").alias("score"), "overlap")
    return top_k(kept.join(starved, "q", "left_anti").unionByName(widened), "q", cap)


def field_overlap(pairs: DataFrame, query_tokens: DataFrame, tokens: DataFrame, radius: int) -> DataFrame:
    """(q, id, overlap) for given pairs: query weight x memory weight x damping over near buckets."""
    asked = pairs.join(spread_buckets(query_tokens, radius), "q")
    return asked.join(tokens, ["id", "action", "bucket"]).groupBy("q", "id").agg(
        F.sum(F.col("q_weight") * F.col("weight") * F.col("damping")).alias("overlap")
    )


def token_field_scores(
    candidates: DataFrame,
    query_side: DataFrame,
    memory_side: DataFrame,
    fetch: int,
    weights: tuple[float, float, float, float] = (0.50, 0.30, 0.14, 0.06),
) -> DataFrame:
    """Field, cosine, mask coverage and source parts in one score, ranked.

    `query_side`: q, q_vec, q_mask; `memory_side`: id, vec, mask; `candidates`: q, id, score, overlap (null: none).
    """
    field, semantic, activation, source = weights
    joined = candidates.join(query_side, "q").join(memory_side, "id")
    shared = F.bit_count(F.col("q_mask").bitwiseAND(F.col("mask"))) / F.greatest(F.lit(1), F.bit_count("q_mask"))
    score = (
        field * F.coalesce("overlap", F.lit(0.0))
        + semantic * dot(F.col("q_vec"), F.col("vec"))
        + activation * shared
        + source * F.col("score")
    )
    return top_k(joined.select("q", "id", score.alias("score")), "q", fetch)

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memjoin.functions import hashing as H
from memjoin.functions import text as X
from memjoin.functions.state import card_state, falsy_default, state_score
from memjoin.operators import vector as V


def fnv(text):
    value = 14695981039346656037
    for octet in text.encode():
        value = ((value ^ octet) * 1099511628211) % (1 << 64)
    return value


def test_both_hash_routes_agree_with_the_definition(spark):
    words = ["", "a", "hello", "ünïcode", "x" * 70, "日本語"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    rows = df.select("w", H.fnv1a64(F.col("w")).alias("e"), F.get(H.fnv1a64_tokens(F.array("w")), F.lit(0)).alias("t"), H.umod(H.fnv1a64(F.col("w")), 999983).alias("m"), H.unit53(H.fnv1a64(F.col("w"))).alias("u")).collect()
    for r in rows:
        want = fnv(r.w)
        assert r.e % (1 << 64) == want and r.t % (1 << 64) == want
        assert r.m == want % 999983
        assert r.u == (want >> 11) / float(1 << 53)


def test_embedding_and_mask_by_hand(spark):
    text = "The cat, the CAT sat on a mat"
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(X.tokens(F.col("t")).alias("k"))
    rows = df.select(H.hash_embedding(F.col("k")).alias("v"), H.activation_mask(F.col("k")).alias("m")).collect()
    want = np.zeros(64)
    mask = 0
    for token in "the cat the cat sat on a mat".split():
        h = fnv(token)
        want[h % 64] += -1.0 if (h >> 8) & 1 else 1.0
        if len(token) > 1:
            mask |= 1 << (h % 64)
    assert np.allclose(rows[0].v, want / np.linalg.norm(want))
    assert rows[0].m % (1 << 64) == mask
    assert rows[1].v == [0.0] * 64 and rows[1].m == 0
    assert rows[2].v == [0.0] * 64 and rows[2].m == 0


@pytest.mark.parametrize("left,right,want", [("aa bb", "bb cc", 1 / 3), ("", "bb", 0.0), ("a b", "a b", 0.0), ("aa", "aa aa", 1.0)])
def test_jaccard(spark, left, right, want):
    assert spark.range(1).select(X.jaccard(F.lit(left), F.lit(right))).first()[0] == pytest.approx(want)


def test_falsy_defaults_and_stale_edge(spark):
    rows = spark.createDataFrame(
        [(0.0, 180, 0, 0, "", False), (None, 179, 0, 0, "helpful", False), (0.3, 400, 0, 0, "ignored", True)],
        "importance double, age_days int, use_count int, evidence_count int, last_outcome string, protected boolean",
    )
    parts = card_state()
    out = rows.select(falsy_default(F.col("importance"), 0.5).alias("i"), parts["stale"].alias("s"), state_score(parts).alias("x")).collect()
    assert [r.i for r in out] == [0.5, 0.5, 0.3]
    assert [r.s for r in out] == [1.0, 0.0, 0.0]
    assert out[0].x == pytest.approx(0.07 * (1 - 180 / 365) - 0.22)


def test_vector_routes_match_numpy_with_ties(spark):
    rng = random.Random(5)
    vectors = {n: [rng.choice([-1.0, 0.0, 1.0]) for _ in range(8)] for n in range(60)}
    mem = spark.createDataFrame([(n, v) for n, v in vectors.items()], "id bigint, vec array<double>")
    asked = spark.createDataFrame([(n, v) for n, v in list(vectors.items())[:15]], "q bigint, vec array<double>")
    want = {}
    for q, a in list(vectors.items())[:15]:
        order = sorted(vectors, key=lambda n: (-float(np.dot(a, vectors[n])), n))[:7]
        want[q] = order
    for limit in (1 << 20, 0):
        got = {}
        for r in V.exact_vector_topk(mem, asked, 7, 8, broadcast_bytes=limit).orderBy("q", "rank").collect():
            got.setdefault(r.q, []).append(r.id)
        assert got == want


def test_hot_key_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "MEMORY_BLOCK_ROWS", 10)
    monkeypatch.setattr(V, "QUERY_BLOCK_ROWS", 4)
    mem = spark.range(95).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vec"))
    asked = spark.range(9).select(F.col("id").alias("q"), F.array(F.lit(1.0), F.lit(0.0)).alias("vec"))
    rows = V.exact_vector_topk(mem, asked, 3, 2, broadcast_bytes=0).collect()
    assert len(rows) == 27 and {r.id for r in rows} == {94, 93, 92}


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_approximate_search_finds_nine_of_ten_neighbours(spark, sf):
    mem = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    asked = mem.withColumnRenamed("id", "q")
    exact = V.exact_vector_topk(mem, asked, 10, 64).select("q", "id")
    found = V.celled_vector_topk(mem, asked, 10, 64).select("q", "id")
    assert exact.join(found, ["q", "id"], "left_semi").count() / exact.count() >= 0.9


def test_probes_follow_the_data(spark):
    """Tight clusters need few probes; a table without rows gives none."""
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16)) * 10
    rows = [(i, (centres[i % 8] + rng.normal(size=16) * 0.01).tolist()) for i in range(400)]
    mem = spark.createDataFrame(rows, "id bigint, vec array<double>")
    asked = mem.withColumnRenamed("id", "q")
    assert V.probes_needed(mem, asked, centres, 5, 16, 0.95, 64) == 1
    assert V.celled_vector_topk(mem.limit(0), asked.limit(0), 5, 16).count() == 0


def field_side(rng, key, count):
    return [(k, rng.randrange(4), [(a, rng.randrange(-2, 3), rng.random()) for a in rng.sample(range(6), 3)]) for k in range(count)]


def test_field_matches_hold_every_candidate(spark, monkeypatch):
    """The block pass gives the candidates that all colliding pairs would give, by either route of the queries."""
    import random

    from memjoin.operators import hashed as H

    rng = random.Random(5)
    memories, queries = field_side(rng, "id", 230), field_side(rng, "q", 9)
    index = spark.createDataFrame(memories, "id bigint, level int, field array<struct<action:int,bucket:int,weight:double>>")
    asked = spark.createDataFrame([(q, *t) for q, _, field in queries for t in field], "q bigint, action int, bucket int, weight double")
    plain = []
    for q, _, mine in queries:
        scores = {}
        for i, level, field in memories:
            met = [(w / (1 + abs(b - y)), w * v / (1 + abs(b - y))) for a, b, w in mine for x, y, v in field if a == x and abs(b - y) <= 1]
            shared = [0.05 * w for a, _, w in mine if a in {x for x, _, _ in field}]
            scores[i] = (sum(m[0] for m in met), sum(m[1] for m in met), bool(met), sum(shared), bool(shared), level)
        order = lambda value: sorted(value, key=lambda i: (-round(value[i], 9), i))
        beam = {}
        for layer in (3, 2, 1):
            merged = {i: s[0] + 0.5 * beam.get(i, 0.0) for i, s in scores.items() if s[2] and s[5] >= layer}
            beam = {i: merged[i] for i in order(merged)[:4]}
        first = order({i: s[0] for i, s in scores.items() if s[2]})[:20]
        kept = {i: s[0] + 0.35 * beam.get(i, 0.0) for i, s in scores.items() if s[2] and (i in beam or (i in first and s[0] >= 0.3 and s[1] >= 0.1))}
        if len(kept) < 17:
            kept = {i: s[3] for i, s in scores.items() if s[4]}
        plain += [(q, i, round(kept[i], 9)) for i in order(kept)[:10]]
    monkeypatch.setattr(H, "MEMORY_ROWS", 50)
    monkeypatch.setattr(H, "QUERY_ROWS", 4)
    for size in (H.QUERY_BYTES, 1):
        matches = H.field_matches(index, asked, 1, 4, 4, 20, 10, query_bytes=size)
        found = H.collision_candidates(matches, asked, 4, 4, 17, 10, 20, 0.3, 0.1)
        assert sorted((r.q, r.id, round(r.score, 9)) for r in found.collect()) == sorted(plain)
        beams = H.routed_beam(matches, 4, 4).groupBy("q").count().collect()
        assert all(r["count"] <= 4 for r in beams)


def test_int8_rounds_half_to_even(spark):
    row = spark.range(1).select(V.quantize_int8(F.array(F.lit(3.0), F.lit(4.0)))).first()[0]
    assert row == [round(0.6 * 127), round(0.8 * 127)]
    assert math.isclose(spark.range(1).select(V.dot_int8(F.array(F.lit(127)), F.array(F.lit(127)))).first()[0], 1.0)

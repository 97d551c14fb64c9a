import random

import pytest
from pyspark.sql import functions as F

from memjoin.operators import augment as A
from memjoin.operators import feedback as B
from memjoin.operators import fields as P
from memjoin.operators import graph as G
from memjoin.operators import metadata as M
from memjoin.operators import ranking as R
from memjoin.operators import rollups as U
from memjoin.operators.lexical import idf_token_scores, verbatim_hits
from memjoin.session import cut_lineage
from memjoin.sources import jsonl


def test_packing_stops_at_first_overflow_and_breaks_ties_by_id(spark):
    rows = spark.createDataFrame([(1, "b", 0.5, 4), (1, "a", 0.5, 4), (1, "c", 0.4, 9), (1, "d", 0.3, 1), (2, "x", 1.0, 99)], "q int, id string, score double, cost bigint")
    out = R.pack_budget(R.ranked(rows, "q"), 10).orderBy("q", "rank").collect()
    assert [(r.q, r.id) for r in out] == [(1, "a"), (1, "b")]


def test_blockers_block_only_later_rows(spark):
    ranked = spark.createDataFrame([(1, "a", 1, 5), (1, "blk", 2, 5), (1, "b", 3, 5), (1, "c", 4, 5)], "q int, id string, rank int, cost bigint")
    blockers = spark.createDataFrame([(1, "blk", "a"), (1, "blk", "b")], "q int, id string, blocked_id string")
    out = R.pack_with_blocks(ranked, blockers, 10).orderBy("rank").collect()
    assert [r.id for r in out] == ["a", "c"] and out[-1].used == 10


def test_threshold_packing_backfills_after_selected(spark):
    rows = spark.createDataFrame([(1, "a", 1, 1, 0.1), (1, "b", 2, 1, 0.9), (1, "c", 3, 1, 0.2)], "q int, id string, rank int, cost bigint, include_probability double")
    out = R.pack_threshold(rows, 10, 0.5, 2).orderBy("position").collect()
    assert [r.id for r in out] == ["b", "a"]


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_idf_ranking_does_not_depend_on_partitions(spark, parts):
    mem = spark.createDataFrame([(n, f"tok{n % 3} tok{n % 5} same") for n in range(40)], "id int, text string").repartition(parts)
    asked = spark.createDataFrame([(0, "tok1 tok2 same")], "q int, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    got = [(r.id, round(r.score, 12)) for r in idf_token_scores(mem, asked, 8, 10).orderBy("rank").collect()]
    spark.conf.set("spark.sql.shuffle.partitions", before)
    import math

    texts = {n: {f"tok{n % 3}", f"tok{n % 5}", "same"} for n in range(40)}
    score = {n: 0.0 for n in texts}
    for token in ("tok1", "tok2", "same"):
        held = [n for n in sorted(texts) if token in texts[n]][:8]
        for n in held:
            score[n] += math.log(1 + 40 / len(held))
    want = sorted([n for n in score if score[n] > 0], key=lambda n: (-round(score[n], 9), n))[:10]
    assert [g[0] for g in got] == want


def test_verbatim_hits_cut_words_and_short_passages(spark):
    docs = spark.createDataFrame([(1, "xx alpha beta gamma delta epsilon zeta yy"), (2, "tiny"), (3, "nothing here")], "id int, text string")
    asked = spark.createDataFrame([(1, "pha beta gamma delta epsilon ze"), (2, "in"), (3, "alpha gamma"), (4, "")], "q int, text string")
    got = {(r.q, r.id) for r in verbatim_hits(docs, asked).collect()}
    assert got == {(1, 1), (2, 2), (2, 3)}


def test_expansion_matches_a_queue_walk_on_a_cyclic_graph(spark):
    rng = random.Random(3)
    nodes = [f"n{i}" for i in range(8)]
    base = {n: round(rng.random(), 3) for n in nodes}
    edges = [(rng.choice(nodes), rng.choice(nodes), round(rng.random(), 2)) for _ in range(30)]
    edges = [(a, b, w) for a, b, w in edges if a != b]
    best = dict(base)
    seeds = sorted(base.items(), key=lambda x: (-x[1], x[0]))[:3]
    frontier = [(n, s, [n]) for n, s in seeds]
    for hop in range(3):
        following = []
        for node, score, path in frontier:
            for a, b, w in edges:
                if a == node and b not in path:
                    new = 0.62 * score + w / (1.25 + hop)
                    if round(new, 9) > round(best[b], 9):
                        best[b] = new
                        following.append((b, new, path + [b]))
        frontier = following
    b = spark.createDataFrame([(1, n, s) for n, s in base.items()], "q int, id string, score double")
    s = spark.createDataFrame([(1, n, x, k + 1) for k, (n, x) in enumerate(seeds)], "q int, id string, score double, rank int")
    e = spark.createDataFrame([(1, x, y, w, k) for k, (x, y, w) in enumerate(edges)], "q int, source string, target string, weight double, epos int")
    out = G.expand_paths(b, s, e, 3, lambda score, hop: 0.62 * score + F.col("weight") / (1.25 + hop))
    assert {r.id: round(r.score, 9) for r in out.collect()} == {n: round(v, 9) for n, v in best.items()}


@pytest.mark.parametrize("slices", [2, 5, 4096])
def test_sliced_fold_equals_the_event_by_event_fold(spark, slices):
    rng = random.Random(11)
    events = [(rng.choice([1, 1, 1, 2, 3]), n, rng.choice(B.OUTCOMES), rng.random() < 0.1) for n in range(300)]
    want = {}
    for memory, _, outcome, protected in events:
        s = want.setdefault(memory, [0.0, 0.0, 0, 0, "", False])
        clip = lambda v, b: max(-b, min(b, v))
        s[0] = clip(s[0] + B.IMPORTANCE_STEP[outcome], 0.45)
        s[1] = clip(s[1] + B.BIAS_STEP[outcome], 0.9)
        s[2] += B.USE_STEP[outcome]
        s[3] += B.EVIDENCE_STEP[outcome]
        s[4], s[5] = outcome, s[5] or protected
    df = spark.createDataFrame(events, "memory_id int, seq bigint, outcome string, protected boolean")
    for r in B.memory_state(df, slices).collect():
        got = [r.importance_delta, r.score_bias, r.use_count_delta, r.evidence_count_delta, r.last_outcome, r.protected]
        assert got[:2] == pytest.approx(want[r.memory_id][:2], abs=1e-9) and got[2:] == want[r.memory_id][2:]
    first, second = df.where("seq < 150"), df.where("seq >= 150")
    for r in B.merge_state(B.memory_state(first), second).collect():
        assert [r.importance_delta, r.score_bias] == pytest.approx(want[r.memory_id][:2], abs=1e-9)
        assert r.last_outcome == want[r.memory_id][4]


def test_bounded_buckets_match_a_full_sort(spark):
    rng = random.Random(2)
    cards = [(n, f"p{rng.randrange(4)}", f"b{rng.randrange(2)}", f"u{rng.randrange(3)}", rng.randrange(11) / 10, rng.randrange(50)) for n in range(200)]
    mem = spark.createDataFrame(cards, "id int, project string, brand string, user_id string, importance double, age_days int")
    asked = spark.createDataFrame([(1, "u1", "p2", "b0"), (2, "u0", "p9", "b1")], "q int, user_id string, project_id string, brand string")
    values = M.query_metadata(asked)
    got = {}
    for r in M.bounded_buckets(values, M.metadata_index(mem), mem, 6).orderBy("n").collect():
        got.setdefault((r.q, r.field, r.value), []).append(r.id)
    for (q, field, value), ids in got.items():
        project, brand = {1: ("p2", "b0"), 2: ("p9", "b1")}[q]
        held = [c for c in cards if value in ({"user_id": [c[3]], "project": [c[1]], "brand": [c[2]]}.get(field) or [c[1], c[2], c[3]])]
        held.sort(key=lambda c: (c[1] != project, c[2] != brand, -c[4], c[5], c[0]))
        assert ids == [c[0] for c in held[:6]]


def test_promotion_needs_every_gate(spark):
    rows = [("tool", n % 6, 0.91) for n in range(30)] + [("mood", n % 2, 0.95) for n in range(30)]
    preds = spark.createDataFrame([(n, f"license constraint" if f == "tool" else f, f"v{v}", c) for n, (f, v, c) in enumerate(rows)], "item int, field string, value string, confidence double")
    registry = P.record_predictions(P.seed_registry(spark), P.resolved(preds, P.seed_registry(spark)))
    lifts = spark.createDataFrame([("license_constraint", 0.05), ("mood", 0.5)], "field string, value double")
    none = spark.createDataFrame([], "field string, value double")
    out = {r.name: r for r in P.promote_ready(registry, lifts, none).collect()}
    assert out["license_constraint"].status == "promoted" and out["license_constraint"].version == 2
    assert out["mood"].status == "proposed" and out["project"].version == 1


def test_cache_keys_escape_non_ascii(spark):
    import hashlib
    import json

    text = 'Über "x"\n日本'
    got = spark.createDataFrame([(text,)], "t string").select(P.stable_key(F.col("t"))).first()[0]
    body = json.dumps({"cache_key_mode": "stable-text-v1", "prompt_version": P.PROMPT_VERSION, "text": text}, sort_keys=True, separators=(",", ":"))
    assert got == hashlib.sha256(body.encode()).hexdigest()


def test_prediction_json_shapes(spark):
    bodies = ['[{"field":"A b","value":" x  y ","confidence":2}]', '{"fields":[{"field_name":"c","value":"v","confidence":0.5,"span":"s"}]}', '{"predictions":[{"field":"d","value":"","confidence":0.5}]}', '{"fields":[]}']
    rows = spark.createDataFrame([(b,) for b in bodies], "b string").select(P.parsed_predictions(F.col("b")).alias("p")).collect()
    assert [(p.field, p.value, p.confidence) for p in rows[0].p] == [("a_b", "x y", 1.0)]
    assert rows[1].p[0].span == "s" and rows[2].p == [] and rows[3].p == []


def test_numbering_and_quantiles(spark):
    rows = spark.range(0, 101, 1, 7).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    out = {r.g: r for r in U.exact_quantiles(rows, "g", "v", {"p50": (0.5, U.ceil_place), "floor": (0.5, U.floor_place), "p95": (0.95, U.ceil_place)}).collect()}
    assert (out[0].p50, out[0].floor, out[0].p95) == (50.0, 50.0, 96.0)
    placed = jsonl.numbered(cut_lineage(rows.orderBy("v"))).orderBy("v").collect()
    assert [r.pos for r in placed] == list(range(101))


def test_bootstrap_bounds_hold_the_mean(spark):
    long = spark.range(50).select(F.col("id").alias("key"), F.lit("m").alias("metric"), (F.col("id") % 5).cast("double").alias("value"))
    r = U.bootstrap_ci(long, 100).first()
    assert 1.0 < r.ci_low < 2.0 < r.ci_high < 3.0
    again = U.bootstrap_ci(long.repartition(3), 100).first()
    assert (round(again.ci_low, 9), round(again.ci_high, 9)) == (round(r.ci_low, 9), round(r.ci_high, 9))
    none = long.limit(0)
    assert U.bootstrap_ci(none, 100).count() == 0


def test_resample_weights_are_poisson():
    import numpy as np

    reps = np.arange(300, dtype=np.int64) * U.SPREAD
    mixed = (reps + np.arange(200)[:, None]) % U.PRIME
    for step in U.MIXES:
        mixed = (mixed * mixed + mixed * step + 7) % U.PRIME
    weights = np.searchsorted(U.COUNTS, mixed, side="right")
    assert abs(weights.mean() - 1) < 0.03 and abs(weights.var() - 1) < 0.05
    assert abs((weights == 0).mean() - np.exp(-1)) < 0.02


def test_jsonl_round_trip_and_repair(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", [("z", 1)]), (1, "a", None)], "n int, a string, l array<struct<y:string,x:int>>")
    assert sorted(r.value for r in jsonl.json_lines(df).collect()) == ['{"a":"a","l":null,"n":1}', '{"a":"b","l":[{"x":1,"y":"z"}],"n":2}']
    path = str(tmp_path / "t")
    spark.createDataFrame([('{"t":"ok \\u12 x"}',), ("",), ('{"t":',)], "value string").coalesce(1).write.text(path)
    rows = jsonl.sanitized(jsonl.scan_text_lines(spark, path), "t string")
    counts = jsonl.kept_counts(rows).first()
    assert (counts.kept, counts.skipped) == (1, 1)


def test_decoys_fill_placeholders_once(spark):
    q = spark.createDataFrame([(1, "qa1", "ask {answer}?", "yes", "", [])], "uid int, qa_id string, query string, answer string, positive string, relevant array<string>")
    donors = spark.createDataFrame([(1, "qa1", "d1", "s", "c", 0.0, 3, 0, 0, "")], "uid int, qa_id string, id string, summary string, cluster string, importance double, age_days int, use_count int, evidence_count int, last_outcome string")
    out = A.decoy_cards(q, donors, 12, A.FORENSIC_DECOYS, A.EVAL_FALLBACK, "adversarial_eval::").collect()
    assert len(out) == 12 and all("{query}" not in r.text and r.importance == 0.5 for r in out)
    assert any(r.text.startswith("ask {answer}?") for r in out)
    with pytest.raises(ValueError):
        A.pick_families(A.FORENSIC_DECOYS, include={"no_such_family"})
    assert {t[0] for t in A.pick_families(A.TRAINING_DECOYS, include={"answer_shaped"})} == {"same_context_wrong_answer_negative", "answer_shaped_wrong_fact_negative"}


def test_growth_keeps_the_relevant_cards_ranked(spark):
    """Unrelated cards added to the pool do not push a relevant card out of the top."""
    mem = spark.createDataFrame([(f"m{n}", f"subject{n} detail{n} note") for n in range(20)], "id string, text string")
    asked = spark.createDataFrame([(0, "subject7 detail7")], "q int, text string")
    case = spark.createDataFrame([(0, "subject7 detail7", "", [], "p")], "q int, query string, positive string, bases array<string>, project string")
    grown = mem.unionByName(A.growth_cards(case, "unrelated", 15, 3).select("id", "text"))
    for pool in (mem, grown):
        assert idf_token_scores(pool, asked, 100, 3).orderBy("rank").first().id == "m7"


def test_file_order_follows_paths_not_sizes(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f'{{"n": {i}}}\n' for i in range(5)))
    (tmp_path / "b.jsonl").write_text("".join(f'{{"n": {i}, "pad": "{"x" * 400}"}}\n' for i in range(100, 150)))
    found = jsonl.scan(spark, str(tmp_path), "n int", limit=7).orderBy("n").collect()
    assert [r.n for r in found] == [0, 1, 2, 3, 4, 100, 101]
    (tmp_path / "c.jsonl").write_text('{"n": 500}\n\n{"n": 501\n')
    lines = jsonl.scan_text_lines(spark, str(tmp_path))
    cut = jsonl.sanitized(lines, "n int", offset=54, limit=10)
    assert [(r.pos, r.kept) for r in cut.orderBy("pos").collect()] == [(54, True), (55, True), (57, False)]
    assert jsonl.require_kept(cut).count() == 2
    with pytest.raises(ValueError):
        jsonl.require_kept(jsonl.sanitized(lines, "n int", offset=57, limit=1))


def test_registry_counts_do_not_depend_on_batches(spark):
    def rows(values):
        return spark.createDataFrame([("topic", v, 0.9) for v in values], "field string, value string, confidence double")

    seed = P.seed_registry(spark)
    one = rows(["a", "b", "a"])
    first, known = P.record_predictions(seed, one), P.field_values(one)
    two = rows(["c", "d", "b"])
    second = P.record_predictions(first, two, known).where("name = 'topic'").first()
    assert (second.seen_count, second.distinct_count) == (6, 4)
    assert P.field_values(two, known).count() == 4


def test_promotion_raises_the_version_once(spark):
    preds = spark.createDataFrame([(f, f"v{i}", 0.95) for f in ("new_a", "new_b") for i in range(30)], "field string, value string, confidence double")
    before = P.record_predictions(P.seed_registry(spark), preds, version=3)
    gates = spark.createDataFrame([("new_a", 0.1), ("new_b", 0.1)], "field string, value double")
    after = P.promote_ready(before, gates, gates.limit(0), version=3)
    assert {r.version for r in after.where("name like 'new%'").collect()} == {4}
    assert P.raised_version(before, after, 3) == 4 and P.raised_version(after, after, 4) == 4


def test_no_machine_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from memjoin.session import scratch_dir

    remote = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        scratch_dir(remote)


def test_seven_datasets_and_their_manifest(spark, tmp_path):
    """Every split once, counts and checksums of what was written; an empty family still has its entries."""
    from memjoin.operators import exports as X

    items = [("train", "query", "query::1"), ("train", "evidence", "evidence::1::0"), ("holdout", "query", "query::9"), ("unused", "query", "query::5")]
    labels = spark.createDataFrame(items, "split string, kind string, item_id string")
    chats = labels.select(F.array(F.struct(F.lit("user").alias("role"), F.col("item_id").alias("content"))).alias("messages"), F.struct("split", "kind", "item_id").alias("metadata"))
    pairs = spark.createDataFrame([], "split string, query_id string, candidate_id string, is_evidence boolean")
    path = str(tmp_path / "datasets")
    found = {r.dataset: r for r in X.export_datasets({"field_labels": labels, "sft": chats, "retrieval_pairs": pairs}, path, "v1").collect()}
    assert {name: r.rows for name, r in found.items()} == {
        "field_labels_all": 3, "field_labels_train": 2, "field_labels_holdout": 1, "sft_train": 2, "sft_holdout": 1, "retrieval_pairs_train": 0, "retrieval_pairs_holdout": 0,
    }
    assert found["field_labels_all"].checksum == found["field_labels_train"].checksum + found["field_labels_holdout"].checksum == found["sft_train"].checksum + found["sft_holdout"].checksum
    back = spark.read.json(found["sft_train"].path).select("metadata.item_id").collect()
    assert sorted(r.item_id for r in back) == ["evidence::1::0", "query::1"]


def test_lexical_scores_by_matrix_and_by_join(spark):
    """Queries that travel and queries that join give one ranking; null and empty texts score nothing."""
    import random

    from memjoin.operators.lexical import idf_token_scores

    rng = random.Random(2)
    texts = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(12)))) for i in range(200)] + [(900, None), (901, "")]
    mem = spark.createDataFrame(texts, "id bigint, text string").repartition(5)
    asked = spark.createDataFrame([(q, " ".join(f"w{rng.randrange(45)}" for _ in range(4))) for q in range(7)] + [(7, "nothing known")], "q bigint, text string")
    rows = [sorted((r.q, r.id, round(r.score, 9), r["rank"]) for r in idf_token_scores(mem, asked, None, 5, matrix_bytes=size).collect()) for size in (128 << 20, 0)]
    assert rows[0] == rows[1] and len(rows[0]) == 35


def test_bootstrap_draws_as_many_as_there_are(spark):
    import numpy as np

    values = {"m": sorted((k * k % 37) / 4 for k in range(150)), "one": [2.5], "two": [0.0, 1.0]}
    long = spark.createDataFrame([(name, v) for name, vs in values.items() for v in reversed(vs)], "metric string, value double")
    out = {r.metric: (r.ci_low, r.ci_high) for r in U.bootstrap_ci(long.repartition(5), 200, 16).collect()}
    for name, vs in values.items():
        mixed = (np.arange(200)[:, None] * U.SPREAD + np.arange(len(vs))) % U.PRIME
        for step in U.MIXES:
            mixed = (mixed * mixed + mixed * step + 7) % U.PRIME
        means = np.sort(np.array(vs)[mixed % len(vs)].mean(axis=1))
        assert np.allclose(out[name], (means[4], means[194]))


def test_vector_scores_are_held_in_tiles(monkeypatch):
    import numpy as np

    from memjoin.operators import vector as V

    rng = np.random.default_rng(3)
    ids, asked = rng.permutation(300), np.arange(70)
    memories, queries = np.round(rng.standard_normal((300, 4))), np.round(rng.standard_normal((70, 4)))  # many ties
    held = []
    best = V._best
    monkeypatch.setattr(V, "_best", lambda scores, k: held.append(scores.size) or best(scores, k))
    monkeypatch.setattr(V, "QUERY_TILE", 16, raising=False)
    monkeypatch.setattr(V, "MEMORY_TILE", 32, raising=False)
    q, found, score = V._block_topk(asked, queries, ids, memories, 5)
    assert max(held) <= 16 * (32 + 5)
    for row in asked:
        own = {int(i): float(memories[at] @ queries[row]) for at, i in enumerate(ids)}
        wanted = sorted(own, key=lambda i: (-round(own[i], 9), i))[:5]
        got = dict(zip(found[q == row].tolist(), score[q == row].tolist()))
        assert sorted(got, key=lambda i: (-round(got[i], 9), i)) == wanted and len(got) == 5

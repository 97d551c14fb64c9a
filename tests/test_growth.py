"""Steps whose cost a review found to grow: results against plain versions, and the plan or task figure that was mended."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from memjoin.operators import fields as P

WORDS = P.BRANDS + P.TOOLS + P.COLORS + P.TONES


def plain_predictions(text):
    """(field, value) of a text in order, one pattern after the other."""
    if text is None:
        return []
    low = text.lower()

    def found(pattern):
        return list(dict.fromkeys(re.findall(pattern, low, re.ASCII)))

    users, projects = found(r"\buser_\d{3}\b"), found(r"\bproject_\d{3}\b")
    words = found(r"\b(?:" + "|".join(WORDS) + r")\b")
    out = [("user_id", v) for v in users] + [("entity", v) for v in users] + [("project", v) for v in projects] + [("entity", v) for v in projects]
    out += [("session_id", v) for v in found(r"\buser_\d{3}_project_\d{3}_[a-z0-9_:-]+\b")]
    out += [("brand", v) for v in words if v in P.BRANDS] + [("entity", v) for v in words if v in P.BRANDS] + [("tool", v) for v in words if v in P.TOOLS]
    out += [("preference", f"color:{v}") for v in words if v in P.COLORS] + [("preference", f"tone:{v}") for v in words if v in P.TONES]
    out += [("time_scope", name) for name, terms in (("current", P.CURRENT_TERMS), ("stale", P.STALE_TERMS)) if any(t in low for t in terms)]
    return out + [("correction", "has_correction_signal")] * any(t in low for t in P.CORRECTION_SIGNALS)


def test_rules_search_every_text_once(spark):
    """The word pattern ran once for each of five parts, and every marker lowered the text again."""
    texts = [
        None, "", "user_001 user_0012 user_002 USER_001", "project_010-project_011, project_01", "user_003_project_004_a:project_005-user_006 tail",
        "Teal lime limes compliance-first visual-formal a.qwen _slack jira", "amber ambers ember kinetic, signal/drive github", "older nowhere override",
        "user_007:project_008:aurora:bigquery:graphite", " ".join(WORDS), "-".join(reversed(WORDS)), "".join(WORDS),
    ]
    items = spark.createDataFrame(list(enumerate(texts)), "item int, text string")
    out = P.extract(items, "item")
    got = {n: [] for n in range(len(texts))}
    for row in sorted(out.collect(), key=lambda r: (r.item, r.pos)):
        got[row.item].append((row.field, row.value))
    assert got == {n: plain_predictions(text) for n, text in enumerate(texts)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2 and plan.count("lower(") == 1


SF = "/root/testdata/sf0.001"


def test_only_cards_of_a_pair_are_annotated(spark, monkeypatch):
    """every card was labelled, twice, to annotate the few that are ranked."""
    from memjoin.plans import metadata as PM

    seen, plain = [], P.extract

    def watched(items, item, text="text"):
        seen.append(items.select(item).distinct())
        return plain(items, item, text)

    monkeypatch.setattr(P, "extract", watched)
    out = PM.v15(spark, SF)
    asked = {r.id for r in out.select("id").collect()}
    assert {r[0] for r in seen[0].collect()} == asked and len(asked) < spark.read.parquet(f"{SF}/documents.parquet").count()


def test_extraction_batches_hold_a_file_for_each_core(spark, monkeypatch):
    """F16: one file a batch left one task to label a third of all texts."""
    from pathlib import Path

    from memjoin.plans import feedback as PF

    folders, plain = {}, PF.scratch
    monkeypatch.setattr(PF, "scratch", lambda session, name: folders.setdefault(name, plain(session, name)))
    PF.t7(spark, SF)
    files, cores = list(Path(folders["texts"]).glob("*.parquet")), spark.sparkContext.defaultParallelism
    batches = sorted(p.name for p in Path(folders["predictions"]).glob("batch=*"))
    assert len(files) == 3 * cores and batches == ["batch=0", "batch=1", "batch=2"]


def plain_graph(rows, specs):
    """(source, target, type, weight, edge_rank) by comparing every two lines of a bucket."""
    best = {}
    for order, (field, kind, weight, reach) in enumerate(specs):
        for bucket in {(r[1], r[3]) for r in rows if r[2] == field}:
            ids = sorted(r[0] for r in rows if r[2] == field and (r[1], r[3]) == bucket)
            for i, a in enumerate(ids):
                for b in ids[max(0, i - reach) : i] + ids[i + 1 : i + reach + 1]:
                    best[a, b] = min(best.get((a, b), (9.0,)), (-weight, order, kind))
    out = []
    for source in {a for a, _ in best}:
        found = sorted((w, kind, b) for (a, b), (w, _, kind) in best.items() if a == source)
        out += [(source, b, kind, -w, n + 1) for n, (w, kind, b) in enumerate(found)]
    return sorted(out)


def test_graph_edges_do_not_travel_one_by_one(spark, monkeypatch):
    """every edge of every bucket was a row, shuffled and sorted twice."""
    from memjoin.operators import metadata as M

    monkeypatch.setattr(M, "BLOCK", 7)
    rng = random.Random(3)
    rows = [(n, source, field, f"v{rng.randrange(size)}", 1.0) for n in range(90) for source in ("metadata", "derived_metadata") for field, size in (("project", 2), ("brand", 1), ("entity", 5), ("tool", 3), ("topic", 1)) if rng.random() < 0.8]
    specs = [("project", "same_project", 0.4, 3), ("brand", "same_brand", 0.9, 5), ("entity", "a_type", 0.4, 9), ("tool", "same_tool", 0.1, 12)]
    index = spark.createDataFrame(rows, "id bigint, source string, field string, value string, confidence double").repartition(5)
    out = M.metadata_graph(index, specs)
    expected = plain_graph(rows, specs)
    assert sorted(tuple(r) for r in out.collect()) == expected
    assert "hashpartitioning(source#" in (plan := out._jdf.queryExecution().executedPlan().toString()) and not re.search(r"hashpartitioning\(source#\d+L?, target#", plan)
    only = spark.createDataFrame([(5,), (5,), (88,)], "id bigint")
    assert sorted(tuple(r) for r in M.metadata_graph(index, specs, only).collect()) == [r for r in expected if r[0] in (5, 88)]


def test_decoy_keys_are_hashed_by_batch(spark):
    """keys that hold whole texts were hashed byte by byte in the expression, up to ten times each."""
    from memjoin.functions.hashing import fnv1a64, fnv1a64_text
    from memjoin.operators import augment as A

    texts = spark.createDataFrame([(t,) for t in (None, "", "a", "qa1:Grüße 日本:0:", "long " * 300)], "t string")
    assert all(r.a == r.b for r in texts.select(fnv1a64(F.col("t")).alias("a"), fnv1a64_text(F.col("t")).alias("b")).collect())
    asked = spark.createDataFrame([(1, "qa1", "what " * 90, "", "", ["x"])], "uid bigint, qa_id string, query string, answer string, positive string, relevant array<string>")
    donors = spark.createDataFrame([(1, "qa1", f"c{n}", "s", "k", 0.5, 1, 1, 1, "") for n in range(3)], "uid bigint, qa_id string, id string, summary string, cluster string, importance double, age_days bigint, use_count bigint, evidence_count bigint, last_outcome string")
    out = A.training_labels(A.decoy_cards(asked, donors, 3, A.TRAINING_DECOYS, A.TRAINING_FALLBACK, "x::"), 8.0, 4.0)
    assert out.count() == 3 and "conv(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_runs_are_composed_by_batch():
    """F8: every run was cut out of its frame and composed alone, a call of pandas for nearly every event."""
    import time

    import numpy as np
    import pandas as pd

    from memjoin.streaming import folds

    def plain(outcomes, step, bound):
        shift, low, high = 0.0, -bound, bound
        for outcome in outcomes:
            by = step.get(outcome, step["ignored"])
            shift, low, high = shift + by, min(bound, max(-bound, low + by)), min(bound, max(-bound, high + by))
        return shift, low, high

    rng = np.random.default_rng(5)

    def frame(rows, keys):
        return pd.DataFrame({"memory_id": rng.integers(0, keys, rows), "seq": rng.permutation(rows * 5 // 4)[:rows], "outcome": rng.choice(["helpful", "corrected", "ignored", "odd"], rows), "protected": rng.random(rows) < 0.1})

    for rows, keys in ((1500, 2), (1500, 900), (40, 1), (0, 1)):
        given = frame(rows, keys)
        (out,) = folds.run_maker(folds.MEMORY)(iter([given]))
        got = {(r.memory_id, r.at): tuple(r)[3:] for r in out.itertuples()}
        ordered, want, before = given.sort_values("seq"), {}, None
        for row in ordered.itertuples(index=False):
            number = number if before is not None and row.seq == before + 1 else row.seq
            want.setdefault((row.memory_id, number), []).append(row)
            before = row.seq
        expected = {}
        for (key, _), run in want.items():
            names = [r.outcome for r in run]
            counts = (names.count("helpful"), names.count("corrected"))
            shapes = plain(names, folds.MEMORY.importance, folds.MEMORY.importance_bound) + plain(names, folds.MEMORY.bias, folds.MEMORY.bias_bound)
            expected[key, run[0].seq] = (names[-1], any(r.protected for r in run), *counts, len(names) - sum(counts), *shapes)
        assert got == expected
    wide, began = frame(40_000, 40_000), time.process_time()
    list(folds.run_maker(folds.MEMORY)(iter([wide])))
    assert time.process_time() - began < 1.0


def test_item_files_hold_many_records(spark, monkeypatch):
    """every record was two files of its own."""
    from pathlib import Path

    from memjoin.plans import ingest

    folders, plain = {}, ingest.scratch
    monkeypatch.setattr(ingest, "scratch", lambda session, name: folders.setdefault(name, plain(session, name)))
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    out, records = ingest.s2(spark, SF), turns.select("conv_id").distinct().count()
    assert out.count() == turns.count()
    for name in ("list", "held"):
        assert len(list(Path(folders[name]).glob("part-*"))) * 5 < records


def test_passages_travel_to_the_texts(spark):
    """every text was cut into word grams and joined with labels and candidates, for each reading of the relevant pairs."""
    from memjoin.operators.lexical import verbatim_hits
    from memjoin.sources import tables

    texts = ["xx one two three four five six seven yy", "one  two three four", None, "", "tiny", "two three\nfour five six", "a one two three four five six seven yy", "one two three"]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "id bigint, text string")
    asked = ["ne two three four five six sev", "two three", "three\nfour five", "in", "one two three", "", None, " one two three four five six seven ", "six", "two  three"]
    passages = spark.createDataFrame([*enumerate(asked), (1, "tiny")], "q int, text string")
    want = sorted((q, k) for q, p in [*enumerate(asked), (1, "tiny")] if p for k, t in [*enumerate(texts), (0, texts[0])] if t and p in t)
    found = verbatim_hits(docs, passages)
    assert sorted(map(tuple, found.collect())) == want
    plan = tables.relevance(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and "labels" not in plan
    joined = verbatim_hits(docs.distinct(), passages, passage_bytes=0)
    assert sorted(set(map(tuple, joined.collect()))) == sorted(set(want))


def test_relevant_pairs_are_searched_once(spark, monkeypatch):
    """the summary searched all texts again for each of its parts."""
    from memjoin.plans import rollups as PR

    calls, plain = [], PR.tables.relevance
    monkeypatch.setattr(PR.tables, "relevance", lambda *a: calls.append(a) or plain(*a))
    assert PR.s12(spark, SF).count() > 0
    assert len(calls) == 1


def held_by(work, batch):
    """Peak bytes that `work` allocates beside its batch."""
    import tracemalloc

    tracemalloc.start()
    out = work(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def test_a_full_batch_is_hashed_in_pieces(spark):
    """what a worker held grew with the tokens of its batch."""
    import numpy as np
    import pyarrow as pa

    from memjoin.functions import hashing as H

    rows = [None, [], ["a"], ["only"] * 300_000, *([f"word{n % 97}" for n in range(k, k + 300)] for k in range(6_000))]
    batch = pa.array(rows, pa.list_(pa.string()))
    small = [p.to_pylist() for p in H.list_pieces(batch.slice(0, 10), 700)]
    assert [row for piece in small for row in piece] == rows[:10]
    assert all(len(piece) == 1 or sum(len(row or []) for row in piece) <= 700 for piece in small)
    masks, peak = held_by(H.activation_mask.func, batch)
    assert peak < 40 << 20
    want = [0, 0, 0, 1 << (int(H.hash_octets(pa.array(["only"]))[0]) & 63)]
    assert masks.to_numpy()[:4].view(np.uint64).tolist() == want


def test_field_slices_are_bounded_in_bytes():
    """a slice of 2,048 memories stood twice against every asked (action, bucket) pair."""
    import numpy as np
    import pyarrow as pa

    from memjoin.operators import hashed as H

    rng = np.random.default_rng(5)
    asked = pa.table({"q": np.repeat(np.arange(50), 12), "action": rng.integers(0, 32, 600), "bucket": rng.integers(-900, 900, 600), "weight": rng.random(600)})
    known = H.AskedField(asked, 1)
    token = pa.struct([("action", pa.int32()), ("bucket", pa.int32()), ("weight", pa.float64())])
    code = known.codes[rng.integers(0, len(known.codes), (3_000, 12))]
    action, bucket = np.floor_divide(code + (H.ACTION_SPAN >> 1), H.ACTION_SPAN), None
    bucket, weight = code - action * H.ACTION_SPAN, rng.random(code.shape)
    field = pa.array([[dict(action=a, bucket=b, weight=w) for a, b, w in zip(*row)] for row in zip(action.tolist(), bucket.tolist(), weight.tolist())], pa.list_(token))
    ids, levels = rng.permutation(3_000), rng.integers(0, 4, 3_000)
    found, peak = held_by(lambda rows: H._field_block(known, ids, levels, rows, 4, 12, 400, 64), field)
    assert peak < 40 << 20
    score, overlap, met, wide, shared = known.scores(field)
    q, id_ = found[0].astype(int), found[1].astype(int)
    at = np.argsort(ids)[id_]
    for got, want in zip(found[3:], (score, overlap, met, wide, shared)):
        assert np.allclose(got.astype(float), want[at, q].astype(float))
    for k in range(50):
        best = sorted(np.flatnonzero(met[:, k]), key=lambda r: (-round(score[r, k], 9), ids[r]))[:400]
        assert set(ids[best]) <= set(id_[q == k])


def test_the_loop_joins_only_texts_that_are_ranked(spark):
    """the rows of the loop moved every text to join the few that a ranking names."""
    from memjoin.plans import online as PO
    from memjoin.session import written
    from memjoin.sources import tables

    rel = written(tables.relevance(spark, SF), "relevance")
    own = PO.pairs(spark, SF, rel)
    assert "SortMergeJoin" not in own._jdf.queryExecution().executedPlan().toString()
    assert own.count() == PO.W.lexical_ranked(spark, SF).count()

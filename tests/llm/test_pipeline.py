"""The corpus pipeline as a whole, stage by stage, over the supplied documents against plain versions of what each stage decides."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from memjoin.llm.common import documents, written
from memjoin.llm.simhash import shingle_hashes
from tests.llm import plain

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark):
    """What goes into each stage, and what comes out of the last."""
    docs, out = documents(spark, SF), []
    for name, stage in P.STAGES:
        out.append((name, docs))
        docs = written(stage(spark, docs, SF), name)
    return [*out, ("result", docs)]


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_keep_columns_and_only_drop_rows(kept):
    names = [name for name, _ in kept]
    assert names == ["quality", "exact_copies", "near_copies", "benchmark_passages", "packing", "result"]
    for (_, before), (_, after) in zip(kept[:-2], kept[1:-1]):
        assert set(after.columns) == set(COLUMNS) and ids(after) <= ids(before)
        assert after.exceptAll(before.select(after.columns)).isEmpty()


def test_quality_drops_labelled_junk_and_keeps_good_prose(spark):
    """Junk takes no part in the training, so its labels are held out; 200 documents of sf0.001 are too few to train on."""
    sf = SF.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    left = ids(P.quality(spark, documents(spark, sf), sf))
    bad, good = ({r.doc_id for r in labels if r.quality == q and not r.toxic} for q in (0, 1))
    assert len(bad - left) >= 0.9 * len(bad) and len(good & left) >= 0.95 * len(good)


def test_exact_copies_leave_one_of_each_text(kept):
    before, after = kept[1][1].collect(), kept[2][1].collect()
    last = {}
    for r in before:
        last[plain.lower(r.text)] = max(r.doc_id, last.get(plain.lower(r.text), -1))
    assert {r.doc_id for r in after} == set(last.values())


def test_near_copies_leave_one_of_each_group(kept):
    rows = {r.doc_id: frozenset(shingle_hashes((r.text or "").encode(), 5).tolist()) if (r.text or "").split() else None for r in kept[2][1].collect()}
    root = {d: d for d in rows}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    names = sorted(rows)
    for i, a in enumerate(names):
        for b in names[:i]:
            x, y = rows[a], rows[b]
            if x and y and len(x & y) >= 0.8 * len(x | y):
                root[max(top(a), top(b))] = min(top(a), top(b))
    assert ids(kept[3][1]) == {top(d) for d in names}


def test_benchmark_passages_go(spark, kept):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = {r.doc_id: r.text or "" for r in kept[3][1].collect()}, ids(kept[4][1])
    holding = {d for d, text in before.items() if any(item and item in text for item in items)}
    assert not holding & after
    assert len(after) >= 0.9 * (len(before) - len(holding))


def test_packing_places_every_piece(kept):
    pieces = kept[5][1]
    assert ids(pieces) == ids(kept[4][1])
    sums = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end <= 4096 for r in sums)

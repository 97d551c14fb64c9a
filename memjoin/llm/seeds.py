"""Candidate search for long repeats: minimizer seeds of whole texts, and the seeds that occur more than once.

A window of `window` symbols (words or bytes) holds a minimizer, its smallest hash of `gram` consecutive symbols. Equal
windows have equal minimizers, so a window can only repeat if its minimizer does. About 2 of every `window - gram` places are
seeds, and only those that recur lead back to texts; all seeds of all texts are counted, whatever their frequency.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memjoin.llm.common import LOC, located, minimizers, text_rows, written

NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def chosen(hashes: np.ndarray, owner: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Places of the minimizers; `owner` is the row of each symbol, and no gram crosses rows."""
    if len(hashes) == 0:
        return np.zeros(0, dtype=np.int64)
    inside = owner[: len(hashes)] == owner[gram - 1 : gram - 1 + len(hashes)]
    hashes = np.where(inside, np.minimum(hashes, NEVER - np.uint64(1)), NEVER)
    picked = minimizers(hashes, min(window - gram + 1, len(hashes)))
    return picked[hashes[picked] != NEVER]


def survey(docs: DataFrame, prepare: Callable[[bytes], tuple[bytes, int]], symbols, least: int) -> DataFrame:
    """One row per document, written once: rid, doc_id, file, row, n (symbols), sha (of the prepared text), seeds.

    `prepare` gives the text as it is compared and its number of symbols; `symbols(rows)` gives the hash of each gram and
    the row and place arrays for the rows that have at least `least` symbols.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid, seeds_of = TaskContext.get().partitionId() << 40, symbols()
        for batch in batches:
            counts, shas, seeds = [], [], []
            for _, rows in text_rows(batch, "text"):
                ready = [prepare(row) for row in rows]
                counts += [n for _, n in ready]
                shas += [hashlib.sha256(text).hexdigest() for text, _ in ready]
                long_enough = [i for i, (_, n) in enumerate(ready) if n >= least]
                found = [[] for _ in rows]
                if long_enough:
                    picked, owner = seeds_of([ready[i][0] for i in long_enough])
                    cuts = np.searchsorted(owner, np.arange(len(long_enough) + 1))
                    for at, i in enumerate(long_enough):
                        found[i] = picked[cuts[at] : cuts[at + 1]].view(np.int64)
                seeds += found
            ids = pa.array(np.arange(rid, rid + len(counts)))
            rid += len(counts)
            columns = [ids, batch.column("doc_id"), batch.column("file"), batch.column("row"), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(seeds, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "file", "row", "n", "sha", "seeds"])

    placed = located(docs.select("doc_id", "text"))
    rows = placed.select("doc_id", F.col(LOC)["file"].alias("file"), F.col(LOC)["row"].alias("row"), "text")
    kind = placed.schema["doc_id"].dataType.simpleString()
    return written(rows.mapInArrow(run, f"rid bigint, doc_id {kind}, file string, row bigint, n bigint, sha string, seeds array<bigint>"), "survey")


def with_recurring(docs: DataFrame, surveyed: DataFrame, recurring: DataFrame) -> DataFrame:
    """(rid, doc_id, text, found) of the surveyed rows that hold seeds of `recurring`; `found` lists its rows as structs."""
    held = surveyed.select("rid", F.explode(F.array_distinct("seeds")).alias("seed"))
    found = held.join(recurring, "seed").groupBy("rid").agg(F.collect_list(F.struct(*recurring.columns)).alias("found"))
    rows = surveyed.select("rid", "file", "row").join(found, "rid")
    placed = located(docs.select("doc_id", "text"))
    texts = placed.select("doc_id", F.col(LOC)["file"].alias("file"), F.col(LOC)["row"].alias("row"), "text")
    return texts.join(rows, ["file", "row"]).select("rid", "doc_id", "text", "found")

"""Suffix-array dedup: repeated byte strings from shard Burrows-Wheeler transforms, merged by interleave refinement.

1. Minimizer seeds of 64 bytes are counted over all texts. Equal 200-byte windows have equal minimizers, so windows whose
   seed occurs once are done.
2. The other windows go, as runs of bytes, to blocks by a key of their seed: the first document that holds the seed, or the
   seed itself where that document's seeds are frequent. Equal windows have equal keys and meet; equal runs collapse first.
3. In a block, shards of runs get a suffix order and a transform each. The transforms of all shards are merged: an interleave
   vector says which shard each merged suffix comes from, and every pass refines it by one symbol, by a stable distribution
   along the transforms, without touching a suffix again. A symbol stands for 40 bytes, so five passes give all common
   prefixes of 200 bytes. Boundaries that no pass has set enclose the repeated intervals.

Texts that are equal as a whole are settled by their number; one of each group goes on to stand for it in other texts.

Defined cases: null and empty texts have no bytes; a text shorter than a window loses nothing; repeated rows are repeats of
each other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memjoin.llm.common import BYTE_BASE, LOC, OCTET, Rolling, documents, located, mix, octets, sliding, text_rows, written
from memjoin.llm.seeds import NEVER, chosen, survey, with_recurring

WINDOW, GRAM = 200, 64
STEP = 40  # bytes of a symbol; divides the window
SHARD_BYTES = 1 << 18
BLOCK_BYTES = 1 << 20
FREQUENT = 20_000  # seeds of one key


def whole(text: bytes) -> tuple[bytes, int]:
    return text, len(text)


class Grams:
    """Hashes of all byte grams of several texts."""

    def __init__(self, gram: int, window: int):
        self.letters, self.gram, self.window = Rolling(BYTE_BASE), gram, window

    def read(self, rows: list[bytes]) -> None:
        self.data, self.offsets = octets(rows)
        self.owner = np.repeat(np.arange(len(rows)), np.diff(self.offsets))
        at = np.arange(max(0, len(self.data) - self.gram + 1))
        self.hashes = self.letters.slices(self.letters.prefix(OCTET[self.data]), at, at + self.gram)
        # No gram runs into the line feed that ends a row.
        self.last = np.append(self.offsets[1:] - 1, 0)

    def seeds(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        self.read(rows)
        picked = chosen(self.hashes, self.owner, self.gram, self.window)
        picked = picked[picked + self.gram <= self.last[self.owner[picked]]]
        return self.hashes[picked], self.owner[picked]


def runs_of(tool: Grams, rows: list[bytes], seeds: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first start, last start, key) of each maximal run of windows that share a key; places within the row."""
    tool.read(rows)
    width = tool.window - tool.gram + 1
    low = sliding(np.minimum(tool.hashes, NEVER - np.uint64(1)), width, np.minimum)
    start = np.arange(len(low))
    at = np.minimum(np.searchsorted(seeds, low), len(seeds) - 1)
    good = (seeds[at] == low) & (start + tool.window <= tool.last[tool.owner[start]])
    start, key = start[good], keys[at[good]]
    if not len(start):
        return start, start, start, key
    cut = np.flatnonzero((np.diff(start) != 1) | (key[1:] != key[:-1])) + 1
    first, last = np.concatenate([[0], cut]), np.append(cut, len(start)) - 1
    row = tool.owner[start[first]]
    return row, start[first] - tool.offsets[row], start[last] - tool.offsets[row], key[first]


def candidate_runs(found: DataFrame, gram: int, window: int) -> DataFrame:
    """(rid, content, runs) of each document with candidate windows; a run is (key, start, size) in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Grams(gram, window)
        for batch in batches:
            lists = batch.column("found")
            keep, content, spans = [], [], [[], [], []]
            for base, rows in text_rows(batch, "text"):
                held = lists.slice(base, len(rows)).flatten()
                seeds, first = np.unique(held.field("seed").to_numpy(zero_copy_only=False).view(np.uint64), return_index=True)
                row, begin, end, key = runs_of(tool, rows, seeds, held.field("key").to_numpy(zero_copy_only=False)[first])
                cuts = np.searchsorted(row, np.arange(len(rows) + 1))
                for i in range(len(rows)):
                    part = slice(cuts[i], cuts[i + 1])
                    if cuts[i + 1] > cuts[i]:
                        keep.append(base + i)
                        content.append(rows[i])
                        for column, values in zip(spans, (key[part], begin[part], end[part] - begin[part] + window)):
                            column.append(values)
            if keep:
                columns = [pa.array(column, pa.list_(pa.int64())) for column in spans]
                yield pa.RecordBatch.from_arrays([batch.column("rid").take(pa.array(keep)), pa.array(content, pa.binary()), *columns], ["rid", "content", "key", "start", "size"])

    return found.mapInArrow(run, "rid bigint, content binary, key array<bigint>, start array<bigint>, size array<bigint>")


# ---------------------------------------------------------------- transforms of shards and their merge


def stable_order(values: np.ndarray) -> np.ndarray:
    """Stable ascending order of non-negative integers below 2**32, by two passes of 16 bits."""
    order = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    if len(values) and int(values.max()) >> 16:
        order = order[np.argsort((values[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def symbols_of(runs: list[bytes], step: int, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """Symbol hash of each suffix (its next `step` bytes, fewer at the end of a run) and where each run's suffixes start.

    A run of n bytes has n + step suffixes; the last `step` are empty and have symbol 0.
    """
    sizes = np.array([len(r) for r in runs], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + step)])
    data = np.frombuffer(b"".join(r + bytes(step) for r in runs), dtype=np.uint8)
    at = np.arange(len(data))
    end = np.repeat(starts[:-1] + sizes, sizes + step)
    stop = np.minimum(at + step, end)
    made = rolling.slices(rolling.prefix(OCTET[data]), at, np.maximum(stop, at))
    made = np.maximum(mix(made + (stop - at).astype(np.uint64)), np.uint64(1))
    made[at >= end] = 0
    return made, starts


def shard_transform(symbol: np.ndarray, starts: np.ndarray, step: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a shard to `depth` symbols, and its transform: the symbol before each suffix, 0 at a run's first ones."""
    rank, reach = symbol.astype(np.int64), 1
    count = len(symbol)
    place = np.arange(count)
    end = np.repeat(starts[1:], np.diff(starts))
    _, rank = np.unique(rank, return_inverse=True)
    one = rank
    while reach < depth:
        add = min(reach, depth - reach)
        further = place + reach * step
        tail = (rank if add == reach else one)[np.minimum(further, count - 1)] if add in (1, reach) else None
        if tail is None:  # an odd depth is reached symbol by symbol
            add, tail = 1, one[np.minimum(further, count - 1)]
        tail = np.where(further < end, tail, 0)
        _, rank = np.unique(rank * (count + 1) + tail, return_inverse=True)
        reach += add
    order = stable_order(rank)
    before = order - step
    begin = np.repeat(starts[:-1], np.diff(starts))
    return order, np.where(before >= begin[order], symbol[np.maximum(before, 0)], 0)


def merged_intervals(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards after `depth` passes, and the common prefix with the suffix before, in symbols.

    Every pass deals the merged suffixes out by the symbol before them, in order, so those behind move up by one symbol. The
    empty suffixes keep the order of the shards.
    """
    sizes = [len(t) for t in transforms]
    interleave = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    group = np.zeros(len(interleave), dtype=np.int64)
    prefix = np.full(len(interleave), depth, dtype=np.int64)
    prefix[:1] = 0
    stacked = np.concatenate(transforms)
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    empty = int((stacked == 0).sum())
    for number in range(depth):
        by_shard = stable_order(interleave)
        read = np.empty(len(interleave), dtype=stacked.dtype)
        read[by_shard] = stacked  # the next symbol of each shard, in merged order
        order = stable_order(read)
        moved, old = interleave[order], group[order]
        moved[:empty] = np.sort(moved[:empty])
        old[:empty] = 0
        now = read[order]
        fresh = np.concatenate([[False], (now[1:] != now[:-1]) | (old[1:] != old[:-1])])
        fresh[1:empty] = False
        prefix[fresh & (prefix == depth)] = number
        interleave, group = moved, np.cumsum(fresh)
    return interleave, prefix


def repeated_starts(runs: list[bytes], copies: np.ndarray, window: int = WINDOW, step: int = STEP, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each run, the starts of its windows that stand at two places or more; `copies` counts each run's occurrences."""
    depth, rolling = window // step, Rolling(BYTE_BASE)
    symbol, starts = symbols_of(runs, step, rolling)
    names, dense = np.unique(symbol, return_inverse=True)
    if names[0] != 0:
        dense = dense + 1
    weight = np.array([len(r) for r in runs], dtype=np.int64)
    shard_of = (np.cumsum(weight) - weight) // shard_bytes
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard_of)) + 1, [len(runs)]])
    orders, transforms = [], []
    for a, b in zip(cuts[:-1], cuts[1:]):
        part = dense[starts[a] : starts[b]]
        order, transform = shard_transform(part, starts[a : b + 1] - starts[a], step, depth)
        orders.append(order + starts[a])
        transforms.append(transform)
    interleave, prefix = merged_intervals(transforms, depth)
    suffix = np.empty(len(interleave), dtype=np.int64)
    suffix[stable_order(interleave)] = np.concatenate(orders)
    owner = np.searchsorted(starts, suffix, side="right") - 1
    inner = suffix - starts[owner]
    full = inner + window <= weight[owner]
    interval = np.cumsum(prefix < depth)
    total = np.bincount(interval[full], weights=copies[owner[full]], minlength=int(interval[-1]) + 1)
    hit = full & (total[interval] >= 2)
    owner, inner = owner[hit], inner[hit]
    order = np.lexsort((inner, owner))
    owner, inner = owner[order], inner[order]
    return np.split(inner, np.searchsorted(owner, np.arange(1, len(runs))))


def block_repeats(window: int):
    """Group function: the runs of a block -> (key, name, begin, end), the stretches of repeated bytes of each run."""

    def find(frame: pd.DataFrame) -> pd.DataFrame:
        found = repeated_starts(frame["seg"].tolist(), frame["n"].to_numpy(), window)
        rows = []
        for key, name, starts in zip(frame["key"], frame["name"], found):
            if len(starts):
                cut = np.flatnonzero(np.diff(starts) > 1) + 1
                first, last = np.concatenate([[0], cut]), np.append(cut, len(starts)) - 1
                rows.append((key, name, starts[first].tolist(), (starts[last] + window).tolist()))
        return pd.DataFrame(rows, columns=["key", "name", "begin", "end"])

    return find


def cut_out(marked: DataFrame) -> DataFrame:
    """(rid, n_removed, n_spans, kept_sha256) from the bytes of each text and the stretches to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], []]
            for content, spans in zip(batch.column("content"), batch.column("spans")):
                content = content.as_py()
                data = np.frombuffer(content, dtype=np.uint8)
                turn = np.zeros(len(data) + 1, dtype=np.int64)
                np.add.at(turn, spans.values.field("a").to_numpy(zero_copy_only=False), 1)
                np.add.at(turn, spans.values.field("b").to_numpy(zero_copy_only=False), -1)
                gone = np.cumsum(turn)[:-1] > 0
                out[0].append(int(gone.sum()))
                out[1].append(int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].sum()))
                out[2].append(hashlib.sha256(data[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["rid", "n_removed", "n_spans", "kept_sha256"])

    return marked.select("rid", "content", "spans").mapInArrow(run, "rid bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def repeated_strings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, frequent: int = FREQUENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of `docs`."""
    docs = located(docs.select("doc_id", "text")).drop(LOC)  # rows that are read twice keep their places
    surveyed = survey(docs, whole, lambda: Grams(gram, window).seeds, window)
    leaders = surveyed.groupBy("sha").agg(F.min("rid").alias("leader"), F.count("*").alias("copies"))
    leaders = written(leaders, "leaders")  # a table of its own, so that the partition of a frequent text can be split in the join
    all_rows = written(surveyed.drop("seeds").join(leaders, "sha"), "led")
    going = surveyed.join(all_rows.where("rid = leader").select("rid"), "rid", "left_semi")
    counted = going.select("rid", F.explode("seeds").alias("seed")).groupBy("seed").agg(F.min("rid").alias("origin"), F.count("*").alias("n")).where("n > 1")
    counted = written(counted, "seeds")
    loads = counted.groupBy("origin").agg(F.sum("n").alias("load"))
    key = F.when(F.col("load") > frequent, F.xxhash64("seed")).otherwise(F.xxhash64("origin"))
    recurring = counted.join(loads, "origin").select("seed", key.alias("key"))
    candidates = written(candidate_runs(with_recurring(docs, going, recurring), gram, window), "runs")
    piece = F.expr("substring(content, int(w.start) + 1, int(w.size))")
    runs = candidates.select("rid", "content", F.explode(F.arrays_zip("key", "start", "size")).alias("w")).select("rid", "w.key", "w.start", piece.alias("seg"))
    runs = runs.withColumn("name", F.md5("seg"))
    octets_all = candidates.agg(F.coalesce(F.sum(F.aggregate("size", F.lit(0).cast("bigint"), lambda a, b: a + b)), F.lit(0))).first()[0]
    blocks = max(1, -(-octets_all // block_bytes))
    alone = runs.groupBy("key", "name", "seg").agg(F.count("*").alias("n")).withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    found = alone.groupBy("block").applyInPandas(block_repeats(window), "key bigint, name string, begin array<bigint>, end array<bigint>")
    hits = runs.select("rid", "key", "name", "start").join(found, ["key", "name"]).select("rid", "start", F.explode(F.arrays_zip("begin", "end")).alias("s"))
    spans = hits.groupBy("rid").agg(F.collect_list(F.struct((F.col("start") + F.col("s.begin")).alias("a"), (F.col("start") + F.col("s.end")).alias("b"))).alias("spans"))
    removed = cut_out(candidates.select("rid", "content").join(spans, "rid"))
    joined = all_rows.join(removed, "rid", "left")
    gone = (F.col("copies") > 1) & (F.col("n") >= window)
    return joined.select(
        "doc_id",
        F.col("n").alias("n_bytes"),
        F.when(gone, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def op6_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(documents(spark, sf_dir))

"""Shared helpers of the training-data operators: scratch tables, row locators, star components, text arrays."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memjoin.session import scratch_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the cluster's shared folder."""
    return f"{scratch_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: a cut of the lineage that survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


LOC = "__loc"


def located(docs: DataFrame, name: str = LOC) -> DataFrame:
    """`docs` with a struct `name` (file, row) of each row's place; rows not read from files are written first."""
    try:
        return _placed(docs, name)
    except AnalysisException:
        return _placed(written(docs, "rows"), name)


def _placed(docs: DataFrame, name: str) -> DataFrame:
    meta = docs.metadataColumn("_metadata")
    placed = docs.withColumn(name, F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("row")))
    placed.schema  # resolves the column now
    return placed


def drop_rows(docs: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`docs`, all columns, without the rows whose place (file, row) `find` returns for them."""
    name = LOC
    while name in docs.columns:
        name += "_"
    placed = located(docs, name)
    gone = find(placed.drop(name)).select(F.struct("file", "row").alias(f"{name}gone"))
    return placed.join(gone, F.col(name) == F.col(f"{name}gone"), "left_anti").drop(name)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character unchanged."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, root): every node of `edges` with the smallest node reachable, by alternating large-star and small-star.

    Each round is two grouped minima and joins over the edges, written to the shared folder; it ends when a round
    changes no edge. Nodes of any ordered type.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs = written(pairs, "edges")
    before = None
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        pairs = written(small, "edges")
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


# ---------------------------------------------------------------- arrays of bytes and words inside tasks

# Odd multipliers of the two polynomial hashes and of the final mix.
BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
OCTET = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(values: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    values = (values ^ (values >> np.uint64(30))) * MIX_1
    values = (values ^ (values >> np.uint64(27))) * MIX_2
    return values ^ (values >> np.uint64(31))


def powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(max(count, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


class Rolling:
    """Hashes of any slice of a sequence from one prefix sum, modulo 2**64."""

    def __init__(self, base: np.uint64):
        self.base, self.up, self.down = base, powers(base, 1), powers(inverse(base), 1)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(values):
            size = 1 << (len(values) + 1).bit_length()
            self.up, self.down = powers(self.base, size), powers(inverse(self.base), size)
        out = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def slices(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((prefix[ends] - prefix[starts]) * self.down[starts])


def octets(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The rows in one array, a line feed after each, and where each row starts (one more entry than rows)."""
    data = np.frombuffer(b"\n".join(rows) + b"\n", dtype=np.uint8)
    offsets = np.zeros(len(rows) + 1, dtype=np.int64)
    np.cumsum([len(row) + 1 for row in rows], out=offsets[1:])
    return data, offsets


def word_bounds(data: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes that are not separators; the last byte must be one."""
    inside = np.concatenate([[False], ~separators[data]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return turns[0::2], turns[1::2]


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick.reduce over every `width` consecutive values, by doubling."""
    if width > len(values):
        return values[:0]
    span, out = 1, values
    while 2 * span <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the smallest hash of some `width` consecutive ones (all places of a tie)."""
    low = sliding(hashes, width, np.minimum)
    if not len(low):
        return np.zeros(0, dtype=np.int64)
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    return np.flatnonzero(sliding(padded, width, np.maximum) == hashes)


def text_rows(batch: pa.RecordBatch, column: str, limit: int = 1 << 21) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as UTF-8) in runs of about `limit` bytes; null is empty."""
    values = batch.column(column)
    values = values.cast(pa.large_binary()) if not pa.types.is_large_binary(values.type) else values
    start, size, rows = 0, 0, []
    for row in values:
        value = row.as_py() or b""
        if rows and size + len(value) > limit:
            yield start, rows
            start, size, rows = start + len(rows), 0, []
        rows.append(value)
        size += len(value)
    if rows:
        yield start, rows

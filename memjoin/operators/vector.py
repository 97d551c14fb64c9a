"""Exact and approximate vector top-k.

All pairs are scored inside tasks by matrix product and only the best k per query leave a block; no pair rows are
built. Two routes, chosen by counting the queries first:

* few queries (bounded bytes): they are broadcast and the memories stream past them without a shuffle;
* many queries: both sides are cut into blocks of bounded size and co-grouped block by block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memjoin.operators.ranking import SCORE_PLACES, top_k

BROADCAST_QUERY_BYTES = 16 << 20
MEMORY_BLOCK_ROWS = 50_000
QUERY_BLOCK_ROWS = 4_096
QUERY_TILE, MEMORY_TILE = 256, 8_192  # scores held at a time


def dot(left: Column, right: Column) -> Column:
    """Dot product of two arrays, 0 for an empty left side or different lengths."""
    product = F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when((F.size(left) > 0) & (F.size(left) == F.size(right)), product).otherwise(F.lit(0.0))


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def l2_normalize(vec: Column) -> Column:
    length = norm(vec)
    return F.when(length > 0, F.transform(vec, lambda v: v.cast("double") / length)).otherwise(vec.cast("array<double>"))


def fit(vec: Column, dims: int) -> Column:
    head = F.slice(vec, 1, dims).cast("array<double>")
    return F.concat(head, F.array_repeat(F.lit(0.0), F.lit(dims) - F.size(head)))


def cosine_prefix(left: Column, right: Column, dims: int) -> Column:
    """True cosine over the first min(len, len, dims) entries."""
    width = F.least(F.size(left), F.size(right), F.lit(dims))
    a, b = F.slice(left, F.lit(1), width), F.slice(right, F.lit(1), width)
    length = norm(a) * norm(b)
    return F.when((width > 0) & (length > 0), dot(a, b) / length).otherwise(F.lit(0.0))


def quantize_int8(vec: Column) -> Column:
    """Normalise, scale to 127, round half to even, clamp."""
    return F.transform(l2_normalize(vec), lambda v: F.greatest(F.lit(-127), F.least(F.lit(127), F.rint(v * 127.0).cast("int"))))


def dot_int8(left: Column, right: Column) -> Column:
    total = F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0), lambda s, v: s + v)
    return total / F.lit(127.0 * 127.0)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of an Arrow list column as a dense matrix; rows of another length become zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lengths) and (lengths == dims).all():
        return values.reshape(-1, dims)
    out = np.zeros((len(lengths), dims))
    ends = np.cumsum(lengths)
    for row in np.flatnonzero(lengths == dims):
        out[row] = values[ends[row] - dims : ends[row]]
    return out


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of every row; equal scores keep the lower column."""
    rows, columns = [], []
    for row, line in enumerate(scores):
        if len(line) > k:
            cut = np.partition(line, len(line) - k)[len(line) - k]
            above = np.flatnonzero(line > cut)
            level = np.flatnonzero(line == cut)[: k - len(above)]
            pick = np.concatenate([above, level])
        else:
            pick = np.arange(len(line))
        rows.append(np.full(len(pick), row))
        columns.append(pick)
    return np.concatenate(rows), np.concatenate(columns)


def _block_topk(q_ids, q_matrix, ids, matrix, k):
    """Best k of one memory block for every query, ids ascending inside equal scores; compared rounded, returned unrounded.

    Scores exist for QUERY_TILE queries and MEMORY_TILE memories at a time; the k best so far meet each next tile.
    """
    order = np.argsort(ids, kind="stable")
    ids, matrix = ids[order], matrix[order]
    picked = []
    for start in range(0, len(q_ids), QUERY_TILE):
        asked = q_matrix[start : start + QUERY_TILE]
        held, columns = np.zeros((len(asked), 0)), np.zeros((len(asked), 0), np.int64)
        for low in range(0, len(ids), MEMORY_TILE):
            scores = asked @ matrix[low : low + MEMORY_TILE].T
            width = held.shape[1]
            scores = np.concatenate([held, scores], axis=1)
            row, column = _best(np.round(scores, SCORE_PLACES), k)
            column = np.sort(column.reshape(len(asked), -1), axis=1)  # lower columns first, so that ties keep the lower id
            held = np.take_along_axis(scores, column, axis=1)
            before = np.concatenate([columns, np.zeros((len(asked), 1), np.int64)], axis=1)
            columns = np.where(column < width, np.take_along_axis(before, np.minimum(column, width), axis=1), column - width + low)
        picked.append((np.repeat(q_ids[start : start + QUERY_TILE], columns.shape[1]), ids[columns.ravel()], held.ravel()))
    return tuple(np.concatenate(part) for part in zip(*picked))


def exact_vector_topk(memories: DataFrame, queries: DataFrame, k: int, dims: int, broadcast_bytes: int = BROADCAST_QUERY_BYTES) -> DataFrame:
    """(q, id, score, rank) of the k best dot products. `memories`: id, vec; `queries`: q, vec."""
    queries, memories = queries.select("q", "vec"), memories.select("id", "vec")
    limit = max(1, broadcast_bytes // (8 * dims))
    head = queries.limit(limit + 1).toArrow()
    if head.num_rows <= limit:
        partial = _stream_past_queries(memories, head, k, dims)
    else:
        partial = _blockwise(memories.withColumn("key", F.lit(0)), queries.withColumn("key", F.lit(0)), k, dims)
    return top_k(partial, "q", k)


def _schema(memories: DataFrame, queries: DataFrame) -> str:
    return f"q {queries.schema['q'].dataType.simpleString()}, id {memories.schema['id'].dataType.simpleString()}, score double"


def _out(q, ids, scores, q_type, id_type) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q, q_type), pa.array(ids, id_type), pa.array(scores, pa.float64())], ["q", "id", "score"])


def _stream_past_queries(memories: DataFrame, asked: pa.Table, k: int, dims: int) -> DataFrame:
    q_ids = asked["q"].to_numpy()
    q_type = asked.schema.field("q").type
    shared = memories.sparkSession.sparkContext.broadcast((q_ids, _matrix(asked["vec"], dims)))

    def score(batches):
        q_all, q_matrix = shared.value
        for batch in batches:
            if batch.num_rows and len(q_all):
                id_col = batch.column("id")
                picked = _block_topk(q_all, q_matrix, id_col.to_numpy(zero_copy_only=False), _matrix(batch.column("vec"), dims), k)
                yield _out(*picked, q_type, id_col.type)

    schema = f"q {_spark_type(q_type)}, id {memories.schema['id'].dataType.simpleString()}, score double"
    return memories.mapInArrow(score, schema)


def _spark_type(kind: pa.DataType) -> str:
    return "bigint" if pa.types.is_int64(kind) else "int" if pa.types.is_int32(kind) else "string"


def _blockwise(memories: DataFrame, queries: DataFrame, k: int, dims: int) -> DataFrame:
    """Block join inside equal keys: each (key, memory block, query block) is one bounded group."""
    m_blocks = memories.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / MEMORY_BLOCK_ROWS).cast("int").alias("m_blocks"))
    q_blocks = queries.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK_ROWS).cast("int").alias("q_blocks"))
    plan = m_blocks.join(q_blocks, "key")
    left = memories.join(plan, "key").select(
        F.col("key").alias("key"),
        F.pmod(F.xxhash64("id"), F.col("m_blocks")).cast("int").alias("mb"),
        F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("qb"),
        F.col("id").alias("id"),
        F.col("vec").alias("vec"),
    )
    right = queries.join(plan, "key").select(
        F.col("key").alias("key"),
        F.explode(F.sequence(F.lit(0), F.col("m_blocks") - 1)).alias("mb"),
        F.pmod(F.xxhash64("q"), F.col("q_blocks")).cast("int").alias("qb"),
        F.col("q").alias("q"),
        F.col("vec").alias("vec"),
    )
    schema = _schema(memories, queries)

    def score(found: pa.Table, asked: pa.Table) -> pa.Table:
        if not found.num_rows or not asked.num_rows:
            return pa.Table.from_batches([_out([], [], [], asked.schema.field("q").type, found.schema.field("id").type)])
        picked = _block_topk(
            asked["q"].to_numpy(), _matrix(asked["vec"], dims), found["id"].to_numpy(), _matrix(found["vec"], dims), k
        )
        return pa.Table.from_batches([_out(*picked, asked.schema.field("q").type, found.schema.field("id").type)])

    keys = ["key", "mb", "qb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, schema)


def project(vec: Column, points: Column) -> Column:
    """Signed sum of the named dimensions over sqrt(width)."""
    total = F.aggregate(points, F.lit(0.0), lambda s, p: s + p["sign"] * F.get(vec, p["dim"]).cast("double"))
    return total / F.sqrt(F.greatest(F.size(points), F.lit(1)).cast("double"))


CELLS, SAMPLE, TARGET = 64, 256, 0.95
MIX, MODULUS = 2_654_435_761, 1 << 32  # fixed values: the order in which rows are drawn


def drawn(df: DataFrame, key: str, count: int) -> pa.Table:
    """The `count` rows that come first when ids are mixed: a sample of bounded size that does not depend on partitions."""
    mixed = F.pmod(F.col(key) * F.lit(MIX), F.lit(MODULUS))
    return df.select(key, "vec").orderBy(mixed, key).limit(count).toArrow()


def probe_order(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The cells of each vector, the nearest centre first; equal products keep the lower cell."""
    return np.argsort(-np.round(vectors @ centres.T, SCORE_PLACES), axis=1, kind="stable")


def in_cells(df: DataFrame, key: str, centres: np.ndarray, dims: int, probes: int) -> DataFrame:
    """(key, vec, cell): each row once for each of its `probes` nearest cells."""
    shared = df.sparkSession.sparkContext.broadcast(centres)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                order = probe_order(_matrix(batch.column("vec"), dims), shared.value)[:, :probes]
                rows = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), order.shape[1])))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(order.ravel().astype(np.int32))], [key, "vec", "key"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(key, "vec").schema)
    return df.select(key, "vec").mapInArrow(place, f"{kinds}, key int")


def probes_needed(memories: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, dims: int, target: float, sample: int) -> int:
    """Cells to probe so that `target` of the true neighbours of a sample of the queries lie in them: measured, so it follows
    the data and not their number. The sample and its neighbours (sample x k rows) are all that the driver sees."""
    asked = drawn(queries, "q", sample)
    own = memories.sparkSession.createDataFrame(asked)
    near = exact_vector_topk(memories, own, k, dims).select("q", "id").join(memories.select("id", "vec"), "id").select("q", "vec").toArrow()
    order = probe_order(_matrix(asked["vec"], dims), centres)
    rank = np.argsort(order, axis=1)  # place of each cell among a query's cells
    at = {q: row for row, q in enumerate(asked["q"].to_pylist())}
    home = probe_order(_matrix(near["vec"], dims), centres)[:, 0]
    places = np.sort(rank[[at[q] for q in near["q"].to_pylist()], home])
    return int(places[max(0, int(np.ceil(target * len(places))) - 1)]) + 1 if len(places) else 1


def celled_vector_topk(memories: DataFrame, queries: DataFrame, k: int, dims: int, cells: int = CELLS, target: float = TARGET, sample: int = SAMPLE) -> DataFrame:
    """Approximate top-k: every memory lies in the cell of its nearest centre, every query probes its nearest cells, and what
    meets is scored exactly, once.

    Centres are `cells` drawn rows; the number of probes is measured on `sample` drawn queries against the exact answer, so
    that recall holds whatever the size and shape of the data. Large cells are cut into blocks of bounded size.
    """
    memories, queries = memories.select("id", "vec"), queries.select("q", "vec")
    chosen = drawn(memories, "id", cells)
    if not chosen.num_rows:
        return exact_vector_topk(memories, queries, k, dims)
    centres = _matrix(chosen["vec"], dims)[np.argsort(chosen["id"].to_numpy(), kind="stable")]
    probes = probes_needed(memories, queries, centres, k, dims, target, sample)
    found = _blockwise(in_cells(memories, "id", centres, dims, 1), in_cells(queries, "q", centres, dims, probes), k, dims)
    return top_k(found, "q", k)

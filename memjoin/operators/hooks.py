"""Places where users plug in their own code: embedders, classifiers, scorers, token emitters.

Each hook runs on Arrow batches inside tasks; Spark partitions the rows, the hook sees a bounded batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCORERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}


def register_scorer(name: str, scorer: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    SCORERS[name] = scorer


def _lists(rows: list, kind: pa.DataType) -> pa.Array:
    return pa.array(rows, pa.list_(kind))


def embed_texts(items: DataFrame, key: str, make: Callable[[], Callable[[list[str]], list[list[float]]]], text: str = "text") -> DataFrame:
    """(key, vec): each distinct text embedded once and joined back. `make` builds the embedder, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = make()
        for batch in batches:
            texts = batch.column(0)
            yield pa.RecordBatch.from_arrays([texts, _lists(backend(texts.to_pylist()), pa.float64())], ["text", "vec"])

    distinct = items.select(F.col(text).alias("text")).distinct()
    return items.select(key, F.col(text).alias("text")).join(distinct.mapInArrow(run, "text string, vec array<double>"), "text").select(key, "vec")


def classify_texts(items: DataFrame, key: str, classify: Callable[[str], Iterable[tuple[str, str, float, str]]], text: str = "text") -> DataFrame:
    """(key, field, value, confidence, span): predictions of a user classifier, any number per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = batch.column(0), []
            index = []
            for at, value in enumerate(batch.column(1).to_pylist()):
                for prediction in classify(value or ""):
                    index.append(at)
                    rows.append(prediction)
            columns = list(zip(*rows)) or [[], [], [], []]
            kinds = (pa.string(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(index, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]], [key, "field", "value", "confidence", "span"])

    kind = items.schema[key].dataType.simpleString()
    return items.select(key, text).mapInArrow(run, f"{key} {kind}, field string, value string, confidence double, span string")


def emit_tokens(vectors: DataFrame, key: str, emit: Callable[[list[list[float]]], list[list[tuple[int, int, float]]]], vec: str = "vec") -> DataFrame:
    """(key, action, bucket, weight): field tokens of a user emitter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = emit(batch.column(1).to_pylist())
            index = [at for at, tokens in enumerate(found) for _ in tokens]
            flat = [t for tokens in found for t in tokens]
            columns = list(zip(*flat)) or [[], [], []]
            kinds = (pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]], [key, "action", "bucket", "weight"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, vec).mapInArrow(run, f"{key} {kind}, action int, bucket int, weight double")

"""Keyed feedback state on disk: one clamped fold per memory or per relationship signature, as a stateful stream.

State is held per key by `transformWithState` in RocksDB with change logs in the shared checkpoint, so a micro-batch writes the
keys that it touches and nothing else. The state is read as a table with the state reader, between batches or afterwards.

A key that holds a third of all events is not sent event by event: events whose sequence numbers follow each other without a
gap are composed into one run per key before the shuffle (a run acts on a value x as clamp(x + shift, low, high)), and the
keyed step composes the runs in sequence order. Composing a part of the sequence early cannot change the result, because the
numbers of a run leave no room for an event that came from elsewhere.

The log must deliver its segments in sequence order; inside a micro-batch the sequence number decides. A replayed batch starts
from the state committed before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

from memjoin.operators import feedback as B

STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
NAME = "fold"
COUNTS = ["n_helpful", "n_corrected", "n_ignored"]
LONGEST = 16  # runs of an Arrow batch that are composed one by one
STATE = "use_count_delta bigint, evidence_count_delta bigint, importance_delta double, score_bias double, last_outcome string, protected boolean, n_helpful bigint, n_corrected bigint, n_ignored bigint"


@dataclass(frozen=True)
class Steps:
    """Clamped steps of one kind of state."""

    key: str
    bias: dict[str, float]
    bias_bound: float
    importance: dict[str, float]
    importance_bound: float

    @property
    def runs(self) -> str:
        return (
            f"{self.key} {self.kind}, at bigint, last_outcome string, protected boolean, n_helpful bigint, n_corrected bigint, n_ignored bigint, "
            "importance_shift double, importance_low double, importance_high double, bias_shift double, bias_low double, bias_high double"
        )

    @property
    def kind(self) -> str:
        return "bigint" if self.key == "memory_id" else "string"


MEMORY = Steps("memory_id", B.BIAS_STEP, B.BIAS_BOUND, B.IMPORTANCE_STEP, B.IMPORTANCE_BOUND)
# A signature carries a bias only: its importance never moves.
SIGNATURE = Steps("signature", B.SIGNATURE_STEP, B.SIGNATURE_BOUND, dict.fromkeys(B.OUTCOMES, 0.0), B.IMPORTANCE_BOUND)


def composed(outcomes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, step: dict[str, float], bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shift, low, high) of every run of events, run `n` being `lengths[n]` outcomes from `starts[n]` on.

    The few longest runs are composed one by one, the others event by event over all runs that are long enough.
    """
    by = np.full(len(outcomes), step["ignored"])
    for name, value in step.items():
        by[outcomes == name] = value
    shift, low, high = np.zeros(len(starts)), np.full(len(starts), -bound), np.full(len(starts), bound)
    order = np.argsort(-lengths, kind="stable")
    for run in order[:LONGEST]:
        s, a, z = 0.0, -bound, bound
        for move in by[starts[run] : starts[run] + lengths[run]].tolist():
            s, a, z = s + move, min(bound, max(-bound, a + move)), min(bound, max(-bound, z + move))
        shift[run], low[run], high[run] = s, a, z
    order = order[LONGEST:]
    for place in range(int(lengths[order].max(initial=0))):
        live = order[: np.searchsorted(-lengths[order], -place, side="left")]
        move = by[starts[live] + place]
        shift[live] += move
        low[live], high[live] = np.clip(low[live] + move, -bound, bound), np.clip(high[live] + move, -bound, bound)
    return shift, low, high


def run_maker(steps: Steps):
    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row per key for every gap-free piece of the sequence in an Arrow batch."""
        for frame in frames:
            frame = frame.sort_values("seq", kind="stable")
            seq, keys = frame["seq"].to_numpy(), pd.factorize(frame[steps.key])[0]
            piece = np.cumsum(np.diff(seq, prepend=seq[:1]) != 1)
            order = np.lexsort((piece, keys))
            keys, piece, seq, own = keys[order], piece[order], seq[order], frame.iloc[order]
            fresh = np.ones(len(own), dtype=bool)
            fresh[1:] = (np.diff(keys) != 0) | (np.diff(piece) != 0)
            starts = np.flatnonzero(fresh)
            lengths = np.diff(starts, append=len(own))
            outcomes = own["outcome"].to_numpy(dtype=object)

            def total(flags: np.ndarray) -> np.ndarray:
                return np.add.reduceat(flags.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)

            helpful, corrected = (total(outcomes == name) for name in B.OUTCOMES[:2])
            columns = [
                own[steps.key].to_numpy()[starts], seq[starts], outcomes[starts + lengths - 1], total(own["protected"].to_numpy(dtype=bool)) > 0,
                helpful, corrected, lengths - helpful - corrected,
                *composed(outcomes, starts, lengths, steps.importance, steps.importance_bound), *composed(outcomes, starts, lengths, steps.bias, steps.bias_bound),
            ]
            yield pd.DataFrame(dict(zip([part.split()[0] for part in steps.runs.split(", ")], columns)))

    return runs


class FoldProcessor(StatefulProcessor):
    """Applies the runs of a key to its stored state and emits the new state."""

    def __init__(self, steps: Steps):
        self.steps = steps

    def init(self, handle) -> None:
        self.held = handle.getValueState(NAME, STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        use, evidence, importance, bias, last, protected, *counts = self.held.get() or (0, 0, 0.0, 0.0, "", False, 0, 0, 0)
        for run in sorted((run for frame in rows for run in frame.itertuples(index=False)), key=lambda run: run.at):
            fresh = [int(getattr(run, name)) for name in COUNTS]
            use += fresh[0] * B.USE_STEP["helpful"] + fresh[1] * B.USE_STEP["corrected"]
            evidence += fresh[0] * B.EVIDENCE_STEP["helpful"] + fresh[1] * B.EVIDENCE_STEP["corrected"]
            importance = max(run.importance_low, min(run.importance_high, importance + run.importance_shift))
            bias = max(run.bias_low, min(run.bias_high, bias + run.bias_shift))
            last, protected = run.last_outcome, protected or bool(run.protected)
            counts = [a + b for a, b in zip(counts, fresh)]
        new = (int(use), int(evidence), float(importance), float(bias), str(last), bool(protected), *map(int, counts))
        self.held.update(new)
        yield pd.DataFrame([(key[0], *new)], columns=[self.steps.key, *names()])

    def close(self) -> None:
        pass


def names() -> list[str]:
    return [part.split()[0] for part in STATE.split(", ")]


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB with change logs."""
    before = {name: spark.conf.get(name, None) for name in STORE}
    for name, value in STORE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def folded(events: DataFrame, steps: Steps) -> DataFrame:
    """The states that change, from a stream of events (key, seq, outcome, protected)."""
    ready = events.select(steps.key, "seq", "outcome", F.coalesce("protected", F.lit(False)).alias("protected")).where(F.col(steps.key).isNotNull())
    runs = ready.mapInPandas(run_maker(steps), steps.runs)
    shape = StructType.fromDDL(f"{steps.key} {steps.kind}, {STATE}")
    return runs.groupBy(steps.key).transformWithStateInPandas(FoldProcessor(steps), shape, "Update", "None")


def fold_stream(events: DataFrame, checkpoint: str, steps: Steps = MEMORY) -> StreamingQuery:
    """Fold what has arrived on a stream of feedback events into the keyed state under `checkpoint`, then stop."""
    with rocksdb(events.sparkSession):
        return folded(events, steps).writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state_table(spark: SparkSession, checkpoint: str, steps: Steps = MEMORY, batch: int | None = None) -> DataFrame:
    """(key, state columns) as committed by the last batch, or by batch number `batch`."""
    reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", NAME)
    if batch is not None:
        reader = reader.option("batchId", batch)
    with rocksdb(spark):
        found = reader.load()
    key = found.schema["key"].dataType.names[0]
    return found.select(F.col("key")[key].alias(steps.key), *[F.col("value")[name].alias(name) for name in names()])

"""Periodic run detection with string synchronising sets.

A run is a stretch of consecutive words with smallest period q, at least max(LEAST, 2 q) words long, that no neighbouring word
extends with the same period. Runs are sought at dyadic scales t = 1, 2, 4, ...; scale t is answerable for the periods from
3 t - 1 to 6 t - 2:

* A place is selected (it synchronises) if the smallest hash of the t + 1 windows of t words that begin at it and at the t
  places after it belongs to the first or the last of them. The choice depends on 2 t words only, so equal passages select
  equal places; windows with a period of at most t / 3 are left out of it.
* Selected places with equal contexts of 2 t words, at a distance among the scale's periods, propose that distance as a
  period. Contexts that are not highly periodic repeat at distances over t / 3 only, so a place has few partners.
* Highly periodic windows are covered by runs of small periods that the scales below have found, and period 1 is read off
  equal neighbours; so the regions without selected places are known. A run of which a whole period lies in such a region is
  three periods long at most and its second copy begins where the next region of the same small period does: the offsets
  that align two touching regions are proposed too.

A proposal is extended to both sides by binary search over prefix hashes, and every run is compared word by word before it is
returned, so a chance collision of hashes cannot invent a run. Texts are independent: there is no shuffle, and a task holds about
CHUNK bytes of text at a time, or one longer text.

Defined cases: null and word-less texts have no run and collapse to the empty text; ties of the longest run are the caller's
(the query takes the smallest start, then period); repeated rows get a row each; an empty table gives no rows; a null doc_id
is kept as it is (and never planted by the query); other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memjoin.llm.common import WORD_BASE, Rolling, documents, mix, sliding, text_rows

LEAST = 12  # words of a run, at least
CHUNK = 1 << 21
NONE = np.uint64(2**64 - 1)
RUNS = "doc_id bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]  # starts, ends, periods


def equal_stretches(codes: np.ndarray, low: int, high: int, period: int) -> Runs:
    """The maximal stretches of codes[low:high] with this period, at least two periods long, by comparing every word."""
    same = np.concatenate([[False], codes[low : high - period] == codes[low + period : high], [False]])
    turns = np.flatnonzero(same[1:] != same[:-1])
    starts, ends = turns[0::2] + low, turns[1::2] + low + period
    long = ends - starts >= 2 * period
    return starts[long], ends[long], np.full(int(long.sum()), period)


class Texts:
    """Word codes of several texts, longest first, a code of its own after each; finds their runs."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray, rolling: Rolling):
        self.codes, self.offsets, self.rolling = codes, offsets, rolling
        self.lengths = np.diff(offsets) - 1
        self.prefix = rolling.prefix(mix((codes + 1).astype(np.uint64) * WORD_BASE))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.rolling.slices(self.prefix, starts, ends)

    def reach(self, left: np.ndarray, right: np.ndarray, room: np.ndarray, forward: bool) -> np.ndarray:
        """How many words agree from each place of `left` and of `right` on (or before them), `room` at most."""
        low, high = np.zeros(len(left), np.int64), room.astype(np.int64)
        while (open_ := low < high).any():
            middle = np.where(open_, (low + high + 1) // 2, low)
            if forward:
                same = self.hashes(left, left + middle) == self.hashes(right, right + middle)
            else:
                same = self.hashes(left - middle, left) == self.hashes(right - middle, right)
            low, high = np.where(same, middle, low), np.where(same, high, np.minimum(high, middle - 1))
            high = np.maximum(high, low)
        return low

    def extended(self, places: np.ndarray, periods: np.ndarray) -> Runs:
        """The maximal stretches around proposals (place, period): long enough to be a run or a highly periodic region."""
        text = np.searchsorted(self.offsets, places, side="right") - 1
        after = self.reach(places, places + periods, np.maximum(self.offsets[text + 1] - 1 - places - periods, 0), True)
        before = self.reach(places, places + periods, places - self.offsets[text], False)
        starts, ends = places - before, places + periods + after
        length = ends - starts
        keep = (length >= 2 * periods) & ((length >= LEAST) | (length >= 3 * periods))
        return distinct(starts[keep], ends[keep], periods[keep])

    def selected(self, scale: int, end: int, regions: Runs) -> np.ndarray:
        """The synchronising places of a scale in codes[:end]."""
        windows = np.arange(end - scale + 1)
        hashes = self.hashes(windows, windows + scale)
        starts, ends, periods = regions
        covered = (periods <= scale / 3) & (ends - starts >= scale) & (ends <= end)
        if covered.any():
            edges = np.zeros(end + 2, np.int64)
            np.add.at(edges, starts[covered], 1)
            np.add.at(edges, ends[covered] - scale + 1, -1)
            hashes[np.cumsum(edges)[: len(hashes)] > 0] = NONE
        least = sliding(hashes, scale + 1, np.minimum)
        return np.flatnonzero(((least == hashes[: len(least)]) | (least == hashes[scale : scale + len(least)])) & (least != NONE))

    def proposals(self, scale: int, end: int, regions: Runs) -> tuple[np.ndarray, np.ndarray]:
        """Places and the distances to later ones with an equal context, among the periods of the scale."""
        places = self.selected(scale, end, regions)
        contexts = self.hashes(places, places + 2 * scale)
        order = np.argsort(contexts, kind="stable")
        contexts, places = contexts[order], places[order]
        found_at, found_by, alive, step = [], [], np.arange(len(places)), 0
        while len(alive):
            step += 1
            alive = alive[alive + step < len(places)]
            gap = places[alive + step] - places[alive]
            near = (contexts[alive + step] == contexts[alive]) & (gap <= 6 * scale - 2)
            alive, gap = alive[near], gap[near]
            wide = gap >= 3 * scale - 1
            found_at.append(places[alive[wide]])
            found_by.append(gap[wide])
        return np.concatenate([np.zeros(0, np.int64), *found_at]), np.concatenate([np.zeros(0, np.int64), *found_by])

    def aligned(self, regions: Runs) -> tuple[np.ndarray, np.ndarray]:
        """Proposals from touching regions of one small period: the distances at which their words agree."""
        starts, ends, periods = regions
        wide = ends - starts >= 9 * periods - 1
        starts, ends, periods = starts[wide], ends[wide], periods[wide]
        order = np.lexsort((starts, periods))
        starts, ends, periods = starts[order], ends[order], periods[order]
        found_at, found_by = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in np.flatnonzero((periods[1:] == periods[:-1]) & (starts[1:] <= ends[:-1])):
            period, first = int(periods[k]), int(starts[k + 1])
            phases = np.arange(ends[k] - 2 * period + 1, ends[k] - period + 1)
            equal = phases[self.hashes(phases, phases + period) == self.hashes(np.array([first]), np.array([first + period]))]
            if not len(equal) or equal[0] >= first:
                continue
            offsets = np.arange(first - int(equal[0]), min(ends[k] - starts[k], ends[k + 1] - first) + period + 1, period)
            low = np.maximum(starts[k], first - offsets)
            high = np.minimum(ends[k], ends[k + 1] - offsets)
            fits = high - low >= offsets
            found_at.append(low[fits])
            found_by.append(offsets[fits])
        return np.concatenate(found_at), np.concatenate(found_by)

    def neighbours(self) -> Runs:
        """The regions of period 1."""
        starts, ends, periods = equal_stretches(self.codes, 0, len(self.codes), 1)
        long = ends - starts >= 3
        return starts[long], ends[long], periods[long]

    def runs(self) -> Runs:
        """All runs, by start, then period."""
        found = self.neighbours()
        scale = 1
        while (count := int(np.searchsorted(-self.lengths, -max(LEAST, 6 * scale - 2), side="right"))) > 0:
            places, periods = self.proposals(scale, int(self.offsets[count]), found)
            if len(places):
                found = distinct(*[np.concatenate(both) for both in zip(found, self.extended(places, periods))])
            scale *= 2
        places, periods = self.aligned(found)
        if len(places):
            found = distinct(*[np.concatenate(both) for both in zip(found, self.extended(places, periods))])
        found = self.compared(found)
        long = found[1] - found[0] >= np.maximum(LEAST, 2 * found[2])
        return found[0][long], found[1][long], found[2][long]

    def compared(self, found: Runs) -> Runs:
        """The runs whose words do agree; a period that a collision of hashes has stretched is read off the words."""
        codes, kept, doubtful = self.codes, [], set()
        for start, end, period in zip(*(part.tolist() for part in found)):
            if np.array_equal(codes[start : end - period], codes[start + period : end]):
                kept.append((start, end, period))
            else:
                doubtful.add((int(np.searchsorted(self.offsets, start, side="right")) - 1, period))
        for text, period in doubtful:
            kept += zip(*(part.tolist() for part in equal_stretches(codes, int(self.offsets[text]), int(self.offsets[text + 1]), period)))
        table = np.array(kept, np.int64).reshape(-1, 3)
        return distinct(table[:, 0], table[:, 1], table[:, 2])


def distinct(starts: np.ndarray, ends: np.ndarray, periods: np.ndarray) -> Runs:
    """One entry for each stretch, with its smallest period, by start, then period."""
    order = np.lexsort((periods, ends, starts))
    starts, ends, periods = starts[order], ends[order], periods[order]
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] != starts[:-1]) | (ends[1:] != ends[:-1])
    starts, ends, periods = starts[new], ends[new], periods[new]
    order = np.lexsort((periods, starts))
    return starts[order], ends[order], periods[order]


def planted(words: list[bytes], mark: int | None) -> list[bytes]:
    """The words with the repetition that the query's contract puts into one of ten texts; `mark` is the checksum of its id."""
    if mark is None or mark % 10 or not words:
        return words
    given, n = mark // 10, len(words)
    start = given % n
    period = 1 + (n - start) // (3 + given % 8)
    block = words[start : start + period]
    return words[:start] + (block * (-(-(n - start) // period)))[: n - start]


def text_runs(texts: list[list[bytes]], rolling: Rolling) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    numbers: dict[bytes, int] = {}
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(texts[k]) + 1 for k in order], out=offsets[1:])
    codes = np.full(int(offsets[-1]), -1, np.int64)
    for place, k in enumerate(order):
        codes[offsets[place] : offsets[place + 1] - 1] = [numbers.setdefault(word, len(numbers)) for word in texts[k]]
    codes[offsets[1:] - 1] = len(numbers) + np.arange(len(texts))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    starts, ends, periods = Texts(codes, offsets, rolling).runs()
    at = np.searchsorted(offsets, starts, side="right") - 1
    for place, start, end, period in zip(at.tolist(), (starts - offsets[at]).tolist(), (ends - offsets[at]).tolist(), periods.tolist()):
        out[order[place]].append((start, end - start, period))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by one space, without those that some run holds after its first period."""
    if not runs:
        return b" ".join(words)
    dropped = np.zeros(len(words), bool)
    for start, length, period in runs:
        dropped[start + period : start + length] = True
    return b" ".join([words[k] for k in np.flatnonzero(~dropped).tolist()])


def find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rolling = Rolling(WORD_BASE)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        marks = batch.column("mark").to_pylist()
        for first, rows in text_rows(batch, "text", CHUNK):
            texts = [planted(row.split(), mark) for row, mark in zip(rows, marks[first : first + len(rows)])]
            runs = text_runs(texts, rolling)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, len(rows)),
                    pa.array([[{"start": s, "length": n, "period": p} for s, n, p in own] for own in runs], kind),
                    pa.array([collapsed(words, own).decode() for words, own in zip(texts, runs)], pa.string()),
                ],
                ["doc_id", "runs", "collapsed"],
            )


def periodic_runs(docs: DataFrame, mark: Column | None = None) -> DataFrame:
    """(doc_id, runs, collapsed) of every row: the runs by start, then period, and the text without their later periods.

    Where `mark` (a checksum of the id) is given, one text of ten gets a planted repetition first.
    """
    checked = F.lit(None).cast("bigint") if mark is None else mark.cast("bigint")
    return docs.select("doc_id", "text", checked.alias("mark")).mapInArrow(find_runs, RUNS)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(documents(spark, sf_dir), F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("quick"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    best = found.withColumn("best", longest)
    return best.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.quick")).alias("period"),
        F.expr("(1000 * best.length) div -best.quick").alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), ""), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )

"""Document fingerprints by a randomised edit embedding.

A text is walked through, character by character, along a random walk that all texts share: step j at character c either stays
or moves on, as the random bit of (j, c) says, and the embedding has the character that each step stands at. Two texts that
differ by few edits fall into step again soon after each of them, so their embeddings differ in few places: edit distance has
become Hamming distance. A walk is about two steps a character.

The embedding is sampled: SAMPLES fixed places in steps [0, FIRST), as many in [FIRST, 2 FIRST), in [2 FIRST, 4 FIRST) and so
on, so texts of any length share the places that both reach. A sample is four bits of the character, one hex digit, or `-` past
the end. The fingerprint is the samples in order: its length grows with the logarithm of the text's. The likeness of two
fingerprints is the share of equal samples, each weighted by the steps it stands for, less what chance alone gives.

Near documents: fingerprints with equal digits at the sampled places of a band meet. Band places are drawn by weight, for the
text's own number of levels and, if it has little of the last one, for one less, and draws past a text's end are passed over, as
the likeness does not count them either. So a band holds WIDTH digits of any text, and two texts of the least likeness share one
of the BANDS bands but for 0.02 % (by calculation). Each meets the band's first document, and the members of a band
that this leaves apart are all compared inside its task; only links verified by the likeness of the whole fingerprints count, and the
groups are their connected components. Equal fingerprints are one row before any band, so a crowd of copies is one member.
What meets first is the last LAST digits of each fingerprint, which stand for half of its steps or more: if they differ so much
that the rest could not make up for it, the pair is done. Whole fingerprints travel only where these digits leave it open.

A text's next document comes from a cut of the order of doc_id into slices of bounded size: the first row of a slice also goes
to the slice before, so each text moves once and every slice is read as a stream.

Defined cases: null is the empty text, whose fingerprint is empty; two empty fingerprints are alike (1), an empty one and
another are not (0); rows with the same doc_id follow each other in an order fixed by their places in the files; null doc_ids
come first; the only row of a table is its own next; an empty table gives no rows; repeated rows get a row each; a text of any
length is walked in full by one task; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from memjoin.llm.common import LOC, components, documents, located, mix, scratch_path, written
from memjoin.llm.order import numbered

SAMPLES, FIRST = 64, 64  # samples in each level, steps of the first level
CLASSES, CYCLE = 256, 1 << 14  # character classes of the walk; steps after which its bits come again
CROWD = 100  # texts that are worth walking side by side
CHUNK = 1 << 23  # characters at a time
ROWS, SLICES = 256, 100_000  # rows of a slice at least, slices at most
CHANCE = 1 / 16
BANDS, WIDTH = 40, 8  # bands of a fingerprint, samples in each
DRAWS = 64  # places that are drawn for a band; a text takes the first WIDTH of them that it reaches
TOP_SHARE = 0.25  # share of the last level up to which a text may be alike to one without that level
SHARD_ROWS = 4096  # rows of a band that are compared in one task
ALIKE = 0.8
BROADCAST_ROWS = 200_000
LOWEST = -(1 << 63)  # the key of a null doc_id
LAST = 64  # digits of a fingerprint that meet first
PAIRS = 1 << 14  # pairs whose last digits are compared at a time
STEPS = np.repeat(2.0 ** np.maximum(np.arange(64) - 1, 0), SAMPLES)  # steps that a sample stands for, in units of the first level's
STEPS_BEFORE = np.concatenate([[0.0], np.cumsum(STEPS)])
LAST_STEPS = sliding_window_view(np.concatenate([np.zeros(LAST), STEPS]).astype(np.float32), LAST)  # by how many digits there are; sums are exact


def _draw(count: int, salt: int) -> np.ndarray:
    return mix(np.arange(count, dtype=np.uint64) + np.uint64(salt << 40))


class Walk:
    """The shared random walk and the sampled places, the same in every task; `steps`: also what it takes to walk a text."""

    def __init__(self, steps: bool = True):
        self.places, self.weight = np.zeros(0, np.int64), np.zeros(0)
        self.drawn: dict[int, np.ndarray] = {}
        self.reached: dict[tuple[int, int], np.ndarray] = {}
        if not steps:
            return
        points = _draw(0x110000, 1)
        self.kind = (points & np.uint64(CLASSES - 1)).astype(np.uint8)
        self.digit = np.frombuffer(b"0123456789abcdef", np.uint8)[(points >> np.uint64(20)).astype(np.int64) & 15]
        moves = (_draw(CLASSES * CYCLE, 2) >> np.uint64(33)).reshape(CLASSES, CYCLE) & np.uint64(1)
        wait = np.ones((CLASSES, CYCLE), np.int32)  # steps that a text stands at a character it reaches at step j
        ahead = np.ones(CLASSES, np.int32)
        for j in [*range(CYCLE - 1, -1, -1)] * 2:
            ahead = np.where(moves[:, j] == 1, 1, ahead + 1).astype(np.int32)
            wait[:, j] = ahead
        self.wait = np.minimum(wait, 255).astype(np.uint8)
        self.rows = [row.tobytes() for row in self.wait]
        self.flat = self.wait.ravel()

    def levels(self, steps: int) -> int:
        return 0 if steps == 0 else 1 + max(0, int(steps - 1) // FIRST).bit_length()

    def need(self, levels: int) -> None:
        """Draw the places of more levels."""
        while len(self.places) < levels * SAMPLES:
            level = len(self.places) // SAMPLES
            low, width = (0, FIRST) if level == 0 else (FIRST << (level - 1), FIRST << (level - 1))
            drawn = low + np.sort((_draw(SAMPLES, 100 + level) % np.uint64(width)).astype(np.int64))
            drawn = low + np.arange(SAMPLES) * (width // SAMPLES) if width == SAMPLES else drawn
            self.places, self.weight = np.concatenate([self.places, drawn]), np.concatenate([self.weight, np.full(SAMPLES, width / SAMPLES)])

    def entered(self, starts: list[int], texts: list[np.ndarray]) -> list[np.ndarray]:
        """For each text: the step at which each character is reached, and the step after the last; from a given first step."""
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        sizes = np.array([len(texts[k]) for k in order], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
        kinds = np.zeros(int(offsets[-1]), np.int32)
        for place, k in enumerate(order):
            kinds[offsets[place] : offsets[place] + sizes[place]] = self.kind[texts[k]]
        reached = np.zeros(int(offsets[-1]), np.int64)
        now = np.array([starts[k] for k in order], np.int64)
        reached[offsets[:-1]] = now
        side_by_side = int(sizes[CROWD - 1]) if len(sizes) >= CROWD else 0
        active = len(sizes)
        for step in range(side_by_side):
            while sizes[active - 1] <= step:
                active -= 1
            at = offsets[:active] + step
            now = now[:active]
            now = now + self.flat[kinds[at] * CYCLE + (now & (CYCLE - 1))]
            reached[at + 1] = now
        mask, rows = CYCLE - 1, self.rows
        for place in range(len(sizes)):
            if sizes[place] <= side_by_side:
                break
            low, high = int(offsets[place]) + side_by_side, int(offsets[place] + sizes[place])
            steps = accumulate(kinds[low:high].tolist(), lambda j, c: j + rows[c][j & mask], initial=int(reached[low]))
            reached[low : high + 1] = np.fromiter(steps, np.int64, high - low + 1)
        out: list[np.ndarray] = [reached[:0]] * len(texts)
        for place, k in enumerate(order):
            out[k] = reached[offsets[place] : offsets[place + 1]]
        return out

    def sampled(self, points: np.ndarray, reached: np.ndarray) -> bytes:
        """The fingerprint of a text from the steps at which its characters are reached."""
        steps = int(reached[-1]) if len(points) else 0
        levels = self.levels(steps)
        self.need(levels)
        places = self.places[: levels * SAMPLES]
        out = np.full(len(places), ord("-"), np.uint8)
        inside = places < steps
        out[inside] = self.digit[points[np.searchsorted(reached, places[inside], side="right") - 1]]
        return out.tobytes()

    def likeness(self, a: bytes, b: bytes) -> float:
        """From 0 (no more than chance) to 1 (equal)."""
        if a == b or not a or not b:
            return float(a == b)
        size = max(len(a), len(b))
        self.need(size // SAMPLES)
        left, right = (np.frombuffer(x.ljust(size, b"-"), np.uint8) for x in (a, b))
        weight = np.where((left == 45) & (right == 45), 0.0, self.weight[:size])
        return max(0.0, (float(weight[left == right].sum() / weight.sum()) - CHANCE) / (1 - CHANCE))

    def band_places(self, top: int, ends: int) -> np.ndarray:
        """The sampled places of each band of a text that reaches `ends` of them: the first of those drawn by weight over `top`
        levels; where too few of these are reached, the first place stands for the others."""
        if top not in self.drawn:
            share = np.cumsum(self.weight[: top * SAMPLES])
            points = np.stack([_draw(DRAWS, 1000 + BANDS * top + band) for band in range(BANDS)])
            self.drawn[top] = np.searchsorted(share, (points >> np.uint64(11)).astype(np.float64) / 2.0**53 * share[-1], side="right")
        if (top, ends) not in self.reached:
            drawn = self.drawn[top]
            order = np.argsort(drawn >= ends, axis=1, kind="stable")[:, :WIDTH]
            places = np.take_along_axis(drawn, order, axis=1)
            self.reached[top, ends] = np.where(places < ends, places, 0)
        return self.reached[top, ends]

    def bands(self, print_: bytes) -> list[int]:
        """Hashes of the keys of a fingerprint's bands: for its number of levels and, if it has little of the last one, for one less."""
        keys = []
        levels = len(print_) // SAMPLES
        self.need(levels)
        digits = np.frombuffer(print_, np.uint8)
        ends = int(np.count_nonzero(digits != 45))
        little = levels > 1 and ends - (levels - 1) * SAMPLES <= TOP_SHARE * SAMPLES
        for top in (levels, levels - 1)[: 1 + little] if levels else ():
            chosen = digits[self.band_places(top, min(ends, top * SAMPLES))]
            keys += [xxh3_64_intdigest(bytes([top, band]) + row.tobytes()) - (1 << 63) for band, row in enumerate(chosen)]
        return keys

    def alike(self, one: np.ndarray, others: np.ndarray) -> np.ndarray:
        """The likeness of a fingerprint to each of `others`, all padded to one length and none empty."""
        size = len(one)
        self.need(size // SAMPLES)
        counted = np.where((others == 45) & (one == 45), 0.0, self.weight[:size])
        return np.maximum(0.0, ((counted * (others == one)).sum(axis=1) / counted.sum(axis=1) - CHANCE) / (1 - CHANCE))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def edited(text: str, following: str) -> tuple[str, int]:
    """`text` with its last half replaced by as much of the beginning of `following`, and how much of it stays."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half], len(text) - half


def printed(walk: Walk, rows: list[tuple[int | None, bool, str]]) -> Iterator[tuple]:
    """The result rows of all but the last of some consecutive rows (doc_id, only here as a next row, text)."""
    points = [code_points(text) for _, _, text in rows]
    reached = walk.entered([0] * len(rows), points)
    prints = [walk.sampled(p, r) for p, r in zip(points, reached)]
    starts, tails, heads = [], [], []
    for k in range(len(rows) - 1):
        keep = len(points[k]) - len(points[k]) // 2
        heads.append(keep)
        starts.append(int(reached[k][keep]))
        tails.append(points[k + 1][: len(points[k]) - keep])
    onward = walk.entered(starts, tails)
    for k, keep in enumerate(heads):
        doc_id, only_next, text = rows[k]
        if only_next:
            continue
        changed = walk.sampled(np.concatenate([points[k][:keep], tails[k]]), np.concatenate([reached[k][:keep], onward[k]]))
        yield (
            doc_id, len(text), hashlib.sha256(edited(text, rows[k + 1][2])[0].encode()).hexdigest(), prints[k].decode(), changed.decode(),
            walk.likeness(prints[k], changed), walk.likeness(prints[k], prints[k + 1]), walk.bands(prints[k]),
        )


SHAPE = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()), ("near_next", pa.float64()), ("bands", pa.list_(pa.int64())),
    ]
)
PRINTS = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bands array<bigint>"


def print_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of slices, each sorted and closed by the first row of the next one, read as a stream."""
    walk = Walk()
    held: list[tuple[int | None, bool, str]] = []
    size = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(SHAPE.names, row)) for row in printed(walk, held)], SHAPE)

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for doc_id, only_next, packed in zip(*(batch.column(name) for name in ("doc_id", "only_next", "packed"))):
            held.append((doc_id.as_py(), only_next.as_py(), unpack(packed.as_py()).decode()))
            size += len(held[-1][2])
            if size > CHUNK:
                yield out()
                held = held[-1:]
                size = len(held[0][2])
    if held:
        yield out()


SLICED = "slice int, only_next boolean, doc_id bigint, key bigint, tie bigint, packed binary"


def slicer(splits: np.ndarray) -> Callable:
    """Rows (doc_id, key, tie, text) to their slices, the first row of a slice also to the slice before; texts are compressed,
    since every one of them is about to be shuffled."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            keys = np.empty(batch.num_rows, splits.dtype)
            for name in splits.dtype.names:
                keys[name] = batch.column(name).to_numpy()
            own = np.searchsorted(splits, keys, side="right") - 1
            first = np.flatnonzero(splits[own] == keys)
            rows = np.concatenate([np.arange(batch.num_rows), first])
            target = np.concatenate([own, (own[first] - 1) % len(splits)]).astype(np.int32)
            packed = pa.array([pack((text.as_py() or "").encode()) for text in batch.column("text")], pa.binary())
            narrow = pa.RecordBatch.from_arrays([*(batch.column(name) for name in ("doc_id", "key", "tie")), packed], ["doc_id", "key", "tie", "packed"]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(target), pa.array(np.arange(len(rows)) >= batch.num_rows), *narrow.columns], ["slice", "only_next", *narrow.schema.names]
            )

    return sliced


def fingerprints(docs: DataFrame, rows: int = ROWS, slices: int = SLICES) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how alike they and the next document's are."""
    spark = docs.sparkSession
    placed = located(docs.select("doc_id", "text"))
    keyed = placed.select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(LOWEST).cast("bigint")).alias("key"), F.xxhash64(F.col(LOC)["file"], F.col(LOC)["row"]).alias("tie"),
    )
    ranked = numbered(keyed.select("key", "tie"), ["key", "tie"])
    span = max(rows, -(-ranked.count() // slices))
    firsts = ranked.where(F.col("position") % span == 0).select("key", "tie").collect()
    if not firsts:
        return spark.createDataFrame([], PRINTS)
    splits = np.sort(np.array([tuple(r) for r in firsts], [("key", np.int64), ("tie", np.int64)]))
    sliced = keyed.mapInArrow(slicer(splits), SLICED).repartition("slice").sortWithinPartitions("slice", "only_next", "key", "tie")
    return sliced.select("doc_id", "only_next", "packed").mapInArrow(print_slices, PRINTS)


def stored(prints: DataFrame) -> DataFrame:
    """Written to the shared folder; hex digits are entropy-coded, they take half."""
    path = scratch_path(prints.sparkSession, "prints")
    prints.write.option("compression", "zstd").parquet(path)
    return prints.sparkSession.read.schema(prints.schema).parquet(path)


def last_digits(column) -> np.ndarray:
    octets = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, LAST // 2)
    return np.stack([octets >> 4, octets & 15], axis=2).reshape(-1, LAST)


def too_far(differ: np.ndarray, ends: np.ndarray, least: float) -> np.ndarray:
    """Which pairs are less than `least` alike, from the steps that are known to differ and the digits of the longer one."""
    share = least * (1 - CHANCE) + CHANCE if least > 0 else 0.0
    return differ > (1 - share + 1e-9) * STEPS_BEFORE[ends]


def ruled_out(one: np.ndarray, other: np.ndarray, one_ends: np.ndarray, other_ends: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of fingerprints are less than `least` alike whatever their other digits are, from their last digits and how
    many they have: places that only one of them reaches differ, and so do different digits of places that both show."""
    high, low = np.maximum(one_ends, other_ends), np.minimum(one_ends, other_ends)
    gap, longer = np.minimum(high - low, LAST), (one_ends >= other_ends)[:, None]
    shorter = np.where(longer, other, one)
    shown = sliding_window_view(np.concatenate([shorter, np.zeros_like(shorter)], axis=1), LAST, axis=1)[np.arange(len(gap)), gap]
    differ = (np.where(longer, one, other) != shown) & (np.arange(LAST) < (LAST - gap)[:, None])
    known = np.einsum("ij,ij->i", LAST_STEPS[high], differ, dtype=np.float32) + STEPS_BEFORE[high] - STEPS_BEFORE[low]
    return too_far(known, high, least)


def open_pairs(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sides = [last_digits(batch.column(name)) for name in ("last", "other_last")] + [batch.column(name).to_numpy() for name in ("ends", "other_ends")]
            yield pa.RecordBatch.from_arrays([batch.column("print"), batch.column("to")], ["print", "to"]).filter(pa.array(~ruled_out(*sides, least)))


def verified(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    walk = None
    for batch in batches:
        walk = walk or Walk(steps=False)
        a, b = batch.column("fingerprint").to_pylist(), batch.column("other").to_pylist()
        score = np.array([walk.likeness(x.encode(), y.encode()) for x, y in zip(a, b)], np.float64)
        yield pa.RecordBatch.from_arrays([batch.column("print"), batch.column("to")], ["print", "to"]).filter(pa.array(score >= least))


def shard_tables(batches: Iterator[pa.RecordBatch], by: tuple[str, ...] = ("band", "left", "right")) -> Iterator[pa.Table]:
    """One table for each shard, which come sorted."""
    held, name = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in by], axis=1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for low, high in zip(edges, edges[1:]):
            if held and tuple(keys[low]) != name:
                yield pa.concat_tables(held)
                held = []
            name = tuple(keys[low])
            held.append(pa.Table.from_batches([batch.slice(low, high - low)]))
    if held:
        yield pa.concat_tables(held)


SHARD = "band bigint, left int, right int, part int, print bigint, root bigint"


def pair_blocks(after: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every row with as many of the rows after it as `after` says, about PAIRS pairs at a time."""
    before = np.concatenate([[0], np.cumsum(after)])
    at = 0
    while at < len(after):
        stop = max(at + 1, int(np.searchsorted(before, before[at] + PAIRS, side="right")) - 1)
        one = np.repeat(np.arange(at, stop), after[at:stop])
        yield one, one + 1 + np.arange(len(one)) - np.repeat(before[at:stop] - before[at], after[at:stop])
        at = stop


def hopeful(least: float):
    """Task function: rows (..SHARD, last, ends), sorted by shard -> the rows (..SHARD) whose last digits leave open that they are
    alike to another row that `linked` compares them with."""
    names = [column.split()[0] for column in SHARD.split(", ")]

    def kept(rows: pa.Table, edges: np.ndarray) -> list[pa.RecordBatch]:
        digits, ends = last_digits(rows.column("last")), rows.column("ends").to_numpy()
        root, part = rows.column("root").to_numpy(), rows.column("part").to_numpy()
        halves = rows.column("left").to_numpy() != rows.column("right").to_numpy()
        keep = np.zeros(len(ends), bool)
        sizes = np.diff(edges)
        for one, other in pair_blocks(np.repeat(np.cumsum(sizes), sizes) - 1 - np.arange(len(ends))):
            meet = (root[one] != root[other]) & (~halves[one] | (part[one] != part[other]))
            one, other = one[meet], other[meet]
            high, low = np.maximum(ends[one], ends[other]), np.minimum(ends[one], ends[other])
            meet = ~too_far(STEPS_BEFORE[high] - STEPS_BEFORE[low], high, least)
            one, other = one[meet], other[meet]
            near = ~ruled_out(digits[one], digits[other], ends[one], ends[other], least)
            keep[one[near]] = keep[other[near]] = True
        return rows.select(names).filter(pa.array(keep)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = None
        for batch in batches:
            if not batch.num_rows:
                continue
            more = pa.Table.from_batches([batch])
            rows = more if rows is None else pa.concat_tables([rows, more])
            keys = np.stack([rows.column(c).to_numpy() for c in ("band", "left", "right")], axis=1)
            edges = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1])
            if len(edges) > 1:  # the last shard may go on in the next batch
                yield from kept(rows.slice(0, edges[-1]), edges)
                rows = rows.slice(edges[-1])
        if rows is not None:
            yield from kept(rows, np.array([0, rows.num_rows]))

    return run


def linked(least: float):
    """Task function: rows (band, left, right, part, print, root, fingerprint), sorted by shard -> links (print, to) that join all
    rows of a shard that are at least `least` alike; rows of equal `root` are joined already. A row is compared with the rows after
    it, in a shard of two parts with those of the other part only."""

    def links(rows: pa.Table, walk: Walk) -> pa.RecordBatch:
        prints, texts = rows.column("print").to_pylist(), rows.column("fingerprint").to_pylist()
        size = max(map(len, texts))
        digits = np.frombuffer("".join(t.ljust(size, "-") for t in texts).encode(), np.uint8).reshape(len(texts), size)
        _, groups = np.unique(rows.column("root").to_numpy(), return_inverse=True)
        part = rows.column("part").to_numpy()
        halves = part.min() != part.max()
        found = []
        for at in range(len(texts) - 1):
            rest = np.flatnonzero(groups[at + 1 :] != groups[at]) + at + 1
            rest = rest[part[rest] != part[at]] if halves else rest
            if len(rest):
                for other in rest[walk.alike(digits[at], digits[rest]) >= least].tolist():
                    if groups[other] != groups[at]:
                        found.append((prints[at], prints[other]))
                        groups[groups == groups[other]] = groups[at]
        return pa.RecordBatch.from_arrays([pa.array([pair[k] for pair in found], pa.int64()) for k in range(2)], ["print", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for table in shard_tables(batches):
            walk = walk or Walk(steps=False)
            yield links(table, walk)

    return run


def small(df: DataFrame, label: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Written and counted: broadcast up to `rows` narrow rows, joined by a shuffle beyond them. The result is the same."""
    table = written(df, label)
    return F.broadcast(table) if table.count() <= rows else table


def near_documents(prints: DataFrame, least: float = ALIKE, most: int = SHARD_ROWS) -> DataFrame:
    """(print, near_id): the smallest doc_id that links between fingerprints at least `least` alike reach, for the fingerprints
    of which that is not simply the only row. `print` is the 64-bit hash of the fingerprint.

    Every member of a band first meets the band's first; where that leaves other members apart, all of these are compared. A band
    of over `most` such rows is cut into parts, and every two parts are compared in a task of their own.
    """
    named = prints.withColumn("print", digest_of("fingerprint"))
    texts = written(named.groupBy("print").agg(F.min("doc_id").alias("own"), F.count("*").alias("copies")), "texts")
    heads = named.join(texts.withColumnRenamed("print", "_print"), (F.col("print") == F.col("_print")) & (F.col("doc_id").eqNullSafe(F.col("own"))))
    plain = heads.groupBy(F.col("print").alias("_print")).agg(F.first("fingerprint").alias("fingerprint"))
    bands = heads.select("print", F.explode("bands").alias("band"))
    own_band = Window.partitionBy("band")
    shared = written(bands.withColumns({"to": F.min("print").over(own_band), "n": F.count("*").over(own_band)}).where("n > 1"), "shared")
    digits = F.rtrim("fingerprint", F.lit("-"))
    last = F.unhex(F.lpad(F.right(digits, F.lit(LAST)), LAST, "0"))
    ends = written(plain.select(F.col("_print"), last.alias("last"), F.length(digits).cast("bigint").alias("ends")), "ends")
    met = shared.where("to <> print").select("print", "to").distinct()
    sides = met.join(ends, F.col("print") == F.col("_print")).drop("_print")
    others = ends.select("_print", F.col("last").alias("other_last"), F.col("ends").alias("other_ends"))
    sides = sides.join(others, F.col("to") == F.col("_print")).drop("_print")
    open_ = small(sides.mapInArrow(lambda batches: open_pairs(batches, least), "print bigint, to bigint"), "meetings")
    left = open_.join(plain, F.col("print") == F.col("_print")).drop("_print")
    pairs = small(left, "pairs").join(plain.withColumnRenamed("fingerprint", "other"), F.col("to") == F.col("_print")).drop("_print")
    good = written(pairs.mapInArrow(lambda batches: verified(batches, least), "print bigint, to bigint"), "links")

    roots = components(good, "print", "to").withColumnRenamed("node", "print")
    rooted = shared.where("n > 2 and to <> print").join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    members = F.sum(F.xxhash64("print").cast("decimal(38,0)")).alias("members")
    apart = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("rows"), members).where("low < high")
    apart = apart.groupBy("members", "rows").agg(F.min("band").alias("band"))  # bands of the same members are one
    parts = F.ceil(F.col("rows") / most).cast("int")
    own = rooted.join(apart.select("band", parts.alias("parts")), "band").withColumn("part", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = own.select("band", "part", "print", "root", every.alias("other")).select("band", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"), "part", "print", "root")
    name = ["band", "left", "right"]
    first = dealt.join(ends, F.col("print") == F.col("_print")).drop("_print").repartition(*name).sortWithinPartitions(*name)
    hoped = small(first.mapInArrow(hopeful(least), SHARD), "hoped")
    shards = hoped.join(plain, F.col("print") == F.col("_print")).drop("_print").repartition(*name).sortWithinPartitions(*name)
    further = written(shards.mapInArrow(linked(least), "print bigint, to bigint"), "further")

    groups = components(good.unionByName(further), "print", "to").withColumnRenamed("node", "print")
    placed = texts.join(groups, "print", "left").withColumn("root", F.coalesce("root", "print"))
    lowest = placed.groupBy("root").agg(F.min("own").alias("near_id"), F.sum("copies").alias("rows")).where("rows > 1")
    return placed.join(lowest, "root").select("print", "near_id")


def digest_of(column: str) -> Column:
    return F.xxhash64(column)


def op12_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = stored(fingerprints(documents(spark, sf_dir)))
    near = small(near_documents(prints), "near")
    rows = prints.withColumn("print", digest_of("fingerprint")).join(near, "print", "left")
    return rows.select(*[n for n in SHAPE.names if n != "bands"], F.coalesce("near_id", "doc_id").alias("near_id"))

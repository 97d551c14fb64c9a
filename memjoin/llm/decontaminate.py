"""Benchmark decontamination: word-pair seeds, then Smith-Waterman alignment.

The test items are a stated query set: they go to the tasks in blocks of at most `block_items` items and `block_bytes` bytes,
and every block meets all documents in one pass. The score is the best local alignment of the item with the whole text (match
2, mismatch -1, gap -1) over a perfect one.

The seeds lose no pair that reaches the threshold. Two words that follow each other in an alignment have c edits between
them; with c of 0 or 1 they are a pair of words one or two places apart in the item and in the text. Such a pair weighs 2 - c.
An alignment of score s with m matches and e = 2m - s edits has pairs that weigh 2(m - 1) - e = s - 2 in all, and its gaps
keep the diagonals of its matches within 2n - s of each other, n being the words of the item. So a text is aligned where pairs
of that weight stand within so many diagonals, on all words that such an alignment can reach.

Defined cases: words are lower-cased runs of letters, digits and non-ASCII characters; an item without words has no hits; an
item shorter than `size` words is its own seed; null and empty texts have no hits; repeated rows and repeated items give a row
for each pair; empty tables give no rows; other columns are not read. With a threshold that one matching word of an item of
`size` words reaches, one pair is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memjoin.llm.common import BYTE_BASE, OCTET, WORD_BASE, Rolling, documents, drop_rows, located, mix, octets, text_rows, word_bounds
from memjoin.llm.licenses import FOLD, SEPARATORS

SEED_WORDS = 4  # shorter items are matched as they stand
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
PAIRS_AT_ONCE = 256
HITS_AT_ONCE = 1 << 21
RUN = 1 << 19  # bytes of text whose words are hashed together


class Words:
    """Hashes of the words of several texts, and of their n-grams."""

    def __init__(self):
        self.letters, self.chain = Rolling(BYTE_BASE), Rolling(WORD_BASE)

    def of(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word and the row it stands in."""
        data, offsets = octets(rows)
        data = FOLD[data]
        starts, ends = word_bounds(data, SEPARATORS)
        return self.letters.slices(self.letters.prefix(OCTET[data]), starts, ends), np.searchsorted(offsets, starts, side="right") - 1

    def grams(self, words: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each n-gram within a row and the place where it starts."""
        if len(words) < size:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        starts = np.flatnonzero(owner[: len(owner) - size + 1] == owner[size - 1 :])
        return self.chain.slices(self.chain.prefix(words), starts, starts + size), starts


def pairs(words: np.ndarray, owner: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word with the one `step` places later in its row, and the place of the first."""
    starts = np.flatnonzero(owner[:-step] == owner[step:])
    return mix(words[starts] * WORD_BASE + words[starts + step]), starts


class Items:
    """A block of test items: their words and seeds (gram, item, place, weight, length), ordered by gram.

    Seeds of length 0 are pairs of words; an item of fewer than `size` words has itself as its only seed, of its length.
    """

    def __init__(self, ids: list, texts: list[str | None], size: int, threshold: float = THRESHOLD):
        words = Words()
        hashed, owner = words.of([(t or "").encode() for t in texts])
        self.ids = ids
        self.starts = np.searchsorted(owner, np.arange(len(ids) + 1))
        self.words = hashed
        self.sizes = np.diff(self.starts)
        least = np.ceil(MATCH * threshold * self.sizes - 1e-9).astype(np.int64)
        self.need = np.where(self.sizes < size, 0, np.maximum(least - MATCH, 1))
        self.reach = np.maximum(MATCH * self.sizes - least, 0)
        grams, at, length, step = [], [], [], []
        for n in range(1, size):
            found, starts = words.grams(hashed, owner, n)
            fit = self.sizes[owner[starts]] == n
            grams.append(found[fit])
            at.append(starts[fit])
            length.append(np.full(int(fit.sum()), n))
            step.append(np.zeros(int(fit.sum()), np.int64))
        for apart in (1, 2):
            found, starts = pairs(hashed, owner, apart)
            fit = self.sizes[owner[starts]] >= size
            grams.append(found[fit])
            at.append(starts[fit])
            length.append(np.zeros(int(fit.sum()), np.int64))
            step.append(np.full(int(fit.sum()), apart))
        grams, at, length, step = map(np.concatenate, (grams, at, length, step))
        order = np.lexsort((grams, length))
        self.item, self.place, self.step = owner[at[order]], (at - self.starts[owner[at]])[order], step[order]
        cuts = np.searchsorted(length[order], np.arange(size + 1))
        self.seeds = {n: (int(cuts[n]), grams[order][cuts[n] : cuts[n + 1]]) for n in range(size) if cuts[n] < cuts[n + 1]}


def hits(items: Items, words: Words, hashed: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place in the texts, first and past-last posting, words apart in the text) for each seed that stands in the texts."""
    out = []
    for n, (base, seeds) in items.seeds.items():
        for step in (1, 2) if n == 0 else (0,):
            grams, starts = pairs(hashed, owner, step) if n == 0 else words.grams(hashed, owner, n)
            low, high = np.searchsorted(seeds, grams, side="left"), np.searchsorted(seeds, grams, side="right")
            found = high > low
            out.append((starts[found], base + low[found], base + high[found], np.full(int(found.sum()), step)))
    return tuple(map(np.concatenate, zip(*out))) if out else (np.zeros(0, np.int64),) * 4


def align(items: list[np.ndarray], regions: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each item with its region, all pairs side by side."""
    wide, deep = max(map(len, regions)), max(map(len, items))
    text, query = np.zeros((len(items), wide), np.uint64), np.zeros((len(items), deep), np.uint64)
    inside, alive = np.zeros((len(items), wide), bool), np.zeros((len(items), deep), bool)
    for i, (item, region) in enumerate(zip(items, regions)):
        query[i, : len(item)], alive[i, : len(item)] = item, True
        text[i, : len(region)], inside[i, : len(region)] = region, True
    above, best = np.zeros((len(items), wide + 1), np.int32), np.zeros(len(items), np.int32)
    slope = np.arange(wide + 1, dtype=np.int32) * -GAP
    for row in range(deep):
        step = np.where((text == query[:, row : row + 1]) & inside & alive[:, row : row + 1], MATCH, MISMATCH).astype(np.int32)
        here = np.zeros_like(above)
        here[:, 1:] = np.maximum(np.maximum(above[:, :-1] + step, above[:, 1:] + GAP), 0)
        here = np.maximum.accumulate(here + slope, axis=1) - slope  # gaps along the text
        best = np.maximum(best, np.where(alive[:, row], here.max(axis=1), 0))
        above = here
    return best


def groups(items: Items, at, low, high, apart, first: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, item, from, to) where the seeds of an item allow the threshold; places are in the texts."""
    fan = high - low
    posting = np.repeat(low, fan) + np.arange(int(fan.sum())) - np.repeat(np.cumsum(fan) - fan, fan)
    place, item = np.repeat(at, fan), items.item[posting]
    row, diagonal = owner[place], place - items.place[posting]
    weight = np.where((items.step[posting] == 1) & (np.repeat(apart, fan) == 1), 2, 1)
    pair = row * len(items.ids) + item
    stride = int(diagonal.max() - diagonal.min() + items.reach.max() + 1)
    order = np.argsort(pair * stride + (diagonal - diagonal.min()), kind="stable")
    pair, item, diagonal, row = pair[order], item[order], diagonal[order], row[order]
    line = pair * stride + (diagonal - diagonal.min())
    total = np.concatenate([[0], np.cumsum(weight[order])])
    begins = total[np.searchsorted(line, line + items.reach[item], side="right")] - total[:-1] >= items.need[item]
    row, item, diagonal, pair = row[begins], item[begins], diagonal[begins], pair[begins]
    if not len(row):
        return []
    apart = (pair[1:] != pair[:-1]) | (diagonal[1:] - diagonal[:-1] > items.reach[item[1:]])
    begin = np.concatenate([[0], np.flatnonzero(apart) + 1])
    end = np.append(begin[1:], len(row)) - 1
    pad = items.reach[item[begin]]
    start = np.maximum(diagonal[begin] - pad, first[row[begin]])
    stop = np.minimum(diagonal[end] + items.sizes[item[begin]] + pad, first[row[begin] + 1])
    return list(zip(row[begin].tolist(), item[begin].tolist(), start.tolist(), stop.tolist()))


def aligned(docs: DataFrame, shared, threshold: float, kinds: tuple[str, str]) -> DataFrame:
    """(doc_id, item_id, score, first_word, n_words) of every document and item whose best score reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, words = shared.value, Words()
        for batch in batches:
            found: dict[tuple[int, int], tuple[float, int, int]] = {}
            for base, rows in text_rows(batch, "text", RUN):
                hashed, owner = words.of(rows)
                first = np.searchsorted(owner, np.arange(len(rows) + 1))
                todo, found_at = [], hits(items, words, hashed, owner)
                load = np.cumsum(np.bincount(owner[found_at[0]], found_at[2] - found_at[1], len(rows))).astype(np.int64) // HITS_AT_ONCE
                for part in np.unique(load[owner[found_at[0]]]):  # whole rows, about `HITS_AT_ONCE` hits at a time
                    mine = load[owner[found_at[0]]] == part
                    todo += groups(items, *(column[mine] for column in found_at), first, owner)
                todo.sort(key=lambda g: g[3] - g[2])  # like lengths side by side
                for cut in range(0, len(todo), PAIRS_AT_ONCE):
                    part = todo[cut : cut + PAIRS_AT_ONCE]
                    queries = [items.words[items.starts[i] : items.starts[i + 1]] for _, i, _, _ in part]
                    scores = align(queries, [hashed[a:b] for _, _, a, b in part])
                    for (row, i, a, b), query, score in zip(part, queries, scores.tolist()):
                        share = score / (MATCH * len(query))
                        if share >= threshold and share > found.get((base + row, i), (0.0,))[0]:
                            found[base + row, i] = (share, int(a - first[row]), int(b - a))
            if found:
                rows_, item = zip(*found)
                score, begin, size = zip(*found.values())
                columns = [batch.column("doc_id").take(pa.array(rows_)), pa.array([items.ids[i] for i in item]), pa.array(score, pa.float64()), pa.array(begin, pa.int64()), pa.array(size, pa.int64())]
                names = ["doc_id", "item_id", "score", "first_word", "n_words"]
                if "loc" in batch.schema.names:
                    columns.append(batch.column("loc").take(pa.array(rows_)))
                    names.append("loc")
                yield pa.RecordBatch.from_arrays(columns, names)

    place = f", loc {docs.schema['loc'].dataType.simpleString()}" if "loc" in docs.columns else ""
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, first_word bigint, n_words bigint{place}"
    return docs.mapInArrow(run, schema)


def contaminated(
    docs: DataFrame, bench: DataFrame, size: int = SEED_WORDS, threshold: float = THRESHOLD, block_items: int = 50_000, block_bytes: int = 32 << 20
) -> DataFrame:
    """Every (document, test item) whose alignment score reaches `threshold`; `docs` may carry a `loc` that stays with its row."""
    spark = docs.sparkSession
    texts = docs.select(*[c for c in ("doc_id", "loc", "text") if c in docs.columns])
    bench = bench.select("item_id", "text")
    kinds = tuple(frame.schema[name].dataType.simpleString() for frame, name in ((docs, "doc_id"), (bench, "item_id")))
    size_of = bench.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("octets")).first()
    blocks = max(1, -(-size_of["n"] // block_items), -(-size_of["octets"] // block_bytes))
    out = None
    for block in range(blocks):
        mine = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block
        rows = bench.where(mine).collect()  # a block of the query set, bounded by its parameters
        items = Items([r["item_id"] for r in rows], [r["text"] for r in rows], size, threshold)
        found = aligned(texts, spark.sparkContext.broadcast(items), threshold, kinds)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that hold no test item."""

    def find(rows: DataFrame) -> DataFrame:
        return contaminated(located(rows.select("doc_id", "text"), "loc"), bench).select("loc.*").distinct()

    return drop_rows(docs, find)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

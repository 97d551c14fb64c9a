"""SimHash near-dedup with BK-trees.

Each document gets a 64-bit fingerprint: the majority, bit by bit, of the XXH64 hashes of its word shingles. Equal
fingerprints collapse to one before any search. Two fingerprints within `radius` bits agree on all but `radius` of the
fingerprint's blocks, so every choice of the blocks that agree is a shard key and each fingerprint goes to the shards of its
keys. A shard holds a BK-tree: children keyed by their integer Hamming distance to the parent; a search follows only edges
whose key is within the radius of its own distance. Trees are built and searched where the shard is, since the number of
fingerprints has no bound that would allow a broadcast. A shard returns a spanning forest of its links, not its pairs, and
the components of all forests are found by star contraction over Spark.

Defined cases: null and word-less texts have fingerprint zero and link like any other; fewer words than a shingle make one
shingle; repeated rows share a fingerprint; a null doc_id takes part but never names a component that has another id; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from memjoin.llm.common import BYTE_BASE, LOC, OCTET, WORD_BASE, Rolling, components, documents, drop_rows, located, octets, text_rows, word_bounds, written
from memjoin.llm.edit_prints import pair_blocks, shard_tables

BITS, BLOCKS = 64, 4
SEED = 42  # fixed by the contract
FINGERPRINT_WORDS, RADIUS = 3, 2
SHARD_ROWS = 4096  # rows of a shard that one task compares
COUNTED = 1 << 20  # shingles that a task counts at a time
RUN = 1 << 18  # bytes of text whose shingles are hashed together
OFTEN, FREQUENT = 3, 200_000  # times in that many that make a shingle frequent; frequent shingles that are told to the tasks
SLACK = 1e-6  # of a shingle, for sums of doubles
PAIRS, BITMAPS = 1 << 18, 1 << 23  # pairs whose bitmaps are compared at a time, bytes of bitmaps
FINE = 8  # how much longer the bitmaps are that choose the links to verify
BROADCAST_ROWS = 200_000
VISITS = 1 << 20  # (query, node) pairs held at a time


def fingerprint(text: bytes, size: int) -> int:
    """Majority of the bits of the XXH64 hashes of all word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(size)]))
    count = max(1, len(words) - size + 1)
    hashes = np.fromiter(map(partial(xxh64_intdigest, seed=SEED), shingles), np.uint64, count)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, count, 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, file, row, fp) of every row; `fp` is the fingerprint as a signed BIGINT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(text, words) for _, rows in text_rows(batch, "text") for text in rows]
            column = pa.array(np.array(made, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("file"), batch.column("row"), column], ["doc_id", "file", "row", "fp"])

    placed = located(docs.select("doc_id", "text"))
    rows = placed.select("doc_id", F.col(LOC)["file"].alias("file"), F.col(LOC)["row"].alias("row"), "text")
    kind = placed.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, file string, row bigint, fp bigint")


def shard_keys(fp: Column, radius: int) -> Column:
    """One key for each choice of the blocks that agree; finer blocks than needed keep shards small."""
    blocks = max(BLOCKS, radius + 1)
    edges = [BITS * b // blocks for b in range(blocks + 1)]
    keys = []
    for index, agree in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in agree)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(index), fp.bitwiseAND(F.lit(signed).cast("bigint"))))
    return F.array(*keys)


def forest(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees over `values`, one for each run of equal `keys`: parent, edge (distance to the parent), root of each node."""
    count = len(values)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    root = np.repeat(first, np.diff(np.append(first, count)))
    parent, edge = np.full(count, -1, np.int64), np.zeros(count, np.int64)
    waiting = np.setdiff1d(np.arange(count), first)
    at = root[waiting]
    while len(waiting):
        apart = np.bitwise_count(values[waiting] ^ values[at]).astype(np.int64)
        place = at * (BITS + 1) + apart
        _, new, back = np.unique(place, return_index=True, return_inverse=True)
        parent[waiting[new]], edge[waiting[new]] = at[new], apart[new]
        at = waiting[new][back]
        stay = np.ones(len(waiting), dtype=bool)
        stay[new] = False
        waiting, at = waiting[stay], at[stay]
    return parent, edge, root


def within(values: np.ndarray, trees: tuple[np.ndarray, np.ndarray, np.ndarray], queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) pairs at most `radius` apart; from each node only edges within the radius of its distance are followed."""
    parent, edge, root = trees
    children = np.flatnonzero(parent >= 0)
    place = parent[children] * (BITS + 1) + edge[children]
    order = np.argsort(place, kind="stable")
    place, children = place[order], children[order]
    nobody = np.zeros(0, np.int64)
    stack = [(queries[at : at + VISITS], root[queries[at : at + VISITS]], nobody, nobody) for at in range(0, len(queries), VISITS)]
    while stack:
        query, node, low, high = stack.pop()
        if len(low):  # edges to follow; long frontiers are halved before they unfold, so that memory stays bounded
            fan = high - low
            if int(fan.sum()) > VISITS and len(query) > 1:
                half = len(query) // 2
                stack += [(query[:half], nobody, low[:half], high[:half]), (query[half:], nobody, low[half:], high[half:])]
                continue
            steps = np.arange(int(fan.sum())) - np.repeat(np.cumsum(fan) - fan, fan)
            query, node = np.repeat(query, fan), children[np.repeat(low, fan) + steps]
        apart = np.bitwise_count(values[query] ^ values[node]).astype(np.int64)
        near = apart <= radius
        yield query[near], node[near]
        low = np.searchsorted(place, node * (BITS + 1) + np.maximum(apart - radius, 0), side="left")
        high = np.searchsorted(place, node * (BITS + 1) + np.minimum(apart + radius, BITS), side="right")
        open_ = high > low
        if open_.any():
            stack.append((query[open_], nobody, low[open_], high[open_]))


def join_roots(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the sets that `label` names, over the links (a, b); labels are indexes of set members."""
    while True:
        left, right = label[a], label[b]
        differ = left != right
        if not differ.any():
            return label
        np.minimum.at(label, np.maximum(left, right)[differ], np.minimum(left, right)[differ])
        while (further := label[label]).tobytes() != label.tobytes():
            label = further


def shard_links(radius: int):
    """Task function: rows (key, fp) sorted by key -> spanning links (a, b) of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = [], []
        for batch in batches:
            keys.append(batch.column("key").to_numpy(zero_copy_only=False))
            values.append(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
        if not keys:
            return
        keys, values = np.concatenate(keys), np.concatenate(values)
        same = keys[1:] == keys[:-1]
        crowd = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        keys, values = keys[crowd], values[crowd]
        if not len(keys):
            return
        label = np.arange(len(keys))
        for query, node in within(values, forest(keys, values), np.arange(len(keys)), radius):
            label = join_roots(label, query, node)
        linked = label != np.arange(len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(values[linked].view(np.int64)), pa.array(values[label[linked]].view(np.int64))], ["a", "b"])

    return run


def tree_links(single: DataFrame, radius: int) -> DataFrame:
    """(a, b): links that join all fingerprints `fp`, one row each, which are at most `radius` apart."""
    keyed = single.select("fp", F.explode(shard_keys(F.col("fp"), radius)).alias("key"))
    dealt = keyed.repartition(F.col("key")).sortWithinPartitions("key")
    return dealt.mapInArrow(shard_links(radius), "a bigint, b bigint")


def linked_components(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id): every different fingerprint and the smallest doc_id that its links reach."""
    single = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    stars = components(tree_links(single, radius), "a", "b")
    named = single.join(stars, single["fp"] == stars["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = written(named, "named")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return named.join(smallest, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, file, row, fp, component_id) for every row of `docs`."""
    prints = written(fingerprints(docs, words), "fingerprints")
    return prints.join(linked_components(prints, radius), "fp")


# ---------------------------------------------------------------- near copies by verified similarity

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each shingle of `size` words; fewer words make one shingle."""
    words = text.lower().split()
    shingles = map(b" ".join, zip(*[words[i:] for i in range(size)])) if len(words) >= size else iter([b" ".join(words)])
    return np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64)


class Shingles:
    """The same shingles for many texts at once, by rolling hashes."""

    def __init__(self, size: int):
        self.size, self.letters, self.chain = size, Rolling(BYTE_BASE), Rolling(WORD_BASE)

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        """The different shingles of each text in ascending order; none without words."""
        data, offsets = octets(texts)
        data = LOWER[data]
        starts, ends = word_bounds(data)
        words = self.letters.slices(self.letters.prefix(OCTET[data]), starts, ends)
        first = np.searchsorted(starts, offsets)  # a text's words, from its own to the next one's
        low, high = (np.repeat(side, np.diff(first)) for side in (first[:-1], first[1:]))
        begin = np.arange(len(words))
        begin = begin[(begin + self.size <= high) | (begin == low)]
        hashes = self.chain.slices(self.chain.prefix(words), begin, np.minimum(begin + self.size, high[begin]))
        edges = np.searchsorted(begin, first).tolist()
        return [np.unique(hashes[a:b]) for a, b in zip(edges, edges[1:])]


def frequent_shingles(docs: DataFrame, size: int, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, ascending, and for each the binary logarithm of how many texts of `docs` hold it, as far as
    tasks saw it often. Only the order of shingles comes from it, which is free: no result depends on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, held, count = Shingles(size), [], 0

        def out() -> pa.RecordBatch:
            names, n = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
            often = n >= OFTEN
            return pa.RecordBatch.from_arrays([pa.array(names[often].view(np.int64)), pa.array(n[often])], ["shingle", "n"])

        for batch in batches:
            for _, texts in text_rows(batch, "text", RUN):
                held += shingles.of(texts)
                count += sum(map(len, held[-len(texts) :]))
                if count > COUNTED:
                    yield out()
                    held, count = [], 0
        yield out()

    counts = docs.select("text").mapInArrow(run, "shingle bigint, n bigint").groupBy("shingle").agg(F.floor(F.log2(F.sum("n"))).cast("int").alias("level"))
    counts = written(counts, "frequent")
    levels = {r["level"]: r["n"] for r in counts.groupBy("level").agg(F.count("*").alias("n")).collect()}
    least, told = 64, 0
    while least and told + levels.get(least - 1, 0) <= most:
        least -= 1
        told += levels.get(least, 0)
    table = counts.where(F.col("level") >= least).toArrow()
    names, level = table.column("shingle").to_numpy().view(np.uint64), table.column("level").to_numpy()
    order = np.argsort(names)
    return names[order], level[order].astype(np.uint8)


def needed(size: int, similarity: float) -> int:
    """Shingles that a text of `size` different ones shares at least with any near copy."""
    return max(1, int(np.ceil(similarity * size - SLACK)))


def prefix(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles of a text, the frequent ones last: two near copies share one of them, since they share `needed` shingles
    and the first of these in the order has no more than the others behind it."""
    names, level = frequent
    if len(names) and len(shingles):
        at = np.minimum(np.searchsorted(names, shingles), len(names) - 1)
        shingles = shingles[np.argsort(np.where(names[at] == shingles, level[at] + 1, 0), kind="stable")]
    return shingles[: len(shingles) - needed(len(shingles), similarity) + 1]


def bitmap(shingles: np.ndarray, times: int = 1) -> bytes:
    """A bit for each value of the last bits of the shingles, about `times` bits for each shingle."""
    marks = np.zeros(times << max(6, (len(shingles) - 1).bit_length()), bool)
    marks[(shingles & np.uint64(len(marks) - 1)).astype(np.int64)] = True
    return np.packbits(marks, bitorder="little").tobytes()


def open_pairs(size: np.ndarray, bits: list[bytes], one: np.ndarray, other: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of rows can be near copies by their bitmaps: texts differ by a shingle at least for each bit that differs."""
    octets_of = np.array([len(b) for b in bits], np.int64)
    width = np.minimum(octets_of[one], octets_of[other])
    differ = np.zeros(len(one), np.int64)
    for w in np.unique(width).tolist():
        pairs = np.flatnonzero(width == w)
        rows, back = np.unique(np.concatenate([one[pairs], other[pairs]]), return_inverse=True)
        folded = np.stack([np.bitwise_or.reduce(np.frombuffer(bits[row], np.uint64).reshape(-1, w // 8), axis=0) for row in rows.tolist()])
        left, right = back[: len(pairs)], back[len(pairs) :]
        step = max(1, BITMAPS // w)
        for at in range(0, len(pairs), step):
            some = slice(at, at + step)
            differ[pairs[some]] = np.bitwise_count(folded[left[some]] ^ folded[right[some]]).sum(axis=1, dtype=np.int64)
    both = size[one] + size[other]
    return (both - differ) // 2 * (1 + similarity) >= similarity * both - SLACK


def open_links(similarity: float):
    """Task function: links (a, b, size, bits, other_size, other_bits) -> those (a, b) that the bitmaps leave open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.concatenate([batch.column(c).to_numpy() for c in ("size", "other_size")])
            bits = batch.column("bits").to_pylist() + batch.column("other_bits").to_pylist()
            one = np.arange(batch.num_rows)
            near = open_pairs(size, bits, one, one + batch.num_rows, similarity)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near))

    return run


def prefixed(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(rid, doc_id, file, row, fp, size, keys, bits) of every row, written; `fp` is the fingerprint of op7, `size` the number of
    different shingles, `keys` the prefix, which is empty without words, `bits` the bitmap."""
    placed = located(docs.select("doc_id", "text"))
    shared = placed.sparkSession.sparkContext.broadcast(frequent_shingles(placed, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid, shingles = TaskContext.get().partitionId() << 40, Shingles(words)
        for batch in batches:
            keys, sizes, prints, bits = [], [], [], []
            for _, rows in text_rows(batch, "text", RUN):
                prints += [fingerprint(text, FINGERPRINT_WORDS) for text in rows]
                sets = shingles.of(rows)
                sizes += map(len, sets)
                keys += [prefix(s, shared.value, similarity).view(np.int64) for s in sets]
                bits += map(bitmap, sets)
            ids = pa.array(np.arange(rid, rid + len(keys)))
            rid += len(keys)
            fps = pa.array(np.array(prints, np.uint64).view(np.int64))
            columns = [ids, *(batch.column(c) for c in ("doc_id", "file", "row")), fps, pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "file", "row", "fp", "size", "keys", "bits"])

    rows = placed.select("doc_id", F.col(LOC)["file"].alias("file"), F.col(LOC)["row"].alias("row"), "text")
    kind = placed.schema["doc_id"].dataType.simpleString()
    return written(rows.mapInArrow(run, f"rid bigint, doc_id {kind}, file string, row bigint, fp bigint, size bigint, keys array<bigint>, bits binary"), "prefixes")


def shards(prints: DataFrame, most: int, radius: int) -> DataFrame:
    """(key, rid, size, place, first, rows, parts): the rows that hold a shingle in their prefixes, `place` places from its begin, and
    those that the BK-trees link, as place -1; `first` is the smallest of a shard's `rows` rows, which make `parts` parts."""
    wordy = prints.where(F.size("keys") > 0)
    held = wordy.select("rid", "size", F.posexplode("keys").alias("place", "key"))
    single = wordy.groupBy("fp").agg(F.min(F.struct("rid", "size")).alias("one"))
    links = tree_links(single, radius).distinct().select(F.xxhash64(F.lit("tree"), "a", "b").alias("key"), F.explode(F.array("a", "b")).alias("fp"))
    linked = links.join(single, "fp").select("one.rid", "one.size", F.lit(-1).alias("place"), "key")
    equal = wordy.select("rid", "size", F.lit(-1).alias("place"), F.xxhash64(F.lit("tree"), "fp").alias("key"))
    own = Window.partitionBy("key")
    met = held.unionByName(linked).unionByName(equal).withColumns({"first": F.min(F.struct("rid", "size", "place")).over(own), "rows": F.count("*").over(own)})
    return written(met.where("rows > 1").withColumn("parts", F.ceil(F.col("rows") / most).cast("int")), "shared")


def may_reach(size, place, other_size, other_place, similarity: float, least):
    """Whether two texts can be near copies if the shingle at these places is the first in the order that they share: no more are
    shared than stand behind it in either. For columns and arrays; `least` is the smaller of two."""
    return least(size - place, other_size - other_place) * (1 + similarity) >= similarity * (size + other_size) - SLACK


def rows_behind(shard: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows, whose shards follow each other, and how many later ones each is compared with in it: rows of a shard's
    most frequent root come last and are compared with none, being one already."""
    order = np.lexsort((root, shard))
    name, owner = root[order], shard[order]
    starts = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])]))
    sizes = np.diff(np.append(starts, len(order)))
    by_size = np.lexsort((sizes, owner[starts]))
    largest = by_size[np.append(np.diff(owner[starts][by_size]) != 0, True)]
    last = np.repeat(np.isin(np.arange(len(starts)), largest), sizes)
    again = np.lexsort((last, owner))
    behind = np.searchsorted(owner, owner, side="right") - 1 - np.arange(len(order))
    return order[again], np.where(last[again], 0, behind)


SHARD = "key bigint, left int, right int, part int, rid bigint, root bigint, size bigint, place bigint"
NAME = ("key", "left", "right")


def hopeful(similarity: float):
    """Task function: rows (..SHARD), with bitmaps or without, sorted by shard -> the rows (..SHARD) that can be near copies of
    another row of their shard that is not joined to them; of a shard of two parts, of the other part."""
    names = [column.split()[0] for column in SHARD.split(", ")]

    def kept(rows: pa.Table, shard: np.ndarray) -> list[pa.RecordBatch]:
        size, place, root, part = (rows.column(c).to_numpy() for c in ("size", "place", "root", "part"))
        halves = rows.column("left").to_numpy() != rows.column("right").to_numpy()
        order, behind = rows_behind(shard, root)
        bits = rows.column("bits").to_pylist() if "bits" in rows.column_names else None
        keep = np.zeros(len(shard), bool)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def judge() -> None:
            one, other = (np.concatenate(side) for side in zip(*held))
            near = slice(None) if bits is None else open_pairs(size, bits, one, other, similarity)
            keep[one[near]] = keep[other[near]] = True
            held.clear()

        for one, other in pair_blocks(behind):
            one, other = order[one], order[other]
            meet = (root[one] != root[other]) & (~halves[one] | (part[one] != part[other]))
            one, other = one[meet], other[meet]
            meet = may_reach(size[one], place[one], size[other], place[other], similarity, np.minimum)
            held.append((one[meet], other[meet]))
            if sum(len(some) for some, _ in held) > PAIRS:
                judge()
        if held:
            judge()
        return rows.select(names).filter(pa.array(keep)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = None
        for batch in batches:
            if not batch.num_rows:
                continue
            more = pa.Table.from_batches([batch])
            rows = more if rows is None else pa.concat_tables([rows, more])
            keys = np.stack([rows.column(c).to_numpy() for c in names[:3]], axis=1)
            shard = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))])
            if shard[-1]:  # the last shard may go on in the next batch
                edge = int(np.searchsorted(shard, shard[-1]))
                yield from kept(rows.slice(0, edge), shard[:edge])
                rows = rows.slice(edge)
        if rows is not None:
            yield from kept(rows, np.zeros(rows.num_rows, np.int64))

    return run


def spanning(size: np.ndarray, place: np.ndarray, part: np.ndarray, roots: np.ndarray, bits: list[bytes], similarity: float) -> list[tuple[int, int]]:
    """Links (places) that join the rows of a shard which their bitmaps allow to be near copies into as few parts as possible,
    the likeliest first: a tree grows by the row that may be most alike to some row in it; rows of equal `roots` are one."""
    count, widths = len(size), np.array([len(b) for b in bits], np.int64)
    halves = part.min() != part.max()
    folded = {}  # for each width: the rows of this width, and of twice the width folded to it
    for w in np.unique(widths).tolist():
        rows = np.flatnonzero((widths == w) | (widths == 2 * w))
        folded[w] = rows, np.stack([np.bitwise_or.reduce(np.frombuffer(bits[row], np.uint64).reshape(-1, w // 8), axis=0) for row in rows.tolist()])
    best, near = np.full(count, -1.0), np.zeros(count, np.int64)
    waiting, links = np.ones(count, bool), []
    for _ in range(count):
        at = int(np.argmax(np.where(waiting, best, -2.0)))
        if 0 <= best[at] <= 1:
            links.append((int(near[at]), at))
        waiting[at] = False
        share = np.full(count, -1.0)
        for w in (widths[at], widths[at] // 2):
            if w not in folded:
                continue
            rows, marks = folded[w]
            own = marks[np.searchsorted(rows, at)]
            differ = np.bitwise_count(marks ^ own).sum(axis=1, dtype=np.int64)
            both = size[rows] + size[at]
            shared = (both - differ) // 2
            here = widths[rows] >= widths[at] if w == widths[at] else widths[rows] == w
            share[rows[here]] = (shared / (both - shared))[here]
        reach = may_reach(size, place, size[at], place[at], similarity, np.minimum)
        share[~reach | (share < similarity - SLACK) | (halves & (part == part[at]))] = -1.0
        share[roots == roots[at]] = 2.0  # joined already
        closer = share > best
        best[closer], near[closer] = share[closer], at
    return links


def verified_links(part: np.ndarray, roots: np.ndarray, shingles: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (places) that join all rows of a shard that have a chain of near copies in it; rows of equal `roots` are joined
    already, and of a shard of two parts rows of the same part are not compared."""
    sizes = np.array([len(s) for s in shingles], np.int64)
    names, codes = np.unique(np.concatenate(shingles), return_inverse=True)
    own = np.split(codes, np.cumsum(sizes)[:-1])
    _, groups = np.unique(roots, return_inverse=True)
    held, links, halves = np.zeros(len(names), bool), [], part.min() != part.max()
    order, behind = rows_behind(np.zeros(len(sizes), np.int64), groups)
    for place in np.flatnonzero(behind).tolist():
        at, rest = order[place], order[place + 1 :]
        rest = rest[(groups[rest] != groups[at]) & (np.minimum(sizes[rest], sizes[at]) >= similarity * np.maximum(sizes[rest], sizes[at]) - SLACK)]
        rest = rest[part[rest] != part[at]] if halves else rest
        if not len(rest):
            continue
        held[own[at]] = True
        starts = np.concatenate([[0], np.cumsum(sizes[rest])[:-1]])
        shared = np.add.reduceat(held[np.concatenate([own[k] for k in rest])], starts, dtype=np.int64)
        held[own[at]] = False
        for other in rest[shared >= similarity * (sizes[at] + sizes[rest] - shared) - SLACK].tolist():
            if groups[other] != groups[at]:
                links.append((at, other))
                groups[groups == groups[other]] = groups[at]
    return links


def offers(similarity: float):
    """Task function: rows (..SHARD) with their bitmaps, sorted by shard -> (key, left, right, a, b), the links of `spanning`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in shard_tables(batches, NAME):
            rid, part, root, size, place = (table.column(c).to_numpy() for c in ("rid", "part", "root", "size", "place"))
            links = spanning(size, place, part, root, table.column("bits").to_pylist(), similarity)
            ends = np.sort(rid[np.array(links, np.int64).reshape(-1, 2)], axis=1)
            name = [table.column(c).slice(0, 1).take(pa.array(np.zeros(len(ends), np.int64))) for c in NAME]
            yield from pa.table([*name, pa.array(ends[:, 0]), pa.array(ends[:, 1])], [*NAME, "a", "b"]).to_batches()

    return run


def judged(similarity: float):
    """Task function: rows (..SHARD) with their shingles, sorted by shard -> the links (a, b) of `verified_links`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in shard_tables(batches, NAME):
            rid, part, root = (table.column(c).to_numpy() for c in ("rid", "part", "root"))
            sets = [s.values.to_numpy() for s in table.column("shingles")]
            ends = rid[np.array(verified_links(part, root, sets, similarity), np.int64).reshape(-1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    return run


def shingle_sets(rows: DataFrame, size: int) -> DataFrame:
    """(rid, shingles, bits): the different word shingles of each text, and a fine bitmap of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for batch in batches:
            sets = [s for _, texts in text_rows(batch, "text", RUN) for s in shingles.of(texts)]
            columns = [batch.column("rid"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([bitmap(s, FINE) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "shingles", "bits"])

    return rows.select("rid", "text").mapInArrow(run, "rid bigint, shingles array<bigint>, bits binary")


def alike(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links whose whole texts have a Jaccard similarity of word shingles of at least `similarity`."""
    first = sets.select(F.col("rid").alias("a"), F.col("shingles").alias("x"))
    second = sets.select(F.col("rid").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return links.join(first, "a").join(second, "b").where(shared >= similarity * (F.size("x") + F.size("y") - shared) - SLACK).select("a", "b")


def drop_near_copies(docs: DataFrame, **settings) -> DataFrame:
    """The rows of `docs`, all columns, one of each group of near copies: the smallest doc_id. Settings of `near_copies`."""
    return drop_rows(docs, lambda rows: near_copies(rows, **settings))


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, most: int = SHARD_ROWS, radius: int = RADIUS) -> DataFrame:
    """(file, row) of the near copies of a document with a smaller doc_id.

    Every pair whose `words`-word shingles have a Jaccard similarity of at least `similarity` is found. In one order of all
    shingles, the frequent ones last, two such texts share a shingle of their prefixes (see `prefix`), so they meet in its shard;
    rows whose fingerprints op7's BK-trees link meet as well. The rows of a shard are first compared with its first row, on
    the sets of shingles of both whole texts, each pair once; bitmaps of all shingles rule out most pairs before. Where that leaves rows of a shard apart that the places of the
    shingle and the bitmaps allow to be near copies, links that join these rows, the likeliest first, are verified; where
    one of them fails, the shard's rows meet with their sets and a task compares all pairs that are still apart. A shard of
    over `most` rows is cut into parts, and every two parts are compared in a task of their own.

    Texts without words stay; a null doc_id is smaller than any other; of rows with the same doc_id the first read stays;
    repeated rows are near copies of each other; an empty table gives no rows.
    """
    placed = located(docs.select("doc_id", "text"))
    place = [F.xxhash64("file").alias("file"), "row"]
    texts = placed.select("text", F.col(LOC)["file"].alias("file"), F.col(LOC)["row"].alias("row")).select("text", *place)
    prints = prefixed(placed.drop(LOC), words, similarity)

    def sets_of(rids: DataFrame) -> DataFrame:
        ends = written(prints.select("rid", *place).join(rids.distinct(), "rid"), "ends")
        return written(shingle_sets(texts.join(F.broadcast(ends) if ends.count() <= BROADCAST_ROWS else ends, ["file", "row"]), words), "shingles")

    shared = shards(prints, most, radius)
    reach = may_reach(F.col("size"), F.col("place"), F.col("first.size"), F.col("first.place"), similarity, F.least)
    met = shared.where((F.col("rid") != F.col("first.rid")) & reach)
    offered = written(met.select(F.col("first.rid").alias("a"), F.col("rid").alias("b")).distinct(), "offered")
    ends = offered.join(prints.select(F.col("rid").alias("a"), "size", "bits"), "a")
    ends = ends.join(prints.select(F.col("rid").alias("b"), F.col("size").alias("other_size"), F.col("bits").alias("other_bits")), "b")
    offered = written(ends.mapInArrow(open_links(similarity), "a bigint, b bigint"), "open")
    good = written(alike(offered, sets_of(offered.select(F.explode(F.array("a", "b")).alias("rid"))), similarity), "passed")

    groups = components(good, "a", "b")
    rest = shared.where("rows > 2 and place >= 0").join(groups.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    members = F.sum(F.xxhash64("rid").cast("decimal(38,0)")).alias("members")
    apart = rest.groupBy("key", "rows", "parts").agg(F.min("root").alias("low"), F.max("root").alias("high"), members, F.max("place").alias("last")).where("low < high")
    # Of the shards of the same rows the first in the order stays: a pair is judged where its first shared shingle stands.
    apart = apart.groupBy("members", "rows", "parts").agg(F.min_by("key", "last").alias("key")).select("key")
    own = rest.join(apart, "key").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    sides = [F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right")]
    dealt = own.select("*", every).select("key", *sides, "part", "rid", "root", "size", F.col("place").cast("bigint").alias("place"))
    name = ["key", "left", "right"]
    dealt = written(dealt.repartition(*name).sortWithinPartitions(*name).mapInArrow(hopeful(similarity), SHARD), "near")
    dealt = dealt.join(prints.select("rid", "bits"), "rid").repartition(*name).sortWithinPartitions(*name)
    hoped = written(dealt.mapInArrow(hopeful(similarity), SHARD), "hoped")
    if not hoped.isEmpty():
        members = F.sum(F.xxhash64("rid", "part", F.col("left") == F.col("right")).cast("decimal(38,0)")).alias("members")
        once = hoped.groupBy(*name).agg(members, F.count("*").alias("rows")).groupBy("members", "rows").agg(F.min(F.struct(*name)).alias("one"))
        hoped = written(hoped.join(once.select("one.*"), name, "left_semi"), "once")
        sets = sets_of(hoped.select("rid"))
        met = hoped.join(sets.select("rid", "bits"), "rid").repartition(*name).sortWithinPartitions(*name)
        offered = written(met.mapInArrow(offers(similarity), "key bigint, left int, right int, a bigint, b bigint"), "offered")
        further = written(alike(offered.select("a", "b").distinct(), sets, similarity), "further")
        good = good.unionByName(further)
        failed = written(offered.join(further, ["a", "b"], "left_anti").select(*name).distinct(), "failed")
        if not further.isEmpty():
            groups = components(good, "a", "b")
        if not failed.isEmpty():
            met = hoped.drop("root").join(failed, name, "left_semi").join(groups.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
            met = met.join(sets.select("rid", "shingles"), "rid").repartition(*name).sortWithinPartitions(*name)
            last = written(met.mapInArrow(judged(similarity), "a bigint, b bigint"), "last")
            if not last.isEmpty():
                groups = components(good.unionByName(last), "a", "b")
    groups = groups.join(prints.select(F.col("rid").alias("node"), "doc_id", "file", "row"), "node")
    stays = groups.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("stay"))
    return groups.join(stays, "root").where(F.col("stay.node") != F.col("node")).select("file", "row")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Best-fit packing: sum-of-squares packing of tokenised documents into sequences.

A sequence is a bin of `capacity` tokens. An item goes to the open bin, or the new bin, after which the sum over all residual
gaps of the squared count of open bins with that gap is smallest; the smaller resulting gap wins a tie. Items come longest
first. Pieces are dealt into groups of about `group_rows` by an even hash, so the groups grow in number and not in size; each
group is packed in one task from its lengths alone. What a group leaves in bins that are not full enough goes, piece by
piece, into a second round over fewer groups, so that the unfilled rests of many groups meet.

Defined cases: a null or empty text is its end token alone; a piece of the full capacity is a sequence of its own; repeated
rows are packed once each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memjoin.llm.common import documents, text_rows, written

CAPACITY = 4096
END_ID = 1  # fixed by the contract
GROUP_ROWS = 32_768
CACHE_WORDS = 500_000
CHUNK = 1 << 20  # bytes of text whose words are looked up together
MARK, MARKS = "\x7f", ".,;:!?|*&#$%"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Token ids of whole texts, little-endian unsigned 32-bit, with a bounded cache of words.

    The vocabulary splits at white space, then into runs of letters and runs of marks, so a word has the same ids in every
    text. That holds for texts of plain Latin characters, which lower-casing and composition treat one by one; all others
    go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.letters.normalizer = None  # for lower-case letters there is nothing to normalise or to split
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.unlike = re.compile("[^\t\n\r\x20-\x7e\u00a1-\u00ac\u00ae-\u012f\u0132-\u0148\u014a-\u017e]").search
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, tokenizer, parts: list[str]) -> None:
        """Ids of new parts, encoded in one text, with a mark between them that no part holds."""
        for at in range(0, len(parts), 2000):
            some = parts[at : at + 2000]
            encoded = tokenizer.encode_batch_fast([f" {MARK} ".join(some) + f" {MARK}"], add_special_tokens=False)[0]
            ids = np.array(encoded.ids, dtype="<u4")
            octets, start = ids.tobytes(), 0
            for part, stop in zip(some, np.flatnonzero(ids == self.mark).tolist(), strict=True):
                self.parts[part] = octets[4 * start : 4 * stop]
                start = stop + 1

    def learn(self, words: list[str]) -> None:
        """Put `words` into the cache: a run of letters with marks after it is two parts, any other word is one."""
        if len(self.parts) + 2 * len(words) > 2 * CACHE_WORDS:
            self.parts.clear()
        cores, tails = [], []
        for word, low in zip(words, " ".join(words).lower().split(" ")):
            core = low.rstrip(MARKS)
            plain = core.isalpha()
            cores.append(core if plain else "")
            tails.append(low[len(core) :] if plain else word)
        for tokenizer, parts in ((self.letters, cores), (self.tokenizer, tails)):
            self.encode(tokenizer, [part for part in set(parts).difference(self.parts) if part])
        known = self.parts
        known[""] = b""
        self.words.update(zip(words, [known[core] + known[tail] if tail else known[core] for core, tail in zip(cores, tails)]))

    def of(self, text: str) -> bytes:
        return next(self.each([text]))

    def each(self, texts: list[str]) -> Iterator[bytes]:
        """Token ids of each text. Its words are numbered by Arrow, and each different one is looked up once for all texts."""
        plain = [not self.unlike(text) and "<|" not in text for text in texts]
        split = pc.ascii_split_whitespace(pa.array([text if own else "" for text, own in zip(texts, plain)], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [word for word in words if word not in self.words]
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words.clear()
            new = words
        if len(new) > CACHE_WORDS:
            yield from map(self.whole, texts)
            return
        if new:
            self.learn(new)
        known = [self.words[word] for word in words]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        codes = coded.indices.to_numpy()
        counts = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(counts)])
        shift = (np.cumsum(sizes) - sizes)[codes] - ends[:-1]
        ids = np.frombuffer(b"".join(known), "<u4")[np.repeat(shift, counts) + np.arange(ends[-1])]
        bounds = ends[split.offsets.to_numpy()].tolist()
        for text, own, low, high in zip(texts, plain, bounds, bounds[1:]):
            yield ids[low:high].tobytes() if own else self.whole(text)


def worker_ids(path: str) -> WordIds:
    """The worker process keeps one per vocabulary; task code arrives anew with each task."""
    kept = sys.modules.setdefault("memjoin_worker_state", types.ModuleType("memjoin_worker_state")).__dict__
    if path not in kept:
        kept[path] = WordIds(path)
    return kept[path]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, row) of every piece; `row` numbers the pieces of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, made = worker_ids(vocabulary), 0
        for batch in batches:
            rows = []
            for first, texts in text_rows(batch, "text", CHUNK):
                for at, ids in enumerate(ids_of.each([text.decode("utf-8") for text in texts]), first):
                    ids += END_ID.to_bytes(4, "little")
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        rows.append((at, piece, start // 4, len(part) // 4, zlib.crc32(part)))
            if not rows:
                continue
            at, piece, start, length, crc = (np.array(column, dtype=np.int64) for column in zip(*rows))
            number = np.arange(made, made + len(rows))
            made += len(rows)
            columns = [batch.column("doc_id").take(pa.array(at)), pa.array(piece.astype(np.int32)), *map(pa.array, (start, length, crc, number))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, row bigint")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset of each item, and the gap that each bin keeps; the items come longest first."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins by gap
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, gaps = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    for item in np.argsort(-lengths, kind="stable"):
        size = int(lengths[item])
        rest = capacity - size
        # The change of the sum: a new bin, an exact fit, and the open bins from the smallest resulting gap.
        gap, best = capacity, (2 * int(count[rest]) + 1 if rest else 0)
        if size < capacity and open_bins[size] and 1 - 2 * int(count[size]) <= best:
            gap, best = size, 1 - 2 * int(count[size])
        after, before = count[1 : capacity - size], count[size + 1 : capacity]
        where = np.flatnonzero(before)
        if len(where):
            change = 2 * (after[where] - before[where] + 1)
            pick = int(change.argmin())
            if int(change[pick]) < best or (int(change[pick]) == best and gap == capacity):
                gap = int(where[pick]) + size + 1
        if gap == capacity:
            number = len(gaps)
            gaps.append(rest)
        else:
            number = open_bins[gap].pop()
            count[gap] -= 1
            gaps[number] = gap - size
        bins[item], offsets[item] = number, capacity - gap
        if gaps[number]:
            open_bins[gaps[number]].append(number)
            count[gaps[number]] += 1
    return bins, offsets, np.array(gaps, dtype=np.int64)


PACKED = "doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, gap bigint"


def packed(dealt: DataFrame, kind: str, capacity: int) -> DataFrame:
    """Pack each `group` of the pieces; sequence ids hold the group and the bin."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        bins, offsets, gaps = sum_of_squares(frame["length"].to_numpy(), capacity)
        out = frame[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
        out["sequence_id"] = frame["group"].to_numpy(dtype=np.int64) * (1 << 24) + bins
        out["offset"], out["gap"] = offsets, gaps[bins]
        return out

    return dealt.groupBy("group").applyInPandas(pack, PACKED.format(kind=kind))


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, full_enough: float = 0.995) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, gap) of every piece of `docs`."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = written(pieces(docs, vocabulary or default_vocabulary(), capacity), "pieces")
    groups = max(1, -(-cut.count() // group_rows))
    spread = F.pmod(F.xxhash64("row", "ids_crc32", "doc_id"), F.lit(groups))
    first = written(packed(cut.withColumn("group", spread), kind, capacity), "packed")
    if groups == 1:
        return first
    loose = F.col("gap") > capacity * (1 - full_enough)
    rest = first.where(loose).drop("gap", "offset")
    again = max(1, -(-rest.count() // group_rows))
    spread = F.pmod(F.xxhash64("sequence_id", "ids_crc32"), F.lit(again)) + groups
    second = packed(rest.withColumn("group", spread), kind, capacity)
    return first.where(~loose).unionByName(second)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir)).drop("gap")

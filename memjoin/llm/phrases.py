"""Substring dedup with repeated-phrase automata: words of passages of 50 words that an earlier document also has.

1. Minimizer phrases of 25 words are counted over all documents; those of two documents recur.
2. Documents with recurring phrases are dealt out evenly; each shard compiles the recurring phrases of its documents into an
   Aho-Corasick automaton (pyahocorasick) and streams the documents through it to locate every occurrence.
3. Each window of 50 words around an occurrence is confirmed exactly: the smallest document of every window is found by one
   grouped minimum, and windows with a smaller document go back to theirs.

Texts that are equal word for word are settled before that, by the smallest document of each: of such a group only the
first goes through the automata. Shards hold documents, not groups, so a passage that much of the table shares is spread.

Defined cases: null and empty texts have no words; a document with fewer words than a window loses nothing; repeated rows
with one doc_id are the same document, which is not smaller than itself; rows with a null doc_id lose nothing and take
nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memjoin.llm.common import BYTE_BASE, LOC, OCTET, WORD_BASE, Rolling, documents, located, octets, text_rows, word_bounds, written
from memjoin.llm.seeds import chosen, survey, with_recurring

WINDOW, GRAM = 50, 25


def plain(text: bytes) -> tuple[bytes, int]:
    """Words joined by one space, and their number."""
    words = text.split()
    return b" ".join(words), len(words)


class Phrases:
    """Hashes of words, of phrases and of windows, for several texts of single-spaced words."""

    def __init__(self, gram: int, window: int):
        self.letters, self.chain, self.gram, self.window = Rolling(BYTE_BASE), Rolling(WORD_BASE), gram, window

    def read(self, rows: list[bytes]):
        self.data, self.offsets = octets(rows)
        self.starts, self.ends = word_bounds(self.data)
        self.words = self.letters.slices(self.letters.prefix(OCTET[self.data]), self.starts, self.ends)
        self.owner = np.searchsorted(self.offsets, self.starts, side="right") - 1
        self.prefix = self.chain.prefix(self.words)
        at = np.arange(max(0, len(self.words) - self.gram + 1))
        self.hashes = self.chain.slices(self.prefix, at, at + self.gram)
        self.picked = chosen(self.hashes, self.owner, self.gram, self.window)

    def seeds(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        self.read(rows)
        return self.hashes[self.picked], self.owner[self.picked]

    def located(self, rows: list[bytes], recurring: np.ndarray) -> np.ndarray:
        """Word places where a recurring phrase starts, found by the automaton of this shard."""
        from ahocorasick import STORE_LENGTH, Automaton

        self.read(rows)
        known = self.picked[np.isin(self.hashes[self.picked], recurring)]
        _, first = np.unique(self.hashes[known], return_index=True)
        phrases = known[first]
        if not len(phrases):
            return phrases
        # One character a byte: places in the string are places in the data. Words end at a space or at a row's line feed.
        text = self.data.tobytes().decode("latin-1").replace("\n", " ")
        automaton = Automaton(STORE_LENGTH)
        for a, b in zip(self.starts[phrases].tolist(), self.ends[phrases + self.gram - 1].tolist()):
            automaton.add_word(" " + text[a:b] + " ")
        automaton.make_automaton()
        stops = np.fromiter((end for end, _ in automaton.iter(" " + text)), np.int64)
        return np.searchsorted(self.ends, stops - 1) - self.gram + 1

    def windows(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of every window that holds a located phrase and stays in its row."""
        count = len(self.words) - self.window + 1
        if count <= 0 or not len(places):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        turn = np.zeros(len(self.words) + 2, dtype=np.int64)
        np.add.at(turn, np.maximum(places + self.gram - self.window, 0), 1)
        np.add.at(turn, places + 1, -1)
        inside = np.flatnonzero(np.cumsum(turn)[:count] > 0)
        inside = inside[self.owner[inside] == self.owner[inside + self.window - 1]]
        return inside, self.chain.slices(self.prefix, inside, inside + self.window)


def candidate_windows(found: DataFrame, gram: int, window: int) -> DataFrame:
    """(rid, doc_id, words, starts, hashes) of each document with candidate windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Phrases(gram, window)
        for batch in batches:
            lists = batch.column("found")
            keep, words, starts, hashes = [], [], [], []
            for base, rows in text_rows(batch, "text"):
                ready = [plain(row)[0] for row in rows]
                recurring = lists.slice(base, len(rows)).flatten().field("seed").to_numpy(zero_copy_only=False).view(np.uint64)
                at, hashed = tool.windows(tool.located(ready, np.unique(recurring)))
                first = np.searchsorted(tool.owner, np.arange(len(rows) + 1))
                cuts = np.searchsorted(at, first)
                for i in range(len(rows)):
                    if cuts[i + 1] > cuts[i]:
                        keep.append(base + i)
                        words.append(ready[i])
                        starts.append((at[cuts[i] : cuts[i + 1]] - first[i]).astype(np.int32))
                        hashes.append(hashed[cuts[i] : cuts[i + 1]].view(np.int64))
            if keep:
                at = pa.array(keep)
                columns = [batch.column("rid").take(at), batch.column("doc_id").take(at), pa.array(words, pa.binary()), pa.array(starts, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "words", "starts", "hashes"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"rid bigint, doc_id {kind}, words binary, starts array<int>, hashes array<bigint>")


def without(marked: DataFrame, window: int) -> DataFrame:
    """(rid, n_removed, kept_sha256) from the words of each document and the starts of its repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas = [], []
            for words, at in zip(batch.column("words"), batch.column("at")):
                words = words.as_py().split(b" ")
                places = np.asarray(at.values.to_numpy(zero_copy_only=False), dtype=np.int64)
                turn = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(turn, places, 1)
                np.add.at(turn, places + window, -1)
                covered = np.cumsum(turn)[: len(words)] > 0
                removed.append(int(covered.sum()))
                shas.append(hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(~covered).tolist()])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], ["rid", "n_removed", "kept_sha256"])

    return marked.select("rid", "words", "at").mapInArrow(run, "rid bigint, n_removed bigint, kept_sha256 string")


def repeated_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of `docs`."""
    docs = located(docs.select("doc_id", "text")).drop(LOC)  # rows that are read twice keep their places
    surveyed = survey(docs, plain, lambda: Phrases(gram, window).seeds, window)
    leaders = surveyed.groupBy("sha").agg(F.min("doc_id").alias("leader"))
    leaders = written(leaders, "leaders")  # a table of its own, so that the partition of a frequent text can be split in the join
    all_rows = written(surveyed.drop("seeds").join(leaders, "sha"), "led")
    copy = F.col("doc_id") > F.col("leader")
    # Only the first of word-for-word equal documents goes on; rows that repeat it are equal rows.
    going = all_rows.where("n >= " + str(window)).where("doc_id = leader").groupBy("sha", "doc_id").agg(F.min("rid").alias("rid"))
    going = surveyed.join(going.select("rid"), "rid", "left_semi")
    pairs = going.select("doc_id", F.explode("seeds").alias("seed"))
    recurring = pairs.groupBy("seed").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("seed")
    recurring = written(recurring, "recurring")  # likewise for a frequent phrase
    candidates = written(candidate_windows(with_recurring(docs, going, recurring), gram, window), "windows")
    rows = candidates.select("rid", "doc_id", F.arrays_zip("starts", "hashes").alias("w")).select("rid", "doc_id", F.inline("w"))
    first = rows.groupBy("hashes").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("hashes", "low")
    first = written(first, "first")  # a table of its own, so that a hot window's partition can be split in the join
    repeated = rows.join(first, "hashes").where("low < doc_id").groupBy("rid").agg(F.collect_list("starts").alias("at"))
    removed = without(candidates.select("rid", "words").join(repeated, "rid"), window)
    # The result of a text belongs to every row that has it as its first document.
    removed = written(removed, "removed").join(all_rows.select("rid", "sha", F.col("doc_id").alias("leader")), "rid").drop("rid")
    joined = all_rows.join(removed, ["sha", "leader"], "left")
    gone = copy & (F.col("n") >= window)
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return joined.select(
        "doc_id",
        F.col("n").alias("n_words"),
        F.when(gone, F.col("n")).when(copy | F.col("doc_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, nothing).when(copy | F.col("doc_id").isNull(), F.col("sha")).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def op5_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))

"""License scans: exact set-similarity join of text blocks with license templates.

A block is 64 consecutive words of a document, one every 32 words; a template is the set of words of a notice. The join finds
every (block, template) whose containment, shared words over template words, reaches the threshold. Words are put in one
order, rarest first, by their counts over all documents. A template's prefix is its first n - need + 1 words in that order;
a block that shares no word of it cannot reach `need` shared words and is never made. A block must then hold `need` words of
the vocabulary (length filter), and enough of them after the first match (positional filter); what is left is verified by
intersecting the sets. The vocabulary is that of the fixed templates, so its counts and postings are bounded by them.

Beside the join, exact phrases are found as runs of words (`BASE`).

Defined cases: null and empty texts have no words, no places and score 0; repeated rows give equal rows; documents are told
apart by their place, so equal or null ids do not merge; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memjoin.llm.common import BYTE_BASE, LOC, OCTET, Rolling, documents, located, octets, text_rows, word_bounds, written

# Fixed values of the contract: phrase -> label.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Notices in general use, as words, with their labels.
TEMPLATES = (
    ("gpl", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("apache", "licensed under the apache license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-sa", "licensed under cc by sa"),
)
THRESHOLD = 0.85
BLOCK, STRIDE = 64, 32

SEPARATORS = np.ones(256, dtype=bool)
SEPARATORS[0x30:0x3A] = False
SEPARATORS[0x61:0x7B] = False
SEPARATORS[0x80:] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32


class Vocabulary:
    """Numbers the words of a fixed list; every other word is -1."""

    def __init__(self, words: Sequence[str]):
        self.rolling = Rolling(BYTE_BASE)
        data, _ = octets([w.encode() for w in words])
        hashed = self.hashes(data)
        self.order = np.argsort(hashed)
        self.sorted = hashed[self.order]

    def hashes(self, data: np.ndarray) -> np.ndarray:
        starts, ends = word_bounds(data, SEPARATORS)
        return self.rolling.slices(self.rolling.prefix(OCTET[data]), starts, ends)

    def numbers(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of each word of the rows, its row, and its place in the row."""
        data, offsets = octets(rows)
        data = FOLD[data]
        starts, ends = word_bounds(data, SEPARATORS)
        hashed = self.rolling.slices(self.rolling.prefix(OCTET[data]), starts, ends)
        at = np.minimum(np.searchsorted(self.sorted, hashed), len(self.sorted) - 1)
        number = np.where(self.sorted[at] == hashed, self.order[at], -1)
        row = np.searchsorted(offsets, starts, side="right") - 1
        first = np.searchsorted(row, np.arange(len(rows)))
        return number, row, np.arange(len(row)) - first[row]


def template_words(templates) -> list[str]:
    return sorted({w for _, text in templates for w in text.split()} | {w for phrase in BASE for w in phrase.split()})


def word_counts(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """How often each vocabulary word occurs in all documents: one partial row a batch, summed by Spark; a word a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Vocabulary(words), np.zeros(len(words), dtype=np.int64)
        for batch in batches:
            for _, rows in text_rows(batch, "text"):
                number, _, _ = known.numbers(rows)
                total += np.bincount(number[number >= 0], minlength=len(words))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["word", "n"])

    counted = docs.select("text").mapInArrow(run, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    found = {words[r["word"]]: r["n"] for r in counted.collect()}  # at most one row for each template word
    return {w: found.get(w, 0) for w in words}


def blocks_of(number, row, place, rank, rare, count: int) -> list[list[list[int]]]:
    """For each of `count` rows, the ranks of the vocabulary words in each block that holds a rare one."""
    blocks: list[list[list[int]]] = [[] for _ in range(count)]
    inside = np.flatnonzero(number >= 0)
    block = np.concatenate([place[inside] // STRIDE, place[inside] // STRIDE - 1])  # a word is in two blocks
    code, held = np.tile(row[inside], 2) * (1 << 40) + block, np.tile(number[inside], 2)
    keep = (block >= 0) & np.isin(code, code[rare[held]])
    code, ranks = code[keep], rank[held[keep]]
    if not len(code):
        return blocks
    order = np.lexsort((ranks, code))
    code, ranks = code[order], ranks[order]
    fresh = np.concatenate([[True], (code[1:] != code[:-1]) | (ranks[1:] != ranks[:-1])])
    code, ranks = code[fresh], ranks[fresh]
    cuts = np.flatnonzero(code[1:] != code[:-1]) + 1
    for part, key in zip(np.split(ranks, cuts), code[np.concatenate([[0], cuts])]):
        blocks[int(key >> 40)].append(part.tolist())
    return blocks


SCANNED = "doc_id {kind}, file string, row bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, blocks array<array<int>>"


def scan(docs: DataFrame, words: list[str], rank: np.ndarray, prefix: set[int]) -> DataFrame:
    """One row per document: exact phrases, and each block that holds a prefix word as its vocabulary ranks, rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rare = Vocabulary(words), np.isin(np.arange(len(words)), sorted(prefix))
        names = {w: i for i, w in enumerate(words)}
        phrases = [([names[w] for w in phrase.split()], label) for phrase, label in BASE.items()]
        for batch in batches:
            out = {name: [] for name in ("n_words", "n_base", "first_word", "last_word", "base_labels", "blocks")}
            for _, rows in text_rows(batch, "text"):
                number, row, place = known.numbers(rows)
                count = len(rows)
                hits = []
                for phrase, label in phrases:
                    size = len(phrase)
                    if len(number) < size:
                        continue
                    match = row[: len(row) - size + 1] == row[size - 1 :]
                    for step, wanted in enumerate(phrase):
                        match &= number[step : len(number) - size + 1 + step] == wanted
                    hits += [(int(row[i]), int(place[i]), label) for i in np.flatnonzero(match)]
                bases: list[list[tuple[int, str]]] = [[] for _ in range(count)]
                for at, where, label in hits:
                    bases[at].append((where, label))
                blocks = blocks_of(number, row, place, rank, rare, count)
                out["n_words"] += np.bincount(row, minlength=count).tolist()
                out["n_base"] += [len(b) for b in bases]
                out["first_word"] += [min(b)[0] if b else None for b in bases]
                out["last_word"] += [max(b)[0] if b else None for b in bases]
                out["base_labels"] += [sorted({label for _, label in b}) for b in bases]
                out["blocks"] += blocks
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string()), pa.list_(pa.list_(pa.int32()))]
            columns = [batch.column(n) for n in ("doc_id", "file", "row")] + [pa.array(v, kind) for v, kind in zip(out.values(), kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "file", "row", *out])

    placed = located(docs.select("doc_id", "text"))
    rows = placed.select("doc_id", F.col(LOC)["file"].alias("file"), F.col(LOC)["row"].alias("row"), "text")
    return rows.mapInArrow(run, SCANNED.format(kind=placed.schema["doc_id"].dataType.simpleString()))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row; labels as arrays.

    `score` is the largest containment of a template in a block of the document, 1 where an exact phrase stands, else 0.
    """
    spark = docs.sparkSession
    words = template_words(templates)
    seen = word_counts(docs, words)
    order = sorted(words, key=lambda w: (seen[w], w))
    place = {w: i for i, w in enumerate(order)}
    rank = np.array([place[w] for w in words])
    sets = [sorted({place[w] for w in text.split()}) for _, text in templates]
    needs = [math.ceil(threshold * len(held) - 1e-9) for held in sets]
    postings = [(t, sets[t][i], i, needs[t], sets[t], templates[t][0]) for t in range(len(sets)) for i in range(len(sets[t]) - needs[t] + 1)]
    prefix = {names for t in range(len(sets)) for names in sets[t][: len(sets[t]) - needs[t] + 1]}
    found = written(scan(docs, words, rank, {words.index(order[r]) for r in prefix}), "licenses")
    posted = spark.createDataFrame(postings, "template int, word int, at int, need int, held array<int>, label string")
    blocks = found.select("file", "row", F.posexplode("blocks").alias("block", "words")).where(F.size("words") > 0)
    met = blocks.select("file", "row", "block", "words", F.posexplode("words").alias("pos", "word")).join(F.broadcast(posted), "word")
    # Length filter, then what the block and the template can still share from the first match on.
    met = met.where("size(words) >= need and size(words) - pos >= need and size(held) - at >= need")
    shared = F.size(F.array_intersect("words", "held"))
    met = met.where(shared >= F.col("need")).select("file", "row", "label", (shared / F.size("held")).alias("part"))
    per_row = met.groupBy("file", "row").agg(F.collect_set("label").alias("more"), F.max("part").alias("part"))
    joined = found.drop("blocks").join(per_row, ["file", "row"], "left")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("part", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(documents(spark, sf_dir))
    return found.withColumns({name: F.array_join(name, ",") for name in ("base_labels", "labels")})

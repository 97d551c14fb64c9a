"""Quality classifier: interpolated modified Kneser-Ney n-gram model of trusted text, perplexity thresholds per language.

Symbols are the bytes of the UTF-8 text, so an n-gram of up to seven symbols is one exact BIGINT and no hash can collide.
Tasks count the n-grams of the trusted documents; Spark sums them by key. Continuation counts of each lower order are the
grouped counts of the different n-grams above it, contexts get their totals and their numbers of followers seen once, twice
and more, and the three discounts of an order come from its counts of counts. N-grams and contexts are then joined into
interpolation terms.

The terms go to the scoring tasks in shards of at most `shard_terms` terms, split by the last two bytes of the context, with
one pass over all documents for each shard: every symbol has all its higher orders in one shard, so the passes add up. What
has to travel is bounded by the parameter, whatever the size of the corpus.

A document is kept when its perplexity is at most the language's quantile of trusted documents that were held out of the
counts, times `slack`. A language with fewer than `least` held-out documents uses the quantile of all languages.

Defined cases: null and empty texts have no perplexity and are kept; without trusted documents every document is kept; a
null language is a language of its own; repeated rows get equal scores; an empty table gives no rows; other columns are not
read, or kept untouched by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memjoin.llm.common import LOC, documents, drop_rows, located, text_rows, written

ORDER = 5
HELD_OUT = 5  # every fifth trusted document by its hash
QUANTILE, SLACK, LEAST = 0.99, 1.1, 20
SHARD_TERMS = 3_000_000
RUN = 1 << 18  # bytes of text that are taken apart together
SLOTS = 20  # bits of the score cache of a task
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def keys_of(rows: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of each row, as an integer, and the row; a row starts after line feeds."""
    pad = b"\n" * (order - 1)
    data = np.frombuffer(b"".join(pad + row for row in rows), dtype=np.uint8).astype(np.uint64)
    sizes = np.array([len(row) for row in rows], dtype=np.int64)
    at = np.arange(int(sizes.sum())) + np.repeat((np.arange(len(rows)) + 1) * (order - 1), sizes)
    out = np.zeros(len(at), dtype=np.uint64)
    for back in range(order):
        out |= data[at - back] << np.uint64(8 * back)
    return out, np.repeat(np.arange(len(rows)), sizes)


def ngram_counts(docs: DataFrame, order: int) -> DataFrame:
    """(key, c): counts of the n-grams of `docs`; each task sends an n-gram once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for _, rows in text_rows(batch, "text", RUN):
                key, n = np.unique(keys_of(rows, order)[0], return_counts=True)
                both = np.concatenate([known, key])
                known, back = np.unique(both, return_inverse=True)
                total = np.bincount(back, weights=np.concatenate([total, n]), minlength=len(known)).astype(np.int64)
                if len(known) > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(total)], ["key", "c"])
                    known, total = known[:0], total[:0]
        yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(total)], ["key", "c"])

    return docs.select("text").mapInArrow(run, "key bigint, c bigint").groupBy("key").agg(F.sum("c").alias("c"))


def model_terms(counts: DataFrame, order: int) -> DataFrame:
    """(n, kind, key, value): for each order n the terms of n-grams (kind 0) and the weights of contexts (kind 1)."""
    levels = {order: counts.select("key", "c")}
    for n in range(order - 1, 0, -1):
        suffix = F.col("key").bitwiseAND(F.lit((1 << (8 * n)) - 1).cast("bigint"))
        levels[n] = written(levels[n + 1].groupBy(suffix.alias("key")).agg(F.count("*").alias("c")), f"order-{n}")
    table = None
    for n, level in levels.items():
        level = level.select(F.lit(n).alias("n"), "key", F.shiftright("key", 8).alias("context"), "c")
        table = level if table is None else table.unionByName(level)
    seen = [F.sum((F.col("c") == k).cast("bigint")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    off = F.lit(0.0)
    for row in table.groupBy("n").agg(*seen).collect():  # one row for each order
        one, two, more = discounts(*(row[f"n{k}"] for k in (1, 2, 3, 4)))
        here = F.when(F.col("c") == 1, one).when(F.col("c") == 2, two).otherwise(more)
        off = F.when(F.col("n") == row["n"], here).otherwise(off)
    table = table.withColumn("off", off)
    contexts = table.groupBy("n", "context").agg(F.sum("c").alias("total"), F.sum("off").alias("rest"))
    terms = table.join(contexts, ["n", "context"]).select("n", F.lit(0).alias("kind"), "key", ((F.col("c") - F.col("off")) / F.col("total")).alias("value"))
    return terms.unionByName(contexts.select("n", F.lit(1).alias("kind"), F.col("context").alias("key"), (F.col("rest") / F.col("total")).alias("value")))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney; where a count of counts is zero, the usual 0.5, 1 and 1.5."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(found))


class Model:
    """One shard of the terms, each order sorted by key."""

    def __init__(self, order: int, terms: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]):
        self.order, self.terms = order, terms

    @classmethod
    def of(cls, order: int, table: pa.Table) -> Model:
        """From rows (n, kind, key, value) in any order."""
        n, kind, key, value = (table.column(c).to_numpy() for c in ("n", "kind", "key", "value"))
        terms = {}
        for level in range(1, order + 1):
            for sort in (0, 1):
                at = np.flatnonzero((n == level) & (kind == sort))
                at = at[np.argsort(key[at], kind="stable")]
                terms[level, sort] = (key[at], value[at])
        return cls(order, terms)

    def look(self, n: int, kind: int, keys: np.ndarray, missing: float) -> np.ndarray:
        known, values = self.terms.get((n, kind), (np.zeros(0, np.int64), np.zeros(0)))
        if not len(known):
            return np.full(len(keys), missing)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, values[at], missing)

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        """Interpolated log probability of the last byte of each n-gram after the others."""
        p = np.full(len(keys), 1 / 256)
        for n in range(1, self.order + 1):
            gram = (keys & np.uint64((1 << (8 * n)) - 1)).astype(np.int64)
            p = self.look(n, 0, gram, 0.0) + self.look(n, 1, gram >> 8, 1.0) * p
        return np.log(p)


class Cache:
    """Scores of n-grams by slot, so that a frequent n-gram is looked up once a task."""

    def __init__(self, model: Model):
        self.model = model
        self.tags, self.values = np.full(1 << SLOTS, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64), np.zeros(1 << SLOTS)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * SPREAD) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        slots = self.slot(keys)
        miss = self.tags[slots] != keys
        if not miss.any():
            return self.values[slots]
        new = np.unique(keys[miss])
        fresh = self.model.log_p(new)
        out = self.values[slots]
        out[miss] = fresh[np.searchsorted(new, keys[miss])]
        at = self.slot(new)
        self.tags[at], self.values[at] = new, fresh
        return out


def shard_of(context: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(context.bitwiseAND(F.lit(0xFFFF).cast("bigint"))), F.lit(shards))


def scored(rows: DataFrame, shared, kind: str) -> DataFrame:
    """(doc_id, lang, file, row, n, log_p) of each document: its symbols in this shard and the sum of their log probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, mine = shared.value
        cache = Cache(model)
        for batch in batches:
            counts, sums = [], []
            for _, texts in text_rows(batch, "text", RUN):
                keys, owner = keys_of(texts, model.order)
                here = mine[((keys >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64)]
                if not here.all():
                    keys, owner = keys[here], owner[here]
                counts.append(np.bincount(owner, minlength=len(texts)))
                sums.append(np.bincount(owner, weights=cache.log_p(keys), minlength=len(texts)))
            if counts:
                columns = [batch.column(c) for c in ("doc_id", "lang", "file", "row")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(counts).astype(np.int64)), pa.array(np.concatenate(sums).astype(np.float64))], ["doc_id", "lang", "file", "row", "n", "log_p"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang string, file string, row bigint, n bigint, log_p double")


def trusted_rows(docs: DataFrame, labels: DataFrame, small: int = 1_000_000) -> DataFrame:
    """Documents labelled good and not toxic; the labels are broadcast only after a count of at most `small`."""
    ids = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").distinct()
    return docs.join(F.broadcast(ids) if ids.count() <= small else ids, "doc_id", "left_semi")


def perplexities(docs: DataFrame, labels: DataFrame, order: int = ORDER, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(doc_id, lang, file, row, n, log_p) of every row of `docs`, written."""
    spark = docs.sparkSession
    trusted = trusted_rows(docs.select("doc_id", "text"), labels)
    counts = written(ngram_counts(trusted.where(~held_out()), order), "ngrams")
    terms = written(model_terms(counts, order), "terms")
    total = terms.count()
    placed = located(docs.select("doc_id", "lang", "text"))
    rows = placed.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col(LOC)["file"].alias("file"), F.col(LOC)["row"].alias("row"), "text")
    kind = placed.schema["doc_id"].dataType.simpleString()
    shards = max(1, -(-total // shard_terms))
    owners = spark.range(1 << 16).select(shard_of(F.col("id"), shards).alias("s")).toPandas()["s"].to_numpy()
    context = F.when(F.col("kind") == 0, F.shiftright("key", 8)).otherwise(F.col("key"))
    out = None
    for shard in range(shards):
        # Orders up to two have at most 2**16 n-grams and are in every shard.
        mine = terms.where((F.col("n") <= 2) | (shard_of(context, shards) == shard)).toArrow()
        found = scored(rows, spark.sparkContext.broadcast((Model.of(order, mine), owners == shard)), kind)
        out = found if out is None else out.unionByName(found)
    if shards > 1:
        out = out.groupBy("doc_id", "lang", "file", "row").agg(F.sum("n").alias("n"), F.sum("log_p").alias("log_p"))
    return written(out, "scores")


def held_out() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0


def classified(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, slack: float = SLACK, least: int = LEAST, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(doc_id, lang, file, row, n_bytes, perplexity, threshold, kept) of every row of `docs`."""
    scores = perplexities(docs, labels, order, shard_terms)
    value = F.when(F.col("n") > 0, F.exp(-F.col("log_p") / F.col("n")))
    scores = scores.select("doc_id", "lang", "file", "row", F.col("n").alias("n_bytes"), value.alias("perplexity"))
    good = trusted_rows(scores, labels).where(held_out()).where("perplexity is not null")
    at = F.percentile_approx("perplexity", quantile, 10_000)
    name = F.concat(F.lit("_"), F.coalesce("lang", F.lit("")), F.col("lang").isNull().cast("string"))
    every = good.agg((at * slack).alias("all_languages"))
    own = good.groupBy(name.alias("name")).agg((at * slack).alias("own"), F.count("*").alias("held")).where(F.col("held") >= least)
    judged = scores.withColumn("name", name).join(own.select("name", "own"), "name", "left").crossJoin(F.broadcast(every))
    limit = F.coalesce("own", "all_languages")
    kept = F.coalesce(F.col("perplexity") <= limit, F.lit(True))
    return judged.select("doc_id", "lang", "file", "row", "n_bytes", "perplexity", limit.alias("threshold"), kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that the classifier keeps."""
    return drop_rows(docs, lambda rows: classified(rows, labels).where("not kept"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("file", "row")

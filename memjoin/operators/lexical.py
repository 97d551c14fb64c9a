"""Token postings, inverse-document-frequency scores, verbatim containment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memjoin.functions.hashing import list_lengths, list_pieces
from memjoin.functions.text import tokens
from memjoin.operators.ranking import first_places, top_k
from memjoin.session import cut_lineage


def token_rows(df: DataFrame, key: str, text: str = "text", token: str = "tok") -> DataFrame:
    """One row per (key, distinct token)."""
    return df.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias(token))


def token_postings(memories: DataFrame, max_postings: int | None = None, vocabulary: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """(tok, id), every memory of every token; with `max_postings` also `pos`, and only the first memories in id order.

    `vocabulary` (tok) keeps only tokens some query asks for; a token's list does not depend on other tokens, so
    this only drops rows nobody reads. The cap is cut per task before the shuffle.
    """
    rows = token_rows(memories, id_col)
    if vocabulary is not None:
        rows = rows.join(vocabulary, "tok", "left_semi")
    if max_postings is None:
        return rows
    order = Window.partitionBy("tok").orderBy(id_col)
    return rows.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= max_postings)


ASKED_ROWS, MATRIX_BYTES = 1 << 20, 128 << 20  # query tokens and bytes of the query matrix that may travel to the memories
SLICE_BYTES = 32 << 20


def idf_token_scores(memories: DataFrame, queries: DataFrame, max_postings: int | None, limit: int, matrix_bytes: int = MATRIX_BYTES) -> DataFrame:
    """(q, id, score, rank): sum of ln(1 + N / df) over shared distinct tokens; df over all postings, or over the capped ones.

    A frequent token stands in most texts and most queries, so joining postings would send nearly every pair. Where the
    queries' tokens fit (they are counted first), they travel to the memories instead: texts are scanned once into codes of
    the asked tokens, and scores are matrix products inside a block, of which only the best `limit` rows of each query leave.
    Beyond that, and for capped lists, postings are joined.
    """
    asked = token_rows(queries, "q")
    if max_postings is None:
        head = asked.limit(ASKED_ROWS + 1).toArrow()
        words = pc.unique(head["tok"]).sort()
        if head.num_rows <= ASKED_ROWS and len(words) * len(pc.unique(head["q"])) * 8 <= matrix_bytes:
            return top_k(_matrix_scores(memories, head, words, limit), "q", limit)
    postings = token_postings(memories, max_postings, asked.select("tok").distinct())
    total = memories.agg(F.count(F.lit(1))).scalar()
    idf = postings.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).select("tok", F.log(1.0 + total / F.col("df")).alias("idf"))
    weighted = asked.join(idf, "tok")
    scores = postings.join(weighted, "tok").groupBy("q", "id").agg(F.sum("idf").alias("score"))
    return top_k(scores, "q", limit)


def token_codes(memories: DataFrame, words: pa.Array) -> DataFrame:
    """(id, codes): the places in `words` of the distinct tokens of every text, written once."""
    shared = memories.sparkSession.sparkContext.broadcast(words)

    def encode(batches):
        for batch in batches:
            start = 0
            for toks in list_pieces(batch.column("toks")):
                codes = pc.index_in(toks.flatten(), value_set=shared.value)
                known = codes.is_valid().to_numpy(zero_copy_only=False)
                counts = np.bincount(np.repeat(np.arange(len(toks)), list_lengths(toks))[known], minlength=len(toks))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), codes.drop_null().cast(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(start, len(toks)), lists], ["id", "codes"])
                start += len(toks)

    rows = memories.select("id", F.array_distinct(tokens(F.coalesce("text", F.lit("")))).alias("toks"))
    return cut_lineage(rows.mapInArrow(encode, f"id {memories.schema['id'].dataType.simpleString()}, codes array<int>"))


def _matrix_scores(memories: DataFrame, asked: pa.Table, words: pa.Array, limit: int) -> DataFrame:
    """(q, id, score): the best `limit` rows of every query in each block of memories."""
    index = token_codes(memories, words)
    found = index.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("df")).toArrow()
    total = index.count()
    idf = np.zeros(len(words))
    idf[found["code"].to_numpy()] = np.log(1.0 + total / found["df"].to_numpy().astype(np.float64))
    queries, row = np.unique(asked["q"].to_numpy(), return_inverse=True)
    weights = np.zeros((len(words), len(queries)))
    weights[pc.index_in(asked["tok"], value_set=words).to_numpy(), row] = 1.0
    shared = memories.sparkSession.sparkContext.broadcast((queries, weights * idf[:, None]))
    q_type = asked.schema.field("q").type

    def score(batches):
        q_ids, matrix = shared.value
        step = max(1, SLICE_BYTES // (8 * max(1, len(matrix))))
        for batch in batches:
            ids, lists = batch.column("id"), batch.column("codes")
            order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
            lists, parts = lists.take(pa.array(order)), []
            for at in range(0, len(order), step):
                piece = lists.slice(at, step)
                one = np.zeros((len(piece), len(matrix)))
                one[pc.list_parent_indices(piece).to_numpy(), piece.flatten().to_numpy(zero_copy_only=False)] = 1.0
                parts.append(one @ matrix)
            if not parts or not len(q_ids):
                continue
            scores = np.concatenate(parts)
            best = [first_places(scores[:, k] > 0, scores[:, k], limit) for k in range(len(q_ids))]
            rows = np.concatenate(best)
            columns = np.repeat(np.arange(len(q_ids)), [len(b) for b in best])
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[columns], q_type), ids.take(pa.array(order[rows])), pa.array(scores[rows, columns])], ["q", "id", "score"])

    q_kind = "bigint" if pa.types.is_int64(q_type) else "int" if pa.types.is_int32(q_type) else "string"
    return index.mapInArrow(score, f"q {q_kind}, id {index.schema['id'].dataType.simpleString()}, score double")


PASSAGE_BYTES = 8 << 20  # of passages that may travel to the texts


def verbatim_hits(documents: DataFrame, passages: DataFrame, passage_bytes: int = PASSAGE_BYTES) -> DataFrame:
    """(q, id) of documents that contain a passage verbatim, without comparing every pair.

    Passages of few bytes (counted first) travel to the texts, which are read once and never moved. Beyond that, a passage of
    three or more words fixes its inner words exactly, so one inner word gram is an equi-join key; a shorter passage joins on
    its first character. Candidates are then checked with `contains`.
    """
    if passages.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] <= passage_bytes:
        return _found_in_texts(documents, passages.where(F.length("text") > 0).select("q", "text"))
    gram = 4
    words = F.split(F.col("text"), r"\s+")
    inner = F.slice(words, 2, F.greatest(F.lit(1), F.least(F.lit(gram), F.size(words) - 2)))
    anchor = F.when(F.size(words) >= gram + 2, F.concat(F.lit("w:"), F.array_join(inner, " "))).otherwise(
        F.concat(F.lit("c:"), F.col("text").substr(1, 1))
    )
    asked = passages.where(F.length("text") > 0).select("q", F.col("text").alias("passage"), anchor.alias("anchor"))
    # The one-element transform binds the split once; a plain reference would be re-evaluated for every position.
    grams = F.get(
        F.transform(
            F.array(words),
            lambda w: F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(w) - gram + 1, F.lit(1))),
                lambda i: F.concat(F.lit("w:"), F.array_join(F.slice(w, i, gram), " ")),
            ),
        ),
        F.lit(0),
    )
    chars = F.transform(F.array_distinct(F.split(F.col("text"), "")), lambda c: F.concat(F.lit("c:"), c))
    keyed = documents.select("id", F.explode(F.array_distinct(F.concat(grams, chars))).alias("anchor"))
    pairs = keyed.join(asked.select("q", "anchor"), "anchor").select("q", "id").distinct()
    return (
        pairs.join(documents.select("id", "text"), "id")
        .join(asked.select("q", "passage"), "q")
        .where(F.col("text").contains(F.col("passage")))
        .select("q", "id")
    )


def _found_in_texts(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """The inner words of a passage stand whole in any text that holds it: one of them, the longest, must be among the text's words."""
    shared = documents.sparkSession.sparkContext.broadcast(passages.toArrow())

    def find(batches):
        table = shared.value
        texts, by_word, short = table["text"].to_pylist(), {}, []
        for place, passage in enumerate(texts):
            inner = passage.split()[1:-1]
            (by_word.setdefault(max(inner, key=len), []) if inner else short).append(place)
        anchors = set(by_word)
        for batch in batches:
            rows, places = [], []
            for row, value in enumerate(batch.column("text")):
                text = value.as_py()
                if text is None:
                    continue
                met = [place for word in anchors.intersection(text.split()) for place in by_word[word]]
                for place in met + short:
                    if texts[place] in text:
                        rows.append(row)
                        places.append(place)
            if rows:
                asked = table["q"].take(pa.array(places, pa.int64())).combine_chunks()
                yield pa.RecordBatch.from_arrays([asked, batch.column("id").take(pa.array(rows, pa.int64()))], ["q", "id"])

    kinds = ", ".join(f"{name} {df.schema[name].dataType.simpleString()}" for name, df in (("q", passages), ("id", documents)))
    return documents.select("id", "text").mapInArrow(find, kinds)

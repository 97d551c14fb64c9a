"""Learned reranker queries (L1-L6) on the feature arrays of conversation records, and the hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from memjoin.functions.text import token_cost
from memjoin.operators import features as V
from memjoin.operators import learn as L
from memjoin.operators.ranking import ranked
from memjoin.plans import features as FE
from memjoin.plans import fields as FP
from memjoin.plans import sqltext as S
from memjoin.plans import workload as W
from memjoin.plans.metrics import rounded
from memjoin.plans.registry import query
from memjoin.session import cut_lineage
from memjoin.sources import records, tables


def training_rows(spark, sf_dir):
    """Ranked candidates with the 48 features, labels and weights; written once, since fitting reads them many times."""
    base = FE.calibration_rows(spark, sf_dir)
    rel = records.relevance(spark, sf_dir).withColumn("hit", F.lit(1.0))
    rows = base.join(rel, ["q", "id"], "left").withColumn("label", F.coalesce("hit", F.lit(0.0)))
    rows = rows.withColumn("include_weight", F.when(F.col("label") == 1, 1.0).when(F.col("last_outcome") == "ignored", 8.0).otherwise(2.0))
    vector = V.padded(list(V.calibration_features(F.lit(900)).values()), 48)
    cost = token_cost(F.col("text")) if "cost" not in rows.columns else F.col("cost")
    target = L.utility_target(F.col("label"), cost, 900.0)
    return cut_lineage(rows.select("q", "id", "score", "rank", "label", "include_weight", target.alias("utility_target"), vector.alias("x")))


def heads(rows):
    """Both heads, fitted on the training queries; the queries below score the held-out ones."""
    train, _ = L.split(rows)
    return L.fit_head(train, "x", "label"), L.fit_head(train, "x", "label", "include_weight")


@query("l1_relevance_and_include_models")
def l1(spark, sf_dir):
    """Logits of both heads for every candidate of the held-out records."""
    rows = training_rows(spark, sf_dir)
    relevance, include = heads(rows)
    scored = L.logit(include, L.logit(relevance, L.split(rows)[1], "x", "relevance_logit"), "x", "include_logit")
    return scored.select("q", "id", "label", F.round("relevance_logit", 4).alias("relevance_logit"), F.round("include_logit", 4).alias("include_logit"))


@query("l2_calibrated_rerank")
def l2(spark, sf_dir):
    """Held-out records ranked by both heads, the base score and the predicted utility."""
    rows = training_rows(spark, sf_dir)
    worth = L.fit_utility(L.split(rows)[0], "x", "utility_target", "include_weight")
    out = L.calibrated_rerank(L.split(rows)[1], *heads(rows), "x", 6, utility_model=worth)
    return out.select("q", "id", F.round("score", 4).alias("score"), F.round("include_probability", 4).alias("include_probability"), "rank")


@query("l3_cascade_rerank")
def l3(spark, sf_dir):
    rows = training_rows(spark, sf_dir)
    models = heads(rows)
    train, held = L.split(rows)
    cheap = L.fit_head(train, "x", "label", reg=0.1, iterations=3)
    return L.cascade_rerank(held, cheap, models, "x", 8, 4).select("q", "id", F.round("score", 4).alias("score"), "rank")


@query("l4_context_selector")
def l4(spark, sf_dir):
    """Select probability and predicted reason from the 31 selector features."""
    roled = FE.roled(spark, sf_dir).select("q", "id", "role", "relevant")
    rows = FE.selector_rows(spark, sf_dir).join(roled, ["q", "id"])
    names = F.array(*[F.lit(r) for r in V.REASONS])
    reason = F.array_position(names, V.reason_label(F.col("role"), F.col("relevant"), F.col("cluster"))) - 1
    data = cut_lineage(rows.select("q", "id", F.col("relevant").cast("double").alias("label"), reason.cast("double").alias("reason"), V.padded(list(V.selector_features(F.lit(900)).values()), 31).alias("x")))
    train, held = L.split(data)
    select = L.logit(L.fit_head(train, "x", "label"), held, "x", "select_logit")
    classes = L.fit_classes(train, "x", "reason", len(V.REASONS))
    out = classes.transform(L._numbers(select, "x"))
    return out.select("q", "id", F.round(L.sigmoid(F.col("select_logit")), 4).alias("select_probability"), F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("reason"))


@query("l4_auxiliary_heads")
def l4_auxiliary(spark, sf_dir):
    """Seven weighted label heads: thresholds tuned on one split of the records, f1 reported on another."""
    from memjoin.operators import rollups as U

    roled = FE.roled(spark, sf_dir)
    flags = V.auxiliary_labels(F.col("role"), F.col("relevant"), V.preference_overlap(F.col("a_terms"), F.col("c_terms")), V.preference_conflict(F.col("a_terms"), F.col("c_terms")))
    labels = roled.select("q", "id", *[v.alias(n) for n, v in flags.items()])
    data = cut_lineage(FE.selector_rows(spark, sf_dir).select("q", "id", V.padded(list(V.selector_features(F.lit(900)).values()), 31).alias("x")).join(labels, ["q", "id"]))
    train, chosen, reported = L.three_ways(data)
    heads_ = L.fit_flags(train, "x", list(flags))
    tuned = U.tune_thresholds(L.flag_samples(heads_, chosen, "x"))
    samples = L.flag_samples(heads_, reported, "x").join(tuned.select("label", "threshold"), "label")
    hit, want = F.col("score") >= F.col("threshold"), F.col("expected") == 1
    counts = samples.groupBy("label", "threshold").agg(F.count_if(hit & want).alias("tp"), F.count_if(hit & ~want).alias("fp"), F.count_if(~hit & want).alias("fn"))
    return rounded(U.with_f1(counts).select("label", "threshold", "precision", "recall", "f1"))


@query("l5_attach_model")
def l5(spark, sf_dir):
    """Attach probability of neighbouring turns, trained on the heuristic's attach flag."""
    pairs = FE.turn_pairs(spark, sf_dir)
    action = V.heuristic_action(pairs).select("q", "id", F.col("attach").cast("double").alias("label"))
    data = cut_lineage(pairs.select("q", "id", V.padded(list(V.candidate_features().values()), 16).alias("x")).join(action, ["q", "id"]))
    train, held = L.split(data)
    scored = L.logit(L.fit_head(train, "x", "label"), held, "x", "logit").withColumn("score", L.sigmoid(F.col("logit")))
    proposals = V.edge_proposals(scored.select("q", "id", "score", (F.col("score") >= 0.5).alias("attach")), records.tasks(spark, sf_dir), 0.5)
    return proposals.select("q", F.coalesce("id", F.lit("")).alias("id"), F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score"), "new_cluster")


@query("l6_model_selection")
def l6(spark, sf_dir):
    """Three regularisation strengths, chosen by the balanced score on one split of the records, reported on another."""
    train, chosen, reported = L.three_ways(training_rows(spark, sf_dir))
    models = {reg: L.fit_head(train, "x", "label", reg=reg, iterations=10) for reg in (0.001, 0.01, 0.1)}
    tried = None
    for reg, model in models.items():
        one = ranking_metrics(model, chosen).withColumn("reg", F.lit(reg))
        tried = one if tried is None else tried.unionByName(one)
    best = tried.orderBy(F.round(L.selection_score(tried, "balanced"), 9).desc(), "reg").first()["reg"]
    final = ranking_metrics(models[best], reported)
    return rounded(final.select(F.lit(best).alias("reg"), L.selection_score(final, "balanced").alias("selection"), "recall", "mrr", "f1"))


def ranking_metrics(model, rows):
    """One row of ranking metrics of the model's order."""
    relevant = rows.where(F.col("label") == 1).groupBy("q").agg(F.count(F.lit(1)).alias("relevant_count"))
    scored = L.logit(model, rows.drop("score", "rank"), "x", "score")
    return V.learned_metrics(ranked(scored, "q").withColumn("is_relevant", F.col("label").cast("int")), relevant, 3, 0.0)


# Hooks: user code plugged into a step, here with a stand-in that repeats the built-in answer.
@query(
    "x1_embedding_backend",
    S.with_(S.QRY, S.hash_vectors("qv", "qry", "q")) + "SELECT q, idx::BIGINT AS idx, round(v, 6) AS v FROM qv WHERE v <> 0",
)
def x1(spark, sf_dir):
    """A user embedder per distinct text, joined back: iterator over Arrow batches, called once per task."""
    from memjoin.operators.hooks import embed_texts

    def backend(texts: list[str]) -> list[list[float]]:
        import math
        import re

        out = []
        for text in texts:
            row = [0.0] * 64
            for token in re.findall("[a-z0-9]+", text.lower()):
                h = 14695981039346656037
                for octet in token.encode():
                    h = ((h ^ octet) * 1099511628211) % (1 << 64)
                row[h % 64] += -1.0 if (h >> 8) & 1 else 1.0
            norm = math.sqrt(sum(v * v for v in row)) or 1.0
            out.append([v / norm for v in row])
        return out

    vec = embed_texts(tables.queries(spark, sf_dir).select("q", "text"), "q", lambda: backend)
    return vec.select("q", F.posexplode("vec").alias("idx", "v")).where(F.col("v") != 0).select("q", F.col("idx").cast("bigint").alias("idx"), F.round("v", 6).alias("v"))


@query(
    "x2_classifier_hook",
    S.with_(FP.ITEMS) + "SELECT item, 'first_word' AS field, string_split(text, ' ')[1] AS value, 0.9::DOUBLE AS confidence FROM items",
)
def x2(spark, sf_dir):
    """A user classifier over batches of texts, emitting any number of predictions per text."""
    from memjoin.operators.hooks import classify_texts

    def classify(text: str):
        yield ("first_word", text.split(" ")[0], 0.9, "")

    return classify_texts(FP.labelled_texts(spark, sf_dir), "item", classify).drop("span")


@query("x3_scorer_hook", S.with_(W.LEX) + "SELECT q, id, rank FROM lex")
def x3(spark, sf_dir):
    """Scorers are functions (queries, memories) -> ranked frame, chosen by name."""
    from memjoin.operators.hooks import SCORERS, register_scorer
    from memjoin.operators.lexical import idf_token_scores

    register_scorer("token_idf", lambda qry, mem: idf_token_scores(mem, qry, None, W.FETCH))
    out = SCORERS["token_idf"](tables.queries(spark, sf_dir).select("q", "text"), tables.memories(spark, sf_dir).select("id", "text"))
    return out.select("q", "id", F.col("rank").cast("bigint").alias("rank"))


@query("x4_token_emitter_hook", "SELECT vec_id AS id, 0::BIGINT AS action, floor(embedding[1]::DOUBLE * 10)::BIGINT AS bucket, round(abs(embedding[1]::DOUBLE), 6) AS weight FROM embeddings")
def x4(spark, sf_dir):
    """A user token emitter over vectors in place of the built-in projection."""
    from memjoin.operators.hooks import emit_tokens

    def emit(vectors):
        return [[(0, int(v[0] * 10 // 1), abs(v[0]))] for v in vectors]

    rows = emit_tokens(tables.vectors(spark, sf_dir).select("id", "vec"), "id", emit)
    return rounded(rows.select("id", F.col("action").cast("bigint").alias("action"), F.col("bucket").cast("bigint").alias("bucket"), "weight"))

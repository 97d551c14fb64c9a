"""Feature and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from memjoin.functions.state import numeric_with_fallback
from memjoin.functions.text import contains_any, jaccard_sets, token_set
from memjoin.operators import basins as B
from memjoin.operators import features as V
from memjoin.operators.ranking import ranked
from memjoin.plans import fields as FP
from memjoin.plans import records_sql as Q
from memjoin.plans import sqltext as S
from memjoin.plans.metrics import r6, rounded
from memjoin.plans.registry import query
from memjoin.sources import records, tables

_markers = ", ".join(f"'{m}'" for m in V.PREFERENCE_MARKERS)


def terms(text: str) -> str:
    t = S.toks(text)
    return (
        f"list_distinct(list_filter(flatten(list_transform(range(1, len({t}) + 1), lambda i: CASE WHEN ({t})[i] IN ({_markers}) THEN ({t})[i + 1 : i + 4] ELSE [] END)), lambda w: length(w) > 1))"
    )


TERMS = S.with_(FP.ITEMS, f"tk AS (SELECT item, {S.toks('text')} AS tk FROM items)", f"""ap AS (SELECT item, unnest(list_filter(range(1, len(tk) + 1), lambda i: list_contains([{_markers}], tk[i]))) AS i, tk FROM tk),
tw AS (SELECT DISTINCT item, w FROM (SELECT item, unnest(tk[i + 1 : i + 4]) AS w FROM ap) WHERE length(w) > 1),
tr AS (SELECT t.item, t.item % 40 AS usr, coalesce(list(w ORDER BY w) FILTER (w IS NOT NULL), []) AS terms FROM tk t LEFT JOIN tw USING (item) GROUP BY t.item)""")


@query("f18_preference_terms", TERMS + "SELECT item, array_to_string(terms, ' ') AS terms FROM tr")
def preference_terms(spark, sf_dir):
    return FP.labelled_texts(spark, sf_dir).select("item", F.array_join(F.array_sort(V.preference_terms(F.col("text"))), " ").alias("terms"))


@query(
    "f19_preference_relation",
    TERMS
    + f""", pr AS (SELECT item, terms AS c, lag(terms) OVER (PARTITION BY usr ORDER BY item) AS a FROM tr)
      SELECT item, CASE WHEN len(a) = 0 OR len(c) = 0 THEN 'preference_unknown' WHEN {S.jac('a', 'c')} >= 0.34 THEN 'preference_match' ELSE 'preference_conflict' END AS relation,
      round({S.jac('a', 'c')}, 6) AS overlap FROM pr WHERE a IS NOT NULL""",
)
def preference_relation(spark, sf_dir):
    from pyspark.sql import Window

    rows = FP.labelled_texts(spark, sf_dir).select("item", V.preference_terms(F.col("text")).alias("c"))
    pairs = rows.withColumn("a", F.lag("c").over(Window.partitionBy(F.col("item") % 40).orderBy("item"))).where(F.col("a").isNotNull())
    return pairs.select("item", V.preference_relation(F.col("a"), F.col("c")).alias("relation"), F.round(V.preference_overlap(F.col("a"), F.col("c")), 6).alias("overlap"))


@query(
    "f20_marker_predicates",
    S.with_(FP.ITEMS)
    + "SELECT item, contains(lower(text), 'now ') OR contains(lower(text), 'current preference') OR contains(lower(text), 'user now') AS current, contains(lower(text), 'obsolete') OR contains(lower(text), 'no longer') OR contains(lower(text), 'used to') AS stale, contains(lower(text), 'teal') OR contains(lower(text), 'formal') AS named FROM items",
)
def marker_predicates(spark, sf_dir):
    text = F.col("text")
    return FP.labelled_texts(spark, sf_dir).select(
        "item", contains_any(text, ["now ", "current preference", "user now"]).alias("current"), contains_any(text, ["obsolete", "no longer", "used to"]).alias("stale"),
        contains_any(text, ["teal", "formal"]).alias("named"),
    )


@query(
    "f16_numeric_with_fallback",
    "SELECT event_id, coalesce(CASE WHEN event_type = 'view' THEN value END, CASE WHEN event_type <> 'error' THEN (props::JSON->>'k')::DOUBLE END, 0.5)::DOUBLE AS value FROM events",
)
def numeric_fallback(spark, sf_dir):
    """Card value for views, metadata value otherwise; errors carry text that is no number and fall to the default."""
    card = F.when(F.col("event_type") == "view", F.col("value").cast("string")).otherwise(F.lit(None).cast("string"))
    k = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.get_json_object("props", "$.k"))
    return tables.table(spark, sf_dir, "events").select("event_id", numeric_with_fallback(card, F.create_map(F.lit("score"), k), "score", 0.5).alias("value"))


_cs, _state = Q.state(a="c_age_days", u="c_use_count", e="c_evidence_count", o="c_last_outcome", p="c_protected"), ("age_norm", "use_norm", "evidence_norm", "outcome", "protected", "stale", "recency")
PP = ",\n".join(
    [
        Q.PAIRS,
        """cc AS (SELECT c.*, cm.mask, """ + f"""{S.tset('c.text')} AS set, len({S.toks('c.text')}) AS n, CASE WHEN importance = 0 THEN 0.5::DOUBLE ELSE importance END AS weighty FROM cards c JOIN cm ON cm.id = c.id)""",
        "lk AS (SELECT id, lag(id) OVER (PARTITION BY q ORDER BY pos) AS prev FROM cards)",
        "dt AS (SELECT l.id, sum(a.v * b.v) AS s FROM lk l JOIN cv a ON a.id = l.prev JOIN cv b ON b.id = l.id AND b.idx = a.idx GROUP BY l.id)",
        f"""pp AS (SELECT c.q, c.id, a.text AS a_text, c.text AS c_text, a.cluster AS a_cluster, c.cluster AS c_cluster, a.speaker AS a_speaker, c.speaker AS c_speaker, a.session AS a_session, c.session AS c_session,
  a.age_days AS a_age_days, c.age_days AS c_age_days, c.use_count AS c_use_count, c.evidence_count AS c_evidence_count, c.last_outcome AS c_last_outcome, c.protected AS c_protected, a.weighty AS a_weighty, c.weighty AS c_weighty,
  greatest(1, a.n) AS a_n, greatest(1, c.n) AS c_n, a.set AS a_set, c.set AS c_set, coalesce(dt.s, 0.0)::DOUBLE AS semantic, {S.jac('a.set', 'c.set')} AS lexical,
  ((a.speaker = c.speaker)::INT + (a.session = c.session)::INT) / 2.0::DOUBLE AS meta, (a.cluster = c.cluster)::INT::DOUBLE AS cluster
  FROM cc c JOIN lk USING (id) JOIN cc a ON a.id = lk.prev LEFT JOIN dt ON dt.id = c.id)""",
    ]
)


def turn_pairs(spark, sf_dir):
    return V.with_pair_scores(V.neighbour_pairs(records.cards(spark, sf_dir)))


def shown(df, values, prefix="f"):
    """Feature columns f00, f01, ... rounded."""
    return df.select("q", "id", *[F.round(v.cast("double"), 6).alias(f"{prefix}{i:02d}") for i, v in enumerate(values)])


def shown_sql(values, source):
    return "SELECT q, id, " + ", ".join(f"round(({v})::DOUBLE, 6) AS f{i:02d}" for i, v in enumerate(values)) + f" FROM {source}"


A_AGE = "greatest(0.0, least(1.0, a_age_days / 365.0))"
STATE_SQL = [A_AGE] + [_cs[n] for n in _state]


@query("v1_state_features", S.with_(PP) + shown_sql(STATE_SQL, "pp"))
def v1(spark, sf_dir):
    return shown(turn_pairs(spark, sf_dir), V.state_features().values())


@query("v2_metadata_score", S.with_(PP) + "SELECT q, id, round(meta, 6) AS meta FROM pp")
def v2(spark, sf_dir):
    return turn_pairs(spark, sf_dir).select("q", "id", F.round("meta", 6).alias("meta"))


@query("v3_cluster_score", S.with_(PP) + "SELECT q, id, cluster FROM pp")
def v3(spark, sf_dir):
    return turn_pairs(spark, sf_dir).select("q", "id", "cluster")


_has = lambda text, words: "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"
TYPE_SQL = f"""CASE WHEN cluster > 0 THEN 'same_cluster' WHEN meta > 0.5 THEN 'same_context' WHEN {_has("a_text || ' ' || c_text", V.PREFERENCE_WORDS)} THEN 'preference'
  WHEN {_has("a_text || ' ' || c_text", V.CORRECTION_WORDS)} THEN 'correction' WHEN lexical > 0.18 THEN 'same_topic' ELSE 'used_with' END"""


@query("v4_edge_type_inference", S.with_(PP) + f"SELECT q, id, {TYPE_SQL} AS type FROM pp")
def v4(spark, sf_dir):
    return turn_pairs(spark, sf_dir).select("q", "id", V.edge_type().alias("type"))


ACTION = f"""sc AS (SELECT *, {TYPE_SQL} AS type, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.35::DOUBLE * semantic + 0.20::DOUBLE * lexical + 0.20::DOUBLE * meta + 0.15::DOUBLE * cluster + 0.05::DOUBLE
  + 0.08::DOUBLE * {_cs['use_norm']} + 0.06::DOUBLE * {_cs['evidence_norm']} + 0.05::DOUBLE * {_cs['protected']} + 0.08::DOUBLE * greatest(0.0, {_cs['outcome']}) - 0.16::DOUBLE * {_cs['stale']} - 0.10::DOUBLE * greatest(0.0, -{_cs['outcome']}))) AS score,
  a_text || ' ' || a_cluster || ' ' || c_text || ' ' || c_cluster || ' ' || type || ' speaker ' || a_speaker || ' session_id ' || a_session || ' speaker ' || c_speaker || ' session_id ' || c_session AS words FROM pp)"""


@query(
    "v5_heuristic_edge_action",
    S.with_(PP, ACTION, S.masks("wm", "sc", "id", "words"))
    + f"""SELECT q, id, round(score, 6) AS score, type, round(greatest(0.05, least(1.2, 0.2 + score)), 6) AS weight, round(greatest(0.05, least(1.0, score)), 6) AS confidence, {S.signed('wm.mask::HUGEINT')} AS mask,
      CASE WHEN type IN ('preference','correction') THEN 0.005 WHEN type IN ('same_cluster','same_context') THEN 0.01 ELSE 0.02 END::DOUBLE AS decay,
      round(greatest(-0.04, least(0.08, (score - 0.5) * 0.08)), 6)::DOUBLE AS importance_delta, score >= 0.28 AS attach FROM sc JOIN wm USING (id)""",
)
def v5(spark, sf_dir):
    return rounded(V.heuristic_action(turn_pairs(spark, sf_dir)))


@query(
    "j26_heuristic_neighbourhood",
    S.with_(
        PP, ACTION,
        f"k AS (SELECT * FROM ({S.ranked('(SELECT q, id, score FROM sc WHERE score >= 0.28)')}) WHERE rank <= 8)",
        "b AS (SELECT q, max(score) AS best FROM k GROUP BY q)",
    )
    + "SELECT t.q, coalesce(k.id, '') AS id, round(coalesce(k.score, 0.0), 6) AS score, coalesce(k.rank, 0) AS rank, b.best IS NULL AS new_cluster, round(1.0 - coalesce(b.best, 0.0), 6) AS new_cluster_score FROM task t LEFT JOIN b USING (q) LEFT JOIN k USING (q)",
)
def j26(spark, sf_dir):
    out = V.edge_proposals(V.heuristic_action(turn_pairs(spark, sf_dir)), records.tasks(spark, sf_dir))
    return rounded(out.select("q", F.coalesce("id", F.lit("")).alias("id"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("rank", F.lit(0)).cast("bigint").alias("rank"), "new_cluster", "new_cluster_score"))


SIXTEEN = ["semantic", "lexical", "meta", "cluster", "a_weighty", "c_weighty", "least(a_n, c_n)::DOUBLE / greatest(a_n, c_n)", "least(1.0, c_n / 64.0)", *STATE_SQL]


@query("v6_candidate_features_16", S.with_(PP) + shown_sql(SIXTEEN, "pp"))
def v6(spark, sf_dir):
    return shown(turn_pairs(spark, sf_dir), V.candidate_features().values())


@query("v8_feature_ablation", S.with_(PP) + shown_sql(["0.0" if i in (2, 3, 8, 9) else v for i, v in enumerate(SIXTEEN + ["0.0", "0.0"])], "pp"))
def v8(spark, sf_dir):
    vector = V.padded(list(V.candidate_features().values()), 18)
    rows = turn_pairs(spark, sf_dir).select("q", "id", V.ablated(vector, [2, 3, 8, 9]).alias("v"))
    return shown(rows, [F.get("v", F.lit(i)) for i in range(18)])


# Ranked record candidates with sources and query matches, for the 48 calibration features.
CAL = ",\n".join(
    [
        Q.PAIRS,
        f"sp AS ({S.ranked(f'(SELECT q, id, {Q.SPARSE} AS score FROM pairs)')})",
        f"""ca AS (SELECT p.*, sp.score, sp.rank, len({S.toks('p.query')}) AS q_n, len({S.toks('p.text')}) AS n, max(sp.score) OVER (PARTITION BY p.q) - sp.score AS gap,
  p.pos % 2 = 0 AS s_vector, p.pos % 3 = 0 AS s_meta, p.speaker = p.anchor_speaker AS um, p.session = p.anchor_session AS pm, p.pos % 4 = 0 AS bm, p.pos % 5 = 0 AS du, p.pos % 2 = 1 AS dp, p.pos % 3 = 1 AS db, p.pos % 5 AS dc FROM pairs p JOIN sp USING (q, id))""",
    ]
)
_r = Q.state()
_b = lambda x: f"({x})::INT"
CAL_SQL = [
    "greatest(-2.0, least(2.0, score)) / 2.0", "1.0 / greatest(1, rank)", "least(1.0, rank / 256.0)", "lexical", "least(greatest(1, q_n), greatest(1, n))::DOUBLE / greatest(greatest(1, q_n), greatest(1, n))",
    "least(1.0, greatest(1, n) / 900.0)", "least(1.0, greatest(1, n) / 128.0)", "weighty", "least(1.0, use_count / 32.0)", "least(1.0, evidence_count / 16.0)", "1.0", "1.0", "0.0", _b("speaker <> ''"), "0.0", _b("cluster <> ''"),
    _r["age_norm"], _r["stale"], _r["recency"], f"greatest(0.0, -{_r['outcome']})", f"greatest(0.0, {_r['outcome']})", _b(_has("text", V.CALIBRATION_CONFLICT)), "0.0", "greatest(-2.0, least(2.0, gap)) / 2.0",
    _b("s_vector"), "1.0", _b("s_meta"), "0.0", "(1 + s_vector::INT + s_meta::INT) / 6.0", _b("um"), _b("pm"), _b("bm"), _b("um AND pm AND bm"), _b("du"), _b("dp"), _b("db"), _b("du OR dp OR db"), "least(1.0, dc / 12.0)", "dc / 5.0",
    _b("(um <> du) OR (pm <> dp) OR (bm <> db)"), _b("NOT (um OR pm OR bm) AND (du OR dp OR db)"), "0.0", "0.0", _b("(um OR pm OR bm) AND (du OR dp OR db)"), "0.0", _b("dc / 5.0 >= 0.8"), _b("dc >= 3"), _b("du AND dp AND db"),
]


def calibration_rows(spark, sf_dir):
    pairs = records.pairs(spark, sf_dir)
    task = records.task_side(spark, sf_dir).select("q", F.size("q_set").alias("_s"), "query", "anchor_speaker", "anchor_session")
    from pyspark.sql import Window

    from memjoin.functions.text import token_count

    rows = B.sparse_ranked(pairs).join(pairs, ["q", "id"]).join(task, "q")
    pos = F.col("pos")
    sources = F.concat(
        F.array(F.lit("token")), F.when(pos % 2 == 0, F.array(F.lit("vector"))).otherwise(F.array().cast("array<string>")),
        F.when(pos % 3 == 0, F.array(F.lit("metadata:speaker"))).otherwise(F.array().cast("array<string>")),
    )
    user, project, brand = F.col("speaker") == F.col("anchor_speaker"), F.col("session") == F.col("anchor_session"), pos % 4 == 0
    derived = (pos % 5 == 0, pos % 2 == 1, pos % 3 == 1)
    return rows.select(
        "q", "id", "score", "rank", "lexical", F.lit(0.0).alias("summary_lexical"), token_count(F.col("query")).alias("q_n"), token_count(F.col("text")).alias("n"), "weighty", "use_count", "evidence_count",
        "age_days", "last_outcome", "protected", "cluster", "text", "speaker",
        F.create_map(F.lit("session_id"), F.col("session").cast("string"), F.lit("turn_id"), F.col("id"), F.lit("speaker"), F.col("speaker")).alias("metadata"),
        (F.max("score").over(Window.partitionBy("q")) - F.col("score")).alias("gap"), sources.alias("sources"),
        user.alias("query_user_match"), project.alias("query_project_match"), brand.alias("query_brand_match"),
        derived[0].alias("derived_user_match"), derived[1].alias("derived_project_match"), derived[2].alias("derived_brand_match"),
        (pos % 5).alias("derived_count"), (pos % 5 / 5.0).alias("derived_confidence"), ((user != derived[0]) | (project != derived[1]) | (brand != derived[2])).alias("metadata_disagreement"),
    )


@query("v7_calibration_features_48", S.with_(CAL) + shown_sql(CAL_SQL, "ca"))
def v7(spark, sf_dir):
    return shown(calibration_rows(spark, sf_dir), V.calibration_features(F.lit(900)).values())


NINE = ",\n".join([PP, f"""tt AS (SELECT id, {terms('text')} AS terms FROM cards)""", f"""qq AS (SELECT pp.*, p.semantic AS q_semantic, p.lexical AS q_lexical, greatest(1, len({S.toks('p.query')})) AS q_n, ta.terms AS a_terms, tc.terms AS c_terms,
  (a_cluster <> '' AND c_cluster <> '' AND a_cluster <> c_cluster)::INT AS mm FROM pp JOIN pairs p ON p.id = pp.id JOIN lk ON lk.id = pp.id JOIN tt ta ON ta.id = lk.prev JOIN tt tc ON tc.id = pp.id)"""])
_ov, _cf = S.jac("a_terms", "c_terms"), f"(len(a_terms) > 0 AND len(c_terms) > 0 AND {S.jac('a_terms', 'c_terms')} < 0.34)::INT"
_pos = f"(({_cs['use_norm']} + {_cs['evidence_norm']} + greatest(0.0, {_cs['outcome']}) + c_weighty) / 4.0)"
NINE_SQL = [
    "q_semantic", "q_lexical", "c_weighty", "least(1.0, c_n / 900.0)", "least(1.0, c_n / 64.0)", "least(q_n, c_n)::DOUBLE / greatest(q_n, c_n)", _b("c_speaker <> ''"), _b("c_cluster <> ''"), "semantic", "lexical", "meta", "cluster",
    _ov, _cf, f"{_cf} * cluster", "a_weighty", "least(a_n, c_n)::DOUBLE / greatest(a_n, c_n)", "mm", "mm * lexical", f"mm * {_ov}", f"mm * {_cf}", *[_cs[n] for n in _state], f"mm * {_pos}", f"cluster * {_cs['stale']}", f"cluster * {_pos}",
]
NINE_SQL = [f"greatest(-1.0, least(1.0, ({v})::DOUBLE))" for v in NINE_SQL]


def selector_rows(spark, sf_dir):
    from memjoin.functions.text import token_count

    asked = records.pairs(spark, sf_dir).select("q", "id", F.col("semantic").alias("q_semantic"), F.col("lexical").alias("q_lexical"))
    length = records.tasks(spark, sf_dir).select("q", token_count(F.col("query")).alias("q_n"))
    return turn_pairs(spark, sf_dir).join(asked, ["q", "id"]).join(length, "q")


@query("v9_selector_features_31", S.with_(NINE) + shown_sql(NINE_SQL, "qq"))
def v9(spark, sf_dir):
    return shown(selector_rows(spark, sf_dir), V.selector_features(F.lit(900)).values())


V10_SQL = ["semantic", "lexical", "activation", "weighty", "least(1.0, cost / 90.0)", *[_r[n] for n in _state], "0.0", "0.0"]


@query("v10_frame_scalars_14", S.with_(Q.PAIRS) + shown_sql([f"greatest(-1.0, least(1.0, {v}))" for v in V10_SQL], "pairs"))
def v10(spark, sf_dir):
    return shown(records.pairs(spark, sf_dir), V.frame_scalars(F.lit("")).values())


@query(
    "f27_relationship_signature",
    S.with_(NINE)
    + f"""SELECT q, id, CASE WHEN a_cluster = c_cluster THEN 'same_project' ELSE 'cross_project' END || '|' || CASE WHEN len(a_terms) = 0 OR len(c_terms) = 0 THEN 'preference_unknown' WHEN {_ov} >= 0.34 THEN 'preference_match' ELSE 'preference_conflict' END
      || '|' || CASE WHEN c_age_days >= 180 AND c_use_count <= 0 AND NOT c_protected THEN 'stale' ELSE 'fresh_or_used' END || '|' || CASE WHEN lexical >= 0.65 THEN 'duplicate_like' ELSE 'distinct' END AS signature FROM qq""",
)
def f27(spark, sf_dir):
    return V.neighbour_pairs(records.cards(spark, sf_dir)).select("q", "id", V.relationship_signature().alias("signature"))


# Roles by position, so that every branch of the label rules is taken.
ROLE_LIST = ["", "near_duplicate", "cross_relevant", "preference_relevant", "contradicted_preference_negative", "stale_negative", "noise_negative"]
ROLED = f"""rl AS (SELECT qq.*, {ROLE_LIST}[(c.pos % 7 + 1)::INT] AS role, c.speaker = 'assistant' AND c.pos % 2 = 1 AS relevant FROM qq JOIN cards c ON c.id = qq.id)"""
_stale = ", ".join(f"'{x}'" for x in V.STALE_ROLES)
_pref = ", ".join(f"'{x}'" for x in V.PREFERENCE_ROLES)
_pcon = ", ".join(f"'{x}'" for x in V.PREFERENCE_CONFLICT_ROLES)
REASON_SQL = f"""CASE WHEN role IN ({_stale}) THEN 'stale_or_superseded' WHEN role = 'cross_relevant' THEN 'cross_context_support' WHEN role IN ({_pref}) THEN 'preference_memory'
  WHEN relevant THEN CASE WHEN cluster > 0 THEN 'same_context' ELSE 'cross_context_support' END ELSE 'wrong_context' END"""


def roled(spark, sf_dir):
    role = F.element_at(F.array(*[F.lit(r) for r in ROLE_LIST]), (F.col("c_pos") % 7 + 1).cast("int"))
    relevant = (F.col("c_speaker") == "assistant") & (F.col("c_pos") % 2 == 1)
    return turn_pairs(spark, sf_dir).withColumn("role", role).withColumn("relevant", relevant)


@query("v13_reason_label", S.with_(NINE, ROLED) + f"SELECT q, id, {REASON_SQL} AS reason FROM rl")
def v13(spark, sf_dir):
    return roled(spark, sf_dir).select("q", "id", V.reason_label(F.col("role"), F.col("relevant"), F.col("cluster")).alias("reason"))


AUX_SQL = [
    _b("relevant"), _b("cluster > 0"), _b(f"role = 'cross_relevant' OR role IN ({_pref}) OR {_ov} > 0"), _b(f"role IN ({_pcon}) OR (cluster > 0 AND {_cf} > 0)"), "mm", _b(f"role IN ({_stale})"), _b(f"NOT relevant AND role NOT IN ({_stale})"),
]


@query("v14_auxiliary_labels", S.with_(NINE, ROLED) + shown_sql(AUX_SQL, "rl"))
def v14(spark, sf_dir):
    overlap = V.preference_overlap(F.col("a_terms"), F.col("c_terms"))
    conflict = V.preference_conflict(F.col("a_terms"), F.col("c_terms"))
    return shown(roled(spark, sf_dir), V.auxiliary_labels(F.col("role"), F.col("relevant"), overlap, conflict).values())


@query(
    "v16_candidate_labels",
    S.with_(Q.PAIRS, f"sp AS ({S.ranked(f'(SELECT q, id, {Q.SPARSE} AS score FROM pairs)')})", "l AS (SELECT s.q, s.id, s.score, r.id IS NOT NULL AS rel, p.last_outcome = 'ignored' AS hard FROM sp s JOIN pairs p USING (q, id) LEFT JOIN rel r USING (q, id))")
    + "SELECT q, id, rel::INT::DOUBLE AS include_label, CASE WHEN rel THEN 1.0 WHEN hard THEN 4.0 ELSE 1.0 END::DOUBLE AS label_weight, CASE WHEN rel THEN 1.0 WHEN hard THEN 8.0 ELSE 2.0 END::DOUBLE AS include_weight, round(max(score) OVER (PARTITION BY q) - score, 6) AS gap FROM l",
)
def v16(spark, sf_dir):
    return rounded(labelled(spark, sf_dir).select("q", "id", "include_label", "label_weight", "include_weight", "gap"))


def labelled(spark, sf_dir):
    pairs = records.pairs(spark, sf_dir)
    rel = records.relevance(spark, sf_dir).withColumn("hit", F.lit(True))
    rows = B.sparse_ranked(pairs).join(pairs.select("q", "id", (F.col("last_outcome") == "ignored").alias("is_hard")), ["q", "id"]).join(rel, ["q", "id"], "left")
    return V.candidate_labels(rows.withColumn("is_relevant", F.coalesce("hit", F.lit(False))))


@query("v19_positive_weight", "SELECT least(16.0, greatest(1.0, (count(*) - sum(toxic)) / greatest(1, sum(toxic))))::DOUBLE AS positive_weight FROM labels")
def v19(spark, sf_dir):
    return V.class_balance(tables.table(spark, sf_dir, "labels"), "toxic")


@query(
    "v19_class_weights",
    S.with_(NINE, ROLED, f"c AS (SELECT {REASON_SQL} AS class, count(*) AS n FROM rl GROUP BY ALL)", f"b AS (SELECT k.class, coalesce(n, 0) + 1 AS n FROM (SELECT unnest({V.REASONS}) AS class) k LEFT JOIN c USING (class))")
    + "SELECT class, round(least(8.0, (SELECT sum(n) FROM b) / (5.0 * n)), 6)::DOUBLE AS weight FROM b",
)
def v19_classes(spark, sf_dir):
    labels = roled(spark, sf_dir).select(V.reason_label(F.col("role"), F.col("relevant"), F.col("cluster")).alias("reason"))
    return rounded(V.class_weights(labels, "reason", V.REASONS))


@query(
    "p29_relevant_ids_resolution",
    S.with_(Q.PAIRS, "ex AS (SELECT q, id FROM rel WHERE q % 2 = 0)", "fb AS (SELECT q, id FROM pairs WHERE q NOT IN (SELECT q FROM ex) AND round(coverage, 9) >= 0.5 AND weighty >= 0.5)")
    + "SELECT q, id FROM ex UNION ALL SELECT q, id FROM fb",
)
def p29(spark, sf_dir):
    """Even records bring explicit ids; the others fall back to candidates whose two label scores both reach one half."""
    from memjoin.operators.cards import resolve_relevant

    pairs = records.pairs(spark, sf_dir)
    explicit = records.relevance(spark, sf_dir).where(F.col("q") % 2 == 0)
    scored = pairs.select("q", "id", F.round("coverage", 9).alias("attach"), F.col("weighty").alias("rank_label"))
    return resolve_relevant(explicit, scored)


@query(
    "p30_padded_frame",
    S.with_(Q.PAIRS, f"sp AS (SELECT * FROM ({S.ranked(f'(SELECT q, id, {Q.SPARSE} AS score FROM pairs)')}) WHERE rank <= 4)", "g AS (SELECT s.q, list(s.id ORDER BY rank) AS ids, list(printf('%.4f', p.weighty) ORDER BY rank) AS w FROM sp s JOIN pairs p USING (q, id) GROUP BY s.q)")
    + "SELECT q, array_to_string(list_resize(ids, 4, ''), ',') AS ids, array_to_string(list_resize(w, 4, '0.0000'), ',') AS weighty, len(ids)::DOUBLE AS active FROM g",
)
def p30(spark, sf_dir):
    pairs = records.pairs(spark, sf_dir)
    rows = B.sparse_ranked(pairs).join(pairs.select("q", "id", "weighty"), ["q", "id"])
    frames = V.padded_frame(records.tasks(spark, sf_dir), rows, 4, {"weighty": 0.0})
    return frames.select(
        "q", F.array_join("ids", ",").alias("ids"), F.array_join(F.transform("weighty", lambda v: F.format_string("%.4f", v)), ",").alias("weighty"), F.aggregate("mask", F.lit(0.0), lambda s, v: s + v).alias("active")
    )

"""Card derivation, decoy, growth, degradation and export queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memjoin.operators import augment as A
from memjoin.operators import basins as B
from memjoin.operators import cards as C
from memjoin.operators import exports as X
from memjoin.plans import records_sql as RQ
from memjoin.plans import sqltext as S
from memjoin.plans import workload as W
from memjoin.plans.ingest import scratch
from memjoin.plans.metrics import rounded
from memjoin.plans.registry import query
from memjoin.sources import records, tables


def lit(value) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def pick_sql(values: list[str], key: str) -> str:
    return f"([{', '.join(lit(v) for v in values)}])[({S.fnv(key)} % {len(values)})::INT + 1]"


@query("p15_stable_pick", f"SELECT page_id, {pick_sql(A.GROWTH_TOPICS, 'url')} AS topic FROM pages")
def p15(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages").select("page_id", A.stable_pick(A.GROWTH_TOPICS, F.col("url")).alias("topic"))


@query(
    "p15_stable_card_pick",
    S.with_(RQ.CARDS, "n AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY id) - 1 AS place, count(*) OVER (PARTITION BY q) AS c FROM cards)")
    + f"SELECT t.q, n.id FROM task t JOIN n ON n.q = t.q AND n.place = ({S.fnv('t.query')} % n.c)::INT",
)
def p15_cards(spark, sf_dir):
    keys = records.tasks(spark, sf_dir).select("q", F.col("query").alias("key"))
    return A.stable_row_pick(keys, records.cards(spark, sf_dir).select("q", "id"), "q", "id").select("q", "id")


QUESTIONS = RQ.CARDS + ",\n" + RQ.REL + """,
ps AS (SELECT r.q, string_agg(c.text, ' ' ORDER BY c.id) AS positive, string_agg(c.id, ',' ORDER BY c.id) AS relevant FROM rel r JOIN cards c USING (q, id) GROUP BY r.q),
qs AS (SELECT t.q AS uid, 'qa' || t.q AS qa_id, t.query, CASE WHEN t.q % 2 = 0 THEN '' ELSE 'answer ' || t.q END AS answer, substr(coalesce(p.positive, ''), 1, 360) AS positive, coalesce(p.relevant, '') AS relevant FROM task t LEFT JOIN ps p USING (q)),
dn AS (SELECT q AS uid, id AS donor, importance, row_number() OVER (PARTITION BY q ORDER BY id) - 1 AS place, count(*) OVER (PARTITION BY q) AS c FROM (FROM cards ANTI JOIN rel USING (q, id) UNION ALL FROM cards WHERE q NOT IN (SELECT q FROM cards ANTI JOIN rel USING (q, id))))"""


def questions(spark, sf_dir):
    cards, rel = records.cards(spark, sf_dir), records.relevance(spark, sf_dir)
    held = cards.join(rel, ["q", "id"], "left_semi").groupBy("q").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("r"))
    rows = records.tasks(spark, sf_dir).join(held, "q", "left")
    none = F.array().cast(held.schema["r"].dataType)
    listed = F.coalesce("r", none)
    return rows.select(
        F.col("q").alias("uid"), F.concat(F.lit("qa"), F.col("q").cast("string")).alias("qa_id"), "query",
        F.when(F.col("q") % 2 == 0, "").otherwise(F.concat(F.lit("answer "), F.col("q").cast("string"))).alias("answer"),
        F.array_join(F.transform(listed, lambda x: x["text"]), " ").substr(1, A.POSITIVE_LENGTH).alias("positive"), F.transform(listed, lambda x: x["id"]).alias("relevant"),
        F.transform(listed, lambda x: x["text"]).alias("bases"),
    )


def donors(spark, sf_dir):
    """Cards that are not relevant; all cards of a record where every one is."""
    every = records.cards(spark, sf_dir)
    free = every.join(records.relevance(spark, sf_dir), ["q", "id"], "left_anti")
    cards = free.unionByName(every.join(free.select("q").distinct(), "q", "left_anti"))
    return cards.select(
        F.col("q").alias("uid"), F.concat(F.lit("qa"), F.col("q").cast("string")).alias("qa_id"), "id", F.col("text").alias("summary"), "cluster", "importance", "age_days", "use_count", "evidence_count", "last_outcome"
    )


def decoy_sql(count: int, templates: list[tuple], fallback: list[str], prefix: str) -> str:
    """CTE `dec` (uid, qa_id, i, key, id, role, text, donor, importance)."""
    n = len(templates)
    pos = f"coalesce(nullif(positive, ''), {pick_sql(fallback, 'key')})"
    texts = " ".join(
        f"WHEN {k} THEN trim(" + " || ".join(
            {"{query}": "query", "{answer}": "coalesce(nullif(answer, ''), 'unknown')", "{positive}": pos}.get(p, lit(p)) for p in _split(t[1]) if p
        ) + ")"
        for k, t in enumerate(templates)
    )
    roles = f"([{', '.join(lit(t[0]) for t in templates)}])[k + 1]"
    return f"""ky AS (SELECT *, qa_id || ':' || query || ':' || i || ':' || relevant AS key FROM qs CROSS JOIN (SELECT unnest(range(0, {count})) AS i)),
kn AS (SELECT *, ({S.fnv('key')}) AS h, ({S.fnv('key')} % {n})::INT AS k FROM ky),
dec AS (SELECT n.uid, n.qa_id, n.i, n.key, '{prefix}' || n.qa_id || '::' || n.i AS id, {roles} AS role, CASE k {texts} END AS text, d.donor, CASE WHEN d.importance = 0 THEN 0.5 ELSE d.importance END::DOUBLE AS importance
  FROM kn n JOIN dn d ON d.uid = n.uid AND d.place = (n.h % d.c)::INT)"""


def _split(template: str) -> list[str]:
    out, rest = [], template
    while rest:
        found = min((rest.find(m) for m in ("{query}", "{answer}", "{positive}") if m in rest), default=-1)
        if found < 0:
            return out + [rest]
        name = rest[found : rest.index("}", found) + 1]
        out += [rest[:found], name]
        rest = rest[found + len(name) :]
    return out


EVAL_SQL = decoy_sql(4, A.FORENSIC_DECOYS, A.EVAL_FALLBACK, "adversarial_eval::")


def eval_decoys(spark, sf_dir):
    return A.decoy_cards(questions(spark, sf_dir), donors(spark, sf_dir), 4, A.FORENSIC_DECOYS, A.EVAL_FALLBACK, "adversarial_eval::")


@query("p17_decoy_augmentation", S.with_(QUESTIONS, EVAL_SQL) + "SELECT uid, id, role, md5(text) AS text FROM dec")
def p17(spark, sf_dir):
    return eval_decoys(spark, sf_dir).select("uid", "id", "role", F.md5("text").alias("text"))


_legacy = "SELECT * FROM (VALUES " + ", ".join(f"('{t[0]}', {t[2][0]}, {t[2][1]}, {t[2][2]}, '{t[2][3]}', {t[2][4]}::DOUBLE)" for t in A.LEGACY_DECOYS) + ") t(role, age, uses, evidence, outcome, weight)"


@query(
    "p17_legacy_decoys",
    S.with_(QUESTIONS, decoy_sql(4, A.LEGACY_DECOYS, A.EVAL_FALLBACK, "adversarial_eval::"), f"ls AS ({_legacy})")
    + f"SELECT uid, id, role, md5(text) AS text, 'memory' AS cluster, age + ({S.fnv(chr(100) + '.key || ' + chr(39) + ':age' + chr(39))} % 9)::BIGINT AS age_days, uses::BIGINT AS use_count, evidence::BIGINT AS evidence_count, outcome AS last_outcome, weight AS importance FROM dec d JOIN ls USING (role)",
)
def p17_legacy(spark, sf_dir):
    decoys = A.decoy_cards(questions(spark, sf_dir), donors(spark, sf_dir), 4, A.LEGACY_DECOYS, A.EVAL_FALLBACK, "adversarial_eval::")
    return A.legacy_states(decoys, F.lit("memory")).select("uid", "id", "role", F.md5("text").alias("text"), "cluster", "age_days", "use_count", "evidence_count", "last_outcome", "importance")


@query("p16_donor_state", S.with_(QUESTIONS, EVAL_SQL) + "SELECT uid, id, donor, importance FROM dec")
def p16(spark, sf_dir):
    return eval_decoys(spark, sf_dir).select("uid", "id", "donor", "importance")


@query("p27_hard_negative_predicate", S.with_(QUESTIONS, EVAL_SQL) + "SELECT id, true AS hard FROM dec UNION ALL SELECT id, false FROM cards")
def p27(spark, sf_dir):
    both = eval_decoys(spark, sf_dir).select("id").unionByName(records.cards(spark, sf_dir).select("id"))
    return both.select("id", A.is_hard_negative(F.col("id")).alias("hard"))


_families = A.pick_families(A.TRAINING_DECOYS, exclude={"answer_shaped"})
TRAIN_SQL = decoy_sql(3, _families, A.TRAINING_FALLBACK, "synthetic_hard_negative::")


def training_decoys(spark, sf_dir):
    base = A.decoy_cards(questions(spark, sf_dir), donors(spark, sf_dir), 3, _families, A.TRAINING_FALLBACK, "synthetic_hard_negative::")
    return A.training_labels(base, 8.0, 4.0)


TRAIN = TRAIN_SQL + f""",
trn AS (SELECT *, 1 + ({S.fnv("key || ':rank'")} % 16)::BIGINT AS base_rank, 0.65::DOUBLE + 0.30::DOUBLE * ({S.fnv("key || ':score'")} % 1000)::DOUBLE / 1000.0::DOUBLE AS base_score FROM dec)"""


@query("p18_hard_negative_training_rows", S.with_(QUESTIONS, TRAIN) + "SELECT uid, id, role, md5(text) AS text, base_rank, round(base_score, 6) AS base_score, 0.0::DOUBLE AS include_label, 8.0::DOUBLE AS include_weight, 4.0::DOUBLE AS label_weight FROM trn")
def p18(spark, sf_dir):
    return rounded(training_decoys(spark, sf_dir).select("uid", "id", "role", F.md5("text").alias("text"), "base_rank", "base_score", "include_label", "include_weight", "label_weight"))


CALIBRATED = ",\n".join(
    [
        RQ.PAIRS, QUESTIONS.split(RQ.REL + ",\n", 1)[1], TRAIN,
        f"sp AS (SELECT * FROM ({S.ranked(f'(SELECT q, id, {RQ.SPARSE} AS score FROM pairs)')}) WHERE rank <= 6)",
        """pl AS (SELECT s.q, s.id, s.rank AS base_rank, s.score AS base_score, (r.id IS NOT NULL)::INT::DOUBLE AS include_label, CASE WHEN r.id IS NOT NULL THEN 1.0 ELSE greatest(1.0, 8.0 / least(greatest(rank, 1), 32)) END::DOUBLE AS include_weight, r.id IS NOT NULL AS forced, 0 AS part
           FROM sp s LEFT JOIN rel r ON r.q = s.q AND r.id = s.id)""",
        "hd AS (SELECT q, count(*) AS held FROM sp GROUP BY q)",
        "ls AS (SELECT r.q, r.id, row_number() OVER (PARTITION BY r.q ORDER BY r.id) AS n FROM rel r ANTI JOIN pl p ON p.q = r.q AND p.id = r.id)",
        """al AS (SELECT * FROM pl UNION ALL SELECT l.q, l.id, 7, -1.0, 1.0, 1.0, true, 1 FROM ls l LEFT JOIN hd USING (q) WHERE coalesce(held, 0) + n <= greatest(6, coalesce(held, 0) + 1)
           UNION ALL SELECT uid, id, base_rank, base_score, 0.0, 8.0, true, 2 FROM trn)""",
        "cp AS (SELECT *, max(base_score) OVER (PARTITION BY q) - base_score AS gap, row_number() OVER (PARTITION BY q ORDER BY forced DESC, part, base_rank, id) AS slot FROM al)",
    ]
)


def calibrated(spark, sf_dir):
    ranked = B.sparse_ranked(records.pairs(spark, sf_dir))
    decoys = training_decoys(spark, sf_dir).withColumnRenamed("uid", "q")
    return A.calibration_rows(ranked, records.relevance(spark, sf_dir), decoys, 6, 8.0)


@query("p19_calibration_rows", S.with_(CALIBRATED) + "SELECT q, id, base_rank::BIGINT AS base_rank, round(base_score, 6) AS base_score, include_label, round(include_weight, 6) AS include_weight, round(gap, 6) AS gap FROM cp WHERE slot <= 6")
def p19(spark, sf_dir):
    return rounded(calibrated(spark, sf_dir).select("q", "id", F.col("base_rank").cast("bigint").alias("base_rank"), "base_score", "include_label", "include_weight", "gap"))


@query("p20_priority_cap", S.with_(RQ.PAIRS) + "SELECT q, id, slot FROM (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY protected DESC, pos, id) AS slot FROM pairs) WHERE slot <= 3")
def p20(spark, sf_dir):
    rows = records.cards(spark, sf_dir).select("q", "id", "pos", F.col("protected").alias("forced"))
    return A.priority_cap(rows, 3, ("pos", "id")).select("q", "id", F.col("slot").cast("bigint").alias("slot"))


@query(
    "p21_entity_profile_cards",
    S.with_(QUESTIONS, "n AS (SELECT r.q, c.id, c.text, row_number() OVER (PARTITION BY r.q ORDER BY c.id) AS n FROM rel r JOIN cards c USING (q, id))")
    + """SELECT q AS uid, 'entity_profile::' || q AS id, md5('Entity profile for ' || q || '. Current facts and preferences with provenance:' || chr(10) || string_agg('- ' || id || ': ' || substr(replace(text, chr(10), ' '), 1, 180), chr(10) ORDER BY n)) AS text,
      count(*) AS evidence_count, string_agg(id, ',' ORDER BY n) AS provenance FROM n WHERE n <= 24 GROUP BY q""",
)
def p21(spark, sf_dir):
    return profiles(spark, sf_dir).select("uid", "id", F.md5("text").alias("text"), "evidence_count", F.array_join("provenance", ",").alias("provenance"))


def record_cards(spark, sf_dir):
    return records.cards(spark, sf_dir).withColumnRenamed("q", "uid")


def profiles(spark, sf_dir):
    return C.entity_profiles(record_cards(spark, sf_dir), records.relevance(spark, sf_dir).withColumnRenamed("q", "uid"))


_roles = ", ".join(lit(r) for r in C.BLOCKER_ROLES)
BLOCKERS = f"""bd AS (SELECT uid, qa_id, list(id ORDER BY id) AS ids, list(substr(text, 1, 120) ORDER BY id) AS ts FROM dec WHERE role IN ({_roles}) GROUP BY ALL),
sr AS (SELECT r.q AS uid, list(c.id ORDER BY c.id) AS ids, list(substr(c.text, 1, 160) ORDER BY c.id) AS ts FROM rel r JOIN cards c USING (q, id) GROUP BY r.q),
blk AS (SELECT b.uid, b.qa_id, 'anti_memory::' || b.qa_id AS id, 'Anti-memory for ' || b.qa_id || '. Do not use blocked memories: ' || array_to_string(b.ids[1:8], ', ') || '. They are superseded or wrong-time context. Use provenance instead: '
  || array_to_string(s.ts[1:3], ' | ') || '. Blocked text: ' || array_to_string(b.ts[1:3], ' | ') AS text, b.ids AS blocked, s.ids AS provenance FROM bd b JOIN sr s USING (uid))"""


def blockers(spark, sf_dir):
    rel = records.relevance(spark, sf_dir).select(F.col("q").alias("uid"), F.concat(F.lit("qa"), F.col("q").cast("string")).alias("qa_id"), "id")
    return C.blocker_cards(eval_decoys(spark, sf_dir), rel, record_cards(spark, sf_dir))


@query("p22_anti_memory_cards", S.with_(QUESTIONS, EVAL_SQL, BLOCKERS) + "SELECT uid, id, md5(text) AS text, array_to_string(blocked, ',') AS blocked, array_to_string(provenance, ',') AS provenance FROM blk")
def p22(spark, sf_dir):
    return blockers(spark, sf_dir).select("uid", "id", F.md5("text").alias("text"), F.array_join("blocked", ",").alias("blocked"), F.array_join("provenance", ",").alias("provenance"))


@query(
    "p23_derived_card_edges",
    S.with_(QUESTIONS, EVAL_SQL, BLOCKERS)
    + """SELECT q AS uid, 'entity_profile::' || q AS source, id AS target, 'provenance' AS type, 0.7::DOUBLE AS weight FROM (SELECT r.q, r.id, row_number() OVER (PARTITION BY r.q ORDER BY r.id) AS n FROM rel r) WHERE n <= 24
      UNION ALL SELECT uid, id, unnest(provenance), 'provenance', 0.7 FROM blk UNION ALL SELECT uid, id, unnest(blocked), 'correction', 0.88 FROM blk""",
)
def p23(spark, sf_dir):
    names = ["uid", "id", "provenance", "blocked"]
    derived = profiles(spark, sf_dir).select(*names).unionByName(blockers(spark, sf_dir).select(*names))
    known = record_cards(spark, sf_dir).select("uid", "id").unionByName(eval_decoys(spark, sf_dir).select("uid", "id"))
    return C.derived_edges(derived, known).select("uid", "source", "target", "type", "weight")


def growth_sql(scenario: str, count: int, seed: int) -> str:
    i = "i::VARCHAR"
    d = lambda name, n: f"({S.fnv(f'{lit(f'{seed}:{name}:')} || {i}')} % {n})::BIGINT"
    project, topic = pick_sql(A.GROWTH_PROJECTS, f"'{seed}:unrelated:project:' || {i}"), pick_sql(A.GROWTH_TOPICS, f"'{seed}:unrelated:topic:' || {i}")
    outcome = pick_sql(["", "", "helpful", "ignored"], f"'{seed}:outcome:' || {i}")
    spec = {
        "unrelated": (f"{project} || ': unrelated growth memory {seed}-' || i || ' about ' || {topic} || '; no current escalation path applies.'", "hard_unrelated", d("age", 180), d("use", 9), d("ev", 4), outcome, f"0.25 + 0.25 * {d('imp', 100)} / 100.0"),
        "semantic_decoy": (f"query || ' Candidate branch {seed}-' || i || ' repeats the route words, but it is a decoy: do not use it as the accepted resolution.'", "hard_semantic_decoy", "1 + i % 7", "18 + i % 13", "6 + i % 5", "CASE WHEN i % 2 = 1 THEN 'ignored' ELSE 'corrected' END", "0.72"),
        "conflict": (f"query || ' Conflict record {seed}-' || i || ': older note resembles the accepted path, but contradicts it. Relevant path said: ' || substr(positive, 1, 180) || '. This record is superseded.'", "hard_conflict", "220 + i % 180", "CASE WHEN i % 3 <> 0 THEN 0 ELSE 2 END", "CASE WHEN i % 2 <> 0 THEN 0 ELSE 1 END", "'ignored'", "0.38"),
        "repeated": (f"'Repeated insert copy {seed}-' || i || ': ' || CASE WHEN len(bases) > 0 THEN bases[(i % len(bases))::INT + 1] ELSE query END || ' This is a repeated non-authoritative duplicate.'", "hard_repeated", "0", "1", "0", "''", "0.44"),
    }
    text, name, age, use, ev, out, imp = spec[scenario]
    return f"SELECT uid AS q, '{name}_{seed}_' || i AS id, md5({text}) AS text, ({age})::BIGINT AS age_days, ({use})::BIGINT AS use_count, ({ev})::BIGINT AS evidence_count, {out} AS last_outcome, round(({imp})::DOUBLE, 6) AS importance FROM cs CROSS JOIN (SELECT unnest(range(0, {count})) AS i)"


CASES = QUESTIONS + """,
bs AS (SELECT r.q AS uid, list(c.text ORDER BY c.id) AS bases FROM rel r JOIN cards c USING (q, id) GROUP BY r.q),
cs AS (SELECT s.uid, s.query, s.positive, coalesce(b.bases, []) AS bases FROM qs s LEFT JOIN bs b USING (uid))"""


@query("p24_growth_augmentation", S.with_(CASES) + " UNION ALL ".join(growth_sql(s, n, 7) for s, n in (("unrelated", 2), ("semantic_decoy", 2), ("conflict", 2), ("repeated", 3))))
def p24(spark, sf_dir):
    cases = questions(spark, sf_dir).select(F.col("uid").alias("q"), "query", "positive", "bases", F.lit("user").alias("project"))
    out = A.growth_cards(cases, "combined", 9, 7)
    return rounded(out.select("q", "id", F.md5("text").alias("text"), "age_days", "use_count", "evidence_count", "last_outcome", "importance"))


DOMAINS = {"user_id": [f"user_{n}" for n in range(13)], "project": [f"src{n}" for n in range(20)], "brand": list(tables.LANGS)}


def wrong_sql(field: str, short: str) -> str:
    others = f"list_filter([{', '.join(lit(v) for v in DOMAINS[field])}], lambda v: v <> {field})"
    key = S.fnv(f"'5:wrong_{short}:' || id")
    return f"({others})[({key} % len({others}))::INT + 1]"


@query(
    "p25_metadata_degradation",
    S.with_(
        S.MEM,
        f"""rl AS (SELECT *, ({S.fnv("'5:metadata_keep:' || id")} % 1000000)::DOUBLE / 1e6 >= 0.7 AS dropped, ({S.fnv("'5:metadata_wrong:' || id")} % 1000000)::DOUBLE / 1e6 < 0.3 AS w,
          {wrong_sql('user_id', 'user')} AS wu, {wrong_sql('project', 'project')} AS wp, {wrong_sql('brand', 'brand')} AS wb FROM mem)""",
    )
    + f"""SELECT id, CASE WHEN dropped THEN '' WHEN w THEN wu ELSE user_id END AS user_id, CASE WHEN dropped THEN '' WHEN w THEN wp ELSE project END AS project, CASE WHEN dropped THEN '' WHEN w THEN wb ELSE brand END AS brand,
      CASE WHEN dropped THEN '' WHEN w THEN wu || '_' || wp || '_corrupt_' || lpad(({S.fnv('id::VARCHAR')} % 100000)::VARCHAR, 5, '0') ELSE 'sess_' || (id % 9) END AS session_id, CASE WHEN NOT dropped AND w THEN wp ELSE cluster END AS cluster, dropped, NOT dropped AND w AS falsified FROM rl""",
)
def p25(spark, sf_dir):
    cards = tables.memories(spark, sf_dir).select("id", "user_id", "project", "brand", F.concat(F.lit("sess_"), (F.col("id") % 9).cast("string")).alias("session_id"), "cluster")
    return A.degrade_metadata(cards, DOMAINS, 0.7, 0.3, 5)


def _draw(name: str, n: int = 1_000_000) -> str:
    return f"({S.fnv(f'{lit(f'11:{name}:')} || id')} % {n})::BIGINT"


def _choice(name: str, values: list) -> str:
    return f"([{', '.join(lit(v) if isinstance(v, str) else str(v) for v in values)}])[{_draw(name, len(values))} + 1]"


@query(
    "p26_state_perturbation",
    S.with_(
        S.MEM,
        f"""m AS (SELECT 'mild' AS mode, id, {_draw('hit')} / 1e6 < 0.5 AS hit, floor(round(use_count * (0.4 + 1.4 * {_draw('use')} / 1e6), 9))::BIGINT AS u, floor(round(evidence_count * (0.5 + 1.2 * {_draw('evidence')} / 1e6), 9))::BIGINT AS e,
          least(0.95, greatest(0.05, CASE WHEN importance = 0 THEN 0.5 ELSE importance END - 0.18 + 0.36 * {_draw('importance')} / 1e6))::DOUBLE AS i, CASE WHEN {_draw('flip')} / 1e6 < 0.35 THEN {_choice('outcome', ['', 'helpful', 'ignored', 'corrected'])} ELSE last_outcome END AS o, age_days AS a, use_count, evidence_count, importance, last_outcome, age_days FROM mem)""",
        f"""s AS (SELECT 'strong' AS mode, id, {_draw('hit')} / 1e6 < 0.5 AS hit, {_choice('use', [0, 0, 1, 5, 21, 89, 144])}::BIGINT AS u, {_choice('evidence', [0, 1, 3, 8, 21, 55])}::BIGINT AS e, {_choice('importance', [0.08, 0.18, 0.35, 0.65, 0.82, 0.94])}::DOUBLE AS i,
          {_choice('outcome', ['', 'helpful', 'ignored', 'corrected'])} AS o, CASE WHEN {_draw('flip')} / 1e6 < 0.2 THEN {_choice('age', [0, 1, 14, 180, 365, 720])} ELSE age_days END::BIGINT AS a, use_count, evidence_count, importance, last_outcome, age_days FROM mem)""",
    )
    + " UNION ALL ".join(
        f"SELECT mode, id, hit AS perturbed, CASE WHEN hit THEN u ELSE use_count END AS use_count, CASE WHEN hit THEN e ELSE evidence_count END AS evidence_count, round(CASE WHEN hit THEN i ELSE importance END, 6)::DOUBLE AS importance, CASE WHEN hit THEN o ELSE last_outcome END AS last_outcome, CASE WHEN hit THEN a ELSE age_days END AS age_days FROM {t}"
        for t in ("m", "s")
    ),
)
def p26(spark, sf_dir):
    cards = tables.memories(spark, sf_dir).select("id", "use_count", "evidence_count", "importance", "last_outcome", "age_days")
    parts = [A.perturb_state(cards, mode, 0.5, 11).withColumn("mode", F.lit(mode)) for mode in ("mild", "strong")]
    return rounded(parts[0].unionByName(parts[1]))


MINED = ",\n".join(
    [
        RQ.PAIRS, "oth AS (SELECT p.q, p.id, row_number() OVER (PARTITION BY p.q ORDER BY round(p.semantic, 9) DESC, p.id) AS n FROM pairs p ANTI JOIN rel r ON r.q = p.q AND r.id = p.id)",
        f"rs AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY {S.signed(S.fnv(chr(39) + '3:' + chr(39) + ' || q || ' + chr(39) + ':' + chr(39) + ' || id'))}, id) AS k FROM oth WHERE n > 2)",
        "ng AS (SELECT q, id, 'hard' AS kind FROM oth WHERE n <= 2 UNION ALL SELECT q, id, 'random' FROM rs WHERE k <= 1)",
        "mn AS (SELECT q, id, 'positive' AS kind FROM rel UNION ALL SELECT * FROM ng)",
    ]
)


def mined(spark, sf_dir):
    scored = records.pairs(spark, sf_dir).select("q", "id", F.col("semantic").alias("score"))
    return A.mined_negatives(scored, records.relevance(spark, sf_dir), 2, 1, 3)


@query("p14_mined_negatives", S.with_(MINED) + "SELECT * FROM mn WHERE q IN (SELECT q FROM rel) AND q IN (SELECT q FROM ng)")
def p14(spark, sf_dir):
    return mined(spark, sf_dir)


@query(
    "p13_triplet_rows",
    S.with_(
        MINED, "pl AS (SELECT r.q, list(c.text ORDER BY c.id) AS p FROM rel r JOIN cards c USING (q, id) GROUP BY r.q)", "nl AS (SELECT n.q, list(c.text ORDER BY c.id) AS n FROM ng n JOIN cards c USING (q, id) GROUP BY n.q)",
        "ex AS (SELECT t.q, t.query, pl.p, nl.n, i, o FROM task t JOIN pl USING (q) JOIN nl USING (q) CROSS JOIN (SELECT unnest(range(0, 64)) AS i) CROSS JOIN (SELECT unnest(range(0, 2)) AS o) WHERE i < len(pl.p))",
    )
    + r"SELECT q, i::BIGINT AS p, o::BIGINT AS o, md5(trim(regexp_replace(query, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS anchor, md5(trim(regexp_replace(p[i + 1], '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS positive, md5(trim(regexp_replace(n[((i * 2 + o) % len(n))::INT + 1], '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS negative FROM ex",
)
def p13(spark, sf_dir):
    texts = records.cards(spark, sf_dir).select("q", "id", "text")
    rows = mined(spark, sf_dir).join(texts, ["q", "id"])

    def listed(condition, name):
        kept = rows.where(condition).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("l"))
        return kept.select("q", F.transform("l", lambda x: x["text"]).alias(name))

    sides = listed(F.col("kind") == "positive", "positives").join(listed(F.col("kind") != "positive", "negatives"), "q")
    out = X.triplets(records.tasks(spark, sf_dir).select("q", "query").join(sides, "q"), 2)
    return out.select("q", F.col("p").cast("bigint").alias("p"), F.col("o").cast("bigint").alias("o"), F.md5("anchor").alias("anchor"), F.md5("positive").alias("positive"), F.md5("negative").alias("negative"))


# Export items: benchmark passages as queries, every document as evidence, hard or background item under an id of its own.
# Of five documents one is evidence, two are hard and two are background; numbers inside ids go round the queries. Splits are
# shares: the first 40 % of the queries and their items train, 50 to 90 % are held out; 60 % and 30 % of the background.
def export_items(spark, sf_dir):
    n = F.col("id")
    asked = tables.queries(spark, sf_dir)
    count, last = asked.count(), tables.card_texts(spark, sf_dir).agg(F.max("id")).first()[0] or 0
    around = max(1, count)
    fifth = F.floor(n / 5).cast("bigint")
    place = fifth * 2 + n % 5 - 1

    def named(kind, number):
        return F.concat(F.lit(f"{kind}::"), (number % around).cast("string"), F.lit("::"), F.floor(number / around).cast("string"))

    name = F.when(n % 5 == 0, named("evidence", fifth)).when(n % 5 < 3, named("hard", place)).otherwise(F.concat(F.lit("background::"), n.cast("string")))
    items = tables.memories(spark, sf_dir).select("id", name.alias("item_id"), "text", "last_outcome")
    asked = asked.select(F.col("q").alias("id"), F.concat(F.lit("query::"), F.col("q").cast("string")).alias("item_id"), "text", F.lit("helpful").alias("last_outcome"))
    bounds = (count * 4 // 10, count * 5 // 10, count * 4 // 10, (last + 1) * 6 // 10, (last + 1) * 3 // 10)
    return asked.unionByName(items).select("*", X.item_kind(F.col("item_id")).alias("kind"), X.item_split(F.col("item_id"), *bounds).alias("split"))


ITEMS = """bnd AS (SELECT (SELECT count(*) FROM benchmark) AS c, (SELECT max(doc_id) + 1 FROM documents) AS l),
it AS (SELECT id, text, last_outcome, CASE WHEN id % 5 = 0 THEN 'evidence::' || ((id // 5) % c) || '::' || ((id // 5) // c) WHEN id % 5 < 3 THEN 'hard::' || (((id // 5) * 2 + id % 5 - 1) % c) || '::' || (((id // 5) * 2 + id % 5 - 1) // c)
  ELSE 'background::' || id END AS item_id FROM mem, bnd),
ei AS (SELECT q AS id, 'query::' || q AS item_id, text, 'helpful' AS last_outcome, 'query' AS kind, q AS ix FROM qry UNION ALL SELECT id, item_id, text, last_outcome, CASE WHEN item_id LIKE 'evidence%' THEN 'evidence' WHEN item_id LIKE 'hard%' THEN 'hard_negative' ELSE 'background' END,
  split_part(item_id, '::', 2)::BIGINT FROM it),
es AS (SELECT ei.*, CASE WHEN kind = 'background' THEN CASE WHEN ix < l * 6 // 10 THEN 'train' WHEN ix < l * 6 // 10 + l * 3 // 10 THEN 'holdout' ELSE 'unused' END
  ELSE CASE WHEN ix < c * 4 // 10 THEN 'train' WHEN ix >= c * 5 // 10 AND ix < c * 5 // 10 + c * 4 // 10 THEN 'holdout' ELSE 'unused' END END AS split FROM ei, bnd)"""


def cached_fields(items):
    """Predictions from the outcome column; items without an outcome have none cached."""
    one = F.array(F.struct(F.lit("outcome").alias("field_name"), F.col("last_outcome").alias("value"), F.lit(0.9).alias("confidence")))
    return items.select("item_id", F.when(F.col("last_outcome") != "", one).alias("fields"))


@query("p10_field_label_and_chat_rows", S.with_(S.MEM, S.QRY, ITEMS) + "SELECT split, kind, item_id, md5('{\"fields\":[{\"field_name\":\"outcome\",\"value\":\"' || last_outcome || '\",\"confidence\":0.9}]}') AS answer FROM es WHERE split <> 'unused' AND last_outcome <> ''")
def p10(spark, sf_dir):
    from memjoin.operators.fields import seed_registry

    items = export_items(spark, sf_dir)
    labels = X.label_rows(items, cached_fields(items), "v1")
    chats = X.chat_rows(labels, "You label memory fields.", X.prompt(items, seed_registry(spark)))
    return chats.select("metadata.split", "metadata.kind", "metadata.item_id", F.md5(F.get("messages", F.lit(2))["content"]).alias("answer"))


PAIRS = ITEMS + """,
rp AS (SELECT e.split, 'query::' || e.id AS query_id, e.id AS qx, m.item_id AS candidate_id, true AS ev FROM es e JOIN rel r ON r.q = e.id JOIN it m ON m.id = r.id WHERE e.kind = 'query' AND e.split <> 'unused'
  UNION ALL SELECT e.split, 'query::' || e.id, e.id, m.item_id, false FROM es e JOIN it m ON m.item_id LIKE 'hard::' || e.ix || '::%' AND coalesce(TRY_CAST(split_part(m.item_id, '::', 3) AS BIGINT), 99) < 12 WHERE e.kind = 'query' AND e.split <> 'unused')"""


def pair_rows(spark, sf_dir):
    items = export_items(spark, sf_dir)
    ids = tables.relevance(spark, sf_dir).join(items.where(F.col("kind") != "query").select("id", "item_id"), "id").groupBy("q").agg(F.array_sort(F.collect_set("item_id")).alias("relevant_ids"))
    asked = items.where(F.col("kind") == "query").join(ids, items["id"] == ids["q"], "left").select(
        F.col("item_id").alias("query_id"), X.query_index(F.col("item_id")).alias("query_index"), "split", "text", F.coalesce("relevant_ids", F.array().cast("array<string>")).alias("relevant_ids")
    )
    return X.retrieval_pairs(asked, items.where(F.col("kind") != "query").select(F.col("item_id").alias("id"), "text"), "v1")


@query(
    "p11_retrieval_pair_rows",
    S.with_(S.MEM, S.QRY, S.REL, PAIRS) + "SELECT split, query_id, candidate_id, bool_or(ev) AS is_evidence, bool_or(ev)::INT::DOUBLE AS include_label FROM rp GROUP BY ALL",
)
def p11(spark, sf_dir):
    return pair_rows(spark, sf_dir).select("split", "query_id", "candidate_id", "is_evidence", "include_label").distinct()


@query("s5_split_dataset_export", S.with_(S.MEM, S.QRY, ITEMS) + "SELECT split, kind, count(*) AS n FROM es WHERE split <> 'unused' AND last_outcome <> '' GROUP BY ALL")
def s5(spark, sf_dir):
    """Label rows written once, partitioned by split; the manifest counts come from what was written."""
    items = export_items(spark, sf_dir)
    path = scratch(spark, "export")
    X.label_rows(items, cached_fields(items), "v1").write.partitionBy("split").json(path)
    back = spark.read.schema("split string, kind string, item_id string").json(path)
    return back.groupBy("split", "kind").agg(F.count(F.lit(1)).alias("n"))


SUM = "sum(('0x' || substr(md5({key}), 1, 8))::BIGINT)::BIGINT AS checksum"
LABELLED = "lb AS (SELECT split, kind, item_id FROM es WHERE split <> 'unused' AND last_outcome <> '' AND text <> '')"
_label, _pair = SUM.format(key="split || '|' || kind || '|' || item_id"), SUM.format(key="split || '|' || query_id || '|' || candidate_id || '|' || ev")


@query(
    "s5_seven_datasets",
    S.with_(S.MEM, S.QRY, S.REL, PAIRS, LABELLED, "pd AS (SELECT split, query_id, candidate_id, bool_or(ev) AS ev FROM rp GROUP BY split, query_id, candidate_id)")
    + f"""SELECT 'field_labels_all' AS dataset, count(*) AS rows, {_label} FROM lb UNION ALL SELECT 'field_labels_' || split, count(*), {_label} FROM lb GROUP BY split
UNION ALL SELECT 'sft_' || split, count(*), {_label} FROM lb GROUP BY split UNION ALL SELECT 'retrieval_pairs_' || split, count(*), {_pair} FROM pd GROUP BY split""",
)
def s5_seven(spark, sf_dir):
    """Field labels, chat rows and retrieval pairs written by split; rows and checksums of the seven datasets from the manifest."""
    from memjoin.operators.fields import seed_registry

    items = export_items(spark, sf_dir)
    labels = X.label_rows(items, cached_fields(items), "v1")
    chats = X.chat_rows(labels, "You label memory fields.", X.prompt(items, seed_registry(spark)))
    pairs = pair_rows(spark, sf_dir).dropDuplicates(["split", "query_id", "candidate_id"])
    manifest = X.export_datasets({"field_labels": labels, "sft": chats, "retrieval_pairs": pairs}, scratch(spark, "datasets"), "v1")
    return manifest.select("dataset", "rows", "checksum")

"""Source, sink and record flattening queries.

Files are written under a fresh folder of the shared scratch path and read back, so every query starts from the supplied
tables and its work grows with them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from memjoin.functions.text import tokens
from memjoin.operators import cards as C
from memjoin.operators import exports as X
from memjoin.operators import fields as P
from memjoin.plans import sqltext as S
from memjoin.plans.registry import query
from memjoin.session import cut_lineage, scratch_dir
from memjoin.sources import caches, jsonl, tables


def scratch(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def turn_lines(spark, sf_dir):
    return tables.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("uid"), "turn", "role", "text")


RECORDS_A_FILE = 200
TURN_SCHEMA = "role string, text string, turn bigint, uid bigint"


@query("s1_jsonl_scan", "SELECT conv_id AS uid, turn, role, text FROM conversations")
def s1(spark, sf_dir):
    path = scratch(spark, "scan")
    jsonl.write(turn_lines(spark, sf_dir), path)
    return jsonl.scan(spark, path, TURN_SCHEMA).select("uid", "turn", "role", "text")


def ordered_files(rows, path, *order):
    """`rows` as JSON lines in several files of different size whose path order is `order`."""
    jsonl.write(rows.repartitionByRange(6, *order).sortWithinPartitions(*order), path)


@query("s1_jsonl_limit", "SELECT conv_id AS uid, turn, role, text FROM conversations ORDER BY conv_id * conv_id % 97, conv_id, turn LIMIT 150")
def s1_limit(spark, sf_dir):
    """The first records, in file order, of files that Spark would read largest first."""
    path = scratch(spark, "scan")
    rows = turn_lines(spark, sf_dir).withColumn("k", F.col("uid") * F.col("uid") % 97)
    ordered_files(rows, path, "k", "uid", "turn")
    return jsonl.scan(spark, path, f"{TURN_SCHEMA}, k bigint", limit=150).select("uid", "turn", "role", "text")


@query("s3_slice", "SELECT doc_id, n - 1 AS pos FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS n FROM documents) WHERE n > 40 AND n <= 140 AND doc_id % 9 <> 2")
def s3_slice(spark, sf_dir):
    """Lines 40 to 139 of several files; broken lines keep their number and are left out."""
    n = F.col("doc_id").cast("string")
    line = F.when(F.col("doc_id") % 9 == 2, F.concat(F.lit('{"doc_id":'), n)).otherwise(F.concat(F.lit('{"doc_id":'), n, F.lit("}")))
    path = scratch(spark, "slice")
    rows = tables.table(spark, sf_dir, "documents").select("doc_id", "n_chars", line.alias("value"))
    rows.repartitionByRange(5, "n_chars", "doc_id").sortWithinPartitions("n_chars", "doc_id").select("value").write.text(path)
    kept = jsonl.require_kept(jsonl.sanitized(jsonl.scan_text_lines(spark, path), "doc_id bigint", offset=40, limit=100))
    return kept.select("record.doc_id", "pos")


@query("s10_split_over_files", "SELECT uid, turn, CASE WHEN n <= floor((SELECT count(*) FROM conversations) * 0.8) THEN 'train' ELSE 'eval' END AS split FROM (SELECT conv_id AS uid, turn, row_number() OVER (ORDER BY turn DESC, conv_id) AS n FROM conversations)")
def s10_files(spark, sf_dir):
    path = scratch(spark, "split")
    rows = turn_lines(spark, sf_dir).select("uid", "turn", (-F.col("turn")).alias("k"))
    ordered_files(rows, path, "k", "uid")
    placed = jsonl.file_numbered(jsonl.scan(spark, path, "uid bigint, turn bigint, k bigint"))
    return jsonl.ordered_split(placed, 0.8).select("uid", "turn", "split")


@query("s4_jsonl_sink", """SELECT '{"role":"' || role || '","text":' || to_json(text) || ',"turn":' || turn || ',"uid":' || conv_id || '}' AS line FROM conversations""")
def s4(spark, sf_dir):
    path = scratch(spark, "sink")
    jsonl.write(turn_lines(spark, sf_dir), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(
    "s2_polymorphic_item_scan",
    "SELECT conv_id AS uid, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN text ELSE 'q' || turn END AS item_text FROM conversations",
)
def s2(spark, sf_dir):
    """Turns split over three layouts: JSON lines with `text`, JSON lists with `content`, and `{memories, queries}` with `query`; a
    file of the last two holds a slice of the records."""
    rows = turn_lines(spark, sf_dir).withColumn("slice", F.floor(F.col("uid") / RECORDS_A_FILE))
    schema = "uid bigint, turn bigint, text string, content string, query string"
    kind = F.col("turn") % 3
    lines, listed, held = scratch(spark, "lines"), scratch(spark, "list"), scratch(spark, "held")
    rows.where(kind == 0).select(F.to_json(F.struct("text", "turn", "uid")).alias("value")).write.text(lines)
    item = F.struct(F.col("text").alias("content"), "turn", "uid")
    rows.where(kind == 1).groupBy("slice").agg(F.to_json(F.collect_list(item)).alias("value")).repartition(20, "slice").select("value").write.partitionBy().option("maxRecordsPerFile", 1).text(listed)
    ask = F.collect_list(F.struct(F.concat(F.lit("q"), "turn").alias("query"), "turn", "uid"))
    rows.where(kind == 2).groupBy("slice").agg(F.to_json(F.struct(F.array().cast("array<string>").alias("memories"), ask.alias("queries"))).alias("value")).repartition(20, "slice").select("value").write.option("maxRecordsPerFile", 1).text(held)
    out = None
    for path in (lines, listed, held):
        part = jsonl.polymorphic_items(spark, path, schema).select("uid", "turn", "item_text")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "s3_sanitize_and_slice",
    "SELECT doc_id, (doc_id % 7 <> 3) AS kept, CASE WHEN doc_id % 7 = 3 THEN '' WHEN doc_id % 5 = 0 THEN 'bad \\u12 escape' ELSE lang END AS note FROM documents WHERE doc_id % 11 <> 4",
)
def s3(spark, sf_dir):
    """A text file with repairable escapes, broken lines and blank lines, one line per document."""
    n = F.col("doc_id")
    note = F.when(n % 5 == 0, F.lit("bad \\u12 escape")).otherwise(F.col("lang"))
    good = F.concat(F.lit('{"doc_id":'), n.cast("string"), F.lit(',"note":"'), note, F.lit('"}'))
    line = F.when(n % 11 == 4, "").when(n % 7 == 3, F.concat(F.lit('{"doc_id":'), n.cast("string"), F.lit(',"note":'))).otherwise(good)
    path = scratch(spark, "dirty")
    tables.table(spark, sf_dir, "documents").select(line.alias("value")).write.text(path)
    rows = jsonl.sanitized(jsonl.scan_text_lines(spark, path), "doc_id bigint, note string")
    number = F.regexp_extract("line", r'"doc_id":(\d+)', 1).cast("bigint")
    return rows.select(number.alias("doc_id"), "kept", F.when(F.col("kept"), F.col("record.note")).otherwise("").alias("note"))


@query(
    "s3_kept_counts",
    "SELECT count_if(doc_id % 7 <> 3)::BIGINT AS kept, count_if(doc_id % 7 = 3)::BIGINT AS skipped FROM documents",
)
def s3_counts(spark, sf_dir):
    n = F.col("doc_id")
    body = F.concat(F.lit('{"doc_id":'), n.cast("string"))
    line = F.when(n % 7 == 3, F.concat(body, F.lit(','))).otherwise(F.concat(body, F.lit("}")))
    path = scratch(spark, "dirty")
    tables.table(spark, sf_dir, "documents").select(line.alias("value")).write.text(path)
    return jsonl.kept_counts(jsonl.sanitized(jsonl.scan_text_lines(spark, path), "doc_id bigint"))


@query(
    "s6_audit_append",
    """WITH x AS (SELECT conv_id || '_' || turn AS item_id, turn, role, turn % 2 AS odd, conv_id FROM conversations)
    SELECT item_id, row_number() OVER (PARTITION BY odd ORDER BY conv_id, turn) - 1 AS index, 1 + odd::BIGINT AS prediction_count, role AS first_value,
      sha256('{"cache_key_mode":"stable-text-v1","prompt_version":"field-classifier-v1","text":"' || item_id || ' ' || role || '"}') AS cache_key FROM x""",
)
def s6(spark, sf_dir):
    """Audit rows appended in two runs, the even turns and then the odd ones, each row with its place in the run and its cache key."""
    path = scratch(spark, "audit")
    one = F.struct(F.lit("speaker").alias("field_name"), F.col("role").alias("value"), F.lit(0.9).alias("confidence"))
    for odd in (0, 1):
        run = cut_lineage(turn_lines(spark, sf_dir).where(F.col("turn") % 2 == odd).orderBy("uid", "turn"))
        listed = F.array_repeat(one, odd + 1)
        rows = jsonl.numbered(run).select(
            F.concat_ws("_", "uid", "turn").alias("item_id"), F.col("pos").alias("index"), P.stable_key(F.concat_ws(" ", F.concat_ws("_", "uid", "turn"), "role")).alias("cache_key"),
            F.size(listed).cast("bigint").alias("prediction_count"), listed.alias("predictions"),
        )
        rows.write.mode("append").json(path)
    back = spark.read.schema("item_id string, index bigint, cache_key string, prediction_count bigint, predictions array<struct<field_name:string,value:string,confidence:double>>").json(path)
    return back.select("item_id", "index", "cache_key", "prediction_count", F.get("predictions", F.lit(0))["value"].alias("first_value"))


@query(
    "s7_prediction_cache",
    "SELECT user_id AS key, arg_max(value, event_id) AS value, max(event_id) AS version FROM events GROUP BY user_id",
)
def s7(spark, sf_dir):
    """Cache put twice: the first half of the events, then the second half; the latest put of a key wins."""
    rows = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "value", F.col("event_id").alias("version"))
    newest = F.max_by(F.struct("value", "version"), "version").alias("n")

    def latest(df):
        return df.groupBy("key").agg(newest).select("key", "n.value", "n.version")

    middle = rows.agg(F.max("version") / 2).scalar()
    path = scratch(spark, "cache")
    latest(rows.where(F.col("version") <= middle)).write.parquet(path)
    return caches.upsert(spark.read.parquet(path), latest(rows.where(F.col("version") > middle)), "key", "version")


@query("s10_ordered_split", "SELECT split, count(*) AS n, min(item_id) AS first, max(item_id) AS last FROM (SELECT item_id, CASE WHEN item_id < floor((SELECT count(*) FROM benchmark) * 0.7) THEN 'train' ELSE 'eval' END AS split FROM benchmark) GROUP BY split")
def s10(spark, sf_dir):
    rows = jsonl.ordered_split(jsonl.file_numbered(tables.table(spark, sf_dir, "benchmark")), 0.7)
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first"), F.max("item_id").alias("last"))


@query("s11_float_mapping_scan", "SELECT event_id, 'k' AS field, (props::JSON->>'k')::DOUBLE AS value FROM events")
def s11(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"fields":'), "props", F.lit("}"))).otherwise(F.col("props")).alias("value"))
    return jsonl.float_mapping(rows, keep=("event_id",))


@query(
    "s13_incremental_label_job",
    f"WITH {S.TURNS} SELECT CASE WHEN (uid + pos) % 3 = 0 THEN 'cached' ELSE 'labelled' END AS state, count(*) AS items, sum(len(list_filter({S.toks('text')}, lambda t: t IN ('la', 'the', 'of', 'der', 'die'))))::BIGINT AS predictions FROM turns GROUP BY ALL",
)
def s13(spark, sf_dir):
    """Turns already in the cache keep their predictions; only the others go through the labelling step."""
    items = tables.turns(spark, sf_dir).select("id", (F.col("uid") + F.col("pos")).alias("n"), "text")
    label = F.size(F.filter(tokens(F.col("text")), lambda t: t.isin("la", "the", "of", "der", "die")))
    path = scratch(spark, "labels")
    items.where(F.col("n") % 3 == 0).select("id", label.alias("predictions"), F.lit("cached").alias("state")).write.parquet(path)
    cache = spark.read.parquet(path)
    fresh = items.join(cache, "id", "left_anti").select("id", label.alias("predictions"), F.lit("labelled").alias("state"))
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("state").agg(F.count(F.lit(1)).alias("items"), F.sum("predictions").alias("predictions"))


# Conversations as nested records: three turns per session, one question per session, evidence by turn or session id.
def nested_records(spark, sf_dir):
    turns = tables.turns(spark, sf_dir)
    turn = F.struct(
        F.col("pos"),
        F.when(F.col("pos") % 2 == 0, F.col("id")).otherwise("").alias("turn_id"),
        F.when(F.col("pos") % 3 == 0, "").otherwise(F.col("speaker")).alias("speaker"),
        F.col("speaker").alias("role"),
        F.col("text").alias("content"),
        F.struct((F.col("pos") % 3 == 1).alias("has_answer"), F.when(F.col("pos") % 5 == 4, "a chart").alias("blip_caption")).alias("metadata"),
    )
    sessions = turns.groupBy("uid", "session").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    stamp = F.when(F.col("session") % 2 == 0, F.concat(F.lit("2024-01-0"), (F.col("session") % 9 + 1).cast("string"))).otherwise("")
    session = F.struct("session", F.when(F.col("session") % 2 == 0, F.concat(F.lit("s"), F.col("uid").cast("string"), F.lit("_"), F.col("session").cast("string"))).otherwise("").alias("session_id"), stamp.alias("timestamp"), "turns")
    return sessions.groupBy("uid").agg(F.array_sort(F.collect_list(session)).alias("sessions"))


UNIT = S.TURNS + """,
un AS (SELECT uid, session, pos, pos % 3 AS turn_pos, CASE WHEN session % 2 = 0 THEN 's' || uid || '_' || session ELSE 'session_' || session END AS session_id, id AS tid, speaker,
  CASE WHEN session % 2 = 0 THEN '2024-01-0' || (session % 9 + 1) ELSE '' END AS stamp, trim(text) AS body, pos % 3 = 1 AS has_answer FROM turns),
ft AS (SELECT uid, session AS session_pos, turn_pos, pos, CASE WHEN pos % 2 = 0 THEN tid ELSE session_id || '_t' || turn_pos END AS id, session_id, speaker, stamp AS timestamp, has_answer,
  trim(concat_ws(' ', CASE WHEN stamp <> '' THEN '[' || stamp || ']' END, CASE WHEN speaker <> '' THEN speaker || ':' END, CASE WHEN body <> '' THEN body END, CASE WHEN pos % 5 = 4 THEN 'Image: a chart' END)) AS text FROM un)"""


@query("p1_turn_text", S.with_(UNIT) + "SELECT uid, session_pos::BIGINT AS session_pos, turn_pos::BIGINT AS turn_pos, text FROM ft")
def p1(spark, sf_dir):
    return C.flatten_turns(nested_records(spark, sf_dir)).select("uid", F.col("session_pos").cast("bigint").alias("session_pos"), F.col("turn_pos").cast("bigint").alias("turn_pos"), "text")


@query("p2_flatten_turns", S.with_(UNIT) + "SELECT uid, id, session_id, speaker, timestamp, has_answer FROM ft")
def p2(spark, sf_dir):
    return C.flatten_turns(nested_records(spark, sf_dir)).select("uid", "id", "session_id", "speaker", "timestamp", "has_answer")


@query(
    "p3_flatten_sessions",
    S.with_(UNIT) + "SELECT uid, any_value(session_id) AS id, md5(string_agg(text, chr(10) ORDER BY turn_pos)) AS digest, string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS speaker, bool_or(has_answer) AS has_answer FROM ft GROUP BY uid, session_pos",
)
def p3(spark, sf_dir):
    return C.flatten_sessions(nested_records(spark, sf_dir)).select("uid", "id", F.md5("text").alias("digest"), "speaker", "has_answer")


def units(spark, sf_dir):
    return C.flatten_turns(nested_records(spark, sf_dir))


def evidence(spark, sf_dir):
    """One question per session. Records alternate between turn ids, session ids and unknown ids as evidence."""
    rows = units(spark, sf_dir)
    named = F.when(F.col("uid") % 3 == 0, F.col("id")).when(F.col("uid") % 3 == 1, F.col("session_id")).otherwise(F.concat(F.lit("ghost_"), F.col("session_id")))
    return rows.where(F.col("turn_pos") == 0).select("uid", F.col("session_pos").alias("pos"), F.concat(F.lit("qa_"), F.col("session_id")).alias("qa_id"), named.alias("evidence_id"), F.col("text").alias("question"))


EV = """ev AS (SELECT uid, session_pos AS pos, 'qa_' || session_id AS qa_id, CASE uid % 3 WHEN 0 THEN id WHEN 1 THEN session_id ELSE 'ghost_' || session_id END AS evidence_id, text AS question FROM ft WHERE turn_pos = 0),
md AS (SELECT f.uid, CASE WHEN any_value(f.uid) % 3 = 1 AND NOT bool_or(f.has_answer) THEN 'session' ELSE 'turn' END AS mode FROM ft f GROUP BY f.uid),
sn AS (SELECT uid, session_id, bool_or(has_answer) AS answered FROM ft GROUP BY ALL),
ne AS (SELECT e.uid, e.qa_id, CASE WHEN e.uid % 3 <> 1 OR m.mode = 'session' THEN e.evidence_id ELSE f.id END AS id FROM ev e JOIN md m USING (uid) LEFT JOIN (ft f JOIN sn s ON s.uid = f.uid AND s.session_id = f.session_id AND (f.has_answer OR NOT s.answered))
  ON e.uid % 3 = 1 AND m.mode = 'turn' AND f.uid = e.uid AND f.session_id = e.evidence_id)"""


@query("p4_unit_mode", S.with_(UNIT, EV) + "SELECT uid, mode FROM md")
def p4(spark, sf_dir):
    return C.unit_modes(units(spark, sf_dir), evidence(spark, sf_dir))


def normalized(spark, sf_dir):
    rows, ids = units(spark, sf_dir), evidence(spark, sf_dir)
    return C.normalize_evidence(rows, ids, C.unit_modes(rows, ids))


@query("p5_normalize_evidence", S.with_(UNIT, EV) + "SELECT uid, qa_id, id FROM ne")
def p5(spark, sf_dir):
    return normalized(spark, sf_dir)


@query(
    "p6_card_projection",
    S.with_(UNIT)
    + "SELECT uid, id, md5(substr(text, 1, 240)) AS summary, uid::VARCHAR AS cluster, 0.5::DOUBLE AS importance, row_number() OVER (PARTITION BY uid ORDER BY session_pos, turn_pos) - 1 AS age_days, uid || '|conv|' || session_id || '|' || id || '|' || speaker || '|' || timestamp AS metadata FROM ft",
)
def p6(spark, sf_dir):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("uid").orderBy("session_pos", "turn_pos")) - 1
    out = C.card_projection(units(spark, sf_dir).withColumn("pos", place), F.lit("conv"))
    keys = ["project", "source", "session_id", "turn_id", "speaker", "timestamp"]
    return out.select("uid", "id", F.md5("summary").alias("summary"), "cluster", "importance", "age_days", F.concat_ws("|", *[F.try_element_at("metadata", F.lit(k)) for k in keys]).alias("metadata"))


def retrieval_tasks(spark, sf_dir):
    questions = evidence(spark, sf_dir).select(
        "uid", "pos", "qa_id", "question", F.lit("").alias("answer"), F.lit("session").alias("question_type"), ((F.col("uid") + F.col("pos")) % 4 == 0).alias("abstention")
    )
    return C.query_projection(questions, normalized(spark, sf_dir), 900)


TASK = """tk AS (SELECT e.uid, e.pos, e.qa_id, md5(e.question) AS query, (e.uid + e.pos) % 4 = 0 AS abstention, string_agg(n.id, ',' ORDER BY n.id) AS relevant, 900::BIGINT AS budget FROM ev e LEFT JOIN ne n ON n.uid = e.uid AND n.qa_id = e.qa_id GROUP BY ALL)"""


@query("p7_query_projection", S.with_(UNIT, EV, TASK) + "SELECT uid, qa_id, query, abstention, relevant, budget FROM tk")
def p7(spark, sf_dir):
    return retrieval_tasks(spark, sf_dir).select("uid", "qa_id", F.md5("query").alias("query"), "abstention", F.array_join("relevant_ids", ",").alias("relevant"), "budget")


@query(
    "p8_question_filter_limit",
    S.with_(UNIT, EV, TASK) + "SELECT uid, qa_id FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY pos) AS n FROM tk WHERE NOT abstention AND relevant IS NOT NULL) WHERE n <= 1",
)
def p8(spark, sf_dir):
    return C.question_filter(retrieval_tasks(spark, sf_dir), 1).select("uid", "qa_id")


@query(
    "p9_item_kind_and_split",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'query' WHEN 'click' THEN 'evidence' WHEN 'purchase' THEN 'hard_negative' WHEN 'signup' THEN 'background' ELSE 'unknown' END AS kind,
      CASE WHEN event_type IN ('view', 'click', 'purchase') THEN CASE WHEN user_id < 60 THEN 'train' WHEN user_id >= 80 AND user_id < 110 THEN 'holdout' ELSE 'unused' END
      WHEN event_type = 'signup' THEN CASE WHEN user_id < 50 THEN 'train' WHEN user_id < 90 THEN 'holdout' ELSE 'unused' END ELSE 'unused' END AS split FROM events""",
)
def p9(spark, sf_dir):
    prefix = F.lit("other")
    for kind, name in (("view", "query"), ("click", "evidence"), ("purchase", "hard"), ("signup", "background")):
        prefix = F.when(F.col("event_type") == kind, name).otherwise(prefix)
    slot = F.when(F.col("event_type") == "purchase", F.lit("::3")).otherwise("")
    identifier = F.concat(prefix, F.lit("::"), F.col("user_id").cast("string"), slot)
    rows = tables.table(spark, sf_dir, "events").select("event_id", identifier.alias("item"))
    return rows.select("event_id", X.item_kind(F.col("item")).alias("kind"), X.item_split(F.col("item"), 60, 80, 30, 50, 40).alias("split"))

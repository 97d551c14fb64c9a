"""Field prediction queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from memjoin.operators import fields as P
from memjoin.plans import sqltext as S
from memjoin.plans.registry import query
from memjoin.session import cut_lineage, scratch_dir
from memjoin.sources import tables

# Every document with a header naming a user, project, session, brand, tool, colour and tone, as agent memories have.
LABEL_TEXT = """('user_' || lpad((doc_id % 40)::VARCHAR, 3, '0') || ' on project_' || lpad((n_chars % 25)::VARCHAR, 3, '0') || ' at ' || {brands}[(doc_id % 8 + 1)::INT] || ' with '
  || {tools}[(n_chars % 8 + 1)::INT] || ' wants ' || {colors}[(doc_id % 10 + 1)::INT] || ', ' || {tones}[(n_chars % 7 + 1)::INT] || '. ' || text)""".format(
    brands=P.BRANDS, tools=P.TOOLS, colors=P.COLORS, tones=P.TONES
)
ITEMS = f"items AS (SELECT doc_id AS item, {LABEL_TEXT} AS text FROM documents)"


def labelled_texts(spark, sf_dir):
    def pick(options, by):
        return F.element_at(F.array(*[F.lit(o) for o in options]), (F.col(by) % len(options) + 1).cast("int"))

    def number(by, n):
        return F.lpad((F.col(by) % n).cast("string"), 3, "0")

    text = F.concat(
        F.lit("user_"), number("doc_id", 40), F.lit(" on project_"), number("n_chars", 25), F.lit(" at "), pick(P.BRANDS, "doc_id"), F.lit(" with "),
        pick(P.TOOLS, "n_chars"), F.lit(" wants "), pick(P.COLORS, "doc_id"), F.lit(", "), pick(P.TONES, "n_chars"), F.lit(". "), F.col("text"),
    )
    return tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), text.alias("text"))


def _any(terms):
    return " OR ".join(f"contains(t, '{x}')" for x in terms)


def _list(options):
    return "(" + ", ".join(f"'{o}'" for o in options) + ")"


_words = "|".join(P.BRANDS + P.TOOLS + P.COLORS + P.TONES)
PRED = f"""low AS (SELECT item, lower(text) AS t FROM items),
us AS (SELECT item, unnest(list_distinct(regexp_extract_all(t, '\\buser_\\d{{3}}\\b'))) AS v FROM low),
pj AS (SELECT item, unnest(list_distinct(regexp_extract_all(t, '\\bproject_\\d{{3}}\\b'))) AS v FROM low),
wd AS (SELECT item, unnest(list_distinct(regexp_extract_all(t, '\\b(?:{_words})\\b'))) AS v FROM low),
pred AS (
  SELECT item, 'user_id' AS field, v AS value, 0.96::DOUBLE AS confidence, v AS span FROM us UNION ALL SELECT item, 'entity', v, 0.82, v FROM us
  UNION ALL SELECT item, 'project', v, 0.96, v FROM pj UNION ALL SELECT item, 'entity', v, 0.84, v FROM pj
  UNION ALL SELECT item, 'session_id', v, 0.88, v FROM (SELECT item, unnest(list_distinct(regexp_extract_all(t, '\\buser_\\d{{3}}_project_\\d{{3}}_[a-z0-9_:-]+\\b'))) AS v FROM low)
  UNION ALL SELECT item, 'brand', v, 0.92, v FROM wd WHERE v IN {_list(P.BRANDS)} UNION ALL SELECT item, 'entity', v, 0.80, v FROM wd WHERE v IN {_list(P.BRANDS)}
  UNION ALL SELECT item, 'tool', v, 0.84, v FROM wd WHERE v IN {_list(P.TOOLS)}
  UNION ALL SELECT item, 'preference', 'color:' || v, 0.74, v FROM wd WHERE v IN {_list(P.COLORS)}
  UNION ALL SELECT item, 'preference', 'tone:' || v, 0.72, v FROM wd WHERE v IN {_list(P.TONES)}
  UNION ALL SELECT item, 'time_scope', 'current', 0.78, 'current' FROM low WHERE {_any(P.CURRENT_TERMS)}
  UNION ALL SELECT item, 'time_scope', 'stale', 0.78, 'stale' FROM low WHERE {_any(P.STALE_TERMS)}
  UNION ALL SELECT item, 'correction', 'has_correction_signal', 0.80, 'has_correction_signal' FROM low WHERE {_any(P.CORRECTION_SIGNALS)})"""


@query("f21_rule_field_extraction", S.with_(ITEMS, PRED) + "SELECT item, field, value, confidence, span FROM pred")
def rule_extraction(spark, sf_dir):
    return P.extract(labelled_texts(spark, sf_dir), "item").drop("pos")


@query(
    "f15_field_name_value_normalisation",
    r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS name,
      trim(regexp_replace(html, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS value, greatest(0.0, least(1.0, (page_id % 30 - 5) / 20.0))::DOUBLE AS confidence FROM pages""",
)
def normalisation(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages").select(
        "page_id",
        P.normal_name(F.col("url")).alias("name"),
        P.normal_value(F.col("html")).alias("value"),
        P.bounded_confidence((F.col("page_id") % 30 - 5) / 20.0).alias("confidence"),
    )


@query(
    "f22_parse_prediction_json",
    """SELECT event_id, replace(event_type, '-', '_') AS field, value::VARCHAR AS value, least(1.0, k / 80.0)::DOUBLE AS confidence, 'e' || event_id AS span
    FROM (SELECT event_id, event_type, user_id AS value, (props::JSON->>'k')::INT AS k FROM events) WHERE k > 0""",
)
def parse_json(spark, sf_dir):
    """Every event as a prediction payload, in one of the three accepted shapes by event type."""
    k = F.get_json_object("props", "$.k").cast("int") / 80.0
    listed = F.to_json(F.array(F.struct(F.col("event_type").alias("field"), F.col("user_id").cast("string").alias("value"), k.alias("confidence"), F.concat(F.lit("e"), F.col("event_id")).alias("source_span"))))
    named = F.to_json(F.array(F.struct(F.col("event_type").alias("field_name"), F.concat(F.lit("  "), F.col("user_id")).alias("value"), k.alias("confidence"), F.concat(F.lit("e"), F.col("event_id")).alias("span"))))
    payload = (
        F.when(F.col("event_type") == "view", listed)
        .when(F.col("event_type") == "click", F.concat(F.lit('{"fields":'), named, F.lit("}")))
        .otherwise(F.concat(F.lit('{"predictions":'), named, F.lit("}")))
    )
    rows = tables.table(spark, sf_dir, "events").select("event_id", payload.alias("payload"))
    return rows.select("event_id", F.inline(P.parsed_predictions(F.col("payload"))))


@query(
    "f23_cache_keys",
    """SELECT page_id, sha256('{"cache_key_mode":"stable-text-v1","prompt_version":"field-classifier-v1","text":"' || url || '"}') AS stable_key,
      sha256('{"fields":["brand","project","tool"],"prompt_version":"field-classifier-v1","registry_version":3,"text":"' || url || '"}') AS registry_key FROM pages""",
)
def cache_keys(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages").select(
        "page_id", P.stable_key(F.col("url")).alias("stable_key"), P.registry_key(F.col("url"), 3, ["tool", "project", "brand"]).alias("registry_key")
    )


# Raw predictions of several sources for one item: the rules plus an echo of every entity at a record-dependent confidence.
ECHO = PRED + """,
echo AS (SELECT item, field, value, confidence, span, 0 AS pos FROM pred UNION ALL SELECT item, 'entity', value, 0.7 + 0.01 * (item % 20), 'echo', 1 FROM pred WHERE field = 'entity')"""


def echoed(spark, sf_dir):
    base = P.extract(labelled_texts(spark, sf_dir), "item")
    echo = base.where(F.col("field") == "entity").select(
        "item", (F.col("pos") + 1000).alias("pos"), "field", "value", (0.7 + 0.01 * (F.col("item") % 20)).alias("confidence"), F.lit("echo").alias("span")
    )
    return base.unionByName(echo)


@query(
    "a1_prediction_dedupe",
    S.with_(ITEMS, ECHO)
    + "SELECT item, field, value, max(confidence) AS confidence, arg_max(span, round(confidence, 9) * 1000 - pos) AS span FROM echo GROUP BY item, field, value",
)
def prediction_dedupe(spark, sf_dir):
    rows = echoed(spark, sf_dir).withColumn("confidence", F.round("confidence", 9))
    return P.stable_predictions(rows)


SEED = "seed AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a})" for n, (a, _) in sorted(P.SEED_FIELDS.items())) + ") t(name, aliases))"
# Fields renamed to an alias, an unknown name or themselves, by row.
RENAMED = """ren AS (SELECT item, CASE WHEN field = 'project' AND item % 3 = 0 THEN 'Workstream' WHEN field = 'tool' AND item % 2 = 0 THEN 'license constraint'
  WHEN field = 'tool' THEN 'license_constraint' WHEN field = 'preference' AND item % 4 = 0 THEN 'likes' ELSE field END AS field, value, confidence, span FROM pred),
res AS (SELECT r.item, coalesce(k.name, (SELECT min(s.name) FROM seed s WHERE list_contains(s.aliases, r.wanted)), r.wanted) AS field, r.value, r.confidence, r.span
  FROM (SELECT *, regexp_replace(lower(field), '[^a-z0-9_]+', '_', 'g') AS wanted FROM ren) r LEFT JOIN seed k ON k.name = r.wanted)"""


def renamed(spark, sf_dir):
    item, field = F.col("item"), F.col("field")
    name = (
        F.when((field == "project") & (item % 3 == 0), "Workstream")
        .when((field == "tool") & (item % 2 == 0), "license constraint")
        .when(field == "tool", "license_constraint")
        .when((field == "preference") & (item % 4 == 0), "likes")
        .otherwise(field)
    )
    return P.extract(labelled_texts(spark, sf_dir), "item").withColumn("field", name)


def resolved_rows(spark, sf_dir):
    return P.resolved(renamed(spark, sf_dir), P.seed_registry(spark))


@query("j44_alias_resolution", S.with_(ITEMS, PRED, SEED, RENAMED) + "SELECT item, field, value, confidence FROM res")
def alias_resolution(spark, sf_dir):
    return resolved_rows(spark, sf_dir).select("item", "field", "value", "confidence")


REG = """reg AS (SELECT coalesce(s.name, c.field) AS name, CASE WHEN s.name IS NULL THEN 'proposed' ELSE 'promoted' END AS status, coalesce(c.n, 0) AS seen_count,
  round(coalesce(c.c, 0.0), 6) AS confidence_sum, coalesce(c.d, 0) AS distinct_count FROM seed s FULL JOIN
  (SELECT field, count(*) AS n, sum(confidence) AS c, count(DISTINCT value) AS d FROM res GROUP BY field) c ON c.field = s.name)"""


def counted(spark, sf_dir):
    return P.record_predictions(P.seed_registry(spark), resolved_rows(spark, sf_dir))


@query("a2_registry_counters", S.with_(ITEMS, PRED, SEED, RENAMED, REG) + "SELECT name, status, seen_count, confidence_sum, distinct_count FROM reg")
def registry_counters(spark, sf_dir):
    return counted(spark, sf_dir).select("name", "status", "seen_count", F.round("confidence_sum", 6).alias("confidence_sum"), "distinct_count")


def float_table(spark, payload):
    from memjoin.sources.jsonl import float_mapping

    return float_mapping(spark.createDataFrame([(payload,)], "value string"))


def gated(spark, registry):
    lifts = float_table(spark, '{"fields": {"license_constraint": 0.05, "topic": 0.2}}')
    deltas = float_table(spark, '{"license_constraint": 0.0}')
    return P.promote_ready(registry, lifts, deltas)


def promoted(spark, sf_dir):
    return gated(spark, counted(spark, sf_dir))


GATE = """gate AS (SELECT *, status <> 'promoted' AND seen_count >= 25 AND round(confidence_sum / greatest(seen_count, 1), 9) >= 0.82 AND distinct_count >= 5 AND name = 'license_constraint' AS ok FROM reg)"""


@query(
    "s8_registry_snapshot",
    S.with_(ITEMS, PRED, SEED, RENAMED, REG, GATE)
    + """SELECT g.name, CASE WHEN ok THEN 'promoted' ELSE status END AS status, (1 + ok::INT)::BIGINT AS version, 1 + (SELECT bool_or(ok) FROM gate)::BIGINT AS registry_version, seen_count, distinct_count,
      coalesce(array_to_string(list_sort(s.aliases), ','), '') AS aliases FROM gate g LEFT JOIN seed s ON s.name = g.name""",
)
def registry_snapshot(spark, sf_dir):
    """The registry saved as counted and as promoted, under its own version; the newest version loaded."""
    path = f"{scratch_dir(spark)}/registry-{uuid.uuid4().hex}"
    before = cut_lineage(counted(spark, sf_dir))
    after = gated(spark, before)
    newest = P.raised_version(before, after)
    for version, rows in ((1, before), (newest, after)):
        rows.write.mode("overwrite").parquet(f"{path}/registry_version={version}")
    stored = spark.read.parquet(path)
    loaded = stored.where(F.col("registry_version") == stored.agg(F.max("registry_version")).scalar())
    return loaded.select(
        "name", "status", F.col("version").cast("bigint").alias("version"), F.col("registry_version").cast("bigint").alias("registry_version"), "seen_count", "distinct_count",
        F.array_join(F.array_sort("aliases"), ",").alias("aliases"),
    )


@query(
    "a3_field_promotion_gate",
    S.with_(ITEMS, PRED, SEED, RENAMED, REG)
    + """SELECT name, CASE WHEN ok THEN 'promoted' ELSE status END AS status, (1 + ok::INT)::BIGINT AS version, CASE WHEN ok THEN 0.05 ELSE 0.0 END::DOUBLE AS validation_lift
      FROM (SELECT *, status <> 'promoted' AND seen_count >= 25 AND round(confidence_sum / greatest(seen_count, 1), 9) >= 0.82 AND distinct_count >= 5 AND name = 'license_constraint' AS ok FROM reg)""",
)
def promotion_gate(spark, sf_dir):
    return promoted(spark, sf_dir).select("name", "status", F.col("version").cast("bigint").alias("version"), "validation_lift")


@query(
    "a4_derived_metadata",
    S.with_(
        ITEMS, PRED, SEED, RENAMED, REG,
        "best AS (SELECT item, field, value, max(confidence) AS c FROM res GROUP BY ALL)",
        "per AS (SELECT item, field, string_agg(value || '@' || printf('%.2f', c), ',' ORDER BY value) AS e FROM best WHERE field IN (SELECT name FROM reg WHERE status = 'promoted' OR (name = 'license_constraint' AND seen_count >= 25 AND distinct_count >= 5)) GROUP BY ALL)",
    )
    + "SELECT item, string_agg(field || '=' || e, ';' ORDER BY field) AS fields, 'rule' AS source_type, 'field-classifier-v1' AS teacher_version, 1 + (SELECT count(*) > 0 FROM reg WHERE name = 'license_constraint' AND seen_count >= 25 AND distinct_count >= 5)::BIGINT AS schema_version FROM per GROUP BY item",
)
def derived_metadata(spark, sf_dir):
    rows = P.stable_predictions(resolved_rows(spark, sf_dir))
    before = cut_lineage(counted(spark, sf_dir))
    after = gated(spark, before)
    out = P.derived_metadata(rows, after, schema_version=P.raised_version(before, after))
    shown = F.transform(
        F.array_sort(F.map_entries("fields")),
        lambda e: F.concat(
            e["key"], F.lit("="), F.array_join(F.transform(e["value"], lambda v: F.concat(v["value"], F.lit("@"), F.format_string("%.2f", v["confidence"]))), ",")
        ),
    )
    return out.select("item", F.array_join(shown, ";").alias("fields"), "source_type", "teacher_version", "schema_version")


# The cache holds rule predictions of the even turns under the stable key and of every third turn under the registry key.
CACHE_SQL = f"""WITH {S.TURNS}, x AS (SELECT id, pos, uid FROM turns)
SELECT id, CASE WHEN (uid + pos) % 3 = 0 THEN 'registry' WHEN (uid + pos) % 2 = 0 THEN 'stable' ELSE '' END AS origin FROM x"""


@query("j43_cache_lookup_with_fallback", CACHE_SQL)
def cache_lookup(spark, sf_dir):
    fields = list(P.SEED_FIELDS)
    turns = tables.turns(spark, sf_dir).select("id", (F.col("uid") + F.col("pos")).alias("n"), F.concat("id", F.lit(" "), "text").alias("text"))
    keyed = turns.select(F.col("id").alias("item"), "n", P.registry_key(F.col("text"), 1, fields).alias("registry_key"), P.stable_key(F.col("text")).alias("stable_key"))
    cache = keyed.where(F.col("n") % 3 == 0).select(F.col("registry_key").alias("key"), F.lit("registry").alias("predictions")).unionByName(
        keyed.where(F.col("n") % 2 == 0).select(F.col("stable_key").alias("key"), F.lit("stable").alias("predictions"))
    )
    return P.cached_predictions(keyed, cache).select(F.col("item").alias("id"), F.coalesce("predictions", F.lit("")).alias("origin"))


@query(
    "p12_prompt_text",
    f"""WITH {S.TURNS} SELECT id, md5('Known field registry:' || chr(10) || '['
      || '{",".join('{"aliases":[' + ",".join(chr(34) + a + chr(34) for a in sorted(al)) + '],"description":"' + d + '","name":"' + n + '","status":"promoted"}' for n, (al, d) in sorted(P.SEED_FIELDS.items()))}'
      || ']' || chr(10) || chr(10) || 'Text to label:' || chr(10) || text) AS digest FROM turns""",
)
def prompt_text(spark, sf_dir):
    from memjoin.operators.exports import prompt

    rows = prompt(tables.turns(spark, sf_dir), P.seed_registry(spark))
    return rows.select("id", F.md5("prompt").alias("digest"))


@query(
    "s13_label_job",
    S.with_(
        ITEMS, PRED, "np AS (SELECT item, count(DISTINCT (field, value)) AS n FROM pred GROUP BY item)",
        "tt AS (SELECT item, bool_or(item % 3 = 0) OVER (PARTITION BY text) AS pre, row_number() OVER (PARTITION BY text ORDER BY item) AS place FROM items)",
    )
    + "SELECT CASE WHEN NOT pre AND place = 1 THEN 'labelled' ELSE 'cached' END AS state, count(*) AS items, sum(coalesce(n, 0))::BIGINT AS predictions FROM tt LEFT JOIN np USING (item) GROUP BY ALL",
)
def label_job(spark, sf_dir):
    """Labelled texts over a cache that holds every third; the job stops after one commit and is resumed."""
    from memjoin.operators import labelling as J
    from memjoin.plans.ingest import scratch
    from memjoin.session import cut_lineage
    from memjoin.streaming.online import BatchLog

    rows = labelled_texts(spark, sf_dir).select(F.col("item").alias("index"), F.col("item").alias("item_id"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("key"), "text")
    items = cut_lineage(rows)
    log, rules = BatchLog(spark, scratch(spark, "label-cache")), J.classifier("rules")
    size = max(1, items.count() // 3)
    J.label_job(items.where(F.col("index") % 3 == 0), log, rules, 10 * size)
    before = cut_lineage(J.audit(log).select("index"))
    J.label_job(items, log, rules, size, stop_after=1)
    J.label_job(items, log, rules, size)
    found = J.outcome(items, log).join(before.withColumn("old", F.lit(True)), "index", "left")
    state = F.when(F.col("old"), "cached").otherwise(F.col("state"))
    return found.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("items"), F.sum(F.size("predictions")).alias("predictions"))

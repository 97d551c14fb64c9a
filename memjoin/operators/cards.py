"""Cards, evidence and questions out of conversation records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Summary length, profile and blocker card texts, edge weights of derived cards.
SUMMARY = 240
PROFILE_SNIPPET, PROFILE_SOURCES, PROFILE_IMPORTANCE = 180, 24, 0.82
BLOCKER_ROLES = ["superseded_conflict", "stale_preference", "same_entity_wrong_time", "answer_shaped"]
BLOCKER_IMPORTANCE, BLOCKED_SHOWN = 0.76, 8
PROVENANCE_EDGE, CORRECTION_EDGE = (0.70, 1.0), (0.88, 1.0)


def _text(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit("")))


def turn_text(timestamp: Column, speaker: Column, content: Column, caption: Column) -> Column:
    """`[timestamp] speaker: content Image: caption`, empty parts left out."""
    stamp, who, said, shown = (_text(v) for v in (timestamp, speaker, content, caption))
    return F.trim(
        F.concat_ws(
            " ",
            F.when(stamp != "", F.concat(F.lit("["), stamp, F.lit("]"))),
            F.when(who != "", F.concat(who, F.lit(":"))),
            F.when(said != "", said),
            F.when(shown != "", F.concat(F.lit("Image: "), shown)),
        )
    )


def named(value: Column, fallback: Column) -> Column:
    return F.coalesce(F.when(value != "", value), fallback)


def flatten_turns(recs: DataFrame) -> DataFrame:
    """One row per non-empty turn of (uid, sessions): session_pos, turn_pos, id, session_id, speaker, timestamp, text, has_answer."""
    sessions = recs.select("uid", F.posexplode("sessions").alias("session_pos", "s"))
    turns = sessions.select("uid", "session_pos", named(F.col("s.session_id"), F.concat(F.lit("session_"), "session_pos")).alias("session_id"), F.col("s.timestamp").alias("timestamp"), F.posexplode("s.turns").alias("turn_pos", "t"))
    speaker = F.coalesce(F.when(F.col("t.speaker") != "", F.col("t.speaker")), F.col("t.role"), F.lit(""))
    return turns.select(
        "uid", "session_pos", "turn_pos", named(F.col("t.turn_id"), F.concat("session_id", F.lit("_t"), "turn_pos")).alias("id"), "session_id", speaker.alias("speaker"),
        F.coalesce("timestamp", F.lit("")).alias("timestamp"), turn_text(F.col("timestamp"), speaker, F.col("t.content"), F.col("t.metadata.blip_caption")).alias("text"),
        F.coalesce("t.metadata.has_answer", F.lit(False)).alias("has_answer"),
    ).where(F.col("text") != "")


def flatten_sessions(recs: DataFrame) -> DataFrame:
    """One row per session with text, built inside the nested array: joined texts, sorted speakers, any answer."""
    sessions = recs.select("uid", F.posexplode("sessions").alias("session_pos", "s"))

    def who(t: Column) -> Column:
        return F.coalesce(F.when(t["speaker"] != "", t["speaker"]), t["role"], F.lit(""))

    texts = F.filter(F.transform("s.turns", lambda t: turn_text(F.col("s.timestamp"), who(t), t["content"], t["metadata"]["blip_caption"])), lambda x: x != "")
    speakers = F.array_sort(F.array_distinct(F.filter(F.transform("s.turns", who), lambda x: x != "")))
    return sessions.select(
        "uid", "session_pos", named(F.col("s.session_id"), F.concat(F.lit("session_"), "session_pos")).alias("id"), F.array_join(texts, "\n").alias("text"),
        F.array_join(speakers, ",").alias("speaker"), F.coalesce("s.timestamp", F.lit("")).alias("timestamp"),
        F.exists("s.turns", lambda t: F.coalesce(t["metadata"]["has_answer"], F.lit(False))).alias("has_answer"),
    ).where(F.col("text") != "")


def unit_modes(units: DataFrame, evidence: DataFrame) -> DataFrame:
    """(uid, mode): turn or session by what the evidence ids name. `units` from `flatten_turns`, `evidence`: uid, evidence_id."""
    ids = evidence.select("uid", "evidence_id").distinct()
    turn = units.select("uid", F.col("id").alias("evidence_id")).distinct().withColumn("is_turn", F.lit(1))
    session = units.groupBy("uid", F.col("session_id").alias("evidence_id")).agg(F.lit(1).alias("is_session"), F.max(F.col("has_answer").cast("int")).alias("answers"))
    marked = ids.join(turn, ["uid", "evidence_id"], "left").join(session, ["uid", "evidence_id"], "left").fillna(0, ["is_turn", "is_session", "answers"])
    sums = marked.groupBy("uid").agg(F.min("is_turn").alias("turns"), F.min("is_session").alias("sessions"), F.max("answers").alias("answers"))
    mode = F.when(F.col("turns") == 1, "turn").when((F.col("sessions") == 1) & (F.col("answers") == 0), "session").otherwise("turn")
    return units.select("uid").distinct().join(sums, "uid", "left").select("uid", mode.alias("mode"))


def normalize_evidence(units: DataFrame, evidence: DataFrame, modes: DataFrame) -> DataFrame:
    """(uid, qa_id, id): evidence ids as turn ids. A session id becomes its answer turns, or all its turns; unmatched ids stay."""
    asked = evidence.select("uid", "qa_id", "evidence_id").where(F.col("evidence_id") != "").distinct().join(modes, "uid")
    turn = units.select("uid", F.col("id").alias("evidence_id")).distinct().withColumn("is_turn", F.lit(1))
    flagged = asked.join(turn, ["uid", "evidence_id"], "left").fillna(0, ["is_turn"])
    per_question = Window.partitionBy("uid", "qa_id")
    flagged = flagged.withColumn("as_is", (F.col("mode") == "session") | (F.min("is_turn").over(per_question) == 1))
    answers = F.max(F.col("has_answer").cast("int")).over(Window.partitionBy("uid", "session_id"))
    members = units.withColumn("answered", answers).where((F.col("answered") == 0) | F.col("has_answer")).select("uid", F.col("session_id").alias("evidence_id"), F.col("id").alias("member"))
    grown = flagged.join(members, ["uid", "evidence_id"], "left").withColumn("found", F.max(F.col("member").isNotNull().cast("int")).over(per_question))
    chosen = F.when(F.col("as_is") | (F.col("found") == 0), F.col("evidence_id")).otherwise(F.col("member"))
    return grown.select("uid", "qa_id", chosen.alias("id")).where(F.col("id").isNotNull()).distinct()


def card_projection(units: DataFrame, source: Column) -> DataFrame:
    """Units as memory cards. `units`: uid, pos, id, session_id, speaker, timestamp, text."""
    return units.select(
        "uid", "id", "text", F.col("text").substr(1, SUMMARY).alias("summary"), F.col("uid").cast("string").alias("cluster"), F.lit(0.5).alias("importance"), F.col("pos").cast("bigint").alias("age_days"),
        F.lit(0).cast("bigint").alias("use_count"),
        F.create_map(
            F.lit("project"), F.col("uid").cast("string"), F.lit("source"), source, F.lit("session_id"), F.col("session_id"), F.lit("turn_id"), F.col("id"), F.lit("speaker"), F.col("speaker"),
            F.lit("timestamp"), F.col("timestamp"),
        ).alias("metadata"),
    )


def query_projection(questions: DataFrame, evidence: DataFrame, budget: int) -> DataFrame:
    """Questions as retrieval tasks with sorted relevant ids. `questions`: uid, pos, qa_id, question, answer, question_type, abstention."""
    ids = evidence.groupBy("uid", "qa_id").agg(F.array_sort(F.collect_set("id")).alias("relevant_ids"))
    return questions.join(ids, ["uid", "qa_id"], "left").select(
        "uid", "pos", "qa_id", F.coalesce("question", F.lit("")).alias("query"), F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("question_type", F.lit("")).alias("question_type"),
        F.coalesce("abstention", F.lit(False)).alias("abstention"), F.coalesce("relevant_ids", F.array().cast("array<string>")).alias("relevant_ids"), F.lit(budget).cast("bigint").alias("budget"),
    )


def question_filter(tasks: DataFrame, per_record: int = 0, keep_abstention: bool = False) -> DataFrame:
    """Drop abstention questions and questions without evidence, keep the first `per_record` of each record."""
    kept = tasks if keep_abstention else tasks.where(~F.col("abstention") & (F.size("relevant_ids") > 0))
    if per_record <= 0:
        return kept
    place = F.row_number().over(Window.partitionBy("uid").orderBy("pos"))
    return kept.withColumn("_n", place).where(F.col("_n") <= per_record).drop("_n")


def resolve_relevant(explicit: DataFrame, scored: DataFrame) -> DataFrame:
    """(q, id): explicit ids; queries without any take candidates with attach and rank label of at least one half."""
    fallback = scored.where((F.col("attach") >= 0.5) & (F.col("rank_label") >= 0.5)).join(explicit.select("q").distinct(), "q", "left_anti")
    return explicit.select("q", "id").unionByName(fallback.select("q", "id"))


def entity_profiles(cards: DataFrame, evidence: DataFrame, max_sources: int = PROFILE_SOURCES) -> DataFrame:
    """One profile card per record listing its first evidence cards. `cards`: uid, id, text; `evidence`: uid, id."""
    sources = evidence.select("uid", "id").distinct().join(cards.select("uid", "id", "text"), ["uid", "id"])
    place = F.row_number().over(Window.partitionBy("uid").orderBy("id"))
    shown = F.concat(F.lit("- "), "id", F.lit(": "), F.replace("text", F.lit("\n"), F.lit(" ")).substr(1, PROFILE_SNIPPET))
    top = sources.withColumn("n", place).where(F.col("n") <= max_sources).select("uid", F.struct("n", "id", shown.alias("line")).alias("s"))
    listed = top.groupBy("uid").agg(F.array_sort(F.collect_list("s")).alias("s"))
    body = F.concat(
        F.lit("Entity profile for "), F.col("uid").cast("string"), F.lit(". Current facts and preferences with provenance:\n"), F.array_join(F.transform("s", lambda x: x["line"]), "\n")
    )
    return listed.select(
        "uid", F.concat(F.lit("entity_profile::"), F.col("uid").cast("string")).alias("id"), body.alias("text"), body.substr(1, SUMMARY).alias("summary"), F.lit(PROFILE_IMPORTANCE).alias("importance"),
        F.size("s").cast("bigint").alias("evidence_count"), F.lit("entity_profile").alias("derived_type"), F.transform("s", lambda x: x["id"]).alias("provenance"), F.array().cast("array<string>").alias("blocked"),
    )


def blocker_cards(decoys: DataFrame, evidence: DataFrame, cards: DataFrame) -> DataFrame:
    """One card per question with blocking decoys and known sources, naming both.

    `decoys`: uid, qa_id, id, role, text; `evidence`: uid, qa_id, id; `cards`: uid, id, text.
    """
    blocked = decoys.where(F.col("role").isin(BLOCKER_ROLES)).groupBy("uid", "qa_id").agg(F.array_sort(F.collect_list(F.struct("id", F.col("text").substr(1, 120).alias("t")))).alias("b"))
    sources = evidence.join(cards.select("uid", "id", "text"), ["uid", "id"]).groupBy("uid", "qa_id").agg(F.array_sort(F.collect_list(F.struct("id", F.col("text").substr(1, 160).alias("t")))).alias("s"))

    def texts(name: str) -> Column:
        return F.array_join(F.transform(F.slice(name, 1, 3), lambda x: x["t"]), " | ")

    ids = F.transform("b", lambda x: x["id"])
    body = F.concat(
        F.lit("Anti-memory for "), "qa_id", F.lit(". Do not use blocked memories: "), F.array_join(F.slice(ids, 1, BLOCKED_SHOWN), ", "),
        F.lit(". They are superseded or wrong-time context. Use provenance instead: "), texts("s"), F.lit(". Blocked text: "), texts("b"),
    )
    return blocked.join(sources, ["uid", "qa_id"]).select(
        "uid", "qa_id", F.concat(F.lit("anti_memory::"), "qa_id").alias("id"), body.alias("text"), body.substr(1, SUMMARY).alias("summary"), F.lit(BLOCKER_IMPORTANCE).alias("importance"),
        F.lit("anti_memory").alias("derived_type"), F.transform("s", lambda x: x["id"]).alias("provenance"), ids.alias("blocked"),
    )


def derived_edges(derived: DataFrame, known: DataFrame) -> DataFrame:
    """Provenance and correction edges from derived cards to the known ids they name. `derived`: uid, id, provenance, blocked."""

    def edges(names: str, kind: str, strength: tuple[float, float]) -> DataFrame:
        return derived.select(
            "uid", F.col("id").alias("source"), F.explode(names).alias("target"), F.lit(kind).alias("type"), F.lit(strength[0]).alias("weight"), F.lit(strength[1]).alias("confidence")
        )

    both = edges("provenance", "provenance", PROVENANCE_EDGE).unionByName(edges("blocked", "correction", CORRECTION_EDGE))
    return both.join(known.select("uid", F.col("id").alias("target")), ["uid", "target"], "left_semi")


def append_new(held: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of `new` whose key is not held yet, the first by `order` per key, after the held rows."""
    first = Window.partitionBy(*keys).orderBy(order)
    fresh = new.join(held.select(*keys), keys, "left_anti").withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).drop("_n")
    return held.unionByName(fresh, allowMissingColumns=True)

"""Decoys, growth cards, degraded metadata and perturbed state, all drawn from hashes of the row's own ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memjoin.functions.hashing import fnv1a64, fnv1a64_text, umod, unit_mod
from memjoin.operators.features import let

# Decoy families with their texts and states, fallback texts, growth words and texts.
FAMILY_ALIASES = {
    "semantic_query_echo_negative": "query_echo",
    "contradicted_positive_negative": "superseded_conflict",
    "same_context_wrong_answer_negative": "answer_shaped",
    "stale_popular_negative": "stale_preference",
    "near_duplicate_non_authoritative_negative": "near_duplicate",
    "same_entity_wrong_time_negative": "same_entity_wrong_time",
    "evidence_adjacent_but_wrong_negative": "evidence_adjacent",
    "stale_preference_negative": "stale_preference",
    "answer_shaped_wrong_fact_negative": "answer_shaped",
}
# role, text, (age_days, use_count, evidence_count, last_outcome, importance)
LEGACY_DECOYS = [
    ("query_echo", "{query} This memory repeats the query wording but is not the evidence-bearing turn.", (5, 24, 4, "ignored", 0.70)),
    ("answer_shaped", "{query} Plausible answer-shaped memory: {answer}. It came from a different session and should be excluded.", (18, 30, 6, "corrected", 0.72)),
    ("superseded_conflict", "{query} Older conflicting note near the accepted evidence: {positive} This note was superseded.", (260, 2, 0, "ignored", 0.42)),
    ("near_duplicate", "{positive} Duplicate-looking memory for {query}; it is not authoritative evidence.", (2, 5, 0, "", 0.50)),
    ("stale_preference", "{query} Stale user preference from an older context. Later evidence replaced it.", (420, 48, 5, "ignored", 0.58)),
    ("same_entity_wrong_time", "{query} Same people and topic, but from the wrong time window. It should not answer the current question.", (180, 12, 2, "ignored", 0.62)),
    ("evidence_adjacent", "{positive} Adjacent context for {query}, but this line is not the evidence-bearing memory.", (6, 20, 3, "ignored", 0.66)),
]
FORENSIC_DECOYS = [
    ("query_echo", "{query} Follow-up note from the same conversation thread."),
    ("answer_shaped", "{query} The remembered response was: {answer}."),
    ("superseded_conflict", "Earlier note near the same topic: {positive}"),
    ("near_duplicate", "{positive} Related note for {query}."),
    ("stale_preference", "{query} Older preference note from a previous session."),
    ("same_entity_wrong_time", "{query} Same topic appeared in a different weekly review."),
    ("evidence_adjacent", "{positive} Adjacent conversation context for {query}."),
]
TRAINING_DECOYS = [
    ("semantic_query_echo_negative", "{query} Follow-up note from the same conversation thread."),
    ("contradicted_positive_negative", "Earlier note near the same topic: {positive}"),
    ("same_context_wrong_answer_negative", "{query} The remembered response was: {answer}."),
    ("stale_popular_negative", "{query} Older preference note from a previous session."),
    ("near_duplicate_non_authoritative_negative", "{positive} Related note for {query}."),
    ("same_entity_wrong_time_negative", "{query} Same topic appeared in a different weekly review."),
    ("evidence_adjacent_but_wrong_negative", "{positive} Adjacent conversation context for {query}."),
    ("stale_preference_negative", "{query} Previous session preference note with similar wording."),
    ("answer_shaped_wrong_fact_negative", "Remembered answer for {query}: {answer}."),
]
EVAL_FALLBACK = ["a nearby conversation note with overlapping entities", "an old memory from the same project", "a similar session turn without the answer"]
TRAINING_FALLBACK = ["a similar looking memory from the same project", "an old preference that no longer applies", "a nearby session note with overlapping terms"]
POSITIVE_LENGTH, SUMMARY_LENGTH = 360, 240
GROWTH_PROJECTS = ["archive", "billing", "research", "ops", "calendar", "personal"]
GROWTH_TOPICS = ["invoice cleanup", "old browser tabs", "meeting notes", "deployment checklist", "reading queue"]
HARD_PREFIXES = ["adversarial_eval::", "synthetic_hard_negative::"]


def stable_pick(values: list[str], key: Column) -> Column:
    """One of the values, by the hash of the key."""
    return hash_pick(values, fnv1a64(key))


def hash_pick(values: list[str], hashed: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (umod(hashed, len(values)) + 1).cast("int"))


def stable_row_pick(keys: DataFrame, rows: DataFrame, by: str, order: str, key: str = "key") -> DataFrame:
    """Each key row joined to one of its group's rows: the one at place `hash(key) % group size` in `order`."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    asked = keys.withColumn("_hash", fnv1a64_text(F.col(key))).join(counts, by).withColumn("_place", umod(F.col("_hash"), F.col("_n")).cast("int")).drop("_n", "_hash")
    return asked.join(rows.withColumn("_place", place), [by, "_place"]).drop("_place")


def is_hard_negative(identifier: Column) -> Column:
    return identifier.startswith(HARD_PREFIXES[0]) | identifier.startswith(HARD_PREFIXES[1])


def pick_families(templates: list[tuple], include: set[str] = frozenset(), exclude: set[str] = frozenset(), profile: str = "mixed") -> list[tuple]:
    """Templates whose family is asked for and not excluded; training role names are read as their family."""

    def family(name: str) -> str:
        return FAMILY_ALIASES.get(name, name)

    wanted, unwanted = {family(f) for f in include}, {family(f) for f in exclude}
    unknown = (wanted | unwanted) - {family(t[0]) for t in templates}
    if unknown:
        raise ValueError(f"unknown decoy families: {', '.join(sorted(unknown))}")
    kept = [t for t in templates if (not wanted or family(t[0]) in wanted) and family(t[0]) not in unwanted and profile in ("mixed", t[0])]
    if not kept:
        raise ValueError("the family filters removed every decoy template")
    return kept


def _rendered(template: Column, query: Column, answer: Column, positive: Column) -> Column:
    # placeholders are filled by splitting, so that a value holding a placeholder's name is not filled again
    parts = F.split(F.replace(F.replace(F.replace(template, F.lit("{query}"), F.lit("\x01q\x01")), F.lit("{answer}"), F.lit("\x01a\x01")), F.lit("{positive}"), F.lit("\x01p\x01")), "\x01")
    filled = F.transform(parts, lambda p: F.when(p == "q", query).when(p == "a", answer).when(p == "p", positive).otherwise(p))
    return F.trim(F.array_join(filled, ""))


def decoy_cards(questions: DataFrame, donors: DataFrame, count: int, templates: list[tuple], fallback: list[str], prefix: str) -> DataFrame:
    """`count` decoys per question: family and donor by hash of `qa:query:i:relevant`, state taken from the donor card.

    `questions`: uid, qa_id, query, answer, positive, relevant (sorted array of ids); `donors`: uid, qa_id, id and card
    columns - the record's cards that are not relevant to the question.
    """
    rows = questions.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i"))
    key = F.concat_ws(":", "qa_id", "query", F.col("i").cast("string"), F.array_join("relevant", ","))
    table = F.array(*[F.struct(F.lit(t[0]).alias("role"), F.lit(t[1]).alias("template")) for t in templates])
    keyed = rows.withColumn("key", key).withColumn("hash", fnv1a64_text(F.col("key")))
    chosen = F.element_at(table, (umod(F.col("hash"), len(templates)) + 1).cast("int"))
    positive = F.coalesce(F.when(F.col("positive") != "", F.col("positive")), hash_pick(fallback, F.col("hash")))
    answer = F.coalesce(F.when(F.col("answer") != "", F.col("answer")), F.lit("unknown"))
    written = keyed.withColumn("t", chosen).withColumn("text", _rendered(F.col("t.template"), F.col("query"), answer, positive))
    base = written.select("uid", "qa_id", F.concat_ws("|", F.col("uid").cast("string"), "qa_id").alias("g"), "i", "key", "text", F.col("t.role").alias("role"), F.concat(F.lit(prefix), "qa_id", F.lit("::"), F.col("i").cast("string")).alias("id"))
    state = donors.select(
        F.concat_ws("|", F.col("uid").cast("string"), "qa_id").alias("g"), F.col("id").alias("donor"), F.col("summary").substr(1, SUMMARY_LENGTH).alias("summary"), "cluster",
        F.when(F.col("importance") == 0, 0.5).otherwise(F.col("importance")).alias("importance"), "age_days", "use_count", "evidence_count", "last_outcome",
    )
    return stable_row_pick(base, state, "g", "donor").drop("g")


def legacy_states(decoys: DataFrame, project: Column, templates: list[tuple] = LEGACY_DECOYS) -> DataFrame:
    """Decoys of the legacy style: usage state by family in place of the donor's, age moved by the hash of `key:age`."""

    def of(place: int, kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for family, _, state in templates:
            out = F.when(F.col("role") == family, F.lit(state[place]).cast(kind)).otherwise(out)
        return out

    moved = umod(F.col("_age"), 9)
    state = {
        "summary": F.lit(""), "cluster": project, "age_days": of(0, "bigint") + moved, "use_count": of(1, "bigint"), "evidence_count": of(2, "bigint"),
        "last_outcome": of(3, "string"), "importance": of(4, "double"),
    }
    return decoys.withColumn("_age", fnv1a64_text(F.concat("key", F.lit(":age")))).withColumns(state).drop("_age")


def training_labels(decoys: DataFrame, include_weight: float, label_weight: float, max_rank: int = 16) -> DataFrame:
    """Decoys as training rows: fixed labels and weights, hash-drawn base rank and score."""
    drawn = decoys.withColumns({f"_{name}": fnv1a64_text(F.concat("key", F.lit(f":{name}"))) for name in ("rank", "score")})
    rank = 1 + umod(F.col("_rank"), max_rank)
    score = 0.65 + 0.30 * unit_mod(F.col("_score"), 1000)
    return drawn.select(*decoys.columns, F.lit(0.0).alias("include_label"), F.lit(include_weight).alias("include_weight"), F.lit(label_weight).alias("label_weight"), rank.alias("base_rank"), score.alias("base_score"))


def calibration_rows(ranked: DataFrame, relevance: DataFrame, decoys: DataFrame, limit: int, near_miss: float, inject: bool = True) -> DataFrame:
    """Training candidates per query: the ranked pool, relevant ids it missed, decoys; capped with relevant and decoys first.

    `decoys`: q, id, base_rank, base_score, include_label, include_weight.
    """
    rel = relevance.select("q", "id").distinct().withColumn("hit", F.lit(1))
    pool = ranked.where(F.col("rank") <= limit).join(rel, ["q", "id"], "left")
    miss = F.greatest(F.lit(1.0), near_miss / F.least(F.greatest(F.col("rank"), F.lit(1)), F.lit(32)))
    rows = pool.select(
        "q", "id", F.col("rank").alias("base_rank"), F.col("score").alias("base_score"), F.coalesce("hit", F.lit(0)).cast("double").alias("include_label"),
        F.when(F.col("hit") == 1, 1.0).otherwise(miss).alias("include_weight"), (F.col("hit") == 1).alias("forced"), F.lit(0).alias("part"),
    )
    if inject:
        lost = rel.join(pool.select("q", "id"), ["q", "id"], "left_anti")
        room = ranked.where(F.col("rank") <= limit).groupBy("q").agg(F.count(F.lit(1)).alias("held"))
        place = F.row_number().over(Window.partitionBy("q").orderBy("id"))
        added = lost.join(room, "q", "left").withColumn("n", place).where(F.coalesce("held", F.lit(0)) + F.col("n") <= F.greatest(F.lit(limit), F.coalesce("held", F.lit(0)) + 1))
        rows = rows.unionByName(added.select("q", "id", F.lit(limit + 1).alias("base_rank"), F.lit(-1.0).alias("base_score"), F.lit(1.0).alias("include_label"), F.lit(1.0).alias("include_weight"), F.lit(True).alias("forced"), F.lit(1).alias("part")))
    rows = rows.unionByName(decoys.select("q", "id", F.col("base_rank").cast("int").alias("base_rank"), "base_score", "include_label", "include_weight", F.lit(True).alias("forced"), F.lit(2).alias("part")))
    return priority_cap(rows.fillna(False, ["forced"]).withColumn("gap", F.max("base_score").over(Window.partitionBy("q")) - F.col("base_score")), limit)


def priority_cap(df: DataFrame, limit: int, order: tuple[str, ...] = ("part", "base_rank", "id")) -> DataFrame:
    """At most `limit` rows per query, forced rows before the others, each in their own order."""
    window = Window.partitionBy("q").orderBy(F.col("forced").desc(), *order)
    return df.withColumn("slot", F.row_number().over(window)).where(F.col("slot") <= limit)


def growth_cards(cases: DataFrame, scenario: str, count: int, seed: int) -> DataFrame:
    """`count` added cards per case. `cases`: q, query, positive (relevant texts joined), bases (relevant texts in id order), project."""
    if scenario == "combined":
        quarter = count // 4
        parts = [("unrelated", quarter), ("semantic_decoy", quarter), ("conflict", quarter), ("repeated", count - 3 * quarter)]
        out = None
        for name, n in parts:
            if n > 0:
                df = growth_cards(cases, name, n, seed)
                out = df if out is None else out.unionByName(df)
        return out
    rows = cases.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i"))
    i, text_i = F.col("i"), F.col("i").cast("string")

    def drawn(name: str, n: int) -> Column:
        return umod(fnv1a64(F.concat(F.lit(f"{seed}:{name}:"), text_i)), n)

    tag = F.concat(F.lit(f"{seed}-"), text_i)
    if scenario == "unrelated":
        project, topic = stable_pick(GROWTH_PROJECTS, F.concat(F.lit(f"{seed}:unrelated:project:"), text_i)), stable_pick(GROWTH_TOPICS, F.concat(F.lit(f"{seed}:unrelated:topic:"), text_i))
        text = F.concat(project, F.lit(": unrelated growth memory "), tag, F.lit(" about "), topic, F.lit("; no current escalation path applies."))
        state = (drawn("age", 180), drawn("use", 9), drawn("ev", 4), stable_pick(["", "", "helpful", "ignored"], F.concat(F.lit(f"{seed}:outcome:"), text_i)), 0.25 + 0.25 * drawn("imp", 100) / 100.0, project)
        name, role = "hard_unrelated", "hard_unrelated_growth"
    elif scenario == "semantic_decoy":
        text = F.concat("query", F.lit(" Candidate branch "), tag, F.lit(" repeats the route words, but it is a decoy: do not use it as the accepted resolution."))
        state = (1 + i % 7, 18 + i % 13, 6 + i % 5, F.when(i % 2 == 1, "ignored").otherwise("corrected"), F.lit(0.72), F.col("project"))
        name, role = "hard_semantic_decoy", "hard_semantic_decoy"
    elif scenario == "conflict":
        text = F.concat("query", F.lit(" Conflict record "), tag, F.lit(": older note resembles the accepted path, but contradicts it. Relevant path said: "), F.col("positive").substr(1, 180), F.lit(". This record is superseded."))
        state = (220 + i % 180, F.when(i % 3 != 0, 0).otherwise(2), F.when(i % 2 != 0, 0).otherwise(1), F.lit("ignored"), F.lit(0.38), F.col("project"))
        name, role = "hard_conflict", "hard_conflict_decoy"
    elif scenario == "repeated":
        source = F.when(F.size("bases") > 0, F.get("bases", i % F.greatest(F.size("bases"), F.lit(1)))).otherwise(F.col("query"))
        text = F.concat(F.lit("Repeated insert copy "), tag, F.lit(": "), source, F.lit(" This is a repeated non-authoritative duplicate."))
        state = (F.lit(0), F.lit(1), F.lit(0), F.lit(""), F.lit(0.44), F.col("project"))
        name, role = "hard_repeated", "hard_repeated_duplicate"
    else:
        raise ValueError(f"unknown growth scenario: {scenario}")
    age, use, evidence, outcome, importance, project = state
    return rows.select(
        "q", F.concat(F.lit(f"{name}_{seed}_"), text_i).alias("id"), text.alias("text"), F.lit(role).alias("role"), age.cast("bigint").alias("age_days"), use.cast("bigint").alias("use_count"),
        evidence.cast("bigint").alias("evidence_count"), outcome.alias("last_outcome"), importance.cast("double").alias("importance"), project.alias("project"),
    )


def degrade_metadata(cards: DataFrame, domains: dict[str, list[str]], availability: float, wrong_rate: float, seed: int) -> DataFrame:
    """Drop or falsify user, project and brand by hash draws of the id. `cards`: id, user_id, project, brand, session_id, cluster."""

    def roll(name: str) -> Column:
        return unit_mod(fnv1a64(F.concat(F.lit(f"{seed}:metadata_{name}:"), F.col("id").cast("string"))), 1_000_000)

    dropped = roll("keep") >= availability
    wrong = ~dropped & (roll("wrong") < wrong_rate)

    def falsified(field: str, short: str) -> Column:
        others = F.filter(F.array(*[F.lit(v) for v in domains[field]]), lambda v: v != F.col(field))
        key = fnv1a64(F.concat(F.lit(f"{seed}:wrong_{short}:"), F.col("id").cast("string")))
        return let(others, lambda o: F.get(o, umod(key, F.size(o)).cast("int")))

    fields = {"user_id": "user", "project": "project", "brand": "brand"}
    marked = cards.select("*", dropped.alias("dropped"), wrong.alias("falsified"), *[falsified(f, s).alias(f"wrong_{f}") for f, s in fields.items()])
    corrupt = F.concat("wrong_user_id", F.lit("_"), "wrong_project", F.lit("_corrupt_"), F.lpad(umod(fnv1a64(F.col("id").cast("string")), 100_000).cast("string"), 5, "0"))

    def value(plain: str, other: Column) -> Column:
        return F.when(F.col("dropped"), "").when(F.col("falsified"), other).otherwise(F.col(plain)).alias(plain)

    kept = [c for c in cards.columns if c not in ("user_id", "project", "brand", "session_id", "cluster")]
    return marked.select(
        *kept, *[value(f, F.col(f"wrong_{f}")) for f in fields], value("session_id", F.when(F.col("session_id") != "", corrupt).otherwise("")),
        F.when(F.col("falsified"), F.col("wrong_project")).otherwise(F.col("cluster")).alias("cluster"), "dropped", "falsified",
    )


def perturb_state(cards: DataFrame, mode: str, rate: float, seed: int) -> DataFrame:
    """Corrupt usage state of a share of the cards; every draw is a hash of seed, id and field, so order plays no part."""

    def draw(name: str, n: int = 1_000_000) -> Column:
        return umod(fnv1a64(F.concat(F.lit(f"{seed}:{name}:"), F.col("id").cast("string"))), n)

    def share(name: str) -> Column:
        return draw(name) / 1e6

    def between(name: str, low: float, high: float) -> Column:
        return low + (high - low) * share(name)

    def choice(name: str, values: list) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), draw(name, len(values)).cast("int"))

    hit = share("hit") < rate
    outcomes = ["", "helpful", "ignored", "corrected"]
    base = F.when(F.col("importance") == 0, 0.5).otherwise(F.col("importance"))
    if mode == "mild":
        new = {
            "use_count": F.floor(F.round(F.col("use_count") * between("use", 0.4, 1.8), 9)), "evidence_count": F.floor(F.round(F.col("evidence_count") * between("evidence", 0.5, 1.7), 9)),
            "importance": F.least(F.lit(0.95), F.greatest(F.lit(0.05), base + between("importance", -0.18, 0.18))), "last_outcome": F.when(share("flip") < 0.35, choice("outcome", outcomes)).otherwise(F.col("last_outcome")),
        }
    elif mode == "strong":
        new = {
            "use_count": choice("use", [0, 0, 1, 5, 21, 89, 144]), "evidence_count": choice("evidence", [0, 1, 3, 8, 21, 55]), "importance": choice("importance", [0.08, 0.18, 0.35, 0.65, 0.82, 0.94]),
            "last_outcome": choice("outcome", outcomes), "age_days": F.when(share("flip") < 0.2, choice("age", [0, 1, 14, 180, 365, 720])).otherwise(F.col("age_days")),
        }
    else:
        raise ValueError(f"unknown perturbation: {mode}")
    types = dict(cards.dtypes)
    return cards.select(*[F.when(hit, new[c].cast(types[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in cards.columns], hit.alias("perturbed"))


def mined_negatives(scored: DataFrame, relevance: DataFrame, hard: int, random: int, seed: int) -> DataFrame:
    """(q, id, kind): relevant ids, the `hard` closest others and `random` of the rest by hash. Queries lacking a side are dropped.

    `scored`: q, id, score.
    """
    rel = relevance.select("q", "id").distinct()
    positives = scored.join(rel, ["q", "id"], "left_semi").select("q", "id", F.lit("positive").alias("kind"))
    others = scored.join(rel, ["q", "id"], "left_anti")
    close = F.row_number().over(Window.partitionBy("q").orderBy(F.round("score", 9).desc(), "id"))
    placed = others.withColumn("n", close)
    draw = fnv1a64(F.concat(F.lit(f"{seed}:"), F.col("q").cast("string"), F.lit(":"), F.col("id").cast("string")))
    rest = placed.where(F.col("n") > hard).withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy(draw, "id"))).where(F.col("k") <= random)
    negatives = placed.where(F.col("n") <= hard).select("q", "id", F.lit("hard").alias("kind")).unionByName(rest.select("q", "id", F.lit("random").alias("kind")))
    both = positives.select("q").distinct().join(negatives.select("q").distinct(), "q", "left_semi")
    return positives.unionByName(negatives).join(both, "q", "left_semi")

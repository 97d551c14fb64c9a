"""Basin, segment, grid and routing graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from memjoin.functions.hashing import activation_mask, hash_embedding
from memjoin.functions.state import card_state, falsy_default, state_score
from memjoin.functions.text import tokens
from memjoin.operators import basin_tree as B
from memjoin.operators import grids as G
from memjoin.operators import routing as R
from memjoin.operators import vector as V
from memjoin.plans import records_sql as Q
from memjoin.plans import sqltext as S
from memjoin.plans.registry import query
from memjoin.sources import records, tables

OUT = "SELECT q, id, round(score, 6) AS score, rank FROM "


def shape(df):
    return df.select("q", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def cards(spark, sf_dir):
    toks = tokens(F.col("text"))
    return records.cards(spark, sf_dir).select(
        "*", activation_mask(toks).alias("mask"), hash_embedding(toks).alias("vec"), falsy_default(F.col("importance"), 0.5).alias("weighty"), state_score(card_state()).alias("state")
    )


_contains = lambda terms: " OR ".join(f"contains(lower(text), '{t}')" for t in terms)
_first = f"list_filter({S.toks('text')}, lambda t: length(t) > 3)[1]"
_bucket = f"'bucket_' || lpad(({S.fnv(_first)} % 16)::VARCHAR, 2, '0')"
PROMO = """greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.20::DOUBLE + 0.30::DOUBLE * (CASE WHEN importance = 0 THEN 0.5 ELSE importance END)
  + 0.18::DOUBLE * least(1.0::DOUBLE, ln(1.0::DOUBLE + use_count) / ln(101.0::DOUBLE)) + 0.16::DOUBLE * least(1.0::DOUBLE, ln(1.0::DOUBLE + evidence_count) / ln(51.0::DOUBLE))
  + 0.09::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - age_days / 365.0::DOUBLE)
  + CASE last_outcome WHEN 'helpful' THEN 0.22 WHEN 'corrected' THEN 0.07 WHEN 'ignored' THEN -0.20 ELSE 0.0 END::DOUBLE
  + CASE WHEN protected THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN age_days >= 180 AND use_count <= 0 AND NOT protected THEN 0.18::DOUBLE ELSE 0.0::DOUBLE END))"""
PLACED = f"""plc AS (SELECT c.*, cm.mask, lower(replace(c.speaker, ' ', '_')) AS project,
  CASE WHEN {_contains(B.RESOLUTION_TERMS)} THEN 'resolution' WHEN {_contains(B.ESCALATION_TERMS)} THEN 'escalation' WHEN {_contains(B.CONFLICT_TERMS)} THEN 'conflict'
    WHEN {_first} IS NULL THEN 'misc' ELSE {_bucket} END AS topic,
  'a' || lpad((cm.mask % 32)::VARCHAR, 2, '0') AS route, {PROMO} AS promotion,
  CASE WHEN importance = 0 THEN 0.5 ELSE importance END AS weighty FROM cards c JOIN cm ON cm.id = c.id),
pro AS (SELECT *, promotion + 0.06::DOUBLE * weighty + 0.02::DOUBLE * ({S.fnv('id')} % 10000000)::DOUBLE / 1e7 AS priority, """ + ", ".join(
    f"({S.fnv(f'''id || ':promote:{level}' ''')} % 10000000)::DOUBLE / 1e7 <= round(least(0.95::DOUBLE, promotion * {share}::DOUBLE), 9) AS promote_{level}"
    for level, share in B.LEVEL_SHARE.items()
) + " FROM plc)"
FLAGS = """(CASE WHEN protected THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'superseded') OR contains(lower(text), 'contradicts') THEN 2 ELSE 0 END
  + CASE WHEN last_outcome = 'ignored' THEN 4 ELSE 0 END + CASE WHEN age_days >= 180 AND use_count <= 0 THEN 8 ELSE 0 END)"""
CARD_MASKS = ",\n".join([Q.CARDS, S.masks("cm", "cards", "id")])


@query("f25_route_keys", S.with_(CARD_MASKS, PLACED) + "SELECT id, project, topic, route FROM pro")
def route_keys(spark, sf_dir):
    return B.placed(cards(spark, sf_dir)).select("id", "project", "topic", "route")


@query("f26_state_flags", S.with_(Q.CARDS) + f"SELECT id, {FLAGS}::BIGINT AS flags FROM cards")
def flags(spark, sf_dir):
    return records.cards(spark, sf_dir).select("id", G.state_flags(F.col("text"), F.lit("")).cast("bigint").alias("flags"))


@query("v11_state_score", S.with_(S.MEM) + f"SELECT id, round({Q.state_score()}, 6) AS score FROM mem")
def v11(spark, sf_dir):
    return tables.memories(spark, sf_dir).select("id", F.round(state_score(card_state()), 6).alias("score"))


@query(
    "v12_promotion_score_and_draw",
    S.with_(CARD_MASKS, PLACED) + "SELECT id, round(promotion, 6) AS promotion, round(priority, 6) AS priority, promote_0, promote_1, promote_2 FROM pro",
)
def promotion(spark, sf_dir):
    return B.placed(cards(spark, sf_dir)).select(
        "id", F.round("promotion", 6).alias("promotion"), F.round("priority", 6).alias("priority"), "promote_0", "promote_1", "promote_2"
    )


def _label_masks(name: str, source: str, text: str) -> str:
    """CTE `{name}` = `{source}` with `label_mask`."""
    return f"""{name}_x AS (SELECT DISTINCT {text} AS label FROM {source}),
{S.masks(name + '_m', name + '_x', 'label', 'label')},
{name} AS (SELECT s.*, m.mask AS label_mask FROM {source} s JOIN {name}_m m ON m.label = {text})"""


LEVELS = ",\n".join(
    [
        "l2 AS (SELECT q, project, topic, route, bit_or(mask) AS mask, count(*) AS child_count FROM pro GROUP BY ALL)",
        "v2 AS (SELECT q, project, topic, route, idx, sum(v) / any_value(n) AS v FROM (SELECT p.q, p.project, p.topic, p.route, cv.idx, cv.v, l2.child_count AS n FROM pro p JOIN l2 USING (q, project, topic, route) JOIN cv ON cv.id = p.id) GROUP BY ALL)",
        _label_masks("k2", "l2", "'route memory basin ' || project || ':' || topic || ':' || route"),
        "l1 AS (SELECT q, project, topic, bit_or(label_mask) AS mask, count(*) AS child_count FROM k2 GROUP BY ALL)",
        "v1 AS (SELECT q, project, topic, idx, sum(v) / any_value(n) AS v FROM (SELECT v2.*, l1.child_count AS n FROM v2 JOIN l1 USING (q, project, topic)) GROUP BY ALL)",
        _label_masks("k1", "l1", "'topic memory basin ' || project || ':' || topic"),
        "l0 AS (SELECT q, project, bit_or(label_mask) AS mask, count(*) AS child_count FROM k1 GROUP BY ALL)",
        "v0 AS (SELECT q, project, idx, sum(v) / any_value(n) AS v FROM (SELECT v1.*, l0.child_count AS n FROM v1 JOIN l0 USING (q, project)) GROUP BY ALL)",
        """bas AS (SELECT q, 2 AS level, project || ':' || topic || ':' || route AS key, project || ':' || topic AS parent, project, mask, child_count FROM l2
  UNION ALL SELECT q, 1, project || ':' || topic, project, project, mask, child_count FROM l1 UNION ALL SELECT q, 0, project, '', project, mask, child_count FROM l0)""",
        """bav AS (SELECT q, project || ':' || topic || ':' || route AS key, idx, v FROM v2 UNION ALL SELECT q, project || ':' || topic, idx, v FROM v1 UNION ALL SELECT q, project, idx, v FROM v0)""",
    ]
)
PLACED_ALL = ",\n".join([CARD_MASKS, S.hash_vectors("cv", "cards", "id"), PLACED])


@query(
    "j33_basin_rollup",
    S.with_(PLACED_ALL, LEVELS)
    + f"""SELECT b.q, level::BIGINT AS level, b.key, parent, child_count, {S.signed('b.mask::HUGEINT')} AS mask, round(coalesce(e.norm2, 0.0), 6) AS norm2 FROM bas b
      LEFT JOIN (SELECT q, key, sum(v * v) AS norm2 FROM bav GROUP BY ALL) e ON e.q = b.q AND e.key = b.key""",
)
def rollup(spark, sf_dir):
    levels = B.basin_levels(B.placed(cards(spark, sf_dir)), 64)
    out = None
    for level, df in levels.items():
        rows = df.select("q", F.lit(level).cast("bigint").alias("level"), "key", "parent", "child_count", "mask", F.round(V.dot(F.col("vec"), F.col("vec")), 6).alias("norm2"))
        out = rows if out is None else out.unionByName(rows)
    return out


LEAF = "(0.36::DOUBLE * semantic + 0.22::DOUBLE * lexical + 0.18::DOUBLE * activation + 0.11::DOUBLE * same_cluster + 0.13::DOUBLE * weighty + state)"


def _descent_sql(floor: float, beam: int, promoted: int) -> str:
    parts = [
        Q.PAIRS, PLACED, LEVELS, Q.EDGES,
        "tn AS (SELECT q, sqrt(sum(v * v)) AS n FROM tv GROUP BY q)",
        "bn AS (SELECT q, key, sqrt(sum(v * v)) AS n FROM bav GROUP BY ALL)",
        "bc AS (SELECT b.q, b.key, sum(b.v * t.v) AS d FROM bav b JOIN tv t ON t.q = b.q AND t.idx = b.idx GROUP BY ALL)",
        f"""bs AS (SELECT b.q, b.level, b.key, b.parent, 0.36::DOUBLE * CASE WHEN tn.n > 0 AND bn.n > 0 THEN coalesce(bc.d, 0.0) / (tn.n * bn.n) ELSE 0.0 END
  + 0.22::DOUBLE * {S.jac(S.tset('t.query'), S.tset("(['project', 'topic', 'route'][b.level + 1] || ' memory basin ' || b.key)"))}
  + 0.18::DOUBLE * {S.coverage('tm.mask', 'b.mask')} + 0.11::DOUBLE * (lower(t.anchor_speaker) = lower(b.project))::INT + 0.035::DOUBLE AS score
  FROM bas b JOIN task t USING (q) JOIN tm ON tm.q = b.q LEFT JOIN tn ON tn.q = b.q LEFT JOIN bn ON bn.q = b.q AND bn.key = b.key LEFT JOIN bc ON bc.q = b.q AND bc.key = b.key)""",
    ]
    for level in (0, 1, 2):
        source = "bs b" if level == 0 else f"bs b SEMI JOIN kp{level - 1} k ON k.q = b.q AND k.key = b.parent"
        parts.append(
            f"""kp{level} AS (SELECT q, key FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, key) AS rank, max(round(score, 9)) OVER (PARTITION BY q) AS best
  FROM (SELECT b.* FROM {source} WHERE b.level = {level})) WHERE round(score, 9) >= {floor} OR (best < {floor} AND rank <= {beam}))"""
        )
        key = ["project", "project || ':' || topic", "project || ':' || topic || ':' || route"][level]
        parts.append(
            f"""pr{level} AS (SELECT q, id, {0.03 * (3 - level)}::DOUBLE AS bonus FROM (SELECT p.q, p.id, row_number() OVER (PARTITION BY p.q, {key} ORDER BY p.id) AS n FROM pro p
  SEMI JOIN kp{level} k ON k.q = p.q AND k.key = {key} WHERE promote_{level}) WHERE n <= {promoted})"""
        )
    parts += [
        "lv AS (SELECT p.q, p.id, 0.0::DOUBLE AS bonus FROM pro p SEMI JOIN kp2 k ON k.q = p.q AND k.key = project || ':' || topic || ':' || route)",
        f"lf AS (SELECT q, id, {LEAF} AS leaf FROM pairs)",
        "base AS (SELECT q, id, leaf + bonus AS score FROM (SELECT q, id, max(bonus) AS bonus FROM (SELECT * FROM pr0 UNION ALL SELECT * FROM pr1 UNION ALL SELECT * FROM pr2 UNION ALL SELECT * FROM lv) GROUP BY q, id) JOIN lf USING (q, id))",
        f"seeds AS ({S.ranked('(SELECT b.* FROM base b SEMI JOIN edges e ON e.q = b.q AND e.source = b.id)')})",
        "wk AS (SELECT e.*, lf.leaf FROM sedge e JOIN lf ON lf.q = e.q AND lf.id = e.target)",
        Q.expand("x", "base", "seeds", "wk", 2, lambda d: f"0.58::DOUBLE * f.score + 0.42::DOUBLE * e.leaf + {Q.hop_gain(d)}"),
        "fin AS (SELECT x.q, x.id, x.score, s.id IS NOT NULL OR x.votes > 0 AS shielded FROM xbest x LEFT JOIN seeds s ON s.q = x.q AND s.id = x.id)",
    ]
    return S.with_(*parts) + f"SELECT q, id, round(score, 6) AS score, shielded, rank FROM ({S.ranked('fin')})"


@query("j34_basin_descent", _descent_sql(0.32, 2, 8))
def descent(spark, sf_dir):
    pairs = records.pairs(spark, sf_dir)
    tasks = records.task_side(spark, sf_dir).select("q", "q_vec", "q_set", "q_mask", "anchor_speaker")
    scored = pairs.withColumn("leaf", B.leaf_score())
    out = B.descend(tasks, B.placed(cards(spark, sf_dir)), scored, records.scored_edges(spark, sf_dir, pairs), 64, 0.32, 2, 8, 2)
    return out.select("q", "id", F.round("score", 6).alias("score"), "shielded", F.col("rank").cast("bigint").alias("rank"))


def scan_pairs(spark, sf_dir):
    """`records.pairs` with the int8 product and the state flags."""
    pairs = records.pairs(spark, sf_dir)
    q_vec = records.task_side(spark, sf_dir).select("q", "q_vec")
    vec = records.cards(spark, sf_dir).select("id", hash_embedding(tokens(F.col("text"))).alias("vec"))
    quant = pairs.select("q", "id").join(q_vec, "q").join(vec, "id").select(
        "q", "id", V.dot_int8(V.quantize_int8(F.col("q_vec")), V.quantize_int8(F.col("vec"))).alias("int8")
    )
    return pairs.join(quant, ["q", "id"]).withColumn("flags", G.state_flags(F.col("text"), F.lit("")))


def _penalty(values):
    return "".join(f" - CASE WHEN {FLAGS} & {bit} <> 0 THEN {v}::DOUBLE ELSE 0.0::DOUBLE END" for bit, v in values.items())


INT8 = """i8 AS (SELECT c.id, sum(greatest(-127, least(127, round_even(a.v * 127.0, 0))) * greatest(-127, least(127, round_even(b.v * 127.0, 0)))) / 16129.0::DOUBLE AS int8
  FROM cards c JOIN cv a ON a.id = c.id JOIN tv b ON b.q = c.q AND b.idx = a.idx GROUP BY c.id)"""


@query(
    "j35_quantised_segment_scan",
    S.with_(
        Q.PAIRS, Q.EDGES, INT8,
        f"""sc AS (SELECT q, id, 0.48::DOUBLE * coalesce(i8.int8, 0.0) + 0.22::DOUBLE * activation + 0.11::DOUBLE * same_cluster + 0.07::DOUBLE * weighty + state{_penalty(G.SCAN_PENALTY)} AS base
          FROM pairs LEFT JOIN i8 USING (id))""",
        f"cut AS (SELECT q, id, score FROM (SELECT *, row_number() OVER (PARTITION BY q, segment ORDER BY round(score, 9) DESC, id) AS n FROM (SELECT q, id, base AS score, ({S.fnv('id')} % 3)::INT AS segment FROM sc)) WHERE n <= 1)",
        f"seeds AS (SELECT * FROM ({S.ranked('cut')}) WHERE rank <= 2)",
        "wk AS (SELECT e.*, sc.base FROM sedge e JOIN sc ON sc.q = e.q AND sc.id = e.target)",
        Q.expand("x", "cut", "seeds", "wk", 2, lambda d: f"0.58::DOUBLE * f.score + 0.42::DOUBLE * e.base + {Q.hop_gain(d)}"),
    )
    + OUT + f"({S.ranked('xbest')}) WHERE rank <= 5",
)
def segment_scan(spark, sf_dir):
    pairs = scan_pairs(spark, sf_dir)
    edges = records.scored_edges(spark, sf_dir, pairs)
    scored = pairs.select("q", "id", G.scan_score().alias("base"))
    return shape(G.segment_scan(scored, edges, 3, 1, 2, 2, 5))


TRIPLES = G.dim_triples(64, 16)
CELL, MIN_DELTA, MIN_LAYERS, MAX_LAYERS = 0.08, 0.25, 2, 6




def card_cells(spark, sf_dir, base):
    origin = base.groupBy("q").agg(F.min_by("vec", "id").alias("origin"))
    rows = base.join(origin, "q").select("q", "id", "vec", "origin")
    return G.grid_cells(rows, "id", TRIPLES, CELL, MIN_DELTA, MIN_LAYERS, MAX_LAYERS), origin


def _cells_sql(name: str, rows: str, key: str) -> str:
    """CTE `{name}` (q, key, layer, x, y, z); `rows` is (q, key, d, delta) with delta = v - origin per dimension."""
    triple = ", ".join(f"({n}, {a}, {b}, {c})" for n, (a, b, c) in enumerate(TRIPLES))
    cell = lambda d: f"greatest(-32768, least(32767, floor(round({d} / {CELL}, 9))::INT))"
    return f"""{name}_e AS (SELECT r0.q, r0.{key}, t.layer, round(abs(r0.delta) + abs(r1.delta) + abs(r2.delta), 9) AS energy, {cell('r0.delta')} AS x, {cell('r1.delta')} AS y, {cell('r2.delta')} AS z
  FROM (SELECT * FROM (VALUES {triple}) v(layer, a, b, c)) t JOIN {rows} r0 ON r0.d = t.a JOIN {rows} r1 ON r1.q = r0.q AND r1.{key} = r0.{key} AND r1.d = t.b JOIN {rows} r2 ON r2.q = r0.q AND r2.{key} = r0.{key} AND r2.d = t.c),
{name} AS (SELECT q, {key}, layer, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY q, {key} ORDER BY energy DESC, layer) - 1 AS place FROM {name}_e)
  WHERE (energy >= {MIN_DELTA} OR place < {MIN_LAYERS}) AND place < {MAX_LAYERS})"""


GRID = ",\n".join(
    [
        "dm AS (SELECT unnest(range(0, 64))::INT AS d)",
        "org AS (SELECT q, min(id) AS id FROM cards GROUP BY q)",
        "ov AS (SELECT o.q, dm.d, coalesce(cv.v, 0.0) AS v FROM org o CROSS JOIN dm LEFT JOIN cv ON cv.id = o.id AND cv.idx = dm.d)",
        "cd AS (SELECT c.q, c.id, ov.d, coalesce(cv.v, 0.0) - ov.v AS delta FROM cards c JOIN ov USING (q) LEFT JOIN cv ON cv.id = c.id AND cv.idx = ov.d)",
        "td AS (SELECT t.q, 0 AS id, ov.d, coalesce(tv.v, 0.0) - ov.v AS delta FROM task t JOIN ov USING (q) LEFT JOIN tv ON tv.q = t.q AND tv.idx = ov.d)",
        _cells_sql("cc", "cd", "id"),
        _cells_sql("tc", "td", "id"),
    ]
)


@query(
    "j36_grid_cells",
    S.with_(Q.PAIRS, GRID) + "SELECT q, id, layer::BIGINT AS layer, x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z FROM cc",
)
def grid_cells(spark, sf_dir):
    cells, _ = card_cells(spark, sf_dir, cards(spark, sf_dir))
    return cells.select("q", "id", *[F.col(c).cast("bigint").alias(c) for c in ("layer", "x", "y", "z")])


_near = [(x, y, z, abs(x) + abs(y) + abs(z)) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if abs(x) + abs(y) + abs(z) <= 1]


@query(
    "j37_grid_probe",
    S.with_(
        Q.PAIRS, Q.EDGES, GRID,
        f"""hd AS (SELECT cc.*, row_number() OVER (PARTITION BY cc.q, layer, x, y, z ORDER BY round(p.weighty + p.state{_penalty(G.GRID_PENALTY)}, 9) DESC, {S.fnv('cc.id')}, cc.id) AS n FROM cc JOIN pairs p ON p.q = cc.q AND p.id = cc.id)""",
        f"""ht AS (SELECT t.q, h.id, min(o.dist) AS distance, count(*) AS seen FROM tc t CROSS JOIN (SELECT * FROM (VALUES {', '.join(map(str, _near))}) o(dx, dy, dz, dist)) o
          JOIN hd h ON h.q = t.q AND h.layer = t.layer AND h.x = t.x + o.dx AND h.y = t.y + o.dy AND h.z = t.z + o.dz WHERE h.n <= 3 GROUP BY ALL)""",
        f"""fd AS (SELECT h.q, h.id, h.seen, 0.45::DOUBLE / (1.0::DOUBLE + h.distance) + 0.25::DOUBLE * activation + 0.13::DOUBLE * same_cluster + 0.08::DOUBLE * weighty + state{_penalty(G.GRID_PENALTY)} AS score
          FROM ht h JOIN pairs p ON p.q = h.q AND p.id = h.id)""",
        f"seeds AS (SELECT * FROM ({S.ranked('(SELECT q, id, score + 0.035::DOUBLE * (seen - 1) AS score FROM fd)')}) WHERE rank <= 2)",
        Q.expand("x", "fd", "seeds", "sedge", 2, lambda d: f"0.68::DOUBLE * f.score + {Q.hop_gain(d)}"),
        "fin AS (SELECT x.q, x.id, x.score + 0.035::DOUBLE * greatest(0, coalesce(f.seen, 0) + x.votes - 1) AS score FROM xbest x LEFT JOIN fd f ON f.q = x.q AND f.id = x.id)",
    )
    + OUT + f"({S.ranked('fin')}) WHERE rank <= 6",
)
def grid_probe(spark, sf_dir):
    base = cards(spark, sf_dir).withColumn("flags", G.state_flags(F.col("text"), F.lit("")))
    cells, origin = card_cells(spark, sf_dir, base)
    asked = records.task_side(spark, sf_dir).select("q", F.col("q_vec").alias("vec")).join(origin, "q")
    asked = G.grid_cells(asked.withColumn("probe", F.lit(0)), "probe", TRIPLES, CELL, MIN_DELTA, MIN_LAYERS, MAX_LAYERS)
    pairs = records.pairs(spark, sf_dir)
    flagged = pairs.withColumn("flags", G.state_flags(F.col("text"), F.lit("")))
    heads = G.cell_heads(cells, base, 3)
    return shape(G.grid_probe(asked, heads, flagged, records.scored_edges(spark, sf_dir, pairs), 1, 2, 2, 6))


@query(
    "j40_objective_seeds",
    S.with_(
        Q.PAIRS,
        """o AS (SELECT *, sum((activation > 0)::INT) OVER (PARTITION BY q) AS met FROM pairs)""",
        """s AS (SELECT q, id, CASE WHEN activation > 0 THEN 0.62::DOUBLE * activation + 0.08::DOUBLE * same_cluster + 0.05::DOUBLE * weighty + state
          ELSE 0.66::DOUBLE * semantic + 0.18::DOUBLE * activation + 0.06::DOUBLE * same_cluster + 0.04::DOUBLE * weighty + state END AS score FROM o WHERE activation > 0 OR met < 5)""",
    )
    + OUT + f"({S.ranked('s')}) WHERE rank <= 5",
)
def objective_seeds(spark, sf_dir):
    return shape(R.objective_seeds(records.pairs(spark, sf_dir).withColumn("same_project", F.col("same_cluster")), 5))


ROUTE_LAYERS, PROJECTIONS, WINDOW, DEGREE, THRESHOLD = 2, 3, 6, 4, 96


def route_nodes(spark, sf_dir):
    vec = tables.vectors(spark, sf_dir)
    return vec.select(
        "id", "vec", F.col("label").alias("project"), falsy_default((F.col("id") * 37) % 11 / 10.0, 0.5).alias("weighty"), (F.col("id") % 7 / 100.0).alias("state"),
        R.deterministic_level(F.col("id").cast("string"), ROUTE_LAYERS, THRESHOLD).alias("level"),
    )


def _line_sql() -> str:
    values = ", ".join(
        f"({layer}, {p}, {d}, {s})" for layer in range(ROUTE_LAYERS) for p in range(PROJECTIONS) for d, s in R.route_points(layer, p, 64)
    )
    return f"""nd AS (SELECT vec_id AS id, embedding, label AS project, CASE WHEN (vec_id * 37) % 11 = 0 THEN 0.5::DOUBLE ELSE ((vec_id * 37) % 11) / 10.0::DOUBLE END AS weighty, (vec_id % 7) / 100.0::DOUBLE AS state,
  CASE WHEN {S.fnv('vec_id::VARCHAR')} % 256 < {THRESHOLD} THEN 1 ELSE 0 END AS level FROM embeddings),
rp AS (SELECT * FROM (VALUES {values}) t(layer, projection, dim, sign)),
ln AS (SELECT n.id, r.layer, r.projection, round(sum(r.sign * n.embedding[r.dim + 1]::DOUBLE), 9) AS value FROM nd n JOIN rp r ON n.level >= r.layer GROUP BY ALL),
ps AS (SELECT layer, projection, id, row_number() OVER (PARTITION BY layer, projection ORDER BY value, id) - 1 AS pos FROM ln),
mt AS (SELECT a.layer, a.id AS source, b.id AS target, sum(1.0::DOUBLE / (1 + abs(a.pos - b.pos))) AS near FROM ps a JOIN ps b ON a.layer = b.layer AND a.projection = b.projection
  AND abs(a.pos - b.pos) <= {WINDOW} AND a.id <> b.id GROUP BY ALL),
sc AS (SELECT m.layer, m.source, m.target, near + 0.06::DOUBLE * (s.project = t.project)::INT + 0.04::DOUBLE * t.weighty + t.state
  + ({S.fnv("m.source || '->' || m.target || ':' || m.layer")} % 65536)::DOUBLE / 1e9 AS score FROM mt m JOIN nd s ON s.id = m.source JOIN nd t ON t.id = m.target),
rt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY layer, source ORDER BY round(score, 9) DESC, target) AS rank FROM sc) WHERE rank <= {DEGREE})"""


def neighbours(spark, sf_dir):
    nodes = route_nodes(spark, sf_dir)
    positions = R.projection_positions(nodes, ROUTE_LAYERS, PROJECTIONS, 64)
    return nodes, R.routing_neighbours(nodes, positions, WINDOW, DEGREE)


@query(
    "j41_projection_window_knn_graph",
    S.with_(_line_sql()) + "SELECT layer::BIGINT AS layer, source, target, round(score, 6) AS score, rank FROM rt",
)
def knn_graph(spark, sf_dir):
    _, out = neighbours(spark, sf_dir)
    return out.select(F.col("layer").cast("bigint").alias("layer"), "source", "target", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "j41_reciprocal_routes",
    S.with_(
        _line_sql(),
        "bo AS (SELECT layer, source, target FROM rt UNION SELECT layer, target, source FROM rt)",
        f"rr AS (SELECT b.*, row_number() OVER (PARTITION BY b.layer, b.source ORDER BY round(n.weighty + n.state, 9) DESC, b.target) AS k FROM bo b JOIN nd n ON n.id = b.target)",
    )
    + f"SELECT layer::BIGINT AS layer, source, target FROM rr WHERE k <= {2 * DEGREE}",
)
def reciprocal(spark, sf_dir):
    nodes, out = neighbours(spark, sf_dir)
    return R.with_reciprocals(out, nodes, DEGREE).select(F.col("layer").cast("bigint").alias("layer"), "source", "target")

"""Shared DuckDB fragments for the oracle queries (common table expressions as text)."""

from __future__ import annotations

MEM = """mem AS (
  SELECT d.doc_id AS id, d.text, '' AS summary, d.source AS project, d.source AS cluster, d.lang AS brand,
    'user_' || (d.doc_id % 13) AS user_id, ((d.doc_id * 37) % 11) / 10.0::DOUBLE AS importance,
    (d.n_chars * 7 + d.doc_id) % 500 AS age_days, (d.doc_id * 13 + d.n_chars) % 9 AS use_count, d.n_chars % 5 AS evidence_count,
    CASE WHEN l.toxic = 1 THEN 'ignored' WHEN l.quality = 1 THEN 'helpful' WHEN l.quality = 0 THEN 'corrected' ELSE '' END AS last_outcome,
    d.doc_id % 17 = 0 AS protected
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

QRY = """qry AS (
  SELECT item_id AS q, text, 'user_' || (item_id % 13) AS user_id, 'src' || (item_id % 20) AS project_id,
    ['en','fr','de','es'][(item_id % 4 + 1)::INT] AS brand, 900::BIGINT AS budget FROM benchmark)"""

REL = "rel AS (SELECT b.item_id AS q, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"

TURNS = """turns AS (
  SELECT conv_id AS uid, turn AS pos, conv_id || '_t' || lpad(turn::VARCHAR, greatest(4, length(turn::VARCHAR))::INT, '0') AS id, (turn // 3)::BIGINT AS session, role AS speaker, text
  FROM conversations)"""

FEEDBACK = """fb AS (
  SELECT user_id AS memory_id, ts, event_id AS seq,
    CASE event_type WHEN 'view' THEN 'helpful' WHEN 'click' THEN 'helpful' WHEN 'purchase' THEN 'corrected' WHEN 'error' THEN 'ignored' END AS outcome,
    value > 40.0 AS protected
  FROM events WHERE event_type IN ('view','click','purchase','error'))"""


def toks(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9]+')"


def tset(text: str) -> str:
    return f"list_distinct(list_filter({toks(text)}, lambda t: length(t) > 1))"


def jac(a: str, b: str) -> str:
    """Jaccard of two distinct lists."""
    return (
        f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE"
        f" / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END)"
    )


def cost(text: str) -> str:
    return f"greatest(1, len({toks(text)}))::BIGINT"


def fnv(s: str) -> str:
    """FNV-1a as HUGEINT over the UTF-8 bytes."""
    h = f"hex(encode({s}))"
    octets = f"list_transform(range(1, length({h})::BIGINT, 2), lambda octet_at: ('0x' || substr({h}, octet_at, 2))::INT::HUGEINT)"
    return (
        f"list_reduce(list_prepend(14695981039346656037::HUGEINT, {octets}),"
        " lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
    )


def points(actions: str, dims: int, width: int, name: str = "pts") -> str:
    """CTE (action, dim, sign): projection points read off the hash of `field-action:action:offset`; `actions` is SQL."""
    key = "'field-action:' || a || ':' || o"
    return f"""{name} AS (SELECT a AS action, (h % {dims}::HUGEINT)::INT AS dim, CASE WHEN (h // 8388608::HUGEINT) % 2::HUGEINT = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sign
  FROM (SELECT a, o, {fnv(key)} AS h FROM (SELECT unnest(range(0, ({actions})::BIGINT)) AS a) CROSS JOIN (SELECT unnest(range(0, {width})) AS o)))"""


def signed(h: str) -> str:
    return f"(CASE WHEN {h} >= 9223372036854775808::HUGEINT THEN ({h} - 18446744073709551616::HUGEINT)::BIGINT ELSE ({h})::BIGINT END)"


def ranked(source: str, by: str = "q", tie: str = "id", score: str = "score") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round({score}, 9) DESC, {tie}) AS rank FROM {source}"


def lexical(cap: int | None = None, limit: int = 32) -> str:
    """CTEs `dtok`, `qtok`, `post`, `idf`, `lex` (q, id, score, rank); needs mem and qry."""
    kept = "dtok" if cap is None else f"(SELECT * FROM (SELECT tok, id, row_number() OVER (PARTITION BY tok ORDER BY id) AS pos FROM dtok) WHERE pos <= {cap})"
    return f"""dtok AS (SELECT id, unnest(list_distinct({toks('text')})) AS tok FROM mem),
qtok AS (SELECT q, unnest(list_distinct({toks('text')})) AS tok FROM qry),
post AS (SELECT * FROM {kept}),
idf AS (SELECT tok, ln(1.0 + (SELECT count(*) FROM mem) / count(*)::DOUBLE) AS idf FROM post GROUP BY tok),
lex_s AS (SELECT q, id, sum(idf) AS score FROM qtok JOIN idf USING (tok) JOIN post USING (tok) GROUP BY q, id),
lex AS (SELECT * FROM ({ranked('lex_s')}) WHERE rank <= {limit})"""


def hash_vectors(name: str, source: str, key: str, text: str = "text", dims: int = 64) -> str:
    """CTEs `{name}` (key, idx, v): sparse unit hash embedding."""
    return f"""{name}_t AS (SELECT {key}, tok, count(*) AS n FROM (SELECT {key}, unnest({toks(text)}) AS tok FROM {source}) GROUP BY {key}, tok),
{name}_d AS (SELECT tok, {fnv('tok')} AS h FROM (SELECT DISTINCT tok FROM {name}_t)),
{name}_r AS (SELECT {key}, (h % {dims})::INT AS idx, sum(n * CASE WHEN (h // 256) % 2 = 1 THEN -1.0 ELSE 1.0 END)::DOUBLE AS v
  FROM {name}_t JOIN {name}_d USING (tok) GROUP BY {key}, (h % {dims})::INT),
{name} AS (SELECT {key}, idx, v / n AS v FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY {key})) AS n FROM {name}_r) WHERE n > 0)"""


def vector(limit: int = 32) -> str:
    """CTEs `mv`, `qv`, `vec` (q, id, score, rank) by exact dot product of hash embeddings; needs mem and qry."""
    return (
        hash_vectors("mv", "mem", "id")
        + ",\n"
        + hash_vectors("qv", "qry", "q")
        + f""",
vec_s AS (SELECT q.q, m.id, coalesce(s.score, 0.0) AS score FROM qry q CROSS JOIN mem m
  LEFT JOIN (SELECT q, id, sum(qv.v * mv.v) AS score FROM qv JOIN mv USING (idx) GROUP BY q, id) s ON s.q = q.q AND s.id = m.id),
vec AS (SELECT * FROM ({ranked('vec_s')}) WHERE rank <= {limit})"""
    )


def masks(name: str, source: str, key: str, text: str = "text") -> str:
    """CTE `{name}` (key, mask): 64-bit activation mask as UBIGINT-valued HUGEINT."""
    return f"""{name}_t AS (SELECT DISTINCT {key}, tok FROM (SELECT {key}, unnest({toks(text)}) AS tok FROM {source}) WHERE length(tok) > 1),
{name}_d AS (SELECT tok, ({fnv('tok')} % 64)::INT AS bit FROM (SELECT DISTINCT tok FROM {name}_t)),
{name} AS (SELECT s.{key}, coalesce(bit_or(1::UBIGINT << d.bit), 0::UBIGINT) AS mask FROM {source} s LEFT JOIN {name}_t t ON s.{key} = t.{key} LEFT JOIN {name}_d d ON d.tok = t.tok GROUP BY s.{key})"""


def overlap(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = 0 OR {b} = 0 THEN 0.0::DOUBLE ELSE bit_count({a} & {b})::DOUBLE / bit_count({a} | {b}) END)"


def coverage(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = 0 OR {b} = 0 THEN 0.0::DOUBLE ELSE bit_count({a} & {b})::DOUBLE / bit_count({a}) END)"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"

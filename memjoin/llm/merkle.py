"""Merkle dataset manifest by incremental witnesses.

Rows are leaves; the leaves of a group (a language) ascend by doc_id. Leaves go to aligned blocks of 2**LEVELS. A block is
appended to, leaf by leaf, in one task: it keeps the open subtrees (complete ones that wait for a right sibling) and, for every
leaf below them, a partial witness: the siblings met so far. When two open subtrees of one level meet, each extends the
witnesses of the other's leaves and they become one subtree a level higher. What is open at the end is closed from the right,
where a lone node is hashed alone. The roots of the blocks are leaves of a further tree that is grown in the same way, again in
blocks, until each group has one node; the groups' roots are appended to the last tree. The witnesses of a higher tree extend
those below it by a join on (group, block).

No task holds more than a block, no join key more than a block of rows, and texts are hashed where they are read: only digests
travel. A witness is a list of siblings from the leaf up: `<digest` stands to the left, `>digest` to the right, an empty string
is a step at which the node was alone.

Defined cases: a null of any column is hashed as `-`; a null language is a group of its own, before the others; null doc_ids
come first; rows with the same doc_id are ordered by their leaf digests, then by their place in the file, so repeated rows are
leaves of their own; an empty table gives no rows and no root; a group of one leaf has that leaf as its root; other columns
are not read, so their names cannot clash; the length of a text matters only to the task that hashes it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memjoin.llm.common import LOC, documents, located, written
from memjoin.llm.order import numbered
from memjoin.llm.sharding import crc_sql

LEVELS = 10  # a block has 2**LEVELS leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.encode(F.concat(*parts), "UTF-8"), 256)


def framed(value: Column) -> Column:
    """`-` for null, else the length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(changed: dict[str, Column] | None = None) -> Column:
    """The digest of a row of documents, with some of its columns replaced."""
    return digest(*[framed((changed or {}).get(name, F.col(name))) for name in FIELDS])


def joined(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def appended(nodes: list[str], levels: int, alone: bool) -> tuple[str, list[list[str]]]:
    """The root of a block and the witness of each of its leaves, by appending them one after another.

    A block that is a whole tree (`alone`) is closed when one node remains, another one at the level of its siblings.
    """
    subtrees: list[tuple[int, str, list[int]]] = []
    witnesses: list[list[str]] = [[] for _ in nodes]

    def settle(level: int, root: str, below: list[int]) -> None:
        while subtrees and subtrees[-1][0] == level:
            _, left, earlier = subtrees.pop()
            for place in earlier:
                witnesses[place].append(">" + root)
            for place in below:
                witnesses[place].append("<" + left)
            level, root, below = level + 1, joined(left, root), earlier + below
        subtrees.append((level, root, below))

    for place, node in enumerate(nodes):
        settle(0, node, [place])
    while len(subtrees) > 1 or not alone and subtrees[0][0] < levels:
        level, root, below = subtrees.pop()
        for place in below:
            witnesses[place].append("")
        settle(level + 1, joined(root), below)
    return subtrees[0][1], witnesses


def block_appender(levels: int) -> Callable[[pa.Table], pa.Table]:
    def append_block(table: pa.Table) -> pa.Table:
        """One block: its rows with the witness of each, and the block's root at the first of them."""
        table = table.sort_by("idx")
        alone = table.column("total")[0].as_py() <= 1 << levels
        root, witnesses = appended(table.column("node").to_pylist(), levels, alone)
        table = table.append_column("witness", pa.array(witnesses, pa.list_(pa.string())))
        return table.append_column("root", pa.array([root] + [None] * (len(witnesses) - 1), pa.string()))

    return append_block


def grown(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """The rounds of appends over `nodes` (tree, idx, node, total, more columns): leaves first, the rows of the last round
    belong to one block in each tree."""
    rounds = []
    while True:
        blocks = nodes.withColumn("block", F.shiftright("idx", levels))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema) + ", witness array<string>, root string"
        done = written(blocks.groupBy("tree", "block").applyInArrow(block_appender(levels), schema), "witnesses")
        rounds.append(done)
        tops = F.ceil(F.col("total") / (1 << levels)).cast("bigint")
        nodes = done.where("root is not null").select("tree", F.col("block").alias("idx"), F.col("root").alias("node"), tops.alias("total"))
        if nodes.where("total > 1").isEmpty():
            return rounds


def extended(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The rows of the first round; each witness goes on through the higher rounds and then through `above` (tree, rest, top)."""
    upper = above.select(F.col("tree").alias("_tree"), F.lit(0).cast("bigint").alias("_idx"), F.col("rest"), F.col("top"))
    for lower in reversed(rounds):
        matched = lower.join(upper, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_idx")))
        whole = matched.withColumn("witness", F.concat("witness", "rest")).drop("_tree", "_idx", "rest")
        upper = whole.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), F.col("witness").alias("rest"), "top")
    return whole


def manifest(leaves: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, str | None]:
    """Every row of `leaves` (tree, node, key, more columns) with its `witness` up to the root and its tree's root `subroot`;
    and the root of all. Leaves ascend by key, then node, then `tie`, within a tree."""
    spark = leaves.sparkSession
    placed = numbered(leaves, ["tree", "key", "node", "tie"], "leaves")
    starts = placed.groupBy("tree").agg(F.min("position").alias("start"), F.count("*").alias("total"))
    groups = written(starts, "trees")
    # Trees of any size: places inside a tree come from a join on (tree, its slice of the table), never on a hot tree alone.
    span = 1 << levels
    slices = groups.select(
        F.col("tree").alias("_tree"), "start", "total",
        F.explode(F.sequence(F.floor(F.col("start") / span), F.floor((F.col("start") + F.col("total") - 1) / span))).alias("_slice"),
    )
    near = placed.withColumn("_at", F.floor(F.col("position") / span))
    same = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("_at") == F.col("_slice"))
    nodes = near.join(slices, same).withColumn("idx", F.col("position") - F.col("start")).drop("_tree", "_at", "_slice", "position", "start")
    rounds = grown(nodes, levels)
    subroots = rounds[-1].where("root is not null").select("tree", F.col("root").alias("node"))
    ordered = numbered(subroots, ["tree"], "subroots")
    top_nodes = ordered.select(
        F.lit(None).cast("string").alias("tree"), F.col("position").alias("idx"), "node", F.lit(ordered.count()).cast("bigint").alias("total"),
        F.col("tree").alias("group"),
    )
    top_rounds = grown(top_nodes, levels)
    found = top_rounds[-1].where("root is not null").select("root").first()
    nothing = spark.range(1).select(F.lit(None).cast("string").alias("tree"), F.array().cast("array<string>").alias("rest"), F.lit("").alias("top"))
    above = extended(top_rounds, nothing).select(F.col("group").alias("tree"), F.col("witness").alias("rest"), F.col("node").alias("top"))
    return extended(rounds, above).withColumnRenamed("top", "subroot"), found and found.root


def folded(witness: Column, start: Column) -> Column:
    """The root that a leaf and its witness give."""
    rest = lambda step: F.substring(step, 2, 64)
    return F.aggregate(
        witness, start,
        lambda node, step: F.when(step == "", digest(node)).when(F.substring(step, 1, 1) == "<", digest(rest(step), node)).otherwise(digest(node, rest(step))),
    )


def siblings(witness: Column) -> Column:
    """The digest of all siblings of a witness, from the leaf to the root."""
    return digest(F.array_join(F.transform(witness, lambda step: F.substring(step, 2, 64)), ""))


def document_manifest(docs: DataFrame, changed: dict[str, Column] | None = None, where: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, other, witness, subroot, root): `other` is the leaf of the row as `changed` says, where `where` holds."""
    placed = located(docs.select(*FIELDS))
    other = leaf() if changed is None else F.when(where, leaf(changed)).otherwise(leaf())
    leaves = placed.select(
        F.col("lang").alias("tree"), F.col("doc_id").alias("key"), leaf().alias("node"), F.struct(F.col(LOC)["file"], F.col(LOC)["row"]).alias("tie"), other.alias("other"),
    )
    rows, root = manifest(leaves, levels)
    return rows.select(F.col("key").alias("doc_id"), F.col("node").alias("leaf"), "other", "witness", "subroot", F.lit(root).alias("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    struck = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0, F.lit(False))
    rows = document_manifest(documents(spark, sf_dir), {"n_chars": F.col("n_chars") + 1}, struck)
    proven = rows.select("doc_id", "leaf", "subroot", "root", siblings(F.col("witness")).alias("proof_sha256"), folded(F.col("witness"), F.col("other")).alias("folded_root"))
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))


def _framed_sql(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_framed_sql(n_chars if name == "n_chars" else name) for name in FIELDS) + ")"


def _nodes_sql(name: str, first: str) -> str:
    """All nodes of the trees whose leaves `first` gives as (tree, idx, node, total)."""
    return f"""{name}(tree, level, idx, node, total) AS (
  SELECT tree, 0, idx, node, total FROM ({first})
  UNION ALL
  SELECT tree, level + 1, idx // 2, sha256(string_agg(node, '' ORDER BY idx)), (total + 1) // 2
  FROM {name} WHERE total > 1 GROUP BY tree, level, idx // 2, total)"""


def _walk_sql(name: str, nodes: str, first: str) -> str:
    """From each row of `first` (tree, start, spot, total, node, others) to the root of its tree."""
    return f"""{name}(tree, start, level, spot, total, node, others) AS (
  SELECT tree, start, 0, spot, total, node, others FROM ({first})
  UNION ALL
  SELECT w.tree, w.start, w.level + 1, w.spot // 2, (w.total + 1) // 2,
         sha256(CASE WHEN w.spot % 2 = 0 THEN w.node || coalesce(s.node, '') ELSE s.node || w.node END), w.others || coalesce(s.node, '')
  FROM {name} w LEFT JOIN {nodes} s ON s.tree = w.tree AND s.level = w.level AND s.idx = w.spot + 1 - 2 * (w.spot % 2)
  WHERE w.total > 1)"""


OP13_SQL = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, {_leaf_sql("n_chars")} AS leaf,
         CASE WHEN {crc_sql("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf_sql("n_chars + 1")} ELSE {_leaf_sql("n_chars")} END AS other
  FROM documents),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS total FROM leaves),
{_nodes_sql("nodes", "SELECT tree, idx, leaf AS node, total FROM placed")},
{_nodes_sql("tops", "SELECT 0 AS tree, tree AS idx, node, count(*) OVER () AS total FROM nodes WHERE total = 1")},
{_walk_sql("low", "nodes", "SELECT tree, idx AS start, idx AS spot, total, other AS node, '' AS others FROM placed")},
{_walk_sql("high", "tops", "SELECT 0 AS tree, tree * 4294967296 + start AS start, tree AS spot, (SELECT max(total) FROM tops) AS total, node, others FROM low WHERE total = 1")}
SELECT p.doc_id, p.leaf, n.node AS subroot, r.node AS root, sha256(h.others) AS proof_sha256, h.node AS folded_root, h.node = r.node AS verified
FROM placed p
JOIN nodes n ON n.tree = p.tree AND n.total = 1
JOIN tops r ON r.total = 1
JOIN high h ON h.total = 1 AND h.start = p.tree * 4294967296 + p.idx
"""

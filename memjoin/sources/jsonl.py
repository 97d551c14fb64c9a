"""JSON-lines sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: conversation record layout.
RECORD_DDL = (
    "uid string, source string, "
    "sessions array<struct<session_id:string,timestamp:string,turns:array<struct<turn_id:string,speaker:string,role:string,content:string,"
    "metadata:struct<has_answer:boolean,blip_caption:string>>>>>, "
    "qa array<struct<qa_id:string,question:string,answer:string,evidence:array<string>,question_type:string,abstention:boolean>>"
)
BAD_ESCAPE = r"\\u(?![0-9a-fA-F]{4})"  # fixed value: `\u` not followed by four hex digits


def numbered(df: DataFrame) -> DataFrame:
    """Add `pos`, the global row number in the order of the partitions, without moving rows to one task.

    Row counts per partition come first; each row's number is its place in the partition plus the rows before it. For
    sorted rows that were written (`cut_lineage`), as the input is read twice. Files have an order of their own
    (`file_numbered`).
    """
    tagged = df.withColumn("_m", F.monotonically_increasing_id())
    return _placed(tagged.withColumn("_block", F.shiftright("_m", 33)))


def file_numbered(df: DataFrame) -> DataFrame:
    """Add `pos`, the global row number in file order, to a file scan.

    Spark packs file blocks into tasks by size, so the order is taken from the path and the start of each block: a row's
    number is its place in the block plus the rows of the blocks before it.
    """
    block = F.struct("_metadata.file_path", "_metadata.file_block_start")
    return _placed(df.select("*", F.monotonically_increasing_id().alias("_m"), block.alias("_block")))


def _placed(tagged: DataFrame) -> DataFrame:
    """`pos` from the increasing `_m` within each `_block`, blocks in order."""
    counts = tagged.groupBy("_block").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # one row for each partition, or block of a file
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_block", "_first", before.alias("_start"))
    return tagged.join(starts, "_block").withColumn("pos", F.col("_start") + F.col("_m") - F.col("_first")).drop("_m", "_block", "_first", "_start")


def scan(spark: SparkSession, path: str, schema: str, limit: int = 0) -> DataFrame:
    """One record per line, blank lines skipped; `limit` keeps the first records in file order."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows if limit <= 0 else file_numbered(rows).where(F.col("pos") < limit).drop("pos")


def scan_text_lines(spark: SparkSession, path: str) -> DataFrame:
    return file_numbered(spark.read.text(path))


def sanitized(lines: DataFrame, schema: str, offset: int = 0, limit: int = 0) -> DataFrame:
    """(pos, record, kept): lines [offset, offset + limit) by line number, bad `\\u` escapes repaired, blank lines dropped.

    `kept` is false for a line that still does not parse.
    """
    window = F.col("pos") >= offset
    if limit > 0:
        window = window & (F.col("pos") < offset + limit)
    fixed = F.regexp_replace("value", BAD_ESCAPE, r"\\\\u")
    picked = lines.where(window & (F.trim("value") != "")).select("pos", fixed.alias("line"))
    parsed = F.from_json("line", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    rows = picked.select("pos", "line", parsed.alias("record"))
    return rows.select("pos", "line", "record", (F.col("record").isNotNull() & F.col("record._corrupt").isNull()).alias("kept"))


def require_kept(rows: DataFrame) -> DataFrame:
    """The kept rows; an error where no line of the slice is one."""
    kept = rows.where("kept")
    if kept.isEmpty():
        raise ValueError("no valid record in this slice of the file")
    return kept


def kept_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("skipped"))


def sorted_struct(df: DataFrame) -> Column:
    """All columns as one struct in name order, nested structs too, so that JSON keys come out sorted."""
    return _sorted(F.struct(*[F.col(c) for c in df.columns]), df.schema)


def _sorted(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.struct(*[_sorted(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(value, lambda v: _sorted(v, kind.elementType))
    return value


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(sorted_struct(df), {"ignoreNullFields": "false"}).alias("value"))


def write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Compact JSON lines with sorted keys, one file per task."""
    json_lines(df).write.mode(mode).text(path)


def item_text(item: dict[str, Column] | list[Column], whole: Column) -> Column:
    """First non-empty text column, else the whole item as sorted JSON."""
    options = list(item.values()) if isinstance(item, dict) else item
    return F.coalesce(*[F.when(c != "", c) for c in options], whole)


def polymorphic_items(spark: SparkSession, path: str, schema: str, text_key: str = "text") -> DataFrame:
    """Items of a JSON-lines file, a JSON list, `{items: [...]}` or `{memories: [...], queries: [...]}`, with `item_text`."""
    entry = f"struct<{schema}>"
    whole = spark.read.option("wholetext", True).text(path)
    body = F.trim("value")
    as_object = F.from_json(body, f"items array<{entry}>, memories array<{entry}>, queries array<{entry}>")
    as_list = F.from_json(body, f"array<{entry}>")
    none = F.array().cast(f"array<{entry}>")
    held = F.concat(*[F.coalesce(as_object[k], none) for k in ("memories", "queries", "items")])
    lines = F.filter(
        F.transform(F.split(body, "\n"), lambda line: F.from_json(line, schema)), lambda r: r.isNotNull()
    )
    is_lines = body.startswith("{") & (F.size(held) == 0)
    items = whole.select(F.explode(F.when(body.startswith("["), as_list).when(is_lines, lines).otherwise(held)).alias("item")).select("item.*")
    order = [c for c in dict.fromkeys([text_key, "text", "content", "question", "query"]) if c in items.columns]
    return items.withColumn("item_text", item_text([F.col(c) for c in order], F.to_json(sorted_struct(items))))


def float_mapping(payloads: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """(field, value) of a JSON object of floats, optionally wrapped in `fields`, after the columns `keep`."""
    wrapped = F.get_json_object(column, "$.fields")
    body = F.coalesce(wrapped, F.col(column))
    return payloads.select(*keep, F.explode(F.from_json(body, "map<string,double>")).alias("field", "value"))


def ordered_split(df: DataFrame, fraction: float) -> DataFrame:
    """Add `split`: the first int(total * fraction) rows in file order are `train`, at least one row on each side.

    Needs `pos` from `numbered`; the total is a one-row scalar, no row crosses a task.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    at = F.least(F.greatest(F.floor(total * F.lit(fraction)), F.lit(1)), total - 1)
    return df.withColumn("split", F.when(F.col("pos") < at, "train").otherwise("eval"))

"""Sharding [native]: weighted rendezvous hashing of stable record keys.

Each (key, shard) has a hash u in (0, 1); a record belongs to the shard with the largest -weight / ln(u). A new shard can
only win records for itself, a removed one only loses its own, and a weight change moves only the share that it concerns.
All steps are column expressions; slots come from bounded buckets, never from one sort of a shard.

Defined cases: a null key is a key of its own; a null text has size 1 and crc 0; repeated rows get a slot each; an empty
table gives no rows; other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memjoin.llm.common import documents

HEX_DIGITS = 13  # 52 bits: exact in a double
ROWS_PER_BUCKET = 100_000


def unit(key: Column, salt: str) -> Column:
    """A hash of (salt, key) strictly between 0 and 1."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, HEX_DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**HEX_DIGITS)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Index of the shard that wins `key`; the lower index wins a tie."""
    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")
    bids = F.array(*[F.lit(-float(w)) / F.log(unit(key, str(shard))) for shard, w in enumerate(weights)])
    return (F.array_position(bids, F.array_max(bids)) - 1).cast("int")


def slots(df: DataFrame, shard: str, key: str, columns: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(shard, *columns, slot): gapless places from 0 within each shard, in the order of the key's hash and the columns.

    Equal rows are counted before the shuffle and unfolded after it, so a key that holds much of the table is one row of
    it; buckets of the key's hash hold about `rows_per_bucket` different keys whatever the size of a shard.
    """
    total = df.count()
    buckets = max(1, -(-total // rows_per_bucket))
    place = unit(F.col(key), "slot")
    counted = df.groupBy(shard, *columns).agg(F.count("*").alias("_copies")).withColumn("_place", place)
    counted = counted.withColumn("_bucket", F.floor(F.col("_place") * buckets))
    sizes = counted.groupBy(shard, "_bucket").agg(F.sum("_copies").alias("_size"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(shard, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(shard, "_bucket").orderBy("_place", *columns).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_before", F.coalesce(F.sum("_copies").over(inside), F.lit(0))).join(offsets, [shard, "_bucket"])
    first = F.col("_offset") + F.col("_before")
    return placed.select(shard, *columns, F.explode(F.sequence(first, first + F.col("_copies") - 1)).alias("slot"))


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * 16, extra: float = 1.0) -> DataFrame:
    """One row per document: its size, checksum, shard, slot, and the shard it would have beside one more of weight `extra`."""
    octets = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    sized = docs.select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint") + 1).alias("size"),
        F.crc32(octets).alias("text_crc32"),
        rendezvous(F.col("doc_id"), weights).alias("shard"),
        rendezvous(F.col("doc_id"), [*weights, extra]).alias("grown_shard"),
    )
    placed = slots(sized, "shard", "doc_id", ["doc_id", "size", "text_crc32", "grown_shard"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))


def _bids(count: int) -> str:
    unit_sql = "((('0x' || substr(md5('{s}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0"
    return "[" + ", ".join(f"-1.0 / ln({unit_sql.format(s=s)})" for s in range(count)) + "]"


# CRC-32 is linear: the table entry of a byte is the exclusive or of the entries of its bits.
_BIT_ENTRIES = []
for _bit in range(8):
    _value = 1 << _bit
    for _ in range(8):
        _value = (_value >> 1) ^ (0xEDB88320 if _value & 1 else 0)
    _BIT_ENTRIES.append(_value)


def crc_sql(string: str = "coalesce(text, '')") -> str:
    """The unsigned CRC-32 of a string expression's UTF-8 bytes, in DuckDB SQL."""
    entry = "0::BIGINT"
    for bit, value in enumerate(_BIT_ENTRIES):
        entry = f"xor({entry}, (((c & 255) >> {bit}) & 1) * {value}::BIGINT)"
    step = entry.replace("c & 255", "xor(c, x) & 255")
    octet_list = f"list_transform(range(1, strlen({string}) + 1), lambda i: ('0x' || substr(hex(encode({string})), 2 * i - 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octet_list}), lambda c, x: xor(c >> 8, {step})), 4294967295::BIGINT)"


OP2_SQL = f"""
WITH sized AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, {_bids(17)} AS bids, text,
         (('0x' || substr(md5('slot:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT) AS place
  FROM documents),
placed AS (
  SELECT doc_id, size, place, text, (list_position(bids[1:16], list_max(bids[1:16])) - 1)::INTEGER AS shard,
         (list_position(bids, list_max(bids)) - 1)::INTEGER AS grown_shard FROM sized)
SELECT doc_id, size, {crc_sql()} AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY place, doc_id, size) - 1 AS slot, grown_shard
FROM placed
"""

"""Dense places of rows in a total order over a whole table, without one sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memjoin.llm.common import written

PLACE_BITS = 33  # of monotonically_increasing_id: the row inside its partition


def numbered(df: DataFrame, keys: list[str], label: str = "order") -> DataFrame:
    """The rows of `df` with `position`, gapless from 0 in the ascending order of `keys` (nulls first).

    One range shuffle sorts the rows; partitions are counted, and the counts of the partitions before are added. The table of
    counts has one row for each shuffle partition, so it may be broadcast at any size of the data. `df` should be narrow.
    """
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    table = written(ordered, label).withColumn("_part", F.shiftright("_place", PLACE_BITS))
    sizes = table.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = F.col("_place") - F.shiftleft(F.col("_part"), PLACE_BITS)
    return table.join(F.broadcast(starts), "_part").withColumn("position", F.col("_start") + inside).drop("_part", "_place", "_start")

"""Places in an order over all rows, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialize

#: Bits of Spark's monotonically increasing ids that count rows within a partition.
ROW_BITS = 33


def numbered(rows: DataFrame, *order: Column | str, name: str = "id") -> DataFrame:
    """rows with name, their place from 1 in the order; equal rows in any order.

    Rows are dealt to partitions by ranges of the order, sorted and numbered within each, and written. Then each
    partition starts where the counts of those before it end: the driver sees a number a partition, and a range is no
    larger than others however many rows share a leading column.
    """
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(ranges.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", ROW_BITS)
    before, starts = 0, []
    for p, n in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        starts.append((p, before))
        before += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part long, _before long"))
    nth = F.col("_m").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1
    return placed.join(offsets, part == F.col("_part")).select(*rows.columns, (F.col("_before") + nth).alias(name))

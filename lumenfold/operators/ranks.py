"""Places of rows in an order, counted without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.session import keep

#: Spark's growing ids hold the partition above this many bits, the row's number below them.
_ROW_BITS = 33


def numbered(rows: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """``rows`` with their place in the order, from 1, as a long column ``name``.

    Rows are dealt by ranges of the whole order, numbered within their range and
    shifted by the sizes of the ranges before. A range may begin within equal
    values of the first columns, so a frequent value burdens no task as long as
    the last column tells its rows apart. Rows alike in all of ``order`` get
    places next to each other, in no fixed order. Nulls are first where a column
    ascends. An empty table gives an empty table.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = keep(dealt.select("*", F.monotonically_increasing_id().alias("_at")), name)
    placed = placed.withColumn("_part", F.shiftright("_at", _ROW_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a row per range
    shift = placed.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    place = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + F.col("_shift") + 1
    # As many rows as there are shuffle partitions.
    return placed.join(F.broadcast(shift), "_part").withColumn(name, place).select(*[f"`{c}`" for c in rows.columns if c != name], name)

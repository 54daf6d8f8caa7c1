"""Numbers of rows in a total order, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.sources.scratch import written


def numbered(df: DataFrame, order: list[str | Column], out: str = "i") -> DataFrame:
    """df with each row's place (0, 1, ...) in a total order: within ranges of the order, after the rows of the ranges before.

    The ranges are written to the shared folder, so that their rows are the same in both uses; the only window without a partition sees a row for each range.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.withColumn(out, within).join(before, "__part").withColumn(out, F.col(out) + F.col("__before")).drop("__part", "__before")


#: Rows of one range, whatever the table's size, so that a task's memory doesn't grow with it.
RANGE_ROWS = 250_000


def range_count(df: DataFrame) -> int:
    """So many ranges that each has about RANGE_ROWS rows, and there is one for each core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // RANGE_ROWS))


def placed(df: DataFrame, by: list[str], order: list[str | Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """df with each row's place i (0, 1, ...) among the n rows of its group, in a total order, and sums over all rows of the group up to and with it.

    Groups may be few and large: rows are dealt by ranges of (by, order), written to the shared folder, numbered within their range, and moved on by what the ranges before hold of the
    group. Windows see a range's rows of a group, or a row for each range and group; there are more ranges for more rows.
    """
    sums, n_ranges = sums or {}, range_count(df)
    ranged = written(df.repartitionByRange(n_ranges, *by, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("__part", *by).agg(F.count("*").alias("__n"), *(F.sum(v).alias(f"__{c}") for c, v in sums.items()))
    group = Window.partitionBy(*by)
    before = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    totals = totals.select(F.col("__part").alias("__p"), *(F.col(c).alias(f"__by_{c}") for c in by), zero("__n").alias("__i"), F.sum("__n").over(group).alias("n"), *(zero(f"__{c}").alias(f"__{c}") for c in sums))
    within = Window.partitionBy("__part", *by).orderBy(*order)
    here = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranged.repartition(n_ranges, "__part").withColumns({"i": F.row_number().over(within) - 1, **{c: F.sum(v).over(here) for c, v in sums.items()}})
    same = F.col("__part") == F.col("__p")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    out = rows.join(totals, same)
    return out.select(*df.columns, (F.col("i") + F.col("__i")).alias("i"), "n", *((F.col(c) + F.col(f"__{c}")).alias(c) for c in sums))


def ntile(place: Column, rows: Column, n: int) -> Column:
    """Group 1 to n of a place (from 0) among so many rows; the first groups get the rows that are left over."""
    size, more = F.floor(rows / n), rows % n
    first = F.floor(place / (size + 1))
    rest = more + F.floor((place - more * (size + 1)) / F.greatest(size, F.lit(1)))
    return (F.when(place < more * (size + 1), first).otherwise(rest) + 1).cast("int")

"""Numbers and running sums in a global order, without a task that holds a group.

Rows are dealt over tasks by ranges of group and order, once, and written; ranges are counted, and a row's number is its number in
its range plus the rows of the group's earlier ranges. So a group of all rows costs what many groups cost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.scratch import scratch, written

#: Rows of a range, about; there are at least as many ranges as the session shuffles into.
RANGE_ROWS = 1_000_000


def ranged(rows: DataFrame, order: list[str | Column]) -> DataFrame:
    """rows with _part, the number of their range in the given order; written. Rows that are equal in it are in one range."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    return written(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged", keep=True)


def numbered(rows: DataFrame, by: list[str], order: list[str | Column], name: str = "n", sums: dict[str, str] | None = None) -> DataFrame:
    """rows with their number from 1 in their group (by; nulls are a group) and running sums (new column -> column) up to and with the row.

    order should be total: rows that are equal in it are numbered in any order, in one task. The running sum of nulls alone is null.
    """
    sums = sums or {}
    with scratch():
        parts = ranged(rows, [*by, *order])
    group = ["_part", *by]
    before = Window.partitionBy(*(by or [F.lit(1)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # some rows a range
    totals = parts.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"), *(F.sum(c).alias(f"_sum_{k}") for k, c in sums.items()))
    earlier = totals.select(*(F.col(c).alias(f"_of_{c}") for c in group), F.sum("_rows").over(before).alias("_earlier"), *(F.sum(f"_sum_{k}").over(before).alias(f"_earlier_{k}") for k in sums))
    here = Window.partitionBy(*group).orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumns({"_n": F.row_number().over(here), **{f"_upto_{k}": F.sum(c).over(upto) for k, c in sums.items()}})
    same = reduce(lambda a, b: a & b, (local[c].eqNullSafe(earlier[f"_of_{c}"]) for c in group))
    total = lambda k: F.when(F.col(f"_upto_{k}").isNull(), F.col(f"_earlier_{k}")).otherwise(F.col(f"_upto_{k}") + F.coalesce(f"_earlier_{k}", F.lit(0)))
    return local.join(earlier, same).select(*rows.columns, (F.col("_n") + F.coalesce("_earlier", F.lit(0))).alias(name), *(total(k).alias(k) for k in sums))


def middle(rows: DataFrame, column: str) -> str | None:
    """The value at place n // 2 (from 0) in order; None without rows. Of all ranges only the one that holds the place is numbered."""
    with scratch():
        parts = ranged(rows.select(column), [column])
        sizes = sorted((r["_part"], r["count"]) for r in parts.groupBy("_part").count().collect())  # one row a range
        place = sum(n for _, n in sizes) // 2
        for part, n in sizes:
            if place < n:
                at = parts.filter(F.col("_part") == part).withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(column)))
                return at.filter(F.col("_n") == place + 1).first()[column]
            place -= n
    return None

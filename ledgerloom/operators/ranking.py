"""Ranks within groups of any size, without a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import keep


def ranks(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with the 1-based rank of every row in its group.

    Rows are range-sorted over all tasks; a row's rank is its place in its task plus the group's rows in the tasks before.
    """
    at = keep(df.orderBy(*by, *order).withColumn("ll_at", F.monotonically_increasing_id()), "sorted")
    at = at.withColumn("ll_pid", F.shiftright("ll_at", 33))
    before = Window.partitionBy(*by).orderBy("ll_pid").rowsBetween(Window.unboundedPreceding, -1)
    # One row for every task and group: as many as groups and tasks together.
    counts = at.groupBy("ll_pid", *by).agg(F.count("*").alias("ll_n"))
    starts = counts.withColumn("ll_start", F.coalesce(F.sum("ll_n").over(before), F.lit(0))).drop("ll_n")
    place = F.row_number().over(Window.partitionBy("ll_pid", *by).orderBy("ll_at"))
    j = at.withColumn("ll_place", place)
    same = j["ll_pid"] == starts["ll_pid"]
    for b in by:
        same = same & j[b].eqNullSafe(starts[b])
    out = j.join(starts, same).withColumn(name, (F.col("ll_place") + F.col("ll_start")).cast("long"))
    return out.select(*[j[c] for c in df.columns], name)


def picks(df: DataFrame, by: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """by, n and for every name in places the value at that 0-based place of the group's sorted values. Places are expressions over n."""
    rows = df.where(F.col(value).isNotNull()).select(*by, value)
    n = rows.groupBy(*by).agg(F.count("*").alias("n"))
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("ll_c"))
    # Equal values are one row from here on; their last place is a running sum of counts.
    at = keep(counts.orderBy(*by, value).withColumn("ll_at", F.monotonically_increasing_id()), "sorted").withColumn("ll_pid", F.shiftright("ll_at", 33))
    before = Window.partitionBy(*by).orderBy("ll_pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = at.groupBy("ll_pid", *by).agg(F.sum("ll_c").alias("ll_s"))
    starts = sums.withColumn("ll_start", F.coalesce(F.sum("ll_s").over(before), F.lit(0))).drop("ll_s")
    j = at.withColumn("ll_run", F.sum("ll_c").over(Window.partitionBy("ll_pid", *by).orderBy("ll_at").rowsBetween(Window.unboundedPreceding, 0)))

    def equal(a: DataFrame, b: DataFrame, cols: list[str]) -> Column:
        out = F.lit(True)
        for c in cols:
            out = out & a[c].eqNullSafe(b[c])
        return out

    r = j.join(starts, equal(j, starts, ["ll_pid", *by])).select(*[j[b].alias(b) for b in by], j[value].alias(value), (F.col("ll_run") + F.col("ll_start")).alias("ll_last"), "ll_c")
    m = r.join(n, equal(r, n, by)).select(*[r[b].alias(b) for b in by], value, "ll_last", "ll_c", "n")
    hit = lambda p: (p >= F.col("ll_last") - F.col("ll_c")) & (p < F.col("ll_last"))
    return m.groupBy(*by, "n").agg(*[F.max(F.when(hit(p), F.col(value))).alias(name) for name, p in places.items()])

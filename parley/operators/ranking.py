"""Ranks, order statistics and dense numbers within groups of any size.

A window over a whole group would put it in one task.  Here equal values are
counted first, values fall into buckets between approximate quantiles of their
group, and a place is the bucket's offset plus the place inside: exact, and no
task holds more than a bucket.  Dense numbers come from range partitions, whose
row counts are their offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.sources.scratch import written

BUCKETS = 64


def _beside(left: DataFrame, right: DataFrame, groups: list[str]) -> DataFrame:
    """Rows beside the columns of their group, a null group included."""
    other = right
    same = F.lit(True)
    for g in groups:
        other = other.withColumnRenamed(g, f"__of_{g}")
        same = same & F.col(g).eqNullSafe(F.col(f"__of_{g}"))
    return (left.join(other, same) if groups else left.crossJoin(other)).drop(*[f"__of_{g}" for g in groups])


def places(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, value, ties, before): how many rows of the group have each distinct value, and how many a smaller one."""
    counts = df.groupBy(*groups, value).agg(F.count("*").alias("ties"))
    points = [i / BUCKETS for i in range(1, BUCKETS)]
    bounds = df.groupBy(*groups).agg(F.percentile_approx(value, points, 1000).alias("__bounds"))
    placed = _beside(counts, bounds, groups).withColumn("__bucket", F.size(F.filter("__bounds", lambda b: b < F.col(value)))).drop("__bounds")
    totals = placed.groupBy(*groups, "__bucket").agg(F.sum("ties").alias("__own"))
    before = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, "__bucket", F.coalesce(F.sum("__own").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*groups, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("__within", F.coalesce(F.sum("ties").over(inside), F.lit(0)))
    return _beside(local, offsets, [*groups, "__bucket"]).select(*groups, value, "ties", (F.col("__before") + F.col("__within")).alias("before"))


def average_ranks(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, value, ties, rank): the mean rank of each distinct value."""
    rank = F.col("before") + (F.col("ties") + 1) / F.lit(2.0)
    return places(df, groups, value).select(*groups, value, "ties", rank.alias("rank"))


def order_statistics(df: DataFrame, groups: list[str], value: str, points: dict[str, float], nearest: bool = False) -> DataFrame:
    """(groups, n, a column for each point): exact quantiles of the values that are there.

    Linear between neighbours (inclusive), or with ``nearest`` the smallest value that the share of a point does not exceed.
    """
    there = df.where(F.col(value).isNotNull())
    placed = places(there, groups, value)
    sizes = there.groupBy(*groups).agg(F.count("*").alias("n"))
    rows = _beside(placed, sizes, groups)
    n = F.col("n")

    def at(k: Column) -> Column:
        return F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("ties")), F.col(value).cast("double")))

    found = []
    for name, p in points.items():
        if nearest:
            found.append(at(F.greatest(F.ceil(n * p) - 1, F.lit(0))).alias(name))
        else:
            where = (n - 1) * F.lit(p)
            low, high = at(F.floor(where)), at(F.ceil(where))
            share = F.first(where - F.floor(where))
            found.append((low + (high - low) * share).alias(name))
    return rows.groupBy(*groups).agg(F.first("n").alias("n"), *found)


def numbered(df: DataFrame, order: list[Column | str], name: str, groups: list[str] | None = None) -> DataFrame:
    """Rows with dense numbers from 1 in the given order, within groups if there are any.

    Rows that are equal in the whole order stay in one partition and get their numbers in any order.
    """
    groups = groups or []
    keys = [F.col(c) if isinstance(c, str) else c for c in [*groups, *order]]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written, so that a partition that is computed again can't be cut elsewhere.
    placed = written(df.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()), "numbered")
    sums = placed.groupBy(*groups, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*groups, F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = sums.select(*groups, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*groups, "__part").orderBy(*keys[len(groups) :]))
    rows = _beside(placed.withColumn("__inside", inside), offsets, [*groups, "__part"])
    return rows.withColumn(name, F.col("__before") + F.col("__inside")).select(*df.columns, name)

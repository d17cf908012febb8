"""Exact quantiles of groups of any size, by counting.

Values are counted first, which combines before the shuffle. A group's distinct values are then dealt to
buckets in their order (256 to a doubling), buckets' counts are summed up along the group, and each bucket's
values within it: no task holds more than a bucket's distinct values, or a row a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS_A_DOUBLING = 256


def quantiles(rows: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row a group of ``by``: for each name in ``wanted`` the quantile of a column, as (column, share),
    interpolated between neighbours; null values don't count, and a group without any has null."""
    columns = sorted({c for c, _ in wanted.values()})
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).cast("double").alias("value")) for c in columns]))
    long = rows.select(*by, each.alias("e")).select(*by, "e.of", "e.value").filter("value is not null")
    bucket = F.when(F.col("value") > 0, F.floor(F.log2("value") * BUCKETS_A_DOUBLING)).otherwise(F.lit(-(1 << 40)))
    counts = long.groupBy(*by, "of", "value").agg(F.count("*").alias("n")).withColumn("bucket", bucket)
    key = [*by, "of"]
    along = Window.partitionBy(*key).orderBy("bucket")
    sums = counts.groupBy(*key, "bucket").agg(F.sum("n").alias("m"))
    sums = sums.select(*key, "bucket", (F.sum("m").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy(*key)).alias("total"))
    within = Window.partitionBy(*key, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("upto", F.sum("n").over(within)).join(sums, [*key, "bucket"])
    placed = placed.withColumn("first", F.col("before") + F.col("upto") - F.col("n")).withColumn("last", F.col("before") + F.col("upto") - 1)

    def at(column: str, share: float) -> Column:
        position = F.lit(share) * (F.col("total") - 1)
        low = F.floor(position)
        rest = position - low

        def value(k: Column) -> Column:
            return F.max(F.when((F.col("of") == column) & (F.col("first") <= k) & (k <= F.col("last")), F.col("value")))

        part = F.max(F.when(F.col("of") == column, rest))
        lower, upper = value(low), value(F.least(low + 1, F.col("total") - 1))
        return lower + (upper - lower) * part

    return placed.groupBy(*by).agg(*[at(c, p).alias(name) for name, (c, p) in wanted.items()])

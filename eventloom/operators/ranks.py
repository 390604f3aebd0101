"""Order statistics from counts by value, without one task for a whole column.

Values are counted, the distinct ones are dealt to tasks by ranges, and each range adds up its own counts; what lies in the ranges
before comes from one small sum for each range and group. So a group may hold any number of distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.plans.lineage import cut


def running(counts: DataFrame, by: Sequence[str], value: str, sums: Sequence[str]) -> DataFrame:
    """``counts``, one row for each group ``by`` and ``value``, with ``below_x``: the sum of x over the group's smaller values."""
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # checkpointed, as the number of a range must be the same in both uses
    ranges = cut(counts.repartitionByRange(n, *by, value).withColumn("range", F.spark_partition_id()))
    whole = ranges.groupBy(*by, "range").agg(*(F.sum(x).alias(x) for x in sums))
    before = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*by, "range", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"before_{x}") for x in sums))
    within = Window.partitionBy(*by, "range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inner = ranges.select("*", *(F.coalesce(F.sum(x).over(within), F.lit(0)).alias(f"within_{x}") for x in sums))
    met = inner.join(F.broadcast(whole), [*by, "range"])  # a row for each range and group that it holds
    return met.select(*counts.columns, *((F.col(f"before_{x}") + F.col(f"within_{x}")).alias(f"below_{x}") for x in sums))


def quantiles(rows: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """(*by, q_0, q_1, ...): exact quantiles, interpolated between neighbours. Nulls don't count."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    spread = running(counts, by, value, ["n"])
    total = spread.groupBy(*by).agg(F.sum("n").alias("total"))

    def at(place: Column) -> Column:
        """The value that the sorted row at a place has."""
        return F.max(F.when((F.col("below_n") <= place) & (place < F.col("below_n") + F.col("n")), F.col(value)))

    found, wanted = [], []
    for i, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("total") - 1)
        low = F.floor(place)
        found += [at(low).alias(f"a_{i}"), at(F.least(low + 1, F.col("total") - 1)).alias(f"b_{i}"), F.max(place - low).alias(f"f_{i}")]
        wanted.append((F.col(f"a_{i}") + (F.col(f"b_{i}") - F.col(f"a_{i}")) * F.col(f"f_{i}")).alias(f"q_{i}"))
    return spread.join(F.broadcast(total), list(by)).groupBy(*by).agg(*found).select(*by, *wanted)  # a row a group

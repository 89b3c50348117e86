"""Running totals over any number of rows without one task per key.

Rows are cut into buckets along the order; the buckets' sums are totalled first (a small table), then each bucket
is totalled on its own, starting from the sum of the buckets before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same keys that come earlier.

    bucket: rising along `order` within the keys. Order must be total over rows that differ.
    """
    rows = df.withColumn("_bucket", bucket)
    per = rows.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_kb"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    on = [rows[k].eqNullSafe(per[f"_k{i}"]) for i, k in enumerate(keys)] + [rows["_bucket"] == per["_kb"]]
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return rows.join(per, cond).withColumn(out, F.col("_inner") + F.col("_base")).drop("_bucket", "_inner", "_base", "_kb", *[f"_k{i}" for i in range(len(keys))])

"""As-of pick over whole tables: for each time the newest row of another table that is not after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_pick(asks: DataFrame, at: str, rows: DataFrame, time: str, pick: str, span: str = "hour") -> DataFrame:
    """``asks`` with the ``pick`` of the newest of ``rows`` whose ``time`` is not after ``at``; the largest of equal times. Without one, the row goes.

    Both sides are put in one order within each ``span`` of time, and the last row is carried forward. A
    span without an earlier row takes the last one of the spans before, of which there is one row a span.
    """
    kind = rows.schema[pick].dataType
    left = asks.select(F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*asks.columns).alias("__ask"), F.lit(None).cast(kind).alias("__pick"))
    right = rows.select(F.col(time).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(left.schema["__ask"].dataType).alias("__ask"), F.col(pick).alias("__pick"))
    both = left.union(right).where(F.col("__at").isNotNull()).withColumn("__span", F.date_trunc(span, "__at"))
    inside = Window.partitionBy("__span").orderBy("__at", "__side", "__pick")
    near = both.withColumn("__pick", F.last("__pick", ignorenulls=True).over(inside)).where("__side = 1")
    last = both.where("__side = 0").groupBy("__span").agg(F.max_by("__pick", F.struct("__at", "__pick")).alias("__carried"))
    spans = both.select("__span").distinct().join(last, "__span", "left")
    carry = spans.select("__span", F.last("__carried", ignorenulls=True).over(Window.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    return near.join(carry, "__span").select("__ask.*", F.coalesce("__pick", "__before").alias(pick)).where(F.col(pick).isNotNull())

"""As-of joins: each row with the latest row of the other side at or before it.

No window runs over all rows of a key. Time is cut into buckets; within a
bucket the running maximum of (time, values) is the latest row so far, and what
a bucket has not seen itself is carried to it: each bucket's maximum, summed up
by running maxima over the buckets of a super-bucket and over super-buckets.
A key that holds a third of all rows is as many groups as it has buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets of a super-bucket.
FAN = 1024


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, values: Sequence[str], width: float, right_time: str | None = None, strict: bool = False, tolerance: float | None = None, suffix: str = "_asof") -> DataFrame:
    """``left`` with ``values`` and the time of the latest row of ``right`` whose time is at most (``strict``: less than) its own.

    New columns end in ``suffix`` and are null where there is none, or none within ``tolerance``. Of right
    rows with one time that with the greatest values counts. Rows with a null key or time match nothing;
    all rows of ``left`` stay. ``width`` is the bucket's, in the unit of time.
    """
    at = right_time or time
    keys = [f"k{i}" for i in range(len(by))]
    known = F.col("t").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    side = lambda of: 1 - of if strict else of  # noqa: E731  at equal times, which side comes first
    ours = left.select(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), F.col(time).cast("double").alias("t"), F.lit(side(1)).alias("side"), F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("own"))
    found = F.struct(F.col(at).cast("double").alias("t"), *(F.col(v).alias(f"v{i}") for i, v in enumerate(values)))
    theirs = right.select(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), F.col(at).cast("double").alias("t"), F.lit(side(0)).alias("side"), found.alias("seen")).filter(known)
    bucket = F.floor(F.col("t") / width)
    both = ours.unionByName(theirs, allowMissingColumns=True).withColumn("bucket", bucket)

    there = both.filter(known).groupBy(*keys, "bucket").agg(F.max("seen").alias("seen"))
    carried = _carried(there, keys)

    so_far = F.max("seen").over(Window.partitionBy(*keys, "bucket").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumn("near", so_far).filter("own is not null").join(carried, [*keys, "bucket"], "left")
    seen = F.when(known, F.coalesce("near", "earlier"))
    if tolerance is not None:
        seen = F.when(F.col("t") - seen["t"] <= tolerance, seen)
    rows = rows.withColumn("got", seen)
    return rows.select("own.*", F.col("got.t").alias(f"{at}{suffix}"), *(F.col(f"got.v{i}").alias(f"{v}{suffix}") for i, v in enumerate(values)))


def _carried(there: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bucket, earlier): the greatest ``seen`` of all earlier buckets, by running maxima on two levels."""
    above = F.floor(F.col("bucket") / FAN)
    supers = there.groupBy(*keys, above.alias("above")).agg(F.max("seen").alias("seen"))
    before = lambda part, order: F.max("seen").over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    supers = supers.select(*keys, "above", before(keys, "above").alias("far"))
    rows = there.withColumn("above", above).withColumn("close", before([*keys, "above"], "bucket"))
    return rows.join(supers, [*keys, "above"], "left").select(*keys, "bucket", F.coalesce("close", "far").alias("earlier"))


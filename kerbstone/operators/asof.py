"""Time series joins: the records before and at or after a moment, nearest records, interpolated positions.

Long recordings are cut into time buckets. Each bucket gets the last record before it and the first after it as
extra rows, found over a table of one row per bucket, so no window spans more than a bucket however long or
hot a sequence is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of a time bucket in the unit of the stamps (ns): 60 s.
BUCKET = 60_000_000_000
#: Records of a bucket, about, where its width is left open.
BUCKET_ROWS = 20_000


def sized_bucket(samples: DataFrame, ts: str) -> int:
    """A width, in the unit of the stamps, that holds about BUCKET_ROWS records of one dense series."""
    r = samples.agg(F.count(ts).alias("n"), (F.max(ts) - F.min(ts)).alias("span")).first()
    return max(1, int((r["span"] or 0) * BUCKET_ROWS // max(r["n"], 1)) + 1)


def around(probes: DataFrame, samples: DataFrame, by: str, ts: str, payload: list[str], bucket: int | None = BUCKET) -> DataFrame:
    """``probes`` with ``before`` and ``after``: structs of the stamp and payload of the record strictly before the probe's
    stamp and of the one at or after it, null where there is none.

    Of records with one stamp the largest payload counts before, the smallest after. Probes with a null stamp or
    sequence have neither; samples with one take no part. Without a ``bucket`` its width follows from the number of samples.
    """
    bucket = sized_bucket(samples, ts) if bucket is None else bucket
    one = samples.where(F.col(by).isNotNull() & F.col(ts).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(ts).alias("_ts")).agg(F.min(F.struct(*payload)).alias("_lo"), F.max(F.struct(*payload)).alias("_hi")).withColumn("_b", F.expr(f"(_ts - pmod(_ts, {bucket})) DIV {bucket}"))
    asked = probes.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in probes.columns])).select(F.col(by).alias("_by"), F.col(ts).alias("_ts"), "_row").withColumn("_b", F.expr(f"(_ts - pmod(_ts, {bucket})) DIV {bucket}"))
    nothing = lambda c: F.lit(None).cast(one.schema[c].dataType)
    # the nearest records outside each bucket
    ends = one.groupBy("_by", "_b").agg(F.max(F.struct("_ts", "_hi", "_lo")).alias("_last"), F.min(F.struct("_ts", "_hi", "_lo")).alias("_first"))
    wanted = asked.where("_by IS NOT NULL AND _ts IS NOT NULL").select("_by", "_b").distinct().join(ends, ["_by", "_b"], "full")
    # what follows is looked up in falling order: a frame to the end of its partition is added up anew for every row
    along = lambda order: Window.partitionBy("_by").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outside = wanted.select("_by", "_b", F.last("_last", True).over(along(F.asc("_b"))).alias("_p"), F.last("_first", True).over(along(F.desc("_b"))).alias("_n"))
    carried = outside.select("_by", "_b", F.explode(F.array("_p", "_n")).alias("_e")).where("_e IS NOT NULL").select("_by", "_e._ts", "_b", "_e._lo", "_e._hi")
    row_type = asked.schema["_row"].dataType
    known = one.select("_by", "_ts", "_b", "_lo", "_hi").unionByName(carried).withColumn("_row", F.lit(None).cast(row_type))
    every = known.unionByName(asked.select("_by", "_ts", "_b", nothing("_lo").alias("_lo"), nothing("_hi").alias("_hi"), "_row"))
    w = Window.partitionBy("_by", "_b")
    has = F.col("_lo").isNotNull()
    before = F.last(F.when(has, F.struct("_ts", "_hi.*")), True).over(w.orderBy("_ts").rangeBetween(Window.unboundedPreceding, -1))
    after = F.last(F.when(has, F.struct("_ts", "_lo.*")), True).over(w.orderBy(F.desc("_ts")).rangeBetween(Window.unboundedPreceding, 0))
    unknown = F.col("_by").isNull() | F.col("_ts").isNull()
    out = every.select("_row", F.when(~unknown, before).alias("before"), F.when(~unknown, after).alias("after")).where("_row IS NOT NULL")
    return out.select("_row.*", "before", "after")


def nearest(probes: DataFrame, samples: DataFrame, by: str, ts: str, payload: list[str], tolerance: int | None = None, bucket: int | None = BUCKET) -> DataFrame:
    """``probes`` with ``found`` (the nearer of the two, of equal ones the earlier), ``delta`` and ``clamped``.

    ``clamped`` tells a probe outside the range of the records. Beyond the tolerance ``found`` is null.
    """
    both = around(probes, samples, by, ts, payload, bucket)
    t = F.col(ts)
    back, ahead = t - F.col("before._ts"), F.col("after._ts") - t
    earlier = F.col("before").isNotNull() & (F.col("after").isNull() | (back <= ahead))
    both = both.withColumn("delta", F.when(earlier, back).otherwise(ahead)).withColumn("clamped", F.coalesce((F.col("before").isNull() & (ahead > 0)) | F.col("after").isNull(), F.lit(False)) & F.col("delta").isNotNull())
    fields = payload
    pick = F.when(earlier, F.struct(F.col("before._ts").alias("_ts"), *[F.col(f"before.{f}").alias(f) for f in fields])).otherwise(F.struct(F.col("after._ts").alias("_ts"), *[F.col(f"after.{f}").alias(f) for f in fields]))
    pick = F.when(F.col("delta").isNotNull(), pick)
    near = F.lit(True) if tolerance is None else F.col("delta") <= tolerance
    return both.withColumn("found", F.when(near, pick)).drop("before", "after")


def interpolate(probes: DataFrame, samples: DataFrame, by: str, ts: str, values: list[str], bucket: int = BUCKET) -> DataFrame:
    """``probes`` with each value on the line between the records around its stamp; an exact hit gives the record.

    Outside the record's range the values are null.
    """
    both = around(probes, samples, by, ts, values, bucket)
    share = (F.col(ts) - F.col("before._ts")) / (F.col("after._ts") - F.col("before._ts"))
    value = lambda v: F.when(F.col("after._ts") == F.col(ts), F.col(f"after.{v}")).when(F.col("before").isNotNull() & F.col("after").isNotNull(), F.col(f"before.{v}") + share * (F.col(f"after.{v}") - F.col(f"before.{v}")))
    return both.withColumns({v: value(v) for v in values}).drop("before", "after")

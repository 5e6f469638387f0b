"""Pairing records of two tables by nearest time for the same entity, where stamps never coincide.

Rows are hashed into Arrow groups by entity and time bucket, samples near a bucket's border going to
both sides of it. In each group DuckDB joins backward and forward as of the stamp, and the nearer
of the two candidates within the tolerance is taken.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of a time bucket in the unit of the stamps (ns): 4 s.
BUCKET = 4_000_000_000
#: Rows of both sides per Arrow group on average.
GROUP_ROWS = 100_000

_JOIN = """
WITH b AS (SELECT f.row, s.ts, s.id, f.ts - s.ts AS gap FROM f ASOF JOIN s ON f.entity = s.entity AND f.bucket = s.bucket AND f.ts >= s.ts),
a AS (SELECT f.row, s.ts, s.id, s.ts - f.ts AS gap FROM f ASOF JOIN s ON f.entity = s.entity AND f.bucket = s.bucket AND f.ts <= s.ts)
SELECT row, CASE WHEN b.gap IS NOT NULL AND (a.gap IS NULL OR b.gap <= a.gap) THEN b.id ELSE a.id END AS id, least(b.gap, a.gap) AS gap
FROM b FULL JOIN a USING (row) WHERE least(b.gap, a.gap) <= $tolerance
"""


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance: int, bucket: int = BUCKET, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``entity, key, id, gap``: for each row of ``left`` (entity, key, ts) the nearest row of ``right`` (entity, ts, id).

    Of two equally near stamps the earlier counts, of rows with equal stamps the smallest id. A
    gap equal to the tolerance is allowed. Rows with a null entity, stamp, key or id take no part; a
    left row with nothing in reach gives none. Equal rows of ``right`` are reduced before the
    shuffle into groups; entity and bucket together bound a group, however long one entity is.
    """
    if not 0 <= tolerance < bucket:
        raise ValueError("the tolerance must be shorter than a bucket")
    spark = left.sparkSession
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((left.count() + right.count()) / group_rows))
    group = F.pmod(F.xxhash64("entity", "bucket"), F.lit(groups)).cast("int")
    at = lambda shift: F.expr(f"CASE WHEN ts + {shift} >= 0 THEN (ts + {shift}) DIV {bucket} ELSE (ts + {shift} + 1) DIV {bucket} - 1 END")
    probes = left.where("entity IS NOT NULL AND key IS NOT NULL AND ts IS NOT NULL").select("entity", at(0).alias("bucket"), "ts", "key").withColumn("g", group)
    samples = right.where("entity IS NOT NULL AND ts IS NOT NULL AND id IS NOT NULL").groupBy("entity", "ts").agg(F.min("id").alias("id"))
    samples = samples.select("entity", F.explode(F.sequence(at(-tolerance), at(tolerance))).alias("bucket"), "ts", "id").withColumn("g", group)

    def join(f: pa.Table, s: pa.Table) -> pa.Table:
        import duckdb

        schema = pa.schema([("entity", pa.string()), ("key", pa.int64()), ("id", pa.int64()), ("gap", pa.int64())])
        if not f.num_rows or not s.num_rows:
            return schema.empty_table()
        f = f.append_column("row", pa.array(range(f.num_rows), pa.int64()))
        with duckdb.connect() as con:
            con.execute("SET threads = 1")
            con.execute("SET memory_limit = '512MB'")
            con.execute("SET temp_directory = ''")  # nothing goes to this machine's disk; the group is what is bounded
            con.register("f", f)
            con.register("s", s)
            got = con.sql(_JOIN, params={"tolerance": tolerance}).to_arrow_table()
        rows = f.take(got.column("row"))
        return pa.table([rows.column("entity"), rows.column("key"), got.column("id"), got.column("gap")], schema=schema)

    return probes.groupBy("g").cogroup(samples.groupBy("g")).applyInArrow(join, "entity string, key long, id long, gap long")


def frame_times(frames: DataFrame) -> DataFrame:
    """``entity, key, ts``: each frame once, its stamp in ns; a null stamp is read from the stem.

    ``drive`` stamps are µs, the others ns; where the adapter is null, stamps under 10^17 are taken for µs. Of a frame
    delivered again the largest stamp known counts.
    """
    digits = F.expr("try_cast(substring_index(stem, '_', -1) AS BIGINT)")
    stamp = F.coalesce(F.col("ts"), digits)
    micro = F.coalesce(F.col("adapter") == "drive", stamp < F.lit(10**17))
    ns = F.when(micro, stamp * 1000).otherwise(stamp)
    return frames.where("sequence IS NOT NULL AND idx IS NOT NULL").groupBy(F.col("sequence").alias("entity"), F.col("idx").alias("key")).agg(F.max(ns).alias("ts"))


def frames_to_samples(frames: DataFrame, tracks: DataFrame, tolerance_ns: int = 50_000_000) -> DataFrame:
    """``sequence, idx, sample_id``: the located sample nearest in time to each frame of its sequence."""
    located = tracks.where("northing IS NOT NULL AND easting IS NOT NULL AND NOT isnan(northing) AND NOT isnan(easting) AND NOT (northing = 0 AND easting = 0)")
    samples = located.select(F.col("sequence").alias("entity"), (F.col("ts") * 1000).alias("ts"), F.col("sample_id").alias("id"))
    got = nearest_in_time(frame_times(frames), samples, tolerance_ns)
    return got.select(F.col("entity").alias("sequence"), F.col("key").alias("idx"), F.col("id").alias("sample_id"))

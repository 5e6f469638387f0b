"""Session helpers shared by all operators: the shared folder, lineage cuts and salted joins."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor reaches, as the cluster names it in ``spark.checkpoint.dir``.

    Only in local mode (tests, a laptop) may that setting be absent; a temporary folder of this machine is
    used then, once per session.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that every executor reaches")
    own = getattr(spark, "_kerbstone_shared", None)
    if own is None:
        folder = tempfile.mkdtemp(prefix="kerbstone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        own = f"file://{folder}"
        spark._kerbstone_shared = own
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in this session's part of the shared folder, which goes when the session's program ends."""
    run = getattr(spark, "_kerbstone_run", None)
    if run is None:
        run = f"{shared_dir(spark)}/kerbstone/{uuid.uuid4().hex}"
        spark._kerbstone_run = run
        fs, p = filesystem(spark, run)
        atexit.register(_delete, fs, p)
    return f"{run}/{label}-{uuid.uuid4().hex}"


def _delete(fs, path) -> None:
    with contextlib.suppress(Exception):
        fs.delete(path, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a lineage cut that
    survives the loss of executors and, unlike ``checkpoint()``, keeps columns compressed. ``drop`` deletes it
    before the program ends."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    got._kerbstone_path = path
    return got


def drop(df: DataFrame) -> None:
    """Delete the table of a ``materialise`` that nothing reads any more."""
    discard(df.sparkSession, df._kerbstone_path)


def filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def discard(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        fs, p = filesystem(spark, path)
        fs.delete(p, True)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], salt_by: str, salts: int = 8, how: str = "inner") -> DataFrame:
    """Equi join whose ``small`` side has one row per key while ``big`` may hold a hot key.

    Rows of a key are spread over ``salts`` tasks; ``small`` is replicated that many times. It is never broadcast, as
    its size is that of the keys.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


#: Rows of one key from which its joins are spread over several tasks, and the share of all rows (one in so many).
HOT_ROWS, HOT_SHARE = 20_000, 2_000


def hot_limit(rows: int) -> int:
    """Rows from which a key counts as hot; at most HOT_SHARE keys can have more."""
    return max(HOT_ROWS, rows // HOT_SHARE)


def skewed_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """Equi join on one column in which a key may be frequent on both sides.

    ``hot`` has a row (key, left_cells, right_cells) for each frequent key, a few thousand by ``hot_limit``, so it is broadcast. The
    rows of such a key form a grid of that many cells by hash; a row goes to all cells of its row or column of the grid,
    so that each pair meets in one cell.
    """
    cells = lambda c: F.coalesce(c, F.lit(1))
    pick = lambda df, n: F.pmod(F.xxhash64(*df.columns), cells(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), cells(n).cast("int") - 1)
    keys = F.broadcast(hot.select(key, F.col("left_cells").alias("_lc"), F.col("right_cells").alias("_rc")))
    a = left.join(keys, key, "left").withColumn("_l", pick(left, F.col("_lc"))).withColumn("_r", F.explode(every(F.col("_rc")))).drop("_lc", "_rc")
    b = right.join(keys, key, "left").withColumn("_r", pick(right, F.col("_rc"))).withColumn("_l", F.explode(every(F.col("_lc")))).drop("_lc", "_rc")
    return a.join(b, [key, "_l", "_r"], how).drop("_l", "_r")


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One row of the columns of several aggregates over everything, which have exactly one row each."""
    single = [r.agg(*[F.any_value(c).alias(c) for c in r.columns], F.assert_true(F.count("*") == 1, F.lit("more than one row")).alias("_one")).withColumn("_one", F.lit(1)) for r in rows]
    out = single[0]
    for r in single[1:]:
        out = out.join(r, "_one")
    return out.drop("_one")


def global_rank(df: DataFrame, column: str, name: str = "rank", width: int = 65_536) -> DataFrame:
    """Adds the 0-based position by a dense non-negative integer column, without sorting the whole in one task.

    Counts of value ranges give each range's offset; a window numbers the rows within a range. Equal values
    have positions in no particular order.
    """
    ranged = df.withColumn("_range", F.expr(f"`{column}` DIV {width}"))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # one row per range
    offsets = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(column))
    return ranged.withColumn("_at", within).join(offsets, "_range").withColumn(name, F.col("_offset") + F.col("_at") - 1).drop("_range", "_at", "_offset")


def global_number(df: DataFrame, groups: list[str], order: list[str], name: str = "number") -> DataFrame:
    """Adds the 0-based position within ``groups`` by ``order`` (a total order), however large one group is.

    Rows are range-partitioned and written, so that the ranges are final; positions count within a range, and the sizes of
    the ranges before it are added from a table of one row per group and range.
    """
    keys = [*groups, *order]
    parts = parallelism(df.sparkSession)
    ranged = materialise(df.repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id()), "ranged")
    own = [*groups, "_range"]
    counts = ranged.groupBy(*own).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*own, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    at = F.row_number().over(Window.partitionBy(*own).orderBy(*order))
    condition = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in own]
    joined = ranged.withColumn("_at", at).alias("r").join(offsets.alias("o"), condition)
    return joined.select(*[F.col(f"r.`{c}`") for c in df.columns], (F.col("o._offset") + F.col("r._at") - 1).alias(name))

"""Consolidation of very many tiny annotation files into few well-sized ones.

A frozen manifest lists every file once (identity, size, checksum, readability). Readable files
are reduced to one keeper per annotation, packed by first-fit decreasing, rewritten bin by bin,
verified by row counts and checksums and published by a pointer file, put in place by one rename. Unreadable content is kept
apart under its own bins, never dropped.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbstone.functions import jsonvalue
from kerbstone.runtime import discard, filesystem, salted_join, scratch_path

#: Bytes of content per rewritten file.
TARGET_BYTES = 128 << 20
#: Files packed by one task; the number of tasks follows from it, so a task's work is bounded.
SHARD_FILES = 100_000
#: Bins' worth of content of one shard, which is written by one task.
SHARD_BINS = 32
#: The file that names the published run.
POINTER = "published.json"


class CompactionError(RuntimeError):
    """Rewritten content doesn't match the manifest; nothing was published."""


def path_key(path: Column) -> Column:
    """The last four segments (kind, producer, sequence, file name) in one spelling; null when fewer."""
    segments = F.filter(F.split(F.lower(F.translate(path, "\\", "/")), "/"), lambda s: ~s.isin("", "."))
    return F.when(F.size(segments) >= 4, F.array_join(F.slice(segments, -4, 4), "/"))


def _read(content: pd.Series) -> pd.DataFrame:
    digests, defects = [], []
    for text in content:
        value, defect = None, None
        if text is None:
            defect = "null"
        elif not text.strip():
            defect = "empty"
        else:
            try:
                value = jsonvalue.digest(text)
            except ValueError:
                defect = "invalid"
        digests.append(value)
        defects.append(defect)
    return pd.DataFrame({"digest": digests, "defect": defects})


def read_json(content: str) -> Column:
    """Value digest of each JSON text, or why there is none: ``null``, ``empty``, ``invalid``."""
    return F.pandas_udf(_read, "struct<digest: binary, defect: string>")(content)


def file_manifest(files: DataFrame) -> DataFrame:
    """One row per ``file_id``: path key, bytes, checksum, digest and defect.

    Rows with a null id are left out; of rows delivered again under one id with other content,
    the one with the largest checksum counts, so the result doesn't depend on row order. A path
    of fewer than four segments has no key and such a file is never a copy of another.
    """
    read = files.where("file_id IS NOT NULL").select("file_id", path_key(F.col("file_path")).alias("path_key"), F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("bytes"), F.xxhash64("file_id", "file_path", "content").alias("checksum"), read_json("content").alias("_read"))
    one = F.max(F.struct("checksum", "path_key", "bytes", "_read.digest", "_read.defect")).alias("m")
    return read.groupBy("file_id").agg(one).select("file_id", "m.*")


def with_keepers(manifest: DataFrame) -> DataFrame:
    """Adds ``keeper``: the smallest id with the same path key and value; the id itself otherwise.

    The copies of an annotation are pre-aggregated, and the answer goes back by a salted join,
    so an annotation stored a million times doesn't end in one task.
    """
    keyed = manifest.where("digest IS NOT NULL AND path_key IS NOT NULL")
    groups = keyed.groupBy("path_key", "digest").agg(F.min("file_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = salted_join(manifest, groups, ["path_key", "digest"], "file_id", how="left")
    return joined.withColumn("keeper", F.coalesce("keeper", "file_id"))


def first_fit_decreasing(sizes: np.ndarray, target: int) -> np.ndarray:
    """The bin of each size: largest first, each into the first bin with room for it.

    A tree of the most room left below each node finds that bin in logarithmic time. A size over
    the target gets a bin of its own.
    """
    n = len(sizes)
    width = 1 << max(0, (n - 1).bit_length())
    room = [target] * (2 * width)
    bins = np.zeros(n, np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        need, at = min(int(sizes[i]), target), 1
        while at < width:
            at *= 2
            if room[at] < need:
                at += 1
        bins[i] = at - width
        room[at] -= need
        if need == target:
            room[at] = -1
        at //= 2
        while at:
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
            at //= 2
    return bins


def pack(manifest: DataFrame, target_bytes: int = TARGET_BYTES, shard_files: int = SHARD_FILES) -> tuple[DataFrame, int]:
    """(``file_id, shard, bin``, number of shards): first-fit decreasing within hash shards of bounded size.

    Readable and unreadable files never share a bin. Each shard leaves at most one bin under half
    full, so the sharding costs one file in SHARD_BINS, or per ``shard_files``, at most. A shard is the
    partition that Spark's hash of the id gives, so that files come to their bins by that one shuffle.
    """
    kept = manifest.where("keeper = file_id").select("file_id", "bytes", F.col("defect").isNotNull().alias("apart"))
    size = kept.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    shards = max(1, math.ceil(size["n"] / shard_files), math.ceil(size["bytes"] / (SHARD_BINS * target_bytes)))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("file_id", kind="stable")
        local = first_fit_decreasing(pdf["bytes"].to_numpy(), target_bytes)
        lead = f"{'apart' if pdf['apart'].iloc[0] else 'data'}-{int(pdf['shard'].iloc[0]):06d}-"
        return pd.DataFrame({"file_id": pdf["file_id"], "shard": pdf["shard"], "bin": [f"{lead}{b:06d}" for b in local]})

    sharded = kept.withColumn("shard", F.pmod(F.hash("file_id"), F.lit(shards)).cast("int"))
    return sharded.groupBy("shard", "apart").applyInPandas(fit, "file_id long, shard int, bin string"), shards


@dataclass(frozen=True)
class Compacted:
    """Where the data, the unreadable rest and the manifest were published: the run that the pointer file names."""

    path: str
    report: dict

    def manifest(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/manifest")

    def data(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/data")


def published(spark: SparkSession, destination: str) -> Compacted | None:
    """What a pointer file under ``destination`` names, None without one."""
    fs, at = filesystem(spark, f"{destination}/{POINTER}")
    if not fs.exists(at):
        return None
    named = json.loads("".join(r[0] for r in spark.read.text(f"{destination}/{POINTER}").collect()))  # one line
    return Compacted(f"{destination}/{named['run']}", named["report"])


def _sums(df: DataFrame) -> DataFrame:
    return df.groupBy("bin").agg(F.count("*").alias("n"), F.sum(F.col("checksum").cast("decimal(20,0)")).alias("total"))


def _publish(spark: SparkSession, destination: str, run: str, report: dict) -> None:
    """Write the pointer beside its place and put it there by one rename of one small file."""
    path = lambda name: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{destination}/{name}")
    fs, pointer = filesystem(spark, f"{destination}/{POINTER}")
    draft = path(f"{run}/pointer.json")
    out = fs.create(draft)
    out.write(bytearray(json.dumps({"run": run, "report": report}).encode()))
    out.close()
    if fs.exists(pointer) or not fs.rename(draft, pointer):
        raise CompactionError(f"{destination} was published already or can't be written to")


def compact(spark: SparkSession, files: DataFrame, destination: str, target_bytes: int = TARGET_BYTES) -> Compacted:
    """Rewrite ``files`` (file_id, file_path, content, ...) under ``destination``.

    A run's ``data/shard=.../bin=...`` holds one file per bin with each annotation exactly once, its
    ``manifest`` every listed id with its keeper, bin and defect. Other columns of ``files`` travel along, but
    for ``shard``, ``bin`` and ``checksum``, which are the operator's. The content is shuffled once, to the shard that its bins are in.
    The run is published by a pointer file. Raises CompactionError, publishing nothing, when what was written
    differs from the manifest. An empty table gives an empty manifest and no data file.
    """
    if published(spark, destination):
        raise CompactionError(f"{destination} was published already")
    run = f"run-{uuid.uuid4().hex}"
    staging = f"{destination}/{run}"
    listed = scratch_path(spark, "listed")
    try:
        with_keepers(file_manifest(files)).write.parquet(listed)
        frozen = spark.read.parquet(listed)
        packed, shards = pack(frozen, target_bytes)
        frozen.join(packed, "file_id", "left").write.parquet(f"{staging}/manifest")
        placed = spark.read.parquet(f"{staging}/manifest")
        extra = [F.col(f"`{c}`") for c in files.columns if c not in ("shard", "bin", "checksum")]
        content = files.where("file_id IS NOT NULL").select(*extra, F.xxhash64("file_id", "file_path", "content").alias("_sum")).repartition(shards, "file_id")
        wanted = placed.where("bin IS NOT NULL").select("file_id", "checksum", "shard", "bin").repartition(shards, "file_id")
        # compared by xor, so that the join is on the id alone and keeps the shards as they are
        chosen = content.join(wanted.hint("shuffle_hash"), "file_id").where(F.col("_sum").bitwiseXOR(F.col("checksum")) == 0)
        once = chosen.withColumn("_nth", F.row_number().over(Window.partitionBy("shard", "bin", "file_id").orderBy("_sum"))).where("_nth = 1")
        once.drop("_sum", "checksum", "_nth").write.partitionBy("shard", "bin").parquet(f"{staging}/data")

        expected = _sums(wanted)
        if not expected.isEmpty():
            written = spark.read.parquet(f"{staging}/data").select("bin", F.xxhash64("file_id", "file_path", "content").alias("checksum"))
            wrong = expected.alias("e").join(_sums(written).alias("w"), "bin", "full").where("NOT (e.n <=> w.n AND e.total <=> w.total)").limit(5).collect()
            if wrong:
                raise CompactionError(f"bins that differ from the manifest: {[r['bin'] for r in wrong]}")
        report = placed.agg(F.count("*").alias("files"), F.count_if(F.col("keeper") != F.col("file_id")).alias("copies"), F.count_if(F.col("defect").isNotNull()).alias("unreadable"), F.count_distinct("bin").alias("bins")).first().asDict()
        _publish(spark, destination, run, report)
        return Compacted(staging, report)
    except BaseException:
        discard(spark, staging)
        raise
    finally:
        discard(spark, listed)

"""Recomputing only what changed: fingerprints per frame, reuse decisions and the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What to do with stored results.
POLICIES = ("reuse_if_compatible", "require_existing", "rebuild")


def resolve_policy(policy: str | None = None, resume: bool | None = None) -> str:
    """The policy by name, or from the older flag; both at once, or an unknown name, is an error."""
    if policy is None:
        return POLICIES[0] if resume is None or resume else POLICIES[2]
    if resume is not None or policy not in POLICIES:
        raise ValueError(f"one of {', '.join(POLICIES)}, and no flag besides")
    return policy


def decide(expected: DataFrame, stored: DataFrame, policy: str = POLICIES[0]) -> DataFrame:
    """``key, action``: ``reuse`` where the stored fingerprint is the expected one and the stored content that of the manifest,
    else ``compute``; stored keys nobody expects are ``stale``.

    ``expected`` has ``key, fingerprint``; ``stored`` ``key, fingerprint, sha256, manifest_sha256``. ``rebuild`` computes all,
    ``require_existing`` fails on the first key that can't be reused.
    """
    resolve_policy(policy)
    s = stored.select("key", F.col("fingerprint").alias("_f"), (F.col("sha256") == F.col("manifest_sha256")).alias("_same"), F.lit(True).alias("_there"))
    joined = expected.join(s, "key", "full")
    good = F.coalesce((F.col("fingerprint") == F.col("_f")) & F.col("_same"), F.lit(False))
    missing = F.lit("compute")
    if policy == POLICIES[1]:
        missing = F.raise_error(F.concat(F.lit("no compatible result for "), F.col("key").cast("string"))).cast("string")
    reuse = F.lit(False) if policy == POLICIES[2] else good
    return joined.select("key", F.when(F.col("fingerprint").isNull(), "stale").when(reuse, "reuse").otherwise(missing).alias("action"))


def manifest(decisions: DataFrame) -> DataFrame:
    """One row: how many keys are expected, reused, computed and stale."""
    count = lambda a: F.count_if(F.col("action") == a)
    return decisions.agg((count("reuse") + count("compute")).alias("expected"), count("reuse").alias("skipped"), count("compute").alias("written"), count("stale").alias("stale"))


def validate(paths: DataFrame, records: DataFrame) -> DataFrame:
    """``path, status`` of split paths against manifest records (path, sha256, fingerprint, stored_sha256, expected): ``ok``,
    ``missing``, ``duplicate``, ``changed`` or ``incompatible``."""
    n = records.groupBy("path").agg(F.count("*").alias("_n"), F.max(F.struct("sha256", "stored_sha256", "fingerprint", "expected")).alias("r"))
    status = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "duplicate").when(~F.col("r.sha256").eqNullSafe(F.col("r.stored_sha256")), "changed").when(~F.col("r.fingerprint").eqNullSafe(F.col("r.expected")), "incompatible").otherwise("ok")
    return paths.select("path").distinct().join(n, "path", "left").select("path", status.alias("status"))


def update(result: DataFrame, path: str, partition: str = "sequence") -> None:
    """Writes recomputed rows, replacing only the partitions they belong to."""
    result.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)

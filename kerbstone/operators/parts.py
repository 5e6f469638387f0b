"""Train, validation and test queries of a recording, without shared ground truth.

Queries have dense numbers ``q``; ``positives`` is a table (q, d). Cuts are computed on the driver in double
precision, as they depend on a count and ratios alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbstone.runtime import global_rank


def _annotated(positives: DataFrame) -> DataFrame:
    return positives.select("q").distinct()


def _check_ratios(test_ratio: float, validation_ratio: float) -> None:
    if not (0 < test_ratio < 1 and 0 <= validation_ratio < 1):
        raise ValueError("test_ratio must be between 0 and 1, validation_ratio at least 0 and under 1")


def temporal_split(n: int, positives: DataFrame, test_ratio: float = 0.2, validation_ratio: float = 0.1) -> DataFrame:
    """``q, part``: annotated queries from the last ``test_ratio`` on are test, of the rest the last share validation."""
    _check_ratios(test_ratio, validation_ratio)
    cut = int(n * (1 - test_ratio))
    known = _annotated(positives)
    rest = known.where(F.col("q") < cut)
    total = rest.count()
    held = min(total, max(1, int(total * validation_ratio))) if validation_ratio else 0
    ranked = global_rank(rest, "q", "_k")
    parts = ranked.select("q", F.when(F.col("_k") >= total - held, "validation").otherwise("train").alias("part"))
    return parts.unionByName(known.where(F.col("q") >= cut).select("q", F.lit("test").alias("part")))


def _sharing(queries: DataFrame, positives: DataFrame, others: DataFrame) -> DataFrame:
    """Of ``queries`` those with a positive in common with ``others``."""
    taken = positives.join(others.select("q"), "q", "left_semi").select("d").distinct()
    return positives.join(queries.select("q"), "q", "left_semi").join(taken, "d", "left_semi").select("q").distinct()


def guard_ground_truth(parts: DataFrame, positives: DataFrame) -> DataFrame:
    """``q, part, excluded``: validation queries sharing a positive with train are excluded, then test queries sharing
    one with train or with a validation query that was kept."""
    of = lambda p: parts.where(F.col("part") == p).select("q")
    train, validation, test = of("train"), of("validation"), of("test")
    bad_validation = _sharing(validation, positives, train)
    kept = validation.join(bad_validation, "q", "left_anti")
    bad_test = _sharing(test, positives, train.unionByName(kept))
    bad = bad_validation.unionByName(bad_test).withColumn("excluded", F.lit(True))
    return parts.join(bad, "q", "left").select("q", "part", F.coalesce("excluded", F.lit(False)).alias("excluded"))


def validation_blocks(n: int, validation_ratio: float, centres: Sequence[float]) -> list[tuple[int, int]]:
    """First and end position, among ``n`` queries before the test, of equally wide blocks around the centres; ValueError if they overlap."""
    if not centres:
        raise ValueError("there must be a centre at least")
    width = max(1, int(n * validation_ratio / len(centres)))
    starts = [min(max(0, int(n * float(c)) - width // 2), n - width) for c in centres]
    if any(b < a + width for a, b in zip(starts, starts[1:], strict=False)):
        raise ValueError("validation blocks overlap")
    return [(a, a + width) for a in starts]


def block_split(n: int, positives: DataFrame, test_ratio: float = 0.2, validation_ratio: float = 0.2, centres: Sequence[float] = (0.3, 0.7)) -> DataFrame:
    """``q, part, excluded`` with validation in blocks of the annotated queries before the test.

    Validation queries sharing a positive with test are excluded, then training queries sharing one with test or kept
    validation. Every query of a block leaves training.
    """
    _check_ratios(test_ratio, validation_ratio)
    cut = int(n * (1 - test_ratio))
    known = _annotated(positives)
    before = global_rank(known.where(F.col("q") < cut), "q", "_k")
    inside = F.lit(False)
    for lo, hi in validation_blocks(before.count(), validation_ratio, centres):
        inside = inside | ((F.col("_k") >= lo) & (F.col("_k") < hi))
    parts = before.select("q", F.when(inside, "validation").otherwise("train").alias("part")).unionByName(known.where(F.col("q") >= cut).withColumn("part", F.lit("test")))
    of = lambda p: parts.where(F.col("part") == p).select("q")
    bad_validation = _sharing(of("validation"), positives, of("test"))
    kept = of("validation").join(bad_validation, "q", "left_anti")
    bad_train = _sharing(of("train"), positives, of("test").unionByName(kept))
    bad = bad_validation.unionByName(bad_train).withColumn("excluded", F.lit(True))
    return parts.join(bad, "q", "left").select("q", "part", F.coalesce("excluded", F.lit(False)).alias("excluded"))


def geographic_split(positions: DataFrame, positives: DataFrame, test_ratio: float = 0.2, validation_ratio: float = 0.1, radius: float = 25.0) -> DataFrame:
    """``q, part, excluded`` of queries with a position (q, x, y): cut by order, then validation within ``radius`` of train is
    excluded, then test within it of train or kept validation. Queries without positives are left out at the end.
    """
    from kerbstone.operators.ground_truth import radius_positives

    _check_ratios(test_ratio, validation_ratio)
    placed = positions.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    n = placed.count()
    test_at = int(n * (1 - test_ratio))
    validation_at = int(n * (1 - test_ratio - validation_ratio))
    ranked = global_rank(placed, "q", "_k")
    known = ranked.select("q", "x", "y", F.when(F.col("_k") >= test_at, "test").when(F.col("_k") >= validation_at, "validation").otherwise("train").alias("part"))
    of = lambda p: known.where(F.col("part") == p).select(F.col("q").alias("id"), "x", "y")
    near = lambda a, b: radius_positives(a, b, radius).select("q").distinct()
    bad_validation = near(of("validation"), of("train"))
    kept = of("validation").join(bad_validation.withColumnRenamed("q", "id"), "id", "left_anti")
    bad = bad_validation.unionByName(near(of("test"), of("train").unionByName(kept))).withColumn("excluded", F.lit(True))
    return known.join(bad, "q", "left").join(_annotated(positives), "q", "left_semi").select("q", "part", F.coalesce("excluded", F.lit(False)).alias("excluded"))


def fold_split(folds: DataFrame, fold: int, frames: DataFrame, positives: DataFrame) -> DataFrame:
    """``q, part``: annotated frames (q, stem) by the part their stem has in the fold; stems without a frame give none."""
    own = folds.where(F.col("fold") == fold).select("stem", "part")
    return frames.join(own, "stem").join(_annotated(positives), "q", "left_semi").select("q", "part")


def unknown_stems(folds: DataFrame, fold: int, frames: DataFrame) -> DataFrame:
    """``part, unknown``: how many stems of the fold no frame has."""
    return folds.where(F.col("fold") == fold).join(frames, "stem", "left_anti").groupBy("part").agg(F.count("*").alias("unknown"))


def cross_validation_split(n: int, positives: DataFrame, folds: int = 5, test_fold: int = 0) -> DataFrame:
    """``q, part``: consecutive folds of even length (bounds rounded half to even); the fold after the test's is validation."""
    if folds < 3 or not 0 <= test_fold < folds:
        raise ValueError("there must be three folds at least, and the test fold one of them")
    bounds = [round(n * i / folds) for i in range(folds + 1)]
    inside = lambda f: (F.col("q") >= bounds[f]) & (F.col("q") < bounds[f + 1])
    return _annotated(positives).select("q", F.when(inside(test_fold), "test").when(inside((test_fold + 1) % folds), "validation").otherwise("train").alias("part"))


def evaluation_split(positives: DataFrame) -> DataFrame:
    """Every annotated query is test."""
    return _annotated(positives).withColumn("part", F.lit("test"))


def central_positives(positives: DataFrame, fraction: float = 0.5) -> DataFrame:
    """The middle share of each query's positives: at least one, the count rounded half to even."""
    per = Window.partitionBy("q")
    counted = positives.select("q", "d").distinct().withColumn("_k", F.row_number().over(per.orderBy("d")) - 1).withColumn("_n", F.count("*").over(per))
    count = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(float(fraction))).cast("int"))
    start = F.floor((F.col("_n") - count) / 2)
    return counted.where((F.col("_k") >= start) & (F.col("_k") < start + count)).select("q", "d")


def training_positives(positives: DataFrame, near: DataFrame) -> DataFrame:
    """Ground truth that is also near (q, d); queries left without any disappear."""
    return positives.select("q", "d").intersect(near.select("q", "d"))


def same_group(positives: DataFrame, queries: DataFrame, database: DataFrame) -> DataFrame:
    """``q, d``: positives whose query (q, group) and database item (d, group) are of one group, as of one camera; a null group is one as well."""
    a, b = queries.select("q", F.col("group").alias("_a")), database.select("d", F.col("group").alias("_b"))
    return positives.select("q", "d").join(a, "q").join(b, "d").where(F.col("_a").eqNullSafe(F.col("_b"))).select("q", "d")

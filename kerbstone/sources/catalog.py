"""Catalogues of frames: dense indices per recording, cameras put together, order checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbstone.functions.text import camera_stem
from kerbstone.runtime import global_number, materialise


def indexed_frames(frames: DataFrame, allowed: DataFrame | None = None, pattern: str | None = None) -> DataFrame:
    """Each stem of a recording once with its position in the sorted stems (as text).

    ``allowed`` (stem) limits the frames, ``pattern`` the form of a stem. Null stems are left out.
    """
    kept = frames.where("stem IS NOT NULL AND sequence IS NOT NULL")
    kept = kept if pattern is None else kept.where(F.col("stem").rlike(pattern))
    kept = kept if allowed is None else kept.join(allowed.select("stem"), "stem", "left_semi")
    return global_number(kept.select("sequence", "stem").distinct(), ["sequence"], ["stem"], "frame_index")


def camera_frames(frames: DataFrame, cameras: Sequence[str]) -> DataFrame:
    """Frames (camera, traversal, stem) of several cameras, the first of ``cameras`` leading and keeping its stems, the others'
    prefixed by the camera; indices run on over the cameras of a traversal."""
    rank = F.array_position(F.array(*[F.lit(c) for c in cameras]), F.col("camera"))
    known = frames.where(F.col("camera").isin(*cameras)).withColumn("_rank", rank)
    named = known.select("camera", "traversal", "_rank", F.col("stem").alias("_stem"), camera_stem(F.col("camera"), F.col("stem"), cameras[0]).alias("stem"))
    return global_number(named, ["traversal"], ["_rank", "_stem"], "frame_index").select("camera", "traversal", "stem", "frame_index")


def order_defects(frames: DataFrame) -> DataFrame:
    """``sequence, frames, gaps, backwards``: frames (sequence, idx, ts) whose index doesn't follow the last, or whose stamp is earlier.

    A frame meets the one before it by their numbers, so a long recording is no single task's work.
    """
    numbered = materialise(global_number(frames.select("sequence", "idx", "ts"), ["sequence"], ["idx"], "n"), "numbered")
    before = numbered.select("sequence", (F.col("n") + 1).alias("n"), F.col("idx").alias("_idx"), F.col("ts").alias("_ts"))
    seen = numbered.join(before, ["sequence", "n"], "left")
    gap = F.when(F.col("_idx").isNull(), F.col("idx") != 0).otherwise(F.col("idx") != F.col("_idx") + 1)
    return seen.groupBy("sequence").agg(F.count("*").alias("frames"), F.count_if(gap).alias("gaps"), F.count_if(F.coalesce(F.col("ts") < F.col("_ts"), F.lit(False))).alias("backwards"))

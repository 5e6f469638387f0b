"""Which database frames show the place of a query frame: by distance, by annotated intervals, by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbstone.operators.asof import interpolate, nearest
from kerbstone.operators.spatial import latest_nearby, located, near_distances
from kerbstone.runtime import parallelism

#: The metric radius, and the frames that must lie between two visits of a place.
RADIUS_M, REVISIT_SPAN = 25.0, 200
#: Fixed value: how far a correspondence may lie from a frame.
TOLERANCE_NS = 50_000_000
#: Frames of an interval that one row holds before they become rows.
PIECE_FRAMES = 65_536


def frame_stamps(frames: DataFrame) -> DataFrame:
    """``sequence, idx, ts``: each frame once with its stamp in ns, from the stem where it is null."""
    stamp = F.coalesce(F.col("ts"), F.expr("try_cast(substring_index(stem, '_', -1) AS BIGINT)"))
    micro = F.coalesce(F.col("adapter") == "drive", stamp < F.lit(10**17))
    return frames.where("sequence IS NOT NULL AND idx IS NOT NULL").groupBy("sequence", "idx").agg(F.max(F.when(micro, stamp * 1000).otherwise(stamp)).alias("ts"))


def frame_positions(frames: DataFrame, tracks: DataFrame) -> DataFrame:
    """``sequence, idx, ts, northing, easting``: positions on the track of the frame's own recording.

    Null outside the log. Samples without a fix take no part.
    """
    samples = located(tracks).select("sequence", (F.col("ts") * 1000).alias("ts"), "northing", "easting")
    return interpolate(frame_stamps(frames), samples, "sequence", "ts", ["northing", "easting"])


def radius_positives(queries: DataFrame, database: DataFrame, radius: float = RADIUS_M, dims: int = 2) -> DataFrame:
    """``q, d, distance``: pairs at most ``radius`` apart, in as many of x, y, z as ``dims`` says (0: all three).

    Both sides have ``id, x, y`` and, for three dimensions, ``z``; an id appears once. Rows without a position have no positives. Distances come
    from where the pairs are found, so pairs are not shuffled.
    """
    if radius <= 0:
        raise ValueError("the radius must be positive")
    zero = F.lit(0.0)
    y, z = zero if dims == 1 else F.col("y"), F.col("z").cast("double") if dims in (0, 3) else zero
    side = lambda df, b: df.select("id", "x", y.alias("y"), F.lit(b).alias("side_b"), z.alias("z"))
    pairs = near_distances(side(queries, False).unionByName(side(database, True)), radius)
    return pairs.select(F.col("id_a").alias("q"), F.col("id_b").alias("d"), "distance")


def revisit_fraction(positions: DataFrame, radius: float = RADIUS_M, span: int = REVISIT_SPAN) -> DataFrame:
    """``sequence, frames, revisits``: per recording (sequence, n, x, y) the share of frames near one at least ``span`` later; 0 for short logs.

    ``n`` numbers the frames of all recordings, those of one without gaps in their order. Each frame asks for the latest one within reach, so
    a place where a vehicle stands gives as many rows as frames, not pairs.
    """
    logs = positions.groupBy("sequence").agg(F.min("n").alias("log"), F.count("*").alias("frames"))
    placed = positions.join(logs.select("sequence", "log"), "sequence").select(F.col("n").alias("id"), "x", "y", F.col("log").alias("group"))
    latest = latest_nearby(placed, radius).where(F.col("latest") >= F.col("id") + span).select(F.col("id").alias("n"))
    hits = positions.select("sequence", "n").join(latest, "n").groupBy("sequence").agg(F.count("*").alias("hits"))
    share = F.when(F.col("frames") > span, F.coalesce("hits", F.lit(0)) / F.col("frames")).otherwise(F.lit(0.0))
    return logs.join(hits, "sequence", "left").select("sequence", "frames", share.alias("revisits"))


def map_correspondences(loops: DataFrame, reference: DataFrame, query: DataFrame, tolerance: int = TOLERANCE_NS, strict: bool = True) -> DataFrame:
    """``loop, query_index, start_index, end_index``: correspondences (loop, query_ts, start_ts, end_ts) as frames.

    ``reference`` and ``query`` have ``idx, ts``. A start or end outside the reference's range is null; inside it but
    farther than the tolerance from any frame the query fails (``strict``) or it is null.
    """
    def at(probe: str, frames: DataFrame, name: str, outside_is_null: bool) -> DataFrame:
        asked = loops.select("loop", F.lit("x").alias("by"), F.col(probe).alias("t"))
        known = frames.select(F.lit("x").alias("by"), F.col("ts").alias("t"), "idx")
        got = nearest(asked, known, "by", "t", ["idx"], bucket=None)
        far = F.col("delta") > tolerance
        message = F.concat(F.lit(f"{probe} of correspondence "), F.col("loop").cast("string"), F.lit(" is too far from any frame"))
        index = F.col("found.idx")
        checked = F.when(far, F.raise_error(message).cast("long") if strict else F.lit(None).cast("long")).otherwise(index)
        return got.select("loop", (F.when(F.col("clamped"), F.lit(None).cast("long")).otherwise(checked) if outside_is_null else checked).alias(name))

    q = at("query_ts", query, "query_index", False)
    return q.join(at("start_ts", reference, "start_index", True), "loop").join(at("end_ts", reference, "end_index", True), "loop")


def merged_intervals(intervals: DataFrame, by: str) -> DataFrame:
    """``by, a, b``: the intervals (from a to b) of each key, overlapping ones made one."""
    along = Window.partitionBy(by).orderBy("a")
    reached = F.max("b").over(along.rowsBetween(Window.unboundedPreceding, -1))
    own = intervals.groupBy(by, "a").agg(F.max("b").alias("b")).withColumn("new", F.coalesce((F.col("a") > reached).cast("int"), F.lit(1)))
    return own.withColumn("run", F.sum("new").over(along)).groupBy(by, "run").agg(F.min("a").alias("a"), F.max("b").alias("b")).select(by, "a", "b")


def frames_of(intervals: DataFrame) -> DataFrame:
    """``q, d``: every frame of intervals ``q, a, b`` that don't overlap.

    Intervals are cut into pieces and spread before frames are made of them: frames are not shuffled, no row holds a long interval, and
    a few rows of intervals don't end up in one task.
    """
    cut = intervals.select("q", F.explode(F.sequence("a", "b", F.lit(PIECE_FRAMES).cast("long"))).alias("a"), "b")
    pieces = cut.select("q", "a", F.least(F.col("a") + (PIECE_FRAMES - 1), "b").alias("b")).repartition(parallelism(intervals.sparkSession), "q", "a")
    return pieces.select("q", F.explode(F.sequence("a", "b")).alias("d"))


def interval_positives(loops: DataFrame) -> DataFrame:
    """``q, d``: every frame between start and end, both included, over all loops of a query with both ends."""
    whole = loops.where("query_index IS NOT NULL AND start_index IS NOT NULL AND end_index IS NOT NULL")
    return frames_of(merged_intervals(whole.select(F.col("query_index").alias("q"), F.least("start_index", "end_index").alias("a"), F.greatest("start_index", "end_index").alias("b")), "q"))


def inherited_intervals(loops: DataFrame, singles: DataFrame, query: DataFrame) -> DataFrame:
    """``q, a, b``: every query frame (idx, ts) takes the intervals of the nearest keyframe, of equally near the earlier; they don't overlap.

    Keyframes are the queries of ``loops`` (with ``query_ts``) and ``singles`` (ts) inside the queries' time range. A single, or a loop
    without both ends, gives no positives; a loop at the stamp of a single counts.
    """
    span = query.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    has = F.col("start_index").isNotNull() & F.col("end_index").isNotNull()
    of_loops = loops.select(F.col("query_ts").alias("t"), F.when(has, F.struct(F.least("start_index", "end_index").alias("a"), F.greatest("start_index", "end_index").alias("b"))).alias("i"))
    of_singles = singles.select(F.col("ts").alias("t"), F.lit(None).cast("struct<a:long,b:long>").alias("i"))
    keys = of_loops.unionByName(of_singles).where(F.col("t").between(F.lit(span["lo"]).cast("long"), F.lit(span["hi"]).cast("long")))
    at = keys.select(F.lit("x").alias("by"), "t").distinct().withColumn("k", F.col("t"))
    got = nearest(query.select("idx", F.lit("x").alias("by"), F.col("ts").alias("t")), at, "by", "t", ["k"], bucket=None).select("idx", F.col("found.k").alias("k"))
    merged = merged_intervals(keys.where("i IS NOT NULL").select(F.col("t").alias("k"), "i.a", "i.b"), "k")
    return got.join(merged, "k").select(F.col("idx").alias("q"), "a", "b")


def inherited_positives(loops: DataFrame, singles: DataFrame, query: DataFrame) -> DataFrame:
    """``q, d``: every frame of the ``inherited_intervals``."""
    return frames_of(inherited_intervals(loops, singles, query))


def extend_folds(folds: DataFrame, frames: DataFrame, max_gap: int) -> DataFrame:
    """``fold, part, stem``: the assignment (fold, part, stem) and, per fold, other cameras' frames (stem, ts) by the part
    of the nearest assigned frame at most ``max_gap`` away, of equally near the earlier. Stems that are no digits are left out.
    """
    stamp = F.when(F.col("stem").rlike(r"^\d+$"), F.expr("try_cast(stem AS BIGINT)"))
    known = folds.select(F.col("fold").cast("string").alias("by"), stamp.alias("t"), "part").where("t IS NOT NULL")
    every = F.array(*[F.lit(r["fold"]) for r in folds.select("fold").distinct().collect()]).cast("array<int>")  # a handful
    asked = frames.select(F.explode(every).alias("fold"), "stem", F.col("ts").alias("t")).withColumn("by", F.col("fold").cast("string"))
    got = nearest(asked, known, "by", "t", ["part"], max_gap, None).where("found IS NOT NULL").select("fold", F.col("found.part").alias("part"), "stem")
    return folds.select("fold", "part", "stem").unionByName(got.join(folds.select("fold", "stem"), ["fold", "stem"], "left_anti").select("fold", "part", "stem"))

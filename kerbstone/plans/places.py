"""Queries over frames, tracks and ground truth: catalogues, as-of and range joins, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbstone.config import settings_from
from kerbstone.functions.text import camera_stem, seconds_to_ns, stem_camera, stem_index, stem_stamp
from kerbstone.operators import ground_truth as gt
from kerbstone.operators import parts
from kerbstone.operators.spatial import located
from kerbstone.pipeline import fold_gap_us, make_split
from kerbstone.pipeline import training_positives as pipeline_positives
from kerbstone.runtime import global_number, materialise, table
from kerbstone.sources import catalog


def _micros():
    """A timestamp without time zone as µs since 1970."""
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "frames")


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "tracks").select("sequence", "side").distinct()


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned frames with their side."""
    placed = gt.frame_positions(_frames(spark, sf_dir), table(spark, sf_dir, "tracks")).where("northing IS NOT NULL").join(_sides(spark, sf_dir), "sequence")
    return placed.select("sequence", "idx", "side", F.col("easting").alias("x"), F.col("northing").alias("y"))


def _truth(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, database, positives): dense query numbers over all query recordings, positives within 25 m."""
    placed = materialise(global_number(_positions(spark, sf_dir), ["side"], ["sequence", "idx"], "id"), "places")
    queries, database = (placed.where(F.col("side") == side) for side in ("query", "database"))
    return queries, database, materialise(gt.radius_positives(queries, database).select("q", "d"), "positives")


def frame_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.indexed_frames(_frames(spark, sf_dir)).select("sequence", "stem", "frame_index")


def catalog_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.order_defects(gt.frame_stamps(_frames(spark, sf_dir)))


def camera_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frames(spark, sf_dir).where("adapter IS NOT NULL").select(F.col("adapter").alias("camera"), F.lit("all").alias("traversal"), "stem").distinct()
    return catalog.camera_frames(rows, ["walk", "drive", "ride"]).select("traversal", "stem", "frame_index")


def frame_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = camera_stem(F.col("adapter"), F.col("stem"), "walk")
    return _frames(spark, sf_dir).select("stem", "adapter").distinct().select("stem", stem.alias("camera_stem"), stem_camera(stem, "walk").alias("camera"), stem_index(F.col("stem")).alias("idx"), stem_stamp(F.col("stem")).cast("string").alias("ts"))


def track_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable samples of each recording: how many, first and last."""
    return located(table(spark, sf_dir, "tracks")).dropDuplicates(["sample_id"]).groupBy("sequence").agg(F.count("*").alias("samples"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def timestamp_ns_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = _micros()
    text = F.concat((micros / 1_000_000).cast("bigint").cast("string"), F.lit("."), F.rtrim(F.lpad((micros % 1_000_000).cast("string"), 6, "0"), F.lit("0")))
    return table(spark, sf_dir, "events").select("event_id", seconds_to_ns(F.regexp_replace(text, r"\.$", "")).alias("ns"))


def asof_nearest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbstone.operators.asof import nearest

    samples = located(table(spark, sf_dir, "tracks")).select("sequence", (F.col("ts") * 1000).alias("ts"), "sample_id")
    got = nearest(gt.frame_stamps(_frames(spark, sf_dir)), samples, "sequence", "ts", ["sample_id"], 1_000_000_000)
    return got.select("sequence", "idx", F.col("found._ts").cast("string").alias("sample_ts"), "delta", "clamped")


def frame_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = gt.frame_positions(_frames(spark, sf_dir), table(spark, sf_dir, "tracks"))
    return got.select("sequence", "idx", F.round("northing", 4).alias("northing"), F.round("easting", 4).alias("easting"))


def frames_without_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = gt.frame_positions(_frames(spark, sf_dir), table(spark, sf_dir, "tracks"))
    return got.groupBy("sequence").agg(F.count("*").alias("frames"), F.count_if(F.col("northing").isNull()).alias("unplaced"))


def radius_positives_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d, positives = _truth(spark, sf_dir)
    name = lambda df, k, lead: df.select(F.col("id").alias(k), F.col("sequence").alias(f"{lead}_sequence"), F.col("idx").alias(f"{lead}_idx"))
    return positives.join(name(q, "q", "query"), "q").join(name(d, "d", "database"), "d").select("query_sequence", "query_idx", "database_sequence", "database_idx")


def radius_positives_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of two kinds as points in space: user, value and weekday-scaled time."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type", (F.col("user_id") * 10.0).alias("x"), F.col("value").alias("y"), (F.col("event_id") % 100).cast("double").alias("z"))
    got = gt.radius_positives(e.where("event_type = 'purchase'"), e.where("event_type = 'signup'"), 12.5, 3)
    return got.select("q", "d", F.round("distance", 6).alias("distance"))


def revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every recording, by its samples, the share that comes back to a place."""
    own = located(table(spark, sf_dir, "tracks")).groupBy("sequence", "ts").agg(F.min(F.struct("easting", "northing")).alias("p"))
    points = global_number(own, [], ["sequence", "ts"], "n").select("sequence", "n", F.col("p.easting").alias("x"), F.col("p.northing").alias("y"))
    got = gt.revisit_fraction(materialise(points, "points"), 2.0)
    return got.select("sequence", "frames", F.round("revisits", 6).alias("revisits"))


def _events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Events as two recordings: (reference, query) frames with idx and ts in µs, loops and singles."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", _micros().alias("ts"))
    numbered = materialise(global_number(e.withColumn("odd", F.col("user_id") % 2), ["odd"], ["ts", "event_id"], "idx"), "events")
    reference, query = (numbered.where(F.col("odd") == odd).select("idx", "ts") for odd in (0, 1))
    hour = 3_600_000_000
    keyed = query.where("idx % 7 IN (0, 3)")
    loops = keyed.where("idx % 7 = 0").select(F.col("idx").alias("loop"), F.col("ts").alias("query_ts"), (F.col("ts") - hour).alias("start_ts"), (F.col("ts") + hour).alias("end_ts"))
    return reference, query, loops, keyed.where("idx % 7 = 3").select("ts")


def correspondence_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference, query, loops, _ = _events(spark, sf_dir)
    return gt.map_correspondences(loops, reference, query, 10**12, strict=False)


def interval_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gt.interval_positives(correspondence_map(spark, sf_dir))


def interval_positives_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference, query, loops, singles = _events(spark, sf_dir)
    mapped = gt.map_correspondences(loops, reference, query, 10**12, strict=False)
    got = gt.inherited_intervals(mapped.join(loops.select("loop", "query_ts"), "loop"), singles, query)
    return got.groupBy("q").agg(F.sum(F.col("b") - F.col("a") + 1).alias("n"), F.min("a").alias("first_d"), F.max("b").alias("last_d"))


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digit-named frames of the drives dealt to three folds in runs of frames."""
    rows = _frames(spark, sf_dir).where("adapter = 'drive'").select("stem", "idx").distinct()
    rows = rows.select("stem", "idx", F.explode(F.array(*map(F.lit, range(3)))).alias("fold"))
    fold = (F.floor(F.col("idx") / 10) % 3).cast("int")
    return rows.select("fold", F.when(fold == F.col("fold"), "test").when(fold == (F.col("fold") + 1) % 3, "validation").otherwise("train").alias("part"), "stem")


def fold_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = _frames(spark, sf_dir).where("adapter = 'ride'").select("stem", F.expr("try_cast(stem AS BIGINT) DIV 1000").alias("ts")).distinct()
    return gt.extend_folds(_folds(spark, sf_dir), other, fold_gap_us(settings_from({"dataset": {"camera_fold_max_gap_s": 300.0}})))


def fold_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir).where("adapter = 'drive'").select("sequence", "stem").distinct()
    numbered = global_number(frames, [], ["stem", "sequence"], "q")
    annotated = numbered.where("q % 3 <> 1").select("q", F.lit(0).alias("d"))
    return parts.fold_split(_folds(spark, sf_dir), 1, numbered, annotated)


def _split(make):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        q, _, positives = _truth(spark, sf_dir)
        return make(q, positives)

    query.__name__ = make.__name__
    return query


@_split
def temporal_split(q: DataFrame, positives: DataFrame) -> DataFrame:
    return parts.temporal_split(q.count(), positives)


@_split
def ground_truth_guard(q: DataFrame, positives: DataFrame) -> DataFrame:
    return parts.guard_ground_truth(parts.temporal_split(q.count(), positives), positives)


@_split
def block_split(q: DataFrame, positives: DataFrame) -> DataFrame:
    return parts.block_split(q.count(), positives)


@_split
def geographic_split(q: DataFrame, positives: DataFrame) -> DataFrame:
    return parts.geographic_split(q.select(F.col("id").alias("q"), "x", "y"), positives)


@_split
def kfold_split(q: DataFrame, positives: DataFrame) -> DataFrame:
    return parts.cross_validation_split(q.count(), positives, 5, 2)


@_split
def evaluation_split(q: DataFrame, positives: DataFrame) -> DataFrame:
    return parts.evaluation_split(positives)


@_split
def central_positives(q: DataFrame, positives: DataFrame) -> DataFrame:
    return parts.central_positives(positives, 0.5)


@_split
def split_by_settings(q: DataFrame, positives: DataFrame) -> DataFrame:
    """The split that a file of settings asks for."""
    return make_split(q.select(F.col("id").alias("q")), positives, settings_from({"dataset": {"split_guard": "ground_truth_blocks", "validation_ratio": 0.2, "validation_centres": [0.3, 0.7]}}))


def same_camera_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives whose frames are of one adapter, as settings with same_camera_triplets ask for."""
    q, d, positives = _truth(spark, sf_dir)
    cameras = _frames(spark, sf_dir).where("adapter IS NOT NULL").groupBy("sequence").agg(F.min("adapter").alias("group"))
    of = lambda df, key: df.join(cameras, "sequence", "left").select(F.col("id").alias(key), "group")
    got, _ = pipeline_positives(positives, settings_from({"training": {"same_camera_triplets": True}}), groups=(of(q, "q"), of(d, "d")))
    return got


def training_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d, positives = _truth(spark, sf_dir)
    return parts.training_positives(positives, gt.radius_positives(q, d, 10.0))


def negative_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Database frames near a query beyond the positive radius: neither positives nor negatives."""
    q, d, positives = _truth(spark, sf_dir)
    return gt.radius_positives(q, d, 60.0).select("q", "d").join(positives, ["q", "d"], "left_anti")


def queries_without_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, _, positives = _truth(spark, sf_dir)
    return q.join(positives.select(F.col("q").alias("id")), "id", "left_anti").groupBy("sequence").agg(F.count("*").alias("queries"))


QUERIES = {
    f.__name__: f
    for f in (
        frame_catalog, catalog_defects, camera_union, frame_names, track_log, timestamp_ns_parse, asof_nearest_sample, frame_positions, frames_without_position,
        radius_positives_2d, radius_positives_3d, revisits, correspondence_map, interval_positives, interval_positives_inherited, fold_extension, fold_split,
        temporal_split, ground_truth_guard, block_split, geographic_split, kfold_split, evaluation_split, central_positives, training_positives,
        negative_exclusions, queries_without_positives, split_by_settings, same_camera_positives,
    )
}

# ------------------------------------------------------------------ SQL counterparts

_LOCATED = "northing IS NOT NULL AND easting IS NOT NULL AND NOT isnan(northing) AND NOT isnan(easting) AND NOT (northing = 0 AND easting = 0)"
_STAMPS = """f AS (SELECT sequence, idx, max(CASE WHEN adapter = 'drive' THEN 1000 ELSE 1 END * coalesce(ts, TRY_CAST(split_part(stem, '_', -1) AS BIGINT))) AS ts FROM frames GROUP BY sequence, idx)"""
_POSITIONS = f"""{_STAMPS}, s AS (SELECT sequence, ts * 1000 AS ts, min({{'n': northing, 'e': easting}}) AS lo, max({{'n': northing, 'e': easting}}) AS hi FROM tracks WHERE {_LOCATED} GROUP BY ALL),
b AS (SELECT f.sequence, f.idx, s.ts, s.hi AS p FROM f ASOF JOIN s ON f.sequence = s.sequence AND f.ts > s.ts), a AS (SELECT f.sequence, f.idx, s.ts, s.lo AS p FROM f ASOF JOIN s ON f.sequence = s.sequence AND f.ts <= s.ts),
pos AS (SELECT f.sequence, f.idx, f.ts, CASE WHEN a.ts = f.ts THEN a.p.n WHEN a.ts IS NOT NULL AND b.ts IS NOT NULL THEN b.p.n + (f.ts - b.ts) / (a.ts - b.ts) * (a.p.n - b.p.n) END AS northing,
  CASE WHEN a.ts = f.ts THEN a.p.e WHEN a.ts IS NOT NULL AND b.ts IS NOT NULL THEN b.p.e + (f.ts - b.ts) / (a.ts - b.ts) * (a.p.e - b.p.e) END AS easting
  FROM f LEFT JOIN b USING (sequence, idx) LEFT JOIN a USING (sequence, idx))"""
_TRUTH = f"""{_POSITIONS}, side AS (SELECT DISTINCT sequence, side FROM tracks),
num AS (SELECT sequence, idx, side, easting AS x, northing AS y, row_number() OVER (PARTITION BY side ORDER BY sequence, idx) - 1 AS id FROM pos JOIN side USING (sequence) WHERE northing IS NOT NULL),
q AS (SELECT * FROM num WHERE side = 'query'), d AS (SELECT * FROM num WHERE side = 'database'), total AS (SELECT count(*) AS n FROM q),
near AS (SELECT q.id AS q, d.id AS d, sqrt((q.x - d.x) ** 2 + (q.y - d.y) ** 2) AS distance FROM q JOIN d ON d.x BETWEEN q.x - 60 AND q.x + 60 AND d.y BETWEEN q.y - 60 AND q.y + 60),
pos25 AS (SELECT q, d FROM near WHERE distance <= 25), known AS (SELECT DISTINCT q FROM pos25)"""
_TEMPORAL = """cut AS (SELECT CAST(trunc(n * (1 - 0.2::DOUBLE)) AS BIGINT) AS c FROM total),
rest AS (SELECT q, row_number() OVER (ORDER BY q) - 1 AS k, count(*) OVER () AS m FROM known, cut WHERE q < c),
tp AS (SELECT q, CASE WHEN k >= m - least(m, greatest(1, trunc(m * 0.1::DOUBLE))) THEN 'validation' ELSE 'train' END AS part FROM rest UNION ALL SELECT q, 'test' FROM known, cut WHERE q >= c)"""
_EVENTS = """e AS (SELECT event_id, user_id, epoch_us(ts) AS ts FROM events), r AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, ts FROM e WHERE user_id % 2 = 0),
qy AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, ts FROM e WHERE user_id % 2 = 1), rlo AS (SELECT ts, min(idx) AS lo, max(idx) AS hi FROM r GROUP BY ts), qlo AS (SELECT ts, min(idx) AS lo, max(idx) AS hi FROM qy GROUP BY ts),
loops AS (SELECT idx AS loop, ts AS query_ts, ts - 3600000000 AS start_ts, ts + 3600000000 AS end_ts FROM qy WHERE idx % 7 = 0),
probe AS (SELECT loop, 's' AS w, start_ts AS t FROM loops UNION ALL SELECT loop, 'e', end_ts FROM loops),
pb AS (SELECT loop, w, t - rlo.ts AS gap, hi AS idx FROM probe ASOF JOIN rlo ON probe.t > rlo.ts), pa AS (SELECT loop, w, rlo.ts - t AS gap, lo AS idx FROM probe ASOF JOIN rlo ON probe.t <= rlo.ts),
pn AS (SELECT loop, w, CASE WHEN pa.gap IS NULL OR pb.gap IS NULL AND pa.gap > 0 THEN NULL WHEN pb.gap IS NOT NULL AND pb.gap <= pa.gap THEN pb.idx ELSE pa.idx END AS idx FROM probe LEFT JOIN pb USING (loop, w) LEFT JOIN pa USING (loop, w)),
m AS (SELECT loop, query_ts, qlo.lo AS query_index, max(CASE WHEN w = 's' THEN pn.idx END) AS start_index, max(CASE WHEN w = 'e' THEN pn.idx END) AS end_index FROM loops JOIN qlo ON qlo.ts = query_ts JOIN pn USING (loop) GROUP BY ALL)"""
_FOLDS = """fo AS (SELECT DISTINCT fold, CASE WHEN idx // 10 % 3 = fold THEN 'test' WHEN idx // 10 % 3 = (fold + 1) % 3 THEN 'validation' ELSE 'train' END AS part, stem FROM frames, (VALUES (0), (1), (2)) v(fold) WHERE adapter = 'drive')"""

SQL = {
    "frame_catalog": "SELECT sequence, stem, row_number() OVER (PARTITION BY sequence ORDER BY stem) - 1 AS frame_index FROM (SELECT DISTINCT sequence, stem FROM frames WHERE stem IS NOT NULL)",
    "catalog_defects": f"WITH {_STAMPS}, w AS (SELECT *, lag(ts) OVER (PARTITION BY sequence ORDER BY idx) AS before, lag(idx) OVER (PARTITION BY sequence ORDER BY idx) AS last FROM f) SELECT sequence, count(*) AS frames, CAST(count_if(coalesce(idx <> last + 1, idx <> 0)) AS BIGINT) AS gaps, CAST(count_if(coalesce(ts < before, false)) AS BIGINT) AS backwards FROM w GROUP BY sequence",
    "camera_union": "WITH r AS (SELECT DISTINCT adapter, stem, CASE adapter WHEN 'walk' THEN 0 WHEN 'drive' THEN 1 ELSE 2 END AS k FROM frames WHERE adapter IS NOT NULL) SELECT 'all' AS traversal, CASE WHEN k = 0 THEN stem ELSE adapter || '-' || stem END AS stem, row_number() OVER (ORDER BY k, stem) - 1 AS frame_index FROM r",
    "frame_names": """SELECT DISTINCT stem, CASE WHEN adapter = 'walk' THEN stem ELSE adapter || '-' || stem END AS camera_stem, adapter AS camera, CASE WHEN regexp_full_match(stem, '[0-9]{6}_[0-9]{19}') THEN CAST(split_part(stem, '_', 1) AS BIGINT) END AS idx,
  CASE WHEN regexp_full_match(stem, '[0-9]{6}_[0-9]{19}') THEN CAST(CAST(split_part(stem, '_', 2) AS BIGINT) AS VARCHAR) END AS ts FROM frames""",
    "track_log": f"SELECT sequence, count(*) AS samples, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT DISTINCT ON (sample_id) * FROM tracks WHERE {_LOCATED}) GROUP BY sequence",
    "timestamp_ns_parse": "SELECT event_id, epoch_us(ts) * 1000 AS ns FROM events",
    "asof_nearest_sample": f"""WITH {_STAMPS}, s AS (SELECT DISTINCT sequence, ts * 1000 AS ts FROM tracks WHERE {_LOCATED}),
b AS (SELECT f.sequence, f.idx, s.ts, f.ts - s.ts AS gap FROM f ASOF JOIN s ON f.sequence = s.sequence AND f.ts > s.ts), a AS (SELECT f.sequence, f.idx, s.ts, s.ts - f.ts AS gap FROM f ASOF JOIN s ON f.sequence = s.sequence AND f.ts <= s.ts),
n AS (SELECT f.sequence, f.idx, CASE WHEN b.gap IS NOT NULL AND (a.gap IS NULL OR b.gap <= a.gap) THEN b.ts ELSE a.ts END AS sample_ts, CASE WHEN b.gap IS NOT NULL AND (a.gap IS NULL OR b.gap <= a.gap) THEN b.gap ELSE a.gap END AS delta, coalesce(b.gap IS NULL AND a.gap > 0, false) OR (a.gap IS NULL AND b.gap IS NOT NULL) AS clamped
  FROM f LEFT JOIN b USING (sequence, idx) LEFT JOIN a USING (sequence, idx))
SELECT sequence, idx, CASE WHEN delta <= 1000000000 THEN CAST(sample_ts AS VARCHAR) END AS sample_ts, delta, clamped AND delta IS NOT NULL AS clamped FROM n""",
    "frame_positions": f"WITH {_POSITIONS} SELECT sequence, idx, round(northing, 4) AS northing, round(easting, 4) AS easting FROM pos",
    "frames_without_position": f"WITH {_POSITIONS} SELECT sequence, count(*) AS frames, CAST(count_if(northing IS NULL) AS BIGINT) AS unplaced FROM pos GROUP BY sequence",
    "radius_positives_2d": f"WITH {_TRUTH} SELECT q.sequence AS query_sequence, q.idx AS query_idx, d.sequence AS database_sequence, d.idx AS database_idx FROM pos25 p JOIN q ON q.id = p.q JOIN d ON d.id = p.d",
    "radius_positives_3d": """WITH e AS (SELECT event_id AS id, event_type, user_id * 10.0::DOUBLE AS x, value AS y, CAST(event_id % 100 AS DOUBLE) AS z FROM events)
SELECT a.id AS q, b.id AS d, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) AS distance FROM e a JOIN e b ON b.x BETWEEN a.x - 12.5 AND a.x + 12.5 AND b.y BETWEEN a.y - 12.5 AND a.y + 12.5
WHERE a.event_type = 'purchase' AND b.event_type = 'signup' AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 12.5::DOUBLE ** 2""",
    "revisits": f"""WITH o AS (SELECT sequence, row_number() OVER (PARTITION BY sequence ORDER BY ts) - 1 AS id, p.e AS x, p.n AS y FROM (SELECT sequence, ts, min({{'e': easting, 'n': northing}}) AS p FROM tracks WHERE {_LOCATED} GROUP BY sequence, ts)),
h AS (SELECT DISTINCT a.sequence, a.id FROM o a JOIN o b ON a.sequence = b.sequence AND b.x BETWEEN a.x - 2 AND a.x + 2 AND b.y BETWEEN a.y - 2 AND a.y + 2 WHERE b.id >= a.id + 200 AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 4),
n AS (SELECT sequence, count(*) AS frames FROM o GROUP BY sequence), k AS (SELECT sequence, count(*) AS hits FROM h GROUP BY sequence)
SELECT sequence, frames, round(CASE WHEN frames > 200 THEN coalesce(hits, 0) / frames ELSE 0 END, 6) AS revisits FROM n LEFT JOIN k USING (sequence)""",
    "correspondence_map": f"WITH {_EVENTS} SELECT loop, query_index, start_index, end_index FROM m",
    "interval_positives": f"WITH {_EVENTS} SELECT DISTINCT query_index AS q, unnest(generate_series(least(start_index, end_index), greatest(start_index, end_index))) AS d FROM m WHERE start_index IS NOT NULL AND end_index IS NOT NULL",
    "interval_positives_inherited": f"""WITH {_EVENTS}, ks AS (SELECT DISTINCT query_ts AS t FROM m UNION SELECT ts FROM qy WHERE idx % 7 = 3),
kb AS (SELECT qy.idx, ks.t, qy.ts - ks.t AS gap FROM qy ASOF JOIN ks ON qy.ts > ks.t), ka AS (SELECT qy.idx, ks.t, ks.t - qy.ts AS gap FROM qy ASOF JOIN ks ON qy.ts <= ks.t),
kn AS (SELECT qy.idx, CASE WHEN kb.gap IS NOT NULL AND (ka.gap IS NULL OR kb.gap <= ka.gap) THEN kb.t ELSE ka.t END AS t FROM qy LEFT JOIN kb USING (idx) LEFT JOIN ka USING (idx)),
x AS (SELECT DISTINCT kn.idx AS q, unnest(generate_series(least(start_index, end_index), greatest(start_index, end_index))) AS d FROM kn JOIN m ON m.query_ts = kn.t WHERE start_index IS NOT NULL AND end_index IS NOT NULL)
SELECT q, count(*) AS n, min(d) AS first_d, max(d) AS last_d FROM x GROUP BY q""",
    "fold_extension": f"""WITH {_FOLDS}, o AS (SELECT DISTINCT stem, TRY_CAST(stem AS BIGINT) // 1000 AS t FROM frames WHERE adapter = 'ride'), k AS (SELECT fold, CAST(stem AS BIGINT) AS t, min(part) AS lo, max(part) AS hi FROM fo GROUP BY 1, 2), p AS (SELECT v.fold, o.stem, o.t FROM o, (VALUES (0), (1), (2)) v(fold)),
b AS (SELECT p.fold, p.stem, p.t - k.t AS gap, hi AS part FROM p ASOF JOIN k ON p.fold = k.fold AND p.t > k.t), a AS (SELECT p.fold, p.stem, k.t - p.t AS gap, lo AS part FROM p ASOF JOIN k ON p.fold = k.fold AND p.t <= k.t),
n AS (SELECT p.fold, p.stem, CASE WHEN b.gap IS NOT NULL AND (a.gap IS NULL OR b.gap <= a.gap) THEN b.part ELSE a.part END AS part, least(b.gap, a.gap) AS gap FROM p LEFT JOIN b USING (fold, stem) LEFT JOIN a USING (fold, stem))
SELECT fold, part, stem FROM fo UNION ALL SELECT fold, part, stem FROM n WHERE gap <= 300000000""",
    "fold_split": f"WITH {_FOLDS}, n AS (SELECT stem, row_number() OVER (ORDER BY stem, sequence) - 1 AS q FROM (SELECT DISTINCT sequence, stem FROM frames WHERE adapter = 'drive')) SELECT q, part FROM n JOIN fo USING (stem) WHERE fold = 1 AND q % 3 <> 1",
    "temporal_split": f"WITH {_TRUTH}, {_TEMPORAL} SELECT q, part FROM tp",
    "ground_truth_guard": f"""WITH {_TRUTH}, {_TEMPORAL}, bv AS (SELECT DISTINCT q FROM pos25 JOIN tp USING (q) WHERE part = 'validation' AND d IN (SELECT d FROM pos25 JOIN tp USING (q) WHERE part = 'train')),
bt AS (SELECT DISTINCT q FROM pos25 JOIN tp USING (q) WHERE part = 'test' AND d IN (SELECT d FROM pos25 JOIN tp USING (q) WHERE part = 'train' OR part = 'validation' AND q NOT IN (SELECT q FROM bv)))
SELECT q, part, q IN (SELECT q FROM bv UNION SELECT q FROM bt) AS excluded FROM tp""",
    "block_split": f"""WITH {_TRUTH}, {_TEMPORAL}, w AS (SELECT q, k, m, CAST(greatest(1, trunc(m * 0.2::DOUBLE / 2)) AS BIGINT) AS width FROM rest),
bs AS (SELECT q, k, width, least(greatest(0, CAST(trunc(m * 0.3::DOUBLE) AS BIGINT) - width // 2), m - width) AS a, least(greatest(0, CAST(trunc(m * 0.7::DOUBLE) AS BIGINT) - width // 2), m - width) AS b FROM w),
bp AS (SELECT q, CASE WHEN k >= a AND k < a + width OR k >= b AND k < b + width THEN 'validation' ELSE 'train' END AS part FROM bs UNION ALL SELECT q, 'test' FROM known, cut WHERE q >= c),
bv AS (SELECT DISTINCT q FROM pos25 JOIN bp USING (q) WHERE part = 'validation' AND d IN (SELECT d FROM pos25 JOIN bp USING (q) WHERE part = 'test')),
bt AS (SELECT DISTINCT q FROM pos25 JOIN bp USING (q) WHERE part = 'train' AND d IN (SELECT d FROM pos25 JOIN bp USING (q) WHERE part = 'test' OR part = 'validation' AND q NOT IN (SELECT q FROM bv)))
SELECT q, part, q IN (SELECT q FROM bv UNION SELECT q FROM bt) AS excluded FROM bp""",
    "geographic_split": f"""WITH {_TRUTH}, g AS (SELECT q.id AS q, x, y, CASE WHEN id >= trunc(n * (1 - 0.2::DOUBLE)) THEN 'test' WHEN id >= trunc(n * (1 - 0.2::DOUBLE - 0.1::DOUBLE)) THEN 'validation' ELSE 'train' END AS part FROM q, total),
bv AS (SELECT DISTINCT a.q FROM g a JOIN g b ON b.x BETWEEN a.x - 25 AND a.x + 25 AND b.y BETWEEN a.y - 25 AND a.y + 25 WHERE a.part = 'validation' AND b.part = 'train' AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 25),
bt AS (SELECT DISTINCT a.q FROM g a JOIN g b ON b.x BETWEEN a.x - 25 AND a.x + 25 AND b.y BETWEEN a.y - 25 AND a.y + 25 WHERE a.part = 'test' AND (b.part = 'train' OR b.part = 'validation' AND b.q NOT IN (SELECT q FROM bv)) AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 25)
SELECT q, part, q IN (SELECT q FROM bv UNION SELECT q FROM bt) AS excluded FROM g WHERE q IN (SELECT q FROM known)""",
    "kfold_split": f"""WITH {_TRUTH}, z AS (SELECT n, CAST(round_even(n * 2 / 5, 0) AS BIGINT) AS b2, CAST(round_even(n * 3 / 5, 0) AS BIGINT) AS b3, CAST(round_even(n * 4 / 5, 0) AS BIGINT) AS b4 FROM total)
SELECT q, CASE WHEN q >= b2 AND q < b3 THEN 'test' WHEN q >= b3 AND q < b4 THEN 'validation' ELSE 'train' END AS part FROM known, z""",
    "evaluation_split": f"WITH {_TRUTH} SELECT q, 'test' AS part FROM known",
    "central_positives": f"""WITH {_TRUTH}, k AS (SELECT q, d, row_number() OVER (PARTITION BY q ORDER BY d) - 1 AS k, count(*) OVER (PARTITION BY q) AS n FROM pos25), c AS (SELECT *, greatest(1, CAST(round_even(n * 0.5::DOUBLE, 0) AS BIGINT)) AS c FROM k)
SELECT q, d FROM c WHERE k >= (n - c) // 2 AND k < (n - c) // 2 + c""",
    "training_positives": f"WITH {_TRUTH} SELECT q, d FROM near WHERE distance <= 10",
    "negative_exclusions": f"WITH {_TRUTH} SELECT q, d FROM near WHERE distance <= 60 AND distance > 25",
    "queries_without_positives": f"WITH {_TRUTH} SELECT sequence, count(*) AS queries FROM q WHERE id NOT IN (SELECT q FROM known) GROUP BY sequence",
}
SQL["split_by_settings"] = SQL["block_split"]
SQL["same_camera_positives"] = f"WITH {_TRUTH}, c AS (SELECT sequence, min(adapter) AS g FROM frames WHERE adapter IS NOT NULL GROUP BY sequence) SELECT p.q, p.d FROM pos25 p JOIN q ON q.id = p.q JOIN d ON d.id = p.d LEFT JOIN c a ON a.sequence = q.sequence LEFT JOIN c b ON b.sequence = d.sequence WHERE a.g IS NOT DISTINCT FROM b.g"

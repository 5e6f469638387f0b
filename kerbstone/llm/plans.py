"""Queries of the operators for language-model data: p3, p4 and p6 to p10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbstone.llm import leakage
from kerbstone.llm.encodings import find_garbled
from kerbstone.llm.lookalikes import detections, misread_signs, with_form
from kerbstone.llm.mixing import Mix, mix
from kerbstone.llm.nearest_time import frames_to_samples
from kerbstone.llm.splits import assign_parts, related
from kerbstone.llm.tokens import encode_corpus
from kerbstone.runtime import materialise, table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = leakage.overlaps(table(spark, sf_dir, "split_records")).pairs()
    return got.select(F.least("train_id", "eval_id").alias("record_a"), F.greatest("train_id", "eval_id").alias("record_b"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.overlaps(table(spark, sf_dir, "split_records")).report()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return related(table(spark, sf_dir, "split_records").select("record_id", "drive_id", "place_id", "source"))


def p4_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_parts(table(spark, sf_dir, "split_records").select("record_id", "drive_id", "place_id", "source"))


def p4_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each part, and how many of its groups are in another part as well."""
    assigned = materialise(p4_parts(spark, sf_dir), "assigned")
    groups = assigned.groupBy("group_id", "part").agg(F.count("*").alias("n"))
    torn = groups.groupBy("group_id").agg(F.count("*").alias("parts")).where("parts > 1").withColumn("torn", F.lit(1))
    return groups.join(torn, "group_id", "left").groupBy("part").agg(F.sum("n").alias("records"), F.count("torn").alias("torn_groups"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return misread_signs(table(spark, sf_dir, "frame_texts").select("ann_id", "detections"), table(spark, sf_dir, "sign_lexicon"))


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every detected text."""
    return with_form(detections(table(spark, sf_dir, "frame_texts").select("ann_id", "detections")), "text").distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "frames").select("sequence", "idx", "ts", "stem", "adapter")
    tracks = table(spark, sf_dir, "tracks").select("sample_id", "sequence", "ts", "northing", "easting")
    return frames_to_samples(frames, tracks)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _mix(spark: SparkSession, sf_dir: str) -> Mix:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "mix_targets"))


def p9_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents with how many times each appears."""
    return _mix(spark, sf_dir).chosen


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share per source."""
    return _mix(spark, sf_dir).shares.select("source", F.round("target_share", 9).alias("target_share"), F.round("actual_share", 9).alias("actual_share"), F.round("share_of_total", 9).alias("share_of_total"), "tokens", "documents", "most_repeats")


def _garbled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_garbled(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _garbled(spark, sf_dir).select("doc_id").distinct()


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled documents with the original text where it can be had."""
    return _garbled(spark, sf_dir)


QUERIES = {f.__name__: f for f in (p3_found, p3_report, p4_found, p4_parts, p4_quotas, p6_found, p6_forms, p7_found, p8_ids, p9_chosen, p9_shares, p10_found, p10_restored)}

_OVERLAPS = r"""
WITH r AS (SELECT DISTINCT ON (record_id) record_id, lower(trim(split_part)) AS part, source, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w,
    list_filter(string_split(replace(lower(file_path), '\', '/'), '/'), lambda s: s <> '') AS seg FROM split_records WHERE record_id IS NOT NULL AND split_part IS NOT NULL),
k AS (SELECT *, CASE WHEN len(seg) >= 2 THEN seg[-2] || '/' || regexp_replace(seg[-1], '^(.+)\.[^.]*$', '\1') END AS frame FROM r),
c AS (SELECT t.record_id AS train_id, e.record_id AS eval_id, e.part AS split_part, e.source, coalesce(t.frame = e.frame, false) AS same_frame, t.w AS a, e.w AS b,
    len(t.w) >= 8 AND len(e.w) >= 8 AND abs(len(t.w) - len(e.w)) * 10 <= greatest(len(t.w), len(e.w)) AS near FROM k t JOIN k e ON t.part = 'train' AND e.part IN ('validation', 'test')),
d AS (SELECT *, CASE WHEN near THEN list_distinct(list_concat(a, b)) END AS names FROM c WHERE near OR same_frame),
o AS (SELECT *, CASE WHEN near THEN levenshtein(array_to_string(list_transform(a, lambda x: chr(CAST(list_position(names, x) AS INT))), ''), array_to_string(list_transform(b, lambda x: chr(CAST(list_position(names, x) AS INT))), '')) * 10 <= greatest(len(a), len(b)) ELSE false END AS alike FROM d)
"""

SQL = {
    "p3_found": _OVERLAPS + "SELECT least(train_id, eval_id) AS record_a, greatest(train_id, eval_id) AS record_b FROM o WHERE same_frame OR alike",
    "p3_report": _OVERLAPS + """SELECT split_part, source, count(*) AS pairs, count(DISTINCT eval_id) AS records, CAST(count_if(same_frame) AS BIGINT) AS same_frame, CAST(count_if(alike) AS BIGINT) AS similar_content
FROM o WHERE same_frame OR alike GROUP BY split_part, source""",
    "p4_found": """
WITH RECURSIVE r AS (
  SELECT record_id, max(CASE WHEN lower(trim(drive_id)) NOT IN ('', 'unknown', 'n/a', '-') THEN lower(trim(drive_id)) END) AS d,
    max(CASE WHEN lower(trim(place_id)) NOT IN ('', 'unknown', 'n/a', '-') THEN lower(trim(place_id)) END) AS p
  FROM split_records WHERE record_id IS NOT NULL GROUP BY record_id),
k AS (SELECT record_id, min(record_id) OVER (PARTITION BY d) AS d, min(record_id) OVER (PARTITION BY p) AS p, d IS NOT NULL AS has_d, p IS NOT NULL AS has_p FROM r),
e AS (SELECT DISTINCT d AS u, p AS v FROM k WHERE has_d AND has_p UNION SELECT DISTINCT p, d FROM k WHERE has_d AND has_p),
c(node, low) AS (SELECT u, u FROM e UNION SELECT e.v, c.low FROM c JOIN e ON e.u = c.node WHERE c.low < e.v),
roots AS (SELECT node, min(low) AS root FROM c GROUP BY node),
g AS (SELECT record_id, coalesce(root, CASE WHEN has_d THEN d WHEN has_p THEN p ELSE record_id END) AS group_id
  FROM k LEFT JOIN roots ON node = CASE WHEN has_d THEN d WHEN has_p THEN p END)
SELECT record_id, group_id FROM g QUALIFY count(*) OVER (PARTITION BY group_id) > 1""",
    "p4_quotas": """
WITH n AS (SELECT count(DISTINCT record_id) AS n FROM split_records), q AS (SELECT part, share * n AS quota, n FROM n, (VALUES ('train', 0.7::DOUBLE), ('validation', 0.1), ('test', 0.2)) v(part, share)),
f AS (SELECT *, floor(quota + 1e-9) AS whole, row_number() OVER (ORDER BY floor(quota + 1e-9) - quota) AS k FROM q)
SELECT part, CAST(whole AS BIGINT) + CASE WHEN k <= max(n) OVER () - sum(whole) OVER () THEN 1 ELSE 0 END AS records, 0 AS torn_groups FROM f""",
    "p7_found": """
WITH f AS (
  SELECT sequence, idx, max(CASE WHEN adapter = 'drive' THEN 1000 ELSE 1 END * coalesce(ts, TRY_CAST(split_part(stem, '_', -1) AS BIGINT))) AS ts
  FROM frames WHERE sequence IS NOT NULL AND idx IS NOT NULL GROUP BY sequence, idx),
s AS (
  SELECT sequence, ts * 1000 AS ts, min(sample_id) AS sample_id FROM tracks
  WHERE northing IS NOT NULL AND easting IS NOT NULL AND NOT isnan(northing) AND NOT isnan(easting) AND NOT (northing = 0 AND easting = 0)
  GROUP BY ALL),
b AS (SELECT f.sequence, f.idx, f.ts - s.ts AS gap, 0 AS later, s.sample_id FROM f ASOF JOIN s ON f.sequence = s.sequence AND f.ts >= s.ts),
a AS (SELECT f.sequence, f.idx, s.ts - f.ts AS gap, 1 AS later, s.sample_id FROM f ASOF JOIN s ON f.sequence = s.sequence AND f.ts <= s.ts),
n AS (SELECT *, row_number() OVER (PARTITION BY sequence, idx ORDER BY gap, later) AS k FROM (SELECT * FROM b UNION ALL SELECT * FROM a) WHERE gap <= 50000000)
SELECT sequence, idx, sample_id FROM n WHERE k = 1""",
}

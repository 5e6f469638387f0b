"""Queries of the general training-data operators: p1 (small files), p2 (near points), p5 (nested records)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbstone.operators.compaction import compact
from kerbstone.operators.nested import annotation_children, distinct_records, shred, tables
from kerbstone.operators.spatial import containing_regions, located, near_samples
from kerbstone.runtime import materialise, scratch_path, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surplus copies, as the committed manifest of the compaction has them: ids that no bin holds, by the keeper that one does."""
    done = compact(spark, table(spark, sf_dir, "annotation_files"), scratch_path(spark, "compacted"))
    return done.manifest(spark).where("bin IS NULL AND keeper < file_id").select(F.col("keeper").alias("file_a"), F.col("file_id").alias("file_b"))


def p1_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and bytes of each rewritten file."""
    done = compact(spark, table(spark, sf_dir, "annotation_files"), scratch_path(spark, "compacted"))
    written = done.manifest(spark).where("bin IS NOT NULL")
    return written.groupBy("bin").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.count("defect").alias("unreadable"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_samples(table(spark, sf_dir, "tracks").select("sample_id", "side", "northing", "easting"))


def p2_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many located samples lie within a kilometre square around where each recording starts."""
    samples = located(table(spark, sf_dir, "tracks").select("sample_id", "sequence", "ts", "northing", "easting"))
    numbered = samples.groupBy("sequence").agg(F.min(F.struct("ts", "sample_id", "easting", "northing")).alias("s")).withColumn("region_id", F.col("s.sample_id"))
    corner = lambda i, j: F.array(F.col("s.easting") + i * 500.0, F.col("s.northing") + j * 500.0)
    regions = materialise(numbered.select("sequence", "region_id", F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)).alias("ring")), "regions")
    points = samples.select(F.col("sample_id").alias("id"), F.col("easting").alias("x"), F.col("northing").alias("y"))
    inside = containing_regions(points, regions).groupBy("region_id").agg(F.count("*").alias("samples"))
    return regions.select("sequence", "region_id").join(inside, "region_id").select("sequence", "samples")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotation_children(table(spark, sf_dir, "annotation_files").select("file_id", "content"))


def p5_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scalar of every annotation with its label and parent label, from the tables by schema path."""
    files = distinct_records(table(spark, sf_dir, "annotation_files"), "file_id", "content")
    values = tables(shred(files, "file_id", "content")).all().where("kind NOT IN ('object', 'array')")
    return values.select(F.col("record_id").alias("file_id"), "dewey", "parent", "schema_path", "kind", F.when(F.col("kind") != "number", F.col("value")).alias("value"), "number")


QUERIES = {f.__name__: f for f in (p1_found, p1_bins, p2_found, p2_regions, p5_found, p5_attributes)}

_NUMBERS = "CASE WHEN json_type({0}) = 'ARRAY' AND json_array_length({0}) = 4 THEN len(list_filter([json_type({0}, '$[' || i || ']') FOR i IN range(4)], lambda x: x IN ('DOUBLE', 'BIGINT', 'UBIGINT'))) = 4 ELSE false END"
_TYPED = "CASE WHEN json_type({0}, '$.{1}') IN ('VARCHAR', 'BOOLEAN') THEN json_type({0}, '$.{1}') || ':' || ({0}->>'$.{1}') WHEN json_type({0}, '$.{1}') IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN 'n:' || CAST({0}->>'$.{1}' AS DOUBLE) END"
_ARRAY = "json_each(CASE WHEN json_type(doc, '$.{0}') = 'ARRAY' THEN doc->'$.{0}' ELSE '[]'::JSON END)"

_COPIES = """
WITH f AS (SELECT DISTINCT ON (file_id) file_id, content, list_filter(string_split(lower(replace(file_path, '\\', '/')), '/'), lambda s: s NOT IN ('', '.')) AS seg FROM annotation_files WHERE json_valid(content)),
t AS (SELECT file_id, any_value(seg[-4:]) AS key,
  string_agg(e.fullkey || chr(1) || CASE WHEN e.type IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN 'n' || CAST(e.value->>'$' AS DOUBLE) WHEN e.type = 'VARCHAR' THEN 's' || (e.value->>'$') WHEN e.type IN ('OBJECT', 'ARRAY') THEN e.type ELSE coalesce(CAST(e.value AS VARCHAR), 'null') END, chr(2) ORDER BY e.fullkey) AS value
  FROM f, json_tree(CAST(f.content AS JSON)) e WHERE len(seg) >= 4 GROUP BY file_id),
g AS (SELECT *, min(file_id) OVER (PARTITION BY key, value) AS file_a FROM t)
"""

SQL = {
    "p1_found": _COPIES + "SELECT file_a, file_id AS file_b FROM g WHERE file_a < file_id",
    # one bin each, as the tables of the tests are smaller than a bin
    "p1_bins": _COPIES + """SELECT CASE WHEN coalesce(json_valid(content), false) THEN 'data-000000-000000' ELSE 'apart-000000-000000' END AS bin, count(*) AS files, CAST(sum(coalesce(strlen(content), 0)) AS BIGINT) AS bytes,
  CAST(count_if(NOT coalesce(json_valid(content), false)) AS BIGINT) AS unreadable
FROM (SELECT DISTINCT ON (file_id) file_id, content FROM annotation_files WHERE file_id IS NOT NULL) WHERE file_id NOT IN (SELECT file_id FROM g WHERE file_a < file_id) GROUP BY 1""",
    "p5_found": f"""
WITH j AS (SELECT DISTINCT ON (file_id) file_id, CAST(content AS JSON) AS doc FROM annotation_files WHERE json_valid(content)),
n0 AS (SELECT file_id, CAST(e.key AS INT) AS pos, e.value AS n, CASE WHEN coalesce(json_type(e.value, '$.data'), 'NULL') <> 'NULL' THEN e.value->'$.data' ELSE e.value END AS d FROM j, {_ARRAY.format('nodes')} e WHERE e.type = 'OBJECT'),
n AS (SELECT file_id, pos, {_TYPED.format('n', 'id')} AS id, CASE WHEN coalesce(json_type(d, '$.bbox_2d'), 'NULL') <> 'NULL' THEN d->'$.bbox_2d'->'$.xyxy' ELSE d->'$.bbox' END AS box FROM n0),
l AS (SELECT file_id, CAST(e.key AS INT) AS pos, e.value AS e FROM j, {_ARRAY.format('links')} e WHERE e.type = 'OBJECT'
  UNION ALL SELECT file_id, CAST(e.key AS INT), e.value FROM j, {_ARRAY.format('edges')} e WHERE e.type = 'OBJECT' AND coalesce(json_type(doc, '$.links'), 'NULL') = 'NULL'),
ids AS (SELECT file_id, id, max(pos) AS pos FROM n WHERE id IS NOT NULL GROUP BY ALL),
k AS (SELECT file_id, pos, {_TYPED.format('e', 'source')} AS source, {_TYPED.format('e', 'target')} AS target FROM l),
t AS (SELECT file_id, CAST(e.key AS INT) AS pos, e.value->'$.box' AS box FROM j, {_ARRAY.format('detections')} e WHERE e.type = 'OBJECT')
SELECT file_id, 'node' AS child, pos, -1 AS source_pos, -1 AS target_pos FROM n
UNION ALL SELECT file_id, 'node_box', pos, -1, -1 FROM n WHERE {_NUMBERS.format('box')}
UNION ALL SELECT file_id, 'detection', pos, -1, -1 FROM t
UNION ALL SELECT file_id, 'detection_box', pos, -1, -1 FROM t WHERE {_NUMBERS.format('box')}
UNION ALL SELECT k.file_id, 'link', k.pos, coalesce(a.pos, -1), coalesce(b.pos, -1) FROM k LEFT JOIN ids a ON a.file_id = k.file_id AND a.id = k.source LEFT JOIN ids b ON b.file_id = k.file_id AND b.id = k.target""",
    "p5_attributes": """
WITH RECURSIVE f AS (SELECT DISTINCT ON (file_id) file_id, CAST(content AS JSON) AS doc FROM annotation_files WHERE json_valid(content) ORDER BY file_id, content DESC),
t AS (SELECT file_id, e.id, e.parent, e.type, e.fullkey, e.atom FROM f, json_tree(doc) e),
o AS (SELECT *, row_number() OVER (PARTITION BY file_id, parent ORDER BY id) - 1 AS ordinal FROM t),
d AS (SELECT file_id, id, type, fullkey, atom, '' AS dewey, '' AS above FROM o WHERE parent IS NULL
  UNION ALL SELECT o.file_id, o.id, o.type, o.fullkey, o.atom, CASE WHEN d.dewey = '' THEN '' ELSE d.dewey || '.' END || o.ordinal, d.dewey FROM o JOIN d ON o.file_id = d.file_id AND o.parent = d.id)
SELECT file_id, dewey, above AS parent, regexp_replace(replace(fullkey, '"', ''), '\\[[0-9]+\\]', '[]', 'g') AS schema_path,
  CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind,
  CASE WHEN type IN ('VARCHAR', 'BOOLEAN') THEN atom->>'$' END AS value, CASE WHEN type IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN CAST(atom->>'$' AS DOUBLE) END AS number
FROM d WHERE type NOT IN ('OBJECT', 'ARRAY')""",
    "p2_regions": """
WITH l AS (SELECT DISTINCT ON (sample_id) sample_id, sequence, ts, easting AS x, northing AS y FROM tracks WHERE northing IS NOT NULL AND easting IS NOT NULL AND NOT isnan(northing) AND NOT isnan(easting) AND NOT (northing = 0 AND easting = 0)),
r AS (SELECT sequence, min({'ts': ts, 'id': sample_id, 'x': x, 'y': y}) AS s FROM l GROUP BY sequence)
SELECT r.sequence, count(*) AS samples FROM r JOIN l ON l.x BETWEEN r.s.x - 500 AND r.s.x + 500 AND l.y BETWEEN r.s.y - 500 AND r.s.y + 500 GROUP BY r.sequence""",
    "p2_found": """
WITH p AS (
  SELECT DISTINCT sample_id, side, northing, easting, CAST(floor(northing / 5) AS BIGINT) gx, CAST(floor(easting / 5) AS BIGINT) gy
  FROM tracks WHERE northing IS NOT NULL AND easting IS NOT NULL AND NOT isnan(northing) AND NOT isnan(easting) AND NOT (northing = 0 AND easting = 0)),
q AS (SELECT p.*, gx + i.i AS hx, gy + j.j AS hy FROM p, (VALUES (-1), (0), (1)) i(i), (VALUES (-1), (0), (1)) j(j) WHERE side = 'query')
SELECT least(q.sample_id, d.sample_id) AS sample_a, greatest(q.sample_id, d.sample_id) AS sample_b
FROM q JOIN p d ON d.side = 'database' AND d.gx = q.hx AND d.gy = q.hy
WHERE (q.northing - d.northing) ** 2 + (q.easting - d.easting) ** 2 <= 25.0""",
}

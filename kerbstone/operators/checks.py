"""Acceptance checks of an annotated corpus: coverage, moving objects, boxes, edges and frame binding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbstone.functions.geometry import is_valid_box
from kerbstone.operators import scene_graph as sg
from kerbstone.operators.compaction import path_key
from kerbstone.operators.text_filters import DETECTOR_DYNAMIC, DYNAMIC_CLASSES
from kerbstone.runtime import side_by_side

KINDS = ("missing_text", "missing_graph", "dynamic_nodes", "degenerate_boxes", "dangling_edges", "binding_errors")


def coverage(frames: DataFrame, files: DataFrame) -> DataFrame:
    """``sequence, idx, has_text, has_graph``: whether a stored file lies behind each path of a frame.

    A frame delivered again has the paths of any delivery. A null path, and one no file has, count as missing.
    """
    known = files.select(path_key(F.col("file_path")).alias("k")).where("k IS NOT NULL").distinct()
    each = frames.where("sequence IS NOT NULL AND idx IS NOT NULL").groupBy("sequence", "idx").agg(F.max("text_path").alias("t"), F.max("graph_path").alias("g"))
    each = each.withColumn("t", path_key(F.col("t"))).withColumn("g", path_key(F.col("g")))
    text = known.select(F.col("k").alias("t"), F.lit(True).alias("has_text"))
    graph = known.select(F.col("k").alias("g"), F.lit(True).alias("has_graph"))
    found = each.join(text, "t", "left").join(graph, "g", "left")
    return found.select("sequence", "idx", F.coalesce("has_text", F.lit(False)).alias("has_text"), F.coalesce("has_graph", F.lit(False)).alias("has_graph"))


def _stems(files: DataFrame) -> DataFrame:
    stem = F.regexp_replace(F.element_at(F.split(F.translate("file_path", "\\", "/"), "/"), -1), r"\.[^.]*$", "")
    return files.where("file_id IS NOT NULL").groupBy("file_id").agg(F.max("content").alias("content"), F.max(stem).alias("stem"))


def defects(frames: DataFrame, files: DataFrame, dynamic: tuple[str, ...] = (*DYNAMIC_CLASSES, *DETECTOR_DYNAMIC)) -> DataFrame:
    """``kind, place``: one row per defect of the frames and of every readable file."""
    graphs = sg.graph_files(files)
    nodes, edges = sg.raw_nodes(graphs), sg.raw_edges(graphs)
    seen = coverage(frames, files)
    frame = F.concat_ws("/", "sequence", F.col("idx").cast("string"))
    at = lambda kind, place: (F.lit(kind).alias("kind"), place.alias("place"))
    here = F.col("file_id").cast("string")
    ids = nodes.where("id IS NOT NULL").select("file_id", "id").distinct()
    end = lambda name, flag: ids.select("file_id", F.col("id").alias(name), F.lit(True).alias(flag))
    loose = edges.join(end("source", "_s"), ["file_id", "source"], "left").join(end("target", "_t"), ["file_id", "target"], "left").where("_s IS NULL OR _t IS NULL")
    stored = _stems(files).withColumn("doc", F.try_parse_json("content")).where("doc IS NOT NULL")
    recorded = F.coalesce(*[F.try_variant_get("doc", p, "string") for p in ("$.graph.scene_name", "$.frame_id")])
    texts = stored.where(F.try_variant_get("doc", "$.nodes", "array<variant>").isNull())
    boxes = texts.select("file_id", F.explode(F.try_variant_get("doc", "$.detections", "array<variant>")).alias("d")).select("file_id", sg._numbers(F.col("d"), "$.box").alias("box"))
    parts = [
        seen.where("NOT has_text").select(*at("missing_text", frame)),
        seen.where("NOT has_graph").select(*at("missing_graph", frame)),
        nodes.where(F.lower("class_name").isin(*{d.lower() for d in dynamic})).select(*at("dynamic_nodes", here)),
        nodes.where(~is_valid_box(F.col("box"))).select(*at("degenerate_boxes", here)),
        boxes.where(~is_valid_box(F.col("box"))).select(*at("degenerate_boxes", here)),
        loose.select(*at("dangling_edges", here)),
        stored.where(recorded.isNotNull() & (recorded != F.col("stem"))).select(*at("binding_errors", here)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def examples(found: DataFrame, most: int = 5) -> DataFrame:
    """``kind, n, places``: how often each defect occurs, and the first places of it."""
    once = found.groupBy("kind", "place").agg(F.count("*").alias("n"))
    first = once.withColumn("_k", F.row_number().over(Window.partitionBy("kind").orderBy("place"))).where(F.col("_k") <= most)
    few = first.groupBy("kind").agg(F.array_sort(F.collect_list("place")).alias("places"))
    return once.groupBy("kind").agg(F.sum("n").alias("n")).join(few, "kind")


def summary(frames: DataFrame, files: DataFrame) -> DataFrame:
    """One row: the defects by kind, frames, nodes and graphs without a node; accepted when there is no defect."""
    found = defects(frames, files).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
    graphs = sg.graph_files(files)
    per = graphs.select("file_id").join(sg.raw_nodes(graphs).groupBy("file_id").agg(F.count("*").alias("n")), "file_id", "left")
    nodes = per.agg(F.count("*").alias("graphs"), F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.count_if(F.col("n").isNull()).alias("empty_graphs"))
    count = frames.where("sequence IS NOT NULL AND idx IS NOT NULL").select("sequence", "idx").distinct().agg(F.count("*").alias("frames"))
    whole = side_by_side(found, nodes, count)
    none = F.lit(True)
    for k in KINDS:
        none = none & (F.col(k) == 0)
    share = lambda a, b: F.round(F.col(a) / F.greatest(F.lit(1), F.col(b)), 2)
    return whole.select(none.alias("accepted"), "frames", *KINDS, "nodes", share("nodes", "graphs").alias("nodes_per_graph"), F.round(100.0 * F.col("empty_graphs") / F.greatest(F.lit(1), F.col("graphs")), 2).alias("empty_graphs_percent"))


_KEY = "array_to_string(list_filter(string_split(lower(replace({0}, '\\', '/')), '/'), lambda s: s NOT IN ('', '.'))[-4:], '/')"
COVERAGE_SQL = f"""
WITH k AS (SELECT DISTINCT {_KEY.format("file_path")} AS k FROM annotation_files),
f AS (SELECT sequence, idx, max(text_path) AS t, max(graph_path) AS g FROM frames GROUP BY 1, 2),
c AS (SELECT sequence, idx, coalesce({_KEY.format("t")} IN (SELECT k FROM k), false) AS has_text, coalesce({_KEY.format("g")} IN (SELECT k FROM k), false) AS has_graph FROM f)
SELECT * FROM c WHERE NOT (has_text AND has_graph)"""
_DYNAMIC = ", ".join(f"'{c}'" for c in sorted({*DYNAMIC_CLASSES, *DETECTOR_DYNAMIC}))
SUMMARY_SQL = (
    f"WITH cov AS ({COVERAGE_SQL.replace('%', '%%')}), %(graph)s,"
    + f"""
ok AS (SELECT file_id, CAST(content AS JSON) AS doc, regexp_replace(split_part(replace(file_path, '\\', '/'), '/', -1), '\\.[^.]*$', '') AS stem FROM annotation_files WHERE json_valid(content)),
ids AS (SELECT DISTINCT file_id, id FROM rn WHERE id IS NOT NULL),
td AS (SELECT e.value AS d FROM ok, json_each(CASE WHEN json_type(doc, '$.detections') = 'ARRAY' THEN doc->'$.detections' ELSE '[]'::JSON END) e WHERE json_type(doc, '$.nodes') IS DISTINCT FROM 'ARRAY'),
tb AS (SELECT CASE WHEN json_type(d, '$.box') = 'ARRAY' AND len(list_filter([json_type(d, '$.box[' || i || ']') FOR i IN range(CAST(json_array_length(d, '$.box') AS BIGINT))], lambda x: x IN ('DOUBLE', 'BIGINT', 'UBIGINT'))) = json_array_length(d, '$.box') THEN CAST(d->'$.box' AS DOUBLE[]) END AS box FROM td),
bad AS (SELECT box FROM rn UNION ALL SELECT box FROM tb),
m AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT sequence, idx FROM frames)) AS frames,
  (SELECT count(*) FROM cov WHERE NOT has_text) AS missing_text, (SELECT count(*) FROM cov WHERE NOT has_graph) AS missing_graph,
  (SELECT count(*) FROM rn WHERE lower(class_name) IN ({_DYNAMIC})) AS dynamic_nodes,
  (SELECT count(*) FROM bad WHERE NOT coalesce(len(box) = 4 AND box[1] BETWEEN 0 AND 1 AND box[2] BETWEEN 0 AND 1 AND box[3] BETWEEN 0 AND 1 AND box[4] BETWEEN 0 AND 1 AND box[3] > box[1] AND box[4] > box[2], false)) AS degenerate_boxes,
  (SELECT count(*) FROM re LEFT JOIN ids a ON a.file_id = re.file_id AND a.id = re.source LEFT JOIN ids b ON b.file_id = re.file_id AND b.id = re.target WHERE a.id IS NULL OR b.id IS NULL) AS dangling_edges,
  (SELECT count(*) FROM ok WHERE coalesce(doc->>'$.graph.scene_name', doc->>'$.frame_id') <> stem) AS binding_errors,
  (SELECT count(*) FROM rn) AS nodes, (SELECT count(*) FROM j) AS graphs, (SELECT count(*) FROM j WHERE file_id NOT IN (SELECT file_id FROM rn)) AS empty_graphs)
SELECT missing_text + missing_graph + dynamic_nodes + degenerate_boxes + dangling_edges + binding_errors = 0 AS accepted, frames, missing_text, missing_graph, dynamic_nodes, degenerate_boxes, dangling_edges, binding_errors,
  nodes, round(nodes / greatest(1, graphs), 2) AS nodes_per_graph, round(100.0::DOUBLE * empty_graphs / greatest(1, graphs), 2) AS empty_graphs_percent FROM m"""
)
DEFECTS_SQL = f"WITH s AS ({SUMMARY_SQL}) SELECT kind, n FROM (UNPIVOT s ON {', '.join(KINDS)} INTO NAME kind VALUE n) WHERE n > 0"

"""Queries over detected strings and scene graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbstone.functions import geometry as g
from kerbstone.functions import text as t
from kerbstone.functions.geometry import Box
from kerbstone.functions.vectors import is_vector
from kerbstone.operators import checks, normalizer
from kerbstone.operators import scene_graph as sg
from kerbstone.operators import text_filters as tf
from kerbstone.runtime import materialise, table


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tf.detection_rows(table(spark, sf_dir, "frame_texts"))


def _graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graphs, parsed once however many branches of a query read them."""
    return materialise(sg.graph_files(table(spark, sf_dir, "annotation_files").select("file_id", "content")), "graphs")


def _scene(spark: SparkSession, sf_dir: str, graphs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    graphs = _graphs(spark, sf_dir) if graphs is None else graphs
    nodes = sg.scene_nodes(sg.raw_nodes(graphs), tf.DYNAMIC_CLASSES)
    return nodes, sg.scene_edges(sg.raw_edges(graphs), nodes)


def _frame_graph(spark: SparkSession, sf_dir: str, graphs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and strings by frame: of a frame's graph files the one with the largest id."""
    files = table(spark, sf_dir, "annotation_files")
    graphs = _graphs(spark, sf_dir) if graphs is None else graphs
    nodes, _ = _scene(spark, sf_dir, graphs)
    stem = F.regexp_replace(F.element_at(F.split(F.translate("file_path", "\\", "/"), "/"), -1), r"\.[^.]*$", "")
    latest = files.join(graphs.select("file_id"), "file_id").groupBy(stem.alias("frame")).agg(F.max("file_id").alias("file_id"))
    by_frame = nodes.join(latest, "file_id").select("frame", "file_id", "node", "class_name", "x1", "y1", "x2", "y2")
    rows = tf.annotation_filter(_detections(spark, sf_dir).where(g.is_valid_box(F.col("box"))))
    first = rows.groupBy("frame_id").agg(F.max("ann_id").alias("ann_id"))
    strings = rows.join(first, ["frame_id", "ann_id"]).select(F.col("frame_id").alias("frame"), "text", "det_pos", *Box.of(F.col("box")).columns())
    numbered = strings.withColumn("string", F.row_number().over(_by_frame()) - 1)
    return by_frame, numbered


def _by_frame():
    from pyspark.sql import Window

    return Window.partitionBy("frame").orderBy("det_pos")


def junk_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tf.drop_junk(_detections(spark, sf_dir)).select("ann_id", "det_pos", "text")


def dynamic_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tf.retained(_detections(spark, sf_dir), strict=False).select("ann_id", "det_pos", "dynamic_score")


def annotation_time_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tf.annotation_filter(_detections(spark, sf_dir)).select("ann_id", "det_pos", "text")


def text_switched_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The control without any string: one row per annotation with how many remain."""
    rows = _detections(spark, sf_dir)
    none = tf.retained(rows, use_text=False).groupBy("ann_id").agg(F.count("*").alias("kept"))
    return rows.groupBy("ann_id").agg(F.count("*").alias("strings")).join(none, "ann_id", "left").select("ann_id", "strings", F.coalesce("kept", F.lit(0)).alias("kept"))


def detection_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Box.of(F.col("box"))
    valid = g.is_valid_box(F.col("box"))
    return _detections(spark, sf_dir).select("ann_id", "det_pos", valid.alias("valid"), F.when(valid, F.round(b.area, 6)).alias("area"))


def pixel_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = table(spark, sf_dir, "frame_texts").groupBy("ann_id").agg(F.max("image_size").alias("s"))
    rows = _detections(spark, sf_dir).where(g.is_valid_box(F.col("box"))).join(size, "ann_id")
    p = g.pixel_bounds(Box.of(F.col("box")), F.get("s", F.lit(0)), F.get("s", F.lit(1)))
    return rows.select("ann_id", "det_pos", *p.columns("p"))


def frame_text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each annotation written as JSON and read back: strings and those with a score survive."""
    from kerbstone.sources.documents import frame_text_rows, frame_text_to_json

    documents = frame_text_to_json(table(spark, sf_dir, "frame_texts"))
    read = frame_text_rows(documents)
    return read.groupBy("ann_id").agg(F.count("*").alias("strings"), F.count("dynamic_score").alias("scored"), F.round(F.sum("confidence"), 6).alias("confidence"))


def recognizer_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections written as a fenced 0..1000 answer and parsed back to pixels."""
    rows = _detections(spark, sf_dir).where(g.is_valid_box(F.col("box")))
    item = F.struct(F.transform("box", lambda v: F.floor(v * 1000).cast("int")).alias("bbox"), F.translate("text", "[]", "()").alias("text"))
    answers = rows.where("text IS NOT NULL").groupBy(F.col("ann_id").alias("key")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("det_pos", item.alias("i")))), lambda x: x.getField("i"))).alias("a")).select("key", F.concat(F.lit("```json\n"), "a", F.lit("\n```")).alias("answer"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    got = tf.word_answers(answers)
    return got.groupBy("key").agg(F.count("text").alias("words"), F.round(F.sum("w"), 6).alias("width"), F.round(F.sum("h"), 6).alias("height"))


def pixel_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Box.of(F.col("box"))
    rows = _detections(spark, sf_dir).where("size(box) = 4").select(F.col("ann_id").alias("key"), F.col("det_pos").alias("pos"), F.array(b.x1 * 640, b.y1 * 480, b.width * 640, b.height * 480).alias("bbox"), F.lit(None).cast("array<array<double>>").alias("polygon"), "text", "confidence", F.lit(640).alias("width"), F.lit(480).alias("height"))
    got = tf.predictions_to_detections(rows)
    return got.select("key", "pos", "text", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2", "confidence")])


def dynamic_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = sg.raw_nodes(_graphs(spark, sf_dir)).groupBy("class_name").agg(F.count("*").alias("n"))
    return names.select("class_name", tf.canonical_class(F.col("class_name")).alias("canonical"), tf.is_dynamic(F.col("class_name")).alias("dynamic"), "n")


def scene_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Box.named()
    nodes, _ = _scene(spark, sf_dir)
    return nodes.select("file_id", "node", "pos", "class_name", F.round(b.cx, 6).alias("cx"), F.round(b.cy, 6).alias("cy"), F.round(b.width, 6).alias("w"), F.round(b.height, 6).alias("h"))


def scene_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scene(spark, sf_dir)[1]


def dropped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.dropped_edges(sg.raw_edges(_graphs(spark, sf_dir)), _scene(spark, sf_dir)[1])


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    graphs = _graphs(spark, sf_dir)
    return sg.vocabulary(sg.raw_nodes(graphs), sg.raw_edges(graphs), tf.DYNAMIC_CLASSES)


def _features(spark: SparkSession, sf_dir: str, graphs: DataFrame | None = None) -> DataFrame:
    nodes, edges = _scene(spark, sf_dir, graphs)
    end = lambda name, lead: nodes.select("file_id", F.col("node").alias(name), *[F.col(c).alias(lead + c) for c in ("x1", "y1", "x2", "y2")])
    return edges.join(end("src", "a_"), ["file_id", "src"]).join(end("dst", "b_"), ["file_id", "dst"]).withColumn("features", g.edge_features(Box.named("a_"), Box.named("b_")))


def edge_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("file_id", "pos", *[F.round(F.get("features", F.lit(i)), 6).alias(f"f{i}") for i in range(10)])


def box_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = sg.node_pairs(_scene(spark, sf_dir)[0]).where("i < j")
    return pairs.select("file_id", "i", "j", F.round(g.iou(Box.named("a_"), Box.named("b_")), 6).alias("iou"))


def relation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = sg.node_pairs(_scene(spark, sf_dir)[0])
    return pairs.select("file_id", "i", "j", g.relation_label(Box.named("a_"), Box.named("b_")).alias("label"))


def neighbour_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.neighbour_links(_scene(spark, sf_dir)[0], 2)


def neighbour_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs built from boxes, written as JSON and parsed again."""
    nodes, _ = _scene(spark, sf_dir)
    graphs = sg.graph_files(sg.to_node_link(nodes, sg.neighbour_links(nodes)))
    again = sg.scene_nodes(sg.raw_nodes(graphs))
    links = sg.scene_edges(sg.raw_edges(graphs), again).groupBy("file_id").agg(F.count("*").alias("links"))
    return again.groupBy("file_id").agg(F.count("*").alias("nodes")).join(links, "file_id", "left").select("file_id", "nodes", F.coalesce("links", F.lit(0)).alias("links"))


def _attach(strategy: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes, strings = _frame_graph(spark, sf_dir)
        return sg.attach_strings(strings, nodes, strategy, 2 if strategy == "nearest" else 1)

    query.__name__ = f"text_attach_{strategy}"
    return query


def fused_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    graphs = _graphs(spark, sf_dir)
    nodes, strings = _frame_graph(spark, sf_dir, graphs)
    _, edges = _scene(spark, sf_dir, graphs)
    names = sg.vocabulary(sg.raw_nodes(graphs), sg.raw_edges(graphs), tf.DYNAMIC_CLASSES)
    objects = sg.with_index(nodes, names, "node", "class_name", "class_idx")
    frame_of = nodes.select("file_id", "frame").distinct()
    scene = sg.with_index(edges.join(frame_of, "file_id"), names, "edge", "label", "label_idx")
    fused = sg.fused_nodes(objects, strings)
    got = sg.fused_edges(fused, scene, sg.attach_strings(strings, nodes))
    return got.select("frame", "edge", "src", "dst", "label_idx", "is_text_edge", "src_class", "dst_class", F.round(F.get("features", F.lit(0)), 6).alias("distance"))


def compatible_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    graphs = _graphs(spark, sf_dir)
    nodes, edges = _scene(spark, sf_dir, graphs)
    frames = graphs.select(F.col("file_id").alias("frame"), F.lit("a").alias("fingerprint"), F.when(F.col("file_id") % 5 == 0, "b").otherwise("a").alias("expected"))
    return sg.compatible_graphs(nodes.withColumnRenamed("file_id", "frame"), _features(spark, sf_dir, graphs).withColumnRenamed("file_id", "frame"), frames)


def edge_normalizer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalizer.fit(_features(spark, sf_dir)).select("pos", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def edge_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _features(spark, sf_dir)
    done = normalizer.transform(rows, normalizer.fit(rows))
    return done.select("file_id", "pos", *[F.round(F.get("features", F.lit(i)), 5).alias(f"f{i}") for i in range(10)], is_vector(F.col("features"), 10).alias("finite"))


def pool_mean_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Box.named()
    graphs = _graphs(spark, sf_dir)
    nodes = _scene(spark, sf_dir, graphs)[0].select(F.col("file_id").alias("frame"), b.cx.alias("cx"), b.cy.alias("cy"))
    got = sg.pooled(nodes, graphs.select(F.col("file_id").alias("frame")), ["cx", "cy"])
    return got.select("frame", *[F.round(c, 6).alias(c) for c in ("cx_mean", "cy_mean", "cx_max", "cy_max")])


def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n-gram vectors of the distinct strings, as their filled buckets."""
    texts = _detections(spark, sf_dir).where("text IS NOT NULL").select("text").distinct()
    return tf.ngram_vectors(texts, "text", "text", 64).select("text", "bucket", F.round("weight", 6).alias("weight"))


def string_shuffle_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tf.shuffled_texts(_detections(spark, sf_dir).select("ann_id", "det_pos", "text"), 7).select("ann_id", "det_pos", "text")


def acceptance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.summary(*_checked(spark, sf_dir))


def acceptance_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.defects(*_checked(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


def _checked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "frames"), table(spark, sf_dir, "annotation_files")


def coverage_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.coverage(*_checked(spark, sf_dir)).where("NOT (has_text AND has_graph)")


def _described(spark: SparkSession, sf_dir: str, fusion: str) -> DataFrame:
    from kerbstone import pipeline
    from kerbstone.config import settings_from
    from kerbstone.operators.encoder import encode_frames, random_weights

    s = settings_from({"preprocess": {"dynamic_text_threshold": None}, "model": {"text_fusion": fusion}})
    done = pipeline.prepare(table(spark, sf_dir, "annotation_files"), table(spark, sf_dir, "frame_texts"), s)
    shape = pipeline.shape_of(done["vocabulary"], s)
    return encode_frames(done["graphs"], shape, random_weights(shape))


def _descriptors(name: str, fusion: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A descriptor per frame by an untrained encoder: its length and first values."""
        return _described(spark, sf_dir, fusion).select("frame", F.size("v").alias("width"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm2"), F.round(F.get("v", F.lit(0)), 6).alias("v0"), F.round(F.get("v", F.lit(255)), 6).alias("v255"))

    query.__name__ = name
    return query


def mask_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each string's box is covered by a mask of the frame's larger objects, through the coded mask."""
    from kerbstone.functions.masks import dynamic_scores, mask_of_boxes

    nodes, strings = _frame_graph(spark, sf_dir)
    box = F.array("x1", "y1", "x2", "y2")
    objects = nodes.where("(x2 - x1) * (y2 - y1) > 0.01").groupBy("frame").agg(F.collect_list(box).alias("objects"))
    texts = strings.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("string", box.alias("b")))).alias("s"))
    both = texts.join(objects, "frame").select("frame", F.transform("s", lambda x: x.getField("b")).alias("boxes"), mask_of_boxes(F.col("objects"), F.lit(160), F.lit(120)).alias("mask"))
    coded = both.withColumn("mask", F.coalesce("mask", F.lit(None).cast("struct<size: array<int>, counts: string>")))
    scores = coded.withColumn("scores", dynamic_scores(F.col("boxes"), F.col("mask"), F.lit(160), F.lit(120)))
    return scores.select("frame", F.posexplode("scores").alias("string", "score")).withColumn("score", F.round("score", 6))


QUERIES = {
    f.__name__: f
    for f in (
        junk_text_filter, dynamic_text_filter, annotation_time_filter, text_switched_off, detection_boxes, pixel_boxes, frame_text_documents, recognizer_answers,
        pixel_predictions, dynamic_classes, scene_nodes, scene_edges, dropped_edges, vocabulary, edge_features, box_iou_pairs, relation_labels, neighbour_graph,
        neighbour_documents, *map(_attach, sg.STRATEGIES), fused_graph_edges, compatible_graphs, edge_normalizer_stats, edge_normalized, pool_mean_max, char_ngrams,
        string_shuffle_control, acceptance_summary, acceptance_defects, coverage_diff, _descriptors("frame_descriptors", "set"), _descriptors("frame_descriptors_node", "node"), _descriptors("frame_descriptors_additive", "additive"), mask_coverage,
    )
}

# ------------------------------------------------------------------ SQL counterparts

_NAMES = ", ".join(f"'{c}'" for c in tf.DYNAMIC_CLASSES)
_ALIAS = "CASE lower(trim(class_name)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in tf.CLASS_ALIASES.items()) + " ELSE lower(trim(class_name)) END"
_DET = """det AS (
  SELECT ann_id, frame_id, u.i - 1 AS det_pos, u.d.box AS box, u.d.text AS text, u.d.confidence AS confidence, u.d.dynamic_score AS dynamic_score, image_size
  FROM (SELECT DISTINCT ON (ann_id) * FROM frame_texts WHERE ann_id IS NOT NULL ORDER BY ann_id, written_at DESC) f,
    (SELECT unnest(f.detections) AS d, generate_subscripts(f.detections, 1) AS i) u)"""
_OK = "coalesce(len(box) = 4 AND box[1] BETWEEN 0 AND 1 AND box[2] BETWEEN 0 AND 1 AND box[3] BETWEEN 0 AND 1 AND box[4] BETWEEN 0 AND 1 AND box[3] > box[1] AND box[4] > box[2], false)"
_JUNK = "(length(trim(coalesce(text, ''))) < 3 OR regexp_full_match(trim(coalesce(text, '')), '\\p{Nd}+'))"
_GRAPH = """j AS (SELECT file_id, file_path, CAST(content AS JSON) AS doc FROM annotation_files WHERE json_valid(content) AND json_type(content, '$.nodes') = 'ARRAY'),
rn0 AS (SELECT file_id, CAST(e.key AS INT) AS pos, e.value AS n, CASE WHEN json_type(e.value, '$.data') = 'OBJECT' THEN e.value->'$.data' ELSE e.value END AS d
  FROM j, json_each(j.doc, '$.nodes') e WHERE e.type = 'OBJECT'),
num AS (SELECT *, CASE WHEN json_type(d, '$.bbox_2d.xyxy') = 'ARRAY' AND len(list_filter([json_type(d, '$.bbox_2d.xyxy[' || i || ']') FOR i IN range(CAST(json_array_length(d, '$.bbox_2d.xyxy') AS BIGINT))], lambda x: x IN ('DOUBLE', 'BIGINT', 'UBIGINT'))) = json_array_length(d, '$.bbox_2d.xyxy') AND json_array_length(d, '$.bbox_2d.xyxy') > 0
    THEN CAST(d->'$.bbox_2d.xyxy' AS DOUBLE[])
  WHEN json_type(d, '$.bbox') = 'ARRAY' AND len(list_filter([json_type(d, '$.bbox[' || i || ']') FOR i IN range(CAST(json_array_length(d, '$.bbox') AS BIGINT))], lambda x: x IN ('DOUBLE', 'BIGINT', 'UBIGINT'))) = json_array_length(d, '$.bbox') AND json_array_length(d, '$.bbox') > 0
    THEN CAST(d->'$.bbox' AS DOUBLE[]) END AS box FROM rn0),
rn AS (SELECT file_id, pos, CASE WHEN json_type(n, '$.id') IN ('VARCHAR', 'BIGINT', 'UBIGINT') THEN substr(json_type(n, '$.id'), 1, 1) || ':' || (n->>'$.id') END AS id,
  coalesce(nullif(trim(coalesce(d->>'$.class_name', d->>'$.label')), ''), 'unknown') AS class_name, box FROM num),
re AS (SELECT file_id, CAST(e.key AS INT) AS pos,
  CASE WHEN json_type(e.value, '$.source') IN ('VARCHAR', 'BIGINT', 'UBIGINT') THEN substr(json_type(e.value, '$.source'), 1, 1) || ':' || (e.value->>'$.source') END AS source,
  CASE WHEN json_type(e.value, '$.target') IN ('VARCHAR', 'BIGINT', 'UBIGINT') THEN substr(json_type(e.value, '$.target'), 1, 1) || ':' || (e.value->>'$.target') END AS target,
  coalesce(nullif(trim(coalesce(e.value->>'$.label', e.value->>'$.type')), ''), 'unknown') AS label
  FROM j, json_each(CASE WHEN json_type(j.doc, '$.links') = 'ARRAY' THEN j.doc->'$.links' WHEN json_type(j.doc, '$.edges') = 'ARRAY' THEN j.doc->'$.edges' ELSE '[]'::JSON END) e WHERE e.type = 'OBJECT'),
n0 AS (SELECT file_id, pos, id, class_name, least(1, greatest(0, box[1])) AS x1, least(1, greatest(0, box[2])) AS y1, least(1, greatest(0, box[3])) AS x2, least(1, greatest(0, box[4])) AS y2 FROM rn WHERE len(box) = 4),
nodes AS (SELECT *, CAST(row_number() OVER (PARTITION BY file_id ORDER BY pos) - 1 AS INT) AS node FROM n0 WHERE x2 > x1 AND y2 > y1 AND lower(class_name) NOT IN (%s)),
lastn AS (SELECT file_id, id, max(node) AS node FROM nodes WHERE id IS NOT NULL GROUP BY ALL),
edges AS (SELECT re.file_id, re.pos, a.node AS src, b.node AS dst, re.label FROM re JOIN lastn a ON a.file_id = re.file_id AND a.id = re.source JOIN lastn b ON b.file_id = re.file_id AND b.id = re.target)""" % _NAMES  # noqa: UP031
_PAIRS = "pairs AS (SELECT a.file_id, a.node AS i, b.node AS j, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2 FROM nodes a JOIN nodes b USING (file_id) WHERE a.node <> b.node)"
_INTER = "(greatest(0, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0, least(ay2, by2) - greatest(ay1, by1)))"
_IOU = f"({_INTER} / ((ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - {_INTER} + 1e-8::DOUBLE))"
_LABEL = f"""CASE WHEN {_INTER} / greatest(1e-9::DOUBLE, (ax2 - ax1) * (ay2 - ay1)) > 0.8::DOUBLE THEN 'in'
  WHEN least(ax2, bx2) - greatest(ax1, bx1) > 0 AND abs(ay2 - by1) < 0.05::DOUBLE THEN 'standing on' WHEN {_INTER} > 0 THEN 'beside'
  WHEN (ay1 + ay2) / 2 < (by1 + by2) / 2 - 0.1::DOUBLE THEN 'above' ELSE 'next to' END"""
_FEATURES = f"""ends AS (SELECT e.file_id, e.pos, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2
  FROM edges e JOIN nodes a ON a.file_id = e.file_id AND a.node = e.src JOIN nodes b ON b.file_id = e.file_id AND b.node = e.dst),
geo AS (SELECT *, (bx1 + bx2) / 2 - (ax1 + ax2) / 2 AS dx, (by1 + by2) / 2 - (ay1 + ay2) / 2 AS dy, (ax2 - ax1) * (ay2 - ay1) AS aa, (bx2 - bx1) * (by2 - by1) AS ba FROM ends),
feat AS (SELECT file_id, pos, sqrt(dx * dx + dy * dy) AS f0, dx AS f1, dy AS f2, sin(atan2(dy, dx)) AS f3, cos(atan2(dy, dx)) AS f4, {_IOU} AS f5, {_INTER} / (least(aa, ba) + 1e-8::DOUBLE) AS f6,
  ln(1 + ba / (aa + 1e-8::DOUBLE)) AS f7, ln(1 + (bx2 - bx1) / (ax2 - ax1 + 1e-8::DOUBLE)) AS f8, ln(1 + (by2 - by1) / (ay2 - ay1 + 1e-8::DOUBLE)) AS f9 FROM geo)"""
_FRAME = f"""latest AS (SELECT regexp_replace(split_part(replace(file_path, '\\', '/'), '/', -1), '\\.[^.]*$', '') AS frame, max(file_id) AS file_id FROM j GROUP BY 1),
fn AS (SELECT frame, file_id, node, class_name, x1, y1, x2, y2 FROM nodes JOIN latest USING (file_id)),
ok AS (SELECT * FROM det WHERE {_OK} AND NOT {_JUNK} AND (dynamic_score IS NULL OR dynamic_score < 0.5::DOUBLE)),
st AS (SELECT frame_id AS frame, text, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY det_pos) - 1 AS INT) AS string, box[1] AS ax1, box[2] AS ay1, box[3] AS ax2, box[4] AS ay2
  FROM ok JOIN (SELECT frame_id, max(ann_id) AS ann_id FROM ok GROUP BY 1) USING (frame_id, ann_id)),
cand AS (SELECT frame, string, node, (ax1 + ax2) / 2 BETWEEN bx1 AND bx2 AND (ay1 + ay2) / 2 BETWEEN by1 AND by2 AS holds, {_IOU} AS iou,
  sqrt(((ax1 + ax2) / 2 - (bx1 + bx2) / 2) ** 2 + ((ay1 + ay2) / 2 - (by1 + by2) / 2) ** 2) AS distance
  FROM (SELECT st.*, fn.node, fn.x1 AS bx1, fn.y1 AS by1, fn.x2 AS bx2, fn.y2 AS by2 FROM st JOIN fn USING (frame)))"""
_BEST = "QUALIFY row_number() OVER (PARTITION BY frame, string ORDER BY holds DESC, iou DESC, round(distance, 12), node) = 1"
_VOCABULARY = f"""names AS (SELECT DISTINCT 'node' AS kind, class_name AS name FROM rn WHERE lower(class_name) NOT IN ({_NAMES}) UNION SELECT DISTINCT 'edge', label FROM re),
vocab AS (SELECT kind, name, CAST(row_number() OVER (PARTITION BY kind ORDER BY name) AS INT) AS idx FROM names WHERE name <> 'unknown' UNION ALL SELECT 'node', 'unknown', 0 UNION ALL SELECT 'edge', 'unknown', 0)"""
_EVERY = ", ".join(f"round(f{i}, 6) AS f{i}" for i in range(10))

SQL = {
    "junk_text_filter": f"WITH {_DET} SELECT ann_id, det_pos, text FROM det WHERE NOT {_JUNK}",
    "dynamic_text_filter": f"WITH {_DET} SELECT ann_id, det_pos, dynamic_score FROM det WHERE NOT {_JUNK} AND dynamic_score < 0.5::DOUBLE",
    "annotation_time_filter": f"WITH {_DET} SELECT ann_id, det_pos, text FROM det WHERE NOT {_JUNK} AND (dynamic_score IS NULL OR dynamic_score < 0.5::DOUBLE)",
    "text_switched_off": f"WITH {_DET} SELECT ann_id, count(*) AS strings, 0 AS kept FROM det GROUP BY ann_id",
    "detection_boxes": f"WITH {_DET} SELECT ann_id, det_pos, {_OK} AS valid, CASE WHEN {_OK} THEN round((box[3] - box[1]) * (box[4] - box[2]), 6) END AS area FROM det",
    "pixel_boxes": f"""WITH {_DET} SELECT ann_id, det_pos, CAST(round_even(box[1] * image_size[1], 0) AS INT) AS px1, CAST(round_even(box[2] * image_size[2], 0) AS INT) AS py1,
  CAST(round_even(box[3] * image_size[1], 0) AS INT) AS px2, CAST(round_even(box[4] * image_size[2], 0) AS INT) AS py2 FROM det WHERE {_OK}""",
    "frame_text_documents": f"WITH {_DET} SELECT ann_id, count(*) AS strings, count(dynamic_score) AS scored, round(sum(confidence), 6) AS confidence FROM det GROUP BY ann_id",
    "recognizer_answers": f"""WITH {_DET}, q AS (SELECT ann_id, text, (floor(box[3] * 1000) - floor(box[1] * 1000)) / 1000 * 640 AS w, (floor(box[4] * 1000) - floor(box[2] * 1000)) / 1000 * 480 AS h FROM det WHERE {_OK} AND text IS NOT NULL),
v AS (SELECT * FROM q WHERE w > 0 AND h > 0 AND trim(text) <> '')
SELECT ann_id AS key, count(v.text) AS words, round(sum(v.w), 6) AS width, round(sum(v.h), 6) AS height FROM v GROUP BY ann_id
UNION ALL SELECT ann_id, 0, NULL, NULL FROM (SELECT DISTINCT ann_id FROM q) WHERE ann_id NOT IN (SELECT ann_id FROM v)""",
    "pixel_predictions": f"""WITH {_DET}, q AS (SELECT ann_id AS key, det_pos AS pos, trim(coalesce(text, '')) AS text, round(least(1, greatest(0, box[1])), 6) AS x1, round(least(1, greatest(0, box[2])), 6) AS y1,
  round(least(1, greatest(0, box[3])), 6) AS x2, round(least(1, greatest(0, box[4])), 6) AS y2, round(coalesce(confidence, 1), 6) AS confidence FROM det WHERE len(box) = 4)
SELECT * FROM q WHERE x2 > x1 AND y2 > y1 AND lower(text) NOT IN ({', '.join(f"'{x}'" for x in t.NO_TEXT)})""",
    "dynamic_classes": f"WITH {_GRAPH}, c AS (SELECT class_name, count(*) AS n FROM rn GROUP BY 1) SELECT class_name, {_ALIAS} AS canonical, {_ALIAS} IN ({_NAMES}) AS dynamic, n FROM c",
    "scene_nodes": f"WITH {_GRAPH} SELECT file_id, node, pos, class_name, round((x1 + x2) / 2, 6) AS cx, round((y1 + y2) / 2, 6) AS cy, round(x2 - x1, 6) AS w, round(y2 - y1, 6) AS h FROM nodes",
    "scene_edges": f"WITH {_GRAPH} SELECT * FROM edges",
    "dropped_edges": f"WITH {_GRAPH}, k AS (SELECT file_id, count(*) AS kept FROM edges GROUP BY 1) SELECT file_id, count(*) AS total, count(*) - coalesce(any_value(kept), 0) AS dropped FROM re LEFT JOIN k USING (file_id) GROUP BY file_id",
    "vocabulary": f"WITH {_GRAPH}, {_VOCABULARY} SELECT * FROM vocab",
    "edge_features": f"WITH {_GRAPH}, {_FEATURES} SELECT file_id, pos, {_EVERY} FROM feat",
    "box_iou_pairs": f"WITH {_GRAPH}, {_PAIRS} SELECT file_id, i, j, round({_IOU}, 6) AS iou FROM pairs WHERE i < j",
    "relation_labels": f"WITH {_GRAPH}, {_PAIRS} SELECT file_id, i, j, {_LABEL} AS label FROM pairs",
    "neighbour_graph": f"""WITH {_GRAPH}, {_PAIRS} SELECT file_id, i AS src, j AS dst, {_LABEL} AS label FROM pairs
QUALIFY row_number() OVER (PARTITION BY file_id, i ORDER BY ((bx1 + bx2) / 2 - (ax1 + ax2) / 2) * ((bx1 + bx2) / 2 - (ax1 + ax2) / 2) + ((by1 + by2) / 2 - (ay1 + ay2) / 2) * ((by1 + by2) / 2 - (ay1 + ay2) / 2), j) <= 2""",
    "neighbour_documents": f"WITH {_GRAPH} SELECT file_id, count(*) AS nodes, CASE WHEN count(*) > 1 THEN count(*) ELSE 0 END AS links FROM nodes GROUP BY file_id",
    "text_attach_overlap_nearest": f"WITH {_DET}, {_GRAPH}, {_FRAME} SELECT frame, string, node FROM cand {_BEST}",
    "text_attach_overlap": f"WITH {_DET}, {_GRAPH}, {_FRAME} SELECT frame, string, node FROM cand WHERE holds OR iou > 0",
    "text_attach_nearest": f"WITH {_DET}, {_GRAPH}, {_FRAME} SELECT frame, string, node FROM cand QUALIFY row_number() OVER (PARTITION BY frame, string ORDER BY round(distance, 12), node) <= 2",
    "text_attach_fully_connected": f"WITH {_DET}, {_GRAPH}, {_FRAME} SELECT frame, string, node FROM cand",
    "fused_graph_edges": f"""WITH {_DET}, {_GRAPH}, {_FRAME}, {_VOCABULARY}, best AS (SELECT frame, string, node FROM cand {_BEST}),
objects AS (SELECT frame, node, coalesce(idx, 0) AS class_idx, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM fn LEFT JOIN vocab ON kind = 'node' AND name = class_name),
sizes AS (SELECT frame, count(*) AS n FROM fn GROUP BY 1),
words AS (SELECT st.frame, CAST(coalesce(n, 0) + string AS INT) AS node, 0 AS class_idx, (ax1 + ax2) / 2 AS cx, (ay1 + ay2) / 2 AS cy FROM st LEFT JOIN sizes USING (frame)),
every AS (SELECT * FROM objects UNION ALL SELECT * FROM words),
se AS (SELECT frame, 0 AS k, pos AS a, 0 AS b, 0 AS c, src, dst, coalesce(idx, 0) AS label_idx, false AS is_text_edge FROM edges JOIN latest USING (file_id) LEFT JOIN vocab ON kind = 'edge' AND name = label),
te AS (SELECT best.frame, 1 AS k, string AS a, node AS b, w.c, CASE WHEN w.c = 0 THEN CAST(n + string AS INT) ELSE node END AS src, CASE WHEN w.c = 0 THEN node ELSE CAST(n + string AS INT) END AS dst, 0 AS label_idx, true AS is_text_edge FROM best JOIN sizes USING (frame), (VALUES (0), (1)) w(c)),
al AS (SELECT *, CAST(row_number() OVER (PARTITION BY frame ORDER BY k, a, b, c) - 1 AS INT) AS edge FROM (SELECT * FROM se UNION ALL SELECT * FROM te))
SELECT al.frame, edge, src, dst, label_idx, is_text_edge, s.class_idx AS src_class, d.class_idx AS dst_class, round(sqrt((d.cx - s.cx) ** 2 + (d.cy - s.cy) ** 2), 6) AS distance
FROM al JOIN every s ON s.frame = al.frame AND s.node = src JOIN every d ON d.frame = al.frame AND d.node = dst""",
    "compatible_graphs": f"WITH {_GRAPH} SELECT file_id AS frame, file_id % 5 <> 0 AS compatible FROM j",
    "edge_normalizer_stats": f"WITH {_GRAPH}, {_FEATURES}, l AS (" + " UNION ALL ".join(f"SELECT {i} AS pos, f{i} AS v FROM feat" for i in range(10)) + ") SELECT pos, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM l GROUP BY pos",
    "edge_normalized": f"WITH {_GRAPH}, {_FEATURES}, s AS (SELECT " + ", ".join(f"avg(f{i}) AS m{i}, stddev_samp(f{i}) AS d{i}" for i in range(10)) + ") SELECT file_id, pos, " + ", ".join(f"round((f{i} - m{i}) / (d{i} + 1e-6::DOUBLE), 5) AS f{i}" for i in range(10)) + ", true AS finite FROM feat, s",
    "pool_mean_max": f"""WITH {_GRAPH} SELECT j.file_id AS frame, round(coalesce(avg((x1 + x2) / 2), 0), 6) AS cx_mean, round(coalesce(avg((y1 + y2) / 2), 0), 6) AS cy_mean, round(coalesce(max((x1 + x2) / 2), 0), 6) AS cx_max, round(coalesce(max((y1 + y2) / 2), 0), 6) AS cy_max
FROM j LEFT JOIN nodes ON nodes.file_id = j.file_id GROUP BY j.file_id""",
    "string_shuffle_control": f"""WITH {_DET}, p AS (SELECT ann_id, det_pos, row_number() OVER (ORDER BY md5(concat_ws('|', 'place', ann_id, det_pos))) AS r FROM det),
s AS (SELECT text, row_number() OVER (ORDER BY md5(concat_ws('|', '7', ann_id, det_pos))) AS r FROM det) SELECT ann_id, det_pos, text FROM p JOIN s USING (r)""",
    "mask_coverage": f"""WITH {_DET}, {_GRAPH}, {_FRAME}, ob AS (SELECT frame, round_even(x1 * 160, 0) AS a, round_even(y1 * 120, 0) AS b, round_even(x2 * 160, 0) AS c, round_even(y2 * 120, 0) AS d FROM fn WHERE (x2 - x1) * (y2 - y1) > 0.01::DOUBLE),
sb AS (SELECT frame, string, round_even(ax1 * 160, 0) AS a, round_even(ay1 * 120, 0) AS b, round_even(ax2 * 160, 0) AS c, round_even(ay2 * 120, 0) AS d FROM st WHERE frame IN (SELECT frame FROM ob)),
px AS (SELECT sb.frame, string, x.x, y.y FROM sb, range(160) x(x), range(120) y(y) WHERE x.x >= sb.a AND x.x < sb.c AND y.y >= sb.b AND y.y < sb.d),
hit AS (SELECT frame, string, count(*) AS h FROM px WHERE EXISTS (SELECT 1 FROM ob WHERE ob.frame = px.frame AND px.x >= ob.a AND px.x < ob.c AND px.y >= ob.b AND px.y < ob.d) GROUP BY ALL)
SELECT sb.frame, sb.string, round(coalesce(h / ((c - a) * (d - b)), 0), 6) AS score FROM sb LEFT JOIN hit USING (frame, string)""",
    "coverage_diff": checks.COVERAGE_SQL,
    "acceptance_summary": checks.SUMMARY_SQL % {"graph": _GRAPH},
    "acceptance_defects": checks.DEFECTS_SQL % {"graph": _GRAPH},
}
SQL["edge_normalized"] = SQL["edge_normalized"].replace("stddev_samp(f9) AS d9)", "stddev_samp(f9) AS d9 FROM feat)")

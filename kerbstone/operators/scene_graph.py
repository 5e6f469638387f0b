"""Scene graphs: from node-link JSON to node and edge tables, to graphs fused with strings, and back.

A file of one frame is a row, so windows and joins by file are bounded by the largest frame.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbstone.functions import geometry as g
from kerbstone.functions import text as t
from kerbstone.functions.geometry import Box

#: How a string may be attached to objects.
STRATEGIES = ("overlap_nearest", "overlap", "nearest", "fully_connected")
UNKNOWN = "unknown"


def graph_files(files: DataFrame) -> DataFrame:
    """``file_id, doc`` of the files whose content is a graph; each id once, the largest content of one.

    Null, broken and other content is left out (the compaction lists it).
    """
    one = files.where("file_id IS NOT NULL").groupBy("file_id").agg(F.max("content").alias("content"))
    doc = one.select("file_id", F.try_parse_json("content").alias("doc"))
    return doc.where(F.try_variant_get("doc", "$.nodes", "array<variant>").isNotNull())


def _object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _part(v: str | Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def typed_key(v: str | Column, path: str) -> Column:
    """An id with its kind, so that number 3 and text "3" differ; null for null, absent and nested ids."""
    kind = F.schema_of_variant(_part(v, path, "variant"))
    short = F.when(kind == "STRING", "s").when(kind == "BOOLEAN", "b").when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "n")
    return F.concat(short, F.lit(":"), _part(v, path))


def _numbers(v: Column, path: str) -> Column:
    """An array of numbers, else null."""
    values = _part(v, path, "array<double>")
    return F.when(F.schema_of_variant(_part(v, path, "variant")).rlike("^ARRAY<(BIGINT|DECIMAL|DOUBLE|FLOAT)") & ~F.exists(values, lambda x: x.isNull()), values)


def raw_nodes(graphs: DataFrame) -> DataFrame:
    """``file_id, pos, id, class_name, box`` of every node object, wrapped in ``data`` or flat.

    ``box`` is ``bbox_2d.xyxy``, else ``bbox``; null where it is no array of numbers. A missing or blank name
    is ``unknown``.
    """
    each = graphs.select("file_id", F.posexplode(_part("doc", "$.nodes", "array<variant>")).alias("pos", "n")).where(_object(F.col("n")))
    wrapped = _object(_part("n", "$.data", "variant"))
    data = F.when(wrapped, _part("n", "$.data", "variant")).otherwise(F.col("n"))
    each = each.withColumn("d", data)
    box = F.coalesce(_numbers(F.col("d"), "$.bbox_2d.xyxy"), _numbers(F.col("d"), "$.bbox"))
    return each.select("file_id", "pos", typed_key("n", "$.id").alias("id"), t.label_or_unknown(_part("d", "$.class_name"), _part("d", "$.label")).alias("class_name"), box.alias("box"))


def raw_edges(graphs: DataFrame) -> DataFrame:
    """``file_id, pos, source, target, label`` of every element of ``links``, else ``edges``, that is an object."""
    links = F.coalesce(_part("doc", "$.links", "array<variant>"), _part("doc", "$.edges", "array<variant>"))
    each = graphs.select("file_id", F.posexplode(links).alias("pos", "e")).where(_object(F.col("e")))
    return each.select("file_id", "pos", typed_key("e", "$.source").alias("source"), typed_key("e", "$.target").alias("target"), t.label_or_unknown(_part("e", "$.label"), _part("e", "$.type")).alias("label"))


def scene_nodes(raw: DataFrame, dynamic: Iterable[str] = ()) -> DataFrame:
    """``file_id, node, pos, id, class_name, x1, y1, x2, y2``: boxes clamped, those without area and dynamic
    classes dropped, the rest numbered densely in file order."""
    dropped = [d.strip().lower() for d in dynamic]
    b = Box.of(F.col("box")).clamped()
    kept = raw.where(F.size("box") == 4).select("file_id", "pos", "id", "class_name", *b.columns()).where("x2 > x1 AND y2 > y1")
    if dropped:
        kept = kept.where(~F.lower("class_name").isin(*dropped))
    return kept.withColumn("node", F.row_number().over(Window.partitionBy("file_id").orderBy("pos")) - 1).select("file_id", "node", "pos", "id", "class_name", "x1", "y1", "x2", "y2")


def scene_edges(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """``file_id, pos, src, dst, label``: edges whose ends are both kept; of nodes with one id the last counts."""
    last = nodes.where("id IS NOT NULL").groupBy("file_id", "id").agg(F.max("node").alias("node"))
    end = lambda name, at: last.select("file_id", F.col("id").alias(name), F.col("node").alias(at))
    return raw.join(end("source", "src"), ["file_id", "source"]).join(end("target", "dst"), ["file_id", "target"]).select("file_id", "pos", "src", "dst", "label")


def dropped_edges(raw: DataFrame, edges: DataFrame) -> DataFrame:
    """``file_id, total, dropped``."""
    kept = edges.groupBy("file_id").agg(F.count("*").alias("kept"))
    return raw.groupBy("file_id").agg(F.count("*").alias("total")).join(kept, "file_id", "left").select("file_id", "total", (F.col("total") - F.coalesce("kept", F.lit(0))).alias("dropped"))


def vocabulary(nodes: DataFrame, edges: DataFrame, dynamic: Iterable[str] = ()) -> DataFrame:
    """``kind, name, idx``: sorted names of all raw nodes and edges, dangling ones too, from 1; ``unknown`` is 0.

    The names of a corpus are few; a window over them is one small task.
    """
    dropped = [d.strip().lower() for d in dynamic]
    names = nodes.select(F.lit("node").alias("kind"), F.col("class_name").alias("name"))
    names = names.where(~F.lower("name").isin(*dropped)) if dropped else names
    names = names.unionByName(edges.select(F.lit("edge").alias("kind"), F.col("label").alias("name"))).where(F.col("name") != UNKNOWN).distinct()
    numbered = names.withColumn("idx", F.row_number().over(Window.partitionBy("kind").orderBy("name")))
    return numbered.unionByName(nodes.sparkSession.createDataFrame([("node", UNKNOWN, 0), ("edge", UNKNOWN, 0)], "kind string, name string, idx int"))


def with_index(rows: DataFrame, names: DataFrame, kind: str, column: str, index: str) -> DataFrame:
    """Adds the vocabulary's index of a name, that of ``unknown`` for names it lacks."""
    known = names.where(F.col("kind") == kind).select(F.col("name").alias(column), F.col("idx").alias(index))
    return rows.join(known, column, "left").withColumn(index, F.coalesce(index, F.lit(0)))


def node_pairs(nodes: DataFrame) -> DataFrame:
    """Ordered pairs of different nodes of a file, boxes prefixed ``a_`` and ``b_``."""
    corner = ("x1", "y1", "x2", "y2")
    a = nodes.select("file_id", F.col("node").alias("i"), *[F.col(c).alias(f"a_{c}") for c in corner])
    b = nodes.select("file_id", F.col("node").alias("j"), *[F.col(c).alias(f"b_{c}") for c in corner])
    return a.join(b, "file_id").where("i <> j")


def neighbour_links(nodes: DataFrame, neighbours: int = 1) -> DataFrame:
    """``file_id, src, dst, label``: each node to its nearest others by centre, ties in node order, labelled."""
    if neighbours < 1:
        return nodes.select("file_id", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit("").alias("label")).where(F.lit(False))
    a, b = Box.named("a_"), Box.named("b_")
    d2 = (b.cx - a.cx) * (b.cx - a.cx) + (b.cy - a.cy) * (b.cy - a.cy)
    ranked = node_pairs(nodes).withColumn("_k", F.row_number().over(Window.partitionBy("file_id", "i").orderBy(d2, "j"))).where(F.col("_k") <= neighbours)
    return ranked.select("file_id", F.col("i").alias("src"), F.col("j").alias("dst"), g.relation_label(a, b).alias("label"))


def to_node_link(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``file_id, content``: a node-link JSON document per file, ids from 1."""
    b = Box.named()
    data = F.struct((F.col("node") + 1).alias("global_id"), F.col("class_name"), F.lit(-1).alias("class_id"), F.struct(F.array(b.x1, b.y1, b.x2, b.y2).alias("xyxy"), F.array(b.cx, b.cy).alias("center")).alias("bbox_2d"))
    n = nodes.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct((F.col("node") + 1).alias("id"), data.alias("data")))).alias("nodes"))
    e = links.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct((F.col("src") + 1).alias("source"), (F.col("dst") + 1).alias("target"), "label"))).alias("links"))
    whole = F.struct(F.lit(True).alias("directed"), F.lit(True).alias("multigraph"), "nodes", F.coalesce("links", F.array().cast("array<struct<source:int,target:int,label:string>>")).alias("links"))
    return n.join(e, "file_id", "left").select("file_id", F.to_json(whole).alias("content"))


def attach_strings(strings: DataFrame, nodes: DataFrame, strategy: str = "overlap_nearest", k: int = 1) -> DataFrame:
    """``frame, string, node``: the objects each string (frame, string, x1..y2) is written on.

    ``nodes`` has frame, node, x1..y2. ``overlap_nearest`` takes one object: that whose box holds the string's
    centre, then of the highest overlap, the nearest centre, the lower number. ``overlap`` takes all that hold the
    centre or overlap, ``nearest`` the k nearest, ``fully_connected`` all. A frame without objects gives none.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {', '.join(STRATEGIES)}")
    corner = ("x1", "y1", "x2", "y2")
    s = strings.select("frame", "string", *[F.col(c).alias(f"s_{c}") for c in corner])
    o = nodes.select("frame", "node", *[F.col(c).alias(f"o_{c}") for c in corner])
    sb, ob = Box.named("s_"), Box.named("o_")
    pairs = s.join(o, "frame").select("frame", "string", "node", g.contains_centre(ob, sb).alias("holds"), g.iou(sb, ob).alias("iou"), g.centre_distance(sb, ob).alias("distance"))
    if strategy == "overlap":
        pairs = pairs.where("holds OR iou > 0")
    elif strategy != "fully_connected":
        order = ["distance", "node"] if strategy == "nearest" else [F.desc("holds"), F.desc("iou"), "distance", "node"]
        most = max(1, k) if strategy == "nearest" else 1
        pairs = pairs.withColumn("_k", F.row_number().over(Window.partitionBy("frame", "string").orderBy(*order))).where(F.col("_k") <= most)
    return pairs.select("frame", "string", "node")


def fused_nodes(nodes: DataFrame, strings: DataFrame) -> DataFrame:
    """Objects, then strings as nodes of class 0: ``frame, node, is_text, class_idx, x1..y2, text``.

    ``nodes`` has frame, node, class_idx and corners; ``strings`` frame, string (0, 1, ...), corners and text.
    """
    counts = nodes.groupBy("frame").agg(F.count("*").alias("_objects"))
    corner = ("x1", "y1", "x2", "y2")
    objects = nodes.select("frame", "node", F.lit(False).alias("is_text"), "class_idx", *corner, F.lit(None).cast("string").alias("text"))
    words = strings.join(counts, "frame", "left").select("frame", (F.coalesce("_objects", F.lit(0)) + F.col("string")).cast("int").alias("node"), F.lit(True).alias("is_text"), F.lit(0).alias("class_idx"), *corner, "text")
    return objects.unionByName(words)


def fused_edges(fused: DataFrame, scene: DataFrame, attached: DataFrame, unknown: int = 0) -> DataFrame:
    """``frame, edge, src, dst, label_idx, is_text_edge, src_class, dst_class, features``.

    Scene relations (frame, pos, src, dst, label_idx) keep their order and come first; then, string by string, the
    edge to its object and the one back.
    """
    texts = fused.where("is_text").groupBy("frame").agg(F.min("node").alias("_first"))
    linked = attached.join(texts, "frame").withColumn("_word", (F.col("_first") + F.col("string")).cast("int"))
    direction = lambda back: F.struct(F.lit(back).alias("back"), (F.col("node") if back else F.col("_word")).alias("src"), (F.col("_word") if back else F.col("node")).alias("dst"))
    text_edges = linked.select("frame", "string", "node", F.explode(F.array(direction(False), direction(True))).alias("d")).select("frame", F.struct(F.lit(1), F.col("string").cast("long"), F.col("node").cast("long"), F.col("d.back").cast("long")).alias("_at"), "d.src", "d.dst", F.lit(unknown).alias("label_idx"), F.lit(True).alias("is_text_edge"))
    scene_edges_ = scene.select("frame", F.struct(F.lit(0), F.col("pos").cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long")).alias("_at"), "src", "dst", "label_idx", F.lit(False).alias("is_text_edge"))
    edges = scene_edges_.union(text_edges).withColumn("edge", F.row_number().over(Window.partitionBy("frame").orderBy("_at")) - 1)
    end = lambda name, lead: fused.select("frame", F.col("node").alias(name), F.col("class_idx").alias(f"{name}_class"), *[F.col(c).alias(lead + c) for c in ("x1", "y1", "x2", "y2")])
    both = edges.join(end("src", "a_"), ["frame", "src"]).join(end("dst", "b_"), ["frame", "dst"])
    return both.select("frame", "edge", "src", "dst", "label_idx", "is_text_edge", "src_class", "dst_class", g.edge_features(Box.named("a_"), Box.named("b_")).alias("features"))


def repaired_edges(edges: DataFrame, nodes: DataFrame, width: int = 10) -> DataFrame:
    """Edges (frame, src, dst, features) with both ends in range, features of the right width and finite."""
    from kerbstone.functions.vectors import repaired

    counts = nodes.groupBy("frame").agg(F.count("*").alias("_n"))
    inside = edges.join(counts, "frame").where("src >= 0 AND dst >= 0 AND src < _n AND dst < _n").drop("_n")
    return inside.withColumn("features", repaired(F.col("features"), width))


def compatible_graphs(nodes: DataFrame, edges: DataFrame, stored: DataFrame, width: int = 10) -> DataFrame:
    """``frame, compatible``: whether a stored graph (frame, fingerprint, expected) has the expected fingerprint, dense
    node numbers, edges within range and finite features of the right width."""
    from kerbstone.functions.vectors import is_vector

    n = nodes.groupBy("frame").agg(F.count("*").alias("_n"), F.min("node").alias("_lo"), F.max("node").alias("_hi"))
    e = edges.groupBy("frame").agg(F.min(F.least("src", "dst")).alias("_el"), F.max(F.greatest("src", "dst")).alias("_eh"), F.bool_and(is_vector(F.col("features"), width)).alias("_ok"))
    dense = F.col("_n").isNull() | (F.col("_lo") == 0) & (F.col("_hi") == F.col("_n") - 1)
    inside = F.col("_el").isNull() | (F.col("_el") >= 0) & (F.col("_eh") < F.coalesce("_n", F.lit(0))) & F.col("_ok")
    return stored.join(n, "frame", "left").join(e, "frame", "left").select("frame", F.coalesce((F.col("fingerprint") == F.col("expected")) & dense & inside, F.lit(False)).alias("compatible"))


def pooled(nodes: DataFrame, frames: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and maximum of columns per frame; a frame without nodes keeps its row, with zeros."""
    sums = nodes.groupBy("frame").agg(*[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.max(c).alias(f"{c}_max") for c in columns])
    return frames.select("frame").distinct().join(sums, "frame", "left").fillna(0.0)

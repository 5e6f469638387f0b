from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbstone.functions import geometry as g
from kerbstone.functions import masks, vectors
from kerbstone.functions import text as t
from kerbstone.functions.geometry import Box
from kerbstone.operators import checks, normalizer
from kerbstone.operators import scene_graph as sg
from kerbstone.operators import text_filters as tf
from kerbstone.sources import documents

BOX = "x1 double, y1 double, x2 double, y2 double"


def one(spark, column, rows=((1,),), schema="a int"):
    return [r[0] for r in spark.createDataFrame(list(rows), schema).select(column).collect()]


def test_boxes(spark):
    boxes = [([0.1, 0.1, 0.2, 0.2],), ([0.0, 0.0, 1.0, 1.0],), ([0.2, 0.1, 0.1, 0.2],), ([0.1, 0.1, 0.1, 0.2],), ([0.1, 0.1, 1.1, 0.2],), ([0.1, 0.1, float("nan"), 0.2],), ([0.1, 0.1, None, 0.2],), ([0.1, 0.2, 0.3],), (None,)]
    assert one(spark, g.is_valid_box(F.col("b")), boxes, "b array<double>") == [True, True, False, False, False, False, False, False, False]
    assert one(spark, g.required_box(F.col("b")), boxes[:1], "b array<double>") == [[0.1, 0.1, 0.2, 0.2]]
    with pytest.raises(Exception, match="box must be"):
        one(spark, g.required_box(F.col("b")), boxes[2:3], "b array<double>")


def test_relation_rules(spark):
    pairs = [([0.4, 0.4, 0.5, 0.5], [0.3, 0.3, 0.6, 0.6]), ([0.4, 0.2, 0.5, 0.5], [0.3, 0.52, 0.6, 0.8]), ([0.3, 0.3, 0.6, 0.6], [0.5, 0.4, 0.8, 0.7]), ([0.1, 0.1, 0.2, 0.2], [0.5, 0.6, 0.7, 0.8]), ([0.1, 0.5, 0.2, 0.6], [0.6, 0.5, 0.7, 0.6])]
    got = one(spark, g.relation_label(Box.of(F.col("a")), Box.of(F.col("b"))), pairs, "a array<double>, b array<double>")
    assert got == ["in", "standing on", "beside", "above", "next to"]


def test_edge_features(spark):
    r = np.random.default_rng(2)
    rows = []
    for _ in range(50):
        a, b = (sorted(r.uniform(0, 1, 2).tolist()) + sorted(r.uniform(0, 1, 2).tolist()) for _ in range(2))
        rows.append(([a[0], a[2], a[1], a[3]], [b[0], b[2], b[1], b[3]]))
    rows.append(([0.1, 0.1, 0.3, 0.3], [0.1, 0.1, 0.3, 0.3]))
    rows.append(([0.1, 0.1, 0.1, 0.3], [0.1, 0.1, 0.3, 0.3]))
    for (a, b), got in zip(rows, one(spark, g.edge_features(Box.of(F.col("a")), Box.of(F.col("b"))), rows, "a array<double>, b array<double>"), strict=True):
        dx, dy = (b[0] + b[2]) / 2 - (a[0] + a[2]) / 2, (b[1] + b[3]) / 2 - (a[1] + a[3]) / 2
        aw, ah, bw, bh = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
        inter = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        d = math.hypot(dx, dy)
        want = [d, dx, dy, dy / d if d else 0, dx / d if d else 1, inter / (aw * ah + bw * bh - inter + 1e-8), inter / (min(aw * ah, bw * bh) + 1e-8) if min(aw * ah, bw * bh) > 0 else 0]
        want += [math.log1p(bw * bh / (aw * ah + 1e-8)) if aw * ah > 0 else 0, math.log1p(bw / (aw + 1e-8)) if aw > 0 else 0, math.log1p(bh / (ah + 1e-8)) if ah > 0 else 0]
        assert got == pytest.approx(want, abs=1e-12)


def test_pixel_boxes(spark):
    p = g.from_pixels(*[F.lit(float(v)) for v in (64, 32, 128, 32, 640, 320)])
    assert one(spark, F.array(p.x1, p.y1, p.x2, p.y2)) == [pytest.approx([0.1, 0.1, 0.3, 0.2])]
    q = g.from_polygon(F.lit(json.loads("[[10, 20], [30, 5], [-4, 8]]")), F.lit(100.0), F.lit(50.0))
    assert one(spark, F.array(q.x1, q.y1, q.x2, q.y2)) == [pytest.approx([0.0, 0.1, 0.3, 0.4])]
    b = g.pixel_bounds(Box(*[F.lit(v) for v in (0.25, 0.75, 1.5, 0.0)]), F.lit(2), F.lit(2))
    assert one(spark, F.array(b.x1, b.y1, b.x2, b.y2)) == [[0, 2, 2, 0]]
    none = F.lit(None).cast("double")
    assert one(spark, F.array(g.clamp(none), g.from_grid(none, F.lit(5)), g.pixel_bounds(b, F.lit(None).cast("int"), F.lit(2)).x1.cast("double"))) == [[None] * 3]


def test_junk(spark):
    texts = ["1", "-", "0", "50", "50%", '"GIVE WAY"', "ab", "xyz", "  ab ", "１２３", None, ""]
    rows = [(x,) for x in texts]
    assert [x for x, j in zip(texts, one(spark, t.is_junk(F.col("s")), rows, "s string"), strict=True) if not j] == ["50%", '"GIVE WAY"', "xyz"]
    assert [x for x, j in zip(texts, one(spark, t.is_junk(F.col("s"), 0), rows, "s string"), strict=True) if not j] == ["-", "50%", '"GIVE WAY"', "ab", "xyz", "  ab ", None, ""]


def test_dynamic_filter(spark):
    scores = [0, 0.49, 0.5, 1, 0, 0.7, 0.2, 0]
    rows = spark.createDataFrame([(1, i, "text", float(s)) for i, s in enumerate(scores)], "ann_id long, det_pos int, text string, dynamic_score double")
    assert [r["det_pos"] for r in tf.drop_dynamic(rows).orderBy("det_pos").collect()] == [0, 1, 4, 6, 7]
    assert tf.drop_dynamic(rows, None).count() == 8
    holed = rows.unionByName(spark.createDataFrame([(2, 0, "1", None), (3, 0, "word", None)], rows.schema))
    with pytest.raises(Exception, match="no dynamic score"):
        tf.drop_dynamic(holed).collect()
    assert tf.retained(holed.where("ann_id < 3")).count() == 5
    assert tf.annotation_filter(holed).where("ann_id = 3").count() == 1
    assert tf.retained(rows, use_text=False).count() == 0


def test_keep_flagged(spark):
    df = [([1, 2, 3], [True, None, True])]
    assert one(spark, tf.keep_flagged(F.col("d"), F.col("f")), df, "d array<int>, f array<boolean>") == [[1, 3]]
    with pytest.raises(Exception, match="differ"):
        one(spark, tf.keep_flagged(F.col("d"), F.col("f")), [([1], [])], "d array<int>, f array<boolean>")


def test_classes(spark):
    rows = [(" Motorbike",), ("tvmonitor",), ("Screen",), ("Tree",), (None,)]
    assert one(spark, tf.canonical_class(F.col("c")), rows, "c string") == ["motorcycle", "tv", "tv", "tree", None]
    assert one(spark, tf.is_dynamic(F.col("c")), rows, "c string") == [True, True, True, False, False]
    boxes = spark.createDataFrame([("Car", 0.0, 0.0, 0.5, 0.5), ("tree", 0.0, 0.0, 0.5, 0.5), ("tree", 0.0, 0.0, 0.01, 0.01)], f"label string, {BOX}")
    assert [r["label"] for r in tf.drop_detections(boxes).collect()] == ["tree"]


def answers(spark, *texts):
    df = spark.createDataFrame([(i, x, 1000, 500) for i, x in enumerate(texts)], "key int, answer string, width int, height int")
    out: dict = {}
    for r in tf.word_answers(df).collect():
        out.setdefault(r["key"], []).append(r["error"] or (r["x"], r["y"], r["w"], r["h"], r["text"]))
    return [sorted(out.get(i, []), key=str) for i in range(len(texts))]


def test_recognizer_answers(spark):
    got = answers(
        spark,
        '```json\n[{"bbox": [100, 100, 300, 200], "text": " STOP "},]\n```', 'Sure: [1, 2] then [{"box": "<box>0 0 10 10</box>", "label": "x"}] end', "[]", "```json\n[ ]\n```", "[] and more", "none",
        '[{"bbox": [0, 0, 1001, 10], "text": "x"}]', '[{"bbox": [5, 5, 5, 10], "text": "x"}]', '[{"bbox": [0, 0, 10, 10], "text": 5}, {"bbox": [0, 0, 10, 10], "text": "y"}]', None,
    )
    assert got[0] == [(100.0, 50.0, 200.0, 50.0, "STOP")]
    assert got[1] == [(0.0, 0.0, 10.0, 5.0, "x")]
    assert got[2] == got[3] == []
    assert [len(x) == 1 and isinstance(x[0], str) for x in got[4:8]] == [True] * 4
    assert got[8] == [(0.0, 0.0, 10.0, 5.0, "y")]
    assert got[9] == ["no array of words"]


def test_predictions(spark):
    rows = spark.createDataFrame(
        [(1, 0, [64.0, 32.0, 128.0, 32.0], None, " OPEN ", None), (1, 1, None, [[0.0, 0.0], [64.0, 32.0]], "x", 0.5), (1, 2, [700.0, 0.0, 10.0, 10.0], None, "out", 0.5), (1, 3, [0.0, 0.0, 9.0, 9.0], None, "No Text", 0.5), (1, 4, None, None, "y", 0.1), (1, 5, [0.0, 0.0, 9.0, 9.0], None, None, 0.5)],
        "key int, pos int, bbox array<double>, polygon array<array<double>>, text string, confidence double",
    ).select("*", F.lit(640).alias("width"), F.lit(320).alias("height"))
    got = {r["pos"]: r for r in tf.predictions_to_detections(rows).collect()}
    assert sorted(got) == [0, 1]
    assert (got[0]["x1"], got[0]["x2"], got[0]["text"], got[0]["confidence"]) == (pytest.approx(0.1), pytest.approx(0.3), "OPEN", 1.0)
    assert got[1]["y2"] == pytest.approx(0.1)
    other = spark.createDataFrame([(1, 0, [64.0, 32.0, 128.0, 32.0], "OPEN", 0.25)], "key int, pos int, box array<double>, text string, score double").select("*", F.lit(640).alias("width"), F.lit(320).alias("height"), F.lit(None).cast("array<array<double>>").alias("polygon"))
    assert [(r["x1"], r["confidence"]) for r in tf.predictions_to_detections(other).collect()] == [(pytest.approx(0.1), 0.25)]


def files(spark, *docs):
    return spark.createDataFrame([(i, json.dumps(d) if not isinstance(d, str) else d) for i, d in enumerate(docs)], "file_id long, content string")


def graph(*nodes, links=()):
    return {"nodes": [{"id": i, "data": {"class_name": c, "bbox_2d": {"xyxy": b}}} for i, c, b in nodes], "links": [{"source": a, "target": b, "label": x} for a, b, x in links]}


def parsed(spark, *docs, dynamic=()):
    graphs = sg.graph_files(files(spark, *docs))
    nodes = sg.scene_nodes(sg.raw_nodes(graphs), dynamic)
    raw = sg.raw_edges(graphs)
    edges = sg.scene_edges(raw, nodes)
    return nodes, edges, sg.dropped_edges(raw, edges), sg.vocabulary(sg.raw_nodes(graphs), raw, dynamic)


def test_scene_graph(spark):
    nodes, edges, dropped, names = parsed(spark, graph((1, "building", [0.1, 0.1, 0.5, 0.5]), links=[(1, 1, "self"), (1, 9, "near")]))
    assert [(r["node"], r["class_name"]) for r in nodes.collect()] == [(0, "building")]
    assert [(r["src"], r["dst"], r["label"]) for r in edges.collect()] == [(0, 0, "self")]
    assert [(r["total"], r["dropped"]) for r in dropped.collect()] == [(2, 1)]
    assert {(r["kind"], r["name"], r["idx"]) for r in names.collect()} == {("node", "unknown", 0), ("node", "building", 1), ("edge", "unknown", 0), ("edge", "near", 1), ("edge", "self", 2)}


def test_dynamic_nodes_go_with_their_edges(spark):
    b = [0.1, 0.1, 0.5, 0.5]
    nodes, edges, dropped, names = parsed(spark, graph((1, "wall", b), (2, "Car", b), (3, "tree", b), links=[(1, 2, "near"), (1, 3, "next-to")]), dynamic=["car"])
    assert [r["class_name"] for r in nodes.orderBy("node").collect()] == ["wall", "tree"]
    assert [(r["src"], r["dst"], r["label"]) for r in edges.collect()] == [(0, 1, "next-to")]
    assert dropped.first()["dropped"] == 1
    assert "Car" not in {r["name"] for r in names.collect()}


def test_scene_graph_variants(spark):
    flat = {"nodes": [{"id": "a", "label": " shop ", "bbox": [-0.5, 0, 0.5, 2]}, {"id": 1, "bbox": [0.1, 0.1, 0.2, 0.2]}, {"id": "1", "class_name": "x", "bbox": [0.5, 0.5, 0.4, 0.6]}, 7, None], "edges": [{"source": "a", "target": 1, "type": "on"}, {"source": 1, "target": "1"}]}
    nodes, edges, _, _ = parsed(spark, flat, "not json", "", {"detections": []}, {"nodes": []}, [1])
    assert [(r["file_id"], r["pos"], r["class_name"], r["x1"], r["y2"]) for r in nodes.orderBy("node").collect()] == [(0, 0, "shop", 0.0, 1.0), (0, 1, "unknown", 0.1, 0.2)]
    assert [(r["src"], r["dst"], r["label"]) for r in edges.collect()] == [(0, 1, "on")]


def test_neighbours(spark):
    nodes, *_ = parsed(spark, graph((1, "building", [0.0, 0.0, 0.6, 0.6]), (2, "sign", [0.2, 0.2, 0.3, 0.3]), (3, "tree", [0.8, 0.2, 0.9, 0.4])))
    got = [(r["src"] + 1, r["dst"] + 1, r["label"]) for r in sg.neighbour_links(nodes).orderBy("src").collect()]
    assert got == [(1, 2, "beside"), (2, 1, "in"), (3, 1, "next to")]
    assert sg.neighbour_links(nodes, 2).count() == 6 and sg.neighbour_links(nodes, 0).count() == 0
    back = json.loads(sg.to_node_link(nodes, sg.neighbour_links(nodes)).first()["content"])
    assert [n["id"] for n in back["nodes"]] == [1, 2, 3] and len(back["links"]) == 3


def fused(spark):
    nodes = spark.createDataFrame([("f", 0, 5, 0.0, 0.0, 0.5, 0.5), ("f", 1, 6, 0.4, 0.4, 0.6, 0.6), ("f", 2, 7, 0.8, 0.8, 0.9, 0.9)], f"frame string, node int, class_idx int, {BOX}")
    strings = spark.createDataFrame([("f", 0, 0.42, 0.42, 0.48, 0.48, "in both"), ("f", 1, 0.95, 0.0, 1.0, 0.05, "far"), ("g", 0, 0.1, 0.1, 0.2, 0.2, "no object")], f"frame string, string int, {BOX}, text string")
    return nodes, strings


def test_attachment(spark):
    nodes, strings = fused(spark)
    of = lambda s, k=1: sorted((r["frame"], r["string"], r["node"]) for r in sg.attach_strings(strings, nodes, s, k).collect())
    assert of("overlap_nearest") == [("f", 0, 1), ("f", 1, 1)]
    assert of("overlap") == [("f", 0, 0), ("f", 0, 1)]
    assert of("nearest", 2) == [("f", 0, 0), ("f", 0, 1), ("f", 1, 0), ("f", 1, 1)]
    assert len(of("fully_connected")) == 6
    with pytest.raises(ValueError):
        of("closest")


def test_fusion_and_repair(spark):
    nodes, strings = fused(spark)
    every = sg.fused_nodes(nodes, strings)
    scene = spark.createDataFrame([("f", 0, 2, 0, 9)], "frame string, pos int, src int, dst int, label_idx int")
    edges = sg.fused_edges(every, scene, sg.attach_strings(strings, nodes))
    got = [(r["edge"], r["src"], r["dst"], r["label_idx"], r["is_text_edge"], r["src_class"], r["dst_class"]) for r in edges.orderBy("edge").collect()]
    assert got == [(0, 2, 0, 9, False, 7, 5), (1, 3, 1, 0, True, 0, 6), (2, 1, 3, 0, True, 6, 0), (3, 4, 1, 0, True, 0, 6), (4, 1, 4, 0, True, 6, 0)]
    assert [(r["frame"], r["node"]) for r in every.where("frame = 'g'").collect()] == [("g", 0)]
    broken = spark.createDataFrame([("f", 0, 1, [1.0, float("nan")]), ("f", 0, 7, [1.0]), ("f", -1, 0, [1.0])], "frame string, src int, dst int, features array<double>")
    assert [r["features"] for r in sg.repaired_edges(broken, nodes, 3).collect()] == [[1.0, 0.0, 0.0]]
    pooled = {r["frame"]: (r["x2_mean"], r["x2_max"]) for r in sg.pooled(nodes, spark.createDataFrame([("f",), ("empty",)], "frame string"), ["x2"]).collect()}
    assert pooled == {"f": (pytest.approx(2 / 3), 0.9), "empty": (0.0, 0.0)}


def test_normalizer(spark):
    rows = spark.createDataFrame([([1.0, 5.0, 0.0],), ([3.0, 5.0, 3.0],), ([5.0, 5.0, 8.0],)], "features array<double>")
    stats = {r["pos"]: (r["n"], r["mean"], r["std"]) for r in normalizer.fit(rows, log_columns=[2]).collect()}
    assert stats[0] == (3, 3.0, 2.0) and stats[1] == (3, 5.0, 0.0)
    assert stats[2][1] == pytest.approx(np.log1p([0, 3, 8]).mean())
    done = [r["features"] for r in normalizer.transform(rows, normalizer.fit(rows)).collect()]
    assert [f[0] for f in done] == pytest.approx([-1, 0, 1], abs=1e-5)
    alone = normalizer.fit(rows.limit(1)).collect()
    assert {r["std"] for r in alone} == {1.0}
    assert normalizer.transform(rows.limit(0), normalizer.fit(rows.limit(0))).count() == 0


def test_ngrams(spark):
    import zlib

    texts = ["PECLARD", "peclard", "PECLAR", "", None, "  ", "Ж"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got: dict = {}
    for r in tf.ngram_vectors(rows, "i", "s", 32).collect():
        got.setdefault(r["i"], {})[r["bucket"]] = r["weight"]
    p = "<peclard>"
    want = np.zeros(32)
    for n in (3, 4, 5):
        for i in range(len(p) - n + 1):
            want[zlib.crc32(p[i : i + n].encode()) % 32] += 1
    want /= np.linalg.norm(want)
    assert {k: v for k, v in enumerate(want) if v} == pytest.approx(got[0])
    assert got[0] == got[1] and set(got) == {0, 1, 2, 6}
    assert 0.5 < sum(got[0].get(k, 0) * v for k, v in got[2].items()) < 1


def test_shuffle_keeps_places_and_strings(spark):
    rows = spark.createDataFrame([(i // 3, i % 3, f"t{i}" if i else None) for i in range(60)], "ann_id long, det_pos int, text string")
    a, b = (tf.shuffled_texts(rows, 1).orderBy("ann_id", "det_pos").collect() for _ in range(2))
    assert a == b
    assert [(r["ann_id"], r["det_pos"]) for r in a] == [(i // 3, i % 3) for i in range(60)]
    assert sorted(str(r["text"]) for r in a) == sorted(str(f"t{i}" if i else None) for i in range(60))
    assert [r["text"] for r in a] != [r["text"] for r in tf.shuffled_texts(rows, 2).orderBy("ann_id", "det_pos").collect()]


def test_text_functions(spark):
    texts = ["1787823716.199182034", "5", "1.5", "1e9", "-2.25", "1.1234567899", "", None, " 7 "]
    assert one(spark, t.seconds_to_ns(F.col("s")), [(x,) for x in texts], "s string") == [1787823716199182034, 5_000_000_000, 1_500_000_000, None, -2_000_000_000 + 250_000_000, 1_123_456_789, None, None, 7_000_000_000]
    assert one(spark, F.array(t.stem_index(F.col("s")).cast("string"), t.stem_stamp(F.col("s")).cast("string")), [("000012_1390761755836903968",), ("12_3",)], "s string") == [["12", "1390761755836903968"], [None, None]]
    assert one(spark, t.camera_stem(F.col("c"), F.lit("150"), "front"), [("front",), ("left",)], "c string") == ["150", "left-150"]
    assert one(spark, t.label_or_unknown(F.col("a"), F.col("b")), [(None, " x "), (" ", "y"), (None, None)], "a string, b string") == ["x", "unknown", "unknown"]


def test_vectors(spark):
    inf = float("inf")
    assert one(spark, vectors.repaired(F.col("v"), 4), [([1.0, float("nan"), inf],), ([1.0, 2.0, 3.0, 4.0, 5.0],), (None,)], "v array<double>") == [[1.0, 0.0, vectors.LARGEST, 0.0], [1.0, 2.0, 3.0, 4.0], [0.0] * 4]
    assert one(spark, vectors.unit(F.col("v")), [([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>") == [[0.6, 0.8], [0.0, 0.0]]
    assert one(spark, vectors.is_vector(F.col("v"), 2), [([3.0, 4.0],), ([0.0, inf],), ([1.0],), (None,)], "v array<double>") == [True, False, False, False]


def test_masks(spark):
    r = np.random.default_rng(1)
    for shape in ((1, 1), (7, 5), (40, 33)):
        for p in (0.02, 0.5, 0.98, 1.0):
            m = r.random(shape) < p
            coded = masks.encode_mask(m)
            assert (coded is None) == (not m.any())
            assert (masks.decode_mask(coded, shape) == m).all()
    block = np.zeros((10, 10), bool)
    block[:, :5] = True
    assert masks.covered_fraction([0.0, 0.0, 1.0, 1.0], block) == 0.5
    assert masks.covered_fraction([0.4, 0.0, 0.6, 1.0], block) == 0.5
    assert masks.covered_fraction([0.5, 0.5, 0.51, 0.51], block) == 0.0
    assert masks.fitted(block, (20, 20)).sum() == 200
    assert masks.union([block, ~block], (10, 10)).all()
    df = spark.createDataFrame([([[0.0, 0.0, 0.5, 1.0]], [[0.0, 0.0, 1.0, 1.0], [0.75, 0.0, 1.0, 1.0]]), ([], [[0.0, 0.0, 1.0, 1.0]]), (None, [])], "o array<array<double>>, b array<array<double>>")
    coded = df.withColumn("m", masks.mask_of_boxes(F.col("o"), F.lit(20), F.lit(10)))
    assert [x[0] for x in coded.select(masks.dynamic_scores(F.col("b"), F.col("m"), F.lit(20), F.lit(10))).collect()] == [[0.5, 0.0], [0.0], []]


def test_documents(spark):
    rows = spark.createDataFrame([(1, "f", [10, 5], {"m": "x"}, [([0.1, 0.1, 0.2, 0.2], "a", 0.5, None), ([0.1, 0.1, 0.2, 0.2], "b", 0.5, 0.25)], 1), (2, "g", [10, 5], None, None, 1)], "ann_id long, frame_id string, image_size array<int>, model_identity map<string,string>, detections array<struct<box: array<double>, text: string, confidence: double, dynamic_score: double>>, written_at long")
    docs = documents.frame_text_to_json(rows)
    text = {r["ann_id"]: json.loads(r["content"]) for r in docs.collect()}
    assert "dynamic_score" not in text[1]["detections"][0] and text[1]["detections"][1]["dynamic_score"] == 0.25
    assert [(r["text"], r["dynamic_score"]) for r in documents.frame_text_rows(docs.where("ann_id = 1"), strict=True).orderBy("det_pos").collect()] == [("a", None), ("b", 0.25)]
    for bad in ('{"image_size": [0, 5], "detections": []}', '{"image_size": [9, 5], "detections": [{"box": [0, 0, 0, 1], "text": "x", "confidence": 1}]}', "{"):
        with pytest.raises(Exception, match="not a valid annotation"):
            documents.frame_text_rows(spark.createDataFrame([(9, bad)], "ann_id long, content string"), strict=True).collect()


def test_acceptance(spark):
    b = [0.1, 0.1, 0.5, 0.5]
    docs = [
        ("a/graphs/g/s/1.json", {"graph": {"scene_name": "other"}, **graph((1, "car", b), (2, "tree", [0.1, 0.1, 0.1, 0.5]), links=[(1, 7, "x")])}),
        ("a/text/t/s/1.json", {"frame_id": "1", "detections": []}), ("a/graphs/g/s/2.json", {"nodes": []}), ("a/text/t/s/2.json", {"frame_id": 2, "detections": []}),
    ]
    stored = spark.createDataFrame([(i, p, json.dumps(d)) for i, (p, d) in enumerate(docs)], "file_id long, file_path string, content string")
    frames = spark.createDataFrame([("s", 1, "a/text/t/s/1.json", "a/graphs/g/s/1.json"), ("s", 2, None, "A\\graphs\\g\\s\\2.json"), ("s", 2, "a/text/t/s/2.json", None), ("s", 3, "a/text/t/s/3.json", "a/graphs/g/s/2.json")], "sequence string, idx long, text_path string, graph_path string")
    got = checks.summary(frames, stored).first().asDict()
    assert {k: got[k] for k in checks.KINDS} == {"missing_text": 1, "missing_graph": 0, "dynamic_nodes": 1, "degenerate_boxes": 1, "dangling_edges": 1, "binding_errors": 1}
    assert not got["accepted"] and got["frames"] == 3 and got["empty_graphs_percent"] == 50.0
    empty = checks.summary(frames.limit(0), stored.limit(0)).first()
    assert empty["accepted"] and empty["frames"] == 0

from __future__ import annotations

import json
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbstone import config, pipeline, streaming
from kerbstone.config import ConfigError, settings_from
from kerbstone.functions import hashing
from kerbstone.operators.checks import examples
from kerbstone.operators.encoder import Encoder, Shape, encode_frames, random_weights
from kerbstone.registry import Registry, default_registry
from kerbstone.sources import catalog, readers, writers

SMALL = dict(node_classes=5, edge_classes=4, text=6, hidden=8, out=7, node_emb=3, edge_emb=3, heads=2)


def frame(texts=2, objects=3, seed=0):
    r = np.random.default_rng(seed)
    n = objects + texts
    is_text = np.arange(n) >= objects
    src = np.array([*[0, 1, 2][:objects], *[i for k in range(texts) for i in (objects + k, 0)]])
    dst = np.array([*[1, 2, 0][:objects], *[i for k in range(texts) for i in (0, objects + k)]])
    text_edge = np.array([False] * min(3, objects) + [True] * (2 * texts))
    text = np.where(is_text[:, None], r.normal(size=(n, 6)), 0.0)
    return [r.random((n, 4)), np.where(is_text, 0, r.integers(1, 5, n)), is_text, text, src, dst, r.normal(size=(len(src), 10)), np.where(text_edge, 0, 1), text_edge]


def without_text(f):
    keep, kept = ~f[2], ~f[8]
    return [f[0][keep], f[1][keep], f[2][keep], f[3][keep], f[4][kept], f[5][kept], f[6][kept], f[7][kept], f[8][kept]]


@pytest.mark.parametrize("fusion", ["node", "additive", "set"])
def test_encoder(fusion):
    s = Shape(**SMALL, fusion=fusion)
    enc = Encoder(s, random_weights(s, 3))
    f = frame()
    d = enc.encode(*f)
    assert d.shape == (7,) and np.linalg.norm(d) == pytest.approx(1)
    bare = enc.encode(*without_text(f))
    assert not np.allclose(d, bare)
    if fusion != "node":  # a string that says nothing adds nothing where its term has no bias
        scene = Encoder(Shape(**SMALL, fusion=fusion), {**enc.w, **({"text_add.w": 0 * enc.w["text_add.w"]} if fusion == "additive" else {"text_out.w": 0 * enc.w["text_out.w"]})})
        assert np.allclose(scene.encode(*f), bare)
    empty = enc.encode(*(x[:0] for x in f))
    assert np.linalg.norm(empty) == pytest.approx(1)
    order = np.array([2, 0, 1, 4, 3])
    place = np.argsort(order)
    moved = [f[0][order], f[1][order], f[2][order], f[3][order], place[f[4]], place[f[5]], *f[6:]]
    assert np.allclose(enc.encode(*moved), d)
    with pytest.raises(ValueError):
        enc.encode(f[0], f[1] + 9, *f[2:])


def test_encoder_knows_a_set_from_its_sum():
    s = Shape(**SMALL, fusion="set")
    enc = Encoder(s, random_weights(s, 3))
    f = frame()
    other = [x.copy() for x in f]
    other[3][3], other[3][4] = f[3][3] + f[3][4], 0.0
    assert not np.allclose(enc.encode(*f), enc.encode(*other))


def test_attention_against_one_edge_at_a_time():
    s = Shape(**SMALL)
    enc = Encoder(s, random_weights(s, 1))
    r = np.random.default_rng(4)
    x, src, dst, e = r.normal(size=(4, 8)), np.array([0, 1, 2, 3, 1, 2]), np.array([1, 2, 1, 3, 1, 0]), r.normal(size=(6, 8))
    got = enc._attend(x, src, dst, e, 0)
    w = enc.w
    left, right = (x @ w[f"conv0.{k}.w"].T + w[f"conv0.{k}.b"] for k in ("source", "target"))
    for i in range(4):
        incoming = [(a, e[k]) for k, (a, b) in enumerate(zip(src, dst, strict=True)) if b == i and a != b]
        incoming.append((i, np.mean([v for _, v in incoming], axis=0) if incoming else np.zeros(8)))
        heads = []
        for h in range(2):
            part = slice(8 * h, 8 * h + 8)
            z = [left[a][part] + right[i][part] + (v @ w["conv0.edge.w"].T)[part] for a, v in incoming]
            score = np.array([np.where(q > 0, q, 0.2 * q) @ w["conv0.attention"][h] for q in z])
            p = np.exp(score - score.max())
            heads.append(sum(q * left[a][part] for q, (a, _) in zip(p / p.sum(), incoming, strict=True)))
        assert np.allclose(got[i], np.mean(heads, axis=0) + x[i] @ w["conv0.residual.w"].T + w["conv0.bias"])


def test_prepare_and_describe(spark, small):
    files, texts = (spark.read.parquet(f"{small}/{t}.parquet").limit(60) for t in ("annotation_files", "frame_texts"))
    s = config.settings_from({"model": {"hidden_dim": 8, "proj_dim": 7, "heads": 2}, "preprocess": {"text_dim": 16, "dynamic_node_classes": ["Car"], "dynamic_text_threshold": None}})
    with pytest.raises(Exception, match="no dynamic score"):
        pipeline.prepare(files, texts, config.settings_from({}))["graphs"].collect()
    done = pipeline.prepare(files, texts, s)
    shape = pipeline.shape_of(done["vocabulary"], s)
    got = encode_frames(done["graphs"], shape, random_weights(shape)).collect()
    assert len(got) == done["graphs"].count() == len({r["frame"] for r in got}) > 20
    assert all(np.linalg.norm(r["v"]) == pytest.approx(1) for r in got)
    off = config.settings_from({"model": {"hidden_dim": 8, "proj_dim": 7, "heads": 2}, "preprocess": {"use_text_nodes": False, "dynamic_text_threshold": None}})
    assert pipeline.prepare(files, texts, off)["graphs"].where(F.exists("nodes", lambda n: n["is_text"])).count() == 0


def test_evaluate(spark):
    v = lambda rows: spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(rows)], "id long, v array<double>")
    s = config.settings_from({"retrieval": {"top_k": 3, "rerank_depth": 2}, "training": {"recall_values": [1, 2]}})
    q, d = v([(1, 0)]), v([(1, 0), (0.9, 0.1), (0, 1)])
    positives = spark.createDataFrame([(0, 1)], "q long, d long")
    _, recall = pipeline.evaluate(q, d, positives, s)
    assert {r["k"]: r["recall"] for r in recall.collect()} == {1: 0.0, 2: 100.0}
    nearest, recall = pipeline.evaluate(q, d, positives, s, v([(0, 1)]), v([(1, 0), (0, 1), (0, 1)]))
    assert [r["d"] for r in nearest.orderBy("rank").collect()] == [1, 0]
    assert {r["k"]: r["recall"] for r in recall.collect()} == {1: 100.0, 2: 100.0}


def test_transfer():
    s = Shape(**SMALL)
    a = {"node_class_to_idx": {"unknown": 0}, "edge_label_to_idx": {"unknown": 0}, "text_encoder": "char_ngram", "text_dim": 6}
    assert pipeline.transfer_problems(a, a, s) == []
    assert len(pipeline.transfer_problems(a, {**a, "text_dim": 7}, s)) == 2
    assert pipeline.transfer_problems(a, {**a, "node_class_to_idx": {str(i): i for i in range(9)}}, s)


def test_split_documents(spark):
    s = config.settings_from({})
    parts = spark.createDataFrame([(0, "train", False), (1, "test", False), (2, "test", True)], "q long, part string, excluded boolean")
    positives = spark.createDataFrame([(0, 5), (0, 4), (1, 5)], "q long, d long")
    doc = pipeline.split_document(parts, positives, s)
    assert doc["positives"] == {0: [4, 5], 1: [5]} and doc["test_query_indices"] == [1] and doc["excluded_test_query_indices"] == [2] and doc["validation_query_indices"] == []
    pipeline.check_split(doc, s)
    with pytest.raises(ValueError, match="split_fold"):
        pipeline.check_split(doc, config.settings_from({"dataset": {"split_fold": 1, "split_fold_count": 3}}))
    with pytest.raises(ValueError, match="no test"):
        pipeline.split_document(parts.where("part = 'train'").drop("excluded"), positives, s)
    frames = spark.createDataFrame([("seq1",), ("seq2",), ("seq2",)], "sequence string")
    assert pipeline.validate(s, frames) == {"seq1": 1, "seq2": 2}
    with pytest.raises(ValueError, match="seq2"):
        pipeline.validate(s, frames.where("sequence = 'seq1'"))
    assert pipeline.fingerprint(s) != pipeline.fingerprint(config.settings_from({"preprocess": {"connection_k": 2}}))
    assert pipeline.fingerprint(s) == pipeline.fingerprint(config.settings_from({"retrieval": {"top_k": 5}}))


def test_checkpoints(tmp_path):
    s = Shape(**SMALL)
    w = random_weights(s, 3)
    pipeline.save_checkpoint(str(tmp_path / "c"), s, w, {"a": 1}, 4)
    shape, weights, epoch = pipeline.load_checkpoint(str(tmp_path / "c"), {"a": 1})
    assert shape == s and epoch == 4 and np.allclose(Encoder(shape, weights).encode(*frame()), Encoder(s, w).encode(*frame()))
    with pytest.raises(ValueError):
        pipeline.load_checkpoint(str(tmp_path / "c"), {"a": 2})


def test_small_driver_functions():
    from kerbstone.functions.text import fill_template

    assert pipeline.epochs_without_improvement([1, 3, 2, 3, 1]) == 3 and pipeline.epochs_without_improvement([]) == 0
    assert pipeline.epochs_without_improvement([3, 1, 1, 1], warm_up=2) == 2
    assert fill_template("{sequence}/graphs", sequence="s") == "s/graphs"
    with pytest.raises(ValueError):
        fill_template("{sequence}/{camera}", sequence="s")


@pytest.mark.parametrize(
    "bad",
    [
        {"unknown": 1}, {"dataset": {"radius": 1}}, {"dataset": {"test_ratio": "0.2"}}, {"training": {"negatives_per_query": True}}, {"dataset": {"test_ratio": 0.6, "validation_ratio": 0.5}},
        {"dataset": {"query_sequence": "seq1"}}, {"dataset": {"split_guard": "ground_truth_blocks"}}, {"training": {"recall_values": [5, 1]}}, {"preprocess": {"connection_strategy": "x"}}, {"retrieval": {"backend": "x"}},
        {"dataset": {"gt_radius_m": float("inf")}}, {"dataset": {"split_fold_count": 4}}, {"training": {"positive_max_distance_m": 1, "positive_interval_fraction": 0.5}}, {"cache_policy": "x"}, {"dataset": []},
    ],
)
def test_settings_are_strict(bad):
    with pytest.raises(config.ConfigError):
        config.settings_from(bad)


def test_settings_round_trip(tmp_path):
    s = config.settings_from({"dataset": {"gt_radius_m": 10}, "preprocess": {"dynamic_text_threshold": None}})
    assert s.dataset.gt_radius_m == 10.0
    config.dump_settings(s, str(tmp_path / "s.yaml"))
    assert config.load_settings(str(tmp_path / "s.yaml")) == s


def test_registry():
    r = Registry()
    r.register("miner", " Hard-Negative ")(len)
    assert r.get("miner", "hard_negative") is len and r.create("miner", "HARD-negative", [1, 2]) == 2 and r.contains("miner", "hard-negative")
    for wrong in (lambda: r.add("miner", "hard_negative", 1), lambda: r.add("miner", " ", 1), lambda: r.get("miner", "x"), lambda: r.available("kind")):
        with pytest.raises((ValueError, KeyError)):
            wrong()
    assert r.add("miner", "hard_negative", sum, replace=True) is r.get("miner", "hard_negative")
    assert "char_ngram" in default_registry().available("encoder")


def test_identities():
    assert hashing.settings_fingerprint({"b": 1, "a": [2]}) == hashing.settings_fingerprint({"a": [2], "b": 1})
    assert hashing.callable_identity(test_registry)["name"] == "test_registry"

    class Stateful:
        def __call__(self):
            return 1

    with pytest.raises(ValueError):
        hashing.callable_identity(Stateful())
    assert hashing.positives_digest({10: [2, 1], 2: []}) == hashing.positives_digest({2: [], 10: [1, 2]})


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_readers(spark, tmp_path):
    log = write(tmp_path / "ins.csv", "timestamp,northing,easting\n300,1,2\n100,3,4\n,5,6\nx,1,1\n200,7,\n")
    assert [tuple(r) for r in readers.ins_track(spark, log).collect()] == [(100, 3.0, 4.0), (300, 1.0, 2.0)]
    with pytest.raises(ValueError):
        readers.ins_track(spark, write(tmp_path / "none.csv", "timestamp,northing,easting\n,,\n"))
    poses = write(tmp_path / "poses.csv", "image,timestamp,tx,ty,tz,qx,qy,qz,qw\na/7.png,1787823716.199182034,1,2,3,0,0,0,1\n8.png,5,1,2,3,0,0,0,1\n")
    known = readers.poses(spark, poses)
    assert {r["stem"]: r["ts"] for r in known.collect()} == {"7": 1787823716199182034, "8": 5_000_000_000}
    assert readers.with_poses(spark.createDataFrame([("7", 0)], "stem string, ts long"), known).first()["tz"] == 3.0
    with pytest.raises(ValueError, match="no pose for 9"):
        readers.with_poses(spark.createDataFrame([("9",)], "stem string"), known)
    with pytest.raises(ValueError, match="has 2 poses"):
        readers.poses(spark, write(tmp_path / "twice.csv", "image,timestamp,tx,ty,tz\na.png,1,1,1,1\nb/a.jpg,2,1,1,1\n"))
    assert {r["stem"] for r in readers.frame_list(spark, write(tmp_path / "list", "# x\n\nbase/1\n 2 \n")).collect()} == {"1", "2"}
    with pytest.raises(ValueError):
        readers.frame_list(spark, write(tmp_path / "list2", "# x\n"))
    loops = readers.correspondences(spark, write(tmp_path / "loops.txt", "# c\n5\n\n7, 1,2\n"))
    assert [tuple(r) for r in loops.orderBy("line").collect()] == [(2, 5, None, None), (4, 7, 1, 2)]
    with pytest.raises(ValueError, match=":2:"):
        readers.correspondences(spark, write(tmp_path / "bad.txt", "5\n7,1\n"))
    names = write(tmp_path / "manifest.json", json.dumps({"node_class_to_idx": {"unknown": 0, "x": 1}, "edge_label_to_idx": {"unknown": 0}}))
    assert readers.vocabularies(spark, names).count() == 3
    with pytest.raises(ValueError):
        readers.vocabularies(spark, write(tmp_path / "m2.json", json.dumps({"node_class_to_idx": {"unknown": 0, "x": 2}, "edge_label_to_idx": {"unknown": 0}})))
    folds = readers.fold_assignment(spark, write(tmp_path / "folds.json", json.dumps({"folds": 1, "assignment": {"0": {"train": ["1", "2"], "test": ["3"]}}})))
    assert {tuple(r) for r in folds.collect()} == {(0, "train", "1"), (0, "train", "2"), (0, "test", "3")}
    writers.save_arrays(str(tmp_path / "d/seq.npz"), {"frame_ids": np.array(["7"]), "descriptors": np.ones((1, 3), np.float32)})
    assert [tuple(r) for r in readers.image_descriptors(spark, str(tmp_path / "d")).collect()] == [("seq", "7", [1.0, 1.0, 1.0])]
    for n in ("b.PNG", "a.jpg", "c.txt", "d.jpeg"):
        write(tmp_path / "img" / n, "x")
    assert [r["stem"] for r in readers.images(spark, str(tmp_path / "img"), 2).orderBy("stem").collect()] == ["a", "d"]


def test_indexed_records(spark, tmp_path):
    for i in range(3):
        for k in ("text", "graph"):
            write(tmp_path / k / f"{i:06d}_{10 + i:019d}.json", "{}")
    read = lambda **more: readers.indexed_records(spark, str(tmp_path / "text"), str(tmp_path / "graph"), "s", **more)
    assert [(r["idx"], r["ts"]) for r in read().orderBy("idx").collect()] == [(0, 10), (1, 11), (2, 12)]
    assert readers.json_documents(spark, str(tmp_path / "text")).count() == 3
    os.unlink(tmp_path / "text" / f"{1:06d}_{11:019d}.json")
    with pytest.raises(ValueError, match="no text annotation"):
        read()
    assert read(require_text=False).count() == 3
    os.unlink(tmp_path / "graph" / f"{1:06d}_{11:019d}.json")
    with pytest.raises(ValueError, match="gaps"):
        read(require_text=False)
    assert hashing.file_identities(spark, str(tmp_path / "text")).count() == 2


def test_catalog(spark):
    rows = spark.createDataFrame([("front", "t", "100"), ("front", "t", "200"), ("left", "t", "150"), ("right", "t", "150"), ("other", "t", "1")], "camera string, traversal string, stem string")
    got = [(r["stem"], r["frame_index"]) for r in catalog.camera_frames(rows, ["front", "left", "right"]).orderBy("frame_index").collect()]
    assert got == [("100", 0), ("200", 1), ("left-150", 2), ("right-150", 3)]
    frames = spark.createDataFrame([("s", "10"), ("s", "9"), ("s", "9"), ("s", None), ("s", "x")], "sequence string, stem string")
    got = [(r["stem"], r["frame_index"]) for r in catalog.indexed_frames(frames, pattern=r"^\d+$").orderBy("frame_index").collect()]
    assert got == [("10", 0), ("9", 1)]
    assert catalog.indexed_frames(frames, allowed=spark.createDataFrame([("9",)], "stem string")).count() == 1


def test_writers(spark, tmp_path):
    near = spark.createDataFrame([(0, 1, 5, 0.5)], "q long, rank int, d long, score double")
    writers.save_retrievals(near, spark.createDataFrame([(1, 50.0)], "k int, recall double"), str(tmp_path))
    assert json.loads((tmp_path / "final_metrics.json").read_text()) == {"R@1": 50.0}
    part = lambda s, x: spark.createDataFrame([(s, x)], "sequence string, x int")
    for s, x in (("a", 1), ("b", 2), ("a", 3)):
        writers.save_table(part(s, x), str(tmp_path / "t"), "sequence")
    assert {(r["sequence"], r["x"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", 3), ("b", 2)}
    with pytest.raises(TypeError):
        writers.save_json({"a": object()}, str(tmp_path / "x.json"))
    assert not (tmp_path / "x.json").exists()


def test_streams(spark, tmp_path):
    rows = [("s", i, 10 + i, [i, i + 1, -1]) for i in range(4)] + [("r", 0, 30, [7])]
    schema = "sequence string, row long, q long, candidates array<long>"
    source = str(tmp_path / "in")
    spark.createDataFrame(rows[:2] + rows[4:], schema).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    q = streaming.sequence_pool(stream, 2).writeStream.format("memory").queryName("pools").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    spark.createDataFrame([*rows[2:4], rows[0]], schema).write.mode("append").parquet(source)
    q.processAllAvailable()
    q.stop()
    got = {(r["sequence"], r["row"]): r["pool"] for r in spark.table("pools").collect()}
    assert got == {("s", 0): [0, 1], ("s", 1): [0, 1, 2], ("s", 2): [1, 2, 3], ("s", 3): [2, 3, 4], ("r", 0): [7]}
    spark.createDataFrame([([1.0, 2.0],), ([3.0, 2.0],)], "features array<double>").write.parquet(str(tmp_path / "f"))
    m = streaming.running_moments(spark.readStream.schema("features array<double>").parquet(str(tmp_path / "f")))
    q = m.writeStream.format("memory").queryName("moments").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["pos"]: (r["n"], r["mean"], round(r["std"], 6)) for r in spark.table("moments").collect()} == {0: (2, 2.0, 1.414214), 1: (2, 2.0, 0.0)}


def test_entry_without_the_llm_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("kerbstone", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", f"{root}/{name}", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "kerbstone/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p2_found' in q and not {n for n in q if n.startswith(('p3_', 'p10_'))}; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_every_sql_belongs_to_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def split_of(spark, payload, folds=None, n=20):
    q = spark.createDataFrame([(i, float(i * 100), 0.0, f"{i}") for i in range(n)], "q long, x double, y double, stem string")
    truth = spark.createDataFrame([(i, i // 2) for i in range(n)], "q long, d long")
    got = pipeline.make_split(q, truth, settings_from({"dataset": payload}), folds)
    return {r["q"]: (r["part"], r["excluded"]) for r in got.collect()}


def test_split_by_settings(spark):
    plain = split_of(spark, {"adapter": "walk"})
    assert [p for _, (p, _) in sorted(plain.items())] == ["train"] * 15 + ["validation"] + ["test"] * 4 and not any(x for _, x in plain.values())
    guarded = split_of(spark, {"adapter": "walk", "split_guard": "ground_truth_overlap"})
    assert {q for q, (_, out) in guarded.items() if out} == {15} and {q: p for q, (p, _) in guarded.items()} == {q: p for q, (p, _) in plain.items()}
    blocks = split_of(spark, {"adapter": "walk", "split_guard": "ground_truth_blocks", "validation_ratio": 0.25, "validation_centres": [0.3, 0.7]})
    assert sum(p == "validation" for p, _ in blocks.values()) == 4
    assert sum(p == "test" for p, _ in split_of(spark, {"adapter": "drive", "gt_radius_m": 50.0}).values()) == 4
    ride = split_of(spark, {"adapter": "ride", "split_fold": 1, "split_fold_count": 4})
    assert [q for q, (p, _) in sorted(ride.items()) if p == "test"] == [5, 6, 7, 8, 9]
    assert {p for p, _ in split_of(spark, {"adapter": "ride"}).values()} == {"test"}
    folds = spark.createDataFrame([(0, "test", "1"), (0, "train", "2"), (1, "test", "3")], "fold int, part string, stem string")
    assert split_of(spark, {"adapter": "drive", "split_fold": 0}, folds) == {1: ("test", False), 2: ("train", False)}
    with pytest.raises(ValueError, match="fold"):
        split_of(spark, {"adapter": "drive", "split_fold": 7}, folds)
    with pytest.raises(ConfigError):
        settings_from({"dataset": {"split_guard": "blocks"}})
    assert pipeline.fold_gap_us(settings_from({})) == 300_000


def test_training_positives_by_settings(spark):
    truth = spark.createDataFrame([(0, d) for d in range(8)] + [(1, 3), (1, 4)], "q long, d long")
    sides = (spark.createDataFrame([(0, "front"), (1, None)], "q long, group string"), spark.createDataFrame([(d, "front" if d % 2 else "left") for d in range(8)], "d long, group string"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    kept, ignored = pipeline.training_positives(truth, settings_from({"training": {"positive_interval_fraction": 0.5, "same_camera_triplets": True}}), groups=sides)
    assert rows(kept) == [(0, 3), (0, 5)]
    assert rows(ignored) == sorted(set(map(tuple, truth.collect())) - {(0, 3), (0, 5)})
    assert rows(pipeline.training_positives(truth, settings_from({}))[0]) == rows(truth)
    near = settings_from({"training": {"positive_max_distance_m": 5.0}})
    assert rows(pipeline.training_positives(truth, near, truth.where("d = 3"))[0]) == [(0, 3), (1, 3)]
    with pytest.raises(ValueError):
        pipeline.training_positives(truth, near)
    with pytest.raises(ValueError):
        pipeline.training_positives(truth, settings_from({"training": {"same_camera_triplets": True}}))


def test_normalizer_sees_training_only(spark):
    edges = spark.createDataFrame([("a", False, [1.0]), ("a", True, [5.0]), ("b", False, [3.0]), ("c", False, [100.0])], "frame string, is_text boolean, features array<double>")
    frames = spark.createDataFrame([("a",), ("b",), ("b",)], "frame string")
    mean = lambda fusion: pipeline.fit_normalizer(edges, frames, settings_from({"model": {"text_fusion": fusion}})).first()["mean"]
    assert (mean("set"), mean("additive")) == (3.0, 2.0)


def test_first_examples_of_defects(spark):
    found = spark.createDataFrame([("a", f"f{i:02d}") for i in range(9)] + [("a", "f00"), ("b", "x")], "kind string, place string")
    got = {r["kind"]: (r["n"], r["places"]) for r in examples(found).collect()}
    assert got == {"a": (10, ["f00", "f01", "f02", "f03", "f04"]), "b": (1, ["x"])}

"""From annotated frames to ranked places: prepare, describe, search and score, and whether a model may be transferred."""

from __future__ import annotations

import dataclasses
import json
import os
from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbstone.config import Settings
from kerbstone.functions.geometry import Box, is_valid_box
from kerbstone.functions.hashing import positives_digest, settings_fingerprint
from kerbstone.operators import encoder, normalizer, parts, retrieval
from kerbstone.operators import scene_graph as sg
from kerbstone.operators import text_filters as tf
from kerbstone.sources.writers import save_arrays, save_json


def prepare(files: DataFrame, frame_texts: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """``graphs`` (frame, nodes, edges) and ``vocabulary`` of annotation files and strings per frame.

    A frame is the stem of its file; of several graphs of a frame the one with the largest id counts, of several annotations
    the largest ann_id. A string without a score fails the query, unless the filter of moving texts is off.
    """
    p = settings.preprocess
    graphs = sg.graph_files(files.select("file_id", "content"))
    raw_nodes, raw_edges = sg.raw_nodes(graphs), sg.raw_edges(graphs)
    nodes = sg.scene_nodes(raw_nodes, p.dynamic_node_classes)
    edges = sg.scene_edges(raw_edges, nodes)
    names = sg.vocabulary(raw_nodes, raw_edges, p.dynamic_node_classes)
    stem = F.regexp_replace(F.element_at(F.split(F.translate("file_path", "\\", "/"), "/"), -1), r"\.[^.]*$", "")
    latest = files.join(graphs.select("file_id"), "file_id").groupBy(stem.alias("frame")).agg(F.max("file_id").alias("file_id"))
    objects = sg.with_index(nodes.join(latest, "file_id"), names, "node", "class_name", "class_idx").select("frame", "node", "class_idx", "x1", "y1", "x2", "y2")
    scene = sg.with_index(edges.join(latest, "file_id"), names, "edge", "label", "label_idx").select("frame", "pos", "src", "dst", "label_idx")

    rows = tf.detection_rows(frame_texts).where(is_valid_box(F.col("box")))
    if not p.use_text_nodes:
        rows = rows.where(F.lit(False))
    rows = tf.drop_junk(rows, p.text_min_length, p.text_drop_numeric)
    rows = tf.drop_dynamic(rows, p.dynamic_text_threshold)
    if p.shuffle_text_seed is not None:
        rows = tf.shuffled_texts(rows, p.shuffle_text_seed)
    newest = rows.groupBy("frame_id").agg(F.max("ann_id").alias("ann_id"))
    strings = rows.join(newest, ["frame_id", "ann_id"]).select(F.col("frame_id").alias("frame"), "text", "det_pos", *Box.of(F.col("box")).columns())
    strings = strings.withColumn("string", F.row_number().over(Window.partitionBy("frame").orderBy("det_pos")) - 1)

    fused = sg.fused_nodes(objects, strings)
    linked = sg.fused_edges(fused, scene, sg.attach_strings(strings, objects, p.connection_strategy, p.connection_k))
    vectors = tf.ngram_vectors(strings.select("text").distinct(), "text", "text", p.text_dim)
    frames = latest.select("frame").unionByName(strings.select("frame")).distinct()
    return {"graphs": encoder.assemble(fused, linked, vectors, frames, p.text_dim), "vocabulary": names}


def shape_of(vocabulary: DataFrame, settings: Settings) -> encoder.Shape:
    """The encoder's widths for a vocabulary."""
    sizes = {r["kind"]: r["n"] for r in vocabulary.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    m = settings.model
    return encoder.Shape(sizes["node"], sizes["edge"], settings.preprocess.text_dim, m.hidden_dim, m.proj_dim, heads=m.heads, layers=m.n_layers, fusion=m.text_fusion, edge_geometry=m.use_edge_geometry)


def evaluate(queries: DataFrame, database: DataFrame, positives: DataFrame, settings: Settings, image_queries: DataFrame | None = None, image_database: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nearest, recall) of descriptors (id, v), with a second stage by image descriptors where they are given."""
    r, cutoffs = settings.retrieval, settings.training.recall_values
    depth = max(r.top_k, max(cutoffs), r.rerank_depth)
    nearest = retrieval.top_k(queries, database, depth)
    if image_queries is not None and image_database is not None:
        first = nearest.where(F.col("rank") <= (r.rerank_depth or depth)).select("q", F.col("q").alias("row"), "d")
        nearest = retrieval.rerank(first, image_queries, image_database, r.rerank_frames, depth)
    return nearest, retrieval.recall_at(nearest, positives, queries.select(F.col("id").alias("q")), cutoffs)


def make_split(queries: DataFrame, positives: DataFrame, settings: Settings, folds: DataFrame | None = None) -> DataFrame:
    """``q, part, excluded`` as the settings ask for it, of queries (q; for ``drive`` also x, y and, with folds, stem).

    ``walk`` recordings are cut in time, guarded or in blocks by ``split_guard``; ``drive`` by the folds given, else by distance; ``ride``
    by ``split_fold_count`` consecutive folds, else for evaluation alone. ValueError for a fold that the table of folds lacks.
    """
    d = settings.dataset
    ratios = {"test_ratio": d.test_ratio, "validation_ratio": d.validation_ratio}
    if d.adapter == "drive":
        if folds is not None:
            if folds.where(F.col("fold") == d.split_fold).isEmpty():
                raise ValueError(f"no fold {d.split_fold}")
            got = parts.fold_split(folds, d.split_fold, queries, positives)
        else:
            got = parts.geographic_split(queries, positives, **ratios, radius=d.gt_radius_m)
    elif d.adapter == "ride":
        got = parts.cross_validation_split(queries.count(), positives, d.split_fold_count, d.split_fold) if d.split_fold_count else parts.evaluation_split(positives)
    elif d.split_guard == "ground_truth_blocks":
        got = parts.block_split(queries.count(), positives, **ratios, centres=d.validation_centres)
    else:
        got = parts.temporal_split(queries.count(), positives, **ratios)
        if d.split_guard == "ground_truth_overlap":
            got = parts.guard_ground_truth(got, positives)
    return got if "excluded" in got.columns else got.withColumn("excluded", F.lit(False))


def fold_gap_us(settings: Settings) -> int:
    """How far another camera's frame may be, in µs, from the frame whose fold it takes."""
    return int(settings.dataset.camera_fold_max_gap_s * 1_000_000)


def training_positives(positives: DataFrame, settings: Settings, near: DataFrame | None = None, groups: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(positives, ignored) of training pairs (q, d): near ones (q, d), or the middle of the interval, or all; where ``same_camera_triplets``
    is set, only those of the query's own camera. What is ground truth but no positive is ignored, never a negative.

    ``groups`` are the cameras of queries (q, group) and of the database (d, group).
    """
    t = settings.training
    chosen = positives.select("q", "d")
    if t.positive_interval_fraction > 0:
        chosen = parts.central_positives(positives, t.positive_interval_fraction)
    elif t.positive_max_distance_m > 0:
        if near is None:
            raise ValueError("positive_max_distance_m needs the pairs that are near")
        chosen = parts.training_positives(positives, near)
    if t.same_camera_triplets:
        if groups is None:
            raise ValueError("same_camera_triplets needs the cameras of both sides")
        chosen = parts.same_group(chosen, *groups)
    return chosen, positives.select("q", "d").exceptAll(chosen)


def mine_negatives(queries: DataFrame, database: DataFrame, positives: DataFrame, settings: Settings, exclusions: DataFrame | None = None) -> DataFrame:
    """``q, slot, d`` by the settings' miner; within the query's own group (id, v, group) where ``same_camera_triplets`` is set."""
    t = settings.training
    if t.miner != "hard_negative":
        return retrieval.random_negatives(queries, database.count(), positives, t.negatives_per_query, settings.seed, exclusions)
    mine = retrieval.grouped_negatives if t.same_camera_triplets else retrieval.hard_negatives
    return mine(queries, database, positives, t.negatives_per_query, t.hard_search_depth, settings.seed, exclusions)


def fit_normalizer(edges: DataFrame, frames: DataFrame, settings: Settings, column: str = "features", log_columns: Sequence[int] = ()) -> DataFrame:
    """Statistics of the edges (frame, is_text, features) of the frames (frame) that training sees: the database and training queries.

    With additive fusion edges of strings never reach the encoder, so they don't count.
    """
    own = edges.join(frames.select("frame").distinct(), "frame", "left_semi")
    own = own.where(~F.col("is_text")) if settings.model.text_fusion == "additive" else own
    return normalizer.fit(own, column, log_columns)


def transfer_problems(source: Mapping[str, Any], target: Mapping[str, Any], shape: encoder.Shape) -> list[str]:
    """Why a model trained on ``source`` can't describe ``target``; empty if it can. Both are manifests."""
    keys = ("node_class_to_idx", "edge_label_to_idx", "text_encoder", "text_dim", "connection_strategy", "connection_k")
    out = [f"{k} differs" for k in keys if source.get(k) != target.get(k)]
    if len(target.get("node_class_to_idx", ())) > shape.node_classes:
        out.append("the target has more node classes than the model")
    if len(target.get("edge_label_to_idx", ())) > shape.edge_classes:
        out.append("the target has more edge labels than the model")
    if target.get("text_dim", shape.text) != shape.text:
        out.append("the target's text vectors are of another width than the model's")
    return out


def fingerprint(settings: Settings) -> str:
    """Of every setting that changes prepared graphs."""
    return settings_fingerprint({"preprocess": dataclasses.asdict(settings.preprocess), "schema": 3})


def validate(settings: Settings, frames: DataFrame) -> dict[str, int]:
    """Frames per sequence the settings name; ValueError for a sequence without any."""
    wanted = settings.dataset.sequences
    found = {r["sequence"]: r["n"] for r in frames.where(F.col("sequence").isin(*wanted)).groupBy("sequence").agg(F.count("*").alias("n")).collect()}
    lacking = [s for s in wanted if s not in found]
    if lacking:
        raise ValueError(f"no frames of {', '.join(lacking)}")
    return found


def split_document(split: DataFrame, positives: DataFrame, settings: Settings) -> dict[str, Any]:
    """The split as one document: positives, queries per part, those excluded, and how it was made.

    ``split`` has q, part and perhaps excluded. The document holds every query and is meant for a benchmark, not for a corpus.
    ValueError if training or test is empty.
    """
    rows = split.withColumn("excluded", F.col("excluded") if "excluded" in split.columns else F.lit(False)).orderBy("q").collect()
    of = lambda p, out: [r["q"] for r in rows if r["part"] == p and r["excluded"] == out]
    truth = {r["q"]: sorted(r["d"]) for r in positives.groupBy("q").agg(F.collect_set("d").alias("d")).collect()}
    d = settings.dataset
    out: dict[str, Any] = {"positives": truth, "positives_sha256": positives_digest(truth), "protocol": d.split_guard or "temporal", "split_fold": d.split_fold, "split_fold_count": d.split_fold_count}
    for p in ("train", "validation", "test"):
        out[f"{p}_query_indices"], out[f"excluded_{p}_query_indices"] = of(p, False), of(p, True)
    if not out["train_query_indices"] or not out["test_query_indices"]:
        raise ValueError("the split has no training or no test query")
    return out


def check_split(document: Mapping[str, Any], settings: Settings) -> None:
    """ValueError for a split of another protocol or fold than the settings'."""
    d = settings.dataset
    for key, want in (("protocol", d.split_guard or "temporal"), ("split_fold", d.split_fold), ("split_fold_count", d.split_fold_count)):
        if document.get(key) != want:
            raise ValueError(f"the split's {key} is {document.get(key)!r}, the settings' {want!r}")


def save_checkpoint(folder: str, shape: encoder.Shape, weights: Mapping[str, np.ndarray], manifest: Mapping[str, Any], epoch: int = 0) -> None:
    """Weights, then what they fit, each whole or not at all."""
    save_arrays(os.path.join(folder, "weights.npz"), weights)
    save_json({"shape": dataclasses.asdict(shape), "manifest_sha256": settings_fingerprint(manifest), "epoch": epoch}, os.path.join(folder, "checkpoint.json"))


def load_checkpoint(folder: str, manifest: Mapping[str, Any] | None = None) -> tuple[encoder.Shape, dict[str, np.ndarray], int]:
    """(shape, weights, epoch); ValueError if it was saved for another manifest."""
    with open(os.path.join(folder, "checkpoint.json"), encoding="utf-8") as f:
        info = json.load(f)
    if manifest is not None and info["manifest_sha256"] != settings_fingerprint(manifest):
        raise ValueError("the checkpoint belongs to another manifest")
    with np.load(os.path.join(folder, "weights.npz"), allow_pickle=False) as a:
        return encoder.Shape(**info["shape"]), dict(a), info["epoch"]


def epochs_without_improvement(metrics: Sequence[float], warm_up: int = 0) -> int:
    """How many epochs, after the warm-up, have passed since the best one; for early stopping."""
    best, since = float("-inf"), 0
    for epoch, value in enumerate(metrics):
        better = value > best
        best = max(best, value)
        since = 0 if better or epoch < warm_up else since + 1
    return since

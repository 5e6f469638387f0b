"""Inference of the graph encoder: one descriptor of unit length per frame from its nodes, edges and strings.

Weights are a dictionary of arrays, a few megabytes, shipped to the tasks. Frames are encoded on their own inside Arrow
batches; what text adds depends on the fusion: ``node`` (strings are nodes), ``additive`` (a term on the object a string is
written on) or ``set`` (strings encoded one by one and summed per frame, after the scene).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FUSIONS = ("node", "additive", "set")


@dataclass(frozen=True)
class Shape:
    """Widths of the encoder."""

    node_classes: int
    edge_classes: int
    text: int = 64
    hidden: int = 256
    out: int = 256
    node_emb: int = 64
    edge_emb: int = 64
    heads: int = 4
    layers: int = 1
    fusion: str = "set"
    edge_geometry: bool = True


def random_weights(s: Shape, seed: int = 42) -> dict[str, np.ndarray]:
    """Weights of the right shapes, for tests and dry runs: trained ones come from outside as the same dictionary."""
    r = np.random.default_rng(seed)
    w: dict[str, np.ndarray] = {}

    def linear(name: str, out: int, into: int, bias: bool = True) -> None:
        w[f"{name}.w"] = r.normal(0, 1 / np.sqrt(into), (out, into))
        if bias:
            w[f"{name}.b"] = r.normal(0, 0.01, out)

    def norm(name: str, n: int) -> None:
        w[f"{name}.g"], w[f"{name}.b"] = np.ones(n), np.zeros(n)

    h = s.hidden
    w["node_emb"] = r.normal(0, 0.1, (s.node_classes, s.node_emb))
    w["edge_emb"] = r.normal(0, 0.1, (s.edge_classes, s.edge_emb))
    linear("input.0", h, 4 + s.node_emb)
    linear("input.1", h, h)
    linear("geometry.0", h, 10)
    linear("geometry.1", h, h)
    linear("label.0", h, s.edge_emb)
    linear("label.1", h, h)
    norm("geometry_norm", h)
    norm("label_norm", h)
    linear("gate.0", h, 2 * h)
    linear("gate.1", h, h)
    for i in range(s.layers):
        linear(f"conv{i}.source", s.heads * h, h)
        linear(f"conv{i}.target", s.heads * h, h)
        linear(f"conv{i}.edge", s.heads * h, h, False)
        linear(f"conv{i}.residual", h, h, False)
        w[f"conv{i}.attention"] = r.normal(0, 0.1, (s.heads, h))
        w[f"conv{i}.bias"] = np.zeros(h)
    linear("project.0", h, 2 * h)
    linear("project.1", s.out, h)
    if s.fusion == "node":
        linear("text", s.node_emb, s.text)
        norm("text_norm", s.node_emb)
    elif s.fusion == "additive":
        linear("text_add", s.node_emb, s.text, False)
    else:
        linear("text.0", h, s.text + 4 + s.node_emb)
        linear("text.1", h, h)
        linear("text_out", s.out, h, False)
    return w


class Encoder:
    """The forward pass over one frame's arrays."""

    def __init__(self, shape: Shape, weights: dict[str, np.ndarray]):
        if shape.fusion not in FUSIONS:
            raise ValueError(f"unknown fusion {shape.fusion!r}; one of {', '.join(FUSIONS)}")
        self.s, self.w = shape, weights

    def _linear(self, x: np.ndarray, name: str) -> np.ndarray:
        y = x @ self.w[f"{name}.w"].T
        return y + self.w[f"{name}.b"] if f"{name}.b" in self.w else y

    def _mlp(self, x: np.ndarray, name: str) -> np.ndarray:
        return self._linear(np.maximum(self._linear(x, f"{name}.0"), 0), f"{name}.1")

    def _norm(self, x: np.ndarray, name: str) -> np.ndarray:
        m, v = x.mean(-1, keepdims=True), x.var(-1, keepdims=True)
        return (x - m) / np.sqrt(v + 1e-5) * self.w[f"{name}.g"] + self.w[f"{name}.b"]

    def _rows(self, table: str, index: np.ndarray) -> np.ndarray:
        if len(index) and (index.min() < 0 or index.max() >= len(self.w[table])):
            raise ValueError(f"an index lies outside {table}")
        return self.w[table][index]

    def _edges(self, features: np.ndarray, label: np.ndarray, is_text: np.ndarray) -> np.ndarray:
        named = self._mlp(self._rows("edge_emb", label), "label")
        named = np.where(is_text[:, None], 0.0, named)
        if not self.s.edge_geometry:
            return named
        a, b = self._norm(self._mlp(features, "geometry"), "geometry_norm"), self._norm(named, "label_norm")
        gate = 1 / (1 + np.exp(-self._mlp(np.concatenate([a, b], 1), "gate")))
        return gate * a + (1 - gate) * b

    def _attend(self, x: np.ndarray, src: np.ndarray, dst: np.ndarray, e: np.ndarray, i: int) -> np.ndarray:
        """A layer of attention: existing loops give way to one per node whose edge is the mean of the incoming ones."""
        n, heads, h = len(x), self.s.heads, self.s.hidden
        keep = src != dst
        src, dst, e = src[keep], dst[keep], e[keep]
        count = np.bincount(dst, minlength=n)[:, None]
        mean = np.zeros((n, e.shape[1]))
        np.add.at(mean, dst, e)
        mean = mean / np.maximum(count, 1)
        loop = np.arange(n)
        src, dst, e = np.concatenate([src, loop]), np.concatenate([dst, loop]), np.concatenate([e, mean])
        left, right = (self._linear(x, f"conv{i}.{k}").reshape(n, heads, h) for k in ("source", "target"))
        mixed = left[src] + right[dst] + self._linear(e, f"conv{i}.edge").reshape(-1, heads, h)
        score = (np.where(mixed > 0, mixed, 0.2 * mixed) * self.w[f"conv{i}.attention"]).sum(-1)
        top = np.full((n, heads), -np.inf)
        np.maximum.at(top, dst, score)
        weight = np.exp(score - top[dst])
        total = np.zeros((n, heads))
        np.add.at(total, dst, weight)
        out = np.zeros((n, heads, h))
        np.add.at(out, dst, left[src] * (weight / (total[dst] + 1e-16))[:, :, None])
        return out.mean(1) + self._linear(x, f"conv{i}.residual") + self.w[f"conv{i}.bias"]

    def _scene(self, features: np.ndarray, src: np.ndarray, dst: np.ndarray, e: np.ndarray) -> np.ndarray:
        h = np.maximum(self._mlp(features, "input"), 0) if len(features) else np.zeros((0, self.s.hidden))
        for i in range(self.s.layers):
            if len(h):
                h = np.maximum(self._attend(h, src, dst, e, i), 0)
        pooled = np.concatenate([h.mean(0), h.max(0)]) if len(h) else np.zeros(2 * self.s.hidden)
        return self._mlp(pooled[None], "project")[0]

    def encode(self, x: np.ndarray, node_class: np.ndarray, is_text: np.ndarray, text: np.ndarray, src: np.ndarray, dst: np.ndarray, features: np.ndarray, label: np.ndarray, text_edge: np.ndarray) -> np.ndarray:
        """The descriptor of a frame: geometry, classes and text vectors of nodes, and edges between them.

        A frame without nodes has the descriptor of empty pools, so it keeps its row.
        """
        s = self.s
        emb = self._rows("node_emb", node_class)
        if s.fusion == "node" and is_text.any():
            emb = emb.copy()
            emb[is_text] = self._norm(self._linear(text[is_text], "text"), "text_norm")
        e = self._edges(features, label, text_edge)
        link = text_edge & is_text[src] & ~is_text[dst]
        if s.fusion == "node":
            d = self._scene(np.concatenate([x, emb], 1), src, dst, e)
        else:
            if s.fusion == "additive" and link.any():
                emb = emb.copy()
                np.add.at(emb, dst[link], self._linear(text[src[link]], "text_add"))
            scene = ~is_text
            kept = scene[src] & scene[dst] & ~text_edge
            number = np.cumsum(scene) - 1
            d = self._scene(np.concatenate([x, emb], 1)[scene], number[src[kept]], number[dst[kept]], e[kept])
            if s.fusion == "set" and link.any():
                element = np.concatenate([text[src[link]], x[src[link]], emb[dst[link]]], 1)
                d = d + self._linear(self._mlp(element, "text").sum(0)[None], "text_out")[0]
        return d / max(float(np.linalg.norm(d)), 1e-12)


NODE = "array<struct<node: int, x: array<double>, class_idx: int, is_text: boolean, text: array<double>>>"
EDGE = "array<struct<src: int, dst: int, features: array<double>, label_idx: int, is_text_edge: boolean>>"


def encode_frames(graphs: DataFrame, shape: Shape, weights: dict[str, np.ndarray]) -> DataFrame:
    """``frame, v``: a descriptor for every row of ``graphs`` (frame, nodes, edges as NODE and EDGE)."""
    shipped = graphs.sparkSession.sparkContext.broadcast((shape, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, w = shipped.value
        enc = Encoder(s, w)
        for batch in batches:
            out = []
            for nodes, edges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                nodes, edges = sorted(nodes or [], key=lambda n: n["node"]), edges or []
                array = lambda rows, key, width, kind=float: np.array([r[key] for r in rows], kind).reshape((len(rows), *width))
                text = np.array([n["text"] if n["text"] is not None else [0.0] * s.text for n in nodes], float).reshape(len(nodes), s.text)
                out.append(enc.encode(array(nodes, "x", (4,)), array(nodes, "class_idx", (), int), array(nodes, "is_text", (), bool), text, array(edges, "src", (), int), array(edges, "dst", (), int), array(edges, "features", (10,)), array(edges, "label_idx", (), int), array(edges, "is_text_edge", (), bool)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tolist() for v in out], pa.list_(pa.float64()))], names=["frame", "v"])

    return graphs.select(F.col("frame").cast("string"), F.col("nodes").cast(NODE), F.col("edges").cast(EDGE)).mapInArrow(run, "frame string, v array<double>")


def assemble(nodes: DataFrame, edges: DataFrame, texts: DataFrame, frames: DataFrame, dim: int = 64) -> DataFrame:
    """``frame, nodes, edges`` of fused tables: nodes (frame, node, is_text, class_idx, corners, text), edges with features, and
    text vectors as filled buckets (text, bucket, weight). Every frame of ``frames`` has a row."""
    vectors = texts.groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m")).select("text", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("tv"))
    geometry = F.array((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    n = nodes.join(vectors, "text", "left").groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("node", geometry.alias("x"), "class_idx", "is_text", F.col("tv").alias("text")))).alias("nodes"))
    e = edges.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("edge", "src", "dst", "features", "label_idx", "is_text_edge"))).alias("e")).select("frame", F.transform("e", lambda x: F.struct(x["src"].alias("src"), x["dst"].alias("dst"), x["features"].alias("features"), x["label_idx"].alias("label_idx"), x["is_text_edge"].alias("is_text_edge"))).alias("edges"))
    return frames.select("frame").distinct().join(n, "frame", "left").join(e, "frame", "left")

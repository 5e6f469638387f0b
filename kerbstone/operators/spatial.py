"""Points near other points, and points in regions, over hundreds of millions of positions.

A bounded sample shapes a quadtree whose leaves are intervals of a Morton curve. Points go to
their leaf and, within half the radius of a border, to the neighbours too. In a leaf, a
bulk-loaded R-tree is probed, distances are refined exactly, and a pair counts only in the leaf
that holds the middle between its points, so no pair is lost and none appears twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sampled points that shape the tree: all that reaches the driver.
SAMPLE_POINTS = 200_000
#: Points a leaf should hold; one over twice that which can't be split is salted.
LEAF_POINTS = 12_000
#: Entries of an R-tree node.
FANOUT = 16
#: Levels of the quadtree.
DEPTH = 20


def _spread(v: np.ndarray) -> np.ndarray:
    """Puts a zero bit before each of the low 32 bits."""
    v = v.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


@dataclass(frozen=True)
class Quadtree:
    """Leaves in Morton order. Points beyond the sampled box belong to the leaf at its border."""

    x0: float
    y0: float
    cell: float
    starts: np.ndarray
    salts_a: np.ndarray
    salts_b: np.ndarray

    def codes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        top = (1 << DEPTH) - 1
        clip = lambda v: np.clip(np.floor(v), 0, top).astype(np.uint64)
        return _spread(clip((x - self.x0) / self.cell)) | (_spread(clip((y - self.y0) / self.cell)) << np.uint64(1))

    def leaf(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, self.codes(x, y), side="right") - 1

    def touched(self, x: np.ndarray, y: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf within ``margin`` of a point. A leaf is wider than twice the
        margin, so it holds a corner of the square around the point if it meets that square."""
        m = margin * (1 + 1e-9) + 1e-7
        corners = np.stack([self.leaf(x + i * m, y + j * m) for i in (-1, 1) for j in (-1, 1)], axis=1)
        corners.sort(axis=1)
        fresh = np.ones(corners.shape, bool)
        fresh[:, 1:] = corners[:, 1:] != corners[:, :-1]
        row, k = np.nonzero(fresh)
        return row, corners[row, k]

    def overlapped(self, x1: float, y1: float, x2: float, y2: float) -> list[int]:
        """The leaves that a box meets; beyond the sampled box, those at its border."""
        top = (1 << DEPTH) - 1
        cut = lambda v, o: min(max(int((v - o) // self.cell), 0), top)
        a, b, c, d = cut(x1, self.x0), cut(y1, self.y0), cut(x2, self.x0), cut(y2, self.y0)
        found, stack = [], [(0, 0, 0, DEPTH)]
        while stack:
            code, i, j, level = stack.pop()
            side = 1 << level
            if i > c or j > d or i + side <= a or j + side <= b:
                continue
            first = int(np.searchsorted(self.starts, np.uint64(code), side="right")) - 1
            last = int(np.searchsorted(self.starts, np.uint64(code + side * side - 1), side="right")) - 1
            if first == last:
                found.append(first)
                continue
            half, quarter = side >> 1, side * side >> 2
            stack.extend((code + q * quarter, i + (q & 1) * half, j + (q >> 1) * half, level - 1) for q in range(4))
        return sorted({*found})


def build_quadtree(x: np.ndarray, y: np.ndarray, side_b: np.ndarray, scale: float, radius: float, leaf_points: int = LEAF_POINTS) -> Quadtree:
    """Splits while a leaf is expected to hold more than ``leaf_points`` (``scale`` rows per sampled
    point) and its children are wider than ``2 * radius``. Leaves that stay too full get salts."""
    if not len(x):
        return Quadtree(0.0, 0.0, 1.0, np.zeros(1, np.uint64), np.ones(1, int), np.ones(1, int))
    side = max(float(np.ptp(x)), float(np.ptp(y)), 4 * radius, 1e-6) * 1.0001
    cell = side / (1 << DEPTH)
    tree = Quadtree(float(x.min()), float(y.min()), cell, np.zeros(1, np.uint64), np.ones(1, int), np.ones(1, int))
    codes = tree.codes(x, y)
    order = np.argsort(codes, kind="stable")
    codes, b = codes[order], np.concatenate([[0], np.cumsum(side_b[order])])
    starts, salts_a, salts_b = [], [], []
    stack = [(0, 0)]
    while stack:
        code, level = stack.pop()
        width = 1 << (2 * (DEPTH - level))
        lo, hi = np.searchsorted(codes, np.array([code, code + width], np.uint64), side="left")
        n = (hi - lo) * scale
        if n > leaf_points and hi - lo > 1 and level < DEPTH and side / (1 << (level + 1)) > 2 * radius:
            stack.extend((code + i * (width >> 2), level + 1) for i in (3, 2, 1, 0))
            continue
        nb = (b[hi] - b[lo]) * scale
        starts.append(code)
        salts_a.append(max(1, math.ceil((n - nb) / (2 * leaf_points))))
        salts_b.append(max(1, math.ceil(nb / (2 * leaf_points))))
    return Quadtree(tree.x0, tree.y0, cell, np.array(starts, np.uint64), np.array(salts_a), np.array(salts_b))


class RTree:
    """Sort-tile-recursive packing of rectangles, level by level in flat arrays, probed in bulk."""

    def __init__(self, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray):
        n = len(x1)
        slabs = max(1, math.ceil(math.sqrt(n / FANOUT)))
        by_x = np.argsort(x1 + x2, kind="stable")
        slab = np.empty(n, np.int64)
        slab[by_x] = np.arange(n) * slabs // max(n, 1)
        self.order = np.lexsort((y1 + y2, slab))
        level = [v[self.order] for v in (x1, y1, x2, y2)]
        self.levels = [level]
        while len(level[0]) > FANOUT:
            at = np.arange(0, len(level[0]), FANOUT)
            level = [np.minimum.reduceat(level[0], at), np.minimum.reduceat(level[1], at), np.maximum.reduceat(level[2], at), np.maximum.reduceat(level[3], at)]
            self.levels.append(level)

    def probe(self, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, entry) of all rectangles that meet, borders included."""
        n = len(self.levels[-1][0])
        query, node = np.repeat(np.arange(len(x1)), n), np.tile(np.arange(n), len(x1))
        for depth in range(len(self.levels) - 1, -1, -1):
            a1, b1, a2, b2 = self.levels[depth]
            meets = (a1[node] <= x2[query]) & (a2[node] >= x1[query]) & (b1[node] <= y2[query]) & (b2[node] >= y1[query])
            query, node = query[meets], node[meets]
            if depth:
                below = len(self.levels[depth - 1][0])
                first = node * FANOUT
                count = np.minimum(FANOUT, below - first)
                query = np.repeat(query, count)
                node = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        return query, self.order[node]


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows with equal leading ``keys`` columns, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.nonzero(change)[0].tolist(), batch.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(c[lo] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def sampled_quadtree(points: DataFrame, radius: float, seed: int = 17, leaf_points: int = LEAF_POINTS) -> tuple[Quadtree, int]:
    """The tree over ``points`` (x, y, side_b) and the number of rows; at most about SAMPLE_POINTS rows are collected."""
    rows = points.count()
    share = min(1.0, SAMPLE_POINTS / max(rows, 1))
    drawn = points.select("x", "y", "side_b")
    drawn = drawn if share == 1.0 else drawn.sample(fraction=share, seed=seed)
    got = drawn.toArrow()
    x, y, b = (got.column(i).to_numpy() for i in range(3))
    return build_quadtree(x, y, b.astype(np.int64), rows / max(len(x), 1), radius, leaf_points), rows


def latest_nearby(points: DataFrame, radius: float, leaf_points: int = LEAF_POINTS) -> DataFrame:
    """``id, latest``: the largest id of the same ``group`` at most ``radius`` from each point (id, x, y, group), itself included.

    Found as ``near_pairs`` finds pairs, but a leaf hands on one row per point.
    """
    both = points.select("id", "x", "y", F.explode(F.array(F.lit(False), F.lit(True))).alias("side_b"), "group")
    found = _near(both, radius, leaf_points, grouped=True)
    return found.groupBy(F.col("id_a").alias("id")).agg(F.max("id_b").alias("latest"))


def near_pairs(points: DataFrame, radius: float, leaf_points: int = LEAF_POINTS) -> DataFrame:
    """``id_a, id_b`` of each point of side A and each of side B at most ``radius`` apart.

    ``points`` has ``id`` (long), ``x``, ``y`` (double) and ``side_b`` (boolean). Rows with a null
    or NaN in any of them take no part. An id delivered again at the same place counts once.
    Every pair is given: a crowded place is cut into salted blocks, not thinned.
    """
    return _near(points, radius, leaf_points)


def near_distances(points: DataFrame, radius: float, leaf_points: int = LEAF_POINTS) -> DataFrame:
    """``id_a, id_b, distance``: as ``near_pairs``, of points with a height ``z`` too; one without takes no part."""
    return _near(points.where("z IS NOT NULL AND NOT isnan(z)"), radius, leaf_points, height=True)


def _near(points: DataFrame, radius: float, leaf_points: int, grouped: bool = False, height: bool = False) -> DataFrame:
    """``near_pairs``; ``grouped``, of each point and leaf the pair with the largest ``id_b`` of the same group; with ``height`` distances."""
    extra = ["group"] if grouped else ["z"] if height else []
    clean = points.select("id", "x", "y", "side_b", *extra).where("id IS NOT NULL AND side_b IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").where("x IS NOT NULL AND y IS NOT NULL")
    tree, rows = sampled_quadtree(clean, radius, leaf_points=leaf_points)
    spark = points.sparkSession
    shipped = spark.sparkContext.broadcast(tree)  # at most a leaf per sampled point
    half = radius / 2

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shipped.value
        for batch in batches:
            ids, x, y, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            row, leaf = t.touched(x, y, half)
            ka, kb = t.salts_a[leaf], t.salts_b[leaf]
            own, other = np.where(b[row], kb, ka), np.where(b[row], ka, kb)
            if other.max(initial=1) > 1 or own.max(initial=1) > 1:
                rep = np.repeat(np.arange(len(row)), other)
                each = np.arange(len(rep)) - np.repeat(np.cumsum(other) - other, other)
                row, leaf, own, kb = row[rep], leaf[rep], own[rep], kb[rep]
                mine = (ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % own
                salt = np.where(b[row], each * kb + mine, mine * kb + each)
            else:
                salt = np.zeros(len(row), np.int64)
            more = [batch.column(4).take(pa.array(row))] if extra else []
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(salt.astype(np.int32)), pa.array(b[row]), pa.array(ids[row]), pa.array(x[row]), pa.array(y[row]), *more], names=["leaf", "salt", "side_b", "id", "x", "y", *extra])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shipped.value
        for group in _grouped(batches, 2):
            leaf, _, b, ids, x, y = (group.column(i).to_numpy() for i in range(6))
            a_at, b_at = np.nonzero(~b)[0], np.nonzero(b)[0]
            a_at = a_at[np.unique(ids[a_at], return_index=True)[1]]
            b_at = b_at[np.unique(ids[b_at], return_index=True)[1]]
            if not len(a_at) or not len(b_at):
                continue
            index = RTree(x[b_at], y[b_at], x[b_at], y[b_at])
            ax, ay, bx, by = x[a_at], y[a_at], x[b_at], y[b_at]
            for lo in range(0, len(a_at), 512):
                qx, qy = ax[lo : lo + 512], ay[lo : lo + 512]
                q, k = index.probe(qx - radius, qy - radius, qx + radius, qy + radius)
                dx, dy = qx[q] - bx[k], qy[q] - by[k]
                near = dx * dx + dy * dy <= radius * radius
                q, k = q[near], k[near]
                if grouped:
                    own = group.column(6).to_numpy()
                    same = own[a_at[lo + q]] == own[b_at[k]]
                    q, k = q[same], k[same]
                    latest = np.full(len(qx), np.iinfo(np.int64).min)
                    np.maximum.at(latest, q, ids[b_at[k]])
                    q = np.unique(q)
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[a_at[lo + q]]), pa.array(latest[q])], names=["id_a", "id_b"])
                    continue
                here = t.leaf((qx[q] + bx[k]) / 2, (qy[q] + by[k]) / 2) == leaf[0]
                q, k = q[here], k[here]
                if height:
                    z = group.column(6).to_numpy()
                    distance = np.sqrt((qx[q] - bx[k]) ** 2 + (qy[q] - by[k]) ** 2 + (z[a_at[lo + q]] - z[b_at[k]]) ** 2)
                    close = distance <= radius
                    if close.any():
                        yield pa.RecordBatch.from_arrays([pa.array(ids[a_at[lo + q[close]]]), pa.array(ids[b_at[k[close]]]), pa.array(distance[close])], names=["id_a", "id_b", "distance"])
                    continue
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a_at[lo + q]]), pa.array(ids[b_at[k]])], names=["id_a", "id_b"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / (8 * leaf_points)))
    spread = clean.mapInArrow(scatter, "leaf int, salt int, side_b boolean, id long, x double, y double" + ", group long" * grouped + ", z double" * height)
    return spread.repartition(parts, "leaf", "salt").sortWithinPartitions("leaf", "salt").mapInArrow(probe, "id_a long, id_b long" + ", distance double" * height)


def in_polygon(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Which points lie in a polygon (even-odd over its one ring) or on its border."""
    ax, ay = ring[:, 0], ring[:, 1]
    bx, by = np.roll(ax, -1), np.roll(ay, -1)
    px, py = x[:, None], y[:, None]
    cross = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
    on = (cross == 0) & (np.minimum(ax, bx) <= px) & (px <= np.maximum(ax, bx)) & (np.minimum(ay, by) <= py) & (py <= np.maximum(ay, by))
    spans = (ay > py) != (by > py)
    left = np.where(by > ay, cross > 0, cross < 0)
    return on.any(axis=1) | (np.count_nonzero(spans & left, axis=1) % 2 == 1)


def containing_regions(points: DataFrame, regions: DataFrame, leaf_points: int = LEAF_POINTS) -> DataFrame:
    """``id, region_id`` of each point (id, x, y) and every region (region_id, ring) that holds it, borders included.

    ``ring`` is an array of [x, y] corners. A region goes to all leaves its bounds meet, a point to one, so each pair is found
    once; crowded leaves are salted by points. Points and regions with nulls, and rings of under three corners, take no part. An
    id delivered again counts once per place.
    """
    clean = points.select("id", "x", "y").where("id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    whole = regions.where("region_id IS NOT NULL AND size(ring) >= 3").where(~F.exists("ring", lambda c: c.isNull() | (F.size(c) != 2) | F.exists(c, lambda v: v.isNull() | F.isnan(v))))
    tree, rows = sampled_quadtree(clean.select("x", "y", F.lit(False).alias("side_b")), 0.0, leaf_points=leaf_points)
    spark = points.sparkSession
    shipped = spark.sparkContext.broadcast(tree)
    fields = ["leaf", "salt", "id", "x", "y", "region_id", "ring"]
    schema = "leaf int, salt int, id long, x double, y double, region_id long, ring array<array<double>>"
    corners = pa.list_(pa.list_(pa.float64()))

    def place_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shipped.value
        for batch in batches:
            ids, x, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            leaf = t.leaf(x, y)
            salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % t.salts_a[leaf]
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(salt.astype(np.int32)), pa.array(ids), pa.array(x), pa.array(y), pa.nulls(n, pa.int64()), pa.nulls(n, corners)], names=fields)

    def place_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shipped.value
        for batch in batches:
            out: list[tuple] = []
            for region, ring in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lo, hi = np.min(ring, axis=0), np.max(ring, axis=0)
                out += [(leaf, salt, region, ring) for leaf in t.overlapped(lo[0], lo[1], hi[0], hi[1]) for salt in range(t.salts_a[leaf])]
            n = len(out)
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.array([o[2] for o in out], pa.int64()), pa.array([o[3] for o in out], corners)], names=fields)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, 2):
            is_region = group.column("region_id").is_valid().to_numpy()
            ids, x, y = (group.column(i).to_numpy()[~is_region] for i in range(2, 5))
            region, rings = group.column(5).to_numpy()[is_region], [np.array(r) for r in group.column(6).filter(pa.array(is_region)).to_pylist()]
            if not len(ids) or not len(region):
                continue
            ids, x, y = ids.astype(np.int64), x.astype(float), y.astype(float)
            low, high = np.array([r.min(axis=0) for r in rings]), np.array([r.max(axis=0) for r in rings])
            index = RTree(low[:, 0], low[:, 1], high[:, 0], high[:, 1])
            for start in range(0, len(ids), 512):
                px, py = x[start : start + 512], y[start : start + 512]
                q, k = index.probe(px, py, px, py)
                order = np.argsort(k, kind="stable")
                q, k = q[order], k[order]
                edges = np.flatnonzero(np.diff(k, prepend=-1, append=len(rings)))
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    inside = q[lo:hi][in_polygon(px[q[lo:hi]], py[q[lo:hi]], rings[k[lo]])]
                    if len(inside):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[start + inside]), pa.array(np.full(len(inside), int(region[k[lo]])))], names=["id", "region_id"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / (8 * leaf_points)))
    spread = clean.mapInArrow(place_points, schema).unionByName(whole.select(F.col("region_id").cast("long"), F.col("ring").cast("array<array<double>>")).mapInArrow(place_regions, schema))
    return spread.repartition(parts, "leaf", "salt").sortWithinPartitions("leaf", "salt").mapInArrow(probe, "id long, region_id long").distinct()


def located(tracks: DataFrame) -> DataFrame:
    """Samples with both coordinates, neither null nor NaN, and not both zero."""
    return tracks.where("northing IS NOT NULL AND easting IS NOT NULL AND NOT isnan(northing) AND NOT isnan(easting) AND NOT (northing = 0 AND easting = 0)")


def near_samples(tracks: DataFrame, radius: float = 5.0) -> DataFrame:
    """``sample_a < sample_b``: a located query sample and a located database sample at most ``radius`` apart.

    Samples of another or no side, or without an id, take no part.
    """
    points = located(tracks).where("side IN ('query', 'database')").select(F.col("sample_id").alias("id"), F.col("easting").alias("x"), F.col("northing").alias("y"), (F.col("side") == "database").alias("side_b"))
    return near_pairs(points, radius).select(F.least("id_a", "id_b").alias("sample_a"), F.greatest("id_a", "id_b").alias("sample_b"))

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbstone.operators import ground_truth as gt
from kerbstone.operators import incremental, parts
from kerbstone.operators import retrieval as r
from kerbstone.operators.asof import interpolate, nearest
from kerbstone.runtime import global_rank


def pairs(spark, table):
    return spark.createDataFrame([(q, d) for q, ds in table.items() for d in ds], "q long, d long")


def by_part(df):
    out: dict = {}
    for row in df.collect():
        key = row["part"] + (" excluded" if "excluded" in row.asDict() and row["excluded"] else "")
        out.setdefault(key, []).append(row["q"])
    return {k: sorted(v) for k, v in out.items()}


def test_interpolation(spark):
    track = spark.createDataFrame([("a", 100, 0.0, 0.0), ("a", 200, 10.0, 0.0), ("a", 300, 10.0, 10.0)], "s string, t long, x double, y double")
    probes = spark.createDataFrame([("a", 150), ("a", 200), ("a", 50), ("a", 400), ("a", None), ("b", 150), (None, 150)], "s string, t long")
    for bucket in (10, 1000):
        got = {(row["s"], row["t"]): (row["x"], row["y"]) for row in interpolate(probes, track, "s", "t", ["x", "y"], bucket).collect()}
        assert len(got) == 7
        assert got["a", 150] == (5.0, 0.0) and got["a", 200] == (10.0, 0.0) and got["a", 50] == got["a", 400] == got["b", 150] == got["a", None] == (None, None)


def test_nearest_equals_brute_force(spark):
    rng = random.Random(2)
    samples = [(rng.choice("ab"), rng.randrange(-300, 300), i) for i in range(200)]
    probes = [(rng.choice("abc"), rng.randrange(-350, 350), i) for i in range(200)]
    df = nearest(spark.createDataFrame(probes, "s string, t long, p long"), spark.createDataFrame(samples, "s string, t long, i long"), "s", "t", ["i"], 20, 37)
    got = {row["p"]: row for row in df.collect()}
    assert len(got) == 200
    for s, t, p in probes:
        own = [(x, i) for q, x, i in samples if q == s]
        before = max(((x, i) for x, i in own if x < t), default=None)
        after = min(((x, i) for x, i in own if x >= t), default=None)
        if before is None and after is None:
            assert got[p]["found"] is None and got[p]["delta"] is None
            continue
        best = before if before and (not after or t - before[0] <= after[0] - t) else after
        delta = abs(best[0] - t)
        assert got[p]["delta"] == delta
        assert (got[p]["found"] and got[p]["found"]["i"]) == (best[1] if delta <= 20 else None)
        assert got[p]["clamped"] == (after is None or before is None and after[0] > t)


def test_nearest_in_one_full_bucket(spark):
    n = 30_000
    samples = spark.range(n).select(F.lit("a").alias("s"), (F.col("id") * 10).alias("t"), F.col("id").alias("i"))
    probes = spark.range(n).select(F.lit("a").alias("s"), (F.col("id") * 10 + F.col("id") % 10 - 3).alias("t"), F.col("id").alias("p"))
    df = nearest(probes, samples, "s", "t", ["i"], None, 10**9)
    # a frame to the end of its partition takes quadratic time
    assert "unboundedfollowing" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
    wrong = df.withColumn("off", F.col("p") % 10 - 3).where((F.col("found.i") != F.least(F.col("p") + (F.col("off") > 5).cast("long"), F.lit(n - 1))) | (F.col("delta") != F.when((F.col("off") > 5) & (F.col("p") < n - 1), 10 - F.col("off")).otherwise(F.abs("off"))))
    assert df.count() == n and wrong.count() == 0


def test_radius(spark):
    point = lambda rows: spark.createDataFrame([(i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(rows)], "id long, x double, y double, z double")
    of = lambda q, d, radius=25.0, dims=2: sorted((row["q"], row["d"]) for row in gt.radius_positives(point(q), point(d), radius, dims).collect())
    assert of([(5, 0, 0)], [(0, 0, 0), (10, 0, 0), (100, 0, 0)]) == [(0, 0), (0, 1)]
    assert of([(0, 0, 0)], [(0, 3, 20), (0, 0, 30)], dims=3) == [(0, 0)]
    assert of([(0, 0, 0)], [(0, 3, 20), (0, 0, 30)]) == [(0, 0), (0, 1)]
    assert of([(0, 0, 0)], [(25, 900, 0), (25.1, 0, 0)], dims=1) == [(0, 0)]
    with pytest.raises(ValueError):
        of([], [], 0.0)


def test_revisits(spark):
    rows = [("a", i, float(i % 250) * 100, 0.0) for i in range(500)] + [("b", 500 + i, float(i % 250) * 100, 0.0) for i in range(199)]
    schema = "sequence string, n long, x double, y double"
    got = {r["sequence"]: (r["frames"], r["revisits"]) for r in gt.revisit_fraction(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": (500, 0.5), "b": (199, 0.0)}
    still = [("a", i, 1.0, 1.0) for i in range(3000)]
    assert gt.revisit_fraction(spark.createDataFrame(still, schema)).first()["revisits"] == 2800 / 3000
    assert gt.revisit_fraction(spark.createDataFrame([], schema)).count() == 0


def test_correspondences(spark):
    frames = spark.createDataFrame([(i, 100 * i) for i in range(10)], "idx long, ts long")
    loops = spark.createDataFrame([(0, 201, 298, 612), (1, 500, -50, 300), (2, 700, 300, 2000)], "loop long, query_ts long, start_ts long, end_ts long")
    got = [tuple(row) for row in gt.map_correspondences(loops, frames, frames, 20).orderBy("loop").collect()]
    assert got == [(0, 2, 3, 6), (1, 5, None, 3), (2, 7, 3, None)]
    with pytest.raises(Exception, match="too far"):
        gt.map_correspondences(loops, frames, frames, 1).collect()
    direct = gt.interval_positives(gt.map_correspondences(loops, frames, frames, 20))
    assert sorted(map(tuple, direct.collect())) == [(2, 3), (2, 4), (2, 5), (2, 6)]
    mapped = gt.map_correspondences(loops, frames, frames, 20).join(loops.select("loop", "query_ts"), "loop")
    singles = spark.createDataFrame([(450,), (201,), (-5000,)], "ts long")
    inherited = gt.inherited_positives(mapped, singles, frames)
    assert sorted({row["q"] for row in inherited.collect()}) == [0, 1, 2, 3]


def test_frames_of_intervals_are_not_shuffled(spark):
    n = gt.PIECE_FRAMES
    rows = [(0, 1, 5, 9), (1, 1, 12, 7), (2, 1, 20, 20), (3, 1, 5, 6), (4, 2, 3 * n, 10), (5, 2, 10, 11), (6, 3, 4, None), (7, None, 4, 5), (8, 4, 0, n - 1), (9, 5, 0, n)]
    df = gt.interval_positives(spark.createDataFrame(rows, "loop long, query_index long, start_index long, end_index long"))
    got = {r["q"]: (r["n"], r["k"], r["lo"], r["hi"]) for r in df.groupBy("q").agg(F.count("*").alias("n"), F.count_distinct("d").alias("k"), F.min("d").alias("lo"), F.max("d").alias("hi")).collect()}
    assert got == {1: (9, 9, 5, 20), 2: (3 * n - 9, 3 * n - 9, 10, 3 * n), 4: (n, n, 0, n - 1), 5: (n + 1, n + 1, 0, n)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Exchange")  # the outermost operator comes first


def test_inherited_intervals_of_repeated_keyframes(spark):
    n = gt.PIECE_FRAMES
    query = spark.range(40).select(F.col("id").alias("idx"), (F.col("id") * 10).alias("ts"))
    rows = [(i, 100, 5, 9) for i in range(50)] + [(50, 100, 12, 8), (51, 100, 30, 31), (52, 300, 2 * n, 1), (53, 200, 4, None)]
    loops = spark.createDataFrame(rows, "loop long, query_ts long, start_index long, end_index long")
    singles = spark.createDataFrame([(390,)], "ts long")
    intervals = gt.inherited_intervals(loops, singles, query)
    got = sorted(map(tuple, intervals.collect()))
    assert got == sorted([(q, a, b) for q in range(16) for a, b in ((5, 12), (30, 31))] + [(q, 1, 2 * n) for q in range(26, 35)])
    assert "unboundedfollowing" not in intervals._jdf.queryExecution().optimizedPlan().toString().lower()
    df = gt.inherited_positives(loops, singles, query)
    assert df.count() == df.distinct().count() == 16 * 10 + 9 * 2 * n
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Exchange") < plan.index("Generate explode", plan.index("Exchange"))  # pieces are spread


def test_fold_extension(spark):
    folds = spark.createDataFrame([(0, "train", "1000000"), (0, "validation", "2000000"), (0, "test", "3000000"), (0, "train", "abc")], "fold int, part string, stem string")
    frames = spark.createDataFrame([("left-1", 1_200_000), ("rear-2", 2_300_000), ("right-3", 2_900_000), ("far", 9_000_000)], "stem string, ts long")
    got = {row["stem"]: row["part"] for row in gt.extend_folds(folds, frames, 300_000).collect()}
    assert got == {"1000000": "train", "2000000": "validation", "3000000": "test", "abc": "train", "left-1": "train", "rear-2": "validation", "right-3": "test"}


def test_temporal_and_guard(spark):
    assert by_part(parts.temporal_split(10, pairs(spark, {i: [i] for i in range(10)}), 0.2, 0.25)) == {"train": [0, 1, 2, 3, 4, 5], "validation": [6, 7], "test": [8, 9]}
    positives = {0: [0, 1, 2], 1: [2, 3, 4], 2: [4, 5], 3: [6, 7], 4: [7, 8], 5: [0, 1], 6: [20, 21]}
    given = spark.createDataFrame([(q, "train" if q < 2 else "validation" if q < 4 else "test") for q in positives], "q long, part string")
    assert by_part(parts.guard_ground_truth(given, pairs(spark, positives))) == {"train": [0, 1], "validation": [3], "validation excluded": [2], "test": [6], "test excluded": [4, 5]}


def test_block_split(spark):
    got = by_part(parts.block_split(100, pairs(spark, {i: [i, i + 1, i + 2] for i in range(100)}), 0.2, 0.2, [0.3, 0.7]))
    assert got["validation"] == [*range(20, 28), *range(52, 60)] and got["test"] == list(range(80, 100))
    assert {18, 28, 78} <= set(got["train excluded"])
    near = by_part(parts.block_split(100, pairs(spark, {i: [i, i + 1, i + 2] for i in range(100)}), 0.2, 0.1, [0.95]))
    assert near["validation"] == list(range(72, 78)) and near["validation excluded"] == [78, 79]
    with pytest.raises(ValueError):
        parts.block_split(100, pairs(spark, {i: [i] for i in range(100)}), 0.2, 0.2, [0.3, 0.35])


def test_geographic_split(spark):
    places = [(i, 100.0 * i, 0.0) for i in range(20)]
    places[13], places[17] = (13, 500.0, 0.0), (17, 1400.0, 0.0)
    df = spark.createDataFrame([*places, (99, None, 1.0)], "q long, x double, y double")
    got = by_part(parts.geographic_split(df, pairs(spark, {i: [i] for i in range(20)}), 0.2, 0.2, 25.0))
    assert got["validation excluded"] == [13] and got["test excluded"] == [17]


def test_folds_and_central(spark):
    got = by_part(parts.cross_validation_split(11, pairs(spark, {i: [i] for i in range(10)}), 3, 2))
    assert got == {"validation": [0, 1, 2, 3], "train": [4, 5, 6], "test": [7, 8, 9]}
    with pytest.raises(ValueError):
        parts.cross_validation_split(9, pairs(spark, {}), 2, 0)
    folds = spark.createDataFrame([(0, "train", "a"), (0, "test", "b"), (0, "test", "z")], "fold int, part string, stem string")
    frames = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "q long, stem string")
    assert by_part(parts.fold_split(folds, 0, frames, pairs(spark, {0: [1], 1: [1]}))) == {"train": [0], "test": [1]}
    assert [tuple(x) for x in parts.unknown_stems(folds, 0, frames).collect()] == [("test", 1)]
    middle = parts.central_positives(pairs(spark, {0: range(10, 18), 1: [5]}), 0.5)
    assert sorted(map(tuple, middle.collect())) == [(0, 12), (0, 13), (0, 14), (0, 15), (1, 5)]
    near = pairs(spark, {0: [0, 1, 2, 9]})
    assert sorted(map(tuple, parts.training_positives(pairs(spark, {0: range(6), 1: [3]}), near).collect())) == [(0, 0), (0, 1), (0, 2)]
    assert by_part(parts.evaluation_split(near)) == {"test": [0]}


def test_global_rank(spark):
    rows = spark.range(0, 5000, 3).withColumn("x", F.lit("keep"))
    assert all(row["rank"] == row["id"] // 3 for row in global_rank(rows, "id", width=100).collect())
    assert global_rank(rows.limit(0), "id").count() == 0


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, v array<double>")


def test_search(spark):
    db = vectors(spark, enumerate([(1, 0), (0, 1), (-1, 0)]))
    got = [tuple(x) for x in r.top_k(vectors(spark, [(7, (2, 0)), (8, (0, 3))]), db, 1).orderBy("q").collect()]
    assert got == [(7, 1, 0, 1.0), (8, 1, 1, 1.0)]
    assert r.top_k(vectors(spark, [(7, (1, 0))]), db, 9).count() == 3
    assert r.top_k(vectors(spark, []), db, 2).count() == 0 and r.top_k(db, vectors(spark, []), 2).count() == 0
    ties = r.top_k(vectors(spark, [(0, (1, 0))]), vectors(spark, [(i, (1, 0)) for i in range(50)]).repartition(5), 3)
    assert [row["d"] for row in ties.orderBy("rank").collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        r.top_k(db, db, 0)
    with pytest.raises(Exception, match="vectors must have"):
        r.top_k(db, vectors(spark, [(0, (1, 0, 0))]), 1).collect()


def test_search_in_blocks_equals_one_block(spark, monkeypatch):
    g = np.random.default_rng(0)
    q, d = vectors(spark, enumerate(g.normal(size=(40, 6)))), vectors(spark, enumerate(g.normal(size=(300, 6))))
    whole = sorted(map(tuple, r.top_k(q, d, 4).select("q", "rank", "d").collect()))
    monkeypatch.setattr(r, "BLOCK_BYTES", 400)
    assert sorted(map(tuple, r.top_k(q, d, 4).select("q", "rank", "d").collect())) == whole


def test_recall(spark):
    near = spark.createDataFrame([(10, 1, 0), (10, 2, 1), (11, 1, 0), (11, 2, 1), (12, 1, 2), (12, 2, 1)], "q long, rank int, d long")
    got = {row["k"]: row["recall"] for row in r.recall_at(near, pairs(spark, {10: [0], 11: [1], 12: [1]}), spark.createDataFrame([(10,), (11,), (12,)], "q long"), [2, 1, 2], 1.0).collect()}
    assert got == {1: pytest.approx(1 / 3), 2: 1.0}
    none = r.recall_at(near.limit(0), pairs(spark, {}), spark.createDataFrame([], "q long"), [1]).collect()
    assert [row["recall"] for row in none] == [0.0]


def test_rerank(spark):
    angles = [0, 0.5, 1, 1.5, 2]
    db = vectors(spark, enumerate((np.cos(a), np.sin(a)) for a in angles))
    q = vectors(spark, [(0, (np.cos(1.1), np.sin(1.1))), (1, (np.cos(2), np.sin(2)))])
    cand = spark.createDataFrame([(0, 0, d) for d in (0, 1, 2)] + [(1, 1, d) for d in (3, 4, -1)], "q long, row long, d long")
    order = lambda n, depth=None: {k: [row["d"] for row in r.rerank(cand, q, db, n, depth).where(f"q = {k}").orderBy("rank").collect()] for k in (0, 1)}
    assert order(1) == {0: [2, 1, 0], 1: [4, 3]}
    assert order(2) == {0: [2, 1, 0], 1: [4, 3, 2, 1, 0]}
    assert order(2, 2)[1] == [4, 3]
    with pytest.raises(ValueError):
        order(0)


def test_negatives(spark):
    db = vectors(spark, enumerate([(1, 0), (0.95, 0.31), (0.8, 0.6), (0, 1)]))
    q = vectors(spark, [(0, (1, 0))])
    mined = lambda n, pos, ex=None, depth=256: [row["d"] for row in r.hard_negatives(q, db, pairs(spark, pos), n, depth, exclusions=ex and pairs(spark, ex)).orderBy("slot").collect()]
    assert mined(1, {0: [0]}) == [1]
    assert mined(1, {0: [0]}, {0: [1]}) == [2]
    assert mined(5, {0: [0]}) == [1, 2, 3, 1, 2]
    assert mined(2, {0: [0, 1, 2, 3]}) == []
    filled = mined(3, {0: [0]}, depth=1)
    assert len(set(filled)) == 3 and 0 not in filled
    assert mined(0, {0: [0]}) == []
    drawn = r.random_negatives(q, 100, pairs(spark, {0: range(50)}), 6, 1).collect()
    assert len(drawn) == 6 and all(row["d"] >= 50 for row in drawn)
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, r.random_negatives(q, 100, pairs(spark, {0: range(50)}), 6, 1).collect()))
    got = r.triplets(pairs(spark, {0: [0], 5: [1]}), r.hard_negatives(q, db, pairs(spark, {0: [0]}), 2), 0).collect()
    assert {(row["q"], row["positive"]) for row in got} == {(0, 0)} and len(got) == 2


def test_incremental(spark):
    expected = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], "key string, fingerprint string")
    stored = spark.createDataFrame([("a", "1", "x", "x"), ("b", "0", "x", "x"), ("c", "1", "x", "y"), ("z", "1", "x", "x")], "key string, fingerprint string, sha256 string, manifest_sha256 string")
    got = {row["key"]: row["action"] for row in incremental.decide(expected, stored).collect()}
    assert got == {"a": "reuse", "b": "compute", "c": "compute", "d": "compute", "z": "stale"}
    assert incremental.manifest(incremental.decide(expected, stored, "rebuild")).first().asDict() == {"expected": 4, "skipped": 0, "written": 4, "stale": 1}
    with pytest.raises(Exception, match="no compatible result"):
        incremental.decide(expected, stored, "require_existing").collect()
    assert incremental.resolve_policy(resume=False) == "rebuild"
    with pytest.raises(ValueError):
        incremental.resolve_policy("other")
    assert {row["action"] for row in incremental.decide(expected, stored.limit(0)).collect()} == {"compute"}

from __future__ import annotations

import random

import pytest

from kerbstone.llm.nearest_time import frames_to_samples, nearest_in_time


def brute(left, right, tolerance):
    out = set()
    for e, k, t in left:
        if None in (e, k, t):
            continue
        near = [(abs(t - s), s, i) for x, s, i in right if x == e and s is not None and i is not None and abs(t - s) <= tolerance]
        if near:
            gap, _, i = min(near)
            out.add((e, k, i, gap))
    return out


def check(spark, left, right, tolerance, **more):
    a = spark.createDataFrame(left, "entity string, key long, ts long")
    b = spark.createDataFrame(right, "entity string, ts long, id long")
    got = [tuple(r) for r in nearest_in_time(a, b, tolerance, **more).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(left, right, tolerance)
    return got


def test_ties_borders_and_nulls(spark):
    left = [("a", 1, 100), ("a", 2, 0), ("a", 3, 1000), ("a", 4, None), (None, 5, 100), ("b", 6, 100), ("a", None, 100), ("a", 8, -205)]
    right = [("a", 90, 9), ("a", 110, 1), ("a", 90, 7), ("a", 1010, 4), ("a", 1011, 5), ("a", None, 3), ("a", 100, None), (None, 100, 2), ("a", 10, 6), ("a", -195, 8), ("a", 90, 7)]
    assert sorted(check(spark, left, right, 10, bucket=100)) == [("a", 1, 7, 10), ("a", 2, 6, 10), ("a", 3, 4, 10), ("a", 8, 8, 10)]


def test_random(spark):
    r = random.Random(3)
    left = [(r.choice("xyz"), i, r.randrange(-5000, 5000)) for i in range(600)]
    right = [("x" if r.random() < 0.6 else r.choice("yz"), r.randrange(-5000, 5000), r.randrange(500)) for i in range(900)]
    check(spark, left, right, 7, bucket=50, group_rows=100)
    check(spark, left, right, 0, bucket=50)


def test_empty(spark):
    assert check(spark, [], [("a", 1, 1)], 5, bucket=10) == []
    assert check(spark, [("a", 1, 1)], [], 5, bucket=10) == []
    with pytest.raises(ValueError):
        check(spark, [], [], 10, bucket=10)


def test_frames(spark):
    frames = spark.createDataFrame(
        [("s", 1, None, "000001_0000000001000000000", "walk", "x"), ("s", 1, 1_000_000_000, None, "walk", "x"), ("s", 2, 1_000_100, "1000100", "drive", None), ("s", 3, None, "bad", "ride", None), ("s", 4, 3_000_000_000, "3000000000", "ride", None), (None, 5, 1, "1", "ride", None)],
        "sequence string, idx long, ts long, stem string, adapter string, sample_id string",
    )
    n = float("nan")
    tracks = spark.createDataFrame(
        [(11, "s", 1_000_049, 1.0, 2.0, "x"), (12, "s", 999_950, 1.0, 2.0, "x"), (13, "s", 1_000_001, n, 2.0, "x"), (14, "s", 1_000_001, 0.0, 0.0, "x"), (15, "s", 2_950_000, 1.0, 0.0, "x"), (15, "s", 2_950_000, 1.0, 0.0, "x"), (16, "s", 2_950_000, 1.0, 5.0, "x"), (17, "s", 1_000_001, None, 2.0, "x")],
        "sample_id long, sequence string, ts long, northing double, easting double, idx string",
    )
    got = sorted(tuple(r) for r in frames_to_samples(frames, tracks).collect())
    assert got == [("s", 1, 11), ("s", 2, 11), ("s", 4, 15)]

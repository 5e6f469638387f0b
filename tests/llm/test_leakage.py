from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kerbstone.llm import leakage
from kerbstone import runtime
from kerbstone.llm.leakage import edits_within, overlaps, similarities, sketches


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def frame(path):
    parts = [s for s in (path or "").replace("\\", "/").lower().split("/") if s]
    return (parts[-2], re.sub(r"(?<=.)\.[^.]*$", "", parts[-1])) if len(parts) > 1 else None


def brute(rows):
    known = {r[0]: r for r in rows if r[0] is not None}.values()
    bags = {r[0]: Counter(words(r[4])) for r in known}
    out = set()
    for t in known:
        for e in known:
            if t[1] == "train" and e[1] in ("validation", "test"):
                a, b = words(t[4]), words(e[4])
                longer = max(len(a), len(b))
                # at least as many edits as words of the longer one that the other lacks
                close = (longer - (bags[t[0]] & bags[e[0]]).total()) * 10 <= longer
                near = min(len(a), len(b)) >= 8 and close and distance(a, b) * 10 <= longer
                if near or frame(t[3]) is not None and frame(t[3]) == frame(e[3]):
                    out.add((t[0], e[0]))
    return out


SCHEMA = "record_id long, split_part string, source string, file_path string, content string, class string, frame int"


def found(spark, rows):
    got = overlaps(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).pairs().collect()
    pairs = [(r["train_id"], r["eval_id"]) for r in got]
    assert len(pairs) == len(set(pairs))
    return set(pairs), got


@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=14), st.integers(0, 5))
@settings(max_examples=400, deadline=None)
def test_edits(a, b, most):
    assert edits_within(a, b, most) == (distance(a, b) <= most)


def edited(r, w, n):
    w = list(w)
    for _ in range(n):
        k, i = r.randrange(3), r.randrange(len(w))
        if k == 0:
            w.insert(i, f"new{r.randrange(999)}")
        elif k == 1 and len(w) > 1:
            del w[i]
        else:
            w[i] = f"new{r.randrange(999)}"
    return w


def shingles(w):
    return Counter(zip(w, w[1:], strict=False))


def test_similarity_and_the_bound_of_the_sketch():
    r = random.Random(8)
    pairs = []
    for _ in range(3000):
        n = r.randrange(8, 60)
        a = [r.choice("abcdefgh" if r.random() < 0.3 else [f"w{i}" for i in range(400)]) for _ in range(n)]
        pairs.append((a, edited(r, a, r.randrange(n // 10 + 2))))
    got = similarities(*(pa.array([" ".join(p[i]) for p in pairs]) for i in (0, 1)))
    low = 1.0
    for (a, b), s in zip(pairs, got.tolist(), strict=True):
        if distance(a, b) * 10 > max(len(a), len(b)):
            assert s != s
            continue
        x, y = shingles(a), shingles(b)
        assert s == (x & y).total() / (x | y).total()
        low = min(low, s)
    assert low >= 0.6
    assert (1 - 0.6**leakage.ROWS) ** leakage.BANDS < 2e-4


def test_bands_agree_as_often_as_shingles():
    r = random.Random(5)
    base = [[f"w{r.randrange(10**6)}" for _ in range(40)] for _ in range(400)]
    other = [edited(r, w, 4) for w in base]
    a, b = (sketches(pa.array([" ".join(w) for w in side])) for side in (base, other))
    s = np.mean([(shingles(x) & shingles(y)).total() / (shingles(x) | shingles(y)).total() for x, y in zip(base, other, strict=True)])
    assert abs((a == b).mean() - s**leakage.ROWS) < 0.05
    assert (a[1:] == b[:-1]).mean() < 0.001
    assert len(sketches(pa.array([], pa.string()))) == 0
    twice = sketches(pa.array(["a b a b a b a b a b", "a b a b a b a b a b c"]))
    assert (sketches(pa.array(["a b a b a b a b a b"])) == twice[:1]).all() and (twice[0] != twice[1]).any()


def test_random_records(spark):
    r = random.Random(4)
    vocabulary = [f"слово{i}" if i % 3 else f"word{i}" for i in range(60)]
    base = [[r.choice(vocabulary) for _ in range(r.randrange(6, 40))] for _ in range(60)]
    rows = []
    for i in range(400):
        w = edited(r, r.choice(base), r.randrange(5))
        text = r.choice([" ", ", ", " | "]).join(w)
        rows.append((i, r.choice(["train", "train", "validation", "test"]), r.choice(["a", None]), f"prepared/x/s{r.randrange(30)}/{r.randrange(9)}.pt", text.upper() if r.random() < 0.2 else text))
    got, _ = found(spark, rows)
    assert got == brute(rows)


def test_dirty_rows(spark):
    long = " ".join(f"w{i}" for i in range(1_500))
    rows = [
        (1, "train", None, "prepared\\drive\\S1\\0001.PT", None), (2, "test", None, "x/s1//0001.bin", ""), (3, "test", "a", "0001.pt", "one two three"), (4, "train", "a", None, "one two three"),
        (5, "train", "a", "a/b/c.d.pt", "A b-c d, e f g h"), (6, "validation", "b", "a/b/c.d", "a B c D e F g_h"), (7, "test", "b", "q/B/C.D.xy", "a b c d e f g x"),
        (8, "train", "c", None, long), (9, "test", "c", None, long + " more"), (10, None, "c", None, long), (11, "holdout", "c", None, long), (None, "train", "c", None, long),
        (12, "train", "c", None, "a " * 12), (13, "test", "c", None, "a " * 11 + "b"),
    ]
    got, all_rows = found(spark, [*rows, rows[0], rows[8]])
    assert got == brute(rows) == {(1, 2), (5, 6), (5, 7), (8, 9), (12, 13)}
    by = {(r["train_id"], r["eval_id"]): r for r in all_rows}
    assert by[5, 6]["same_frame"] is False and by[5, 6]["similarity"] == 1.0 and by[5, 7]["similarity"] is None and by[1, 2]["same_frame"]


def test_empty(spark):
    assert found(spark, []) == (set(), [])


def test_on_the_tables(spark, small):
    rows = [(r["record_id"], r["split_part"], r["source"], r["file_path"], r["content"]) for r in spark.read.parquet(f"{small}/split_records.parquet").collect()]
    got, _ = found(spark, rows)
    assert got == brute(rows)
    total = overlaps(spark.read.parquet(f"{small}/split_records.parquet")).report().collect()
    assert sum(r["pairs"] for r in total) == len(got)
    with pytest.raises(Exception, match="record_id"):
        overlaps(spark.range(1))


def test_copies_are_spread_and_never_paired_by_the_report(spark, monkeypatch):
    text = "one two three four five six seven eight nine"
    rows = [(i, "train" if i % 2 else "test", "s", f"p/q/{i % 7}", text + " ten" * (i % 3 == 0)) for i in range(600)]
    want = brute(rows)
    monkeypatch.setattr(runtime, "HOT_ROWS", 40)
    frame_ = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = overlaps(frame_)
    assert {(r["train_id"], r["eval_id"]) for r in got.pairs().collect()} == want and got.pairs().count() == len(want) == 300 * 300
    many = overlaps(frame_.withColumn("record_id", F.col("record_id") + 600).unionByName(frame_).unionByName(frame_.withColumn("record_id", F.col("record_id") + 1200)))
    one = many.report()
    assert one.first()["pairs"] == 900 * 900 and one.first()["records"] == 900 and one.first()["similar_content"] == 900 * 900
    assert one.first()["same_frame"] == 9 * sum(frame(a[3]) == frame(b[3]) for a in rows for b in rows if a[1] == "train" and b[1] == "test")
    produced = one._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in produced and "BroadcastNestedLoopJoin" not in produced

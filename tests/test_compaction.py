from __future__ import annotations

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kerbstone.functions import jsonvalue
from kerbstone.operators import compaction
from kerbstone.operators.compaction import compact, first_fit_decreasing
from kerbstone.plans.training_data import p1_found


def make(spark, rows):
    return spark.createDataFrame(rows, "file_id long, file_path string, size_bytes long, content string, bin string")


def brute(rows):
    """Pairs by nested comparison."""
    def key(path):
        parts = [s for s in (path or "").replace("\\", "/").lower().split("/") if s not in ("", ".")]
        return parts[-4:] if len(parts) >= 4 else None

    def value(text):
        try:
            return (json.loads(text, parse_constant=lambda _: 1 / 0),)
        except (ValueError, TypeError, ZeroDivisionError):
            return None

    def same(a, b):
        if isinstance(a, bool) or isinstance(b, bool):
            return a is b
        if isinstance(a, dict) and isinstance(b, dict):
            return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
        if isinstance(a, list) and isinstance(b, list):
            return len(a) == len(b) and all(map(same, a, b))
        return type(a) in (int, float) and type(b) in (int, float) and a == b or type(a) is type(b) and a == b

    known = [(r[0], key(r[1]), value(r[3])) for r in {r[0]: r for r in rows if r[0] is not None}.values()]
    out = set()
    for b in known:
        firsts = [a[0] for a in known if a[0] < b[0] and a[1] and a[1] == b[1] and a[2] and b[2] and same(a[2][0], b[2][0])]
        if firsts:
            out.add((min(firsts), b[0]))
    return out


ROWS = [
    (1, "a/text/p/s/1.json", 1, '{"a": 1, "b": [1, 2]}', "x"),
    (2, "./b//TEXT\\p/s/1.JSON", 1, '{"b":[1,2],\n"a":1.0}', "x"),
    (3, "a/text/p/s/1.json", 1, '{"b":[2,1],"a":1}', None),
    (4, "a/text/p/s/2.json", 1, '{"a": 1, "b": [1, 2]}', None),
    (5, "a/text/p/s/1.json", 1, '{"a": true, "b": [1, 2]}', None),
    (6, "a/text/p/s/1.json", 1, '{"a": 1, "b": [1, 2', None),
    (7, "a/text/p/s/1.json", 1, None, None),
    (8, "a/text/p/s/1.json", 1, "  ", None),
    (9, None, 1, '{"a": 1, "b": [1, 2]}', None),
    (10, "s/1.json", 1, "{}", None),
    (11, "s/1.json", 1, "{}", None),
    (12, "a/text/p/s/3.json", 1, '"\\u00e9\\ud800"', None),
    (13, "a/text/p/s/3.json", 1, '"é\\ud800"', None),
    (14, "a/text/p/s/4.json", 1, "NaN", None),
    (15, "a/text/p/s/4.json", 1, "NaN", None),
    (16, "a/text/p/s/5.json", 1, "[" * 30 + "1e2" + "]" * 30 + " " * 100_000, None),
    (17, "a/text/p/s/5.json", 1, "[" * 30 + "100" + "]" * 30, None),
    (2, "./b//TEXT\\p/s/1.JSON", 1, '{"b":[1,2],\n"a":1.0}', "x"),
    (None, "a/text/p/s/1.json", 1, '{"a": 1, "b": [1, 2]}', None),
]


def test_copies_and_content(spark, tmp_path):
    done = compact(spark, make(spark, ROWS), f"file://{tmp_path}/out", target_bytes=64)
    manifest = {r["file_id"]: r for r in done.manifest(spark).collect()}
    assert set(manifest) == set(range(1, 18))
    assert {(r["keeper"], i) for i, r in manifest.items() if r["keeper"] < i} == brute(ROWS) == {(1, 2), (12, 13), (16, 17)}
    assert {i: r["defect"] for i, r in manifest.items() if r["defect"]} == {6: "invalid", 7: "null", 8: "empty", 14: "invalid", 15: "invalid"}
    data = done.data(spark).collect()
    assert sorted(r["file_id"] for r in data) == sorted(set(range(1, 18)) - {2, 13, 17})
    assert {r["file_id"] for r in data if r["bin"].startswith("apart")} == {6, 7, 8, 14, 15}
    assert {r["file_id"]: r["content"] for r in data}[3] == ROWS[2][3]
    assert compaction.published(spark, f"file://{tmp_path}/out") == done
    bins = sorted((tmp_path / "out").glob("run-*/data/shard=*/bin=*"))
    assert len(bins) == done.report["bins"] and all(len(list(b.glob("*.parquet"))) == 1 for b in bins)


def test_shards_are_spark_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(compaction, "SHARD_FILES", 3)
    monkeypatch.setattr(compaction.pack, "__defaults__", (compaction.TARGET_BYTES, 3))
    done = compact(spark, make(spark, ROWS), f"file://{tmp_path}/many")
    bins = sorted((tmp_path / "many").glob("run-*/data/shard=*/bin=*"))
    assert len(bins) == done.report["bins"] > 4 and all(len(list(b.glob("*.parquet"))) == 1 for b in bins)
    assert sorted(r["file_id"] for r in done.data(spark).collect()) == sorted(set(range(1, 18)) - {2, 13, 17})


def test_empty_table(spark, tmp_path):
    done = compact(spark, make(spark, []), f"file://{tmp_path}/none")
    assert done.report == {"files": 0, "copies": 0, "unreadable": 0, "bins": 0}
    assert done.manifest(spark).count() == 0


def test_nothing_is_published_on_a_mismatch(spark, tmp_path, monkeypatch):
    real = compaction._sums
    calls = []

    def wrong(df):
        calls.append(1)
        return real(df if len(calls) == 1 else df.where("checksum % 2 = 0"))

    monkeypatch.setattr(compaction, "_sums", wrong)
    with pytest.raises(compaction.CompactionError):
        compact(spark, make(spark, ROWS), f"file://{tmp_path}/bad")
    assert compaction.published(spark, f"file://{tmp_path}/bad") is None and not list((tmp_path / "bad").glob("run-*"))


def test_destination_is_not_overwritten(spark, tmp_path):
    compact(spark, make(spark, ROWS[:2]), f"file://{tmp_path}/once")
    with pytest.raises(compaction.CompactionError):
        compact(spark, make(spark, ROWS[:2]), f"file://{tmp_path}/once")


@given(st.lists(st.integers(0, 120), max_size=60))
@settings(max_examples=80, deadline=None)
def test_first_fit_decreasing(sizes):
    got = first_fit_decreasing(np.array(sizes, np.int64), 100)
    room, want = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        need = min(sizes[i], 100)
        at = next((b for b, r in enumerate(room) if r >= need), None)
        if at is None:
            room.append(100)
            at = len(room) - 1
        room[at] = -1 if need == 100 else room[at] - need
        want[i] = at
    assert got.tolist() == [want[i] for i in range(len(sizes))]


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=12))
@settings(max_examples=150, deadline=None)
def test_digest_ignores_spelling(value):
    a = json.dumps(value)
    b = json.dumps(value, ensure_ascii=False, indent=3, sort_keys=True)
    assert jsonvalue.digest(a) == jsonvalue.digest(b)


def test_digest_of_numbers():
    d = jsonvalue.digest
    assert d("1") == d("1.0") == d("10e-1") == d("1.00000000000000000000")
    assert d("0") == d("-0") == d("0.0e7")
    assert len({d(x) for x in ("1", '"1"', "true", "[1]", "1e400", "1e500", "0.1", "0.10000000000000000001", "-1", '{"\\u0000number":"1e500"}', '["1e500"]')}) == 11
    assert d("1e99999999999999999999") == d("10e99999999999999999998") != d("1e99999999999999999998")
    assert d("9" * 5000) == d("9" * 5000 + ".0") != d("9" * 4999 + "8")


def test_p1_on_the_tables(spark, small):
    rows = [(r["file_id"], r["file_path"], 0, r["content"]) for r in spark.read.parquet(f"{small}/annotation_files.parquet").collect()]
    got = [(r["file_a"], r["file_b"]) for r in p1_found(spark, small).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_digest_of_any_depth():
    deep = lambda x, n=50_000: "[ " * n + x + "]" * n
    assert jsonvalue.digest(deep("1.0")) == jsonvalue.digest(deep("1").replace(" ", "")) != jsonvalue.digest(deep("2"))
    with pytest.raises(ValueError):
        jsonvalue.digest(deep("1")[:-1])


def test_one_canonical_form(monkeypatch):
    value = json.loads('{"b":[1,{"x":null,"a":[]}],"a":"q\\u00e9","c":{}}')
    want, real = jsonvalue.canonical(value), json.dumps

    def shallow(x, **options):
        if options:
            raise RecursionError
        return real(x)

    monkeypatch.setattr(json, "dumps", shallow)
    assert jsonvalue.canonical(value) == want

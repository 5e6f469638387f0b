from __future__ import annotations

import json
import random

import numpy as np
import pyarrow as pa

from kerbstone.functions import jsontree
from kerbstone.operators.nested import annotation_children, shred, tables


def brute(rows):
    out = set()
    for file_id, text in {r[0]: r[1] for r in rows if r[0] is not None}.items():
        try:
            v = json.loads(text, parse_constant=lambda _: 1 / 0)
        except (ValueError, TypeError, ZeroDivisionError):
            continue
        if not isinstance(v, dict):
            continue
        array = lambda k: v[k] if isinstance(v.get(k), list) else []
        number = lambda x: isinstance(x, int | float) and not isinstance(x, bool)
        four = lambda b: isinstance(b, list) and len(b) == 4 and all(map(number, b))
        scalar = lambda x: None if x is None or isinstance(x, list | dict) else (type(x) is bool, type(x) is str, x)
        last = {}
        for i, n in enumerate(array("nodes")):
            if not isinstance(n, dict):
                continue
            out.add((file_id, "node", i, -1, -1))
            if scalar(n.get("id")) is not None:
                last[scalar(n["id"])] = i
            d = n["data"] if n.get("data") is not None else n
            if isinstance(d, dict):
                two = d.get("bbox_2d")
                box = d.get("bbox") if two is None else two.get("xyxy") if isinstance(two, dict) else None
                if four(box):
                    out.add((file_id, "node_box", i, -1, -1))
        for i, e in enumerate(array("links" if v.get("links") is not None else "edges")):
            if isinstance(e, dict):
                out.add((file_id, "link", i, *(last.get(scalar(e.get(k)), -1) for k in ("source", "target"))))
        for i, e in enumerate(array("detections")):
            if isinstance(e, dict):
                out.add((file_id, "detection", i, -1, -1))
                if four(e.get("box")):
                    out.add((file_id, "detection_box", i, -1, -1))
    return out


def found(spark, rows):
    df = annotation_children(spark.createDataFrame(rows, "file_id long, content string"))
    got = [tuple(r) for r in df.select("file_id", "child", "pos", "source_pos", "target_pos").collect()]
    assert len(got) == len(set(got))
    return set(got)


CASES = [
    {"nodes": [1, {"id": 3, "bbox": [0, 0, 1, 1]}, {"id": "3", "data": {"bbox_2d": {"xyxy": [0, 0, 1, True]}}}, {"id": 3, "data": {"bbox_2d": None, "bbox": [1, 2, 3, 4.5]}}, None], "links": [{"source": 3, "target": "3"}, "x", {"source": 3.0, "target": 4}, {"target": None}]},
    {"nodes": [{"bbox_2d": {"xyxy": [1, 2, 3]}, "bbox": [1, 2, 3, 4]}, {"bbox_2d": [1, 2, 3, 4]}, {"data": None, "bbox": [1, 2, 3, 4]}, {"data": 5, "bbox": [1, 2, 3, 4]}], "edges": [{"source": None, "target": [1]}]},
    {"nodes": [{"id": True}, {"id": [1]}, {"id": None}], "links": None, "edges": [{"source": True, "target": 1}, {"source": None, "target": [1]}]},
    {"nodes": {"id": 1}, "links": [], "edges": [{"source": 1, "target": 1}], "detections": [{"box": [1, 2, 3, "4"]}, {"box": [1, 2, 3, 4]}, 7, {}]},
    {"detections": None, "nodes": [[{"id": 1}]], "links": "no"},
    [1, 2], "text", None, {},
]


def test_cases(spark):
    rows = [(i, json.dumps(c)) for i, c in enumerate(CASES)]
    rows += [(50, None), (51, ""), (52, '{"nodes": [{"id"'), (None, '{"nodes": [{}]}'), (53, '{"nodes": [], "nodes": [{}]}'), (54, '{"a.b": {"nodes[]": 1}, "nodes": [{"id": "' + "x" * 300_000 + '"}]}')]
    rows.append(rows[0])
    assert found(spark, rows) == brute(rows)


def test_empty(spark):
    assert found(spark, []) == set()


def test_links_of_tables_and_round_trip(spark):
    text = '{"a": [{"b": 1, "c": [true, null]}, {"b": "x"}], "d": {}}'
    values = shred(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t")
    got = tables(values)
    assert {p: sorted((r["dewey"], r["parent"], r["value"]) for r in got.table(p).collect()) for p in ("$.a[].b", "$.a[].c[]", "$.z")} == {
        "$.a[].b": [("0.0.0", "0.0", "1"), ("0.1.0", "0.1", "x")],
        "$.a[].c[]": [("0.0.1.0", "0.0.1", "true"), ("0.0.1.1", "0.0.1", None)],
        "$.z": [],
    }
    assert {r["schema_path"]: r["rows"] for r in got.paths().collect()} == {"$": 1, "$.a": 1, "$.a[]": 2, "$.a[].b": 2, "$.a[].c": 1, "$.a[].c[]": 2, "$.d": 1}
    rows = {r["dewey"]: r for r in values.collect()}

    def build(dewey):
        r = rows[dewey]
        below = sorted((k for k in rows if k and (k.rpartition(".")[0] == dewey)), key=lambda k: rows[k]["ordinal"])
        if r["kind"] == "object":
            return {rows[k]["schema_path"].rpartition(".")[2]: build(k) for k in below}
        if r["kind"] == "array":
            return [build(k) for k in below]
        return r["value"] if r["kind"] == "string" else None if r["kind"] == "null" else json.loads(r["value"])

    assert build("") == json.loads(text)


def test_on_the_tables(spark, small):
    rows = [(r["file_id"], r["content"]) for r in spark.read.parquet(f"{small}/annotation_files.parquet").collect()]
    assert found(spark, rows) == brute(rows)


def test_names_that_look_like_paths(spark):
    text = '{"nodes[]":{"id":1},"a.b":2,"a":{"b":3},"x\\\\":{"":0},"\\u0000number":"1e500","n":1e500}'
    got = {(r["dewey"], r["schema_path"], r["value"]) for r in shred(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").where("value IS NOT NULL").collect()}
    assert got == {("0.0", "$.nodes\\[\\].id", "1"), ("1", "$.a\\.b", "2"), ("2.0", "$.a.b", "3"), ("3.0", "$.x\\\\.", "0"), ("4", "$.\0number", "1e500"), ("5", "$.n", "1e500")}
    assert found(spark, [(1, text)]) == set()


def test_any_depth(spark):
    deep = "[" * 50_000 + "1" + "]" * 50_000
    rows = [(1, '{"nodes": [{"id": 1, "data": {"bbox": [0, 0, 1, 1], "more": ' + deep + '}}], "links": [{"source": 1, "target": 1}], "z": ' + '{"nodes":' * 50_000 + "0" + "}" * 50_000 + "}"), (2, deep), (3, deep[:-1])]
    assert found(spark, rows) == {(1, "node", 0, -1, -1), (1, "node_box", 0, -1, -1), (1, "link", 0, 0, 0)}
    chain = spark.createDataFrame([(1, "[" * 2_000 + "7" + "]" * 2_000)], "id long, t string")
    bottom = shred(chain, "id", "t").where("value IS NOT NULL").first()
    assert (bottom["value"], bottom["dewey"], bottom["schema_path"]) == ("7", ".".join(["0"] * 2_000), "$" + "[]" * 2_000)


def test_one_id_with_several_contents(spark):
    rows = [(1, '{"nodes": [{}, {}]}'), (1, '{"nodes": [{}]}'), (1, None), (1, '{"nodes": [{}, {}]}')]
    assert len(found(spark, rows)) in (1, 2)
    assert found(spark, rows) == found(spark, rows[::-1])


def trees(f):
    """Python values of a forest."""
    out, values = {}, []
    for i, (kind, parent, spelled) in enumerate(zip(f.kind, f.parent, f.spelled(np.arange(len(f))).to_pylist() if len(f) else [], strict=True)):
        v = {} if kind == jsontree.OBJECT else [] if kind == jsontree.ARRAY else spelled if kind == jsontree.STRING else json.loads(spelled)
        values.append(v)
        if parent < 0:
            out[int(f.text[i])] = v
        elif f.kind[parent] == jsontree.OBJECT:
            values[parent][f.names[f.name[i]]] = v
        else:
            assert len(values[parent]) == f.ordinal[i]
            values[parent].append(v)
    return out


def test_forest_against_the_parser_of_python():
    r = random.Random(7)

    def value(depth=0):
        x = r.random()
        if depth < 5 and x < 0.3:
            return [value(depth + 1) for _ in range(r.randint(0, 4))]
        if depth < 5 and x < 0.6:
            return {r.choice(["a", "b", "nodes[]", 'x"y', "\\q", "é", ""]): value(depth + 1) for _ in range(r.randint(0, 4))}
        return r.choice([1, -2.5, 1e300, "", "s", 'q"u', "b\\", "\né", '\\"', True, False, None, "[{,:}]"])

    texts = []
    for _ in range(700):
        t = json.dumps(value(), ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1]))
        at = r.randrange(len(t))
        texts += [t, t[:at], t[:at] + r.choice(["", t[at] * 2, '"', ",", "\\", "}", "]", ":", "1", " ", "\t", '"a"', "\x01"]) + t[at + 1 :]]
    texts += [None, "", " ", "1 2", '"a" "b"', '{"a":1,"a":{"a":[1]},"a":2}', '{"a":[1],"\\u0061":3}', "[1,]", '{"a"}', '{"a":"b":1}', "{,}", "[}", "{]", "01", "-", "1.", "+1", "1e5", '"\\u12"', '"\\u12G4"', '"\\x"', "NaN", '\\"', "[1]]", "[[1]", "]", '"abc']
    f = jsontree.parse(pa.array(texts, pa.string()))
    got = trees(f)
    for i, t in enumerate(texts):
        try:
            want = json.loads(t, parse_constant=lambda _: 1 / 0)
        except (ValueError, TypeError, ZeroDivisionError):
            assert not f.valid[i] and i not in got
        else:
            assert f.valid[i] and json.dumps(got[i]) == json.dumps(want), t

from __future__ import annotations

import os

import pytest

from kerbstone.llm import mixing
from kerbstone.llm.mixing import hash_key, mix, prefix_sums
from kerbstone.llm.tokens import VOCABULARY, Encoder, model_bytes

needs = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


def test_prefix_sums(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(mixing, "RANGE_ROWS", 200)
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "big").otherwise("small").alias("g"), hash_key(1, F.col("id")).alias("key"), (F.col("id") % 7).alias("n"))
    rows = rows.unionByName(rows.limit(5).withColumn("id", F.col("id") + 5000))  # equal keys
    got = {r["id"]: r["before"] for r in prefix_sums(rows, "g", "key", "id", "n").collect()}
    for g in ("big", "small"):
        total = 0
        for r in sorted((r for r in rows.collect() if r["g"] == g), key=lambda r: (r["key"], r["id"])):
            assert got[r["id"]] == total
            total += r["n"]


@needs
def test_shares_and_caps(spark):
    text = lambda i, n: f"word{i} " * n
    docs = [(i, text(i, 3 + i % 5), ("big", "mid", "tiny")[0 if i < 600 else 1 if i < 900 else 2], "x") for i in range(930)]
    docs += [(2000, None, "big", "x"), (2001, "", "mid", "x"), (2002, "no source", None, "x"), (2003, "unlisted", "other", "x"), (None, "no id", "big", "x"), docs[0]]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, n_tokens string")
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 3), ("tiny", 0.2, 4), ("absent", 0.0, 2)], "source string, target_share double, max_repeats int")
    got = mix(d, t)
    enc = Encoder(model_bytes())
    size = {i: len(x) for i, x in zip([r[0] for r in docs], enc.encode([r[1] for r in docs]), strict=True) if i is not None}
    total = sum(size.values())
    rows = got.chosen.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    assert all(size[r["doc_id"]] == r["n_tokens"] for r in rows)
    by = {s: [r for r in rows if r["source"] == s] for s in ("big", "mid", "tiny")}
    caps = {"big": 1, "mid": 3, "tiny": 4}
    shares = {r["source"]: r for r in got.shares.collect()}
    for s, share in (("big", 0.5), ("mid", 0.3), ("tiny", 0.2)):
        tokens = sum(r["n_tokens"] * r["repeats"] for r in by[s])
        own = {i: n for i, n in size.items() for x in docs if x[0] == i and x[2] == s}
        assert shares[s]["tokens"] == tokens
        assert shares[s]["share_of_total"] == pytest.approx(tokens / total)
        assert max(r["repeats"] for r in by[s]) <= caps[s]
        if sum(own.values()) * caps[s] >= share * total:
            assert abs(tokens - share * total) <= max(own.values()) / 2
        else:
            assert tokens == sum(own.values()) * caps[s]
    assert shares["absent"]["tokens"] == 0
    assert abs(sum(r["actual_share"] for r in shares.values()) - 1) < 1e-9


@needs
def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 1.0, 2), ("b", None, None)], "source string, target_share double, max_repeats int")
    got = mix(d, t)
    assert got.chosen.count() == 0
    assert {r["source"]: r["actual_share"] for r in got.shares.collect()} == {"a": 0.0, "b": 0.0}
    assert mix(d, t.limit(0)).shares.count() == 0

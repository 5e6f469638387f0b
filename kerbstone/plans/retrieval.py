"""Queries over descriptors: search, recall, reranking, negatives, triplets, and incremental results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbstone.functions.hashing import row_fingerprint
from kerbstone.functions.vectors import unit
from kerbstone.operators import incremental
from kerbstone.operators import retrieval as r
from kerbstone.runtime import table

DEPTH = 256


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every hundredth vector asks, all of them answer; ids are dense."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    return e.where("id % 100 = 0"), e


def _positives(queries: DataFrame, database: DataFrame) -> DataFrame:
    """Answers of the query's label, the query itself among them; a label is asked for about as often as it is answered."""
    return queries.select(F.col("id").alias("q"), "label").join(database.select(F.col("id").alias("d"), "label"), "label").select("q", "d")


def _top(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    queries, database = _vectors(spark, sf_dir)
    return r.top_k(queries, database, k, apart=True)


def vector_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, 10).select("q", "rank", "d", F.round("score", 6).alias("score"))


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, database = _vectors(spark, sf_dir)
    got = r.recall_at(_top(spark, sf_dir, 10), _positives(queries, database).where("q <> d"), queries.select(F.col("id").alias("q")))
    return got.select("k", F.round("recall", 6).alias("recall"))


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(unit(F.col("embedding"))).alias("pos", "value"))
    return e.select("vec_id", "pos", F.round("value", 6).alias("value"))


def _rows(queries: DataFrame) -> DataFrame:
    return queries.select(F.col("id").alias("q"), (F.col("id") / 100).cast("long").alias("row"))


def _reranked(spark: SparkSession, sf_dir: str, frames: int) -> DataFrame:
    """Candidates by the descriptor, ordered by its second half: a stand-in for an image descriptor."""
    queries, database = _vectors(spark, sf_dir)
    candidates = r.top_k(queries, database, 20, apart=True).join(_rows(queries), "q").select("q", "row", "d")
    half = lambda df: df.select("id", F.slice("v", 33, 32).alias("v"))
    return r.rerank(candidates, half(queries), half(database), frames, 10).select("q", "rank", "d", F.round("score", 6).alias("score"))


def rerank_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir, 1)


def rerank_sequence_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir, 3)


def two_stage_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, database = _vectors(spark, sf_dir)
    got = r.recall_at(_reranked(spark, sf_dir, 3), _positives(queries, database).where("q <> d"), queries.select(F.col("id").alias("q")))
    return got.select("k", F.round("recall", 6).alias("recall"))


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, database = _vectors(spark, sf_dir)
    return r.hard_negatives(queries, database, _positives(queries, database), 5, DEPTH)


def hard_negatives_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, database = _vectors(spark, sf_dir)
    near = r.top_k(queries, database, 3, apart=True).select("q", "d")
    return r.hard_negatives(queries, database, _positives(queries, database), 5, DEPTH, exclusions=near)


def hard_negatives_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, database = _vectors(spark, sf_dir)
    grouped = lambda df: df.withColumn("group", F.floor(F.col("id") / 100) % 2)
    return r.grouped_negatives(grouped(queries).select("id", "v", "group"), grouped(database).select("id", "v", "group"), _positives(queries, database), 3, DEPTH)


def random_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, database = _vectors(spark, sf_dir)
    return r.random_negatives(queries, database.count(), _positives(queries, database), 4, 7)


def epoch_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, database = _vectors(spark, sf_dir)
    return r.triplets(_positives(queries, database).where("q <> d"), hard_negatives(spark, sf_dir), 3)


def fingerprint_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", row_fingerprint(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority"), settings="v3").alias("fingerprint"))


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Yesterday's results: some keys missing, some of other settings, some changed, some stale."""
    k, f = F.col("o_orderkey"), F.col("fingerprint")
    expected = fingerprint_rows(spark, sf_dir).select(k.alias("key"), "fingerprint")
    old = F.when(F.col("key") % 11 == 0, F.lit("old")).otherwise(f)
    stored = expected.where("key % 7 <> 0").select("key", old.alias("fingerprint"), F.lit("a").alias("sha256"), F.when(F.col("key") % 13 == 0, "b").otherwise("a").alias("manifest_sha256"))
    return expected, stored.unionByName(expected.where("key % 100 = 1").select((-F.col("key")).alias("key"), "fingerprint", F.lit("a").alias("sha256"), F.lit("a").alias("manifest_sha256")))


def incremental_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.decide(*_stored(spark, sf_dir))


def incremental_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.manifest(incremental_decisions(spark, sf_dir))


def manifest_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, stored = _stored(spark, sf_dir)
    records = stored.join(expected.select("key", F.col("fingerprint").alias("expected")), "key", "left").select(F.col("key").alias("path"), "sha256", F.col("manifest_sha256").alias("stored_sha256"), "fingerprint", "expected")
    return incremental.validate(expected.select(F.col("key").alias("path")), records).groupBy("status").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        vector_topk_cosine, recall_at_k, unit_vectors, rerank_single, rerank_sequence_pool, two_stage_recall, hard_negatives, hard_negatives_excluded,
        hard_negatives_by_group, random_negatives, epoch_triplets, fingerprint_rows, incremental_decisions, incremental_manifest, manifest_validation,
    )
}

# ------------------------------------------------------------------ SQL counterparts

_BASE = """q AS (SELECT vec_id AS q, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0),
d AS (SELECT vec_id AS d, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q, d, list_cosine_similarity(q.v, d.v) AS score, q.label = d.label AS positive FROM q JOIN d ON q <> d),
t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM s)"""
_RERANK = _BASE.replace("%", "%%") + """, w AS (SELECT DISTINCT q + 100 * i AS q, d FROM t, (SELECT unnest(range(%d)) AS i) WHERE rank <= 20),
h AS (SELECT w.q, w.d, list_cosine_similarity(q.v[33:64], d.v[33:64]) AS score, q.label = d.label AND w.q <> w.d AS positive FROM w JOIN q USING (q) JOIN d USING (d)),
p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM h QUALIFY rank <= 10)"""
_RECALL = "SELECT k, round(100.0::DOUBLE * (SELECT count(DISTINCT q) FROM {0} WHERE positive AND rank <= k) / (SELECT count(*) FROM q), 6) AS recall FROM (VALUES (1), (5), (10)) c(k)"
_FINGERPRINT = "f AS (SELECT o_orderkey AS key, sha256(concat_ws(chr(31), 'v3', '=' || o_orderkey, coalesce('=' || o_custkey, '~'), coalesce('=' || o_orderstatus, '~'), coalesce('=' || o_orderpriority, '~'))) AS fingerprint FROM orders)"
_DECIDED = f"""{_FINGERPRINT}, act AS (SELECT key, CASE WHEN key % 7 <> 0 AND key % 11 <> 0 AND key % 13 <> 0 THEN 'reuse' ELSE 'compute' END AS action FROM f UNION ALL SELECT -key, 'stale' FROM f WHERE key % 100 = 1)"""

SQL = {
    "random_negatives": f"""WITH {_BASE}, bl AS (SELECT q, d FROM q JOIN d USING (label)), fr AS (SELECT q.q, (SELECT count(*) FROM d) - count(bl.d) AS free FROM q LEFT JOIN bl USING (q) GROUP BY q.q),
j AS (SELECT q, free, unnest(generate_series(1, CASE WHEN free <= 8 THEN free ELSE 64 END)) AS j FROM fr), dr AS (SELECT *, CAST('0x' || substr(md5('7|' || q || '|' || j), 1, 15) AS BIGINT) AS key FROM j),
rk AS (SELECT q, CASE WHEN free <= 8 THEN j - 1 ELSE key % free END AS r, min(CASE WHEN free <= 8 THEN key ELSE j END) AS k FROM dr GROUP BY 1, 2),
bw AS (SELECT q, d - (row_number() OVER (PARTITION BY q ORDER BY d) - 1) AS r FROM bl), c AS (SELECT rk.q, rk.k, rk.r + count(bw.r) AS d FROM rk LEFT JOIN bw ON bw.q = rk.q AND bw.r <= rk.r GROUP BY rk.q, rk.k, rk.r),
o AS (SELECT q, d, row_number() OVER (PARTITION BY q ORDER BY k, d) - 1 AS slot FROM c) SELECT q, slot, d FROM o WHERE slot < 4""",
    "vector_topk_cosine": f"WITH {_BASE} SELECT q, rank, d, round(score, 6) AS score FROM t WHERE rank <= 10",
    "recall_at_k": f"WITH {_BASE} {_RECALL.format('t')}",
    "unit_vectors": "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM e) SELECT vec_id, i - 1 AS pos, round(v[i] / n, 6) AS value FROM n, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i)",
    "rerank_single": f"WITH {_RERANK % 1} SELECT q, rank, d, round(score, 6) AS score FROM p",
    "rerank_sequence_pool": f"WITH {_RERANK % 3} SELECT q, rank, d, round(score, 6) AS score FROM p",
    "two_stage_recall": f"WITH {_RERANK % 3} {_RECALL.format('p')}",
    "hard_negatives": f"WITH {_BASE} SELECT q, row_number() OVER (PARTITION BY q ORDER BY rank) - 1 AS slot, d FROM t WHERE NOT positive AND rank <= {DEPTH} QUALIFY slot < 5",
    "hard_negatives_excluded": f"WITH {_BASE} SELECT q, row_number() OVER (PARTITION BY q ORDER BY rank) - 1 AS slot, d FROM t WHERE NOT positive AND rank > 3 AND rank <= {DEPTH} QUALIFY slot < 5",
    "hard_negatives_by_group": f"""WITH {_BASE}, g AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS r FROM s WHERE q // 100 % 2 = d // 100 % 2)
SELECT q, row_number() OVER (PARTITION BY q ORDER BY r) - 1 AS slot, d FROM g WHERE NOT positive AND r <= {DEPTH} QUALIFY slot < 3""",
    "epoch_triplets": f"""WITH {_BASE}, n AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY rank) - 1 AS slot, d FROM t WHERE NOT positive AND rank <= {DEPTH} QUALIFY slot < 5),
c AS (SELECT q, arg_min(d, md5(concat_ws('|', '{42 + 3 * 100_003}', q, d))) AS positive FROM s WHERE positive GROUP BY q) SELECT q, positive, slot, d AS negative FROM n JOIN c USING (q)""",
    "fingerprint_rows": f"WITH {_FINGERPRINT} SELECT key AS o_orderkey, fingerprint FROM f",
    "incremental_decisions": f"WITH {_DECIDED} SELECT key, action FROM act",
    "incremental_manifest": f"WITH {_DECIDED} SELECT count(*) FILTER (action <> 'stale') AS expected, count(*) FILTER (action = 'reuse') AS skipped, count(*) FILTER (action = 'compute') AS written, count(*) FILTER (action = 'stale') AS stale FROM act",
    "manifest_validation": f"""WITH {_FINGERPRINT}, v AS (SELECT CASE WHEN key % 7 = 0 THEN 'missing' WHEN key % 13 = 0 THEN 'changed' WHEN key % 11 = 0 THEN 'incompatible' ELSE 'ok' END AS status FROM f) SELECT status, count(*) AS n FROM v GROUP BY status""",
}

"""Exact vector search in blocks, recall, reranking by a second descriptor over a causal window, and negatives.

Descriptors are tables (id, v). Scores are cosines in double precision; of equal scores the smaller id comes first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbstone.functions.vectors import dot, unit
from kerbstone.runtime import global_number, materialise, parallelism

#: Bytes of vectors of a block of queries or of database rows; one task multiplies two blocks.
BLOCK_BYTES = 64 << 20
#: Scores that are held at a time.
SCORES = 8 << 20


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(flat) and (flat.null_count or set(np.diff(flat.offsets.to_numpy()).tolist()) != {dim}):
        raise ValueError(f"vectors must have {dim} values")
    m = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest scores of each row, of equal ones the first columns."""
    if scores.shape[1] <= k:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(scores, best, 1).min(axis=1)
    for i in np.nonzero((scores >= least[:, None]).sum(axis=1) > k)[0].tolist():
        above = np.nonzero(scores[i] > least[i])[0]
        best[i] = np.concatenate([above, np.nonzero(scores[i] == least[i])[0][: k - len(above)]])
    return best


def top_k(queries: DataFrame, database: DataFrame, k: int, apart: bool = False) -> DataFrame:
    """``q, rank, d, score``: the k database vectors most similar to each query vector, ranks from 1.

    Both sides have ``id, v``; rows with a null id or vector take no part, vectors of another width are an error. Both sides are
    cut into blocks of bounded size by hash, a task multiplies a block of queries with one of the database and keeps k per query, and the
    partial lists are merged. No vector passes through the driver. ``apart``: both sides are of one table, and no row answers itself.
    """
    if k < 1:
        raise ValueError("k must be positive")
    clean = lambda df: df.where("id IS NOT NULL AND v IS NOT NULL").select(F.col("id").cast("long"), F.col("v").cast("array<double>"))
    asked, known = clean(queries), clean(database)
    size = lambda df: df.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    q, d = size(asked), size(known)
    dim = d["dim"] or q["dim"] or 1
    blocks = lambda n: max(1, -(-n * dim * 8 // BLOCK_BYTES))
    # as few blocks of the database as keep all tasks busy, since every block of it reads all queries
    rows, columns = blocks(q["n"]), max(blocks(d["n"]), -(-parallelism(database.sparkSession) // blocks(q["n"])))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    a = asked.withColumn("i", own(rows)).withColumn("j", every(columns))
    b = known.withColumn("j", own(columns)).withColumn("i", every(rows))
    schema = pa.schema([("q", pa.int64()), ("d", pa.int64()), ("score", pa.float64())])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        right = right.sort_by("id")
        ids, names = left.column("id").to_numpy(), right.column("id").to_numpy()
        m, to = _matrix(left.column("v"), dim), _matrix(right.column("v"), dim).T
        parts = []
        step = max(1, SCORES // len(names))
        for at in range(0, len(ids), step):
            score = m[at : at + step] @ to
            if apart:
                score[names == ids[at : at + step, None]] = -np.inf
            best = _best(score, k)
            parts.append(pa.table([np.repeat(ids[at : at + step], best.shape[1]), names[best].ravel(), np.take_along_axis(score, best, 1).ravel()], schema=schema))
        return pa.concat_tables(parts)

    found = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(search, "q long, d long, score double")
    found = found.where("q <> d") if apart else found
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "d")))
    return ranked.where(F.col("rank") <= k).select("q", "rank", "d", "score")


def recall_at(nearest: DataFrame, positives: DataFrame, queries: DataFrame, cutoffs: Sequence[int] = (1, 5, 10), scale: float = 100.0) -> DataFrame:
    """``k, recall``: the share of queries with a positive among their first k; every query counts, also without positives."""
    wanted = sorted({int(c) for c in cutoffs})
    hits = nearest.join(positives.select("q", "d").distinct(), ["q", "d"]).groupBy("q").agg(F.min("rank").alias("first"))
    each = queries.select("q").distinct().join(hits, "q", "left")
    rates = each.agg(*[F.coalesce(F.avg(F.coalesce((F.col("first") <= c).cast("double"), F.lit(0.0))), F.lit(0.0)).alias(f"k{c}") for c in wanted])
    return rates.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), (F.col(f"k{c}") * scale).alias("recall")) for c in wanted])).alias("r")).select("r.*")


def rerank(candidates: DataFrame, queries: DataFrame, database: DataFrame, frames: int = 1, depth: int | None = None) -> DataFrame:
    """``q, rank, d, score``: the candidates of the last ``frames`` queries, each once, ordered by a second descriptor.

    ``candidates`` has ``q, row, d``, the rows numbering the queries in order, so the window counts queries and never looks
    ahead. Candidates pass their query's place on to the next rows by an equi join; nothing is sorted as a whole.
    """
    if frames < 1:
        raise ValueError("frames must be at least 1")
    rows = candidates.select("row", "q").distinct()
    passed = candidates.where("d >= 0").select("d", F.explode(F.sequence(F.col("row"), F.col("row") + (frames - 1))).alias("row"))
    pool = passed.join(rows, "row").select("row", "q", "d").distinct()
    a = queries.select(F.col("id").alias("q"), unit(F.col("v")).alias("_q"))
    b = database.select(F.col("id").alias("d"), unit(F.col("v")).alias("_d"))
    scored = pool.join(a, "q").join(b, "d").select("q", "d", dot(F.col("_q"), F.col("_d")).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "d")))
    return (ranked if depth is None else ranked.where(F.col("rank") <= depth)).select("q", "rank", "d", "score")


def aligned(paths: DataFrame, descriptors: DataFrame) -> DataFrame:
    """``row, v``: image descriptors (sequence, frame_id, v) in the order of prepared paths (row, path); the query fails on a frame without one."""
    parts = F.split(F.translate("path", "\\", "/"), "/")
    keyed = paths.withColumn("sequence", F.element_at(parts, -2)).withColumn("frame_id", F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", ""))
    found = keyed.join(descriptors, ["sequence", "frame_id"], "left")
    return found.select("row", F.coalesce("v", F.raise_error(F.concat(F.lit("no image descriptor for frame "), "path")).cast("array<double>")).alias("v"))


def _random_candidates(queries: DataFrame, blocked: DataFrame, n: int, size: int, seed: int) -> DataFrame:
    """``q, d, k``: for each query (q) pseudo-random database numbers that aren't blocked (q, d), each once, in the order of k.

    Draws are ranks among the numbers left: the r-th of those is r and as many as there are blocked ones of a lower rank. Where
    no more than 2n are left, all of them are drawn.
    """
    at = F.row_number().over(Window.partitionBy("q").orderBy("d")) - 1
    taken = blocked.where(F.col("d").between(0, size - 1)).join(queries.select("q"), "q", "left_semi").select("q", (F.col("d") - at).alias("r"))
    free = queries.select("q").join(taken.groupBy("q").agg(F.count("*").alias("b")), "q", "left").select("q", (F.lit(size) - F.coalesce("b", F.lit(0))).alias("free")).where("free > 0")
    few = F.col("free") <= 2 * n
    tries = F.when(few, F.col("free")).otherwise(F.lit(8 * n + 32))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "q", "j")), 1, 15), 16, 10).cast("long")
    drawn = free.select("q", "free", F.explode(F.sequence(F.lit(1).cast("long"), tries)).alias("j")).withColumn("key", key)
    drawn = drawn.select("q", F.when(few, F.col("j") - 1).otherwise(F.col("key") % F.col("free")).alias("r"), F.when(few, F.col("key")).otherwise(F.col("j")).alias("k"))
    drawn = drawn.groupBy("q", "r").agg(F.min("k").alias("k"))
    both = taken.select("q", "r", F.lit(None).cast("long").alias("k")).unionByName(drawn)
    lower = F.count_if(F.col("k").isNull()).over(Window.partitionBy("q").orderBy("r", F.col("k").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("d", F.col("r") + lower).where("k IS NOT NULL").select("q", "d", "k")


def _repeat_to(selected: DataFrame, n: int) -> DataFrame:
    """``q, slot, d``: lists (q, k, d) cut to n, shorter ones repeated in turn."""
    lists = selected.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("k", "d"))).alias("l")).withColumn("l", F.slice("l", 1, n))
    slots = lists.select("q", "l", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot"))
    return slots.select("q", "slot", F.element_at("l", (F.pmod(F.col("slot"), F.size("l")) + 1).cast("int")).getField("d").alias("d"))


def hard_negatives(queries: DataFrame, database: DataFrame, positives: DataFrame, n: int, depth: int = 256, seed: int = 0, exclusions: DataFrame | None = None, size: int | None = None) -> DataFrame:
    """``q, slot, d``: the n nearest database items that are neither positives nor excluded.

    Database ids are dense from 0. Where the search to ``depth`` has too few, pseudo-random ones fill up; where there are too
    few at all, they repeat in turn; a query whose whole database is blocked has none.
    """
    if n < 0:
        raise ValueError("n can't be negative")
    size = database.count() if size is None else size
    if not n or not size:
        return positives.select("q", F.lit(0).alias("slot"), "d").where(F.lit(False))
    blocked = positives.select("q", "d")
    blocked = (blocked if exclusions is None else blocked.unionByName(exclusions.select("q", "d"))).distinct()
    nearest = top_k(queries, database, min(max(depth, n, 1), size))
    found = nearest.join(blocked, ["q", "d"], "left_anti").select("q", F.col("rank").cast("long").alias("k"), "d")
    found = found.withColumn("_at", F.row_number().over(Window.partitionBy("q").orderBy("k"))).where(F.col("_at") <= n).drop("_at")
    counts = queries.select(F.col("id").alias("q")).distinct().join(found.groupBy("q").agg(F.count("*").alias("c")), "q", "left").where(F.coalesce("c", F.lit(0)) < n)
    taken = blocked.unionByName(found.select("q", "d"))
    filled = _random_candidates(counts, taken, n, size, seed).select("q", (F.col("k") + size).alias("k"), "d")
    return _repeat_to(found.unionByName(filled), n)


def random_negatives(queries: DataFrame, size: int, positives: DataFrame, n: int, seed: int = 0, exclusions: DataFrame | None = None) -> DataFrame:
    """``q, slot, d``: pseudo-random items that aren't blocked, the same for the same seed; too few repeat in turn."""
    blocked = positives.select("q", "d")
    blocked = (blocked if exclusions is None else blocked.unionByName(exclusions.select("q", "d"))).distinct()
    asked = queries.select(F.col("id").alias("q")).distinct()
    return _repeat_to(_random_candidates(asked, blocked, n, size, seed), n)


def grouped_negatives(queries: DataFrame, database: DataFrame, positives: DataFrame, n: int, depth: int = 256, seed: int = 0, exclusions: DataFrame | None = None) -> DataFrame:
    """``q, slot, d`` with negatives of the query's own group (id, v, group) only: hard_negatives of each group on its own,
    over the group's own ids numbered from 0."""
    names = [r["group"] for r in queries.select("group").distinct().collect()]  # cameras: a handful
    out = None
    for name in names:
        own = lambda df, name=name: df.where(F.col("group").eqNullSafe(F.lit(name))).drop("group")
        numbered = materialise(global_number(own(database).where("id IS NOT NULL AND v IS NOT NULL"), [], ["id"], "local"), "group")
        ids = numbered.select("local", F.col("id").alias("d"))
        inside = lambda pairs, ids=ids: pairs.join(ids, "d").select("q", F.col("local").alias("d"))
        mined = hard_negatives(own(queries), numbered.select(F.col("local").alias("id"), "v"), inside(positives), n, depth, seed, None if exclusions is None else inside(exclusions))
        part = mined.withColumnRenamed("d", "local").join(ids, "local").select("q", "slot", "d")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else positives.select("q", F.lit(0).alias("slot"), "d").where(F.lit(False))


def triplets(positives: DataFrame, negatives: DataFrame, epoch: int, seed: int = 42, ignored: DataFrame | None = None) -> DataFrame:
    """``q, positive, slot, negative`` of an epoch: one positive per query by a seeded digest, each mined negative (q, slot, d)
    that is neither a positive nor ignored; queries without either are left out."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed + epoch * 100_003)), F.col("q"), F.col("d")))
    chosen = positives.select("q", "d", key.alias("k")).groupBy("q").agg(F.min_by("d", "k").alias("positive"))
    blocked = positives.select("q", "d") if ignored is None else positives.select("q", "d").unionByName(ignored.select("q", "d"))
    usable = negatives.join(blocked.distinct(), ["q", "d"], "left_anti")
    return chosen.join(usable, "q").select("q", "positive", "slot", F.col("d").alias("negative"))

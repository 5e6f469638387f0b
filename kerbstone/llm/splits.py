"""Train, validation and test parts that keep related records together.

Records sharing a drive or a place, also through others, form components (alternating large-star and
small-star rounds over the keys, not the records). Components of equal size and commonest label are bundled.
What a part still lacks is given to it of each bundle, rounded down to whole components; those left over are placed by a min-cost flow
whose costs are what the parts' quotas, and each label's quotas, are missed by. A bundle's members are dealt to the parts in the order of
their label profiles, of equal ones by hash, so that each profile is spread in proportion.
"""

from __future__ import annotations

import heapq
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbstone.llm.mixing import hash_key
from kerbstone.runtime import drop, global_number, materialise, salted_join

PARTS = (("train", 0.7), ("validation", 0.1), ("test", 0.2))
#: Keys that relate nothing.
PLACEHOLDERS = ("", "unknown", "n/a", "-")
#: Rounds after which the search for components gives up; it needs the logarithm of the longest path.
MOST_ROUNDS = 60
#: Labels whose shares are balanced one by one; the rarer ones are balanced as one label.
LABELS = 64
#: Bundles from which the driver warns that it takes long; the result doesn't depend on it. Of n records there are at most sqrt(2 * LABELS * n).
MOST_BUNDLES = 500_000
#: What a record beyond a label's quota costs, where one beyond a part's quota costs 1.
LABEL_COST = 0.01


def relation(key: Column) -> Column:
    """A key without case and surrounding blanks; null where it relates nothing."""
    k = F.regexp_replace(F.lower(key), r"(?U)^\s+|\s+$", "")
    return F.when(~k.isin(*PLACEHOLDERS), k)


def _digest(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of ``edges`` (u, v): the smallest node of each component.

    Large-star links every larger neighbour to the smallest one, small-star every smaller; the
    smallest neighbours are pre-aggregated and handed back by a salted join, so a node with a third of all
    edges is no single task's work. Each round is written to the shared folder.
    """
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _digest(edges)
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both.where("v > u"), low, ["u"], "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # the smallest node of a neighbourhood keeps no edge of its own to itself
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, low, ["u"], "v").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        last, edges = edges, materialise(small, "edges")
        drop(last)
        now = _digest(edges)
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now
    raise RuntimeError("the components didn't settle")


def distinct_records(records: DataFrame) -> DataFrame:
    """``record_id, drive, place, label``: one row per id; of rows that differ the largest counts."""
    seen = records.where("record_id IS NOT NULL").select("record_id", F.struct(relation(F.col("drive_id")).alias("drive"), relation(F.col("place_id")).alias("place"), F.coalesce("source", F.lit("")).alias("label")).alias("r"))
    return seen.groupBy("record_id").agg(F.max("r").alias("r")).select("record_id", "r.*")


def grouped(records: DataFrame) -> DataFrame:
    """``record_id, label, group_id, size`` of every record; alone, a record is its own group.

    A key stands for its smallest record, so that only pairs of keys met in one record are edges and the
    root of a component is its smallest record.
    """
    one = materialise(distinct_records(records), "records")
    for key in ("drive", "place"):
        firsts = one.where(f"{key} IS NOT NULL").groupBy(key).agg(F.min("record_id").alias(f"{key}_first"))
        one = salted_join(one, firsts, [key], "record_id", how="left")
    one = materialise(one.select("record_id", "label", "drive_first", "place_first"), "keyed")
    roots = components(one.where("drive_first IS NOT NULL AND place_first IS NOT NULL").select(F.col("drive_first").alias("u"), F.col("place_first").alias("v")))
    rooted = salted_join(one.withColumn("node", F.coalesce("drive_first", "place_first", "record_id")), roots, ["node"], "record_id", how="left").select("record_id", "label", F.coalesce("root", "node").alias("group_id"))
    rooted = materialise(rooted, "rooted")
    sizes = rooted.groupBy("group_id").agg(F.count("*").alias("size"))
    return salted_join(rooted, sizes, ["group_id"], "record_id")


def related(records: DataFrame) -> DataFrame:
    """``record_id, group_id`` of each record that must stay with at least one other."""
    return grouped(records).where("size > 1").select("record_id", "group_id")


@dataclass(frozen=True)
class Bundle:
    """``count`` components of ``size`` records, ``profile[i]`` of them, on average, with the i-th label."""

    size: int
    profile: tuple[float, ...]
    count: int


class Flow:
    """Min-cost flow of indivisible components of one size from their bundles to the parts.

    Successive shortest paths. A unit may enter a part, or enter one and push another bundle's unit on to the next part; the best unit to
    push on from part to part is kept in heaps, so that paths are searched over the parts alone.
    """

    def __init__(self, costs: np.ndarray, entry) -> None:
        """``costs[b, p]``: of a unit of bundle b in part p; ``entry(p, n)``: of the n-th unit in part p, not decreasing in n."""
        self.costs, self.entry = costs, entry
        parts = costs.shape[1]
        self.held = np.zeros(costs.shape, np.int64)
        self.load = [0] * parts
        self.moves: list[list[list[tuple[float, int]]]] = [[[] for _ in range(parts)] for _ in range(parts)]

    def _best(self, p: int, q: int) -> tuple[float, int] | None:
        heap = self.moves[p][q]
        while heap and not self.held[heap[0][1], p]:
            heapq.heappop(heap)
        return heap[0] if heap else None

    def _put(self, b: int, p: int) -> None:
        if not self.held[b, p]:
            for q in range(len(self.load)):
                if q != p:
                    heapq.heappush(self.moves[p][q], (float(self.costs[b, q] - self.costs[b, p]), b))
        self.held[b, p] += 1

    def add(self, b: int) -> None:
        """One more unit of bundle b, along the shortest augmenting path."""
        parts = range(len(self.load))
        dist = [float(self.costs[b, p]) for p in parts]
        via: list[tuple[int, int] | None] = [None for _ in parts]
        for _ in parts:
            for p in parts:
                for q in parts:
                    step = self._best(p, q) if p != q else None
                    if step is not None and dist[p] + step[0] < dist[q] - 1e-9:
                        dist[q], via[q] = dist[p] + step[0], (p, step[1])
        end = min(parts, key=lambda p: (dist[p] + self.entry(p, self.load[p]), p))
        self.load[end] += 1
        at = end
        while via[at] is not None:
            before, pushed = via[at]
            self.held[pushed, before] -= 1
            self._put(pushed, at)
            at = before
        self._put(b, at)


def allocate(bundles: list[Bundle], parts: tuple[tuple[str, float], ...] = PARTS) -> dict[Bundle, list[int]]:
    """How many components of each bundle go to each part.

    Sizes are placed from the largest down, so that smaller components make up for what larger ones miss. Of a bundle each part is given what
    it still lacks of all records, as a share, rounded down to whole components. The components left over, fewer of each bundle than there
    are parts, are placed by a min-cost flow: its costs are how much nearer or farther a component brings the part to its quota of
    records and, much cheaper, to its quota of each label. A part of no share gets nothing.
    """
    share = np.array([s for _, s in parts], float)
    given = {b: [0] * len(parts) for b in bundles}
    if not bundles:
        return given
    open_ = [j for j in range(len(parts)) if share[j] > 0] or [0]
    profile = {b: np.array(b.profile, float) for b in bundles}
    labels = sum(profile[b] * b.count for b in bundles)
    quota = np.outer(share, labels)
    missing = share * sum(b.size * b.count for b in bundles)
    by_size: dict[int, list[Bundle]] = {}
    for b in sorted(bundles, key=lambda b: (-b.size, b.profile)):
        by_size.setdefault(b.size, []).append(b)
    for size, same in by_size.items():
        lacking = np.maximum(missing, 0)
        lacking = lacking / lacking.sum() if lacking.any() else share / share.sum()
        for b in same:
            given[b] = [int(b.count * s + 1e-9) for s in lacking]
            missing -= np.array(given[b]) * size
            quota -= np.outer(given[b], profile[b])
        left = [b.count - sum(given[b]) for b in same]
        if not any(left):
            continue
        profiles = np.array([profile[b] for b in same])
        # how much farther from, less how much nearer to, the labels' quotas a unit brings each part
        costs = np.array([[LABEL_COST * (np.abs(quota[j] - p) - np.abs(quota[j])).sum() for j in open_] for p in profiles])
        entry = lambda p, n, size=size: abs(missing[open_[p]] - (n + 1) * size) - abs(missing[open_[p]] - n * size)
        flow = Flow(costs, entry)
        for b, n in enumerate(left):
            for _ in range(n):
                flow.add(b)
        for i, b in enumerate(same):
            for k, j in enumerate(open_):
                n = int(flow.held[i, k])
                given[b][j] += n
                missing[j] -= n * size
                quota[j] -= n * profile[b]
    return given


def profiles(members: DataFrame) -> DataFrame:
    """``group_id, size, profile``: the number of each component's records by label, in the order of the labels' frequency."""
    counts = members.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(LABELS - 1).collect()
    names = [r["label"] for r in counts]
    ranked = F.coalesce(*[F.when(F.col("label") == n, F.lit(i)) for i, n in enumerate(names)], F.lit(len(names))) if names else F.lit(0)
    votes = members.select("group_id", ranked.alias("rank")).groupBy("group_id", "rank").agg(F.count("*").alias("n"))
    width = len(names) + 1
    of = F.map_from_entries(F.collect_list(F.struct("rank", "n")))
    each = votes.groupBy("group_id").agg(F.sum("n").alias("size"), of.alias("by"))
    return each.select("group_id", "size", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("by", i), F.lit(0).cast("long"))).alias("profile"))


def dealt(position: Column, count: Column, given: Column, parts: int) -> Column:
    """The part (0, 1, ...) of the component at a 0-based position of a bundle that gives ``given[j]`` of its ``count`` to part j.

    Each part's components lie evenly among those that the parts before it leave.
    """
    part, left, at = F.lit(None).cast("int"), count, position
    taken = lambda k, t, n: F.call_function("div", k * t * 2 + n, n * 2)  # noqa: E731  # of the first k
    for j in range(parts):
        t = given[j]
        before = taken(at, t, left)
        part = F.coalesce(part, F.when(taken(at + 1, t, left) > before, F.lit(j)))
        at, left = at - before, F.greatest(left - t, F.lit(1))
    return part


def assign_parts(records: DataFrame, parts: tuple[tuple[str, float], ...] = PARTS, seed: int = 42) -> DataFrame:
    """``record_id, group_id, part``: every record, groups whole, shares of records as near as can be.

    Bundles of equal size and commonest label are collected to solve the flow with their mean profiles; with LABELS labels they number at most the
    square root of 2 * LABELS times the records. What the parts are given goes back by a broadcast of as many rows. A null source is a label of its own.
    """
    spark = records.sparkSession
    members = materialise(grouped(records), "grouped")
    kind = F.array_position("profile", F.array_max("profile"))
    groups = materialise(profiles(members).select("group_id", "size", "profile", kind.alias("kind"), hash_key(seed, F.col("group_id")).alias("key")), "groups")
    width = groups.agg(F.max(F.size("profile"))).first()[0] or 0
    found = groups.groupBy("size", "kind").agg(F.count("*").alias("n"), F.array(*[F.avg(F.col("profile")[i]) for i in range(width)]).alias("profile")).orderBy("size", "kind").collect()
    if len(found) > MOST_BUNDLES:
        warnings.warn(f"{len(found)} bundles are placed on the driver", stacklevel=2)
    bundles = [Bundle(r["size"], tuple(r["profile"]), r["n"]) for r in found]
    placed = allocate(bundles, parts)
    rows = [(r["size"], r["kind"], i, r["n"], placed[b]) for i, (r, b) in enumerate(zip(found, bundles, strict=True))]
    given = F.broadcast(spark.createDataFrame(rows, "size long, kind long, bundle int, count long, given array<long>"))
    ranked = global_number(groups.join(given, ["size", "kind"]), ["bundle"], ["profile", "key", "group_id"], "position")
    part = F.array(*[F.lit(name) for name, _ in parts])[dealt(F.col("position"), F.col("count"), F.col("given"), len(parts))]
    return salted_join(members.select("record_id", "group_id"), ranked.select("group_id", part.alias("part")), ["group_id"], "record_id")


def deviations(assigned: DataFrame, parts: tuple[tuple[str, float], ...] = PARTS) -> DataFrame:
    """``part, records, groups, off``: what each part got, and by how many records it misses its quota."""
    total = assigned.count()
    wanted = F.create_map(*[x for name, s in parts for x in (F.lit(name), F.lit(s * total))])
    got = assigned.groupBy("part").agg(F.count("*").alias("records"), F.count_distinct("group_id").alias("groups"))
    return got.withColumn("off", F.round(F.abs(F.col("records") - F.element_at(wanted, F.col("part"))), 6))

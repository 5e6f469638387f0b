from __future__ import annotations

from kerbstone.operators import retrieval as r


def test_grouped_negatives_fill_from_the_group_beyond_the_depth(spark):
    """All of the depth are positives of query 0; query 1 has one negative in the depth, and exclusions."""
    db = spark.createDataFrame([(10 * i + g, [1.0, i / 10], g) for g in (0, 1) for i in range(6)], 'id long, v array<double>, `group` int')
    q = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 7)], 'id long, v array<double>, `group` int')
    positives = spark.createDataFrame([(0, 0), (0, 10), (0, 20), (0, 1), (1, 1), (1, 11)], "q long, d long")
    excluded = spark.createDataFrame([(1, 31)], "q long, d long")

    def got(**more):
        lists: dict[int, set[int]] = {}
        for row in r.grouped_negatives(q, db, positives, 3, 3, **more).collect():
            lists.setdefault(row["q"], set()).add(row["d"])
        return lists

    assert got()[0] == {30, 40, 50} and len(got()[1]) == 3 and {21} < got()[1] <= {21, 31, 41, 51}
    assert got(exclusions=excluded) == {0: {30, 40, 50}, 1: {21, 41, 51}}

from __future__ import annotations

import pytest

from kerbstone.plans import annotations, places, retrieval, training_data
from tests.compare import same

CASES = [(m, n) for m in (training_data, annotations, places, retrieval) for n in m.SQL]


@pytest.mark.parametrize(("module", "name"), CASES, ids=[n for _, n in CASES])
def test_query_equals_its_sql(spark, module, name):
    same(spark, module, name, "/root/testdata/sf0.001")


#: Operators with buckets, leaves, grids or blocks, which sf0.001 hardly fills.
LARGER = ("p1_found", "p2_found", "p5_found", "catalog_defects", "interval_positives_inherited", "radius_positives_2d", "revisits", "vector_topk_cosine", "hard_negatives_by_group", "random_negatives")


@pytest.mark.parametrize(("module", "name"), [c for c in CASES if c[1] in LARGER], ids=[n for _, n in CASES if n in LARGER])
def test_larger_tables(spark, small, module, name):
    same(spark, module, name, small)


@pytest.mark.parametrize("name", ["frame_descriptors", "frame_descriptors_node", "frame_descriptors_additive"])
def test_descriptors_have_unit_length(spark, name):
    rows = annotations.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 20 and {round(r["norm2"], 4) for r in rows} == {1.0} and {r["width"] for r in rows} == {256}

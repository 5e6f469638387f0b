from __future__ import annotations

import pytest

from kerbstone.llm import plans
from tests.compare import same


@pytest.mark.parametrize("name", list(plans.SQL))
def test_query_equals_its_sql(spark, small, name):
    # sf0.001 has no record that stands alone, so that no split of whole groups need meet the quotas
    same(spark, plans, name, small if name == "p4_quotas" else "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", [n for n in plans.QUERIES if n not in plans.SQL])
def test_query_has_a_stable_schema(spark, name):
    df = plans.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.count() >= 0 and df.columns == plans.QUERIES[name](spark, "/root/testdata/sf0.001").columns


def test_columns_of_the_fixed_results(spark):
    want = {"p3_found": ["record_a", "record_b"], "p4_found": ["record_id", "group_id"], "p6_found": ["ann_id", "det_pos", "sign_id"], "p7_found": ["sequence", "idx", "sample_id"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"]}
    for name, columns in want.items():
        assert plans.QUERIES[name](spark, "/root/testdata/sf0.001").columns == columns

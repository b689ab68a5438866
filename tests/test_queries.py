"""Every registered query against its SQL twin on the smallest tables."""

import oracle
import pytest

from assayframe.plans import registry

registry.load_all()
SF = f"{oracle.ROOT}/sf0.001"
# The smallest tables have ten suppliers and few letters; these need more to say anything.
LARGER = {"f6_size_matched_control", "f7_arm_sizes", "f9_test_survivors", "f4_stage_counts", "f3_greedy_orders_wide", "f3_greedy_documents"}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, name):
    sf = f"{oracle.ROOT}/sf0.01" if name in LARGER else SF
    oracle.compare(spark, oracle.connect(sf), name, registry.QUERIES[name], registry.ORACLES.get(name), sf)


def test_every_twin_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)

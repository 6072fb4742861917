"""Every query against DuckDB on the same tables."""

from __future__ import annotations

import pytest
from compare import connect, differences

from ledgerlake.plans.oracle import oracle_sql
from ledgerlake.plans.queries import queries

#: Queries whose rule finds nothing in the smallest tables, so they run on the next larger ones.
LARGER = {"r13_identifier_overlaps", "r14_overlap_probe", "p2_in_flight", "i7_shared_identifiers", "c8_restated_options", "c10_applied_restatement", "c11_option_faults", "i6_merged_names", "i6_merged_instruments", "i6_merge_instruments"}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, sf_dir, name):
    folder = sf_dir.replace("sf0.001", "sf0.01") if name in LARGER else sf_dir
    assert differences(queries()[name](spark, folder), connect(folder), oracle_sql()[name]) == ""


def test_every_query_has_sql():
    assert queries().keys() == oracle_sql().keys()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["scope_id", "val_date", "total_value", "unpriced"]
    assert __spark_entry__.queries().keys() >= __spark_entry__.oracle_sql().keys()

"""Portfolio members: filters without a value, and filters that are put together only where a posting can meet them."""

from __future__ import annotations

from ledgerlake.operators.holdings import portfolio_members
from ledgerlake.sources.fixture import Ledger


def test_a_category_of_filters_that_match_nothing_leaves_no_member(spark):
    postings = spark.createDataFrame([(1, 1, "A", "x", 5), (2, 1, "A", "y", None), (3, 1, "B", "x", 6)], "tx_id long, user_id long, broker string, account string, instrument_id long")
    rows = [(1, "broker", "A"), (2, "broker", "A"), (2, "instrument", None), (3, "instrument", "5"), (3, "instrument", "6"), (3, "instrument", "5"), (3, "instrument", None), (4, "account", None), (5, "account", "x"), (5, "instrument", "6")]
    filters = spark.createDataFrame([(p, 1, kind, value) for p, kind, value in rows], "portfolio_id long, user_id long, filter_type string, filter_value string")
    found = portfolio_members(postings, filters)
    assert sorted((r["portfolio_id"], r["tx_id"]) for r in found.collect()) == [(1, 1), (1, 2), (3, 1), (3, 3), (5, 3)]


def test_members_by_the_filters_met_are_those_by_all(spark, sf_dir):
    x = Ledger(spark, sf_dir.replace("sf0.001", "sf0.01"))
    members = lambda filters: portfolio_members(x["postings"], filters).select("portfolio_id", "tx_id")
    some, every = members(x.met_filters()), members(x["filters"])
    assert some.exceptAll(every).isEmpty() and every.exceptAll(some).isEmpty() and not some.isEmpty()


def test_filters_met_are_no_more_than_what_is_held(spark, tmp_path):
    """3,000 customers and 20,000 parts make 240,000 instrument filters in the view; ten postings leave ten pairs at most."""
    spark.range(3_000).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(20_000).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(10).selectExpr("id AS o_orderkey", "id * 5 + 3 AS o_custkey", "timestamp_ntz'1997-01-01' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    line = ["id AS l_orderkey", "id * 5 + 3 + id % 2 AS l_partkey", "id AS l_suppkey", "CAST(1 AS INT) AS l_linenumber", "1D AS l_quantity", "1D AS l_extendedprice", "0D AS l_discount", "0D AS l_tax", "'N' AS l_returnflag", "'O' AS l_linestatus", "timestamp_ntz'1997-01-01' AS l_shipdate"]
    spark.range(10).selectExpr(*line).write.parquet(f"{tmp_path}/lineitem.parquet")
    x = Ledger(spark, str(tmp_path))
    met = x.met_filters().where("filter_type = 'instrument' and filter_value is not null")
    assert sorted((r["user_id"], r["filter_value"]) for r in met.collect()) == [(k, str(k)) for k in (3, 13, 23, 33, 43)]
    assert sorted((r["portfolio_id"], r["tx_id"]) for r in portfolio_members(x["postings"], x.met_filters()).where("user_id % 5 = 3").collect()) == [(k, k // 5 * 1000 + 1) for k in (3, 13, 23, 33, 43)]

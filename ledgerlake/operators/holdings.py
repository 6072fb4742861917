"""Positions, portfolio membership, external flows and residual reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.decimals import qty_is_zero
from ledgerlake.operators.rounds import settled

RESIDUAL_TYPES = ("IMBALANCE", "TRANSFER_CLEARING", "SOURCE_ROUNDING")


def _open_positions(rows: DataFrame, instruments: DataFrame, keys: list[str]) -> DataFrame:
    inexact = F.count_if(F.col("split_adjusted_quantity") != F.col("quantity").cast("decimal(38,12)"))
    named = rows.join(instruments.select("instrument_id", "name"), "instrument_id", "left")
    sums = named.groupBy(*keys, "instrument_id", "name").agg(F.sum("split_adjusted_quantity").alias("quantity"), inexact.alias("inexact"), F.max("description").alias("description"))
    still = sums.where(~qty_is_zero(F.col("quantity"), F.col("inexact")))
    return still.select(*keys, "instrument_id", F.coalesce("name", "description").alias("name"), "quantity")


def holdings(postings: DataFrame, instruments: DataFrame, as_of: str, user_id=None, broker: str | None = None, account: str | None = None) -> DataFrame:
    """Open positions by user, broker, account and instrument at the end of ``as_of``; USER postings only.

    Postings without an instrument make one position for each account, named by the largest description.
    """
    rows = postings.where((F.col("account_type") == "USER") & (F.col("order_date") <= F.lit(as_of).cast("date")))
    for name, value in (("user_id", user_id), ("broker", broker), ("account", account)):
        rows = rows.where(F.col(name) == value) if value is not None else rows
    return _open_positions(rows, instruments, ["user_id", "broker", "account"])


def portfolio_members(postings: DataFrame, filters: DataFrame) -> DataFrame:
    """Postings by portfolio_id: a posting must match one filter in each category that the portfolio filters by.

    A portfolio without filters has no members; an instrument filter matches no posting without instrument, and
    one without a value matches nothing. Brokers and accounts are few and come along as sets. A portfolio may
    name any number of instruments, so those meet postings by user and value, each at most once.
    """
    kind, value = F.col("filter_type"), F.col("filter_value")
    has = lambda name: F.max(kind == name)
    values = lambda name: F.collect_set(F.when(kind == name, value))
    wanted = filters.groupBy("portfolio_id", "user_id").agg(has("broker").alias("_by_broker"), values("broker").alias("_brokers"), has("account").alias("_by_account"), values("account").alias("_accounts"), has("instrument").alias("_by_instrument"))
    named = filters.where(kind == "instrument").select("portfolio_id", "user_id", value.alias("_value")).distinct().withColumn("_named", F.lit(True))
    passes = lambda by, held, found: ~F.col(by) | F.coalesce(F.array_contains(held, found), F.lit(False))
    rows = postings.join(wanted, "user_id").where(passes("_by_broker", "_brokers", F.col("broker")) & passes("_by_account", "_accounts", F.col("account")))
    rows = rows.withColumn("_value", F.when(F.col("_by_instrument"), F.col("instrument_id").cast("string")))
    members = rows.join(named, ["portfolio_id", "user_id", "_value"], "left").where(~F.col("_by_instrument") | F.col("_named"))
    return members.select(*postings.columns, "portfolio_id")


def portfolio_holdings(postings: DataFrame, filters: DataFrame, instruments: DataFrame, as_of: str) -> DataFrame:
    """Open positions of each portfolio's members at the end of ``as_of``."""
    rows = portfolio_members(postings, filters).where((F.col("account_type") == "USER") & (F.col("order_date") <= F.lit(as_of).cast("date")))
    return _open_positions(rows, instruments, ["portfolio_id", "broker", "account"])


def matched_sides(matches: DataFrame) -> DataFrame:
    """Both sides of each transfer match: (group_id, instrument_id, other_group_id)."""
    one = matches.select(F.col("from_group_id").alias("group_id"), "instrument_id", F.col("to_group_id").alias("other_group_id"))
    return one.unionByName(matches.select(F.col("to_group_id").alias("group_id"), "instrument_id", F.col("from_group_id").alias("other_group_id"))).distinct()


def unmatched(postings: DataFrame, matches: DataFrame) -> DataFrame:
    """Postings whose group and instrument no transfer match names."""
    return postings.join(matched_sides(matches).select("group_id", "instrument_id").distinct(), ["group_id", "instrument_id"], "left_anti")


def in_flight(members: DataFrame, matches: DataFrame) -> DataFrame:
    """Member clearing legs whose matched counterpart is a member of the same portfolio: transfers under way inside it."""
    legs = members.where("account_type = 'TRANSFER_CLEARING' and instrument_id is not null")
    ends = legs.select("portfolio_id", "group_id", "instrument_id").distinct()
    inside = ends.join(matched_sides(matches), ["group_id", "instrument_id"]).join(ends.withColumnRenamed("group_id", "other_group_id"), ["portfolio_id", "other_group_id", "instrument_id"], "left_semi")
    return legs.join(inside.select("portfolio_id", "group_id", "instrument_id").distinct(), ["portfolio_id", "group_id", "instrument_id"], "left_semi")


def _flows(legs: DataFrame, keys: list[str]) -> DataFrame:
    inexact = F.count_if(F.col("split_adjusted_quantity") != F.col("quantity").cast("decimal(38,12)"))
    sums = legs.groupBy(*keys, F.col("order_date").alias("flow_date"), "instrument_id").agg((-F.sum("split_adjusted_quantity")).alias("amount"), inexact.alias("inexact"))
    return sums.where(~qty_is_zero(F.col("amount"), F.col("inexact"))).drop("inexact")


def user_external_flows(postings: DataFrame, matches: DataFrame, start: str, before: str) -> DataFrame:
    """What crossed each user's boundary, by day and instrument: equity legs and unmatched clearing legs, sign turned."""
    rows = postings.where((F.col("order_date") >= F.lit(start).cast("date")) & (F.col("order_date") < F.lit(before).cast("date")))
    open_clearing = unmatched(rows.where("account_type = 'TRANSFER_CLEARING'"), matches)
    return _flows(rows.where("account_type = 'EQUITY'").unionByName(open_clearing.select(*rows.columns)), ["user_id"])


def portfolio_external_flows(postings: DataFrame, filters: DataFrame, matches: DataFrame, start: str, before: str) -> DataFrame:
    """What crossed each portfolio's boundary: in groups with a member USER leg, equity legs, USER legs of non-members, and clearing legs that aren't in flight inside it."""
    held = portfolio_members(postings, filters).where("account_type in ('USER', 'TRANSFER_CLEARING')")
    members = settled(held.select("portfolio_id", "tx_id", "group_id", "instrument_id", "account_type"))  # asked for four times
    touched = members.where("account_type = 'USER'").select("portfolio_id", "group_id").distinct()
    legs = postings.where((F.col("order_date") >= F.lit(start).cast("date")) & (F.col("order_date") < F.lit(before).cast("date"))).join(touched, "group_id")
    mine = members.where("account_type = 'USER'").select("portfolio_id", "tx_id")
    moving = in_flight(members, matches).select("portfolio_id", "tx_id")
    equity = legs.where("account_type = 'EQUITY'")
    others = legs.where("account_type = 'USER'").join(mine, ["portfolio_id", "tx_id"], "left_anti")
    clearing = legs.where("account_type = 'TRANSFER_CLEARING'").join(moving, ["portfolio_id", "tx_id"], "left_anti")
    return _flows(equity.unionByName(others.select(*equity.columns)).unionByName(clearing.select(*equity.columns)), ["portfolio_id"])


def residual_balances(postings: DataFrame, matches: DataFrame) -> DataFrame:
    """Unmatched balances on residual accounts by user, broker, account, type, instrument and description."""
    rows = unmatched(postings.where(F.col("account_type").isin(*RESIDUAL_TYPES)), matches)
    keys = ["user_id", "broker", "account", "account_type", "instrument_id", "description"]
    inexact = F.count_if(F.col("split_adjusted_quantity") != F.col("quantity").cast("decimal(38,12)"))
    sums = rows.groupBy(*keys).agg(F.sum("split_adjusted_quantity").alias("balance"), F.count("*").alias("n_postings"), F.min("order_date").alias("oldest"), F.max("order_date").alias("newest"), inexact.alias("inexact"))
    return sums.where(~qty_is_zero(F.col("balance"), F.col("inexact"))).drop("inexact")


def residual_counts(balances: DataFrame, stale_before: str) -> DataFrame:
    """How many balances there are, and how many went stale, by user; rounding doesn't count."""
    rows = balances.where("account_type <> 'SOURCE_ROUNDING'")
    return rows.groupBy("user_id").agg(F.count("*").alias("n_balances"), F.count_if(F.col("newest") < F.lit(stale_before).cast("date")).alias("n_stale"), F.count_if(F.col("account_type") == "IMBALANCE").alias("n_imbalance"))


def residual_ages(balances: DataFrame, today: str) -> DataFrame:
    """Balances with age: fresh below 7 days, stale below 30, loud from then on; undated ones are fresh."""
    days = F.datediff(F.lit(today).cast("date"), F.col("oldest"))
    return balances.withColumn("age", F.when(days >= 30, "loud").when(days >= 7, "stale").otherwise("fresh"))


def residual_exposure(balances: DataFrame) -> DataFrame:
    """Totals by broker and instrument, brokers by their largest absolute total: (broker, instrument_id, total, broker_rank, row_rank)."""
    totals = balances.groupBy("broker", "instrument_id").agg(F.sum("balance").alias("total"))
    widest = totals.withColumn("widest", F.max(F.abs("total")).over(Window.partitionBy("broker")))
    brokers = widest.select("broker", "widest").distinct()
    ranked = brokers.withColumn("broker_rank", F.dense_rank().over(Window.orderBy(F.desc("widest"), "broker"))).drop("widest")  # a row for each broker
    row = Window.partitionBy("broker").orderBy(F.desc(F.abs("total")), F.col("instrument_id").asc_nulls_first())
    return totals.withColumn("row_rank", F.row_number().over(row)).join(F.broadcast(ranked), "broker")


def unbalanced_groups(postings: DataFrame) -> DataFrame:
    """Groups whose weights don't sum to zero in some commodity: (group_id, commodity, imbalance)."""
    return postings.groupBy("group_id", "commodity").agg(F.sum("weight").alias("imbalance")).where("imbalance <> 0")


def held_event_instruments(postings: DataFrame, instruments: DataFrame) -> DataFrame:
    """Rows (instrument_id, first_date): stocks and funds held, and the underlyings of held derivatives, with the first posting's day."""
    first = postings.where("account_type = 'USER' and instrument_id is not null").groupBy("instrument_id").agg(F.min("order_date").alias("first_date")).join(instruments, "instrument_id")
    direct = first.where("asset_class in ('STOCK', 'ETF')").select("instrument_id", "first_date")
    below = first.where("asset_class in ('OPTION', 'FUTURE') and underlying_id is not null").select(F.col("underlying_id").alias("instrument_id"), "first_date")
    return direct.unionByName(below).groupBy("instrument_id").agg(F.min("first_date").alias("first_date"))


def group_timestamps(postings: DataFrame) -> DataFrame:
    """Each group's timestamp: the earliest day of its postings."""
    return postings.groupBy("group_id").agg(F.min("order_date").alias("timestamp"))

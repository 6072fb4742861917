"""What an upload's rows need before they are stored: derived legs, vintage, defaults, neutral weights, routed legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.decimals import ADJUSTED
from ledgerlake.operators.ledger import with_weights

#: Money below this is no leg.
LEAST = "0.005"


def upload_vintage(stated: Column, period_before: Column, edited: Column | None = None) -> Column:
    """When an upload was exported: the day picked, else what the file states, else the last day of its window, else null."""
    found = F.coalesce(stated, F.date_sub(period_before, 1).cast("timestamp_ntz"))
    return found if edited is None else F.coalesce(edited.cast("timestamp_ntz"), found)


def derived_legs(postings: DataFrame) -> DataFrame:
    """Rows (tx_id, leg, tx_type, account_type, quantity, currency): the money legs that a source's row implies.

    ``postings``: tx_id, quantity, unit_price, settlement_currency, fee, reinvests. A fee is paid by the user; a
    reinvestment consumed income of quantity times price. Legs below LEAST are left out.
    """
    fee, value = -F.abs(F.col("fee").cast("decimal(18,6)")), -(F.col("quantity").cast("decimal(18,6)") * F.coalesce("unit_price", F.lit(0)).cast("decimal(18,6)"))
    leg = lambda name, kind, account, amount: F.struct(F.lit(name).alias("leg"), F.lit(kind).alias("tx_type"), F.lit(account).alias("account_type"), amount.cast("decimal(28,6)").alias("quantity"))
    both = F.array(leg("fee", "TRANSACTION_COST", "USER", fee), F.when(F.col("reinvests"), leg("reinvested", "DIVIDEND", "INCOME", value)))
    rows = postings.select("tx_id", F.col("settlement_currency").alias("currency"), F.inline(F.filter(both, lambda x: x.isNotNull())))
    return rows.where(F.abs("quantity") >= F.lit(LEAST).cast("decimal(4,3)"))


def with_defaults(postings: DataFrame) -> DataFrame:
    """Postings as they are stored: without a basis theirs is the trade date, and without adjusted figures the stated ones count."""
    return postings.withColumns({
        "share_count_basis": F.coalesce("share_count_basis", "trade_date"),
        "split_adjusted_quantity": F.coalesce("split_adjusted_quantity", F.col("quantity").cast(ADJUSTED)),
        "split_adjusted_unit_price": F.coalesce("split_adjusted_unit_price", F.col("unit_price").cast(ADJUSTED)),
    })


def weight_divergence(postings: DataFrame, instruments: DataFrame) -> DataFrame:
    """Rows (tx_id, first_type, other_type): postings (tx_types: array) whose candidate types weigh differently.

    other_type is the first that differs from the first candidate, in amount or in commodity.
    """
    several = postings.where(F.size("tx_types") > 1).drop("tx_type")
    each = several.select(*several.columns, F.posexplode("tx_types").alias("place", "tx_type"))
    weighed = with_weights(each, instruments).select("tx_id", "place", "tx_type", "weight", "commodity")
    first = weighed.where("place = 0").select("tx_id", F.col("tx_type").alias("first_type"), F.col("weight").alias("w"), F.col("commodity").alias("c"))
    apart = weighed.join(first, "tx_id").where((F.col("weight") != F.col("w")) | (F.col("commodity") != F.col("c")))
    return apart.groupBy("tx_id", "first_type").agg(F.min_by("tx_type", "place").alias("other_type"))


def routed_legs(legs: DataFrame, weighted: DataFrame, instruments: DataFrame) -> DataFrame:
    """``legs`` (group_id, commodity, account_type, amount) as postings, with what a routed posting takes from its group.

    Broker, account, dates and type are those of the group's earliest posting (then smallest tx_id), description
    and instrument those of the earliest of the commodity; money takes the currency's own instrument (the
    smallest CASH one) and its code as description.
    """
    earliest = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("order_date", "tx_id"))
    group = weighted.withColumn("_n", earliest("group_id")).where("_n = 1").select("group_id", "user_id", "broker", "account", "order_date", "trade_date", "tx_type")
    thing = weighted.withColumn("_n", earliest("group_id", "commodity")).where("_n = 1").select("group_id", "commodity", "description", F.col("instrument_id").alias("_own"))
    money = instruments.where("asset_class = 'CASH'").groupBy(F.concat(F.lit("cur:"), F.col("currency")).alias("commodity"), F.col("currency").alias("_code")).agg(F.min("instrument_id").alias("_cash"))
    found = legs.join(group, "group_id").join(thing, ["group_id", "commodity"], "left").join(F.broadcast(money), "commodity", "left")  # one row for each currency
    is_money = F.col("commodity").startswith("cur:")
    return found.select(
        "group_id", "user_id", "broker", "account", "order_date", "trade_date", "tx_type", "account_type",
        F.when(is_money, F.col("_cash")).otherwise(F.col("_own")).alias("instrument_id"),
        F.when(is_money, F.substring("commodity", 5, 8)).otherwise(F.col("description")).alias("description"),
        F.col("amount").alias("quantity"), "commodity",
    )

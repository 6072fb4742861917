"""Double entry: weights, boundary legs, residuals, replacement by period, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.decimals import QUANTITY, half_unit
from ledgerlake.functions.txtypes import PARENTS, is_antichain, may_be, must_be, resolve

MONEY_TOLERANCE, COMMODITY_TOLERANCE = "0.005", "0.000001"
#: Classes that sources confuse, either way round.
ALIKE = (("STOCK", "ETF"), ("MUTUAL_FUND", "ETF"))


def commodity(instrument_id: Column, description: Column, currency: Column | None = None) -> Column:
    """The key of what a posting moves: ``cur:CODE`` for money, else ``inst:ID`` or ``desc:TEXT``."""
    thing = F.when(instrument_id.isNotNull(), F.concat(F.lit("inst:"), instrument_id.cast("string"))).otherwise(F.concat(F.lit("desc:"), description))
    return thing if currency is None else F.when(currency.isNotNull(), F.concat(F.lit("cur:"), F.upper(F.trim(currency)))).otherwise(thing)


def contract_size(asset_class: Column, multiplier: Column | None = None) -> Column:
    """Units of the underlying in one contract: 100 times the multiplier (1 if unset or not positive) for options, else 1."""
    times = F.lit(1).cast("decimal(9,3)") if multiplier is None else F.when(multiplier > 0, multiplier).otherwise(F.lit(1)).cast("decimal(9,3)")
    return F.when(asset_class == "OPTION", F.lit(100) * times).otherwise(F.lit(1)).cast("decimal(9,3)")


def with_weights(postings: DataFrame, instruments: DataFrame) -> DataFrame:
    """Postings with weight and commodity: what each adds to its group's balance, and in which commodity.

    Without a price or a settlement currency, or where the posting moves that currency itself, its own
    quantity counts. A posting that must be a trade of an asset, and money in another currency, count as
    quantity times price times contract size in the settlement currency.
    """
    known = instruments.select("instrument_id", "asset_class", F.when(F.col("asset_class") == "CASH", F.col("currency")).alias("_money"))
    rows = postings.join(known, "instrument_id", "left")
    settle = F.upper(F.trim("settlement_currency"))
    asset = must_be(F.array("tx_type"), "TRADE_ASSET")
    own = F.struct(F.col("quantity").cast("decimal(38,12)").alias("weight"), commodity(F.col("instrument_id"), F.col("description"), F.col("_money")).alias("commodity"))
    sized = (F.col("quantity") * contract_size(F.col("asset_class"))).cast(QUANTITY)
    bought = F.struct((sized * F.col("unit_price").cast(QUANTITY)).cast("decimal(38,12)").alias("weight"), F.concat(F.lit("cur:"), settle).alias("commodity"))
    chosen = F.when(F.col("unit_price").isNull() | settle.isNull() | F.coalesce(F.col("_money") == settle, F.lit(False)), own).when(asset | F.col("_money").isNotNull(), bought).otherwise(own)
    return rows.withColumn("_w", chosen).select(*postings.columns, "asset_class", "_w.weight", "_w.commodity")


def boundary_legs(weighted: DataFrame) -> DataFrame:
    """For each USER posting of income or expense with a weight, the leg that takes it out of the ledger: (group_id, tx_id, account_type, amount, commodity)."""
    kind = F.when(must_be(F.array("tx_type"), "INCOME"), "INCOME").when(must_be(F.array("tx_type"), "EXPENSE"), "EXPENSE")
    rows = weighted.where("account_type = 'USER' and weight <> 0").withColumn("_kind", kind).where("_kind is not null")
    return rows.select("group_id", "tx_id", F.col("_kind").alias("account_type"), (-F.col("weight")).alias("amount"), "commodity")


def group_residuals(weighted: DataFrame, price_scale: int = 2) -> DataFrame:
    """Rows (group_id, commodity, residual, rounding, transfers): what each group leaves over, boundary legs counted.

    rounding is what half a unit in the last place of its converted legs' prices can amount to. A price has as
    many places as its source stated (unit_price_scale, where ``weighted`` has it), and at least ``price_scale``.
    """
    converted = F.col("unit_price").isNotNull() & (F.col("weight") != F.col("quantity")) & (F.col("unit_price") != 0)
    scale = F.col("unit_price_scale") if "unit_price_scale" in weighted.columns else F.lit(price_scale)
    units = (F.abs(F.col("weight").cast("decimal(28,6)")) / F.abs(F.col("unit_price").cast(QUANTITY))).cast("decimal(25,9)")
    shaken = F.when(converted, (units * half_unit(scale, price_scale)).cast("decimal(38,12)"))
    legs = weighted.where("account_type = 'USER'").select("group_id", "commodity", F.col("weight").alias("amount"), shaken.alias("shaken"))
    out = legs.unionByName(boundary_legs(weighted).select("group_id", "commodity", "amount", F.lit(None).cast("decimal(38,12)").alias("shaken")))
    sums = out.groupBy("group_id", "commodity").agg(F.sum("amount").alias("residual")).where("residual <> 0")
    odd = legs.groupBy("group_id").agg(F.coalesce(F.sum("shaken"), F.lit(0)).cast("decimal(38,12)").alias("rounding"))
    moves = weighted.groupBy("group_id").agg(F.max(must_be(F.array("tx_type"), "TRANSFER")).alias("transfers"))
    return sums.join(odd, "group_id").join(moves, "group_id").select("group_id", "commodity", "residual", "rounding", "transfers")


def residual_legs(residuals: DataFrame) -> DataFrame:
    """The leg that closes each residual: (group_id, commodity, account_type, amount).

    Within tolerance it is the source's rounding, unless the group lost legs (lost, where ``residuals`` has it);
    else a transfer's other side if any posting of the group must be a transfer, or an imbalance.
    """
    whole = ~F.col("lost") if "lost" in residuals.columns else F.lit(True)
    tolerance = F.when(F.col("commodity").startswith("cur:"), F.lit(MONEY_TOLERANCE).cast("decimal(38,12)") + F.col("rounding")).otherwise(F.lit(COMMODITY_TOLERANCE).cast("decimal(38,12)"))
    kind = F.when(whole & (F.abs("residual") < tolerance), "SOURCE_ROUNDING").when(F.col("transfers"), "TRANSFER_CLEARING").otherwise("IMBALANCE")
    return residuals.select("group_id", "commodity", kind.alias("account_type"), (-F.col("residual")).alias("amount"))


def settled(weighted: DataFrame) -> DataFrame:
    """All legs of every group after settling: (group_id, commodity, account_type, amount); each group sums to zero by commodity."""
    own = weighted.where("account_type = 'USER'").select("group_id", "commodity", "account_type", F.col("weight").alias("amount"))
    edge = boundary_legs(weighted).select("group_id", "commodity", "account_type", "amount")
    return own.unionByName(edge).unionByName(residual_legs(group_residuals(weighted)).select("group_id", "commodity", "account_type", "amount"))


def replace_by_period(postings: DataFrame, upload: DataFrame, user_id, broker: str, start: str, before: str) -> DataFrame:
    """The ledger after an upload restates a user's postings at a broker in [start, before).

    Stated postings of the period go, and all routed legs of the groups that they touch; other brokers'
    postings, those outside the period and opening balances stay. Replaying an upload changes nothing.
    """
    period = (F.col("order_date") >= F.lit(start).cast("date")) & (F.col("order_date") < F.lit(before).cast("date"))
    mine = (F.col("user_id") == user_id) & (F.col("broker") == broker) & period & (F.col("account_type") == "USER")
    touched = postings.where(mine).select("group_id").distinct().withColumn("_touched", F.lit(True))
    marked = postings.join(touched, "group_id", "left").withColumn("_touched", F.coalesce("_touched", F.lit(False)))
    routed = F.col("account_type").isin("TRANSFER_CLEARING", "IMBALANCE", "SOURCE_ROUNDING", "INCOME", "EXPENSE")
    kept = marked.where(~(mine | (F.col("_touched") & routed))).select(*postings.columns)
    return kept.unionByName(upload.select(*postings.columns))


def latest_by_key(existing: DataFrame, added: DataFrame, keys: list[str], order: str) -> DataFrame:
    """An upsert: of rows with equal keys the added one wins, of several added the last by ``order``."""
    both = existing.withColumn("_added", F.lit(0)).unionByName(added.withColumn("_added", F.lit(1)), allowMissingColumns=True)
    by = Window.partitionBy(*keys).orderBy(F.desc("_added"), F.desc_nulls_last(order))
    return both.withColumn("_row", F.row_number().over(by)).where("_row = 1").drop("_row", "_added")


def earliest_by_key(existing: DataFrame, added: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """An upsert of when each key was first known: the earliest of both."""
    return existing.select(*keys, stamp).unionByName(added.select(*keys, stamp)).groupBy(*keys).agg(F.min(stamp).alias(stamp))


def insert_absent(existing: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` and those rows of ``added`` whose keys it lacks; null keys are equal."""
    on = None
    other = existing.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    for k in keys:
        on = F.col(k).eqNullSafe(F.col(f"_{k}")) if on is None else on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return existing.unionByName(added.join(other, on, "left_anti"))


def classes_compatible(implied: Column, found: Column) -> Column:
    """Whether a source's class may name an instrument's: unset or UNKNOWN instruments take any, UNKNOWN sources any but CASH."""
    alike = F.lit(False)
    for a, b in ALIKE:
        alike = alike | ((implied == a) & (found == b)) | ((implied == b) & (found == a))
    return F.coalesce(F.when(F.coalesce(found, F.lit("")).isin("", "UNKNOWN"), True).when(implied == "UNKNOWN", found != "CASH").otherwise((implied == found) | alike), F.lit(False))


def posting_errors(postings: DataFrame) -> DataFrame:
    """Rows (tx_id, error) for every rule that a posting breaks.

    Needs tx_id, order_date, description, tx_types (array), quantity and settlement_amount.
    """
    t = F.col("tx_types")
    known = F.forall(t, lambda x: x.isin([k for k in PARENTS if k != "AMBIGUOUS"]))
    rules = F.array(
        F.when(F.col("order_date").isNull(), "order_date is missing"),
        F.when(F.coalesce(F.length(F.trim("description")), F.lit(0)) == 0, "description is missing"),
        F.when(F.coalesce(F.size(t), F.lit(0)) <= 0, "no transaction type"),
        F.when((F.size(t) > 0) & ~F.coalesce(known, F.lit(False)), "unknown transaction type"),
        F.when((F.size(t) > 0) & known & ~is_antichain(t), "transaction types overlap"),
        F.when(F.col("quantity").isNull(), "quantity is missing"),
        F.when(F.col("settlement_amount").isNotNull() & ~may_be(t, "TRADE_ASSET"), "settlement_amount without a trade"),
        F.when(F.col("settlement_amount") < 0, "settlement_amount is negative"),
    )
    return postings.select("tx_id", F.explode(F.array_compact(rules)).alias("error"))


def type_predicates(sets: DataFrame) -> DataFrame:
    """``sets`` (tx_types: array) with resolved, must_be_trade, may_be_trade_asset and antichain."""
    t = F.col("tx_types")
    return sets.withColumns({"resolved": resolve(t), "must_be_trade": must_be(t, "TRADE"), "may_be_trade_asset": may_be(t, "TRADE_ASSET"), "antichain": is_antichain(t)})

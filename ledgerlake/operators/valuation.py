"""Daily valuation in a display currency, with prices carried forward inside coverage only.

Positions are spans between a holding's days of change, and an instrument's prices in the window are one array
by day. A span meets its instrument once, by a join on the instrument, and takes its slice of the array. Spans,
not days, are then dealt out by scope: days are spelt out where they are summed. Decimals stay exact up to the value
of one holding on one day, which is the one place where a figure becomes a double.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.decimals import qty_is_zero
from ledgerlake.operators.holdings import in_flight, matched_sides, portfolio_members
from ledgerlake.operators.intervals import merged_coverage
from ledgerlake.operators.rounds import settled


def user_source(postings: DataFrame, matches: DataFrame) -> DataFrame:
    """What a user owns: USER postings, and clearing legs of matched transfers; scope is the user."""
    matched = matched_sides(matches).select("group_id", "instrument_id").distinct()
    legs = postings.where("account_type = 'TRANSFER_CLEARING'").join(matched, ["group_id", "instrument_id"], "left_semi")
    return postings.where("account_type = 'USER'").unionByName(legs.select(*postings.columns)).withColumn("scope_id", F.col("user_id"))


def portfolio_source(postings: DataFrame, filters: DataFrame, matches: DataFrame) -> DataFrame:
    """What a portfolio owns: its members' USER postings, and transfers under way inside it; scope is the portfolio."""
    members = portfolio_members(postings, filters).where("account_type in ('USER', 'TRANSFER_CLEARING')")
    members = settled(members.select("portfolio_id", "tx_id", "group_id", "instrument_id", "account_type", "order_date", "description", "quantity", "split_adjusted_quantity"))  # asked for four times
    both = members.where("account_type = 'USER'").unionByName(in_flight(members, matches).select(*members.columns))
    return both.withColumn("scope_id", F.col("portfolio_id"))


def position_spans(source: DataFrame, start: str, before: str) -> DataFrame:
    """Rows (scope_id, instrument_id, description, quantity, inexact, from_date, before_date): an open position's spans in [start, before).

    Postings without an instrument are kept apart by description.
    """
    first, last = F.lit(start).cast("date"), F.lit(before).cast("date")
    unknown = F.when(F.col("instrument_id").isNull(), F.col("description"))
    inexact = F.count_if(F.col("split_adjusted_quantity") != F.col("quantity").cast("decimal(38,12)"))
    daily = source.where(F.col("order_date") < last).groupBy("scope_id", "instrument_id", unknown.alias("description"), F.greatest("order_date", first).alias("day")).agg(F.sum("split_adjusted_quantity").alias("net"), inexact.alias("n"))
    by = Window.partitionBy("scope_id", "instrument_id", "description").orderBy("day")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    spans = daily.select("scope_id", "instrument_id", "description", F.sum("net").over(so_far).alias("quantity"), F.sum("n").over(so_far).alias("inexact"), F.col("day").alias("from_date"), F.coalesce(F.lead("day").over(by), last).alias("before_date"))
    return spans.where((F.col("from_date") < F.col("before_date")) & ~qty_is_zero(F.col("quantity"), F.col("inexact")))


def daily_positions(source: DataFrame, start: str, before: str) -> DataFrame:
    """Rows (scope_id, instrument_id, description, day, quantity, inexact) for every day in [start, before) a position is open."""
    still = position_spans(source, start, before)
    return still.withColumn("day", F.explode(F.sequence("from_date", F.date_sub("before_date", 1)))).drop("from_date", "before_date")


def price_runs(bars: DataFrame, coverage: DataFrame, wanted: DataFrame, start: str, before: str, adjust: Callable[[DataFrame], DataFrame] = lambda bars: bars) -> DataFrame:
    """Rows (instrument_id, from_day, to_day, close, split_adjusted_close): the runs of days in [start, before) on which one bar is the last so far of its merged span of coverage.

    A bar counts from its own day to the next bar's, or to the end of its span; nothing crosses the edge of a
    span. ``wanted`` (instrument_id) says for which instruments. ``adjust`` adds split_adjusted_close to bars; it
    sees only those that are shown: one before ``start`` for each span at most.
    """
    first, last = F.lit(start).cast("date"), F.lit(before).cast("date")
    spans = merged_coverage(coverage.join(wanted, "instrument_id", "left_semi")).select("instrument_id", F.col("from_date").alias("span_from"), F.col("before_date").alias("span_before"))
    spans = spans.where((F.col("span_from") < last) & (F.col("span_before") > first))
    inside = bars.where(F.col("price_date") < last).join(spans, "instrument_id").where("price_date >= span_from and price_date < span_before")
    by = Window.partitionBy("instrument_id", "span_from").orderBy("price_date")
    until = F.least(F.coalesce(F.lead("price_date").over(by), "span_before"), last)
    shown = inside.withColumns({"from_day": F.greatest("price_date", first), "to_day": until}).where("from_day < to_day").drop("span_from", "span_before")
    return adjust(shown).select("instrument_id", "from_day", "to_day", "close", "split_adjusted_close")


def filled_prices(bars: DataFrame, coverage: DataFrame, wanted: DataFrame, start: str, before: str, adjust: Callable[[DataFrame], DataFrame] = lambda bars: bars) -> DataFrame:
    """Rows (instrument_id, day, close, split_adjusted_close) for covered days in [start, before): the days of ``price_runs``."""
    runs = price_runs(bars, coverage, wanted, start, before, adjust)
    return runs.select("instrument_id", F.explode(F.sequence("from_day", F.date_sub("to_day", 1))).alias("day"), "close", "split_adjusted_close")


def currency_pairs(identifiers: DataFrame) -> DataFrame:
    """Rows (instrument_id, currency): the pairs against USD in force."""
    rows = identifiers.where("identifier_type = 'FX_PAIR' and valid_before is null and value like '%USD' and length(value) = 6")
    return rows.select("instrument_id", F.substring("value", 1, 3).alias("currency"))


def price_arrays(runs: DataFrame, start: str, before: str) -> DataFrame:
    """Rows (instrument_id, prices, rates): adjusted and plain closes of each day in [start, before) as doubles, null where there are none; an array is as long as the window.

    Runs are laid side by side with nulls between them, so days are never spelt out as rows.
    """
    first, last = F.lit(start).cast("date"), F.lit(before).cast("date")
    run = F.struct(F.datediff("from_day", first).alias("at"), F.datediff("to_day", first).alias("to"), F.col("split_adjusted_close").cast("double").alias("price"), F.col("close").cast("double").alias("rate"))
    held = runs.groupBy("instrument_id").agg(F.array_sort(F.collect_list(run)).alias("r"))  # one for each day at most
    blank = F.lit(None).cast("double")

    def laid(value: str) -> Column:
        one = lambda x, i: F.concat(F.array_repeat(blank, x["at"] - F.coalesce(F.get("r", i - 1)["to"], F.lit(0))), F.array_repeat(x[value], x["to"] - x["at"]))
        return F.concat(F.flatten(F.transform("r", one)), F.array_repeat(blank, F.datediff(last, first) - F.element_at("r", -1)["to"]))

    return held.select("instrument_id", laid("price").alias("prices"), laid("rate").alias("rates"))


def valued_positions(source: DataFrame, instruments: DataFrame, pairs: DataFrame, bars: DataFrame, coverage: DataFrame, start: str, before: str, display: str, adjust: Callable[[DataFrame], DataFrame] = lambda bars: bars, wanted: DataFrame | None = None) -> DataFrame:
    """Rows (scope_id, day, label, value, unpriced): each open position's value on each day.

    value is null where a price or a needed rate is missing; unpriced then says so. Prices and rates are filled
    once, for ``wanted`` (instrument_id; those of ``source`` if it isn't given) and the pairs, and written.
    """
    first = F.lit(start).cast("date")
    ids = (source if wanted is None else wanted).where("instrument_id is not null").select("instrument_id")
    ids = ids.unionByName(pairs.select("instrument_id")).distinct()
    arrays = settled(price_arrays(price_runs(bars, coverage, ids, start, before, adjust), start, before))
    rates = settled(arrays.join(pairs, "instrument_id").select("currency", "rates"))
    shown = rates.where(F.col("currency") == display).agg(F.max("rates").alias("shown_rates"))
    known = instruments.select("instrument_id", "name", "asset_class", "currency").join(arrays.select("instrument_id", "prices"), "instrument_id", "left")
    held = position_spans(source, start, before).join(known, "instrument_id", "left")
    at, n = F.datediff("from_date", first), F.datediff("before_date", "from_date")
    cut = lambda c: F.slice(F.col(c), at + 1, n)
    sent = held.select("scope_id", "instrument_id", F.coalesce("name", "description").alias("label"), "asset_class", "currency", F.col("quantity").cast("double").alias("quantity"), "from_date", "before_date", cut("prices").alias("prices")).repartition("scope_id")
    named = sent.join(F.broadcast(rates), "currency", "left").crossJoin(F.broadcast(shown))  # one row for each currency; one row
    whole = lambda c: F.coalesce(c, F.array_repeat(F.lit(None).cast("double"), n))
    days = named.select("scope_id", "instrument_id", "label", "asset_class", "currency", "quantity", "from_date", F.posexplode(F.arrays_zip(whole(F.col("prices")).alias("price"), whole(cut("rates")).alias("rate"), whole(cut("shown_rates")).alias("shown_rate"))).alias("pos", "p"))
    found = days.select("scope_id", "instrument_id", "label", "asset_class", "currency", "quantity", F.date_add("from_date", F.col("pos")).alias("day"), "p.price", "p.rate", "p.shown_rate")
    cash = F.coalesce(F.col("asset_class") == "CASH", F.lit(False))
    priced = cash | F.col("price").isNotNull()
    own = F.coalesce("currency", F.lit(display)) == display
    in_own = F.col("quantity") * F.when(cash, F.lit(1.0)).otherwise(F.col("price"))
    base = F.coalesce("currency", F.lit("USD")) == "USD"
    if display == "USD":
        convertible = F.col("rate").isNotNull()
        converted = in_own * F.col("rate")
    else:
        convertible = F.col("shown_rate").isNotNull() & (base | F.col("rate").isNotNull())
        converted = in_own * F.coalesce("rate", F.lit(1.0)) / F.col("shown_rate")
    value = F.when(F.col("instrument_id").isNotNull() & priced, F.when(own, in_own).when(convertible, converted))
    lost = F.col("instrument_id").isNull() | ~priced | (~own & ~convertible)
    return found.select("scope_id", "day", "label", value.alias("value"), lost.alias("unpriced"))


def valuation(source: DataFrame, instruments: DataFrame, pairs: DataFrame, bars: DataFrame, coverage: DataFrame, start: str, before: str, display: str, adjust: Callable[[DataFrame], DataFrame] = lambda bars: bars, wanted: DataFrame | None = None) -> DataFrame:
    """Rows (scope_id, val_date, total_value, unpriced): each scope's total on each day it holds anything.

    unpriced lists, sorted, the names whose price or rate is missing; empty names are left out. Values are
    summed as decimals of four places, so the total doesn't depend on the order of rows.
    """
    rows = valued_positions(source, instruments, pairs, bars, coverage, start, before, display, adjust, wanted)
    total = F.coalesce(F.sum(F.col("value").cast("decimal(38,4)")), F.lit(0).cast("decimal(38,4)")).cast("double")
    names = F.array_sort(F.collect_set(F.when(F.col("unpriced") & (F.col("label") != ""), F.col("label"))))
    return rows.groupBy("scope_id", F.col("day").alias("val_date")).agg(total.alias("total_value"), names.alias("unpriced"))


def percent_change(series: DataFrame) -> DataFrame:
    """Rows (scope_id, percent_change): from the first day's total to the last's; null with fewer than two days or a first total of zero."""
    ends = series.groupBy("scope_id").agg(F.min_by("total_value", "val_date").alias("first"), F.max_by("total_value", "val_date").alias("last"), F.count("*").alias("n"))
    change = F.when((F.col("n") >= 2) & (F.col("first") != 0), (F.col("last") - F.col("first")) / F.col("first") * 100)
    return ends.select("scope_id", change.alias("percent_change"))


def derived_pair(bars: DataFrame, instrument_id: int, from_instrument: int, exponent: int) -> DataFrame:
    """Bars of a pair in minor units from those of the major one: prices times ten to ``exponent``, exactly."""
    rows = bars.where(F.col("instrument_id") == from_instrument)
    factor = F.lit(f"{10.0**exponent:.6f}").cast("decimal(18,6)")
    moved = {c: (F.col(c).cast("decimal(18,6)") * factor).cast("decimal(38,12)") for c in ("open", "high", "low", "close") if c in bars.columns}
    return rows.withColumn("instrument_id", F.lit(instrument_id).cast("long")).withColumns(moved)

"""Splits as exact rationals, applied once, and what follows for options."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.decimals import FACTOR, exact_product, scaled, whole_ratio
from ledgerlake.functions.symbols import occ_build, parse_option
from ledgerlake.operators.intervals import join_spans


def effective_splits(splits: DataFrame, instruments: DataFrame, today: str) -> DataFrame:
    """Splits up to ``today`` by the instrument they change, its own and its underlying's, in whole numbers."""
    down, up = whole_ratio(F.col("split_from"), F.col("split_to"))
    done = splits.where(F.col("ex_date") <= F.lit(today).cast("date")).select("instrument_id", "ex_date", down.alias("split_from"), up.alias("split_to"))
    derived = instruments.where("underlying_id is not null").select(F.col("instrument_id").alias("derived_id"), F.col("underlying_id").alias("instrument_id"))
    return done.unionByName(done.join(derived, "instrument_id").select(F.col("derived_id").alias("instrument_id"), "ex_date", "split_from", "split_to"))


def split_spans(splits: DataFrame, instruments: DataFrame, today: str) -> DataFrame:
    """Rows (instrument_id, basis_from, basis_before, num, den): the factor of every basis date that a later split changes.

    A basis in [basis_from, basis_before) takes all splits from basis_before on; bases after the last split
    need no row, as their factor is one.
    """
    own = effective_splits(splits, instruments, today).groupBy("instrument_id", "ex_date").agg(exact_product(F.collect_list("split_to")).alias("up"), exact_product(F.collect_list("split_from")).alias("down"))
    by = Window.partitionBy("instrument_id").orderBy("ex_date")
    later = by.rowsBetween(0, Window.unboundedFollowing)
    return own.select(
        "instrument_id",
        F.coalesce(F.lag("ex_date").over(by), F.lit("0001-01-01").cast("date")).alias("basis_from"),
        F.col("ex_date").alias("basis_before"),
        exact_product(F.collect_list("up").over(later)).alias("num"),
        exact_product(F.collect_list("down").over(later)).alias("den"),
    )


def with_factor(rows: DataFrame, spans: DataFrame, basis_col: str) -> DataFrame:
    """``rows`` with num and den for their basis date; 1 and 1 where nothing changes it."""
    one = F.lit(1).cast(FACTOR)
    joined = join_spans(rows, spans, "instrument_id", basis_col, "basis_from", "basis_before", ["num", "den"])
    return joined.withColumns({c: F.coalesce(c, one) for c in ("num", "den")})


def adjust_postings(postings: DataFrame, splits: DataFrame, instruments: DataFrame, today: str) -> DataFrame:
    """Postings with split_adjusted_quantity and split_adjusted_unit_price as of ``today``."""
    found = with_factor(postings, split_spans(splits, instruments, today), "share_count_basis")
    return found.withColumn("split_adjusted_quantity", scaled(F.col("quantity"), F.col("num"), F.col("den"))).withColumn("split_adjusted_unit_price", scaled(F.col("unit_price"), F.col("den"), F.col("num"))).drop("num", "den")


def adjust_bars(bars: DataFrame, splits: DataFrame, instruments: DataFrame, today: str) -> DataFrame:
    """Bars with split_adjusted_close (and open, high, low and a rounded volume where they are given)."""
    found = with_factor(bars, split_spans(splits, instruments, today), "share_count_basis")
    for price in [c for c in ("open", "high", "low", "close") if c in bars.columns]:
        found = found.withColumn(f"split_adjusted_{price}", scaled(F.col(price), F.col("den"), F.col("num")))
    if "volume" in bars.columns:
        found = found.withColumn("split_adjusted_volume", F.round(F.col("volume").cast("decimal(18,0)") * F.col("num") / F.col("den"), 0).cast("long"))
    return found.drop("num", "den")


def instruments_with_splits(splits: DataFrame, instruments: DataFrame, today: str) -> DataFrame:
    """Instruments that a split changes, directly or through their underlying."""
    return effective_splits(splits, instruments, today).select("instrument_id").distinct()


def pending_option_splits(instruments: DataFrame, splits: DataFrame, identifiers: DataFrame, first_traded: DataFrame, today: str) -> DataFrame:
    """Rows (instrument_id, ex_date, split_from, split_to) of splits that change an option's terms.

    The split is its underlying's, up to ``today`` and the option's expiry, and after the option's name: the
    day from which its OCC name in force is valid, or else its first trade date (``first_traded``:
    instrument_id, first_date), or no day at all. So a restated option isn't restated again, while a split
    learnt of late still is due.
    """
    options = instruments.where("asset_class = 'OPTION'").select("instrument_id", "underlying_id", "expiry")
    due = splits.where(F.col("ex_date") <= F.lit(today).cast("date")).select(F.col("instrument_id").alias("underlying_id"), "ex_date", "split_from", "split_to")
    names = identifiers.where("identifier_type = 'OCC' and valid_before is null").groupBy("instrument_id").agg(F.max("valid_from").alias("named"))
    met = options.join(due, "underlying_id").join(names, "instrument_id", "left").join(first_traded, "instrument_id", "left")
    since = F.coalesce("named", "first_date")
    return met.where((F.col("ex_date") <= F.col("expiry")) & (since.isNull() | (F.col("ex_date") > since))).select("instrument_id", "ex_date", "split_from", "split_to")


def is_whole_forward(split_from, split_to):
    """Whether a split multiplies shares by a whole number above one."""
    return F.when((split_from > 0) & (split_to > split_from), F.pmod(split_to, split_from) == 0).otherwise(False)


def _restated(pending: DataFrame, instruments: DataFrame, identifiers: DataFrame) -> DataFrame:
    """``pending`` in whole numbers with each option's terms after the split, and what stands against restating the option (fault).

    Terms build on the OCC name in force: its root, expiry and side; strikes move from the stored one by the
    factor of all splits up to this one, rounded once to three places. Options without such a name, or without
    a stored strike, expiry or side, have nothing to restate and are left out.
    """
    down, up = whole_ratio(F.col("split_from"), F.col("split_to"))
    whole = pending.select("instrument_id", "ex_date", down.alias("split_from"), up.alias("split_to"))
    names = identifiers.where("identifier_type = 'OCC' and valid_before is null and value <> ''").groupBy("instrument_id").agg(F.max_by("value", F.struct("valid_from", "value")).alias("name"))
    terms = instruments.where("strike is not null and expiry is not null and put_call is not null").select("instrument_id", "underlying_id", F.col("strike").alias("old"))
    named = whole.join(terms, "instrument_id").join(names, "instrument_id").withColumn("p", parse_option(F.col("name")))
    every = Window.partitionBy("instrument_id")
    by = every.orderBy("ex_date")
    run = by.rowsBetween(Window.unboundedPreceding, 0)
    moved = named.withColumns({"num": exact_product(F.collect_list("split_to").over(run)), "den": exact_product(F.collect_list("split_from").over(run)), "valid_before": F.lead("ex_date").over(by)})
    moved = moved.withColumn("strike", F.round(scaled(F.col("old"), F.col("den"), F.col("num")), 3).cast("decimal(18,3)"))
    moved = moved.withColumn("symbol", occ_build(F.col("p.symbol"), F.col("p.expiry"), F.col("p.put_call"), F.col("strike")))
    odd = ~is_whole_forward(F.col("split_from"), F.col("split_to"))
    blocked = F.max(odd).over(every)
    # splits that follow no rule are told of first, then a name that can't be read, then the first symbol that can't be built
    fault = F.when(blocked, F.when(odd, F.when(F.col("split_to") < F.col("split_from"), "REVERSE_SPLIT").otherwise("NON_WHOLE_SPLIT")))
    fault = fault.when(F.col("p").isNull(), F.when(F.lead("ex_date").over(by).isNull(), "UNREADABLE_NAME")).when(F.col("symbol").isNull(), "NO_SUCH_SYMBOL")
    return moved.withColumn("fault", fault).withColumn("ok", ~blocked & F.min(F.col("symbol").isNotNull()).over(every))


def restate_options(pending: DataFrame, instruments: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Rows (instrument_id, valid_from, valid_before, strike, symbol): an option's terms after each pending split.

    An option is restated wholly or not at all: one with any split that isn't whole and forward is left out, as
    its terms follow no rule, and so is one whose OCC name in force is missing or can't be read, or any of whose
    new symbols can't be built.
    """
    rows = _restated(pending, instruments, identifiers).where("ok")
    return rows.select("instrument_id", F.col("ex_date").alias("valid_from"), "valid_before", "strike", "symbol")


def option_faults(pending: DataFrame, instruments: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Rows (instrument_id, ex_date, event_type, options) of what needs a person before options can be restated.

    A split without a rule is its underlying's, once with all options that wait for it; a name that can't be read
    (told of at the last split) and a symbol that can't be built (at the first such split) are the option's own.
    """
    rows = _restated(pending, instruments, identifiers).where("fault is not null")
    shared = F.col("fault").isin("REVERSE_SPLIT", "NON_WHOLE_SPLIT")
    own = Window.partitionBy("instrument_id", "fault").orderBy("ex_date")
    rows = rows.withColumn("nth", F.row_number().over(own)).where(shared | (F.col("nth") == 1))
    rows = rows.select(F.when(shared, F.col("underlying_id")).otherwise(F.col("instrument_id")).alias("instrument_id"), "ex_date", F.col("fault").alias("event_type"), F.col("instrument_id").alias("option_id"))
    return rows.groupBy("instrument_id", "ex_date", "event_type").agg(F.array_sort(F.collect_set("option_id")).alias("options"))


def unhandled_splits(splits: DataFrame) -> DataFrame:
    """Splits that need a person: reverse ones, and forward ones whose ratio isn't whole."""
    kind = F.when(F.col("split_to") < F.col("split_from"), "REVERSE_SPLIT").when(~is_whole_forward(F.col("split_from"), F.col("split_to")), "NON_WHOLE_SPLIT")
    return splits.withColumn("event_type", kind).where("event_type is not null")


def special_dividends(dividends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dividends to store, events that need a person) of ``dividends`` (instrument_id, ex_date, pay_date, amount, currency, dividend_type, provider).

    A special dividend (SC) moves option terms and prices in ways that no rule covers, so it isn't stored but told
    of: (instrument_id, ex_date, event_type, detail, data), data being JSON of what is known.
    """
    special = F.coalesce(F.col("dividend_type") == "SC", F.lit(False))
    amount = F.col("amount").cast("string")
    known = F.to_json(F.struct(amount.alias("amount"), "currency", F.col("pay_date").cast("string").alias("pay_date"), "dividend_type", F.col("provider").alias("data_provider")))
    detail = F.concat(F.lit("special dividend of "), amount, F.lit(" "), "currency", F.lit(", told by "), "provider")
    told = dividends.where(special).select("instrument_id", "ex_date", F.lit("SPECIAL_CASH_DIVIDEND").alias("event_type"), detail.alias("detail"), known.alias("data"))
    return dividends.where(~special), told


def apply_restatement(restated: DataFrame, instruments: DataFrame, identifiers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(instruments, identifiers, mapping of merged instruments) after ``restated`` (instrument_id, valid_from, valid_before, strike, symbol) is written.

    Another instrument that already holds a new name at that time is a duplicate of the option and merges into
    it: mapping (instrument_id, survivor_id). OCC names from the first restatement on are replaced, the one in
    force until then is closed, not deleted, and the last strike becomes the option's.
    """
    first = restated.groupBy("instrument_id").agg(F.min("valid_from").alias("_first"), F.max_by("strike", "valid_from").alias("_strike"))
    names = identifiers.where("identifier_type = 'OCC'").select(F.col("instrument_id").alias("holder"), F.col("value").alias("symbol"), F.col("valid_from").alias("_from"), F.col("valid_before").alias("_before"))
    met = restated.join(names, "symbol").where((F.col("holder") != F.col("instrument_id")) & (F.col("_from").isNull() | F.col("valid_before").isNull() | (F.col("_from") < F.col("valid_before"))) & (F.col("_before").isNull() | (F.col("_before") > F.col("valid_from"))))
    mapping = met.groupBy(F.col("holder").alias("instrument_id")).agg(F.min(F.col("instrument_id")).alias("survivor_id"))
    moved = identifiers.join(mapping, "instrument_id", "left").withColumn("instrument_id", F.coalesce("survivor_id", "instrument_id")).drop("survivor_id")
    occ = F.col("identifier_type") == "OCC"
    held = moved.join(first.select("instrument_id", "_first"), "instrument_id", "left")
    kept = held.where(~(occ & F.col("_first").isNotNull() & F.coalesce(F.col("valid_from") >= F.col("_first"), F.lit(False))))
    closed = kept.withColumn("valid_before", F.when(occ & F.col("valid_before").isNull(), F.col("_first")).otherwise(F.col("valid_before")))
    minted = restated.select("instrument_id", F.lit("OCC").alias("identifier_type"), F.lit(None).cast("string").alias("domain"), F.col("symbol").alias("value"), F.lit(True).alias("canonical"), "valid_from", "valid_before")
    names = closed.select(*minted.columns).unionByName(minted).distinct()
    left = instruments.join(mapping.select("instrument_id"), "instrument_id", "left_anti").join(first.select("instrument_id", "_strike"), "instrument_id", "left")
    return left.withColumn("strike", F.coalesce("_strike", "strike")).select(*instruments.columns), names, mapping

"""Declared holdings: pads and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.decimals import ADJUSTED, FACTOR, qty_is_zero, scaled
from ledgerlake.operators.splits import split_spans, with_factor

KEY = ["user_id", "broker", "account", "instrument_id"]


def declaration_kinds(declarations: DataFrame) -> DataFrame:
    """Declarations with kind: a holding's earliest is its PAD, any later one an ASSERT."""
    first = F.min("as_of_date").over(Window.partitionBy(*KEY))
    return declarations.withColumn("kind", F.when(F.col("as_of_date") == first, "PAD").otherwise("ASSERT"))


def quantities_in_basis(declarations: DataFrame, postings: DataFrame, splits: DataFrame, instruments: DataFrame, today: str) -> DataFrame:
    """Each declaration with computed (its holding in the declaration's share count at the end of as_of_date), n_postings and inexact_bases.

    Postings are summed by their own basis first; each sum is converted once by the ratio of the two
    factors, and counted as inexact where that isn't one.
    """
    spans = split_spans(splits, instruments, today)
    asked = with_factor(declarations, spans, "share_count_basis").withColumnsRenamed({"num": "num_d", "den": "den_d", "share_count_basis": "basis_d"})
    own = postings.where("account_type = 'USER' and instrument_id is not null").select(*KEY, "order_date", "share_count_basis", "quantity")
    met = asked.join(own, KEY, "left").where("order_date is null or order_date <= as_of_date or quantity is null")
    met = with_factor(met, spans, "share_count_basis")
    by_basis = met.groupBy(*declarations_key(declarations), "num_d", "den_d", "num", "den").agg(F.sum("quantity").alias("raw"), F.count("quantity").alias("n"))
    up, down = (F.col("num") * F.col("den_d")).cast(FACTOR), (F.col("den") * F.col("num_d")).cast(FACTOR)
    moved = scaled(F.col("raw"), up, down)
    sums = by_basis.groupBy(*declarations_key(declarations)).agg(F.coalesce(F.sum(moved), F.lit(0).cast(ADJUSTED)).alias("computed"), F.sum("n").alias("n_postings"), F.count_if((up != down) & (F.col("n") > 0)).alias("inexact_bases"))
    lost = declarations.select(*declarations_key(declarations)).join(sums, declarations_key(declarations), "left_anti")
    empty = lost.select(*declarations_key(declarations), F.lit(0).cast(sums.schema["computed"].dataType).alias("computed"), F.lit(0).cast("long").alias("n_postings"), F.lit(0).cast("long").alias("inexact_bases"))
    return sums.unionByName(empty)


def declarations_key(declarations: DataFrame) -> list[str]:
    return [*KEY, "as_of_date", "declared_qty"]


def declaration_checks(declarations: DataFrame, postings: DataFrame, splits: DataFrame, instruments: DataFrame, today: str) -> DataFrame:
    """Each declaration with kind, computed, delta (computed less declared) and matched: a PAD always, an ASSERT if delta counts as zero."""
    found = quantities_in_basis(declarations, postings, splits, instruments, today)
    kinds = declaration_kinds(declarations).select(*declarations_key(declarations), "kind")
    delta = (F.col("computed") - F.col("declared_qty")).cast(ADJUSTED)
    checked = found.join(kinds, declarations_key(declarations)).withColumn("delta", delta)
    return checked.withColumn("matched", (F.col("kind") == "PAD") | qty_is_zero(F.col("delta"), F.col("inexact_bases")))


def opening_pads(declarations: DataFrame, postings: DataFrame, splits: DataFrame, instruments: DataFrame, today: str, start: str) -> DataFrame:
    """The pair of legs that makes each holding agree with its PAD, dated ``start``: (key, order_date, account_type, quantity).

    Declarations before ``start`` don't count. A pad of zero is kept.
    """
    live = declarations.where(F.col("as_of_date") >= F.lit(start).cast("date"))
    pads = declaration_checks(live, postings, splits, instruments, today).where("kind = 'PAD'")
    legs = F.array(F.struct(F.lit("USER").alias("t"), (-F.col("delta")).alias("q")), F.struct(F.lit("EQUITY").alias("t"), F.col("delta").alias("q")))
    return pads.withColumn("_leg", F.explode(legs)).select(*KEY, F.lit(start).cast("date").alias("order_date"), F.col("_leg.t").alias("account_type"), F.col("_leg.q").alias("quantity"))


def recalculated_pads(declarations: DataFrame, postings: DataFrame, splits: DataFrame, instruments: DataFrame, today: str) -> DataFrame:
    """The pads of every user after their history changed: (key, order_date, account_type, quantity, share_count_basis).

    A user's start is the first day of a stated posting. Declarations before it are gone, a holding without any
    left has no pad, and a user without postings has none at all. The earliest declaration left pads its holding
    on the start day, in its own share count; a pad of zero is kept.
    """
    start = postings.where("account_type = 'USER'").groupBy("user_id").agg(F.min("order_date").alias("_start"))
    live = declarations.join(start, "user_id").where("as_of_date >= _start")
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy("as_of_date", "declared_qty"))
    pads = live.withColumn("_n", first).where("_n = 1").select(*declarations.columns)
    found = quantities_in_basis(pads, postings, splits, instruments, today)
    found = found.join(pads.select(*declarations_key(pads), "share_count_basis"), declarations_key(pads)).join(start, "user_id")
    short = (F.col("declared_qty") - F.col("computed")).cast(ADJUSTED)
    legs = F.array(F.struct(F.lit("USER").alias("t"), short.alias("q")), F.struct(F.lit("EQUITY").alias("t"), (-short).alias("q")))
    return found.withColumn("_leg", F.explode(legs)).select(*KEY, F.col("_start").alias("order_date"), F.col("_leg.t").alias("account_type"), F.col("_leg.q").alias("quantity"), "share_count_basis")

"""Half-open date intervals: union, difference, coverage and gaps, by windows over sorted intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOREVER = "9999-12-31"


def merge_ranges(ranges: DataFrame, keys: list[str], start: str = "from_date", end: str = "before_date", *extra: Column) -> DataFrame:
    """The union of each key's ranges: overlapping or abutting ones become one. Empty and inverted ranges are dropped.

    ``extra`` are aggregates over the ranges that one result row unites.
    """
    by = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    opened = ranges.where(F.col(start) < F.col(end)).withColumn("_new", F.when(reach >= F.col(start), 0).otherwise(1))
    island = opened.withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = island.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), *extra)
    return merged.drop("_island")


def subtract_ranges(needed: DataFrame, covered: DataFrame, keys: list[str], start: str = "from_date", end: str = "before_date") -> DataFrame:
    """What of ``needed`` isn't in ``covered``, by key; touching bounds leave no empty piece.

    Both are merged first. Then all bounds of a key go by in order of days, and what lies between two of them is
    left where something is needed and nothing covers: rows in proportion to the ranges, without a join.
    """
    merged = [merge_ranges(rows.select(*keys, start, end), keys, start, end) for rows in (needed, covered)]
    bound = lambda day, need, cover: F.struct(F.col(day).alias("_day"), F.lit(need).alias("_need"), F.lit(cover).alias("_cover"))
    both = [rows.select(*keys, F.inline(F.array(bound(start, *up), bound(end, *(-x for x in up))))) for rows, up in zip(merged, ((1, 0), (0, 1)))]
    by = Window.partitionBy(*keys).orderBy("_day")
    so_far = by.rangeBetween(Window.unboundedPreceding, Window.currentRow)  # with all bounds of the day
    swept = both[0].unionByName(both[1]).select(*keys, F.col("_day").alias(start), F.lead("_day").over(by).alias(end), F.sum("_need").over(so_far).alias("_need"), F.sum("_cover").over(so_far).alias("_cover"))
    return swept.where((F.col("_need") > 0) & (F.col("_cover") == 0) & (F.col(start) < F.col(end))).select(*keys, start, end)


#: Spans of more months are few for each key, as its spans don't overlap, and meet rows by the key alone.
LONG_MONTHS = 24


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def join_spans(rows: DataFrame, spans: DataFrame, key: str, day: str, start: str, end: str, values: list[str]) -> DataFrame:
    """``rows`` with ``values`` of the span of ``spans`` (key, start, end, values) that holds their day; null in none.

    Spans of a key don't overlap. They are indexed by key and month, so a row meets those of its month only
    however many its key has; LONG_MONTHS or more would repeat in too many months and are met apart.
    """
    known = spans.select(F.col(key).alias("_key"), F.col(start).alias("_start"), F.col(end).alias("_end"), *(F.col(v).alias(f"_{v}") for v in values))
    months = _month(F.date_sub("_end", 1)) - _month(F.col("_start"))
    short = known.where((F.col("_start") < F.col("_end")) & (months < LONG_MONTHS)).withColumn("_in", F.explode(F.sequence(_month(F.col("_start")), _month(F.date_sub("_end", 1)))))
    long = known.where(months >= LONG_MONTHS).select(*(F.col(c).alias(f"_long{c}") for c in known.columns))
    holds = lambda p: (F.col(key) == F.col(f"{p}_key")) & (F.col(day) >= F.col(f"{p}_start")) & (F.col(day) < F.col(f"{p}_end"))
    met = rows.withColumn("_month", _month(F.col(day)))
    met = met.join(short, (F.col("_month") == F.col("_in")) & holds(""), "left").join(long, holds("_long"), "left")
    return met.select(*(F.col(f"`{c}`") for c in rows.columns), *(F.coalesce(f"_{v}", f"_long_{v}").alias(v) for v in values))


def spans_of_days(days: DataFrame, keys: list[str], day: str, start: str = "from_date", end: str = "before_date") -> DataFrame:
    """Runs of consecutive days as ranges."""
    rows = days.select(*keys, F.col(day).alias(start), F.date_add(day, 1).alias(end)).distinct()
    return merge_ranges(rows, keys, start, end)


def upsert_coverage(existing: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage after adding spans: touching spans become one, which keeps the oldest last_fetched_at."""
    return merge_ranges(existing.unionByName(added), keys, "covered_from", "covered_before", F.min("last_fetched_at").alias("last_fetched_at"))


def chunk_ranges(ranges: DataFrame, days: int = 365, start: str = "from_date", end: str = "before_date") -> DataFrame:
    """Each range in pieces of at most ``days`` days."""
    cuts = F.sequence(F.col(start), F.date_sub(end, 1), F.expr(f"interval {int(days)} days"))
    return ranges.where(F.col(start) < F.col(end)).withColumn("_cut", F.explode(cuts)).withColumn(end, F.least(F.date_add("_cut", days), F.col(end))).withColumn(start, F.col("_cut")).drop("_cut")


def overlapping(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The keys for which two rows' intervals overlap; a null bound is open."""
    low, high = F.coalesce(start, F.lit("0001-01-01").cast("date")), F.coalesce(end, F.lit(FOREVER).cast("date"))
    by = Window.partitionBy(*keys).orderBy("_low", "_high")
    reach = F.max("_high").over(by.rowsBetween(Window.unboundedPreceding, -1))
    bounded = rows.withColumn("_low", low).withColumn("_high", high)
    return bounded.withColumn("_reach", reach).where("_low < _reach").select(*keys).distinct()


def held_ranges(postings: DataFrame, today: str, extend: bool = True) -> DataFrame:
    """Rows (instrument_id, from_date, before_date): when any user held an instrument, by raw quantity.

    A run starts on the day its end-of-day position leaves zero and ends on the day it returns; one still
    open ends after ``today``, or a day after it started without ``extend``.
    """
    daily = postings.where("account_type = 'USER' and instrument_id is not null").groupBy("user_id", "instrument_id", F.col("order_date").alias("day")).agg(F.sum("quantity").alias("net"))
    by = Window.partitionBy("user_id", "instrument_id").orderBy("day")
    held = daily.withColumn("held", F.sum("net").over(by.rowsBetween(Window.unboundedPreceding, 0)) != 0)
    changed = held.withColumn("_was", F.coalesce(F.lag("held").over(by), F.lit(False))).where("held <> _was")
    last = F.date_add(F.lit(today).cast("date"), 1) if extend else F.date_add("day", 1)
    runs = changed.withColumn("before_date", F.coalesce(F.lead("day").over(by), last)).where("held")
    return merge_ranges(runs.select("instrument_id", F.col("day").alias("from_date"), "before_date"), ["instrument_id"])


def merged_coverage(coverage: DataFrame) -> DataFrame:
    """Each instrument's coverage over all plugins: (instrument_id, from_date, before_date)."""
    return merge_ranges(coverage.select("instrument_id", F.col("covered_from").alias("from_date"), F.col("covered_before").alias("before_date")), ["instrument_id"])


def price_gaps(postings: DataFrame, coverage: DataFrame, today: str) -> DataFrame:
    """Held ranges that no plugin has covered."""
    return subtract_ranges(held_ranges(postings, today), merged_coverage(coverage), ["instrument_id"])


def fx_gaps(postings: DataFrame, instruments: DataFrame, users: DataFrame, pairs: DataFrame, coverage: DataFrame, today: str) -> DataFrame:
    """Ranges in which a currency pair (instrument_id, currency) is needed and not covered.

    A held instrument needs its own currency's pair unless that is USD, and the pair of each display
    currency but USD that isn't the instrument's own.
    """
    held = held_ranges(postings, today).join(instruments.where("asset_class <> 'FX'").select("instrument_id", "currency"), "instrument_id")
    own = held.where("currency <> 'USD'").select(F.col("currency").alias("need"), "from_date", "before_date")
    shown = users.where("display_currency is not null and display_currency not in ('', 'USD')").select(F.col("display_currency").alias("need")).distinct()
    runs = merge_ranges(held.select("currency", "from_date", "before_date"), ["currency"])  # a few currencies
    other = runs.join(F.broadcast(shown), F.col("need") != F.col("currency")).select("need", "from_date", "before_date")
    needed = own.unionByName(other).join(F.broadcast(pairs.withColumnRenamed("currency", "need")), "need").select("instrument_id", "from_date", "before_date")
    return subtract_ranges(needed, merged_coverage(coverage), ["instrument_id"])


def plugin_outstanding(gaps: DataFrame, coverage: DataFrame, cutoff: str) -> DataFrame:
    """What of each gap each plugin hasn't covered yet, as parts before ``cutoff`` (unreachable) and from it (fetchable)."""
    plugins = coverage.select("plugin_id").distinct()
    wanted = gaps.crossJoin(F.broadcast(plugins))  # one row for each configured plugin
    have = coverage.select("instrument_id", "plugin_id", F.col("covered_from").alias("from_date"), F.col("covered_before").alias("before_date"))
    left = subtract_ranges(wanted, have, ["instrument_id", "plugin_id"])
    edge = F.lit(cutoff).cast("date")
    head = left.withColumn("before_date", F.least("before_date", edge)).withColumn("reachable", F.lit(False))
    tail = left.withColumn("from_date", F.greatest("from_date", edge)).withColumn("reachable", F.lit(True))
    return head.unionByName(tail).where("from_date < before_date")


def event_gaps(first_held: DataFrame, coverage: DataFrame, end: str) -> DataFrame:
    """For each instrument [first_date, end) less its coverage."""
    needed = first_held.select("instrument_id", F.col("first_date").alias("from_date"), F.lit(end).cast("date").alias("before_date"))
    return subtract_ranges(needed, merged_coverage(coverage), ["instrument_id"])


def inflation_gap(indices: DataFrame, first_month: str, today: str) -> DataFrame:
    """For each currency the range from its first missing month to the first of the current month; none if none is missing."""
    months = F.sequence(F.lit(first_month).cast("date"), F.add_months(F.trunc(F.lit(today).cast("date"), "month"), -1), F.expr("interval 1 month"))
    wanted = indices.select("currency").distinct().withColumn("month", F.explode(months))
    missing = wanted.join(indices.select("currency", "month"), ["currency", "month"], "left_anti")
    return missing.groupBy("currency").agg(F.min("month").alias("from_date"), F.trunc(F.lit(today).cast("date"), "month").alias("before_date"))


def overlap_probe(rows: DataFrame, asked: DataFrame, keys: list[str], start: str, end: str, holder: str) -> DataFrame:
    """``asked`` (keys, holder, start, end) with other_holder: another holder of the same keys at an overlapping time, the smallest if several.

    A null bound is open; what no other holds isn't returned.
    """
    low, high = F.lit("0001-01-01").cast("date"), F.lit(FOREVER).cast("date")
    held = rows.select(*keys, F.col(holder).alias("other_holder"), F.coalesce(start, low).alias("_from"), F.coalesce(end, high).alias("_before"))
    met = asked.join(held, keys).where((F.col("other_holder") != F.col(holder)) & (F.col("_from") < F.coalesce(end, high)) & (F.col("_before") > F.coalesce(start, low)))
    return met.groupBy(*asked.columns).agg(F.min("other_holder").alias("other_holder"))

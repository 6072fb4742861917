"""Listings, pages and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.texts import page_token
from ledgerlake.functions.txtypes import PARENTS, lineage


def page_size(asked: int | None) -> int:
    """A page's size: 50 unless between 1 and 100 were asked for."""
    return asked if asked and 0 < asked <= 100 else 50


def paged(rows: DataFrame, order: list[Column], size: int | None = None, offset: int = 0) -> DataFrame:
    """A page of ``rows`` in ``order``, with total, how many rows there are, and next_token of the page behind it (empty for the last)."""
    size = page_size(size)
    counted = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(*order).offset(offset).limit(size).crossJoin(F.broadcast(counted))  # one row
    return page.withColumn("next_token", F.when(F.col("total") > offset + size, page_token(F.lit(offset + size))).otherwise(""))


def prices_by() -> list[Column]:
    """The order of a price listing: latest first, names within a day."""
    return [F.desc("price_date"), F.lower("name"), F.col("instrument_id")]


def list_prices(bars: DataFrame, instruments: DataFrame, search: str | None = None, start: str | None = None, before: str | None = None, provider: str | None = None) -> DataFrame:
    """Bars with instrument names in order; filters that aren't given don't apply. A provider is looked for in data_provider."""
    rows = bars.join(instruments.select("instrument_id", "name"), "instrument_id")
    rows = rows.where(F.col("name").ilike(f"%{search}%")) if search else rows
    rows = rows.where(F.col("price_date") >= F.lit(start).cast("date")) if start else rows
    rows = rows.where(F.col("price_date") < F.lit(before).cast("date")) if before else rows
    rows = rows.where(F.col("data_provider") == provider) if provider else rows
    return rows.orderBy(*prices_by())


def list_instruments(instruments: DataFrame, search: str | None = None, asset_classes: list[str] | None = None) -> DataFrame:
    """Instruments by name; UNKNOWN among the classes also takes those without one."""
    rows = instruments.where(F.col("name").ilike(f"%{search}%")) if search else instruments
    if asset_classes:
        keep = F.col("asset_class").isin(asset_classes)
        keep = keep | F.coalesce(F.col("asset_class") == "", F.lit(True)) if "UNKNOWN" in asset_classes else keep
        rows = rows.where(keep)
    return rows.orderBy(F.lower("name"), "instrument_id")


def list_inflation(indices: DataFrame, currency: str, start: str | None = None, before: str | None = None) -> DataFrame:
    rows = indices.where(F.col("currency") == currency)
    rows = rows.where(F.col("month") >= F.lit(start).cast("date")) if start else rows
    rows = rows.where(F.col("month") < F.lit(before).cast("date")) if before else rows
    return rows.orderBy(F.desc("month"))


def list_postings(postings: DataFrame, user_id, groups: int, offset: int = 0, broker: str | None = None, account: str | None = None, start: str | None = None, before: str | None = None, descending: bool = False) -> DataFrame:
    """A page of ``groups`` whole groups of a user's postings, by (group's day, group, day, posting); only postings that pass the filters are shown.

    A group's day is its first posting's, whether that passes the filters or not. With no ``user_id``, postings
    of any user, for instance a portfolio's members, are listed.
    """
    days = postings.groupBy("group_id").agg(F.min("order_date").alias("timestamp"))
    rows = postings if user_id is None else postings.where(F.col("user_id") == user_id)
    rows = rows.where(F.col("broker") == broker) if broker else rows
    rows = rows.where(F.col("account") == account) if account else rows
    rows = rows.where(F.col("order_date") >= F.lit(start).cast("date")) if start else rows
    rows = rows.where(F.col("order_date") < F.lit(before).cast("date")) if before else rows
    by = lambda *columns: [F.desc(c) if descending else F.asc(c) for c in columns]
    page = days.join(rows.select("group_id").distinct(), "group_id").orderBy(*by("timestamp", "group_id")).offset(offset).limit(groups)
    return rows.join(page, "group_id").orderBy(*by("timestamp", "group_id", "order_date", "tx_id"))


def brokers_and_accounts(postings: DataFrame) -> DataFrame:
    return postings.where("account_type = 'USER'").select("user_id", "broker", "account").distinct()


def start_dates(postings: DataFrame) -> DataFrame:
    """Each user's first day with a stated posting."""
    return postings.where("account_type = 'USER'").groupBy("user_id").agg(F.min("order_date").alias("start_date"))


def display_currencies(users: DataFrame) -> DataFrame:
    return users.where("display_currency is not null and display_currency <> ''").select("display_currency").distinct()


def export_prices(bars: DataFrame, best: DataFrame, coverage: DataFrame) -> DataFrame:
    """Bars by identifier, with a basis only where it isn't the bar's own day; instruments with coverage and no bars have one row without a day."""
    basis = F.nullif(F.col("share_count_basis"), F.col("price_date"))
    rows = bars.join(best, "instrument_id").select("instrument_id", "identifier_type", "value", "price_date", "close", basis.alias("share_count_basis"))
    empty = coverage.select("instrument_id").distinct().join(bars.select("instrument_id").distinct(), "instrument_id", "left_anti").join(best, "instrument_id")
    return rows.unionByName(empty.select("instrument_id", "identifier_type", "value"), allowMissingColumns=True)


def export_windows(postings: DataFrame) -> DataFrame:
    """Each user's stated postings at a broker as one window: [first day, day after the last) and how many."""
    return postings.where("account_type = 'USER'").groupBy("user_id", "broker").agg(F.min("order_date").alias("period_from"), F.date_add(F.max("order_date"), 1).alias("period_before"), F.count("*").alias("n_postings"))


#: How strong a claim a type has to stand for its event, and in which order the other legs are read.
PRINCIPAL_ORDER = {"TRADE_ASSET": 1, "TRADE": 2, "INCOME": 3, "TRANSFER": 4, "EXPENSE": 5, "TRADE_CASH": 6, "AMBIGUOUS": 7}
LEG_ORDER = {"TRADE_CASH": 1, "TRADE_ASSET": 2, "TRADE": 2, "INCOME": 3, "TRANSFER": 4, "EXPENSE": 5, "AMBIGUOUS": 6}
#: Account types of legs that balancing routes.
ROUTED = ("TRANSFER_CLEARING", "IMBALANCE", "SOURCE_ROUNDING")


def _place(order: dict[str, int]) -> Column:
    """The place of a type: its own, or that of its nearest ancestor; unknown ones come last."""
    places = {kind: next(order[k] for k in lineage(kind) if k in order) for kind in PARENTS}
    known = F.create_map(*(F.lit(x) for pair in places.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.col("tx_type")), F.lit(max(order.values()) + 1))


def principal_legs(postings: DataFrame) -> DataFrame:
    """Postings with leg_rank: 1 for the leg that a group is shown as, the others in the order they are read in.

    The principal is the user's own leg of the strongest type, then of the largest amount, then the smallest
    tx_id; a group without a leg of its user's chooses among all. The others go stated before routed, by kind
    of leg, larger amounts first.
    """
    size, group = F.desc(F.abs("quantity")), Window.partitionBy("group_id")
    own = F.when(F.coalesce("account_type", F.lit("USER")) == "USER", 0).otherwise(1)
    routed = F.when(F.col("account_type").isin(*ROUTED), 1).otherwise(0)
    shown = postings.withColumn("_first", F.row_number().over(group.orderBy(own, _place(PRINCIPAL_ORDER), size, "tx_id")))
    order = group.orderBy(F.when(F.col("_first") == 1, 0).otherwise(1), routed, _place(LEG_ORDER), size, "tx_id")
    return shown.withColumn("leg_rank", F.row_number().over(order)).drop("_first")


def latest_supplied(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows that repeat a key, the last supplied."""
    by = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_row", F.row_number().over(by)).where("_row = 1").drop("_row")


def fetch_windows(postings: DataFrame, today: str, lookback: int, history_start: str) -> DataFrame:
    """For each user and broker the window to fetch next: from ``lookback`` days before the latest posting, not before ``history_start``, to ``today``."""
    latest = postings.where("account_type = 'USER'").groupBy("user_id", "broker").agg(F.max("order_date").alias("latest"))
    start = F.greatest(F.date_sub("latest", lookback), F.lit(history_start).cast("date"))
    return latest.select("user_id", "broker", start.alias("from_date"), F.lit(today).cast("date").alias("before_date")).where("from_date < before_date")


def export_events(splits: DataFrame, coverage: DataFrame, best: DataFrame, dividends: DataFrame | None = None) -> DataFrame:
    """Rows (instrument_id, identifier_type, value, splits, dividends, spans): each instrument's events by day and its coverage, by its best identifier.

    Instruments with coverage and no events are listed too; one without an identifier isn't.
    """
    ratio = F.struct("ex_date", F.col("split_from").cast("decimal(18,6)").alias("split_from"), F.col("split_to").cast("decimal(18,6)").alias("split_to"))
    events = splits.groupBy("instrument_id").agg(F.array_sort(F.collect_list(ratio)).alias("splits"))
    spans = coverage.groupBy("instrument_id").agg(F.array_sort(F.collect_list(F.struct("from_date", "before_date"))).alias("spans"))
    rows = events.join(spans, "instrument_id", "full")
    held = ["splits", "spans"]
    if dividends is not None:
        paid = dividends.groupBy("instrument_id").agg(F.array_sort(F.collect_list(F.struct("ex_date", "amount", "currency"))).alias("dividends"))
        rows, held = rows.join(paid, "instrument_id", "full"), [*held, "dividends"]
    rows = rows.join(best.select("instrument_id", "identifier_type", "value"), "instrument_id")
    return rows.withColumns({c: F.coalesce(c, F.array()) for c in held})


def list_unhandled_events(events: DataFrame, instruments: DataFrame, include_resolved: bool = False) -> DataFrame:
    """Events that need a person, with instrument names, latest first: ``events`` (event_id, instrument_id, ex_date, event_type, resolved)."""
    rows = events if include_resolved else events.where("not resolved")
    return rows.join(instruments.select("instrument_id", "name"), "instrument_id", "left").orderBy(F.desc("ex_date"), "event_id")


def list_jobs(jobs: DataFrame, errors: DataFrame, kinds: list[str]) -> DataFrame:
    """``jobs`` (job_id, ...) with n_<kind> for each of ``kinds``: how many rows of ``errors`` (job_id, kind) each has."""
    counts = errors.groupBy("job_id").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds))
    return jobs.join(counts, "job_id", "left").fillna(0, [f"n_{k}" for k in kinds])

from __future__ import annotations

from datetime import date
from decimal import Decimal as D

from pyspark.sql import functions as F

from ledgerlake.sources import sheets


def test_days_in_every_layout(spark):
    rows = [("2021-03-04",), ("2021-03-04 16:00:00",), ("4/3/2021",), ("04/03/2021",), ("04/03/2021 16:00:00",), ("25/12/2021",), ("12/25/2021",), ("4-Mar-2021",), ("04-Mar-21",), ("Mar 4, 2021",), (" 44259 ",), ("44259.67",), ("1",), ("soon",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    read = lambda order: [r["d"] for r in df.select(sheets.sheet_day(F.col("t"), order).alias("d")).collect()]
    march, april, christmas = date(2021, 3, 4), date(2021, 4, 3), date(2021, 12, 25)
    assert read("dmy") == [march] * 5 + [christmas] * 2 + [march] * 5 + [None] * 4
    assert read("mdy") == [march] * 2 + [april] * 3 + [christmas] * 2 + [march] * 5 + [None] * 4


def test_a_grid_of_pairs(spark):
    grid = [
        (0, ["MIC_TICKER|XNAS|ABC|STOCK", "", "bad header", "", "ISIN||US1|ETF", None]),
        (1, ["Date", "Close", "2021-01-04", "5", "2021-01-04", "1e2"]),
        (2, ["2021-01-04", "10.50", "2021-01-05", "6", "#N/A", "1"]),
        (3, ["2021-01-05", "#ERROR!", "", "", "2021-01-05", "dear"]),
        (4, ["someday", "11"]), (5, ["2021-01-06"]), (6, []), (7, None),
    ]
    prices, warnings = sheets.read_grid(spark.createDataFrame([(1, *r) for r in grid], "sheet long, row int, cells array<string>"), "2021-02-01")
    assert {(r["value"], r["domain"], r["price_date"], r["close"], r["share_count_basis"]) for r in prices.collect()} == {("ABC", "XNAS", date(2021, 1, 4), D("10.5"), date(2021, 2, 1)), ("US1", "", date(2021, 1, 4), D(100), date(2021, 2, 1))}
    assert {(r["row"], r["column"], r["warning"]) for r in warnings.collect()} == {(0, 2, "header"), (3, 5, "close"), (4, 0, "day")}
    none = spark.createDataFrame([], "sheet long, row int, cells array<string>")
    assert [df.count() for df in sheets.read_grid(none, "2021-02-01")] == [0, 0]


def _asked(spark, kinds, gaps):
    instruments = spark.createDataFrame([(i, f"N{i}", "STOCK", mic) for i, (_, _, _, mic) in kinds.items()], "instrument_id long, name string, asset_class string, exchange_mic string")
    names = [(i, k, d, v, None) for i, (k, d, v, _) in kinds.items()]
    identifiers = spark.createDataFrame(names, "instrument_id long, identifier_type string, domain string, value string, valid_before date")
    wanted = spark.createDataFrame(gaps, "instrument_id long, from_date date, before_date date")
    return sheets.requests(wanted, instruments, identifiers, F.lit(1))


def test_requests_go_by_venue_and_year_and_the_rest_is_told_of(spark):
    kinds = {1: ("MIC_TICKER", "XTSE", "A", "XNAS"), 2: ("MIC_TICKER", None, "B", "XSWX"), 3: ("OPENFIGI_TICKER", "US", "C", "XNAS"), 4: ("FX_PAIR", None, "EURUSD", None), 5: ("OPENFIGI_TICKER", "US", "E", None), 6: ("MIC_TICKER", "XXXX", "F", "XNAS"), 7: ("ISIN", None, "US7", "XNAS"), 8: ("BROKER_DESCRIPTION", "IBKR", "H", "XNAS")}
    gaps = [(i, date(2020, 1, 1), date(2021, 1, 2)) for i in kinds] + [(1, date(2022, 3, 1), date(2022, 3, 2)), (1, date(2023, 1, 1), date(2023, 1, 1)), (9, date(2020, 1, 1), date(2021, 1, 1)), (6, date(2022, 1, 1), date(2022, 1, 2))]
    columns, skipped = _asked(spark, kinds, gaps)
    said = [(r["column"], r["header"], r["formula"].removeprefix('=GOOGLEFINANCE("').removesuffix(',"DAILY")')) for r in columns.orderBy("column").collect()]
    years = ('","close",DATE(2020,1,1),DATE(2020,12,30)', '","close",DATE(2020,12,31),DATE(2021,1,1)')
    heads = [("MIC_TICKER|XTSE|A|STOCK", "TSE:A"), ("MIC_TICKER||B|STOCK", "VTX:B"), ("OPENFIGI_TICKER|US|C|STOCK", "NASDAQ:C"), ("FX_PAIR||EURUSD|STOCK", "CURRENCY:EURUSD")]
    expected = [(h, t + y) for h, t in heads for y in years]
    expected.insert(2, ("MIC_TICKER|XTSE|A|STOCK", 'TSE:A","close",DATE(2022,3,1),DATE(2022,3,1)'))
    assert said == [(2 * i, *e) for i, e in enumerate(expected)]
    assert {tuple(r) for r in skipped.collect()} == {(5, "N5", "NO_VENUE", ""), (6, "N6", "UNKNOWN_VENUE", "XXXX"), (7, "N7", "UNSUPPORTED_TYPE", "XNAS")}
    assert skipped.count() == 3


def test_a_grid_of_requests_has_headers_that_the_reader_takes(spark):
    columns, _ = _asked(spark, {1: ("MIC_TICKER", "XNAS", "A", None)}, [(1, date(2020, 1, 1), date(2021, 1, 2))])
    grid = sheets.request_grid(columns).orderBy("row").collect()
    assert [(r["sheet"], r["row"], len(r["cells"])) for r in grid] == [(1, 0, 4), (1, 1, 4)]
    filled = spark.createDataFrame([(1, 0, grid[0]["cells"]), (1, 1, ["2020-01-02", "5", "2020-12-31", "6"])], "sheet long, row int, cells array<string>")
    prices, warnings = sheets.read_grid(filled, "2021-02-01")
    assert sorted((r["value"], r["close"]) for r in prices.collect()) == [("A", D(5)), ("A", D(6))] and warnings.count() == 0
    none, skipped = _asked(spark, {1: ("MIC_TICKER", "XNAS", "A", None)}, [])
    assert sheets.request_grid(none).count() == 0 and skipped.count() == 0

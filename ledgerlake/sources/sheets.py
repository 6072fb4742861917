"""Price grids of spreadsheets: column pairs of days and closes, one pair for each instrument, with a typed header.

A grid comes as rows of cells (text). Its first row has ``type|domain|value|asset class`` above each pair. A grid
of requests has a formula below each header, which the spreadsheet spells out to days and closes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.decimals import QUANTITY
from ledgerlake.operators.identity import PRICE_ORDER, best_identifier
from ledgerlake.operators.intervals import chunk_ranges

#: Day zero of spreadsheets' serial days.
SERIAL_ZERO = "1899-12-30"
#: Layouts of days, tried in turn. Those with slashes go by the order of day and month that the user states, then by the other.
ISO_LAYOUTS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss")
DAY_FIRST, MONTH_FIRST = ("d/M/yyyy", "d/M/yyyy H:mm:ss"), ("M/d/yyyy", "M/d/yyyy H:mm:ss")
NAMED_LAYOUTS = ("d-MMM-yyyy", "d-MMM-yy", "MMM d, yyyy")

#: Days that one formula asks for at most.
FORMULA_DAYS = 365
#: The spreadsheet's exchange codes by ISO venue.
EXCHANGE_CODES = dict(x.split("=") for x in """
XBUE=BCBA XMEX=BMV BVMF=BVMF XCNQ=CNSX XNAS=NASDAQ XNYS=NYSE ARCX=NYSEARCA XASE=NYSEAMERICAN OTCM=OTCMKTS XTSE=TSE XTSX=TSXV
XAMS=AMS XMIL=BIT BMEX=BME XCSE=CPH XBRU=EBR XLIS=ELI XPAR=EPA XETR=ETR XFRA=FRA XHEL=HEL XICE=ICE XIST=IST XLON=LON XRIS=RSE
XSTO=STO XSWX=VTX XTAL=TAL XWBO=VIE XLIT=VSE XWAR=WSE XJSE=JSE XSAU=TADAWUL XTAE=TLV XBKK=BKK XBOM=BOM XKLS=KLSE XHKG=HKG XIDX=IDX
XKOS=KOSDAQ XKRX=KRX XNSE=NSE XSES=SGX XSHG=SHA XSHE=SHE XTAI=TPE XTKS=TYO XASX=ASX XNZE=NZE""".split())


def sheet_day(text: Column, order: str = "dmy") -> Column:
    """The day that a cell states in any of the layouts, or as a serial number above one; null if in none."""
    said = F.trim(text)
    slashes = (*MONTH_FIRST, *DAY_FIRST) if order == "mdy" else (*DAY_FIRST, *MONTH_FIRST)
    found = [F.try_to_timestamp(said, F.lit(layout)).cast("date") for layout in (*ISO_LAYOUTS, *slashes, *NAMED_LAYOUTS)]
    number = said.try_cast("double")
    serial = F.when((number > 1) & (number < 3_000_000), F.date_add(F.lit(SERIAL_ZERO).cast("date"), F.floor(number).cast("int")))
    return F.coalesce(*found, serial)


def _pairs(grid: DataFrame) -> DataFrame:
    """Rows (sheet, row, column, day_cell, close_cell) of the pairs of every row of ``grid``; a cell that a row lacks is null."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("cells") - 1, F.lit(0)), F.lit(2))
    rows = grid.where(F.size("cells") > 0).select("sheet", "row", F.explode(starts).alias("column"), "cells")
    cell = lambda at: F.get("cells", at)
    return rows.select("sheet", "row", "column", cell(F.col("column")).alias("day_cell"), cell(F.col("column") + 1).alias("close_cell"))


def read_grid(grid: DataFrame, basis: str, order: str = "dmy") -> tuple[DataFrame, DataFrame]:
    """(prices, warnings) of ``grid`` (sheet, row from 0, cells: array of text).

    prices: (sheet, column, identifier_type, domain, value, asset_class, price_date, close, share_count_basis);
    closes are adjusted as of ``basis``, the day they were fetched. Pairs without a header, blank cells, repeated
    headings and error values are passed over; a header, day or close that can't be read makes a row of
    warnings (sheet, row, column, warning), and a pair with a bad header gives nothing else.
    """
    pairs = _pairs(grid)
    fields = F.split("day_cell", r"\|", -1)
    heads = pairs.where("row = 0 and day_cell <> ''").select("sheet", "column", fields.alias("head"), F.col("day_cell").alias("said"))
    good = heads.where(F.size("head") == 4).select("sheet", "column", F.col("head")[0].alias("identifier_type"), F.col("head")[1].alias("domain"), F.col("head")[2].alias("value"), F.col("head")[3].alias("asset_class"))
    named = pairs.where("row > 0 and day_cell <> '' and close_cell <> '' and day_cell <> 'Date'").where(~F.col("day_cell").startswith("#") & ~F.col("close_cell").startswith("#"))
    close = F.col("close_cell").try_cast("decimal(38,18)")
    read = named.join(good, ["sheet", "column"]).withColumns({"price_date": sheet_day(F.col("day_cell"), order), "close": close})
    prices = read.where("price_date is not null and close is not null").select("sheet", "column", "identifier_type", "domain", "value", "asset_class", "price_date", F.col("close").cast(QUANTITY).alias("close"), F.lit(basis).cast("date").alias("share_count_basis"))
    bad_heads = heads.where(F.size("head") != 4).select("sheet", F.lit(0).alias("row"), "column", F.lit("header").alias("warning"))
    bad = read.where("price_date is null or close is null").select("sheet", "row", F.when(F.col("price_date").isNull(), F.col("column")).otherwise(F.col("column") + 1).alias("column"), F.when(F.col("price_date").isNull(), "day").otherwise("close").alias("warning"))
    return prices, bad_heads.unionByName(bad)


def requests(gaps: DataFrame, instruments: DataFrame, identifiers: DataFrame, sheet: Column) -> tuple[DataFrame, DataFrame]:
    """(columns, skipped) that ask a spreadsheet for the closes of ``gaps`` (instrument_id, from_date, before_date).

    columns: (sheet, column, header, formula), a column pair for each FORMULA_DAYS of a gap; ``sheet`` says which
    sheet an instrument's pairs are on, and they are numbered within it. skipped: (instrument_id, name, reason,
    venue), once an instrument: NO_VENUE, UNKNOWN_VENUE (no exchange code) or UNSUPPORTED_TYPE. A ticker's own venue
    goes before its instrument's; a pair needs none. Instruments without an identifier in force that names a
    security for prices, unknown ones and empty gaps are passed over.
    """
    best = best_identifier(identifiers, PRICE_ORDER, only_known=True).select("instrument_id", "identifier_type", F.coalesce("domain", F.lit("")).alias("domain"), "value")
    known = instruments.select("instrument_id", "name", F.coalesce("asset_class", F.lit("")).alias("asset_class"), F.coalesce("exchange_mic", F.lit("")).alias("exchange_mic"))
    rows = gaps.where("from_date < before_date").join(known.join(best, "instrument_id"), "instrument_id")
    kind = F.col("identifier_type")
    venue = F.when((kind == "MIC_TICKER") & (F.col("domain") != ""), F.col("domain")).otherwise(F.col("exchange_mic"))
    codes = F.create_map(*(F.lit(x) for pair in EXCHANGE_CODES.items() for x in pair))
    code = F.try_element_at(codes, venue)
    listed = kind.isin("MIC_TICKER", "OPENFIGI_TICKER")
    reason = F.when(kind == "FX_PAIR", None).when(~listed, "UNSUPPORTED_TYPE").when(venue == "", "NO_VENUE").when(code.isNull(), "UNKNOWN_VENUE")
    ticker = F.concat(F.when(kind == "FX_PAIR", "CURRENCY").otherwise(code), F.lit(":"), F.col("value"))
    told = rows.withColumns({"venue": venue, "reason": reason, "ticker": ticker, "sheet": sheet})
    skipped = told.where("reason is not null").select("instrument_id", "name", "reason", "venue").distinct()
    day = lambda d: F.date_format(d, "'DATE('y,M,d')'")
    formula = F.concat(F.lit('=GOOGLEFINANCE("'), "ticker", F.lit('","close",'), day(F.col("from_date")), F.lit(","), day(F.date_sub("before_date", 1)), F.lit(',"DAILY")'))  # the last day counts
    asked = chunk_ranges(told.where("reason is null"), FORMULA_DAYS)
    place = (F.row_number().over(Window.partitionBy("sheet").orderBy("instrument_id", "from_date", "before_date")) - 1) * 2
    return asked.select("sheet", place.cast("int").alias("column"), F.concat_ws("|", kind, "domain", "value", "asset_class").alias("header"), formula.alias("formula")), skipped


def request_grid(columns: DataFrame) -> DataFrame:
    """Rows (sheet, row, cells) of ``columns`` of ``requests``: headers in row 0, formulas in row 1, a blank cell to the right of each.

    A sheet is two rows, so it must not hold more columns than a spreadsheet takes.
    """
    pairs = F.array_sort(F.collect_list(F.struct("column", "header", "formula")))
    held = columns.groupBy("sheet").agg(pairs.alias("pairs"))
    cells = lambda field: F.flatten(F.transform("pairs", lambda p: F.array(p[field], F.lit(""))))
    return held.select("sheet", F.posexplode(F.array(cells("header"), cells("formula"))).alias("row", "cells"))

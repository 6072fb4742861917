"""Column expressions over texts that sources write: dates, lines, page tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ofx_datetime(value: Column) -> Column:
    """The UTC time of ``YYYYMMDD[HHMMSS[.fff]][[offset:TZ]]``; without an offset it counts as UTC, and what is no date is null."""
    text = F.trim(value)
    digits = F.regexp_extract(text, r"^(\d{8}(?:\d{6})?)", 1)
    whole = F.when(F.length(digits) == 14, digits).when(F.length(digits) == 8, F.concat(digits, F.lit("000000")))
    offset = F.regexp_extract(text, r"\[([+-]?\d+(?:\.\d+)?)", 1)
    minutes = F.round(F.coalesce(F.nullif(offset, F.lit("")).cast("double"), F.lit(0.0)) * 60).cast("int")
    local = F.try_to_timestamp(whole, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    return local - F.make_dt_interval(mins=minutes)


def csv_fields(line: Column, n: int) -> Column:
    """The first ``n`` fields of a CSV line as an array: quotes may hold commas, and a doubled quote is one."""
    parsed = F.from_csv(line, ", ".join(f"c{i} string" for i in range(n)), {"escape": '"', "mode": "PERMISSIVE"})
    return F.array(*(parsed[f"c{i}"] for i in range(n)))


def page_token(offset: Column) -> Column:
    return F.base64(offset.cast("string").cast("binary"))


def page_offset(token: Column) -> Column:
    """The offset that a page token holds; 0 for null, an empty one, or one that holds none."""
    text = F.try_to_binary(F.coalesce(token, F.lit("")), F.lit("base64")).cast("string")
    return F.coalesce(F.when(text.rlike(r"^-?\d{1,18}$"), text.cast("string").try_cast("long")), F.lit(0).cast("long"))

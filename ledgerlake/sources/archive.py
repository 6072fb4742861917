"""User archives: JSON documents of upload windows, read with a stated schema and spread into rows.

Unknown fields are ignored. Enumerated values may carry their type's name as a prefix, which is taken off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT_VERSION = 1
#: 64-bit numbers may be written as strings, so they are read as such.
CORRELATION = "struct<label: string, token: string, ordinal: string, scope: string, match: array<string>, ordinal_span: string>"
POSTING = f"""struct<order_date: string, trade_date: string, account: string, account_type: string, instrument_description: string,
  identifier_hints: array<struct<type: string, domain: string, value: string>>, asset_class_hint: string, broker_tx_type: array<string>,
  quantity: string, unit_price: string, trading_currency: string, settlement_currency: string, settlement_amount: string,
  share_count_basis: string, correlations: array<{CORRELATION}>>"""
WINDOW = f"struct<broker: string, period_from: string, period_before: string, source: string, postings: array<{POSTING}>>"
SCHEMA = f"envelope struct<format_version: int, exported_at: string, source_instance: string, kind: string>, preferences struct<display_currency: string>, txs struct<windows: array<{WINDOW}>>"


def _plain(value: Column, prefix: str) -> Column:
    return F.regexp_replace(value, f"^{prefix}_", "")


def read_archives(spark: SparkSession, path: str, kind: str = "USER") -> DataFrame:
    """One row for each archive below ``path`` with its file; raises for one without a version, of a newer version, or of another kind."""
    rows = spark.read.schema(SCHEMA).json(path, multiLine=True).withColumn("file", F.input_file_name())
    version = F.coalesce("envelope.format_version", F.lit(0))
    fault = F.when(version == 0, "no version is stated").when(version > FORMAT_VERSION, "this version is not known yet")
    fault = fault.when(~F.col("envelope.kind").eqNullSafe(kind), f"another kind than {kind}")
    return rows.where(F.assert_true(fault.isNull(), F.concat_ws(": ", fault, "file")).isNull())


def windows(archives: DataFrame) -> DataFrame:
    """Rows (file, window, broker, period_from, period_before, source, exported_at), one for each upload window."""
    spread = archives.select("file", F.to_timestamp("envelope.exported_at").alias("exported_at"), F.posexplode("txs.windows").alias("window", "w"))
    return spread.select("file", "window", "w.broker", F.to_timestamp("w.period_from").alias("period_from"), F.to_timestamp("w.period_before").alias("period_before"), "w.source", "exported_at")


def postings(archives: DataFrame) -> DataFrame:
    """Rows of all postings of all windows, with (file, window, row) as their place; an unset account type is USER, an unset basis the trade date."""
    spread = archives.select("file", F.posexplode("txs.windows").alias("window", "w")).select("file", "window", "w.broker", F.posexplode("w.postings").alias("row", "p"))
    day = lambda c: F.to_date(F.to_timestamp(c))
    amount = lambda c, kind: F.col(c).try_cast(kind)
    whole = lambda c, name: c[name].try_cast("long")
    correlations = F.transform("p.correlations", lambda c: F.struct(c["label"].alias("label"), c["token"].alias("token"), whole(c, "ordinal").alias("ordinal"), _plain(c["scope"], "SCOPE").alias("scope"), F.transform(c["match"], lambda m: _plain(m, "MATCH")).alias("match"), whole(c, "ordinal_span").alias("ordinal_span")))
    return spread.select(
        "file", "window", "row", "broker", day("p.order_date").alias("order_date"), day("p.trade_date").alias("trade_date"), F.coalesce("p.account", F.lit("")).alias("account"),
        F.coalesce(_plain(F.col("p.account_type"), "ACCOUNT_TYPE"), F.lit("USER")).alias("account_type"), F.col("p.instrument_description").alias("description"), "p.identifier_hints", "p.asset_class_hint",
        F.col("p.broker_tx_type").alias("tx_types"), amount("p.quantity", "decimal(18,6)").alias("quantity"), amount("p.unit_price", "decimal(18,6)").alias("unit_price"), "p.trading_currency", "p.settlement_currency",
        amount("p.settlement_amount", "decimal(18,2)").alias("settlement_amount"), F.coalesce(F.to_date("p.share_count_basis"), day("p.trade_date")).alias("share_count_basis"), correlations.alias("correlations"),
    )


def posting_faults(rows: DataFrame) -> DataFrame:
    """Rows (file, window, row, field, fault) of ``postings`` that break the format: no type, an ambiguous or repeated one, no description or quantity."""
    types = F.col("tx_types")
    checks = (
        ("broker_tx_type", F.coalesce(F.size(types), F.lit(0)) < 1, "no type"),
        ("broker_tx_type", F.array_contains(types, "AMBIGUOUS"), "AMBIGUOUS is no statement"),
        ("broker_tx_type", F.size(F.array_distinct(types)) < F.size(types), "a type is repeated"),
        ("instrument_description", F.coalesce("description", F.lit("")) == "", "no description"),
        ("quantity", F.col("quantity").isNull(), "no quantity"),
        ("order_date", F.col("order_date").isNull() | F.col("trade_date").isNull(), "no date"),
    )
    found = F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(text).alias("fault"))) for field, bad, text in checks))
    return rows.select("file", "window", "row", F.inline(F.filter(found, lambda x: x.isNotNull())))


def accepted(rows: DataFrame, faults: DataFrame) -> DataFrame:
    """``rows`` of windows without a fault: a window's postings are taken all or not at all."""
    return rows.join(faults.select("file", "window").distinct(), ["file", "window"], "left_anti").select(*rows.columns)

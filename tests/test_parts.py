"""Archives written, read back, and imported part by part."""

from __future__ import annotations

import json
from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerlake.sources import parts

NAMES = "instrument_id long, identifier_type string, domain string, value string"


def tables(spark):
    bars = [(7, date(2020, 12, 30), D("1.50"), date(2020, 12, 30)), (7, date(2021, 1, 4), D("-2"), date(2021, 1, 4)), (8, date(2021, 1, 4), D("3"), None)]
    frame = spark.createDataFrame(bars, "instrument_id long, price_date date, close decimal(18,6), share_count_basis date")
    names = spark.createDataFrame([(7, "MIC_TICKER", "XNAS", "ABC"), (8, "ISIN", None, "US1")], NAMES)
    instruments = spark.createDataFrame([(7, "STOCK", "USD"), (8, "ETF", "EUR")], "instrument_id long, asset_class string, currency string")
    return frame, names, instruments


def test_what_is_written_is_read(spark, tmp_path):
    bars, names, instruments = tables(spark)
    inflation = spark.createDataFrame([("GBP", date(2020, 1, 1), D("101.5")), ("GBP", date(2020, 2, 1), D("102"))], "currency string, month date, index_value decimal(18,6)")
    splits = spark.createDataFrame([(7, date(2020, 5, 1), D(1), D("1.5"))], "instrument_id long, ex_date date, split_from decimal(18,6), split_to decimal(18,6)")
    groups = {"INFLATION_INDICES": parts.inflation_groups(inflation, 2015), "PRICES": parts.price_groups(bars, names, instruments), "CORPORATE_EVENTS": parts.split_groups(splits, names, instruments), "FETCH_BLOCKS": spark.createDataFrame([], f"g {parts.SYSTEM_PARTS['FETCH_BLOCKS'][2]}").select("g.*")}
    path = f"file://{tmp_path}/out"
    parts.write_archive(spark, path, "SYSTEM", "2021-02-01T00:00:00Z", groups)
    read = parts.read_archive(spark, path, "SYSTEM")
    assert list(read) == ["PRICES", "CORPORATE_EVENTS", "INFLATION_INDICES", "FETCH_BLOCKS"]  # in order of restoring; absent parts aren't there, empty ones are
    assert read["FETCH_BLOCKS"].count() == 0
    status = {}
    for part, rows in read.items():
        status[part] = parts.import_part(part, rows, f"file://{tmp_path}/in/{part}")
    assert {p: tuple(s)[1:] for p, s in status.items()} == {"PRICES": (3, 3, 0), "CORPORATE_EVENTS": (1, 1, 0), "INFLATION_INDICES": (2, 2, 0), "FETCH_BLOCKS": (0, 0, 0)}
    good, bad = parts.imported(spark, "PRICES", f"file://{tmp_path}/in/PRICES", status["PRICES"])
    assert bad.count() == 0
    back = {(r["value"], r["price_date"], r["close"], r["share_count_basis"]) for r in parts.prices(good).collect()}
    assert back == {("ABC", date(2020, 12, 30), D("1.5"), date(2020, 12, 30)), ("ABC", date(2021, 1, 4), D(-2), date(2021, 1, 4)), ("US1", date(2021, 1, 4), D(3), None)}
    events, _ = parts.imported(spark, "CORPORATE_EVENTS", f"file://{tmp_path}/in/CORPORATE_EVENTS", status["CORPORATE_EVENTS"])
    assert [tuple(r)[2:] for r in parts.split_rows(events).collect()] == [("ABC", date(2020, 5, 1), D(1), D("1.5"))]
    with pytest.raises(ValueError):
        parts.write_archive(spark, path, "SYSTEM", "2021-02-01T00:00:00Z", {})
    with pytest.raises(ValueError):
        parts.write_archive(spark, f"{path}-2", "USER", "2021-02-01T00:00:00Z", groups)
    with pytest.raises(ValueError):
        parts.read_archive(spark, path, "USER")


def test_documents_of_all_parts_and_their_faults(spark, tmp_path):
    ref = {"type": "ISIN", "value": "US1"}
    body = {
        "envelope": {"format_version": 1, "kind": "SYSTEM", "unknown": 1},
        "instruments": {"instruments": [{"asset_class": "STOCK", "identifiers": [{"type": "ISIN", "value": "US1", "canonical": True}]}, {"identifiers": []}, {"identifiers": [{"type": "NO", "value": "1"}], "put_call": "X"}]},
        "prices": {"groups": [{"instrument": ref, "rows": [{"price_date": "2021-01-04", "close": "1.5", "volume": "7"}, {"price_date": "2021-13-04", "close": "x", "volume": "7.5"}]}, {"instrument": {"type": "ISIN", "value": ""}, "rows": [{"price_date": "2021-01-04", "close": "1"}]}]},
        "corporate_events": {"groups": [{"instrument": ref, "events": [{"split": {"ex_date": "2021-02-01", "split_from": "1", "split_to": "2"}}, {"split": {"ex_date": "2021-02-01", "split_from": "0", "split_to": "2"}}, {"dividend": {"ex_date": "2021-03-01", "amount": "0.25", "currency": "USD"}}, {"dividend": {"ex_date": "soon", "amount": "-1"}}, {}]}]},
        "inflation_indices": {"groups": [{"currency": "USD", "rows": [{"month": "2021-01-01", "index_value": "99", "base_year": 2015}, {"month": "2021-01-02", "index_value": "0", "base_year": 15}]}, {"rows": [{"month": "2021-01-01", "index_value": "99", "base_year": 2015}]}]},
        "fetch_blocks": {"groups": [{"instrument": ref, "blocks": [{"category": "PRICE", "plugin_id": "p", "reason": "gone"}, {"category": "IDENTIFIER", "plugin_id": "", "reason": "r"}]}]},
        "unhandled_events": {"groups": [{"instrument": ref, "events": [{"event_type": "REVERSE_SPLIT"}, {"event_type": "", "ex_date": "x"}]}]},
        "plugin_config": {"configs": [{"plugin_id": "p", "category": "PRICE", "precedence": 1}, {"plugin_id": "q", "precedence": 0}]},
    }
    (tmp_path / "a.json").write_text(json.dumps(body))
    (tmp_path / "b.json").write_text(json.dumps({"envelope": {"format_version": 1, "kind": "SYSTEM"}, "prices": {}}))
    groups = parts.document_parts(spark, str(tmp_path), "SYSTEM")
    faults = {(p, r["index"], r["field"]) for p, g in groups.items() for r in parts.checked(p, g).select("index", F.inline("faults")).collect()}
    assert faults == {
        ("INSTRUMENTS", 1, "identifiers"), ("INSTRUMENTS", 2, "identifiers"), ("INSTRUMENTS", 2, "put_call"),
        ("PRICES", 0, "price_date"), ("PRICES", 0, "close"), ("PRICES", 0, "volume"), ("PRICES", 1, "instrument"),
        ("CORPORATE_EVENTS", 0, "split"), ("CORPORATE_EVENTS", 0, "ex_date"), ("CORPORATE_EVENTS", 0, "amount"), ("CORPORATE_EVENTS", 0, "event"),
        ("INFLATION_INDICES", 0, "month"), ("INFLATION_INDICES", 0, "index_value"), ("INFLATION_INDICES", 0, "base_year"), ("INFLATION_INDICES", 1, "currency"),
        ("FETCH_BLOCKS", 0, "category"), ("FETCH_BLOCKS", 0, "plugin_id"), ("UNHANDLED_EVENTS", 0, "event_type"), ("UNHANDLED_EVENTS", 0, "ex_date"),
        ("PLUGIN_CONFIG", 1, "category"), ("PLUGIN_CONFIG", 1, "precedence"),
    }
    for whole, taken in ((False, 2), (True, 0)):
        path = f"file://{tmp_path}/in-{whole}"
        status = parts.import_part("CORPORATE_EVENTS", groups["CORPORATE_EVENTS"], path, whole)
        good, bad = parts.imported(spark, "CORPORATE_EVENTS", path, status)
        assert (status.rows, status.accepted, status.errors, good.count(), bad.count()) == (5, taken, 4, taken, 4)
        assert [(r["amount"], r["type"]) for r in parts.dividend_rows(good).collect()] == [(D("0.25"), "CD")] * (taken > 0)
    (tmp_path / "newer").mkdir()
    (tmp_path / "newer" / "c.json").write_text(json.dumps({"envelope": {"format_version": 2, "kind": "SYSTEM"}}))
    with pytest.raises(Exception, match="known version"):
        parts.document_parts(spark, str(tmp_path / "newer"), "SYSTEM")["PRICES"].collect()


def test_user_documents(spark, tmp_path):
    body = {"envelope": {"format_version": 1, "kind": "USER"}, "preferences": {"display_currency": "GBP"}, "declarations": {"statements": [{"broker": "IBKR", "as_of_date": "2021-01-01", "declarations": [{"instrument": {"type": "ISIN", "value": "US1"}, "declared_qty": "-5"}, {"instrument": {"type": "ISIN", "value": "US1"}, "declared_qty": "five", "share_count_basis": "2021"}]}]}}
    (tmp_path / "u.json").write_text(json.dumps(body))
    groups = parts.document_parts(spark, str(tmp_path), "USER")
    assert groups["PREFERENCES"].first()["g"]["display_currency"] == "GBP"
    assert {(r["field"]) for r in parts.checked("DECLARATIONS", groups["DECLARATIONS"]).select(F.inline("faults")).collect()} == {"declared_qty", "share_count_basis"}

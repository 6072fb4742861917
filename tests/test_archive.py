from __future__ import annotations

import json
from datetime import date
from decimal import Decimal as D

import pytest

from ledgerlake.sources import archive


def posting(**more):
    return {"order_date": "2023-05-08T00:00:00Z", "trade_date": "2023-05-10T00:00:00Z", "instrument_description": "Some Fund", "broker_tx_type": ["TRADE_ASSET"], "quantity": "10", "later_field": 1} | more


def written(tmp_path, name, version=1, kind="USER", windows=()):
    body = {"envelope": {"format_version": version, "exported_at": "2026-08-01T00:00:00Z", "kind": kind, "new": {}}, "txs": {"windows": list(windows)}}
    (tmp_path / name).write_text(json.dumps(body, indent=1))


def test_postings_of_archives(spark, tmp_path):
    good = {"broker": "IBKR", "period_from": "2023-05-01T00:00:00Z", "period_before": "2023-06-01T00:00:00Z", "postings": [posting(unit_price="41.25", account_type="ACCOUNT_TYPE_EQUITY", correlations=[{"token": "t", "ordinal": "7", "scope": "SCOPE_FILE", "match": ["MATCH_EXACT"]}])]}
    bad = {"broker": "SCHB", "postings": [posting(), posting(broker_tx_type=["AMBIGUOUS", "TRADE", "TRADE"]), posting(broker_tx_type=[], instrument_description="", quantity="x1")]}
    written(tmp_path, "a.json", windows=[good, bad])
    written(tmp_path, "b.json", windows=[])
    archives = archive.read_archives(spark, str(tmp_path))
    rows = archive.postings(archives)
    assert archive.windows(archives).count() == 2 and rows.count() == 4
    first = rows.where("broker = 'IBKR'").first()
    assert (first["order_date"], first["share_count_basis"], first["quantity"], first["unit_price"], first["account_type"], first["account"]) == (date(2023, 5, 8), date(2023, 5, 10), D(10), D("41.25"), "EQUITY", "")
    assert (first["correlations"][0]["scope"], first["correlations"][0]["match"], first["correlations"][0]["ordinal"]) == ("FILE", ["EXACT"], 7)
    faults = archive.posting_faults(rows)
    assert {(r["row"], r["field"], r["fault"]) for r in faults.collect()} == {(1, "broker_tx_type", "AMBIGUOUS is no statement"), (1, "broker_tx_type", "a type is repeated"), (2, "broker_tx_type", "no type"), (2, "instrument_description", "no description"), (2, "quantity", "no quantity")}
    assert [r["broker"] for r in archive.accepted(rows, faults).collect()] == ["IBKR"]


@pytest.mark.parametrize(("version", "kind"), [(0, "USER"), (2, "USER"), (1, "SYSTEM")])
def test_archives_of_another_version_or_kind_raise(spark, tmp_path, version, kind):
    written(tmp_path, "a.json", version, kind)
    with pytest.raises(Exception, match="version|kind"):
        archive.read_archives(spark, str(tmp_path)).collect()

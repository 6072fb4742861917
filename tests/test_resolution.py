"""Resolution of plugins' answers on hand-made keys."""

from __future__ import annotations

import pytest

from ledgerlake.operators import resolution

ASKED = f"key long, currency string, security_type string, stated {resolution.IDS}, proposed {resolution.IDS}"
ANSWERS = f"key long, plugin_id string, precedence int, error string, asset_class string, currency string, mic string, country string, name string, cik string, sic_code string, ids {resolution.IDS}, underlying_ids {resolution.IDS}"
VENUES = [("XNAS", "XNAS", "US"), ("XNGS", "XNAS", "US"), ("XNYS", "XNYS", "US"), ("XLON", "XLON", "GB")]


@pytest.fixture
def solve(spark):
    venues = spark.createDataFrame(VENUES, "mic string, operating_mic string, country_code string")

    def run(asked: list[tuple], answers: list[tuple]):
        return resolution.resolve(spark.createDataFrame(asked, ASKED), spark.createDataFrame(answers, ANSWERS), venues), venues

    return run


def answer(plugin, precedence, error=None, asset_class="STOCK", currency="", mic="", country="", name="", ids=(), key=1):
    return (key, plugin, precedence, error, asset_class, currency, mic, country, name, "", "", list(ids), [])


def test_a_later_answer_that_matches_what_was_stated_wins(solve):
    asked = [(1, "USD", "", [("MIC_TICKER", "XNGS", "A")], None)]
    rows, _ = solve(asked, [answer("a", 1, currency="GBP", mic="XLON", ids=[("MIC_TICKER", "XLON", "A")]), answer("b", 2, currency="usd", mic="XNAS", ids=[("MIC_TICKER", "XNAS", "A")])])
    row = rows.first()
    assert (row["status"], row["plugin_id"], row["decided_by"]) == ("IDENTIFIED", "b", "stated")
    assert sorted(row["confirmed"]) == ["Currency", "Exchange", "MIC_TICKER"]
    assert {o["plugin_id"]: o["outcome"] for o in row["outcomes"]} == {"a": "DISCARDED", "b": "WON"}


def test_an_agreeing_answer_fills_blanks_and_an_inconsistent_one_does_not(solve):
    asked = [(1, "", "", [("ISIN", "", "I1")], None)]
    first, agrees, differs = answer("a", 1, mic="XNAS", ids=[("ISIN", "", "I1")]), answer("b", 2, currency="USD", mic="XNGS", name="Name", ids=[("CUSIP", "", "C")]), answer("c", 3, name="Other", ids=[("ISIN", "", "I2"), ("SEDOL", "", "S")])
    row = solve(asked, [differs, agrees, first])[0].first()
    assert (row["plugin_id"], row["currency"], row["name"], row["mic"]) == ("a", "USD", "Name", "XNAS")
    assert {(i["type"], i["value"]) for i in row["ids"]} == {("ISIN", "I1"), ("CUSIP", "C")}


def test_a_guess_that_confirms_nothing_stated_is_unconfirmed_until_the_currency_agrees(solve):
    proposed = [("MIC_TICKER", "XNAS", "A")]
    asked = [(1, "", "", None, proposed), (2, "USD", "", None, proposed)]
    rows, _ = solve(asked, [answer("a", 1, currency="USD", mic="XNAS", ids=proposed, key=k) for k in (1, 2)])
    assert {r["key"]: r["status"] for r in rows.collect()} == {1: "UNCONFIRMED", 2: "IDENTIFIED"}


def test_why_nothing_was_found(solve):
    asked = [(k, "", "", None, None) for k in (1, 2, 3, 4)]
    answers = [answer("a", 1, "NOT_IDENTIFIED", key=2), answer("a", 1, "NOT_IDENTIFIED", key=3), answer("b", 2, "TIMEOUT", key=3), answer("a", 1, "REFUSED", key=4)]
    assert {r["key"]: r["status"] for r in solve(asked, answers)[0].collect()} == {1: "NO_PLUGIN", 2: "NOT_IDENTIFIED", 3: "TIMEOUT", 4: "ERROR"}


def test_what_became_of_each_proposal(spark, solve):
    asked = [(1, "USD", "", [("ISIN", "", "I1")], None), (2, "", "", None, None)]
    rows, venues = solve(asked, [answer("a", 1, currency="USD", mic="XNAS", ids=[("ISIN", "", "I1"), ("MIC_TICKER", "XNAS", "A")]), answer("a", 1, "NOT_IDENTIFIED", key=2)])
    cases = [
        ((1, "MIC_TICKER", "XNGS", "a"), "CONFIRMED"), ((1, "MIC_TICKER", "XLON", "A"), "CONTRADICTED"), ((1, "MIC_TICKER", "XNAS", "B"), "CONTRADICTED"), ((1, "MIC_TICKER", "", "A"), "CONFIRMED"),
        ((1, "OPENFIGI_TICKER", "XLON", "A"), "CONTRADICTED"), ((1, "SEDOL", None, "S"), "UNTESTED"), ((1, "CURRENCY", "", "usd"), "CONFIRMED"), ((1, "CURRENCY", "", "EUR"), "CONTRADICTED"),
        ((2, "CURRENCY", "", "USD"), "UNUSED"), ((3, "ISIN", "", "I1"), "UNUSED"),
    ]
    proposals = spark.createDataFrame([c for c, _ in cases], "key long, type string, domain string, value string")
    found = {tuple(r)[:4]: r["outcome"] for r in resolution.proposal_outcomes(proposals, rows, venues).collect()}
    assert found == dict(cases)
    assert resolution.proposal_outcomes(proposals.where("false"), rows, venues).count() == 0

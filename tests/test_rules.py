"""Greedy rules, symbols and intervals on small fixtures."""

from __future__ import annotations

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from ledgerlake.functions.symbols import is_isin, occ_padded, parse_option
from ledgerlake.operators import identity, intervals, matching, splits, valuation
from ledgerlake.operators import ledger
from ledgerlake.streaming.events import drain, hourly_totals, read_events, replay_uploads, session_totals

SIDES = "user_id long, broker string, account string, group_id long, instrument_id long, day date, amount decimal(18,6), ordinals array<long>, tokens array<string>"


def day(n: int) -> date:
    return date(2000, 1, 1) + timedelta(n)


def test_transfers_pair_best_first_and_refuse_ties(spark):
    from decimal import Decimal

    side = lambda g, acc, n, q, o, t, broker="B": (1, broker, acc, g, 5, day(n), Decimal(q), o, t)
    rows = [
        side(1, "x", 0, 10, [100], ["Y "]), side(2, "y", 1, -10, [101], []),  # a pointer
        side(3, "x", 0, 20, [200], []), side(4, "y", 2, -20, [203], []), side(5, "z", 1, -20, [240], []),  # the nearest reference
        side(6, "x", 0, 30, [1], []), side(7, "y", 0, -30, [2], []), side(8, "z", 0, -30, [2], []),  # a tie
        side(9, "x", 0, 40, [1], []), side(10, "y", 9, -40, [1], []),  # too late
        side(11, "x", 0, 50, [1], []), side(12, "X", 0, -50, [1], []),  # the same account
        side(15, "x", 0, 70, [1], []), side(16, "x ", 0, -70, [1], []),  # other accounts: only case is folded
        side(17, "x", 0, 80, [1], []), side(18, "y", 0, -80, [2], []), side(19, "z", 0, -80, [2], []), side(20, "w", 0, 80, [9], []),  # a tie leaves its second arrival to another
        side(13, "x", 0, 60, [1], []), side(14, "y", 0, -60, [1], [], "C"),  # another broker, no pointer
    ]
    found = matching.match_transfers(spark.createDataFrame(rows, SIDES)).collect()
    assert {(r["from_group_id"], r["to_group_id"], r["method"]) for r in found} == {(1, 2, "POINTER"), (3, 4, "REFERENCE"), (15, 16, "REFERENCE"), (20, 19, "REFERENCE")}
    assert matching.match_transfers(spark.createDataFrame([], SIDES)).count() == 0


def test_rounds_take_what_a_walk_takes(spark):
    from ledgerlake.operators.rounds import best_first

    rnd = random.Random(9)
    rows = list({(a, b): (a, b, rnd.randrange(4)) for a in range(40) for b in rnd.sample(range(40), 6)}.values())
    for refuse in (False, True):
        used, want = set(), set()
        order = sorted(rows, key=lambda r: (r[2], r[0], r[1]))
        for i, (a, b, e) in enumerate(order):
            if ("l", a) in used or ("r", b) in used:
                continue
            tied = any(r[2] == e and (r[0] == a or r[1] == b) and not {("l", r[0]), ("r", r[1])} & used for r in order[i + 1 :])
            used |= {("l", a), ("r", b)}
            if not (refuse and tied):
                want.add((a, b))
        found = best_first(spark.createDataFrame(rows, "a int, b int, e int"), ["a"], ["b"], ["e"], refuse_ties=refuse)
        assert {(r["a"], r["b"]) for r in found.collect()} == want


def test_matches_are_written_once(spark):
    schema = "user_id long, instrument_id long, from_group_id long, to_group_id long, method string"
    held = spark.createDataFrame([(1, 5, 1, 2, "POINTER")], schema)
    new = spark.createDataFrame([(1, 5, 2, 3, "REFERENCE"), (1, 6, 2, 3, "REFERENCE"), (1, 5, 7, 8, "REFERENCE"), (1, 5, 8, 9, "REFERENCE")], schema)
    once = matching.create_matches(held, new)
    want = {(5, 1, 2), (6, 2, 3), (5, 7, 8)}
    assert {(r["instrument_id"], r["from_group_id"], r["to_group_id"]) for r in once.collect()} == want
    assert {(r["instrument_id"], r["from_group_id"], r["to_group_id"]) for r in matching.create_matches(once, new).collect()} == want


def test_ranges_against_single_days(spark):
    rnd = random.Random(1)
    make = lambda n: [(rnd.randint(0, 5), a := rnd.randint(0, 90), a + rnd.randint(-1, 12)) for _ in range(n)]
    one, two = make(80), make(60)
    frame = lambda rows: spark.createDataFrame([(k, day(a), day(b)) for k, a, b in rows], "k int, from_date date, before_date date")
    spell = lambda rows: {(k, d) for k, a, b in rows for d in range(a, b)}
    read = lambda df: [(r["k"], (r["from_date"] - day(0)).days, (r["before_date"] - day(0)).days) for r in df.collect()]
    union, rest = read(intervals.merge_ranges(frame(one), ["k"])), read(intervals.subtract_ranges(frame(one), frame(two), ["k"]))
    assert spell(union) == spell(one) and spell(rest) == spell(one) - spell(two)
    for found in (union, rest):
        assert sum(b - a for _, a, b in found) == len(spell(found))
    assert all((k, b) not in spell(union) for k, _, b in union)
    chunks = read(intervals.chunk_ranges(frame(one), 5))
    assert spell(chunks) == spell(one) and max(b - a for _, a, b in chunks) == 5


def test_option_symbols_and_isins(spark):
    rows = spark.createDataFrame([("AAPL  250117C00150000",), ("AAPL250117C00150000",), ("AAPL 01/17/25 C 150",), ("AAPL20250117C150",), ("AAPL  251317C00150000",), ("x",), (None,)], "t string")
    found = [r["p"] for r in rows.select(parse_option(F.col("t")).alias("p")).collect()]
    assert all((p["symbol"], p["expiry"], p["put_call"], float(p["strike"])) == ("AAPL", date(2025, 1, 17), "C", 150.0) for p in found[:4])
    assert found[4:] == [None] * 3
    assert rows.select(occ_padded(F.col("t")).alias("p")).collect()[1]["p"] == "AAPL  250117C00150000"
    codes = spark.createDataFrame([("US0378331005",), ("US0378331006",), ("GB0002634946",), ("US037833100",), (None,)], "v string")
    assert [r["ok"] for r in codes.select(is_isin(F.col("v")).alias("ok")).collect()] == [True, False, True, False, False]


def test_value_through_two_rates(spark):
    """Five units at 100 GBP, shown in EUR through the dollar."""
    from decimal import Decimal as D

    d0, d1 = day(0), day(1)
    source = spark.createDataFrame([(1, 7, "x", d0, D(5), D(5))], "scope_id long, instrument_id long, description string, order_date date, quantity decimal(18,6), split_adjusted_quantity decimal(38,12)")
    instruments = spark.createDataFrame([(7, "Seven", "STOCK", "GBP"), (-1, "EURUSD", "FX", "USD"), (-2, "GBPUSD", "FX", "USD")], "instrument_id long, name string, asset_class string, currency string")
    pairs = spark.createDataFrame([(-1, "EUR"), (-2, "GBP")], "instrument_id long, currency string")
    bars = spark.createDataFrame([(7, d0, D(100), D(100)), (-1, d0, D("1.08"), D("1.08")), (-2, d0, D("1.27"), D("1.27"))], "instrument_id long, price_date date, close decimal(18,6), split_adjusted_close decimal(38,12)")
    coverage = spark.createDataFrame([(i, "p", d0, d1) for i in (7, -1, -2)], "instrument_id long, plugin_id string, covered_from date, covered_before date")
    run = lambda cover: valuation.valuation(source, instruments, pairs, bars, cover, str(d0), str(d1), "EUR").collect()
    (row,) = run(coverage)
    assert abs(row["total_value"] - 587.96) < 0.01 and row["unpriced"] == []
    (row,) = run(coverage.where("instrument_id <> -1"))
    assert row["total_value"] == 0.0 and row["unpriced"] == ["Seven"]


def test_a_position_that_thirds_leave_at_zero_closes(spark):
    from decimal import Decimal as D

    rows = [(1, 7, "x", day(2), D(10)), (1, 7, "x", day(3), D(10)), (1, 7, "x", day(9), D("-6.666667"))]
    postings = spark.createDataFrame([(*r, day(2)) for r in rows[:2]] + [(*rows[2], day(9))], "scope_id long, instrument_id long, description string, order_date date, quantity decimal(18,6), share_count_basis date").withColumn("unit_price", F.lit(None).cast("decimal(18,2)"))
    instruments = spark.createDataFrame([(7, None)], "instrument_id long, underlying_id long")
    split = spark.createDataFrame([(7, day(5), 3, 1)], "instrument_id long, ex_date date, split_from int, split_to int")
    adjusted = splits.adjust_postings(postings, split, instruments, "2001-01-01").withColumn("split_adjusted_quantity", F.when(F.col("quantity") < 0, F.lit("-6.666666666667").cast("decimal(38,12)")).otherwise(F.col("split_adjusted_quantity")))
    days = [r["day"] for r in valuation.daily_positions(adjusted, str(day(0)), str(day(20))).orderBy("day").collect()]
    assert days == [day(n) for n in range(2, 9)]


def test_arbitration_prefers_the_hint_and_fills_blanks(spark):
    rows = [("k", "a", 1, False, "STOCK", "A", None), ("k", "b", 2, True, "ETF", None, "USD"), ("k", "c", 3, False, "ETF", "C", "EUR")]
    found = identity.arbitrate(spark.createDataFrame(rows, "key string, plugin_id string, precedence int, matches_hint boolean, asset_class string, name string, currency string"), ["asset_class", "name", "currency"]).first()
    assert (found["plugin_id"], found["asset_class"], found["name"], found["currency"]) == ("b", "ETF", "C", "USD")


def test_a_stream_gives_what_a_batch_gives(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = hourly_totals(read_events(spark, f"{tmp_path}/in", events.schema), "1 day")
    drain(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {tuple(r) for r in hourly_totals(events).collect()}
    assert got and got <= want


def test_scaling_is_exact_and_rounds_once(spark):
    from decimal import ROUND_HALF_UP, Decimal, localcontext

    from ledgerlake.functions.decimals import scaled, whole_ratio

    rnd = random.Random(7)
    ratios = [("1", "1.5"), ("0.1", "1"), ("3", "1"), ("1.25", "0.333333"), ("7", "7"), ("999999", "0.000001")]
    rows = [(Decimal(rnd.randint(-(10**9), 10**9)).scaleb(-6), Decimal(a), Decimal(b)) for a, b in ratios for _ in range(20)] + [(Decimal(0), Decimal(1), Decimal(3)), (Decimal("0.000001"), Decimal(2), Decimal(1))]
    df = spark.createDataFrame(rows, "v decimal(18,6), a decimal(18,6), b decimal(18,6)")
    down, up = whole_ratio(F.col("a"), F.col("b"))
    with localcontext() as exact:
        exact.prec = 80
        for r in df.select("v", "a", "b", scaled(F.col("v"), up, down).alias("got")).collect():
            assert r["got"] == (r["v"] * r["b"] / r["a"]).quantize(Decimal("1e-12"), ROUND_HALF_UP), r


def test_sessions_of_a_stream_and_late_events(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    drain(session_totals(read_events(spark, f"{tmp_path}/in", events.schema), "12 hours", "1 day"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {tuple(r) for r in session_totals(events, "12 hours").collect()}
    assert got and got <= want
    late = events.limit(1).withColumn("ts", F.lit("1971-01-01").cast("timestamp_ntz"))
    late.write.mode("append").parquet(f"{tmp_path}/in")
    drain(session_totals(read_events(spark, f"{tmp_path}/in", events.schema), "12 hours", "1 day"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()} <= want


def test_a_replayed_upload_changes_nothing(spark, tmp_path):
    schema = "tx_id long, user_id long, broker string, order_date date, account_type string, group_id long, quantity double"
    ledger_rows = [(1, 7, "B", day(1), "USER", 1, 1.0), (2, 7, "B", day(1), "IMBALANCE", 1, -1.0), (3, 7, "B", day(9), "USER", 3, 5.0), (4, 8, "B", day(1), "USER", 4, 1.0)]
    state = {"now": spark.createDataFrame(ledger_rows, schema)}
    spark.createDataFrame([(10, 7, "B", day(2), "USER", 10, 2.0)], schema).write.parquet(f"{tmp_path}/in")

    def apply(batch, number):
        new = batch.sparkSession.createDataFrame(batch.collect(), schema)
        for _ in range(2):
            state["now"] = ledger.replace_by_period(state["now"], new, 7, "B", str(day(0)), str(day(5)))

    replay_uploads(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), apply, f"{tmp_path}/state")
    assert {r["tx_id"] for r in state["now"].collect()} == {3, 4, 10} and state["now"].count() == 3


def test_a_small_price_and_stated_places(spark):
    from decimal import Decimal as D

    from ledgerlake.functions.decimals import half_unit, stated

    texts = [("0.004",), ("10.500",), ("-3",), (" 7.25 ",), (".5",), ("1e3",), ("1.2.3",), (".",), ("",), (None,)]
    got = [(r["p"]["value"], r["p"]["scale"], r["h"]) if r["p"] else None for r in spark.createDataFrame(texts, "t string").select(stated(F.col("t")).alias("p")).select("p", half_unit(F.col("p.scale")).alias("h")).collect()]
    assert got == [(D("0.004"), 3, D("0.0005")), (D("10.5"), 3, D("0.0005")), (D(-3), 0, D("0.005")), (D("7.25"), 2, D("0.005")), (D("0.5"), 1, D("0.005")), None, None, None, None, None]
    schema = "tx_id long, group_id long, instrument_id long, description string, tx_type string, quantity decimal(18,6), unit_price decimal(18,6), settlement_currency string, account_type string"
    rows = [(1, 1, 5, "x", "TRADE_ASSET", D(1000), D("0.004"), "USD", "USER"), (2, 1, None, "USD", "TRADE_CASH", D("-3.99"), None, None, "USER")]
    instruments = spark.createDataFrame([(5, "STOCK", "USD")], "instrument_id long, asset_class string, currency string")
    found = {r["commodity"]: r for r in ledger.group_residuals(ledger.with_weights(spark.createDataFrame(rows, schema), instruments).withColumn("unit_price_scale", F.lit(3))).collect()}
    assert found["cur:USD"]["residual"] == D("4") and found["cur:USD"]["rounding"] == D("0.5")


def test_merges_keep_names_in_force(spark):
    none = None
    schema = "instrument_id long, identifier_type string, domain string, value string, canonical boolean, valid_from date, valid_before date"
    rows = [
        (1, "T", none, "A", True, none, day(10)), (1, "T", none, "A", True, day(20), none),  # given up and taken again
        (2, "T", "", "A", True, day(5), day(12)), (2, "T", "", "A", True, day(12), day(20)), (2, "T", none, "B", True, none, none),
        (3, "T", none, "B", False, day(1), none), (3, "T", none, "C", False, day(1), none),
    ]
    mapping = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "instrument_id long, survivor_id long")
    names = identity.merged_names(spark.createDataFrame(rows, schema), mapping).collect()
    assert {(r["instrument_id"], r["value"], r["valid_from"], r["valid_before"]) for r in names} == {(1, "A", none, day(10)), (1, "A", day(20), none), (1, "A", day(12), day(20)), (1, "B", none, none), (1, "C", day(1), none)}
    matches = spark.createDataFrame([(9, 1, 2, 2), (9, 1, 3, 3), (9, 5, 6, 2)], "user_id long, from_group_id long, to_group_id long, instrument_id long")
    moved, conflicts = identity.merged_matches(matches, mapping)
    assert {r["instrument_id"] for r in moved.collect()} == {1} and {r["to_group_id"] for r in conflicts.collect()} == {2, 3}


def test_options_are_restated_from_the_name_in_force_or_not_at_all(spark):
    from decimal import Decimal as D

    pending = spark.createDataFrame([(i, day(n), D(a), D(b)) for i, n, a, b in [(1, 30, "1", "2"), (2, 30, "1", "2"), (3, 30, "1", "2"), (4, 30, "1", "2"), (4, 40, "2", "3"), (5, 30, "0.5", "1"), (5, 60, "1", "3"), (6, 30, "1", "2"), (7, 30, "2", "1")]], "instrument_id long, ex_date date, split_from decimal(18,6), split_to decimal(18,6)")
    instruments = spark.createDataFrame([(i, 90, D(400 if i == 1 else 30), day(300), "C") for i in (1, 2, 3, 4, 5, 7)] + [(6, 90, None, day(300), "C")], "instrument_id long, underlying_id long, strike decimal(18,6), expiry date, put_call string")
    name = lambda i, value, start=None, end=None: (i, "OCC", value, start, end)
    names = [name(1, "OLD001027C00800000", None, day(9)), name(1, "NEW001027C00400000", day(9)), name(3, "NOTAVALIDOCC"), *(name(i, "ABC001027C00030000") for i in (4, 5, 6, 7)), (2, "MIC_TICKER", "X", None, None)]
    identifiers = spark.createDataFrame(names, "instrument_id long, identifier_type string, value string, valid_from date, valid_before date")
    found = splits.restate_options(pending, instruments, identifiers).orderBy("instrument_id", "valid_from").collect()
    assert [(r["instrument_id"], r["symbol"], float(r["strike"]), r["valid_before"]) for r in found] == [(1, "NEW001027C00200000", 200.0, None), (5, "ABC001027C00015000", 15.0, day(60)), (5, "ABC001027C00005000", 5.0, None)]
    faults = {(r["instrument_id"], r["ex_date"], r["event_type"], tuple(r["options"])) for r in splits.option_faults(pending, instruments, identifiers).collect()}
    assert faults == {(3, day(30), "UNREADABLE_NAME", (3,)), (90, day(40), "NON_WHOLE_SPLIT", (4,)), (90, day(30), "REVERSE_SPLIT", (7,))}
    odd = identifiers.withColumn("value", F.when(F.col("instrument_id") == 1, "NEW001027C00400000").otherwise(F.col("value")))
    huge = instruments.withColumn("strike", F.when(F.col("instrument_id") == 1, F.lit("900000").cast("decimal(18,6)")).otherwise(F.col("strike")))
    assert {r["event_type"] for r in splits.option_faults(pending.where("instrument_id = 1"), huge, odd).collect()} == {"NO_SUCH_SYMBOL"}


def test_a_long_chain_and_large_sets_need_few_rounds(spark, monkeypatch):
    from ledgerlake.operators import rounds

    counted = []
    settle = rounds.settled
    monkeypatch.setattr(rounds, "settled", lambda df: counted.append(1) or settle(df))
    chain = spark.range(20_000).selectExpr("(id + 1) div 2 AS a", "id div 2 AS b", "id AS e", "id % 1 AS user")  # each pair competes with the next
    want = {(i, i) for i in range(10_000)}
    found = rounds.best_first(chain, ["a"], ["b"], ["e"], within=["user"])
    assert {(r["a"], r["b"]) for r in found.collect()} == want and len(counted) < 10
    counted.clear()
    found = rounds.best_first(chain, ["a"], ["b"], ["e"])  # without a known bound: rounds, then components
    assert {(r["a"], r["b"]) for r in found.collect()} == want and len(counted) < 60


def test_walks_rounds_and_components_agree(spark, monkeypatch):
    from ledgerlake.operators import rounds

    rnd = random.Random(4)
    rows = list({(u, a, b): (u, a, b, rnd.randrange(5)) for u in range(3) for a in range(40) for b in rnd.sample(range(40), 4 if u else 1)}.values())
    df = spark.createDataFrame([(u, u * 100 + a, u * 100 + b, e) for u, a, b, e in rows], "u int, a int, b int, e int")
    sets = spark.createDataFrame(list({(u, a % 17, u * 100 + b) for u, a, b, _ in rows}), "u int, s int, i int")
    results = set()
    for most in (1_000_000, 100, 1):
        monkeypatch.setattr(rounds, "WALK_ROWS", most)
        for refuse in (False, True):
            pairs = frozenset(tuple(r) for r in rounds.best_first(df, ["a"], ["b"], ["e"], refuse, within=["u"]).collect())
            results.add((refuse, pairs))
        results.add(("sets", frozenset(tuple(r) for r in rounds.first_come(sets, ["u", "s"], "i", within=["u"]).collect())))
    assert len(results) == 3 and all(rows for _, rows in results)


def test_spans_of_a_hot_instrument_meet_by_month(spark):
    n = 30_000
    spans = spark.range(n).selectExpr("7L AS instrument_id", "date_add(DATE '1950-01-01', cast(id AS int)) AS basis_from", "date_add(DATE '1950-01-01', cast(id + 1 AS int)) AS basis_before", "cast(id + 2 AS decimal(18,0)) AS num", "cast(1 AS decimal(18,0)) AS den")
    old = spark.sql("SELECT 7L AS instrument_id, DATE '0001-01-01' AS basis_from, DATE '1950-01-01' AS basis_before, cast(99999999 AS decimal(18,0)) AS num, cast(1 AS decimal(18,0)) AS den")
    rows = spark.range(-5, n + 5).selectExpr("id", "7L AS instrument_id", "date_add(DATE '1950-01-01', cast(id AS int)) AS basis")
    met = intervals.join_spans(rows, spans.union(old), "instrument_id", "basis", "basis_from", "basis_before", ["num", "den"])
    assert {(r["id"], int(r["num"])) for r in splits.with_factor(rows, spans.union(old), "basis").collect()} == {(i, 99999999 if i < 0 else i + 2 if i < n else 1) for i in range(-5, n + 5)}
    assert met.columns == [*rows.columns, "num", "den"] and "CartesianProduct" not in met._jdf.queryExecution().toString()
    half = lambda odd: spark.range(n).selectExpr("1 AS k", f"date_add(DATE '1950-01-01', cast(id * 4 + {odd} AS int)) AS from_date", f"date_add(DATE '1950-01-01', cast(id * 4 + {odd + 2} AS int)) AS before_date")
    left = intervals.subtract_ranges(half(0), half(1), ["k"])
    assert left.count() == n and left.where("datediff(before_date, from_date) <> 1").count() == 0 and "Join" not in left._jdf.queryExecution().toString()

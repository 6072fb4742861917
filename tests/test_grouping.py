"""The grouping rules against a plain walk over small tables."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import date, timedelta
from decimal import Decimal as D
from itertools import combinations

import pytest

from ledgerlake.functions.txtypes import PARENTS, lineage
from ledgerlake.operators import grouping

POSTINGS = "tx_id long, user_id long, broker string, account string, order_date date, tx_types array<string>, quantity decimal(18,6), unit_price decimal(18,6), settlement_amount decimal(18,2)"
EVIDENCE = "tx_id long, position int, label string, token string, ordinal long, ordinal_span long, scope string, job_id long, matches array<string>"


def must(types, kind):
    return bool(types) and all(kind in lineage(t) for t in types)


def may(types, kind):
    return any(kind in lineage(t) or t in lineage(kind) for t in types)


def ancestor(types):
    return next(k for k in lineage(types[0]) if all(k in lineage(t) for t in types))


class Walk:
    """Every rule as a walk over sorted candidates, one posting table and one user at a time."""

    def __init__(self, postings, evidence):
        self.ps = {p["tx_id"]: p for p in postings}
        self.said = defaultdict(list)
        for e in sorted(evidence, key=lambda e: (e["tx_id"], e["position"])):
            self.said[e["tx_id"]].append(e)
        self.up = {i: i for i in self.ps}
        self.claimed, self.rule = {}, {}

    def top(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = sorted((self.top(a), self.top(b)))
        self.up[b] = a

    def claim(self, rule, legs):
        if len(legs) < 2 or any(i in self.claimed for i, _ in legs):
            return
        for i, kind in legs:
            self.claimed[i], self.rule[i] = kind, rule
            self.join(legs[0][0], i)

    def money(self, i):
        return not may(self.ps[i]["tx_types"], "TRADE_ASSET")

    def bucket(self, i):
        p = self.ps[i]
        return p["user_id"], p["broker"], p["account"], p["order_date"]

    def own(self, i):
        return ancestor(self.ps[i]["tx_types"])

    def ordinals(self, i):
        return [e for e in self.said[i] if "ORDINAL" in e["matches"] and e["ordinal"] is not None]

    def gaps(self, a, b):
        return [y["ordinal"] - x["ordinal"] for x in self.ordinals(a) for y in self.ordinals(b) if x["label"] == y["label"]]

    def key(self, i, e):
        p = self.ps[i]
        within = {"FILE": ("f", e["job_id"]), "ACCOUNT": ("a", p["broker"], p["account"]), "BROKER": ("b", p["broker"])}[e["scope"]]
        return e["label"], e["token"], e["scope"], str(within), p["user_id"]

    def charge(self, i):
        return self.money(i) and self.ps[i]["quantity"] != 0 and must(self.ps[i]["tx_types"], "EXPENSE")

    def run(self):
        free = lambda: [i for i in sorted(self.ps) if i not in self.claimed]
        q = {i: p["quantity"] for i, p in self.ps.items()}
        types = {i: p["tx_types"] for i, p in self.ps.items()}
        sets = defaultdict(set)
        for i in free():
            for e in self.said[i]:
                if "EXACT" in e["matches"]:
                    sets[self.key(i, e)].add(i)
        for k in sorted(sets):
            self.claim("exact", [(i, self.own(i)) for i in sorted(sets[k])])

        far = lambda a, b: min(map(abs, self.gaps(a, b)), default=10**30)
        for rule, buys in (("disposal", False), ("acquisition", True)):
            found = []
            for a in free():
                p = self.ps[a]
                if self.money(a) or p["settlement_amount"] is None or not q[a] or (q[a] > 0) != buys:
                    continue
                for c in free():
                    if not self.money(c) or not may(types[c], "TRADE_CASH") or not q[c] or (q[c] > 0) == buys or self.bucket(a) != self.bucket(c):
                        continue
                    stated, paid = abs(p["settlement_amount"]), abs(q[c])
                    worth = abs(q[a] * p["unit_price"]) if p["unit_price"] is not None else 0
                    if (stated - paid > -D("0.005") if buys else abs(stated - paid) < D("0.005")) and (not worth or abs(paid - worth) / worth <= D("0.0075")):
                        found.append((far(a, c), a, c))
            for _, a, c in sorted(found):
                self.claim(rule, [(a, "TRADE_ASSET"), (c, "TRADE_CASH")])
        cash = [i for i in free() if self.money(i) and must(types[i], "TRADE_CASH") and q[i]]
        for _, a, c in sorted((far(a, c), a, c) for a in cash for c in cash if q[a] < 0 and q[a] == -q[c] and self.bucket(a) == self.bucket(c)):
            self.claim("cash_trade", [(a, "TRADE_CASH"), (c, "TRADE_CASH")])

        first = lambda i: (not self.ordinals(i), self.ordinals(i)[0]["ordinal"] if self.ordinals(i) else 0, i)
        rows = [i for i in free() if self.money(i) and q[i]]
        openers = [i for i in rows if q[i] > 0 and must(types[i], "TRANSFER")]
        steps = [i for i in rows if i not in openers and (may(types[i], "TRADE_CASH") or may(types[i], "TRANSFER"))]
        for o in sorted(openers, key=first):
            span = next((e["ordinal_span"] for e in self.ordinals(o) if e["ordinal_span"] is not None), None)
            legs = [(o, "TRANSFER")]
            for spends in (True, False):
                near = [m for m in steps if span is not None and m not in self.claimed and (q[m] < 0) == spends and self.bucket(m)[:3] == self.bucket(o)[:3] and self.gaps(o, m) and 0 < self.gaps(o, m)[0] <= span and abs(abs(q[m]) - q[o]) < D("0.005")]
                if near:
                    m = min(near, key=first)
                    legs.append((m, "TRANSFER" if may(types[m], "TRANSFER") else self.own(m)))
            self.claim("deposit_run", legs)

        holders = defaultdict(list)
        for i in sorted(self.ps):
            for e in self.said[i]:
                if "EXACT" in e["matches"]:
                    holders[self.key(i, e)].append(i)
        for i in free():
            for e in self.said[i]:
                named = [h for h in holders[self.key(i, e)] if h != i] if "ATTACHES" in e["matches"] else []
                if named and len({self.top(h) for h in named}) == 1:
                    self.join(min(named), i)
                    self.claimed[i], self.rule[i] = self.own(i), "attaches"
                    break

        events, found = defaultdict(list), []
        for i in self.ps:
            events[self.top(i)].append(i)
        for a in sorted(self.ps):
            if self.money(a) or self.ps[a]["settlement_amount"] is None or q[a] <= 0:
                continue
            gap = abs(self.ps[a]["settlement_amount"]) - sum(abs(q[m]) for m in events[self.top(a)] if m != a and (self.charge(m) or self.money(m) and may(types[m], "TRADE_CASH")))
            near = [c for c in free() if self.charge(c) and self.bucket(c) == self.bucket(a)]
            sums = (s for n in (1, 2, 3) for s in combinations(near, n) if abs(gap - sum(abs(q[c]) for c in s)) < D("0.005"))
            if gap > 0 and (best := next(sums, None)):
                found.append((len(best), a, best))
        for _, a, best in sorted(found):
            if not any(c in self.claimed for c in best):
                for c in best:
                    self.claimed[c], self.rule[c] = self.own(c), "charge"
                    self.join(a, c)
        return {(i, self.top(i), self.rule.get(i), self.claimed.get(i) or self.own(i)) for i in self.ps}


def tables(seed, n=160):
    """Few accounts, days, amounts and references, so that rules and postings compete."""
    rnd = random.Random(seed)
    postings, evidence = [], []
    for i in range(1, n + 1):
        types = rnd.choice((["TRADE_ASSET"], ["TRADE_ASSET"], ["TRADE_CASH"], ["TRADE_CASH"], ["TRADE_CASH", "TRANSFER_INTERNAL"], ["TRANSFER_EXTERNAL"], ["TRANSFER"], ["TRANSACTION_COST"], ["HOLDING_COST"], ["DIVIDEND", "INTEREST"], ["TRADE"]))
        asset = may(types, "TRADE_ASSET")
        amount = D(rnd.choice(("100", "100", "50", "99.75", "0.25", "0.5", "0.75", "7.25", "100.004", "0"))) * rnd.choice((1, -1))
        quantity = D(rnd.choice((-10, 10, 5, -5, 0))) if asset else amount
        price = rnd.choice((None, D("10"), D("10.02"), D("20"))) if asset else None
        settled = rnd.choice((None, D("100"), D("100.25"), D("100.50"), D("50.75"), D("101.25"))) if asset else None
        postings.append((i, 1 + i % 2, rnd.choice("AB"), rnd.choice("xy"), date(2000, 1, 1) + timedelta(rnd.randrange(2)), types, quantity, price, settled))
        said = []
        if rnd.random() < 0.7:
            said.append(("ref", "", rnd.randrange(60), rnd.choice((None, 8, 20)), "BROKER", ["ORDINAL"]))
        if rnd.random() < 0.2:
            said.append((rnd.choice(("ref", "id")), "", rnd.randrange(60), None, "BROKER", ["ORDINAL"]))
        for kind, share in (("EXACT", 0.12), ("EXACT", 0.04), ("ATTACHES", 0.2), ("ATTACHES", 0.1), ("ACCOUNT", 0.1)):
            if rnd.random() < share:
                said.append(("id", f"t{rnd.randrange(12)}", None, None, rnd.choice(("FILE", "ACCOUNT", "ACCOUNT", "BROKER")), [kind]))
        evidence += [(i, k, label, token, ordinal, span, scope, 1 + i % 2, matches) for k, (label, token, ordinal, span, scope, matches) in enumerate(said)]
    return postings, evidence


def named(rows, schema):
    return [dict(zip([c.split()[0] for c in schema.split(", ")], r)) for r in rows]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_rules_against_a_walk(spark, seed):
    postings, evidence = tables(seed)
    want = Walk(named(postings, POSTINGS), named(evidence, EVIDENCE)).run()
    found = grouping.partition(spark.createDataFrame(postings, POSTINGS), spark.createDataFrame(evidence, EVIDENCE))
    assert {tuple(r) for r in found.select("tx_id", "event_id", "rule", "resolved").collect()} == want
    assert len({rule for _, _, rule, _ in want}) >= 6


def test_no_postings(spark):
    assert grouping.partition(spark.createDataFrame([], POSTINGS), spark.createDataFrame([], EVIDENCE)).count() == 0


def test_neighbourhood_against_steps(spark):
    postings, evidence = tables(5, 60)
    walk = Walk(named(postings, POSTINGS), named(evidence, EVIDENCE))
    reach = defaultdict(set)
    for a in walk.ps:
        for b in walk.ps:
            p, r = walk.ps[a], walk.ps[b]
            if walk.bucket(a) == walk.bucket(b):
                reach[a].add(b)
            for e in walk.said[a]:
                for f in walk.said[b]:
                    same = p["user_id"] == r["user_id"] and p["broker"] == r["broker"] and e["label"] == f["label"]
                    if {"EXACT", "ATTACHES"} & set(e["matches"]) and "EXACT" in f["matches"] and same and e["token"] == f["token"] and (e["scope"] != "ACCOUNT" or p["account"] == r["account"]):
                        reach[a].add(b)
                    spans = "ORDINAL" in e["matches"] and e["ordinal_span"] is not None and "ORDINAL" in f["matches"]
                    if spans and same and p["account"] == r["account"] and abs(f["ordinal"] - e["ordinal"]) <= e["ordinal_span"]:
                        reach[a].add(b)
    held = front = {1}
    while front:
        front = set().union(*(reach[a] for a in front)) - held
        held = held | front
    ps, es = spark.createDataFrame(postings, POSTINGS), spark.createDataFrame(evidence, EVIDENCE)
    assert {r["tx_id"] for r in grouping.neighbourhood(ps.where("tx_id = 1"), ps, es).collect()} == held


def test_divergence_and_types(spark):
    stored = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (5, 4)], "tx_id long, event_id long")
    derived = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)], "tx_id long, event_id long")
    assert grouping.divergence(stored, derived).first().asDict() == {"n_derived": 3, "n_stored": 3, "agreed": 1, "joined": 1, "split": 1}
    assert all(PARENTS[k] is None or k in lineage(k) for k in PARENTS)

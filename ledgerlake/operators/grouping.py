"""Grouping: which postings make up one economic event.

Rules claim postings in order of precedence; a claim holds wholly or not at all and is never undone. Each rule
finds its candidates by equality joins and takes them in rounds (``rounds``) that give what a walk over sorted
candidates gives. Amounts are decimals throughout.

``postings``: tx_id, user_id, broker, account, order_date, tx_types (array), quantity, unit_price,
settlement_amount. ``correlations``: tx_id, position, label, token, ordinal, ordinal_span, scope, job_id,
matches (array of EXACT, ORDINAL, ATTACHES, ACCOUNT).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.txtypes import may_be, must_be, resolve
from ledgerlake.operators.ledger import group_residuals, residual_legs
from ledgerlake.operators.rounds import best_first, components, first_come, settled, taken_in_turn

#: Money that differs by less is the same amount; a cash leg may be so far from quantity times price, as a share.
MONEY, BAND = "0.005", "0.0075"
MAX_CHARGES = 3
BUCKET = ["user_id", "broker", "account", "order_date"]
#: Ranks behind every pair with references to compare.
NO_ORDINAL = (1 << 63) - 1


def _is_money(types: Column) -> Column:
    """A posting is money if it can't be a trade's asset."""
    return ~may_be(types, "TRADE_ASSET")


def _is_charge(rows: str = "") -> Column:
    types = F.col(f"{rows}tx_types")
    return _is_money(types) & (F.col(f"{rows}quantity") != 0) & must_be(types, "EXPENSE")


def _near(a: Column, b: Column) -> Column:
    return F.abs(a - b) < F.lit(MONEY).cast("decimal(4,3)")


def _cents(amount: Column) -> Column:
    return F.floor(amount * 100).cast("long")


def _around(cents: Column) -> Column:
    return F.explode(F.sequence(cents - 1, cents + 1))


def _declared(kind: str) -> Column:
    return F.array_contains("matches", kind)


def with_ordinals(postings: DataFrame, correlations: DataFrame) -> DataFrame:
    """Postings with ordinals: array of (position, label, ordinal, span) that their source declares comparable, in its order."""
    held = correlations.where(_declared("ORDINAL") & F.col("ordinal").isNotNull())
    held = held.groupBy("tx_id").agg(F.array_sort(F.collect_list(F.struct("position", "label", "ordinal", F.col("ordinal_span").alias("span")))).alias("ordinals"))
    return postings.join(held, "tx_id", "left")


def _gaps(a: str, b: str) -> Column:
    """ordinal of b less that of a, for each two of one label, in order."""
    return F.flatten(F.transform(a, lambda x: F.transform(F.filter(b, lambda y: y["label"] == x["label"]), lambda y: y["ordinal"] - x["ordinal"])))


def _within(scope: Column) -> Column:
    """The set of postings across which a token means anything."""
    account = F.concat_ws("\u0001", F.lit("a"), "broker", "account")
    return F.when(scope == "FILE", F.concat(F.lit("f"), F.col("job_id").cast("string"))).when(scope == "ACCOUNT", account).otherwise(F.concat(F.lit("b"), F.col("broker")))


TOKEN = ["label", "token", "scope", "within", "user_id"]


def _tokens(postings: DataFrame, correlations: DataFrame, kind: str) -> DataFrame:
    rows = correlations.where(_declared(kind)).select("tx_id", "position", "label", "token", "scope", "job_id")
    return rows.join(postings.select("tx_id", "user_id", "broker", "account"), "tx_id").withColumn("within", _within(F.col("scope"))).select("tx_id", "position", *TOKEN)


# ---------------------------------------------------------------- rules: each takes free postings and returns (tx_id, anchor, resolved); null keeps what the posting declares


def exact_claims(free: DataFrame, correlations: DataFrame) -> DataFrame:
    """Postings whose source gave them one token; tokens in order, and a set of which a posting is gone is left."""
    held = _tokens(free, correlations, "EXACT").select("tx_id", *TOKEN).distinct()
    many = held.groupBy(*TOKEN).agg(F.count("*").alias("n"), F.min("tx_id").alias("anchor")).where("n > 1")
    taken = first_come(held.join(many.select(*TOKEN), TOKEN, "left_semi"), TOKEN, "tx_id", within=["user_id"])
    return taken.join(many, TOKEN).select("tx_id", "anchor", F.lit(None).cast("string").alias("resolved"))


def exact_groups(postings: DataFrame, correlations: DataFrame) -> DataFrame:
    """Rows (tx_id, event_id) of ``exact_claims`` alone; event_id is the smallest tx_id."""
    return exact_claims(postings, correlations).select("tx_id", F.col("anchor").alias("event_id"))


def trade_candidates(free: DataFrame, acquiring: bool) -> DataFrame:
    """Pairs (BUCKET, asset, cash, distance): a sale with cash of its settlement, a purchase with cash of no more, by account and day.

    Where a price is stated cash must be within BAND of quantity times price; candidates then meet by
    amounts' logarithms, else a sale's by its cents, and a purchase without a price meets its day's cash.
    """
    money, sign = _is_money(F.col("tx_types")), F.col("quantity") > 0
    worth = F.abs(F.col("quantity") * F.col("unit_price").cast("decimal(18,6)"))
    worth = F.when(worth != 0, worth)
    assets = free.where(~money & F.col("settlement_amount").isNotNull() & (F.col("quantity") != 0) & (sign == F.lit(acquiring)))
    assets = assets.select(*BUCKET, F.col("tx_id").alias("asset"), F.abs("settlement_amount").alias("stated"), worth.alias("worth"), F.col("ordinals").alias("asset_ordinals"))
    cash = free.where(money & may_be(F.col("tx_types"), "TRADE_CASH") & (F.col("quantity") != 0) & (sign != F.lit(acquiring)))
    cash = cash.select(*BUCKET, F.col("tx_id").alias("cash"), F.abs("quantity").alias("paid"), F.col("ordinals").alias("cash_ordinals"))
    consistent = F.col("worth").isNull() | (F.abs(F.col("paid") - F.col("worth")) * 10_000 <= F.col("worth") * 75)
    if acquiring:
        log = lambda x: F.floor(F.ln(x.cast("double")) * 100).cast("long")
        priced = assets.where("worth is not null").withColumn("key", F.explode(F.sequence(log(F.col("worth")) - 1, log(F.col("worth")) + 1)))
        met = priced.join(cash.withColumn("key", log(F.col("paid"))), [*BUCKET, "key"]).drop("key")
        met = met.unionByName(assets.where("worth is null").join(cash, BUCKET).select(*met.columns))
        fits = F.col("stated") - F.col("paid") > -F.lit(MONEY).cast("decimal(4,3)")
    else:
        met = assets.withColumn("key", _around(_cents(F.col("stated")))).join(cash.withColumn("key", _cents(F.col("paid"))), [*BUCKET, "key"]).drop("key")
        fits = _near(F.col("stated"), F.col("paid"))
    distance = F.array_min(F.transform(_gaps("asset_ordinals", "cash_ordinals"), F.abs))
    return met.where(fits & consistent).select(*BUCKET, "asset", "cash", F.coalesce(distance, F.lit(NO_ORDINAL)).alias("distance"))


def cash_candidates(free: DataFrame) -> DataFrame:
    """Pairs (BUCKET, asset, cash, distance) of exactly opposite cash, money out first, both a trade's cash under every reading."""
    rows = free.where(_is_money(F.col("tx_types")) & must_be(F.col("tx_types"), "TRADE_CASH"))
    side = lambda sign, name: rows.where(f"quantity {sign} 0").select(*BUCKET, F.abs("quantity").alias("size"), F.col("tx_id").alias(name), F.col("ordinals").alias(f"{name}_ordinals"))
    met = side("<", "asset").join(side(">", "cash"), [*BUCKET, "size"])
    distance = F.array_min(F.transform(_gaps("asset_ordinals", "cash_ordinals"), F.abs))
    return met.select(*BUCKET, "asset", "cash", F.coalesce(distance, F.lit(NO_ORDINAL)).alias("distance"))


def _paired(candidates: DataFrame) -> DataFrame:
    """Nearest references first, then the smallest ids."""
    return best_first(candidates, ["asset"], ["cash"], ["distance"], within=BUCKET)


def _pair_claims(pairs: DataFrame, first: str) -> DataFrame:
    legs = F.array(F.struct(F.col("asset").alias("tx_id"), F.lit(first).alias("resolved")), F.struct(F.col("cash").alias("tx_id"), F.lit("TRADE_CASH").alias("resolved")))
    return pairs.select(F.col("asset").alias("anchor"), F.explode(legs).alias("leg")).select("leg.tx_id", "anchor", "leg.resolved")


def trade_pairs(postings: DataFrame, correlations: DataFrame) -> DataFrame:
    """Rows (asset_tx_id, cash_tx_id, rule): disposals, then acquisitions, then opposite cash, each from what is left."""
    free, out = settled(with_ordinals(postings, correlations)), None
    for rule, make in (("disposal", lambda f: trade_candidates(f, False)), ("acquisition", lambda f: trade_candidates(f, True)), ("cash_trade", cash_candidates)):
        pairs = settled(_paired(make(free)))
        free = free.join(pairs.select(F.explode(F.array("asset", "cash")).alias("tx_id")), "tx_id", "left_anti").select(*free.columns)
        found = pairs.select(F.col("asset").alias("asset_tx_id"), F.col("cash").alias("cash_tx_id"), F.lit(rule).alias("rule"))
        out = found if out is None else out.unionByName(found)
    return out


def deposit_runs(free: DataFrame) -> DataFrame:
    """Rows (opener_tx_id, spend_tx_id, arrival_tx_id) of ``free`` (with ordinals): money that arrives as a transfer, is spent, and arrives again.

    An opener takes the next spending and the next arrival of its amount in its account within its span.
    Openers go by reference, so an earlier run takes the rows it needs.
    """
    types = F.col("tx_types")
    rows = free.where(_is_money(types) & (F.col("quantity") != 0))
    opens = (F.col("quantity") > 0) & must_be(types, "TRANSFER")
    place = lambda name: F.struct(F.when(F.size("ordinals") > 0, 0).otherwise(1).alias("none"), F.get("ordinals", F.lit(0))["ordinal"].alias("ordinal"), F.col("tx_id").alias("id")).alias(name)
    keys = ["user_id", "broker", "account"]
    span = F.get(F.filter("ordinals", lambda x: x["span"].isNotNull()), F.lit(0))["span"]
    openers = rows.where(opens).select(*keys, place("opener"), F.col("quantity").alias("opened"), F.col("ordinals").alias("opener_ordinals"), span.alias("span"), _around(_cents(F.col("quantity"))).alias("key"))
    steps = rows.where(~opens & (may_be(types, "TRADE_CASH") | may_be(types, "TRANSFER")))
    steps = steps.select(*keys, place("step"), F.abs("quantity").alias("size"), (F.col("quantity") < 0).alias("spending"), F.col("ordinals").alias("step_ordinals"), _cents(F.abs("quantity")).alias("key"))
    gap = F.get(_gaps("opener_ordinals", "step_ordinals"), F.lit(0))
    met = openers.join(steps, [*keys, "key"]).where(_near(F.col("size"), F.col("opened")) & (gap > 0) & (gap <= F.col("span")))
    wanted = met.select(*keys, "opener", "step", "spending")
    chosen = taken_in_turn(wanted, ["opener"], ["step"], ["spending"], keys)
    side = lambda spending: F.max(F.when(F.col("spending") == F.lit(spending), F.col("step.id")))
    return chosen.groupBy(F.col("opener.id").alias("opener_tx_id")).agg(side(True).alias("spend_tx_id"), side(False).alias("arrival_tx_id"))


def _deposit_claims(free: DataFrame) -> DataFrame:
    runs = deposit_runs(free)
    legs = runs.select(F.col("opener_tx_id").alias("anchor"), F.explode(F.array("opener_tx_id", "spend_tx_id", "arrival_tx_id")).alias("tx_id")).where("tx_id is not null")
    return legs.join(free.select("tx_id", "tx_types"), "tx_id").select("tx_id", "anchor", F.when(may_be(F.col("tx_types"), "TRANSFER"), F.lit("TRANSFER")).alias("resolved"))


def _events(links: DataFrame) -> DataFrame:
    """Rows (tx_id, event_id) of linked postings."""
    return components(links.select(F.col("tx_id").alias("a"), F.col("anchor").alias("b"))).select(F.col("node").alias("tx_id"), F.col("root").alias("event_id"))


def attach_bearers(postings: DataFrame, free: DataFrame, correlations: DataFrame, links: DataFrame) -> DataFrame:
    """Claims of bearers: each joins the one event whose postings hold the token that it points at; of several events, none.

    Bearers go by tx_id and their pointers by position. A bearer waits for a smaller one in an event that it
    points at, since that one may still move; all others are decided together.
    """
    holders = _tokens(postings, correlations, "EXACT").select(F.col("tx_id").alias("holder"), *TOKEN)
    pointers = settled(_tokens(free, correlations, "ATTACHES").join(holders, TOKEN).where("holder <> tx_id").select("tx_id", "position", "holder").distinct())
    claims = links.limit(0).select("tx_id", "anchor")
    while not pointers.isEmpty():
        events = _events(links.select("tx_id", "anchor").unionByName(claims))
        at = pointers.join(events.withColumnRenamed("tx_id", "holder"), "holder", "left").withColumn("event_id", F.coalesce("event_id", "holder"))
        waiting = pointers.select(F.col("tx_id").alias("other")).distinct()
        waiting = waiting.join(events.withColumnRenamed("tx_id", "other"), "other", "left").select(F.coalesce("event_id", "other").alias("event_id"), "other")
        least = at.join(waiting, "event_id", "left").where("other is null or other <> tx_id").groupBy("tx_id").agg(F.min("other").alias("other"))
        later = least.where("other < tx_id").select("tx_id")
        now = settled(at.join(later, "tx_id", "left_anti"))
        clear = now.groupBy("tx_id", "position").agg(F.min("event_id").alias("low"), F.max("event_id").alias("high"), F.min("holder").alias("anchor")).where("low = high")
        claims = settled(claims.unionByName(clear.groupBy("tx_id").agg(F.min_by("anchor", "position").alias("anchor"))))
        pointers = settled(pointers.join(now.select("tx_id").distinct(), "tx_id", "left_anti"))
    return claims.withColumn("resolved", F.lit(None).cast("string"))


def explaining_charges(gaps: DataFrame, charges: DataFrame) -> DataFrame:
    """Rows (BUCKET, anchor, size, tx_id): the fewest charges (at most three, then the smallest ids) that sum to each gap.

    ``gaps``: BUCKET, anchor, gap; ``charges``: BUCKET, tx_id, amount. Of equal amounts in a bucket only the
    first three can be in an answer, so no more take part. One charge is found by its cents. So are two, and
    three meet in the middle: a bucket's pairs are made once, and a gap less one charge is looked up among their sums.
    """
    first = F.row_number().over(Window.partitionBy(*BUCKET, "amount").orderBy("tx_id"))
    asked = settled(gaps)
    usable = charges.withColumn("nth", first).where(F.col("nth") <= MAX_CHARGES).drop("nth")
    usable = settled(usable.join(asked.select(*BUCKET).distinct(), BUCKET, "left_semi").select(*charges.columns))
    single = usable.select(*BUCKET, F.array("tx_id").alias("more"), F.col("amount").alias("sum"), _cents(F.col("amount")).alias("key"))
    # a pair takes part where some gap of its bucket is as large
    top = asked.groupBy(*BUCKET).agg(F.max("gap").alias("top"))
    other = usable.select(*BUCKET, F.col("tx_id").alias("next"), F.col("amount").alias("second"))
    pair = usable.join(other, BUCKET).where(F.col("next") > F.col("tx_id")).join(top, BUCKET)
    total = F.col("amount") + F.col("second")
    pair = pair.where(total < F.col("top") + F.lit(MONEY).cast("decimal(4,3)")).select(*BUCKET, F.array("tx_id", "next").alias("more"), total.alias("sum"), _cents(total).alias("key"))
    whole = asked.select(*BUCKET, "anchor", "gap", F.array().cast("array<bigint>").alias("ids"))
    less = asked.join(usable, BUCKET).where(F.col("amount") < F.col("gap")).select(*BUCKET, "anchor", (F.col("gap") - F.col("amount")).alias("gap"), F.array("tx_id").alias("ids"))
    out = None
    for size, open_sums, ends in ((1, whole, single), (2, whole, pair), (3, less, pair)):
        if out is not None:
            open_sums = open_sums.join(out.select("anchor").distinct(), "anchor", "left_anti").select(*open_sums.columns)
        after = (F.size("ids") == 0) | (F.get("more", F.lit(0)) > F.try_element_at("ids", F.lit(-1)))
        met = open_sums.withColumn("key", _around(_cents(F.col("gap")))).join(ends, [*BUCKET, "key"]).where(after & _near(F.col("gap"), F.col("sum")))
        best = met.groupBy(*BUCKET, "anchor").agg(F.min(F.concat("ids", "more")).alias("ids"))
        found = settled(best.select(*BUCKET, "anchor", F.lit(size).alias("size"), F.explode("ids").alias("tx_id")))
        out = found if out is None else out.unionByName(found)
    return out


def _charge_claims(postings: DataFrame, free: DataFrame, links: DataFrame) -> DataFrame:
    """A purchase's stated total, less the cash and charges of its event, explained by free charges of its day."""
    types = F.col("tx_types")
    placed = postings.join(_events(links), "tx_id", "left").withColumn("event_id", F.coalesce("event_id", "tx_id"))
    spends = _is_charge() | (_is_money(types) & may_be(types, "TRADE_CASH"))
    spent = placed.where(spends).groupBy("event_id").agg(F.sum(F.abs("quantity")).alias("spent"))
    bought = placed.where(~_is_money(types) & F.col("settlement_amount").isNotNull() & (F.col("quantity") > 0)).join(spent, "event_id", "left")
    gap = F.abs("settlement_amount").cast("decimal(28,6)") - F.coalesce("spent", F.lit(0).cast("decimal(28,6)"))
    gaps = bought.select(*BUCKET, F.col("tx_id").alias("anchor"), gap.alias("gap")).where("gap > 0")
    charges = free.where(_is_charge()).select(*BUCKET, "tx_id", F.abs("quantity").alias("amount"))
    taken = first_come(explaining_charges(gaps, charges), ["size", "anchor"], "tx_id", within=BUCKET)
    return taken.select("tx_id", "anchor", F.lit(None).cast("string").alias("resolved"))


def partition(postings: DataFrame, correlations: DataFrame) -> DataFrame:
    """Rows (tx_id, event_id, rule, resolved): every posting with its event, which its smallest tx_id names.

    rule is the one that claimed the posting, null for none; resolved is what that rule made of it, or the
    nearest common ancestor of its declared types.
    """
    rows = settled(with_ordinals(postings, correlations))
    claims = rows.select("tx_id", F.col("tx_id").alias("anchor"), F.lit(None).cast("string").alias("resolved"), F.lit(None).cast("string").alias("rule")).limit(0)
    rules = (
        ("exact", lambda free: exact_claims(free, correlations)),
        ("disposal", lambda free: _pair_claims(_paired(trade_candidates(free, False)), "TRADE_ASSET")),
        ("acquisition", lambda free: _pair_claims(_paired(trade_candidates(free, True)), "TRADE_ASSET")),
        ("cash_trade", lambda free: _pair_claims(_paired(cash_candidates(free)), "TRADE_CASH")),
        ("deposit_run", _deposit_claims),
        ("attaches", lambda free: attach_bearers(rows, free, correlations, claims)),
        ("charge", lambda free: _charge_claims(rows, free, claims)),
    )
    for name, rule in rules:
        free = rows.join(claims.select("tx_id"), "tx_id", "left_anti").select(*rows.columns)
        claims = settled(claims.unionByName(rule(free).withColumn("rule", F.lit(name)).select(*claims.columns)))
    found = rows.select("tx_id", "tx_types").join(_events(claims), "tx_id", "left").join(claims.drop("anchor"), "tx_id", "left")
    return found.select("tx_id", F.coalesce("event_id", "tx_id").alias("event_id"), "rule", F.coalesce("resolved", resolve(F.col("tx_types"))).alias("resolved"))


# ---------------------------------------------------------------- around the engine


def by_tokens(postings: DataFrame, correlations: DataFrame, asked: DataFrame) -> DataFrame:
    """Postings that hold a token asked for: ``asked`` (user_id, broker, account, any_account, label, token)."""
    held = correlations.where(_declared("EXACT")).select("tx_id", "label", "token").join(postings, "tx_id")
    q = asked.select(F.col("user_id"), F.col("broker"), F.col("label"), F.col("token"), F.when(~F.col("any_account"), F.col("account")).alias("_account")).distinct()
    met = held.join(q, ["user_id", "broker", "label", "token"]).where(F.col("_account").isNull() | (F.col("account") == F.col("_account")))
    return met.select(*postings.columns).distinct()


def by_days(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """Postings of the account-days asked for: ``asked`` (BUCKET)."""
    return postings.join(asked.select(*BUCKET).distinct(), BUCKET, "left_semi").select(*postings.columns)


def by_ordinals(postings: DataFrame, correlations: DataFrame, asked: DataFrame) -> DataFrame:
    """Postings with an ordinal in a span asked for: ``asked`` (user_id, broker, account, label, low, high)."""
    held = correlations.where(_declared("ORDINAL") & F.col("ordinal").isNotNull()).select("tx_id", "label", "ordinal").join(postings, "tx_id")
    met = held.join(asked.select("user_id", "broker", "account", "label", "low", "high").distinct(), ["user_id", "broker", "account", "label"])
    return met.where("ordinal >= low and ordinal <= high").select(*postings.columns).distinct()


def neighbourhood(seed: DataFrame, postings: DataFrame, correlations: DataFrame) -> DataFrame:
    """Rows (tx_id) of all postings that the rules could link to ``seed`` (tx_id), over any number of steps."""
    keys = ["tx_id", *BUCKET]
    rows = settled(postings.select(*keys))
    held = settled(rows.join(seed.select("tx_id").distinct(), "tx_id", "left_semi"))
    front = held
    while not front.isEmpty():
        said = front.join(correlations, "tx_id")
        tokens = said.where(_declared("EXACT") | _declared("ATTACHES")).withColumn("any_account", F.col("scope") != "ACCOUNT")
        spans = said.where(_declared("ORDINAL") & F.col("ordinal").isNotNull() & F.col("ordinal_span").isNotNull())
        spans = spans.withColumn("low", F.col("ordinal") - F.col("ordinal_span")).withColumn("high", F.col("ordinal") + F.col("ordinal_span"))
        met = by_days(rows, front).unionByName(by_tokens(rows, correlations, tokens)).unionByName(by_ordinals(rows, correlations, spans))
        front = settled(met.distinct().join(held.select("tx_id"), "tx_id", "left_anti").select(*keys))
        held = settled(held.unionByName(front))
    return held.select("tx_id")


def seeds(postings: DataFrame, matches: DataFrame) -> DataFrame:
    """Rows (tx_id) of the stated postings in groups that a residual leg leaves open and no transfer match explains."""
    open_legs = postings.where("account_type in ('IMBALANCE', 'TRANSFER_CLEARING')")
    sides = matches.select(F.explode(F.array("from_group_id", "to_group_id")).alias("group_id"), "instrument_id").distinct()
    groups = open_legs.join(sides, ["group_id", "instrument_id"], "left_anti").select("group_id").distinct()
    return postings.where("account_type = 'USER'").join(groups, "group_id", "left_semi").select("tx_id")


def membership_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Postings whose event changed: (tx_id, old_event_id, new_event_id); events are named by their smallest member, so only membership counts."""
    name = lambda rows, to: rows.join(rows.groupBy("event_id").agg(F.min("tx_id").alias(to)), "event_id").select("tx_id", to)
    both = name(before, "old_event_id").join(name(after, "new_event_id"), "tx_id")
    return both.where("old_event_id <> new_event_id")


def divergence(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """One row (n_derived, n_stored, agreed, joined, split) on two partitions (tx_id, event_id) of the same postings.

    agreed counts derived events whose members are a stored event's; joined those with members of several
    stored events; split stored events whose members are in several derived ones.
    """
    both = derived.join(stored.withColumnRenamed("event_id", "stored_id"), "tx_id")
    sizes = stored.groupBy(F.col("event_id").alias("stored_id")).agg(F.count("*").alias("stored_size"))
    by_event = both.groupBy("event_id").agg(F.countDistinct("stored_id").alias("n"), F.min("stored_id").alias("stored_id"), F.count("*").alias("size")).join(sizes, "stored_id")
    events = by_event.agg(F.count("*").alias("n_derived"), F.count_if((F.col("n") == 1) & (F.col("size") == F.col("stored_size"))).alias("agreed"), F.count_if(F.col("n") > 1).alias("joined"))
    groups = both.groupBy("stored_id").agg(F.countDistinct("event_id").alias("n")).agg(F.count("*").alias("n_stored"), F.count_if(F.col("n") > 1).alias("split"))
    return events.crossJoin(groups).select("n_derived", "n_stored", "agreed", "joined", "split")  # one row each


def apply_partition(weighted: DataFrame, derived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stated postings with their new group_id and tx_type, routed legs of the groups that changed) after ``derived`` (tx_id, event_id, resolved).

    ``weighted`` are postings with weight and commodity. A group is named by its smallest tx_id. Routed legs of
    every group that a posting left or joined are dropped and worked out again; other groups keep theirs.
    """
    own = weighted.where("account_type = 'USER'")
    named = own.join(derived.select("tx_id", "event_id", "resolved"), "tx_id").withColumn("old_group", F.min("tx_id").over(Window.partitionBy("group_id")))
    moved = named.withColumn("group_id", F.col("event_id")).withColumn("tx_type", F.coalesce("resolved", "tx_type"))
    changed = named.where("event_id <> old_group").select(F.explode(F.array("event_id", "old_group")).alias("group_id")).distinct()
    stated = moved.select(*weighted.columns)
    return stated, residual_legs(group_residuals(stated.join(changed, "group_id", "left_semi").select(*weighted.columns)))

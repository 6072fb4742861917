"""Transfer matching: pairs departures with arrivals, best first, and refuses what is ambiguous.

Candidates come from equality joins on (user, instrument, amount); pairing is rounds of joins (``rounds``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators.holdings import unmatched
from ledgerlake.operators.rounds import best_first, settled

MAX_DAYS, MAX_ORDINAL_GAP = 7, 64


def unmatched_sides(postings: DataFrame, correlations: DataFrame, matches: DataFrame) -> DataFrame:
    """Clearing balances by group and instrument with the evidence of the whole group.

    Rows (user_id, broker, account, group_id, instrument_id, day, amount, ordinals, tokens). ``postings`` carry
    split_adjusted_quantity: the two sides of a journal recorded on either side of a split are stated in
    different share counts. ``correlations`` carry the match kinds that their source declares (matches): only
    tokens declared ACCOUNT name an account, and only ordinals declared ORDINAL compare.
    """
    legs = unmatched(postings.where("account_type = 'TRANSFER_CLEARING' and instrument_id is not null"), matches)
    sides = legs.groupBy("user_id", "broker", "account", "group_id", "instrument_id").agg(F.sum("split_adjusted_quantity").alias("amount"), F.min("order_date").alias("day")).where("amount <> 0")
    declared = lambda kind, value: F.array_sort(F.collect_set(F.when(F.array_contains("matches", kind), F.col(value))))
    evidence = correlations.groupBy("group_id").agg(declared("ORDINAL", "ordinal").alias("ordinals"), declared("ACCOUNT", "token").alias("tokens"))
    return sides.join(evidence, "group_id", "left")


def candidates(sides: DataFrame) -> DataFrame:
    """Pairs that may be one transfer: exact opposites of different accounts at most MAX_DAYS apart, with how they are known."""
    columns = ("group_id", "broker", "account", "day", "ordinals", "tokens")
    part = lambda sign, name: sides.where(f"amount {sign} 0").select("user_id", "instrument_id", F.abs("amount").alias("size"), *(F.col(c).alias(f"{name}_{c}") for c in columns))
    met = part(">", "from").join(part("<", "to"), ["user_id", "instrument_id", "size"])
    same_broker = F.col("from_broker") == F.col("to_broker")
    gap = F.abs(F.datediff("from_day", "to_day"))
    met = met.where(~(same_broker & (F.lower("from_account") == F.lower("to_account"))) & (gap <= MAX_DAYS))
    plain = lambda c: F.lower(F.trim(c))
    names = lambda here, there: F.array_contains(F.transform(F.coalesce(f"{here}_tokens", F.array().cast("array<string>")), plain), plain(F.col(f"{there}_account")))
    named = names("from", "to") | names("to", "from")
    apart = F.array_min(F.flatten(F.transform("from_ordinals", lambda a: F.transform("to_ordinals", lambda b: F.abs(a - b)))))
    near = F.when(same_broker & (apart <= MAX_ORDINAL_GAP), apart)
    rows = met.select("user_id", "instrument_id", "from_group_id", "to_group_id", gap.alias("days"), F.coalesce(same_broker & named, F.lit(False)).alias("pointer"), near.alias("distance"))
    return rows.where("pointer or distance is not null")


def match_transfers(sides: DataFrame) -> DataFrame:
    """New matches (user_id, instrument_id, from_group_id, to_group_id, method): pointers first, then near references among what is left.

    Nearest references go first, then nearest days, then the smallest groups. Of candidates that only the group
    tells apart none is taken, and both sides of the first sit out their pass.
    """
    found = settled(candidates(sides))
    left, right = ["user_id", "instrument_id", "from_group_id"], ["user_id", "instrument_id", "to_group_id"]
    named = best_first(found.where("pointer").withColumn("distance", F.lit(0).cast("long")), left, right, ["distance", "days"], refuse_ties=True, within=["user_id", "instrument_id"])
    rest = found.where("distance is not null").withColumn("distance", F.col("distance").cast("long"))
    for keys in (left, right):
        rest = rest.join(named.select(*keys).distinct(), keys, "left_anti").select(*found.columns)
    near = best_first(rest, left, right, ["distance", "days"], refuse_ties=True, within=["user_id", "instrument_id"])
    columns = ["user_id", "instrument_id", "from_group_id", "to_group_id"]
    return named.select(*columns, F.lit("POINTER").alias("method")).unionByName(near.select(*columns, F.lit("REFERENCE").alias("method")))


def create_matches(matches: DataFrame, proposed: DataFrame) -> DataFrame:
    """``matches`` with those of ``proposed`` added whose groups no match names yet in that instrument, on either side.

    Of proposals that share a group in an instrument the first by (from_group_id, to_group_id) is written, so
    proposing the same again changes nothing.
    """
    columns = matches.columns
    ends = F.explode(F.array("from_group_id", "to_group_id"))
    held = matches.select("instrument_id", ends.alias("group_id")).distinct()
    new = proposed.select(*columns, F.struct("from_group_id", "to_group_id").alias("_order")).withColumn("group_id", ends)
    first = new.groupBy("instrument_id", "group_id").agg(F.min("_order").alias("_first"))
    judged = new.join(first, ["instrument_id", "group_id"]).join(held.withColumn("_held", F.lit(True)), ["instrument_id", "group_id"], "left")
    ok = judged.groupBy(*columns).agg(F.min((F.col("_order") == F.col("_first")) & F.col("_held").isNull()).alias("_ok"))
    return matches.unionByName(ok.where("_ok").select(*columns))

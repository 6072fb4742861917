"""The transaction-type tree and its predicates over declared sets of types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parent of each type; the root has none.
PARENTS = {
    "AMBIGUOUS": None,
    "DIVIDEND": "INCOME",
    "EXPENSE": "AMBIGUOUS",
    "FINANCING_COST": "EXPENSE",
    "HOLDING_COST": "EXPENSE",
    "INCOME": "AMBIGUOUS",
    "INTEREST": "INCOME",
    "RETURN_OF_CAPITAL": "INCOME",
    "TRADE": "AMBIGUOUS",
    "TRADE_ASSET": "TRADE",
    "TRADE_CASH": "TRADE",
    "TRANSACTION_COST": "EXPENSE",
    "TRANSFER": "AMBIGUOUS",
    "TRANSFER_EXTERNAL": "TRANSFER",
    "TRANSFER_INTERNAL": "TRANSFER",
}


def lineage(kind: str) -> list[str]:
    """``kind`` and its ancestors, nearest first."""
    out = [kind]
    while PARENTS.get(out[-1]):
        out.append(PARENTS[out[-1]])
    return out


def _up() -> Column:
    return F.create_map(*(x for k in PARENTS for x in (F.lit(k), F.array(*map(F.lit, lineage(k))))))


def must_be(types: Column, kind: str) -> Column:
    """Whether every declared type is ``kind`` or below it; false for an empty or null set."""
    below = [k for k in PARENTS if kind in lineage(k)]
    return F.coalesce((F.size(types) > 0) & F.forall(types, lambda t: t.isin(below)), F.lit(False))


def may_be(types: Column, kind: str) -> Column:
    """Whether some declared type is ``kind``, below it, or above it."""
    near = sorted({k for k in PARENTS if kind in lineage(k)} | set(lineage(kind)))
    return F.coalesce(F.exists(types, lambda t: t.isin(near)), F.lit(False))


def resolve(types: Column) -> Column:
    """The nearest common ancestor of the declared types; null for an empty set or an unknown type."""
    up = _up()
    shared = F.aggregate(F.slice(types, 2, 64), up[F.get(types, F.lit(0))], lambda a, t: F.filter(a, lambda x: F.array_contains(up[t], x)))
    return F.when(F.size(types) > 0, F.get(shared, F.lit(0)))


def is_antichain(types: Column) -> Column:
    """Whether no declared type is another's ancestor, and none repeats."""
    up = _up()
    clear = F.forall(types, lambda t: F.size(F.array_intersect(types, up[t])) == 1)
    return clear & (F.size(F.array_distinct(types)) == F.size(types))

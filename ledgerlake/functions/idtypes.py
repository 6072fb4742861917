"""What an identifier type says about what it names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: For each type its scope, how readily its values are given to something else, and what one value names.
ID_TYPES = {
    "ISIN": ("GLOBAL", "RARE", "SECURITY"),
    "CUSIP": ("GLOBAL", "RARE", "SECURITY"),
    "SEDOL": ("GLOBAL", "RARE", "SECURITY"),
    "CINS": ("GLOBAL", "RARE", "SECURITY"),
    "WERTPAPIER": ("GLOBAL", "RARE", "SECURITY"),
    "OPENFIGI_SHARE_CLASS": ("GLOBAL", "RARE", "SECURITY"),
    "OPENFIGI_COMPOSITE": ("GLOBAL", "RARE", "SECURITY"),
    "MIC_TICKER": ("GLOBAL", "ROUTINE", "LISTING"),
    "OPENFIGI_TICKER": ("GLOBAL", "ROUTINE", "LISTING"),
    "OCC": ("GLOBAL", "ROUTINE", "SECURITY"),
    "OPRA": ("GLOBAL", "ROUTINE", "SECURITY"),
    "FUT_OPT": ("GLOBAL", "ROUTINE", "SECURITY"),
    "CURRENCY": ("GLOBAL", "ROUTINE", "SECURITY"),
    "FX_PAIR": ("GLOBAL", "ROUTINE", "SECURITY"),
    "BROKER_DESCRIPTION": ("DESCRIPTION", "ROUTINE", "SECURITY"),
}


def _any(kind: Column, place: int, value: str) -> Column:
    return F.coalesce(kind.isin([k for k, held in ID_TYPES.items() if held[place] == value]), F.lit(False))


def is_known(kind: Column) -> Column:
    return F.coalesce(kind.isin(list(ID_TYPES)), F.lit(False))


def names_a_listing(kind: Column) -> Column:
    """Whether a value names one listing, so that its domain is a venue; false for an unknown type."""
    return _any(kind, 2, "LISTING")


def may_mediate(kind: Column, system_owned: Column) -> Column:
    """Whether two things that share a value may be one by it: the system states it, and its values are rarely given away."""
    return _any(kind, 1, "RARE") & F.coalesce(system_owned, F.lit(False))

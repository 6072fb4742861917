"""What runs report: counts for a dashboard, what became of gaps, which runs are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gap_outcome(fetched: Column, bars: Column, reached: Column, called: Column) -> Column:
    """What became of a gap: covered with bars, settled without, out of every plugin's reach, or failed by all asked.

    A gap that plugins could take but that none was asked for had been covered before, so it counts as settled.
    """
    settled = F.when(fetched & (bars > 0), "filled").when(fetched | (reached & ~called), "settled_empty")
    return F.coalesce(settled, F.when(~reached, "no_eligible_plugin").otherwise("all_plugins_failed"))


def gap_outcomes(gaps: DataFrame, calls: DataFrame) -> DataFrame:
    """``gaps`` (gap_id, n_ranges, n_eligible) with n_calls, n_bars and outcome, by ``calls`` (gap_id, range, ok, bars).

    A gap is fetched if every one of its ranges was covered by a call without an error.
    """
    sums = calls.groupBy("gap_id").agg(F.count("*").alias("n_calls"), F.countDistinct(F.when(F.col("ok"), F.col("range"))).alias("_covered"), F.sum(F.when(F.col("ok"), F.col("bars"))).alias("n_bars"))
    rows = gaps.join(sums, "gap_id", "left").fillna(0, ["n_calls", "_covered", "n_bars"])
    fetched = (F.col("n_ranges") > 0) & (F.col("_covered") >= F.col("n_ranges"))
    return rows.withColumn("outcome", gap_outcome(fetched, F.col("n_bars"), F.col("n_eligible") > 0, F.col("n_calls") > 0)).drop("_covered")


def dashboard_counts(balances: DataFrame, gaps: DataFrame, unhandled: DataFrame) -> DataFrame:
    """Rows (key, n): open balances, imbalances, instruments with gaps and unhandled events."""
    count = lambda rows, key: rows.agg(F.count("*").alias("n")).select(F.lit(key).alias("key"), "n")
    out = count(balances.where("account_type <> 'SOURCE_ROUNDING'"), "balances")
    for rows, key in ((balances.where("account_type = 'IMBALANCE'"), "imbalances"), (gaps.select("instrument_id").distinct(), "gap_instruments"), (unhandled, "unhandled_events")):
        out = out.unionByName(count(rows, key))
    return out


def kept_runs(runs: DataFrame, cutoff: str, now: str) -> DataFrame:
    """``runs`` (started_at, ended_at, status) from ``cutoff`` on; a run that never ended by ``now`` is marked incomplete and ends there."""
    kept = runs.where(F.col("started_at") >= F.lit(cutoff).cast("timestamp_ntz"))
    open_run = F.col("ended_at").isNull()
    return kept.withColumn("status", F.when(open_run, "INCOMPLETE").otherwise(F.col("status"))).withColumn("ended_at", F.coalesce("ended_at", F.lit(now).cast("timestamp_ntz")))

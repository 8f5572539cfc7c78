"""Decayed relevance of concepts, and the counts of an overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000
# Decay in days of fetches, confirmations and arousal; weight and floor of arousal.
FETCH_DAYS, CONFIRM_DAYS, AROUSAL_DAYS = 60.0, 14.0, 120.0
AROUSAL_WEIGHT, AROUSAL_FLOOR = 0.5, 0.1
# End of fixed values.


def _days(now_ms: Column, then_ms: Column) -> Column:
    return (now_ms - then_ms) / DAY_MS


def living_score(confidence: Column, usefulness: Column, fetched_ms: Column, confirmed_ms: Column, arousal: Column, aroused_ms: Column, now_ms: Column) -> Column:
    """Confidence, raised by decayed usefulness and arousal, and decayed since the last confirmation."""
    useful = usefulness * F.exp(-_days(now_ms, F.coalesce(fetched_ms, confirmed_ms)) / FETCH_DAYS)
    awake = F.greatest(arousal * AROUSAL_FLOOR, arousal * F.exp(-_days(now_ms, aroused_ms) / AROUSAL_DAYS))
    return confidence * (1 + useful) * F.exp(-_days(now_ms, confirmed_ms) / CONFIRM_DAYS) * (1 + AROUSAL_WEIGHT * F.coalesce(awake, F.lit(0.0)))


def stale(confirmed_ms: Column, now_ms: Column, after_ms: int) -> Column:
    """Stale by the last confirmation, never by the last update."""
    return now_ms - confirmed_ms > after_ms


def within_budget(rows: DataFrame, group: str, order: list[str], text: str, budget: int) -> DataFrame:
    """The longest ordered prefix of each group whose texts fit the budget of characters."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(F.length(text)).over(w)).where(F.col("used") <= budget)

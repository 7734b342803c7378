"""Telemetry roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTERS = ("answered", "ambiguous", "not_found", "low_confidence", "cache_hits", "cache_misses", "refine_attempts", "refine_success", "refine_exhausted")


def counters(events: DataFrame, by: list[str] | None = None, kind: str = "event_type") -> DataFrame:
    """Events of each kind, over all or by columns."""
    return events.groupBy(*(by or []), kind).agg(F.count("*").alias("n"))


def snapshot(events: DataFrame, ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Each kind's events, and the whole seconds between its first and its last."""
    at = lambda f: F.unix_micros(f(F.col(ts).cast("timestamp")))
    return events.groupBy(kind).agg(F.count("*").alias("n"), F.round((at(F.max) - at(F.min)) / 1e6).cast("long").alias("busy_s"))


def outcomes(answers: DataFrame, low: float = 0.32) -> DataFrame:
    """Counters of answers (answer, context_found, confidence, needs_clarification, cache_hit, refine_attempts, refine_success)."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    ask, found = F.col("needs_clarification"), F.col("context_found")
    return answers.agg(
        F.count("*").alias("total"), n(found & ~F.coalesce(ask, F.lit(False))).alias("answered"), n(ask).alias("ambiguous"), n(~found & ~F.coalesce(ask, F.lit(False))).alias("not_found"),
        n(F.col("confidence") < low).alias("low_confidence"), n(F.col("cache_hit")).alias("cache_hits"), n(~F.col("cache_hit")).alias("cache_misses"),
        F.coalesce(F.sum("refine_attempts"), F.lit(0)).alias("refine_attempts"), n(F.col("refine_success")).alias("refine_success"),
        n((F.col("refine_attempts") > 0) & ~F.col("refine_success")).alias("refine_exhausted"),
    )


def rate_alerts(events: DataFrame, minutes: int = 5, more_than: int = 3, ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Windows in which a kind of event came more often than allowed."""
    w = events.groupBy(F.window(ts, f"{minutes} minutes").alias("w"), kind).agg(F.count("*").alias("n")).filter(F.col("n") > more_than)
    return w.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), kind, "n")

"""Serving functions: the answers of the read-only service, as DataFrames. Bad parameters raise ValueError."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.operators import allocate as place
from quayside.operators import marts
from quayside.plans.frames import Frames
from quayside.sources import documents

METRICS = {"revenue_per_driver_hour", "mean_trips_per_day", "total_revenue"}


def _within(name: str, value: int, low: int, high: int) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be {low} to {high}")


def heatmap(frames: Frames, metric: str = "revenue_per_driver_hour", borough: str | None = None) -> DataFrame:
    """The grid of the week's hours; the metric only names what the caller shows."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {sorted(METRICS)}")
    return marts.heatmap(frames.profile, borough)


def boroughs(frames: Frames) -> DataFrame:
    return frames.zones.select("borough").distinct().orderBy("borough")


def zones(frames: Frames, order: str = "value", limit: int = 15, min_trips: int = 20_000) -> DataFrame:
    """Top zones by value, of those with more than ``min_trips`` trips, or by trips."""
    rows = marts.zone_summary(frames.mart)
    rows = marts.top(rows.where(F.col("trips") > min_trips), "revenue_per_driver_hour", limit, "zone_id") if order == "value" else marts.top(rows, "trips", limit, "zone_id")
    return rows.select("zone_id", "zone_name", "borough", "trips", "revenue", "revenue_per_driver_hour")


def _hour(frames: Frames, fleet: int, hour: int, dow: int) -> DataFrame:
    _within("fleet", fleet, 1, 20_000)
    _within("hour", hour, 0, 23)
    _within("dow", dow, 0, 6)
    return frames.serving.where((F.col("hour") == hour) & (F.col("dow") == dow))


def allocate(frames: Frames, fleet: int = 300, hour: int = 18, dow: int = 3, policy: str = "revenue_per_hour", limit: int = 25) -> DataFrame:
    """The first ``limit`` assignments of a policy in one hour."""
    if policy not in place.POLICIES:
        raise ValueError(f"policy must be one of {sorted(place.POLICIES)}")
    return place.assign(_hour(frames, fleet, hour, dow), [fleet], [policy]).where(F.col("rank") <= limit)


def compare(frames: Frames, fleet: int = 300, hour: int = 18, dow: int = 3) -> DataFrame:
    """All policies on one hour."""
    spine = frames.times.where((F.col("hour") == hour) & (F.col("dow") == dow))
    return place.compare(place.assign(_hour(frames, fleet, hour, dow), [fleet]), spine, fleet)


def summary(spark: SparkSession, out: str) -> dict:
    """The stored summary; LookupError before the first report."""
    return documents.read(spark, f"{out}/summary.json")


def backtest(spark: SparkSession, out: str) -> dict:
    """The stored backtest; LookupError before the first report."""
    return documents.read(spark, f"{out}/backtest.json")


def health(frames: Frames) -> DataFrame:
    return frames.serving.agg(F.count("*").alias("cells"))

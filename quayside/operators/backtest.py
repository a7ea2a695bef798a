"""Temporal backtest: plan on earlier periods, earn at what later ones really paid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions import ratio
from quayside.operators.allocate import MULTIPLE, assign, capacity

HOURS = 168


def split(periods: DataFrame, fraction: float = 0.25) -> DataFrame:
    """(period, part): the last quarter, rounded half to even and one at least, is 'test'. Fails for fewer than two periods.

    Periods are few (months of a service), so one window over them is small.
    """
    one = Window.partitionBy()
    rows = periods.select("period").distinct().withColumn("n", F.count("*").over(one)).withColumn("at", F.row_number().over(one.orderBy(F.desc("period"))))
    tests = F.greatest(F.lit(1), F.bround(F.col("n") * fraction).cast("int"))
    part = F.when(F.col("n") < 2, F.raise_error(F.lit("a backtest needs two periods at least"))).when(F.col("at") <= tests, "test").otherwise("train")
    return rows.select("period", part.alias("part"))


def part_of(mart: DataFrame, parts: DataFrame, part: str) -> DataFrame:
    return mart.join(parts.where(F.col("part") == part).select("period"), "period")


def train_cells(mart: DataFrame) -> DataFrame:
    """What each cell promises: mean trips a day over the periods, and revenue per driver-hour of the sums."""
    out = mart.groupBy("zone_id", "zone_name", "borough", "is_airport", "dow", "hour").agg(
        F.coalesce(F.avg("trips_per_day"), F.lit(0.0)).alias("trips_per_day"), F.coalesce(ratio(F.sum("revenue"), F.sum("driver_hours")), F.lit(0.0)).alias("revenue_per_driver_hour"), F.sum("driver_hours").alias("h")
    )
    return out.where("h > 0").drop("h")


def realised_rates(mart: DataFrame) -> DataFrame:
    """What each cell paid and took."""
    return train_cells(mart).select("zone_id", "dow", "hour", F.col("revenue_per_driver_hour").alias("rph"), F.col("trips_per_day").alias("trips"))


def score(assigned: DataFrame, realised: DataFrame) -> DataFrame:
    """Assignments with what they earned: drivers on cells that paid nothing are wasted, drivers over capacity earn nothing."""
    rows = assigned.join(realised, ["zone_id", "dow", "hour"], "left")
    alive = F.coalesce(F.col("rph") > 0, F.lit(False))
    room = capacity(F.col("trips"), MULTIPLE)
    earning = F.when(alive, F.least(F.col("drivers"), room)).otherwise(0).cast("bigint")
    return rows.select(
        "policy", "fleet", "dow", "hour", "zone_id", "drivers", F.when(alive, 0).otherwise(F.col("drivers")).cast("bigint").alias("wasted"),
        F.when(alive, F.col("drivers") - earning).otherwise(0).cast("bigint").alias("over"), F.when(alive, earning * F.col("rph")).otherwise(0.0).alias("revenue"),
        F.when(alive, F.col("drivers")).otherwise(0).cast("bigint").alias("assigned"),
    )


def backtest(train: DataFrame, realised: DataFrame, fleets: Sequence[int]) -> DataFrame:
    """The week's realised revenue of every policy and fleet size."""
    scored = score(assign(train, fleets), realised)
    out = scored.groupBy("policy", "fleet").agg(F.sum("revenue").alias("r"), F.sum("wasted").alias("drivers_to_dead_cells"), F.sum("over").alias("drivers_over_capacity"), F.sum("assigned").alias("driver_hours_assigned"))
    return out.select("policy", "fleet", F.round("r", 2).alias("realised_weekly_revenue"), F.round(F.col("r") / (F.col("fleet") * HOURS), 4).alias("revenue_per_driver_hour"), "drivers_to_dead_cells", "drivers_over_capacity", "driver_hours_assigned")


def lift(results: DataFrame) -> DataFrame:
    """The value-ranked policy against the better of the others, from rounded revenues; and the mean lift over fleets."""
    of = lambda p: F.max(F.when(F.col("policy") == p, F.col("realised_weekly_revenue")))
    rows = results.groupBy("fleet").agg(of("revenue_per_hour").alias("revenue_policy"), of("trip_volume").alias("volume"), of("uniform").alias("uniform"))
    rows = rows.withColumn("best_baseline", F.greatest("volume", "uniform"))
    gain = lambda base: F.when(F.col(base) != 0, F.round(100 * (F.col("revenue_policy") - F.col(base)) / F.col(base), 2))
    rows = rows.select("fleet", "revenue_policy", "best_baseline", F.when(F.col("volume") >= F.col("uniform"), "trip_volume").otherwise("uniform").alias("best_baseline_policy"), gain("best_baseline").alias("lift_pct"), gain("uniform").alias("vs_uniform_pct"))
    return rows.withColumn("mean_lift_pct", F.round(F.avg("lift_pct").over(Window.partitionBy()), 2))  # a row a fleet size

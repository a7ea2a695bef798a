"""Placing a fleet on cells, hour by hour, under three policies, as window functions.

Cells have zone_id, zone_name, borough, dow, hour, trips_per_day and revenue_per_driver_hour, unique by (zone_id, dow, hour). Greedy
filling is a running sum of capacities in rank order: a cell gets what the better ones leave of the fleet. Ties go to the smaller
zone_id. A window spans the zones of one hour, a number that doesn't grow with the trips.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions import truncated

#: Drivers that a cell takes for each expected trip.
MULTIPLE = 1.5
POLICIES = ["revenue_per_hour", "trip_volume", "uniform"]
HOUR = ["fleet", "dow", "hour"]


def capacity(trips: Column, multiple: float = MULTIPLE, drivers_per_trip: float = 1.0) -> Column:
    """Drivers that a cell can keep busy; at least one."""
    return F.greatest(F.lit(1).cast("bigint"), truncated(trips * drivers_per_trip * multiple))


def with_fleets(cells: DataFrame, fleets: Sequence[int], drivers_per_trip: float = 1.0) -> DataFrame:
    """Each cell once per fleet size, with its capacity."""
    return cells.withColumn("capacity", capacity(F.col("trips_per_day"), MULTIPLE, drivers_per_trip)).withColumn("fleet", F.explode(F.array(*(F.lit(f).cast("bigint") for f in fleets))))


def top_cells(cells: DataFrame, k: int) -> DataFrame:
    """The ``k`` cells of each hour that pay best."""
    rank = F.row_number().over(Window.partitionBy("dow", "hour").orderBy(F.desc_nulls_last("revenue_per_driver_hour"), "zone_id"))
    return cells.withColumn("rank", rank).where(F.col("rank") <= k)


def heap_operations(cells: DataFrame, k: int) -> DataFrame:
    """How many cells of each hour, met in the order of zone_id, are among the ``k`` best so far when they are met."""
    return (
        cells.select("dow", "hour", "zone_id", F.col("revenue_per_driver_hour").alias("v"))
        .groupBy("dow", "hour")
        .agg(F.sort_array(F.collect_list(F.struct("zone_id", "v"))).alias("c"))  # the zones of an hour
        .select("dow", "hour", F.aggregate("c", F.struct(F.lit(0).cast("bigint").alias("n"), F.array().cast("array<double>").alias("best")), lambda s, x: _offer(s, x["v"], k))["n"].alias("operations"))
    )


def _offer(state: Column, value: Column, k: int) -> Column:
    enters = (F.size(state["best"]) < k) | (value > F.get(state["best"], F.lit(0)))
    kept = F.sort_array(F.concat(state["best"], F.array(value)))
    kept = F.when(F.size(kept) > k, F.slice(kept, F.greatest(F.size(kept) - k + 1, F.lit(1)), k)).otherwise(kept)
    return F.struct((state["n"] + F.when(enters & F.lit(k > 0), 1).otherwise(0)).alias("n"), F.when(enters & F.lit(k > 0), kept).otherwise(state["best"]).alias("best"))


def _finish(df: DataFrame, policy: str) -> DataFrame:
    return df.where("drivers > 0").select(
        F.lit(policy).alias("policy"), *HOUR, "zone_id", "zone_name", "borough", "drivers", "capacity", "rank", "considered",
        (F.col("drivers") * F.col("revenue_per_driver_hour")).alias("expected_revenue"), (F.col("drivers") / F.col("capacity")).alias("utilisation"),
    )


def _fill(cells: DataFrame, by: str, policy: str) -> DataFrame:
    hour = Window.partitionBy(*HOUR)
    order = hour.orderBy(F.desc(by), "zone_id")
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cells.where(F.col(by) > 0).withColumn("considered", F.count("*").over(hour)).withColumn("rank", F.row_number().over(order)).withColumn("before", before)
    return _finish(ranked.withColumn("drivers", F.greatest(F.lit(0), F.least(F.col("capacity"), F.col("fleet") - F.col("before")))), policy)


def by_revenue(cells: DataFrame) -> DataFrame:
    """Best paid cells first, each up to its capacity."""
    return _fill(cells, "revenue_per_driver_hour", "revenue_per_hour")


def by_volume(cells: DataFrame) -> DataFrame:
    """Busiest cells first, each up to its capacity, whatever they pay."""
    return _fill(cells, "trips_per_day", "trip_volume")


def uniform(cells: DataFrame) -> DataFrame:
    """The same for every cell that pays, in the order of zone_id, regardless of capacity; what doesn't divide stays idle."""
    hour = Window.partitionBy(*HOUR)
    rows = cells.where("revenue_per_driver_hour > 0").withColumn("considered", F.count("*").over(hour)).withColumn("rank", F.row_number().over(hour.orderBy("zone_id")))
    each = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("fleet") / F.col("considered")))
    return _finish(rows.withColumn("drivers", F.greatest(F.lit(0), F.least(each, F.col("fleet") - each * (F.col("rank") - 1)))), "uniform")


PLACE = dict(zip(POLICIES, (by_revenue, by_volume, uniform), strict=True))


def assign(cells: DataFrame, fleets: Sequence[int], policies: Sequence[str] = POLICIES, drivers_per_trip: float = 1.0) -> DataFrame:
    """Assignments of all policies for all fleet sizes."""
    rows, out = with_fleets(cells, fleets, drivers_per_trip), None
    for p in policies:
        part = PLACE[p](rows)
        out = part if out is None else out.unionByName(part)
    return out


def summary(assigned: DataFrame, times: DataFrame, fleets: Sequence[int], policies: Sequence[str] = POLICIES) -> DataFrame:
    """One row for each policy, fleet and hour of the week, hours without a candidate included: all of their fleet is idle."""
    spine = times.select("dow", "hour", F.explode(F.array(*map(F.lit, policies))).alias("policy")).withColumn("fleet", F.explode(F.array(*(F.lit(f).cast("bigint") for f in fleets))))
    sums = assigned.groupBy("policy", *HOUR).agg(F.sum("drivers").alias("placed"), F.sum("expected_revenue").alias("revenue"), F.max("considered").alias("considered"), F.count("*").alias("used"))
    rows = spine.join(sums, ["policy", *HOUR], "left")
    revenue, placed = F.coalesce("revenue", F.lit(0.0)), F.coalesce("placed", F.lit(0)).cast("bigint")
    return rows.select(
        "policy", *HOUR, placed.alias("drivers_placed"), (F.col("fleet") - placed).alias("drivers_idle"), revenue.alias("expected_revenue"),
        F.coalesce("considered", F.lit(0)).cast("bigint").alias("cells_considered"), F.coalesce("used", F.lit(0)).cast("bigint").alias("cells_used"),
        F.when(F.col("fleet") > 0, revenue / F.col("fleet")).otherwise(0.0).alias("revenue_per_driver"),
    )


def day(hours: DataFrame) -> DataFrame:
    """The 24 hours of :func:`summary` summed up."""
    out = hours.groupBy("policy", "fleet", "dow").agg(F.sum("drivers_placed").alias("driver_hours_placed"), F.sum("drivers_idle").alias("driver_hours_idle"), F.sum("expected_revenue").alias("expected_revenue"))
    return out.withColumn("revenue_per_driver_day", F.when(F.col("fleet") > 0, F.col("expected_revenue") / F.col("fleet")).otherwise(0.0))


def compare(assigned: DataFrame, times: DataFrame, fleet: int) -> DataFrame:
    """All policies on the hours of ``assigned``, with how far each is from the best and its first five zones."""
    hours = summary(assigned, times, [fleet])
    first = assigned.where("rank <= 5").groupBy("policy", *HOUR).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "zone_name"))), lambda x: x["zone_name"]), "|").alias("top_zones"))
    best = F.max("shown").over(Window.partitionBy(*HOUR))
    rows = hours.withColumn("shown", F.round("expected_revenue", 2)).withColumn("best", best).join(first, ["policy", *HOUR], "left")
    lag = F.when(F.col("best") != 0, F.round(100 * (F.col("shown") - F.col("best")) / F.col("best"), 2)).otherwise(0.0)
    per_driver = F.when(F.col("fleet") > 0, F.round(F.col("expected_revenue") / F.col("fleet"), 2)).otherwise(0.0)
    return rows.select("policy", *HOUR, F.col("shown").alias("expected_revenue"), per_driver.alias("revenue_per_driver"), "cells_used", "drivers_idle", F.coalesce("top_zones", F.lit("")).alias("top_zones"), lag.alias("vs_best_pct"))

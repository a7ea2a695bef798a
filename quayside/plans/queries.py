"""All queries over the order tables, by name."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions import rounded
from quayside.operators import allocate, backtest, forecast, marts, quality, seasonal
from quayside.plans import api, warehouse
from quayside.plans.frames import FLEETS, MIN_TRIPS, Frames
from quayside.sources import load, trips

Q = Callable[[Frames], DataFrame]


def _both_tops(f: Frames) -> DataFrame:
    value, volume = (api.zones(f, order, 12, MIN_TRIPS).select("zone_name") for order in ("value", "volume"))
    return value.join(volume, "zone_name", "left_semi").agg(F.count("*").alias("shared_zones"))


def _rush_hour(f: Frames) -> DataFrame:
    return f.mart.where(F.col("dow").between(1, 5)).groupBy("hour").agg(F.sum("trips").alias("trips"))


def _band(f: Frames) -> DataFrame:
    cells = f.profile.where(F.col("total_trips") > 3)
    return cells.agg(F.min("revenue_per_driver_hour").alias("lowest"), F.max("revenue_per_driver_hour").alias("highest"), F.count("*").alias("cells"))


def _coverage(f: Frames) -> DataFrame:
    """Periods on one side only of the load's record and the mart."""
    recorded = quality.load_totals(f.marked).select("period")
    held = f.mart.select("period").distinct()
    missing = recorded.join(held, "period", "left_anti").select("period", F.lit("mart").alias("missing_in"))
    return missing.unionByName(held.join(recorded, "period", "left_anti").select("period", F.lit("record").alias("missing_in"))).unionByName(held.agg(F.lit("all").alias("period"), F.concat(F.lit("none of "), F.count("*").cast("string")).alias("missing_in")))


def _orphans(f: Frames) -> DataFrame:
    """Raw trips by pickup code that the zone table doesn't have."""
    rows = f.marked.where("pickup_zone_id is not null").join(f.zones, F.col("pickup_zone_id") == F.col("zone_id"), "left_anti")
    return rows.groupBy("pickup_zone_id").agg(F.count("*").alias("trips"))


def _zone_mean(f: Frames) -> DataFrame:
    return f.test_rows.select(*forecast.CELL, "target", F.col("zone_mean_trips").alias("prediction"))


def _month_of_file(f: Frames) -> DataFrame:
    names = f.spark.createDataFrame([("yellow_tripdata_2024-01.parquet",), ("x/yellow_tripdata_2023-12.parquet",), ("green_tripdata_2024-01.parquet",)], "file string")
    return names.select("file", trips.month_of_file(F.col("file")).alias("month"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: in spark.checkpoint.dir, or, only where Spark runs in one process, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _monthly_files(f: Frames, root: str) -> None:
    """The order tables' trips as raw files in root/raw, one for each month of orders."""
    raw = trips.order_trips(f.spark, f.folder, F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    raw.select(*(F.col(b).alias(a) for a, b, _ in trips.RAW_COLUMNS), "month").repartition("month").write.partitionBy("month").parquet(f"{root}/new")
    path = f.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(f.spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{root}/raw"))
    for s in fs.listStatus(path(f"{root}/new")):
        if (name := s.getPath().getName()).startswith("month="):
            (part,) = (x.getPath() for x in fs.listStatus(s.getPath()) if x.getPath().getName().startswith("part-"))
            fs.rename(part, path(f"{root}/raw/yellow_tripdata_{name.removeprefix('month=')}.parquet"))
    fs.delete(path(f"{root}/new"), True)


def _incremental_load(f: Frames) -> DataFrame:
    """Writes the order tables' trips as raw monthly files and loads the folder three times: fresh, unchanged, forced. One row a run
    and period."""
    root = shared_folder(f.spark, "load")
    _monthly_files(f, root)
    done = [(i, x) for i, force in enumerate((False, False, True)) for x in load.load_folder(f.spark, f"{root}/raw", f"{root}/store", force)]
    period = F.substring(F.col("period").cast("string"), 1, 7).alias("period")
    stored = {r["period"]: r["n"] for r in trips.stored_trips(f.spark, f"{root}/store/trips").groupBy(period).agg(F.count("*").alias("n")).collect()}  # a row a month
    return f.spark.createDataFrame([(i, x.period, x.skipped, x.source_rows, x.loaded_rows, x.excluded_rows, stored.get(x.period, 0)) for i, x in done], "run int, period string, skipped boolean, source_rows long, loaded_rows long, excluded_rows long, stored_rows long")


def _raw_files(f: Frames) -> DataFrame:
    """Stored trips of two months, read from raw files, loaded, and read again by partition."""
    root = shared_folder(f.spark, "raw")
    _monthly_files(f, root)
    load.load_folder(f.spark, f"{root}/raw", f"{root}/store", months=["1996-03", "1997-01"])
    stored = trips.stored_trips(f.spark, f"{root}/store/trips", ["1997-01"])
    return trips.fact_trips(stored).groupBy(F.col("period").cast("string").alias("period"), "dow", "pickup_hour").agg(F.count("*").alias("trips"), F.sum("fare_total").alias("revenue"), F.sum("duration_hours").alias("driver_hours"))


def _csv_zones(f: Frames) -> DataFrame:
    """The zone table written as a lookup CSV, with two codes that stand for no place, and read again."""
    root = shared_folder(f.spark, "zones")
    rows = f.zones.select(F.col("zone_id").alias("LocationID"), F.col("borough").alias("Borough"), F.col("zone_name").alias("Zone"), "service_zone")
    more = f.spark.createDataFrame([(x, "Unknown", "N/A", "N/A") for x in trips.UNKNOWN_ZONES], rows.schema)
    rows.unionByName(more).write.csv(root, header=True)
    return trips.read_zones(f.spark, root)


def _stored_warehouse(f: Frames) -> DataFrame:
    """All tables stored and read again: rows of each, and trips of those that count them."""
    stored, report = warehouse.build(f, shared_folder(f.spark, "warehouse"), trips.UNKNOWN_NATIONS)
    sums = {n: (stored.table(n).agg(F.sum(c)).first()[0]) for n, c in (("mart_demand", "trips"), ("mart_demand_profile", "total_trips"), ("mart_zone_summary", "trips"), ("mart_hourly_profile", "trips"), ("mart_monthly", "trips"))}
    return f.spark.createDataFrame([(n, r["rows"], sums.get(n)) for n, r in report["tables"].items()], "name string, rows long, trips long")


def _importance(f: Frames) -> DataFrame:
    found = forecast.importances(forecast.fit(f.train_rows))
    return f.spark.createDataFrame(list(found.items()), "feature string, importance double")


def _hour_of(f: Frames, policy: str) -> DataFrame:
    return allocate.assign(f.serving.where("dow = 4 and hour = 18"), [10], [policy])


TABLE: dict[str, Q] = {
    "scan_trips": lambda f: f.marked.groupBy("period").agg(F.count("*").alias("rows"), F.count("dropoff_ts").alias("with_dropoff"), F.min("pickup_ts").cast("string").alias("first_pickup")),
    "dim_zone": lambda f: f.zones,
    "dim_time": lambda f: f.times,
    "quality_rules": lambda f: quality.documentation(f.spark, quality.YEAR_RULES).select("position", "rule"),
    "quality_breakdown": lambda f: quality.breakdown(f.marked),
    "load_summary": lambda f: quality.load_totals(f.marked),
    "fact_trip": lambda f: f.fact.select("pickup_zone_id", "dropoff_zone_id", "passengers", "distance_mi", "fare_total", "fare_base", "tip", "duration_sec", "duration_hours", "pickup_hour", F.col("pickup_date").cast("string").alias("pickup_date"), "dow", "hour_of_week", "period"),
    "fact_trip_months": lambda f: f.fact.where(F.col("period").isin("Y1996", "Y1998")).groupBy("period").agg(F.count("*").alias("trips"), F.sum("fare_total").alias("revenue")),
    "mart_demand": lambda f: f.mart,
    "mart_demand_profile": lambda f: f.profile,
    "mart_zone_summary": lambda f: marts.zone_summary(f.mart),
    "mart_hourly_profile": lambda f: marts.hourly_profile(f.mart),
    "mart_monthly": lambda f: marts.by_period(f.mart),
    "reconciliation": lambda f: marts.checks(f.fact, f.mart, f.zones, f.times, trips.UNKNOWN_NATIONS),
    "cell_mart": lambda f: marts.cell_mart(f.fact, f.zones),
    "cell_mart_totals": lambda f: marts.cell_totals(marts.cell_mart(f.fact, f.zones)),
    "fact_totals": lambda f: marts.fact_totals(f.fact),
    "zones_by_value": lambda f: api.zones(f, "value", 12, MIN_TRIPS),
    "zones_by_volume": lambda f: api.zones(f, "volume", 12),
    "volume_value_overlap": _both_tops,
    "top_cells": lambda f: marts.top(marts.cell_mart(f.fact, f.zones).where("trips > 5"), "revenue_per_driver_hour", 10, "zone_id", "dow", "hour").select("zone_id", "dow", "hour", "trips", "revenue_per_driver_hour"),
    "heatmap": lambda f: api.heatmap(f),
    "heatmap_borough": lambda f: api.heatmap(f, "mean_trips_per_day", "ASIA"),
    "boroughs": api.boroughs,
    "split_months": lambda f: f.parts,
    "train_cells": lambda f: f.train_cells,
    "realised_rates": lambda f: f.realised,
    "serving_cells": lambda f: f.serving,
    "cell_capacity": lambda f: f.serving.select("zone_id", "dow", "hour", allocate.capacity(F.col("trips_per_day")).alias("capacity")),
    "topk_cells": lambda f: allocate.top_cells(f.serving, 5).select("dow", "hour", "rank", "zone_id", "revenue_per_driver_hour"),
    "heap_operations": lambda f: allocate.heap_operations(f.serving, 5),
    "allocate_hour": lambda f: _hour_of(f, "revenue_per_hour"),
    "allocate_volume": lambda f: _hour_of(f, "trip_volume"),
    "allocate_uniform": lambda f: _hour_of(f, "uniform"),
    "allocation_summary": lambda f: allocate.summary(f.assigned((10,)), f.times, (10,)),
    "allocate_day": lambda f: allocate.day(allocate.summary(f.assigned((10,)), f.times, (10,))),
    "compare_policies": lambda f: api.compare(f, 10, 18, 4),
    "score": lambda f: backtest.score(allocate.assign(f.train_cells, [10]), f.realised),
    "backtest": lambda f: backtest.backtest(f.train_cells, f.realised, FLEETS),
    "backtest_lift": lambda f: backtest.lift(backtest.backtest(f.train_cells, f.realised, FLEETS)),
    "hourly_series": lambda f: marts.hourly_profile(f.mart).select("hour_of_week", "trips"),
    "moving_average": lambda f: seasonal.moving_average(seasonal.moving_average(f.series, 24), 7, "trend_odd"),
    "decompose": lambda f: seasonal.decompose(f.series, 168),
    "seasonal_strength": lambda f: seasonal.strength(seasonal.decompose(f.series, 24)),
    "hour_of_week_profile": lambda f: seasonal.week_profile(f.series).drop("residual_sd"),
    "cyclical_features": lambda f: f.times.select("hour_of_week", *(c.alias(n) for c, n in zip((*forecast.cyclic(F.col("hour"), 24), *forecast.cyclic(F.col("dow"), 7)), forecast.FEATURES, strict=False))),
    "forecast_features": lambda f: f.test_rows,
    "feature_matrix": lambda f: forecast.matrix(f.test_rows),
    "baseline_forecast": lambda f: f.predicted,
    "forecast_metrics": lambda f: forecast.metrics(f.predicted, "historical_cell_mean"),
    "forecast_verdict": lambda f: forecast.verdict(forecast.metrics(f.predicted, "historical_cell_mean"), forecast.metrics(_zone_mean(f), "zone_mean")),
    "rush_hour": _rush_hour,
    "rph_band": _band,
    "period_coverage": _coverage,
    "orphan_zones": _orphans,
    "gbt_forecast": lambda f: forecast.boosted(f.train_rows, f.test_rows),
    "gbt_verdict": lambda f: forecast.verdict(forecast.metrics(f.predicted, "historical_cell_mean"), forecast.metrics(forecast.boosted(f.train_rows, f.test_rows), "boosted")),
    "month_of_file": _month_of_file,
    "incremental_load": _incremental_load,
    "stored_month": _raw_files,
    "csv_zones": _csv_zones,
    "stored_warehouse": _stored_warehouse,
    "feature_importance": _importance,
    "health": api.health,
    "capacity_two_drivers": lambda f: f.serving.select("zone_id", "dow", "hour", allocate.capacity(F.col("trips_per_day"), 1.5, 2.0).alias("capacity")),
}


def _query(build: Q) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: rounded(build(Frames(spark, folder)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(build) for name, build in TABLE.items()}

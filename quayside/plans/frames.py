"""The engine's tables over a data folder, as lazy plans."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from quayside.operators import allocate, backtest, forecast, marts, quality, seasonal
from quayside.sources import trips

#: Parameters that fit the order tables: cells there have a few trips only.
FLEETS, MIN_TRIPS = (5, 10, 20, 40), 100


class Frames:
    """Tables from raw trips on, each built from the ones before when first asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    @cached_property
    def zones(self) -> DataFrame:
        return trips.order_zones(self.spark, self.folder)

    @cached_property
    def times(self) -> DataFrame:
        return trips.time_spine(self.spark)

    @cached_property
    def marked(self) -> DataFrame:
        return quality.classify(trips.order_trips(self.spark, self.folder), quality.YEAR_RULES)

    @cached_property
    def fact(self) -> DataFrame:
        return trips.fact_trips(trips.clean_columns(quality.good(trips.order_trips(self.spark, self.folder), quality.YEAR_RULES)))

    @cached_property
    def mart(self) -> DataFrame:
        return marts.demand(self.fact, self.zones, self.times)

    @cached_property
    def profile(self) -> DataFrame:
        return marts.profile(self.mart)

    @cached_property
    def parts(self) -> DataFrame:
        return backtest.split(trips.order_trips(self.spark, self.folder).select("period").distinct())

    @cached_property
    def train(self) -> DataFrame:
        return backtest.part_of(self.mart, self.parts, "train")

    @cached_property
    def test(self) -> DataFrame:
        return backtest.part_of(self.mart, self.parts, "test")

    @cached_property
    def train_cells(self) -> DataFrame:
        return backtest.train_cells(self.train)

    @cached_property
    def realised(self) -> DataFrame:
        return backtest.realised_rates(self.test)

    @cached_property
    def serving(self) -> DataFrame:
        """Cells to allocate from: those of the profile that pay."""
        cells = self.profile.where("revenue_per_driver_hour > 0")
        return cells.selectExpr("zone_id", "zone_name", "borough", "dow", "hour", "mean_trips_per_day AS trips_per_day", "revenue_per_driver_hour")

    @cached_property
    def series(self) -> DataFrame:
        return seasonal.repeated(marts.hourly_profile(self.mart))

    @cached_property
    def train_rows(self) -> DataFrame:
        return forecast.features(self.train, self.train)

    @cached_property
    def test_rows(self) -> DataFrame:
        return forecast.features(self.test, self.train)

    @cached_property
    def predicted(self) -> DataFrame:
        return forecast.baseline(self.train_rows, self.test_rows)

    def assigned(self, fleets: tuple[int, ...], *policies: str) -> DataFrame:
        return allocate.assign(self.serving, fleets, policies or allocate.POLICIES)

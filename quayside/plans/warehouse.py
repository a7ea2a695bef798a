"""The engine's tables on disk: written once from trips, checked, and served from then on."""

from __future__ import annotations

import time
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from quayside.operators import marts
from quayside.plans.frames import Frames

#: Tables that are stored, in the order in which they are built; what needs the trips themselves comes before what doesn't.
TABLES = {
    "dim_zone": lambda f: f.zones,
    "dim_time": lambda f: f.times,
    "mart_demand": lambda f: f.mart,
    "mart_demand_profile": lambda f: f.profile,
    "mart_zone_summary": lambda f: marts.zone_summary(f.mart),
    "mart_hourly_profile": lambda f: marts.hourly_profile(f.mart),
    "mart_monthly": lambda f: marts.by_period(f.mart),
}


class Stored(Frames):
    """Frames over tables that :func:`build` has stored; trips come from ``source``, the frames that they were built from."""

    def __init__(self, spark: SparkSession, root: str, source: Frames) -> None:
        super().__init__(spark, source.folder)
        self.root, self.source = root, source

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    zones = cached_property(lambda self: self.table("dim_zone"))
    times = cached_property(lambda self: self.table("dim_time"))
    mart = cached_property(lambda self: self.table("mart_demand"))
    profile = cached_property(lambda self: self.table("mart_demand_profile"))
    marked = property(lambda self: self.source.marked)
    fact = property(lambda self: self.source.fact)


def build(source: Frames, root: str, unknown: tuple[int, ...], force: bool = True) -> tuple[Stored, dict]:
    """Store all tables of ``source`` under ``root``, each from those stored before it, name fact_trip as a view over the trips, and
    check that the marts tie back to them. Returns the stored frames and a report: seconds and rows by table, and the checks.

    Raises :class:`quayside.operators.marts.ReconciliationError` if a check fails and ``force`` isn't False.
    """
    stored, report = Stored(source.spark, root, source), {}
    for name, make in TABLES.items():
        began = time.time()
        frames = source if name in ("dim_zone", "dim_time") else stored
        if name == "mart_demand":
            rows = marts.demand(source.fact, stored.zones, stored.times)
        elif name == "mart_demand_profile":
            rows = marts.profile(stored.mart)
        else:
            rows = make(frames)
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{name}")
        report[name] = {"seconds": round(time.time() - began, 3), "rows": stored.table(name).count()}
    source.fact.createOrReplaceTempView("fact_trip")
    checks = marts.checks(source.fact, stored.mart, stored.zones, stored.times, unknown)
    found = [r.asDict() for r in checks.collect()]  # nine rows
    if force:
        marts.gate(source.spark.createDataFrame([tuple(x.values()) for x in found], checks.schema))
    totals = marts.cell_totals(stored.profile.selectExpr("total_trips AS trips", "total_revenue AS revenue", "total_driver_hours AS driver_hours")).first().asDict()
    return stored, {"tables": report, "checks": found, "all_checks_passed": all(x["passed"] for x in found), "totals": totals}

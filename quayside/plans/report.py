"""What a run found, as JSON documents: the summary and the backtest. Both are small, a few hundred numbers."""

from __future__ import annotations

from quayside.operators import backtest, forecast, marts, quality, seasonal
from quayside.plans import api
from quayside.plans.frames import FLEETS, MIN_TRIPS, Frames


def _rows(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def backtest_report(frames: Frames, fleets: tuple[int, ...] = FLEETS) -> dict:
    """Realised revenue by policy and fleet, the lift of the value-ranked policy, and which periods were planned on and which scored."""
    results = frames.spark.createDataFrame(backtest.backtest(frames.train_cells, frames.realised, fleets).collect())  # a row a policy and fleet
    parts = _rows(frames.parts.orderBy("period"))
    lifts = _rows(backtest.lift(results).orderBy("fleet"))
    return {
        "train_periods": [x["period"] for x in parts if x["part"] == "train"], "test_periods": [x["period"] for x in parts if x["part"] == "test"],
        "results": _rows(results.orderBy("fleet", "policy")), "lift": [{k: v for k, v in x.items() if k != "mean_lift_pct"} for x in lifts], "mean_lift_pct": lifts[0]["mean_lift_pct"] if lifts else None,
    }


def summary(frames: Frames, unknown: tuple[int, ...], rounds: int = 300, top: int = 12, min_trips: int = MIN_TRIPS) -> dict:
    """Volumes, reconciliation, forecast against its baseline, the week's cycle, and zones by volume and by value."""
    loads = _rows(quality.load_totals(frames.marked).orderBy("period"))
    source, loaded = (sum(x[k] for x in loads) for k in ("source_rows", "loaded_rows"))
    checks = _rows(marts.checks(frames.fact, frames.mart, frames.zones, frames.times, unknown))
    volume, value = (_rows(api.zones(frames, order, top, min_trips)) for order in ("volume", "value"))
    week = _rows(seasonal.week_profile(frames.series))
    return {
        "data": {"periods": len(loads), "source_rows": source, "loaded_rows": loaded, "excluded_pct": round(100 * (source - loaded) / source, 4) if source else 0.0}
        | marts.cell_totals(marts.cell_mart(frames.fact, frames.zones)).select("revenue", "driver_hours", "cells").first().asDict(),
        "reconciliation": {"checks": len(checks), "all_passed": all(x["passed"] for x in checks)},
        "forecast": forecast.evaluate(frames.train_rows, frames.test_rows, rounds), "seasonal": week[0] if week else None,
        "zones_by_volume": volume, "zones_by_value": value, "shared_zones": len({x["zone_id"] for x in volume} & {x["zone_id"] for x in value}),
    }

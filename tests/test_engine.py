"""Properties of the demand and fleet operators on small tables."""

import datetime as dt
import inspect
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quayside import cli, registry
from quayside.operators import allocate, backtest, forecast, marts, quality, seasonal
from quayside.plans import api, queries
from quayside.plans.frames import Frames
from quayside.sources import load, trips
from quayside.streaming import loader


def test_quality_rules(spark):
    t = dt.datetime(2024, 1, 5, 10)
    good = dict(pickup_ts=t, dropoff_ts=t + dt.timedelta(seconds=600), pickup_zone_id=1, dropoff_zone_id=2, passengers=1, distance_mi=2.0, fare_total=10.0)
    cases = [({}, "ok"), ({"dropoff_ts": None}, "null_timestamps"), ({"pickup_ts": dt.datetime(2023, 1, 1)}, "wrong_month"), ({"dropoff_ts": t}, "negative_duration")]
    cases += [({"dropoff_ts": t + dt.timedelta(seconds=s)}, x) for s, x in ((60, "ok"), (21600, "ok"), (59, "implausible_duration"), (21601, "implausible_duration"))]
    cases += [({"pickup_zone_id": 264}, "unknown_zone"), ({"dropoff_zone_id": 265, "fare_total": 1.0}, "unknown_zone"), ({"pickup_zone_id": None}, "ok")]
    cases += [({"distance_mi": d}, x) for d, x in ((0.1, "ok"), (100.0, "ok"), (0.09, "implausible_distance"), (100.01, "implausible_distance"), (None, "ok"))]
    cases += [({"fare_total": f}, x) for f, x in ((2.5, "ok"), (1000.0, "ok"), (2.49, "non_positive_fare"), (1000.01, "implausible_fare"), (None, "ok"))]
    cases += [({"passengers": p}, x) for p, x in ((None, "ok"), (0, "ok"), (6, "ok"), (7, "implausible_passengers"))]
    schema = "i int, pickup_ts timestamp_ntz, dropoff_ts timestamp_ntz, pickup_zone_id int, dropoff_zone_id int, passengers int, distance_mi double, fare_total double, period_start date"
    rows = [(i, *{**good, **change}.values(), dt.date(2024, 1, 1)) for i, (change, _) in enumerate(cases)]
    got = {r["i"]: r["status"] for r in quality.classify(spark.createDataFrame(rows, schema), quality.MONTH_RULES).collect()}
    assert [got[i] for i in range(len(cases))] == [x for _, x in cases]


def test_time_spine_and_names(spark):
    spine = trips.time_spine(spark)
    assert spine.count() == spine.select("hour_of_week").distinct().count() == 168
    assert trips.month_of("a/yellow_tripdata_2024-03.parquet") == "2024-03"
    with pytest.raises(ValueError):
        trips.month_of("green.parquet")


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(i, f"z{i}", "b", 1, 9, 0.01 + i % 7 * 3.0, float(50 if i < 10 else i)) for i in range(30)] + [(40, "dead", "b", 1, 9, 50.0, 0.0)]
    return spark.createDataFrame(rows, "zone_id int, zone_name string, borough string, dow int, hour int, trips_per_day double, revenue_per_driver_hour double")


def test_allocation_conserves_the_fleet(spark, cells):
    fleets = (1, 10, 1000)
    placed = allocate.assign(cells, fleets)
    hours = allocate.summary(placed, trips.time_spine(spark), fleets).collect()
    assert len(hours) == 168 * 3 * 3
    assert all(r["drivers_placed"] + r["drivers_idle"] == r["fleet"] for r in hours)
    assert all(r["drivers_idle"] == r["fleet"] for r in hours if (r["dow"], r["hour"]) != (1, 9))
    assert placed.where("policy != 'uniform' and drivers > capacity").count() == 0
    assert placed.where("policy = 'revenue_per_hour' and zone_id = 40").count() == 0
    first = placed.where("policy = 'trip_volume' and fleet = 1").collect()
    assert [r["zone_id"] for r in first] == [40]
    order = [r["zone_id"] for r in allocate.top_cells(cells, 30).orderBy("rank").collect()]
    assert order.index(0) < order.index(1) < order.index(2)


def test_split(spark):
    for n, tests in ((2, 1), (4, 1), (6, 2), (10, 2), (12, 3), (14, 4)):
        rows = spark.createDataFrame([(f"m{i:02}",) for i in range(n)], "period string")
        assert backtest.split(rows).where("part = 'test'").count() == tests
    with pytest.raises(Exception, match="two periods"):
        backtest.split(spark.createDataFrame([("a",)], "period string")).collect()


def test_seasonal(spark):
    rows = [("s", i, 100.0 + (10.0 if i % 24 == 5 else 0.0)) for i in range(144)]
    series = spark.createDataFrame(rows, "series_id string, i long, observed double")
    parts = seasonal.decompose(series, 24)
    assert abs(parts.where("i < 24").agg(F.sum("seasonal")).first()[0]) < 1e-9
    assert parts.orderBy(F.desc("seasonal"), "i").first()["i"] == 5
    three = [r["trend"] for r in seasonal.moving_average(series.where("i < 5"), 3).orderBy("i").collect()]
    assert three[0] is None and three[-1] is None and three[2] is not None
    with pytest.raises(Exception, match="two full periods"):
        seasonal.decompose(series.where("i < 10"), 24).collect()


def test_forecast(spark):
    kind = "zone_id int, dow int, hour int, target double"
    train = spark.createDataFrame([(1, 0, 0, 10.0), (1, 0, 0, 20.0), (2, 0, 0, 30.0)], kind)
    test = spark.createDataFrame([(1, 0, 0, 0.0), (1, 1, 1, 10.0), (9, 0, 0, 20.0)], kind)
    got = forecast.baseline(train, test)
    assert [r["prediction"] for r in got.orderBy("zone_id", "dow").collect()] == [15.0, 15.0, 20.0]
    m = forecast.metrics(got, "x").first()
    assert m["n"] == 3 and abs(m["mape"] - 25.0) < 1e-9


def test_ratio_of_sums(spark):
    rows = [(1, "z", "b", "s", False, 0, 0, 0, "d", p, n, r, h, 1.0, 1.0) for p, n, r, h in (("a", 3, 300.0, 1.0), ("b", 30000, 3000.0, 100.0))]
    kind = "zone_id int, zone_name string, borough string, service_zone string, is_airport boolean, dow int, hour int, hour_of_week int, daypart string, period string, trips long, revenue double, driver_hours double, trips_per_day double, revenue_per_day double"
    assert abs(marts.profile(spark.createDataFrame(rows, kind)).first()["revenue_per_driver_hour"] - 3300 / 101) < 1e-9


def test_incremental_load_takes_every_month(spark):
    folder = "/root/testdata/sf0.001"
    got = registry.queries()["incremental_load"](spark, folder).collect()
    rows = trips.order_trips(spark, folder, F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    want = {r["month"]: (r["n"], r["late"]) for r in rows.groupBy("month").agg(F.count("*").alias("n"), F.count_if(F.date_format("pickup_ts", "yyyy-MM") != F.col("month")).alias("late")).collect()}
    assert len(want) > 12 and len(got) == 3 * len(want)
    for r in got:
        n, late = want[r["period"]]
        assert r["skipped"] == (r["run"] == 1) and r["source_rows"] == n == r["loaded_rows"] + r["excluded_rows"]
        assert r["stored_rows"] == r["loaded_rows"] and r["excluded_rows"] >= late
    assert sum(late for _, late in want.values()) > 0


def test_boosted_model_has_its_rounds_and_is_judged(spark, monkeypatch):
    kind, seen = "zone_id int, dow int, hour int, target double, prediction double", []

    def boosted(train, test, rounds=inspect.signature(forecast.boosted).parameters["rounds"].default, **_):
        seen.append(rounds)
        return spark.createDataFrame([(1, 0, 0, 10.0, 10.0), (2, 0, 0, 20.0, 19.0)], kind)

    monkeypatch.setattr(forecast, "boosted", boosted)
    f = SimpleNamespace(train_rows=None, test_rows=None, predicted=spark.createDataFrame([(1, 0, 0, 10.0, 14.0), (2, 0, 0, 20.0, 20.0)], kind))
    queries.TABLE["gbt_forecast"](f)
    got = queries.TABLE["gbt_verdict"](f).first()
    assert min(seen) >= 20 and len(seen) == 2
    assert (got["baseline_mae"], got["model_mae"], got["beats_baseline"]) == (2.0, 0.5, True)


@pytest.mark.parametrize("name", ["fact_totals", "mart_demand", "quality_breakdown", "reconciliation"])
def test_generated_methods_are_small_enough_to_be_compiled(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
        package = spark._jvm.org.apache.spark.sql.execution.debug
        code = getattr(getattr(package, "package$"), "MODULE$").codegenString(plan)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000  # beyond it, the JVM interprets a method for good


def test_good_rows_are_those_of_status_ok(spark):
    rows = trips.order_trips(spark, "/root/testdata/sf0.001")
    marked = quality.classify(rows, quality.YEAR_RULES).where("status = 'ok'").drop("status")
    kept = quality.good(rows, quality.YEAR_RULES)
    assert kept.count() > 1000 and kept.exceptAll(marked).count() == marked.exceptAll(kept).count() == 0


def _raw(spark, path, month, n, bad=0, fare="double", **change):
    """A raw file of n trips, of which the first ``bad`` have no distance to speak of."""
    rows = spark.range(n).select(
        (F.lit(f"{month}-03 10:00:00").cast("timestamp_ntz")).alias("tpep_pickup_datetime"), (F.lit(f"{month}-03 10:20:00").cast("timestamp_ntz")).alias("tpep_dropoff_datetime"),
        F.lit(1).alias("PULocationID"), F.lit(2).alias("DOLocationID"), F.lit(1).cast(fare).alias("passenger_count"), F.when(F.col("id") < bad, 0.0).otherwise(3.0).alias("trip_distance"),
        F.lit(change.get("total", 20.0)).alias("total_amount"), F.lit(18.0).alias("fare_amount"), F.lit(2.0).alias("tip_amount"), F.lit("x").alias("unused"),
    )
    file = f"{path}/yellow_tripdata_{month}.parquet"
    rows.toPandas().to_parquet(file, coerce_timestamps="us")
    return file


def test_load_skips_forces_and_finds_files_changed_in_place(spark, tmp_path):
    raw, root = tmp_path / "raw", f"{tmp_path}/store"
    raw.mkdir()
    for month, n, bad, kind in (("2024-01", 30, 3, "double"), ("2024-02", 20, 0, "long"), ("2024-03", 10, 10, "double")):
        _raw(spark, raw, month, n, bad, kind)
    first = load.load_folder(spark, str(raw), root)
    assert [(x.period, x.skipped, x.source_rows, x.loaded_rows, x.excluded_rows) for x in first] == [("2024-01", False, 30, 27, 3), ("2024-02", False, 20, 20, 0), ("2024-03", False, 10, 0, 10)]
    assert load.load_summary(first) == {"periods": 3, "skipped": 0, "source_rows": 60, "loaded_rows": 47, "excluded_rows": 13, "excluded_pct": 21.6667}
    assert all(x.skipped for x in load.load_folder(spark, str(raw), root))
    counts = lambda: {r["period"]: r["count"] for r in trips.stored_trips(spark, f"{root}/trips").groupBy(F.substring(F.col("period").cast("string"), 1, 7).alias("period")).count().collect()}
    assert counts() == {"2024-01": 27, "2024-02": 20}
    # a file that changes in place, to one without a good row
    _raw(spark, raw, "2024-01", 12, 12)
    again = load.load_folder(spark, str(raw), root)
    assert [x.skipped for x in again] == [False, True, True] and again[0].loaded_rows == 0
    assert counts() == {"2024-02": 20}
    assert not any(x.skipped for x in load.load_folder(spark, str(raw), root, force=True)) and counts() == {"2024-02": 20}
    assert {r["period"] for r in load.read_watermark(spark, root).collect()} == {"2024-01", "2024-02", "2024-03"}
    assert [x.period for x in load.load_folder(spark, str(raw), root, months=1)] == ["2024-01"]
    with pytest.raises(FileNotFoundError):
        load.load_folder(spark, str(tmp_path), root)


def test_a_load_that_breaks_off_is_made_good(spark, tmp_path, monkeypatch):
    raw, root = tmp_path / "raw", f"{tmp_path}/store"
    raw.mkdir()
    file = _raw(spark, raw, "2024-05", 8)
    load.load_file(spark, file, root)
    monkeypatch.setattr(load, "clean_columns", lambda df: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        load.load_file(spark, file, root, force=True)
    monkeypatch.undo()
    assert not load.load_file(spark, file, root).skipped and trips.stored_trips(spark, f"{root}/trips").count() == 8


def test_partitions_are_pruned_and_columns_too(spark, tmp_path):
    raw, root = tmp_path / "raw", f"{tmp_path}/store"
    raw.mkdir()
    for month in ("2024-01", "2024-02"):
        _raw(spark, raw, month, 5)
    load.load_folder(spark, str(raw), root)
    plan = trips.stored_trips(spark, f"{root}/trips", ["2024-02"]).select("fare_total")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "period" in plan.split("PartitionFilters: [")[1].split("]")[0] and "ReadSchema: struct<fare_total:double>" in plan
    one = trips.read_trips(spark, f"{raw}/yellow_tripdata_2024-01.parquet")
    assert one.count() == 5 and "unused" not in one.columns


def test_stream_loads_what_is_new(spark, tmp_path):
    raw, root = tmp_path / "raw", f"{tmp_path}/store"
    raw.mkdir()
    for month in ("2024-01", "2024-02"):
        _raw(spark, raw, month, 5)
        loader.load_stream(spark, str(raw), root, f"{tmp_path}/check").awaitTermination()
    assert {r["period"] for r in load.read_watermark(spark, root).collect()} == {"2024-01", "2024-02"}


def test_gate(spark):
    kind = "check_name string, left_value double, right_value double, passed boolean"
    marts.gate(spark.createDataFrame([("a", 1.0, 1.0, True)], kind))
    with pytest.raises(marts.ReconciliationError, match="b, c"):
        marts.gate(spark.createDataFrame([("a", 1.0, 1.0, True), ("b", 1.0, 2.0, False), ("c", None, 2.0, None)], kind))


def test_serving_functions_refuse_bad_parameters(spark):
    f = Frames(spark, "/root/testdata/sf0.001")
    for call in (lambda: api.heatmap(f, "x"), lambda: api.allocate(f, 0), lambda: api.allocate(f, 20_001), lambda: api.allocate(f, hour=24), lambda: api.allocate(f, dow=7), lambda: api.allocate(f, policy="x"), lambda: api.compare(f, dow=-1)):
        with pytest.raises(ValueError):
            call()
    assert api.allocate(f, 40, 18, 4, limit=3).count() <= 3 and api.health(f).first()["cells"] > 0


def test_reports_are_written_and_served(spark, tmp_path, monkeypatch):
    with pytest.raises(LookupError):
        api.summary(spark, str(tmp_path))
    fit = forecast.fit
    monkeypatch.setattr(forecast, "fit", lambda train, rounds=20, seed=7: fit(train, min(rounds, 2), seed))
    assert cli.main(["report", "/root/testdata/sf0.001", str(tmp_path)], spark) == 0
    got = api.summary(spark, str(tmp_path))
    assert got["data"]["source_rows"] > got["data"]["loaded_rows"] > 0 and got["reconciliation"] == {"checks": 9, "all_passed": True}
    assert got["forecast"]["verdict"] in ("model", "baseline") and abs(sum(got["forecast"]["feature_importance"].values()) - 1) < 1e-6
    assert got["forecast"]["model"]["n"] == got["forecast"]["baseline"]["n"] == got["forecast"]["test_rows"]
    assert 0 < len(got["zones_by_volume"]) <= 12 and got["seasonal"]["period"] == 168
    back = api.backtest(spark, str(tmp_path))
    assert len(back["results"]) == 12 and len(back["lift"]) == 4 and back["test_periods"] and back["test_periods"][0] > back["train_periods"][-1]


def test_command_line_loads_and_verifies(spark, tmp_path, capsys):
    raw, store = tmp_path / "raw", f"{tmp_path}/store"
    raw.mkdir()
    for month in ("2024-01", "2024-02"):
        _raw(spark, raw, month, 6, 1)
    (tmp_path / "zones.csv").write_text("LocationID,Borough,Zone,service_zone\n1,Queens,Astoria,Boro Zone\n2,EWR,Newark,EWR\n264,Unknown,N/A,N/A\n")
    assert cli.main(["load", str(raw), store], spark) == 0 and "2024-02 6 read, 5 kept, 1 left out\n" in capsys.readouterr().out
    assert cli.main(["load", str(raw), store, "--months", "1"], spark) == 0 and ", unchanged" in capsys.readouterr().out
    assert cli.main(["totals", store, f"{tmp_path}/zones.csv", "--verify", "--top", "1"], spark) == 0
    out = capsys.readouterr().out
    assert "Astoria" in out and '"trips": 10' in out and "totals agree" in out
    assert cli.main(["totals", store, f"{tmp_path}/zones.csv", "--months", "1"], spark) == 0 and '"trips": 5' in capsys.readouterr().out


def test_capacity_scales_with_drivers_per_trip(spark):
    row = spark.createDataFrame([(40.0,)], "t double").select(allocate.capacity(F.col("t")).alias("a"), allocate.capacity(F.col("t"), 1.5, 2.0).alias("b"), allocate.capacity(F.lit(0.0), 1.5, 9.0).alias("c")).first()
    assert tuple(row) == (60, 120, 1)

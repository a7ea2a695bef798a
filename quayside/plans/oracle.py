"""The same queries in SQL for another engine, each a selection over shared common table expressions."""

from __future__ import annotations

#: Stated here once more and not taken from the engine, which this SQL is to check.
DAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
FLEETS, MIN_TRIPS = (5, 10, 20, 40), 100

_PLACE = "zone_id, zone_name, borough, service_zone, is_airport"
_RPH = "SUM(revenue) / NULLIF(SUM(driver_hours), 0)"
_DAY_ROWS = ", ".join(f"({i}, '{d}')" for i, d in enumerate(DAYS))

_TABLES = f"""
dim_zone AS (
  SELECT n_nationkey AS zone_id, n_name AS zone_name, r_name AS borough, CASE WHEN n_nationkey % 8 = 0 THEN 'Airports' ELSE 'Boro Zone' END AS service_zone, n_nationkey % 8 = 0 AS is_airport
  FROM nation JOIN region ON n_regionkey = r_regionkey),
dim_time AS (
  SELECT dow, dow_name, hour, dow * 24 + hour AS hour_of_week, dow IN (0, 6) AS is_weekend,
    CASE WHEN hour BETWEEN 6 AND 9 THEN 'morning_peak' WHEN hour BETWEEN 10 AND 15 THEN 'midday' WHEN hour BETWEEN 16 AND 19 THEN 'evening_peak' WHEN hour >= 20 THEN 'evening' ELSE 'overnight' END AS daypart
  FROM (VALUES {_DAY_ROWS}) AS d(dow, dow_name), (SELECT unnest(range(0, 24)) AS hour)),
lines AS (
  SELECT *, 'Y' || year(o_orderdate) AS period, (l_partkey * 97 + l_orderkey * 13) % 22500 - 300 AS lasts,
    o_orderdate + to_seconds((l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 86400 + CASE WHEN l_orderkey % 211 = 0 THEN 400 * 86400 ELSE 0 END) AS pickup_ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey),
raw AS (
  SELECT period, year(o_orderdate) AS period_year, pickup_ts, CASE WHEN l_partkey % 500 <> 0 THEN pickup_ts + to_seconds(lasts) END AS dropoff_ts,
    CASE WHEN l_orderkey % 97 = 0 THEN 25 ELSE s_nationkey END AS pickup_zone_id, CASE WHEN l_orderkey % 89 = 0 THEN 26 ELSE c_nationkey END AS dropoff_zone_id,
    CASE WHEN l_linenumber = 7 AND l_partkey % 5 = 0 THEN 7 WHEN l_linenumber <> 7 THEN l_linenumber - 1 END AS passengers, (l_quantity - 1) * 2.05::DOUBLE AS distance_mi,
    l_extendedprice * (1 - l_discount) / 100 - 10 AS fare_total, l_extendedprice / 100 AS fare_base, l_extendedprice * l_tax / 100 AS tip
  FROM lines),
marked AS (
  SELECT *, CASE WHEN pickup_ts IS NULL OR dropoff_ts IS NULL THEN 'null_timestamps' WHEN year(pickup_ts) <> period_year THEN 'wrong_month' WHEN dropoff_ts <= pickup_ts THEN 'negative_duration'
    WHEN date_diff('second', pickup_ts, dropoff_ts) < 60 OR date_diff('second', pickup_ts, dropoff_ts) > 21600 THEN 'implausible_duration'
    WHEN pickup_zone_id IN (25, 26) OR dropoff_zone_id IN (25, 26) THEN 'unknown_zone' WHEN distance_mi < 0.1 OR distance_mi > 100.0 THEN 'implausible_distance' WHEN fare_total < 2.5 THEN 'non_positive_fare'
    WHEN fare_total > 1000 THEN 'implausible_fare' WHEN passengers > 6 THEN 'implausible_passengers' ELSE 'ok' END AS status
  FROM raw),
fact AS (
  SELECT pickup_zone_id, dropoff_zone_id, passengers, distance_mi, fare_total, fare_base, tip, date_diff('second', pickup_ts, dropoff_ts) AS duration_sec, date_diff('second', pickup_ts, dropoff_ts) / 3600.0::DOUBLE AS duration_hours,
    CAST(hour(pickup_ts) AS INTEGER) AS pickup_hour, CAST(pickup_ts AS DATE) AS pickup_date, CAST(dayofweek(pickup_ts) AS INTEGER) AS dow, CAST(dayofweek(pickup_ts) * 24 + hour(pickup_ts) AS INTEGER) AS hour_of_week, period
  FROM marked WHERE status = 'ok'),
cells AS (
  SELECT pickup_zone_id AS zone_id, dow, pickup_hour AS hour, period, COUNT(*) AS trips, SUM(fare_total) AS revenue, SUM(duration_hours) AS driver_hours, AVG(fare_total) AS mean_fare, AVG(distance_mi) AS mean_distance,
    AVG(duration_sec) / 60.0 AS mean_duration_min, SUM(tip) AS tips, COUNT(DISTINCT pickup_date) AS days_observed
  FROM fact GROUP BY 1, 2, 3, 4),
mart AS (
  SELECT {_PLACE}, dow, dow_name, hour, hour_of_week, is_weekend, daypart, period, trips, revenue, driver_hours, mean_fare, mean_distance, mean_duration_min, tips, days_observed,
    trips / NULLIF(days_observed, 0) AS trips_per_day, revenue / NULLIF(days_observed, 0) AS revenue_per_day, revenue / NULLIF(driver_hours, 0) AS revenue_per_driver_hour
  FROM cells JOIN dim_zone USING (zone_id) JOIN dim_time USING (dow, hour)),
prof AS (
  SELECT {_PLACE}, dow, hour, hour_of_week, daypart, COUNT(DISTINCT period) AS periods_observed, CAST(SUM(trips) AS BIGINT) AS total_trips, SUM(revenue) AS total_revenue, SUM(driver_hours) AS total_driver_hours,
    AVG(trips_per_day) AS mean_trips_per_day, AVG(revenue_per_day) AS mean_revenue_per_day, {_RPH} AS revenue_per_driver_hour, STDDEV_SAMP(trips_per_day) AS trips_per_day_sd
  FROM mart GROUP BY ALL),
zone_sums AS (
  SELECT {_PLACE}, CAST(SUM(trips) AS BIGINT) AS trips, SUM(revenue) AS revenue, SUM(driver_hours) AS driver_hours, {_RPH} AS revenue_per_driver_hour, SUM(revenue) / NULLIF(SUM(trips), 0) AS mean_fare,
    COUNT(DISTINCT hour_of_week) AS active_hours_of_week
  FROM mart GROUP BY ALL),
hour_sums AS (
  SELECT hour_of_week, dow_name, hour, is_weekend, daypart, CAST(SUM(trips) AS BIGINT) AS trips, SUM(revenue) AS revenue, SUM(driver_hours) AS driver_hours, {_RPH} AS revenue_per_driver_hour, COUNT(DISTINCT zone_id) AS active_zones
  FROM mart GROUP BY hour_of_week, dow_name, hour, is_weekend, daypart),
period_sums AS (SELECT period, CAST(SUM(trips) AS BIGINT) AS trips, SUM(revenue) AS revenue, SUM(driver_hours) AS driver_hours, {_RPH} AS revenue_per_driver_hour FROM mart GROUP BY period),
straight AS (
  SELECT pickup_zone_id AS zone_id, dow, pickup_hour AS hour, COUNT(*) AS trips, SUM(fare_total) AS revenue, SUM(duration_hours) AS driver_hours, AVG(fare_total) AS mean_fare, AVG(distance_mi) AS mean_distance,
    COUNT(DISTINCT pickup_date) AS days_observed
  FROM fact GROUP BY 1, 2, 3),
cell_mart AS (
  SELECT c.*, zone_name, borough, trips / NULLIF(days_observed, 0) AS trips_per_day, revenue / NULLIF(driver_hours, 0) AS revenue_per_driver_hour FROM straight c JOIN dim_zone USING (zone_id)),
by_value AS (SELECT zone_id, zone_name, borough, trips, revenue, revenue_per_driver_hour FROM zone_sums WHERE trips > {MIN_TRIPS} ORDER BY revenue_per_driver_hour DESC NULLS LAST, zone_id LIMIT 12),
by_volume AS (SELECT zone_id, zone_name, borough, trips, revenue, revenue_per_driver_hour FROM zone_sums ORDER BY trips DESC NULLS LAST, zone_id LIMIT 12),
periods AS (SELECT period, row_number() OVER (ORDER BY period DESC) AS nth, COUNT(*) OVER () AS n FROM (SELECT DISTINCT period FROM raw)),
parts AS (SELECT period, CASE WHEN nth <= greatest(1, round_even(n * 0.25, 0)) THEN 'test' ELSE 'train' END AS part FROM periods),
train AS (SELECT mart.* FROM mart JOIN parts USING (period) WHERE part = 'train'),
test AS (SELECT mart.* FROM mart JOIN parts USING (period) WHERE part = 'test'),
train_cells AS (
  SELECT zone_id, zone_name, borough, is_airport, dow, hour, COALESCE(AVG(trips_per_day), 0) AS trips_per_day, COALESCE({_RPH}, 0) AS revenue_per_driver_hour FROM train
  GROUP BY zone_id, zone_name, borough, is_airport, dow, hour HAVING SUM(driver_hours) > 0),
realised AS (SELECT zone_id, dow, hour, {_RPH} AS rph, AVG(trips_per_day) AS trips FROM test GROUP BY zone_id, dow, hour HAVING SUM(driver_hours) > 0),
serving AS (SELECT zone_id, zone_name, borough, dow, hour, mean_trips_per_day AS trips_per_day, revenue_per_driver_hour FROM prof WHERE revenue_per_driver_hour > 0),
series AS (SELECT 'city' AS series_id, k * 168 + hour_of_week AS i, CAST(trips AS DOUBLE) AS observed FROM hour_sums, (SELECT unnest(range(0, 3)) AS k)),
history AS (SELECT zone_id, dow, hour, AVG(trips_per_day) AS cell_history_mean, STDDEV_SAMP(trips_per_day) AS cell_history_sd FROM train GROUP BY 1, 2, 3),
zone_history AS (SELECT zone_id, AVG(trips_per_day) AS zone_mean_trips, {_RPH} AS zone_mean_revenue_per_hour FROM train GROUP BY 1),
"""


def _features(part: str) -> str:
    return f"""
{part}_rows AS (
  SELECT t.zone_id, t.dow, t.hour, t.target, CAST(t.is_airport AS DOUBLE) AS is_airport, COALESCE(cell_history_mean, 0) AS cell_history_mean, COALESCE(cell_history_sd, 0) AS cell_history_sd,
    COALESCE(zone_mean_trips, 0) AS zone_mean_trips, COALESCE(zone_mean_revenue_per_hour, 0) AS zone_mean_revenue_per_hour
  FROM (SELECT zone_id, dow, hour, is_airport, AVG(trips_per_day) AS target FROM {part} GROUP BY 1, 2, 3, 4) t
  LEFT JOIN history h ON h.zone_id = t.zone_id AND h.dow = t.dow AND h.hour = t.hour LEFT JOIN zone_history z ON z.zone_id = t.zone_id),"""


_PREDICTED = """
predicted AS (
  SELECT r.zone_id, r.dow, r.hour, r.target, COALESCE(by_cell, by_zone, (SELECT AVG(target) FROM train_rows), 0) AS prediction
  FROM test_rows r LEFT JOIN (SELECT zone_id, dow, hour, AVG(target) AS by_cell FROM train_rows GROUP BY 1, 2, 3) c ON c.zone_id = r.zone_id AND c.dow = r.dow AND c.hour = r.hour
  LEFT JOIN (SELECT zone_id, AVG(target) AS by_zone FROM train_rows GROUP BY 1) z ON z.zone_id = r.zone_id),
"""


def _metrics(rows: str, prediction: str, name: str) -> str:
    return f"""SELECT '{name}' AS name, AVG(abs(target - {prediction})) AS mae, sqrt(AVG((target - {prediction}) ** 2)) AS rmse, 100 * AVG(abs((target - {prediction}) / target)) FILTER (target > 0) AS mape,
  CASE WHEN VAR_POP(target) > 0 THEN 1 - SUM((target - {prediction}) ** 2) / (VAR_POP(target) * COUNT(*)) ELSE 0 END AS r2, COUNT(*) AS n FROM {rows}"""


def _assigned(cells: str, fleets: tuple[int, ...], where: str = "true") -> str:
    rows = ", ".join(f"({f})" for f in fleets)
    cap = "greatest(1, CAST(trunc(trips_per_day * 1.5) AS BIGINT))"
    fill = lambda by, policy: f"""
  SELECT '{policy}' AS policy, fleet, dow, hour, zone_id, zone_name, borough, capacity, revenue_per_driver_hour, row_number() OVER w AS rank, COUNT(*) OVER (PARTITION BY fleet, dow, hour) AS considered,
    greatest(0, least(capacity, fleet - COALESCE(SUM(capacity) OVER (PARTITION BY fleet, dow, hour ORDER BY {by} DESC, zone_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS drivers
  FROM fleet_cells WHERE {by} > 0 WINDOW w AS (PARTITION BY fleet, dow, hour ORDER BY {by} DESC, zone_id)"""  # noqa: E731
    return f"""
fleet_cells AS (SELECT *, {cap} AS capacity FROM {cells}, (VALUES {rows}) AS f(fleet) WHERE {where}),
placed AS ({fill("revenue_per_driver_hour", "revenue_per_hour")}
  UNION ALL {fill("trips_per_day", "trip_volume")}
  UNION ALL
  SELECT 'uniform', fleet, dow, hour, zone_id, zone_name, borough, capacity, revenue_per_driver_hour, rank, considered, greatest(0, least(each, fleet - each * (rank - 1)))
  FROM (SELECT *, greatest(1, fleet // considered) AS each FROM (
    SELECT *, row_number() OVER (PARTITION BY fleet, dow, hour ORDER BY zone_id) AS rank, COUNT(*) OVER (PARTITION BY fleet, dow, hour) AS considered FROM fleet_cells WHERE revenue_per_driver_hour > 0))),
assigned AS (
  SELECT policy, CAST(fleet AS BIGINT) AS fleet, dow, hour, zone_id, zone_name, borough, CAST(drivers AS BIGINT) AS drivers, capacity, CAST(rank AS INTEGER) AS rank, considered, drivers * revenue_per_driver_hour AS expected_revenue,
    drivers / capacity AS utilisation
  FROM placed WHERE drivers > 0),
hours AS (
  SELECT policy, fleet, dow, hour, CAST(COALESCE(p, 0) AS BIGINT) AS drivers_placed, CAST(fleet - COALESCE(p, 0) AS BIGINT) AS drivers_idle, COALESCE(r, 0) AS expected_revenue, COALESCE(k, 0) AS cells_considered, COALESCE(u, 0) AS cells_used,
    COALESCE(r, 0) / fleet AS revenue_per_driver
  FROM (SELECT CAST(fleet AS BIGINT) AS fleet, policy, dow, hour FROM dim_time, (VALUES {rows}) AS f(fleet), (VALUES ('revenue_per_hour'), ('trip_volume'), ('uniform')) AS p(policy) WHERE {where})
  LEFT JOIN (SELECT policy, fleet, dow, hour, SUM(drivers) AS p, SUM(expected_revenue) AS r, MAX(considered) AS k, COUNT(*) AS u FROM assigned GROUP BY 1, 2, 3, 4) USING (policy, fleet, dow, hour)),
"""


_SCORED = """
scored AS (
  SELECT policy, fleet, dow, hour, zone_id, drivers, CASE WHEN rph > 0 THEN 0 ELSE drivers END AS wasted, CASE WHEN rph > 0 THEN drivers - least(drivers, greatest(1, CAST(trunc(trips * 1.5) AS BIGINT))) ELSE 0 END AS over,
    CASE WHEN rph > 0 THEN least(drivers, greatest(1, CAST(trunc(trips * 1.5) AS BIGINT))) * rph ELSE 0 END AS revenue, CASE WHEN rph > 0 THEN drivers ELSE 0 END AS assigned
  FROM assigned LEFT JOIN realised USING (zone_id, dow, hour)),
results AS (
  SELECT policy, fleet, round(SUM(revenue), 2) AS realised_weekly_revenue, round(SUM(revenue) / (fleet * 168), 4) AS revenue_per_driver_hour, CAST(SUM(wasted) AS BIGINT) AS drivers_to_dead_cells,
    CAST(SUM(over) AS BIGINT) AS drivers_over_capacity, CAST(SUM(assigned) AS BIGINT) AS driver_hours_assigned
  FROM scored GROUP BY policy, fleet),
wide AS (
  SELECT fleet, MAX(realised_weekly_revenue) FILTER (policy = 'revenue_per_hour') AS revenue_policy, MAX(realised_weekly_revenue) FILTER (policy = 'trip_volume') AS volume, MAX(realised_weekly_revenue) FILTER (policy = 'uniform') AS uniform
  FROM results GROUP BY fleet),
lifts AS (
  SELECT fleet, revenue_policy, greatest(volume, uniform) AS best_baseline, CASE WHEN volume >= uniform THEN 'trip_volume' ELSE 'uniform' END AS best_baseline_policy,
    round(100 * (revenue_policy - greatest(volume, uniform)) / NULLIF(greatest(volume, uniform), 0), 2) AS lift_pct, round(100 * (revenue_policy - uniform) / NULLIF(uniform, 0), 2) AS vs_uniform_pct
  FROM wide),
"""


def _average(width: int, out: str, table: str = "series") -> str:
    half = width // 2
    if width % 2:
        frame = f"OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
        return f"CASE WHEN COUNT(*) {frame} = {width} THEN SUM(observed) {frame} / {width} END AS {out}"
    order = "OVER (PARTITION BY series_id ORDER BY i)"
    return f"(SUM(observed) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN {half - 1} PRECEDING AND {half - 1} FOLLOWING) + 0.5 * lag(observed, {half}) {order} + 0.5 * lead(observed, {half}) {order}) / {width} AS {out}"


def _decomposed(period: int) -> str:
    return f"""
trended AS (SELECT *, {_average(period, "trend")}, i % {period} AS place FROM series),
means AS (SELECT series_id, place, AVG(observed - trend) AS m FROM trended GROUP BY 1, 2),
centred AS (SELECT series_id, place, m - AVG(m) OVER (PARTITION BY series_id) AS m FROM means),
decomposed AS (SELECT series_id, i, observed, trend, COALESCE(m, 0) AS seasonal, observed - trend - COALESCE(m, 0) AS residual FROM trended JOIN centred USING (series_id, place)),
strengths AS (
  SELECT series_id, CASE WHEN n < 3 OR COALESCE(rs, 0) = 0 THEN 0 ELSE round(greatest(0, 1 - r / rs), 4) END AS seasonal_strength, CASE WHEN n < 3 OR COALESCE(d, 0) = 0 THEN 0 ELSE round(greatest(0, 1 - r / d), 4) END AS trend_strength,
    CASE WHEN n >= 3 THEN round(sqrt(r), 4) END AS residual_sd
  FROM (SELECT series_id, COUNT(residual) AS n, VAR_POP(residual) AS r, VAR_POP(residual + seasonal) AS rs, VAR_POP(observed - trend) AS d FROM decomposed GROUP BY series_id)),
"""


_LABEL = "CASE {0} // 24 " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DAYS)) + " END || ' ' || lpad(CAST({0} % 24 AS VARCHAR), 2, '0') || ':00'"
_WEEK = f"""
ends AS (
  SELECT series_id, MAX(round(seasonal, 6)) AS high, MIN(round(seasonal, 6)) AS low FROM decomposed WHERE i < 168 GROUP BY 1),
peaks AS (
  SELECT series_id, high, low, (SELECT MIN(i) FROM decomposed d WHERE d.i < 168 AND round(d.seasonal, 6) = high) AS peak, (SELECT MIN(i) FROM decomposed d WHERE d.i < 168 AND round(d.seasonal, 6) = low) AS trough FROM ends),
week AS (
  SELECT series_id, 168 AS period, seasonal_strength, trend_strength, CAST(peak AS INTEGER) AS peak_hour_of_week, {_LABEL.format("peak")} AS peak_label, round(high, 3) AS peak_effect, CAST(trough AS INTEGER) AS trough_hour_of_week,
    {_LABEL.format("trough")} AS trough_label, round(low, 3) AS trough_effect, round(high - low, 3) AS peak_to_trough
  FROM peaks JOIN strengths USING (series_id)),
"""
_FEATURES = _features("train") + _features("test") + _PREDICTED
_HOUR = _assigned("serving", (10,), "dow = 4 AND hour = 18")
_WEEKLY = _assigned("serving", (10,))
_CYCLIC = "sin(2 * pi() * hour / 24) AS hour_sin, cos(2 * pi() * hour / 24) AS hour_cos, sin(2 * pi() * dow / 7) AS dow_sin, cos(2 * pi() * dow / 7) AS dow_cos"

#: Double columns of each query.
DOUBLES = {
    "quality_breakdown": "pct",
    "load_summary": "excluded_pct",
    "fact_trip": "distance_mi fare_total fare_base tip duration_hours",
    "fact_trip_months": "revenue",
    "mart_demand": "revenue driver_hours mean_fare mean_distance mean_duration_min tips trips_per_day revenue_per_day revenue_per_driver_hour",
    "mart_demand_profile": "total_revenue total_driver_hours mean_trips_per_day mean_revenue_per_day revenue_per_driver_hour trips_per_day_sd",
    "mart_zone_summary": "revenue driver_hours revenue_per_driver_hour mean_fare",
    "mart_hourly_profile": "revenue driver_hours revenue_per_driver_hour",
    "mart_monthly": "revenue driver_hours revenue_per_driver_hour",
    "reconciliation": "left_value right_value",
    "cell_mart": "revenue driver_hours mean_fare mean_distance trips_per_day revenue_per_driver_hour",
    "cell_mart_totals": "revenue driver_hours",
    "fact_totals": "revenue driver_hours",
    "zones_by_value": "revenue revenue_per_driver_hour",
    "zones_by_volume": "revenue revenue_per_driver_hour",
    "top_cells": "revenue_per_driver_hour",
    "heatmap": "revenue_per_driver_hour mean_trips_per_day",
    "heatmap_borough": "revenue_per_driver_hour mean_trips_per_day",
    "train_cells": "trips_per_day revenue_per_driver_hour",
    "realised_rates": "rph trips",
    "serving_cells": "trips_per_day revenue_per_driver_hour",
    "topk_cells": "revenue_per_driver_hour",
    "allocate_hour": "expected_revenue utilisation",
    "allocate_volume": "expected_revenue utilisation",
    "allocate_uniform": "expected_revenue utilisation",
    "allocation_summary": "expected_revenue revenue_per_driver",
    "allocate_day": "expected_revenue revenue_per_driver_day",
    "compare_policies": "expected_revenue revenue_per_driver vs_best_pct",
    "score": "revenue",
    "backtest": "realised_weekly_revenue revenue_per_driver_hour",
    "backtest_lift": "revenue_policy best_baseline lift_pct vs_uniform_pct mean_lift_pct",
    "moving_average": "observed trend trend_odd",
    "decompose": "observed trend seasonal residual",
    "seasonal_strength": "seasonal_strength trend_strength residual_sd",
    "hour_of_week_profile": "seasonal_strength trend_strength peak_effect trough_effect peak_to_trough",
    "cyclical_features": "hour_sin hour_cos dow_sin dow_cos",
    "forecast_features": "target is_airport cell_history_mean cell_history_sd zone_mean_trips zone_mean_revenue_per_hour",
    "feature_matrix": "target hour_sin hour_cos dow_sin dow_cos is_weekday is_airport zone_mean_trips zone_mean_revenue_per_hour cell_history_mean cell_history_sd",
    "baseline_forecast": "target prediction",
    "forecast_metrics": "mae rmse mape r2",
    "forecast_verdict": "baseline_mae model_mae improvement",
    "rph_band": "lowest highest",
    "stored_month": "revenue driver_hours",
}

#: Trips by month of order, under the rules for monthly files: zones 264 and 265 are unknown there, and none of the order tables' is.
_MONTHS = """
monthly AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS month, pickup_ts, pickup_ts + to_seconds(lasts) AS dropoff_ts, l_extendedprice * (1 - l_discount) / 100 - 10 AS fare_total,
    l_partkey % 500 <> 0 AND strftime(pickup_ts, '%Y-%m') = strftime(o_orderdate, '%Y-%m') AND lasts BETWEEN 60 AND 21600 AND (l_quantity - 1) * 2.05::DOUBLE BETWEEN 0.1 AND 100.0
      AND l_extendedprice * (1 - l_discount) / 100 - 10 BETWEEN 2.5 AND 1000 AND NOT (l_linenumber = 7 AND l_partkey % 5 = 0) AS kept
  FROM lines),
by_month AS (SELECT month, COUNT(*) AS n, COUNT(*) FILTER (kept) AS good FROM monthly GROUP BY month),
"""

#: name: (further tables, the selection)
_SELECTS = {
    "scan_trips": ("", "SELECT period, COUNT(*) AS rows, COUNT(dropoff_ts) AS with_dropoff, strftime(MIN(pickup_ts), '%Y-%m-%d %H:%M:%S') AS first_pickup FROM raw GROUP BY period"),
    "dim_zone": ("", "SELECT * FROM dim_zone"),
    "dim_time": ("", "SELECT dow, dow_name, CAST(hour AS INTEGER) AS hour, CAST(hour_of_week AS INTEGER) AS hour_of_week, is_weekend, daypart FROM dim_time"),
    "quality_rules": ("", "SELECT * FROM (VALUES (1, 'null_timestamps'), (2, 'wrong_month'), (3, 'negative_duration'), (4, 'implausible_duration'), (5, 'unknown_zone'), (6, 'implausible_distance'), (7, 'non_positive_fare'), (8, 'implausible_fare'), (9, 'implausible_passengers')) AS t(position, rule)"),
    "quality_breakdown": ("", "SELECT status, COUNT(*) AS rows, 100.0::DOUBLE * COUNT(*) / SUM(COUNT(*)) OVER () AS pct FROM marked GROUP BY status"),
    "load_summary": ("", "SELECT period, COUNT(*) AS source_rows, COUNT(*) FILTER (status = 'ok') AS loaded_rows, COUNT(*) FILTER (status <> 'ok') AS excluded_rows, 100.0::DOUBLE * COUNT(*) FILTER (status <> 'ok') / COUNT(*) AS excluded_pct FROM marked GROUP BY period"),
    "fact_trip": ("", "SELECT * REPLACE (CAST(pickup_date AS VARCHAR) AS pickup_date) FROM fact"),
    "fact_trip_months": ("", "SELECT period, COUNT(*) AS trips, SUM(fare_total) AS revenue FROM fact WHERE period IN ('Y1996', 'Y1998') GROUP BY period"),
    "mart_demand": ("", "SELECT * FROM mart"),
    "mart_demand_profile": ("", "SELECT * FROM prof"),
    "mart_zone_summary": ("", "SELECT * FROM zone_sums"),
    "mart_hourly_profile": ("", "SELECT * FROM hour_sums"),
    "mart_monthly": ("", "SELECT * FROM period_sums"),
    "reconciliation": (
        """
sums AS (SELECT CAST(SUM(trips) AS DOUBLE) AS t, round(SUM(revenue)) AS r FROM mart),
checked AS (
  SELECT 'demand_trips_equal_fact_trips' AS check_name, t AS left_value, (SELECT CAST(COUNT(*) AS DOUBLE) FROM fact) AS right_value FROM sums
  UNION ALL SELECT 'demand_revenue_equals_fact_revenue', r, (SELECT round(SUM(fare_total)) FROM fact) FROM sums
  UNION ALL SELECT 'profile_trips_equal_demand_trips', (SELECT SUM(total_trips) FROM prof), t FROM sums
  UNION ALL SELECT 'zone_summary_ties_to_demand', (SELECT SUM(trips) FROM zone_sums), t FROM sums
  UNION ALL SELECT 'hourly_profile_ties_to_demand', (SELECT SUM(trips) FROM hour_sums), t FROM sums
  UNION ALL SELECT 'monthly_ties_to_demand', (SELECT SUM(trips) FROM period_sums), t FROM sums
  UNION ALL SELECT 'hour_of_week_spine_is_complete', (SELECT COUNT(*) FROM dim_time), 168
  UNION ALL SELECT 'no_unknown_zones_survived', (SELECT COUNT(*) FROM mart WHERE zone_id IN (25, 26)), 0
  UNION ALL SELECT 'every_demand_zone_exists_in_dim', (SELECT COUNT(*) FROM mart m LEFT JOIN dim_zone z ON z.zone_id = m.zone_id WHERE z.zone_id IS NULL), 0),
""",
        "SELECT check_name, left_value, right_value, CAST(left_value AS BIGINT) = CAST(right_value AS BIGINT) AS passed FROM checked",
    ),
    "cell_mart": ("", "SELECT * FROM cell_mart"),
    "cell_mart_totals": ("", "SELECT CAST(SUM(trips) AS BIGINT) AS trips, SUM(revenue) AS revenue, SUM(driver_hours) AS driver_hours, COUNT(*) AS cells FROM cell_mart"),
    "fact_totals": ("", "SELECT COUNT(*) AS trips, SUM(fare_total) AS revenue, SUM(duration_hours) AS driver_hours, COUNT(DISTINCT (pickup_zone_id, dow, pickup_hour)) AS cells FROM fact"),
    "zones_by_value": ("", "SELECT * FROM by_value"),
    "zones_by_volume": ("", "SELECT * FROM by_volume"),
    "volume_value_overlap": ("", "SELECT COUNT(*) AS shared_zones FROM by_value WHERE zone_name IN (SELECT zone_name FROM by_volume)"),
    "top_cells": ("", "SELECT zone_id, dow, hour, trips, revenue_per_driver_hour FROM cell_mart WHERE trips > 5 ORDER BY revenue_per_driver_hour DESC NULLS LAST, zone_id, dow, hour LIMIT 10"),
    "heatmap": ("", "SELECT hour_of_week, dow, hour, CAST(SUM(total_trips) AS BIGINT) AS trips, SUM(total_revenue) / NULLIF(SUM(total_driver_hours), 0) AS revenue_per_driver_hour, AVG(mean_trips_per_day) AS mean_trips_per_day FROM prof WHERE revenue_per_driver_hour > 0 GROUP BY 1, 2, 3"),
    "heatmap_borough": ("", "SELECT hour_of_week, dow, hour, CAST(SUM(total_trips) AS BIGINT) AS trips, SUM(total_revenue) / NULLIF(SUM(total_driver_hours), 0) AS revenue_per_driver_hour, AVG(mean_trips_per_day) AS mean_trips_per_day FROM prof WHERE revenue_per_driver_hour > 0 AND borough = 'ASIA' GROUP BY 1, 2, 3"),
    "boroughs": ("", "SELECT DISTINCT borough FROM dim_zone ORDER BY 1"),
    "split_months": ("", "SELECT period, part FROM parts"),
    "train_cells": ("", "SELECT * FROM train_cells"),
    "realised_rates": ("", "SELECT * FROM realised"),
    "serving_cells": ("", "SELECT * FROM serving"),
    "cell_capacity": ("", "SELECT zone_id, dow, hour, greatest(1, CAST(trunc(trips_per_day * 1.5) AS BIGINT)) AS capacity FROM serving"),
    "topk_cells": ("", "SELECT dow, hour, CAST(rank AS INTEGER) AS rank, zone_id, revenue_per_driver_hour FROM (SELECT *, row_number() OVER (PARTITION BY dow, hour ORDER BY revenue_per_driver_hour DESC NULLS LAST, zone_id) AS rank FROM serving) WHERE rank <= 5"),
    "heap_operations": ("", "SELECT dow, hour, COUNT(*) FILTER (better < 5) AS operations FROM (SELECT a.dow, a.hour, a.zone_id, (SELECT COUNT(*) FROM serving b WHERE b.dow = a.dow AND b.hour = a.hour AND b.zone_id < a.zone_id AND b.revenue_per_driver_hour >= a.revenue_per_driver_hour) AS better FROM serving a) GROUP BY 1, 2"),
    "allocate_hour": (_HOUR, "SELECT * FROM assigned WHERE policy = 'revenue_per_hour'"),
    "allocate_volume": (_HOUR, "SELECT * FROM assigned WHERE policy = 'trip_volume'"),
    "allocate_uniform": (_HOUR, "SELECT * FROM assigned WHERE policy = 'uniform'"),
    "allocation_summary": (_WEEKLY, "SELECT * FROM hours"),
    "allocate_day": (_WEEKLY, "SELECT policy, fleet, dow, CAST(SUM(drivers_placed) AS BIGINT) AS driver_hours_placed, CAST(SUM(drivers_idle) AS BIGINT) AS driver_hours_idle, SUM(expected_revenue) AS expected_revenue, SUM(expected_revenue) / fleet AS revenue_per_driver_day FROM hours GROUP BY 1, 2, 3"),
    "compare_policies": (
        _HOUR,
        """SELECT h.policy, h.fleet, h.dow, CAST(h.hour AS INTEGER) AS hour, round(h.expected_revenue, 2) AS expected_revenue, round(h.expected_revenue / h.fleet, 2) AS revenue_per_driver, cells_used, drivers_idle, COALESCE(top_zones, '') AS top_zones,
  CASE WHEN MAX(round(h.expected_revenue, 2)) OVER () <> 0 THEN round(100 * (round(h.expected_revenue, 2) - MAX(round(h.expected_revenue, 2)) OVER ()) / MAX(round(h.expected_revenue, 2)) OVER (), 2) ELSE 0 END AS vs_best_pct
FROM hours h LEFT JOIN (SELECT policy, string_agg(zone_name, '|' ORDER BY rank) AS top_zones FROM assigned WHERE rank <= 5 GROUP BY policy) t ON t.policy = h.policy""",
    ),
    "score": (_assigned("train_cells", (10,)) + _SCORED, "SELECT * FROM scored"),
    "backtest": (_assigned("train_cells", FLEETS) + _SCORED, "SELECT * FROM results"),
    "backtest_lift": (_assigned("train_cells", FLEETS) + _SCORED, "SELECT *, round(AVG(lift_pct) OVER (), 2) AS mean_lift_pct FROM lifts"),
    "hourly_series": ("", "SELECT hour_of_week, trips FROM hour_sums"),
    "moving_average": ("", f"SELECT series_id, i, observed, {_average(24, 'trend')}, {_average(7, 'trend_odd')} FROM series"),
    "decompose": (_decomposed(168), "SELECT * FROM decomposed"),
    "seasonal_strength": (_decomposed(24), "SELECT * FROM strengths"),
    "hour_of_week_profile": (_decomposed(168) + _WEEK, "SELECT * FROM week"),
    "cyclical_features": ("", f"SELECT CAST(hour_of_week AS INTEGER) AS hour_of_week, {_CYCLIC} FROM dim_time"),
    "forecast_features": (_FEATURES, "SELECT * FROM test_rows"),
    "feature_matrix": (_FEATURES, f"SELECT zone_id, dow, hour, target, {_CYCLIC}, CASE WHEN dow BETWEEN 1 AND 5 THEN 1.0::DOUBLE ELSE 0 END AS is_weekday, is_airport, zone_mean_trips, zone_mean_revenue_per_hour, cell_history_mean, cell_history_sd FROM test_rows"),
    "baseline_forecast": (_FEATURES, "SELECT * FROM predicted"),
    "forecast_metrics": (_FEATURES, _metrics("predicted", "prediction", "historical_cell_mean")),
    "forecast_verdict": (
        _FEATURES + f"base AS ({_metrics('predicted', 'prediction', 'b')}), model AS ({_metrics('test_rows', 'zone_mean_trips', 'm')}),",
        "SELECT base.mae AS baseline_mae, model.mae AS model_mae, model.mae < base.mae AS beats_baseline, COALESCE((base.mae - model.mae) / NULLIF(base.mae, 0), 0) AS improvement, CASE WHEN model.mae < base.mae THEN 'model' ELSE 'baseline' END AS verdict FROM base, model",
    ),
    "incremental_load": (_MONTHS, "SELECT CAST(run AS INTEGER) AS run, month AS period, run = 1 AS skipped, n AS source_rows, good AS loaded_rows, n - good AS excluded_rows, good AS stored_rows FROM by_month, (VALUES (0), (1), (2)) AS r(run)"),
    "stored_month": (
        _MONTHS,
        "SELECT month AS period, CAST(dayofweek(pickup_ts) AS INTEGER) AS dow, CAST(hour(pickup_ts) AS INTEGER) AS pickup_hour, COUNT(*) AS trips, SUM(fare_total) AS revenue, SUM(date_diff('second', pickup_ts, dropoff_ts) / 3600.0::DOUBLE) AS driver_hours FROM monthly WHERE kept AND month = '1997-01' GROUP BY 1, 2, 3",
    ),
    "csv_zones": ("", "SELECT * FROM dim_zone"),
    "stored_warehouse": (
        "",
        """SELECT 'dim_zone' AS name, COUNT(*) AS rows, CAST(NULL AS BIGINT) AS trips FROM dim_zone UNION ALL SELECT 'dim_time', COUNT(*), NULL FROM dim_time UNION ALL SELECT 'mart_demand', COUNT(*), CAST(SUM(trips) AS BIGINT) FROM mart
  UNION ALL SELECT 'mart_demand_profile', COUNT(*), CAST(SUM(total_trips) AS BIGINT) FROM prof UNION ALL SELECT 'mart_zone_summary', COUNT(*), CAST(SUM(trips) AS BIGINT) FROM zone_sums
  UNION ALL SELECT 'mart_hourly_profile', COUNT(*), CAST(SUM(trips) AS BIGINT) FROM hour_sums UNION ALL SELECT 'mart_monthly', COUNT(*), CAST(SUM(trips) AS BIGINT) FROM period_sums""",
    ),
    "health": ("", "SELECT COUNT(*) AS cells FROM serving"),
    "capacity_two_drivers": ("", "SELECT zone_id, dow, hour, greatest(1, CAST(trunc(trips_per_day * 2.0 * 1.5) AS BIGINT)) AS capacity FROM serving"),
    "rush_hour": ("", "SELECT hour, CAST(SUM(trips) AS BIGINT) AS trips FROM mart WHERE dow BETWEEN 1 AND 5 GROUP BY hour"),
    "rph_band": ("", "SELECT MIN(revenue_per_driver_hour) AS lowest, MAX(revenue_per_driver_hour) AS highest, COUNT(*) AS cells FROM prof WHERE total_trips > 3"),
    "period_coverage": ("", "SELECT DISTINCT period, 'mart' AS missing_in FROM raw WHERE period NOT IN (SELECT period FROM mart) UNION ALL SELECT 'all', 'none of ' || COUNT(DISTINCT period) FROM mart"),
    "orphan_zones": ("", "SELECT pickup_zone_id, COUNT(*) AS trips FROM raw WHERE pickup_zone_id NOT IN (SELECT zone_id FROM dim_zone) GROUP BY 1"),
    "month_of_file": ("", "SELECT * FROM (VALUES ('yellow_tripdata_2024-01.parquet', '2024-01'), ('x/yellow_tripdata_2023-12.parquet', '2023-12'), ('green_tripdata_2024-01.parquet', NULL)) AS t(file, month)"),
}


def oracle_sql() -> dict[str, str]:
    """Each query, with its double columns rounded as the engine rounds them."""
    out = {}
    for name, (more, select) in _SELECTS.items():
        tables = f"{_TABLES}{more}".strip().rstrip(",")
        rounding = ", ".join(f"CAST(round(CAST({c} AS DECIMAL(38, 8)), 6) AS DOUBLE) AS {c}" for c in DOUBLES.get(name, "").split())
        out[name] = f"WITH {tables}\n" + (f", out AS ({select}) SELECT * REPLACE ({rounding}) FROM out" if rounding else select)
    return out

"""Additive decomposition of time series (series_id, i, observed), many series at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions import DAYS


def moving_average(series: DataFrame, width: int, out: str = "trend") -> DataFrame:
    """Centred mean of ``width`` points; of an even width the outermost two count half. Null where the frame leaves the series."""
    order, half = Window.partitionBy("series_id").orderBy("i"), width // 2
    x = F.col("observed")
    if width % 2:
        frame = order.rowsBetween(-half, half)
        return series.withColumn(out, F.when(F.count(F.lit(1)).over(frame) == width, F.sum(x).over(frame) / width))
    inner = F.sum(x).over(order.rowsBetween(1 - half, half - 1))
    return series.withColumn(out, (inner + 0.5 * F.lag(x, half).over(order) + 0.5 * F.lead(x, half).over(order)) / width)


def decompose(series: DataFrame, period: int) -> DataFrame:
    """Adds trend, seasonal (sums to zero over a period) and residual. Fails for a series shorter than two periods."""
    whole = Window.partitionBy("series_id")
    long = F.when(F.count(F.lit(1)).over(whole) < 2 * period, F.raise_error(F.lit(f"a series shorter than two full periods of {period} points has no seasons"))).otherwise(F.col("observed"))
    rows = moving_average(series.withColumn("observed", long), period).withColumn("place", F.col("i") % period)
    means = rows.groupBy("series_id", "place").agg(F.avg(F.col("observed") - F.col("trend")).alias("m"))
    means = means.withColumn("m", F.col("m") - F.avg("m").over(whole))
    rows = rows.join(means, ["series_id", "place"]).withColumn("seasonal", F.coalesce("m", F.lit(0.0)))
    return rows.select("series_id", "i", "observed", "trend", "seasonal", (F.col("observed") - F.col("trend") - F.col("seasonal")).alias("residual"))


def strength(parts: DataFrame) -> DataFrame:
    """Seasonal and trend strength, 0 to 1, and the residual's deviation; of fewer than three residuals 0, 0 and null."""
    sums = parts.groupBy("series_id").agg(
        F.count("residual").alias("n"), F.var_pop("residual").alias("r"), F.var_pop(F.col("residual") + F.col("seasonal")).alias("rs"), F.var_pop(F.col("observed") - F.col("trend")).alias("d")
    )
    share = lambda of: F.when((F.col("n") < 3) | (F.coalesce(of, F.lit(0.0)) == 0), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 1 - F.col("r") / F.col(of)), 4))
    return sums.select("series_id", share("rs").alias("seasonal_strength"), share("d").alias("trend_strength"), F.when(F.col("n") >= 3, F.round(F.sqrt("r"), 4)).alias("residual_sd"))


def week_profile(series: DataFrame) -> DataFrame:
    """The 168-hour cycle's strength, peak and trough; of equal effects the first hour."""
    parts = decompose(series, 168)
    first = parts.where("i < 168").groupBy("series_id").agg(F.max(F.struct(F.round("seasonal", 6), -F.col("i"))).alias("p"), F.min(F.struct(F.round("seasonal", 6), F.col("i"))).alias("t"))
    rows = strength(parts).join(first, "series_id").select("*", F.col("p.col1").alias("high"), (-F.col("p.col2")).cast("int").alias("peak"), F.col("t.col1").alias("low"), F.col("t.i").cast("int").alias("trough"))
    label = lambda h: F.concat(F.element_at(F.array(*map(F.lit, DAYS)), F.floor(F.col(h) / 24).cast("int") + 1), F.format_string(" %02d:00", F.col(h) % 24))
    return rows.select(
        "series_id", F.lit(168).alias("period"), "seasonal_strength", "trend_strength", "residual_sd", F.col("peak").alias("peak_hour_of_week"), label("peak").alias("peak_label"), F.round("high", 3).alias("peak_effect"),
        F.col("trough").alias("trough_hour_of_week"), label("trough").alias("trough_label"), F.round("low", 3).alias("trough_effect"), F.round(F.col("high") - F.col("low"), 3).alias("peak_to_trough"),
    )


def repeated(profile: DataFrame, times: int = 3) -> DataFrame:
    """An hour-of-week profile (hour_of_week, trips), repeated as a series."""
    rows = profile.select("hour_of_week", "trips", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("k"))
    return rows.select(F.lit("city").alias("series_id"), (F.col("k") * 168 + F.col("hour_of_week")).cast("bigint").alias("i"), F.col("trips").cast("double").alias("observed"))

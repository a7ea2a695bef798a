"""Trip records and zones as the engine's model has them, from files of raw trips or from order tables.

A raw trip has pickup_ts, dropoff_ts, pickup_zone_id, dropoff_zone_id, passengers, distance_mi, fare_total, fare_base, tip, and the
period that its file stands for. Times are held once more as microseconds since 1970 (pickup_us, dropoff_us; UTC, the session's time
zone), and so are the period's ends (from_us, until_us): rules and calendar fields are then arithmetic on longs, which keeps the code
generated for a scan small however often an expression is repeated in it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.functions import DAYS, DAY_US, HOUR_US, SECOND_US, daypart, seconds_between, units

#: Columns of a raw trip file, as (name in the file, name here, type).
RAW_COLUMNS = [
    ("tpep_pickup_datetime", "pickup_ts", "timestamp_ntz"),
    ("tpep_dropoff_datetime", "dropoff_ts", "timestamp_ntz"),
    ("PULocationID", "pickup_zone_id", "int"),
    ("DOLocationID", "dropoff_zone_id", "int"),
    ("passenger_count", "passengers", "int"),
    ("trip_distance", "distance_mi", "double"),
    ("total_amount", "fare_total", "double"),
    ("fare_amount", "fare_base", "double"),
    ("tip_amount", "tip", "double"),
]
FILE_NAME = r"yellow_tripdata_(\d{4})-(\d{2})\.parquet$"
ZONE_SCHEMA = T.StructType([T.StructField("LocationID", T.IntegerType()), T.StructField("Borough", T.StringType()), T.StructField("Zone", T.StringType()), T.StructField("service_zone", T.StringType())])
#: Codes that stand for no place, in zone files and in the order tables' adapter.
UNKNOWN_ZONES, UNKNOWN_NATIONS = (264, 265), (25, 26)


def month_of(path: str) -> str:
    """'YYYY-MM' of a raw file's name; ValueError for another name."""
    if not (m := re.search(FILE_NAME, path)):
        raise ValueError(f"not a monthly trip file: {path}")
    return f"{m[1]}-{m[2]}"


def month_of_file(name: Column) -> Column:
    """:func:`month_of` as a column, null for another name."""
    month = F.concat_ws("-", F.regexp_extract(name, FILE_NAME, 1), F.regexp_extract(name, FILE_NAME, 2))
    return F.when(name.rlike(FILE_NAME), month)


def read_trips(spark: SparkSession, path: str | list[str], month: str | None = None) -> DataFrame:
    """A raw monthly file in the engine's names and types, or several of one schema, each of the month that its name says; only the
    nine columns in use are read."""
    columns = [F.col(a).cast(kind).alias(b) for a, b, kind in RAW_COLUMNS]
    if isinstance(path, str):
        rows = spark.read.parquet(path).select(*columns, F.lit(month or month_of(path)).alias("period"))
    else:
        rows = spark.read.parquet(*path).select(*columns, month_of_file(F.col("_metadata.file_name")).alias("period"))
    return timed(rows.withColumn("period_start", F.concat("period", F.lit("-01")).cast("date")))


def timed(trips: DataFrame) -> DataFrame:
    """``trips`` with pickup_us, dropoff_us, from_us and until_us; where they lack they come from the times and from period_start, the
    first day of a month."""
    start = F.col("period_start")
    wanted = {"from_us": lambda: F.unix_date(start).cast("long") * DAY_US, "until_us": lambda: F.unix_date(F.add_months(start, 1)).cast("long") * DAY_US}
    wanted |= {f"{x}_us": lambda x=x: F.unix_micros(F.col(f"{x}_ts").cast("timestamp")) for x in ("pickup", "dropoff")}
    return trips.select("*", *(make().alias(name) for name, make in wanted.items() if name not in trips.columns))


def discover(spark: SparkSession, folder: str) -> list[str]:
    """Monthly files of a folder, in order; the folder can be in any file system that Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    names = [str(s.getPath().getName()) for s in path.getFileSystem(conf).listStatus(path)]
    return [f"{folder.rstrip('/')}/{n}" for n in sorted(names) if re.search(FILE_NAME, n)]


def read_zones(spark: SparkSession, path: str, unknown: tuple[int, ...] = UNKNOWN_ZONES) -> DataFrame:
    """Zones of a lookup CSV without the codes that stand for no place."""
    raw = spark.read.csv(path, header=True, schema=ZONE_SCHEMA).where(~F.col("LocationID").isin(*unknown))
    return raw.select(F.col("LocationID").alias("zone_id"), F.col("Zone").alias("zone_name"), F.col("Borough").alias("borough"), "service_zone", (F.col("service_zone") == "Airports").alias("is_airport"))


def time_spine(spark: SparkSession) -> DataFrame:
    """The 168 hours of a week."""
    spine = spark.range(168).select(F.floor(F.col("id") / 24).cast("int").alias("dow"), (F.col("id") % 24).cast("int").alias("hour"))
    name = F.element_at(F.array(*map(F.lit, DAYS)), F.col("dow") + 1)
    return spine.select("dow", name.alias("dow_name"), "hour", (F.col("dow") * 24 + F.col("hour")).alias("hour_of_week"), F.col("dow").isin(0, 6).alias("is_weekend"), daypart(F.col("hour")).alias("daypart"))


def clean_columns(trips: DataFrame) -> DataFrame:
    """The columns of a stored trip: raw ones without the microseconds, with duration and calendar fields (0 is Sunday)."""
    pickup, day = F.col("pickup_us"), units(F.col("pickup_us"), DAY_US)
    return trips.select(
        "pickup_ts", "dropoff_ts", "pickup_zone_id", "dropoff_zone_id", "passengers", "distance_mi", "fare_total", "fare_base", "tip",
        seconds_between(pickup, F.col("dropoff_us")).alias("duration_sec"), F.pmod(units(pickup, HOUR_US), F.lit(24)).cast("int").alias("pickup_hour"),
        F.pmod(day + 4, F.lit(7)).cast("int").alias("pickup_dow"), F.date_from_unix_date(day.cast("int")).alias("pickup_date"), "period",
    )


def fact_trips(clean: DataFrame) -> DataFrame:
    """Stored trips with the hours that a driver was bound and the hour of the week."""
    return clean.select(
        "pickup_ts", "dropoff_ts", "pickup_zone_id", "dropoff_zone_id", "passengers", "distance_mi", "fare_total", "fare_base", "tip", "duration_sec",
        (F.col("duration_sec") / F.lit(3600.0)).alias("duration_hours"), "pickup_hour", "pickup_date", F.col("pickup_dow").alias("dow"),
        (F.col("pickup_dow") * 24 + F.col("pickup_hour")).alias("hour_of_week"), "period",
    )


def stored_trips(spark: SparkSession, root: str, periods: list[str] | None = None) -> DataFrame:
    """Trips that :mod:`quayside.sources.load` has stored; naming periods prunes partitions."""
    df = spark.read.parquet(root)
    return df.where(F.col("period").isin(*periods)) if periods is not None else df


# --- order tables ---------------------------------------------------------------------------------------------------


def order_trips(spark: SparkSession, folder: str, *extra: Column) -> DataFrame:
    """Order lines as raw trips: the order's day and a time of day from its keys, nations as zones, years as periods; then ``extra``
    columns over the order's date. What needs one table only is computed below the joins."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    clock = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729 + F.col("l_partkey") * 31) % 86400
    late = F.when(F.col("l_orderkey") % 211 == 0, 400 * 86400).otherwise(0)
    lasts = (F.col("l_partkey") * 97 + F.col("l_orderkey") * 13) % 22500 - 300
    lines = read("lineitem").select(
        "l_orderkey", "l_suppkey",
        (clock + late).alias("clock"),
        F.when(F.col("l_partkey") % 500 != 0, lasts).alias("lasts"),
        F.when((F.col("l_linenumber") == 7) & (F.col("l_partkey") % 5 == 0), 7).when(F.col("l_linenumber") != 7, F.col("l_linenumber") - 1).cast("int").alias("passengers"),
        ((F.col("l_quantity") - 1) * 2.05).alias("distance_mi"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 100 - 10).alias("fare_total"),
        (F.col("l_extendedprice") / 100).alias("fare_base"),
        (F.col("l_extendedprice") * F.col("l_tax") / 100).alias("tip"),
    )
    year = F.year("o_orderdate")
    new_year = lambda y: F.unix_date(F.make_date(y, F.lit(1), F.lit(1))).cast("long") * DAY_US
    orders = read("orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ordered_us"), F.concat(F.lit("Y"), year).alias("period"),
        new_year(year).alias("from_us"), new_year(year + 1).alias("until_us"),
    )
    lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(read("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    after = lambda seconds: F.timestamp_add("SECOND", seconds.cast("int"), F.col("o_orderdate"))
    start = F.col("ordered_us") + F.col("clock") * SECOND_US
    return lines.select(
        after(F.col("clock")).alias("pickup_ts"),
        after(F.col("clock") + F.col("lasts")).alias("dropoff_ts"),
        F.when(F.col("l_orderkey") % 97 == 0, UNKNOWN_NATIONS[0]).otherwise(F.col("s_nationkey")).alias("pickup_zone_id"),
        F.when(F.col("l_orderkey") % 89 == 0, UNKNOWN_NATIONS[1]).otherwise(F.col("c_nationkey")).alias("dropoff_zone_id"),
        "passengers", "distance_mi", "fare_total", "fare_base", "tip", "period",
        start.alias("pickup_us"), (start + F.col("lasts") * SECOND_US).alias("dropoff_us"), "from_us", "until_us", *extra,
    )


def order_zones(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as zones, regions as boroughs; every eighth nation is an airport."""
    nation, region = spark.read.parquet(f"{folder}/nation.parquet"), spark.read.parquet(f"{folder}/region.parquet")
    zone = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    service = F.when(F.col("n_nationkey") % 8 == 0, "Airports").otherwise("Boro Zone")
    zones = zone.select(F.col("n_nationkey").alias("zone_id"), F.col("n_name").alias("zone_name"), F.col("r_name").alias("borough"), service.alias("service_zone"))
    return zones.withColumn("is_airport", F.col("service_zone") == "Airports")

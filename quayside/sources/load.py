"""Incremental, idempotent load of raw monthly files into period partitions, kept in step by content hashes."""

from __future__ import annotations

import hashlib
import re
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.operators.quality import good, MONTH_RULES
from quayside.sources.trips import clean_columns, discover, FILE_NAME, month_of, read_trips

WATERMARK = T.StructType(
    [
        T.StructField("period", T.StringType(), False),
        T.StructField("source_file", T.StringType(), False),
        T.StructField("source_hash", T.StringType(), False),
        T.StructField("source_rows", T.LongType(), False),
        T.StructField("loaded_rows", T.LongType(), False),
        T.StructField("excluded_rows", T.LongType(), False),
        T.StructField("loaded_at", T.TimestampType(), False),
    ]
)
#: Bytes of a file's head and of its tail that are hashed, with its size.
EDGE = 1 << 20


@dataclass(frozen=True)
class Loaded:
    period: str
    skipped: bool
    source_rows: int
    loaded_rows: int
    excluded_rows: int
    seconds: float


def content_hash(spark: SparkSession, path: str) -> str:
    """16 hex digits over a file's size, its first MiB and, of files above two, its last MiB; through Hadoop's file systems."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    size = fs.getFileStatus(p).getLen()
    digest = hashlib.sha256(str(size).encode())
    stream = fs.open(p)
    try:
        for start in [0, *([size - EDGE] if size > 2 * EDGE else [])]:
            stream.seek(start)
            digest.update(bytes(stream.readNBytes(min(EDGE, size - start))))
    finally:
        stream.close()
    return digest.hexdigest()[:16]


def _hadoop(spark: SparkSession, path: str):
    """A path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions of the record, in order."""
    p, fs = _hadoop(spark, f"{root}/_watermark")
    if not fs.exists(p):
        return []
    names = [str(s.getPath().getName()) for s in fs.listStatus(p)]
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(_hadoop(spark, f"{root}/_watermark/{n}/_SUCCESS")[0]))


def read_watermark(spark: SparkSession, root: str) -> DataFrame:
    """The load's record, one row a period: its newest complete version; empty before the first load."""
    versions = _versions(spark, root)
    return spark.read.schema(WATERMARK).json(f"{root}/_watermark/{versions[-1]}") if versions else spark.createDataFrame([], WATERMARK)


def _write_watermark(spark: SparkSession, root: str, rows: list[tuple]) -> None:
    """Written as a new version, which counts from when it is complete, so that a reader finds a whole record at any time. The
    version before stays for those who are reading it, older ones go."""
    versions = _versions(spark, root)
    new = versions[-1] + 1 if versions else 0
    spark.createDataFrame(rows, WATERMARK).coalesce(1).write.mode("overwrite").json(f"{root}/_watermark/{new}")
    for old in versions[:-1]:
        p, fs = _hadoop(spark, f"{root}/_watermark/{old}")
        fs.delete(p, True)


def load_files(spark: SparkSession, paths: list[str], root: str, force: bool = False, months: list[str] | None = None) -> list[Loaded]:
    """Load monthly files, one a month, together: those whose hash is on record are skipped, the partitions of the others are replaced
    in one job and then recorded. ``months``: of each path, if its name doesn't say.

    Months are taken off the record before their data are touched, so a crash in between makes the next run load them again, which
    changes nothing. A month without a good row has no partition afterwards.
    """
    began, months = time.time(), months or [month_of(p) for p in paths]
    if len(set(months)) < len(months):
        raise ValueError("two files of one month")
    record = {r["period"]: tuple(r) for r in read_watermark(spark, root).collect()}  # a row a month
    marks = {m: content_hash(spark, p) for p, m in zip(paths, months, strict=True)}
    fresh = {m: p for p, m in zip(paths, months, strict=True) if force or m not in record or record[m][2] != marks[m]}
    if fresh:
        kept = {m: r for m, r in record.items() if m not in fresh}
        if len(kept) < len(record):
            _write_watermark(spark, root, sorted(kept.values()))
        groups: dict[tuple, list[str]] = {}  # files of one schema whose names say their months are read by one scan
        for m, p in fresh.items():
            named = re.search(FILE_NAME, p) is not None and month_of(p) == m
            groups.setdefault((spark.read.parquet(p).schema.json(), "" if named else m), []).append(m)
        trips, total, name = None, {}, lambda path: path.rsplit("/", 1)[-1]
        for (_, month), same in groups.items():
            part = read_trips(spark, fresh[month], month) if month else read_trips(spark, [fresh[m] for m in same])
            trips = part if trips is None else trips.unionByName(part)
            files = spark.read.parquet(*(fresh[m] for m in same)).groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count("*").alias("n"))
            counts = {r["f"]: r["n"] for r in files.collect()}  # a row a file
            total |= {m: counts.get(name(fresh[m]), 0) for m in same}
        folders = {m: _hadoop(spark, f"{root}/trips/period={m}") for m in fresh}
        for folder, fs in folders.values():
            fs.delete(folder, True)
        clean = clean_columns(good(trips, MONTH_RULES))
        clean.write.mode("append").option("compression", "zstd").partitionBy("period").parquet(f"{root}/trips")
        now = spark.sql("SELECT current_timestamp()").first()[0]
        there = [str(folder) for folder, fs in folders.values() if fs.exists(folder)]
        stored = spark.read.option("basePath", f"{root}/trips").schema(clean.schema).parquet(*there).groupBy("period").agg(F.count("*").alias("n")).collect() if there else []
        loaded = {r["period"]: r["n"] for r in stored}  # a row a month
        for m, p in fresh.items():
            kept[m] = (m, name(p), marks[m], total[m], loaded.get(m, 0), total[m] - loaded.get(m, 0), now)
        _write_watermark(spark, root, sorted(kept.values()))
        record = kept
    took = time.time() - began
    return [Loaded(m, m not in fresh, *record[m][3:6], took if m in fresh else 0.0) for m in months]


def load_file(spark: SparkSession, path: str, root: str, force: bool = False, month: str | None = None) -> Loaded:
    """Load one monthly file; see :func:`load_files`."""
    return load_files(spark, [path], root, force, [month] if month else None)[0]


def load_folder(spark: SparkSession, folder: str, root: str, force: bool = False, months: list[str] | int | None = None) -> list[Loaded]:
    """Load all monthly files of a folder, in order; or those of ``months``, or the first so many."""
    paths = discover(spark, folder)
    if isinstance(months, int):
        paths = paths[:months]
    elif months is not None:
        paths = [p for p in paths if month_of(p) in months]
    if not paths:
        raise FileNotFoundError(f"no monthly trip files in {folder}")
    return load_files(spark, paths, root, force)


def load_summary(loads: list[Loaded]) -> dict:
    """Totals of a load, with the percentage left out."""
    source, loaded, excluded = (sum(getattr(x, k) for x in loads) for k in ("source_rows", "loaded_rows", "excluded_rows"))
    return {"periods": len(loads), "skipped": sum(x.skipped for x in loads), "source_rows": source, "loaded_rows": loaded, "excluded_rows": excluded, "excluded_pct": round(100 * excluded / source, 4) if source else 0.0}

"""Small JSON documents in any file system that Spark reaches."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def write(spark: SparkSession, document: dict, path: str) -> None:
    """One JSON file, through Hadoop's file systems; written aside first, so that a reader finds a whole one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    aside, final = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.new", path))
    fs = final.getFileSystem(conf)
    stream = fs.create(aside, True)
    try:
        stream.write(bytearray(json.dumps(document, indent=2, default=str).encode()))
    finally:
        stream.close()
    fs.delete(final, False)
    fs.rename(aside, final)


def read(spark: SparkSession, path: str) -> dict:
    """A document that :func:`write` left; LookupError if there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        raise LookupError(f"no document at {path}")
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])

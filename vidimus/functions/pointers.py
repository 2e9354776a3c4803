"""Numbered pointers to snapshots: one small file a number, created only where none is yet, so of two writers one loses and knows."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def claim(spark: SparkSession, base: str, number: int, about: dict) -> bool:
    """Makes about the pointer of that number; False if another writer has made one. As atomic as the store's creation of new files."""
    where, fs = _files(spark, f"{base}/pointer/{number:012d}.json")
    try:
        out = fs.create(where, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()) or fs.exists(where):
            return False
        raise
    out.write(bytearray(json.dumps({"number": number, **about}).encode()))
    out.close()
    return True


def latest(spark: SparkSession, base: str) -> dict | None:
    """The pointer with the highest number; None before the first."""
    where, fs = _files(spark, f"{base}/pointer")
    if not fs.exists(where):
        return None
    lines = spark.read.text(f"{base}/pointer/*.json").where(F.length("value") > 0)
    row = lines.orderBy(F.desc(F.get_json_object("value", "$.number").cast("long"))).first()  # a line a snapshot
    return json.loads(row.value) if row else None


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _files(spark, path)
    fs.delete(where, True)

"""Tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN = "spark.cuelight.own.dir"


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, gone when the application ends. A local session where that is unset, as in
    tests, gets a temporary folder; executors on other machines could not see it, so any other session is refused."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(_OWN, "")
    if not base:
        if not re.fullmatch(r"local(\[.*)?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='cuelight-')}"
        spark.conf.set(_OWN, base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def settled(df: DataFrame) -> DataFrame:
    """df as a written table: what reads it twice doesn't compute it twice, and a lost executor costs a read."""
    spark = df.sparkSession
    path = fresh_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

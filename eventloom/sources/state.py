"""Delivered-state tables: a JSON object with a sorted list, as found, and Parquet for growth."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.text import strip

SHAPE = "sent_urls array<string>"


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """(url) distinct and stripped; a missing or malformed file is an empty state."""
    try:
        raw = spark.read.schema(SHAPE).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    except AnalysisException:
        return spark.createDataFrame([], "url string")
    return raw.select(F.explode("sent_urls").alias("u")).select(strip(F.col("u")).alias("url")).where("url <> ''").distinct()


def state_document(urls: DataFrame) -> DataFrame:
    """One row: the JSON object of the sorted distinct urls. For a state that fits a file; tables keep theirs as rows."""
    listed = F.array_sort(F.collect_set("url"))
    return urls.agg(F.to_json(F.struct(listed.alias("sent_urls"))).alias("value"))


def write_state(urls: DataFrame, path: str) -> bool:
    """The state as an indented JSON file on any file system that the session reaches; False if it could not be written."""
    spark = urls.sparkSession
    text = json.dumps(json.loads(state_document(urls).first().value), indent=2, ensure_ascii=False)
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True
    except Py4JJavaError:
        return False


def save_state(urls: DataFrame, path: str) -> None:
    urls.select("url").where("url is not null and url <> ''").distinct().write.mode("append").parquet(path)

"""Small files on any file system that the session reaches: marks, commits, and folders that are done."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole: under another name first, then renamed, so a reader never sees half of it."""
    fs, where = _at(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(where, False)
    if not fs.rename(part, where):
        raise OSError(f"could not write {path}")


def get(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    with_bytes = fs.open(where)
    try:
        return bytes(with_bytes.readAllBytes()).decode()
    finally:
        with_bytes.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it is not there."""
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return []
    return sorted(n for s in fs.listStatus(where) if not (n := s.getPath().getName()).startswith((".", "_")) and not n.endswith(".part"))


def drop(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)

"""Rejecting what was sent before, without shuffling all that was ever sent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators.durable import durable
from eventloom.sources import files

FEW = 200_000  # candidates whose keys are sent to every task of the state's scan, some 20 MB
BUCKETS = 64


def reject(candidates: DataFrame, sent: DataFrame, key: str = "url", few: int = FEW) -> DataFrame:
    """Candidates whose key the state does not hold. Null keys stay.

    A run has few candidates and a state that only grows. So the candidates' keys go to the state, by broadcast once they
    are counted, and only what is found comes back: the state is scanned in one column and no row of it moves. Beyond
    ``few`` keys both sides meet by a join, in which a state in buckets (``SentTable``) stays where it is.
    """
    known = durable(candidates.select(key).where(F.col(key).isNotNull()).distinct())
    if known.limit(few + 1).count() > few:
        return candidates.join(sent.select(key), key, "left_anti").select(*candidates.columns)
    found = sent.select(key).join(F.broadcast(known), key, "left_semi")
    return candidates.join(F.broadcast(found), key, "left_anti").select(*candidates.columns)


class SentTable:
    """Keys in a table of Parquet buckets with Bloom filters, at ``path``.

    The same hash that deals a join's rows has dealt the table's, so a join on the key shuffles its other side alone. The
    files carry a Bloom filter of the key: a search for single keys (``holds``) skips row groups that cannot have them.
    ``add`` writes few rows to few files; ``compact`` rewrites the table with one file a bucket.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, key: str = "url", buckets: int = BUCKETS, distinct_keys: int = 1_000_000):
        self.spark, self.path, self.name, self.key, self.buckets = spark, path.rstrip("/"), name, key, buckets
        self.version = max((int(n[1:]) for n in files.names(spark, self.path)), default=0)
        self.options = f"'parquet.bloom.filter.enabled#{key}' 'true', 'parquet.bloom.filter.expected.ndv#{key}' '{distinct_keys}'"
        self._open()

    def _open(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")
        self.spark.sql(f"create table {self.name} (`{self.key}` string) using parquet options ({self.options}) clustered by (`{self.key}`) sorted by (`{self.key}`) into {self.buckets} buckets location '{self.path}/v{self.version}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, keys: DataFrame) -> None:
        """Add the keys that are not there yet."""
        new = reject(keys.select(self.key).where(F.col(self.key).isNotNull()).distinct(), self.rows(), self.key)
        self._insert(new)

    def _insert(self, rows: DataFrame) -> None:
        rows.repartition(self.buckets, self.key).sortWithinPartitions(self.key).write.insertInto(self.name)

    def holds(self, keys: list[str]) -> DataFrame:
        """Those of a few keys that the table has."""
        return self.rows().where(F.col(self.key).isin(keys)).distinct()

    def reject(self, candidates: DataFrame, few: int = FEW) -> DataFrame:
        return reject(candidates, self.rows(), self.key, few)

    def compact(self) -> None:
        """One file a bucket again, in a new folder; the old one goes once the new one is whole."""
        rows, old = self.rows(), f"{self.path}/v{self.version}"
        held = durable(rows.distinct())
        self.version += 1
        self._open()
        self._insert(held)
        files.drop(self.spark, old)

"""What the operators of this subpackage share: table reads, durable cuts of the lineage, Arrow maps."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole named table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_BYTES = 4_000_000
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """``df``, its session set to send Python no more than ``BATCH_BYTES`` at once: the setting's default lets 10,000
    texts of any length through, on both sides of the pipe and for each core. A lower bound of the session's stays."""
    conf = df.sparkSession.conf
    if int(conf.get(_BATCH).rstrip("b")) > BATCH_BYTES:
        conf.set(_BATCH, f"{BATCH_BYTES}b")
    return df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the cluster's shared checkpoint folder.

    The folder is the session's own ``spark.checkpoint.dir``; only a local master, which has no other machine, gets a
    private one where none is set.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt"))
    out = df.checkpoint(eager=True)
    tidy(df.sparkSession)
    return out


def tidy(spark: SparkSession) -> None:
    """Let the driver's collector run. Spark drops the files of shuffles and broadcasts that nothing refers to any more
    only after it has; between the steps of an iterative operator that keeps their disk and the driver's heap small."""
    spark.sparkContext._jvm.System.gc()


SLICE_ROWS, SLICE_BYTES = 4096, 8_000_000


def _weight(row: tuple) -> int:
    """About the bytes of a row's texts and lists."""
    return sum(len(x) * (64 if isinstance(x, list) else 1) for x in row if isinstance(x, (str, bytes, list)))


def arrow_map(df: DataFrame, rows: Callable[[list], Iterator[tuple]], schema: str, columns: list[str], kinds: list[pa.DataType]) -> DataFrame:
    """One pass of ``rows`` over each Arrow batch, given as a list of columns of Python values; it yields output tuples.

    Output leaves in slices of ``SLICE_ROWS`` rows or about ``SLICE_BYTES``, whichever comes first, and input is read in
    slices of the same rows, so a batch of long texts needs no second copy of itself.
    """
    names = columns

    def run(batches):
        out: list[tuple] = []
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for row in rows([c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns]):
                    out.append(row)
                    held += _weight(row)
                    if len(out) >= SLICE_ROWS or held >= SLICE_BYTES:
                        yield pack(out)
                        out, held = [], 0
        if out:
            yield pack(out)

    def pack(out):
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(zip(*out), kinds)], names=names)

    return bounded(df).mapInArrow(run, schema)


def list_array(flat: np.ndarray, sizes: list[int], kind: pa.DataType = pa.int32()) -> pa.Array:
    """Lists of ``sizes`` cut from flat values."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def row_key(*columns: str) -> Column:
    """A key that is never null and equal only for equal rows: 128 bits of two seeded hashes."""
    return F.concat_ws("-", F.hex(F.xxhash64(*columns)), F.hex(F.xxhash64(F.lit(7), *columns)))

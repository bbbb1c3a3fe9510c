"""Shared plumbing of the training-data operators: reading tables and cutting lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of most contracts: a run of anything but space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset (tests on one machine) a temporary folder is set for the session."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit
        pass


def cut(df: DataFrame, name: str, instead: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    A lost executor then costs only the tasks that read it.  ``instead``: a table written before that nothing reads
    from now on.  The others go when the driver ends, or by ``release``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._plumbline_path = path
    if instead is not None:
        release(instead)
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, t._plumbline_path)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Parts of batches with about ``most`` bytes in column ``text``, or one row: what Python holds of a batch at once."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 512)
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
            yield b.slice(at, end - at)
            at = end


def fresh(taken: list[str], *names: str) -> list[str]:
    """Names like those given that no column of ``taken`` has (Spark compares names without case)."""
    have, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def lower_ascii(col):
    """A-Z to a-z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

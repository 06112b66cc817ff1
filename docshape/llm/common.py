"""Helpers shared by the operators: shared storage, worker state, Arrow batches."""

from __future__ import annotations

import atexit
import itertools
import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables written by this driver (session, path, name in the catalog if any), removed when it ends.
_WRITTEN: list[tuple] = []

#: Checkpoints from one sweep of the driver's garbage to the next.
SWEEP = 3
_CHECKPOINTS = itertools.count(1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` if the session names one.

    Only a local master may fall back to a folder of this machine."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="docshape-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor costs nothing before it.

    What was shuffled before it is needed no more, but its files stay until the driver collects its garbage, which a driver of
    small work may not do for long: it is asked to now and then, so that rounds do not add up on disk."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if next(_CHECKPOINTS) % SWEEP == 0:
        df.sparkSession.sparkContext._jvm.System.gc()
    return out


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: for rows that carry whole texts, as files are compressed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, key: str, parts: int) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by ``key``: joins on it move the other side only."""
    spark = df.sparkSession
    name = f"docshape_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(parts, key).saveAsTable(name)
    _WRITTEN.append((spark, path, name))
    return spark.table(name)


def discard() -> None:
    """Removes the tables of ``written`` and ``placed``, files and names.  A driver that lives long may call it once the
    results that were read from them are stored."""
    for spark, path, *name in _WRITTEN:
        try:
            if name:
                spark.sql(f"DROP TABLE IF EXISTS {name[0]}")
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone by now; the folder is then the cluster's to clean
            pass
    _WRITTEN.clear()


atexit.register(discard)


def worker_state() -> types.ModuleType:
    """What a Python worker keeps from one task to the next."""
    return sys.modules.setdefault("_docshape_worker", types.ModuleType("_docshape_worker"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def binary_text(name: str = "text"):
    """The text's UTF-8 bytes; a null text counts as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

"""Reading flat tables and keeping versions of a catalog."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Schema
from ..operators.reshape import Catalog


def parquet_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options) -> DataFrame:
    """A table of a relational database, read in ranges of a numeric key if one is given."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key:
        r = r.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
    return r.load()


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; repeating it changes nothing."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def children_of(child: DataFrame, columns: list[str], parents: DataFrame, keys: list[str]) -> DataFrame:
    """The child rows of a set of parents."""
    p = parents.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
    return child.join(p, [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(columns)], "left_semi")


def _text_file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def save(cat: Catalog, spark: SparkSession, folder: str) -> int:
    """Writes all roots to a folder of their own and then names it in the next version's manifest, so that readers see all
    changes or none.  What a crash left without a manifest is never read nor in the way; of two writers of one version the
    second takes the next."""
    data = uuid.uuid4().hex
    for t, df in cat.roots.items():
        df.write.parquet(f"{folder}/{data}/{t}")
    while True:
        version = current(spark, folder) + 1
        p, fs = _text_file(spark, f"{folder}/manifest-{version}.json")
        try:
            out = fs.create(p, False)
        except Py4JJavaError:
            if not fs.exists(p):
                raise
            continue
        out.write(bytearray(json.dumps({"version": version, "data": data, "roots": sorted(cat.roots)}).encode()))
        out.close()
        return version


def current(spark: SparkSession, folder: str) -> int:
    p, fs = _text_file(spark, folder)
    if not fs.exists(p):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return max([int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")], default=0)


def load(schema: Schema, layouts, spark: SparkSession, folder: str, version: int | None = None) -> Catalog:
    v = version or current(spark, folder)
    manifest = json.loads("".join(r[0] for r in spark.read.text(f"{folder}/manifest-{v}.json").collect()))
    roots = {t: spark.read.parquet(f"{folder}/{manifest['data']}/{t}") for t, x in layouts.items() if x.kind == "root"}
    return Catalog(schema, layouts, roots)

"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet
and read again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docshape.llm import mixing, packing, pii, quality, simhash_dedup
from docshape.llm.common import _WRITTEN, checkpoint, read, shared_dir, written

#: Words of a part of a shard, on average: what one task sorts and writes.
PART = 1 << 24


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash_dedup.keep_one(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts replaced by its kind; n_chars follows the text."""
    return pii.mask(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def _copy_numbers(rows: DataFrame) -> DataFrame:
    """``rows`` (_row, _id, ..) with ``_c``, the number of a row among those of its ``_id``: within its partition first, then behind the partitions before."""
    at = rows.select("_row", "_id", F.shiftrightunsigned("_row", 33).alias("_part"))
    here = F.row_number().over(W.partitionBy("_id", "_part").orderBy("_row")) - 1
    of_part = at.groupBy("_id", "_part").agg(F.count(F.lit(1)).alias("_m"))
    before = F.coalesce(F.sum("_m").over(W.partitionBy("_id").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    number = at.withColumn("_here", here).join(of_part.select("_id", "_part", before.alias("_before")), ["_id", "_part"])
    return rows.join(number.select("_row", (F.col("_before") + F.col("_here")).alias("_c")), "_row")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of its shards; columns may have any names.

    The draw depends on a row's columns only, so reruns agree; rows alike in all columns are drawn each for itself.  Each
    shard is cut by place into parts of about PART words, one task each: their number grows with the words.  Null and empty
    texts are words of none, drawn with whole blocks; an empty table stays empty."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    source, text = (F.col(f"c{names.index(n)}") for n in ("source", "text"))
    rows = plain.select("*", F.xxhash64(*plain.columns).alias("_id"), source.alias("_source"), mixing.word_count(text).alias("_size"))
    counted = checkpoint(mixing.counts(rows))
    plan = written(mixing.source_plan(counted), "plan")  # a file, so that its true size decides how it is joined
    if counted.where("_n > 1").isEmpty():
        rows = rows.withColumn("_c", F.lit(0).cast("long"))
    else:
        rows = _copy_numbers(written(rows.withColumn("_row", F.monotonically_increasing_id()), "mix"))
    words = plan.agg(F.sum("s")).first()[0] or 0
    parts = max(1, -(-words // (mixing.SHARDS * PART)))
    taken = mixing.draw(rows, plan).select(*plain.columns, F.inline("shards_of"))
    # The high bits of a place are as good as random: equal ranges of them hold about equal numbers of rows.
    part = F.col("shard") * parts + F.expr(f"shiftrightunsigned(place, 33) * {parts} div 2147483648").cast("int")
    out = taken.repartitionById(mixing.SHARDS * parts, part.cast("int")).sortWithinPartitions("shard", F.expr("shiftrightunsigned(place, 33)"), "place")
    return out.select(*[F.col(c).alias(n) for c, n in zip(plain.columns, names)])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens packed into sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality_filter), ("SimHash near-dedup", near_dedup), ("PII", private_data), ("mixing sources to target weights", mix_sources), ("best-fit packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        _WRITTEN.append((spark, path))
        docs = spark.read.parquet(path)
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)


QUERIES = {"pipeline": pipeline}
ORACLE: dict[str, str] = {}

"""SimHash near-duplicate classes of documents (operator 1)."""

from __future__ import annotations

from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .blocks import near_links
from .common import binary_text, checkpoint, placed, shuffle_partitions
from .components import connected_components

SHINGLE = 3
#: Words of a pipeline's near-duplicate shingles.
LONG_SHINGLE = 5
_STEP = 1 << 16


def simhash(text: bytes, width: int = SHINGLE) -> int:
    """The fingerprint of a whole text, as an unsigned integer.

    A bit is set if more than half of the shingles' XXH64 values (seed 42) have it."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, and splits at 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    n = len(words) - width + 1
    shingles = map(b" ".join, zip(*(islice(words, i, None) for i in range(width))))
    votes = np.zeros(64, np.int64)
    for start in range(0, n, _STEP):
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)) if n <= _STEP else map(xxhash.xxh64_intdigest, islice(shingles, min(_STEP, n - start)), repeat(42)), np.uint64, min(_STEP, n - start))
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprinter(width: int):
    def run(batches):
        for batch in batches:
            fps = np.fromiter((simhash(t, width) for t in batch.column("_text").to_pylist()), np.uint64, batch.num_rows)
            rest = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "_text"]
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(fps.view(np.int64))], names=[*names, "fp"])

    return run


def fingerprints(docs: DataFrame, keep: dict, text: str = "text", width: int = SHINGLE) -> DataFrame:
    """The columns ``keep`` (name: Column) of each document and ``fp``, the SimHash of its whole text as a signed long.

    Null and empty texts have fingerprint zero.  One pass, no shuffle; a task holds one batch of texts."""
    src = docs.select(*[c.alias(n) for n, c in keep.items()], F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name != "_text")
    return src.mapInArrow(_fingerprinter(width), f"{kinds}, fp bigint")


def classes(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """(fp, class): each distinct fingerprint and the least fingerprint that it reaches over links of at most 2 bits."""
    distinct = checkpoint(fps.where(F.col(fp).isNotNull()).select(F.col(fp).alias("fp")).distinct())
    linked = connected_components(near_links(distinct))
    return distinct.join(linked, distinct.fp == linked.node, "left").select("fp", F.coalesce("component", "fp").alias("class"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, fingerprint, component_id) for each row of ``docs``: near-duplicate classes of whole texts.

    component_id is the smallest id reachable over links of at most 2 differing bits, itself included.  Null or
    empty texts have fingerprint zero and link like any other; repeated rows each get a row; a null id never names
    a class, so a class of null ids only has a null component_id.  An empty table gives no rows.  Columns other
    than the id and the text are not read.  Copies of a text share a fingerprint and are never paired."""
    fps = checkpoint(fingerprints(docs, {"_id": F.col(id_col)}, text, width))
    named = classes(fps)
    least = fps.groupBy("fp").agg(F.min("_id").alias("low"))
    of_class = named.join(least, "fp").groupBy("class").agg(F.min("low").alias("component_id"))
    of_fp = named.join(of_class, "class").select("fp", "component_id")
    return fps.join(of_fp, "fp").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = LONG_SHINGLE) -> DataFrame:
    """``docs`` without near copies: of each class the row with the smallest id (null ids last; between rows of one
    id, the one with the smallest digest; of rows alike in every column, one).

    A class is what pairs of texts link whose sets of ``width``-word shingles have a Jaccard similarity of 0.8 or more: texts without
    near copies are told by a sample of their shingles, pairs of the others come from tables over SimHash fingerprints, pass by
    Hamming distance and are then compared whole (``near_copies``); null and empty texts are alike.  Columns may have any names and all come back; an empty table stays empty."""
    names = docs.columns
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])
    id_col, text = (f"c{names.index(n)}" for n in (id_col, text))
    parts = shuffle_partitions(docs.sparkSession)
    # Texts move once: both joins with them are on the digest that they are placed by.
    rows = placed(docs.withColumn("_row", F.xxhash64(*docs.columns)).repartition(parts, "_row"), "_row", parts)
    signed = near_copies.signatures(rows.select(F.col(id_col).alias("_id"), "_row", binary_text(text).alias("_text")), width)
    # The first row of each shingle set before the joins: copies of one text, however many, come to them as one row.
    first = signed.groupBy("node").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))).alias("k"), F.any_value("sample").alias("sample"))
    first = checkpoint(first)
    compared = near_copies.possible(first)
    first = first.drop("sample")
    # Joined by the digest alone, ids being compared after it: the rows then lie as dropDuplicates needs them.
    same = F.when(F.col(id_col).isNull(), F.col("_kept_id").isNull()).otherwise(F.col(id_col) == F.col("_kept_id"))
    shared = first.join(compared, "node").select("node", F.col("k.id").alias("_kept_id"), F.col("k.row").alias("_kept_row"))
    texts = rows.select(id_col, "_row", binary_text(text).alias("_text")).join(shared, (F.col("_row") == F.col("_kept_row")) & same).select("node", "_text")
    # Placed by node, so that comparing pairs moves pairs and not all sets.
    sets = placed(near_copies.shingle_sets(texts, width).dropDuplicates(["node"]), "node", parts)
    named = near_copies.classes(sets)
    kept = first.join(named, "node", "left").groupBy(F.coalesce("class", "node").alias("class")).agg(F.min("k").alias("k")).select(F.col("k.id").alias("_kept_id"), F.col("k.row").alias("_kept_row"))
    hit = rows.join(kept, (F.col("_row") == F.col("_kept_row")) & same, "left_semi")
    return hit.dropDuplicates(["_row", id_col]).select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names)])

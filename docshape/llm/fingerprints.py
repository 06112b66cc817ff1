"""Document fingerprints with DataFrame functions only (operator 4).

SimHash: every occurrence of a term (a word with its two followers) hashes to
64 signed votes; a bit is set where the votes are positive.  Votes of two bits
travel in the halves of one long, so 32 sums carry all 64 counts and cannot
overflow below four billion terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .blocks import entries, near_links, neighbours
from .common import checkpoint, shuffle_partitions
from .components import connected_components

_HALVES = 0x0000000100000001
_LOW = 0xFFFFFFFF


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[ \\t\\n\\x0B\\f\\r]+", " ")), " ")


def _votes(h: Column) -> list[Column]:
    return [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_HALVES))).alias(f"_v{i}") for i in range(32)]


def _bits(n: Column) -> Column:
    """The fingerprint: a bit is set if over half of the ``n`` terms have it."""
    out = F.lit(0).cast("long")
    for i in range(32):
        v = F.col(f"_v{i}")
        low = F.when(v.bitwiseAND(F.lit(_LOW)) * 2 > n, F.lit(_signed(1 << i))).otherwise(F.lit(0))
        high = F.when(F.shiftrightunsigned(v, 32) * 2 > n, F.lit(_signed(1 << (i + 32)))).otherwise(F.lit(0))
        out = out.bitwiseOR(low.cast("long")).bitwiseOR(high.cast("long"))
    return out


def simhash(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and ``fp`` (signed long) of each group of ``rows`` with equal keys, which name one text each.

    No shuffle if the rows are already placed by some of the keys; else partial counts make it one row a text."""
    w = words(F.coalesce(F.col(text), F.lit("")))
    terms = rows.select(*keys, w.alias("_w")).select(
        *keys, F.inline(F.arrays_zip(F.col("_w").alias("a"), F.expr("slice(_w, 2, 2147483647)").alias("b"), F.expr("slice(_w, 3, 2147483647)").alias("c")))
    ).toDF(*keys, "_w0", "_w1", "_w2")
    # An empty text has the one word "", whose hash is left out of the votes: fingerprint zero.
    h = F.when(F.col("_w0") != "", F.xxhash64("_w0", "_w1", "_w2")).otherwise(F.lit(0).cast("long"))
    votes = terms.select(*keys, h.alias("_h")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"), *_votes(F.col("_h")))
    return votes.select(*keys, _bits(F.col("_total")).alias("fp"))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """The cosine that the angle between two fingerprints stands for, at least 0: 1 for equal fingerprints."""
    return F.greatest(F.lit(0.0), F.cos(F.lit(3.141592653589793) * F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)))


def ranges(docs: DataFrame, key: str, parts: int) -> Column:
    """The number of the range of ``key`` that a row falls in: about equal shares, fixed by at most ``parts`` values."""
    at = [i / parts for i in range(1, parts)]
    cuts = sorted(set(docs.stat.approxQuantile(key, at, 0.2 / parts))) if at else []
    cut = F.array(*[F.lit(int(c)).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    return F.coalesce(F.size(F.filter(cut, lambda c: c <= F.col(key))), F.lit(0)) if cuts else F.lit(0)


def with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(_p, _n, id, text, next): each document with the text of its successor by ascending id; the last with the first's.

    Rows are placed by ranges of the id, each sorted by one task; the first row of each range is also placed at the
    end of the range before it, so no order over all rows is ever needed.  Ties keep the order of the texts' digests; null ids
    come first."""
    src = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    spark = docs.sparkSession
    src = src.withColumn("_p", ranges(src.where(F.col("_id").isNotNull()), "_id", max(1, shuffle_partitions(spark))))
    src = src.withColumn("_h", F.xxhash64("_t"))
    first = src.groupBy("_p").agg(F.min(F.struct(F.col("_id").isNotNull().alias("s"), F.col("_id").alias("i"), F.col("_h").alias("h"), F.col("_t").alias("t"))).alias("f"))
    heads = checkpoint(first)
    order = W.orderBy("_p")
    before = heads.select("_p").withColumn("_to", F.lag("_p").over(order))
    last = heads.agg(F.max("_p").alias("_z"))
    before = before.join(F.broadcast(last)).select(F.col("_p"), F.coalesce("_to", "_z").alias("_to"))
    ends = heads.join(before, "_p").select(F.col("_to").alias("_p"), F.lit(True).alias("_end"), F.col("f.i").alias("_id"), F.col("f.h").alias("_h"), F.col("f.t").alias("_t"))
    both = src.select("_p", F.lit(False).alias("_end"), "_id", "_h", "_t").unionByName(ends)
    w = W.partitionBy("_p").orderBy("_end", F.col("_id").asc_nulls_first(), "_h")
    return both.select("_p", "_end", "_id", "_t", F.row_number().over(w).alias("_n"), F.lead("_t").over(w).alias("_next")).select("_p", "_n", "_end", "_id", "_t", "_next")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last half (rounded down) replaced by the start of ``following``."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.left(text, n - half), F.left(following, half))


def near_documents(rows: DataFrame) -> DataFrame:
    """(fp, near_doc_id, n_near, class_doc_id) of each fingerprint of the documents ``rows`` (_id, fp).

    near_doc_id is the smallest id whose fingerprint lies within two bits, its own included; n_near the number of other
    documents within two bits; class_doc_id the smallest id reached over links of at most two bits.  A null id counts
    as a document but never stands for one."""
    fps = checkpoint(rows.groupBy("fp").agg(F.min("_id").alias("low"), F.count(F.lit(1)).alias("w")))
    members = entries(fps)
    found = connected_components(near_links(fps, members=members)).select(F.col("node").alias("fp"), "component")
    known = checkpoint(fps.join(neighbours(fps, members), "fp", "left").join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    of_class = known.groupBy("component").agg(F.min("low").alias("class_doc_id"))
    near, count = F.least("low", "near").alias("near_doc_id"), (F.col("w") - 1 + F.coalesce("others", F.lit(0))).alias("n_near")
    return known.join(of_class, "component").select("fp", near, count, "class_doc_id")


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_doc_id, n_near, class_doc_id.

    A null text counts as empty (fingerprint zero).  Repeated rows each get a row.  A single row is its own
    successor.  The last three columns are those of ``near_documents``.  Columns other than the id and the text are not read."""
    rows = with_next(docs, id_col, text)
    rows = rows.select("_p", "_n", "_end", "_id", F.char_length("_t").cast("long").alias("_c"), "_t", F.when(~F.col("_end"), edited(F.col("_t"), F.col("_next"))).alias("_e"))
    rows = rows.withColumn("_s", F.unhex(F.sha2(F.col("_e").cast("binary"), 256)))
    kinds = F.when(F.col("_end"), F.array(F.struct(F.lit(0).alias("k"), F.col("_t").alias("x")))).otherwise(
        F.array(F.struct(F.lit(0).alias("k"), F.col("_t").alias("x")), F.struct(F.lit(1).alias("k"), F.col("_e").alias("x")))
    )
    texts = rows.select("_p", "_n", "_end", "_id", "_c", "_s", F.explode(kinds).alias("_v")).select("_p", "_n", "_end", "_id", "_c", "_s", F.col("_v.k").alias("_k"), F.col("_v.x").alias("_x"))
    fps = checkpoint(simhash(texts, ["_p", "_n", "_end", "_id", "_c", "_s", "_k"], "_x"))
    w = W.partitionBy("_p").orderBy("_n", "_k")
    # Of a document come two rows, its own text's and its edited text's; then the next document's.
    seq = fps.select("*", F.lead("fp", 1).over(w).alias("_ef"), F.lead("fp", 2).over(w).alias("_nf")).where("_k = 0 AND NOT _end")
    low = near_documents(seq.select("_id", "fp")).withColumnRenamed("fp", "_f")
    out = seq.join(low, F.col("fp") == F.col("_f"), "left")
    return out.select(
        F.col("_id").alias(id_col), F.col("_c").alias("n_chars"), F.lower(F.hex("_s")).alias("edited_sha256"), hex16(F.col("fp")).alias("fingerprint"),
        hex16(F.col("_ef")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("_ef")).alias("near_edited"), likeness(F.col("fp"), F.col("_nf")).alias("near_next"), "near_doc_id", "n_near", "class_doc_id",
    )

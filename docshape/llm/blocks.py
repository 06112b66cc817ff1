"""Hamming links between 64-bit fingerprints by pigeonhole blocks.

A fingerprint is cut into blocks; two fingerprints that differ in at most
RADIUS bits agree on all but RADIUS blocks.  With five blocks there are ten
tables, each keyed by three whole blocks (38 bits or more), so chance meetings
stay rare far beyond billions of fingerprints.  Pairs that meet in a table are
verified by their Hamming distance.

A table entry that very many different fingerprints share (a family of near
copies) is not expanded into pairs: its members are joined again on the 65
values at distance at most one from each, because two fingerprints differ in
at most two bits exactly if some value lies within one bit of both.  That
verifies the same distance with work linear in the members.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

RADIUS = 2
BLOCKS = 5
#: Entries of up to so many fingerprints are verified pair by pair, larger ones by their common neighbours.
PAIRWISE = 32


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def table_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """The bits that each table's key keeps, as signed longs."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    whole = [((1 << cuts[i + 1]) - 1) & ~((1 << cuts[i]) - 1) for i in range(blocks)]
    return [_signed(sum(kept)) for kept in combinations(whole, blocks - radius)]


def block_rows(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """A row for each fingerprint and table: (t, key, fp)."""
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("t"), F.col(fp).bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(table_masks())])
    return fps.select(F.col(fp).alias("fp"), F.explode(keys).alias("x")).select("x.t", "x.key", "fp")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def entries(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """(t, key, fp, n): the fingerprints (distinct, not null) that share a table entry with another, and how many share it."""
    rows = block_rows(fps, fp)
    crowd = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return checkpoint(rows.join(crowd, ["t", "key"]).select("t", "key", "fp", "n"))


def _pairs(members: DataFrame) -> DataFrame:
    few = members.where(F.col("n") <= PAIRWISE)
    x = few.select("t", "key", F.col("fp").alias("a"))
    y = few.select("t", "key", F.col("fp").alias("b"))
    return x.join(y, ["t", "key"]).where((F.col("a") < F.col("b")) & (hamming(F.col("a"), F.col("b")) <= RADIUS)).select("a", "b")


def _around(fps: DataFrame) -> DataFrame:
    """A row for each row of ``fps`` and value ``hub`` at distance at most one from its fp."""
    return fps.select("*", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])).alias("hub"))


def near_links(fps: DataFrame, fp: str = "fp", members: DataFrame | None = None) -> DataFrame:
    """(a, b): links between different fingerprints (distinct, not null) of Hamming distance at most 2.

    Every link lies within the radius, and fingerprints within the radius are always connected: directly, or,
    within crowded entries, through the least fingerprint of a common neighbourhood, which is a path of true links
    (all that share a neighbour are within the radius of each other).  ``members`` are the ``entries`` of ``fps`` if known."""
    members = entries(fps, fp) if members is None else members
    around = _around(members.where(F.col("n") > PAIRWISE).select("fp").distinct())
    least = around.groupBy("hub").agg(F.min("fp").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").select("hub", "m")
    stars = around.join(least, "hub").where("fp <> m").select(F.col("m").alias("a"), F.col("fp").alias("b"))
    return _pairs(members).unionByName(stars).distinct()


def neighbours(fps: DataFrame, members: DataFrame) -> DataFrame:
    """(fp, near, others) of fingerprints with a neighbour: over all other fingerprints within the radius, the least ``low`` and the sum of ``w``.

    ``fps`` are (fp, low, w), ``members`` their ``entries``.  Two fingerprints of crowded entries are counted over the
    values within one bit: those at distance one or two share exactly two such values, a fingerprint all 65 with itself.
    A pair of which one is in no crowded entry meets in small entries only and is counted as a pair."""
    crowded = checkpoint(members.where(F.col("n") > PAIRWISE).select("fp").distinct())
    around = _around(crowded.join(fps, "fp"))
    hubs = around.groupBy("hub").agg(F.min("low").alias("_low"), F.sum("w").alias("_w"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    own = around.join(hubs, "hub").groupBy("fp").agg(F.min("_low").alias("near"), F.sum(F.col("_w") - F.col("w")).alias("_twice"))
    by_hub = own.select("fp", "near", F.expr("_twice div 2").alias("others"))
    pairs = _pairs(members).distinct()
    a, b = (crowded.select(F.col("fp").alias(c), F.lit(True).alias(f"_{c}")) for c in "ab")
    pairs = pairs.join(a, "a", "left").join(b, "b", "left").where("_a IS NULL OR _b IS NULL").select("a", "b")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    by_pair = both.join(fps.withColumnRenamed("fp", "b"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("low").alias("near"), F.sum("w").alias("others"))
    return by_hub.unionByName(by_pair).groupBy("fp").agg(F.min("near").alias("near"), F.sum("others").alias("others"))

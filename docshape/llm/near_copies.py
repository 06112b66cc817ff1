"""Classes of texts whose sets of word shingles have a Jaccard similarity of at least 0.8, by SimHash.

First, texts that have no near copy are told by a sample: of each set the SAMPLE least hashed shingles.  Of the least ones of a
union of two sets of similarity 0.8, four fifths on average are in both sets and in both samples, so a set is passed over if fewer
than two fifths of its sample occur in any other sample: for a pair at exactly 0.8 that has a probability of at most two in ten
million (by formula), less above, and none if the sets are no larger than the sample.  A shuffle of at most SAMPLE numbers a set; no pairs.

Each set left gets a SimHash of BITS_ALL bits: a bit is set if more than half of the shingles' hashes have it.  Two sets of
similarity s differ in a bit with probability arccos(2s / (1 + s)) / pi or near it: 0.15 at 0.8, which is ten bits of 64 and
more than block tables over 64 bits reach at a workable number.  So there are TABLES tables, each keyed by KEY bits drawn from
the long fingerprint: sets of similarity 0.8 meet in one of them with a probability of about 0.9998, at 0.85 of 0.9999999.
Sets that meet are compared by the Hamming distance of WORDS * 64 bits, whose bound lies eight deviations above a pair at 0.8 and
five below unrelated sets, and by parity sketches: each shingle flips one of 512 bits, so two sketches differ in at most as many
bits as the sets have shingles that only one of them holds, and near sets hold few of those.  What passes both is compared whole,
so no pair below 0.8 is ever linked.

This goes in two steps, so that families of near copies are not expanded into pairs.  First each set is compared with the most
central sets of its entries (those that share most entries with others), at most LEADERS of them, the ones that it meets most often:
work linear in the sets, after which a family is one class or a few.  Then every two sets of an entry that are in different classes
are compared: those outside their entry's largest class with all others, by distance and sketch within the join, and whole if they
pass.  If that takes more than PAIRWISE comparisons a row, the sets are thinned out before: what two sets share is at most
the number of their shingles that occur in any other set at all, an exact bound that rules out copies with many edits of their own.
Then every two sets of an entry have been compared, are ruled out by a bound, or are in one class.
"""

from __future__ import annotations

from functools import reduce
from itertools import islice
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpoint
from .components import connected_components

#: Bits of a fingerprint, tables, and bits of a table's key.
BITS_ALL, TABLES, KEY = 2048, 256, 20
#: Longs of the part of a fingerprint whose Hamming distance is compared, and the most bits in which near sets may differ.
WORDS, APART = 4, 88
#: Least shingles of a set by which those without near copies are told.
SAMPLE = 32
#: Comparisons within entries, for each row of them, beyond which sets are thinned out by their shared shingles first.
PAIRWISE = 32
#: Central sets that a set is compared with in the first step.
LEADERS = 16
#: Sets of a batch that a worker holds at a time.
SLICE = 256
#: Longs of a parity sketch, and their columns.
SKETCH = 8
BITS = [f"k{i}" for i in range(SKETCH)]
PRINT = [f"f{i}" for i in range(WORDS)]
_rng = np.random.Generator(np.random.PCG64(17))
_XOR, _ODD = _rng.integers(0, 1 << 63, (2, 1, BITS_ALL // 64), np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: The bits of each table's key.
_DRAWN = np.array([_rng.choice(BITS_ALL, KEY, replace=False) for _ in range(TABLES)])
_WEIGHT = np.int64(1) << np.arange(KEY, dtype=np.int64)
_TABLE = np.arange(TABLES, dtype=np.int64) << KEY


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The distinct XXH64 values (seed 42) of a whole text's shingles, ascending; a shorter text is one shingle."""
    import xxhash

    words = text.lower().split()  # as in ``simhash``
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    shingles = map(b" ".join, zip(*(islice(words, i, None) for i in range(width))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(words) - width + 1))


def simhash_bits(shingles: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashed shingles: BITS_ALL zeros and ones, one where more than half of the shingles have the bit."""
    votes = np.zeros(BITS_ALL, np.int64)
    for at in range(0, len(shingles), 255):
        h = (shingles[at : at + 255, None] ^ _XOR) * _ODD
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        votes += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return (votes * 2 > len(shingles)).astype(np.uint8)


def table_keys(bits: np.ndarray) -> np.ndarray:
    """A fingerprint's key in each table."""
    return _TABLE + bits[_DRAWN] @ _WEIGHT


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of at least 0.8."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _signer(width: int):
    def run(batches):
        import xxhash

        for batch in _slices(batches):
            sets = [shingle_set(t, width) for t in batch.column("_text").to_pylist()]
            nodes = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets), np.uint64, len(sets)).view(np.int64)
            samples = pa.array([s[:SAMPLE].view(np.int64) for s in sets], pa.list_(pa.int64()))
            rest = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, rest), pa.array(nodes), samples], names=[*rest, "node", "sample"])

    return run


def _setter(width: int):
    def run(batches):
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([shingle_set(t, width).tobytes() for t in batch.column("_text").to_pylist()], pa.binary())], names=["node", "set"])

    return run


def _verify(batches):
    for batch in _slices(batches):
        sets = (map(lambda s: np.frombuffer(s, np.uint64), batch.column(c).to_pylist()) for c in ("sa", "sb"))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array([alike(x, y) for x, y in zip(*sets)], pa.bool_())], names=["a", "b", "near"])


def signatures(src: DataFrame, width: int) -> DataFrame:
    """``src`` with, in place of the bytes ``_text``: node (the digest of its shingle set) and sample (the set's least shingles)."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name != "_text")
    return src.mapInArrow(_signer(width), f"{kinds}, node bigint, sample array<bigint>")


def shingle_sets(src: DataFrame, width: int) -> DataFrame:
    """(node, set) of rows (node, _text)."""
    return src.mapInArrow(_setter(width), "node bigint, set binary")


def _shingle_rows(batches):
    for batch in batches:
        sets = [np.frombuffer(s, np.int64) for s in batch.column("set").to_pylist()]
        for at in range(0, len(sets), 64):
            part = sets[at : at + 64]
            nodes = batch.column("node").slice(at, len(part)).take(pa.array(np.repeat(np.arange(len(part)), [len(s) for s in part])))
            yield pa.RecordBatch.from_arrays([nodes, pa.array(np.concatenate(part))], names=["node", "s"])


def unshared(rows: DataFrame) -> DataFrame:
    """(node, u): of the sets (rows (node, s), distinct) that have some, the number of shingles that no other of them has.

    A shuffle of counts by shingle: one that very many sets hold is counted before it moves."""
    alone = rows.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1")
    return alone.groupBy("node").agg(F.count(F.lit(1)).alias("u"))


def possible(first: DataFrame) -> DataFrame:
    """(node): of the sets (node, sample), those that may have a near copy by their samples."""
    k = F.size("sample")
    alone = unshared(first.select("node", F.explode("sample").alias("s")))
    return first.join(alone, "node", "left").where((k - F.coalesce("u", F.lit(0))) * 5 >= k * 2).select("node")


def parities(shingles: np.ndarray) -> np.ndarray:
    """The parity sketch of a set, as SKETCH signed longs."""
    flips = np.bincount((shingles & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64)


def _sketcher(batches):
    for batch in _slices(batches):
        sets = [np.frombuffer(s, np.uint64) for s in batch.column("set").to_pylist()]
        bits = [simhash_bits(s) for s in sets]
        prints = np.array([np.packbits(b[: 64 * WORDS], bitorder="little").view(np.int64) for b in bits], np.int64).reshape(-1, WORDS)
        flips = np.array([parities(s) for s in sets], np.int64).reshape(-1, SKETCH)
        keys = pa.array([table_keys(b).astype(np.int32) for b in bits], pa.list_(pa.int32()))
        columns = [batch.column("node"), pa.array([len(s) for s in sets], pa.int64()), *[pa.array(np.ascontiguousarray(c)) for c in (*prints.T, *flips.T)], keys]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "n", *PRINT, *BITS, "keys"])


def sketches(sets: DataFrame) -> DataFrame:
    """(node, n, f0, f1, .., k0, k1, .., keys) of each set: its size, the compared part of its SimHash, its parity sketch and its keys in the tables."""
    return sets.mapInArrow(_sketcher, f"node bigint, n bigint, {', '.join(f'{c} bigint' for c in (*PRINT, *BITS))}, keys array<int>")


def entries(nodes: DataFrame) -> DataFrame:
    """The ``sketches`` of sets that share a table's entry with another, with the keys of such entries only, and d: how many sets share them, in sum."""
    rows = nodes.select(F.explode("keys").alias("key"), "node")
    shared = rows.withColumn("m", F.count(F.lit(1)).over(W.partitionBy("key"))).where("m > 1")
    of_node = shared.groupBy("node").agg(F.collect_list("key").alias("keys"), F.sum("m").alias("d"))
    return checkpoint(nodes.drop("keys").join(of_node, "node"))


def _close():
    """Whether sets with the columns of ``sketches``, and the other's with a leading underscore, may be near by their sizes, prints and sketches."""
    sized = F.least("n", "_n") * 5 >= F.greatest("n", "_n") * 4
    print_apart, apart = (reduce(add, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"_{c}"))) for c in names]) for names in (PRINT, BITS))
    # |A ^ B| is at least the distance of the sketches, and a similarity of 0.8 needs 9 |A ^ B| <= |A| + |B|.
    return sized & (print_apart <= APART) & (apart * 9 <= F.col("n") + F.col("_n"))


def _other(rows: DataFrame, *keep: str) -> DataFrame:
    """``rows`` with a leading underscore to all columns but ``keep``."""
    return rows.select(*keep, *[F.col(c).alias(f"_{c}") for c in rows.columns if c not in keep])


def _ends():
    return F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, near) of distinct pairs (a, b)."""
    whole = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return checkpoint(whole.mapInArrow(_verify, "a bigint, b bigint, near boolean"))


def _linked(tried: DataFrame) -> DataFrame:
    return checkpoint(connected_components(tried.where("near"))).toDF("node", "class")


def central(met: DataFrame) -> DataFrame:
    """(node, _node): each set of the ``entries`` with the most central sets that it meets most often, LEADERS at most."""
    rows = met.select(F.explode("keys").alias("key"), "node", "d")
    centre = F.max(F.struct("d", "node")).over(W.partitionBy("key"))["node"]
    often = rows.select("node", centre.alias("_node")).where("node <> _node").groupBy("node", "_node").agg(F.count(F.lit(1)).alias("_often"))
    return often.withColumn("_r", F.row_number().over(W.partitionBy("node").orderBy(F.desc("_often"), "_node"))).where(F.col("_r") <= LEADERS).select("node", "_node")


def _across(met: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b), distinct: the sets of one entry and different classes that may be near.  ``met`` are the ``entries`` with their class."""
    rows = met.select(F.explode("keys").alias("key"), *[c for c in met.columns if c not in ("keys", "d")])
    key, of_class = W.partitionBy("key"), W.partitionBy("key", "class")
    rows = rows.withColumn("_m", F.count(F.lit(1)).over(of_class)).withColumn("_largest", F.max(F.struct("_m", "class")).over(key)).withColumn("_all", F.count(F.lit(1)).over(key))
    # Of two different classes one at least is not the entry's largest.
    rows = checkpoint(rows.where("_m < _all").withColumn("_outside", F.col("class") != F.col("_largest.class")).drop("_m", "_largest"))
    work = rows.agg(F.sum(F.when(F.col("_outside"), F.col("_all"))).alias("pairs"), F.count(F.lit(1)).alias("rows")).first()
    if (work["pairs"] or 0) > PAIRWISE * work["rows"]:
        held = sets.join(rows.select("node").distinct(), "node", "left_semi")
        alone = unshared(held.mapInArrow(_shingle_rows, "node bigint, s bigint"))
        rows = rows.join(alone, "node", "left").where((F.col("n") - F.coalesce("u", F.lit(0))) * 5 >= F.col("n") * 4).drop("u")
    outside, rows = _other(rows.where("_outside").drop("_all", "_outside"), "key"), rows.drop("_all", "_outside")
    return rows.join(outside, "key").where((F.col("class") != F.col("_class")) & _close()).select(*_ends()).distinct()


def classes(sets: DataFrame) -> DataFrame:
    """(node, class) of the nodes that are linked to another: the least node reached over pairs of similarity 0.8.  ``sets`` are (node, set)."""
    met = entries(sketches(sets))
    drawn = met.drop("keys", "d")
    pairs = central(met).join(drawn, "node").join(_other(drawn), "_node").where(_close()).select(*_ends()).distinct()
    tried = _near(pairs, sets)
    found = _linked(tried)
    classed = met.join(found, "node", "left").withColumn("class", F.coalesce("class", "node"))
    more = _near(_across(classed, sets).join(tried, ["a", "b"], "left_anti"), sets)
    return found if more.where("near").isEmpty() else _linked(tried.unionByName(more))

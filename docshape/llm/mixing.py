"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (operator 6).

A hash deals each source's documents into blocks of about equal size.  A
source's target says how many blocks the mix takes of it: all of them for each
whole pass, and of one more pass those that come first in a permutation of the
block numbers, the last of them in part.  These exact block quotas are split
among the output shards by a binary tree: a node deals its quota of every
source between its two halves with a multivariate hypergeometric draw, so each
leaf gets the mixture that random order without replacement would give it.
Each pass permutes the blocks of a source anew; a leaf draws the next blocks
of that order, so shards are disjoint.  What a document gives to the mix is
what the leaves drew of it; within a shard its copies are ordered by a hash.

Nothing about single sources comes to the driver, so their number has no bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpoint, shuffle_partitions

WEIGHTS = (5, 2, 1)
MOST = 3
SHARDS = 16
#: Sizes per block, on average.
BLOCK = 4096
#: Rounds of the permutation of block numbers.
ROUNDS = 24
#: Ranks of blocks that are summed together first.
RANKS = 4096
#: Sources that one task splits among the shards, on average.
GROUP = 4096
#: Copies of one row that are numbered together.
COPIES = 1 << 16


def word_count(text: Column) -> Column:
    """The number of runs of characters other than space and 0x09 to 0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\x09-\\x0D]+")), F.lit(0)).cast("long")


def split_quotas(quotas: np.ndarray, totals: np.ndarray, seed: int) -> np.ndarray:
    """The blocks of each source that each shard gets (shards x sources): sums over shards are the quotas, over sources the totals."""
    out = np.zeros((len(totals), len(quotas)), np.int64)
    todo = [(0, len(totals), np.asarray(quotas, np.int64))]
    while todo:
        low, high, q = todo.pop()
        if high - low == 1:
            out[low] = q
            continue
        mid = (low + high) // 2
        rng = np.random.Generator(np.random.PCG64([seed, low, high]))
        left = rng.multivariate_hypergeometric(q, int(totals[low:mid].sum()), method="marginals") if q.sum() else q
        todo += [(low, mid, left), (mid, high, q - left)]
    return out


def shard_totals(total: int, shards: int) -> np.ndarray:
    """``total`` blocks dealt as evenly as halving allows."""
    out = np.zeros(shards, np.int64)
    todo = [(0, shards, total)]
    while todo:
        low, high, n = todo.pop()
        if high - low == 1:
            out[low] = n
            continue
        mid = (low + high) // 2
        left = n * (mid - low) // (high - low)
        todo += [(low, mid, left), (mid, high, n - left)]
    return out


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """The place of ``x`` (0 to n - 1) in a pseudo-random permutation of n numbers that ``key`` chooses.

    Swap-or-not: each round pairs x with k - x modulo n and lets a bit of the pair's hash decide which of them follows."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), lambda r: F.xxhash64(*key, r))

    def step(at: Column, k: Column) -> Column:
        other = F.pmod(F.pmod(k, n) - at, n)
        return F.when(F.xxhash64(F.greatest(at, other), k) < 0, other).otherwise(at)

    return F.aggregate(keys, x.cast("long"), step)


def source_targets(of_source: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, s, target) of (source, s): shares of the total by weight, none above ``most`` times its size; what is cut
    off is shared again by weight until none is above.

    Sources by code point, null last, weigh ``weights`` in turn: ranges of the order are numbered apart and only the sizes
    of the ranges come to the driver.  Each round is one aggregate over the sources."""
    spark = of_source.sparkSession
    named = of_source.where("_source IS NOT NULL").repartitionByRange(shuffle_partitions(spark), "_source").withColumn("_part", F.spark_partition_id())
    named = checkpoint(named.withColumn("_n", F.row_number().over(W.partitionBy("_part").orderBy("_source"))))
    before, parts = 0, []
    for r in sorted(named.groupBy("_part").count().collect()):
        parts.append((r["_part"], before))
        before += r["count"]
    starts = F.create_map(*[F.lit(x) for p in parts for x in p]) if parts else F.create_map(F.lit(0), F.lit(0))
    number = named.select("_source", "s", (F.try_element_at(starts, F.col("_part")) + F.col("_n") - 1).alias("_i"))
    number = number.unionByName(of_source.where("_source IS NULL").select("_source", "s", F.lit(before).alias("_i")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("_i", F.lit(len(weights))) + 1).cast("int"))
    known = checkpoint(number.select("_source", "s", weight.cast("long").alias("_w")))
    unit, was = 0.0, None
    while True:
        over = F.lit(False) if was is None else F.col("_w") * F.lit(unit) > most * F.col("s")
        sums = known.where("s > 0").agg(F.sum("s").alias("total"), F.sum(F.when(over, most * F.col("s"))).alias("cut"), F.sum(F.when(~over, F.col("_w"))).alias("w"), F.count(F.when(over, True)).alias("n")).first()
        if sums["total"] is None or not sums["w"] or sums["n"] == was:
            break
        was = sums["n"]
        unit = (sums["total"] - (sums["cut"] or 0)) / sums["w"]
    share = F.least(F.col("_w") * F.lit(float(unit)), (most * F.col("s")).cast("double"))
    return known.select("_source", "s", F.when(F.col("s") > 0, share).otherwise(F.lit(0.0)).alias("target"))


def _split(totals: dict[int, list[int]], seed: int):
    def run(table: pa.Table) -> pa.Table:
        g = table.column("_g")[0].as_py()
        # The order of the rows must not matter: sources by code point, null last.
        order = sorted(range(len(table)), key=lambda i: ((x := table.column("_source")[i].as_py()) is None, x or ""))
        q = table.column("quota").to_numpy()[order]
        ends = split_quotas(q, np.array(totals[g], np.int64), seed * 1_000_003 + g).cumsum(axis=0)
        return pa.table({"_source": table.column("_source").take(pa.array(order)), "ends": pa.array([ends[:, i].tolist() for i in range(len(q))], pa.list_(pa.int64()))})

    return run


def dealt(quotas: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """(source, ends) of (source, quota): shard i draws the places ends[i - 1] to ends[i] - 1 of a source's blocks.

    Sources are hashed into groups; the tree first splits the groups' sums, then each group's task its own sources, which
    is the same distribution.  Only the groups' sums (one for about GROUP sources) come to the driver."""
    n = quotas.count()
    grouped = quotas.withColumn("_g", F.pmod(F.xxhash64("_source"), F.lit(max(1, -(-n // GROUP)))))
    sums = sorted(grouped.groupBy("_g").agg(F.sum("quota").alias("q")).collect())
    of_group = split_quotas(np.array([r["q"] for r in sums], np.int64), shard_totals(sum(r["q"] for r in sums), shards), seed)
    totals = {r["_g"]: of_group[:, i].tolist() for i, r in enumerate(sums)}
    kind = dict(quotas.dtypes)["_source"]
    return grouped.groupBy("_g").applyInArrow(_split(totals, seed + 1), f"_source {kind}, ends array<bigint>")


def _numbered(rows: DataFrame) -> DataFrame:
    """A row for each copy of (.., _n): with its number ``_c``.  Copies by the million are first cut into bounded runs."""
    few = rows.where(F.col("_n") <= COPIES).withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    runs = rows.where(F.col("_n") > COPIES).withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {COPIES}")))).repartition("_id", "_source", "_r")
    last = F.least(F.col("_n"), (F.col("_r") + 1) * COPIES) - 1
    return few.drop("_n").unionByName(runs.withColumn("_c", F.explode(F.sequence(F.col("_r") * COPIES, last))).drop("_n", "_r"))


def _on_source(rows: DataFrame, of_source: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of the one row ``of_source`` has for their source, null included."""
    other = of_source.withColumnRenamed("_source", "_other")
    return rows.join(other, F.col("_source").eqNullSafe(F.col("_other")), how).drop("_other")


def _first_over(sums: DataFrame, at: str, limit: Column) -> DataFrame:
    """(source, at, before): the first ``at`` of each source up to which the sums of ``x`` are over ``limit``, and the sum before it."""
    w = W.partitionBy("_source").orderBy(at).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = sums.withColumn("_to", F.sum("x").over(w)).where(F.col("_to") > limit)
    return run.groupBy("_source").agg(F.min(F.struct(at, (F.col("_to") - F.col("x")).alias("before"))).alias("m")).select("_source", f"m.{at}", "m.before")


def _hashed(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """``rows`` (_id, _source, _size, _c, ..) with their source's plan, their hash ``_h``, block ``_b`` and its rank in the last pass."""
    # A copy's hash deals it to its block; within a block the hash is the order.
    rows = _on_source(rows, plan).withColumn("_h", F.xxhash64(F.lit(seed), "_id", "_source", "_size", "_c"))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("_h"), F.col("blocks")))
    return rows.withColumn("_rank", permuted(F.col("_b"), F.col("blocks"), F.lit(seed), F.col("_source"), F.col("passes")))


def source_plan(counted: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, shards: int = SHARDS, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """What the mix takes of each source: a row each, from rows (_id, _source, _size, _n) that stand for _n copies.

    s and target are sizes; passes the whole passes, blocks the source's blocks; of one more pass the blocks ranked below
    _end, of that one the rows up to hash _cut, and the row of hash _eh and copy _ec; ends where the shards' draws end."""
    goals = source_targets(counted.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_n")).alias("s")), weights, most)
    passes = F.when(F.col("s") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("s")))).otherwise(F.lit(0)).cast("int")
    plan = goals.withColumn("passes", passes).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("s")))
    plan = checkpoint(plan.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("s") / block)).cast("long")))
    some = _hashed(_numbered(counted.where("_size > 0")), plan.where("rest > 0"), seed)
    some = checkpoint(some.select("_id", "_source", "_size", "_c", "_h", "_rank", "rest", F.expr(f"_rank div {RANKS}").alias("_run")))
    # The rank of the block that the rest ends in: sums by runs of ranks first, then by ranks of the one run.
    of_run = _on_source(some.groupBy("_source", "_run").agg(F.sum("_size").alias("x")), plan.select("_source", "rest"))
    run = checkpoint(_first_over(of_run, "_run", F.col("rest")))
    inside = _on_source(some, run.select("_source", F.col("_run").alias("_this"), "before")).where("_run = _this")
    of_rank = inside.groupBy("_source", "_rank", "rest", "before").agg(F.sum("_size").alias("x"))
    rank = _first_over(of_rank.withColumn("open", F.col("rest") - F.col("before")).drop("before"), "_rank", F.col("open")).withColumnRenamed("before", "_in")
    rank = checkpoint(_on_source(rank, run.select("_source", "before")).select("_source", F.col("_rank").alias("_end"), (F.col("before") + F.col("_in")).alias("_whole")))
    # Rows of that block, by hash, until the rest is met; and the one other row that fits the gap best.
    w = W.partitionBy("_source").orderBy("_h", "_id", "_c").rowsBetween(W.unboundedPreceding, W.currentRow)
    tail = _on_source(some, rank).where("_rank >= _end")
    part = tail.where("_rank = _end").withColumn("_to", F.col("_whole") + F.sum("_size").over(w)).where("_to <= rest")
    part = part.groupBy("_source").agg(F.max("_h").alias("_cut"), F.max("_to").alias("_to"))
    gap = _on_source(_on_source(rank, part, "left"), plan.select("_source", "rest"))
    gap = checkpoint(gap.select("_source", "_end", "_cut", (F.col("rest") - F.coalesce("_to", "_whole")).alias("_gap")))
    off = F.abs(F.col("_size") - F.col("_gap"))
    beyond = (F.col("_rank") > F.col("_end")) | ((F.col("_rank") == F.col("_end")) & (F.col("_cut").isNull() | (F.col("_h") > F.col("_cut"))))
    extra = _on_source(some, gap).where(beyond & (off < F.col("_gap"))).groupBy("_source").agg(F.min(F.struct(off.alias("o"), "_h", "_c")).alias("m"))
    plan = _on_source(plan.drop("rest"), gap.drop("_gap"), "left")
    plan = checkpoint(_on_source(plan, extra.select("_source", F.col("m._h").alias("_eh"), F.col("m._c").alias("_ec")), "left"))
    quotas = plan.select("_source", (F.col("passes") * F.col("blocks") + F.coalesce(F.col("_end") + 1, F.lit(0))).alias("quota"))
    return checkpoint(_on_source(plan, dealt(quotas, shards, seed)))


def draw(rows: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """``rows`` (_id, _source, _size, _c, ..) with s, target and ``shards_of``: a list of (shard, place), one for each time the mix draws the row.

    Needs nothing but a row and its source's plan, so rows stay where they are unless the plan is too large to be sent to them."""
    rows = _hashed(rows, plan, seed)
    fits = (F.col("_rank") < F.col("_end")) | ((F.col("_rank") == F.col("_end")) & (F.col("_h") <= F.col("_cut")))
    more = (F.col("_h") == F.col("_eh")) & (F.col("_c") == F.col("_ec"))

    def slot(p: Column) -> Column:
        """The place among its source's blocks at which the mix takes this row's block in pass ``p``, or null."""
        return F.struct(
            p.alias("p"),
            F.when(p < F.col("passes"), p * F.col("blocks") + permuted(F.col("_b"), F.col("blocks"), F.lit(seed), F.col("_source"), p))
            .when(fits, p * F.col("blocks") + F.col("_rank")).when(more, p * F.col("blocks") + F.col("_end")).alias("slot"),
        )

    def drawn(x: Column) -> Column:
        return F.struct(F.size(F.filter("ends", lambda e: e <= x["slot"])).alias("shard"), F.xxhash64(F.lit(seed + 1), F.col("_h"), x["p"]).alias("place"))

    quota = F.element_at("ends", -1)
    slots = F.filter(F.transform(F.sequence(F.lit(0), F.col("passes")), slot), lambda x: x["slot"].isNotNull() & (x["slot"] < quota))
    return rows.withColumn("shards_of", F.transform(slots, drawn)).drop("passes", "blocks", "_end", "_cut", "_eh", "_ec", "ends", "_h", "_b", "_rank")


def counts(rows: DataFrame) -> DataFrame:
    """Rows (_id, _source, _size) alike in all three as one, with their number ``_n``: counted before they are moved."""
    return rows.groupBy("_id", "_source", "_size").agg(F.count(F.lit(1)).alias("_n"))


def mix(docs: DataFrame, size: Column, source: str = "source", id_col: str = "doc_id", weights: tuple = WEIGHTS, most: int = MOST, shards: int = SHARDS, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """Per row of ``docs``: id, source, size, source_size, target, taken and ``shards_of``, a list of (shard, place), one for each time the mix takes it.

    Sources by code point, null last, weigh ``weights`` in turn.  A row is in the mix as often as the shards draw its
    block; of the block that the quota ends in, rows are drawn until it is met, and the one further row that fits what is
    then open best is drawn too, so a source's taken size comes close to its target.  Rows of size 0 are drawn with
    whole blocks, ``taken`` 0; a source of size 0 has target 0 and gives nothing.  The draw depends on ids, sources and sizes only: reruns agree.
    Rows alike in all three are counted before they are moved, and each copy is dealt to a block of its own choice.  An
    empty table gives no rows.  Other columns are not read, whatever their names; the id and the source may be null."""
    rows = checkpoint(counts(docs.select(F.col(id_col).alias("_id"), F.col(source).alias("_source"), size.alias("_size"))))
    out = draw(_numbered(rows), source_plan(rows, weights, most, shards, block, seed), seed)
    return out.select(
        F.col("_id").alias(id_col), F.col("_source").alias(source), F.col("_size").alias("size"), F.col("s").alias("source_size"), "target",
        (F.size("shards_of").cast("long") * F.col("_size")).alias("taken"), "shards_of",
    )


def mix_documents(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", **options) -> DataFrame:
    """``mix`` with sizes in words of the whole text (null: 0)."""
    return mix(docs, word_count(F.col(text)), source, id_col, **options)

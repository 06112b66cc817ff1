"""Best-fit packing of token sequences by a grouping genetic algorithm (operator 3).

Documents become pieces of at most CAPACITY tokens.  Pieces are dealt at random
into blocks of bounded size; each block is solved by several islands, whose
individuals, random at first, are groupings of the block's pieces into bins.  Crossover injects
whole well-filled bins of one parent into the other, drops the bins that now
hold a piece twice and best-fits the displaced pieces.  Between epochs each
island's elite moves to the next island of its block.  Bins left ill-filled are
dissolved and their pieces meet in other blocks, while that saves bins.
"""

from __future__ import annotations

import random
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, worker_state
from .tokens import Encoder

CAPACITY = 4096
END = b"\x01\x00\x00\x00"
#: Expected pieces of a block; bounds a task's memory.
BLOCK = 16384
ISLANDS = 2
EPOCHS = 2
#: Groupings that an island holds, and crossovers of an epoch at most.
POPULATION = 6
CHILDREN = 12
#: Bins emptier than this are dissolved between levels.
ILL = 0.95

_PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


def _piecer(path: str, capacity: int):
    def run(batches):
        state = worker_state()
        encode = state.__dict__.setdefault("encoders", {}).get(path) or state.encoders.setdefault(path, Encoder(path))
        step = 4 * capacity
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("_text").to_pylist()):
                ids = encode(text) + END
                for k in range(0, len(ids), step):
                    part = ids[k : k + step]
                    row.append(i)
                    piece.append(k // step)
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            rest = batch.drop_columns(["_text"]).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=[*rest.schema.names, "piece", "start", "length", "ids_crc32"],
            )

    return run


def pieces(docs: DataFrame, path: str, keep: list[str], text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each document: its columns ``keep``, piece, start, length and the CRC-32 of its ids.  One pass, no shuffle."""
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name != "_text")
    return src.mapInArrow(_piecer(path, capacity), f"{kinds}, {_PIECES}")


# ---- one block: bins are lists of item numbers, items are numbered by falling length ----


def best_fit(items, lengths: list[int], bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Puts each item into the bin with the least room that holds it, or into a new one."""
    at: dict[int, list[int]] = {}
    mask = 0
    for b, r in enumerate(room):
        at.setdefault(r, []).append(b)
        mask |= 1 << r
    for i in items:
        n = lengths[i]
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = at[r].pop()
            if not at[r]:
                mask &= ~(1 << r)
        else:
            r, b = capacity, len(bins)
            bins.append([])
            room.append(capacity)
        bins[b].append(i)
        room[b] = r = r - n
        at.setdefault(r, []).append(b)
        mask |= 1 << r


def fills(bins: list[list[int]], lengths: list[int]) -> list[int]:
    return [sum(map(lengths.__getitem__, b)) for b in bins]


def fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; then the mean square of their fill."""
    return -len(bins), sum((f / capacity) ** 2 for f in fills(bins, lengths)) / max(1, len(bins))


def lower_bound(lengths: list[int], capacity: int) -> int:
    """No grouping has fewer bins: all tokens need room, and no two items of over half a bin share one."""
    return max(-(-sum(lengths) // capacity), sum(2 * n > capacity for n in lengths))


def random_grouping(lengths: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """The items in random order, each put where it fits best."""
    order, bins = list(range(len(lengths))), []
    rng.shuffle(order)
    best_fit(order, lengths, bins, [], capacity)
    return bins


def crossover(a, b, lengths, capacity: int, rng: random.Random):
    """Whole well-filled bins of ``b``, put into ``a``; the bins of ``a`` that now hold an item twice are dissolved and
    their other items put where they fit best, the longest first.

    Well-filled are bins with no more room than the lower bound leaves a bin on average: a child of such bins only
    could still meet the bound.  If ``b`` has none, its fullest bins are taken."""
    full, bound = fills(b, lengths), lower_bound(lengths, capacity)
    enough = min(max(full), sum(lengths) // bound)
    chosen = [x for x, f in zip(b, full) if f >= enough and rng.random() < 0.5]
    taken = set().union(*chosen)
    child, displaced = [list(x) for x in chosen], []
    for x in a:
        if taken.isdisjoint(x):
            child.append(list(x))
        else:
            displaced += [i for i in x if i not in taken]
    # Mutation: a few of the emptiest bins are dissolved too.
    full = fills(child, lengths)
    at = sorted(range(len(child)), key=full.__getitem__)
    for k in at[: 1 + len(child) // 200]:
        displaced += child[k]
    gone = set(at[: 1 + len(child) // 200])
    room = [capacity - f for k, f in enumerate(full) if k not in gone]
    child = [x for k, x in enumerate(child) if k not in gone]
    best_fit(sorted(displaced), lengths, child, room, capacity)
    return child


def evolve(lengths: list[int], start: list[list[list[int]]], capacity: int, seed: int) -> tuple[list[list[int]], int, int]:
    """The best grouping that crossovers of ``start`` and of random groupings give, their number, and the bins of the best
    grouping before the first of them.  Ends when the lower bound is met, but not without a crossover of new groupings."""
    rng = random.Random(seed)
    bound = lower_bound(lengths, capacity)
    score = lambda s: fitness(s, lengths, capacity)
    if start and len(best := max(start, key=score)) <= bound:
        return best, 0, len(best)
    population = [(score(s), s) for s in start]
    while len(population) < POPULATION:
        s = random_grouping(lengths, capacity, rng)
        population.append((score(s), s))
    population.sort(reverse=True)
    first, crossed = len(population[0][1]), 0
    while crossed < CHILDREN and not (crossed and len(population[0][1]) <= bound):
        a, b = rng.sample(population, 2)
        child = crossover(a[1], b[1], lengths, capacity, rng)
        population = sorted([*population, (score(child), child)], reverse=True)[:POPULATION]
        crossed += 1
    return population[0][1], crossed, first


def _island(capacity: int, epoch: int):
    def run(table: pa.Table) -> pa.Table:
        block, island = table.column("block")[0].as_py(), table.column("island")[0].as_py()
        rows = table.select(["pid", "length", "guest", "bin", "crossed", "first"]).to_pylist()
        items = sorted({(-r["length"], r["pid"]) for r in rows})
        number = {pid: i for i, (_, pid) in enumerate(items)}
        lengths = [-n for n, _ in items]
        start = []
        for guest in (False, True):
            bins: dict[int, list[int]] = {}
            for r in rows:
                if r["guest"] is guest and r["bin"] is not None:
                    bins.setdefault(r["bin"], []).append(number[r["pid"]])
            if bins:
                start.append(list(bins.values()))
        best, crossed, first = evolve(lengths, start, capacity, (block * ISLANDS + island) * EPOCHS + epoch)
        score = fitness(best, lengths, capacity)
        mine = [r for r in rows if not r["guest"]][0]
        crossed, first = crossed + mine["crossed"], first if mine["first"] is None else mine["first"]
        out = []
        for k, b in enumerate(best):
            offset = 0
            for i in b:
                out.append((items[i][1], lengths[i], k, offset))
                offset += lengths[i]
        fill = fills(best, lengths)
        n = len(out)
        return pa.table({
            "block": pa.array([block] * n, pa.int64()), "island": pa.array([island] * n, pa.int32()), "pid": pa.array([x[0] for x in out], pa.int64()),
            "length": pa.array([x[1] for x in out], pa.int64()), "bin": pa.array([x[2] for x in out], pa.int64()), "offset": pa.array([x[3] for x in out], pa.int64()),
            "fill": pa.array([fill[x[2]] for x in out], pa.int64()), "bins": pa.array([-score[0]] * n, pa.int64()), "score": pa.array([score[1]] * n, pa.float64()),
            "crossed": pa.array([crossed] * n, pa.int64()), "first": pa.array([first] * n, pa.int64()),
        })

    return run


_SOLVED = "block bigint, island int, pid bigint, length bigint, bin bigint, offset bigint, fill bigint, bins bigint, score double, crossed bigint, first bigint"


def solve_blocks(items: DataFrame, blocks: int, capacity: int = CAPACITY, level: int = 0) -> DataFrame:
    """The best grouping of each block of (pid, length): block, pid, length, bin, offset, fill; and of the block crossovers, bins_before, bins_after."""
    dealt = items.select(
        F.pmod(F.xxhash64("pid", F.lit(level)), F.lit(blocks)).alias("block"), F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), "pid", "length",
        F.lit(False).alias("guest"), F.lit(None).cast("bigint").alias("bin"), F.lit(0).cast("bigint").alias("crossed"), F.lit(None).cast("bigint").alias("first"),
    )
    for epoch in range(EPOCHS):
        solved = checkpoint(dealt.groupBy("block", "island").applyInArrow(_island(capacity, epoch), _SOLVED))
        own = solved.select("block", "island", "pid", "length", F.lit(False).alias("guest"), "bin", "crossed", "first")
        elite = solved.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), "pid", "length", F.lit(True).alias("guest"), "bin", "crossed", "first")
        dealt = own.unionByName(elite)
    islands = solved.groupBy("block", "island").agg(*[F.max(c).alias(c) for c in ("bins", "score", "crossed", "first")])
    best = islands.groupBy("block").agg(F.min(F.struct("bins", (-F.col("score")).alias("s"), "island")).alias("w"), F.sum("crossed").alias("crossovers"), F.min("first").alias("bins_before"))
    best = best.select("block", F.col("w.island").alias("island"), "crossovers", "bins_before", F.col("w.bins").alias("bins_after"))
    return solved.select("block", "island", "pid", "length", "bin", "offset", "fill").join(best, ["block", "island"]).drop("island")


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(pid, sequence_id, offset, crossovers, bins_before, bins_after) of each (pid, length): lengths from 1 to ``capacity``, pids distinct.

    The last three are those of the block that placed the piece; a piece that fills a sequence takes part in none (null).
    Ill-filled bins are packed again in new blocks until one block is left or a level saves less than a bin a block."""

    def named(solved: DataFrame, level: int) -> DataFrame:
        return solved.select("pid", (F.lit(level << 56) + F.col("block") * (1 << 24) + F.col("bin")).alias("sequence_id"), "offset", "crossovers", "bins_before", "bins_after")

    nothing = [F.lit(None).cast("bigint").alias(c) for c in ("crossovers", "bins_before", "bins_after")]
    done = items.where(F.col("length") >= capacity).select("pid", (-1 - F.col("pid")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), *nothing)
    rest, ill, open_bins, level = items.where(F.col("length") < capacity).select("pid", "length"), None, None, 0
    while n := rest.count():
        blocks = -(-n // BLOCK)
        solved = checkpoint(solve_blocks(rest, blocks, capacity, level))
        bins = solved.select("block", "bin").distinct().count()
        if open_bins is not None and bins >= open_bins:
            return done.unionByName(named(ill, level - 1))
        if blocks == 1 or (open_bins is not None and open_bins - bins < blocks):
            return done.unionByName(named(solved, level))
        done = done.unionByName(named(solved.where(F.col("fill") >= ILL * capacity), level))
        ill = solved.where(F.col("fill") < ILL * capacity)
        rest, open_bins, level = ill.select("pid", "length"), ill.select("block", "bin").distinct().count(), level + 1
    return done


def pack_documents(docs: DataFrame, path: str, keep: list[str] | None = None, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Per piece: the columns ``keep`` of its document (doc_id by default), piece, start, length, ids_crc32, sequence_id, offset, and ``pack``'s crossovers, bins_before, bins_after.

    Null and empty texts are documents of one token, the end id.  Only documents longer than ``capacity`` are cut,
    all pieces but the last to full length.  Repeated rows are packed each for itself; null ids are kept.  An empty table gives no
    rows.  Other columns are not read and ``keep`` may have any names but those of the result."""
    keep = keep or ["doc_id"]
    cut = checkpoint(pieces(docs, path, keep, text, capacity).withColumn("_pid", F.monotonically_increasing_id()))
    placed = pack(cut.select(F.col("_pid").alias("pid"), "length"), capacity)
    return cut.join(placed, F.col("_pid") == F.col("pid")).select(*[F.col(f"`{c}`") for c in keep], "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "crossovers", "bins_before", "bins_after")

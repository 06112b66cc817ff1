"""Exact top-k inner products by aggregation without random access (operator 8).

Candidates are dealt into blocks.  In a block every dimension has its list of
candidates sorted by value.  A query reads all lists of its non-zero
components in step, each from the end that suits the component's sign, in
stretches of doubling length; no candidate is looked up.  What is read adds to
its candidate's partial score.  A component not yet seen is bounded by the last
value read from its list on one side and by the list's other end on the other,
which gives every candidate, seen or not, an upper and a lower bound.  Candidates
whose upper bound lies below the k-th best lower bound are out.  Reading stops
when few are left, whose scores are then resolved exactly.  The blocks' winners
are merged by query.

The queries of a block read together: what a depth shows of the lists is laid
out once (``Lists.shown``), and the bounds of many queries are products with it.
A few queries go first; the others begin at the depth that these needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpoint

K = 5
SCALE = 256
EVERY = 50
#: Expected rows of a block of candidates, and of queries: a task holds one of each.
CANDIDATES = 16384
QUERIES = 16384
#: Small tables are dealt into up to so many blocks of candidates of so many rows.
SPREAD, SMALL = 8, 2048
#: The first stretch of the lists, as a share of a block; each next one doubles what is read.
FIRST_DEPTH = 1 / 16
#: Queries whose bounds are held at once, and those that find the depth at which the others begin.
BATCH, SCOUTS = 128, 8
_PAIRS = 1 << 16


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of longs, padded with zeros."""
    sizes = pc.list_value_length(column).to_numpy().astype(np.int64)
    flat = pc.list_flatten(column).to_numpy()
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of one query; Python integers where longs could overflow, then held to the range of a long."""
    bound = float(np.abs(q.astype(np.float64)) @ np.abs(x.astype(np.float64)).max(axis=0, initial=0))
    if bound < 2.0**62:
        return x @ q
    lim = (1 << 63) - 1
    return np.array([max(-lim - 1, min(lim, sum(int(a) * int(b) for a, b in zip(q, row)))) for row in x], np.int64)


class Lists:
    """Each dimension's list of a block's candidates, from its highest and from its lowest value."""

    def __init__(self, x: np.ndarray):
        f = x.T.astype(np.float64)
        low = np.argsort(f, axis=1, kind="stable").astype(np.int32)
        values = np.take_along_axis(f, low, axis=1)
        self.ids, self.values = (low[:, ::-1], low), (values[:, ::-1], values)
        self._shown: tuple = (None, None)

    def shown(self, depth: int, kind: type) -> list[tuple[np.ndarray, np.ndarray]]:
        """For the lists read from the high and from the low end: the values of all candidates (by dimension) as the first
        ``depth`` places show them, those not read taken as the last value read, and taken as the list's other end."""
        if self._shown[0] != (depth, kind):
            out = []
            for up in (False, True):
                ids, values = self.ids[up][:, :depth], self.values[up][:, :depth]
                best = np.repeat(values[:, -1:].astype(kind), self.ids[up].shape[1], axis=1)
                np.put_along_axis(best, ids, values.astype(kind), axis=1)
                worst = best
                if depth < best.shape[1]:
                    worst = np.repeat(self.values[not up][:, :1].astype(kind), best.shape[1], axis=1)
                    np.put_along_axis(worst, ids, values.astype(kind), axis=1)
                out.append((best, worst))
            self._shown = ((depth, kind), out)
        return self._shown[1]


def aggregate_all(q: np.ndarray, lists: Lists, n: int, k: int, own: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate) pairs, by query, of which the k best of each row of ``q`` are some, and how deep each query read the lists.

    ``own`` is the place of a query among the candidates, or -1: it is none of them.  ``start`` is the first depth.
    Scores are kept as floats: where these are not exact, bounds are widened by what rounding could have moved them."""
    m, every = len(q), np.arange(n)
    depths = np.zeros(m, np.int64)
    if n <= 4 * k or not q.shape[1]:
        rows, cols = np.repeat(np.arange(m), n), np.tile(every, m)
        kept = cols != np.repeat(own, n)
        return rows[kept], cols[kept], depths
    ends = np.maximum(np.abs(lists.values[0][:, 0]), np.abs(lists.values[1][:, 0]))
    most = np.abs(q.astype(np.float64)) @ ends
    bound = float(most.max(initial=0))
    kind = np.float32 if bound < 2.0**24 and ends.max() < 2.0**24 and np.abs(q.astype(np.float64)).max() < 2.0**24 else np.float64
    slack = np.zeros(m, kind) if bound < 2.0**53 else 1e-12 * q.shape[1] * most
    falling, rising = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
    left, depth, found = np.arange(m), min(start, n), []
    while len(left):
        (best, worst), (low_best, low_worst) = lists.shown(depth, kind)
        upper = falling[left] @ best if depth < n else q[left].astype(kind) @ best
        if depth < n:
            lower = falling[left] @ worst
            upper += rising[left] @ low_best
            lower += rising[left] @ low_worst
        else:  # all lists are read: both bounds are the score
            lower = upper.copy()
        upper += slack[left, None]
        lower -= slack[left, None]
        held = np.flatnonzero(own[left] >= 0)
        upper[held, own[left][held]] = lower[held, own[left][held]] = -np.inf
        kth = np.partition(lower, n - k, axis=1)[:, n - k]
        among = upper >= kth[:, None]
        done = (among.sum(axis=1) <= max(4 * k, n // 64)) | (depth == n)
        depths[left[done]] = depth
        at, cols = np.nonzero(among[done])
        found.append((left[done][at], cols))
        left, depth = left[~done], min(2 * depth, n)
    rows, cols = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(rows, kind="stable")
    return rows[order], cols[order], depths


def first_depth(n: int, k: int, first: float = FIRST_DEPTH) -> int:
    return max(k + 2, int(n * first))


def aggregate(q: np.ndarray, lists: Lists, n: int, k: int, own: int | None, first: float = FIRST_DEPTH) -> tuple[np.ndarray, int]:
    """The candidates that may be among the k best of query ``q`` other than candidate ``own``, and how deep the lists were read."""
    _, cols, depths = aggregate_all(q[None, :], lists, n, k, np.array([-1 if own is None else own]), first_depth(n, k, first))
    return cols, int(depths[0])


def _resolved(q: np.ndarray, x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """The exact scores of pairs that lie by query."""
    bound = float((np.abs(q.astype(np.float64)) @ np.abs(x.astype(np.float64)).max(axis=0, initial=0)).max(initial=0))
    if bound < 2.0**62:
        parts = [np.einsum("ij,ij->i", q[rows[at : at + _PAIRS]], x[cols[at : at + _PAIRS]]) for at in range(0, len(rows), _PAIRS)]
    else:
        cuts = np.flatnonzero(np.diff(rows)) + 1
        parts = [exact_scores(q[r[0]], x[c]) for r, c in zip(np.split(rows, cuts), np.split(cols, cuts)) if len(r)]
    return np.concatenate([np.zeros(0, np.int64), *parts])


def block_top(qid: np.ndarray, q: np.ndarray, qrow: np.ndarray, cid: np.ndarray, x: np.ndarray, crow: np.ndarray, k: int) -> tuple[list, list, list, list]:
    """(query row, query, candidate, score) of each query's k best candidates of a block other than its own row; ties to smaller ids."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    lists, place, n = Lists(x), {r: i for i, r in enumerate(crow.tolist())}, len(cid)
    own = np.array([place.get(r, -1) for r in qrow.tolist()], np.int64)
    at, start = 0, first_depth(n, k)
    while at < len(qid):
        part = slice(at, at + (BATCH if at else SCOUTS))
        rows, cols, depths = aggregate_all(q[part], lists, n, k, own[part], start)
        if not at:
            start = max(start, int(np.median(depths)))
        scores = _resolved(q[part], x, rows, cols)
        order = np.lexsort((cid[cols], ~scores, rows))
        rows, cols, scores = rows[order], cols[order], scores[order]
        best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        for have, more in zip(out, (qrow[part][rows[best]], qid[part][rows[best]], cid[cols[best]], scores[best])):
            have += more.tolist()
        at = part.stop
    return out


def _cell(k: int):
    def run(cell: pa.Table) -> pa.Table:
        got = ([], [], [], [])
        asks = pc.equal(cell.column("asks"), True)
        queries, candidates = cell.filter(asks), cell.filter(pc.invert(asks))
        if len(queries) and len(candidates):
            width = max(pc.max(pc.list_value_length(t.column("x"))).as_py() for t in (queries, candidates))
            (qid, q, qrow), (cid, x, crow) = ((t.column("id").to_numpy(), _matrix(t.column("x"), width), t.column("row").to_numpy()) for t in (queries, candidates))
            got = block_top(qid, q, qrow, cid, x, crow, k)
        return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("row", "query_id", "vec_id", "score"), got)})

    return run


def quantized(vectors: DataFrame, id_col: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, x): floor(scale * component) of each usable vector.  Rows with a null id, a null vector or a null or
    non-finite component are left out; floors outside a long take its end."""
    v = F.transform(F.col(vector), lambda e: F.floor(e.cast("double") * scale).cast("long"))
    ok = F.col(id_col).isNotNull() & F.col(vector).isNotNull() & F.forall(F.col(vector), lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    small = F.forall(F.col(vector), lambda e: F.abs(e.cast("double")) * scale < F.lit(9.2e18))
    held = F.transform(F.col(vector), lambda e: F.when(F.abs(e.cast("double")) * scale < F.lit(9.2e18), F.floor(e.cast("double") * scale).cast("long")).when(e > 0, F.lit((1 << 63) - 1)).otherwise(F.lit(-(1 << 63))))
    return vectors.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.when(small, v).otherwise(held).alias("x"))


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id ``every`` divides its k highest integer inner products with all other rows, ties to smaller ids.

    Rows count each for itself, however alike: a row of a query's id or vector is one of its candidates, only the query's
    own row is not, and rows of one id are queries of their own.  Shorter vectors count as padded with zeros.  With fewer candidates than k, all are given.
    Null ids, null vectors and vectors with a null or non-finite component take no part; an empty table gives no rows; other columns are not read.
    Queries and candidates meet in cells of bounded size: each candidate is sent once for each block of queries,
    each query once for each block of candidates; of a cell, k rows a query come back."""
    kept = checkpoint(quantized(vectors, id_col, vector, scale).withColumn("row", F.monotonically_increasing_id()))
    queries = kept.where(F.col("id") % every == 0)
    n, m = kept.count(), queries.count()
    cells, groups = max(1, -(-n // CANDIDATES), min(SPREAD, -(-n // SMALL))), max(1, -(-m // QUERIES))
    c = kept.select(F.pmod(F.xxhash64("row"), F.lit(cells)).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")).alias("g"), F.lit(False).alias("asks"), "id", "x", "row")
    q = queries.select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1)).cast("array<bigint>")).alias("c"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups)).alias("g"), F.lit(True).alias("asks"), "id", "x", "row")
    found = q.unionByName(c).groupBy("c", "g").applyInArrow(_cell(k), "row bigint, query_id bigint, vec_id bigint, score bigint")
    w = W.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

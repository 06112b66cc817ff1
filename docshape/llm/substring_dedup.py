"""Repeated substrings by a sparse distributed suffix array (operator 9).

Every WINDOW-byte string has one anchor, the place of the least hash among its
GRAM-byte strings, so equal strings have equal anchors and only suffixes that
start at anchors need sorting.  Suffixes whose first GRAM bytes occur once in
the corpus cannot match and stay behind.  The others are sorted where they lie,
and the sorted runs are exchanged front-coded (the length of the prefix shared
with the run's last suffix, and the rest).  A loser tree merges the runs of a
bucket and compares only beyond prefixes known to be equal; its output carries
the common-prefix lengths of neighbours.  Stretches that share the anchor's
prefix are then resolved window by window, exactly, on their bytes.

What repeats within one run is settled there: the run then sends its content
once, without owners, so a passage that a third of all texts share reaches a
bucket once a run and not once a text.
"""

from __future__ import annotations

import hashlib
import marshal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, placed, shuffle_partitions, worker_state

WINDOW = 200
GRAM = 64
_PLACES = WINDOW - GRAM + 1
#: Window starts per stretch of text that is hashed at once.
_STRETCH = 1 << 20
#: Anchors that occur more often are cut into groups of STEP windows, so that no class of different contexts is large,
HOT = 512
STEP = 16
#: and those that occur more often still into single windows, which are in one class only if they are equal.
VERY_HOT = 16_384
#: The kinds of runs: suffixes at anchors, groups of windows, single windows; and spans that need no merging.
_STEPS = {1: STEP, 2: 1}
_SETTLED = 3
#: Suffixes that a task sorts into one run.
RUN = 200_000
_POS = np.uint64((1 << 24) - 1)


def _tables(n: int):
    """Random byte codes, powers of an odd base and of its inverse modulo 2^64."""
    state = worker_state()
    have = state.__dict__.get("powers")
    if have is None or len(have[1]) < n:
        rng = np.random.Generator(np.random.PCG64(9))
        codes = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        base = 0x9E3779B97F4A7C15
        inverse = pow(base, -1, 1 << 64)

        def powers(b: int) -> np.ndarray:
            out = np.full(n, b, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        state.powers = have = codes, powers(base), powers(inverse)
    return have


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def anchors(parts: list[bytes]):
    """(part, anchor, lo, hi, hash) of each anchor of the parts' windows: those that start lo to hi bytes before it.

    Parts are laid end to end; windows that would cross a border are left out."""
    buf = np.frombuffer(b"".join(parts), np.uint8)
    n = len(buf)
    codes, power, inverse = _tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(codes[buf] * power[:n], out=total[1:])
    h = _mixed((total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1])
    m = len(h)
    # The least of each stretch of _PLACES values: prefix minima of blocks against suffix minima of the blocks before.
    val = (h & ~_POS) | np.arange(m, dtype=np.uint64)
    padded = np.full(-(-(m + _PLACES) // _PLACES) * _PLACES, np.iinfo(np.uint64).max)
    padded[:m] = val
    blocks = padded.reshape(-1, _PLACES)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[: n - WINDOW + 1], before[_PLACES - 1 : n - WINDOW + _PLACES]) & _POS
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - WINDOW + 1, 0)
    part = np.repeat(np.arange(len(parts)), counts)
    p = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    a = least[p].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (part[1:] != part[:-1])])) if len(a) else np.zeros(0, np.int64)
    last = np.concatenate([first[1:], [len(a)]])[: len(first)] - 1
    at = a[first]
    return part[first], at - starts[part[first]], at - p[last], at - p[first], h[at]


def _stretches(texts: list[bytes]):
    """Groups of (text number, start, bytes): whole texts, or overlapping stretches of long ones."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for start in range(0, max(0, len(t) - WINDOW + 1), _STRETCH):
            piece = t[start : start + _STRETCH + WINDOW - 1]
            group.append((i, start, piece))
            size += len(piece)
            if size >= _STRETCH:
                yield group
                group, size = [], 0
    if group:
        yield group


def _anchor_counts(batches):
    for batch in batches:
        found = [anchors([x for _, _, x in g])[4] for g in _stretches(batch.column("_t").to_pylist())]
        h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])


def _anchor_rows(batches):
    for batch in batches:
        keys, texts = batch.column("_key"), batch.column("_t").to_pylist()
        for g in _stretches(texts):
            part, at, lo, hi, h = anchors([x for _, _, x in g])
            text, start = np.array([i for i, _, _ in g])[part], np.array([s for _, s, _ in g])[part]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), keys.take(pa.array(text)), pa.array(at + start), pa.array(lo.astype(np.int16)), pa.array(hi.astype(np.int16))], names=["h", "_key", "a", "lo", "hi"]
            )


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix, of which ``known`` bytes are known to be equal."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    x = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (x.bit_length() + 7) // 8


def front_code(items: list[tuple]) -> bytes:
    """A run: (suffix, rest of the item) sorted by suffix; each as the length shared with the one before, and what follows."""
    out, last = [], b""
    for right, *rest in sorted(items):
        n = common_prefix(last, right)
        out.append((n, right[n:], *rest))
        last = right
    return marshal.dumps(out)


def read_run(run: bytes):
    """(prefix shared with the one before, suffix, rest) of each item of a run."""
    last = b""
    for n, tail, *rest in marshal.loads(run):
        last = last[:n] + tail
        yield n, last, rest


def merge(runs: list):
    """The items of sorted runs in order, as (prefix shared with the item before, suffix, rest): a loser tree.

    Each loser keeps the length of the prefix that it shares with the item that beat it.  Against a later winner the
    longer such prefix wins unseen; only equal ones are compared, from there on."""
    k = 1
    while k < len(runs):
        k *= 2
    iters = [iter(r) for r in runs]
    heads = [next(i, None) for i in iters] + [None] * (k - len(runs))
    shared = [0] * k  # with the last item given out
    losers = [-1] * k

    def beats(x: int, y: int) -> bool:
        """Whether run x comes first; sets the loser's shared length with the winner."""
        a, b = heads[x], heads[y]
        if a is None or b is None:
            return b is None
        if shared[x] != shared[y]:
            return shared[x] > shared[y]  # the loser's length with the winner stays what it is
        n = common_prefix(a[1], b[1], shared[x])
        first = a[1][n:] <= b[1][n:]
        shared[y if first else x] = n
        return first

    def build(node: int) -> int:
        if node >= k:
            return node - k
        x, y = build(2 * node), build(2 * node + 1)
        if beats(x, y):
            losers[node] = y
            return x
        losers[node] = x
        return y

    winner = build(1)
    while heads[winner] is not None:
        _, suffix, rest = heads[winner]
        yield shared[winner], suffix, rest
        heads[winner] = head = next(iters[winner], None) if winner < len(iters) else None
        shared[winner] = head[0] if head else 0
        node = (winner + k) // 2
        while node:
            if not beats(winner, losers[node]):
                winner, losers[node] = losers[node], winner
            node //= 2


def resolve(group: dict, found: list) -> None:
    """Of items (left, right, lo, hi): [times, owners] that share an anchor's prefix, adds (owner, first byte, end) of repeated windows."""
    if len(group) == 1:
        ((left, right, lo, hi), (times, owners)), = group.items()
        if times > 1:
            found += [(key, a - hi, a - lo + WINDOW) for key, a in owners]
        return
    seen: dict = {}
    for (left, right, lo, hi), (times, _) in group.items():
        s, w = left + right, min(2, times)
        for p in range(hi - lo + 1):
            x = s[p : p + WINDOW]
            seen[x] = seen.get(x, 0) + w
    for (left, right, lo, hi), (_, owners) in group.items():
        s, start = left + right, None
        for p in range(hi - lo + 2):
            again = p <= hi - lo and seen[s[p : p + WINDOW]] > 1
            if again and start is None:
                start = p
            elif not again and start is not None:
                found += [(key, a - hi + start, a - hi + p - 1 + WINDOW) for key, a in owners]
                start = None


def repeats(runs: list, core: int) -> list:
    """(owner, first byte, end) of the repeated windows among the items of sorted runs whose classes share ``core`` bytes."""
    found, group = [], {}
    for n, right, (left, lo, hi, times, owners) in merge(runs):
        if n < core and group:
            resolve(group, found)
            group = {}
        have = group.setdefault((left, right, lo, hi), [0, []])
        have[0] += times
        have[1] += owners
    if group:
        resolve(group, found)
    return found


def _core(kind: int) -> int:
    """The bytes that a class of this kind shares at least."""
    return WINDOW - _STEPS[kind] + 1 if kind else GRAM


def _bucket(data: bytes, buckets: int) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest()) % buckets


def _runs(buckets: int):
    def flush(items: dict):
        out: dict = {}
        settled: dict = {}
        for (kind, left, right, lo, hi), owners in items.items():
            if len(owners) > 1:
                for key, a in owners:
                    settled.setdefault(key, []).append((a - hi, a - lo + WINDOW))
            out.setdefault((_bucket(right[: _core(kind)], buckets), kind), []).append((right, left, lo, hi, min(2, len(owners)), owners if len(owners) == 1 else []))
        rows = [(bucket, kind, front_code(run)) for (bucket, kind), run in sorted(out.items())]
        spans: dict = {}
        for key, found in settled.items():
            spans.setdefault(_bucket(key, buckets), []).extend((key, s, e) for s, e in union(found))
        rows += [(bucket, _SETTLED, marshal.dumps(found)) for bucket, found in spans.items()]
        cols = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "kind", "run"])

    def run(batches):
        items, n = {}, 0
        for batch in batches:
            for key, t, cells in zip(*(batch.column(c).to_pylist() for c in ("_key", "_t", "cells"))):
                for c in cells:
                    a, lo, hi, kind = c["a"], c["lo"], c["hi"], c["kind"]
                    if not kind:
                        items.setdefault((0, t[a - hi : a], t[a : a - lo + WINDOW], lo, hi), []).append((key, a))
                        n += 1
                    else:
                        step = _STEPS[kind]
                        for j in range(lo // step, hi // step + 1):
                            at, x, y = a - step * j, max(lo - step * j, 0), min(hi - step * j, step - 1)
                            items.setdefault((kind, t[at - y : at], t[at : at - x + WINDOW], x, y), []).append((key, at))
                            n += 1
                    if n >= RUN:
                        yield flush(items)
                        items, n = {}, 0
        if items:
            yield flush(items)

    return run


def _merge_bucket(table: pa.Table) -> pa.Table:
    kind, runs = table.column("kind")[0].as_py(), table.column("run").to_pylist()
    found = [x for r in runs for x in marshal.loads(r)] if kind == _SETTLED else repeats([read_run(r) for r in runs], _core(kind))
    return pa.table({"_key": pa.array([k for k, _, _ in found], pa.binary()), "s": pa.array([s for _, s, _ in found], pa.int64()), "e": pa.array([e for _, _, e in found], pa.int64())})


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that spans cover."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def _cut(batches):
    for batch in batches:
        rows = []
        for key, t, n, spans in zip(*(batch.column(c).to_pylist() for c in ("_key", "_t", "copies", "spans"))):
            found = [(0, len(t))] if n > 1 and len(t) >= WINDOW else union([(x["s"], x["e"]) for x in spans or []])
            kept, at = [], 0
            for s, e in found:
                kept.append(t[at:s])
                at = e
            kept.append(t[at:])
            data = b"".join(kept)
            rows.append((key, len(t), len(t) - len(data), len(found), hashlib.sha256(data).hexdigest(), [x for f in found for x in f]))
        cols = list(zip(*rows)) if rows else [[]] * 6
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, spans (start and end of each removed run, in bytes).

    A byte goes if a WINDOW-byte string over it also starts anywhere else in the corpus, the same text included.
    Null and empty texts have no bytes.  Repeated rows repeat each other, so all their windows go; null ids get rows
    too.  An empty table gives no rows; other columns are not read.  Equal texts are worked on once."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    src = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_t")).withColumn("_key", F.unhex(F.md5("_t")))
    texts = placed(src.groupBy("_key").agg(F.count(F.lit(1)).alias("copies"), F.first("_t").alias("_t")), "_key", parts)
    long = texts.where(F.length("_t") >= WINDOW).select("_key", "_t")
    # Kept apart from the join, so that adaptive execution may split the rows of an anchor that very many texts have.
    again = checkpoint(long.select("_t").mapInArrow(_anchor_counts, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"))
    kind = F.when(F.col("n") > VERY_HOT, 2).when(F.col("n") > HOT, 1).otherwise(0)
    rows = long.mapInArrow(_anchor_rows, "h bigint, _key binary, a bigint, lo smallint, hi smallint")
    cells = rows.join(again, "h").select("_key", F.struct("a", "lo", "hi", kind.alias("kind")).alias("c")).groupBy("_key").agg(F.collect_list("c").alias("cells"))
    runs = long.join(cells, "_key").mapInArrow(_runs(2 * parts), "bucket int, kind int, run binary")
    spans = runs.groupBy("bucket", "kind").applyInArrow(_merge_bucket, "_key binary, s bigint, e bigint")
    of_text = spans.groupBy("_key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    cut = texts.join(of_text, "_key", "left").select("_key", "_t", "copies", "spans").mapInArrow(_cut, "_key binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>")
    return src.select("_id", "_key").join(cut, "_key").select(F.col("_id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")

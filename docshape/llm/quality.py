"""Quality classifier by positive-unlabelled learning (operator 5).

Trusted positives are rows labelled 1, unlabelled rows stand for web text.  The
class prior is estimated from the scores that a first positive-against-unlabelled
model gives all unlabelled documents (the least ratio of unlabelled to positive
mass above a threshold); the final network minimises the non-negative unbiased
risk.  A two-parameter logistic map, fitted on labelled training rows, turns its
output into a score between 0 and 1.  Means and deviations of the features are
those of all documents; only the rows that the networks are fitted on are a
bounded sample.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of each kind (positive, unlabelled, labelled negative) that the networks are fitted on at most, those of the smallest hashes.
SAMPLE = 6000
BUCKETS = 256
HIDDEN = 32
STEPS = 1500
BATCH = 512
FOLDS = 5
THRESHOLD = 0.3
_STATS = 14
#: Thresholds at which the tails are compared.
CUTS = 60
#: For means and deviations features are whole multiples of 1 / _UNIT, so that sums do not depend on their order; values beyond _FAR count as _FAR.
_UNIT, _FAR = 4096, 64
WIDTH = _STATS + BUCKETS


def _stats(data: bytes) -> list[float]:
    n = max(1, len(data))
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    w, k = max(1, len(words)), max(1, len(lines))
    a = np.frombuffer(data, np.uint8)
    upper, digit = int(((a >= 65) & (a <= 90)).sum()), int(((a >= 48) & (a <= 57)).sum())
    letter = upper + int(((a >= 97) & (a <= 122)).sum()) + int((a >= 128).sum())
    space = data.count(b" ") + data.count(b"\n")
    counts, once = Counter(words), len(set(lines))
    distinct, first = len(counts), max((counts[x] for x in words[:8]), default=0)
    return [
        math.log1p(len(data)), upper / n, digit / n, letter / n, space / n, (n - letter - digit - space) / n, n / w / 10, distinct / w, math.log1p(distinct) - math.log1p(w),
        once / k, math.log1p(k) - math.log1p(w), sum(x.rstrip()[-1:] in b".!?" for x in lines) / k, max(map(len, words), default=0) ** 0.5 / 10, first / w,
    ]


def features(texts: list[bytes]) -> np.ndarray:
    """Statistics of each whole text and the shares of its hashed byte pairs."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for i, data in enumerate(texts):
        out[i, :_STATS] = _stats(data)
        a = np.frombuffer(data, np.uint8).astype(np.uint32)
        if len(a) > 1:
            pair = ((a[:-1] * np.uint32(0x9E3779B1) + a[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(17)) % BUCKETS
            out[i, _STATS:] = np.sqrt(np.bincount(pair, minlength=BUCKETS) / len(pair))
    return out


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """One hidden layer; output is a real margin."""

    def __init__(self, width: int, rng: np.random.Generator):
        self.w1 = rng.normal(0, 1 / math.sqrt(width), (width, HIDDEN))
        self.b1, self.w2, self.b2 = np.zeros(HIDDEN), rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.zeros(1)
        self._m = [np.zeros_like(p) for p in self.parts()]
        self._v = [np.zeros_like(p) for p in self.parts()]
        self._t = 0

    def parts(self):
        return [self.w1, self.b1, self.w2, self.b2]

    def __call__(self, x):
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2[0]

    def step(self, x, slope, rate: float = 2e-3, decay: float = 1e-4):
        """Adam on the gradient whose derivative with respect to each row's margin is ``slope``."""
        h = x @ self.w1 + self.b1
        on = np.maximum(h, 0)
        back = np.outer(slope, self.w2) * (h > 0)
        grads = [x.T @ back + decay * self.w1, back.sum(0), on.T @ slope + decay * self.w2, np.array([slope.sum()])]
        self._t += 1
        for p, g, m, v in zip(self.parts(), grads, self._m, self._v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**self._t)) / (np.sqrt(v / (1 - 0.999**self._t)) + 1e-8)


def fit_pu(pos: np.ndarray, unl: np.ndarray, prior: float, seed: int, steps: int = STEPS) -> Network:
    """Minimises prior * R+(pos) + max(0, R-(unl) - prior * R-(pos)) with the sigmoid loss; where the bracket is negative, its gradient is reversed."""
    rng = np.random.Generator(np.random.PCG64(seed))
    net = Network(pos.shape[1], rng)
    for _ in range(steps):
        p, u = pos[rng.integers(0, len(pos), BATCH)], unl[rng.integers(0, len(unl), BATCH)]
        sp, su = _sigmoid(net(p)), _sigmoid(net(u))
        dp, du = sp * (1 - sp) / len(p), su * (1 - su) / len(u)  # of the mean loss of class -1; of class +1 it is the opposite
        negative = su.mean() - prior * sp.mean()
        if negative >= 0:
            net.step(np.vstack([p, u]), np.concatenate([-prior * dp - prior * dp, du]))
        else:
            net.step(np.vstack([p, u]), np.concatenate([prior * dp, -du]))
    return net


def moments(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each feature over all rows of ``texts`` (_text binary); a row a feature comes to the driver."""

    def run(batches):
        n, s, ss = 0, np.zeros(WIDTH, np.int64), np.zeros(WIDTH, np.int64)
        for batch in batches:
            v = np.rint(np.clip(features(batch.column("_text").to_pylist()), -_FAR, _FAR).astype(np.float64) * _UNIT).astype(np.int64)
            n, s, ss = n + len(v), s + v.sum(0), ss + (v * v).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDTH, dtype=np.int32)), pa.array([n] * WIDTH, pa.int64()), pa.array(s), pa.array(ss)], names=["j", "n", "s", "ss"])

    whole = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "s", "ss")]
    rows = sorted(texts.mapInArrow(run, "j int, n bigint, s bigint, ss bigint").groupBy("j").agg(*whole).collect())
    n = max(1, int(rows[0]["n"])) if rows else 1
    mean = np.array([float(r["s"]) / n / _UNIT for r in rows] or [0.0] * WIDTH)
    square = np.array([float(r["ss"]) / n / _UNIT**2 for r in rows] or [0.0] * WIDTH)
    return mean, np.sqrt(np.maximum(square - mean**2, 0)) + 1e-3


def prior_from_tails(pos: np.ndarray, cuts: np.ndarray, above: list[int], total: int) -> float:
    """The share of positives among ``total`` unlabelled rows of which ``above`` score at least ``cuts``: the ratio of the
    tails at the cut where the ratio with a margin for chance is least.  The margin only chooses the cut; it is no part of the share."""
    sp, margin, best = np.sort(pos), math.sqrt(math.log(4 / 0.1) / 2), (math.inf, 1.0)
    for cut, n in zip(cuts, above):
        qp, qu = max(1e-9, 1 - np.searchsorted(sp, cut) / len(sp)), n / max(1, total)
        best = min(best, ((qu + margin / math.sqrt(max(1, total)) * 0.5) / qp, qu / qp))
    return float(min(0.98, max(0.05, best[1])))


def calibrate(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic map from margins to the probability of label 1."""
    a, b = 1.0, 0.0
    if not len(label) or label.min() == label.max():
        return a, b
    x = np.stack([margin, np.ones_like(margin)], 1)
    w = np.array([a, b])
    for _ in range(50):
        p = _sigmoid(x @ w)
        h = x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(h, x.T @ (p - label) + 1e-3 * w)
        w = np.clip(w, -50, 50)
    return float(max(w[0], 1e-6)), float(w[1])


def fold(id_col: str, folds: int = FOLDS):
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def _unlabelled(ids: DataFrame, known: DataFrame, sample: int) -> DataFrame:
    """(_id): the ``sample`` ids of the smallest hashes that ``known`` does not hold.  Only ids below a hash that leaves enough are joined."""
    order, n = F.xxhash64(F.lit(5), F.col("_id")), ids.count()
    share = min(1.0, 8 * sample / max(1, n))
    while True:
        low = ids if share >= 1 else ids.where(order < F.lit(int(share * 2**64) - 2**63))
        found = low.distinct().join(known, "_id", "left_anti")
        if share >= 1 or found.count() >= sample:
            return found.orderBy(order).limit(sample)
        share = min(1.0, 8 * share)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> dict:
    """The model, from labels of rows outside fold 0 only.

    At most ``sample`` positives, unlabelled rows and negatives come to the driver, as features, one row an id; negatives only
    serve the calibration.  Means, deviations and the prior are taken over all documents.  An id labelled both ways is left
    out, and so are null ids.  Without positives or unlabelled rows, as in empty tables, the model scores every text 0.5."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label).alias("low"), F.max(label).alias("high"))
    order = F.xxhash64(F.lit(5), F.col("_id"))
    sure = known.where((F.col("low") == F.col("high")) & (fold("_id") != 0))
    picked = [sure.where(F.col("low") == v).select("_id", F.lit(v).alias("_k")).orderBy(order).limit(sample) for v in (1, 0)]
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).where(fold("_id") != 0)
    picked.append(_unlabelled(ids, known, sample).select("_id", F.lit(-1).alias("_k")))
    chosen = F.broadcast(picked[0].unionByName(picked[1]).unionByName(picked[2]))  # 3 * sample rows at most
    texts = docs.select(F.col(id_col).alias("_d"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_text"))
    src = texts.join(chosen, F.col("_d") == F.col("_id")).select("_id", "_k", "_text")

    def run(batches):
        for batch in batches:
            x = features(batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_k"), pa.array([r.tobytes() for r in x], pa.binary())], names=["_id", "_k", "x"])

    kind = dict(src.dtypes)["_id"]
    # One row an id, however many the documents have, before anything comes to the driver.
    rows = src.mapInArrow(run, f"_id {kind}, _k int, x binary").groupBy("_id", "_k").agg(F.min("x").alias("x"))
    table = rows.toArrow()
    k = np.array(table.column("_k").to_pylist(), np.int32)
    x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float32).reshape(-1, WIDTH).astype(np.float64)
    ids_at = table.column("_id").to_pylist()
    order_at = sorted(range(len(k)), key=lambda i: ids_at[i])  # the order of the rows must not matter
    ids_at, k, x = [ids_at[i] for i in order_at], k[order_at], x[order_at]
    pos, neg, unl = x[k == 1], x[k == 0], x[k == -1]
    if len(pos) < 4 or len(unl) < 4:
        return {"none": True}
    mix = np.random.Generator(np.random.PCG64(7))
    of_unl = [i for i, v in zip(ids_at, k) if v == -1]
    pos, turn = pos[mix.permutation(len(pos))], mix.permutation(len(unl))
    unl, of_unl = unl[turn], [of_unl[i] for i in turn]
    mean, dev = moments(texts.select("_text"))
    scale = lambda v: np.clip((v - mean) / dev, -8, 8)
    # The prior: a first model, fitted on half of the sample, scores all other unlabelled documents.
    half_p, half_u = len(pos) // 2, len(unl) // 2
    first = {"mean": mean, "dev": dev, "parts": fit_pu(scale(pos[:half_p]), scale(unl[:half_u]), 0.5, seed=1, steps=STEPS // 3).parts()}
    held = _margins(first, pos[half_p:])
    cuts = np.quantile(held, np.linspace(0.02, 0.9, CUTS))
    used = docs.sparkSession.createDataFrame([(i,) for i in of_unl[:half_u]], f"_d {kind}")

    def rate(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_d"), pa.array(margins(first, batch.column("_text").to_pylist()), pa.float64())], names=["_d", "m"])

    others = texts.where(F.col("_d").isNull() | (fold("_d") != 0)).mapInArrow(rate, f"_d {kind}, m double")
    others = others.join(known.select(F.col("_id").alias("_d")), "_d", "left_anti").join(F.broadcast(used), "_d", "left_anti")  # half a sample at most
    tails = others.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum((F.col("m") >= float(c)).cast("long")), F.lit(0)).alias(f"c{i}") for i, c in enumerate(cuts)]).first()
    prior = prior_from_tails(held, cuts, list(tails[1:]), tails[0])
    net = {"mean": mean, "dev": dev, "parts": fit_pu(scale(pos), scale(unl), prior, seed=2).parts()}
    # Positives count as often as the prior says, so that scores are probabilities for web text.
    a, b = calibrate(np.concatenate([_margins(net, pos), _margins(net, neg)]), np.concatenate([np.ones(len(pos)), np.zeros(len(neg))]))
    if len(neg):
        b += math.log(prior / (1 - prior)) - math.log(len(pos) / len(neg))
    return net | {"a": a, "b": b, "prior": prior}


def _margins(model: dict, x: np.ndarray) -> np.ndarray:
    w1, b1, w2, b2 = model["parts"]
    x = np.clip((x - model["mean"]) / model["dev"], -8, 8)
    return np.maximum(x @ w1 + b1, 0) @ w2 + b2[0]


def margins(model: dict, texts: list[bytes]) -> np.ndarray:
    return np.concatenate([_margins(model, features(texts[at : at + 512])) for at in range(0, len(texts), 512)] or [np.zeros(0)])


def score(model: dict, texts: list[bytes]) -> np.ndarray:
    if model.get("none"):
        return np.full(len(texts), 0.5)
    return _sigmoid(model["a"] * margins(model, texts) + model["b"])


def scores(docs: DataFrame, model: dict, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: id, held_out, score, predicted.  Only the text is scored; a null text scores as an empty one.

    Repeated rows each get a row; a null id is never held out.  One pass, no shuffle."""
    src = docs.select(F.col(id_col), F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_text"))

    def run(batches):
        for batch in batches:
            s = score(model, batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32), pa.int32())], names=[id_col, "held_out", "score", "predicted"])

    return src.mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text scores below the threshold.

    A null text scores as an empty one; rows are judged each for itself, so copies stay or go together; columns may have
    any names; an empty table stays empty.  One pass, no shuffle; a task holds one batch of texts."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(score(model, texts) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)

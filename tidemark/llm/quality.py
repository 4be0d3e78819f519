"""Text quality by naive-Bayes support vectors (Wang and Manning, 2012).

Indicators of n-grams are scaled by the log ratio of their smoothed shares in good and bad documents,
rows are brought to length 1, and a linear hinge-loss model is fitted by dual coordinate descent. The
n-grams run over three streams of a text: its bytes; its shape, where runs of letters or digits are
one symbol; and whether each word repeats the one before. A logistic curve on rows kept out of the
fit turns margins into scores.

Labels are read for a bounded sample of the training rows (``FIT_ROWS``, by hash of the id); scoring
reads every text in one pass, with a model of fixed size.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.storage import named, without

#: At most so many labelled rows are fitted, about a quarter of them to the logistic curve.
FIT_ROWS = 6000
BITS = 18
SHAPE_GRAMS = (1, 2, 3, 4, 5)
REPEATS = (1, 2, 4, 8)
SMOOTHING = 1.0
COST = 4.0
EPOCHS = 12
KEEP_FROM = 0.3

_SHAPE = np.arange(256, dtype=np.uint32)
_SHAPE[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = 1
_SHAPE[ord("A") : ord("Z") + 1] = 2
_SHAPE[ord("0") : ord("9") + 1] = 3
_SHAPE[[9, 32]] = 4
_SHAPE[[10, 11, 12, 13]] = 5


def _bucket(code: np.ndarray, stream: int) -> np.ndarray:
    return ((code * np.uint32(2654435761) + np.uint32(stream * 40503 % (1 << 32))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)


def ngrams(text: str | None) -> np.ndarray:
    """Distinct hashed n-grams of the three streams."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    found = []
    if len(b) > 2:
        found.append(_bucket((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:], 0))
    if len(b):
        s = _SHAPE[b]
        s = s[np.r_[True, (s[1:] != s[:-1]) | (s[1:] > 5)]]
        acc = np.zeros(len(s), np.uint32)
        for n in range(1, min(SHAPE_GRAMS[-1], len(s)) + 1):
            acc = acc[: len(s) - n + 1] * np.uint32(0x01000193) + s[n - 1 :]
            found.append(_bucket(acc, n))
    words = raw.split()
    same = bytes(map(operator.eq, words, words[1:]))
    runs = [n for n in REPEATS if b"\1" * n in same]
    if runs:
        found.append(_bucket(np.array(runs, np.uint32), 99))
    return np.unique(np.concatenate(found)).astype(np.int32) if found else np.zeros(0, np.int32)


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    slope: float
    shift: float

    def margin(self, at: np.ndarray) -> float:
        length = float(np.sqrt(np.square(self.ratio[at]).sum()))
        return float(self.weight[at].sum() / length) if length else 0.0

    def score(self, text: str | None) -> float:
        return 1 / (1 + float(np.exp(-np.clip(self.slope * self.margin(ngrams(text)) + self.shift, -500, 500))))


def log_ratio(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    share = []
    for side in (True, False):
        n = np.full(1 << BITS, SMOOTHING)
        for i in np.flatnonzero(good == side):
            n[rows[i]] += 1
        share.append(n / n.sum())
    return np.log(share[0] / share[1])


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """L2-regularised hinge loss by dual coordinate descent (Hsieh et al., 2008); rows have length 1."""
    w, alpha, rng = np.zeros(1 << BITS), np.zeros(len(rows)), np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            after = min(max(alpha[i] - (y[i] * float(w[x] @ v) - 1), 0.0), cost[i])
            if after != alpha[i]:
                w[x] += (after - alpha[i]) * y[i] * v
                alpha[i] = after
    return w


def logistic_curve(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps with Platt's softened targets."""
    up, down = good.sum(), (~good).sum()
    target = np.where(good, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, float(np.log((up + 1) / (down + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum() + 1e-3 * a, (p - target).sum()])
        q = p * (1 - p)
        h = np.array([[(q * margin * margin).sum() + 1e-3, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], good: np.ndarray) -> Model:
    """Without rows of both labels, every score is the smoothed share of good rows."""
    good = np.asarray(good, bool)
    prior = float(np.log((good.sum() + 1) / ((~good).sum() + 1)))
    fitted = np.arange(len(rows)) % 4 != 3
    if len(set(good[fitted])) < 2 or len(set(good[~fitted])) < 2:
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), 1.0, prior)
    train = np.flatnonzero(fitted)
    ratio = log_ratio([rows[i] for i in train], good[train])
    values = [v / n if (n := np.sqrt(v @ v)) else v for v in (ratio[rows[i]] for i in train)]
    y = np.where(good[train], 1.0, -1.0)
    rarer = 2 * np.minimum(good[train].mean(), 1 - good[train].mean())
    cost = COST * np.where(good[train] == (good[train].mean() > 0.5), rarer, 2 - rarer)
    weight = descend([rows[i] for i in train], values, y, cost) * ratio
    flat = Model(ratio, weight, 1.0, 0.0)
    slope, shift = logistic_curve(np.array([flat.margin(rows[i]) for i in np.flatnonzero(~fitted)]), good[~fitted])
    return Model(ratio, weight, slope, shift)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def _grams(texts: pa.Array) -> pa.Array:
    return pa.array([ngrams(x.as_py()) for x in texts], pa.list_(pa.int32()))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> Model:
    """Fits at most ``rows`` labelled documents that aren't held out; null labels and ids don't count.

    The driver holds these documents' distinct hashed n-grams: at most ``rows`` x 2^BITS numbers, in
    practice some 3 KB a document. Ids that repeat in ``docs`` are fitted with each of their texts; without
    labelled rows of both kinds every score is the prior.
    """
    chosen = labels.select(named(doc_id).alias("y_id"), named(label).alias("y")).where("y IN (0, 1) AND y_id IS NOT NULL").where(~held_out("y_id"))
    chosen = F.broadcast(chosen.distinct().orderBy(F.xxhash64("y_id"), "y").limit(rows))  # at most ``rows`` pairs of numbers
    found = docs.select(named(doc_id).alias("id"), named(text).alias("text")).join(chosen, F.col("id") == F.col("y_id"))
    table = found.select(F.xxhash64("id").alias("o"), "y", F.arrow_udf(_grams, "array<int>")("text").alias("x")).toArrow().sort_by([("o", "ascending"), ("y", "ascending")])
    grams = [np.asarray(x.values, dtype=np.int32) for x in table.column("x")]
    return fit(grams, np.asarray(table.column("y")) == 1)


def _score(model: Model):
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(x.as_py()) for x in texts], pa.float64())

    return run


def score_quality(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``score`` added, 0 to 1, higher for good; only the text counts.

    A null or empty text has no n-grams and the score of a margin of 0. Rows are kept one to one, an
    input column ``score`` is replaced.
    """
    return without(df, "score").withColumn("score", F.arrow_udf(_score(model), "double")(named(text)))


def op3_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))

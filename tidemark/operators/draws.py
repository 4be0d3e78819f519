"""Which rows each of many fits takes: those that ``split.downsample`` keeps, all fits drawn in two passes.

A row's MD5s are taken where it lies, in batches, once for each seed, whatever the number of fits that compare them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.labels import PAIR

#: Digests with the same first three hexadecimal digits share a bucket.
BUCKETS = 4096


def text() -> Column:
    """What a seed is added to before it is digested."""
    return F.concat_ws("|", *PAIR, "cutoff_date")


def earlier(days: pa.Array, day: str) -> np.ndarray:
    return pc.less(days, day).to_numpy(zero_copy_only=False)


def digests(texts: np.ndarray, seed: int) -> np.ndarray:
    end = f"|{seed}".encode()
    return np.frombuffer(b"".join([md5(t.encode() + end, usedforsecurity=False).digest() for t in texts]), "S16")


def limits(trainval: DataFrame, jobs: list[dict]) -> dict[tuple, str]:
    """By seed + fold, day and ratio the last digest kept of the negatives before the day; absent where all are kept.

    Counts by digest bucket tell which bucket a limit falls into, a second pass ranks that bucket alone. What comes to
    the driver is a count of each bucket and one digest a limit. No row of the bucket stays if a limit is its name.
    """
    draws, ratios = sorted({(j["seed"] + j["fold"], j["day"]) for j in jobs if j["ratio"]}), sorted({j["ratio"] for j in jobs if j["ratio"]})
    if not draws:
        return {}
    of_seed = {seed: [i for i, (s, _) in enumerate(draws) if s == seed] for seed, _ in draws}
    slim = trainval.where(F.col("cutoff_date") < max(d for _, d in draws)).select("cutoff_date", "label", text().alias("text"))

    def marks(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each draw its rows' labels, digests and buckets."""
        label, texts = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        for seed, of in of_seed.items():
            mine = np.flatnonzero(earlier(b.column(0), max(draws[i][1] for i in of)))
            found = digests(texts[mine], seed)
            two = found.view(np.uint8).reshape(-1, 16)[:, :2].astype(np.int64)
            bucket = two[:, 0] * 16 + two[:, 1] // 16
            for i in of:
                some = earlier(b.column(0), draws[i][1])[mine]
                yield i, label[mine][some], found[some], bucket[some]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(draws), 2, BUCKETS), np.int64)
        for b in batches:
            for i, label, _, bucket in marks(b):
                for y in (0, 1):
                    n[i, y] += np.bincount(bucket[label == y], minlength=BUCKETS)
        draw, bucket = np.nonzero(n.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(draw, pa.int32()), pa.array(bucket, pa.int32()), pa.array(n[draw, 0, bucket]), pa.array(n[draw, 1, bucket])], names=["draw", "bucket", "neg", "pos"])

    counts = slim.mapInArrow(count, "draw int, bucket int, neg bigint, pos bigint").groupBy("draw", "bucket").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).toArrow()
    draw, bucket, neg, pos = (counts[c].to_numpy() for c in ("draw", "bucket", "neg", "pos"))
    at = {}
    for i in range(len(draws)):
        own = np.zeros(BUCKETS, np.int64)
        own[bucket[draw == i]] = neg[draw == i]
        upto, positives = np.cumsum(own), int(pos[draw == i].sum())
        for r in ratios:
            if 0 < r * positives < upto[-1]:
                k = int(np.searchsorted(upto, r * positives, side="right"))
                at[i, r] = k, int(r * positives - upto[k] + own[k])

    def edge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, r, n, m.ljust(16, b"\0")) for i, label, all_, bucket in marks(b) for (draw, r), (k, n) in at.items() if draw == i and n for m in all_[(label == 0) & (bucket == k)].tolist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["draw", "ratio", "n", "md5"])

    last = {(*draws[i], r): f"{k:03x}" for (i, r), (k, _) in at.items()}
    if any(n for _, n in at.values()):
        ranked = slim.mapInArrow(edge, "draw int, ratio int, n bigint, md5 binary").withColumn("r", F.row_number().over(W.partitionBy("draw", "ratio").orderBy("md5")))
        last |= {(*draws[r.draw], r.ratio): bytes(r.md5).hex() for r in ranked.where("r = n").collect()}  # one row a draw and ratio
    return last


def members(days: pa.Array, label: np.ndarray, texts: np.ndarray, jobs: list[dict], last: dict[tuple, str]) -> np.ndarray:
    """(jobs, rows): whether a row is a training row of a job; ``last``: what ``limits`` gave."""
    before = {d: earlier(days, d) for d in {j["day"] for j in jobs}}
    out = np.stack([before[j["day"]] for j in jobs])
    bounded = [(i, j["seed"] + j["fold"], last[at]) for i, j in enumerate(jobs) if (at := (j["seed"] + j["fold"], j["day"], j["ratio"])) in last]
    for seed in sorted({s for _, s, _ in bounded}):
        of = [(i, x) for i, s, x in bounded if s == seed]
        mine = np.flatnonzero(np.any([out[i] for i, _ in of], axis=0) & (label != 1))
        found = digests(texts[mine], seed)
        for i, x in of:
            name = len(x) == 3  # of a bucket, of which no row stays
            limit = np.array((int(x, 16) << 4).to_bytes(2, "big") if name else bytes.fromhex(x), "S16")
            out[i, mine] &= found < limit if name else found <= limit
    return out

"""Near-duplicate documents by SuperMinHash, banding, exact verification and component grouping.

A document's set holds the 64-bit hashes of its distinct word shingles (two different shingles of a
set agree with probability below 1e-13 for a set of 1,000). SuperMinHash (Ertl, 2017) draws, for each
element, a random permutation of the registers and gives the j-th register of it a value in [j, j+1):
registers of one element are correlated, which lowers the variance, and once every register of a
document is below j + 1 its later draws can't matter, so most elements stop after a draw or two.

Documents with equal sets are one class. Classes that share a band's registers meet in a bucket:

1. each is checked against the bucket's smallest; confirmed links give first components;
2. only buckets that still hold several components are looked at again: all pairs across components
   are checked on full sets in cells of bounded size (large components don't meet themselves).

No pair is stored for copies and no bucket is cut. Joins whose keys may be hot have plain exchanges on
both sides, so that adaptive execution can split them; blank texts take no part in any.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.idfilter import mark_possible
from tidemark.llm.storage import forget, held, keep, named, unheld, without

#: A pair at the threshold shares no band with at most this probability.
MISS = 5e-4
MOST_BANDS = 20
#: Documents of a block, fewer where their sets hold more than LOAD shingles together; a cell has two
#: blocks at most.
BLOCK, LOAD = 256, 1 << 19
#: Shingles that are ranked together.
CHUNK = 150_000

U = np.uint64
GOLD, M1, M2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * M1
    x = (x ^ (x >> U(27))) * M2
    return x ^ (x >> U(31))


def band_shape(threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bands and rows: as many rows as at most ``MOST_BANDS`` bands leave at that miss probability."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))
        if bands <= MOST_BANDS and bands * rows <= 255:
            return bands, rows
    raise ValueError(f"no banding for a threshold of {threshold}")


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of so many words.

    A-Z are lower-cased; words are what blanks and tabs to carriage returns separate; a shorter text
    that has words is one shingle.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, U)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), U, len(found))
    n = len(h) - words + 1
    acc = h[:n].copy()
    for i in range(1, words):
        acc = mix(acc * GOLD + h[i : i + n])
    return np.unique(acc)


@lru_cache(maxsize=16)
def _recent(text: str, words: int) -> np.ndarray:
    """Of the centers that many pairs in a row share."""
    return shingle_set(text, words)


def superminhash(sets: list[np.ndarray], registers: int) -> np.ndarray:
    """One row of registers per set: draw number above, 32 random bits below. None of the sets is empty."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), size)
    seed = np.concatenate(sets)
    out = np.full(len(sets) * registers, ~U(0))
    order = None
    for j in range(registers):
        z = mix(seed + U((j + 1) * int(GOLD) % (1 << 64)))
        k = j + (((z & U(0xFFFFFFFF)) * U(registers - j)) >> U(32)).astype(np.int64)
        at = np.arange(len(k))
        if order is None:
            to = k
        else:
            to = order[at, k].astype(np.int64)
            order[at, k] = order[:, j]
        np.minimum.at(out, owner * registers + to, (U(j) << U(32)) | (z >> U(32)))
        open_ = out.reshape(len(sets), registers).max(axis=1) >= U(j + 1) << U(32)
        stay = open_[owner]
        if not stay.any():
            break
        if order is None:
            order = np.tile(np.arange(registers, dtype=np.uint8), (int(stay.sum()), 1))
            order[np.arange(len(order)), k[stay]] = 0
        elif not stay.all():
            order = order[stay]
        if not stay.all():
            owner, seed = owner[stay], seed[stay]
    return out.reshape(len(sets), registers)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = signature.reshape(len(signature), bands, rows)
    acc = np.zeros(part.shape[:2], U) + np.arange(bands, dtype=U)
    for i in range(rows):
        acc = mix(acc * GOLD + part[:, :, i])
    return acc.view(np.int64)


def _mark(words: int, bands: int, rows: int):
    """Per text: set size, 128 bits of the whole set, a key per band (null without shingles)."""

    def run(texts: pa.Array) -> pa.Array:
        n, hi, lo = (np.zeros(len(texts), np.int64) for _ in range(3))
        keys: list[np.ndarray | None] = [None] * len(texts)
        sets, at, total = [], [], 0

        def rank() -> None:
            nonlocal total
            if sets:
                for i, row in zip(at, band_keys(superminhash(sets, bands * rows), bands, rows), strict=True):
                    keys[i] = row
            sets.clear()
            at.clear()
            total = 0

        for i, x in enumerate(texts):
            s = shingle_set(x.as_py(), words)
            n[i] = len(s)
            if len(s):
                d = xxhash.xxh3_128_digest(s.tobytes())
                hi[i], lo[i] = int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)
                sets.append(s)
                at.append(i)
                total += len(s)
                if total >= CHUNK:
                    rank()
        rank()
        return pa.StructArray.from_arrays([pa.array(n), pa.array(hi), pa.array(lo), pa.array(keys, pa.list_(pa.int64()))], names=["n", "hi", "lo", "bands"])

    return run


def _similar(words: int, num: int, den: int):
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            s, t = shingle_set(x.as_py(), words), _recent(y.as_py(), words)
            if len(s) > len(t):
                s, t = t, s
            if len(s) * den < num * len(t):
                out.append(False)
                continue
            at = np.searchsorted(t, s)
            same = int((t[np.minimum(at, len(t) - 1)] == s).sum())
            out.append(den * same >= num * (len(s) + len(t) - same))
        return pa.array(out, pa.bool_())

    return run


def _links_in_cell(ids: list[int], comps: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links across components that join them all, each confirmed on full sets."""
    label = np.unique(np.array(comps), return_inverse=True)[1]
    left = int(label.max()) + 1
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    start = np.cumsum(size) - size
    local = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(int(local.max()) + 1, bool)
    links = []
    for i in range(len(ids)):
        if left == 1:
            break
        if (label == label[i]).all():
            continue
        own = local[start[i] : start[i] + size[i]]
        mark[own] = True
        same = np.add.reduceat(mark[local], start, dtype=np.int64)
        mark[own] = False
        near = np.flatnonzero((den * same >= num * (size[i] + size - same)) & (label != label[i]))
        for j in near:
            if label[j] != label[i]:
                links.append((ids[i], ids[int(j)]))
                label[label == label[j]] = label[i]
                left -= 1
    return links


def _cells(words: int, num: int, den: int):
    """Rows come sorted by cell; a cell may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, comps, sets, found = None, [], [], [], []

        def close() -> None:
            if len(ids) > 1:
                found.extend(_links_in_cell(ids, comps, sets, num, den))
            ids.clear(), comps.clear(), sets.clear()

        for b in batches:
            cell, rep, comp = (b.column(i).to_pylist() for i in range(3))
            for i, c in enumerate(cell):
                if c != now:
                    close()
                    now = c
                ids.append(rep[i])
                comps.append(comp[i])
                sets.append(shingle_set(b.column(3)[i].as_py(), words))
        close()
        a, z = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["src", "dst"])

    return run


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``df``'s columns but the text, with ``n_shingles``, ``component_id`` and ``kept`` added, row by row.

    Two documents are linked if ``den`` times their sets' intersection is at least ``num`` times the
    union (default 0.8 of five-word shingles). ``component_id`` is the smallest id reachable by links,
    ``kept`` whether it is the row's own. A null, empty or blank text has no shingles and links with
    nothing. Rows that share an id are one document: what links with any of their texts links with it.
    A row with a null id links with nothing but the copies of its text: their component, or null, is
    its own, and it is kept. Input columns with the three names are replaced, others may have any name.
    """
    bands, rows = band_shape(num / den)
    base = without(df, "n_shingles", "component_id", "kept")
    slim = base.select(held(base, text), named(doc_id).cast("bigint").alias("id"), named(text).alias("text"))
    mark = F.arrow_udf(_mark(words, bands, rows), "struct<n bigint, hi bigint, lo bigint, bands array<bigint>>")
    marked = keep(slim.select("row_", "id", F.xxhash64("text").alias("th"), mark("text").alias("m")).select("row_", "id", "th", "m.*"))
    classes = marked.where("n > 0 AND id IS NOT NULL").groupBy("hi", "lo").agg(F.min(F.struct("id", "th")).alias("c"), F.first("n").alias("size"), F.first("bands").alias("bands"))
    classes = classes.selectExpr("hi", "lo", "c.id AS rep", "c.th", "size", "bands")
    spread = classes.select("rep", "th", "size", F.explode("bands").alias("key"))  # a key holds its band
    buckets = spread.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("rep", "th")).alias("center"), F.bit_xor(F.xxhash64("rep", "th")).alias("mark")).where("n > 1")
    # Many bands bring the same documents together: one of them is enough.
    buckets = buckets.groupBy("n", "center", "mark").agg(F.min("key").alias("key"))
    members = keep(spread.join(buckets, "key").select("key", "rep", "th", "size", "center", "n"))

    wanted = members.select("rep", "th").distinct()
    texts = mark_possible(slim.select(F.col("id").alias("rep"), "text"), "rep", wanted)
    texts = texts.where("_possible").select("rep", F.xxhash64("text").alias("th"), "text").join(wanted, ["rep", "th"], "left_semi")
    texts = keep(texts.groupBy("rep", "th").agg(F.max("text").alias("text")))

    pairs = members.where("rep <> center.rep").selectExpr("rep AS src", "th AS src_th", "center.rep AS dst", "center.th AS dst_th").distinct()
    checked = pairs.join(texts.selectExpr("rep AS src", "th AS src_th", "text AS a"), ["src", "src_th"]).join(texts.selectExpr("rep AS dst", "th AS dst_th", "text AS b"), ["dst", "dst_th"])
    similar = F.arrow_udf(_similar(words, num, den), "boolean")
    stars = connected_components(checked.where(similar("a", "b")).select("src", "dst"))

    # A bucket of two has been checked whole. A member weighs its share of a block.
    open_ = members.where("n > 2").join(stars, F.col("rep") == F.col("node"), "left").selectExpr("key", "rep", "th", f"{LOAD // BLOCK} + size AS w", "coalesce(component, rep) AS comp")
    sizes = open_.groupBy("key", "comp").agg(F.sum("w").alias("w"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("k"), F.sum("w").alias("w"), F.max(F.struct("w", "comp")).alias("top")).where("k > 1")
    mixed = keep(mixed.selectExpr(
        "key", f"IF(w > {LOAD}, top.comp, NULL) AS major",
        f"ceil(IF(w > {LOAD}, w - top.w, w) / {LOAD}) AS minors", f"IF(w > {LOAD}, ceil(top.w / {LOAD}), 0) AS majors",
    ))
    dealt = open_.join(mixed, "key").selectExpr("key", "rep", "th", "comp", "minors", "majors", "comp <=> major AS big", "pmod(xxhash64(rep, th), IF(comp <=> major, majors, minors)) AS block")
    cells = dealt.selectExpr(
        "rep", "th", "comp", "key",
        """explode(IF(big,
             transform(sequence(0, minors - 1), x -> struct(1 AS kind, x AS one, block AS two)),
             concat(IF(majors = 0 OR minors > 1, transform(sequence(0, minors - 1), x -> struct(0 AS kind, least(x, block) AS one, greatest(x, block) AS two)), array()),
                    IF(majors = 0, array(), transform(sequence(0, greatest(majors - 1, 0)), x -> struct(1 AS kind, block AS one, x AS two)))))) AS at""",
    )
    cells = cells.selectExpr("rep", "th", "comp", "xxhash64(key, at.kind, at.one, at.two) AS cell").join(texts, ["rep", "th"]).select("cell", "rep", "comp", "text")
    crossed = cells.repartition("cell").sortWithinPartitions("cell", "rep").mapInArrow(_cells(words, num, den), "src bigint, dst bigint")
    found = connected_components(stars.select(F.col("node").alias("src"), F.col("component").alias("dst")).union(crossed))
    forget(texts)
    forget(members)
    forget(mixed)

    # Written first: the join may then split the rows of one large class.
    label = keep(classes.select("hi", "lo", "rep").join(found, F.col("rep") == F.col("node"), "left").selectExpr("hi AS of_hi", "lo AS of_lo", "coalesce(component, rep) AS comp"))
    solid = marked.where("n > 0").join(label, (F.col("hi") == F.col("of_hi")) & (F.col("lo") == F.col("of_lo")), "left").select("row_", "id", "n", "comp")
    blank = marked.where("n = 0").select("row_", "id", "n", F.lit(None).cast("bigint").alias("comp"))
    out = solid.unionByName(blank).withColumn("component", F.coalesce("comp", "id"))
    return out.select(*unheld(base, text), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``df`` with one document of each group left: the one with the smallest id.

    Of rows that share that id and their text any one stays; rows that share the id alone are one
    document and stay. Rows with a null id and blank texts all stay. Only rows that may have an id to act
    on are shuffled. Columns may have any name.
    """
    slim = df.select(held(df), named(doc_id).cast("bigint").alias("id"), named(text).alias("text"))
    flags = near_duplicates(slim.select("id", "text"), "id", "text", words, num, den)
    acts = flags.where("id IS NOT NULL").groupBy(F.col("id").alias("of_id")).agg(F.bool_or(~F.col("kept")).alias("gone"), F.count("*").alias("n"))
    acts = keep(acts.where("gone OR n > 1"))
    marked = mark_possible(slim, "id", acts)
    maybe = marked.where("_possible").join(acts, F.col("id") == F.col("of_id"), "left")
    again = maybe.where("of_id IS NOT NULL AND NOT gone").groupBy("id", "text").agg(F.first("row_").alias("row_"))
    out = marked.where("NOT _possible").select("row_").union(maybe.where("of_id IS NULL").select("row_")).union(again.select("row_"))
    return out.select(*unheld(df))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, words=3, num=85, den=100).select("doc_id", "n_shingles", "component_id", "kept")

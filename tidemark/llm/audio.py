"""Chroma fingerprints of audio columns, and recordings aligned by them.

A recording is cut into overlapping frames, each folded to energies of the twelve pitch classes. On
the integral image over frames and classes sixteen box filters are four look-ups each; every filter's
value is quantised to two Gray-coded bits, so each frame gives a 32-bit integer. Two recordings that
share pairs of these integers are aligned at the offset that most of them agree on, and the share of
differing bits over the whole overlap decides.

Recordings that share a key (two integers a fixed distance apart) meet in its bucket:

1. each is aligned with the bucket's smallest id; confirmed links give first components;
2. in buckets that still hold several components all pairs across these are aligned at the bucket's
   offset, in cells of bounded size (a large component doesn't meet itself).

No pair is stored for copies and no bucket is cut. Joins whose keys may be hot have plain exchanges on
both sides, so that adaptive execution can split them; silent rows take no part in any.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.storage import forget, held, keep, named, unheld, without

RATE = 8000
FRAME, HOP = 512, 64
LOWEST = 100.0
#: The two integers of a key lie so many frames apart.
APART = 12
#: Shared keys at the best offset, frames of overlap and share of differing bits that make a link.
VOTES, OVERLAP, ERRORS = 4, 16, 0.15
STEPS = (-0.12, 0.0, 0.12)
#: (kind, width in frames, lowest class, height in classes) of each filter, by rule.
FILTERS = [(i % 5, (4, 8, 12, 16)[i // 4], (i * 5) % (13 - h), h) for i, h in ((i, (2, 4, 6, 3, 12)[i % 5]) for i in range(16))]
WIDEST = max(w for _, w, _, _ in FILTERS)
CHUNK = 2048
#: Recordings of a block; a cell has two blocks at most.
BLOCK = 256


def _pcm(raw: bytes, bits: int, real: bool) -> np.ndarray:
    """Values in [-1, 1] of 8, 16, 24 or 32 bits, or of 32-bit floats; none for other widths."""
    step = bits // 8
    if bits not in (8, 16, 24, 32) or real and bits != 32:
        return np.zeros(0)
    raw = raw[: len(raw) // step * step]
    if real:
        return np.nan_to_num(np.frombuffer(raw, "<f4").astype(np.float64), posinf=0.0, neginf=0.0)
    if bits == 8:
        return (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    if bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        return (b[:, 0] | b[:, 1] << 8 | (b[:, 2] ^ 128) - 128 << 16) / float(1 << 23)
    return np.frombuffer(raw, f"<i{step}").astype(np.float64) / float(1 << (bits - 1))


def samples(media: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1] and their rate: RIFF WAVE (PCM or 32-bit floats), or else bytes as raw unsigned 8-bit."""
    if media[:4] == b"RIFF" and media[8:12] == b"WAVE":
        at, channels, bits, real, rate = 12, 1, 8, False, RATE
        while at + 8 <= len(media):
            name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            if name == b"fmt " and at + 24 <= len(media):
                form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
                channels, rate, real = max(channels, 1), rate or RATE, form == 3
            elif name == b"data":
                x = _pcm(media[at + 8 : at + 8 + size], bits, real)
                return x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1), rate
            at += 8 + size + (size & 1)
        return np.zeros(0), rate
    return _pcm(media, 8, False), RATE


def resampled(x: np.ndarray, rate: int) -> np.ndarray:
    """At ``RATE``: a moving mean as wide as the step, then straight lines between samples."""
    if rate == RATE or not len(x):
        return x
    if (wide := round(rate / RATE)) > 1:
        total = np.cumsum(np.r_[np.zeros(1), x, np.zeros(wide - 1)])
        x = (np.r_[total[wide:]] - total[:-wide]) / wide
    return np.interp(np.arange(int(len(x) * RATE / rate)) * (rate / RATE), np.arange(len(x)), x)


def _fold(rate: int) -> np.ndarray:
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    out = np.zeros((len(f), 12))
    at = np.flatnonzero(f >= LOWEST)
    out[at, np.round(12 * np.log2(f[at] / 440)).astype(int) % 12] = 1
    return out


_FOLDS: dict[int, np.ndarray] = {}
_WINDOW = np.hanning(FRAME)


def chroma(x: np.ndarray, rate: int) -> np.ndarray:
    """Frames by pitch classes, each frame of length 1 (silence: 0)."""
    if len(x) < FRAME:
        return np.zeros((0, 12))
    fold = _FOLDS.setdefault(rate, _fold(rate))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = np.concatenate([np.square(np.abs(np.fft.rfft(frames[i : i + CHUNK] * _WINDOW))) @ fold for i in range(0, len(frames), CHUNK)])
    n = np.sqrt(np.square(out).sum(axis=1, keepdims=True))
    return np.divide(out, n, out=np.zeros_like(out), where=n > 1e-9)


def prints(image: np.ndarray) -> np.ndarray:
    """A 32-bit integer for each frame that has the widest filter's frames after it."""
    n = len(image) - WIDEST + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    np.cumsum(np.cumsum(image, axis=0), axis=1, out=total[1:, 1:])

    def box(x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
        return total[x1 : x1 + n, y1] - total[x0 : x0 + n, y1] - total[x1 : x1 + n, y0] + total[x0 : x0 + n, y0]

    out = np.zeros(n, np.uint32)
    for kind, w, y, h in FILTERS:
        whole, hw, hh, tw = box(0, w, y, y + h), w // 2, h // 2, w // 3
        if kind == 0:  # against the other classes
            part, rest = whole / h, (box(0, w, 0, 12) - whole) / max(12 - h, 1)
        elif kind == 1:  # later against earlier
            part, rest = box(0, hw, y, y + h), box(hw, w, y, y + h)
        elif kind == 2:  # upper against lower classes
            part, rest = box(0, w, y, y + hh) / max(hh, 1), box(0, w, y + hh, y + h) / max(h - hh, 1)
        elif kind == 3:  # both halves crossed
            part = box(0, hw, y, y + hh) + box(hw, w, y + hh, y + h)
            rest = whole - part
        else:  # the middle third against the outer ones
            part = box(tw, w - tw, y, y + h) / (w - 2 * tw)
            rest = (whole - part * (w - 2 * tw)) / max(2 * tw, 1)
        level = np.searchsorted(STEPS, np.log1p(np.maximum(part, 0)) - np.log1p(np.maximum(rest, 0))).astype(np.uint32)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return out


def fingerprint(media: bytes | None) -> np.ndarray:
    return prints(chroma(resampled(*samples(media or b"")), RATE))


def keys_of(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the first frame of each."""
    if len(p) <= APART:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = (p[:-APART].astype(np.uint64) << np.uint64(32)) | p[APART:]
    key, at = np.unique(both, return_index=True)
    return key.view(np.int64), at.astype(np.int64)


def align(p: np.ndarray, q: np.ndarray, offset: int) -> tuple[int, float]:
    """Frames of overlap and share of differing bits with ``p[i]`` over ``q[i - offset]``."""
    a, b = max(0, offset), min(len(p), len(q) + offset)
    if b <= a:
        return 0, 1.0
    return b - a, float(np.bitwise_count(p[a:b] ^ q[a - offset : b - offset]).sum()) / (32 * (b - a))


_FIELDS = "struct<n_frames bigint, prints binary, prints_sha256 string, keys array<struct<key bigint, at bigint>>>"


def _marks(media: pa.Array) -> pa.Array:
    n, raw, sha, keys = [], [], [], []
    for m in media:
        p = fingerprint(m.as_py())
        n.append(len(p))
        raw.append(p.astype("<u4").tobytes())
        sha.append(hashlib.sha256(raw[-1]).hexdigest())
        keys.append([{"key": int(k), "at": int(a)} for k, a in zip(*keys_of(p), strict=True)])
    kind = pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int64())]))
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(raw, pa.binary()), pa.array(sha, pa.string()), pa.array(keys, kind)], names=["n_frames", "prints", "prints_sha256", "keys"])


def _aligned(a: pa.Array, b: pa.Array, offset: pa.Array) -> pa.Array:
    found = [align(np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4"), o.as_py()) for x, y, o in zip(a, b, offset, strict=True)]
    return pa.array([{"overlap": n, "bit_error": e} for n, e in found], pa.struct([("overlap", pa.int64()), ("bit_error", pa.float64())]))


def _links_in_cell(ids: list[int], comps: list[int], ats: list[int], held: list[np.ndarray]) -> list[tuple[int, int, int, int, int, float]]:
    """(rep, other, votes, offset, overlap, error) across components, with the shared key's frames laid over each other.

    Ids ascend. Each recording's link to the smallest id, and links that join all that is linked.
    """
    first = np.unique(np.array(comps), return_inverse=True)[1]
    label = first.copy()
    size = np.fromiter(map(len, held), np.int64, len(held))
    start = np.cumsum(size) - size
    p = np.concatenate(held)
    place = np.arange(len(p)) - np.repeat(start + np.array(ats), size)
    place -= place.min()
    own, there = np.zeros(int(place.max()) + 1, np.uint32), np.zeros(int(place.max()) + 1, bool)
    keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    links = []
    for i in range(1, len(ids)):
        if (first[:i] == first[i]).all():
            continue
        n, at = start[i], place[start[i] : start[i] + size[i]]
        own[at], there[at] = held[i], True
        both = there[place[:n]]
        overlap = np.add.reduceat(both, start[:i], dtype=np.int64)
        bits = np.add.reduceat(np.bitwise_count(p[:n] ^ own[place[:n]]) * both, start[:i], dtype=np.int64)
        there[at] = False
        error = bits / (32 * np.maximum(overlap, 1))
        matched = False
        for j in map(int, np.flatnonzero((overlap >= OVERLAP) & (error <= ERRORS) & (first[:i] != first[i]))):
            if matched and label[j] == label[i]:
                continue
            for x in (i, j):
                if x not in keys:
                    keys[x] = keys_of(held[x])
            _, a, b = np.intersect1d(keys[i][0], keys[j][0], assume_unique=True, return_indices=True)
            votes = int((keys[i][1][a] - keys[j][1][b] == ats[i] - ats[j]).sum())
            if votes >= VOTES:
                links.append((ids[i], ids[j], votes, ats[i] - ats[j], int(overlap[j]), float(error[j])))
                label[label == label[j]] = label[i]
                matched = True
    return links


_LINKS = pa.schema([("rep", pa.int64()), ("other", pa.int64()), ("votes", pa.int64()), ("frame_offset", pa.int64()), ("overlap", pa.int64()), ("bit_error", pa.float64())])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (cell, id, component, frame, prints) come sorted by cell and id; a cell may span batches."""
    now, ids, comps, ats, held, found = None, [], [], [], [], []

    def close() -> None:
        if len(ids) > 1:
            found.extend(_links_in_cell(ids, comps, ats, held))
        ids.clear(), comps.clear(), ats.clear(), held.clear()

    for b in batches:
        cell, rep, comp, at = (b.column(i).to_pylist() for i in range(4))
        for i, c in enumerate(cell):
            if c != now:
                close()
                now = c
            ids.append(rep[i])
            comps.append(comp[i])
            ats.append(at[i])
            held.append(np.frombuffer(b.column(4)[i].as_py(), "<u4"))
    close()
    columns = zip(*found, strict=True) if found else [()] * len(_LINKS)
    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _LINKS, strict=True)], schema=_LINKS)


def _across(members: DataFrame, stars: DataFrame, prints_: DataFrame) -> DataFrame:
    """Links between recordings of different components that share a key."""
    # Many keys bring the same recordings together at the same offsets: one of them is enough.
    alike = members.groupBy("key").agg(F.count("*").alias("n"), F.first("c.rep").alias("center"), F.bit_xor(F.xxhash64("rep", F.col("at") - F.col("c.at"))).alias("mark"))
    alike = alike.groupBy("n", "center", "mark").agg(F.min("key").alias("key")).select("key")
    held = members.select("key", "rep", "at").join(alike, "key").join(stars, F.col("rep") == F.col("node"), "left").select("key", "rep", "at", F.coalesce("component", "rep").alias("comp"))
    sizes = held.groupBy("key", "comp").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("k"), F.sum("c").alias("n"), F.max(F.struct("c", "comp")).alias("top")).where("k > 1")
    mixed = keep(mixed.selectExpr(
        "key", f"IF(n > {BLOCK}, top.comp, NULL) AS major",
        f"ceil(IF(n > {BLOCK}, n - top.c, n) / {BLOCK}) AS minors", f"IF(n > {BLOCK}, ceil(top.c / {BLOCK}), 0) AS majors",
    ))
    dealt = held.join(mixed, "key").selectExpr("key", "rep", "at", "comp", "minors", "majors", "comp <=> major AS big", "pmod(xxhash64(rep), IF(comp <=> major, majors, minors)) AS block")
    cells = dealt.selectExpr(
        "rep", "at", "comp", "key",
        """explode(IF(big,
             transform(sequence(0, minors - 1), x -> struct(1 AS kind, x AS one, block AS two)),
             concat(IF(majors = 0 OR minors > 1, transform(sequence(0, minors - 1), x -> struct(0 AS kind, least(x, block) AS one, greatest(x, block) AS two)), array()),
                    IF(majors = 0, array(), transform(sequence(0, greatest(majors - 1, 0)), x -> struct(1 AS kind, block AS one, x AS two)))))) AS place""",
    )
    cells = cells.selectExpr("rep", "at", "comp", "xxhash64(key, place.kind, place.one, place.two) AS cell").join(prints_, "rep").select("cell", "rep", "comp", "at", "prints")
    return cells.repartition("cell").sortWithinPartitions("cell", "rep").mapInArrow(_cells, "rep bigint, other bigint, votes bigint, frame_offset bigint, overlap bigint, bit_error double")


_ADDED = ("n_frames", "prints_sha256", "match_id", "frame_offset", "overlap", "bit_error", "component_id", "kept")


def align_recordings(df: DataFrame, doc_id: str = "doc_id", media: str = "media") -> DataFrame:
    """``df``'s columns but the media, with each recording's digest, the recording it aligns with, and its group.

    Two recordings link if at some offset at least ``VOTES`` of their keys agree and the overlap and its
    bit error pass. ``n_frames`` integers, ``prints_sha256``; ``match_id``: the smallest id below its own
    that it links with directly among those compared (the first holders of its keys, and recordings
    that these links leave in other components), with ``frame_offset``, ``overlap`` and ``bit_error``
    (null without a link); ``component_id``: the smallest id reachable by links between any two
    recordings; ``kept``: whether it is the row's own.

    Recordings with equal fingerprints are one class and aligned at offset 0. Null, empty and short
    media (under 1,472 samples) have no integers and link with nothing; so do rows with a null id, whose
    component is null and which are kept. Of rows that share an id, those with other media count as
    recordings of that id too. Every rate is brought to 8 kHz. A recording is held whole, eight bytes a
    sample. Input columns with the new names are replaced, others may have any name.
    """
    base = without(df, *_ADDED)
    slim = base.select(held(base, media), named(doc_id).cast("bigint").alias("id"), named(media).alias("media"))
    marked = keep(slim.select("row_", "id", F.arrow_udf(_marks, _FIELDS)("media").alias("m")).select("row_", "id", "m.*"))
    sound = "n_frames > 0 AND id IS NOT NULL"
    classes = marked.where(sound).groupBy("prints_sha256").agg(F.min("id").alias("rep"), F.first("prints").alias("prints"), F.first("keys").alias("keys"))
    spread = classes.select("rep", F.explode("keys").alias("k")).select("rep", "k.key", "k.at")
    first = keep(spread.groupBy("key").agg(F.min(F.struct("rep", "at")).alias("c"), F.count("*").alias("n")).where("n > 1").select("key", "c"))
    members = keep(spread.join(first, "key"))
    forget(first)
    votes = members.where("rep <> c.rep").groupBy("rep", F.col("c.rep").alias("other"), (F.col("at") - F.col("c.at")).alias("frame_offset")).agg(F.count("*").alias("votes"))
    best = votes.groupBy("rep", "other").agg(F.max(F.struct("votes", -F.abs("frame_offset"), "frame_offset")).alias("b")).where(f"b.votes >= {VOTES}").select("rep", "other", "b.votes", "b.frame_offset")
    prints_ = classes.select("rep", "prints")
    pairs = best.join(prints_, "rep").join(prints_.select(F.col("rep").alias("other"), F.col("prints").alias("theirs")), "other")
    pairs = pairs.select("rep", "other", "votes", "frame_offset", F.arrow_udf(_aligned, "struct<overlap bigint, bit_error double>")("prints", "theirs", "frame_offset").alias("a")).where(f"a.overlap >= {OVERLAP} AND a.bit_error <= {ERRORS}")
    links = keep(pairs.select("rep", "other", "votes", "frame_offset", "a.overlap", "a.bit_error"))
    stars = connected_components(links.select(F.col("rep").alias("src"), F.col("other").alias("dst")))
    crossed = keep(_across(members, stars, prints_))
    forget(members)
    match = links.unionByName(crossed).groupBy("rep").agg(F.min(F.struct("other", -F.col("votes"), F.abs("frame_offset"), -F.col("frame_offset"), "frame_offset", "overlap", "bit_error")).alias("l"))
    match = match.select("rep", F.struct("l.other", "l.frame_offset", "l.overlap", "l.bit_error").alias("l"))
    comps = connected_components(stars.select(F.col("node").alias("src"), F.col("component").alias("dst")).union(crossed.select("rep", "other")))
    facts = classes.select("prints_sha256", "rep").join(match, "rep", "left").join(comps, F.col("rep") == F.col("node"), "left").selectExpr("prints_sha256 AS class", "rep", "l", "coalesce(component, rep) AS c")
    facts = keep(facts)  # written first, so that the join may split a class of very many copies
    solid = marked.where(sound).join(facts, F.col("prints_sha256") == F.col("class"))
    same = F.struct(F.col("rep").alias("other"), F.lit(0).cast("bigint").alias("frame_offset"), F.col("n_frames").alias("overlap"), F.lit(0.0).alias("bit_error"))
    solid = solid.withColumn("l", F.when((F.col("rep") < F.col("id")) & (F.col("l").isNull() | (F.col("rep") < F.col("l.other"))), same).otherwise(F.col("l")))
    solid = solid.select("row_", "id", "n_frames", "prints_sha256", "l", "c")
    rest = marked.where(f"NOT ({sound})").select("row_", "id", "n_frames", "prints_sha256", F.lit(None).cast("struct<other: bigint, frame_offset: bigint, overlap: bigint, bit_error: double>").alias("l"), F.col("id").alias("c"))
    out = solid.unionByName(rest)
    return out.select(
        *unheld(base, media), "n_frames", "prints_sha256", F.col("l.other").alias("match_id"), "l.frame_offset", "l.overlap", "l.bit_error",
        F.col("c").alias("component_id"), F.coalesce(F.col("c") == F.col("id"), F.lit(True)).alias("kept"),
    )


def add_fingerprints(df: DataFrame, media: str = "media", out: str = "prints") -> DataFrame:
    """``df`` with the recording's integers added as little-endian bytes; null and short media have none."""
    return without(df, out).withColumn(out, F.arrow_udf(_marks, _FIELDS)(media)["prints"])


def op6_chroma_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds audio: the bytes of each text are read as unsigned 8-bit samples at 8 kHz."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.encode("text", "UTF-8").alias("media"))
    return align_recordings(docs).select("doc_id", *_ADDED)

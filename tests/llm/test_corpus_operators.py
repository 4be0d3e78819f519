"""Near-duplicates, vectors, sharding, packing, audio and the pipeline against brute force."""

import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public = pytest.importorskip("public_tokenizers")

from tidemark.llm import audio, components, idfilter, minhash, packing, pii, quality, sharding, urls, vectors  # noqa: E402


def joined(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(300, 360)] + [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(5, 5), (7, 8), (7, 8)]
    df = spark.createDataFrame([*links, (None, 3)], "src bigint, dst bigint")
    found = {r.node: r.component for r in components.connected_components(df).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert found == {n: c for n, c in joined(nodes, links).items() if n != c} and components.connected_components(df.limit(0)).count() == 0


def test_id_filter_never_misses(spark):
    ids = spark.range(0, 5000, 7).selectExpr("id AS k")
    rows = idfilter.mark_possible(spark.range(5000).withColumn("x", F.lit("a")), "id", ids).collect()
    assert len(rows) == 5000 and all(r._possible for r in rows if r.id % 7 == 0)
    assert sum(r._possible for r in rows) < 900
    assert not idfilter.mark_possible(spark.range(3), "id", ids.limit(0)).where("_possible").count()


def sets(text, words):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefg", k=4)) for _ in range(400)]
    rows = []
    for i in range(n):
        text = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 8, 40, 120]))
        rows.append(" ".join(text))
        for _ in range(rng.choice([0, 0, 1, 6])):
            copy = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(("  " if rng.random() < 0.3 else " ").join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    rng.shuffle(rows)
    return [None, "", " \t", *rows, rows[0], rows[0]]


@pytest.mark.parametrize("words,num,den,block", [(3, 85, 100, 512), (5, 4, 5, 4)])
def test_near_duplicates(spark, monkeypatch, words, num, den, block):
    monkeypatch.setattr(minhash, "BLOCK", block)  # small blocks: buckets are split into cells
    monkeypatch.setattr(minhash, "LOAD", 1 << 20 if block > 4 else 1024)  # by their shingles too
    texts = corpus(words)
    ids = random.Random(9).sample(range(10 * len(texts)), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts, ["x"] * len(ids), strict=True)), "doc_id bigint, text string, kept string")
    found = {r.doc_id: r for r in minhash.near_duplicates(docs, words=words, num=num, den=den).collect()}
    of = {i: sets(t, words) for i, t in zip(ids, texts, strict=True)}
    links = [(a, b) for a in of for b in of if a < b and of[a] and of[b] and den * len(of[a] & of[b]) >= num * len(of[a] | of[b])]
    want = joined(ids, links)
    assert len(links) > 100
    assert {i: r.component_id for i, r in found.items()} == want
    assert all(r.n_shingles == len(of[i]) and r.kept == (want[i] == i) for i, r in found.items())
    left = minhash.drop_near_duplicates(docs, words=words, num=num, den=den)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(want.values()))


def test_near_duplicates_edges(spark):
    schema = "doc_id bigint, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(str(i) for i in range(60_000))
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f"), (5, long), (6, long + " end"), (7, "p q"), (7, "p q"), (None, "x")]
    docs = spark.createDataFrame(rows, schema)
    found = [tuple(r) for r in minhash.near_duplicates(docs).collect()]
    assert Counter((r[0], r[2], r[3]) for r in found) == Counter([(None, 3, True), (3, 3, True), (4, 3, False), (5, 5, True), (6, 5, False), (7, 7, True), (7, 7, True), (None, None, True)])
    assert Counter(r.doc_id for r in minhash.drop_near_duplicates(docs).collect()) == Counter([None, 3, 5, 7, None])


def test_near_duplicates_of_repeated_ids(spark):
    """Rows of one id are one document: near copies of either text are linked, and no text is lost with another's row."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, "p q"), (4, "p q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert Counter(tuple(r) for r in minhash.drop_near_duplicates(docs).collect()) == Counter([(1, a), (1, b), (4, "p q")])


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(200):
        pool = rng.integers(0, 2**63, 150, dtype=np.uint64)
        a, b = np.unique(pool[:100]), np.unique(pool[50:])
        s = minhash.superminhash([a, b], 128)
        errors.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    # MinHash with as many registers has a standard error of 0.0417
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.0417
    one = minhash.superminhash([np.array([5], np.uint64)], 64)[0] >> np.uint64(32)
    assert sorted(one.tolist()) == list(range(64)), "one element: a permutation of the draws"


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 24))
    v = [*base, *(base[i % 3] + rng.normal(size=24) * 0.12 for i in range(120)), base[0] * 3, base[0], base[0]]
    rows = [(i, [float(np.float32(y)) for y in x], "l") for i, x in enumerate(v)]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [None] * 24, [1.0, float("inf")], [1.0], [1.0]]
    rows += [(1000 + i, x, None) for i, x in enumerate(odd)] + [(None, rows[0][1], "n")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, n_links string")
    out = vectors.vector_links(df)
    found = {r.vec_id: r for r in out.collect()}
    m = np.array([r[1] for r in rows[: len(v)]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = (m @ m.T >= 0.95) & ~np.eye(len(m), dtype=bool)
    comp = joined(range(len(v)), zip(*map(list, np.nonzero(near)), strict=True))
    to_nameless = m @ m[0] >= 0.95
    assert near.sum() > 1000
    assert all(found[i].n_links == near[i].sum() + to_nameless[i] and found[i].component_id == comp[i] and found[i].kept == (comp[i] == i) for i in range(len(v)))
    assert [(found[1000 + i].n_links, found[1000 + i].component_id) for i in range(8)] == [(0, 1000 + i) for i in range(6)] + [(1, 1006), (1, 1006)]
    assert out.count() == len(rows) and vectors.vector_links(df.limit(0)).count() == 0


def test_vectors_of_two_lengths(spark):
    rng = np.random.default_rng(4)
    base = {n: rng.normal(size=(3, n)) for n in (6, 10, 15)}
    v = [base[n][i % 3] + rng.normal(size=n) * 0.08 for i in range(40) for n in base]
    out = vectors.vector_links(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id int, embedding array<double>")).collect()
    near = {(i, j) for i, x in enumerate(v) for j, y in enumerate(v) if i != j and len(x) == len(y) and x @ y >= 0.95 * np.linalg.norm(x) * np.linalg.norm(y)}
    comp, links = joined(range(len(v)), near), Counter(i for i, _ in near)
    assert len(near) > 500 and all((r.n_links, r.component_id) == (links[r.vec_id], comp[r.vec_id]) for r in out)


def test_collision_chances_are_met():
    rng = np.random.default_rng(1)
    for cosine in (0.95, 0.5):
        a = vectors.unit(rng.normal(size=(4000, 32)))
        b = rng.normal(size=(4000, 32))
        b = vectors.unit(b - a * np.einsum("ij,ij->i", a, b)[:, None])
        b = cosine * a + np.sqrt(1 - cosine**2) * b
        hit = (vectors.table_keys(a, 1, 8) == vectors.table_keys(b, 1, 8)).mean()
        assert hit == pytest.approx(vectors.collision(np.sqrt(2 - 2 * cosine)), abs=0.02)


def test_sharding(spark):
    rng = random.Random(6)
    texts = [None, "", "", *("w" * rng.randint(0, 300) + str(i) for i in range(3000)), *["copy " * 20] * 1500]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, shard string")
    rows = sharding.shard_by_bytes(docs, 16).collect()
    size, slots, where = Counter(), {}, {}
    for r in rows:
        assert r.size == len((r.text or "").encode()) + 1
        size[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        where.setdefault(r.text, set()).add(r.shard)
    mean = sum(size.values()) / 16
    assert len(rows) == len(texts) and set(size) == set(range(16)) and all(abs(s - mean) < 0.02 * mean for s in size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(len(w) > 1 for t, w in where.items() if t) == 1, "only the group larger than a shard is cut"
    assert sharding.shard_by_bytes(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(None, "x" * 1000), (None, "x" * 1000), (1, None)], "doc_id bigint, text string")
    assert sharding.shard_by_bytes(one).count() == 3


def test_splitters_are_those_of_a_full_sort(spark):
    rng = random.Random(8)
    keys = [(rng.getrandbits(64) - (1 << 63), i, rng.choice([1, 10, 200, 3000])) for i in range(4000)] + [(7, i, 50) for i in range(3000)]
    cuts = sharding.find_splitters(spark.createDataFrame(keys, "h bigint, d bigint, n bigint"), 16, 0.01)
    rows = sorted(keys)
    mean = sum(n for *_, n in rows) / 16
    for i, cut in enumerate(cuts, 1):
        below, sums = sum(n for h, d, n in rows if (h, d) < cut), np.cumsum([0, *(n for *_, n in rows)])
        assert abs(below - i * mean) <= max(0.01 * mean, np.abs(sums - i * mean).min() + 1e-9)


def plain_bfd(lengths, window):
    open_, out = [], []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, room in enumerate(open_) if room >= n]
        if fit:
            open_[min(fit, key=lambda i: open_[i])] -= n
        else:
            open_.append(window - n)
    return sorted(open_), out


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    window = rng.choice([10, 64, 100])
    lengths = Counter(rng.randint(1, window) for _ in range(rng.choice([1, 20, 500])))
    plan = packing.plan_best_fit_decreasing(dict(lengths), window)
    starts = {}
    for n, rank, *rest in sorted(plan):
        starts.setdefault(n, []).append((rank, *rest))
    used, spans = Counter(), {}
    for n, total in lengths.items():
        for r in range(total):
            rank, first, each, there = [s for s in starts[n] if s[0] <= r][-1]
            at = first + (r - rank) // each
            used[at] += n
            spans.setdefault(at, []).append((there + (r - rank) % each * n, n))
    for s in spans.values():
        end = 0
        for offset, n in sorted(s):
            assert offset == end
            end += n
    assert sorted(window - u for u in used.values()) == plain_bfd(list(lengths.elements()), window)[0]
    assert sorted(used) == list(range(len(used)))


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    rng = random.Random(8)
    texts = [None, "", "a", "a", "It's ÀÉ 12! ﬁ İ \x1c<|endoftext|> Σας", *(" ".join(rng.choices(["alpha", "Beta,", "γ", "42", "naïve"], k=rng.choice([5, 300, 6000]))) for _ in range(30))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, start string")
    rows = packing.pack_documents(docs, path).collect()
    pieces, places = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids + [packing.END_ID]
        own = sorted(pieces[i], key=lambda r: r.start)
        assert np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist() == want and all(r.doc_tokens == len(want) and r.length == len(r.ids) // 4 for r in own)
        assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in own)
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
    for s in places.values():
        end = 0
        for offset, n in sorted(s):
            assert offset == end
            end += n
        assert end <= packing.WINDOW
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_words_are_the_librarys():
    own = packing._words(public.path("word_bpe_49k.json"))
    rng = random.Random(5)
    letters = [chr(c) for c in range(0x21, 0x250)] + ["'s", "'LL", "’", "É", "ſ", "İ", "e\u0301", "\x1d", "\x85", "\xa0", " ", "\u200b", "Σ", "日"]
    for _ in range(5000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 9)))
        assert own.encode(text) == own.whole(text), repr(text)
    assert own.plain


def test_frequent_words_stay_in_the_memo(monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 100)
    own, made = packing._Words(public.path("word_bpe_49k.json")), []
    piece = own._piece
    monkeypatch.setattr(own, "_piece", lambda p: made.append(p) or piece(p))
    text = " ".join(f"the w{chr(97 + i % 26)}{chr(97 + i // 26)}x, Then" for i in range(600))
    assert own.encode(text) == own.whole(text)
    assert made.count("the") == made.count("then") == made.count(",") == 1 and len(own) <= 100


def tone(seed, n=20_000):
    rng = np.random.default_rng(seed)
    notes = rng.choice([220, 262, 330, 392, 494, 587, 698], n // 500)
    return np.sin(2 * np.pi * np.cumsum(np.repeat(notes, 500)) / audio.RATE)


def raw(x):
    return bytes(np.clip(np.round(x * 90 + 128), 0, 255).astype(np.uint8))


def test_audio(spark):
    a, b = tone(1), tone(2)
    noisy = a + np.random.default_rng(3).normal(size=len(a)) * 0.02
    media = {3: raw(a), 5: raw(b), 7: raw(a), 9: raw(noisy), 11: raw(np.r_[np.zeros(640), a]), 12: None, 13: b"", 14: b"x" * 900, 15: raw(np.zeros(9000)), 16: raw(np.zeros(9000))}
    df = spark.createDataFrame(list(media.items()), "doc_id bigint, media binary")
    found = {r.doc_id: r for r in audio.align_recordings(df).collect()}
    assert (found[7].match_id, found[7].frame_offset, found[7].bit_error) == (3, 0, 0.0)
    assert found[9].match_id == 3 and found[9].frame_offset == 0 and 0 < found[9].bit_error < 0.15
    assert found[11].match_id == 3 and found[11].frame_offset == 10
    assert found[5].match_id is None and found[5].kept and [found[i].n_frames for i in (12, 13, 14)] == [0, 0, 0]
    assert found[16].match_id == 15
    assert {i for i, r in found.items() if r.component_id == 3} == {3, 7, 9, 11}
    assert audio.align_recordings(df.limit(0)).count() == 0


def test_audio_links_by_brute_force(spark):
    """Every recording against the first holder of each of its keys, with no index."""
    rng = np.random.default_rng(5)
    media = [raw(tone(i % 7, 8000) + rng.normal(size=8000) * 0.03 * (i > 6)) for i in range(21)]
    prints = [audio.fingerprint(m) for m in media]
    keys = [dict(zip(*map(list, audio.keys_of(p)), strict=True)) for p in prints]
    want = {}
    for i, own in enumerate(keys):
        votes = Counter()
        for k, at in own.items():
            first = next(j for j in range(len(keys)) if k in keys[j])
            if first < i:
                votes[first, at - keys[first][k]] += 1
        best = {}
        for (j, off), n in votes.items():
            best[j] = max(best.get(j, (0,)), (n, -abs(off), off))
        for j, (n, _, off) in sorted(best.items()):
            overlap, errors = audio.align(prints[i], prints[j], off)
            if n >= audio.VOTES and overlap >= audio.OVERLAP and errors <= audio.ERRORS:
                want.setdefault(i, (j, off, overlap))
    out = audio.align_recordings(spark.createDataFrame(list(enumerate(media)), "doc_id bigint, media binary")).collect()
    assert {r.doc_id: (r.match_id, r.frame_offset, r.overlap) for r in out if r.match_id is not None} == want and len(want) > 7


@pytest.mark.parametrize("block", [256, 2])
def test_audio_components_are_those_of_all_pairs(spark, monkeypatch, block):
    """10 and 11 differ only around the joint; all their shared keys are first held by 1 and 2."""
    monkeypatch.setattr(audio, "BLOCK", block, raising=False)
    rng = np.random.default_rng(6)
    one, two = (tone(i, 32000) * 0.7 + rng.normal(size=32000) * 0.05 for i in (21, 22))  # noise: no filter's value is at a step
    parts = {1: [one, tone(23, 32000)], 2: [tone(24, 32000), two], 10: [one, two], 11: [one, two]}
    parts |= {20 + i: [one, tone(30 + i % 4, 32000)] for i in range(5)}
    media = {i: np.concatenate(x) for i, x in parts.items()}
    media[11][30500:33500] = rng.normal(size=3000)
    media = {i: raw(x) for i, x in media.items()}
    prints = {i: audio.fingerprint(m) for i, m in media.items()}
    keys = {i: dict(zip(*map(list, audio.keys_of(p)), strict=True)) for i, p in prints.items()}
    links = set()
    for i in prints:
        for j in prints:
            for off, n in Counter(keys[i][k] - keys[j][k] for k in keys[i].keys() & keys[j].keys()).items() if j < i else ():
                overlap, errors = audio.align(prints[i], prints[j], off)
                if n >= audio.VOTES and overlap >= audio.OVERLAP and errors <= audio.ERRORS:
                    links.add((i, j))
    out = {r.doc_id: r for r in audio.align_recordings(spark.createDataFrame(list(media.items()), "doc_id bigint, media binary")).collect()}
    assert (11, 10) in links and not links & {(10, 1), (10, 2), (11, 1), (11, 2)}
    assert out[11].match_id == 10 and not out[11].kept and all((i, r.match_id) in links for i, r in out.items() if r.match_id is not None)
    assert {i: r.component_id for i, r in out.items()} == joined(list(media), links)


def test_audio_recall_and_edges(spark):
    """Noisy, shifted and cut copies against all pairs, with rows that repeat ids or have none."""
    rng = np.random.default_rng(11)
    media = {}
    for i in range(12):
        x = tone(100 + i, 24000) * 0.7
        media |= {10 * i: x, 10 * i + 1: x + rng.normal(size=len(x)) * 0.01, 10 * i + 2: np.r_[np.zeros(64 * 9), x], 10 * i + 3: x[6400:]}
    prints = {i: audio.fingerprint(raw(x)) for i, x in media.items()}
    same = {(i, j) for i in prints for j in prints if i < j and i // 10 == j // 10 and min(audio.align(prints[i], prints[j], o)[1] for o in (0, -9, 100, 109, -100)) <= audio.ERRORS}
    rows = [(i, raw(x)) for i, x in media.items()] + [(0, raw(media[10])), (None, raw(media[20])), (500, None), (501, bytes(2_000_000))]
    out = audio.align_recordings(spark.createDataFrame(rows, "doc_id int, media binary").withColumn("kept", F.lit("x"))).collect()
    assert len(out) == len(rows)
    found = {r.doc_id: r.component_id for r in out if r.doc_id is not None}
    assert len(same) > 40 and sum(found[i] == found[j] for i, j in same) >= 0.9 * len(same)
    assert found[10] == 0 and found[500] == 500 and all(found[i] // 10 == i // 10 for i in media if i // 10 > 1)
    assert [(r.component_id, r.match_id, r.kept) for r in out if r.doc_id is None] == [(None, None, True)]


@pytest.mark.parametrize("bits,form", [(8, 1), (16, 1), (24, 1), (32, 1), (32, 3)])
def test_wave_widths_and_rates(bits, form):
    t = tone(1, 8000) * 0.5
    twice = np.interp(np.arange(16000) / 2, np.arange(8000), t)
    if form == 3:
        data = twice.astype("<f4").tobytes()
    elif bits == 8:
        data = (np.round(twice * 127) + 128).astype(np.uint8).tobytes()
    else:
        whole = np.round(twice * ((1 << (bits - 1)) - 1)).astype("<i8")
        data = whole.view(np.uint8).reshape(-1, 8)[:, : bits // 8].tobytes()
    head = b"RIFF" + (36 + len(data)).to_bytes(4, "little") + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, form, 1, 16000, 16000 * bits // 8, bits // 8, bits) + b"data" + struct.pack("<I", len(data))
    x, rate = audio.samples(head + data)
    assert rate == 16000 and np.abs(x - twice).max() < 0.02
    own, want = audio.fingerprint(head + data), audio.fingerprint(raw(t))
    assert abs(len(own) - len(want)) <= 1 and audio.align(own, want, 0)[1] < audio.ERRORS


def test_wave_header():
    x = (tone(1, 4000) * 9000).astype("<i2").tobytes()
    head = b"RIFF" + (36 + len(x)).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + (1).to_bytes(2, "little") + (1).to_bytes(2, "little") + (8000).to_bytes(4, "little") + (16000).to_bytes(4, "little") + (2).to_bytes(2, "little") + (16).to_bytes(2, "little") + b"data" + len(x).to_bytes(4, "little")
    y, rate = audio.samples(head + x)
    assert rate == 8000 and len(y) == 4000 and np.abs(y).max() < 0.3
    assert len(audio.fingerprint(head + x)) > 0 and len(audio.fingerprint(b"RIFF1234WAVE")) == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    good = lambda: " ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 8))) for _ in range(60))
    texts = [good() for _ in range(160)]
    bad = [good().upper().replace(" ", "!! ") for _ in range(60)]
    rows = [*texts, *bad, texts[0], texts[1] + " extra", texts[2] + " mail me@here.org"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 160), 0) for i in range(220)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    first = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, first, str(tmp_path))
        assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(f"{tmp_path}/{k}")
        first = spark.read.parquet(f"{tmp_path}/{k}")
    left = {r.doc_id: r for r in first.collect()}
    assert set(left) == set(range(160)) and all(r.n_chars == len(r.text) for r in left.values())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(left) and len({r.sequence_id for r in packed}) == -(-sum(r.length for r in packed) // 4096)


def test_pipeline_edges(spark, tmp_path):
    """Nulls, empty, very long and repeated texts, extra columns and empty tables go through every stage."""
    import corpus_pipeline

    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 8))) for _ in range(n))
    rows = [(i, prose(60), i) for i in range(80)] + [(i, prose(40).upper().replace(" ", "!! "), 0) for i in range(80, 120)]
    odd = [(200, None, 1), (201, "", 1), (202, " \t", 1), (203, prose(30_000), 1), (None, prose(50), 1), (None, None, 1), (0, rows[0][1], 0)]
    schema = "doc_id bigint, text string, row_ int"
    docs = spark.createDataFrame(rows + odd, schema).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(NULL AS bigint) AS n_chars", "row_", "row_ AS score", "row_ AS id")
    spark.createDataFrame([(i, int(i < 80), 0) for i in range(120)] + [(None, 1, 0), (1, None, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    good = corpus_pipeline.keep_good(spark, docs, str(tmp_path))
    assert good.columns == list(corpus_pipeline.COLUMNS)
    kept = {r.doc_id for r in good.collect()}
    assert set(range(80)) <= kept and not kept & set(range(80, 120))
    one = corpus_pipeline.keep_one_of_each(spark, docs, str(tmp_path))
    ids = Counter(r.doc_id for r in one.collect())
    assert one.columns == list(corpus_pipeline.COLUMNS) and ids[0] == 1 and ids[None] == 2 and ids[203] == ids[200] == ids[201] == 1
    masked = corpus_pipeline.mask_personal(spark, docs, str(tmp_path)).collect()
    assert len(masked) == len(rows) + len(odd) and {r.n_chars for r in masked if r.text is None} == {None} and all(r.n_chars == len(r.text) for r in masked if r.text is not None)
    packed = corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()
    assert sum(r.start == 0 for r in packed) == len(rows) + len(odd) and packed[0].row_ is not None
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


#: Every name that the operators give to columns of their own.
NAMES = (
    "row_ id th m n hi lo bands rep size key center mark comp component node src dst a b src_th dst_th of_id gone of_hi of_lo "
    "h d part at before place v of_v fine weight keys dim table block links c l class token of_url p dotted rule_id rule_name "
    "row k y o x y_id _id _y _n _c _part _at _row _bits _key_row _byte _possible _bit _host_rule _rest a.b"
).split()


def test_callers_columns_may_have_any_name(spark):
    long = " ".join(f"w{i}" for i in range(40))
    base = [(1, long), (2, long + " more"), (3, None), (None, "x y"), (1, long), (4, "other words here altogether now")]
    vectors_ = [[1.0, 0.0], [1.0, 0.01], None, [0.0, 1.0], [1.0, 0.0], [0.0, 0.0]]
    docs = spark.createDataFrame([(i, t, x, raw(tone(i or 9, 4000)), f"http://a{i}.com/en/") for (i, t), x in zip(base, vectors_, strict=True)], "doc_id int, text string, vec array<double>, media binary, url string")
    wide = docs.select("*", *[F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in NAMES if n not in docs.columns])
    path = public.path("word_bpe_49k.json")
    runs = {
        "links": lambda t: vectors.vector_links(t, "doc_id", "vec"),
        "shards": lambda t: sharding.shard_by_bytes(t, 2),
        "copies": lambda t: minhash.near_duplicates(t),
        "one": lambda t: minhash.drop_near_duplicates(t),
        "audio": lambda t: audio.align_recordings(t),
        "urls": lambda t: urls.filter_urls(t),
        "packed": lambda t: packing.pack_documents(t, path, with_ids=False),
        "pii": lambda t: pii.find_pii(t),
        "masked": lambda t: pii.redact_pii(t),
        "scored": lambda t: quality.score_quality(t, quality.train(t, t.selectExpr("*", "1 AS quality"))),
    }
    for name, run in runs.items():
        plain, out = run(docs), run(wide)
        extra = [n for n in NAMES if n in out.columns and n not in plain.columns]
        assert set(extra) == set(NAMES) - set(plain.columns), name
        assert [c for c in out.columns if c not in extra] == plain.columns, name
        rows = out.collect()
        assert Counter(repr(tuple(r[c] for c in plain.columns)) for r in rows) == Counter(map(repr, map(tuple, plain.collect()))), name
        assert all(r[n] == f"{n} {'-' if r.doc_id is None else r.doc_id}" for r in rows for n in extra), name

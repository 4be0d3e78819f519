"""BPE, PII, HTML, URL filters and quality on small tables, against libraries and brute force."""

import hashlib
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

public = pytest.importorskip("public_tokenizers")

from tidemark.llm import bpe, html, pii, quality, urls  # noqa: E402

LONG = "word " * 40_000
TEXTS = [None, "", " ", "a", "Hello  world!\n\n it's 42 naïve 日本語 🙂", "Same.", "Same.", LONG, "x" * 50_000, "\x00\x1c\x85  　 é"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "other", i) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, score int")


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def test_bpe_is_the_librarys(codec):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    random.seed(2)
    parts = ["a", "aa", "b", " ", "  ", "\n", "\t", "\u00a0", "\x1c", "\x85", "\u2003", "\u3000", "'s", "'ll", "é", "日本", "1", "٣", "½", "!", "🙂", "\r\n", "_", "́", "The ", "ing"]
    for text in [*filter(None, TEXTS), *("".join(random.choices(parts, k=random.randint(0, 20))) for _ in range(4000))]:
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text), repr(text[:50])
        assert codec.decode(ids) == text.encode()


def test_bpe_keeps_runs_of_other_white_space_whole(codec):
    tiktoken = pytest.importorskip("tiktoken")
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    assert codec.encode("a \u00a0 \u00a0 b") == [64, 11504, 275]
    for space in ("\u00a0", "\n", "\t", "\x85", "\u2003", "\u3000", "\x1c"):
        for n in range(1, 9):
            for text in (f"a{(' ' + space) * n} b", f"a{(space + ' ') * n}b", f"{(space + ' ') * n}", f"a b{space} c{(' ' + space) * n}"):
                assert codec.encode(text) == library.encode(text), (space, n)


def test_bpe_rank_ties_go_left():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aab": 257, b"ab": 258}
    own = bpe.BytePairCodec(ranks, r"\S+")
    assert own.merge(b"aaa") == [256, 97] and own.merge(b"aaab") == [256, 258] and own.merge(b"aaaa") == [256, 256]


def test_bpe_frames(docs, codec):
    path = public.path("byte_bpe_50k.tiktoken")
    out = bpe.bpe_decode(bpe.bpe_encode(docs, path, public.PATTERN), path, public.PATTERN)
    assert out.columns == ["doc_id", "text", "score", "ids", "decoded"]
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 1 and all(bytes(r.decoded) == (r.text or "").encode() for r in rows)
    assert bpe.bpe_encode(docs.limit(0), path, public.PATTERN).count() == 0


def simple_spans(text):
    """The base kinds by the plainest regular expressions."""
    found = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((kind, m.start(), m.end()))
    return sorted(found, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_pii_base_is_the_plain_one():
    random.seed(5)
    parts = ["a", "a.b", "@", "@x.y", ".", "1", "23", "4111 1111 1111 1111", "255", ".1", "-", " ", "+", "+1 (555) 123-4567", "(", "_", "%", "é", "1.2.3.4", "300.1.1.1", "4012888888881881"]
    for _ in range(20_000):
        text = "".join(random.choices(parts, k=random.randint(1, 12)))
        assert [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE] == simple_spans(text), text


def test_pii_checksums_context_and_edges(docs):
    kinds = lambda t: [s[0] for s in pii.find_spans(t)]
    assert kinds("IBAN DE89370400440532013000 ok") == ["iban"] and kinds("IBAN DE89370400440532013001 ok") == []
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    near, far = pii.find_spans("call +1 555 123 4567")[0][3], pii.find_spans("xxxx +1 555 123 4567")[0][3]
    assert near > far
    for text in ("1" * 200_000, "1.1." * 50_000, "+1(" * 60_000, "a@" * 60_000, "1 " * 100_000, "a" * 200_000 + "@"):
        pii.find_spans(text)
    found = pii.find_pii(docs.withColumn("pii", F.lit(1))).collect()
    assert len(found) == len(TEXTS) + 1 and all(r.pii == [] for r in found)
    assert pii.redact("a@b.co é +1 555 123 4567", pii.find_spans("a@b.co é +1 555 123 4567")) == "[EMAIL] é [PHONE]"
    assert {r.text for r in pii.redact_pii(docs).collect()} == {*TEXTS, "no id"}


def test_pii_context_decides():
    kinds = lambda t: [s[0] for s in pii.find_spans(t)]
    for kind, span, speaks, against in (
        ("ssn", "123-45-6789", "ssn", "part"), ("tel", "(555) 123-4567", "call", "order"), ("tel", "555-123-4567", "fax", "isbn"),
        ("secret", "24be64439e3e49cf46b2d7c90f3602a3", "token =", "md5"), ("secret", "sk_live_9aB8c7D6e5F4g3H2", "api_key:", "commit"),
    ):
        assert kinds(f"{speaks} {span} x") == [kind] and kinds(f"{against} {span} x") == [] and kinds(f"{span}") == [], span
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 ok") == ["iban"] and kinds("DE89370400440532013000") == ["iban"]
    assert kinds("example DE89 3704 0044 0532 0130 00 of a code") == [], "a word against it takes it below the least score"
    for after in ("", " EUR", " 1332 FROM", ".", " 50"):
        text = f"pay ES91 2100 0418 4502 0005 1332{after}"
        assert [s[:3] for s in pii.find_spans(text)] == [("iban", 4, 33)], text
    assert kinds("ES9121000418450200051332X") == [] and kinds("ZZ91 2100 0418 4502 0005 1332") == []
    assert kinds("call +1 555 123 4567") == ["phone"] and kinds("token " + "a1b2c3d4e5" * 60) == []
    for text in ("token " + "aB1-" * 50_000, "DE89" * 50_000, "555-" * 50_000, "(555) " * 40_000):
        pii.find_spans(text)


def plain_iban(code):
    """ISO 7064 by the book, digit by digit."""
    rest = 0
    for c in code[4:] + code[:4]:
        for d in str(int(c, 36)):
            rest = (rest * 10 + int(d)) % 97
    return rest == 1


def test_iban_by_brute_force():
    rng = random.Random(12)
    for _ in range(3000):
        land = rng.choice(["DE", "NO", "GB", "ZZ"])
        body = "".join(rng.choices("0123456789AB", k=rng.choice([11, 18])))
        check = next((f"{k:02}" for k in range(2, 99) if plain_iban(f"{land}{k:02}{body}")), "00") if rng.random() < 0.7 else f"{rng.randint(0, 99):02}"
        code = land + check + body
        want = len(code) == pii.IBAN_LENGTH.get(land) and plain_iban(code)
        assert bool([s for s in pii.find_spans(f"({code})") if s[0] == "iban"]) == want, code


def naive_table(rows):
    """A grid of (row, column) that each cell is written into, one after the other."""
    taken, cells, owner = set(), [], {}
    for r, row in enumerate(rows):
        c = 0
        for i, (lines, span, down) in enumerate(row):
            while (r, c) in taken:
                c += 1
            cells.append((r, c, span, lines, i == len(row) - 1))
            taken |= {(r + y, c + x) for y in range(1, down) for x in range(span)}
            c += span
    columns = max((c for _, c, *_ in cells), default=0) + 1
    width = {x: max([0, *(len(t) for _, c, s, ls, end in cells for t in ls if c == x and s == 1 and not end)]) for x in range(columns)}
    for _, c, s, ls, end in cells:
        if s > 1 and not end:
            last = min(c + s, columns) - 1
            width[last] += max(0, max(map(len, ls), default=0) - sum(width[x] for x in range(c, last + 1)) - 2 * (last - c))
    out = []
    for r in range(len(rows)):
        own = [x for x in cells if x[0] == r]
        for k in range(max((len(x[3]) for x in own), default=0)):
            line = ""
            for _, c, _, ls, _ in own:
                line = line.ljust(sum(width[x] + 2 for x in range(c))) + (ls[k] if k < len(ls) else "")
            out.append(line.rstrip(" "))
    return out


def test_tables_by_brute_force():
    rng = random.Random(7)
    for _ in range(400):
        rows = [[([rng.choice("abcd") * rng.randint(1, 30) for _ in range(rng.choice([1, 1, 2]))], rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 2, 3])) for _ in range(rng.randint(0, 5))] for _ in range(rng.randint(1, 6))]
        assert html.table_lines(rows) == naive_table(rows), rows


def simple_page(rng):
    """A random page and its text, from one list of blocks."""
    words = lambda: " ".join("".join(rng.choices("abcde", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 5)))
    page, blocks = [], []
    for _ in range(rng.randint(1, 8)):
        kind = rng.choice(["p", "div", "ul", "ol", "table", "h2", "hidden", "pre"])
        if kind in ("p", "div", "h2"):
            text = words()
            page.append(f"<{kind}> {text.replace(' ', rng.choice(['  ', chr(10), ' <b></b>']))} " + (f"</{kind}>" if kind != "p" or rng.random() < 0.5 else ""))
            blocks.append((kind != "div", [text]))
        elif kind in ("ul", "ol"):
            items = [words() for _ in range(rng.randint(1, 4))]
            page.append(f"<{kind}>" + "".join(f"<li>{x}" + rng.choice(["", "</li>"]) for x in items) + f"</{kind}>")
            blocks.append((True, [("- " if kind == "ul" else f"{i}. ") + x for i, x in enumerate(items, 1)]))
        elif kind == "table":
            rows = [[words() for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 4))]
            page.append("<table>" + "".join("<tr>" + "".join(f"<td>{x}" for x in row) for row in rows) + "</table>")
            blocks.append((True, naive_table([[([x], 1, 1) for x in row] for row in rows])))
        elif kind == "pre":
            lines = [words() for _ in range(rng.randint(1, 3))]
            page.append("<pre>" + "\n".join(lines) + "</pre>")
            blocks.append((True, lines))
        else:
            page.append(f"<div hidden>{words()}</div><script>{words()}</script><!-- {words()} --><details><p>{words()}</details>")
    text: list[str] = []
    for i, (apart, lines) in enumerate(blocks):
        text += [""] * (i > 0 and (apart or blocks[i - 1][0])) + lines
    return "".join(page), "\n".join(text)


def test_html_by_a_second_renderer():
    rng = random.Random(3)
    for _ in range(500):
        page, text = simple_page(rng)
        assert html.render(page) == text, page


def test_html_tables_with_spans_and_limits():
    assert html.render("<table><tr><td rowspan=2>a<td>b<td>c<tr><td>y<td>z<tr><td colspan=2>wide wide<td>q</table>") == "a  b       c\n   y       z\nwide wide  q"
    assert html.render(f"<table><tr><td>{'x' * 50}<td>b<tr><td>k<td>c</table>") == f"{'x' * 50}  b\nk{' ' * 51}c"
    long = html.render(f"<table><tr><td>{'ab ' * 80}<td>b</table>").split("\n")
    assert len(long) == 3 and max(map(len, long)) <= html.CELL + 3 and "".join(long).count("ab") == 80
    assert html.render("<details><summary>s</summary>h</details><details open><summary>t</summary>v</details>") == "s\nt\nv"
    for page in ("<table>" + "<tr><td rowspan=9999 colspan=9999>x" * 3000, "<table><tr>" + "<td>" * 20_000 + "x", "<table>" + ("<tr>" + "<td>" * 50 + "y" * 5) * 2000, "<table><tr><td>" + "w" * 300_000 + "<td>x" + "<tr><td>a<td>b" * 2000):
        assert len(html.render(page)) < 80 * len(page)


def test_html_layout():
    page = "<title>t</title><p>One <b>two</b><p>three<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul><table><tr><td>n<td>long cell<tr><th>a b<td>c</table><pre> x\n  y</pre><div hidden>h</div><p style='display: none'>n</p>end &amp; <script>s</script>&eacute;<br>z"
    assert html.render(page) == "One two\n\nthree\n\n- a\n- b\n  3. c\n  4. d\n\nn    long cell\na b  c\n\n x\n  y\n\nend & é\nz"


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("a < b", "a < b"), ("<p it's>y</p><a", "y"), ("<div>" * 30_000 + "x", "x"), ("<!-- <p>c --><b>k", "k"), ("</p></li>t", "t"), ("<td>1<td>2", "12"), ("<table><tr><td>o<table><tr><td>i</table><td>p</table>", "o  p\n\ni"), ("<template>n</template><noscript>m</noscript>v", "v")])
def test_html_edges(page, text):
    assert html.render(page) == text


def test_html_frame_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "<p>a"), (1, "<p>a"), (2, None)], "page_id int, html string").withColumn("text", F.lit("old"))
    assert sorted((r.page_id, r.text or "-") for r in html.extract_html(pages).collect()) == [(1, "a"), (1, "a"), (2, "-")]
    assert html.extract_html(pages.limit(0)).count() == 0


def judge(url):
    """Every rule tried on every URL."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(str.maketrans(urls.UPPER, urls.LOWER))
    fits = [r for r in urls.HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    if best:
        return host, path, best.name, best.verdict
    bad = url is not None and any(re.search(r.pattern.replace(r"\z", r"\Z").replace("(?i)", ""), url, re.I) for r in urls.PATTERN_RULES)
    return host, path, None, "block" if bad else "allow"


def test_url_filters(spark):
    made = [f"{s}{h}{p}" for s in ("http://", "https://", "") for h in ("A.Example.COM", "example.com", "com", "notexample.com", "b.example.net", "x.org", "x.org:80", "casino.fr", "u@v.com") for p in ("", "/", "/en/", "/en/7", "/en/71?x", "/de/8.html#a", "/de/9", "/es/?q=/en/", "?/en/", "/a.exe", "/wp-login.php", "/EN/7")]
    rows = [(i, u, "h") for i, u in enumerate([*made, None, "", "no scheme", "://", "a://b://com/en/", made[0], "http://com/en/ porn."])]
    out = urls.filter_urls(spark.createDataFrame(rows, "page_id int, url string, host string"))
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert found == {i: judge(u) for i, u, _ in rows}
    assert urls.filter_urls(spark.createDataFrame([], "page_id int, url string")).count() == 0


def test_the_host_rules_are_the_contracts(spark):
    """The words of the contract's list, not those of the code."""
    assert {(r.verdict, r.name) for r in urls.HOST_RULES} == {("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")}
    made = [("http://a.net/de/casino", "net/de/", "allow"), ("http://example.net/de/9.exe", "net/de/", "allow"), ("http://b.example.net/de/81", "example.net/de/8", "block"), ("http://example.com/en/7.exe", "example.com/en/7", "allow"), ("http://example.com/en/8", "com/en/", "block"), ("http://c.org/es/", "org/es/", "block"), ("http://casino.net/fr/", None, "block")]
    out = urls.filter_urls(spark.createDataFrame([(u,) for u, _, _ in made], "url string"))
    assert {(r.url, r.rule, r.verdict) for r in out.collect()} == set(made)


def test_literals_follow_from_the_pattern():
    assert [r.literals() for r in urls.PATTERN_RULES] == [["casino"], ["porn"], ["php"], ["exe"], ["apk"]]
    for pattern, want in (("/abc/", ["abc"]), ("abc", []), ("/a/|/b/", []), ("/ab+c/", []), ("/ab?/x/", ["x"]), (r"\bads\d+\b", []), ("[?&]utm_source=(x|y)", ["utm", "source"]), (r"^https://foo\.bar/", ["https", "foo", "bar"]), ("/(?:ads|ad)/banner[.]gif$", ["banner", "gif"]), ("(?x)/a/", []), ("/[a-z]x/", []), ("/(a/)?b/", []), ("/a{0,2}/", []), (r"/\Qa\E/", [])):
        assert urls.required_tokens(pattern) == want, pattern
    with pytest.raises(ValueError):
        urls.Rule("block", pattern="casino").literals()


def test_many_rules_by_brute_force(spark):
    rng = random.Random(2)
    words = ["ads", "track", "img", "x1", "news", "pop"]
    rules = [urls.Rule("block" if i % 3 else "allow", pattern=rng.choice(["(?i)", ""]) + rng.choice([r"/{}/", r"\b{}\b", r"[/.]{}[./-]", r"\.{}([?#]|\z)", r"//[^/]*\b{}\.(com|net)\b", r"[?&]{}=[0-9]+"]).format(rng.choice(words))) for i in range(60)]
    rules = list({r.pattern: r for r in rules}.values()) + list(urls.HOST_RULES)
    made = ["http://" + rng.choice(["", "www.", "ads.", "X1-"]) + rng.choice(words) + rng.choice([".com", ".net", ".de"]) + "".join(rng.choice("/.-?&=_") + rng.choice([*words, "ADS", "7", "en"]) for _ in range(rng.randint(0, 5))) for _ in range(1500)]
    out = urls.filter_urls(spark.createDataFrame([(i, u) for i, u in enumerate(made)], "page_id int, url string"), rules).collect()
    hits = 0
    for r in out:
        fits = [x for x in rules if x.pattern and re.search(x.pattern.replace(r"\z", r"\Z"), r.url, re.ASCII)]
        best = max(fits, key=lambda x: (x.verdict == "block", x.name), default=None)
        if judge(r.url)[2] is None:
            hits += best is not None
            assert (r.pattern, r.verdict) == ((best.pattern, best.verdict) if best else (None, "allow")), r.url
    assert hits > 200


def test_very_long_urls(spark):
    out = urls.filter_urls(spark.createDataFrame([(1, "http://a.com/" + "x/" * 200_000 + "a.exe"), (2, "http://b.com/en/" + "y" * 300_000)], "page_id int, url string"))
    assert sorted((r.page_id, r.rule, r.verdict) for r in out.collect()) == [(1, None, "block"), (2, "com/en/", "block")]


def test_url_filters_use_no_python(spark):
    plan = urls.filter_urls(spark.createDataFrame([(1, "http://a.com/")], "page_id int, url string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def junk(rng, bad):
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 8))) for _ in range(rng.randint(20, 60))]
    return " ".join(w.upper() + "!!" if bad else w for w in words)


def test_quality_learns_and_holds_out(spark):
    rng = random.Random(3)
    rows = [(i, junk(rng, i % 4 == 0), int(i % 4 != 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, y int")
    labels = docs.selectExpr("doc_id", "y AS quality")
    model = quality.train(docs, labels)
    scored = quality.score_quality(docs.withColumn("score", F.lit("old")), model).withColumn("held", quality.held_out()).collect()
    assert all((r.score >= 0.3) == bool(r.y) for r in scored if r.held) and any(r.held for r in scored)
    # held-out labels are never read
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.train(docs, flipped)
    assert (again.weight == model.weight).all() and again.shift == model.shift
    held = {r.doc_id: r.held for r in docs.withColumn("held", quality.held_out()).collect()}
    import zlib

    assert held == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in held}


def plain_grams(text):
    """The n-grams of the three streams, in plain integers."""
    mask = (1 << 32) - 1
    bucket = lambda code, stream: (((code * 2654435761 + stream * 40503) & mask) * 0x85EBCA6B & mask) >> (32 - quality.BITS)
    raw, found = (text or "").encode(), set()
    for i in range(len(raw) - 2):
        found.add(bucket(raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2], 0))
    kind = lambda b: 1 if 97 <= b <= 122 or b > 127 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b in (9, 32) else 5 if b in (10, 11, 12, 13) else b
    shape = []
    for b in map(kind, raw):
        if not shape or b != shape[-1] or b > 5:
            shape.append(b)
    for n in range(1, 6):
        for i in range(len(shape) - n + 1):
            acc = 0
            for s in shape[i : i + n]:
                acc = (acc * 0x01000193 + s) & mask
            found.add(bucket(acc, n))
    words, best, now = raw.split(), 0, 0
    for a, b in zip(words, words[1:], strict=False):
        now = now + 1 if a == b else 0
        best = max(best, now)
    return found | {bucket(n, 99) for n in quality.REPEATS if best >= n}


def test_quality_by_brute_force():
    import numpy as np

    rng = random.Random(5)
    texts = [junk(rng, i % 3 == 0) + rng.choice(["", " a a a", "\n\n7 7", " é", "\x00"]) for i in range(80)] + ["", "a", "ab"]
    grams = [plain_grams(t) for t in texts]
    assert all(set(quality.ngrams(t).tolist()) == g for t, g in zip(texts, grams, strict=True))
    good = np.array([i % 3 != 0 for i in range(len(texts))])
    ratio = quality.log_ratio([quality.ngrams(t) for t in texts], good)
    size = 1 << quality.BITS
    counts = [{}, {}]
    for g, y in zip(grams, good, strict=True):
        for x in g:
            counts[int(y)][x] = counts[int(y)].get(x, 0) + 1
    share = [lambda x, c=c: (c.get(x, 0) + quality.SMOOTHING) / (sum(c.values()) + size * quality.SMOOTHING) for c in counts]
    seen = set().union(*grams)
    assert all(abs(ratio[x] - np.log(share[1](x) / share[0](x))) < 1e-9 for x in seen)
    model = quality.fit([quality.ngrams(t) for t in texts], good)
    for t, g in zip(texts, grams, strict=True):
        length = sum(model.ratio[x] ** 2 for x in g) ** 0.5
        margin = sum(model.weight[x] for x in g) / length if length else 0.0
        assert abs(model.score(t) - 1 / (1 + np.exp(-(model.slope * margin + model.shift)))) < 1e-9


def test_quality_edges(docs, spark):
    nothing = quality.train(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, quality int"))
    rows = quality.score_quality(docs, nothing).collect()
    assert len(rows) == len(TEXTS) + 1 and all(r.score == 0.5 for r in rows)
    assert quality.score_quality(docs.limit(0), nothing).count() == 0
    assert len(quality.ngrams(None)) == 0 and len(quality.ngrams("a")) == 1


def test_dual_descent_reaches_the_optimum():
    """The primal of a small problem can't be lowered by small steps."""
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(20, 6, replace=False)) for _ in range(40)]
    values = [v / np.linalg.norm(v) for v in rng.normal(size=(40, 6))]
    y = rng.choice([-1.0, 1.0], 40)
    cost = np.full(40, 1.0)
    quality_epochs = quality.EPOCHS
    quality.EPOCHS = 400
    try:
        w = quality.descend(rows, values, y, cost)
    finally:
        quality.EPOCHS = quality_epochs

    def primal(v):
        return v @ v / 2 + sum(c * max(0, 1 - s * float(v[x] @ u)) for x, u, s, c in zip(rows, values, y, cost, strict=True))

    best = primal(w)
    assert all(primal(w + 1e-3 * np.r_[rng.normal(size=20), np.zeros(len(w) - 20)]) >= best - 1e-6 for _ in range(50))


def test_digest_of_ids(spark):
    digest = F.arrow_udf(bpe._digest(public.path("byte_bpe_50k.tiktoken"), public.PATTERN), "struct<n_tokens bigint, ids_sha256 string, decoded_sha256 string>")
    row = spark.createDataFrame([("Hello world",)], "text string").select(digest("text").alias("d")).first().d
    ids = bpe.codec(public.path("byte_bpe_50k.tiktoken"), public.PATTERN).encode("Hello world")
    assert row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and row.n_tokens == len(ids)
    assert row.decoded_sha256 == hashlib.sha256(b"Hello world").hexdigest()

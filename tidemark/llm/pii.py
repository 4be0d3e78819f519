"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Offsets are code points, ends exclusive. Four base kinds are always kept once confirmed:

* ``email``  local part, ``@``, two or more dotted labels
* ``ip``     four dotted numbers, each at most 255
* ``card``   12 to 19 digits with single blanks or hyphens between, passing Luhn
* ``phone``  ``+`` and a digit, then digits and punctuation, 9 to 15 digits in all

The method adds four kinds. ``iban`` is confirmed by its country's length and mod-97, unless words nearby
speak of an example. ``ssn`` (three groups of digits), ``tel`` (ten digits without a ``+``) and ``secret``
(a long run of letters and digits) have no checksum: words nearby must speak for them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.storage import named, without

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "tel", "secret")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin within a run of digits unless it could at the run's start, so the look-behind
# only keeps very long runs from being tried at every digit.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_TEL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile("[0-9]")

#: Words within WINDOW code points that raise or lower a proposal's score.
WINDOW = 40
START = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.7, "ssn": 0.3, "tel": 0.3, "secret": 0.3}
RAISE = {
    "email": re.compile(r"(?i)\b(e-?mail|mail|contact|write)\b"),
    "ip": re.compile(r"(?i)\b(ip|address|host|server)\b"),
    "card": re.compile(r"(?i)\b(card|visa|credit|payment|master)\b"),
    "phone": re.compile(r"(?i)\b(phone|tel|call|mobile|fax)\b"),
    "iban": re.compile(r"(?i)\b(iban|account|bank)\b"),
    "ssn": re.compile(r"(?i)\b(ssn|social security)\b"),
    "tel": re.compile(r"(?i)\b(phone|tel|telephone|call|mobile|cell|fax)\b"),
    "secret": re.compile(r"(?i)(\b|_)(token|secret|password|passwd|api[ _-]?key|access[ _-]?key|bearer|credentials?)(\b|_)"),
}
LOWER = {
    "ip": re.compile(r"(?i)\b(version|release|section)\b"),
    "card": re.compile(r"(?i)\b(order|isbn|serial)\b"),
    "iban": re.compile(r"(?i)\b(example|sample|test|dummy)\b"),
    "ssn": re.compile(r"(?i)\b(part|order|serial|model)\b"),
    "tel": re.compile(r"(?i)\b(part|order|serial|isbn|model)\b"),
    "secret": re.compile(r"(?i)\b(sha-?1|sha-?256|md5|commit|checksum|digest)\b"),
}
LEAST = 0.5
#: Longest run that counts as a secret.
SECRET_MOST = 512

#: Characters of an IBAN by country (ISO 13616).
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27,
    "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches; each must hold an ``@``, whose left run is the local part."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Codes of their country's length, single blanks allowed between characters, that pass mod-97."""
    for m in _IBAN.finditer(text):
        want, at, code = IBAN_LENGTH.get(m[0][:2], 0), m.start(), ""
        while at < len(text) and len(code) < want:
            c = text[at]
            if "0" <= c <= "9" or "A" <= c <= "Z":
                code += c
            elif c != " " or text[at - 1] == " ":
                break
            at += 1
        if want and len(code) == want and not (at < len(text) and text[at].isascii() and text[at].isalnum()) and mod97(code):
            yield m.start(), at


def _is_secret(run: str) -> bool:
    """Letters and digits, at least ten different characters."""
    return len(run) <= SECRET_MOST and len(set(run)) >= 10 and any(c.isdigit() for c in run) and any(c.isalpha() for c in run)


def _score(kind: str, text: str, start: int, end: int) -> float:
    near = text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]
    score = START[kind]
    if RAISE[kind].search(near):
        score = min(1.0, score + 0.3)
    if kind in LOWER and LOWER[kind].search(near):
        score = max(0.0, score - 0.3)
    return score


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """``(kind, start, end, score)`` by start, then kind as listed; base kinds whatever their score."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        found += [("iban", a, b) for a, b in _ibans(text)]
        found += [("ssn", m.start(), m.end()) for m in _SSN.finditer(text)] if "-" in text else []
        phones = [(a, b) for k, a, b in found if k in ("phone", "card", "iban")]
        found += [("tel", m.start(), m.end()) for m in _TEL.finditer(text) if not any(a < m.end() and m.start() < b for a, b in phones)]
        found += [("secret", m.start(), m.end()) for m in _SECRET.finditer(text) if _is_secret(m[0])]
    scored = [(k, a, b, _score(k, text, a, b)) for k, a, b in found]
    return sorted((x for x in scored if x[0] in BASE or x[3] >= LEAST), key=lambda x: (x[1], KINDS.index(x[0])))


def joined(spans: list[tuple[str, int, int, float]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """Each span, or union of overlapping spans, becomes ``[KIND]`` of the one that starts first."""
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _spans_of(texts: pa.Array) -> pa.Array:
    return pa.array([[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find_spans(x.as_py())] for x in texts], _SPANS)


def _digest_of(texts: pa.Array) -> pa.Array:
    rows = []
    for x in texts:
        spans = find_spans(x.as_py())
        base = [s for s in spans if s[0] in BASE]
        count = {f"n_{k}": sum(s[0] == k for s in base) for k in BASE}
        rows.append({"spans": joined(spans), "n_spans": len(spans), "scores": ",".join(f"{s[3]:.1f}" for s in spans), "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest()} | count)
    return pa.array(rows, pa.struct([("spans", pa.string()), ("n_spans", pa.int64()), ("scores", pa.string()), ("base_sha256", pa.string()), *((f"n_{k}", pa.int64()) for k in BASE)]))


def _redacted(texts: pa.Array) -> pa.Array:
    return pa.array([t if (t := x.as_py()) is None else redact(t, find_spans(t)) for x in texts], pa.string())


def find_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``pii`` added: an array of (kind, start, end, score).

    Null and empty texts have an empty array; rows are kept one to one, repeated ones too; other
    columns pass through, one named ``pii`` is replaced. Time is linear in the text's length.
    """
    return without(df, "pii").withColumn("pii", F.arrow_udf(_spans_of, "array<struct<kind string, start bigint, end bigint, score double>>")(named(text)))


def redact_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every found span of ``text`` replaced by ``[KIND]``; null stays null, all else as it is."""
    return df.withColumn(text, F.arrow_udf(_redacted, "string")(named(text)))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    digest = F.arrow_udf(_digest_of, "struct<spans string, n_spans bigint, scores string, base_sha256 string, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint>")
    return docs.select("doc_id", digest("text").alias("d")).select("doc_id", *[F.col(f"d.{c}") for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "scores")])

"""Secrets in texts: keyword prefilter, anchored expressions near hits, checksum validation.

An Aho-Corasick automaton runs once over the lower-cased bytes of each whole text. Only where
it reports a keyword is an expression tried, anchored at that place. Runs of hexadecimal
digits have no keyword: the text is mapped to two classes, and the keyword is sixteen digits
in a row. Formats that carry a check of their own are reported only if it holds:
``github`` and ``npm`` tokens end in the CRC-32 of their body in base 62, the header of a
``jwt`` must decode to JSON that names an algorithm, and a ``pem`` block must decode from
base 64 to a DER sequence of the stated length.

A document is one row; there is no shuffle. Offsets count code points, ends are exclusive.

Defined results: a null or empty text has no secrets; repeated rows are scanned one by one;
extra columns pass through, one named ``secrets`` is replaced.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from themeweave.llm.columns import text_of, without

SPANS = "array<struct<kind:string,start:int,end:int>>"
#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")

# The formats looked for.
ASSIGN = re.compile(
    rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
PEM = re.compile(rb"-----BEGIN ([A-Z ]*)PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END \1PRIVATE KEY-----")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign",
    "api_key": "assign", "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github",
    "ghr_": "github", "npm_": "npm", "eyj": "jwt", "-----begin": "pem",
}
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16

_HEX_CLASS = bytes(0x78 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))
_HEX_KEYWORD = b"x" * MIN_HEX


def crc_base62(body: bytes) -> bytes:
    """CRC-32 in base 62, six digits."""
    left, digits = zlib.crc32(body), []
    for _ in range(6):
        left, digit = divmod(left, 62)
        digits.append(BASE62[digit])
    return "".join(reversed(digits)).encode()


def _crc_holds(match: re.Match) -> bool:
    return crc_base62(match[1]) == match[2]


def _jwt_holds(match: re.Match) -> bool:
    try:
        header = json.loads(base64.urlsafe_b64decode(match[1] + b"=" * (-len(match[1]) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and "alg" in header


def _pem_holds(match: re.Match) -> bool:
    try:
        der = base64.b64decode(b"".join(match[2].split()), validate=True)
    except binascii.Error:
        return False
    if len(der) < 2 or der[0] != 0x30:
        return False
    if der[1] < 0x80:
        return len(der) == 2 + der[1]
    width = der[1] & 0x7F
    return len(der) == 2 + width + int.from_bytes(der[2 : 2 + width], "big")


#: Expression and check of every kind that has keywords.
FORMATS = {
    "assign": (ASSIGN, lambda m: len(m[1]) >= MIN_ASSIGN),
    "access": (ACCESS, lambda m: m.end() - m.start() >= MIN_ACCESS),
    "github": (GITHUB, _crc_holds),
    "npm": (NPM, _crc_holds),
    "jwt": (JWT, _jwt_holds),
    "pem": (PEM, _pem_holds),
}


def build_automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        automaton.add_word(word, (len(word), kind))
    automaton.make_automaton()
    return automaton


def find_secrets(text: bytes, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in bytes, by start, then kind."""
    found = []
    used = dict.fromkeys(FORMATS, 0)
    hits = sorted((end + 1 - size, kind) for end, (size, kind) in automaton.iter(text.lower().decode("latin-1")))
    for start, kind in hits:
        if start < used[kind]:
            continue
        expression, holds = FORMATS[kind]
        if match := expression.match(text, start):
            used[kind] = match.end()
            if holds(match):
                found.append((kind, start, match.end()))
    classes = text.translate(_HEX_CLASS)
    start = classes.find(_HEX_KEYWORD)
    while start >= 0:
        end = HEX.match(text, start).end()
        found.append(("hex", start, end))
        start = classes.find(_HEX_KEYWORD, end)
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def in_code_points(text: bytes, spans: list[tuple[str, int, int]]) -> list[dict]:
    """The spans with offsets counted in code points."""
    points, at, done = {}, 0, 0
    for cut in sorted({x for _, start, end in spans for x in (start, end)}):
        at += len(text[done:cut].decode("utf-8", "replace"))
        points[cut] = at
        done = cut
    return [{"kind": kind, "start": points[start], "end": points[end]} for kind, start, end in spans]


def _secret_spans(texts: pd.Series) -> pd.Series:
    automaton = build_automaton()
    encoded = (text.encode("utf-8", "replace") for text in texts)
    return pd.Series([in_code_points(text, find_secrets(text, automaton)) for text in encoded], dtype=object)


def _redacted(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, found in zip(texts, spans, strict=True):
        pieces, at = [], 0
        for span in sorted(found, key=lambda s: (s["start"], -s["end"])):
            if span["start"] >= at:
                pieces += [text[at : span["start"]], f"[{span['kind']}]"]
            at = max(at, span["end"])
        out.append("".join(pieces) + text[at:])
    return pd.Series(out, dtype=object)


def _text_if_redacted(texts: pd.Series) -> pd.Series:
    spans = _secret_spans(texts)
    has = spans.map(len) > 0
    out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
    out[has] = _redacted(texts[has], spans[has.to_numpy()]).to_numpy()
    return out


def redact_secrets(docs: DataFrame, name: str) -> DataFrame:
    """Add column ``name``: the text with each secret replaced by its kind in brackets, null if there is none.

    Scan and replacement share one Python worker per task, and only changed texts come back.
    """
    return docs.withColumn(name, F.pandas_udf(_text_if_redacted, "string")(text_of()))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Add ``secrets: array<struct<kind, start, end>>``, by start, then kind."""
    return without(docs, "secrets").withColumn("secrets", F.pandas_udf(_secret_spans, SPANS)(text_of()))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; overlapping spans count as one."""
    return F.pandas_udf(_redacted, "string")(F.coalesce(text, F.lit("")), spans)

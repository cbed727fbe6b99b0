r"""Secret scans with structural confirmation.

Base kinds are patterns: ``assign`` (a key word, a separator and a value of six
or more characters; key words in either ASCII case), ``access`` (``AKIA`` and
20 or more characters in all) and ``hex`` (24 or more lower-case hex digits).
Each is matched leftmost and without overlaps, and short matches are dropped.

The method adds kinds that are reported only when their bytes decode and parse:
``jwt`` (base64url header and claims that are JSON objects, the header with
``alg``, of any length), ``der`` (base64, base64url or hex, the former two also
wrapped over lines, whose bytes are a private-key SEQUENCE with nested lengths
that all add up, the key inside PKCS#8 included), ``openssh`` (in the same
encodings: length-prefixed fields after the format's magic), and ``pem`` (an
armoured block, with or without header lines, whose body is one of the two; or
one whose headers say that it is encrypted, which leaves whole cipher blocks).

A null or empty text has no spans; offsets are code points, ends exclusive; long
texts are scanned whole; repeated rows each give a row; an empty table gives no
rows; other columns, whatever their names, are ignored or (``redact_secrets``)
kept. Spans are ordered by start, then by the order of ``KINDS``.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, id_and_text

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "jwt", "der", "openssh", "pem")
_ORDER = {k: i for i, k in enumerate(KINDS)}

# The key words of the assign pattern, lower case.
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{10,})\.([A-Za-z0-9_-]{2,})\.[A-Za-z0-9_-]*")
#: Runs of one alphabet; wrapped ones have lines of 16 characters or more but the last.
_B64 = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}[ \t]*\r?\n[ \t]*)+[A-Za-z0-9+/_-]+={0,2}")
_LINE = re.compile(r"[^\s]+")
_URL64 = re.compile(r"[A-Za-z0-9_-]{40,}={0,2}")
_HEXES = re.compile(r"[0-9A-Fa-f]{64,}")
_PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----\s*?((?:\n[A-Za-z][A-Za-z0-9-]*:[^\n]*(?:\n[ \t][^\n]*)*)*)([A-Za-z0-9+/=\s]+)-----END (?:[A-Z]+ )*PRIVATE KEY-----")
_LONG = 24


def _json_object(part: str) -> dict | None:
    try:
        got = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (binascii.Error, ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def _tlv(data: bytes, at: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the DER value at ``at``; None if its length doesn't fit."""
    if at + 2 > len(data):
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n >= 0x80:
        width = n & 0x7F
        if not 1 <= width <= 4 or at + width > len(data) or data[at] == 0:
            return None
        n, at = int.from_bytes(data[at : at + width], "big"), at + width
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= len(data) else None


def _children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while start < end:
        if not (got := _tlv(data, start)) or got[2] > end:
            return None
        out.append(got)
        start = got[2]
    return out


# DER object identifiers of RSA, RSA-PSS and elliptic-curve keys.
_RSA = {bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a864886f70d01010a")}
_EC = bytes.fromhex("2a8648ce3d0201")
_DEEPEST = 16


def _nests(data: bytes, start: int, end: int, depth: int = 0) -> bool:
    """Whether the range is DER values whose lengths, and those within them, all add up."""
    kids = _children(data, start, end) if depth < _DEEPEST else None
    return kids is not None and all(not k[0] & 0x20 or _nests(data, k[1], k[2], depth + 1) for k in kids)


def _is_plain_key(data: bytes, kids: list[tuple[int, int, int]], kind: str) -> bool:
    """Whether the children of a SEQUENCE are a PKCS#1 (``rsa``) or SEC1 (``ec``) private key."""
    if len(kids) < 2 or kids[0][0] != 0x02 or kids[0][2] - kids[0][1] != 1:
        return False
    tags, version = [k[0] for k in kids], data[kids[0][1]]
    if kind == "ec":
        return version == 1 and tags[1] == 0x04 and kids[1][2] - kids[1][1] >= 16
    return version <= 1 and len(tags) >= 9 and all(t == 0x02 for t in tags[:9])


def _is_inner_key(data: bytes, algorithm: bytes, start: int, end: int) -> bool:
    """Whether PKCS#8's octets are the algorithm's key: a whole SEQUENCE for RSA and curves, one whole value for others."""
    top = _children(data, start, end)
    if not top or len(top) != 1:
        return False
    if algorithm in _RSA or algorithm == _EC:
        kids = _children(data, top[0][1], top[0][2]) if top[0][0] == 0x30 else None
        return bool(kids) and _nests(data, start, end) and _is_plain_key(data, kids, "ec" if algorithm == _EC else "rsa")
    return top[0][2] > top[0][1] and _nests(data, start, end)


def is_der_key(data: bytes) -> bool:
    """Whether the bytes are one PKCS#1, PKCS#8 (plain or encrypted), SEC1 or DSA private key, all lengths nested exactly at every level."""
    top = _tlv(data, 0)
    if not top or top[0] != 0x30 or top[2] != len(data):
        return False
    kids = _children(data, top[1], top[2])
    if not kids or len(kids) < 2 or not _nests(data, top[1], top[2]):
        return False
    tags, size = [k[0] for k in kids], kids[1][2] - kids[1][1]
    if tags == [0x30, 0x04]:
        # EncryptedPrivateKeyInfo: an algorithm with parameters (none of them names a digest, as DigestInfo does), then whole cipher blocks.
        algorithm = _children(data, kids[0][1], kids[0][2])
        return [k[0] for k in algorithm] == [0x06, 0x30] and size >= 16 and size % 8 == 0
    if tags[0] != 0x02 or kids[0][2] - kids[0][1] != 1:
        return False
    version = data[kids[0][1]]
    if tags[1] == 0x30 and len(kids) >= 3 and tags[2] == 0x04:
        algorithm = _children(data, kids[1][1], kids[1][2])
        return version <= 1 and bool(algorithm) and algorithm[0][0] == 0x06 and _is_inner_key(data, data[algorithm[0][1] : algorithm[0][2]], kids[2][1], kids[2][2])
    if len(tags) == 6 and all(t == 0x02 for t in tags):
        # DSA: version 0, p, q, g, y, x; q is a short prime, and the others are no longer than p.
        p, q, g, y, x = (k[2] - k[1] for k in kids[1:])
        return version == 0 and p >= 64 and 20 <= q <= 33 and g <= p and y <= p and x <= q
    return _is_plain_key(data, kids, "ec" if tags[1] == 0x04 else "rsa")


def is_openssh_key(data: bytes) -> bool:
    """Whether the bytes are an OpenSSH private key: magic, three strings and a key count."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)
    for _ in range(3):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 64


def key_kind(data: bytes) -> str | None:
    return "der" if is_der_key(data) else "openssh" if is_openssh_key(data) else None


_URL_SIGNS = str.maketrans("-_", "+/")


def _is_encrypted_body(headers: str, data: bytes) -> bool:
    """Whether armour headers say that the body is encrypted, and it is whole cipher blocks."""
    return "ENCRYPTED" in headers and "DEK-Info:" in headers and len(data) >= 48 and len(data) % 8 == 0


def _from_base64(part: str) -> bytes:
    body = part.rstrip("=")
    body = body[: len(body) - (len(body) % 4 == 1)]
    try:
        return base64.b64decode(body.translate(_URL_SIGNS) + "=" * (-len(body) % 4))
    except binascii.Error:
        return b""


def _wrapped(run: re.Match) -> list[tuple[str, int, int]]:
    """The keys in lines of base64: lines as long as the first, and a shorter one or none."""
    lines = [(x[0], x.start() + run.start(), x.end() + run.start()) for x in _LINE.finditer(run[0])]
    out, at = [], 0
    while at < len(lines) - 1:
        after = at + 1
        if lines[at][0].startswith(("M", "b3Blbn")):
            end = at + 1
            while end < len(lines) and len(lines[end][0]) == len(lines[at][0]):
                end += 1
            for stop in (end + 1, end):
                if at + 1 < stop <= len(lines) and (kind := key_kind(_from_base64("".join(x for x, _, _ in lines[at:stop])))):
                    out.append((kind, lines[at][1], lines[stop - 1][2]))
                    after = stop
                    break
        at = after
    return out


def scan(text: str) -> list[tuple[str, int, int]]:
    """All confirmed spans (kind, start, end) of a text, ordered."""
    found: list[tuple[str, int, int]] = []
    lower = text.lower()
    if any(w in lower for w in _WORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # A signed token has two dots, and no least length.
    if text.count(".") > 1:
        for m in _JWT.finditer(text):
            header = _json_object(m[1])
            if header is not None and "alg" in header and _json_object(m[2]) is not None:
                found.append(("jwt", *m.span()))
    # Lines of wrapped base64 are 16 signs or more, any other run lies within a longer blank-free word.
    longest = max(map(len, text.split()), default=0)
    if longest >= 16:
        for m in _WRAPPED.finditer(text):
            found += _wrapped(m)
    if longest >= _LONG:
        found += [("hex", *m.span()) for m in _HEX.finditer(text) if m.end() - m.start() >= _LONG]
        for m in _B64.finditer(text):
            if kind := key_kind(_from_base64(m[0])):
                found.append((kind, *m.span()))
        for m in _URL64.finditer(text):
            if ("-" in m[0] or "_" in m[0]) and (kind := key_kind(_from_base64(m[0]))):
                found.append((kind, *m.span()))
        for m in _HEXES.finditer(text):
            body = m[0][: len(m[0]) // 2 * 2]
            if kind := key_kind(bytes.fromhex(body)):
                found.append((kind, m.start(), m.start() + len(body)))
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            data = _from_base64("".join(m[2].split()))
            if key_kind(data) or _is_encrypted_body(m[1], data):
                found.append(("pem", *m.span()))
    return sorted(found, key=lambda x: (x[1], _ORDER[x[0]], x[2]))


def redact(text: str, spans: list[tuple[str, int, int]], mask: str = "[SECRET]") -> str:
    """The text with every maximal covered range replaced by ``mask``."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda x: x[1:]):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPANS_PA = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, spans: the ordered spans of each whole text."""

    def run(batches):
        for b in batches:
            spans = [[dict(zip(("kind", "start", "end"), s)) for s in scan(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, _SPANS_PA)], ["doc_id", "spans"])

    kept = id_and_text(docs)
    return kept.mapInArrow(bounded(run), f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, spans {_SPANS}")


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, with every secret of ``text`` masked and ``n_chars`` recounted if there.

    Null texts stay null. Rows without secrets are returned as they were.
    """
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = [t if t is None else redact(t, s, mask) if (s := scan(t)) else t for t in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    out = docs.mapInArrow(bounded(run), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out


def report(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as a string."""
    joined = lambda kept: F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )

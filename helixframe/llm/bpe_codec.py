"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Texts longer than ``SPLIT_CHARS`` are cut at safe boundaries, so the pattern
engine never sees an unbounded string and the ids stay those of the whole text:

* before a blank that follows a printable ASCII character: every match of the
  pattern that holds the character ends there, and the next starts at the blank;
* around very long runs of white space: the pattern's look-ahead gives all but
  the last of them one match, which is encoded without the pattern.

Nulls and empty texts encode to no ids and decode to no bytes; repeated rows
each give a row; other columns are ignored. A text without any boundary is one
piece, which tiktoken still merges in n log n.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, id_and_text

SPLIT_CHARS = 20_000
LONG_BLANKS = 4_096
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANKS = re.compile(f"[{_WHITE}]{{{LONG_BLANKS},}}")
_SAFE = re.compile(r"(?<=[!-~])(?= )")


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, loaded once per Python worker."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, limit: int = SPLIT_CHARS) -> Iterator[tuple[str, bool]]:
    """Cut ``text`` at safe boundaries; True marks a run to encode without the pattern."""
    begin = 0
    if len(text) >= LONG_BLANKS:
        for run in _BLANKS.finditer(text):
            start, end = run.span()
            end -= end < len(text)
            yield from ((p, False) for p in _plain(text[begin:start], limit))
            yield text[start:end], True
            begin = end
    yield from ((p, False) for p in _plain(text[begin:], limit))


def _plain(text: str, limit: int) -> Iterator[str]:
    at = 0
    while len(text) - at > limit and (cut := _SAFE.search(text, at + limit)):
        yield text[at : cut.start()]
        at = cut.start()
    if at < len(text):
        yield text[at:] if at else text


def encode_text(enc: tiktoken.Encoding, text: str, limit: int = SPLIT_CHARS) -> np.ndarray:
    """The ids of a whole text as little-endian unsigned 32-bit integers."""
    if len(text) <= min(limit, LONG_BLANKS):
        return np.asarray(enc.encode_ordinary(text), "<u4")
    parts = [enc._encode_single_piece(p) if raw else enc.encode_ordinary(p) for p, raw in pieces(text, limit)]
    return np.concatenate([np.asarray(p, "<u4") for p in parts]) if parts else np.empty(0, "<u4")


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids: the packed little-endian unsigned 32-bit ids of each whole text."""

    def run(batches):
        enc = encoding(ranks_path, pattern)
        for b in batches:
            ids = [encode_text(enc, t).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    kept = id_and_text(docs)
    return kept.mapInArrow(bounded(run), f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids, bytes: the raw bytes that the packed ids stand for."""

    def run(batches):
        enc = encoding(ranks_path, pattern)
        for b in batches:
            raw = [enc.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], ["doc_id", "ids", "bytes"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(bounded(run), f"doc_id {kind}, ids binary, bytes binary")


def digests(decoded: DataFrame) -> DataFrame:
    """The round trip of :func:`encode` and :func:`decode` as counts and digests."""
    return decoded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )

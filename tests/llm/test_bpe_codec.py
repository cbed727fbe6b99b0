import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import bpe_codec as B
from helixframe.llm.queries import BYTE_RANKS, op8_byte_bpe

from .conftest import SF

ENC = B.encoding(BYTE_RANKS, public_tokenizers.PATTERN)
PIECES = st.lists(st.sampled_from(["a", "the ", "  ", "\n", "é", "'s", " 12", "!?", "\t", "　", "\x1c", "日本", " x", "\xa0"]), max_size=120).map("".join)


@settings(max_examples=150, deadline=None)
@given(PIECES, st.integers(1, 20))
def test_splitting_changes_nothing(text, limit):
    assert "".join(p for p, _ in B.pieces(text, limit)) == text
    parts = [i for p, raw in B.pieces(text, limit) for i in (ENC._encode_single_piece(p) if raw else ENC.encode_ordinary(p))]
    assert parts == ENC.encode_ordinary(text)


def test_long_runs_of_blanks(monkeypatch):
    import re

    monkeypatch.setattr(B, "LONG_BLANKS", 8)
    monkeypatch.setattr(B, "_BLANKS", re.compile(f"[{B._WHITE}]{{8,}}"))
    for text in (" " * 30, "a" + " " * 30, "a" + " " * 30 + "b", " " * 30 + "\n" + "b c" + "\n" * 9 + "d", "x" + "\t" * 20 + "y z" * 9):
        assert B.encode_text(ENC, text, 5).tolist() == ENC.encode_ordinary(text)


def test_query(spark, table):
    got = {r.doc_id: r for r in op8_byte_bpe(spark, SF).collect()}
    assert len(got) == len(table[1])
    for i, text in table[1]:
        ids = ENC.encode_ordinary(text)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_awkward_rows(docs, no_docs, rows):
    coded = B.decode(B.encode(docs, BYTE_RANKS, public_tokenizers.PATTERN), BYTE_RANKS, public_tokenizers.PATTERN)
    got = coded.collect()
    assert sorted(bytes(r.bytes) for r in got) == sorted((r[1] or "").encode() for r in rows)
    assert B.encode(no_docs, BYTE_RANKS, public_tokenizers.PATTERN).count() == 0
    assert {r.n_tokens for r in B.digests(coded).collect() if r.doc_id in (0, 3)} == {0}

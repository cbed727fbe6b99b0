import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helixframe.llm import packing as K
from helixframe.llm import word_tokens
from helixframe.llm.queries import WORD_TOKENIZER, op4_packing
from helixframe.llm.word_tokens import Tokens

from .conftest import SF

TOKENS = Tokens(WORD_TOKENIZER)
PLAIN = Tokenizer.from_file(WORD_TOKENIZER)
PARTS = st.lists(st.sampled_from(["a", "It", "'s", "'", "''s", "'RE", "'vex", "don't", " ", "\n", "12", "é", "ÀÉÞß", "×", "÷", "!", "\"'ll", "ñ", "日", "é", "<|endoftext|>", "<|", "<|ENDOFTEXT|>", "<|startoftext|>", "\xa0", "\x1c", "_", "'d'm", "I'M"]), max_size=14).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(PARTS, max_size=5))
def test_ids_are_the_tokenizers(texts):
    ids, at = TOKENS.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_small_memory_of_words_changes_no_ids(monkeypatch):
    monkeypatch.setattr(word_tokens, "REMEMBERED", 4)
    known, most = Tokens(WORD_TOKENIZER), 0
    for i in range(20):
        texts = [f"word{chr(97 + i)} antidisestablishmentarianism it's", f"{chr(97 + i)}b again", ""]
        ids, at = known.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]
        assert (np.diff(known.keys.astype(object)) > 0).all()
        most = max(most, len(known.keys))
    assert most <= 8


def test_special_tokens_in_a_text_have_their_own_ids():
    ids, _ = TOKENS.encode(pa.array(["a <|endoftext|> b", "plain"]))
    assert ids.tolist() == [320, 49407, 321, *PLAIN.encode("plain", add_special_tokens=False).ids]


def check(pieces, texts, repeats=False):
    """Every id in one piece, gapless sequences, little padding."""
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {i for i, _ in texts}
    if not repeats:
        for i, text in texts:
            ids, at = np.array(PLAIN.encode(text or "", add_special_tokens=False).ids + [1], "<u4"), 0
            for r in sorted(by_doc[i], key=lambda r: r.start):
                assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
                at += r.length
            assert at == len(ids)
    total = 0
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= K.LENGTH and at & (at - 1) == 0
        total += at
    return total


def test_query(spark, table):
    check(op4_packing(spark, SF).collect(), table[1])


def test_awkward_rows(docs, no_docs, rows):
    got = K.digest(K.pack(docs, WORD_TOKENIZER)).collect()
    total = check(got, [r[:2] for r in rows], repeats=True)
    assert total == sum(len(PLAIN.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert K.pack(no_docs, WORD_TOKENIZER).count() == 0


def test_neighbours_share_terms():
    rng = np.random.default_rng(0)
    pieces = [np.concatenate([rng.integers(0, 300, 40), rng.integers(1000 * (1 + k % 3), 1000 * (1 + k % 3) + 30, 60)]).astype("<u4") for k in range(30)]
    index = K.Index(pieces)
    scores = index.scores(4)
    scores[4] = 0
    assert {int(i) % 3 for i in np.argsort(-scores)[:9]} == {1}
    n, df = 30, sum(1 for p in pieces if pieces[4][50] in p)
    assert df < n / 2
    first = K.arrange([len(p) for p in pieces], index, 500)[0]
    assert [i for i, _, _ in first][0] == 0 and {i % 3 for i, _, _ in first} == {0}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=40))
def test_arrangement_is_gapless(sizes):
    rng = np.random.default_rng(1)
    pieces = [rng.integers(0, 50, n) for n in sizes]
    sequences = K.arrange(sizes, K.Index(pieces), 64)
    assert all(sum(e - b for _, b, e in s) == 64 for s in sequences[:-1])
    cut = K.powers_of_two(sequences[-1]) if sequences else []
    seen = sorted((i, b, e) for s in [*sequences[:-1], *cut] for i, b, e in s)
    covered = {i: [] for i in range(len(sizes))}
    for i, b, e in seen:
        covered[i] += range(b, e)
    assert all(covered[i] == list(range(n)) for i, n in enumerate(sizes))


def bm25(pieces):
    """Each piece's score of each other by the textbook formula."""
    n, mean = len(pieces), sum(map(len, pieces)) / len(pieces)
    df = Counter(t for p in pieces for t in set(p))
    idf = {t: math.log((n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
    out = np.zeros((n, n))
    for i, a in enumerate(pieces):
        for j, b in enumerate(pieces):
            tf = Counter(b)
            for t in set(a):
                if idf[t] > 0 and df[t] > 1 and tf[t]:
                    out[i, j] += idf[t] * tf[t] * (K.K1 + 1) / (tf[t] + K.K1 * (1 - K.B + K.B * len(b) / mean))
    return out


def greedy(pieces, length):
    """Windows filled by each seed's best unused neighbours, the cut one being the next seed."""
    scores, used, out, rest = bm25(pieces), set(), [], None
    while rest or len(used) < len(pieces):
        if rest is None:
            seed = min(i for i in range(len(pieces)) if i not in used)
            used.add(seed)
            rest = (seed, 0)
        i, begin = rest
        window, room, rest = [(i, begin, len(pieces[i]))], length - len(pieces[i]) + begin, None
        for j in sorted((j for j in range(len(pieces)) if j not in used), key=lambda j: (-round(scores[i, j], 9), j)):
            if room == 0:
                break
            take = min(room, len(pieces[j]))
            used.add(j)
            window.append((j, 0, take))
            room -= take
            if take < len(pieces[j]):
                rest = (j, take)
        out.append(window)
    return out


def test_packing_equals_brute_force():
    """The choice of neighbours, on one shard of random pieces with few ties."""
    rng = np.random.default_rng(3)
    pieces = [rng.zipf(1.3, int(n)).clip(1, 400).astype("<u4") for n in rng.integers(5, 90, 40)]
    known = bm25([p.tolist() for p in pieces])
    index = K.Index(pieces)
    for i in range(len(pieces)):
        assert np.allclose(index.scores(i), known[i])
    assert K.arrange([len(p) for p in pieces], index, 128) == greedy([p.tolist() for p in pieces], 128)


def test_whole_operator_equals_brute_force(spark):
    """One range and one shard, whatever order the rows come in: tokens, statistics, order of signatures, neighbours, cuts."""
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    texts = [" ".join(rng.choice(words[k % 3 * 100 : k % 3 * 100 + 100], int(rng.integers(5, 60)))) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = K.pack(docs, WORD_TOKENIZER, length=256).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    ids = [np.array(PLAIN.encode(t, add_special_tokens=False).ids + [1], "<u4") for t in texts]
    tails = [x[len(x) // 256 * 256 :] for x in ids]
    df = np.zeros(TOKENS.size, np.int64)
    for t in tails:
        df[np.unique(t)] += 1
    costs = K.sample_costs(K.idf_of(df, sum(len(t) > 0 for t in tails)))
    sign = lambda t: [int(np.uint32(c[t].min() & np.uint64(0xFFFFFFFF)).view(np.int32)) for c in costs]
    order = [i for i in sorted(range(60), key=lambda i: (sign(tails[i]), i)) if len(tails[i])]
    windows = greedy([tails[i].tolist() for i in order], 256)
    if sum(e - b for _, b, e in windows[-1]) < 256:
        windows += K.powers_of_two(windows.pop())
    want = []
    for window in windows:
        want.append([(order[j], len(ids[order[j]]) - len(tails[order[j]]) + b, e - b) for j, b, e in window])
    made = {}
    for r in got:
        if r.start + r.length > len(ids[r.doc_id]) // 256 * 256:
            made.setdefault(r.sequence_id, []).append((r.offset, (r.doc_id, r.start, r.length)))
    assert [[x for _, x in sorted(made[s])] for s in sorted(made)] == want


def test_neighbours_meet_in_a_range(spark):
    """Documents of a rare common vocabulary fall into few shards of a table of many."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 7))
    topics = [[word() for _ in range(30)] for _ in range(40)]
    shared = [word() for _ in range(200)]
    texts = [" ".join([*rng.choice(topics[i % 40], 30), *rng.choice(shared, 30)]) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    by_sequence = {}
    for r in K.pack(docs, WORD_TOKENIZER, shard_tokens=8_000).collect():
        by_sequence.setdefault(r.sequence_id, set()).add(r.doc_id)
    pairs = [(a, b) for s in by_sequence.values() for a in s for b in s if a < b]
    assert sum(a % 40 == b % 40 for a, b in pairs) > 5 * len(pairs) / 40


def test_hot_signature_is_split(spark):
    """Copies of one text, and rows without an id, are dealt over the ranges."""
    docs = spark.range(3000).selectExpr("if(id % 5 = 0, null, id) as doc_id", "'one text that very many rows hold in this table' as text").repartition(3)
    got = K.pack(docs, WORD_TOKENIZER).collect()
    ranges = Counter(r.sequence_id >> 32 for r in got)
    assert len(ranges) == 4 and max(ranges.values()) < 0.6 * len(got)
    assert sum(r.length for r in got) == 3000 * (len(PLAIN.encode("one text that very many rows hold in this table", add_special_tokens=False).ids) + 1)

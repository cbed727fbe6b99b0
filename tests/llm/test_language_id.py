import zlib

import numpy as np
import pytest

from helixframe.llm import language_id as L
from helixframe.llm.queries import op1_language_id

from .conftest import SF


def phrases(text, sample):
    """Greedy longest phrases of a block-wise parse, by substring search."""
    count = 0
    for b in range(0, len(text), L.BLOCK):
        part, at = text[b : b + L.BLOCK], 0
        while at < len(part):
            n = 1
            while at + n < len(part) and part[at : at + n + 1] in sample:
                n += 1
            at, count = at + n, count + 1
    return count


def test_phrases_equal_substring_search():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abc d"), n)) for n in (5, 300, 2500, 40)]
    model = (("a", "".join(rng.choice(list("abc "), 400))), ("b", "".join(rng.choice(list("bcd "), 300))))
    p = L.Parser(model)
    letters = lambda s: "".join(map(chr, p.symbols(s) + 65))
    got = p.phrases([p.symbols(t) for t in texts])
    for t, row in zip(texts, got):
        assert row.tolist() == [phrases(letters(t), letters(s)) for _, s in model]


def test_automaton_accepts_substrings_only():
    nexts, _ = L.automaton([ord(c) for c in "abracadabra"])

    def accepts(s):
        state = 0
        for c in s:
            state = nexts[state].get(ord(c), -1)
            if state < 0:
                return False
        return True

    word = "abracadabra"
    assert all(accepts(word[i:j]) for i in range(11) for j in range(i, 12))
    assert not accepts("abd") and not accepts("rr")


def test_query_predicts_held_out_documents(spark, table):
    docs, _ = table
    got = {r.doc_id: r for r in op1_language_id(spark, SF).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert set(got) == set(truth)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [i for i in got if got[i].held_out]
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.95 * len(held)


def test_query_equals_brute_force(spark, table):
    """Labels and entropies of the whole query, by substring search, for all texts up to 1,200 letters."""
    docs, rows = table
    model = L.learn(docs)
    p = L.Parser(model)
    letters = lambda s: "".join(chr(65 + x) for x in p.symbols(s))
    samples = [letters(text) for _, text in model]
    got, seen = {r.doc_id: r for r in op1_language_id(spark, SF).collect()}, 0
    for i, text in rows:
        s = letters(text or "")
        if not 0 < len(s) <= 1200 or not set(s) - {"A"}:
            continue
        h = [phrases(s, x) * np.log2(len(x)) / len(s) for x in samples]
        best = int(np.argmin(h))
        assert got[i].lang_pred == model[best][0] and abs(got[i].bits - h[best]) < 1e-9
        seen += 1
    assert seen > 20


def test_awkward_rows(spark, docs, no_docs, rows):
    model = L.learn(docs)
    assert [m[0] for m in model] == ["en"]
    got = L.identify(docs, model).collect()
    assert len(got) == len(rows)
    empty = {r.lang_pred for r in got if r.doc_id in (0, 3, 6, 57)}
    assert empty == {"und"} and all(r.score == 1.0 for r in got if r.lang_pred == "en")
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert L.identify(no_docs, model).count() == 0
    assert L.learn(no_docs) == () and {r.lang_pred for r in L.identify(docs, ()).collect()} == {"und"}
    kept = L.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.filter("lang is null").count() == 0
    assert kept.count() == sum(r.lang_pred != "und" for r in got)


def test_never_learns_from_held_out_or_unlabelled(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = spark.createDataFrame([(i, "zzz yyy", "xx") for i in held] + [(1000, "abc", None)], "doc_id int, text string, lang string")
    assert L.learn(docs) == ()


def test_sample_is_bounded(spark):
    docs = spark.range(3000).selectExpr("id * 4 as doc_id", "concat('text ', cast(id as string), repeat(' und so weiter', 200)) as text", "if(id % 2 = 0, 'a', 'b') as lang")
    model = L.learn(docs, sample_chars=5_000)
    assert [m[0] for m in model] == ["a", "b"] and all(len(m[1]) <= 5_000 for m in model)
    assert L.learn(docs, sample_chars=5_000) == model
    many = spark.range(2000).selectExpr("id * 4 as doc_id", "concat('text ', cast(id as string), repeat(' und so weiter', 90)) as text", "concat('l', cast(id % 100 as string)) as lang")
    model = L.learn(many, table_bytes=1 << 20)
    assert len(model) == 100 and all(0 < len(m[1]) <= L.EXCERPT for m in model)


def test_rows_labelled_undetermined_are_not_lost(spark):
    docs = spark.createDataFrame([(4 * i, "the words of a text " * 9, "und" if i % 2 else "en") for i in range(20)] + [(999, "12 34", "und")], "doc_id bigint, text string, lang string")
    model = L.learn(docs)
    assert [m[0] for m in model] == ["en"]
    kept = L.keep_identified(docs, model)
    assert kept.count() == 20 and kept.filter("lang = 'und'").count() == docs.filter("lang = 'und' and doc_id != 999").count()


def test_score_needs_two_languages():
    p = L.Parser((("de", "der die das und"), ("en", "the and of")))
    labels, scores, bits = p.predict(["der und das", "the of and", "", None, "!!"])
    assert labels == ["de", "en", "und", "und", "und"] and scores[2:] == [0, 0, 0] and bits[0] > 0
    with pytest.raises(IndexError):
        _ = L.Parser(()).roots[0]


def test_two_languages_in_each_of_two_scripts():
    """Beside long Latin samples, languages that differ in the letters of a rarer script alone."""
    import random

    rng = random.Random(5)

    def text(letters, n, favoured):
        words = ["".join(rng.choice(favoured if rng.random() < 0.7 else letters) for _ in range(5)) for _ in range(n)]
        return " ".join(words)

    scripts = {"latin": "abcdefghijklmnopqrstuvwxyzáéíóúñüßçèêà", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
    kinds = {f"{s}{k}": (x, x[k::2]) for s, x in scripts.items() for k in (0, 1)}
    model = tuple((name, text(x, 3000 if name.startswith("latin") else 400, f)) for name, (x, f) in sorted(kinds.items()))
    wanted, texts = zip(*[(name, text(x, 60, f)) for name, (x, f) in kinds.items() for _ in range(20)])
    labels, _, _ = L.Parser(model).predict(list(texts))
    assert sum(a == b for a, b in zip(labels, wanted)) >= 118

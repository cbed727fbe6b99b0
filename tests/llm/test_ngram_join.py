import re
from collections import defaultdict

import pytest

from helixframe.llm import ngram_join as J
from helixframe.llm.components import components
from helixframe.llm.queries import op10_ngram_join

from .conftest import SF, prose

FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets, key=lambda i: (i is not None, i))
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    rank = {i: k for k, i in enumerate(ids)}
    holders = defaultdict(list)
    for i in ids:
        for s in sets[i]:
            holders[s].append(i)
    for i in ids:
        shared = defaultdict(int)
        for s in sets[i]:
            for j in holders[s]:
                shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)), key=rank.get)
                parent[b] = a
    return sorted(((i, len(sets[i]), root(i)) for i, _ in rows), key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_query(spark, table):
    assert rows_of(op10_ngram_join(spark, SF)) == brute(table[1])


@pytest.mark.parametrize("block", [3_000, 1 << 22])
def test_awkward_rows(docs, no_docs, rows, block):
    assert rows_of(J.near_duplicate_classes(docs, block)) == brute([r[:2] for r in rows])
    assert J.near_duplicate_classes(no_docs, block).count() == 0


def test_near_copies_chains_and_threshold(spark):
    """A base with many edited copies, chains of small edits, and pairs just at and below the threshold."""
    import random

    rng, rows = random.Random(3), []
    base = prose(11, 140).split()
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"edit{rng.random()}"
        rows.append((1000 - i, " ".join(w)))
    chain = prose(12, 120).split()
    for i in range(20):
        chain[(i * 6) % 120] = f"step{i}"
        rows.append((2000 + i, " ".join(chain)))
    for n in range(20, 60):
        words = prose(100 + n, n).split()
        for cut in (4, 5, 6, 7):
            rows += [(3000 + n * 10 + cut, " ".join(words[cut:])), (5000 + n, " ".join(words))][: 1 + (cut == 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert rows_of(J.near_duplicate_classes(docs, 20_000)) == brute(rows)


def test_one_row_of_each_class_stays(docs, rows):
    kept = J.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    want = {c for _, _, c in brute([r[:2] for r in rows])}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)


def test_different_texts_under_one_id_stay(spark):
    """Rows of a null or repeated id are judged by their texts: clean ones stay, near copies go."""
    base = prose(70, 120).split()
    near = " ".join(base[:60] + ["changed"] + base[61:])
    rows = [(None, prose(30 + i, 60)) for i in range(12)] + [(7, prose(50 + i, 60)) for i in range(12)]
    rows += [(None, " ".join(base)), (None, near), (7, near), (9, " ".join(base)), (3, prose(80, 60)), (7, prose(80, 60)), (7, prose(50, 60)), (None, prose(30, 60))]
    docs = spark.createDataFrame([(i, t, str(k)) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, lang string").repartition(3)
    kept = [(r.doc_id, r.text) for r in J.keep_one_of_each(docs).collect()]
    clean = {(i, t) for i, t in rows[:24]} | {(3, prose(80, 60))}
    assert len(kept) == 26 and clean <= set(kept)
    (other,) = set(kept) - clean
    assert other[0] is None and other[1] in (" ".join(base), near)


def test_awkward_names_and_repeated_rows(spark):
    text = prose(90, 80)
    rows = [(1, text, 1, 2, 3, 4), (1, text, 1, 2, 3, 5), (1, text, 1, 2, 3, 4), (2, prose(91, 60), 1, 2, 3, 4), (2, prose(91, 60), 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __kept int, `a.b` int, `c``d` int, id int")
    kept = [J.keep_one_of_each(d) for d in (docs, docs.repartition(5))]
    assert kept[0].columns == docs.columns
    first, second = (sorted(map(tuple, k.collect())) for k in kept)
    assert first == second and [r[0] for r in first] == [1, 2]


def test_a_token_that_many_groups_share(spark, monkeypatch):
    """Texts that share their rarest shingles but little else, dealt over parts."""
    monkeypatch.setattr(J, "_TOGETHER", 3)
    rows, common = [], prose(60, 30).split()
    for i in range(40):
        own = prose(700 + i // 2, 12 + i % 2).split()
        rows.append((i, " ".join(common + own)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert rows_of(J.near_duplicate_classes(docs, 2_000)) == brute(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200), (200, 300), (160, 159)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 161)}, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0

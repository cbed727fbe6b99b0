import re

import numpy as np
import pyarrow as pa
import pytest

from helixframe.llm import license_scan as C
from helixframe.llm.license_templates import TEMPLATES
from helixframe.llm.queries import op5_license_scan

from .conftest import SF, prose

KNOWN = tuple(TEMPLATES.items())
LINES = {TEMPLATES[k]: k for k in ("MIT-line", "GPL-3.0-line", "Apache-2.0-line", "CC-BY-NC-4.0-line", "all-rights-reserved")}


def scan(*texts):
    return C.scan_batch(pa.array(texts, pa.string()), KNOWN)


def test_query_finds_every_line_and_no_other(spark, table):
    got = {r.doc_id: r for r in op5_license_scan(spark, SF).collect()}
    assert len(got) == len(table[1])
    for i, text in table[1]:
        want = sorted((p, k) for line, k in LINES.items() for p in range(len(text)) if text.startswith(line, p))
        spans = [s.split(":") for s in got[i].spans.split(",") if s]
        assert [(int(s[1]), s[0]) for s in spans] == want


def test_query_finds_the_license_lines_of_the_documents(spark, table):
    """The lines are taken from the documents: short ones that speak of a license or rights."""
    got = {r.doc_id: r.spans for r in op5_license_scan(spark, SF).collect()}
    lines = {x for _, text in table[1] for x in (text or "").split("\n") if len(x) < 120 and re.search(r"(?i)licen[sc]e|rights reserved", x)}
    assert "Released under the MIT License." in lines
    for i, text in table[1]:
        want = sorted(p for line in lines for p in range(len(text or "")) if text.startswith(line, p))
        assert [int(s.split(":")[1]) for s in got[i].split(",") if s] == want


def test_whole_and_edited_texts():
    for name, text in KNOWN:
        found = scan("é ü " + prose(1, 50) + " " + text + " " + prose(2, 50))[0]
        assert [(f["license"], f["coverage"]) for f in found] == [(name, 1.0)]
        assert found[0]["start"] == len("é ü " + prose(1, 50)) + 1 + (0 if text[0].isalnum() else 1)
    words = TEMPLATES["MIT"].split()
    edited = " ".join(["extra"] + [w for i, w in enumerate(words) if i % 17] + ["more"])
    found = scan(edited)[0]
    assert found[0]["license"] == "MIT" and 0.9 < found[0]["coverage"] < 1
    assert scan(" ".join(words[: len(words) // 2])) == [[]]


def test_two_copies_and_overlaps():
    text = TEMPLATES["Apache-2.0"] + " " + prose(3, 300) + " " + TEMPLATES["Apache-2.0"].upper()
    assert [f["license"] for f in scan(text)[0]] == ["Apache-2.0", "Apache-2.0"]


def test_notices_that_repeat_within_the_band():
    line = TEMPLATES["all-rights-reserved"]
    assert [(f["start"], f["coverage"]) for f in scan(" ".join([line] * 3))[0]] == [(0, 1.0), (21, 1.0), (42, 1.0)]
    for k in ("CC-BY-NC-4.0-line", "Apache-2.0-line", "MIT-line"):
        assert [f["license"] for f in scan("\n".join([TEMPLATES[k]] * 4))[0]] == [k] * 4


def test_one_long_insertion_or_deletion_near_the_middle():
    for k in ("GPL-3.0", "Apache-2.0", "MIT", "BSD"):
        words = TEMPLATES[k].split()
        half = len(words) // 2
        for n in (9, 12, 20):
            text = " ".join(words[:half] + prose(n, n).split() + words[half:])
            assert [(f["license"], f["start"], f["coverage"] >= 0.9) for f in scan(text)[0]] == [(k, 0, True)]
    words = TEMPLATES["MIT"].split()
    text = " ".join(words[:50] + words[62:])
    assert [(f["license"], f["start"]) for f in scan(text)[0]] == [("MIT", 0)] and scan(text)[0][0]["coverage"] > 0.85


def test_winnowing_covers_every_window():
    rng = np.random.default_rng(0)
    at = np.array([0, 3, 3, 40, 41, 100])
    runs = rng.integers(0, 20, 100).astype(np.uint64)
    picked = set(C.winnow(runs, at).tolist())
    want = set()
    for a, b in zip(at[:-1], at[1:]):
        if b - a < C.WINDOW:
            want |= set(range(a, b))
        for i in range(a, b - C.WINDOW + 1):
            least = runs[i : i + C.WINDOW].min()
            want.add(max(j for j in range(i, i + C.WINDOW) if runs[j] == least))
    assert picked == want


def test_alignment_equals_full_dynamic_programming():
    rng = np.random.default_rng(2)

    def full(t, x):
        best, score = 0, np.zeros((len(t) + 1, len(x) + 1), int)
        for i in range(1, len(t) + 1):
            for j in range(1, len(x) + 1):
                score[i, j] = max(0, score[i - 1, j - 1] + (2 if t[i - 1] == x[j - 1] else -1), score[i - 1, j] - 1, score[i, j - 1] - 1)
                best = max(best, score[i, j])
        return best

    for _ in range(30):
        t, x = rng.integers(0, 4, 12), rng.integers(0, 4, 15)
        m, a, b = C.align(t, x, -20, 20)
        best = full(t, x)
        assert m <= min(len(t), b - a) and 2 * m >= best


def test_awkward_rows(docs, no_docs, rows):
    got = C.report(C.scan_licenses(docs)).collect()
    assert len(got) == len(rows) and sum(r.n_licenses for r in got) == 0
    assert C.scan_licenses(no_docs).count() == 0
    assert scan(None, "", "rights", "All  rights\nRESERVED")[3][0]["coverage"] == 1.0


def every_alignment(template, text):
    """The best local alignment's score over the whole table, without a band."""
    score, top = [[0] * (len(text) + 1) for _ in range(len(template) + 1)], 0
    for i, w in enumerate(template, 1):
        for j, x in enumerate(text, 1):
            score[i][j] = max(0, score[i - 1][j - 1] + (2 if w == x else -1), score[i - 1][j] - 1, score[i][j - 1] - 1)
            top = max(top, score[i][j])
    return top


def test_alignment_equals_the_whole_table():
    """A band over all diagonals gives a best alignment: its matches, gaps and mismatches sum to the best score."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 4, int(rng.integers(1, 14))), rng.integers(0, 4, int(rng.integers(1, 18)))
        want = every_alignment(a.tolist(), b.tolist())
        m, x, y, p, q = C.align_both(a, b, -len(a), len(b))
        assert (want == 0) == (m == 0)
        if m:
            # The span it names holds an alignment of that score, and no better one is anywhere.
            assert every_alignment(a[p:q].tolist(), b[x:y].tolist()) == want and m <= min(q - p, y - x)


@pytest.mark.parametrize("line", ["All rights reserved.", "Licensed under CC BY-NC 4.0.", "Released under the MIT License."])
@pytest.mark.parametrize("times", [1, 2, 7, 10])
def test_every_repeat_of_a_short_notice_counts(line, times):
    (found,) = C.scan_batch(pa.array([" ".join([line] * times)]), tuple(C.TEMPLATES.items()))
    assert [(s["start"], s["end"]) for s in found] == [(k * (len(line) + 1), k * (len(line) + 1) + len(line) - line.endswith(".")) for k in range(times)]


def test_whole_licenses_are_covered():
    """A BSD text of four parts is named part by part, without a gap of a sentence."""
    text = " ".join(C.TEMPLATES[k] for k in ("BSD", "BSD-3-Clause-endorsement", "BSD-disclaimer"))
    (found,) = C.scan_batch(pa.array([text]), tuple(C.TEMPLATES.items()))
    assert [s["license"] for s in found] == ["BSD", "BSD-3-Clause-endorsement", "BSD-disclaimer"] and all(s["coverage"] == 1.0 for s in found)

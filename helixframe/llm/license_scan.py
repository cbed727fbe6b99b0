"""License scans: winnowed fingerprints pick candidates, banded alignment confirms them.

Words are runs of letters and digits, A-Z folded. Templates give an inverted index
from the hash of every ``K``-word run to its places. A text is winnowed: of every
``WINDOW`` runs in a row the one with the smallest hash (the last, if equal) is a
fingerprint, so a shared passage of ``K + WINDOW - 1`` words has one in common;
templates shorter than that are looked up by their first run besides. Fingerprints
in the index group by template and diagonal, and each group is aligned with its
template within a band, then what that leaves of the group's text is, as long as
``K`` words match. These pieces chain where they follow each other in the text and
in the template, at most the template's length apart, so a notice with a longer
insertion or a deletion counts whole. A chain gives the matched words, their share
of the template and the span. Of overlapping spans the one with the most matched
words stays.

Null and empty texts have no spans; repeated rows each give a row; long texts are
scanned whole; other columns are ignored. Spans are code points, ends exclusive.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_hash
from .common import bounded, id_and_text
from .license_templates import TEMPLATES

K, WINDOW, BAND = 3, 4, 8
MIN_COVERAGE = 0.7


def _words(data: np.ndarray, at: np.ndarray):
    return byte_hash.words(_plain()[data], at)


@lru_cache(maxsize=1)
def _plain() -> np.ndarray:
    """Bytes with every ASCII sign but letters and digits as a blank."""
    table = np.arange(256, dtype=np.uint8)
    for b in range(128):
        if not chr(b).isalnum():
            table[b] = 0x20
    return table


def winnow(runs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the fingerprints: the last smallest run of every window within a text; all runs of a text with fewer than a window."""
    if not len(runs):
        return np.empty(0, np.int64)
    flag = np.zeros(len(runs), bool)
    sizes = np.diff(at)
    flag[np.repeat(sizes < WINDOW, sizes)] = True
    if len(runs) >= WINDOW:
        best = np.arange(len(runs) - WINDOW + 1)
        for j in range(1, WINDOW):
            there = np.arange(len(best)) + j
            best = np.where(runs[there] <= runs[best], there, best)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        flag[best[owner[: len(best)] == owner[WINDOW - 1 :]]] = True
    return np.flatnonzero(flag)


class Templates:
    """The inverted index of templates."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.names = [n for n, _ in templates]
        data, at = byte_hash.bytes_of(pa.array([t for _, t in templates], pa.string()))
        _, _, hashes, word_at = _words(data, at)
        runs, run_at = byte_hash.shingles(hashes, word_at, K)
        self.words = [hashes[a:b] for a, b in zip(word_at[:-1], word_at[1:])]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, (a, b) in enumerate(zip(run_at[:-1], run_at[1:])):
            for p, h in enumerate(runs[a:b].tolist()):
                self.places[h].append((t, p))
        self.known = np.array(sorted(self.places), np.uint64)
        short = [runs[a] for a, b, w in zip(run_at[:-1], run_at[1:], self.words) if b > a and len(w) < K + WINDOW - 1]
        self.short = np.array(sorted(short), np.uint64)


@lru_cache(maxsize=4)
def index_of(templates: tuple[tuple[str, str], ...]) -> Templates:
    return Templates(templates)


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Matched words, and first and last + 1 matched place in ``text``, of the best local alignment on diagonals ``low`` to ``high``."""
    return align_both(template, text, low, high)[:3]


def align_both(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int, int, int]:
    """As ``align``, then first and last + 1 matched place in ``template``.

    A match scores 2, a mismatch or gap -1. A diagonal is a place in the text minus one in the template.
    """
    width = high - low + 1
    # Of each cell in the band: score, matched words, first matched places in the text and in the template.
    score, matched, first = [0] * (width + 2), [0] * (width + 2), [(-1, -1)] * (width + 2)
    best = (0, 0, -1, -1, -1, -1)
    words, n = template.tolist(), len(text)
    text_words = text.tolist()
    for i, w in enumerate(words):
        above, above_m, above_f = score, matched, first
        score, matched, first = [0] * (width + 2), [0] * (width + 2), [(-1, -1)] * (width + 2)
        for d in range(1, width + 1):
            j = i + low + d - 1
            if not 0 <= j < n:
                continue
            same = text_words[j] == w
            # Diagonal neighbour: same d above; a skipped template word: d + 1 above; a skipped text word: d - 1 here.
            s, m, f = above[d] + (2 if same else -1), above_m[d] + same, above_f[d]
            if above[d + 1] - 1 > s:
                s, m, f = above[d + 1] - 1, above_m[d + 1], above_f[d + 1]
            if score[d - 1] - 1 > s:
                s, m, f = score[d - 1] - 1, matched[d - 1], first[d - 1]
            if s <= 0:
                continue
            if m and f[0] < 0:
                f = (j, i)
            score[d], matched[d], first[d] = s, m, f
            if same and s > best[0]:
                best = (s, m, f[0], j + 1, f[1], i + 1)
    return best[1:]


def pieces(template: np.ndarray, text: np.ndarray, low: int, high: int) -> list[tuple[int, int, int, int, int]]:
    """The alignments of ``align_both`` of ``K`` matched words or more, in order: the best one and those of what is left before and after it."""
    out, todo = [], [(max(0, low), min(len(text), high + len(template)))]
    while todo:
        x, y = todo.pop()
        if y - x < K:
            continue
        m, a, b, p, q = align_both(template, text[x:y], low - x, high - x)
        if m >= K:
            out.append((m, x + a, x + b, p, q))
            todo += [(x, x + a), (x + b, y)]
    return sorted(out, key=lambda r: r[1:])


def chained(found: list[tuple[int, int, int, int, int]], size: int, need: float) -> list[tuple[int, int, int]]:
    """Matched words, start and end of the chains of pieces with ``need`` matched words or more, best first and without overlaps."""
    out, left = [], sorted(set(found), key=lambda r: r[1:])
    while left:
        # Of the best chain that ends with each piece: matched words and start.
        best: list[tuple[int, int]] = []
        for j, (m, a, b, p, q) in enumerate(left):
            top = (m, a)
            for i in range(j - 1, -1, -1):
                _, a1, b1, p1, q1 = left[i]
                if a - a1 > 4 * size + BAND:
                    break
                common = max(0, q1 - p, b1 - a)
                if a1 < a and p1 < p and b1 < b and q1 < q and common < m and a - b1 <= size:
                    top = max(top, (best[i][0] + m - common, best[i][1]))
            best.append(top)
        k = max(range(len(left)), key=lambda j: (best[j][0], -left[j][2]))
        (m, a), b = best[k], left[k][2]
        if m < need:
            break
        out.append((m, a, b))
        left = [r for r in left if r[2] <= a or r[1] >= b]
    return out


def scan_batch(texts: pa.Array, templates: tuple[tuple[str, str], ...], min_coverage: float = MIN_COVERAGE) -> list[list[dict]]:
    """For each text its spans: license, start, end, matched, coverage."""
    index = index_of(templates)
    data, at = byte_hash.bytes_of(texts)
    starts, ends, hashes, word_at = _words(data, at)
    runs, run_at = byte_hash.shingles(hashes, word_at, K)
    out: list[list[dict]] = [[] for _ in range(len(at) - 1)]
    picked = winnow(runs, run_at)
    picked = picked[np.isin(runs[picked], index.known)]
    if len(index.short):
        picked = np.union1d(picked, np.flatnonzero(np.isin(runs, index.short)))
    owner = np.searchsorted(run_at, picked, side="right") - 1
    for doc in np.unique(owner):
        mine = picked[owner == doc]
        found = _candidates(index, [(int(p - run_at[doc]), int(runs[p])) for p in mine])
        text = hashes[word_at[doc] : word_at[doc + 1]]
        spans, parts = [], defaultdict(list)
        for t, low, high in found:
            parts[t] += pieces(index.words[t], text, low - BAND, high + BAND)
        for t, known in parts.items():
            size = len(index.words[t])
            spans += [(m, m / size, a, b, t) for m, a, b in chained(known, size, min_coverage * size)]
        base, begin = at[doc], word_at[doc]
        kept: list[tuple] = []
        for s in sorted(set(spans), key=lambda s: (-s[0], -s[1], s[2], s[4])):
            if all(s[3] <= k[2] or s[2] >= k[3] for k in kept):
                kept.append(s)
        points = lambda end: int((data[base:end] & 0xC0 != 0x80).sum())  # noqa: E731, B023
        for m, share, a, b, t in sorted(kept, key=lambda s: s[2]):
            out[doc].append({"license": index.names[t], "start": points(starts[begin + a]), "end": points(ends[begin + b - 1]), "matched": m, "coverage": round(share, 4)})
    return out


def _candidates(index: Templates, hits: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Template and range of diagonals of each group of neighbouring hits."""
    by_template: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for place, h in hits:
        for t, p in index.places[h]:
            by_template[t].append((place - p, place))
    out = []
    for t, found in by_template.items():
        found.sort()
        low = last = found[0][0]
        for d, _ in found[1:]:
            if d - last > BAND or d - low > len(index.words[t]) + BAND:
                out.append((t, low, last))
                low = d
            last = d
        out.append((t, low, last))
    return out


_SPANS = "array<struct<license:string,start:bigint,end:bigint,matched:bigint,coverage:double>>"
_SPANS_PA = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.int64()), ("coverage", pa.float64())]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """doc_id, spans of each whole text. The templates travel with the tasks; they are a parameter, not data."""
    known = tuple((templates or TEMPLATES).items())
    kept = id_and_text(docs)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scan_batch(b.column(1), known, min_coverage), _SPANS_PA)], ["doc_id", "spans"])

    return kept.mapInArrow(bounded(run), f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, spans {_SPANS}")


def report(found: DataFrame) -> DataFrame:
    """Counts and spans as a string."""
    one = lambda s: F.concat_ws(":", s["license"], s["start"].cast("string"), s["end"].cast("string"), F.format_number(s["coverage"], 4))
    return found.select("doc_id", F.size("spans").cast("bigint").alias("n_licenses"), F.array_join(F.transform("spans", one), ",").alias("spans"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("coverage"))

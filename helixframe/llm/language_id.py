"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded labelled sample is built. A
text is parsed greedily into the longest phrases that occur in the sample; the
phrases times the bits of a pointer into the sample, over the length of the
text, is its cross entropy, and the language with the smallest one wins.

The automata are completed into one transition table, whose entries also carry
the phrases that end there, so NumPy advances all languages and many texts by
one letter at a time. Texts are folded to lower-case letters and single blanks
and parsed whole, in blocks of ``BLOCK`` symbols that phrases don't cross.

The sample's bounds are parameters: ``sample_chars`` per language, in excerpts of
``EXCERPT`` characters, and ``table_bytes`` for the transition table, which share
out among all labels, so with many labels or large alphabets each has a shorter
sample and none goes unlearned. Rows whose crc32(doc_id) mod 4 is 2, rows without
a label and rows labelled ``und`` (undetermined) are not learned from.

Null texts, and texts without letters, give ``und`` and score 0; equal entropies
go to the label that sorts first; repeated rows each give a row; an empty table
gives no rows, and with nothing to learn from all are ``und``. Very long texts
are parsed whole. Other columns, whatever their names, are ignored or
(``keep_identified``) kept. The score is 1 - best/second, 1 when one language
alone was learned.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, id_and_text, only_one

BLOCK = 1024
EXCERPT = 512
HELD_OUT = 2
#: Symbols: 0 a blank, 1 any letter outside the alphabet, then the alphabet (the letters of the sample, so many at most), last the padding.
ALPHABET = 250
UNKNOWN = "und"
_GROUP = 1_000_000


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def learn(docs: DataFrame, sample_chars: int = 40_000, table_bytes: int = 256 << 20) -> tuple[tuple[str, str], ...]:
    """The model: for each language, its label and the sampled text, both bounded.

    A first pass estimates each label's distinct texts, a second collects those
    whose hash falls below the fraction that gives the wanted number of excerpts,
    and the one of the smallest hash, so that no label is left without. What comes
    to the driver is bounded by the number of labels times the sample.
    """
    labelled = (
        docs.select(F.col("doc_id"), F.col("text"), F.col("lang"))
        .filter(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
        .select("lang", "text", F.xxhash64("text").alias("h"))
    )
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.min("h").alias("least")).orderBy("lang").collect()
    if not counts:
        return ()
    # An automaton has two states a character at most, and a table row of four bytes a symbol for each.
    chars = max(EXCERPT, min(sample_chars, table_bytes // (len(counts) * 2 * 4 * (ALPHABET + 3))))
    per_language = max(1, chars // EXCERPT)
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 3.0 * per_language / max(1, r["n"])), r["least"]) for r in counts], "lang string, share double, least bigint")
    unit = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    start = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - EXCERPT, F.lit(0)) + 1).cast("int") + 1
    # A row per label: no larger than the counts that the driver holds.
    sampled = labelled.join(F.broadcast(shares), "lang").filter((F.col("share") > unit) | (F.col("h") == F.col("least")))
    rows = sampled.select("lang", "h", F.substring("text", start, F.lit(EXCERPT)).alias("part")).distinct().collect()
    found: dict[str, list] = {r["lang"]: [] for r in counts}
    for r in rows:
        found[r["lang"]].append((r["h"], r["part"]))
    model = []
    for lang in sorted(found):
        if text := " ".join(part for _, part in sorted(found[lang])[: 2 * per_language])[:chars]:
            model.append((lang, text))
    return tuple(model)


def automaton(symbols: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """States of the suffix automaton of ``symbols``: their transitions and suffix links."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new, p = len(nexts), last
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return nexts, link


class Parser:
    """The completed automata of a model, over one state space."""

    def __init__(self, model: tuple[tuple[str, str], ...]):
        self.labels = [label for label, _ in model]
        letters = Counter(c for _, text in model for c in text.lower() if c.isalpha())
        self.table = np.zeros(0x110000, np.uint8)
        self.table[[i for i in range(0x110000) if chr(i).isalpha()]] = 1
        self.size = min(len(letters), ALPHABET) + 3
        for k, (c, _) in enumerate(sorted(letters.items(), key=lambda x: (-x[1], x[0]))[:ALPHABET]):
            self.table[ord(c)] = 2 + k
        parts, roots, bits, base = [], [], [], 0
        for _, text in model:
            symbols = self.symbols(text)
            nexts, _ = automaton(symbols.tolist())
            n = len(nexts)
            state = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in nexts])
            symbol = np.fromiter((c for x in nexts for c in x), np.int32)
            target = np.fromiter((t for x in nexts for t in x.values()), np.int32)
            del nexts
            step = np.full((n, self.size), -1, np.int32)
            step[state, symbol] = target
            root = step[0].copy()
            # Without a transition the phrase ends and the next begins at the root; a symbol unknown there is a phrase of its own.
            restart = np.where(root >= 0, (root + base) << 2 | 1, base << 2 | 2)
            full = np.where(step >= 0, (step + base) << 2, restart[None, :])
            full[0] = np.where(root >= 0, (root + base) << 2, base << 2 | 1)
            full[:, self.size - 1] = (np.arange(n, dtype=np.int32) + base) << 2
            parts.append(full)
            roots.append(base)
            bits.append(np.log2(max(2, len(symbols))))
            base += n
        self.steps = np.concatenate(parts).ravel() if parts else np.empty(0, np.int32)
        self.roots, self.bits = np.array(roots, np.int32), np.array(bits)

    def symbols(self, text: str) -> np.ndarray:
        got = self.table[np.frombuffer(text.lower().encode("utf-32-le"), "<u4")]
        before = np.concatenate([np.zeros(1, np.uint8), got[:-1]])
        return got[(got > 0) | (before > 0)]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """The phrases of each text (rows) in each language (columns)."""
        owner = np.repeat(np.arange(len(texts)), [-(-len(t) // BLOCK) for t in texts])
        lanes = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
        sizes = np.array([len(x) for x in lanes], np.int64)
        order = np.argsort(-sizes, kind="stable")
        longest = int(sizes.max(initial=0))
        grid = np.full((longest, len(lanes)), self.size - 1, np.uint8)
        for k, i in enumerate(order):
            grid[: sizes[i], k] = lanes[i]
        active = np.searchsorted(-sizes[order], -np.arange(longest), side="left")
        state = np.repeat(self.roots[:, None], len(lanes), 1)
        ended = np.zeros(state.shape, np.int32)
        for t in range(longest):
            n = active[t]
            got = self.steps.take(state[:, :n] * self.size + grid[t, :n])
            ended[:, :n] += got & 3
            state[:, :n] = got >> 2
        ended += state != self.roots[:, None]
        out = np.zeros((len(texts), len(self.roots)), np.int64)
        np.add.at(out, owner[order], ended.T)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Labels, scores and cross entropies in bits a symbol."""
        labels, scores, entropies = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if not self.labels:
            return labels, scores, entropies
        pending: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            if not pending:
                return
            sizes = np.array([len(s) for _, s in pending])
            h = self.phrases([s for _, s in pending]) * self.bits / sizes[:, None]
            best = np.argmin(h, 1)
            low = h[np.arange(len(h)), best]
            h[np.arange(len(h)), best] = np.inf
            second = h.min(1)
            for (i, _), k, a, b in zip(pending, best, low, second):
                labels[i], entropies[i] = self.labels[k], float(a)
                scores[i] = float(min(1.0, max(0.0, 1 - a / b))) if np.isfinite(b) else 1.0
            pending.clear()

        total = 0
        for i, text in enumerate(texts):
            s = self.symbols(text or "")
            if s.any():
                pending.append((i, s))
                total += len(s)
            if total >= _GROUP:
                flush()
                total = 0
        flush()
        return labels, scores, entropies


def parser(model: tuple[tuple[str, str], ...]) -> Parser:
    """Built once per Python worker."""
    return only_one("parser", model, Parser)


def identify(docs: DataFrame, model: tuple[tuple[str, str], ...]) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits (the cross entropy) of each whole text."""
    kept = id_and_text(docs)

    def run(batches):
        for b in batches:
            labels, scores, bits = parser(model).predict(b.column(1).to_pylist())
            columns = [b.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "bits"])

    kind = kept.schema["doc_id"].dataType.simpleString()
    out = kept.mapInArrow(bounded(run, keeps="parser"), f"doc_id {kind}, lang_pred string, score double, bits double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits")


def keep_identified(docs: DataFrame, model: tuple[tuple[str, str], ...]) -> DataFrame:
    """The rows whose text has a language, unchanged but for a missing ``lang``, which is filled in."""
    names, at, lang = docs.columns, docs.columns.index("text"), docs.columns.index("lang") if "lang" in docs.columns else None

    def run(batches):
        for b in batches:
            labels, _, _ = parser(model).predict(b.column(at).to_pylist())
            columns = list(b.columns)
            if lang is not None:
                columns[lang] = pa.array([x if x is not None else y for x, y in zip(columns[lang].to_pylist(), labels)], columns[lang].type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array([x != UNKNOWN for x in labels]))

    return docs.mapInArrow(bounded(run, keeps="parser"), docs.schema)


def learn_and_identify(docs: DataFrame, **bounds: int) -> DataFrame:
    return identify(docs, learn(docs, **bounds))


__all__ = ["automaton", "held_out", "identify", "keep_identified", "learn", "learn_and_identify", "Parser"]

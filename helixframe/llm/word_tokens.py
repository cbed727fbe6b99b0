"""Exact ids of a lower-casing word BPE tokenizer, a batch of texts at a time.

The tokenizer file decides every id; this module only avoids running it on the
same word again. Texts of ASCII and Latin-1 letters are cut into the pattern's
words with NumPy over their bytes (letters, single digits, runs of other signs,
and the contractions), distinct words are looked up by hash, and unknown ones go
through the tokenizer. For any other text, for texts that may hold one of the
tokenizer's special tokens, and for other tokenizer files, the tokenizer itself
runs on the whole text.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import byte_hash
from .common import only_one

#: Words that a worker remembers, with four ids each on average, before it starts anew, which bounds its memory.
REMEMBERED = 600_000

# The word pattern and the normalizers that the fast path stands for.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of a byte; the second byte of a Latin-1 letter is a letter too, bytes of other characters are odd."""
    table = np.full(256, _ODD, np.uint8)
    table[:128] = _OTHER
    table[[0x20, *range(0x09, 0x0E)]] = _SPACE
    table[0x30:0x3A] = _DIGIT
    table[0x41:0x5B] = table[0x61:0x7B] = _LETTER
    table[0xC3] = _LETTER
    return table


class Tokens:
    """The tokenizer of a file with a memory of words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        steps = (said.get("normalizer") or {}).get("normalizers", [])
        splits = (said.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        end = said["model"].get("end_of_word_suffix")
        self.fast = [x["type"] for x in steps] == NORMALIZERS and splits[0].get("pattern", {}).get("Regex") == PATTERN and bool(end)
        # Texts that hold a special token's first signs, in either case, are the tokenizer's own to cut.
        self.marks = sorted({t["content"].lower().encode()[:2] for t in said.get("added_tokens", [])})
        self.ends_word = np.zeros(self.size, bool)
        if self.fast:
            self.ends_word[[i for word, i in said["model"]["vocab"].items() if word.endswith(end)]] = True
        self._forget()

    def _forget(self) -> None:
        #: The hashes of known words in order, where the ids of each begin in the pool, and how many they are.
        self.keys, self.begin, self.count = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.pool, self.filled = np.empty(1 << 16, np.uint16 if self.size <= 1 << 16 else np.uint32), 0

    def _learn(self, keys: np.ndarray, at: np.ndarray, words: list[str]) -> None:
        """Append the ids of new words to the pool; ``at`` is where their hashes go among the known ones."""
        begin, count = [], []
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            # Offsets aren't needed: the last id of a word, and no other, has the end-of-word sign.
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            counts = np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1)
            if len(counts) != len(part) or counts.sum() != len(ids):
                raise ValueError("the tokenizer cuts words otherwise than its pattern says")
            if self.filled + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.empty(max(len(self.pool), len(ids)), self.pool.dtype)])
            self.pool[self.filled : self.filled + len(ids)] = ids
            begin.append(np.cumsum(counts) - counts + self.filled)
            count.append(counts)
            self.filled += len(ids)
        self.keys = np.insert(self.keys, at, keys)
        self.begin = np.insert(self.begin, at, np.concatenate(begin))
        self.count = np.insert(self.count, at, np.concatenate(count))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the n + 1 offsets."""
        data, at = byte_hash.bytes_of(texts)
        odd = np.zeros(len(data), bool)
        if self.fast and len(data):
            kind = _classes()[data]
            lead = data == 0xC3
            after = np.flatnonzero(lead) + 1
            second = data[after]
            kind[after] = np.where((second == 0x97) | (second == 0xB7), _ODD, _LETTER)
            odd = kind == _ODD
            self._mark(data, at, odd)
        slow = np.diff(np.concatenate([[0], np.cumsum(odd)])[at]) > 0 if self.fast else np.ones(len(at) - 1, bool)
        ids, counts = self._fast(data, at, kind, slow) if self.fast and len(data) else (np.empty(0, np.uint32), np.zeros(len(at) - 1, np.int64))
        if slow.any():
            ends = np.cumsum(counts)
            parts = [ids[e - c : e] for e, c in zip(ends, counts)]
            for i in np.flatnonzero(slow):
                parts[i] = np.asarray(self.tokenizer.encode(texts[int(i)].as_py() or "", add_special_tokens=False).ids, np.uint32)
            counts = np.array([len(p) for p in parts])
            ids = np.concatenate(parts)
        return ids, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def _mark(self, data: np.ndarray, at: np.ndarray, odd: np.ndarray) -> None:
        """Flag places where a special token may begin."""
        raw = data.tobytes().lower() if self.marks else b""
        for mark in self.marks:
            found = raw.find(mark)
            while found >= 0:
                odd[found] = True
                # The rest of this text needs no look.
                found = raw.find(mark, int(at[np.searchsorted(at, found, side="right")]))

    def _fast(self, data: np.ndarray, at: np.ndarray, kind: np.ndarray, slow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = data.copy()
        data[(data >= 65) & (data <= 90)] += 32
        upper = np.flatnonzero(data == 0xC3) + 1
        upper = upper[(data[upper] >= 0x80) & (data[upper] <= 0x9E)]
        data[upper] += 32
        solid = kind != _SPACE
        solid[np.repeat(slow, np.diff(at))] = False
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        start = solid.copy()
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT) | edge[1:-1]
        self._contract(data, kind, start, edge)
        last = solid.copy()
        last[:-1] &= start[1:] | ~solid[1:] | edge[1:-1]
        begins, ends = np.flatnonzero(start), np.flatnonzero(last) + 1
        if not len(begins):
            return np.empty(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        hashes = byte_hash.ranges(byte_hash.prefix(data), begins, ends)
        values, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(values) > REMEMBERED or self.filled > 4 * REMEMBERED:
            self._forget()
        among = np.searchsorted(self.keys, values)
        new = np.ones(len(values), bool)
        inside = among < len(self.keys)
        new[inside] = self.keys[among[inside]] != values[inside]
        if new.any():
            raw = data.tobytes()
            self._learn(values[new], among[new], [raw[begins[i] : ends[i]].decode() for i in first[new].tolist()])
            among = np.searchsorted(self.keys, values)
        word = among[place]
        start_of, size = self.begin[word], self.count[word]
        total = np.cumsum(size)
        ids = self.pool[np.arange(total[-1]) + np.repeat(start_of - (total - size), size)].astype(np.uint32)
        words_at = np.searchsorted(begins, at)
        return ids, np.diff(np.concatenate([[0], total])[words_at])

    @staticmethod
    def _contract(data: np.ndarray, kind: np.ndarray, start: np.ndarray, edge: np.ndarray) -> None:
        """Join a quote that begins a word with the letters of a contraction."""
        n = len(data)
        quotes = np.flatnonzero((data == 0x27) & start)
        quotes = quotes[quotes + 1 < n]
        for letters in CONTRACTIONS:
            k, hit = len(letters), quotes[quotes + len(letters) < n]
            for j, c in enumerate(letters):
                hit = hit[(data[hit + 1 + j] == ord(c)) & ~edge[hit + 1 + j]]
            start[hit + 1] = False
            rest = hit[hit + 1 + k < n] + 1 + k
            start[rest[(kind[rest] == _LETTER) & ~edge[rest]]] = True


def tokens(path: str) -> Tokens:
    """Loaded once per Python worker."""
    return only_one("tokens", path, Tokens)

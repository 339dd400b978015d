"""Byte-level BPE on ragged numpy arrays.

Words are held as one flat array of token ids with offsets. In each round every word applies its own
lowest-rank pair, at all places at once; words without a mergeable pair leave the arrays. A merge never
makes a pair of lower rank than its own, so the rounds give what merging one pair at a time gives.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np
import regex

from .common import ragged_index

NONE = np.int64(1) << 40


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """Open-addressing table from a pair of ids to (rank, merged id), probed for whole arrays."""

    def __init__(self, left, right, rank, merged, byte_ids, token_bytes: list[bytes]):
        key = np.asarray(left, np.int64) << 20 | np.asarray(right, np.int64)
        size = 1 << int(np.ceil(np.log2(max(len(key), 8) * 3)))
        self.mask = size - 1
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, NONE, np.int64)
        self.merged = np.zeros(size, np.int64)
        rank, merged = np.asarray(rank, np.int64), np.asarray(merged, np.int64)
        todo, slot = np.arange(len(key)), self._hash(key)
        while len(todo):
            free = self.keys[slot] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            at = slot[put]
            self.keys[at], self.rank[at], self.merged[at] = key[todo[put]], rank[todo[put]], merged[todo[put]]
            todo, slot = todo[~put], slot[~put]
            slot = np.where(self.keys[slot] >= 0, (slot + 1) & self.mask, slot)
        self.byte_ids = np.asarray(byte_ids, np.int64)
        self.token_bytes = token_bytes
        #: whether later merges always make larger ids
        self.by_id = bool((np.diff(merged[np.argsort(rank, kind="stable")]) >= 0).all())

    def _hash(self, key: np.ndarray) -> np.ndarray:
        k = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (k >> np.uint64(40)).astype(np.int64) & self.mask

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 20 | right
        slot = self._hash(key)
        rank, merged = np.full(len(key), NONE, np.int64), np.zeros(len(key), np.int64)
        open_ = np.arange(len(key))
        while len(open_):
            there = self.keys[slot]
            hit = there == key[open_]
            rank[open_[hit]], merged[open_[hit]] = self.rank[slot[hit]], self.merged[slot[hit]]
            go = ~hit & (there >= 0)
            open_, slot = open_[go], (slot[go] + 1) & self.mask
        return rank, merged


@lru_cache(4)
def table_from_ranks(path: str) -> PairTable:
    """Of a rank file: any split of a token into two tokens may merge into it, at the token's rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    left, right, rank = [], [], []
    for token, r in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                left.append(a), right.append(b), rank.append(r)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, r in ranks.items():
        tokens[r] = token
    return PairTable(left, right, rank, rank, [ranks[bytes([b])] for b in range(256)], tokens)


@lru_cache(4)
def table_from_json(path: str) -> tuple[PairTable, dict[str, int]]:
    """Of a tokenizer file with byte-level BPE; also its special strings with their ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
    alphabet = _byte_alphabet()
    left, right, merged = [vocab[a] for a, _ in merges], [vocab[b] for _, b in merges], [vocab[a + b] for a, b in merges]
    byte_ids = [0] * 256
    for c, b in alphabet.items():
        byte_ids[b] = vocab[c]
    tokens = [b""] * (max(vocab.values()) + 1)
    for t, i in vocab.items():
        if all(c in alphabet for c in t):
            tokens[i] = bytes(alphabet[c] for c in t)
    specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    return PairTable(left, right, range(len(merges)), merged, byte_ids, tokens), specials


def merge_words(words: list[bytes], table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of each word, flat and by word, and the number of each word's tokens."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    n_out = lengths.copy()
    ids = table.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    out_ids, out_word = [], []
    word = np.repeat(np.arange(len(words)), lengths)

    def ranks(at):
        """Rank and result of the pair that begins at each position; none at a word's end."""
        nxt = at + 1
        inside = nxt < len(ids)
        inside[inside] = word[nxt[inside]] == word[at[inside]]
        r, m = np.full(len(at), NONE, np.int64), np.zeros(len(at), np.int64)
        r[inside], m[inside] = table.find(ids[at[inside]], ids[nxt[inside]])
        return r, m

    rank, merged = ranks(np.arange(len(ids)))
    while len(ids):
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        size = np.diff(np.r_[starts, len(ids)])
        low = np.minimum.reduceat(rank, starts)
        live = np.repeat(low < NONE, size)
        if not live.all():
            out_ids.append(ids[~live]), out_word.append(word[~live])
            ids, word, rank, merged, low_at = ids[live], word[live], rank[live], merged[live], np.repeat(low, size)[live]
            if not len(ids):
                break
        else:
            low_at = np.repeat(low, size)
        hit = rank == low_at
        if (hit[1:] & hit[:-1]).any():  # a run of one repeated id: every second pair of it merges
            at = np.flatnonzero(hit)
            head = np.r_[True, np.diff(at) > 1]
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            hit[at[nth % 2 == 1]] = False
        ids = np.where(hit, merged, ids)
        keep = np.r_[True, ~hit[:-1]]
        n_out -= np.bincount(word[~keep], minlength=len(n_out))
        # a kept position is stale if it merged or if what follows it changed
        follows = np.zeros(len(hit), bool)
        follows[:-1] = hit[1:]
        follows[:-2] |= hit[:-2] & hit[2:]
        ids, word, rank, merged, stale = ids[keep], word[keep], rank[keep], merged[keep], (hit | follows)[keep]
        at = np.flatnonzero(stale)
        rank[at], merged[at] = ranks(at)
    if out_ids:
        flat, of = np.concatenate(out_ids), np.concatenate(out_word)
        flat = flat[np.argsort(of, kind="stable")]
    else:
        flat = np.zeros(0, np.int64)
    return flat, n_out


class PreTokenizer:
    """Splits a text by the pattern; texts in ASCII take an equal pattern of the faster engine."""

    #: The public pattern with its character classes written for ASCII alone.
    ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"

    def __init__(self, pattern: str, specials: dict[str, int] | None = None):
        self.plain = re.compile(self.ASCII, re.A).findall
        self.full = regex.compile(pattern).findall
        self.specials = specials or {}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None

    def split(self, text: str) -> list[str]:
        return self.plain(text) if text.isascii() else self.full(text)

    def __call__(self, text: str) -> list[str]:
        """Special strings, where there are any, stay whole items of the list."""
        if self.cut is None or not any(s in text for s in self.specials):
            return self.split(text)
        out = []
        for part in self.cut.split(text):
            if part in self.specials:
                out.append(part)
            elif part:
                out += self.split(part)
        return out


def encode_pieces(text: str, pre: PreTokenizer, pairs: PairTable) -> np.ndarray:
    """Ids of a text, special strings included, by splitting it first: linear however long a piece is."""
    pieces = pre(text)
    words = [b"" if w in pre.specials else w.encode() for w in pieces]
    flat, n = merge_words([w for w in words if w], pairs)
    parts, at, k = [], 0, 0
    sizes = n.tolist()
    for piece, w in zip(pieces, words):
        if w:
            parts.append(flat[at : at + sizes[k]])
            at, k = at + sizes[k], k + 1
        else:
            parts.append(np.array([pre.specials[piece]], np.int64))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def ragged_take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The ranges numbered by which, one after the other."""
    return flat[ragged_index(starts[which], lengths[which])]

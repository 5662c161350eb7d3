"""Byte-level BPE encoding and decoding by replaying the merges over all words of a block of texts at once.

A block is what a task holds of the corpus at a time. Its distinct pre-tokens are laid out in one symbol
array. In each round the next merge of every word is applied, and only the neighbours of a merged position are looked up
again. Long words have an inverted index each, from a mergeable pair (named by the rank of what it makes) to its
positions. Words once encoded are kept for the following blocks, up to ``KEEP`` of them; the
bound costs time, never results. Texts never move between tasks.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicerank.llm.common import KEEP, SPACES, held, map_texts, texts

#: Runs that no match of the tokenizers' pattern leaves: a word with the space before it, or white space.
UNITS = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def pieces_pattern(pattern: str):
    """The published pattern, with white space by the Unicode property."""
    return regex.compile(pattern.replace("[^\\s", f"[^{SPACES}").replace("\\s", f"[{SPACES}]")
                         .replace("\\S", f"[^{SPACES}]"))


class MergeReplay:
    """Encodes many words together.

    Words of up to ``WIDE`` bytes lie in one symbol array, without an index from pairs to positions. In every round each
    word's merge of least rank is applied at its leftmost position, the ranks of the touched neighbours are looked up
    again, and the array is written anew. Longer words have an index with one queue of ranks, so that their cost does not
    grow with the square of their length.
    """

    WIDE = 64
    NONE = 1 << 30

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        made = {}
        for word, rank in ranks.items():
            for k in range(1, len(word)):
                left, right = ranks.get(word[:k]), ranks.get(word[k:])
                if left is not None and right is not None:
                    made[left << 24 | right] = rank
        self.pairs = np.array(sorted(made), np.int64)
        self.ranks_of = np.array([made[k] for k in self.pairs.tolist()] + [self.NONE], np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of what two neighbours make, ``NONE`` if nothing."""
        keys = left << 24 | right
        at = np.searchsorted(self.pairs, keys)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == keys, self.ranks_of[at], self.NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word.

        A word that is itself in the vocabulary is one id, as in the tiktoken library.
        """
        out: list[bytes] = [b""] * len(words)
        short = []
        for i, word in enumerate(words):
            if (whole := self.ranks.get(word)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(word) > self.WIDE:
                out[i] = np.array(self._long(word), "<u4").tobytes()
            elif word:
                short.append(i)
        if short:
            self._replay(words, short, out)
        return out

    def _replay(self, words: list[bytes], which: list[int], out: list[bytes]) -> None:
        symbol = self.first[np.frombuffer(b"".join([words[i] for i in which]), np.uint8)]
        sizes = np.array([len(words[i]) for i in which], np.int64)
        owner = np.array(which, np.int64)
        ends = np.cumsum(sizes)
        rank = np.full(len(symbol), self.NONE, np.int64)  # of a position with its right neighbour
        rank[:-1] = self.look_up(symbol[:-1], symbol[1:])
        rank[ends - 1] = self.NONE
        while len(sizes):
            starts = ends - sizes
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == self.NONE
            if done.any():
                flat = symbol.astype("<u4").tobytes()
                for i, a, b in zip(owner[done].tolist(), (starts[done] * 4).tolist(), (ends[done] * 4).tolist()):
                    out[i] = flat[a:b]
                stay = np.repeat(~done, sizes)
                symbol, rank, sizes, owner, lowest = symbol[stay], rank[stay], sizes[~done], owner[~done], lowest[~done]
                ends = np.cumsum(sizes)
                if not len(sizes):
                    return
            word = np.repeat(np.arange(len(sizes)), sizes)
            at = np.flatnonzero(rank == lowest[word])
            at = at[np.r_[True, word[at][1:] != word[at][:-1]]]  # one a word: the leftmost
            symbol[at] = lowest
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, rank = symbol[keep], rank[keep]
            sizes = sizes - 1
            ends = np.cumsum(sizes)
            at = at - np.arange(len(at))
            inner = at < ends - 1
            rank[at] = self.NONE
            rank[at[inner]] = self.look_up(symbol[at[inner]], symbol[at[inner] + 1])
            inner = at > ends - sizes
            rank[at[inner] - 1] = self.look_up(symbol[at[inner] - 1], symbol[at[inner]])

    def _long(self, word: bytes) -> list[int]:
        ranks, name = self.ranks, self.bytes_of
        symbol = self.first[np.frombuffer(word, np.uint8)].tolist()
        n = len(symbol)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        pair = [ranks.get(word[p:p + 2], -1) for p in range(n - 1)] + [-1]
        index: dict[int, list[int]] = {}
        for p, made in enumerate(pair):
            if made >= 0:
                index.setdefault(made, []).append(p)
        due = list(index)
        heapq.heapify(due)

        def touch(p: int, made: int) -> int:
            pair[p] = made
            if made < 0:
                return self.NONE
            if made in index:
                index[made].append(p)
            else:
                index[made] = [p]
                heapq.heappush(due, made)
            return made

        while due:
            rank = heapq.heappop(due)
            if rank not in index:
                continue
            at = sorted(index.pop(rank))
            for k, p in enumerate(at):
                if pair[p] != rank:
                    continue
                gone = right[p]
                pair[gone] = -2
                symbol[p] = rank
                beyond = right[p] = right[gone]
                pair[p], lowest = -1, rank
                if beyond >= 0:
                    left[beyond] = p
                    lowest = min(lowest, touch(p, ranks.get(name[rank] + name[symbol[beyond]], -1)))
                if (before := left[p]) >= 0:
                    lowest = min(lowest, touch(before, ranks.get(name[symbol[before]] + name[rank], -1)))
                if lowest < rank and k + 1 < len(at):  # a lower rank has come up: it goes first
                    index[rank] = at[k + 1:]
                    heapq.heappush(due, rank)
                    break
        out, p = [], 0
        while p >= 0:
            out.append(symbol[p])
            p = right[p]
        return out


class Encoder:
    """Texts to ids, with a memory of units already encoded."""

    def __init__(self, path: str, pattern: str, keep: int = KEEP):
        self.replay = MergeReplay(read_ranks(path))
        self.pattern = pieces_pattern(pattern)
        self.keep = keep
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def learn(self, units: set[str]) -> None:
        several: dict[str, list[str]] = {}
        wanted = set()
        find = self.pattern.findall
        for unit in units:
            pieces = find(unit)
            if len(pieces) == 1 and pieces[0] == unit:
                wanted.add(unit)
            else:
                several[unit] = pieces
                wanted.update(pieces)
        new = list(wanted.difference(self.words))
        words = self.words
        words.update(zip(new, self.replay.encode([w.encode() for w in new])))
        self.known.update((unit, words[unit]) for unit in units if unit not in several)
        self.known.update((unit, b"".join([words[w] for w in pieces])) for unit, pieces in several.items())

    def __call__(self, batch: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [UNITS.findall(text) for text in batch]
        distinct = set().union(*cut)
        fresh = distinct.difference(self.known)
        if len(self.known) + len(fresh) > self.keep:
            # What has come again stays: most units come once, and the others make up most of every text.
            again = distinct.difference(fresh)
            self.known = {u: self.known[u] for u in again}
            self.words = {u: self.words[u] for u in again if u in self.words}
        if fresh:
            self.learn(fresh)
        look = self.known.__getitem__
        return [b"".join(map(look, units)) for units in cut]


def worker_encoder(path: str, pattern: str) -> Encoder:
    """One encoder a Python worker, which outlives tasks."""
    memory = held("bpe")
    if (path, pattern) not in memory:
        memory[path, pattern] = Encoder(path, pattern)
    return memory[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids``: each whole text as little-endian unsigned 32-bit ids.

    A null text counts as empty and has no ids. Rows with equal keys stay separate rows; other columns are not
    read. Special tokens are ordinary text.
    """

    def make() -> Callable[[list[str]], dict[str, list]]:
        encoder = worker_encoder(path, pattern)
        return lambda batch: {"ids": encoder(batch)}

    return map_texts(texts(docs, key, text), make, "ids binary", key)


def worker_bytes(path: str) -> list[bytes]:
    """What each id stands for, once a Python worker."""
    memory = held("bpe")
    if ("bytes", path) not in memory:
        ranks = read_ranks(path)
        table = [b""] * (max(ranks.values()) + 1)
        for word, i in ranks.items():
            table[i] = word
        memory["bytes", path] = table
    return memory["bytes", path]


def _decoded(table: list[bytes], ids: list[bytes]) -> list[bytes]:
    look = table.__getitem__
    return [b"".join(map(look, np.frombuffer(x, "<u4").tolist())) for x in ids]


def decode(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key``, ``ids``, ``bytes``: what the ids stand for. Null ids give no bytes."""
    def make() -> Callable[[list[bytes]], dict[str, list]]:
        table = worker_bytes(path)
        return lambda batch: {"ids": batch, "bytes": _decoded(table, batch)}

    rows = tokens.select(key, F.coalesce(F.col(ids), F.lit(b"")).alias("given"))
    return map_texts(rows, make, "ids binary, bytes binary", key, "given")


def encode_decode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens``, ``ids``, ``bytes``: a text's ids, and the bytes read back from them.

    One pass: the same worker encodes a slice of texts and decodes its ids. Rows and nulls as in ``encode``.
    """
    def make() -> Callable[[list[str]], dict[str, list]]:
        encoder, table = worker_encoder(path, pattern), worker_bytes(path)

        def run(batch: list[str]) -> dict[str, list]:
            ids = encoder(batch)
            return {"ids": ids, "bytes": _decoded(table, ids)}

        return run

    tokens = map_texts(texts(docs, key, text), make, "ids binary, bytes binary", key)
    return tokens.select(key, F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), "ids", "bytes")


def digest(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``."""
    return tokens.select(key, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                         F.sha2("bytes", 256).alias("decoded_sha256"))

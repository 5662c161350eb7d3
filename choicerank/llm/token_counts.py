"""Token counts: the pieces of a distinct pre-token are counted once; documents only add up frequencies.

A task cuts its texts into units that no match of the tokenizer's pattern leaves, counts each document's units, has
the pieces of every unit not met before counted once by the library (each of its pre-tokens once), and adds
frequency times pieces. Neither ids nor pre-tokens of a document leave the task, so nothing is shuffled.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicerank.llm.bpe import UNITS, pieces_pattern
from choicerank.llm.common import KEEP, held, map_texts, texts


class PieceCounter:
    """Counts by a byte-level BPE file of the tokenizers library, special tokens included."""

    def __init__(self, path: str, pattern: str, keep: int = KEEP):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path) as file:
            described = json.load(file)
        if described["pre_tokenizer"]["type"] != "ByteLevel" or described["normalizer"]:
            raise ValueError("a tokenizer whose pre-tokens are matches of the pattern is needed")
        self.special = [t["content"] for t in described["added_tokens"]]
        self.tokenizer = Tokenizer.from_file(path)
        self.pattern = pieces_pattern(pattern)
        self.keep = keep
        self.units: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def learn(self, units: set[str]) -> None:
        cut = {u: self.pattern.findall(u) for u in units}
        new = list({w for pieces in cut.values() for w in pieces if w not in self.words})
        found = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        self.words.update(zip(new, map(len, found)))
        words = self.words
        self.units.update((u, sum([words[w] for w in pieces])) for u, pieces in cut.items())

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """A text's units, and how many special tokens stand in it."""
        if not any(s in text for s in self.special):
            return Counter(UNITS.findall(text)), 0
        # Whatever stands between special tokens is cut on its own, as the library does.
        import re

        parts = re.split("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))), text)
        return sum((Counter(UNITS.findall(p)) for p in parts), Counter()), len(parts) - 1

    def __call__(self, batch: list[str]) -> list[int]:
        counted = [self.frequencies(text) for text in batch]
        distinct = set().union(*(c for c, _ in counted))
        fresh = distinct.difference(self.units)
        if len(self.units) + len(fresh) > self.keep:
            self.units.clear()
            self.words.clear()
            fresh = distinct
        if fresh:
            self.learn(fresh)
        pieces = self.units
        return [special + sum([n * pieces[u] for u, n in freq.items()]) for freq, special in counted]


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 512, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """``key``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    A null text counts as empty: no bytes, no tokens. Rows with equal keys stay separate; other columns are not read.
    """

    def make() -> Callable[[list[str]], dict[str, list]]:
        memory = held("counts")
        if (path, pattern) not in memory:
            memory[path, pattern] = PieceCounter(path, pattern)
        counter = memory[path, pattern]
        return lambda batch: {"n_bytes": [len(t.encode()) for t in batch], "n_tokens": counter(batch)}

    rows = map_texts(texts(docs, key, text), make, "n_bytes bigint, n_tokens bigint", key)
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)

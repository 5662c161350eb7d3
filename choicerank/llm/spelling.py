"""Spelling variants of a corpus's words, found in a bit-sliced position index.

Words are counted over all documents. For near words (one code point inserted, deleted or replaced) the vocabulary is put
into blocks: with ``m`` the length of the shorter word, two near words have the same first ``m // 2`` code points or the
same last ``m - m // 2``, so a word stands under both affixes for its own length and, as the longer word, for one less. Affixes
are dealt by hash into blocks of about ``BLOCK`` words; an affix of more words is split into chunks, and every two chunks
are a block, so no task ever holds more than a few thousand words, whatever the affix.

Inside a block the words of length ``m`` are an index: for every (position, letter) a bitset of the words that have it. A query
word walks its letters and carries two bitsets of words: those that match so far without error, and those with one. The
second takes over survivors of the first where a letter differs, or, for longer queries, where it is left out, and reads the
index one position behind from there on. All queries of a length walk together, as rows of a matrix of 64-bit words.

A word's form is its most frequent near word if that is ``ratio`` times as frequent; forms are followed to their root by pointer
doubling, whose rounds are bounded as each form is ``ratio`` times as frequent.

Null and empty texts have no words. A null key is read as an empty one where a word is rewritten. Repeated rows count each time.
An empty table, or one without frequent words, gives an empty result. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicerank.llm.common import Work

LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words that an index holds, about.
BLOCK = 1024


def count_words(docs: DataFrame, rewrite: Callable[[Column, Column], Column] | None = None, key: str = "doc_id",
                text: str = "text", shortest: int = 6, least: int = 5) -> DataFrame:
    """``word``, ``n``: runs of letters of all texts, lower-cased, with at least ``shortest`` letters and ``least`` occurrences.

    ``rewrite`` makes the counted word from the key (as text) and the run.
    """
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(
        F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(LETTERS), F.lit(0))).alias("run"))
    word = rewrite(F.col("id"), F.col("run")) if rewrite else F.col("run")
    return (runs.select(word.alias("word")).filter(F.length("word") >= shortest)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least))


def drop_letters(every: int = 199) -> Callable[[Column, Column], Column]:
    """Damage for tests and the query: where ``every`` divides the crc32 of ``key:run``, one letter of the run goes."""

    def rewrite(key: Column, run: Column) -> Column:
        h = F.crc32(F.concat(key, F.lit(":"), run).cast("binary"))
        place = (h % F.length(run)).cast("int")
        return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), place),
                                               F.substring(run, place + 2, F.length(run)))).otherwise(run)

    return rewrite


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word``, ``near``, ``near_n``: every pair of near words of the table ``word``, ``n``, in both directions, each once."""
    work = Work(words.sparkSession)
    size = F.length("word")
    affixes = F.explode(F.array(*[F.struct(
        F.lit(side).alias("side"), m.alias("m"),
        (F.left("word", half) if side == "first" else F.right("word", m - half)).alias("affix"))
        for m, half in ((size, F.floor(size / 2).cast("int")), (size - 1, F.floor((size - 1) / 2).cast("int")))
        for side in ("first", "last")])).alias("a")
    rows = work.store(words.select("word", "n", affixes).select("word", "n", "a.*"), "affixes")
    blocks = max(1, rows.count() // block)
    crowded = work.store(rows.groupBy("side", "m", "affix").agg(F.count(F.lit(1)).alias("size"))
                         .filter(F.col("size") > block), "crowded")
    placed = (rows.join(crowded, ["side", "m", "affix"], "left")
              .withColumn("chunks", F.coalesce(F.ceil(F.col("size") / block), F.lit(1)).cast("int"))
              .withColumn("chunk", F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
              .select("side", "word", "n", "m", "chunk",
                      F.when(F.col("size").isNull(), F.pmod(F.xxhash64("m", "affix"), F.lit(blocks)).cast("string"))
                      .otherwise(F.concat(F.col("m").cast("string"), F.lit(" "), F.col("affix"))).alias("block"),
                      F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")))
    return placed.groupBy("side", "block", "i", "j").applyInPandas(_near_in_block, "word string, near string, near_n bigint")


def _near_in_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Near pairs of a block whose shorter word has a length that both rows name."""
    first, apart = rows["side"].iloc[0] == "first", rows["i"].iloc[0] != rows["j"].iloc[0]
    out = []
    for m, same in rows.groupby("m", sort=False):
        words, n, chunk = same["word"].to_list(), same["n"].to_numpy(), same["chunk"].to_numpy()
        lengths = np.array([len(w) for w in words])
        index = np.flatnonzero(lengths == m)
        table = Index([words[i] for i in index], m)
        for length in (m, m + 1):
            queries = np.flatnonzero(lengths == length)
            for q, i in zip(*table.near([words[i] for i in queries], length)):
                q, i = queries[q], index[i]
                a, b = words[q], words[i]
                # each pair counts once: under the first affix if that is the same, else under the last
                here = a[:m // 2] == b[:m // 2]
                if here != first or (not first and a[-(m - m // 2):] != b[-(m - m // 2):]) or apart != (chunk[q] != chunk[i]):
                    continue
                out.append((a, b, n[i]))
                if length > m:
                    out.append((b, a, n[q]))
    return pd.DataFrame(out, columns=["word", "near", "near_n"])


class Index:
    """Bitsets of words of one length by (position, letter)."""

    def __init__(self, words: list[str], length: int):
        self.n, self.length = len(words), length
        codes = _codes(words, length)
        self.letters = np.unique(codes)
        self.sets = np.zeros((length, len(self.letters) + 1, (self.n + 63) // 64 * 8), np.uint8)
        for k in range(length):
            for letter in np.unique(codes[:, k]):
                bits = np.packbits(codes[:, k] == letter, bitorder="little")
                self.sets[k, 1 + np.searchsorted(self.letters, letter), :len(bits)] = bits
        self.sets = self.sets.view(np.uint64)

    def near(self, words: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of queries (all of one length: the index's or one more) and of the words one error away."""
        if not words or not self.n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        codes = _codes(words, length)
        at = np.searchsorted(self.letters, codes)
        at = np.where(self.letters[np.minimum(at, len(self.letters) - 1)] == codes, at + 1, 0)  # row 0: no word
        shift = length - self.length
        none = np.full((len(words), self.sets.shape[2]), ~np.uint64(0))
        one = np.zeros_like(none)
        for k in range(length):
            here = self.sets[k][at[:, k]] if k < self.length else 0
            if shift:
                one = (one & self.sets[k - 1][at[:, k]] if k else one) | none
            else:
                one = (one & here) | (none & ~here)
            none = none & here
        found = np.unpackbits(one.view(np.uint8), axis=1, bitorder="little", count=self.n)
        return np.nonzero(found)


def _codes(words: list[str], length: int) -> np.ndarray:
    """Code points, a row a word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, length) if words else np.empty((0, length), np.uint32)


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of a table ``word``, ``n``."""
    work = Work(words.sparkSession)
    words = work.store(words, "words")
    near = near_pairs(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    better = -F.col("best.less") >= ratio * F.col("n")
    formed = work.store(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(better, F.col("best.near")).alias("form"), F.when(better, -F.col("best.less")).alias("form_n")), "forms")
    moves, step = work.store(formed.filter("form is not null").select("word", F.col("form").alias("root")), "roots-0"), 0
    top = words.agg(F.max("n")).first()[0] or 1
    for step in range(1, math.ceil(math.log2(max(1, math.log(top, ratio)) + 1)) + 1):  # a chain has at most log(top) forms
        after = moves.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moves = work.store(moves.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root")),
                           f"roots-{step}")
        work.release(f"roots-{step - 1}")
    return (formed.join(moves, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))

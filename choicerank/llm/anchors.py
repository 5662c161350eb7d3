"""SimHash near duplicates by anchor points: fingerprints a few bits apart meet at the words of a covering code.

A fingerprint of 64 bits is cut into blocks of 23, 23, 15 and 3 bits. The anchors are all 64-bit words whose blocks are words
of the Golay code, the Golay code, a Hamming code, and zero; each of these codes covers its block within 3, 3, 1 and 3 bits,
so every fingerprint has an anchor, its home, within 10 bits. If two fingerprints differ in at most ``t`` bits, these bits fall
into the blocks as t1 + t2 + ..., and the home of one lies within (radius + ti) of every block of the other. So each
fingerprint is replicated to the anchors within the covering radius plus ``t``, without those that no such split of ``t``
can reach (for t = 2 about 150 of 2**35), and the ones at home there are compared with the replicas. No pair is lost, none
is found twice, and different fingerprints that link to a given one number at most 2,080, so links stay linear in the input.

Equal fingerprints are one node; a table of distinct ones goes through the anchors. Codes are perfect, so a home is unique.

Null and empty texts and texts of white space have fingerprint zero and link like others. Rows with a null key get a
fingerprint and the smallest key of their component, null if nobody there has one. Repeated rows stay repeated. An
empty table gives an empty result. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicerank.llm.common import Work, map_texts
from choicerank.llm.components import components

SEED = 42

#: Bytes of a text that are split into words at one time.
PIECE = 1 << 20

#: Fingerprints that a task replicates at one time.
ROWS = 4096

#: Blocks from the lowest bit: bits, generator polynomial, covering radius. The bits above them are not part of an anchor.
BLOCKS = ((23, 0b110001110101, 3), (23, 0b110001110101, 3), (15, 0b10011, 1))


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a piece at a time."""
    begin = 0
    while begin < len(text):
        end = min(begin + PIECE, len(text))
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[begin:end].split()
        begin = end


def fingerprint(text: bytes, width: int = 3) -> int:
    """Majority of the bits of the 64-bit hashes of all shingles, as a signed integer."""
    ones, n, tail = np.zeros(64, np.int64), 0, []
    for words in _words(text.lower()):
        words = tail + words
        shingles = [b" ".join(s) for s in zip(*(words[k:] for k in range(width)))]
        if len(words) < width:
            tail = words
            continue
        tail = words[len(words) - width + 1:]
        ones += _ones(shingles)
        n += len(shingles)
    if not n and tail:
        ones, n = _ones([b" ".join(tail)]), 1
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def _ones(shingles: list[bytes]) -> np.ndarray:
    """How many hashes have each bit, the highest first."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), ">u8", len(shingles))
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


class Code:
    """A perfect cyclic code of a block, with the error patterns of up to ``radius + extra`` bits by syndrome."""

    def __init__(self, bits: int, generator: int, radius: int, extra: int):
        self.check = generator.bit_length() - 1
        rest, residues = 1, []
        for _ in range(bits):
            residues.append(rest)
            rest <<= 1
            if rest >> self.check:
                rest ^= generator
        self.residues = np.array(residues, np.int64)
        self.bits = bits
        self.levels = []
        for excess in range(extra + 1):
            weights = range(radius + 1) if excess == 0 else (radius + excess,)
            places = [c for w in weights for c in combinations(range(bits), w)]
            patterns = np.array([sum(1 << i for i in c) for c in places], np.int64)
            syndromes = self.syndrome(patterns)
            order = syndromes.argsort(kind="stable")
            counts = np.bincount(syndromes, minlength=1 << self.check)
            self.levels.append((patterns[order], counts, counts.cumsum() - counts))

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        for i, residue in enumerate(self.residues):
            out ^= ((words >> i) & 1) * residue
        return out

    def errors(self, syndromes: np.ndarray, excess: int) -> tuple[np.ndarray, np.ndarray]:
        """For each syndrome its patterns of that excess: positions in ``syndromes`` and patterns."""
        patterns, counts, starts = self.levels[excess]
        n = counts[syndromes]
        rows = np.repeat(np.arange(len(syndromes)), n)
        within = np.arange(len(rows)) - np.repeat(n.cumsum() - n, n)
        return rows, patterns[starts[syndromes][rows] + within]


def codes(extra: int) -> list[Code]:
    return [Code(*block, extra) for block in BLOCKS]


def anchors(prints: np.ndarray, known: list[Code], extra: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Anchors of 64-bit fingerprints: positions in ``prints`` and anchors; ``extra = 0`` gives the homes."""
    kept = np.int64((1 << sum(c.bits for c in known)) - 1)
    shifts = np.cumsum([0] + [c.bits for c in known[:-1]])
    syndromes = [c.syndrome((prints >> s) & ((1 << c.bits) - 1)) for c, s in zip(known, shifts)]
    for split in product(range(extra + 1), repeat=len(known)):
        if sum(split) > extra:
            continue
        rows, found = np.arange(len(prints)), prints & kept
        for code, shift, syndrome, excess in zip(known, shifts, syndromes, split):
            again, pattern = code.errors(syndrome[rows], excess)
            rows, found = rows[again], found[again] ^ (pattern << shift)
        yield rows, found


def at_anchors(prints: DataFrame, extra: int, name: str) -> DataFrame:
    """``anchor`` and the fingerprint (as ``name``) of a table with the column ``fp``, once per anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codes(extra)
        for batch in batches:
            every = batch.column(0).to_numpy()
            for begin in range(0, len(every), ROWS):
                part = every[begin:begin + ROWS]
                for rows, found in anchors(part, known, extra):
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(part[rows])], ["anchor", name])

    return prints.select("fp").mapInArrow(run, f"anchor bigint, {name} bigint")


def links(prints: DataFrame, bits: int = 2) -> DataFrame:
    """Pairs ``a < b`` of the distinct fingerprints ``fp`` that differ in at most ``bits`` bits, each once.

    Always joined by shuffle: Spark sizes the replicas like the fingerprints they come from and would broadcast them.
    """
    homes, replicas = at_anchors(prints, 0, "a"), at_anchors(prints, bits, "b")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    return homes.join(replicas.hint("merge"), (homes.anchor == replicas.anchor) & close).select("a", "b")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """Key and ``fp``, the fingerprint of the whole text as a signed integer."""
    whole = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return map_texts(whole, lambda: lambda found: {"fp": [fingerprint(t, width) for t in found]}, "fp bigint", key)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, bits: int = 2) -> DataFrame:
    """Key, ``fingerprint`` (hex) and ``component_id``, the smallest key that links of up to ``bits`` bits reach."""
    work = Work(docs.sparkSession)
    named = fingerprints(docs, key, text, width).withColumnRenamed(key, "id")
    prints = work.store(named, "prints")
    heads = work.store(prints.groupBy("fp").agg(F.min("id").alias("least")), "heads")
    linked = components(links(heads, bits), work, "linked")
    member = work.store(heads.join(linked, heads.fp == linked.node, "left")
                        .select("fp", "least", F.coalesce("component", "fp").alias("head")), "members")
    least = work.store(member.groupBy("head").agg(F.min("least").alias("component_id")), "least")
    ids = work.store(member.join(least, "head").select("fp", "component_id"), "ids")
    work.release("heads", "members", "least")
    return prints.join(ids, "fp").select(F.col("id").alias(key),
                                         F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

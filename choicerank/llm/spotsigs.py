"""Document fingerprints from spot signatures: chains of content words that follow common words.

Every common word (anchor) of a text gives one signature: the anchor and the next ``CHAIN`` words that are no anchors.
A text's fingerprint is the set of its signatures. Fingerprints are compared through a Jaccard likeness that is pruned by
the sizes of the sets; for a search they are partitioned by size, so that a set meets only partitions that its likeness
can reach.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from choicerank.llm.common import KEEP, Work, held, map_texts, slices, texts

CHAIN = 3
#: Bits of a signature, as ten hexadecimal digits in a fingerprint.
BITS = 40

# Common words of four languages that serve as anchors.
ANCHORS = frozenset((
    "a an and are as at be by for from in is it of on or that the this to was with "
    "auf das dem den der des die ein eine im ist mit nicht und von zu "
    "au aux de des du en est et la le les par pour que qui sur un une "
    "al con del el en es la las lo los para por que se su un una y").split())

_WORD = re.compile(r"[^\W_]+")


def signatures(text: str) -> np.ndarray:
    """Sorted distinct signatures of a text.

    A text without a whole chain is one signature of all its words, a text without words one of its characters, an
    empty text has none.
    """
    import xxhash

    if not text:
        return np.empty(0, np.int64)
    memory: dict[str, tuple[int, bool]] = held("spots").setdefault("words", {})
    if len(memory) > KEEP:
        memory.clear()
    codes, marks = [], []
    for word in _WORD.findall(text.lower()):
        known = memory.get(word)
        if known is None:
            known = memory[word] = (xxhash.xxh3_64_intdigest(word), word in ANCHORS)
        codes.append(known[0])
        marks.append(known[1])
    words, anchor = np.array(codes, np.uint64), np.array(marks, bool)
    content = words[~anchor]
    follows = np.cumsum(~anchor)[anchor]  # content words before each anchor
    whole = follows + CHAIN <= len(content)
    if not whole.any():
        seed = words.tobytes() if len(words) else text.encode()
        return np.array([xxhash.xxh3_64_intdigest(seed) >> (64 - BITS)], np.int64)
    total, follows = words[anchor][whole], follows[whole]
    for k in range(CHAIN):
        total = (total ^ (total >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + content[follows + k]
    total = (total ^ (total >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(total >> np.uint64(64 - BITS)).astype(np.int64)


def fingerprint(found: np.ndarray) -> str:
    return "".join(f"{x:010x}" for x in found.tolist())


def likeness(a: np.ndarray, b: np.ndarray, floor: float = 0.0) -> float:
    """Jaccard likeness of two sorted sets, 0 where sizes alone keep it below ``floor``; equal sets have 1."""
    small, large = sorted((len(a), len(b)))
    if large == 0:
        return 1.0
    if small < floor * large or small == 0:
        return 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    found = shared / (small + large - shared)
    return found if found >= floor else 0.0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``signatures``, ``fingerprint`` of whole texts; a null text is empty. Other columns are not read."""

    def make() -> Callable[[list[str]], dict[str, list]]:
        def run(batch: list[str]) -> dict[str, list]:
            found = [signatures(t) for t in batch]
            return {"signatures": found, "fingerprint": [fingerprint(x) for x in found]}

        return run

    return map_texts(texts(docs, key, text), make, "signatures array<bigint>, fingerprint string", key)


def similar(docs: DataFrame, floor: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``a``, ``b``, ``likeness``: pairs of different fingerprints that are alike by ``floor`` or more.

    ``a`` and ``b`` are the smallest keys of their fingerprints; membership follows from ``fingerprints``. Keys are whole
    numbers, rows without one are left out; texts without signatures are alike nothing.
    """
    work = Work(docs.sparkSession)
    sets = (fingerprints(docs, key, text).filter(F.col(key).isNotNull() & (F.size("signatures") > 0))
            .groupBy(F.sha2("fingerprint", 256).alias("digest"))
            .agg(F.min(F.col(key).cast("bigint")).alias("node"), F.first("signatures").alias("s")))
    sets = work.store(sets.select("node", "s", F.size("s").alias("n")), "sets")
    seen = sets.select(F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("f")).filter("f > 1")
    # Two sets alike by p share one of the n - ceil(p n) + 1 rarest of either; what only one set has is rarest of all.
    ranked = (sets.select("node", "n", F.explode("s").alias("h")).join(seen, "h").groupBy("node", "n")
              .agg(F.array_sort(F.collect_list(F.struct("f", "h"))).alias("order")))
    spare = F.col("n") - F.ceil(F.col("n") * floor).cast("int") + 1 - (F.col("n") - F.size("order"))
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(-np.log(floor))).cast("int")
    first = (ranked.filter(spare > 0).withColumn("part", part)
             .select("node", "n", "part", F.explode(F.slice("order", 1, spare)).alias("at"))
             .select("node", "n", "part", F.col("at.h").alias("h")))
    near = first.select(F.col("node").alias("b"), F.col("n").alias("m"), "h",
                        F.explode(F.array("part", F.col("part") - 1)).alias("part"))
    met = (first.join(near, ["part", "h"]).filter("node != b and m >= n and n >= m * %r" % floor)
           .select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct())
    met = work.store(met, "met")
    shared = F.size(F.array_intersect("x", "y"))
    return (met.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
            .withColumn("shared", shared)
            .select("a", "b", (F.col("shared") / (F.size("x") + F.size("y") - F.col("shared"))).alias("likeness"))
            .filter(F.col("likeness") >= floor))


_RESULT = ("key bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")
_RESULT_TYPES = [("key", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                 ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
                 ("near_next", pa.float64())]
#: Ranges of the key a shuffle partition, so that partitions are even and adaptive execution can join small ones.
RANGES = 4


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many characters from the beginning of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compared(key, text: str, following: str, own: np.ndarray, other: np.ndarray) -> tuple:
    changed = edited(text, following)
    mixed = signatures(changed)
    return (key, len(text), hashlib.sha256(changed.encode()).hexdigest(), fingerprint(own), fingerprint(mixed),
            likeness(own, mixed), likeness(own, other))


def _in_ranges(rows: DataFrame, ranges: int) -> DataFrame:
    """Column ``part``: the range of a row's key, higher for higher keys; -1 without a key.

    The bounds are approximate quantiles of all keys, at most ``ranges`` of them. Whatever they are, the rows of a part lie
    together in the order of the key.
    """
    places = [i / ranges for i in range(1, ranges)]
    bounds = rows.agg(F.percentile_approx("key", places, 100 * ranges)).first()[0]
    splits = [-np.inf, *sorted(set(map(float, bounds or [0]))), np.inf]
    value = F.coalesce(F.col("key").cast("double"), F.lit(0.0))
    found = Bucketizer(splits=splits, inputCol="value", outputCol="range").transform(rows.withColumn("value", value))
    part = F.when(F.col("key").isNull(), -1).otherwise(F.col("range").cast("int"))
    return found.select("key", "text", part.alias("part"))


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document against its own edited text and against the next document in descending order of the key.

    Gives ``key``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and
    ``near_next``. The first document follows the last one, so a lone document follows itself. Null texts are empty; rows
    with equal keys are ordered by text, rows without a key come last.

    Texts are shuffled once, by ranges of the key, and nothing is stored. Each range also gets the first document of the
    range that follows it, found by two scans of the keys and one of the texts, so that a task that walks over the sorted
    rows of a range has all that it compares.
    """
    spark = docs.sparkSession
    rows = _in_ranges(texts(docs, key, text).select(F.col(key).cast("bigint").alias("key"), "text"),
                      RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    # A row a range, without texts: the windows are over as many rows as there are ranges.
    tops = rows.groupBy("part").agg(F.max("key").alias("top"))
    before = F.lag("part").over(Window.orderBy(F.desc("part")))
    tops = tops.select(F.col("part").alias("of"), "top", F.coalesce(before, F.min("part").over(Window.partitionBy()))
                       .alias("to"))
    heads = (rows.join(F.broadcast(tops), (F.col("part") == F.col("of")) & F.col("key").eqNullSafe(F.col("top")))
             .groupBy("to", "key").agg(F.max("text").alias("text")))
    walked = rows.select("part", F.lit(0).alias("tail"), "key", "text").union(
        heads.select(F.col("to").alias("part"), F.lit(1).alias("tail"), "key", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for piece in slices(batch):
                out = []
                for tail, k, t in zip(*(piece.column(c).to_pylist() for c in ("tail", "key", "text"))):
                    own = signatures(t)
                    if last is not None:
                        out.append(_compared(last[0], last[1], t, last[2], own))
                    last = None if tail else (k, t, own)
                columns = list(zip(*out)) or [()] * len(_RESULT_TYPES)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _RESULT_TYPES)],
                                                 [name for name, _ in _RESULT_TYPES])

    # The row with a tail ends its range, so a walk never goes from one range to another.
    walked = walked.repartition("part").sortWithinPartitions("part", "tail", F.desc("key"), F.desc("text"))
    return walked.mapInArrow(run, _RESULT).withColumnRenamed("key", key)

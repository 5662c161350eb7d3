"""Near-duplicate documents by an LSH forest over MinHash signatures of word shingles.

1. A document's words are cut at ASCII white space; its set is its distinct shingles as 64-bit hashes. Documents with the
   same set form a class; from here on only one document a class takes part.
2. A signature is ``TREES * DEPTH`` minimum hashes. Each tree is one sorted order of the signatures by its own ``DEPTH`` of
   them: rows are range-partitioned and sorted, and a task walks over its rows once. Candidates are neighbours with the
   longest common prefixes: of each row those ``NEIGHBOURS`` before it that share at least the first hash. Depth so adapts
   to the region: where few documents share a prefix the neighbours reach down to depth 1. In a crowded region, where the
   whole window shares it, a row's candidates are the one next to it and the one that agrees with it most, and the rows
   of the whole region are crowded.
3. Links are confirmed on the full sets. As only classes are asked for, a candidate inside a component that is
   already linked needs no look: in every round each component confirms its likeliest candidate to another one, the
   components are formed anew, and when few candidates are left all of them are confirmed. No candidate between different
   components is dropped.
4. All crowded documents, and those of components that do not fit a window with their borders, are joined with each other
   by their rarest shingles, so that the windows only save work there.

Nothing collects a group: a group of copies is one class, a group of near copies lies along the sorted orders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicerank.llm.common import KEEP, Work, held, map_texts, texts
from choicerank.llm.components import components

WORDS = 5
TREES, DEPTH = 16, 6
NEIGHBOURS = 8
#: Pairs whose signatures agree in a smaller share of places are no candidates: 3.4 standard deviations below 0.75.
LEAST_AGREEMENT = 0.6

_MULTIPLIERS = np.random.default_rng(20).integers(1, 1 << 63, TREES * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles: ASCII lower case, ASCII white space.

    A text of fewer words is one shingle; one without words has none.
    """
    import xxhash

    found = text.encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    known: dict[bytes, int] = held("forest").setdefault("words", {})
    if len(known) > KEEP:
        known.clear()
    codes = []
    for word in found:
        code = known.get(word)
        if code is None:
            code = known[word] = xxhash.xxh3_64_intdigest(word)
        codes.append(code)
    hashes = np.array(codes, np.uint64)
    width = min(words, len(hashes))
    count = len(hashes) - width + 1
    total = np.full(count, width, np.uint64)
    for k in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + count]
        total ^= total >> np.uint64(29)
    return np.unique(_mixed(total))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minimum of each hash function, as unsigned 32-bit integers."""
    best = np.full(len(_MULTIPLIERS), 0xFFFFFFFF, np.uint64)
    for k in range(0, len(hashes), 4096):
        part = (hashes[k:k + 4096] * _MULTIPLIERS[:, None]) >> np.uint64(32)
        best = np.minimum(best, part.min(axis=1))
    return best.astype(">u4")


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``key``, ``n_shingles``, ``digest`` of the set, ``signature`` and ``sketch`` (nulls without shingles)."""
    import hashlib

    def make() -> Callable[[list[str]], dict[str, list]]:
        def run(batch: list[str]) -> dict[str, list]:
            sets = [shingle_hashes(t, words) for t in batch]
            signed = [signature(s) if len(s) else None for s in sets]
            return {"n_shingles": [len(s) for s in sets],
                    "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                    "signature": [s.tobytes() if s is not None else None for s in signed],
                    "sketch": [(s & 255).astype(np.uint8).tobytes() if s is not None else None for s in signed]}

        return run

    return map_texts(texts(docs, key, text), make, "n_shingles bigint, digest binary, signature binary, sketch binary", key)


def shingle_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``key``, ``hashes``: the whole set as signed 64-bit integers."""

    def make() -> Callable[[list[str]], dict[str, list]]:
        return lambda batch: {"hashes": [shingle_hashes(t, words).view(np.int64) for t in batch]}

    return map_texts(texts(docs, key, text), make, "hashes array<bigint>", key)


def _neighbours(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk over sorted rows; gives pairs, and a task's first and last rows for the seams between tasks."""
    held: tuple | None = None
    tail: pa.RecordBatch | None = None
    began = False
    for batch in rows:
        n = batch.num_rows
        if not n:
            continue
        node = np.array(batch.column("node"), np.int64)
        tree = np.array(batch.column("tree"), np.int32)
        first = _matrix(batch.column("prefix"), ">u4")[:, 0].astype(np.int64)
        bytes_ = _matrix(batch.column("sketch"), np.uint8)
        if not began:
            began = True
            yield _seam(batch.slice(0, NEIGHBOURS))
        last = batch if tail is None else pa.concat_batches([tail, batch])
        tail = last.slice(max(0, last.num_rows - NEIGHBOURS))
        if held is not None:
            node, tree, first, bytes_ = (np.concatenate(x) for x in zip(held, (node, tree, first, bytes_)))
        fresh = len(node) - n
        agreed = np.zeros((NEIGHBOURS, len(node)))
        together = np.zeros((NEIGHBOURS, len(node)), bool)
        for lag in range(1, min(NEIGHBOURS, len(node) - 1) + 1):
            at = np.arange(max(lag, fresh), len(node))
            at = at[(tree[at] == tree[at - lag]) & (first[at] == first[at - lag])]
            together[lag - 1, at] = True
            same = (bytes_[at] == bytes_[at - lag]).mean(axis=1)
            agreed[lag - 1, at] = (same - 1 / 256) / (255 / 256)  # bytes of different hashes are equal now and then
        chosen = agreed >= LEAST_AGREEMENT
        crowded = together[-1]
        chosen[1:, crowded] &= (agreed == agreed.max(axis=0))[1:, crowded]
        lag, at = np.nonzero(chosen)
        low, high = np.minimum(node[at], node[at - lag - 1]), np.maximum(node[at], node[at - lag - 1])
        good = low != high
        yield _pairs(low[good], high[good], agreed[lag, at][good])
        region = np.unique(node[np.add.outer(np.nonzero(crowded)[0], -np.arange(NEIGHBOURS + 1))])
        yield _pairs(region, region, np.zeros(len(region)))  # a row with itself: crowded
        held = tuple(x[-NEIGHBOURS:] for x in (node, tree, first, bytes_))
    if tail is not None:
        yield _seam(tail)


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


_PAIR = "a bigint, b bigint, agree double, node bigint, tree int, prefix binary, sketch binary"
_NAMES = ["a", "b", "agree", "node", "tree", "prefix", "sketch"]


def _pairs(a: np.ndarray, b: np.ndarray, agree: np.ndarray) -> pa.RecordBatch:
    empty = [pa.nulls(len(a), t) for t in (pa.int64(), pa.int32(), pa.binary(), pa.binary())]
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(agree, pa.float64()), *empty], _NAMES)


def _seam(rows: pa.RecordBatch) -> pa.RecordBatch:
    empty = [pa.nulls(rows.num_rows, t) for t in (pa.int64(), pa.int64(), pa.float64())]
    return pa.RecordBatch.from_arrays([*empty, *(rows.column(n) for n in _NAMES[3:])], _NAMES)


def candidates(nodes: DataFrame, work: Work) -> tuple[DataFrame, DataFrame]:
    """``a``, ``b``, ``agree`` of ``nodes`` (``node``, ``signature``, ``sketch``): neighbours in some tree.

    Also the ``node`` of those that share a first hash with more rows than a window has. A sketch has one byte of each
    hash, enough to tell how many agree.
    """
    prefix = F.expr(f"substring(signature, tree * {4 * DEPTH} + 1, {4 * DEPTH})")
    rows = nodes.select("node", "sketch", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    order = ["tree", "prefix", "node"]
    rows = rows.select("node", "tree", prefix.alias("prefix"), "sketch")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = work.store(rows.mapInArrow(_neighbours, _PAIR), "neighbours")
    # A few rows a task: what lies on either side of a seam.
    seams = (found.filter("node is not null").select("node", "tree", "prefix", "sketch").distinct()
             .coalesce(1).sortWithinPartitions(*order).mapInArrow(_neighbours, _PAIR))
    pairs = found.select("a", "b", "agree").union(seams.select("a", "b", "agree")).filter("a is not null")
    crowded = work.store(pairs.filter("a = b").select(F.col("a").alias("node")).distinct(), "crowded")
    return work.store(pairs.filter("a < b").groupBy("a", "b").agg(F.max("agree").alias("agree")), "pairs"), crowded


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of ``a``, ``b`` whose full sets are alike enough."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return (pairs.join(left, "a").join(right, "b").withColumn("shared", shared)
            .filter(100 * F.col("shared") >= percent * (F.size("x") + F.size("y") - F.col("shared"))).select("a", "b"))


def _between(pairs: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Pairs whose ends lie in different components, with those components."""
    if groups is None:
        return pairs.select("a", "b", "agree", F.col("a").alias("ga"), F.col("b").alias("gb"))
    for end in "ab":
        mine = groups.select(F.col("node").alias(end), F.col("component").alias(f"g{end}"))
        pairs = pairs.drop(f"g{end}").join(mine, end, "left").withColumn(
            f"g{end}", F.coalesce(f"g{end}", end))
    return pairs.filter("ga != gb").select("a", "b", "agree", "ga", "gb")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75,
                    words: int = WORDS) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` (smallest key reachable over links), ``kept`` (it is that key).

    Documents are linked if their sets of shingles have a Jaccard likeness of ``percent`` / 100 or more. Keys are whole
    numbers. A null text is empty; a document without words is linked with nothing and kept. Rows with equal keys count
    as one document; a row without a key is kept, with no component. Other columns are not read. No rows give no rows.
    """
    work = Work(docs.sparkSession)
    rows = docs.select(F.col(key).cast("bigint").alias("node"), F.col(text).alias("text"))
    signed = work.store(signatures(rows, "node"), "signatures")
    classes = signed.filter("node is not null and digest is not null").groupBy("digest").agg(
        F.min("node").alias("class"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch"),
        F.count("*").alias("copies"))
    classes = work.store(classes, "classes")
    pairs, crowded = candidates(classes.select(F.col("class").alias("node"), "signature", "sketch"), work)
    work.release("neighbours")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(crowded).distinct()
    sets = work.store(shingle_sets(rows.join(wanted, "node", "left_semi"), "node", words=words), "sets")
    links, groups = _linked(pairs, sets, work, percent)
    groups = _bridged(pairs, crowded, links, groups, sets, work, percent)
    copies = classes.filter("copies > 1").select("digest", "class")
    found = (signed.select("node", "n_shingles", "digest").join(copies, "digest", "left")
             .withColumn("class", F.coalesce("class", "node"))
             .join(groups.select(F.col("node").alias("class"), "component"), "class", "left"))
    component = F.when(F.col("node").isNotNull(), F.coalesce("component", "class"))
    return found.select(F.col("node").alias(key), "n_shingles", component.alias("component_id"),
                        F.coalesce(F.col("node") == component, F.lit(True)).alias("kept"))


def _linked(pairs: DataFrame, sets: DataFrame, work: Work, percent: int) -> tuple[DataFrame, DataFrame]:
    """The confirmed links, and the components they form."""
    links, groups, left, turn = None, None, pairs, 0
    nodes = sets.count()
    count = pairs.count()
    left = _between(left, None)
    while True:
        every = count <= 3 * nodes
        if every:
            chosen = left
        else:
            best = F.max(F.struct("agree", (-F.col("a")).alias("na"), (-F.col("b")).alias("nb")))
            ends = left.select(F.explode(F.array("ga", "gb")).alias("g"), "agree", "a", "b")
            chosen = ends.groupBy("g").agg(best.alias("best")).select(
                (-F.col("best.na")).alias("a"), (-F.col("best.nb")).alias("b")).distinct()
            chosen = work.store(chosen, f"chosen-{turn}")
        fresh = confirmed(chosen.select("a", "b"), sets, percent)
        links = work.store(fresh if links is None else links.union(fresh), f"links-{turn}")
        groups = components(links, work, f"groups-{turn}")
        if every:
            return links, groups
        left = left.join(chosen, ["a", "b"], "left_anti")
        left = work.store(_between(left, groups), f"left-{turn}")
        fewer = left.count()
        # When rounds gain little, the rest is confirmed at once.
        count = 0 if fewer > 0.8 * count else fewer
        turn += 1


def _bridged(pairs: DataFrame, crowded: DataFrame, links: DataFrame, groups: DataFrame, sets: DataFrame, work: Work,
             percent: int) -> DataFrame:
    """Components once all crowded nodes were held against each other.

    In a crowd more nodes share a prefix than a window has places, and a node may be like a few of them only. Crowded are
    the regions that do not fit a window, and the components that do not with the nodes at their borders (those with a
    candidate into them that was not confirmed). Their nodes are joined by their rarest shingles: two sets that are alike
    by p share one of the first n - ceil(p n) + 1 of both, and as many more behind the first they share as p asks for. As
    only components are asked for, shingles of a single component come first and join nothing, and nodes of the component
    with most nodes at a shingle are not joined with each other; all others are joined with it first, as this leaves less.
    """
    # components() names a component by its smallest node without listing that node.
    members = groups.select("node", "component").union(
        groups.select(F.col("component").alias("node"), "component").distinct())
    large = members.groupBy("component").agg(F.count("*").alias("size")).filter(F.col("size") > NEIGHBOURS)
    border = _between(pairs, groups).select(F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.col("gb").alias("component")),
        F.struct(F.col("b").alias("node"), F.col("ga").alias("component")))).alias("at")).select("at.*")
    border = border.join(large, "component", "left_semi")
    inside = members.join(border, "component", "left_semi")
    crowded = crowded.union(border.select("node")).union(inside.select("node")).distinct()

    shingles = (_grouped(crowded, groups).join(sets, "node")
                .select("node", "g", F.size("hashes").alias("n"), F.explode("hashes").alias("h")))
    spread = (shingles.groupBy("h").agg(F.count("*").alias("f"), F.min("g").alias("low"), F.max("g").alias("high"))
              .filter("low != high").select("h", "f"))
    rare = (shingles.join(spread, "h").groupBy("node", "n")
            .agg(F.array_sort(F.collect_list(F.struct("f", "h"))).alias("order"))
            .select("node", "n", F.size("order").alias("k"), F.posexplode("order").alias("i", "at"))
            .select("node", "n", (F.col("n") - F.col("k") + F.col("i")).alias("i"), F.col("at.h").alias("h"))
            .filter(f"i <= n - (n * {percent} + 99) div 100"))
    rare = work.store(rare, "rare")
    tried = pairs.select("a", "b")
    for whole in (False, True):
        rows = _grouped(rare, groups)
        most = (rows.groupBy("h", "g").agg(F.count("*").alias("c")).groupBy("h")
                .agg(F.max(F.struct("c", "g")).alias("most"), F.count("*").alias("different"))
                .filter("different > 1").select("h", F.col("most.g").alias("most")))
        rows = work.store(rows.join(most, "h").withColumn("own", F.col("g") != F.col("most")).drop("most"), f"rows-{whole}")
        left = rows.filter("own").select("h", F.col("node").alias("x"), F.col("n").alias("m"), F.col("i").alias("j"),
                                         F.col("g").alias("gx"))
        right = rows if whole else rows.filter("not own")
        met = (left.join(right, "h").filter(f"gx != g and (not own or x < node) and "
                                            f"least(n - i, m - j) * {100 + percent} >= {percent} * (n + m)")
               .select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct())
        met = work.store(met.join(tried, ["a", "b"], "left_anti"), f"met-{whole}")
        work.release(f"rows-{whole}")
        fresh = work.store(confirmed(met, sets, percent), f"bridged-{whole}")
        if not fresh.isEmpty():
            tried, links = tried.union(met), links.union(fresh)
            groups = components(links, work, f"bridged-groups-{whole}")
    return groups


def _grouped(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """``nodes`` with their component as ``g``; a node without a link is its own."""
    return nodes.join(groups, "node", "left").withColumn("g", F.coalesce("component", "node")).drop("component")

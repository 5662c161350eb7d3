"""Benchmark passages in documents, with edits: q-gram lemma filtering, then banded alignment.

An item of m characters that stands in a text with at most k edits shares at least m - q + 1 - k q of its q-grams with it,
and all of them lie within k diagonals (place in the text minus place in the item). So for each item the shared q-grams are
counted in bands of 2k + 1 diagonals that overlap by k; bands that meet the bound are aligned inside the band, with
free ends in the text. Of any k q + t q-grams of the item, t are left in the same way, so the rarest of them are counted
first, and all q-grams only for items that these leave.

An item may also stand in a text in part: without a sentence, or cut by the text's end. So of items longer than ``WINDOW``
characters, windows of that size that overlap by half, the last at the item's end, are searched in the same way.

The items are read in chunks of bounded size, and each chunk is what tasks get as an index; documents are scanned once a
chunk and never shuffled. Text is compared in lower case with runs of white space as one space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicerank.llm.common import slices, texts

Q = 6
#: Edits allowed, as a share of an item's (or a window's) characters.
EDITS = 0.12
#: Characters of an item that count as its passage also without the rest.
WINDOW = 80
#: Of the q-grams that the lemma asks for, the share that the rarest q-grams of an entry must have before all are counted.
#: It decides how much is counted, never what is found.
SURE = 0.5
#: Bytes of items in one index.
CHUNK_BYTES = 4_000_000

FIELDS = "item_id bigint, begin bigint, end bigint, edits bigint"


def normalized(text: str) -> str:
    return " ".join(text.lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of every run of q characters. Equal hashes of different runs only add work."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total, size, power = codes.astype(np.uint64), 1, np.uint64(0x100000001B3)
    for bit in bin(q)[3:]:  # runs of twice as many characters, and one more where q has the bit
        with np.errstate(over="ignore"):
            total, size, power = total[:-size] * power + total[size:], 2 * size, power * power
            if bit == "1":
                base = np.uint64(0x100000001B3)
                total, size, power = total[:-1] * base + codes[size:], size + 1, power * base
    return (total * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(8)


def budget(size: int, edits: float, q: int) -> int:
    """Edits allowed for an item: the share asked for, or less where the lemma would ask for no q-gram at all."""
    return max(0, min(int(edits * size), (size - q) // q))


class Postings:
    """Where q-grams stand in the entries of an index."""

    BITS = 19

    def __init__(self, grams: np.ndarray, item: np.ndarray, place: np.ndarray):
        order = np.argsort(grams, kind="stable")
        self.grams, starts = np.unique(grams[order], return_index=True)
        self.starts = np.r_[starts, len(grams)]
        self.many = np.diff(self.starts)
        self.item, self.place = item[order].astype(np.intp), place[order].astype(np.intp)
        self.ended = np.append(self.grams, np.uint64(0xFFFFFFFFFFFFFFFF))  # no q-gram is above the last
        # The q-grams of a slot stand together, so a slot's first one and the most that a slot has are all that is needed.
        slots = self._slot(self.grams)
        self.first = np.full(1 << self.BITS, -1, np.int32)
        self.first[slots[::-1]] = np.arange(len(slots), dtype=np.int32)[::-1]
        self.deepest = int(np.bincount(slots).max()) if len(slots) else 0

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return (grams >> np.uint64(56 - self.BITS)).astype(np.int64)

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Postings that a text's q-grams meet, in the order of the text; the q-grams' places, and how many each meets."""
        first = self.first[self._slot(grams)]
        at = np.flatnonzero(first >= 0)
        slot, wanted = first[at].astype(np.intp), grams[at]
        for _ in range(self.deepest - 1):
            slot += self.ended[slot] < wanted
        same = np.flatnonzero(self.ended[slot] == wanted)
        at, slot = at[same], slot[same]
        many = self.many[slot]
        hit = np.repeat(self.starts[slot] - np.cumsum(many) + many, many)
        hit += np.arange(len(hit))
        return hit, at, many

    def of(self, grams: np.ndarray, wanted: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, ...]:
        """Entry, place in the entry and diagonal of the hits of the entries that ``wanted`` marks, given all hits' entries."""
        hit, at, many = self.hits(grams)
        item = self.item[hit]
        stay = np.flatnonzero(wanted(item)[item])
        place = self.place[hit[stay]]
        return item[stay], place, np.repeat(at, many)[stay] - place


class Index:
    """The q-grams of a chunk of items."""

    #: Bands counted in an array; more are sorted instead.
    CELLS = 4_000_000
    #: Bands are first counted by the last bits of their numbers: what is too few there is too few in the band.
    SLOTS = 1 << 16

    def __init__(self, items: list[tuple[int, str]], q: int = Q, edits: float = EDITS, window: int = 0):
        """With ``window``, windows of so many characters of longer items are entries as well."""
        self.q = q
        self.items, self.plain, self.whole = [], [], []  # whole: the entry of the item that an entry is a window of
        grams, item, place = [], [], []
        for key, text in items:
            plain = normalized(text or "")
            if not plain:
                continue
            whole, last = len(self.items), len(plain) - window
            windows = [plain[b:b + window] for b in (*range(0, last, max(1, window // 2)), last)] if 0 < window < len(plain) else []
            for part in (plain, *windows):
                codes = _codes(part)
                self.plain.append(part)
                self.whole.append(whole)
                grams.append(_grams(codes, q))
                item.append(np.full(len(grams[-1]), len(self.items), np.int32))
                place.append(np.arange(len(grams[-1]), dtype=np.int32))
                self.items.append((key, codes, budget(len(codes), edits, q)))
        grams = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        item = np.concatenate(item) if item else np.empty(0, np.int32)
        place = np.concatenate(place) if place else np.empty(0, np.int32)
        self.sizes = np.array([len(c) for _, c, _ in self.items], np.int64)
        self.budgets = np.array([k for _, _, k in self.items], np.int64)
        self.need = self.sizes - q + 1 - self.budgets * q
        self.step = self.budgets + 1
        self.below = self.sizes // self.step + 2
        self.shift = self.below * self.step
        self.all = Postings(grams, item, place)
        # Of k q + t of an entry's q-grams, k edits leave at least t.
        self.least = np.maximum(1, (SURE * self.need).astype(np.int64))
        common = np.diff(self.all.starts)[np.searchsorted(self.all.grams, grams)] if len(grams) else item
        order = np.lexsort((place, common, item))
        first = np.searchsorted(item[order], np.arange(len(self.items)))
        rarity = np.arange(len(order)) - first[item[order]]
        chosen = order[rarity < (self.budgets * q + self.least)[item[order]]]
        self.rare = Postings(grams[chosen], item[chosen], place[chosen])
        # An item shorter than q characters has no q-gram: it is looked for as it is, between other characters.
        self.short = [(key, codes) for key, codes, _ in self.items if len(codes) < q]

    def _cells(self, item: np.ndarray, diagonal: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
        """The two bands (numbers from ``base`` on) that a hit may lie in: always the first, the second where ``reach``.

        Bands begin at multiples of k + 1 and are 2k + 1 wide, so any k + 1 diagonals lie in one of them.
        """
        base = np.zeros(len(self.step) + 1, np.int64)  # a cell for every band of every entry
        np.cumsum(self.below + size // self.step + 2, out=base[1:])
        width = self.step[item]
        shifted = diagonal + self.shift[item]  # not negative
        band = ((shifted + 0.5) / width).astype(np.int64)  # half a diagonal from a whole number: rounding decides nothing
        reach = np.flatnonzero(shifted - band * width <= width - 2)
        key = base[item] + band
        return np.concatenate([key, key[reach] - 1]), reach, base, self.shift, self.step

    def _possible(self, grams: np.ndarray, size: int) -> np.ndarray:
        """A mark an entry: does a band hold enough of its rarest q-grams?"""
        found = np.zeros(len(self.items), bool)
        item, _, diagonal = self.rare.of(
            grams, lambda item: np.bincount(item, minlength=len(found)) >= self.least)
        if not len(item):
            return found
        key, reach, base, _, _ = self._cells(item, diagonal, size)
        slot = key & (self.SLOTS - 1)
        least = self.least[item]
        key = key[np.bincount(slot, minlength=self.SLOTS)[slot] >= np.concatenate([least, least[reach]])]
        if not len(key):
            return found
        cells, counts = np.unique(key, return_counts=True)
        owner = np.searchsorted(base, cells, "right") - 1
        found[owner[counts >= self.least[owner]]] = True
        return found

    def bands(self, codes: np.ndarray) -> np.ndarray:
        """Rows of item, lowest diagonal of a band: those with as many shared q-grams as the lemma asks for."""
        none = np.empty((0, 2), np.int64)
        grams = _grams(codes, self.q)
        possible = self._possible(grams, len(codes))
        if not possible.any():
            return none
        item, place, diagonal = self.all.of(grams, lambda item: possible)
        key, reach, base, shift, step = self._cells(item, diagonal, len(codes))
        if base[-1] <= min(self.CELLS, 4 * len(key)):
            counts = np.bincount(key, minlength=base[-1])
            cells = np.flatnonzero(counts >= max(1, self.need[possible].min()))
            counts = counts[cells]
        else:
            cells, counts = np.unique(key, return_counts=True)
        owner = np.searchsorted(base, cells, "right") - 1
        good = counts >= self.need[owner]
        cells, owner = cells[good], owner[good]
        if not len(cells):
            return none
        # A q-gram of the item counts once, however often the band has it.
        which = np.minimum(np.searchsorted(cells, key), len(cells) - 1)
        chosen = cells[which] == key
        place = np.concatenate([place, place[reach]])
        width = int(self.sizes.max()) + 1
        once = np.unique(which[chosen] * width + place[chosen]) // width
        good = np.bincount(once, minlength=len(cells)) >= self.need[owner]
        cells, owner = cells[good], owner[good]
        return np.stack([owner, (cells - base[owner]) * step[owner] - shift[owner]], 1)

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """Item, begin, end, edits of every passage, in places of the normalized text.

        Of overlapping places of an item the one with fewest edits counts, the first of equals; places of the whole item
        go before those of its windows.
        """
        plain = normalized(text or "")
        codes = _codes(plain)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for item, diagonal in self.bands(codes).tolist():
            _, wanted, k = self.items[item]
            same = plain.find(self.plain[item], max(diagonal, 0), max(diagonal + 2 * k + len(wanted), 0))
            if same >= 0:  # no path has fewer edits
                found.setdefault(item, []).append((0, same, same + len(wanted)))
            elif (end := align(wanted, codes, diagonal, diagonal + 2 * k, k)) is not None:
                found.setdefault(item, []).append(end)
        for key, wanted in self.short:
            n, index = len(wanted), next(i for i, x in enumerate(self.items) if x[1] is wanted)
            same = np.ones(max(0, len(codes) - n + 1), bool)
            for k in range(n):
                same &= codes[k:k + len(same)] == wanted[k]
            found.setdefault(index, []).extend((0, b, b + n) for b in np.flatnonzero(same).tolist())
        out = []
        entries: dict[int, set[tuple[bool, int, int, int]]] = {}
        for item, places in found.items():
            entries.setdefault(self.whole[item], set()).update((item != self.whole[item], *at) for at in places)
        for item, places in entries.items():
            taken: list[tuple[int, int]] = []
            for _, edits, begin, end in sorted(places):
                if all(end <= b or begin >= e for b, e in taken):
                    taken.append((begin, end))
                    out.append((self.items[item][0], begin, end, edits))
        return sorted(out)


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """Fewest edits, begin and end of ``item`` in ``text``, with paths on the diagonals low to high; None beyond k.

    A cell is a diagonal; a row is a character of the item. Edits within a row run along the band and are the running
    minimum of the row's values less their place.
    """
    width = high - low + 1
    lanes = np.arange(width)
    diagonal = low + lanes
    big = 1 << 20
    cost = np.where((diagonal >= 0) & (diagonal <= len(text)), 0, big)  # the item may begin anywhere in the band
    begin = np.where(cost == 0, diagonal, 0)
    edge = len(item) + width + 1
    padded = np.concatenate([np.full(edge, 0xFFFFFFFF, np.uint32), text[max(low, 0):max(high + len(item), 0)],
                             np.full(edge, 0xFFFFFFFF, np.uint32)])
    offset = edge + low - max(low, 0)  # where the character of diagonal ``low`` and row 0 lies
    skip, source_of = np.full(width, big), np.zeros(width, np.int64)
    for i, code in enumerate(item):
        step = cost + (padded[offset + i:offset + i + width] != code)
        skip[:-1] = cost[1:] + 1  # the item's character is missing from the text
        source_of[:-1] = begin[1:]
        best = np.minimum(step, skip)
        come = np.where(step <= skip, begin, source_of)
        reach = diagonal + (i + 1)
        best[(reach < 0) | (reach > len(text))] = big
        # Characters that the text has beyond the item: along the row.
        along = best - lanes
        lowest = np.minimum.accumulate(along)
        source = np.maximum.accumulate(np.where(along == lowest, lanes, 0))
        cost, begin = lowest + lanes, come[source]
        if cost.min() > k:
            return None
    at = int(cost.argmin())
    if cost[at] > k:
        return None
    return int(cost[at]), int(begin[at]), int(len(item) + diagonal[at])


def _chunks(items: DataFrame, key: str, text: str, limit: int) -> Iterator[list[tuple[int, str]]]:
    """Items in runs of about ``limit`` bytes, of which the driver holds one at a time."""
    sized = items.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).filter("t is not null")
    total = sized.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-total // limit))
    part = F.pmod(F.xxhash64("t"), F.lit(parts))
    for i in range(parts):
        chosen = sized.filter(part == i) if parts > 1 else sized
        yield [(r.k, r.t) for r in chosen.distinct().orderBy("k", "t").toLocalIterator()]


def find_passages(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", q: int = Q, edits: float = EDITS,
                  chunk_bytes: int = CHUNK_BYTES, window: int = WINDOW) -> DataFrame:
    """``key``, ``item_id``, ``begin``, ``end``, ``edits`` of the items' passages in whole documents.

    Places count characters of the normalized text. Where only windows of an item stand, each place has the edits of its
    window. Null or blank texts and items have no passages. Rows with equal keys
    are searched each, equal items once. Keys of items are whole numbers. Other columns are not read. Without documents or
    items there are no rows.
    """
    rows = texts(docs, key, text)
    schema = f"{key} {dict(rows.dtypes)[key]}, {FIELDS}"
    out = None
    for chunk in _chunks(items, item, item_text, chunk_bytes):
        found = rows.mapInArrow(_search(docs.sparkSession.sparkContext.broadcast(chunk), q, edits, window, key), schema)
        out = found if out is None else out.union(found)
    return out


def _search(chunk, q: int, edits: float, window: int,
            key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(chunk.value, q, edits, window)
        for batch in batches:
            for part in slices(batch):
                which, found = [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    for row in index.find(text):
                        which.append(i)
                        found.append(row)
                columns = list(zip(*found)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(key).take(pa.array(which, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)],
                    [key, "item_id", "begin", "end", "edits"])

    return run


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents in which no passage was found, all columns. Rows without a key cannot be named and stay."""
    dirty = find_passages(docs, items, key, text).select(F.col(key).alias("dirty_key")).distinct()
    return docs.join(dirty, docs[key] == dirty.dirty_key, "left_anti")

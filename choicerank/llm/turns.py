"""Repair of conversations by a cheapest sequence of edits.

Rows of a conversation, in the order of their turns, have a symbol each: the initial of their role and their fault (blank,
duplicate, truncated or none). A repaired conversation is empty or an optional system row followed by pairs of user and
assistant. What a symbol may do to the four states of that grammar (nothing yet, after system, after user, after assistant) is
a 4 x 4 matrix over (min, +), inserts before the row included. Runs of equal symbols are collapsed; a run of ``n`` rows is
``T^n``, applied to the costs behind it from cached powers ``T^(2^k)``, so the costs of a run take log n steps. The audit, one
letter an edit, is then unrolled from the front: at every row the ASCII-least edit that keeps the cost, with the costs inside
a run found by halving it again. Costs behind runs are kept for every ``STRIDE``-th run only and made again in between.

Faults and symbols are columns of DataFrame expressions and one window; the rows, without their texts, are sorted by
conversation and walked as a stream, a byte a row being all that is held of a conversation. The texts are sorted once,
each conversation behind its audit, and pass through a task one by one. A conversation is one row of the result and
one digest, so a task walks it from end to end; it never gathers its texts.

Nulls in role and text are read as one space. Rows are ordered by turn, nulls first, then role and a hash of the text; equal rows are
repeats. A null key is a conversation of its own. Roles other than system, user and assistant (by their initials) are kept out
by the grammar and must be replaced or deleted. Empty tables give empty results. Other columns are not read, so
their names cannot clash.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from choicerank.llm.common import SLICE_CHARS, Work, slices

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

#: Runs between two kept cost vectors.
STRIDE = 256

#: States: nothing yet, after system, after user, after assistant. The state that a role leads to, by state.
NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
MADE = (("u", 2), ("u", 2), ("a", 3), ("u", 2))  # the only role (and its state) that an insert or a new role can have
ROLES = {"u": "user", "a": "assistant"}
NEVER = 1 << 60

Vector = tuple[int, int, int, int]


def _inserts() -> list[list[int]]:
    """Cheapest inserts from state to state."""
    out = [[NEVER] * 4 for _ in range(4)]
    for start in range(4):
        state = start
        for n in range(3):
            out[start][state] = min(out[start][state], n * INSERT)
            state = MADE[state][1]
    return out


INSERTS = _inserts()
#: Costs behind the last row: inserts until the conversation may end.
LAST: Vector = tuple(min(INSERTS[q][0], INSERTS[q][3]) for q in range(4))


def edits(symbol: str, state: int) -> Iterator[tuple[str, int, int]]:
    """Letter, cost and next state of what may happen to a row; ``symbol`` is an initial, upper case if truncated, or ``-``."""
    yield "D", DELETE, state
    if symbol != "-":
        more = TRUNCATED if symbol.isupper() else 0
        kept = NEXT.get(symbol.lower(), (None,) * 4)[state]
        if kept is not None:
            yield "K", KEEP + more, kept
        yield "R", REROLE + more, MADE[state][1]


def apply(matrix: tuple, costs: Vector) -> Vector:
    return tuple(min(m + c for m, c in zip(row, costs)) for row in matrix)


@cache
def power(symbol: str, k: int) -> tuple:
    """Matrix of ``2 ** k`` rows of a symbol, inserts before each included."""
    if k:
        half = power(symbol, k - 1)
        columns = list(zip(*half))
        return tuple(tuple(min(a + b for a, b in zip(row, column)) for column in columns) for row in half)
    row = [[NEVER] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, after in edits(symbol, state):
            row[state][after] = min(row[state][after], cost)
    return tuple(tuple(min(INSERTS[p][q] + row[q][r] for q in range(4)) for r in range(4)) for p in range(4))


def before_run(symbol: str, n: int, costs: Vector) -> Vector:
    k = 0
    while n:
        if n & 1:
            costs = apply(power(symbol, k), costs)
        n >>= 1
        k += 1
    return costs


class Symbols:
    """The symbols of a conversation as runs."""

    def __init__(self):
        self.kinds, self.lengths = bytearray(), array("q")

    def add(self, symbol: str) -> None:
        code = ord(symbol)
        if self.kinds and self.kinds[-1] == code:
            self.lengths[-1] += 1
        else:
            self.kinds.append(code)
            self.lengths.append(1)

    def repair(self) -> tuple[int, str]:
        """Cost of the cheapest edits, and the ASCII-least of the cheapest audits."""
        n, costs, kept = len(self.kinds), LAST, {}
        for i in range(n - 1, -1, -1):
            if (i + 1) % STRIDE == 0 or i == n - 1:
                kept[i] = costs
            costs = before_run(chr(self.kinds[i]), self.lengths[i], costs)
        audit, state = [], 0
        for begin in range(0, n, STRIDE):
            last = min(begin + STRIDE, n) - 1
            behind = [kept[last]]
            for i in range(last, begin, -1):
                behind.append(before_run(chr(self.kinds[i]), self.lengths[i], behind[-1]))
            for i in range(begin, last + 1):
                state = _unroll(chr(self.kinds[i]), self.lengths[i], behind.pop(), state, audit)
        while LAST[state]:
            audit.append("I")
            state = MADE[state][1]
        return costs[0], "".join(audit)


def _unroll(symbol: str, n: int, behind: Vector, state: int, audit: list[str]) -> int:
    """Append the edits of a run that starts in ``state``; returns the state behind it."""
    while n > 1:  # the rows before the last 2 ** k first
        k = (n - 1).bit_length() - 1
        state = _unroll(symbol, n - (1 << k), apply(power(symbol, k), behind), state, audit)
        n = 1 << k
    here = apply(power(symbol, 0), behind)
    while True:
        options = [(letter, after) for letter, cost, after in edits(symbol, state) if cost + behind[after] == here[state]]
        if INSERT + here[MADE[state][1]] == here[state]:
            options.append(("I", None))
        letter, after = min(options)
        audit.append(letter)
        if letter != "I":
            return after
        state = MADE[state][1]


def prepared(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``id``, ``turn``, ``role``, ``text``, ``digest`` of the text; nulls of role and text are a space."""
    return rows.select(F.col(key).alias("id"), F.col(turn).cast("bigint").alias("turn"),
                       F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text")
                       ).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def in_order() -> list:
    return [F.col("turn").asc_nulls_first(), "role", "digest"]


def plans(rows: DataFrame) -> DataFrame:
    """One row a conversation of ``prepared`` rows: faults, cost and audit of the cheapest repair."""
    bare = F.rtrim("text", F.lit(SPACE))
    seen = F.row_number().over(Window.partitionBy("id", "role", "digest").orderBy(F.col("turn").asc_nulls_first()))
    fault = (F.when(F.col("blank"), F.lit("b")).when(F.col("seen") > 1, F.lit("d"))
             .when(~F.col("ended"), F.lit("t")).otherwise(F.lit("")))
    faults = (rows.select("id", "turn", "role", "digest", (bare == "").alias("blank"),
                          F.right(bare, F.lit(1)).isin(".", "!", "?").alias("ended"))
              .repartition("id").withColumn("seen", seen)
              .select("id", "turn", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"), "role", "digest", "seen")
              .sortWithinPartitions("id", *in_order(), "seen"))
    kind = dict(rows.dtypes)["id"]
    return faults.select("id", "turn", "initial", "fault").mapInArrow(
        _plan, f"id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")


class _Conversation:
    def __init__(self):
        self.symbols, self.counts = Symbols(), {"b": 0, "d": 0, "t": 0, "": 0}
        self.illegal, self.initial = 0, None
        self.first = self.last = None
        self.turns = 0

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        self.counts[fault] += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        kind = initial if initial in ("s", "u", "a") else "x"
        self.symbols.add("-" if fault in ("b", "d") else kind.upper() if fault == "t" else kind)

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (gaps, self.counts["b"], self.counts["d"], self.counts["t"], self.illegal, *self.symbols.repair())


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    types, key, now, done, held = None, None, None, [], 0
    for batch in batches:
        types = types or [batch.schema.field(0).type, *[pa.int64()] * 6, pa.string()]
        for part in (batch.slice(k, 4096) for k in range(0, len(batch), 4096)):
            for own, turn, initial, fault in zip(*(c.to_pylist() for c in part.columns)):
                if now is None or own != key:
                    if now is not None:
                        done.append((key, *now.row()))
                        held += len(done[-1][-1])
                    key, now = own, _Conversation()
                now.add(turn, initial, fault)
            if len(done) >= 4096 or held > SLICE_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
                done, held = [], 0
    if now is not None:
        done.append((key, *now.row()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)


def _behind_audits(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Rows of each conversation in order, behind a row that holds the audit in place of a text."""
    parts = rows.select("id", F.lit(1).alias("part"), "turn", "role", "digest", "text").union(
        audits.select("id", F.lit(0), F.lit(None).cast("bigint"), F.lit(""), F.lit(None).cast("binary"), "audit"))
    return (parts.repartition("id").sortWithinPartitions("id", "part", *in_order()).select("id", "part", "role", "text"))


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """What each audit does: its key with None, then (role, text) of the rows that it leaves, in order."""
    key, audit, at, state = None, "", 0, 0

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            initial, state = MADE[state]
            at += 1
            yield key, (ROLES[initial], "")

    for batch in batches:
        for part in slices(batch):
            for own, kind, role, text in zip(*(c.to_pylist() for c in part.columns)):
                if kind == 0:
                    yield from inserted()
                    key, audit, at, state = own, text, 0, 0
                    yield key, None
                    continue
                yield from inserted()
                letter = audit[at]
                at += 1
                if letter == "K":
                    state = NEXT[role[0]][state]
                    yield key, (role, text)
                elif letter == "R":
                    initial, state = MADE[state]
                    yield key, (ROLES[initial], text)
    yield from inserted()


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired conversations: ``id``, ``place`` from 0, ``role``, ``text``; ``audits`` are ``plans`` of the same rows."""
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, out, held, types = 0, [], 0, None
        ahead = iter(batches)
        for first in ahead:
            types = [first.schema.field(0).type, pa.int64(), pa.string(), pa.string()]
            for key, row in _follow(_chained(first, ahead)):
                if row is None:
                    place = 0
                    continue
                out.append((key, place, *row))
                place += 1
                held += len(row[1])
                if len(out) >= 4096 or held > SLICE_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    names = ["id", "place", "role", "text"]
    return _behind_audits(rows, audits).mapInArrow(run, f"id {kind}, place bigint, role string, text string")


def digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``id`` and ``repaired_sha256`` of the repaired conversation as lines ``role:text``."""
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = iter(batches)
        for first in ahead:
            types = [first.schema.field(0).type, pa.string()]
            done = []
            for (key, _), group in groupby(_numbered(_follow(_chained(first, ahead))), lambda x: x[0]):
                digest, joint = hashlib.sha256(), b""
                for _, row in group:
                    if row is not None:
                        digest.update(joint + f"{row[0]}:{row[1]}".encode())
                        joint = b"\n"
                done.append((key, digest.hexdigest()))
                if len(done) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
                    done = []
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)

    names = ["id", "repaired_sha256"]
    return _behind_audits(rows, audits).mapInArrow(run, f"id {kind}, repaired_sha256 string")


def _numbered(followed: Iterator[tuple]) -> Iterator[tuple]:
    """Keys with a number, so that every audit starts a group."""
    n = 0
    for key, row in followed:
        n += row is None
        yield (key, n), row


def _chained(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def damaged(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with planted faults, by crc32 of ``key:turn`` modulo 20: dropped, emptied, without sentence ends, repeated, by the user."""
    filled = rows.select(F.col(key), F.col(turn), F.coalesce(F.col(role), F.lit(" ")).alias(role),
                         F.coalesce(F.col(text), F.lit(" ")).alias(text),
                         (F.crc32(F.concat(F.coalesce(F.col(key).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(
                             F.col(turn).cast("string"), F.lit(" "))).cast("binary")) % 20).alias("damage"))
    case = F.col("damage")
    return (filled.filter(case != 0)
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(case == 3, F.lit(2)).otherwise(F.lit(1)))))
            .select(key, turn, F.when(case == 4, F.lit("user")).otherwise(F.col(role)).alias(role),
                    F.when(case == 1, F.lit("")).when(case == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(F.col(text)).alias(text)))


def repair(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Key, faults, cost, audit and digest of the repaired conversation, one row a conversation."""
    found = prepared(rows, key, turn, role, text)
    audits = Work(rows.sparkSession).store(plans(found), "plans")
    hashes = digests(found, audits).withColumnRenamed("id", "same")
    return audits.join(hashes, audits.id.eqNullSafe(hashes.same)).drop("same").withColumnRenamed("id", key)

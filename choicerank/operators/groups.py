"""Group primitives that hold when a single group has a third of all rows.

How large groups get decides how they are computed. ``measured`` notes the rows of the largest group in the metadata of the key
column, where every later operator finds it; tables of ``sources.layout`` have it from the start, other frames are
counted once (one job over the key columns). It is a bound: filters keep it true, and where it has become wrong
results stay right.

``attach``   statistics of the group on every row. If no group is above ``spark.choicerank.hotRows``, windows over the group:
             one scan, and one exchange for any number of them, or none over a table bucketed by the group. Otherwise
             they are aggregated (map-side combine) and joined back, which adaptive execution can split at a hot key.
``running``  an ordered position or running sum. Ordinary groups use a window, on the same exchange. Otherwise a segmented
             prefix scan cuts groups of any size by ranges of their order, so no task sorts a hot group alone.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from itertools import count as counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from choicerank.settings import checkpointed, setting

_serial = counter()


def scratch(label: str) -> str:
    """A column name that no user column and no other scratch column has."""
    return f"__{label}_{next(_serial)}"


def as_list(names: str | Iterable[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def join_on(df: DataFrame, table: DataFrame, keys: Sequence[str], *, how: str = "left",
            null_keys: bool = False, broadcast: bool = False) -> DataFrame:
    """Equi-join on equally named keys; ``null_keys`` lets null match null.

    ``broadcast`` is for tables that are usually small: they are measured, and broadcast only if they are.

    Adaptive execution splits a hot key only where both sides are shuffled for the join. A table that
    was aggregated by the same keys is not, unless it is joined with ``null_keys``: the null-safe
    match hashes other expressions, so the small table is shuffled once more.
    """
    if broadcast:
        table = sized(table)
    if not null_keys:
        return df.join(table, list(keys), how)
    renamed = {key: scratch("key") for key in keys}
    matches = [F.col(key).eqNullSafe(F.col(other)) for key, other in renamed.items()]
    joined = df.join(table.withColumnsRenamed(renamed), reduce(lambda a, b: a & b, matches), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*renamed.values())


#: Metadata of a key column: rows of the largest group by keys, the keys by which rows lie together, and rows of all groups.
ROWS, TOGETHER, ALL = "choicerank.rows", "choicerank.together", "choicerank.all"
#: Rows that a task of an exchange by group holds, about, where more than the usual number of partitions are needed for that.
TASK_ROWS = 500_000


def _noted(df: DataFrame, keys: Sequence[str], what: str) -> list[tuple[set[str], object]]:
    """What is noted about groups whose keys are among ``keys``: (keys, value)."""
    found = []
    for field in df.schema.fields:
        if field.name in keys and what in field.metadata:
            found += [(set(json.loads(k)), v) for k, v in json.loads(field.metadata[what]).items()]
    return [(k, v) for k, v in found if k <= set(keys)]


def note(df: DataFrame, keys: Sequence[str], what: str, value: object) -> DataFrame:
    """``df`` with a remark on the groups of ``keys``, kept in the metadata of the first key."""
    first = sorted(keys)[0]
    metadata = df.schema[first].metadata
    remarks = json.loads(metadata.get(what, "{}")) | {json.dumps(sorted(keys)): value}
    return df.withMetadata(first, metadata | {what: json.dumps(remarks)})


def largest_group(df: DataFrame, keys: str | Sequence[str]) -> int | None:
    """A noted bound of the rows of any group of ``keys``: a group of some of the keys holds those of all."""
    return min((rows for _, rows in _noted(df, as_list(keys), ROWS)), default=None)


def all_rows(df: DataFrame, keys: str | Sequence[str]) -> int | None:
    """A noted number of the rows of all groups of ``keys``."""
    return min((rows for _, rows in _noted(df, as_list(keys), ALL)), default=None)


def measured(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """``df`` with the rows of its largest group and of all groups noted; counted (one job over the keys) unless they are."""
    keys = as_list(keys)
    if largest_group(df, keys) is not None:
        return df
    size = scratch("size")
    largest, rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(size)).agg(F.max(size), F.sum(size)).first()
    return note(note(df, keys, ROWS, largest or 0), keys, ALL, rows or 0)


def has_hot_groups(df: DataFrame, keys: str | Sequence[str]) -> bool:
    """Whether a measured frame may have a group above the row limit."""
    return largest_group(df, keys) > setting(df.sparkSession, "hotRows")


def together(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Rows of a group in one partition, for several windows over finer groups; nothing to do where they are noted to be."""
    keys = as_list(keys)
    if _noted(df, keys, TOGETHER):
        return df
    parts = _many_parts(df, keys)
    return note(df.repartition(parts, *keys) if parts else df.repartition(*keys), keys, TOGETHER, 1)


def _many_parts(df: DataFrame, keys: Sequence[str]) -> int | None:
    """Partitions of ``TASK_ROWS`` rows by what is noted, if those are more than the session's number of shuffle partitions."""
    rows = min((n for _, n in _noted(df, keys, ALL)), default=0)
    parts = math.ceil(rows / TASK_ROWS)
    return parts if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def over_group(df: DataFrame, keys: Sequence[str], columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that are windows over the groups of ``keys``; the rows of a group lie together then."""
    if not _noted(df, keys, TOGETHER) and _many_parts(df, keys):
        df = together(df, keys)
    out = df.withColumns(dict(columns))
    return out if _noted(df, keys, TOGETHER) else note(out, keys, TOGETHER, 1)


def measures(table: DataFrame) -> list[Column]:
    """Aggregates that measure a table: its rows and the bytes of its columns without a fixed width."""
    sizes = []
    for f in table.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            sizes.append(F.octet_length(f.name))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            sizes.append(F.octet_length(F.to_json(F.struct(f.name))) * 2)
    volume = reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(0)) for s in sizes], F.lit(0))
    return [F.count(F.lit(1)).alias("rows"), F.sum(long(volume)).alias("text_bytes")]


def is_small(table: DataFrame, rows: int | None = None, text_bytes: int | None = 0) -> bool:
    """Is a table within the limits for a broadcast? It is measured unless its size is given."""
    limit = setting(table.sparkSession, "broadcastRows")
    if rows is None:
        rows, text_bytes = table.limit(limit + 1).agg(*measures(table)).first()
    volume = rows * 8 * len(table.columns) + (text_bytes or 0)
    return rows <= limit and volume <= setting(table.sparkSession, "broadcastBytes")


def sized(table: DataFrame, rows: int | None = None, text_bytes: int | None = 0) -> DataFrame:
    """A table to join: broadcast if it is small, else by shuffle.

    Spark's own estimate is that of the files, which knows neither exploded rows nor how well columns are packed, so a table
    of any size could go through the driver.
    """
    return F.broadcast(table) if is_small(table, rows, text_bytes) else table.hint("merge")


class Side:
    """A table with unique keys that is to be joined, under column names nothing else uses.

    ``on`` maps its key columns to expressions over the other side. It is broadcast only if its
    measured rows and bytes are few (``rows`` and ``text_bytes`` where the caller has measured them
    already). A larger table is joined by shuffle, where adaptive execution may split a hot key.
    """

    def __init__(self, table: DataFrame, on: Mapping[str, Column], rows: int | None = None,
                 text_bytes: int = 0):
        named = {name: scratch(name) for name in table.columns}
        renamed = table.withColumnsRenamed(named)
        self.small = is_small(renamed, rows, text_bytes)
        self.table = F.broadcast(renamed) if self.small else renamed.hint("merge")
        self.match = reduce(lambda a, b: a & b, [e == F.col(named[k]) for k, e in on.items()])
        self.columns = {name: F.col(unique) for name, unique in named.items()}


def join_sides(df: DataFrame, sides: Iterable[Side], outputs: Mapping[str, Column]) -> DataFrame:
    """Left-join tables and add the outputs in one projection, which keeps wide plans short.

    Tables that are joined by shuffle come first, so that rows are dealt without the columns of the others.
    """
    ordered = sorted(sides, key=lambda side: side.small)
    joined = reduce(lambda left, side: left.join(side.table, side.match, "left"), ordered, df)
    kept = [F.col(c) for c in df.columns if c not in outputs]
    return joined.select(*kept, *[e.alias(n) for n, e in outputs.items()])


def attach(df: DataFrame, keys: str | Sequence[str], aggregates: Mapping[str, Column], *,
           null_keys: bool = True, source: DataFrame | None = None) -> DataFrame:
    """Add group aggregates to every row of the group.

    ``null_keys=False`` leaves the aggregates of rows with a null key null. ``source`` is an earlier
    frame with the same rows to aggregate where hot groups forbid windows. A chain of several attachments should
    name one, as each of them otherwise reads the whole chain before it twice.
    """
    keys = as_list(keys)
    df = measured(df, keys)
    if not has_hot_groups(df, keys):
        w = Window.partitionBy(*keys)
        return over_group(df, keys, {n: known(e.over(w), [] if null_keys else keys) for n, e in aggregates.items()})
    source = df if source is None else source
    source = source if null_keys else source.dropna(subset=keys)
    stats = source.groupBy(*keys).agg(*[e.alias(n) for n, e in aggregates.items()])
    return join_on(df, stats, keys, null_keys=True)


def distinct_counts(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """For each ``{output: column}`` the different values of the column per group, null being one.

    Each row gives a narrow row a column; these are made distinct and then counted. A group's values are
    spread over tasks, columns of one type share a field, and one exchange serves all of them.
    """
    types = {c: df.schema[c].dataType for c in columns.values()}
    values = {t: scratch("value") for t in types.values()}
    what = scratch("what")
    tags = [F.struct(*[F.col(k) for k in keys], F.lit(i).alias(what), *[
        (F.col(column) if types[column] == t else F.lit(None).cast(t)).alias(name) for t, name in values.items()])
        for i, column in enumerate(columns.values())]
    rows = df.select(F.inline(F.array(*tags))).distinct()
    return rows.groupBy(*keys).agg(*[F.count(F.when(F.col(what) == i, 1)).alias(n) for i, n in enumerate(columns)])


def known(value: Column, keys: Sequence[str]) -> Column:
    """The value where no key is null."""
    return F.when(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]), value) if keys else value


def hot_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """All groups above the row limit with their row counts ``n``, or None if there is none."""
    size = scratch("size")
    found = checkpointed(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(size))
                         .where(F.col(size) > setting(df.sparkSession, "hotRows")))
    return None if found.isEmpty() else found.withColumnRenamed(size, "n")


def by_size(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """Split rows into those of ordinary groups and those of hot groups (None if there is none)."""
    df = measured(df, keys)
    hot = hot_groups(df, keys) if has_hot_groups(df, keys) else None
    if hot is None:
        return df, None
    keyed = hot.drop("n")
    return (join_on(df, keyed, keys, how="left_anti", null_keys=True, broadcast=True),
            join_on(df, keyed, keys, how="left_semi", null_keys=True, broadcast=True))


def ascending(order: Sequence[Column]) -> list[Column]:
    return [o.asc_nulls_last() for o in order]


def running(df: DataFrame, keys: str | Sequence[str], order: Sequence[Column], name: str, *,
            weight: Column | None = None, total: str | None = None) -> DataFrame:
    """Add the position of each row in its group (or the running sum of ``weight``).

    ``order`` is ascending, nulls last, and must be unique in the group: pass ``-score`` for a
    descending number. ``total`` also adds the row count (or weight sum) of the group. No keys
    means one group over everything.
    """
    keys = as_list(keys)
    made_key = None
    if not keys:
        made_key = scratch("all")
        df = df.withColumn(made_key, F.lit(0))
        keys = [made_key]
    df = measured(df, keys)
    way = _scanned_running if has_hot_groups(df, keys) else _windowed_running
    out = way(df, keys, list(order), name, weight, total)
    return out.drop(made_key) if made_key else out


def amount(weight: Column | None) -> Column:
    return F.count(F.lit(1)) if weight is None else F.sum(weight)


def _windowed_running(df, keys, order, name, weight, total):
    w = Window.partitionBy(*keys)
    ordered = w.orderBy(*ascending(order))
    if weight is None:
        added = {name: long(F.row_number().over(ordered))}
    else:
        added = {name: F.sum(weight).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))}
    if total:
        added[total] = amount(weight).over(w)
    return over_group(df, keys, added)


def _scanned_running(df, keys, order, name, weight, total):
    """A segmented prefix scan: rows are dealt to tasks by ranges of (keys, order) and sorted there, so a group of any size is
    cut wherever a range ends. What a row has before it in its own task comes from its place there (or a running sum inside
    the task's part of the group), what the tasks before hold from a table of one row a task and group.

    The sorted rows are stored, as ranges come from samples and must not change when a task is run again.
    """
    spot, part, first, own, before, whole = (scratch(x) for x in ("spot", "part", "first", "own", "before", "whole"))
    spark = df.sparkSession
    n = max(setting(spark, "parts"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = [*[F.col(k).asc_nulls_first() for k in keys], *ascending(order)]
    rows = checkpointed(df.repartitionByRange(n, *by).sortWithinPartitions(*by)
                        .withColumn(spot, F.monotonically_increasing_id()))
    rows = rows.withColumn(part, F.shiftright(spot, 33))
    w = Window.partitionBy(*keys)
    earlier = w.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carries = (rows.groupBy(*keys, part).agg(F.min(spot).alias(first), amount(weight).alias(own))
               .withColumns({before: F.coalesce(F.sum(own).over(earlier), F.lit(0)), whole: F.sum(own).over(w)}).drop(own))
    out = join_on(rows, carries, [*keys, part], how="inner", null_keys=True)
    if weight is None:
        here = F.col(spot) - F.col(first) + 1
    else:
        here = F.sum(weight).over(Window.partitionBy(*keys, part).orderBy(spot)
                                  .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    added = {name: here + F.col(before)} | ({total: F.col(whole)} if total else {})
    return out.withColumns(added).drop(spot, part, first, before, whole)


def top_rows(df: DataFrame, keys: str | Sequence[str], order: Sequence[Column], k: int,
             name: str) -> DataFrame:
    """The first ``k`` rows of each group with their 1-based position.

    Spark limits every map task to ``k`` rows a group before the shuffle, so a hot group
    sends ``k`` rows a task.
    """
    w = Window.partitionBy(*as_list(keys)).orderBy(*ascending(order))
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def quantile_position(pick: float | str, n: Column) -> list[Column]:
    """Places (from 0) of the values whose mean is the quantile of ``n`` values."""
    last = n - 1
    return [F.floor(last / 2), F.ceil(last / 2)] if pick == "median" else [F.floor(F.lit(float(pick)) * last + 0.5)]


def group_quantiles(df: DataFrame, keys: str | Sequence[str], value: str,
                    picks: Mapping[str, float | str]) -> DataFrame:
    """Exact quantiles of ``value`` per group, one row a group that has a value.

    A pick is a fraction, taken at the nearest row ``round(q*(n-1))`` (halves up), or ``"median"``.
    Ordinary groups are sorted on the exchange of their windows. Where groups are hot, equal values are counted first, so
    that the ordered step sees each value once a group. Without keys see ``column_quantiles``.
    """
    keys = as_list(keys)
    if not keys:
        found = column_quantiles(df, value, picks)
        kinds = {n: "double" if pick == "median" else df.schema[value].dataType for n, pick in picks.items()}
        return df.sparkSession.range(1).select(*[F.lit(found[n]).cast(kinds[n]).alias(n) for n in picks])
    df = df.where(F.col(value).isNotNull()).select(*keys, value)
    df = measured(df, keys)
    if not has_hot_groups(df, keys):
        n, place = scratch("n"), scratch("place")
        w = Window.partitionBy(*keys)
        placed = over_group(df, keys, {place: F.row_number().over(w.orderBy(value)) - 1, n: F.count(F.lit(1)).over(w)})
        return placed.groupBy(*keys).agg(*[
            _mean([F.max(F.when(F.col(place) == p, F.col(value))) for p in quantile_position(pick, F.col(n))]).alias(name)
            for name, pick in picks.items()])

    n, upto, total = scratch("n"), scratch("upto"), scratch("total")
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias(n))
    placed = running(counted, keys, [F.col(value)], upto, weight=F.col(n), total=total)

    def at(position):
        here = (F.col(upto) - F.col(n) <= position) & (position < F.col(upto))
        return F.max(F.when(here, F.col(value)))

    exprs = [_mean([at(p) for p in quantile_position(pick, F.col(total))]).alias(name) for name, pick in picks.items()]
    return placed.groupBy(*keys).agg(*exprs)


#: Accuracy of the approximate quantiles that bracket a place, and distinct values that are few enough to be collected.
ACCURACY, FEW = 100_000, 20_000


def column_quantiles(df: DataFrame, value: str, picks: Mapping[str, float | str]) -> dict[str, object]:
    """Exact quantiles of a whole column of numbers, dates or times, with picks as in ``group_quantiles``.

    Each pass brackets the wanted places by approximate quantiles; the next one counts what lies below, at and between the
    ends, which settles a place or narrows it to less than a ten-thousandth of the rows. What is left between the ends is
    collected once it has few distinct values. No row is sorted or shuffled; 3 passes do up to half a billion rows, and each
    two more passes ten thousand times as many.
    """
    x = F.col("x")
    rows = df.select(F.col(value).alias("x")).where(x.isNotNull())
    fractions = {n: 0.5 if q == "median" else float(q) for n, q in picks.items()}
    every = sorted({min(1.0, max(0.0, q + d)) for q in fractions.values() for d in _AROUND})
    n, low, high, near = rows.agg(F.count("x"), F.min("x"), F.max("x"), F.percentile_approx("x", every, ACCURACY)).first()
    if not n:
        return dict.fromkeys(picks)
    places = {name: _places(q, n) for name, q in picks.items()}
    ends = dict(zip(every, near))
    state = {}  # the ends that bracket each place
    for name, found in places.items():
        a, b = (ends[min(1.0, max(0.0, fractions[name] + d))] for d in _AROUND)
        state |= {p: (a, b) for p in found}
    known: dict[int, object] = {}
    outer = {p: (low, high) for p in state}
    while state:
        counts = rows.agg(*[c for p, (a, b) in state.items() for c in (
            F.count(F.when(x < F.lit(a), 1)), F.count(F.when(x == F.lit(a), 1)),
            F.count(F.when((x > F.lit(a)) & (x < F.lit(b)), 1)), F.count(F.when((x == F.lit(b)) & (x > F.lit(a)), 1)),
            F.approx_count_distinct(F.when((x > F.lit(a)) & (x < F.lit(b)), x)))]).first()
        few, wide = {}, {}
        for k, (p, (a, b)) in enumerate(state.items()):
            below, at_a, between, at_b, distinct = counts[5 * k:5 * k + 5]
            if below <= p < below + at_a:
                known[p] = a
            elif below + at_a + between <= p < below + at_a + between + at_b:
                known[p] = b
            elif not below <= p < below + at_a + between + at_b:
                wide[p] = (*outer[p], None)  # the approximation missed it: take the ends before
            elif distinct <= FEW:
                few[p] = (a, b, p - below - at_a)
            else:
                outer[p] = (a, b)
                wide[p] = (a, b, (p - below - at_a) / between)
        if few:
            inside = reduce(lambda s, t: s | t, [(x > F.lit(a)) & (x < F.lit(b)) for a, b, _ in few.values()])
            found = rows.where(inside).groupBy("x").agg(F.count("x").alias("n")).collect()
            found.sort(key=lambda r: (r.x != r.x, r.x))  # NaN last
            for p, (a, b, left) in few.items():
                for r in found:
                    if (r.x > a or r.x != r.x) and (r.x < b or (b != b and r.x == r.x)):
                        left -= r.n
                        if left < 0:
                            known[p] = r.x
                            break
        state = {p: (a, b) for p, (a, b, share) in wide.items() if share is None}
        narrower = {p: (a, b, share) for p, (a, b, share) in wide.items() if share is not None}
        if narrower:
            near = rows.agg(*[F.percentile_approx(F.when((x > F.lit(a)) & (x < F.lit(b)), x),
                                                  [min(1.0, max(0.0, share + d)) for d in _AROUND], ACCURACY)
                              for a, b, share in narrower.values()]).first()
            state |= {p: tuple(ends) for p, ends in zip(narrower, near)}
    return {name: known[found[0]] if len(found) == 1 else (known[found[0]] + known[found[1]]) / 2
            for name, found in places.items()}


_AROUND = (-2 / ACCURACY, 2 / ACCURACY)


def _places(pick: float | str, n: int) -> list[int]:
    return [(n - 1) // 2, n // 2] if pick == "median" else [math.floor(float(pick) * (n - 1) + 0.5)]


def _mean(values: list[Column]) -> Column:
    return values[0] if len(values) == 1 else sum(values[1:], values[0]) / len(values)


def dense_positions(df: DataFrame, keys: str | Sequence[str], value: str, name: str) -> DataFrame:
    """Distinct (keys, value) rows with the 1-based dense rank of the value; nulls are left out."""
    distinct = df.where(F.col(value).isNotNull()).select(*as_list(keys), value).distinct()
    return running(distinct, keys, [F.col(value)], name)


def long(column: Column) -> Column:
    return column.cast(T.LongType())

"""Statistics of past choices per key, joined to every row with a fallback for unseen keys.

``history`` is a condition that picks the past rows, by default the chosen rows of the training
split, so a training row's own outcome is inside its statistics. Pass another condition to avoid that.

All keys of a history are aggregated together: every past row is exploded once into (kind of key, key value) rows, the
overall row being one more kind, and one exchange gives the statistics of every kind. The result is one small table in the
shared folder, of which each kind is a filter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from choicerank.operators.groups import Side, as_list, join_on, join_sides, measures, scratch
from choicerank.settings import checkpointed

GLOBAL = "global"
NULL_KEY = "null_key"


@dataclass
class Stat:
    """One statistic: its aggregate and what a row without it gets.

    ``default`` is None (stays null), a number, ``GLOBAL`` (the aggregate over all history) or
    ``NULL_KEY`` (the aggregate of the history rows without any key). ``trust`` makes a condition of the
    key's statistics; where it is false the statistic counts as missing. Instead of an aggregate, ``distinct`` names a
    column whose different values are counted, null being one.
    """

    name: str
    aggregate: Column | None
    default: float | str | None = None
    trust: Callable[[dict[str, Column]], Column] | None = None
    distinct: str | None = None


def chosen(split: str = "split", label: str = "selected") -> Column:
    """The usual history: chosen rows of the training split."""
    return (F.col(split) == "train") & (F.col(label) == 1)


@dataclass
class HistorySpec:
    """Statistics of one key; ``outputs`` makes the final columns from them, by default all of them."""

    keys: Sequence[str]
    stats: Sequence[Stat]
    outputs: Callable[[dict[str, Column]], dict[str, Column]] = dict
    history: Column | DataFrame | None = None


def history_rows(df: DataFrame, history: Column | DataFrame | None) -> DataFrame:
    """The past rows: a frame given as it is, or the rows of ``df`` that satisfy a condition."""
    if isinstance(history, DataFrame):
        return history
    return df.where(chosen() if history is None else history)


class _Kinds:
    """The keys of a history as kinds 1, 2, ... (0 is the overall row), with slots for key values by place and type."""

    def __init__(self, past: DataFrame, keys: Sequence[Sequence[str]]):
        self.past, self.keys, self.kind = past, [(), *keys], scratch("kind")
        self.slots: dict[tuple[int, T.DataType], str] = {}
        for own in keys:
            for place, key in enumerate(own):
                self.slots.setdefault((place, past.schema[key].dataType), scratch("slot"))
        self.columns = [self.kind, *self.slots.values()]

    def slot(self, kind: int, place: int) -> str:
        return self.slots[place, self.past.schema[self.keys[kind][place]].dataType]

    def _tag(self, kind: int, more: Sequence[Column] = ()) -> Column:
        own = {self.slot(kind, place): key for place, key in enumerate(self.keys[kind])}
        return F.struct(F.lit(kind).alias(self.kind), *[
            (F.col(own[name]) if name in own else F.lit(None).cast(type_)).alias(name)
            for (_, type_), name in self.slots.items()], *more)

    def aggregate(self, aggregates: dict[str, Column]) -> DataFrame:
        """All aggregates of every kind and key, from one exchange."""
        tag = scratch("tag")
        rows = self.past.withColumn(tag, F.explode(F.array(*[self._tag(k) for k in range(len(self.keys))])))
        return rows.groupBy(*[F.col(f"{tag}.{c}").alias(c) for c in self.columns]).agg(
            *[e.alias(n) for n, e in aggregates.items()])

    def count_distinct(self, counts: dict[str, tuple[int, str]]) -> DataFrame:
        """For each name the different values of a column per key of a kind: distinct rows first, so that a key with many
        values is spread over tasks."""
        values = {}
        for _, column in counts.values():
            values.setdefault(self.past.schema[column].dataType, scratch("value"))
        what, n = scratch("what"), scratch("n")
        tags = [self._tag(kind, [F.lit(i).alias(what), *[
            (F.col(column) if self.past.schema[column].dataType == t else F.lit(None).cast(t)).alias(name)
            for t, name in values.items()]]) for i, (kind, column) in enumerate(counts.values())]
        rows = self.past.select(F.inline(F.array(*tags))).distinct()
        found = rows.groupBy(*self.columns, what).agg(F.count(F.lit(1)).alias(n))
        return found.groupBy(*self.columns).agg(*[
            F.max(F.when(F.col(what) == i, F.col(n))).alias(name) for i, name in enumerate(counts)])


def _statistics(past: DataFrame, parts: Sequence[tuple[Sequence[str], Sequence[Sequence[Stat]]]]
                ) -> list[tuple[Side, list[dict[str, Column]]]]:
    """For each key the table to join and the filled statistics of each list of them.

    Equal aggregates are computed once. The table is stored, and one job over it measures the kinds for their joins and gives
    the overall row and the rows without a key.
    """
    kinds = _Kinds(past, [keys for keys, _ in parts])
    aggregates: dict[str, Column] = {}
    distinct: dict[str, tuple[int, str]] = {}
    known: dict[object, str] = {}

    def name_of(stat: Stat, kind: int) -> str:
        text = (kind, stat.distinct) if stat.distinct else str(stat.aggregate)
        if text not in known or "more fields" in text:  # a shortened text may stand for another aggregate
            known[text] = scratch(stat.name)
            if stat.distinct:
                distinct[known[text]] = (kind, stat.distinct)
            else:
                aggregates[known[text]] = stat.aggregate
        return known[text]

    names = [[{s.name: (name_of(s, kind), name_of(s, 0) if s.distinct and s.default == GLOBAL else None) for s in some}
              for some in stats] for kind, (_, stats) in enumerate(parts, 1)]
    table = kinds.aggregate(aggregates or {scratch("n"): F.count(F.lit(1))})
    if distinct:
        table = join_on(table, kinds.count_distinct(distinct), kinds.columns, null_keys=True)
    table = checkpointed(table)
    plain = [c for c in table.columns if c not in kinds.columns]
    keyless = F.lit(True)
    for slot in kinds.slots.values():
        keyless = keyless & F.col(slot).isNull()
    found = {row[kinds.kind]: row for row in table.groupBy(kinds.kind).agg(
        *measures(table), F.first(F.when(keyless, F.struct(*plain)), True).alias(NULL_KEY)).collect()}

    out = []
    for kind, (keys, stats) in enumerate(parts, 1):
        slots = {key: kinds.slot(kind, place) for place, key in enumerate(keys)}
        used = list(dict.fromkeys(n for some in names[kind - 1] for n, _ in some.values()))
        own = table.where(F.col(kinds.kind) == kind).dropna(subset=list(slots.values())).select(
            *[F.col(slot).alias(key) for key, slot in slots.items()], *used)
        size = found.get(kind)
        side = Side(own, {key: F.col(key) for key in keys}, size["rows"] if size else 0, size["text_bytes"] if size else 0)
        overall, unkeyed = (found[k][NULL_KEY] if k in found else None for k in (0, kind))
        filled = []
        for some, own_names in zip(stats, names[kind - 1]):
            values = {name: side.columns[unique] for name, (unique, _) in own_names.items()}
            for s in some:
                unique, whole = own_names[s.name]
                value, type_, fallback = values[s.name], table.schema[unique].dataType, s.default
                if s.default in (GLOBAL, NULL_KEY):
                    row = overall if s.default == GLOBAL else unkeyed
                    fallback = row[whole or unique] if row else None
                    if fallback is None and s.default == NULL_KEY and isinstance(type_, T.LongType):
                        fallback = 0
                if s.trust:
                    value = F.when(s.trust(values), value)
                if fallback is not None:
                    value = F.coalesce(value, F.lit(fallback).cast(type_))
                values[s.name] = value
            filled.append(values)
        out.append((side, filled))
    return out


def with_history(df: DataFrame, *specs: HistorySpec) -> DataFrame:
    """Add the outputs of all specs.

    Specs with the same history share one aggregation, those with the same key one table. Every table is joined once, and
    one projection adds all columns.
    """
    together: dict[int, dict[tuple, list[HistorySpec]]] = {}
    for spec in specs:
        together.setdefault(id(spec.history), {}).setdefault(tuple(spec.keys), []).append(spec)
    sides, outputs = [], {}
    for by_keys in together.values():
        past = history_rows(df, next(iter(by_keys.values()))[0].history)
        found = _statistics(past, [(keys, [s.stats for s in group]) for keys, group in by_keys.items()])
        for group, (side, filled) in zip(by_keys.values(), found):
            sides.append(side)
            for spec, columns in zip(group, filled):
                outputs |= spec.outputs(columns)
    return join_sides(df, sides, outputs)


def history_stats(df: DataFrame, keys: str | Sequence[str], stats: Sequence[Stat],
                  history: Column | DataFrame | None = None) -> DataFrame:
    """Add per-key statistics of the history to every row."""
    return with_history(df, HistorySpec(as_list(keys), stats, history=history))


def rate(condition: Column) -> Column:
    """Share of rows where a condition holds; unknown rows are left out."""
    return F.avg(condition.cast("int"))


def company(key: str, price: str, log_price: str, *, shares: dict[str, Column], means: dict[str, str],
            history: Column | DataFrame | None = None) -> HistorySpec:
    """What a company chose: count, mean and deviation of the log price, shares and plain means.

    The mean of a company with one choice is replaced by the overall mean. Shares default to 0,
    plain means have no default. ``z_price_vs_company_selected`` compares the raw price with the
    statistics of the log price, as the ranking features it reproduces do.
    """
    def outputs(c: dict[str, Column]) -> dict[str, Column]:
        spread = c["std_selected_price"] + F.lit(1e-6)
        return c | {"z_price_vs_company_selected":
                    F.try_divide(F.col(price) - c["avg_selected_price"], spread)}

    return HistorySpec([key], [
        Stat("company_ocurrence", F.count(F.lit(1)), 0),
        Stat("avg_selected_price", F.avg(log_price), GLOBAL, trust=lambda c: c["company_ocurrence"] > 1),
        Stat("std_selected_price", F.stddev_samp(log_price), GLOBAL),
        *[Stat(name, F.avg(expr), 0.0) for name, expr in shares.items()],
        *[Stat(name, F.avg(column)) for name, column in means.items()],
    ], outputs, history)


def company_stats(df: DataFrame, key: str, price: str, log_price: str, **options) -> DataFrame:
    """Add the ``company`` columns."""
    return with_history(df, company(key, price, log_price, **options))


def selection_rate(key: str, prefix: str, label: str = "selected",
                   train: Column | DataFrame | None = None) -> HistorySpec:
    """Chosen over offered per key among all training rows, and the logs of both counts."""
    def outputs(c: dict[str, Column]) -> dict[str, Column]:
        n, k = c["offered"], c["taken"]
        return {f"{prefix}_selection_rate": F.coalesce(k / n, F.lit(0.0)),
                f"{prefix}_log_total_count": F.coalesce(F.log1p(n.cast("double")), F.lit(0.0)),
                f"{prefix}_log_selected_count": F.coalesce(F.log1p(k.cast("double")), F.lit(0.0))}

    return HistorySpec([key], [Stat("offered", F.count(F.lit(1))), Stat("taken", F.sum(label))], outputs,
                       F.col("split") == "train" if train is None else train)


def carrier_selection_rate(df: DataFrame, key: str, prefix: str, label: str = "selected",
                           train: Column | DataFrame | None = None) -> DataFrame:
    """Add the ``selection_rate`` columns."""
    return with_history(df, selection_rate(key, prefix, label, train))


def cabin_shares(key: str, cabin: str, prefix: str, levels: Sequence[int] = (1, 2, 3, 4),
                 history: Column | DataFrame | None = None) -> HistorySpec:
    """Share of each cabin among the choices of a key, one column a cabin.

    A cabin that no history row has is 0.0 for every row. A cabin that only this key never had, and
    every cabin of an unseen key, is null.
    """
    def outputs(c: dict[str, Column]) -> dict[str, Column]:
        n = c["n"] + F.lit(1e-5)
        return {f"{prefix}_cabin{lv}_select_ratio":
                F.when(c[f"ever{lv}"] == 0, F.lit(0.0)).otherwise(F.when(c[f"k{lv}"] > 0, c[f"k{lv}"] / n))
                for lv in levels}

    def hits(level: int) -> Column:
        return F.count(F.when(F.col(cabin) == level, F.lit(1)))

    return HistorySpec([key], [
        Stat("n", F.count(F.lit(1))), *[Stat(f"k{lv}", hits(lv)) for lv in levels],
        *[Stat(f"ever{lv}", hits(lv), GLOBAL, trust=lambda c: F.lit(False)) for lv in levels],
    ], outputs, history)


def cabin_share_pivot(df: DataFrame, key: str, cabin: str, prefix: str, **options) -> DataFrame:
    """Add the ``cabin_shares`` columns."""
    return with_history(df, cabin_shares(key, cabin, prefix, **options))


def behaviour(key: str, prefix: str, *, price_rank: str, duration_rank: str, hour: str, company: str, user: str,
              history: Column | DataFrame | None = None) -> HistorySpec:
    """Choices of a carrier: mean ranks, mean hour, night share, distinct companies and users."""
    return HistorySpec([key], [
        Stat(f"{prefix}_avg_price_rank", F.avg(price_rank), GLOBAL),
        Stat(f"{prefix}_avg_duration_rank", F.avg(duration_rank), GLOBAL),
        Stat(f"{prefix}_avg_dep_hour", F.avg(hour), 12.0),
        Stat(f"{prefix}_night_ratio", rate(F.col(hour) < 6), 0.0),
        Stat(f"{prefix}_company_diversity", None, 0, distinct=company),
        Stat(f"{prefix}_user_diversity", None, 0, distinct=user),
    ], history=history)


def carrier_behaviour(df: DataFrame, key: str, prefix: str, **options) -> DataFrame:
    """Add the ``behaviour`` columns."""
    return with_history(df, behaviour(key, prefix, **options))


def profile(key: str, *, price_rank: str, duration_rank: str, cabin: str, fallbacks: dict[str, float],
            history: Column | DataFrame | None = None) -> HistorySpec:
    """Choices of a user: count, mean cabin, and the row's ranks less the user's mean ranks."""
    def outputs(c: dict[str, Column]) -> dict[str, Column]:
        n = c["user_selected_count"]
        return {"user_selected_count": n, "user_avg_cabin": c["user_avg_cabin"],
                "user_total_count": F.when(n > 0, n),
                "price_rank_diff": F.col(price_rank) - c["price"],
                "duration_rank_diff": F.col(duration_rank) - c["duration"]}

    return HistorySpec([key], [
        Stat("user_selected_count", F.count(F.lit(1)), 0),
        Stat("price", F.avg(price_rank), fallbacks[price_rank]),
        Stat("duration", F.avg(duration_rank), fallbacks[duration_rank]),
        Stat("user_avg_cabin", F.avg(cabin), fallbacks[cabin]),
    ], outputs, history)


def profile_stats(df: DataFrame, key: str, *, price_rank: str, duration_rank: str, cabin: str,
                  fallbacks: dict[str, float] | None = None,
                  history: Column | DataFrame | None = None) -> DataFrame:
    """Add the ``profile`` columns. Users without history get the given ``fallbacks`` per column, or
    the most likely value of the history's distribution (``density_mode``)."""
    if not fallbacks:  # the past rows are read several times: a narrow copy of them
        history = checkpointed(history_rows(df, history).select(*dict.fromkeys([key, price_rank, duration_rank, cabin])))
    fill = fallbacks or density_modes(history, [price_rank, duration_rank, cabin])
    return with_history(df, profile(key, price_rank=price_rank, duration_rank=duration_rank, cabin=cabin,
                                    fallbacks=fill, history=history))


#: Cells of the density are half a bandwidth wide. A value is at most a quarter of a bandwidth from the middle of its cell, so
#: the terms left out of the series add less than 1.1 * 0.25 ** 16 / sqrt(16!) < 6e-17 of each value's greatest term.
CELL, TERMS, REACH = 0.5, 16, 39.25


def density_curves(df: DataFrame, columns: Sequence[str], points: int = 1000
                   ) -> tuple[DataFrame | None, dict[str, float | None]]:
    """Gaussian kernel densities (Scott bandwidth) of columns on even grids, and the columns without spread.

    The first result has ``column``, ``i``, ``x``, ``density`` (None if no column has a spread), the second the only value of
    the other columns. This is a fast Gauss transform: one pass counts the values of each cell and sums their powers up to
    ``TERMS``, combined before the shuffle; a Hermite series per cell then gives its part at the grid points within
    ``REACH`` bandwidths (beyond that a term is 0 in a double). Rows between stages are cells, whatever the number of values.
    """
    x = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    m = df.agg(*[f(x[c]).alias(f"{name}{i}") for i, c in enumerate(columns) for name, f in
                 (("low", F.min), ("high", F.max), ("std", F.stddev_samp), ("n", F.count))]).first()
    constant = {c: m[f"low{i}"] for i, c in enumerate(columns) if not m[f"n{i}"] or m[f"low{i}"] == m[f"high{i}"]}
    spread = [(i, c) for i, c in enumerate(columns) if c not in constant]
    if not spread:
        return None, constant
    width = {i: m[f"std{i}"] * m[f"n{i}"] ** -0.2 for i, _ in spread}

    def of_column(values: dict[int, float]) -> Column:
        return F.element_at(F.create_map(*[F.lit(v) for item in values.items() for v in item]), F.col("id"))

    narrow = df.select(F.inline(F.array(*[F.struct(
        F.lit(i).alias("id"), ((x[c] - m[f"low{i}"]) / width[i]).alias("u")) for i, c in spread]))).where("u is not null")
    cell = F.floor(F.col("u") / CELL)
    away = F.col("u") - (F.col("cell") + 0.5) * CELL
    cells = narrow.withColumn("cell", cell).groupBy("id", "cell").agg(
        *[F.sum(F.pow(away, F.lit(float(k)))).alias(f"m{k}") for k in range(TERMS)])

    step = of_column({i: (m[f"high{i}"] - m[f"low{i}"]) / (points - 1) / width[i] for i, _ in spread})
    middle = (F.col("cell") + 0.5) * CELL
    first = F.greatest(F.lit(0), F.ceil((middle - REACH) / step))
    last = F.least(F.lit(points - 1), F.floor((middle + REACH) / step))
    sums = F.array(*[F.struct(F.lit(float(k)).alias("k"), (F.col(f"m{k}") / math.factorial(k)).alias("m"))
                     for k in range(TERMS)])
    near = (cells.select("id", sums.alias("sums"), middle.alias("middle"), F.explode(F.sequence(first, last)).alias("i"))
            .withColumn("t", F.col("i") * step - F.col("middle")))
    start = F.struct(F.lit(0.0).alias("before"), F.lit(1.0).alias("now"), F.lit(0.0).alias("sum"))
    series = F.aggregate("sums", start, lambda s, term: F.struct(
        s["now"].alias("before"), (F.col("t") * s["now"] - term["k"] * s["before"]).alias("now"),
        (s["sum"] + term["m"] * s["now"]).alias("sum")), lambda s: s["sum"])
    part = F.exp(-F.col("t") * F.col("t") / 2) * series
    scale = of_column({i: m[f"n{i}"] * width[i] * math.sqrt(2 * math.pi) for i, _ in spread})
    names = F.element_at(F.create_map(*[F.lit(v) for item in spread for v in item]), F.col("id"))
    grid = of_column({i: m[f"low{i}"] for i, _ in spread}) + F.col("i") * of_column(
        {i: (m[f"high{i}"] - m[f"low{i}"]) / (points - 1) for i, _ in spread})
    return near.groupBy("id", "i").agg(F.sum(part).alias("sum")).select(
        names.alias("column"), "i", grid.alias("x"), (F.greatest(F.col("sum"), F.lit(0.0)) / scale).alias("density")), constant


def density_curve(df: DataFrame, column: str, points: int = 1000) -> DataFrame | None:
    """``i``, ``x``, ``density`` of one column; None without spread."""
    curve, _ = density_curves(df, [column], points)
    return None if curve is None else curve.drop("column")


def density_modes(df: DataFrame, columns: Sequence[str], points: int = 1000) -> dict[str, float | None]:
    """The grid point with the highest density of each column; a constant column gives its value."""
    curve, modes = density_curves(df, columns, points)
    if curve is not None:
        best = curve.groupBy("column").agg(F.max_by("x", F.struct("density", -F.col("i"))).alias("x"))
        modes = modes | {row["column"]: row["x"] for row in best.collect()}
    return modes


def density_mode(df: DataFrame, column: str, points: int = 1000) -> float | None:
    return density_modes(df, [column], points)[column]


def tariff_code(key: str, *, price_rank: str, duration_rank: str,
                history: Column | DataFrame | None = None) -> HistorySpec:
    """Choices per tariff code; unseen and missing codes get the statistics of no-code choices."""
    return HistorySpec([key], [
        Stat(f"{key}_hotness", F.count(F.lit(1)), NULL_KEY),
        Stat(f"{key}_price_rank_mean", F.avg(price_rank), NULL_KEY),
        Stat(f"{key}_duration_rank_mean", F.avg(duration_rank), NULL_KEY),
    ], history=history)


def tariff_code_stats(df: DataFrame, key: str, **options) -> DataFrame:
    """Add the ``tariff_code`` columns."""
    return with_history(df, tariff_code(key, **options))


def route(key: str, *, log_price: str, duration: str, policy: str, direct: str,
          history: Column | DataFrame | None = None) -> HistorySpec:
    """Choices per route: count, mean log price and duration, policy rate, direct share."""
    return HistorySpec([key], [
        Stat(f"{key}_hotness", F.count(F.lit(1)), 0),
        Stat(f"{key}_avg_price", F.avg(log_price), GLOBAL),
        Stat(f"{key}_avg_duration", F.avg(duration), GLOBAL),
        Stat(f"{key}_policy_rate", F.avg(policy), 0.0),
        Stat(f"{key}_direct_ratio", F.avg(direct)),
    ], history=history)


def route_stats(df: DataFrame, key: str, **options) -> DataFrame:
    """Add the ``route`` columns."""
    return with_history(df, route(key, **options))


def route_aircraft_stats(df: DataFrame, route: str, aircraft: str, *, price_rank: str,
                         duration_rank: str, history: Column | DataFrame | None = None) -> DataFrame:
    """Share of each aircraft among the choices on a route, and mean ranks of the pair."""
    pair, whole = scratch("pair"), scratch("whole")
    out = with_history(
        df,
        HistorySpec([route, aircraft], [
            Stat(pair, F.count(F.lit(1))), Stat("aircraft_avg_pct", F.avg(price_rank)),
            Stat("aircraft_avg_dct", F.avg(duration_rank))], history=history),
        HistorySpec([route], [Stat(whole, F.count(F.lit(1)))], history=history))
    return out.withColumn("route_aircraft_ratio", F.col(pair) / F.col(whole)).drop(pair, whole)

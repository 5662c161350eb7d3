"""Operators inside a group (a search session, a query, a basket).

Most are a ``GroupSpec``: aggregates of the group and row expressions over them. ``with_group`` adds any number of specs: as
windows over one layout of the rows, or, where a group is hot, as one aggregation that is joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choicerank.operators.groups import (as_list, attach, dense_positions, distinct_counts, group_quantiles, has_hot_groups, join_on,
                                         known, long, measured, over_group, quantile_position, running, scratch, together)


@dataclass
class GroupSpec:
    """Aggregates, distinct counts and quantiles of a group, and the row columns made from them.

    ``distinct`` counts the different values of a column, null being one.
    """

    outputs: dict[str, Column]
    aggregates: dict[str, Column] = field(default_factory=dict)
    quantiles: dict[str, dict[str, float | str]] = field(default_factory=dict)
    distinct: dict[str, str] = field(default_factory=dict)


def with_group(df: DataFrame, keys: str | Sequence[str], *specs: GroupSpec,
               null_keys: bool = True, source: DataFrame | None = None) -> DataFrame:
    """Add the outputs of all specs.

    Without hot groups all statistics are windows over the group: one scan and one exchange, or none where the rows of a
    group lie together already. With hot groups they are one aggregation and one join on the group key; ``source`` is
    an earlier frame with the same rows to aggregate then instead of ``df``.

    Rows with a null key form a group, unless ``null_keys=False``: then their statistics are null.
    """
    keys = as_list(keys)
    df = measured(df, keys)
    spec = GroupSpec({n: e for s in specs for n, e in s.outputs.items()},
                     {n: e for s in specs for n, e in s.aggregates.items()}, {},
                     {n: c for s in specs for n, c in s.distinct.items()})
    for s in specs:
        for value, picks in s.quantiles.items():
            spec.quantiles.setdefault(value, {}).update(picks)
    if has_hot_groups(df, keys):
        out = _joined_back(df, keys, spec, null_keys, df if source is None else source)
    else:
        out = _windowed(df, keys, spec, null_keys)
    kept = [F.col(c) for c in df.columns if c not in spec.outputs]
    return out.select(*kept, *[e.alias(n) for n, e in spec.outputs.items()])


def _joined_back(df: DataFrame, keys: list[str], spec: GroupSpec, null_keys: bool, source: DataFrame) -> DataFrame:
    source = source if null_keys else source.dropna(subset=keys)
    stats = [group_quantiles(source, keys, value, picks) for value, picks in spec.quantiles.items()]
    if spec.distinct:
        stats.insert(0, distinct_counts(source, keys, spec.distinct))
    if spec.aggregates:
        stats.insert(0, source.groupBy(*keys).agg(*[e.alias(n) for n, e in spec.aggregates.items()]))
    return join_on(df, reduce(lambda a, b: join_on(a, b, keys, null_keys=True), stats), keys, null_keys=True)


def _windowed(df: DataFrame, keys: list[str], spec: GroupSpec, null_keys: bool) -> DataFrame:
    """Ordered windows first: what they sort serves the others too."""
    w = Window.partitionBy(*keys)
    places, last = {}, {}
    for value in spec.quantiles:
        last[value] = (scratch("place"), scratch("n"))
        places |= {last[value][0]: F.row_number().over(w.orderBy(F.col(value).asc_nulls_last())) - 1,
                   last[value][1]: F.count(value).over(w)}
    ranks = {n: scratch("rank") for n in spec.distinct}
    places |= {ranks[n]: F.dense_rank().over(w.orderBy(c)) for n, c in spec.distinct.items()}
    stats = {n: e.over(w) for n, e in spec.aggregates.items()}
    stats |= {n: long(F.max(rank).over(w)) for n, rank in ranks.items()}
    for value, picks in spec.quantiles.items():
        place, n = (F.col(c) for c in last[value])
        for name, pick in picks.items():
            found = [F.max(F.when(place == p, F.col(value))).over(w) for p in quantile_position(pick, n)]
            stats[name] = found[0] if len(found) == 1 else (found[0] + found[1]) / 2
    if not null_keys:
        stats = {n: known(e, keys) for n, e in stats.items()}
    return over_group(over_group(df, keys, places) if places else df, keys, stats)


def flag(condition: Column) -> Column:
    """0/1 of a condition; unknown stays null."""
    return condition.cast("int")


def minmax(columns: Mapping[str, str]) -> GroupSpec:
    """``(x - min) / (max - min + 1e-9)`` for each ``{column: output}``."""
    aggregates, outputs = {}, {}
    for column, output in columns.items():
        low, high = scratch("low"), scratch("high")
        aggregates |= {low: F.min(column), high: F.max(column)}
        outputs[output] = (F.col(column) - F.col(low)) / (F.col(high) - F.col(low) + F.lit(1e-9))
    return GroupSpec(outputs, aggregates)


def group_minmax(df: DataFrame, group: str | Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Min-max scale columns within the group."""
    return with_group(df, group, minmax(columns))


def minimum_flags(columns: Mapping[str, str], zero_when: Mapping[str, Column] | None = None) -> GroupSpec:
    """1 on rows that equal the group minimum; ``zero_when[output]`` forces 0."""
    zero_when = zero_when or {}
    aggregates, outputs = {}, {}
    for column, output in columns.items():
        low = scratch("low")
        aggregates[low] = F.min(column)
        expr = flag(F.col(column) == F.col(low))
        if output in zero_when:
            expr = F.when(zero_when[output], F.lit(0)).otherwise(expr)
        outputs[output] = expr
    return GroupSpec(outputs, aggregates)


def is_group_min(df: DataFrame, group: str | Sequence[str], columns: Mapping[str, str],
                 zero_when: Mapping[str, Column] | None = None) -> DataFrame:
    """Flag the rows at the group minimum of each column; a null value gives null."""
    return with_group(df, group, minimum_flags(columns, zero_when))


def size(column: str, output: str) -> GroupSpec:
    n = scratch("n")
    return GroupSpec({output: F.col(n)}, {n: F.count(column)})


def group_size(df: DataFrame, group: str | Sequence[str], column: str,
               output: str = "group_size") -> DataFrame:
    """Rows of the group whose ``column`` is not null."""
    return with_group(df, group, size(column, output))


def moments(columns: Mapping[str, str]) -> GroupSpec:
    """``<prefix>_mean``, ``<prefix>_std`` (sample) and ``<prefix>_range`` per ``{column: prefix}``."""
    aggregates, outputs = {}, {}
    for column, prefix in columns.items():
        mean, std, low, high = (scratch(x) for x in ("mean", "std", "low", "high"))
        aggregates |= {mean: F.avg(column), std: F.stddev_samp(column),
                       low: F.min(column), high: F.max(column)}
        outputs |= {f"{prefix}_mean": F.col(mean), f"{prefix}_std": F.col(std),
                    f"{prefix}_range": F.col(high) - F.col(low)}
    return GroupSpec(outputs, aggregates)


def group_moments(df: DataFrame, group: str | Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Mean, sample deviation and range of columns in the group; one value has no deviation."""
    return with_group(df, group, moments(columns))


def group_position(df: DataFrame, group: str | Sequence[str], order: Sequence[Column],
                   output: str = "group_position") -> DataFrame:
    """1-based place of the row in its group; ``order`` must be unique in the group."""
    return running(df, group, order, output)


def count_in_group(df: DataFrame, group: str | Sequence[str], key: str | Sequence[str],
                   output: str, source: DataFrame | None = None) -> DataFrame:
    """Rows of the group that share the key; a null key has no count."""
    return attach(df, [*as_list(group), *as_list(key)], {output: F.count(F.lit(1))}, null_keys=False,
                  source=source)


def nunique(keys: Mapping[str, str]) -> GroupSpec:
    names = {output: scratch("distinct") for output in keys.values()}
    return GroupSpec({output: F.col(n) for output, n in names.items()},
                     distinct={names[output]: key for key, output in keys.items()})


def nunique_in_group(df: DataFrame, group: str | Sequence[str], keys: Mapping[str, str]) -> DataFrame:
    """Distinct values per group for each ``{column: output}``."""
    return with_group(df, group, nunique(keys))


def ordinal_rank_ratio(df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str],
                       output: str) -> DataFrame:
    """Ordinal rank of ``value`` among rows with the same keys, over their number.

    A null value has no rank; it still counts in the number.
    """
    place, n = scratch("place"), scratch("n")
    order = [F.col(value), *[F.col(t) for t in ties]]
    out = running(df, keys, order, place, total=n)
    return out.withColumn(output, F.when(F.col(value).isNotNull(), F.col(place) / F.col(n))).drop(place, n)


_PRICE_STATS = {"median": "median", "q25": 0.25, "q75": 0.75}


def group_price_stats(df: DataFrame, group: str | Sequence[str], value: str,
                      prefix: str = "grp_price") -> DataFrame:
    """One row a group: median, std, min, mean, max, nearest quartiles and their distance."""
    keys = as_list(group)
    stats = df.groupBy(*keys).agg(
        F.stddev_samp(value).alias(f"{prefix}_std"), F.min(value).alias(f"{prefix}_min"),
        F.avg(value).alias(f"{prefix}_mean"), F.max(value).alias(f"{prefix}_max"))
    picks = {f"{prefix}_{n}": q for n, q in _PRICE_STATS.items()}
    quartiles = group_quantiles(df, keys, value, picks)
    return join_on(stats, quartiles, keys, null_keys=True).withColumn(
        f"{prefix}_iqr", F.col(f"{prefix}_q75") - F.col(f"{prefix}_q25"))


def relative_price(value: str, names: Mapping[str, str] | None = None) -> GroupSpec:
    """Place of a price in its group.

    ``cheapest`` at the minimum, ``z`` distance from the median over std + 1 (0 where unknown),
    ``above_min`` distance from the minimum over min + 1, ``below_q25`` and ``outlier`` (above
    q75 + 1.5 * IQR). ``names`` renames the outputs.
    """
    names = {k: k for k in ("cheapest", "z", "above_min", "below_q25", "outlier")} | dict(names or {})
    std, low, median, q25, q75 = (scratch(x) for x in ("std", "low", "median", "q25", "q75"))
    x = F.col(value)
    return GroupSpec(
        outputs={
            names["cheapest"]: flag(x == F.col(low)),
            names["z"]: F.coalesce((x - F.col(median)) / (F.col(std) + 1), F.lit(0.0)),
            names["above_min"]: F.try_divide(x - F.col(low), F.col(low) + 1),
            names["below_q25"]: flag(x < F.col(q25)),
            names["outlier"]: flag(x > F.col(q75) + 1.5 * (F.col(q75) - F.col(q25))),
        },
        aggregates={std: F.stddev_samp(value), low: F.min(value)},
        quantiles={value: {median: "median", q25: 0.25, q75: 0.75}})


def group_relative_price(df: DataFrame, group: str | Sequence[str], value: str,
                         names: Mapping[str, str] | None = None) -> DataFrame:
    """Add the ``relative_price`` columns."""
    return with_group(df, group, relative_price(value, names))


def filtered_minimum(predicate: Column, columns: Mapping[str, str]) -> GroupSpec:
    """1 on rows that satisfy the predicate and hold the least value among those that do."""
    aggregates, outputs = {}, {}
    for column, output in columns.items():
        low = scratch("low")
        aggregates[low] = F.min(F.when(predicate, F.col(column)))
        outputs[output] = F.coalesce(flag(predicate & (F.col(column) == F.col(low))), F.lit(0))
    return GroupSpec(outputs, aggregates)


def filtered_group_min(df: DataFrame, group: str | Sequence[str], predicate: Column,
                       columns: Mapping[str, str]) -> DataFrame:
    """Flag the best rows among those that satisfy a predicate."""
    return with_group(df, group, filtered_minimum(predicate, columns))


def same_offer_features(df: DataFrame, group: str | Sequence[str], key: str, value: str,
                        source: DataFrame | None = None) -> DataFrame:
    """Offers of the same item in a group: count, cheapest, ratio to the least, dense percentile.

    ``key`` may be null; rows with a null key form one item, as rows of a null window key do.
    """
    keys = [*as_list(group), key]
    low, rank = scratch("low"), scratch("rank")
    df = measured(df, group)
    if has_hot_groups(df, group):
        source = df if source is None else source
        out = attach(df, keys, {"flight_option_count": F.count(F.lit(1)), low: F.min(value)}, source=source)
        out = join_on(out, dense_positions(source, keys, value, rank), [*keys, value], null_keys=True)
    else:
        w = Window.partitionBy(*keys)
        place = F.dense_rank().over(w.orderBy(F.col(value).asc_nulls_last()))
        out = over_group(together(df, group), keys, {
            rank: F.when(F.col(value).isNotNull(), place),
            "flight_option_count": F.count(F.lit(1)).over(w), low: F.min(value).over(w)})
    n = F.col("flight_option_count")
    return out.withColumns({
        "is_flight_cheapest": flag(F.col(value) == F.col(low)),
        "price_to_flight_min_ratio": F.col(value) / (F.col(low) + F.lit(1e-6)),
        "flight_price_percentile": F.col(rank) / n,
        "is_flight_only_option": flag(n == 1),
    }).drop(low, rank)


def filter_groups_by_size(df: DataFrame, group: str | Sequence[str], more_than: int = 10) -> DataFrame:
    """Keep the rows of groups with more than ``more_than`` rows (non-null keys)."""
    keys = as_list(group)
    n = scratch("n")
    large = (df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
             .where(F.col(n) > more_than).drop(n))
    return join_on(df, large, keys, how="left_semi", null_keys=True)

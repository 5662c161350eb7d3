"""Whole-table operators: split, union, sampling, pruning, null fill, imputation, clipping."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from fnmatch import fnmatchcase
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicerank.operators.groups import as_list, column_quantiles


def split_at(df: DataFrame, order: str, cuts: Mapping[str, object], rest: str,
             output: str = "split") -> DataFrame:
    """Name the split of each row: the first ``{name: bound}`` with ``order < bound``, else ``rest``.

    Bounds are values of the order column, given in ascending order.
    """
    whens = reduce(lambda acc, item: acc.when(F.col(order) < F.lit(item[1]), F.lit(item[0])),
                   cuts.items(), F)
    return df.withColumn(output, whens.otherwise(F.lit(rest)))


def with_split(df: DataFrame, order: str, shares: Mapping[str, float], rest: str,
               output: str = "split") -> DataFrame:
    """Split by time: ``{"train": 0.7, "val": 0.9}`` cuts at those exact fractions of the rows.

    The cut is the value at the nearest row of the ordered column, so rows of one instant stay
    together.
    """
    picks = {name: float(share) for name, share in shares.items()}
    bounds = column_quantiles(df, order, picks)
    return split_at(df, order, {name: bounds[name] for name in shares}, rest, output)


def split_frames(df: DataFrame, features: Sequence[str], label: str, group: str,
                 split: str = "split") -> dict[str, DataFrame]:
    """Frames of features, label and group per split, and ``full`` for train and validation."""
    wanted = df.select(*features, label, group, split)
    frames = {name: wanted.where(F.col(split) == name) for name in ("train", "val", "test")}
    frames["full"] = wanted.where(F.col(split).isin("train", "val"))
    return frames


def append_test(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Stack the unlabelled rows under the labelled ones with label 0."""
    return train.unionByName(test.withColumn(label, F.lit(0).cast("bigint")))


def sample_groups(df: DataFrame, key: str | Sequence[str], fraction: float, seed: int = 42) -> DataFrame:
    """Keep all rows of a sample of the groups, chosen by a hash of key and seed.

    The choice needs no shuffle and is the same on every run and on every table with the key.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in as_list(key)])
    bucket = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return df.where(bucket < F.lit(int(fraction * 2**32)))


def prune_columns(df: DataFrame, patterns: Iterable[str]) -> DataFrame:
    """Drop the columns whose name matches one of the shell-style patterns."""
    patterns = list(patterns)
    return df.drop(*[c for c in df.columns if any(fnmatchcase(c, p) for p in patterns)])


def distinct_values(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Distinct rows of the columns."""
    return df.select(*as_list(columns)).distinct()


def fill_all_nulls(df: DataFrame, number: float = 0, text: str = "missing") -> DataFrame:
    """Numeric nulls become 0 and string nulls "missing"; other types are left alone."""
    return df.na.fill(number).na.fill(text)


def impute(df: DataFrame, constants: Mapping[str, object] | None = None,
           means: Iterable[str] = (), source: DataFrame | None = None) -> DataFrame:
    """Fill nulls with constants, or with the mean of the whole column (one aggregation for all).

    ``source`` is another frame with the same values, for instance a narrow copy, to take the means from.
    """
    means = list(means)
    filled: dict[str, Column] = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in (constants or {}).items()}
    if means:
        found = (df if source is None else source).agg(*[F.avg(c).alias(c) for c in means]).first()
        filled |= {c: F.coalesce(F.col(c).cast("double"), F.lit(found[c])) for c in means}
    return df.withColumns(filled)


def winsorize(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99,
              accuracy: int | None = None, source: DataFrame | None = None) -> DataFrame:
    """Clip a column to its global quantiles, of ``source`` if that is given; a null stays null.

    Exact by default (``column_quantiles``). ``accuracy`` switches to
    ``percentile_approx``, one pass.
    """
    source = df if source is None else source
    if accuracy:
        bounds = source.agg(F.percentile_approx(column, low, accuracy).alias("low"),
                        F.percentile_approx(column, high, accuracy).alias("high")).first()
    else:
        bounds = column_quantiles(source, column, {"low": low, "high": high})
    x = F.col(column)
    return df.withColumn(column, F.when(x < F.lit(bounds["low"]), F.lit(bounds["low"]))
                         .when(x > F.lit(bounds["high"]), F.lit(bounds["high"])).otherwise(x))

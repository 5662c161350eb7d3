"""Ranking and re-ranking inside a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choicerank.functions.calendar import as_time
from choicerank.operators.groups import (as_list, attach, by_size, has_hot_groups, join_on, measured, running, scratch,
                                         together, top_rows)
from choicerank.settings import checkpointed


def best_first(score: str | Column, ties: Sequence[str]) -> list[Column]:
    """Sort keys for a descending score with ties broken by ``ties``."""
    if not ties:
        raise ValueError("name tie columns that are unique in the group, or ranks are not repeatable")
    value = F.col(score) if isinstance(score, str) else score
    return [-value, *[F.col(t) for t in ties]]


def rank_within_group(df: DataFrame, group: str | Sequence[str], score: str, ties: Sequence[str],
                      output: str = "selected") -> DataFrame:
    """Rank 1..n by descending score."""
    return running(df, group, best_first(score, ties), output)


def top_k_per_group(df: DataFrame, group: str | Sequence[str], score: str, ties: Sequence[str], k: int,
                    output: str = "rank") -> DataFrame:
    """The k best rows of each group."""
    return top_rows(df, group, best_first(score, ties), k, output)


def penalty_score(df: DataFrame, group: str | Sequence[str], key: str | Sequence[str], score: str,
                  factor: float = 0.1, output: str = "reorder_score") -> DataFrame:
    """Lower a score by ``factor`` times its distance to the best of the same key in the group."""
    best = scratch("best")
    out = attach(df, [*as_list(group), *as_list(key)], {best: F.max(score)})
    s = F.col(score)
    return out.withColumn(output, s - F.lit(factor) * (F.col(best) - s)).drop(best)


def duplicate_penalty_rerank(df: DataFrame, group: str | Sequence[str], key: str | Sequence[str],
                             score: str, ties: Sequence[str], factor: float = 0.1,
                             output: str = "new_selected") -> DataFrame:
    """Rank again after pushing down the worse offers of the same item."""
    df = measured(df, group)
    df = df if has_hot_groups(df, group) else together(df, group)  # both windows use one exchange
    penalised = penalty_score(df, group, key, score, factor)
    return rank_within_group(penalised, group, "reorder_score", ties, output)


def make_submission(df: DataFrame, group: str, row: str, score: str, *, key: str | Sequence[str] = (),
                    rerank: bool = False, keep_score: bool = False, factor: float = 0.1,
                    output: str = "selected", extra: Sequence[str] = ()) -> DataFrame:
    """Row id, group, rank and on request the score, re-ranked by ``key`` on request."""
    if rerank:
        ranked = duplicate_penalty_rerank(df, group, key, score, [row], factor, output)
    else:
        ranked = rank_within_group(df, group, score, [row], output)
    score_column = [F.col(score).alias("pred_score")] if keep_score else []
    return ranked.select(row, group, output, *score_column, *extra)


def option_similarity(a: str, b: str, times: Sequence[str], categories: Sequence[str],
                      hours: float = 24.0) -> Column:
    """Mean likeness of two options held in struct columns ``a`` and ``b``.

    A time counts ``max(0, 1 - distance / hours)``, a category 1 when equal. A time that cannot be
    read is the epoch and a missing category equals another missing one.
    """
    return similarity([F.col(f"{a}.{c}") for c in times], [F.col(f"{b}.{c}") for c in times],
                      [F.col(f"{a}.{c}") for c in categories], [F.col(f"{b}.{c}") for c in categories],
                      hours)


def epoch_seconds(text: Column) -> Column:
    """Seconds of a naive time since the epoch, 0 where it cannot be read."""
    zero = F.lit("1970-01-01").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", zero, as_time(text.cast("string")))
    return F.coalesce(micros.cast("double") / 1e6, F.lit(0.0))


def similarity(times_a: Sequence[Column], times_b: Sequence[Column], categories_a: Sequence[Column],
               categories_b: Sequence[Column], hours: float = 24.0) -> Column:
    near = [closeness(epoch_seconds(x), epoch_seconds(y), hours) for x, y in zip(times_a, times_b)]
    return mean_likeness(near, [x.eqNullSafe(y) for x, y in zip(categories_a, categories_b)])


def closeness(x: Column, y: Column, hours: float) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(x - y) / 3600 / hours)


def mean_likeness(near: Sequence[Column], same: Sequence[Column]) -> Column:
    parts = [*near, *[s.cast("double") for s in same]]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total / len(parts)


def mmr_rerank(df: DataFrame, group: str, row: str, score: str, times: Sequence[str],
               categories: Sequence[str], top_k: int = 10, lam: float = 0.7,
               output: str = "new_selected") -> DataFrame:
    """Greedy diverse choice: best score first, then the best ``lam*score - (1-lam)*likeness``.

    Likeness is the highest to any row chosen before. Returns the chosen rows with rank 1..k.
    Ordinary groups run all rounds as windows over one shuffle. Hot groups run each round as an
    aggregation whose winners, k a group, are broadcast back.
    """
    time_names = [f"t{i}" for i in range(len(times))]
    category_names = [f"c{i}" for i in range(len(categories))]
    value = F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))
    base = df.select(F.col(group), F.col(row), value.alias("pred_score"),
                     *[epoch_seconds(F.col(c)).alias(n) for c, n in zip(times, time_names)],
                     *[F.col(c).alias(n) for c, n in zip(categories, category_names)])
    names = (time_names, category_names)
    usual, hot = by_size(base, [group])
    out = _mmr_windows(usual, group, row, names, top_k, lam, output)
    if hot is not None:
        out = out.unionByName(_mmr_rounds(hot, group, row, names, top_k, lam, output))
    return out


def _likeness_to(winner: Column, names) -> Column:
    times, categories = names
    near = [closeness(F.col(t), winner.getField(t), 24.0) for t in times]
    return mean_likeness(near, [F.col(c).eqNullSafe(winner.getField(c)) for c in categories])


def _mmr_windows(df, group, row, names, top_k, lam, output):
    w = Window.partitionBy(group)
    out = df.withColumns({output: F.lit(None).cast("bigint"), "near": F.lit(0.0)})
    for place in range(1, top_k + 1):
        value = F.col("pred_score") if place == 1 else (
            lam * F.col("pred_score") - (1 - lam) * F.col("near"))
        offer = F.struct((-value).alias("cost"), row, *names[0], *names[1])
        out = out.withColumn("winner", F.min(F.when(F.col(output).isNull(), offer)).over(w))
        won = F.col(output).isNull() & (F.col(row) == F.col("winner")[row])
        like = _likeness_to(F.col("winner"), names)
        out = out.withColumns({
            output: F.when(won, F.lit(place).cast("bigint")).otherwise(F.col(output)),
            "near": like if place == 1 else F.greatest(F.col("near"), like),
        }).drop("winner")
    return out.where(F.col(output).isNotNull()).select(row, group, output, "pred_score")


def _mmr_rounds(df, group, row, names, top_k, lam, output):
    chosen, df = None, checkpointed(df)
    for place in range(1, top_k + 1):
        rest, value = df, F.col("pred_score")
        if chosen is not None:
            before = chosen.groupBy(group).agg(F.collect_list("winner").alias("winners"))
            rest = join_on(df, before, [group], null_keys=True, broadcast=True).where(
                ~F.exists("winners", lambda x: x[row] == F.col(row)))
            near = F.array_max(F.transform("winners", lambda x: _likeness_to(x, names)))
            value = lam * value - (1 - lam) * near
        offer = F.struct((-value).alias("cost"), row, *names[0], *names[1], "pred_score")
        winners = rest.groupBy(group).agg(F.min(offer).alias("winner")).select(
            group, "winner", F.lit(place).cast("bigint").alias(output))
        winners = checkpointed(winners)  # at most one row a hot group
        chosen = winners if chosen is None else chosen.unionByName(winners)
    return chosen.select(F.col(f"winner.{row}").alias(row), group, output,
                         F.col("winner.pred_score").alias("pred_score"))


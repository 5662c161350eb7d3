"""Ranking metrics. They need only the first rows of each group and one row a group after that."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choicerank.operators.groups import (as_list, ascending, column_quantiles, has_hot_groups, join_on, known, largest_group,
                                         measured, over_group, scratch, together, top_rows)
from choicerank.operators.rerank import best_first
from choicerank.settings import checkpointed


def _placed(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame | None:
    """All rows with their place in the group, from one exchange, if it is noted that no group is hot; else None.

    A frame without a note is not counted for this: that would read it once more.
    """
    if largest_group(df, keys) is None or has_hot_groups(df, keys):
        return None
    return over_group(df, keys, {name: F.row_number().over(Window.partitionBy(*keys).orderBy(*ascending(order)))})


def group_hits(df: DataFrame, group: str | Sequence[str], order: Sequence[Column], label: str, k: int,
               more_than: int = 10) -> DataFrame:
    """One row per group with more than ``more_than`` rows: size and rank of the first hit within k."""
    keys = as_list(group)
    place = scratch("place")
    first_hit = F.min(F.when((F.col(place) <= k) & (F.col(label) == 1), F.col(place))).alias("first_hit")
    placed = _placed(df.dropna(subset=keys), keys, order, place)
    if placed is not None:
        return (placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"), first_hit)
                .where(F.col("group_size") > more_than))
    sizes = (df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"))
             .where(F.col("group_size") > more_than))
    first = top_rows(df, keys, order, k, place).groupBy(*keys).agg(first_hit)
    return join_on(sizes, first, keys)


def hit(k: int) -> Column:
    return F.coalesce(F.col("first_hit") <= k, F.lit(False)).cast("int")


def hitrate_at_k(df: DataFrame, group: str, score: str, label: str, ties: Sequence[str], k: int = 3,
                 more_than: int = 10) -> DataFrame:
    """Share of large groups whose k best rows hold a chosen one."""
    hits = group_hits(df, group, best_first(score, ties), label, k, more_than)
    return hits.agg(F.avg(hit(k)).alias("hitrate"), F.count(F.lit(1)).alias("n_groups"))


def hitrate_of_rank(df: DataFrame, group: str, rank: str, label: str, k: int = 3,
                    more_than: int = 10) -> DataFrame:
    """``hitrate_at_k`` of rows that are ranked already."""
    keys = as_list(group)
    found = df.dropna(subset=keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("group_size"),
        F.min(F.when(F.col(label) == 1, F.col(rank))).alias("first_hit"))
    return found.where(F.col("group_size") > more_than).agg(
        F.avg(hit(k)).alias("hitrate"), F.count(F.lit(1)).alias("n_groups"))


def missed_groups(df: DataFrame, group: str, score: str, label: str, ties: Sequence[str], k: int = 3,
                  more_than: int = 10) -> DataFrame:
    """All rows of the large groups without a hit; empty when there is none."""
    hits = group_hits(df, group, best_first(score, ties), label, k, more_than)
    return join_on(df, hits.where(hit(k) == 0).select(group), [group], how="left_semi",
                   null_keys=True)


def _curve(hits: DataFrame, ks: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    wide = hits.groupBy(*by).agg(*[F.avg(hit(k)).alias(f"k{k}") for k in ks])
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("hitrate")) for k in ks])
    return wide.select(*by, F.inline(pairs))


def hitrate_curve(df: DataFrame, group: str, score: str, label: str, ties: Sequence[str],
                  ks: Iterable[int] = range(1, 21), more_than: int = 10) -> DataFrame:
    """Hit rate at every k, in one pass."""
    ks = list(ks)
    return _curve(group_hits(df, group, best_first(score, ties), label, max(ks), more_than), ks)


def hit_summary(df: DataFrame, group: str, score: str, label: str, ties: Sequence[str],
                more_than: int = 10) -> DataFrame:
    """Hit rate at 1, 3, 4, 5, 6 and 10."""
    return hitrate_curve(df, group, score, label, ties, (1, 3, 4, 5, 6, 10), more_than)


def hitrate_by_size_quantile(df: DataFrame, group: str, score: str, label: str, ties: Sequence[str],
                             ks: Iterable[int] = range(1, 21), more_than: int = 10) -> DataFrame:
    """Curves of small, medium and large groups, cut at the quartiles of the group sizes."""
    ks = list(ks)
    hits = checkpointed(group_hits(df, group, best_first(score, ties), label, max(ks), more_than))
    cuts = column_quantiles(hits, "group_size", {"q25": 0.25, "q75": 0.75})
    size = F.col("group_size")
    band = (F.when(size <= F.lit(cuts["q25"]), F.lit("small"))
            .when(size <= F.lit(cuts["q75"]), F.lit("medium")).otherwise(F.lit("large")))
    return _curve(hits.withColumn("size_band", band), ks, ["size_band"])


def log_edges(low: float, high: float, bins: int) -> list[float]:
    """Evenly spaced edges on a log scale."""
    start, end = math.log10(low), math.log10(high)
    step = (end - start) / bins
    return [math.pow(10, start + i * step) for i in range(bins)] + [math.pow(10, end)]


def hitrate_by_log_bin(df: DataFrame, group: str, score: str, label: str, ties: Sequence[str],
                       k: int = 3, bins: int = 50, min_groups: int = 3,
                       more_than: int = 10) -> DataFrame:
    """Hit rate and number of groups per log-spaced group size, bins with enough groups only."""
    hits = checkpointed(group_hits(df, group, best_first(score, ties), label, k, more_than))
    ends = hits.agg(F.min("group_size"), F.max("group_size")).first()
    if ends[0] is None:
        edges = [1.0] * (bins + 1)
    else:
        edges = log_edges(ends[0], ends[1], bins)
    edge_array = F.array(*[F.lit(e) for e in edges])
    centers = F.array(*[F.lit((a + b) / 2) for a, b in zip(edges, edges[1:])])
    size = F.col("group_size").cast("double")
    index = F.size(F.filter(edge_array, lambda e: e <= size)) - 1
    inside = F.least(F.greatest(F.col("bin_idx"), F.lit(0)), F.lit(bins - 1))
    return (hits.groupBy(index.alias("bin_idx"))
            .agg(F.avg(hit(k)).alias("hitrate3"), F.count(F.lit(1)).alias("n_groups"))
            .where(F.col("n_groups") >= min_groups)
            .withColumn("bin_center", F.get(centers, inside)).orderBy("bin_center"))


def group_ndcg(df: DataFrame, keys: Sequence[str], score: str, label: str, ties: Sequence[str], k: int = 3,
               empty: float = 1.0) -> DataFrame:
    """``keys`` and ``ndcg`` at k of each group, with gain 1 for a chosen row; a group without one has ``empty``."""
    place, gain, chosen = scratch("place"), scratch("gain"), scratch("chosen")
    count = F.sum(F.col(label).cast("bigint")).alias(chosen)
    gained = F.sum(F.when(F.col(place) <= k, F.col(label) / F.log2(F.col(place) + 1))).alias(gain)
    value = ndcg_of(F.col(gain), F.col(chosen), k, empty)
    placed = _placed(df, keys, best_first(score, ties), place)
    if placed is not None:
        return placed.groupBy(*keys).agg(count, gained).select(*keys, value.alias("ndcg"))
    totals = df.groupBy(*keys).agg(count)
    gains = top_rows(df, keys, best_first(score, ties), k, place).groupBy(*keys).agg(gained)
    return join_on(totals, gains, keys, null_keys=True).select(*keys, value.alias("ndcg"))


def ndcg_of(gain: Column, chosen: Column, k: int, empty: float = 1.0) -> Column:
    """The gain at k of a group by that of its best order; ``empty`` without chosen rows."""
    ideal = [sum(1 / math.log2(i + 1) for i in range(1, n + 1)) for n in range(k + 1)]
    best = F.get(F.array(*[F.lit(float(x)) for x in ideal]), F.least(chosen, F.lit(k)).cast("int"))
    return F.when(F.coalesce(chosen, F.lit(0)) == 0, F.lit(empty)).otherwise(gain / best)


def ndcg_at_k(df: DataFrame, group: str | Sequence[str], score: str, label: str, ties: Sequence[str], k: int = 3,
              empty: float = 1.0) -> DataFrame:
    """Mean NDCG at k with gain 1 for a chosen row; a group without one counts ``empty``."""
    return (group_ndcg(df, as_list(group), score, label, ties, k, empty)
            .agg(F.avg("ndcg").alias("ndcg"), F.count(F.lit(1)).alias("n_groups")))


#: Rounds that one branch of ``staged_metrics`` orders; each is a window on the same exchange.
STAGES = 10


def staged_metrics(df: DataFrame, group: str, margins: str, label: str, ties: Sequence[str], by: Sequence[str] = ("split",),
                   rounds: Sequence[int] | None = None, k: int = 3, more_than: int = 10) -> DataFrame:
    """Ranking metrics after every boosting round, from an array with the score of each row after each round.

    ``by``, ``round``, ``ndcg`` over all groups, ``hitrate`` over those with more than ``more_than`` rows, and their numbers.
    ``rounds`` names the places of the array, by default 1, 2, ... All rounds share one exchange of the rows as they are, and
    each round is a window there. Where a group is hot, or the number of rounds is unknown, rows are expanded by rounds and only
    the k best of a group and round are kept together.
    """
    one = scratch("one")
    rows = df.select(*by, group, *ties, F.col(label).alias(one), margins).where(F.col(margins).isNotNull())
    keys = [*by, group]
    if rounds is not None and len(set(rounds)) == len(rounds):
        rows = measured(rows, keys)
        if not has_hot_groups(rows, keys):
            order = scratch("order")  # rows that nothing tells apart keep their order in every round
            rows = together(rows.withColumn(order, F.monotonically_increasing_id()), keys)
            parts = [_staged_windows(rows, keys, margins, one, [*ties, order], by, list(enumerate(rounds))[i:i + STAGES], k, more_than)
                     for i in range(0, len(rounds), STAGES)]
            if parts:
                return reduce(DataFrame.unionByName, parts)
    return _staged_rows(rows, group, margins, one, ties, by, rounds, k, more_than)


def _staged_windows(rows: DataFrame, keys: Sequence[str], margins: str, label: str, ties: Sequence[str], by: Sequence[str],
                    rounds: Sequence[tuple[int, int]], k: int, more_than: int) -> DataFrame:
    """``staged_metrics`` of some (place in the array, round) by windows over rows whose groups lie together."""
    w = Window.partitionBy(*keys)
    places = {i: scratch("place") for i, _ in rounds}
    placed = rows.withColumns({name: F.row_number().over(w.orderBy(
        *ascending(best_first(F.get(F.col(margins), F.lit(i)), ties)))) for i, name in places.items()})
    size, chosen = scratch("size"), scratch("chosen")
    gains, firsts = ({i: scratch(what) for i, _ in rounds} for what in ("gain", "first"))
    found = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(size), F.sum(F.col(label).cast("bigint")).alias(chosen),
        *[F.sum(F.when(F.col(p) <= k, F.col(label) / F.log2(F.col(p) + 1))).alias(gains[i]) for i, p in places.items()],
        *[F.min(F.when((F.col(p) <= k) & (F.col(label) == 1), F.col(p))).alias(firsts[i]) for i, p in places.items()])
    large = known(F.col(size) > more_than, keys)
    n_large = F.count(F.when(large, 1))
    out = found.groupBy(*by).agg(F.array(*[F.struct(
        F.lit(int(r)).alias("round"), F.avg(ndcg_of(F.col(gains[i]), F.col(chosen), k)).alias("ndcg"),
        F.count(F.lit(1)).alias("n_groups"),
        F.avg(F.when(large, F.col(firsts[i]).isNotNull().cast("int"))).alias("hitrate"),
        F.when(n_large > 0, n_large).alias("n_large")) for i, r in rounds]).alias("stages"))
    return out.select(*by, F.inline("stages"))


def _staged_rows(df: DataFrame, group: str, margins: str, one: str, ties: Sequence[str], by: Sequence[str],
                 rounds: Sequence[int] | None, k: int, more_than: int) -> DataFrame:
    """``staged_metrics`` with the round as one more key of the group."""
    scores, score = F.col(margins), scratch("score")
    if rounds is None:
        pairs = F.transform(scores, lambda x, i: F.struct((i + 1).alias("round"), x.alias(score)))
    else:
        pairs = F.arrays_zip(F.array(*[F.lit(int(r)) for r in rounds]).alias("round"), scores.alias(score))
    staged = df.select(*by, group, *ties, one, F.inline(pairs).alias("round", score))
    keys = [*by, "round", group]
    gains = group_ndcg(staged, keys, score, one, ties, k).groupBy(*by, "round").agg(
        F.avg("ndcg").alias("ndcg"), F.count(F.lit(1)).alias("n_groups"))
    hits = group_hits(staged, keys, best_first(score, ties), one, k, more_than).groupBy(*by, "round").agg(
        F.avg(hit(k)).alias("hitrate"), F.count(F.lit(1)).alias("n_large"))
    return join_on(gains, hits, [*by, "round"], null_keys=True)


def best_round(curve: DataFrame, by: str, value: object, patience: int | None = None, metric: str = "ndcg") -> int:
    """The earliest round with the best metric; with ``patience``, before as many rounds without a better one."""
    best, at = None, 0
    for row in curve.where(F.col(by) == F.lit(value)).orderBy("round").select("round", metric).collect():
        if best is None or row[1] > best:
            best, at = row[1], row[0]
        elif patience is not None and row[0] - at >= patience:
            break
    return at

"""Row expressions on numbers and flags. Every function returns a Column or a dict of Columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the age bins: upper bounds (inclusive) and labels.
AGE_BOUNDS = [18, 25, 35, 45, 55, 65, 75]
AGE_LABELS = ["2-17", "18-24", "25-34", "35-44", "45-54", "55-64", "65-74", "75-92"]


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def flag(condition: Column) -> Column:
    """0/1 of a condition; unknown stays null."""
    return condition.cast("int")


def either_or(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also where it is unknown)."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def price_ratios(price, tax) -> dict[str, Column]:
    """Price and tax over one another (+1), their logs and a zero-tax flag."""
    p, t = col(price), col(tax)
    return {
        "price_per_tax": F.try_divide(p, t + 1),
        "tax_rate": F.try_divide(t, p + 1),
        "log_price": F.log1p(p),
        "log_taxes": F.log1p(t),
        "is_zero_tax": flag(t == 0),
    }


def fee_ratio(amount, price) -> Column:
    """Fee over price; null where either is missing or the price is 0."""
    return F.try_divide(col(amount).cast("double"), col(price).cast("double"))


def is_missing(x) -> Column:
    return flag(col(x).isNull())


def is_free(amount, status) -> Column:
    """1 where the fee is 0 and the rule's status is 1."""
    return flag((col(amount) == 0) & (col(status) == 1))


def leg_totals(first, second, price) -> dict[str, Column]:
    """Sum of two legs (missing = 0), first over second (0 without a second), price per unit.

    Price per unit is null where the total is 0.
    """
    a, b = col(first), col(second)
    total = F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return {
        "total_duration": total,
        "duration_ratio": F.when(F.coalesce(b, F.lit(0)) > 0, F.try_divide(a, b)).otherwise(F.lit(0.0)),
        "price_duration_rat": F.try_divide(col(price), total),
    }


def is_one_way(second_duration, second_origin) -> Column:
    """1 where the second leg has no duration, zero duration or no origin."""
    d = col(second_duration)
    return flag(d.isNull() | F.coalesce(d == 0, F.lit(False)) | col(second_origin).isNull())


def count_present(columns: Iterable[str | Column]) -> Column:
    """How many of the columns are not null."""
    return reduce(lambda a, b: a + b, [flag(col(c).isNotNull()) for c in columns], F.lit(0))


def conditional_flags(code, policy, vip, programs) -> dict[str, Column]:
    """Presence of a code alone and together with a policy flag or a VIP flag; VIP or member."""
    has, is_vip = col(code).isNotNull(), col(vip).cast("int") == 1
    return {
        "has_code": flag(has),
        "code_and_policy": either_or(has & (col(policy) == 1)),
        "code_and_vip": either_or(has & is_vip),
        "vip_or_member": flag(is_vip | (col(programs) > 0)),
    }


def columns_differ(a, b) -> Column:
    """1 where the two differ, null where either is missing."""
    return flag(col(a) != col(b))


def direct_flags(first_segments, second_segments, one_way) -> dict[str, Column]:
    """One-segment flags of two legs (the second is 0 on one-way trips) and both at once."""
    one = flag(col(first_segments) == 1)
    two = F.when(col(one_way) == 1, F.lit(0)).otherwise(flag(col(second_segments) == 1))
    return {"is_direct_leg0": one, "is_direct_leg1": two, "both_direct": one.bitwiseAND(two)}


def threshold_bin(x, edges: Sequence[float], start: int = 0) -> Column:
    """Index of the first edge with ``x <= edge``, counted from ``start``; above all (or null): last."""
    whens = F
    for i, edge in enumerate(edges):
        whens = whens.when(col(x) <= edge, F.lit(start + i))
    return whens.otherwise(F.lit(start + len(edges)))


def cabin_features(cabins: Sequence[str | Column], vip=None) -> dict[str, Column]:
    """Any cabin 3, any 4, highest, and all 1 among those present (a missing cabin is 0)."""
    levels = [F.coalesce(col(c).cast("int"), F.lit(0)) for c in cabins]
    def some(test):
        return reduce(lambda a, b: a | b, [test(x) for x in levels])

    first = some(lambda x: x == 4)
    only_economy = reduce(lambda a, b: a & b, [x.isin(0, 1) for x in levels])
    out = {
        "has_business_class": flag(some(lambda x: x == 3)),
        "has_first_class": flag(first),
        "max_cabin_level": F.greatest(*levels) if len(levels) > 1 else levels[0],
        "all_cabin_level_1": flag(only_economy & some(lambda x: x != 0)),
    }
    if vip is not None:
        out["vip_first_class"] = flag((col(vip).cast("int") == 1) & first)
    return out


def age_features(birth_year, reference_year: int = 2024, lowest: int = 2, highest: int = 90,
                 bounds: Sequence[int] = AGE_BOUNDS,
                 labels: Sequence[str] = AGE_LABELS) -> dict[str, Column]:
    """Age, -1 outside the valid range, and its labelled bin (upper bound included)."""
    age = F.lit(reference_year) - col(birth_year).cast("int")
    valid = age.between(lowest, highest)
    whens = F.when(~F.coalesce(valid, F.lit(False)), F.lit("outlier"))
    for bound, label in zip(bounds, labels):
        whens = whens.when(age <= bound, F.lit(label))
    return {"age": F.when(valid, age).otherwise(F.lit(-1)),
            "age_bin": whens.otherwise(F.lit(labels[-1]))}


def log_transform(columns: Iterable[str]) -> dict[str, Column]:
    """``log1p`` in place; null stays null."""
    return {c: F.log1p(F.col(c)) for c in columns}


def log_sum(*counts) -> Column:
    """Sum of already logged popularity counts."""
    return reduce(lambda a, b: a + b, [col(c) for c in counts])


def clip(x: Column, low: float, high: float) -> Column:
    """Bound a number on both sides; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def rank_interactions(a, b, prefix: str = "rank_interaction", eps: float = 1e-6) -> dict[str, Column]:
    """Product, clipped ratio, sum and difference of two scaled ranks."""
    x, y = col(a), col(b)
    return {
        f"{prefix}_mul": x * y,
        f"{prefix}_ratio": clip(F.try_divide(x + eps, y + eps), 0.01, 100.0),
        f"{prefix}_sum": x + y,
        f"{prefix}_sub": x - y,
    }

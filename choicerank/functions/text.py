"""Row expressions on strings: durations, delimited lists, patterns, routes, keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from choicerank.functions.numbers import col, flag


def duration_to_minutes(text) -> Column:
    """Minutes of ``[D.]HH:MM:SS``; a piece that is missing counts 0, so null gives 0."""
    x = col(text)

    def piece(pattern: str, minutes: int) -> Column:
        digits = F.regexp_extract(x, pattern, 1)
        # a failed cast costs an exception a row, so empty matches are not cast
        number = F.when(digits != "", digits.try_cast("bigint"))
        return F.coalesce(number, F.lit(0).cast("bigint")) * minutes

    return piece(r"^(\d+)\.", 1440) + piece(r"^(?:\d+\.)?(\d+):", 60) + piece(r":(\d+):", 1)


def list_count(text, separator: str = "/") -> Column:
    """Length of a delimited list; null and the empty string have none."""
    x = F.coalesce(col(text), F.lit(""))
    return F.regexp_count(x, F.lit(separator)) + flag(x != "")


def has_text(text) -> Column:
    return flag(F.coalesce(col(text), F.lit("")) != "")


def list_membership(text, value, cabin, major: Sequence[str], separator: str = "/") -> dict[str, Column]:
    """Value in a delimited list, list of one that contains it, in a fixed set, member in cabin 1-2.

    A missing value is in no list; whether a list of one contains it is unknown (null).
    """
    x, v = F.coalesce(col(text), F.lit("")), col(value)
    items = F.split(x, separator)
    member = F.coalesce(F.array_contains(items, v), F.lit(False))
    return {
        "in_list": flag(member),
        "is_only": flag((F.size(items) == 1) & F.contains(x, v)),
        "in_major": flag(v.isin(*major)),
        "member_low_cabin": flag(member & F.coalesce(col(cabin).isin(1, 2), F.lit(False))),
    }


def in_set(text, values: Sequence[str]) -> Column:
    """1 where the text is one of the values; null stays null."""
    return flag(col(text).isin(*values))


def matches(text, pattern: str) -> Column:
    """1 where the pattern occurs in the text; null stays null."""
    return flag(col(text).rlike(pattern))


def split_route(route, separator: str = "/") -> dict[str, Column]:
    """Two halves of a route, the ends of each, and whether the second is the first reversed.

    The reversed flag is -1 where there is no second half.
    """
    parts = F.split(col(route), separator, 3)
    out, back = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    ends = {"outbound_origin": out.substr(1, 3), "outbound_destination": out.substr(4, 3),
            "return_origin": back.substr(1, 3), "return_destination": back.substr(4, 3)}
    turned = ((ends["outbound_origin"] == ends["return_destination"])
              & (ends["outbound_destination"] == ends["return_origin"]))
    return {"outbound_route": out, "return_route": back, **ends,
            "is_exact_round_trip": F.coalesce(flag(turned), F.lit(-1))}


def composite_key(columns: Sequence[str | Column], null_as: str | None = "missing",
                  separator: str = "_") -> Column:
    """Join columns into one key; nulls are written as ``null_as``, or make the key null if None."""
    texts = [col(c).cast("string") for c in columns]
    if null_as is not None:
        return F.concat_ws(separator, *[F.coalesce(t, F.lit(null_as)) for t in texts])
    spaced = [p for t in texts for p in (F.lit(separator), t)][1:]
    return F.concat(*spaced)


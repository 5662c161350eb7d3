"""Null, tie and sentinel cases the driver tables do not hold."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from choicerank.functions import calendar, numbers, text
from choicerank.operators import enrich, session, tables
from choicerank.operators import history
from choicerank.operators.history import GLOBAL, NULL_KEY, Stat, cabin_share_pivot, company_stats, density_mode, history_stats


def one(spark, value, kind, *columns):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return tuple(df.select(*columns).first())


@pytest.mark.parametrize("value, minutes", [
    ("02:05:00", 125), ("1.02:05:00", 1565), ("12:30", 720), ("", 0), (None, 0), ("x:30:00", 30), ("00:00:00", 0)])
def test_duration(spark, value, minutes):
    assert one(spark, value, "string", text.duration_to_minutes("x")) == (minutes,)


@pytest.mark.parametrize("value, n, has", [(None, 0, 0), ("", 0, 0), ("SU", 1, 1), ("SU/S7", 2, 1), ("SU/S7/U6", 3, 1)])
def test_list_count(spark, value, n, has):
    assert one(spark, value, "string", text.list_count("x"), text.has_text("x")) == (n, has)


def test_membership(spark):
    df = spark.createDataFrame([("SU", "SU", 1.0), ("SU/S7", "S7", 3.0), (None, "SU", 1.0), ("SU", None, 1.0),
                                ("SU", "S", 1.0)], "l string, v string, c double")
    parts = text.list_membership("l", "v", "c", ["SU", "S7"])
    found = [tuple(r) for r in df.select(*parts.values()).collect()]
    assert found == [(1, 1, 1, 1), (1, 0, 1, 0), (0, 0, 1, 0), (0, None, None, 0), (0, 1, 0, 0)]


def test_route(spark):
    def parts(route):
        return one(spark, route, "string", *text.split_route("x").values())

    assert parts("MOWLED/LEDMOW") == ("MOWLED", "LEDMOW", "MOW", "LED", "LED", "MOW", 1)
    assert parts("MOWLED/LEDSVX")[-1] == 0
    assert parts("MOWLED") == ("MOWLED", None, "MOW", "LED", None, None, -1)


def test_keys(spark):
    df = spark.createDataFrame([("a", None)], "a string, b int")
    row = df.select(text.composite_key(["a", "b"]), text.composite_key(["a", "b"], "NULL"),
                    text.composite_key(["a", "b"], None)).first()
    assert tuple(row) == ("a_missing", "a_NULL", None)


def test_missing_hour_counts_as_night(spark):
    parts = calendar.calendar_features(calendar.as_time("x"), "t") | calendar.calendar_combos(
        calendar.as_time("x"), calendar.as_time("x"), "t")
    assert one(spark, None, "string", *parts.values()) == (-1, 0, 0, 0, 0, -1, "-1_-1", 0, 1)
    assert one(spark, "no time", "string", *parts.values())[0] == -1
    assert one(spark, "2024-06-02T21:10:00", "string", *parts.values()) == (21, 7, 0, 0, 1, 4, "4_4", 0, 0)


@pytest.mark.parametrize("back, hours, short, band", [
    (None, None, 0, 5), ("2024-01-01T00:00:00", 0.0, 0, -1), ("2023-12-31T00:00:00", 0.0, 0, -1),
    ("2024-01-01T15:59:59", 15.999722, 1, 0), ("2024-01-01T16:00:00", 16.0, 1, 1), ("2024-01-06T00:00:00", 120.0, 0, 5)])
def test_gap(spark, back, hours, short, band):
    parts = calendar.gap_features(calendar.as_time(F.lit("2024-01-01T00:00:00")), calendar.as_time("x"))
    found = one(spark, back, "string", F.round(parts["stay_duration_hours"], 6), parts["is_short_trip"],
                parts["stay_duration_bin"])
    assert found == (hours, short, band)


def test_lead_time(spark):
    parts = calendar.lead_time(F.lit(dt.datetime(2024, 1, 3)).cast("timestamp_ntz"), calendar.as_time("x")).values()
    assert one(spark, None, "string", *parts) == (0.0, None)
    assert one(spark, "2024-01-02T00:00:00", "string", *parts) == (0.0, 1)
    assert one(spark, "2024-01-05T00:00:00", "string", *parts) == (48.0, 0)


@pytest.mark.parametrize("year, age, label", [(2023, -1, "outlier"), (2022, 2, "2-17"), (2006, 18, "2-17"),
                                              (2005, 19, "18-24"), (1949, 75, "65-74"), (1934, 90, "75-92"),
                                              (1933, -1, "outlier"), (None, -1, "outlier")])
def test_age(spark, year, age, label):
    assert one(spark, year, "int", *numbers.age_features("x").values()) == (age, label)


def test_zero_divisors_give_null(spark):
    parts = numbers.leg_totals("x", F.lit(0), F.lit(10.0))
    assert one(spark, 0, "int", *parts.values()) == (0, 0.0, None)
    assert one(spark, None, "double", numbers.fee_ratio("x", F.lit(5.0))) == (None,)


def test_cabins(spark):
    df = spark.createDataFrame([(None, None), (1.0, None), (1.0, 2.0), (4.0, 3.0)], "a double, b double")
    found = [tuple(r) for r in df.select(*numbers.cabin_features(["a", "b"], F.lit(True)).values()).collect()]
    assert found == [(0, 0, 0, 0, 0), (0, 0, 1, 1, 0), (0, 0, 2, 0, 0), (1, 1, 4, 0, 1)]


def test_fill_leaves_booleans(spark):
    df = spark.createDataFrame([(None, None, None)], "n double, s string, b boolean")
    assert tuple(tables.fill_all_nulls(df).first()) == (0.0, "missing", None)


GROUPS = [(1, "a", 10.0), (1, "b", 10.0), (1, "c", 30.0), (2, "d", None), (2, "e", 5.0), (None, "f", 2.0),
          (None, "g", 4.0)]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(GROUPS, "g int, id string, x double")


def by_id(df, *columns):
    return {r["id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_group_flags_with_ties_and_nulls(small):
    found = by_id(session.is_group_min(small, "g", {"x": "low"}), "low")
    assert found == {"a": (1,), "b": (1,), "c": (0,), "d": (None,), "e": (1,), "f": (1,), "g": (0,)}


def test_group_moments_of_one_value(small):
    found = by_id(session.group_moments(small, "g", {"x": "m"}), "m_mean", "m_std", "m_range")
    assert found["d"] == (5.0, None, 0.0)
    assert found["f"][0] == 3.0


def test_relative_price_without_spread(small):
    found = by_id(session.group_relative_price(small, "g", "x"), "cheapest", "z", "below_q25")
    assert found["e"] == (1, 0.0, 0) and found["d"] == (None, 0.0, None) and found["a"] == (1, 0.0, 0)


def test_counts_skip_null_keys(small):
    keyed = small.withColumn("k", F.when(F.col("id") < "c", F.lit("k")))
    found = by_id(session.count_in_group(keyed, "g", "k", "n"), "n")
    assert found["a"] == (2,) and found["c"] == (None,) and found["f"] == (None,)
    assert by_id(session.nunique_in_group(keyed, "g", {"k": "n"}), "n")["a"] == (2,)


def test_enrichment_keeps_rows_with_duplicate_airports(spark):
    airports = spark.createDataFrame([("A", 1.0, "X"), ("A", 1.0, "X"), ("B", 3.0, "X"), (None, 0.0, "Z")],
                                     "IATA string, UTC_Offset_Hours double, Country_CodeA2 string")
    trips = spark.createDataFrame([(1, "A", "B"), (2, "A", "Q"), (3, None, "B")], "id int, o string, d string")
    found = by_id(enrich.airport_enrichment(trips, airports, "o", "d", "t"), "t_is_cross_country", "t_is_cross_timezone")
    assert found == {1: (0, True), 2: (0, False), 3: (0, False)}


def test_summary_keeps_sessions_without_one(small, spark):
    summary = spark.createDataFrame([(1, 1980)], "g int, yearOfBirth int")
    found = by_id(enrich.summary_enrichment(small, summary, "g"), "yearOfBirth")
    assert len(found) == 7 and found["a"] == (1980,) and found["d"] == (None,) and found["f"] == (None,)


PAST = [(1, 5, 10.0, 1, "train"), (1, 5, 20.0, 1, "train"), (2, 6, 40.0, 1, "train"), (None, 7, 80.0, 1, "train"),
        (3, 8, 5.0, 0, "train"), (4, 9, 7.0, 1, "test")]


@pytest.fixture(scope="module")
def choices(spark):
    return spark.createDataFrame(PAST, "k int, cabin int, x double, selected int, split string")


def test_history_fallbacks(choices):
    stats = [Stat("n", F.count(F.lit(1)), NULL_KEY), Stat("m", F.avg("x"), GLOBAL), Stat("own", F.avg("x"))]
    found = {r["x"]: (r["n"], r["m"], r["own"]) for r in history_stats(choices, "k", stats).collect()}
    assert found == {10.0: (2, 15.0, 15.0), 20.0: (2, 15.0, 15.0), 40.0: (1, 40.0, 40.0), 80.0: (1, 37.5, None),
                     5.0: (1, 37.5, None), 7.0: (1, 37.5, None)}


def test_history_without_rows(choices):
    nothing = choices.where("x < 0")
    stats = [Stat("n", F.count(F.lit(1)), 0), Stat("c", F.count(F.lit(1)), NULL_KEY), Stat("m", F.avg("x"), GLOBAL)]
    assert {tuple(r[-3:]) for r in history_stats(choices, "k", stats, nothing).collect()} == {(0, 0, None)}


def test_single_choice_takes_the_overall_mean(choices):
    out = company_stats(choices, "k", "x", "x", shares={}, means={})
    found = {r["x"]: (r["company_ocurrence"], r["avg_selected_price"]) for r in out.collect()}
    assert found[10.0] == (2, 15.0) and found[40.0] == (1, 37.5) and found[5.0] == (0, 37.5)


def test_cabin_nobody_chose_is_zero(choices):
    out = cabin_share_pivot(choices, "k", "cabin", "c", levels=(4, 5, 6))
    found = {r["x"]: (r["c_cabin4_select_ratio"], r["c_cabin5_select_ratio"], r["c_cabin6_select_ratio"])
             for r in out.collect()}
    assert found[10.0] == (0.0, pytest.approx(2 / 2.00001), None) and found[5.0] == (0.0, None, None)


def test_density_mode_of_a_constant(spark):
    assert density_mode(spark.createDataFrame([(2.0,), (2.0,), (None,)], "x double"), "x") == 2.0
    assert density_mode(spark.createDataFrame([(None,)], "x double"), "x") is None


def test_density_against_the_plain_sum(spark):
    """The series per cell gives what the sum over all values gives, also with outliers, ties and two columns at once."""
    rng = np.random.default_rng(3)
    a = np.concatenate([rng.normal(0, 1, 4000), rng.normal(9, 0.2, 500), [250.0, -90.0], np.repeat(2.5, 300)])
    b = rng.exponential(3.0, len(a)).round(1)
    df = spark.createDataFrame([(float(x), float(y), 1.5) for x, y in zip(a, b)] + [(None, float("nan"), None)],
                               "a double, b double, c double")
    curves, constant = history.density_curves(df, ["a", "b", "c"])
    found = curves.toPandas()
    assert constant == {"c": 1.5} and set(found["column"]) == {"a", "b"}
    for name, values in (("a", a), ("b", b)):
        width = values.std(ddof=1) * len(values) ** -0.2
        grid = np.linspace(values.min(), values.max(), 1000)
        want = np.exp(-0.5 * ((grid[:, None] - values) / width) ** 2).sum(1) / (len(values) * width * np.sqrt(2 * np.pi))
        got = found[found["column"] == name].sort_values("i")
        assert np.allclose(got["x"], grid[got["i"]]) and np.abs(got["density"] - want[got["i"]]).max() < 1e-14
        assert np.delete(want, got["i"]).sum() < 1e-14
        assert history.density_mode(df, name) == pytest.approx(grid[want.argmax()])

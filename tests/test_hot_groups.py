"""Groups too large for one task take another way to the same result."""

import pytest
from pyspark.sql import functions as F

from checks.fixture import options
from choicerank.operators import encode, groups, history, metrics, rerank, session, tables
from tests.compare import assert_same
from tests.conftest import DATA


@pytest.fixture(scope="module")
def skewed(spark):
    """Options with a third of the rows in one session, some without a session, many equal prices."""
    df = options(spark, DATA)
    number = F.crc32("option_id")
    return df.withColumns({
        "session_id": F.when(number % 3 == 0, F.lit(7)).when(number % 50 != 1, F.col("session_id")),
        "total_price": F.when(number % 2 == 0, F.lit(100.0)).otherwise(F.round("total_price", -3)),
    }).cache()


def both(settings, make):
    usual = make().toPandas()
    settings(hotRows=20, parts=4, broadcastRows=5)
    return usual, make().toPandas()


WAYS = {
    "rank": lambda df: rerank.rank_within_group(
        df.withColumn("score", -F.col("total_price")), "session_id", "score", ["option_id"])
    .select("option_id", "selected"),
    "position": lambda df: session.group_position(df, "session_id", [F.col("option_id")])
    .select("option_id", "group_position"),
    "running sum": lambda df: groups.running(df, "session_id", [F.col("option_id")], "upto",
                                             weight=F.col("selected"), total="total")
    .select("option_id", "upto", "total"),
    "quantiles": lambda df: groups.group_quantiles(df, "session_id", "total_price",
                                                   {"median": "median", "low": 0.1, "q75": 0.75}),
    "global quantiles": lambda df: groups.group_quantiles(df, [], "total_price", {"a": 0.01, "b": 0.99, "m": "median"}),
    "offers": lambda df: session.same_offer_features(df, "session_id", "carrier", "total_price")
    .select("option_id", "flight_option_count", "flight_price_percentile", "is_flight_cheapest"),
    "distinct": lambda df: session.nunique_in_group(
        df.withColumn("half", F.when(F.col("total_price") > 0, F.col("total_price"))), "session_id",
        {"carrier": "carriers", "half": "prices", "cabin": "cabins", "profile_id": "profiles"})
    .select("option_id", "carriers", "prices", "cabins", "profiles"),
    "mmr": lambda df: rerank.mmr_rerank(df.withColumn("score", -F.col("total_price") / 50000), "session_id",
                                        "option_id", "score", ["departure_at", "return_at"], ["carrier", "cabin"], 5),
    "split": lambda df: tables.with_split(df, "request_ts", {"train": 0.5, "val": 0.8}, "test", "part")
    .select("option_id", "part"),
    "history": lambda df: history.history_stats(df, "profile_id", [
        history.Stat("n", F.count(F.lit(1)), 0), history.Stat("low", F.min("total_price"), history.GLOBAL)])
    .select("option_id", "n", "low"),
    "encode": lambda df: encode.dense_encode(df.select("option_id", "profile_id"), "profile_id"),
    "bands": lambda df: metrics.hitrate_by_size_quantile(
        df.withColumn("score", -F.col("total_price")), "session_id", "score", "selected", ["option_id"], (1, 3)),
}


@pytest.mark.parametrize("way", sorted(WAYS))
def test_same_result(spark, settings, skewed, way):
    assert_same(*both(settings, lambda: WAYS[way](skewed)))


def test_hot_rank_is_a_permutation(spark, settings, skewed):
    settings(hotRows=20, parts=4)
    ranked = rerank.rank_within_group(skewed.withColumn("score", -F.col("total_price")), "session_id", "score",
                                      ["option_id"], "place")
    wrong = ranked.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("place").alias("d"), F.min("place").alias("a"),
        F.max("place").alias("b")).where("d <> n OR a <> 1 OR b <> n")
    assert wrong.count() == 0


def test_all_hot_groups_are_found(spark, settings):
    settings(hotRows=1)
    rows = spark.range(12_000).select((F.col("id") % 6_000).alias("g"), "id")
    assert groups.hot_groups(rows, ["g"]).count() == 6_000


def test_a_hot_group_is_cut_into_ranges(spark, settings):
    settings(hotRows=30, parts=20)
    rows = spark.range(1000).select(F.lit(1).alias("g"), ((F.col("id") * 79) % 1000).alias("v"))
    placed = groups.running(rows, "g", [F.col("v")], "place", total="n")
    assert placed.where("place <> v + 1 OR n <> 1000").count() == 0
    sums = groups.running(rows, "g", [F.col("v")], "upto", weight=F.col("v"), total="all")
    assert sums.where("upto <> v * (v + 1) / 2 OR all <> 499500").count() == 0


def test_equal_order_values_beside_a_group_that_can_be_cut(spark, settings):
    settings(hotRows=30, parts=10)
    alone = spark.range(400).select(F.lit(1).alias("g"), ((F.col("id") * 79) % 400).alias("v"))
    rows = alone.union(spark.range(900).select(F.lit(2).alias("g"), F.lit(3).alias("v"))).union(
        spark.range(50).select(F.lit(None).cast("int").alias("g"), F.col("id").alias("v")))
    placed = groups.running(rows, "g", [F.col("v")], "place", total="n").cache()
    assert placed.where("g = 1 and (place <> v + 1 or n <> 400)").count() == 0
    assert placed.where("g is null and (place <> v + 1 or n <> 50)").count() == 0
    assert sorted(r.place for r in placed.where("g = 2").collect()) == list(range(1, 901))


def test_column_quantiles_narrow_until_they_are_exact(spark, monkeypatch):
    """Coarse brackets and few collected values: several levels, heavy ties at and between the ends, values that are missed."""
    import random

    rng = random.Random(4)
    for values in ([rng.random() for _ in range(4000)], [5.0] * 3000 + [rng.random() * 10 for _ in range(900)],
                   [1.0, 2.0] * 1500, [7.0], [float(rng.randrange(40)) for _ in range(2500)] + [float("nan")] * 30):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
        ordered = sorted(values, key=lambda v: (v != v, v))
        picks = {"low": 0.01, "q": 0.25, "m": "median", "high": 0.99, "top": 1.0, "bottom": 0.0}
        n = len(values)
        want = {k: ordered[int(q * (n - 1) + 0.5)] for k, q in picks.items() if q != "median"}
        want["m"] = (ordered[(n - 1) // 2] + ordered[n // 2]) / 2
        for accuracy, few in ((groups.ACCURACY, groups.FEW), (20, 5)):
            monkeypatch.setattr(groups, "ACCURACY", accuracy)
            monkeypatch.setattr(groups, "FEW", few)
            monkeypatch.setattr(groups, "_AROUND", (-2 / accuracy, 2 / accuracy))
            assert str(groups.column_quantiles(df, "x", picks)) == str({k: want[k] for k in picks})
    assert groups.column_quantiles(df.limit(0), "x", {"a": 0.5}) == {"a": None}


@pytest.mark.parametrize("partitions", [1, 4, 50])
def test_partition_count_does_not_matter(spark, skewed, partitions):
    def report():
        ranked = WAYS["rank"](skewed)
        return ranked.agg(F.sum(F.xxhash64("option_id", "selected").cast("decimal(38,0)"))).first()[0]

    before = spark.conf.get("spark.sql.shuffle.partitions")
    expected = report()
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        assert report() == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_distinct_counts_of_nulls_zeros_and_repeats(spark, settings):
    rows = [(1, 0.0, "a", None), (1, -0.0, "b", None), (1, float("nan"), "a", 5), (1, float("nan"), None, 5), (None, 1.0, "a", 5),
            (None, None, None, None), (2, None, None, None)]
    df = spark.createDataFrame(rows, "k int, x double, s string, i int")
    settings(hotRows=1)
    counted = session.nunique_in_group(df, "k", {"x": "n_x", "s": "n_s", "i": "n_i"})
    assert {tuple(r) for r in counted.select("k", "n_x", "n_s", "n_i").collect()} == {(1, 2, 3, 2), (None, 2, 2, 2), (2, 1, 1, 1)}
    assert "Expand" not in counted._jdf.queryExecution().executedPlan().toString()
    assert session.nunique_in_group(df.limit(0), "k", {"x": "n_x"}).count() == 0

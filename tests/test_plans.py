"""Plans: pruning, pushdown, shuffles, and what must not appear."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks.feature_queries import features
from checks import fixture
from checks.fixture import options, table
from choicerank.operators import encode, enrich, groups, history, metrics, model, rerank, session
from choicerank.plans.catalogue import FAMILIES, feature_lists
from choicerank.operators.encode import select_features
from choicerank.operators.rerank import top_k_per_group
from choicerank.settings import long_methods
from choicerank.sources import layout
from tests.compare import assert_same
from tests.conftest import DATA


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_scan_reads_only_what_is_needed(spark):
    text = plan(entry.queries()["scan_options"](spark, DATA))
    assert "PushedFilters: [IsNotNull(l_extendedprice), GreaterThan(l_extendedprice,90000.0)]" in text
    assert "l_discount" not in text


def test_statistics_of_one_key_share_a_shuffle(spark):
    df = table(spark, DATA, "lineitem")
    out = session.with_group(df, "l_partkey", session.minmax({"l_tax": "a"}), session.size("l_tax", "n"),
                             session.moments({"l_extendedprice": "p"}))
    assert plan(out).count("Exchange hashpartitioning") <= 2


def session_block(df, group, row, key, value):
    """Statistics, distinct counts, quantiles, positions, offers of an item and the penalised rank of a session."""
    out = session.with_group(df, group, session.minmax({value: "scaled"}), session.size(row, "n"),
                             session.relative_price(value), session.nunique({key: "n_keys"}),
                             session.filtered_minimum(F.col(key) > "N2", {value: "least"}))
    out = session.group_position(out, group, [F.col(row)])
    out = session.same_offer_features(out, group, key, value)
    out = session.count_in_group(out, group, key, "same_key")
    out = out.withColumn("z", F.round("z", 9))  # deviations are added up in another order
    return rerank.duplicate_penalty_rerank(out, group, key, value, [row])


def test_a_session_layout_needs_one_scan_and_no_exchange(spark):
    name = f"sessions_{uuid.uuid4().hex}"
    laid = layout.write_groups(options(spark, DATA), name, "session_id", ["option_id"], buckets=4)
    try:
        df = spark.read.parquet(*laid.inputFiles())
        args = ("session_id", "option_id", "carrier", "total_price")
        df = df.withMetadata("session_id", {})
        out, plain = session_block(laid, *args), session_block(groups.measured(df, "session_id"), *args)
        text = out._jdf.queryExecution().executedPlan().toString()
        assert text.count("FileScan parquet") == 1 and "Bucketed: true" in text
        assert "Exchange" not in text and "Join" not in text and "Expand" not in text
        text = plain._jdf.queryExecution().executedPlan().toString()
        assert text.count("FileScan parquet") == 1 and text.count("Exchange") == 1 and "Join" not in text
        assert_same(out.toPandas(), plain.toPandas())
        again = layout.read_groups(spark, name, "session_id").where("total_price > 3000")
        text = session.group_size(again, "session_id", "carrier")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text
    finally:
        spark.sql(f"drop table if exists {name}")


def test_a_layout_with_a_hot_group_is_read_without_its_buckets(spark, settings):
    name = f"sessions_{uuid.uuid4().hex}"
    df = options(spark, DATA).selectExpr(
        "if(profile_id % 3 = 0, null, session_id) as k", "option_id", "carrier", "total_price")
    args = ("k", "option_id", "carrier", "total_price")
    expected = session_block(groups.measured(df, "k"), *args).toPandas()
    settings(hotRows=500, parts=4)
    laid = layout.write_groups(df, name, "k", ["option_id"], buckets=3)
    try:
        assert groups.has_hot_groups(laid, "k") and laid.count() == df.count()
        assert len(laid.inputFiles()) > 3  # several tasks wrote the bucket of the hot group
        assert "Bucketed: true" not in laid._jdf.queryExecution().executedPlan().toString()
        assert_same(session_block(laid, *args).toPandas(), expected)
    finally:
        spark.sql(f"drop table if exists {name}")


def test_group_sizes_are_counted_once(spark):
    df = groups.measured(options(spark, DATA), "session_id")
    spark.sparkContext.setJobGroup("counted", "once")
    session_block(df, "session_id", "option_id", "carrier", "total_price")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("counted")
    spark.sparkContext.setJobGroup("", "")
    assert not jobs
    assert groups.largest_group(df, ["session_id", "carrier"]) == groups.largest_group(df, "session_id")
    assert groups.largest_group(df, "carrier") is None


def test_top_rows_are_limited_before_the_shuffle(spark):
    df = table(spark, DATA, "lineitem").withColumn("score", -F.col("l_extendedprice"))
    text = plan(top_k_per_group(df, "l_partkey", "score", ["l_orderkey", "l_linenumber"], 3))
    assert text.count("WindowGroupLimit") >= 2


SKEW = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true"}
ATTACHED = {
    "attach": lambda df: session.count_in_group(df, "k", "one", "n"),
    "with_group": lambda df: session.group_size(df, "k", "l_tax"),
    "history": lambda df: history.history_stats(
        df, "k", [history.Stat("n", F.count(F.lit(1)), 0)], F.col("l_tax") >= 0),
    "filter": lambda df: session.filter_groups_by_size(df, "k", 3),
}


@pytest.mark.parametrize("name", sorted(ATTACHED))
def test_hot_keys_are_split_when_statistics_join_back(spark, settings, name):
    """Half of the rows share a key; the join of rows and statistics is marked as a skewed one."""
    key = F.when(F.col("l_orderkey") % 2 == 0, F.lit(1)).otherwise(F.col("l_orderkey"))
    df = (table(spark, DATA, "lineitem").repartition(8)
          .select("*", key.alias("k"), F.lit(1).alias("one")))
    settings(broadcastRows=0, hotRows=1000)
    before = {k: spark.conf.get(k, None) for k in SKEW}
    try:
        for k, v in SKEW.items():
            spark.conf.set(k, v)
        out = ATTACHED[name](df)
        expected = df.count() if name != "filter" else out.select("k").count()
        assert len(out.collect()) == expected
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


QUICK = [n for n in entry.queries() if n not in
         ("train_ranker", "search_params", "score_options", "feature_importance", "learning_curve", "evaluate_ranker",
          "selected_features", "build_features", "ranked_options", "feature_history", "feature_sessions", "halving_search",
          "ranking_curve")]


@pytest.mark.parametrize("name", QUICK)
def test_no_products_and_no_python_rows(spark, name):
    text = plan(entry.queries()[name](spark, DATA))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert word not in text


@pytest.mark.parametrize("name", ["nunique_in_group", "carrier_behaviour", "build_features", "dense_encode", "winsorize",
                                  "time_split"])
def test_rows_are_not_expanded(spark, name):
    assert "Expand" not in plan(entry.queries()[name](spark, DATA))


def test_all_keys_of_a_history_share_an_exchange(spark):
    """Thirty statistics of ten keys: the past is read once, and one table is stored."""
    df = options(spark, DATA)
    past = df.where("selected = 1")
    keys = ["carrier", "company_id", "profile_id", "tariff_code", "search_route", "operating_carrier", "cabin", "split"]
    specs = [history.HistorySpec([k], [history.Stat(f"{k}_n", F.count(F.lit(1)), 0),
                                       history.Stat(f"{k}_m", F.avg("total_price"), history.GLOBAL)], history=past)
             for k in keys]
    kinds = history._Kinds(past, [[k] for k in keys])
    text = plan(kinds.aggregate({"n": F.count(F.lit(1))}))
    assert text.count("hashpartitioning") == 1 and "Expand" not in text
    out = history.with_history(df, *specs)
    want = df
    for k in keys:
        own = past.groupBy(k).agg(F.count(F.lit(1)).alias("a"), F.avg("total_price").alias("b")).dropna(subset=[k])
        overall = past.agg(F.avg("total_price")).first()[0]
        want = want.join(own, k, "left").withColumns({f"{k}_n": F.coalesce("a", F.lit(0)).cast("bigint"),
                                                      f"{k}_m": F.coalesce("b", F.lit(overall))}).drop("a", "b")
    names = ["option_id", *[f"{k}_{x}" for k in keys for x in "nm"]]

    def rounded(frame):
        return frame.select("option_id", *[F.round(c, 5).alias(c) for c in names[1:]]).toPandas()

    assert_same(rounded(out), rounded(want))


def test_the_feature_job_reads_the_options_three_times(spark):
    out = features(spark, DATA)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("lineitem.parquet") == 1  # the copy and the history were read before


def test_catalogue_counts():
    numeric, categorical, excluded = feature_lists(FAMILIES)
    assert (len(numeric), len(categorical)) == (106, 126)
    assert len(set(numeric) - set(excluded)) == 73


def test_feature_job_keeps_rows_and_names(spark):
    out = features(spark, DATA, counts=True, options=True, aircraft=True)
    chosen, categorical, numeric = select_features(out, FAMILIES)
    assert (len(categorical), len(numeric)) == (89, 73)
    assert chosen.count() == options(spark, DATA).count()
    expected = {"legs1_departureAt_peak_evening", "legs0_is_overnight_flight", "legs1_duration_bin", "user_total_count",
                "user_avg_cabinClass_leg0_seg0", "price_rank_diff", "duration_rank_diff", "group_position",
                "legs0_carrier_count_in_group", "legs1_segment_count_in_group", "group_legs0_n_segments",
                "group_total_options", "route_aircraft_ratio", "flight_price_percentile", "price_per_tax"}
    assert expected <= set(out.columns)
    assert len(set(out.columns)) == len(out.columns)


def planned(df):
    """The plan as a tree, before adaptive execution changes it."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_tables_are_not_broadcast_by_their_files(spark, settings):
    settings(broadcastRows=10)
    numbered = session.group_position(fixture.flights(spark, DATA).select("ranker_id", "Id"), "ranker_id", [F.col("Id")], "place")
    plan = planned(enrich.label_join(numbered, fixture.labels(spark, DATA).withColumnRenamed("row_id", "row"), "ranker_id",
                                     "place", row_id="row").select("Id", "category"))
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert len(joins) <= 1, plan  # suppliers


def test_order_lines_are_joined_with_orders_once(spark, settings):
    settings(broadcastRows=10)
    plan = planned(fixture.options(spark, DATA).select("session_id", "company_id", "total_price"))
    assert sum("BroadcastHashJoin" in line for line in plan.splitlines()) <= 1, plan  # suppliers
    assert plan.count("SortMergeJoin") == 2, plan
    assert sum("Exchange hashpartitioning(l_" in line for line in plan.splitlines()) == 1, plan


def test_rounds_share_one_exchange_of_the_rows(spark, settings):
    rows = spark.range(400).select(
        (F.col("id") % 7).cast("string").alias("g"), F.when(F.col("id") % 5 > 0, F.lit("train")).otherwise("val").alias("split"),
        F.col("id").alias("row"), (F.col("id") % 11 == 0).cast("int").alias("hit"),
        F.array(*[F.when(F.col("id") % (17 + i) > 0, F.pmod(F.hash("id", F.lit(i)), F.lit(9))) for i in range(12)]).alias("m"))
    rows = rows.union(rows.limit(9).withColumn("g", F.lit(None).cast("string")).withColumn("hit", F.lit(None).cast("int")))
    rounds = [3 * i + 1 for i in range(12)]
    staged = metrics.staged_metrics(rows, "g", "m", "hit", ["row"], rounds=rounds, more_than=8)
    plan = planned(staged)
    assert "Generate explode" not in plan and "WindowGroupLimit" not in plan
    found = {(r["split"], r["round"]): r for r in staged.collect()}
    settings(hotRows=2)
    wide = metrics.staged_metrics(rows, "g", "m", "hit", ["row"], rounds=rounds, more_than=8).collect()
    assert len(wide) == len(found) == 24
    for row in wide:
        mine = found[row["split"], row["round"]]
        assert list(mine.asDict()) == list(row.asDict())
        assert all(a == b or abs(a - b) < 1e-12 for a, b in zip(mine, row)), (mine, row)


def test_rows_of_a_fit_are_spread(spark, monkeypatch):
    monkeypatch.setattr(model, "FIT_ROWS", 20)
    rows = spark.range(400).select((F.col("id") % 100).alias("g"), F.col("id")).coalesce(1)
    assert model.spread(rows, "g").rdd.getNumPartitions() == 20
    monkeypatch.setattr(model, "FIT_ROWS", 400)
    assert model.spread(rows, "g").rdd.getNumPartitions() == 1


def test_modes_read_a_copy_of_the_past(spark, monkeypatch):
    rows = spark.range(60).select((F.col("id") % 6).alias("user"), (F.col("id") % 7).cast("double").alias("p"),
                                  (F.col("id") % 5).cast("double").alias("d"), (F.col("id") % 3).alias("cabin"),
                                  F.lit("train").alias("split"), (F.col("id") % 2).alias("selected"))
    read = []
    modes = history.density_modes
    monkeypatch.setattr(history, "density_modes", lambda past, columns: read.append(past) or modes(past, columns))
    history.profile_stats(rows, "user", price_rank="p", duration_rank="d", cabin="cabin")
    assert read[0].inputFiles() and sorted(read[0].columns) == ["cabin", "d", "p", "user"]


def test_a_rung_stores_only_what_its_trials_read(spark, monkeypatch):
    rows = spark.range(60).selectExpr("id % 6 as g", "id as row", "if(id % 6 < 4, 'train', 'val') as split",
                                      "cast(id % 5 = 0 as int) as hit", "cast(id % 7 as double) as x", "1.0d as w", "'long' as other")
    rows = encode.assemble(rows, ["x"], "hit", "g", keep=["row", "split", "w", "other"])
    stored, keep = [], model.checkpointed
    monkeypatch.setattr(model, "checkpointed", lambda df: stored.append(df.columns) or keep(df))
    best, _ = model.successive_halving(rows, {"maxDepth": [2]}, "hit", "g", ["row"], n=1, smallest=1.0,
                                       params={"maxIter": 1, "weightCol": "w"})
    assert best == {"maxDepth": 2} and stored == [["g", "row", "split", "hit", "features", "w"]]


def test_a_session_layout_is_packed_by_zstd(spark):
    name = f"sessions_{uuid.uuid4().hex}"
    laid = layout.write_groups(spark.range(20).withColumn("g", F.col("id") % 3), name, "g", buckets=2)
    try:
        assert laid.count() == 20 and all(file.endswith(".zstd.parquet") for file in laid.inputFiles())
    finally:
        spark.sql(f"drop table if exists {name}")


def test_an_exchange_by_group_gets_the_partitions_its_rows_need(spark, monkeypatch):
    df = groups.measured(spark.range(2000).selectExpr("id % 90 as k", "cast(id % 7 as double) as x", "id"), "k")
    usual = session.group_minmax(df, "k", {"x": "scaled"})
    monkeypatch.setattr(groups, "TASK_ROWS", 100)
    many = session.group_minmax(df, "k", {"x": "scaled"})
    assert "hashpartitioning(k#" in plan(many) and ", 20), REPARTITION_BY_NUM" in plan(many)
    assert "REPARTITION_BY_NUM" not in plan(usual) and plan(many).count("hashpartitioning(k#") == 1
    assert_same(many.toPandas(), usual.toPandas())


@pytest.mark.parametrize("metric", [metrics.ndcg_at_k, metrics.hitrate_at_k])
def test_a_metric_reads_noted_groups_once(spark, settings, metric):
    rows = [(s, f"{s}-{i}", None if i == 5 else float(i % 4), i % 6 == 0 and s != 3) for s in (1, 2, 3, None) for i in range(13)]
    df = spark.createDataFrame(rows, "s int, id string, score double, c boolean").withColumn("c", F.col("c").cast("int"))
    args = ("s", "score", "c", ["id"])
    noted = groups.note(df, ["s"], groups.ROWS, 13)
    text = plan(metric(noted, *args))
    assert "Join" not in text and text.count("hashpartitioning(s#") == 1
    expected = metric(df, *args).toPandas()
    assert_same(metric(noted, *args).toPandas(), expected)
    settings(hotRows=5, parts=4)
    assert "WindowGroupLimit" in plan(metric(noted, *args))  # a hot group is not ordered by one task
    assert_same(metric(noted, *args).toPandas(), expected)


def test_options_note_their_largest_session(spark):
    df = options(spark, DATA)
    assert groups.largest_group(df, "session_id") == df.groupBy("session_id").count().agg(F.max("count")).first()[0]


def test_labels_are_joined_while_sessions_lie_together(spark, settings):
    settings(broadcastRows=10)
    text = planned(features(spark, DATA).select("Id", "category", "legs0_Carrier_code_user_diversity"))
    (join,) = [line for line in text.splitlines() if "Join [ranker_id#" in line]
    assert "group_position#" in join and "LeftOuter" in join
    assert not re.search(r"Exchange hashpartitioning\(ranker_id#\d+, group_position#", text), text


def test_tables_joined_by_shuffle_come_first(spark, settings):
    settings(broadcastRows=10)
    rows = spark.range(50).selectExpr("id % 20 as user", "id % 3 as kind", "id")
    users = spark.range(20).selectExpr("id as user", "id * 2 as twice")
    kinds = spark.range(3).selectExpr("id as kind", "id * 5 as many")
    sides = [groups.Side(kinds, {"kind": F.col("kind")}), groups.Side(users, {"user": F.col("user")})]
    out = groups.join_sides(rows, sides, {"many": sides[0].columns["many"], "twice": sides[1].columns["twice"]})
    text = planned(out)
    assert text.index("BroadcastHashJoin") < text.index("SortMergeJoin")
    assert out.columns == ["user", "kind", "id", "many", "twice"]
    assert out.where("twice = 2 * user and many = 5 * kind").count() == 50


def test_methods_of_the_feature_job_are_compiled(spark):
    features(spark, DATA)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_small_partitions_of_a_fit_are_not_dealt_again(spark, monkeypatch):
    rows = spark.range(0, 400, 1, 8).select((F.col("id") % 100).alias("g"), F.col("id"))
    monkeypatch.setattr(model, "FIT_ROWS", 60)
    assert "Exchange" not in planned(model.spread(rows, "g"))
    assert "Exchange" in planned(model.spread(rows, "g", by_group=True))
    monkeypatch.setattr(model, "FIT_ROWS", 40)
    assert "Exchange" in planned(model.spread(rows, "g"))


def test_long_methods_are_for_wide_rows_only(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    with long_methods(spark):
        assert spark.conf.get(name) == "65535"
    assert spark.conf.get(name) == before


def test_a_layout_does_not_count_noted_groups(spark):
    df = spark.range(20).withColumn("g", F.col("id") % 3)
    noted = groups.note(groups.note(df, ["g"], groups.ROWS, 9), ["g"], groups.ALL, 20)
    name = f"sessions_{uuid.uuid4().hex}"
    laid = layout.write_groups(noted, name, "g", buckets=2)
    try:
        assert laid.count() == 20 and groups.largest_group(laid, "g") == 9  # counted it would be 7
    finally:
        spark.sql(f"drop table if exists {name}")

"""Invariants of ranking, re-ranking, metrics and the model jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import feature_queries
from checks.feature_queries import FEATURES, features, fitted
from checks.fixture import options
from choicerank.operators import metrics, model, rerank
from choicerank.plans.ranking import rank_options
from tests.conftest import DATA

S, ROW = "session_id", "option_id"


@pytest.fixture(scope="module")
def scored(spark):
    return options(spark, DATA).withColumn("score", -F.col("total_price") / 50000).cache()


def test_ties_need_names(scored):
    with pytest.raises(ValueError):
        rerank.rank_within_group(scored, S, "score", [])


def test_rerank_keeps_order_inside_a_key(scored):
    both = rerank.duplicate_penalty_rerank(scored, S, ["carrier", "cabin"], "score", [ROW])
    both = rerank.rank_within_group(both, S, "score", [ROW], "before").toPandas()
    for _, item in both.groupby([S, "carrier", "cabin"], dropna=False):
        assert list(item.sort_values("before")[ROW]) == list(item.sort_values("new_selected")[ROW])


def greedy(rows, k, lam):
    """Plain greedy choice over one session, to check the distributed one."""
    def seconds(text):
        return 0.0 if text is None else np.datetime64(text).astype("datetime64[s]").astype(float)

    def like(a, b):
        near = [max(0.0, 1 - abs(seconds(a[c]) - seconds(b[c])) / 3600 / 24) for c in ("departure_at", "return_at")]
        return (sum(near) + (a["carrier"] == b["carrier"]) + (a["cabin"] == b["cabin"])) / 4

    rest, chosen = sorted(rows, key=lambda r: r[ROW]), []
    while rest and len(chosen) < k:
        def value(r):
            return r["score"] if not chosen else lam * r["score"] - (1 - lam) * max(like(r, c) for c in chosen)
        best = max(rest, key=value)
        chosen.append(best)
        rest.remove(best)
    return [r[ROW] for r in chosen]


def test_mmr_against_plain_greedy(scored):
    some = scored.where("session_id < 25")
    found = rerank.mmr_rerank(some, S, ROW, "score", ["departure_at", "return_at"], ["carrier", "cabin"]).toPandas()
    rows = [r.asDict() for r in some.select(S, ROW, "score", "departure_at", "return_at", "carrier", "cabin").collect()]
    for key, group in found.groupby(S):
        expected = greedy([r for r in rows if r[S] == key], 10, 0.7)
        assert list(group.sort_values("new_selected")[ROW]) == expected


def test_curve_agrees_with_single_rates(scored):
    args = (S, "score", "selected", [ROW])
    curve = {r["k"]: r["hitrate"] for r in metrics.hitrate_curve(scored, *args).collect()}
    assert curve[3] == metrics.hitrate_at_k(scored, *args).first()["hitrate"]
    ranked = rerank.rank_within_group(scored.drop("place"), S, "score", [ROW], "place")
    assert curve[3] == metrics.hitrate_of_rank(ranked, S, "place", "selected").first()["hitrate"]
    assert list(curve.values()) == sorted(curve.values())


def test_no_missed_groups_gives_an_empty_frame(scored):
    assert metrics.missed_groups(scored.withColumn("selected", F.lit(1)), S, "score", "selected", [ROW]).count() == 0


def test_ndcg_of_groups_without_choice(spark):
    df = spark.createDataFrame([(1, 1, 0.5, 0), (1, 2, 0.4, 0), (2, 3, 0.3, 0), (2, 4, 0.2, 1)],
                               "g int, id int, s double, y int")
    one = metrics.ndcg_at_k(df, "g", "s", "y", ["id"], 3).first()["ndcg"]
    zero = metrics.ndcg_at_k(df, "g", "s", "y", ["id"], 3, empty=0.0).first()["ndcg"]
    assert one == pytest.approx((1 + 1 / np.log2(3)) / 2) and zero == pytest.approx(1 / np.log2(3) / 2)


def test_log_edges_are_those_of_logspace():
    assert np.allclose(metrics.log_edges(11, 400, 50), np.logspace(np.log10(11), np.log10(400), 51))


def test_ranker_learns_a_signal(spark):
    """Choices that depend on price and taxes together are ranked better than by price alone."""
    df = options(spark, DATA)
    low = F.col("total_price") + 8 * F.col("taxes") < 20000
    df = df.withColumns({"selected": low.cast("int"), "split": F.when(F.col(S) % 4 == 0, "val").otherwise("train")})
    rows, _, ranker = fitted(df)
    scored = model.score(rows.where("split = 'val'"), ranker).withColumn("cheap", F.crc32(ROW).cast("double"))
    learned = metrics.ndcg_at_k(scored, S, "pred_score", "selected", [ROW]).first()["ndcg"]
    chance = metrics.ndcg_at_k(scored, S, "cheap", "selected", [ROW]).first()["ndcg"]
    assert learned > 0.9 and learned > chance + 0.1
    used = model.feature_importance(ranker, FEATURES, spark).collect()
    assert abs(sum(r["importance"] for r in used) - 1) < 1e-6
    losses = [r["loss"] for r in model.learning_curve(ranker, rows, "selected", S, centred=True).collect()]
    assert losses == sorted(losses, reverse=True)


def test_options_are_ranked_end_to_end(spark):
    df = features(spark, DATA).withColumn("selected", (F.col("price_quantile_rank") < 0.1).cast("bigint"))
    run = rank_options(df, params={"maxIter": 2, "maxDepth": 3, "maxBins": 32}, more_than=4)
    assert len(run.features) == 162
    wrong = run.submission.groupBy("ranker_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("selected").alias("d"), F.max("selected").alias("top")
    ).where("n <> d OR n <> top")
    assert wrong.count() == 0
    assert run.submission.count() == df.where("split = 'test'").count()
    possible = run.scored.where("split = 'val'").groupBy("ranker_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("selected").alias("any")).where("n > 4").agg(F.avg("any")).first()[0]
    assert {r["k"]: r["hitrate"] for r in run.hits.collect()}[3] >= 0.95 * possible


def test_staged_scores_end_at_the_score(spark):
    rows, train, ranker = fitted(options(spark, DATA))
    staged, rounds = model.staged_scores(model.score(rows, ranker), ranker, every=3)
    assert rounds == [3, 4]
    assert staged.where("abs(margins[1] - pred_score) > 1e-9 or size(margins) <> 2").count() == 0
    short = model.first_trees(ranker, 3)
    assert len(short.treeWeights) == 3
    again = model.score(staged.drop("pred_score"), short)
    assert again.where("abs(margins[0] - pred_score) > 1e-9").count() == 0
    curve = {(r["split"], r["round"]): r for r in model.ranking_curve(rows, ranker, "selected", S, [ROW]).collect()}
    assert {r for _, r in curve} == {1, 2, 3, 4}
    val = model.score(rows.where("split = 'val'"), ranker)
    assert curve["val", 4]["ndcg"] == pytest.approx(metrics.ndcg_at_k(val, S, "pred_score", "selected", [ROW]).first()["ndcg"])
    hits = metrics.hitrate_at_k(val, S, "pred_score", "selected", [ROW]).first()
    assert (curve["val", 4]["hitrate"], curve["val", 4]["n_large"]) == (hits["hitrate"], hits["n_groups"])


def test_best_round_and_patience(spark):
    curve = spark.createDataFrame([("val", i + 1, v) for i, v in enumerate([0.1, 0.3, 0.2, 0.25, 0.3, 0.4])]
                                  + [("train", 1, 0.9)], "split string, round int, ndcg double")
    assert metrics.best_round(curve, "split", "val") == 6
    assert metrics.best_round(curve, "split", "val", 2) == 2
    assert metrics.best_round(curve, "split", "test") == 0


def test_trials_are_different_and_repeatable():
    space = {"a": [1, 2, 3], "b": [None, [0, 1]], "c": "xyz"}
    trials = model.trial_params(space, 10)
    assert len({str(t) for t in trials}) == 10 and trials == model.trial_params(space, 10)
    assert len(model.trial_params(space, 100)) == 18


def test_the_ranker_is_trained_with_all_rounds(spark, monkeypatch):
    """The query asks for the whole fit; the fit itself is shortened here."""
    train, asked = model.train_ranker, []

    def short(df, label, group, params, centred):
        asked.append(dict(params))
        return train(df, label, group, params | {"maxIter": 2, "maxDepth": 2}, centred)

    monkeypatch.setattr(model, "train_ranker", short)
    found = feature_queries.train_ranker(options(spark, DATA)).collect()
    assert sorted(r["scorer"] for r in found) == ["price", "ranker"] and all(0 < r["ndcg"] <= 1 for r in found)
    (params,) = asked
    assert (params["maxIter"], params["maxDepth"], params["minInstancesPerNode"]) == (1000, 14, 26)


def test_the_search_tries_all_ranges(spark, monkeypatch):
    """The query asks for the whole search; one combination is tried here, with few rounds."""
    search, asked = model.search_params, []

    def short(df, grid, label, group, ties, k=3, folds=3, params=None):
        asked.append((grid, folds, dict(params)))
        return search(df, {"maxDepth": [2]}, label, group, ties, k, 2, params | {"maxIter": 1})

    monkeypatch.setattr(model, "search_params", short)
    (trial,) = feature_queries.search_params(options(spark, DATA)).collect()
    assert 0 < trial["ndcg"] <= 1
    ((grid, folds, params),) = asked
    assert grid == {"maxDepth": [6, 18], "stepSize": [0.01, 0.1], "subsamplingRate": [0.6, 1.0], "maxIter": [500, 1500]}
    assert folds == 3 and params["minInstancesPerNode"] == 26

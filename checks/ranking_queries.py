"""Ranking, re-ranking and metrics (SURVEY H, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import on_options, query, rounded
from checks.fixture import table
from choicerank.operators import metrics, rerank

S, ROW = "session_id", "option_id"
ITEM = ["carrier", "cabin"]


def scored(df):
    return df.withColumn("score", -F.col("total_price") / 50000.0)


SCORED = "s AS (SELECT *, -total_price / 50000.0::double AS score FROM options)"


@on_options("rank_within_group", f"""
WITH {SCORED}
SELECT option_id, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, option_id) AS selected FROM s""")
def rank_within_group(df):
    return rerank.rank_within_group(scored(df), S, "score", [ROW], "place").select(
        ROW, F.col("place").alias("selected"))


PENALTY = f"""{SCORED},
m AS (SELECT *, max(score) OVER (PARTITION BY session_id, carrier, cabin) AS best FROM s),
p AS (SELECT *, score - 0.1::double * (best - score) AS reorder_score FROM m)"""


@on_options("penalty_rerank", f"""
WITH {PENALTY}
SELECT option_id, round(reorder_score, 9) AS reorder_score,
  row_number() OVER (PARTITION BY session_id ORDER BY reorder_score DESC, option_id) AS new_selected FROM p""")
def penalty_rerank(df):
    out = rerank.duplicate_penalty_rerank(scored(df), S, ITEM, "score", [ROW])
    return rounded(out.select(ROW, "reorder_score", "new_selected"), "reorder_score", places=9)


@on_options("submission", f"""
WITH {PENALTY}
SELECT option_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY reorder_score DESC, option_id) AS selected,
  round(score, 9) AS pred_score FROM p""")
def submission(df):
    out = rerank.make_submission(scored(df), S, ROW, "score", key=ITEM, rerank=True, keep_score=True)
    return rounded(out, "pred_score", places=9)


@on_options("pair_similarity", """
WITH t AS (SELECT *, coalesce(epoch_us(try_cast(departure_at AS timestamp)), 0) / 1e6 AS t0,
    coalesce(epoch_us(try_cast(return_at AS timestamp)), 0) / 1e6 AS t1 FROM options),
p AS (SELECT option_id, t0, t1, carrier, cabin, first_value({'t0': t0, 't1': t1, 'carrier': carrier, 'cabin': cabin})
    OVER (PARTITION BY session_id ORDER BY option_id) AS a FROM t)
SELECT option_id, round((greatest(0.0, 1 - abs(a.t0 - t0) / 3600 / 24) + greatest(0.0, 1 - abs(a.t1 - t1) / 3600 / 24)
  + (a.carrier IS NOT DISTINCT FROM carrier)::int + (a.cabin IS NOT DISTINCT FROM cabin)::int) / 4, 6) AS similarity
FROM p""")
def pair_similarity(df):
    """Every option beside the first of its session."""
    columns = ["departure_at", "return_at", "carrier", "cabin"]
    first = (df.groupBy(S).agg(F.min_by(F.struct(*columns), ROW).alias("a")))
    both = df.select(S, ROW, F.struct(*columns).alias("b")).join(first, S)
    like = rerank.option_similarity("a", "b", columns[:2], columns[2:])
    return rounded(both.select(ROW, like.alias("similarity")), "similarity")


def mmr_round(i: int) -> str:
    """SQL of choice ``i``: best remaining by score less the highest likeness to the rows chosen."""
    like = " , ".join(f"""(greatest(0.0, 1 - abs(s.t0 - w{j}.t0) / 3600 / 24) + greatest(0.0, 1 - abs(s.t1 - w{j}.t1) / 3600 / 24)
      + (s.carrier IS NOT DISTINCT FROM w{j}.carrier)::int + (s.cabin IS NOT DISTINCT FROM w{j}.cabin)::int) / 4"""
                      for j in range(1, i))
    value = "s.score" if i == 1 else f"0.7::double * s.score - (1 - 0.7::double) * greatest({like})"
    joins = "".join(f" JOIN w{j} ON s.session_id = w{j}.session_id AND s.option_id <> w{j}.option_id" for j in range(1, i))
    return f"""
w{i} AS MATERIALIZED (SELECT s.*, {i} AS place FROM s{joins}
  QUALIFY row_number() OVER (PARTITION BY s.session_id ORDER BY {value} DESC, s.option_id) = 1)"""


@on_options("mmr_rerank", f"""
WITH s AS MATERIALIZED (SELECT session_id, option_id, -total_price / 50000.0::double AS score, carrier, cabin,
    coalesce(epoch_us(try_cast(departure_at AS timestamp)), 0) / 1e6 AS t0,
    coalesce(epoch_us(try_cast(return_at AS timestamp)), 0) / 1e6 AS t1 FROM options),
{','.join(mmr_round(i) for i in range(1, 11))}
SELECT session_id, option_id, place::bigint AS new_selected, round(score, 9) AS pred_score
FROM ({' UNION ALL '.join(f'SELECT * FROM w{i}' for i in range(1, 11))})""")
def mmr_rerank(df):
    out = rerank.mmr_rerank(scored(df), S, ROW, "score", ["departure_at", "return_at"], ITEM)
    return rounded(out, "pred_score", places=9)


@on_options("top_k_per_group", f"""
WITH {SCORED}
SELECT option_id, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, option_id)::int AS rank FROM s
QUALIFY rank <= 5""")
def top_k_per_group(df):
    return rerank.top_k_per_group(scored(df), S, "score", [ROW], 5).select(ROW, "rank")


RANKED = f"""{SCORED},
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, option_id) AS rank,
    count(*) OVER (PARTITION BY session_id) AS n FROM s)"""
HITS = f"""{RANKED},
h AS (SELECT session_id, n, min(CASE WHEN selected = 1 THEN rank END) AS first_hit FROM r WHERE n > 10
  GROUP BY session_id, n)"""


def call(fn, df, *args, **kw):
    return fn(scored(df), S, "score", "selected", [ROW], *args, **kw)


@on_options("hitrate_at_3", f"""
WITH {HITS}
SELECT round(avg((coalesce(first_hit, 999) <= 3)::int), 6) AS hitrate, count(*) AS n_groups FROM h""")
def hitrate_at_3(df):
    return rounded(call(metrics.hitrate_at_k, df), "hitrate")


@query("hitrate_large_orders", plain_sql="""
WITH r AS (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber,
    l_partkey, l_suppkey) AS rank, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
h AS (SELECT l_orderkey, max((l_returnflag = 'R' AND rank <= 3)::int) AS hit FROM r WHERE n > 8 GROUP BY l_orderkey)
SELECT round(avg(hit), 6) AS hitrate, count(*) AS n_groups FROM h""")
def hitrate_large_orders(spark, sf_dir):
    """A group key where the size filter drops most groups."""
    df = table(spark, sf_dir, "lineitem").withColumns({
        "score": -F.col("l_extendedprice"), "chosen": (F.col("l_returnflag") == "R").cast("int")})
    out = metrics.hitrate_at_k(df, "l_orderkey", "score", "chosen", ["l_linenumber", "l_partkey", "l_suppkey"],
                               more_than=8)
    return rounded(out, "hitrate")


@on_options("missed_groups", f"""
WITH {HITS}
SELECT option_id, session_id, total_price, selected FROM options
WHERE session_id IN (SELECT session_id FROM h WHERE coalesce(first_hit, 999) > 3)""")
def missed_groups(df):
    return call(metrics.missed_groups, df).select(ROW, S, "total_price", "selected")


@on_options("hitrate_curve", f"""
WITH {HITS}
SELECT k::int AS k, round(avg((coalesce(first_hit, 999) <= k)::int), 6) AS hitrate FROM h, range(1, 21) AS ks(k) GROUP BY k""")
def hitrate_curve(df):
    return rounded(call(metrics.hitrate_curve, df), "hitrate")


@on_options("hit_summary", f"""
WITH {HITS}
SELECT k::int AS k, round(avg((coalesce(first_hit, 999) <= k)::int), 6) AS hitrate
FROM h, (VALUES (1), (3), (4), (5), (6), (10)) AS ks(k) GROUP BY k""")
def hit_summary(df):
    return rounded(call(metrics.hit_summary, df), "hitrate")


@on_options("hitrate_by_size", f"""
WITH {HITS},
o AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS c FROM h),
q AS (SELECT max(CASE WHEN i = floor(0.25 * (c - 1) + 0.5) THEN n END) AS q25,
  max(CASE WHEN i = floor(0.75 * (c - 1) + 0.5) THEN n END) AS q75 FROM o),
b AS (SELECT first_hit, CASE WHEN n <= q25 THEN 'small' WHEN n <= q75 THEN 'medium' ELSE 'large' END AS size_band FROM h, q)
SELECT size_band, k::int AS k, round(avg((coalesce(first_hit, 999) <= k)::int), 6) AS hitrate
FROM b, range(1, 21) AS ks(k) GROUP BY size_band, k""")
def hitrate_by_size(df):
    return rounded(call(metrics.hitrate_by_size_quantile, df), "hitrate")


@on_options("hitrate_log_bins", f"""
WITH {HITS},
m AS (SELECT log10(min(n)) AS a, log10(max(n)) AS b FROM h),
e AS (SELECT i, CASE WHEN i = 50 THEN pow(10, b) ELSE pow(10, a + i * ((b - a) / 50)) END AS edge FROM m, range(51) AS r(i)),
x AS (SELECT session_id, first_hit, count(edge) - 1 AS bin_idx FROM h LEFT JOIN e ON edge <= n GROUP BY session_id, first_hit),
c AS (SELECT i AS bin, (edge + lead(edge) OVER (ORDER BY i)) / 2 AS center FROM e)
SELECT bin_idx::int AS bin_idx, round(center, 6) AS bin_center,
  round(avg((coalesce(first_hit, 999) <= 3)::int), 6) AS hitrate3, count(*) AS n_groups
FROM x JOIN c ON bin = least(greatest(bin_idx, 0), 49) GROUP BY bin_idx, center HAVING count(*) >= 3""")
def hitrate_log_bins(df):
    return rounded(call(metrics.hitrate_by_log_bin, df), "hitrate3", "bin_center")


@on_options("ndcg_at_3", f"""
WITH {RANKED},
d AS (SELECT session_id, sum(CASE WHEN rank <= 3 THEN selected / log2(rank + 1) ELSE 0 END) AS dcg,
    least(sum(selected), 3) AS p FROM r GROUP BY session_id),
i AS (SELECT *, CASE p WHEN 1 THEN 1.0 WHEN 2 THEN 1 + 1 / log2(3) ELSE 1.5 + 1 / log2(3) END AS ideal FROM d)
SELECT round(avg(CASE WHEN p = 0 THEN 1 ELSE dcg / ideal END), 6) AS ndcg, count(*) AS n_groups FROM i""")
def ndcg_at_3(df):
    return rounded(call(metrics.ndcg_at_k, df), "ndcg")


@on_options("staged_metrics", """
WITH m AS (SELECT *, CASE k WHEN 1 THEN -total_price / 50000.0::double WHEN 2 THEN -taxes / 1000.0::double
    ELSE (cabin % 3) - total_price / 100000.0::double END AS score
  FROM options, (VALUES (1), (2), (4)) AS ks(k) WHERE split <> 'test'),
r AS (SELECT *, row_number() OVER (PARTITION BY split, k, session_id ORDER BY score DESC NULLS LAST, option_id) AS rank FROM m),
g AS (SELECT split, k, session_id, count(*) AS n, min(CASE WHEN selected = 1 THEN rank END) AS first_hit,
    least(sum(selected), 3) AS p, sum(CASE WHEN rank <= 3 THEN selected / log2(rank + 1) ELSE 0 END) AS dcg
  FROM r GROUP BY ALL),
i AS (SELECT *, CASE p WHEN 1 THEN 1.0 WHEN 2 THEN 1 + 1 / log2(3) ELSE 1.5 + 1 / log2(3) END AS ideal FROM g)
SELECT split, k::int AS round, round(avg(CASE WHEN p = 0 THEN 1 ELSE dcg / ideal END), 6) AS ndcg, count(*) AS n_groups,
  round(avg(CASE WHEN n > 4 THEN (coalesce(first_hit, 999) <= 3)::int END), 6) AS hitrate,
  count(*) FILTER (n > 4) AS n_large
FROM i GROUP BY split, k""")
def staged_metrics(df):
    """Metrics per round of scores after 1, 2 and 4 rounds, here made of columns."""
    price, tax = F.col("total_price"), F.col("taxes")
    margins = F.array(-price / 50000, -tax / 1000, F.col("cabin") % 3 - price / 100000)
    out = metrics.staged_metrics(df.where("split <> 'test'").withColumn("margins", margins), S, "margins", "selected", [ROW],
                                 rounds=[1, 2, 4], more_than=4)
    return rounded(out, "ndcg", "hitrate")

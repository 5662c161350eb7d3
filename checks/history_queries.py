"""Statistics of past choices and enrichment joins (SURVEY D, E)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.fixture import options, table
from checks.registry import nullable, on_options, query, rounded
from choicerank.functions.text import split_route
from choicerank.operators import enrich, history
from choicerank.operators.history import GLOBAL, Stat
from choicerank.settings import checkpointed


def with_values(df):
    """Columns the statistics read: log price, scaled price in the session, hour, flags."""
    from choicerank.operators.session import group_minmax

    df = group_minmax(df, "session_id", {"total_price": "price_rank", "taxes": "tax_rank"})
    return df.withColumns({
        "log_price": F.log1p("total_price"),
        "hour": F.coalesce(F.hour(F.col("return_at").try_cast("timestamp_ntz")), F.lit(-1)),
        "is_direct": (F.coalesce("cabin", F.lit(0)) == 1).cast("int"),
        "has_tariff": F.col("tariff_code").isNotNull().cast("int"),
    })


VALUES = """v AS (SELECT *, ln(1 + total_price) AS log_price,
    (total_price - min(total_price) OVER s)
      / (max(total_price) OVER s - min(total_price) OVER s + 0.000000001::double) AS price_rank,
    (taxes - min(taxes) OVER s) / (max(taxes) OVER s - min(taxes) OVER s + 0.000000001::double) AS tax_rank,
    coalesce(hour(try_cast(return_at AS timestamp)), -1) AS hour,
    CASE WHEN cabin = 1 THEN 1 ELSE 0 END AS is_direct,
    CASE WHEN tariff_code IS NULL THEN 0 ELSE 1 END AS has_tariff
  FROM options WINDOW s AS (PARTITION BY session_id)),
past AS (SELECT * FROM v WHERE split = 'train' AND selected = 1)"""


@on_options("history_stats", """
WITH past AS (SELECT *, ln(1 + total_price) AS lp FROM options WHERE split = 'train' AND selected = 1),
t AS (SELECT profile_id, count(*) AS n, avg(lp) AS m, stddev_samp(lp) AS sd FROM past GROUP BY profile_id),
g AS (SELECT avg(lp) AS m, stddev_samp(lp) AS sd FROM past)
SELECT option_id, coalesce(n, 0) AS chosen, round(coalesce(t.m, g.m), 6) AS mean_price,
  round(coalesce(t.sd, g.sd), 6) AS std_price, round(t.m, 6) AS own_mean
FROM options CROSS JOIN g LEFT JOIN t USING (profile_id)""")
def history_stats(df):
    lp = F.log1p("total_price")
    out = history.history_stats(df, "profile_id", [
        Stat("chosen", F.count(F.lit(1)), 0), Stat("mean_price", F.avg(lp), GLOBAL),
        Stat("std_price", F.stddev_samp(lp), GLOBAL), Stat("own_mean", F.avg(lp))])
    names = ["mean_price", "std_price", "own_mean"]
    return rounded(out.select("option_id", "chosen", *names), *names)


@on_options("company_stats", f"""
WITH {VALUES},
g AS (SELECT avg(log_price) AS m, stddev_samp(log_price) AS sd FROM past),
t AS (SELECT profile_id, count(*) AS n, avg(log_price) AS m, stddev_samp(log_price) AS sd, avg(is_direct) AS direct,
    avg((hour < 6)::int) AS night, avg(price_rank) AS pct, avg(has_tariff) AS policy FROM past GROUP BY profile_id),
j AS (SELECT option_id, total_price, n, CASE WHEN n > 1 THEN t.m ELSE g.m END AS m, coalesce(t.sd, g.sd) AS sd,
    direct, night, pct, policy FROM v CROSS JOIN g LEFT JOIN t USING (profile_id))
SELECT option_id, coalesce(n, 0) AS company_ocurrence, round(m, 6) AS avg_selected_price,
  round(sd, 6) AS std_selected_price, round(coalesce(direct, 0), 6) AS direct_ratio,
  round(coalesce(night, 0), 6) AS night_ratio, round(pct, 6) AS avg_pct, round(policy, 6) AS policy_rate,
  round((total_price - m) / (sd + 0.000001::double), 2) AS z_price_vs_company_selected
FROM j""")
def company_stats(df):
    out = history.company_stats(
        with_values(df), "profile_id", "total_price", "log_price",
        shares={"direct_ratio": F.col("is_direct"), "night_ratio": (F.col("hour") < 6).cast("int")},
        means={"avg_pct": "price_rank", "policy_rate": "has_tariff"})
    names = ["avg_selected_price", "std_selected_price", "direct_ratio", "night_ratio", "avg_pct", "policy_rate"]
    out = out.select("option_id", "company_ocurrence", *names, "z_price_vs_company_selected")
    return rounded(rounded(out, *names), "z_price_vs_company_selected", places=2)


@on_options("carrier_selection_rate", """
WITH t AS (SELECT carrier, count(*) AS n, sum(selected) AS k FROM options WHERE split = 'train' GROUP BY carrier)
SELECT option_id, round(coalesce(k / n, 0), 6) AS c_selection_rate, round(coalesce(ln(1 + n), 0), 6) AS c_log_total_count,
  round(coalesce(ln(1 + k), 0), 6) AS c_log_selected_count
FROM options LEFT JOIN t USING (carrier)""")
def carrier_selection_rate(df):
    out = history.carrier_selection_rate(df, "carrier", "c")
    names = ["c_selection_rate", "c_log_total_count", "c_log_selected_count"]
    return rounded(out.select("option_id", *names), *names)


@on_options("carrier_stats", """
WITH t AS (SELECT carrier, count(*) AS n FROM options WHERE split = 'train' GROUP BY carrier),
u AS (SELECT carrier AS operating_carrier, n AS m FROM t)
SELECT option_id, round(coalesce(ln(1 + n), 0) + coalesce(ln(1 + m), 0), 6) AS carrier_pop_prod,
  round(ln(1 + count(*) OVER (PARTITION BY session_id)), 6) AS group_size_log
FROM options LEFT JOIN t USING (carrier) LEFT JOIN u USING (operating_carrier)""")
def carrier_stats(df):
    from choicerank.functions.numbers import log_sum, log_transform
    from choicerank.operators.session import group_size

    out = history.carrier_selection_rate(df, "carrier", "a")
    renamed = df.where("split = 'train'").select(F.col("carrier").alias("operating_carrier"), "selected")
    out = history.carrier_selection_rate(out, "operating_carrier", "b", train=renamed)
    out = group_size(out, "session_id", "option_id", "group_size_log").withColumns(log_transform(["group_size_log"]))
    out = out.select("option_id", log_sum("a_log_total_count", "b_log_total_count").alias("carrier_pop_prod"),
                     "group_size_log")
    return rounded(out, "carrier_pop_prod", "group_size_log")


@on_options("cabin_share_pivot", """
WITH past AS (SELECT * FROM options WHERE split = 'train' AND selected = 1),
n AS (SELECT carrier, cabin, count(*) AS k FROM past GROUP BY carrier, cabin),
t AS (SELECT carrier, sum(k) AS n FROM n GROUP BY carrier),
s AS (SELECT carrier, cabin, k / (n + 0.00001::double) AS share FROM n JOIN t USING (carrier)),
w AS (SELECT carrier, max(CASE WHEN cabin = 1 THEN share END) AS c1, max(CASE WHEN cabin = 2 THEN share END) AS c2,
    max(CASE WHEN cabin = 3 THEN share END) AS c3, max(CASE WHEN cabin = 4 THEN share END) AS c4
  FROM s GROUP BY carrier)
SELECT option_id, round(c1, 6) AS c_cabin1_select_ratio, round(c2, 6) AS c_cabin2_select_ratio,
  round(c3, 6) AS c_cabin3_select_ratio, round(c4, 6) AS c_cabin4_select_ratio
FROM options LEFT JOIN w USING (carrier)""")
def cabin_share_pivot(df):
    out = history.cabin_share_pivot(df, "carrier", "cabin", "c")
    names = [f"c_cabin{i}_select_ratio" for i in (1, 2, 3, 4)]
    return rounded(out.select("option_id", *names), *names)


@on_options("carrier_behaviour", f"""
WITH {VALUES},
g AS (SELECT avg(price_rank) AS p, avg(tax_rank) AS t FROM past),
c AS (SELECT carrier, avg(price_rank) AS p, avg(tax_rank) AS t, avg(hour) AS h, avg((hour < 6)::int) AS night,
    count(DISTINCT company_id) AS companies,
    count(DISTINCT tariff_code) + max(CASE WHEN tariff_code IS NULL THEN 1 ELSE 0 END) AS users
  FROM past GROUP BY carrier)
SELECT option_id, round(coalesce(c.p, g.p), 6) AS c_avg_price_rank, round(coalesce(c.t, g.t), 6) AS c_avg_duration_rank,
  round(coalesce(h, 12.0), 6) AS c_avg_dep_hour, round(coalesce(night, 0), 6) AS c_night_ratio,
  coalesce(companies, 0) AS c_company_diversity, coalesce(users, 0) AS c_user_diversity
FROM v CROSS JOIN g LEFT JOIN c USING (carrier)""")
def carrier_behaviour(df):
    out = history.carrier_behaviour(with_values(df), "carrier", "c", price_rank="price_rank",
                                    duration_rank="tax_rank", hour="hour", company="company_id", user="tariff_code")
    names = ["c_avg_price_rank", "c_avg_duration_rank", "c_avg_dep_hour", "c_night_ratio"]
    return rounded(out.select("option_id", *names, "c_company_diversity", "c_user_diversity"), *names)


@on_options("profile_stats", f"""
WITH {VALUES},
t AS (SELECT profile_id, count(*) AS n, avg(price_rank) AS p, avg(tax_rank) AS d, avg(coalesce(cabin, 0)) AS c
  FROM past GROUP BY profile_id)
SELECT option_id, coalesce(n, 0) AS user_selected_count, n::double AS user_total_count,
  round(price_rank - coalesce(p, 0.25), 6) + 0.0 AS price_rank_diff,
  round(tax_rank - coalesce(d, 0.5), 6) + 0.0 AS duration_rank_diff, round(coalesce(c, 1.0), 6) AS user_avg_cabin
FROM v LEFT JOIN t USING (profile_id)""")
def profile_stats(df):
    values = with_values(df).withColumn("cabin", F.coalesce("cabin", F.lit(0)))
    out = history.profile_stats(values, "profile_id", price_rank="price_rank", duration_rank="tax_rank",
                                cabin="cabin", fallbacks={"price_rank": 0.25, "tax_rank": 0.5, "cabin": 1.0})
    names = ["price_rank_diff", "duration_rank_diff", "user_avg_cabin"]
    out = out.select("option_id", "user_selected_count", "user_total_count", *names)
    return nullable(rounded(out, *names), "user_total_count")


def density_sql(values: str) -> str:
    return f"""
WITH x AS ({values}),
m AS (SELECT min(x) AS lo, max(x) AS hi, stddev_samp(x) * pow(count(*), -0.2) AS w, count(*) AS n FROM x),
k AS (SELECT x, count(*) AS c FROM x GROUP BY x),
g AS (SELECT i, lo + i * ((hi - lo) / 999) AS gx, w, n FROM m, range(1000) AS r(i)),
d AS (SELECT i, gx, sum(c * exp(-0.5 * pow((gx - x) / w, 2))) / (any_value(n) * any_value(w) * sqrt(2 * pi())) AS density
  FROM g, k GROUP BY i, gx)"""


@query("density_mode", plain_sql=density_sql("SELECT l_quantity AS x FROM lineitem") + """
SELECT round(max(density), 8) AS density, round(arg_max(gx, density), 6) AS mode FROM d""")
def density_mode(spark, sf_dir):
    curve = history.density_curve(table(spark, sf_dir, "lineitem"), "l_quantity")
    best = curve.agg(F.max("density").alias("density"), F.max_by("x", F.struct("density", -F.col("i"))).alias("mode"))
    return rounded(rounded(best, "density", places=8), "mode")


@on_options("density_curve", density_sql("""SELECT ln(1 + total_price) AS x FROM options
  WHERE split = 'train' AND selected = 1""") + """
SELECT i, round(gx, 6) AS x, round(density, 6) AS density FROM d""")
def density_curve(df):
    past = history.history_rows(df, None).withColumn("lp", F.log1p("total_price"))
    curve = history.density_curve(past, "lp")
    return rounded(curve.select("i", "x", "density"), "x", "density")


def mode_ctes(name: str, column: str) -> str:
    return f"""
{name}m AS (SELECT min({column}) AS lo, max({column}) AS hi, stddev_samp({column}) * pow(count(*), -0.2) AS w FROM past),
{name}k AS (SELECT {column} AS x, count(*) AS c FROM past GROUP BY 1),
{name}d AS (SELECT i, lo + i * ((hi - lo) / 999) AS gx, sum(c * exp(-0.5 * pow((lo + i * ((hi - lo) / 999) - x) / w, 2))) AS density
  FROM {name}m, range(1000) AS r(i), {name}k GROUP BY i, lo, hi),
{name}mode AS (SELECT arg_max(gx, density) AS mode FROM {name}d)"""


@on_options("profile_mode_fallback", f"""
WITH {VALUES}, {mode_ctes('p', 'price_rank')}, {mode_ctes('t', 'tax_rank')},
t AS (SELECT profile_id, count(*) AS n, avg(price_rank) AS p, avg(tax_rank) AS d FROM past GROUP BY profile_id)
SELECT option_id, coalesce(n, 0) AS user_selected_count,
  round(price_rank - coalesce(p, pmode.mode), 6) + 0.0 AS price_rank_diff,
  round(tax_rank - coalesce(d, tmode.mode), 6) + 0.0 AS duration_rank_diff
FROM v CROSS JOIN pmode CROSS JOIN tmode LEFT JOIN t USING (profile_id)""")
def profile_mode_fallback(df):
    out = history.profile_stats(with_values(df), "profile_id", price_rank="price_rank", duration_rank="tax_rank",
                                cabin="cabin")
    names = ["price_rank_diff", "duration_rank_diff"]
    return rounded(out.select("option_id", "user_selected_count", *names), *names)


@on_options("code_stats_null_fallback", f"""
WITH {VALUES},
t AS (SELECT tariff_code, count(*) AS n, avg(price_rank) AS p, avg(tax_rank) AS d FROM past GROUP BY tariff_code),
z AS (SELECT * FROM t WHERE tariff_code IS NULL)
SELECT option_id, coalesce(t.n, z.n) AS tariff_code_hotness, round(coalesce(t.p, z.p), 6) AS tariff_code_price_rank_mean,
  round(coalesce(t.d, z.d), 6) AS tariff_code_duration_rank_mean
FROM v CROSS JOIN z LEFT JOIN t ON v.tariff_code = t.tariff_code""")
def code_stats_null_fallback(df):
    out = history.tariff_code_stats(with_values(df), "tariff_code", price_rank="price_rank", duration_rank="tax_rank")
    names = ["tariff_code_price_rank_mean", "tariff_code_duration_rank_mean"]
    return rounded(out.select("option_id", "tariff_code_hotness", *names), *names)


def route_sql(name: str, part: int) -> str:
    return f"""
{name} AS (SELECT r[{part}] AS route, count(*) AS n, avg(log_price) AS p, avg(tax_rank) AS d, avg(has_tariff) AS policy,
    avg(is_direct) AS direct FROM rp GROUP BY 1)"""


@on_options("route_stats", f"""
WITH {VALUES}, rv AS (SELECT *, string_split(search_route, '/') AS r FROM v),
rp AS (SELECT * FROM rv WHERE split = 'train' AND selected = 1),
g AS (SELECT avg(log_price) AS p, avg(tax_rank) AS d FROM past), {route_sql('o', 1)}, {route_sql('b', 2)}
SELECT option_id, coalesce(o.n, 0) AS outbound_route_hotness, round(coalesce(o.p, g.p), 6) AS outbound_route_avg_price,
  round(coalesce(o.d, g.d), 6) AS outbound_route_avg_duration, round(coalesce(o.policy, 0), 6) AS outbound_route_policy_rate,
  round(o.direct, 6) AS outbound_route_direct_ratio, coalesce(b.n, 0) AS return_route_hotness,
  round(coalesce(b.p, g.p), 6) AS return_route_avg_price, round(coalesce(b.d, g.d), 6) AS return_route_avg_duration,
  round(coalesce(b.policy, 0), 6) AS return_route_policy_rate, round(b.direct, 6) AS return_route_direct_ratio
FROM rv CROSS JOIN g LEFT JOIN o ON r[1] = o.route LEFT JOIN b ON r[2] = b.route""")
def route_stats(df):
    out = with_values(df).withColumns(split_route("search_route"))
    routes = ["outbound_route", "return_route"]
    past = checkpointed(history.history_rows(out, None).select(
        *routes, "log_price", "tax_rank", "has_tariff", "is_direct"))
    out = history.with_history(out, *[history.route(route, log_price="log_price", duration="tax_rank",
                                                    policy="has_tariff", direct="is_direct", history=past)
                                      for route in routes])
    names = [f"{route}_{x}" for route in routes for x in ("avg_price", "avg_duration", "policy_rate", "direct_ratio")]
    return rounded(out.select("option_id", "outbound_route_hotness", "return_route_hotness", *names), *names)


@on_options("route_share", f"""
WITH {VALUES},
a AS (SELECT search_route, cabin, count(*) AS n, avg(price_rank) AS p, avg(tax_rank) AS d FROM past
  GROUP BY search_route, cabin),
r AS (SELECT search_route, count(*) AS total FROM past GROUP BY search_route)
SELECT option_id, round(n / total, 6) AS route_aircraft_ratio, round(p, 6) AS aircraft_avg_pct, round(d, 6) AS aircraft_avg_dct
FROM v LEFT JOIN a USING (search_route, cabin) LEFT JOIN r USING (search_route)""")
def route_share(df):
    out = history.route_aircraft_stats(with_values(df), "search_route", "cabin", price_rank="price_rank",
                                       duration_rank="tax_rank")
    names = ["route_aircraft_ratio", "aircraft_avg_pct", "aircraft_avg_dct"]
    return rounded(out.select("option_id", *names), *names)


@query("geo_enrichment", """
WITH p AS (SELECT concat('N', n_nationkey::varchar) AS code, (n_nationkey % 24 - 12)::double AS off, r_name AS country
  FROM nation JOIN region ON n_regionkey = r_regionkey),
s AS (SELECT option_id, carrier, CASE WHEN cabin = 1 THEN carrier WHEN cabin = 2 THEN operating_carrier
    WHEN cabin = 3 THEN company_id END AS last FROM options)
SELECT option_id, a.off AS trip_departure_airport_off, a.country AS trip_departure_airport_country,
  b.off AS trip_arrival_airport_off, b.country AS trip_arrival_airport_country,
  CASE WHEN a.country <> b.country THEN 1 ELSE 0 END AS trip_is_cross_country,
  coalesce(a.off <> b.off, false) AS trip_is_cross_timezone
FROM s LEFT JOIN p a ON carrier = a.code LEFT JOIN p b ON last = b.code""")
def geo_enrichment(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"),
        (F.col("n_nationkey") % 24 - 12).cast("double").alias("off"), F.col("r_name").alias("country"))
    df = options(spark, sf_dir).select("option_id", "carrier", "operating_carrier", "company_id", "cabin")
    last = enrich.last_stop(["carrier", "operating_carrier", "company_id"], "cabin")
    out = enrich.airport_enrichment(df, places, "carrier", last, "trip", code="code", offset="off", country="country")
    return out.drop("carrier", "operating_carrier", "company_id", "cabin")


LABELS = """SELECT o_custkey AS profile_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_id,
    o_orderpriority AS category, o_orderstatus AS status FROM orders"""


@query("label_join", f"""
WITH l AS ({LABELS}),
o AS (SELECT option_id, profile_id, row_number() OVER (PARTITION BY profile_id ORDER BY option_id) AS row_id FROM options)
SELECT option_id, category, CASE WHEN l.row_id IS NULL THEN NULL WHEN status = 'F' THEN 0 ELSE 1 END::double AS has_any_label
FROM o LEFT JOIN l USING (profile_id, row_id)""")
def label_join(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    labels = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("profile_id"), F.row_number().over(w).cast("bigint").alias("row_id"),
        F.col("o_orderpriority").alias("category"),
        F.filter(F.array("o_orderstatus"), lambda x: x != "F").alias("labels"))
    out = enrich.label_enrichment(options(spark, sf_dir), labels, "profile_id", [F.col("option_id")])
    return nullable(out.select("option_id", "category", "has_any_label"), "has_any_label")


@query("summary_join", """
SELECT option_id, p_size::double AS p_size, p_brand FROM options
LEFT JOIN part ON session_id = p_partkey""")
def summary_join(spark, sf_dir):
    summary = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("session_id"), "p_size", "p_brand")
    out = enrich.summary_enrichment(options(spark, sf_dir), summary, "session_id")
    return nullable(out.select("option_id", "p_size", "p_brand"), "p_size")

"""Row expressions (SURVEY B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import nullable, on_options, query, rounded
from checks.fixture import table
from choicerank.functions import calendar, numbers, text
from choicerank.operators import tables


@on_options("duration_minutes", """
WITH p AS (SELECT option_id, duration0, duration1,
    CASE WHEN contains(duration0, '.') THEN cast(split_part(duration0, '.', 1) AS bigint) ELSE 0 END AS days,
    CASE WHEN contains(duration0, '.') THEN split_part(duration0, '.', 2) ELSE duration0 END AS rest
  FROM options)
SELECT option_id,
  days * 1440 + cast(split_part(rest, ':', 1) AS bigint) * 60 + cast(split_part(rest, ':', 2) AS bigint) AS minutes0,
  CASE WHEN duration1 IS NULL THEN 0
       ELSE cast(split_part(duration1, ':', 1) AS bigint) * 60 + cast(split_part(duration1, ':', 2) AS bigint)
  END AS minutes1
FROM p""")
def duration_minutes(df):
    return df.select("option_id", text.duration_to_minutes("duration0").alias("minutes0"),
                     text.duration_to_minutes("duration1").alias("minutes1"))


@on_options("price_ratios", """
SELECT option_id, round(total_price / (taxes + 1), 6) AS price_per_tax,
  round(taxes / (total_price + 1), 6) AS tax_rate, round(ln(1 + total_price), 6) AS log_price,
  round(ln(1 + taxes), 6) AS log_taxes, CASE WHEN taxes = 0 THEN 1 ELSE 0 END AS is_zero_tax
FROM options""")
def price_ratios(df):
    out = df.select("option_id", *[e.alias(n) for n, e in numbers.price_ratios("total_price", "taxes").items()])
    return rounded(out, "price_per_tax", "tax_rate", "log_price", "log_taxes")


@on_options("fee_ratios", """
WITH f AS (SELECT *, CASE WHEN cabin IS NULL THEN NULL WHEN cabin = 1 THEN 0 ELSE taxes END AS fee,
    CASE WHEN carrier IS NULL THEN NULL ELSE tariff_code % 2 END AS status FROM options)
SELECT option_id, round(fee / nullif(total_price, 0), 6) AS ratio,
  CASE WHEN fee IS NULL THEN 1 ELSE 0 END AS missing,
  (fee = 0 AND status = 1)::int::double AS free
FROM f""")
def fee_ratios(df):
    fee = F.when(F.col("cabin") == 1, F.lit(0.0)).when(F.col("cabin").isNotNull(), F.col("taxes"))
    status = F.when(F.col("carrier").isNotNull(), F.col("tariff_code") % 2)
    ratio = numbers.fee_ratio(fee, "total_price")
    out = df.select("option_id", ratio.alias("ratio"), numbers.is_missing(ratio).alias("missing"),
                    numbers.is_free(fee, status).alias("free"))
    return nullable(rounded(out, "ratio"), "free")


MINUTES = """m AS (SELECT *,
    cast(split_part(split_part(concat('0.', duration0), '.', -1), ':', 1) AS bigint) * 60
    + cast(split_part(split_part(concat('0.', duration0), '.', -1), ':', 2) AS bigint)
    + CASE WHEN contains(duration0, '.') THEN 1440 ELSE 0 END AS minutes0,
    CASE WHEN duration1 IS NULL THEN 0 ELSE cast(split_part(duration1, ':', 1) AS bigint) * 60
      + cast(split_part(duration1, ':', 2) AS bigint) END AS minutes1
  FROM options)"""


def with_minutes(df):
    return df.withColumns({"minutes0": text.duration_to_minutes("duration0"),
                           "minutes1": text.duration_to_minutes("duration1")})


@on_options("leg_totals", f"""
WITH {MINUTES}
SELECT option_id, minutes0 + minutes1 AS total_duration,
  CASE WHEN minutes1 > 0 THEN minutes0 / minutes1 ELSE 0.0 END AS duration_ratio,
  total_price / nullif(minutes0 + minutes1, 0) AS price_duration_rat
FROM m""")
def leg_totals(df):
    parts = numbers.leg_totals("minutes0", "minutes1", "total_price")
    return with_minutes(df).select("option_id", *[e.alias(n) for n, e in parts.items()])


@on_options("trip_type", f"""
WITH {MINUTES}
SELECT option_id, CASE WHEN minutes1 = 0 OR return_at IS NULL OR carrier IS NULL THEN 1 ELSE 0 END AS is_one_way
FROM m""")
def trip_type(df):
    origin = F.when(F.col("return_at").isNotNull(), F.col("carrier"))
    return with_minutes(df).select("option_id", numbers.is_one_way("minutes1", origin).alias("is_one_way"))


@on_options("count_present", """
SELECT option_id, (CASE WHEN carrier IS NULL THEN 0 ELSE 1 END) + (CASE WHEN cabin IS NULL THEN 0 ELSE 1 END)
  + (CASE WHEN duration1 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN loyalty IS NULL THEN 0 ELSE 1 END) AS present
FROM options""")
def count_present(df):
    present = numbers.count_present(["carrier", "cabin", "duration1", "loyalty"])
    return df.select("option_id", present.alias("present"))


@on_options("list_count", """
SELECT option_id, CASE WHEN loyalty IS NULL THEN 0 ELSE len(string_split(loyalty, '/')) END::int AS n_programs,
  CASE WHEN loyalty IS NULL THEN 0 ELSE 1 END AS has_program
FROM options""")
def list_count(df):
    return df.select("option_id", text.list_count("loyalty").alias("n_programs"),
                     text.has_text("loyalty").alias("has_program"))


@on_options("list_membership", """
WITH s AS (SELECT *, coalesce(loyalty, '') AS listed FROM options),
t AS (SELECT *, carrier IS NOT NULL AND list_contains(string_split(listed, '/'), carrier) AS member FROM s)
SELECT option_id, member::int AS in_list,
  CASE WHEN contains(listed, '/') THEN 0 WHEN carrier IS NULL THEN NULL
       ELSE contains(listed, carrier)::int END::double AS is_only,
  (carrier IN ('N1', 'N7'))::int::double AS in_major,
  CASE WHEN member AND cabin IN (1, 2) THEN 1 ELSE 0 END AS member_low_cabin
FROM t""")
def list_membership(df):
    parts = text.list_membership("loyalty", "carrier", "cabin", ["N1", "N7"])
    return nullable(df.select("option_id", *[e.alias(n) for n, e in parts.items()]), "is_only", "in_major")


@on_options("conditional_flags", """
SELECT option_id, CASE WHEN tariff_code IS NULL THEN 0 ELSE 1 END AS has_code,
  CASE WHEN tariff_code IS NOT NULL AND cabin = 1 THEN 1 ELSE 0 END AS code_and_policy,
  CASE WHEN tariff_code IS NOT NULL AND profile_id % 11 = 0 THEN 1 ELSE 0 END AS code_and_vip,
  CASE WHEN profile_id % 11 = 0 OR loyalty IS NOT NULL THEN 1 ELSE 0 END AS vip_or_member
FROM options""")
def conditional_flags(df):
    parts = numbers.conditional_flags("tariff_code", "cabin", F.col("profile_id") % 11 == 0,
                                      text.list_count("loyalty"))
    return df.select("option_id", *[e.alias(n) for n, e in parts.items()])


@on_options("pattern_flags", """
SELECT option_id, CASE WHEN search_route IN ('NN1NN2', 'NN2NN1', 'NN1NN2/NN2NN1') THEN 1 ELSE 0 END AS popular,
  CASE WHEN contains(search_route, 'NN3') OR contains(search_route, 'N14') THEN 1 ELSE 0 END AS has_capital,
  (carrier = 'N8')::int::double AS is_n8
FROM options""")
def pattern_flags(df):
    routes = ["NN1NN2", "NN2NN1", "NN1NN2/NN2NN1"]
    return nullable(df.select("option_id", text.in_set("search_route", routes).alias("popular"),
                              text.matches("search_route", "NN3|N14").alias("has_capital"),
                              text.in_set("carrier", ["N8"]).alias("is_n8")), "is_n8")


@on_options("columns_differ", """
SELECT option_id, (carrier <> operating_carrier)::int::double AS codeshare
FROM options""")
def columns_differ(df):
    differ = numbers.columns_differ("carrier", "operating_carrier").alias("codeshare")
    return nullable(df.select("option_id", differ), "codeshare")


@on_options("impute_mean", """
SELECT option_id, coalesce(tariff_code, -1) AS tariff_code,
  round(coalesce(cabin, (SELECT sum(cabin) / count(cabin) FROM options)), 6) AS cabin
FROM options""")
def impute_mean(df):
    out = tables.impute(df, {"tariff_code": -1}, ["cabin"]).select("option_id", "tariff_code", "cabin")
    return rounded(out, "cabin")


@on_options("direct_flags", """
WITH s AS (SELECT *, coalesce(cabin, 0) AS n0, length(coalesce(loyalty, '')) % 3 AS n1,
    CASE WHEN return_at IS NULL THEN 1 ELSE 0 END AS one_way FROM options)
SELECT option_id, CASE WHEN n0 = 1 THEN 1 ELSE 0 END AS is_direct_leg0,
  CASE WHEN one_way = 0 AND n1 = 1 THEN 1 ELSE 0 END AS is_direct_leg1,
  CASE WHEN n0 = 1 AND one_way = 0 AND n1 = 1 THEN 1 ELSE 0 END AS both_direct
FROM s""")
def direct_flags(df):
    parts = numbers.direct_flags(F.coalesce("cabin", F.lit(0)),
                                 F.length(F.coalesce("loyalty", F.lit(""))) % 3,
                                 F.col("return_at").isNull().cast("int"))
    return df.select("option_id", *[e.alias(n) for n, e in parts.items()])


def calendar_sql(column: str, prefix: str, source: str, key: str) -> str:
    return f"""
WITH h AS (SELECT {key}, coalesce(hour({column}), -1) AS h, coalesce(isodow({column}), 0) AS d FROM {source})
SELECT {key}, h::int AS {prefix}_hour, d::int AS {prefix}_weekday,
  CASE WHEN h BETWEEN 6 AND 20 THEN 1 ELSE 0 END AS {prefix}_business_time,
  CASE WHEN h IN (7, 8, 9) THEN 1 ELSE 0 END AS {prefix}_peak_morning,
  CASE WHEN h IN (19, 20, 21) THEN 1 ELSE 0 END AS {prefix}_peak_evening,
  CASE WHEN h = -1 THEN -1 WHEN h <= 5 THEN 0 WHEN h = 6 THEN 1 WHEN h <= 11 THEN 2 WHEN h <= 18 THEN 3
       WHEN h <= 21 THEN 4 ELSE 5 END AS {prefix}_time_bin
FROM h"""


@on_options("calendar_features", calendar_sql("try_cast(return_at AS timestamp)", "back", "options", "option_id"))
def calendar_features(df):
    parts = calendar.calendar_features(calendar.as_time("return_at"), "back")
    return df.select("option_id", *[e.alias(n) for n, e in parts.items()])


@query("calendar_events", plain_sql=calendar_sql("ts", "event", "events", "event_id"))
def calendar_events(spark, sf_dir):
    parts = calendar.calendar_features("ts", "event")
    return table(spark, sf_dir, "events").select("event_id", *[e.alias(n) for n, e in parts.items()])


HOURS = """t AS (SELECT *, try_cast(departure_at AS timestamp) AS dep, try_cast(return_at AS timestamp) AS ret
  FROM options),
h AS (SELECT *, coalesce(hour(dep), -1) AS hd, coalesce(hour(ret), -1) AS hr FROM t),
b AS (SELECT *,
  CASE WHEN hd = -1 THEN -1 WHEN hd <= 5 THEN 0 WHEN hd = 6 THEN 1 WHEN hd <= 11 THEN 2 WHEN hd <= 18 THEN 3
       WHEN hd <= 21 THEN 4 ELSE 5 END AS bd,
  CASE WHEN hr = -1 THEN -1 WHEN hr <= 5 THEN 0 WHEN hr = 6 THEN 1 WHEN hr <= 11 THEN 2 WHEN hr <= 18 THEN 3
       WHEN hr <= 21 THEN 4 ELSE 5 END AS br FROM h)"""


@on_options("calendar_combos", f"""
WITH {HOURS}
SELECT option_id, cast(bd AS varchar) || '_' || cast(br AS varchar) AS trip_dep_arr_bin_combo,
  CASE WHEN hd BETWEEN 6 AND 20 AND hr BETWEEN 6 AND 20 THEN 1 ELSE 0 END AS trip_is_business_friendly,
  CASE WHEN hd < 6 OR hr < 6 THEN 1 ELSE 0 END AS trip_is_red_eye
FROM b""")
def calendar_combos(df):
    parts = calendar.calendar_combos(calendar.as_time("departure_at"), calendar.as_time("return_at"), "trip")
    return df.select("option_id", *[e.alias(n) for n, e in parts.items()])


@on_options("gap_features", f"""
WITH {HOURS},
g AS (SELECT option_id, greatest((epoch_us(ret) - epoch_us(dep)) / 3600000000.0, 0) AS gap_or_0, ret FROM b),
k AS (SELECT option_id, CASE WHEN ret IS NULL THEN NULL ELSE gap_or_0 END AS gap FROM g)
SELECT option_id, round(gap, 6) AS stay_duration_hours, round(ln(1 + gap), 6) AS stay_duration_hours_log,
  CASE WHEN gap > 0 AND gap < 36 THEN 1 ELSE 0 END AS is_short_trip,
  CASE WHEN gap IS NULL THEN 5 WHEN gap = 0 THEN -1 WHEN gap < 16 THEN 0 WHEN gap < 38 THEN 1 WHEN gap < 64 THEN 2
       WHEN gap < 88 THEN 3 WHEN gap < 112 THEN 4 ELSE 5 END AS stay_duration_bin
FROM k""")
def gap_features(df):
    parts = calendar.gap_features(calendar.as_time("departure_at"), calendar.as_time("return_at"))
    out = df.select("option_id", *[e.alias(n) for n, e in parts.items()])
    return rounded(out, "stay_duration_hours", "stay_duration_hours_log")


@on_options("lead_time", """
WITH g AS (SELECT option_id, (epoch_us(try_cast(return_at AS timestamp)) - epoch_us(request_ts)) / 3600000000.0 AS h
  FROM options)
SELECT option_id, round(coalesce(greatest(h, 0), 0), 6) AS hours_to_departure,
  (h < 48)::int::double AS is_last_minute_booking
FROM g""")
def lead_time(df):
    parts = calendar.lead_time("request_ts", calendar.as_time("return_at"))
    out = df.select("option_id", *[e.alias(n) for n, e in parts.items()])
    return nullable(rounded(out, "hours_to_departure"), "is_last_minute_booking")


@on_options("overnight_bins", f"""
WITH {MINUTES}, t AS (SELECT *, try_cast(departure_at AS timestamp) AS dep, try_cast(return_at AS timestamp) AS ret FROM m)
SELECT option_id,
  CASE WHEN minutes0 <= 360 THEN 0.0 ELSE (ret::date <> dep::date)::int::double END AS trip_is_overnight_flight,
  CASE WHEN minutes0 <= 60 THEN 0 WHEN minutes0 <= 105 THEN 1 WHEN minutes0 <= 360 THEN 2 WHEN minutes0 <= 600 THEN 3
       ELSE 4 END AS trip_duration_bin
FROM t""")
def overnight_bins(df):
    parts = calendar.overnight_and_duration_bin(calendar.as_time("departure_at"), calendar.as_time("return_at"),
                                                "minutes0", "trip")
    out = with_minutes(df).select("option_id", *[e.alias(n) for n, e in parts.items()])
    return nullable(out, "trip_is_overnight_flight")


@on_options("threshold_bin", """
SELECT option_id, CASE WHEN total_price <= 1000 THEN 1 WHEN total_price <= 20000 THEN 2
  WHEN total_price <= 60000 THEN 3 ELSE 4 END AS price_bin
FROM options""")
def threshold_bin(df):
    return df.select("option_id", numbers.threshold_bin("total_price", [1000, 20000, 60000], 1).alias("price_bin"))


@on_options("cabin_features", """
WITH c AS (SELECT option_id, profile_id, coalesce(cabin, 0)::int AS a, coalesce(tariff_code % 5, 0)::int AS b FROM options)
SELECT option_id, CASE WHEN a = 3 OR b = 3 THEN 1 ELSE 0 END AS has_business_class,
  CASE WHEN a = 4 OR b = 4 THEN 1 ELSE 0 END AS has_first_class, greatest(a, b) AS max_cabin_level,
  CASE WHEN a IN (0, 1) AND b IN (0, 1) AND a + b > 0 THEN 1 ELSE 0 END AS all_cabin_level_1,
  CASE WHEN profile_id % 11 = 0 AND (a = 4 OR b = 4) THEN 1 ELSE 0 END AS vip_first_class
FROM c""")
def cabin_features(df):
    parts = numbers.cabin_features(["cabin", F.col("tariff_code") % 5], F.col("profile_id") % 11 == 0)
    return df.select("option_id", *[e.alias(n) for n, e in parts.items()])


@query("age_bins", plain_sql="""
WITH a AS (SELECT c_custkey, (2024 - (1930 + c_custkey % 110))::int AS a FROM customer)
SELECT c_custkey, CASE WHEN a BETWEEN 2 AND 90 THEN a ELSE -1 END AS age,
  CASE WHEN a < 2 OR a > 90 THEN 'outlier' WHEN a <= 18 THEN '2-17' WHEN a <= 25 THEN '18-24' WHEN a <= 35 THEN '25-34'
       WHEN a <= 45 THEN '35-44' WHEN a <= 55 THEN '45-54' WHEN a <= 65 THEN '55-64' WHEN a <= 75 THEN '65-74'
       ELSE '75-92' END AS age_bin
FROM a""")
def age_bins(spark, sf_dir):
    parts = numbers.age_features(1930 + F.col("c_custkey") % 110)
    return table(spark, sf_dir, "customer").select("c_custkey", *[e.alias(n) for n, e in parts.items()])


@on_options("split_route", """
WITH p AS (SELECT option_id, string_split(search_route, '/') AS parts FROM options),
r AS (SELECT option_id, parts[1] AS o, parts[2] AS b FROM p)
SELECT option_id, o AS outbound_route, b AS return_route, o[1:3] AS outbound_origin, o[4:6] AS outbound_destination,
  b[1:3] AS return_origin, b[4:6] AS return_destination,
  CASE WHEN b IS NULL THEN -1 WHEN o = b[4:6] || b[1:3] THEN 1 ELSE 0 END AS is_exact_round_trip
FROM r""")
def split_route(df):
    return df.select("option_id", *[e.alias(n) for n, e in text.split_route("search_route").items()])


@on_options("composite_key", """
SELECT option_id, coalesce(carrier, 'missing') || '_' || coalesce(cabin::varchar, 'missing') AS key_missing,
  coalesce(carrier, 'NULL') || '_' || coalesce(cabin::varchar, 'NULL') AS key_null,
  carrier || '_' || cabin::varchar AS key_propagating
FROM options""")
def composite_key(df):
    key = ["carrier", "cabin"]
    return df.select("option_id", text.composite_key(key).alias("key_missing"),
                     text.composite_key(key, "NULL").alias("key_null"),
                     text.composite_key(key, None).alias("key_propagating"))


@on_options("log_transform", """
SELECT option_id, round(ln(1 + total_price), 6) AS total_price, round(ln(1 + taxes), 6) AS taxes,
  round(ln(1 + cabin), 6) AS cabin
FROM options""")
def log_transform(df):
    columns = ["total_price", "taxes", "cabin"]
    return rounded(df.withColumns(numbers.log_transform(columns)).select("option_id", *columns), *columns)


@on_options("winsorize", """
WITH p AS (SELECT option_id, total_price / (taxes + 1) AS x FROM options),
o AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n FROM p),
b AS (SELECT max(CASE WHEN i = floor(0.01 * (n - 1) + 0.5) THEN x END) AS lo,
             max(CASE WHEN i = floor(0.99 * (n - 1) + 0.5) THEN x END) AS hi FROM o)
SELECT option_id, round(least(greatest(x, lo), hi), 6) AS price_per_tax FROM p, b""")
def winsorize(df):
    out = df.select("option_id", (F.col("total_price") / (F.col("taxes") + 1)).alias("price_per_tax"))
    return rounded(tables.winsorize(out, "price_per_tax"), "price_per_tax")


@on_options("rank_interactions", """
WITH r AS (SELECT option_id,
    (total_price - min(total_price) OVER s) / (max(total_price) OVER s - min(total_price) OVER s + 0.000000001::double) AS a,
    (taxes - min(taxes) OVER s) / (max(taxes) OVER s - min(taxes) OVER s + 0.000000001::double) AS b
  FROM options WINDOW s AS (PARTITION BY session_id))
SELECT option_id, round(a * b, 6) AS rank_interaction_mul,
  round(greatest(0.01, least(100.0, (a + 0.000001::double) / (b + 0.000001::double))), 6) AS rank_interaction_ratio,
  round(a + b, 6) AS rank_interaction_sum, round(a - b, 6) AS rank_interaction_sub
FROM r""")
def rank_interactions(df):
    from choicerank.operators.session import group_minmax

    scaled = group_minmax(df, "session_id", {"total_price": "a", "taxes": "b"})
    parts = numbers.rank_interactions("a", "b")
    return rounded(scaled.select("option_id", *[e.alias(n) for n, e in parts.items()]), *parts)

"""The driver tables shaped as sessions (parts) and options (order lines)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from choicerank.operators.groups import ALL, ROWS, is_small, note, sized

# Runs unchanged in Spark and in DuckDB. The driver tables hold no nulls, so some are made here.
OPTIONS = """
SELECT
  l_partkey AS session_id,
  concat(cast(l_orderkey AS string), '-', cast(l_linenumber AS string), '-', cast(l_partkey AS string), '-',
         cast(l_suppkey AS string), '-', cast(cast(l_shipdate AS date) AS string)) AS option_id,
  o_custkey AS profile_id,
  c_mktsegment AS company_id,
  CASE WHEN l_linenumber = 6 THEN NULL ELSE concat('N', cast(s_nationkey AS string)) END AS carrier,
  concat('N', cast(c_nationkey AS string)) AS operating_carrier,
  CASE WHEN l_quantity > 45 THEN NULL ELSE 1 + l_linenumber % 4 END AS cabin,
  l_extendedprice AS total_price,
  l_extendedprice * l_tax AS taxes,
  concat(CASE WHEN l_linenumber = 7 THEN '1.' ELSE '' END,
         lpad(cast(cast(l_quantity AS int) % 24 AS string), 2, '0'), ':',
         lpad(cast(l_suppkey % 60 AS string), 2, '0'), ':00') AS duration0,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE
    concat(lpad(cast(l_orderkey % 20 AS string), 2, '0'), ':',
           lpad(cast(l_partkey % 60 AS string), 2, '0'), ':00') END AS duration1,
  concat(cast(cast(l_shipdate AS date) AS string), 'T', lpad(cast(l_orderkey % 24 AS string), 2, '0'), ':',
         lpad(cast(l_suppkey % 60 AS string), 2, '0'), ':00') AS departure_at,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE
    concat(cast(cast(o_orderdate AS date) AS string), 'T', lpad(cast(l_partkey % 24 AS string), 2, '0'),
           ':30:00') END AS return_at,
  o_orderdate AS request_ts,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL
       WHEN o_orderpriority = '1-URGENT' THEN concat('N', cast(s_nationkey AS string))
       ELSE concat('N', cast(s_nationkey AS string), '/N', cast(c_nationkey AS string)) END AS loyalty,
  CASE WHEN o_orderstatus = 'P' THEN cast(l_suppkey % 10 AS bigint) ELSE NULL END AS tariff_code,
  CASE WHEN o_orderstatus = 'O'
       THEN concat(lpad(cast(s_nationkey AS string), 3, 'N'), lpad(cast(c_nationkey AS string), 3, 'N'))
       ELSE concat(lpad(cast(s_nationkey AS string), 3, 'N'), lpad(cast(c_nationkey AS string), 3, 'N'), '/',
                   lpad(cast(c_nationkey AS string), 3, 'N'), lpad(cast(s_nationkey AS string), 3, 'N'))
       END AS search_route,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS selected,
  CASE WHEN o_orderdate < timestamp '1999-01-01 00:00:00' THEN 'train'
       WHEN o_orderdate < timestamp '2000-06-01 00:00:00' THEN 'val' ELSE 'test' END AS split
FROM {lineitem}
JOIN {orders} ON l_orderkey = o_orderkey
JOIN {customer} ON o_custkey = c_custkey
JOIN {supplier} ON l_suppkey = s_suppkey
"""

def _segment(leg: int, segment: int) -> str:
    """Columns of one segment. Leg 0 has one or two segments, leg 1 none without a return."""
    there = {(0, 0): "option_id IS NOT NULL", (0, 1): "cabin % 2 = 0", (1, 0): "return_at IS NOT NULL",
             (1, 1): "return_at IS NOT NULL AND tariff_code % 2 = 1"}.get((leg, segment), "1 = 0")
    home, away = ("carrier", "operating_carrier") if leg == 0 else ("operating_carrier", "carrier")
    values = {
        "aircraft_code": f"concat('A', cast(profile_id % {3 + leg + segment} AS string))",
        "arrivalTo_airport_city_iata": away, "arrivalTo_airport_iata": away,
        "departureFrom_airport_iata": home, "duration": f"duration{leg}",
        "flightNumber": f"cast((profile_id + {leg} + {segment}) % 9 AS string)",
        "marketingCarrier_code": home, "operatingCarrier_code": "operating_carrier",
        "baggageAllowance_quantity": "cast(cabin AS double)",
        "baggageAllowance_weightMeasurementType": "cast(tariff_code % 2 AS double)",
        "cabinClass": f"cast(cabin AS double) + {0 if leg == 0 else 1} * cast(profile_id % 2 AS double)",
        "seatsAvailable": "cast(profile_id % 10 AS double)",
    }
    return ",\n  ".join(f"CASE WHEN {there} THEN {v} END AS legs{leg}_segments{segment}_{n}" for n, v in values.items())


def _later(text: str, hours: int) -> str:
    return (f"concat(substr({text}, 1, 11), lpad(cast((cast(substr({text}, 12, 2) AS int) + {hours}) % 24 AS string), "
            f"2, '0'), substr({text}, 14))")


# The same options under the flight column names. Runs in both engines too.
FLIGHTS = f"""
SELECT
  option_id AS Id, cast(session_id AS string) AS ranker_id, profile_id AS profileId,
  cast(length(company_id) AS bigint) AS companyID, profile_id % 2 = 0 AS sex, profile_id % 7 AS nationality,
  true AS bySelf, profile_id % 5 = 0 AS isAccess3D, profile_id % 11 = 0 AS isVip, loyalty AS frequentFlyer,
  tariff_code AS corporateTariffCode, cast(cabin % 2 AS double) AS pricingInfo_isAccessTP,
  cast(1 AS double) AS pricingInfo_passengerCount, search_route AS searchRoute, request_ts AS requestDate,
  total_price AS totalPrice, taxes,
  CASE WHEN cabin = 1 THEN cast(0 AS double) WHEN cabin > 1 THEN taxes END AS miniRules0_monetaryAmount,
  cast(tariff_code % 2 AS double) AS miniRules0_statusInfos, cast(NULL AS double) AS miniRules0_percentage,
  CASE WHEN carrier IS NOT NULL THEN total_price / 10 END AS miniRules1_monetaryAmount,
  cast(cabin % 2 AS double) AS miniRules1_statusInfos, cast(NULL AS double) AS miniRules1_percentage,
  departure_at AS legs0_departureAt, {_later("departure_at", 5)} AS legs0_arrivalAt, duration0 AS legs0_duration,
  return_at AS legs1_departureAt, {_later("return_at", 9)} AS legs1_arrivalAt, duration1 AS legs1_duration,
  {(","+chr(10)+"  ").join(_segment(leg, segment) for leg in (0, 1) for segment in range(4))},
  cast(selected AS bigint) AS selected, split
FROM {{options}}
"""

AIRPORTS = """
SELECT concat('N', cast(n_nationkey AS string)) AS IATA, cast(n_nationkey % 24 - 12 AS double) AS UTC_Offset_Hours,
  r_name AS Country_CodeA2
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
"""

TABLES = ("lineitem", "orders", "customer", "supplier")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The same rows for Spark: order lines, the largest table, are joined once with orders that have their customer already.
JOINED = OPTIONS[:OPTIONS.index("FROM {lineitem}")] + """FROM {lineitem}
JOIN {ordered} ON l_orderkey = o_orderkey
JOIN {supplier} ON l_suppkey = s_suppkey
"""


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of all sessions. Orders and customers are broadcast only where they measure small.

    The largest session is noted as the order lines of a part, counted before the joins: orders, customers and suppliers have
    one row a key. Where they have more, the note is too low, which changes no result.
    """
    lineitem, orders, customer, supplier = (table(spark, sf_dir, t) for t in TABLES)
    orders = orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    customer = customer.select("c_custkey", "c_mktsegment", "c_nationkey")
    few = is_small(orders)
    ordered = orders.join(sized(customer), F.col("o_custkey") == F.col("c_custkey"))
    out = spark.sql(JOINED, lineitem=lineitem, ordered=F.broadcast(ordered) if few else ordered.hint("merge"), supplier=supplier)
    largest, rows = lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    return note(note(out, ["session_id"], ROWS, largest or 0), ["session_id"], ALL, rows or 0)


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options under the flight column names."""
    return spark.sql(FLIGHTS, options=options(spark, sf_dir))


def airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as airports, regions as their countries."""
    return spark.sql(AIRPORTS, nation=table(spark, sf_dir, "nation"), region=table(spark, sf_dir, "region"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the first options of each session, made from the parts."""
    rows = F.explode(F.sequence(F.lit(1).cast("bigint"), 1 + F.col("p_partkey") % 20))
    return (table(spark, sf_dir, "part").select("p_partkey", "p_type", rows.alias("row_id"))
            .select(F.col("p_partkey").cast("string").alias("ranker_id"), "row_id", F.col("p_type").alias("category"),
                    F.filter(F.array("p_type"), lambda x: F.col("row_id") % 3 != 0).alias("labels")))


def with_options(sql: str) -> str:
    """DuckDB text of a query that reads ``options``; it may go on with further CTEs."""
    body = OPTIONS.format(**{t: t for t in TABLES})
    tail = sql.strip()
    if tail[:5].lower() == "with ":
        return f"WITH options AS ({body}), {tail[5:]}"
    return f"WITH options AS ({body}) {tail}"

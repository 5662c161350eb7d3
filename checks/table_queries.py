"""Sources, sinks, table operators, encoding (SURVEY A, F)."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks.fixture import options, table
from checks.registry import nullable, on_options, query
from choicerank.operators import encode, tables
from choicerank.plans.catalogue import FeatureFamily
from choicerank.settings import shared_folder
from choicerank.sources import tables as sources
from choicerank.sources.schemas import SESSION_DOCUMENT

S, ROW = "session_id", "option_id"


@query("scan_options", plain_sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem WHERE l_extendedprice > 90000""")
def scan_options(spark, sf_dir):
    source = sources.read_options(spark, f"{sf_dir}/lineitem.parquet",
                                  "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_extendedprice double, "
                                  "__index_level_0__ bigint")
    return source.where("l_extendedprice > 90000")


@query("json_explode", plain_sql="""
WITH p AS (SELECT o_orderkey, i, o_totalprice + i AS price, o_orderpriority AS category
  FROM orders, range(3) AS r(i) WHERE i < o_orderkey % 4)
SELECT o_orderkey, (CASE WHEN i = 1 THEN 1 ELSE i + 1 END)::bigint AS row_id,
  CASE WHEN i = 2 THEN 0 ELSE round(price, 2) END AS totalPrice, category,
  CASE WHEN i = 0 THEN 0 ELSE 2 END::int AS n_labels FROM p""")
def json_explode(spark, sf_dir):
    """One session document per order, written as JSON and read back. Some fields are left out."""
    offers = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: i < F.col("o_orderkey") % 4),
        lambda i: F.struct(
            F.when(i != 1, i).alias("ordinal"),
            F.when(i != 2, F.round(F.col("o_totalprice") + i, 2)).alias("totalPrice"),
            F.col("o_orderpriority").alias("category"),
            F.when(i > 0, F.array(F.lit("BestPrice"), F.lit("MinTime"))).alias("labels")))
    flights = F.array(F.struct(offers.alias("pricings")))
    document = F.to_json(F.struct(F.struct(flights.alias("$values")).alias("data")))
    documents = (table(spark, sf_dir, "orders").select("o_orderkey", document.alias("json"))
                 .select("o_orderkey", F.from_json("json", SESSION_DOCUMENT).alias("d"))
                 .select("o_orderkey", "d.data"))
    out = sources.explode_pricings(documents, "o_orderkey")
    return out.withColumn("n_labels", F.size("labels")).drop("labels")


@query("extract_labels", plain_sql="""
WITH o AS (SELECT o_custkey % 64 AS doc, o_orderkey, o_totalprice, o_orderpriority FROM orders)
SELECT doc::varchar AS ranker_id, (o_orderkey % 5 + 1)::double AS row_id, round(o_totalprice, 2) AS "totalPrice",
  o_orderpriority AS category, (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END)::int AS n_labels, false AS broken
FROM o WHERE doc % 5 <> 4
UNION ALL SELECT DISTINCT doc::varchar, NULL::double, NULL::double, NULL, 0::int, true FROM o WHERE doc % 5 = 4""")
def extract_labels(spark, sf_dir):
    """Orders as 64 JSON documents in files of their own, every fifth broken off; read back, written and read as labels."""
    folder = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    doc = F.col("o_custkey") % 64
    offers = F.struct((F.col("o_orderkey") % 5).alias("ordinal"), F.round("o_totalprice", 2).alias("totalPrice"),
                      F.col("o_orderpriority").alias("category"),
                      F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("BestPrice"))).alias("labels"))
    pricings = table(spark, sf_dir, "orders").groupBy(doc.alias("doc")).agg(F.collect_list(offers).alias("pricings"))
    flights = F.array(F.struct("pricings"))
    text = F.to_json(F.struct(F.struct(flights.alias("$values")).alias("data")))
    cut = F.when(F.col("doc") % 5 == 4, F.left(text, F.length(text) - 3)).otherwise(text)
    pricings.select("doc", cut.alias("value")).write.partitionBy("doc").text(folder)
    good, bad = sources.extract_labels(spark, folder, glob="*.txt", key=r"/doc=([0-9]+)/")
    sources.write_result(good, f"{folder}-labels")
    labels = sources.read_labels(spark, f"{folder}-labels")
    out = labels.select("ranker_id", F.col("row_id").cast("bigint").alias("row_id"), "totalPrice", "category",
                        F.size("labels").alias("n_labels"), F.lit(False).alias("broken"))
    none = bad.select("ranker_id", F.lit(None).cast("bigint"), F.lit(None).cast("double"), F.lit(None).cast("string"),
                      F.lit(0), F.lit(True))
    return nullable(out.union(none), "row_id", "totalPrice")


@query("read_airports", plain_sql="""
SELECT 'N' || n_nationkey AS "IATA", CASE WHEN n_nationkey % 6 <> 0 THEN (n_nationkey % 24 - 12)::double END AS "UTC_Offset_Hours",
  r_name AS "Country_CodeA2" FROM nation JOIN region ON n_regionkey = r_regionkey""")
def read_airports(spark, sf_dir):
    """Nations as an airport file with its columns in another order, one more, and offsets that are no numbers."""
    path = f"{shared_folder(spark)}/airports-{uuid.uuid4().hex}"
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    offset = F.when(F.col("n_nationkey") % 6 == 0, F.lit("none")).otherwise((F.col("n_nationkey") % 24 - 12).cast("string"))
    places.select(F.col("r_name").alias("Country_CodeA2"), F.lit(1).alias("GeoPointLat"), offset.alias("UTC_Offset_Hours"),
                  F.concat(F.lit("N"), "n_nationkey").alias("IATA")).write.csv(path, header=True)
    return sources.read_airports(spark, path).select("IATA", "UTC_Offset_Hours", "Country_CodeA2")


@query("read_summary", plain_sql="SELECT p_partkey AS session_id, p_size::bigint AS p_size, p_brand FROM part")
def read_summary(spark, sf_dir):
    path = f"{shared_folder(spark)}/summary-{uuid.uuid4().hex}"
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias(S), F.col("p_size").cast("bigint").alias("p_size"),
                                                "p_brand")
    sources.write_result(parts, path)
    return sources.read_summary(spark, path)


@query("json_props", plain_sql="""
SELECT event_id, json_extract_string(props, '$.k')::bigint AS k FROM events""")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("write_roundtrip", """
SELECT option_id, session_id, selected, split FROM options""")
def write_roundtrip(spark, sf_dir):
    path = f"{shared_folder(spark)}/options-{uuid.uuid4().hex}"
    rows = options(spark, sf_dir).select(ROW, S, "selected", "split")
    sources.write_result(rows, path, "split")
    return spark.read.parquet(path)


@on_options("time_split", """
WITH o AS (SELECT *, row_number() OVER (ORDER BY request_ts) - 1 AS i, count(*) OVER () AS n FROM options),
c AS (SELECT max(CASE WHEN i = floor(0.7 * (n - 1) + 0.5) THEN request_ts END) AS a,
  max(CASE WHEN i = floor(0.9 * (n - 1) + 0.5) THEN request_ts END) AS b FROM o)
SELECT option_id, CASE WHEN request_ts < a THEN 'train' WHEN request_ts < b THEN 'val' ELSE 'test' END AS part
FROM options, c""")
def time_split(df):
    return tables.with_split(df, "request_ts", {"train": 0.7, "val": 0.9}, "test", "part").select(ROW, "part")


@on_options("split_frames", """
SELECT split AS frame, count(*) AS n, sum(selected)::bigint AS chosen, round(avg(total_price), 4) AS mean_price
FROM options GROUP BY split
UNION ALL SELECT 'full', count(*), sum(selected)::bigint, round(avg(total_price), 4) FROM options WHERE split <> 'test'""")
def split_frames(df):
    frames = tables.split_frames(df, ["total_price"], "selected", S)
    stats = [frame.agg(F.lit(name).alias("frame"), F.count(F.lit(1)).alias("n"), F.sum("selected").alias("chosen"),
                       F.round(F.avg("total_price"), 4).alias("mean_price")) for name, frame in frames.items()]
    return stats[0].unionByName(stats[1]).unionByName(stats[2]).unionByName(stats[3])


@on_options("union_train_test", """
SELECT option_id, CASE WHEN split = 'test' THEN 0 ELSE selected END::bigint AS selected FROM options""")
def union_train_test(df):
    rows = df.select(ROW, F.col("selected").cast("bigint").alias("selected"), "split")
    train, test = rows.where("split <> 'test'"), rows.where("split = 'test'").drop("selected")
    return tables.append_test(train, test, "selected").drop("split")


@on_options("sample_sessions", """
SELECT option_id, session_id FROM options
WHERE ('0x' || substr(md5('42|' || session_id::varchar), 1, 8))::bigint < floor(0.25 * 4294967296)""")
def sample_sessions(df):
    return tables.sample_groups(df, S, 0.25).select(ROW, S)


@query("prune_columns", plain_sql="SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def prune_columns(spark, sf_dir):
    return tables.prune_columns(table(spark, sf_dir, "lineitem"),
                                ["l_part*", "l_supp*", "l_*date", "l_linestatus", "l_[qedt]*"])


@on_options("distinct_groups", "SELECT DISTINCT session_id, company_id FROM options")
def distinct_groups(df):
    return tables.distinct_values(df, [S, "company_id"])


@on_options("fill_nulls", """
SELECT option_id, coalesce(cabin, 0) AS cabin, coalesce(tariff_code, 0) AS tariff_code,
  coalesce(carrier, 'missing') AS carrier, coalesce(loyalty, 'missing') AS loyalty, (cabin = 1)::int::double AS is_economy FROM options""")
def fill_nulls(df):
    out = tables.fill_all_nulls(df.select(ROW, "cabin", "tariff_code", "carrier", "loyalty",
                                          (F.col("cabin") == 1).alias("is_economy")))
    return nullable(out.withColumn("is_economy", F.col("is_economy").cast("int")), "is_economy")


FAMILY = [FeatureFamily("price", ["total_price", "taxes", "absent"], ["carrier", "cabin"], ["taxes"]),
          FeatureFamily("off", ["tariff_code"], active=False),
          FeatureFamily("trip", ["profile_id"], ["search_route"])]


@on_options("select_features", """
SELECT option_id, carrier, cabin::double AS cabin, search_route, total_price, profile_id, selected, session_id FROM options""")
def select_features(df):
    out, _, _ = encode.select_features(df, FAMILY, "selected", S, keep=[ROW])
    return nullable(out, "cabin")


@on_options("dense_encode", """
WITH c AS (SELECT carrier, dense_rank() OVER (ORDER BY carrier) - 1 AS code FROM options WHERE carrier IS NOT NULL GROUP BY 1),
p AS (SELECT profile_id, dense_rank() OVER (ORDER BY profile_id) - 1 AS code FROM options GROUP BY 1),
t AS (SELECT tariff_code, dense_rank() OVER (ORDER BY tariff_code) - 1 AS code FROM options
  WHERE tariff_code IS NOT NULL GROUP BY 1),
r AS (SELECT search_route, dense_rank() OVER (ORDER BY search_route) - 1 AS code FROM options GROUP BY 1)
SELECT option_id, coalesce(c.code, -1)::int AS carrier, coalesce(p.code, -1)::int AS profile_id,
  coalesce(t.code, -1)::int AS tariff_code, coalesce(r.code, -1)::int AS search_route
FROM options LEFT JOIN c USING (carrier) LEFT JOIN p USING (profile_id) LEFT JOIN t USING (tariff_code)
LEFT JOIN r USING (search_route)""")
def dense_encode(df):
    columns = ["carrier", "profile_id", "tariff_code", "search_route"]
    return encode.dense_encode(df.select(ROW, *columns), columns)


@on_options("group_sizes", """
SELECT session_id, count(*) AS len, min(option_id) AS first_row FROM options GROUP BY session_id""")
def group_sizes(df):
    return encode.group_sizes(df, S, ROW)


@on_options("assemble", """
SELECT option_id, session_id, selected, total_price AS f0, taxes AS f1, coalesce(cabin, -1)::double AS f2 FROM options""")
def assemble(df):
    out = encode.assemble(df, ["total_price", "taxes", "cabin"], "selected", S, keep=[ROW])
    parts = vector_to_array("features")
    return out.select(ROW, S, "selected", parts[0].alias("f0"), parts[1].alias("f1"),
                      F.nanvl(parts[2], F.lit(-1.0)).alias("f2"))

"""Readers of options, airports, labels and summaries, and the Parquet writer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from choicerank.settings import checkpointed
from choicerank.sources.schemas import AIRPORTS, SESSION_DOCUMENT

HELPER_COLUMNS = ("__index_level_0__",)


def read_options(spark: SparkSession, path: str | Sequence[str],
                 schema: T.StructType | None = None) -> DataFrame:
    """Parquet options without the index column some writers add; a schema skips inference."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    paths = [path] if isinstance(path, str) else list(path)
    return reader.parquet(*paths).drop(*HELPER_COLUMNS)


def read_airports(spark: SparkSession, path: str) -> DataFrame:
    """Code, UTC offset and country of each airport from a CSV with a header, columns by name."""
    columns = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in AIRPORTS.fields]
    return spark.read.csv(path, header=True).select(*columns)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """The label table that ``extract_labels`` and ``write_result`` produce."""
    return spark.read.parquet(path)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """One row of attributes per session."""
    return spark.read.parquet(path)


def explode_pricings(documents: DataFrame, session: str) -> DataFrame:
    """One row per pricing of a session document.

    A pricing without an ordinal is row 1, one without a price costs 0, one without labels has an
    empty list. A document without pricings has no rows.
    """
    offer = F.col("offer")
    return (documents.select(session, F.explode(F.col("data").getField("$values")).alias("flight"))
            .select(session, F.explode("flight.pricings").alias("offer"))
            .select(session,
                    (F.coalesce(offer["ordinal"], F.lit(0)) + 1).alias("row_id"),
                    F.coalesce(offer["totalPrice"], F.lit(0.0)).alias("totalPrice"),
                    offer["category"].alias("category"),
                    F.coalesce(offer["labels"], F.array().cast("array<string>")).alias("labels")))


def extract_labels(spark: SparkSession, path: str, session: str = "ranker_id", glob: str = "*.json",
                   key: str = r"([^/]+)\.json$") -> tuple[DataFrame, DataFrame]:
    """Labels of a folder with one JSON file per session, and the files that could not be read.

    The session key is the first group of ``key`` in the file's path, by default its name without the ending. A broken file
    gives no rows and does not stop the job. Files are read and parsed once: labels and broken files come from one stored table.
    """
    broken = "_corrupt_record"
    schema = T.StructType([*SESSION_DOCUMENT.fields, T.StructField(broken, T.StringType())])
    files = checkpointed(
        spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
        .select(F.regexp_extract("_metadata.file_path", key, 1).alias(session),
                F.from_json("value", schema, {"columnNameOfCorruptRecord": broken}).alias("document"))
        .select(session, "document.data", F.col("document").getField(broken).alias(broken)))
    good = files.where(F.col(broken).isNull())
    bad = files.where(F.col(broken).isNotNull()).select(session, broken)
    return explode_pricings(good, session), bad


def write_result(df: DataFrame, path: str, partition_by: str | Sequence[str] = (),
                 mode: str = "overwrite") -> None:
    """Write Parquet, split into folders by the given columns."""
    writer = df.write.mode(mode)
    columns = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    (writer.partitionBy(*columns) if columns else writer).parquet(path)

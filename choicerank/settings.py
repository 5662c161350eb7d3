"""Size limits and the checkpoint folder, all read from the Spark session.

Set them with ``spark.conf.set`` or ``--conf``:

``spark.choicerank.hotRows``        a group above this many rows is never sorted in one task
``spark.choicerank.parts``          ranges that rows with hot groups are dealt to, at least
``spark.choicerank.broadcastRows``  a lookup table above this many rows is not broadcast
``spark.choicerank.broadcastBytes``  nor one above this many bytes
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "hotRows": 1_000_000,
    "parts": 128,
    "broadcastRows": 200_000,
    "broadcastBytes": 64 * 1024 * 1024,
}


# Spark SQL settings the wide feature job wants: whole-stage code for rows of several hundred columns, but none in methods
# above 8,000 bytes, which the JVM does not compile; joins that use rows dealt by some of their keys as they lie; and
# joins with a hot key split at run time even where that costs another shuffle.
RECOMMENDED = {
    "spark.sql.codegen.maxFields": "2000",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tuned(spark: SparkSession) -> SparkSession:
    """Apply the recommended settings to the session."""
    for name, value in RECOMMENDED.items():
        spark.conf.set(name, value)
    return spark


@contextmanager
def long_methods(spark: SparkSession) -> Iterator[None]:
    """Generated methods of any length for what runs inside: chains of many joins over rows of hundreds of columns, where
    copying each row from join to join costs more than methods that are not compiled."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "65535")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def setting(spark: SparkSession, name: str) -> int:
    return int(spark.conf.get(f"spark.choicerank.{name}", str(DEFAULTS[name])))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set, one in the session's warehouse, which is shared too."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", f"{warehouse}/checkpoints"))
    return context.getCheckpointDir()


_TABLES: list[str] = []


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back: lineage ends at files that outlive
    executors, and later readers get column pruning and filters. ``release_tables`` removes what was written."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_tables(spark: SparkSession) -> None:
    """Remove the intermediate tables of this process. Call it when no frame that reads them is needed any more."""
    hadoop = spark._jsc.hadoopConfiguration()
    while _TABLES:
        path = spark._jvm.org.apache.hadoop.fs.Path(_TABLES.pop())
        path.getFileSystem(hadoop).delete(path, True)

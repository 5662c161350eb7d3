"""What the operators share: intermediate tables, text columns, and Arrow batches cut by size."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space by the Unicode property, as the tokenizers' patterns understand it.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: Characters of text that a task holds as Python objects at one time.
SLICE_CHARS = 4_000_000


#: Words (or the like) that a Python worker remembers at most; the bound costs time, never results.
KEEP = 250_000

#: Spark's setting that removes an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_HELD: dict = {}


def held(operator: str) -> dict:
    """What a Python worker, which outlives tasks, remembers for an operator. Another operator's memory goes first."""
    if _HELD.get("operator") != operator:
        _HELD.clear()
        _HELD["operator"] = operator
    return _HELD


class Work:
    """A folder of intermediate Parquet tables, which all executors share.

    It lies in ``spark.checkpoint.dir``; only where that is unset (tests), in the session's warehouse.
    Tables that later results still read stay; ``release`` removes the others.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = (spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
                or spark.conf.get("spark.sql.warehouse.dir"))
        self.folder = f"{root.rstrip('/')}/work-{uuid.uuid4().hex}"

    def store(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Write ``df`` and read it back: lineage ends at files that outlive executors.

        What was shuffled for it goes as soon as it is written; else all stages' shuffle files would lie on disk together
        until the driver's next garbage collection.
        """
        path = f"{self.folder}/{name}"
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.partitionBy(*partition_by).parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text alone; a missing text is empty."""
    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` characters; a longer row is a run of its own."""
    sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield batch.slice(begin)


def map_texts(df: DataFrame, make: Callable[[], Callable[[list[str]], dict[str, list]]], schema: str,
              key: str = "doc_id", column: str = "text") -> DataFrame:
    """Apply a function of a list of texts to whole texts, slice by slice.

    ``make`` is called once a task and gives the function; its result holds the columns of ``schema`` other
    than the key. ``df`` has the two columns ``key`` and ``column``.
    """
    full = f"{key} {dict(df.dtypes)[key]}, {schema}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        types = None
        for batch in batches:
            for part in slices(batch, column):
                found = apply(part.column(column).to_pylist())
                if types is None:
                    types = _arrow_types(schema)
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), *(pa.array(found[n], t) for n, t in types.items())], [key, *types])

    return df.select(key, column).mapInArrow(run, full)


def _arrow_types(schema: str) -> dict[str, pa.DataType]:
    known = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
             "binary": pa.binary(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
    return {n: known[t] for n, t in (field.split() for field in schema.split(", "))}


def on_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this library from where the driver has it, if they start with another path.

    On a cluster without a common file system the library is shipped with ``--py-files`` instead.
    """
    import os

    import choicerank

    folder = os.path.dirname(os.path.dirname(os.path.abspath(choicerank.__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if folder not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (folder, known) if p)
    return spark

"""Connected components by alternating large and small stars.

Each round points every node's larger neighbours at the smallest node it knows, then every node and its smaller
neighbours at the smallest of these. Rounds end when the links form stars, after about log(n) of them. A round is a
minimum by node (pre-aggregated before the shuffle) joined back to the links, never a list of a node's neighbours, and is
written to the shared folder. A node with a large share of the links is split in that join at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicerank.llm.common import Work


def components(links: DataFrame, work: Work, name: str, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` (its smallest node) of every node that has a link to another one.

    Links with a null or to the node itself say nothing; repeated links and both directions are fine.
    """
    x, y = F.col(a), F.col(b)
    edges = links.filter(x != y).select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).distinct()
    edges = work.store(edges, f"{name}-0")
    state, step = _state(edges), 0
    while True:
        both = edges.union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        large = (_with_least(both).withColumn("m", F.least("hi", "m")).filter("lo > hi and lo != m")
                 .select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct())
        small = (_with_least(large).select(F.explode(F.array(
            F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))))
            .select("col.*").filter("hi != lo").distinct())
        step += 1
        edges = work.store(small, f"{name}-{step}")
        work.release(f"{name}-{step - 1}")
        before, state = state, _state(edges)
        if state == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def _with_least(links: DataFrame) -> DataFrame:
    """With ``m``, the smallest ``lo`` of the same ``hi``.

    Compared null-safely, the keys of the minima are not those they were grouped by, so both sides are shuffled for the
    join and adaptive execution can split a hot node's links over tasks.
    """
    least = links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m"))
    return links.join(least, links["hi"].eqNullSafe(least["node"])).drop("node")


def _state(edges: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")),
                           F.sum(F.xxhash64("lo").cast("decimal(38,0)"))).first())

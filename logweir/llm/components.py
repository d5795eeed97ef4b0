"""Connected components by alternating star contraction.

Every round is a grouped minimum followed by an equi-join of two written
tables, so the optimiser can split a hot node's edges over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import materialize


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _minima(edges: DataFrame, name: str) -> DataFrame:
    return materialize(edges.groupBy("u").agg(F.min("v").alias("mv")).select("u", F.least("u", "mv").alias("m")), name)


def _large_star(edges: DataFrame) -> DataFrame:
    both = materialize(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "cc-both")
    found = both.join(_minima(both, "cc-large"), "u").where(F.col("v") > F.col("u"))
    return materialize(found.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-ls")


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from the larger to the smaller node here."""
    mins = _minima(edges, "cc-small")
    found = edges.join(mins, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return materialize(found.union(mins.select("u", F.col("m").alias("v"))).distinct(), "cc-ss")


def connected_components(edges: DataFrame) -> DataFrame:
    """Map every node of ``edges(u, v)`` to its component's smallest node.

    Returns ``(node, root)`` for each node that has a link to another node;
    roots map to themselves.  Loops and repeated edges are harmless, rows with
    a null end are ignored, an empty input gives an empty result.  Nodes may be
    of any orderable type.  The driver sees only a count and a checksum a round.
    """
    start = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current = materialize(start.distinct(), "cc-edges")
    before = _signature(current)
    while before[0]:
        current = _small_star(_large_star(current))
        now = _signature(current)
        if now == before:
            break
        before = now
    members = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.union(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

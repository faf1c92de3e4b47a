"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.storage import drop_tables, materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each node's larger (or its smaller) neighbours, and itself, on its smallest neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("low"))
    least = least.select(F.col("a").alias("of"), F.least("a", "low").alias("low"))
    joined = both.join(least, F.col("a") == F.col("of"))
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    return joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select(F.col("of").alias("a"), F.col("low").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node long, root long) for every node of ``edges`` (a long, b long): the smallest node it is connected with.

    Large-star and small-star steps alternate until nothing changes; each round's edges are written to the shared
    folder, so a lost executor costs one round at most. Direction, repeats, self-links and nulls in edges don't
    matter; no edges give no rows.
    """
    clean = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct()
    now, before = materialize(clean, "edges"), None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            own = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            found = materialize(now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(own), "components")
            drop_tables(now)
            return found
        before, last = mark, now
        now = materialize(_stars(_stars(last, large=True), large=False), "edges")
        drop_tables(last)

"""Connected components by alternating star contraction, in joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitgauge.llm.common import stored
from commitgauge.operators.joins import hot_join


def _star(edges: DataFrame, both_ways: bool, total: int) -> DataFrame:
    """Hang the neighbours of every node on the smallest one. both_ways: larger neighbours only ("large star")."""
    if both_ways:
        seen = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hub = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        hung = hot_join(seen, hub, "a", ["b"], hub, 2 * total).filter("b > a").select(F.col("b").alias("x"), "m")
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        hub = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        hung = hot_join(down, hub, "a", ["b"], hub, total).select(F.col("b").alias("x"), "m")
        hung = hung.union(hub.select(F.col("a").alias("x"), "m"))
    return hung.filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Rows (node, component) of every node of the edges (a, b): the smallest node reachable.

    Each turn is two star contractions, written to the shared folder; turns grow with the logarithm of the longest
    path; each writes as many files as its rows ask for. The edges of hot nodes are cut into slices. No edges give no rows. Loops (a, a) are ignored.
    """
    now = stored(edges.filter("a <> b").select("a", "b").distinct(), label, edges.count())
    state = None
    while True:
        total = now.count()
        wide = stored(_star(now, True, total), label, 2 * total)
        total = wide.count()
        now = stored(_star(wide, False, total), label, 2 * total)
        seen = now.agg(F.count("*"), F.sum("b"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )

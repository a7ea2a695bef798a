"""Connected components by alternating stars, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import Scratch


def _stars(scratch: Scratch, edges: DataFrame, large: bool, name: str) -> DataFrame:
    """Link the neighbours of every node to the smallest of them: its larger ones (large) or smaller ones (small).

    A hub is never gathered: the minimum is a partially aggregated groupBy, written as a table of its own so that both sides of the
    join back are plain shuffles, of which AQE splits a skewed one, or that it broadcasts if it is small.
    """
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    least = scratch.write(edges.groupBy("u").agg(F.min("v").alias("m")), name)
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(scratch: Scratch, edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node of its component.

    ``edges``: columns u and v of one integral type; either order, repeats and loops allowed. Each round is written to the
    shared folder, so a lost executor costs at most one round. Raises if ``rounds`` don't suffice (they grow with the
    square of the logarithm of the nodes at worst).
    """
    state = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state = scratch.write(state, f"{name}-0")
    mark = F.struct(F.count("*"), F.sum(F.hash("u", "v").cast("long")))
    before = state.agg(mark).first()[0]
    for i in range(1, rounds):
        if not before[0]:
            break
        wide = scratch.write(_stars(scratch, state, True, f"{name}-{i}-least"), f"{name}-{i}-wide")
        state = scratch.write(_stars(scratch, wide, False, f"{name}-{i}-own"), f"{name}-{i}")
        now = state.agg(mark).first()[0]
        scratch.drop(*(f"{name}-{x}" for x in (i - 1, f"{i}-least", f"{i}-wide", f"{i}-own")))
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

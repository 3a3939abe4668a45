"""Weighted composites: look-through exposure, blends and drifting weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import scratch


def children(edges: DataFrame, parent: str, at) -> DataFrame:
    """Direct holdings of a parent at a date: (child, weight)."""
    return edges.where((F.col("parent") == parent) & (F.col("as_of") == at)).select("child", "weight")


def look_through(edges: DataFrame, depth: int = 8) -> DataFrame:
    """(root, leaf, exposure): the sum over all paths of the product of weights. Paths longer than `depth` edges raise, which also stops cycles."""
    edges = edges.select("parent", "child", F.col("weight").cast("double").alias("weight"))
    inner = edges.select(F.col("parent").alias("node")).distinct()
    now = edges.select(F.col("parent").alias("root"), F.col("child").alias("node"), F.col("weight").alias("exposure"))
    done = None
    for _ in range(depth):
        now = scratch.materialise(now, "paths")  # each level is read twice, for its leaves and for the next one
        leaves = now.join(inner, "node", "left_anti")
        done = leaves if done is None else done.unionByName(leaves)
        further = now.join(inner, "node", "left_semi")
        if further.isEmpty():
            break
        now = further.join(edges, further["node"] == edges["parent"]).groupBy("root", "child").agg(F.sum(F.col("exposure") * F.col("weight")).alias("exposure")).withColumnRenamed("child", "node")
    else:
        raise ValueError(f"paths of over {depth} edges, or a cycle")
    return done.groupBy("root", F.col("node").alias("leaf")).agg(F.sum("exposure").alias("exposure"))


def blend(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Returns of a portfolio with constant weights (series_id, weight)."""
    joined = rows.join(weights, "series_id")
    return joined.groupBy("ym", "period_end").agg(F.sum(F.col("weight") * F.col("r")).alias("r"))


def drifted_weights(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Weights at the end of each month when nothing is traded: the initial weight times the growth, scaled to 1 per month."""
    w = Window.partitionBy("series_id").orderBy("ym").rowsBetween(Window.unboundedPreceding, 0)
    grown = rows.join(weights, "series_id").withColumn("g", F.col("weight") * F.product(1 + F.col("r")).over(w))
    return grown.withColumn("drifted", F.col("g") / F.sum("g").over(Window.partitionBy("ym"))).select("series_id", "ym", "period_end", "drifted")


def plan_gap(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Monthly difference between the two series of each pair (left_id, right_id)."""
    left = rows.select(F.col("series_id").alias("left_id"), "ym", "period_end", F.col("r").alias("left_r"))
    right = rows.select(F.col("series_id").alias("right_id"), "ym", F.col("r").alias("right_r"))
    return pairs.join(left, "left_id").join(right, ["right_id", "ym"]).select("left_id", "right_id", "period_end", (F.col("left_r") - F.col("right_r")).alias("gap"))

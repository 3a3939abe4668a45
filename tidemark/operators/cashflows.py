"""Held values with cash flows, and weights that are disclosed, residual or set on a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import panel

STEPS = 100
LOWEST, HIGHEST = -0.9999, 1e4


def money_weighted(flows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The yearly rate at which the dated flows (keys, date, amount; the last one holds the final value) are worth nothing at the first
    date: the root of the sum of amount / (1 + rate) ** (days / 365), by bisection. Null where the flows do not change sign
    between the lowest and the highest rate. A key's flows are one row's array, so they must be those of one holding."""
    keys = keys or ["series_id"]
    days = flows.groupBy(*keys, "date").agg(F.sum(F.col("amount").cast("double")).alias("amount"))
    held = days.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date", "amount"))).alias("f"))
    first = F.get("f", F.lit(0))["date"]
    held = held.withColumn("f", F.transform("f", lambda x: F.struct((F.datediff(x["date"], first) / F.lit(365.0)).alias("t"), x["amount"].alias("a"))))

    def worth(rate: Column) -> Column:
        return F.aggregate("f", F.lit(0.0), lambda acc, x: acc + x["a"] / F.pow(1 + rate, x["t"]))

    start = F.struct(F.lit(LOWEST).alias("lo"), F.lit(HIGHEST).alias("hi"))

    def halved(acc: Column) -> Column:
        middle = (acc["lo"] + acc["hi"]) / 2
        below = F.signum(worth(middle)) == F.signum(worth(F.lit(LOWEST)))
        return F.struct(F.when(below, middle).otherwise(acc["lo"]).alias("lo"), F.when(below, acc["hi"]).otherwise(middle).alias("hi"))

    rate = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, lambda acc, _: halved(acc))
    crosses = F.signum(worth(F.lit(LOWEST))) * F.signum(worth(F.lit(HIGHEST))) < 0
    return held.select(*keys, F.when(crosses, (rate["lo"] + rate["hi"]) / 2).alias("rate"))


def disclosed_weights(edges: DataFrame, dates: DataFrame) -> DataFrame:
    """(parent, child, date, weight): the weights of the last disclosure on or before each date. A disclosure lists all children of its
    parent, so that one that is no longer listed is gone."""
    told = edges.select("parent", "as_of").distinct()
    named = told.select(F.col("parent").alias("series_id"), F.col("as_of").alias("date"), F.lit(0).cast(panel.LEVEL).alias("level"))
    anchors = edges.select(F.col("parent").alias("series_id")).distinct().join(F.broadcast(dates.select(F.col("date").alias("anchor")).distinct()))  # a grid of dates
    found = panel.as_of(named, anchors).select(F.col("series_id").alias("parent"), F.col("anchor").alias("date"), F.col("level_date").alias("as_of"))
    return found.join(edges, ["parent", "as_of"]).select("parent", "child", "date", "weight")


def weight_at(edges: DataFrame, child: str, date: Column) -> DataFrame:
    """(parent, weight) of one child by the last disclosures on or before a date; 0 where they do not list it."""
    listed = disclosed_weights(edges, edges.sparkSession.range(1).select(date.alias("date")))
    return listed.groupBy("parent").agg(F.coalesce(F.sum(F.when(F.col("child") == child, F.col("weight"))), F.lit(0)).cast("double").alias("weight"))


def with_cash(edges: DataFrame, name: str = "cash") -> DataFrame:
    """The edges, and what the weights of a disclosure leave of 1 as an edge to a residual node."""
    rest = edges.groupBy("parent", "as_of").agg((F.lit(1.0) - F.sum(F.col("weight").cast("double"))).alias("weight")).where(F.abs("weight") > 1e-12)
    return edges.select("parent", "as_of", "child", F.col("weight").cast("double").alias("weight")).unionByName(rest.withColumn("child", F.lit(name)))


def node_kinds(edges: DataFrame, cash: str = "cash") -> DataFrame:
    """(node, kind): portfolio for what holds something, cash for the residual, stock for the other leaves."""
    nodes = edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct()
    parents = edges.select(F.col("parent").alias("node")).distinct().withColumn("holds", F.lit(True))
    kind = F.when(F.col("holds"), "portfolio").when(F.col("node") == cash, "cash").otherwise("stock")
    return nodes.join(parents, "node", "left").select("node", kind.alias("kind"))


def weight_curves(levels: DataFrame, units: DataFrame, grid: DataFrame) -> DataFrame:
    """(series_id, date, weight): the share of each holding (series_id, units) in the whole at the dates of a grid, at the last level on or
    before them; holdings without one count for nothing."""
    anchors = units.select("series_id", "units").join(F.broadcast(grid.select(F.col("date").alias("anchor")).distinct()))  # a grid of dates
    valued = panel.as_of(levels, anchors).withColumn("value", F.coalesce(F.col("level").cast("double") * F.col("units"), F.lit(0.0)))
    whole = F.sum("value").over(Window.partitionBy("anchor"))
    return valued.select("series_id", F.col("anchor").alias("date"), F.try_divide(F.col("value"), whole).alias("weight"))


def factor_regression(rows: DataFrame, factors: DataFrame, names: list[str], rf: DataFrame) -> DataFrame:
    """Loadings of r - f on several factors by least squares, per series: intercept, a column per factor and n; null where the factors are
    collinear or the months do not outnumber them. `factors` holds ym and a column per name, `rf` ym and f."""
    both = rows.join(F.broadcast(factors.select("ym", *names)), "ym").join(F.broadcast(rf.select("ym", "f")), "ym")  # a row per month
    both = both.withColumn("y", F.col("r") - F.col("f"))
    k = len(names)
    columns = [F.lit(1.0), *(F.col(c).cast("double") for c in names)]
    sums = [F.sum(columns[i] * columns[j]).alias(f"a{i}_{j}") for i in range(k + 1) for j in range(i + 1)] + [F.sum(columns[i] * F.col("y")).alias(f"b{i}") for i in range(k + 1)]
    out = both.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), *sums)
    for j in range(k + 1):  # the root of the normal equations, column by column, and its forward substitution
        out = out.withColumn(f"d{j}", F.col(f"a{j}_{j}") - sum((F.col(f"l{j}_{m}") * F.col(f"l{j}_{m}") for m in range(j)), F.lit(0.0)))
        out = out.withColumn(f"l{j}_{j}", F.sqrt(F.when(F.col(f"d{j}") > 1e-12 * F.col(f"a{j}_{j}"), F.col(f"d{j}"))))
        for i in range(j + 1, k + 1):
            out = out.withColumn(f"l{i}_{j}", (F.col(f"a{i}_{j}") - sum((F.col(f"l{i}_{m}") * F.col(f"l{j}_{m}") for m in range(j)), F.lit(0.0))) / F.col(f"l{j}_{j}"))
        out = out.withColumn(f"z{j}", (F.col(f"b{j}") - sum((F.col(f"l{j}_{m}") * F.col(f"z{m}") for m in range(j)), F.lit(0.0))) / F.col(f"l{j}_{j}"))
    for j in range(k, -1, -1):
        out = out.withColumn(f"x{j}", (F.col(f"z{j}") - sum((F.col(f"l{i}_{j}") * F.col(f"x{i}") for i in range(j + 1, k + 1)), F.lit(0.0))) / F.col(f"l{j}_{j}"))
    enough = F.col("n") > k + 1
    return out.select("series_id", "n", F.when(enough, F.col("x0")).alias("intercept"), *(F.when(enough, F.col(f"x{i + 1}")).alias(c) for i, c in enumerate(names)))

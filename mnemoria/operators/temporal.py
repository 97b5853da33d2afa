"""Operators over facts with validity intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoria.functions import exprs as X


def edges_at(edges: DataFrame, t, bounds: str = "closed", relation: str | None = None, source: str | None = None, target: str | None = None) -> DataFrame:
    """Edges that hold at t (a filter that reaches the scan); relation is compared without case."""
    out = edges.where(X.valid_at(t, bounds=bounds))
    if relation is not None:
        out = out.where(F.lower("relation_type") == relation.lower())
    for name, value in (("source_id", source), ("target_id", target)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return out


def edges_at_each(edges: DataFrame, instants: DataFrame, bounds: str = "halfopen", t: str = "t") -> DataFrame:
    """Every (instant, edge) that holds: an equi-join on calendar years, then the exact interval.

    An interval is repeated for each year from the first to the last instant that it touches, so open
    ends don't multiply; instants have a row each and are never null.
    """
    span = instants.agg(F.min(F.year(t)).alias("__lo"), F.max(F.year(t)).alias("__hi"))
    lo = F.greatest(F.coalesce(F.year("valid_from"), F.col("__lo")), F.col("__lo"))
    hi = F.least(F.coalesce(F.year("valid_until"), F.col("__hi")), F.col("__hi"))
    spread = edges.crossJoin(F.broadcast(span)).where(lo <= hi).withColumn("__year", F.explode(F.sequence(lo, hi))).drop("__lo", "__hi")
    return instants.withColumn("__year", F.year(t)).join(spread, "__year").where(X.valid_at(F.col(t), bounds=bounds)).drop("__year")


def supersede(edges: DataFrame, chosen, end) -> DataFrame:
    """The chosen edges (a condition) end and are archived."""
    return edges.withColumn("valid_until", F.when(chosen, end).otherwise(F.col("valid_until"))).withColumn("state", F.when(chosen, F.lit("ARCHIVED")).otherwise(F.col("state")))


def supersede_chain(edges: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Each fact of a key ends when the next begins."""
    return edges.withColumn("valid_until", F.lead("valid_from").over(Window.partitionBy(*key).orderBy(*order)))

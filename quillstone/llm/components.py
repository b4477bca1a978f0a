"""Connected components by minimum labels and pointer jumping, all as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Work


def components(work: Work, edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (id, comp): each id of an edge and the smallest id that it reaches. Nothing is collected; a hub's edges are pre-aggregated, and its joins are left to Spark's skew handling."""
    both = work.write(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "links")
    labels = work.write(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        step = labels.join(seen, "id").select("id", "comp", F.least("comp", "near").alias("low"))
        # the label's own label: chains halve in each round
        jump = labels.select(F.col("id").alias("low"), F.col("comp").alias("far"))
        new = work.write(step.join(jump, "low", "left").select("id", F.least("low", F.coalesce("far", "low")).alias("comp"), (F.least("low", F.coalesce("far", "low")) < F.col("comp")).alias("moved")), "labels")
        labels = new.select("id", "comp")
        if new.where("moved").isEmpty():
            return labels

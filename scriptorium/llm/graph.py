"""Connected components by minimum labels with pointer jumping; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """id and component (its smallest id) of every id in ``links`` (a, b)."""
    edges = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "component-edges")
    labels = staged(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "component-labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("least"))
        lower = labels.join(near, labels["id"] == near["a"]).select("id", F.least("component", "least").alias("next"), "component")
        jump = labels.select(F.col("id").alias("_id"), F.col("component").alias("_component"))
        lower = lower.join(jump, F.col("next") == F.col("_id")).select("id", "component", F.least("next", "_component").alias("next"))
        lower = staged(lower, "component-labels")
        labels = lower.select("id", F.col("next").alias("component"))
        if not lower.filter("next <> component").head(1):
            return labels

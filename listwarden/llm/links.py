"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwarden.llm.skew import lookup
from listwarden.llm.storage import stored


def components(edges: DataFrame) -> DataFrame:
    """One row (id, label) for each id in edges (a, b); label is the smallest id it can reach.

    Every round each id takes the smallest label among its neighbours (summed up before the
    shuffle, so an id with very many links is no burden; labels that very many rows ask for are
    broadcast), then the label of its label. Rounds go on until no label changes; their number
    grows with the logarithm of the longest path for the shapes that occur. Repeated links and loops do no harm; an empty table gives an empty one.
    """
    edges = edges.select("a", "b").filter("a <> b").distinct()
    both = stored(edges.union(edges.select("b", "a")))
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label")).select("id", F.least("id", "label").alias("label")))
    while True:
        near = lookup(both, labels.withColumnRenamed("id", "b"), ["b"]).groupBy("a").agg(F.min("label").alias("near"))
        step = stored(labels.join(near, F.col("id") == F.col("a")).select("id", "label", F.least("label", "near").alias("next")))
        far = step.select(F.col("id").alias("next"), F.col("next").alias("far"))
        moved = stored(lookup(step, far, ["next"]).select(
            "id", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("label")).alias("moved")))
        labels = moved.select("id", "label")
        if moved.filter("moved").isEmpty():
            return labels

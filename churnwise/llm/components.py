"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnwise.llm.common import stage


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``links`` (a long, b long); root is the smallest node of the component.

    Each round maps every node to the smallest of itself and its neighbours,
    then contracts the links by that map.  Rounds are logarithmic in practice;
    each writes its tables, so a lost executor replays one round at most.
    The minimum is combined on the map side and the joins are plain equi-joins
    that AQE may split, so a hub node is never gathered.
    """
    edges = stage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                  .filter("a <> b").distinct(), f"{name}-edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(
            edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        step = stage(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("to")), f"{name}-step")
        if labels is None:
            labels = step.select("node", F.col("to").alias("root"))
        else:
            hop = step.select(F.col("node").alias("root"), "to")
            labels = stage(labels.join(hop, "root", "left").select("node", F.coalesce("to", "root").alias("root")), f"{name}-labels")
        of_a = step.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        of_b = step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        edges = stage(edges.join(of_a, "a").join(of_b, "b").filter("ta <> tb")
                      .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), f"{name}-edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels

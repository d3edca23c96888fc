"""Connected components of a distributed edge list, by alternating star steps.

Each round every node hands its larger neighbours, then its smaller ones, to the
smallest node it knows (large-star and small-star, Kiveris et al. 2014). Edges
stay in Spark and are checkpointed every round; a node with very many
neighbours is aggregated before the shuffle and met in a join that adaptive
execution can split. The driver sees one count and one sum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm._store import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v) but the roots; root is a component's smallest node."""
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = e.union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        small = large.join(least, F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now

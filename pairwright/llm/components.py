"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import cut


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): component is the smallest node it reaches.

    Each round points the larger neighbours of every node at the smallest neighbour, then does the same among the
    smaller neighbours; the table shrinks to one star per component in about log(n) rounds. A node with very many links
    is only ever joined (AQE splits such a join) or aggregated with partial sums, never gathered. Both sides of each
    join are read from checkpoints for that reason. Nulls and self links are ignored; no links give no rows.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(most_rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if now == mark or now[0] == 0:
            break
        mark = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        # large star: neighbours above a node point at the smallest one it knows
        large = cut(edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least.withColumnRenamed("a", "u"), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # small star: those below a node point at the smallest of them
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        pointed = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(pointed.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

"""Connected components by alternating large and small stars; no link is ever collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, attach, store

#: Edges for each file that a round writes, and files at least.
FILE_EDGES, FILES = 500_000, 8


def components(links: DataFrame) -> Stored:
    """node and label (the smallest node of its component) for every node of links (a, b). Nodes are longs or strings.

    Popular nodes are joined by attach(), so none of them is dealt to one task. Each round writes its edges to shared storage. Both stars only ever link a node with a smaller one of its component,
    so the rounds end when the edges are stars: every node has one parent, and no parent has one.
    """
    edges = store(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        n, nodes = edges.df.agg(F.count(F.lit(1)), F.countDistinct("u")).first()
        if n == nodes and edges.df.join(edges.df.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        files = max(FILES, -(-n // FILE_EDGES))
        both = edges.df.unionByName(edges.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = store(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m")).coalesce(files), "least")
        large = attach(both, least.df, "u", "n", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = store(large.coalesce(files), "edges")
        down = store(large.df.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).coalesce(files), "down")
        small = attach(large.df, down.df, "u", "n", large.df.count()).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(down.df.select("u", F.col("m").alias("v"))).distinct()
        small = store(small.coalesce(files), "edges")
        for done in (edges, least, large, down):
            done.drop()
        edges = small
    labels = edges.df.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return store(labels.unionByName(edges.df.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()).coalesce(max(FILES, -(-n // FILE_EDGES))), "labels")

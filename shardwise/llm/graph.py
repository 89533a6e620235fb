"""Connected components as repeated star contractions, without any component ever gathering in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwise.llm.storage import Tables, settled


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (bigint columns a, b): root is the least node of its component. Loops and repeated edges do no harm; no edges give no rows.

    Alternates large stars (each node links its greater neighbours to its least one) and small stars (each node links
    its smaller neighbours and itself to the least of them) until nothing changes; every step is a grouped minimum, combined before the
    shuffle, and a join with the settled minima, whose skewed keys Spark splits at run time.
    """
    tables = Tables(edges.sparkSession)
    now = tables.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settled(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("m", "a").alias("m")))
        large = both.join(least, F.col("a") == F.col("u")).where(F.col("b") > F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = tables.written(large)
        least = settled(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"))
        small = large.join(least, F.col("a") == F.col("u")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = tables.written(small.where("a <> b").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    tables.drop_all_but(1)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

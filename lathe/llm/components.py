"""Connected components of a graph that is too large for the driver: alternating large and small stars.

Each step replaces edges by edges to the smallest neighbour, so paths shorten geometrically; hub nodes cost a minimum
with map-side combination and a join whose skew Spark splits.  Every step's edges are a table in the shared folder, so
lineage stays short and lost executors cost no repetition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.shared import new_folder, remove


#: Edges that a task takes at least, where so many are there: few edges need no more files, each of which has a price.
EDGES = 50_000


def _least(edges: DataFrame) -> DataFrame:
    """The smallest of each node and its neighbours."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return least.select("a", F.least("a", "m").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, component), the component named by its smallest node, of every node in ``links`` (a, b), both long."""
    spark = links.sparkSession
    folders: list[str] = []

    def few(df: DataFrame, rows: int) -> DataFrame:
        """``df``, which has at most so many ``rows``, in no more partitions than these need."""
        return df.coalesce(max(1, -(-rows // EDGES)))

    def keep(df: DataFrame) -> tuple[DataFrame, tuple]:
        folders.append(new_folder(spark, "stars"))
        df.write.parquet(folders[-1])
        df = spark.read.schema("a long, b long").parquet(folders[-1])
        state = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if len(folders) > 2:
            remove(spark, folders.pop(0))
        return df, tuple(state)

    down = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges, state = keep(links.filter(F.col("a") != F.col("b")).select(*down).distinct())
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_least(both), "a").filter(F.col("b") > F.col("a"))
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b")).distinct()
        joined = large.join(_least(large), "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            joined.select("a", F.col("m").alias("b"))
        )
        # Each edge becomes one, and then two at most.
        edges, after = keep(few(small.filter(F.col("a") != F.col("b")).select(*down).distinct(), 2 * state[0]))
        if after == state:
            break
        state = after
    roots = few(edges.select(F.col("b").alias("node")).distinct(), state[0]).withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

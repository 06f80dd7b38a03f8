"""Connected components of a graph given by links, as a distributed loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.session import NotConverged, drop_table, write_table

#: Rounds grow with the logarithm of the longest chain; more than this many raise :class:`NotConverged`.
MAX_ROUNDS = 60


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, component) for every node of ``links``; the component is its smallest node.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each round links every node's
    larger neighbours, then its smaller ones, to the smallest node around, until nothing changes - a
    number of rounds that grows with the logarithm of the graph's size.  Hot nodes are met by
    aggregates with map-side combine only, and no list of neighbours is ever gathered.  Links from a
    node to itself and links with a null are left out; an empty table gives an empty result.
    Links that still change after ``max_rounds`` raise ``NotConverged``.
    """
    spark = links.sparkSession
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    held, path = write_table(pairs, "links")
    before = None
    for _ in range(max_rounds):
        both = held.union(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u <> v").distinct()
        nxt, nxt_path = write_table(small, "links")
        print_ = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        drop_table(spark, path)
        held, path = nxt, nxt_path
        if print_ == before:
            break
        before = print_
    else:
        raise NotConverged(f"components still change after {max_rounds} rounds")
    star = held.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return star.union(star.select(F.col("component").alias("node"), "component").distinct())

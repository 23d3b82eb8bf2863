"""Connected components of links between 64-bit ids, by alternating stars.

Each round hangs every neighbour under the smallest one it sees; links stay
distributed, every round ends in the shared folder, and a centre of many links
is only ever aggregated or joined, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ids that occur in links (a, b): component is the smallest id reachable. An id without links is not in the result."""
    both = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialise(both, "links")
    while True:
        # Large star: neighbours above hang under the smallest of all.
        wide = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written first: Spark can then split the links of a centre that has very many.
        least = materialise(wide.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = wide.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: neighbours below, and oneself, hang under the smallest of them.
        below = large.where("a <> b").distinct()
        low = below.groupBy("a").agg(F.min("b").alias("m"))
        small = below.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b"))))).select("col.*").where("a <> b").distinct()
        old, e = e, materialise(small, "links")
        discard(old, least)
        # Done when every id hangs under one that hangs under none.
        heads = e.select(F.col("b").alias("a")).distinct()
        odd = e.join(heads, "a", "left_semi").limit(1).count() or e.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        if not odd:
            break
    out = e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
    out._written_at = e._written_at  # what `discard` of the result deletes
    return out

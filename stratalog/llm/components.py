"""Connected components of an undirected edge table by minimum-label hooking and pointer jumping.

Every round is a handful of joins over the vertices that have edges, and ends in a written table; no
edge list, component or neighbourhood is ever gathered in one task or on the driver. A logarithmic
number of rounds is typical.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, written


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (v, root): the smallest vertex of v's component, for every vertex with an edge.

    Loops and repeated edges are harmless; edges with a null end are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    pairs = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    with scratch(spark) as kept:
        both = written(
            pairs.select(F.col("a").alias("u"), F.col("b").alias("w")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("w"))).distinct(),
            "cc-edges",
        )
        parent = written(both.groupBy("u").agg(F.min("w").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("p")), "cc-parents")
        done = False
        while not done:
            with scratch(spark) as next_round:
                up = parent.select(F.col("v").alias("p"), F.col("p").alias("g"))
                jumped = parent.join(up, "p").select("v", "p", "g")
                near = both.join(jumped.select(F.col("v").alias("w"), "g"), "w").groupBy("u").agg(F.min("g").alias("m"))
                state = written(jumped.join(near.withColumnRenamed("u", "v"), "v").select("v", "p", "g", "m"), "cc-state")
                hooked = state.groupBy("p").agg(F.min("m").alias("h")).select(F.col("p").alias("v"), "h")
                new = written(
                    state.join(hooked, "v", "left").select("v", F.col("p").alias("old"), F.least("g", "m", F.coalesce("h", "g")).alias("p")),
                    "cc-parents",
                )
                done = new.filter("old <> p").isEmpty()
                next_round.append(new)
            parent = new.select("v", "p")
        kept.append(new)
    return new.select("v", F.col("p").alias("root"))

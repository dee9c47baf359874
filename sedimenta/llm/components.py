"""Connected components by alternating large-star and small-star steps.

Every step is a minimum over a node's neighbours (combined before the shuffle) joined back
to the edges; a hub with very many neighbours is one row of the aggregate, and the join
side that holds its edges is split by the engine's skew handling. Each round is written to
the shared folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.sources.hfs import drop_table, stage_table


def components(edges: DataFrame, max_rounds: int = 60) -> tuple[DataFrame, str]:
    """(node, component) for every node of ``edges`` (columns u, v: long), component the smallest node reachable, and the path of its table.

    Null ends, loops and repeated edges are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    pairs = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs, path = stage_table(pairs, "edges")
    last = None
    for _ in range(max_rounds):
        state = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == last or not state["n"]:
            break
        last = state
        # Large star: every larger neighbour of a node is linked to the smallest node around it.
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node's smaller neighbours and itself are linked to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new, new_path = stage_table(small.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        drop_table(spark, path)
        pairs, path = new, new_path
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # Now every node hangs on its component's smallest one.
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), path

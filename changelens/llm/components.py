"""Connected components of a link table by repeated contraction, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def components(links: DataFrame, folder: str) -> DataFrame | None:
    """``(v, root)`` for each end of ``links(a, b)``: equal roots mean connected. None where there are no links.

    Each round every vertex moves to whichever of itself and its neighbours has the smallest hash of label and round,
    and the links move with it. The vertex with the largest hash of each component goes in each round, so it ends, and since
    each round draws new hashes a constant share of the vertices goes on average, also along chains. Each round is a
    stored table; nothing is gathered at the driver, and the minimum of a hub's neighbours is combined before the shuffle.
    """
    links = stash(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), folder, "links0")
    moves = []
    while not links.isEmpty():
        k = len(moves)
        both = links.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(links.select(F.col("b").alias("v"), F.col("a").alias("w")))
        rank = F.struct(F.xxhash64(F.lit(k), "w").alias("hash"), F.col("w"))
        own = F.struct(F.xxhash64(F.lit(k), "v").alias("hash"), F.col("v").alias("w"))
        move = stash(both.groupBy("v").agg(F.min(rank).alias("m")).select("v", F.least(own, "m")["w"].alias("m")), folder, f"move{k}")
        moves.append(move)
        to_a = move.select(F.col("v").alias("a"), F.col("m").alias("ma"))
        to_b = move.select(F.col("v").alias("b"), F.col("m").alias("mb"))
        moved = links.join(to_a, "a").join(to_b, "b").filter("ma <> mb")
        links = stash(moved.select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct(), folder, f"links{k + 1}")
    if not moves:
        return None
    roots = moves[0].withColumnRenamed("m", "root")
    for move in moves[1:]:
        step = move.select(F.col("v").alias("root"), "m")
        roots = roots.join(step, "root", "left").select("v", F.coalesce("m", "root").alias("root"))
    return roots

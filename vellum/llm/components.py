"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, pinned


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the component's smallest node.

    Each round moves every node onto the first of its neighbours and itself, and contracts
    the edges to those, so that they shrink from round to round. Even rounds order nodes by
    value, which folds a star onto its smallest node at once; odd ones by a hash of the
    round, which cuts a chain in any order to half and less. All tables stay distributed
    and are pinned between rounds; minima are combined before the shuffle, so a hub costs
    its task no more than others.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    links = pinned(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    moves: list[DataFrame] = []
    while not links.isEmpty():
        turn = len(moves)
        place = lambda c: F.struct((F.xxhash64(F.lit(turn), c) if turn % 2 else F.lit(0)).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        both = links.union(links.select("v", "u"))
        first = both.groupBy("u").agg(F.min(place("v")).alias("first")).select(F.col("u").alias("_from"), F.least(place("u"), F.col("first"))["n"].alias("_to"))
        move = lookup(first)
        moves.append(move)
        near = links.join(move, F.col("u") == F.col("_from")).select(F.col("_to").alias("p"), "v")
        far = near.join(move, F.col("v") == F.col("_from")).select("p", F.col("_to").alias("q")).filter("p <> q")
        links = pinned(far.select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct())
    if not moves:
        return links.toDF("node", "root")
    labels = moves[0].toDF("node", "root")
    for move in moves[1:]:
        labels = pinned(labels.join(move, F.col("root") == F.col("_from"), "left").select("node", F.coalesce("_to", "root").alias("root")))
    least = lookup(labels.groupBy(F.col("root").alias("_root")).agg(F.min("node").alias("_least")))
    return labels.join(least, F.col("root") == F.col("_root")).select("node", F.col("_least").alias("root"))

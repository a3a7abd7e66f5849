"""Graph metrics over nodes (column ``node``) and edges (``src``, ``dst``)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.checkpoints import Rounds, cut
from graphloom.operators.brandes import dependencies
from graphloom.operators.cells import EDGES, Around, around, degrees, labelled, merged, numbered, of_kind
from graphloom.operators.shares import shared
from graphloom.operators.traverse import depths


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``fanIn`` and ``fanOut`` of each node, 0 without edges."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fanOut"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fanIn"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return nodes.join(into.hint("merge"), "node", "left").join(out.hint("merge"), "node", "left").select(*nodes.columns, zero("fanIn"), zero("fanOut"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """``pageRank`` of each node: ``1 - d + d * sum(rank / fanOut)`` over callers, in fixed rounds.

    Ranks aren't normalised, and those of nodes without outgoing edges aren't dealt out again.
    A node that stands twice gives its shares twice. A round is one shuffle of arrays between cells of nodes (``shares``).
    """
    if rounds < 1:
        return nodes.select("node", F.lit(1.0 - damping).alias("pageRank"))
    known = nodes.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("n"))
    found = shared(known, edges, rounds, damping)
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("pageRank", F.lit(1.0 - damping)).alias("pageRank"))


def _turn(ids: np.ndarray) -> np.ndarray:
    """Places of ids in an order that has nothing to do with their cells; no two ids have the same."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _least(x: Around) -> dict[str, pa.Array]:
    """The least label of each node and of those next to it, in the order of ``_turn``."""
    order = np.argsort(_turn(x.names))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    least = place[x.own]
    np.minimum.at(least, x.src, place[x.near])
    return {"up": pa.array(x.names[order[least]])}


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``component``: the smallest node that each node reaches, edges taken both ways.

    Each round nodes follow the least of those next to them up to one that has no lesser; such a tree becomes one
    node of the next round, and edges within it vanish. So there are a few rounds over ever fewer edges (``cells``),
    and steps of a round are about the logarithm of the longest descent. The order is that of a hash: in the order of
    ids, which begin with their cell, nearly all trees and so all edges would come to the first cells.
    """
    ids, graph = numbered(nodes.select("node").where("node IS NOT NULL").distinct(), edges)
    of = ids.select("node", F.col("id").alias("part"))
    rounds, parts = Rounds(nodes.sparkSession, "trees"), Rounds(nodes.sparkSession, "parts")  # read anew: sizes estimated over checkpoints would square with each join
    while not of_kind(graph, EDGES).isEmpty():
        state = degrees(graph).select("node", F.col("node").alias("label"))
        trees = rounds.written(around(graph, labelled(state), _least, "up long").select("node", "up"))
        while True:
            upper = trees.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            further = rounds.written(trees.join(upper, "up").select("node", F.col("upper").alias("up"), (F.col("upper") != F.col("up")).alias("moved")))
            trees = further.drop("moved")
            if further.where("moved").isEmpty():
                break
        of = parts.written(of.join(trees.withColumnRenamed("node", "part"), "part", "left").select("node", F.coalesce("up", "part").alias("part")))
        graph = merged(graph, labelled(trees.withColumnRenamed("up", "label")))
    rounds.clear()
    least = of.groupBy("part").agg(F.min("node").alias("component"))
    return nodes.select("node").join(of.join(least, "part").select("node", "component"), "node", "left")


def roles(nodes: DataFrame, edges: DataFrame, bridge: float = 0.5, boundary: float = 0.15) -> DataFrame:
    """``role`` of each node by its calls out of its own ``communityId``.

    ``nodes`` has ``node`` and ``communityId``. A null community is never the same as another.
    """
    own, other = nodes.select(F.col("node").alias("src"), F.col("communityId").alias("a")), nodes.select(F.col("node").alias("dst"), F.col("communityId").alias("b"))
    both = edges.join(own, "src").join(other, "dst")
    counts = both.groupBy(F.col("src").alias("node")).agg(F.count_if(F.col("a") == F.col("b")).alias("intra"), F.count_if(F.col("a") != F.col("b")).alias("inter"))
    rows = nodes.join(counts, "node", "left").withColumns({"intra": F.coalesce("intra", F.lit(0)), "inter": F.coalesce("inter", F.lit(0))})
    total = F.col("intra") + F.col("inter")
    share = F.col("inter") / F.when(total > 0, total)
    return rows.withColumn("role", F.when(share > bridge, "bridge").when(share > boundary, "boundary").otherwise("core"))


def community_nodes(with_roles: DataFrame, edges: DataFrame) -> DataFrame:
    """Each community's size, members by role and cohesion: its share of the possible calls inside."""
    sizes = with_roles.where("communityId IS NOT NULL").groupBy("repo", "communityId").agg(
        F.count("*").alias("size"), *[F.count_if(F.col("role") == r).alias(f"{r}Count") for r in ("core", "boundary", "bridge")]
    )
    own = with_roles.select("node", "repo", "communityId")
    inside = edges.select("src", "dst").join(own, F.col("src") == F.col("node")).drop("node").join(own.select(F.col("node").alias("dst"), F.col("communityId").alias("c")), "dst").where("communityId = c")
    inside = inside.groupBy("repo", "communityId").agg(F.count("*").alias("n"))
    possible = F.col("size") * (F.col("size") - 1)
    cohesion = F.when(F.col("size") < 2, 0.0).otherwise(F.coalesce("n", F.lit(0)) / F.when(possible > 0, possible))
    return sizes.join(inside, ["repo", "communityId"], "left").withColumn("cohesion", cohesion).drop("n")


def reachability(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Least depth from an entry: an exported node (``isExported``) that nothing calls."""
    entries = nodes.where("isExported").join(edges.select(F.col("dst").alias("node")), "node", "left_anti").select("node")
    found = depths(edges, entries)
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("depth", F.lit(-1)).alias("depthFromEntry"), F.col("depth").isNotNull().alias("reachableFromEntry"))


def edge_delta(count: Column, last: Column, threshold: float = 0.05) -> Column:
    """Whether the metrics are to be computed anew; always on the first run (``last`` is null)."""
    return last.isNull() | (F.abs(count - last) / F.greatest(last, F.lit(1)) >= threshold)


def betweenness(nodes: DataFrame, edges: DataFrame, samples: int = 5000, block: int = 1000) -> DataFrame:
    """Brandes' betweenness of a directed graph, not normalised, from up to ``samples`` sources.

    Sources are the nodes of the least hashes; with as many samples as nodes it is exact. They
    are taken ``block`` at a time; paths are counted level by level and then the dependencies summed back level
    by level, over cells of nodes (``brandes``), so no task or driver holds a graph.
    """
    pairs = edges.select("src", "dst").where("src <> dst").distinct()
    nodes = cut(nodes.select("node"))
    n_nodes = nodes.count()
    share = min(1.0, samples / max(1, n_nodes))
    known = nodes.union(pairs.select("src")).union(pairs.select("dst")).where("node IS NOT NULL").distinct()
    known = cut(known.withColumn("id", F.monotonically_increasing_id()))
    label = lambda a, b: known.select(F.col("node").alias(a), F.col("id").alias(b)).hint("merge")
    pairs = cut(pairs.join(label("src", "a"), "src").join(label("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    sources = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < share * (1 << 30)).distinct().join(label("node", "s"), "node").select("s")
    sums = dependencies(sources, pairs, block).join(label("of", "node"), "node").select(F.col("of").alias("node"), "part")
    return nodes.join(sums, "node", "left").select("node", (F.coalesce("part", F.lit(0.0)) / share).alias("betweenness"))


def modularity(graph: DataFrame, of: DataFrame, gamma: float = 1.0) -> float:
    """Of communities (node, community) in an undirected graph given as both directions of its edges (src, dst, w)."""
    a, b = of.select(F.col("node").alias("src"), F.col("community").alias("a")), of.select(F.col("node").alias("dst"), F.col("community").alias("b"))
    rows = graph.join(a, "src").join(b, "dst").groupBy("a").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w"))).alias("i"))
    found = rows.agg(F.sum("k"), F.sum("i"), F.sum(F.col("k") * F.col("k"))).first()
    total = found[0] or 0.0
    return (found[1] or 0.0) / total - gamma * found[2] / total**2 if total else 0.0

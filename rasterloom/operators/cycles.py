"""Nodes on the cycles of a graph, apart from what only hangs before or behind one: strongly connected components in joins.

1. Nodes without a way in or without a way out are on no cycle and go, again and again.
2. Chains, of nodes with one way in and one way out, become one edge, by pointers that double their reach each round; a
   chain that meets itself is a cycle. So long chains and deep trees take rounds by the logarithm of their size.
3. In what is left, each node takes the greatest name of all that lead to it; the nodes that lead back to a name's owner
   within its name are its component. The rest goes round again.
4. Chains that were folded up have the component of their ends, if both have one.

Every step is a join or a count over edges, written down; none collects nodes or edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Scratch, cut_lineage

#: The edges that derive evidence from other evidence; edges of other types make no cycle.
DERIVATION = ("DERIVED_FROM", "MEASURED_FROM", "VERIFIED_FROM")


def _trimmed(edges: DataFrame, keep: Scratch) -> DataFrame:
    """Edges between nodes that have both a way in and a way out; as many rounds as it takes while each takes a tenth away."""
    n = edges.count()
    while n:
        kept = edges.join(edges.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
        kept = keep(kept.join(edges.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"))
        m = kept.count()
        edges = kept
        if m > 0.9 * n:
            break
        n = m
    return edges


def _chains(edges: DataFrame, keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node, before, after) of nodes of chains, with the ends of each chain, and (node, ring) of chains that meet themselves."""
    into = edges.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("i"), F.min("source").alias("before"))
    out = edges.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("o"), F.min("target").alias("after"))
    links = keep(into.join(out, "node").where("i = 1 and o = 1").select("node", "before", "after", F.col("node").alias("least")))
    total, span = links.count(), 1
    while span < 2 * total:
        # What lies behind the node that a pointer reaches; least: the least node passed, which names a ring.
        back = links.select(F.col("node").alias("before"), F.col("before").alias("_b"))
        ahead = links.select(F.col("node").alias("after"), F.col("after").alias("_a"), F.col("least").alias("_l"))
        met = links.join(back, "before", "left").join(ahead, "after", "left")
        links = keep(met.select("node", F.coalesce("_b", "before").alias("before"), F.coalesce("_a", "after").alias("after"), F.least("least", "_l").alias("least")))
        moving = links.join(links.select(F.col("node").alias("after")), "after", "left_semi").count()
        if not moving:
            break
        span *= 2
    held = links.join(links.select(F.col("node").alias("after"), F.lit(True).alias("_in")), "after", "left")
    return keep(held.where("_in is null").select("node", "before", "after")), keep(held.where("_in").select("node", F.col("least").alias("ring")))


def _core(edges: DataFrame, keep: Scratch) -> DataFrame:
    """(node, component) of the strongly connected components of more than one node."""
    found = None
    while not edges.isEmpty():
        name = keep(edges.select(F.explode(F.array("source", "target")).alias("node")).distinct().withColumn("name", F.col("node")))
        while True:
            told = edges.join(name.withColumnRenamed("node", "source"), "source").groupBy(F.col("target").alias("node")).agg(F.max("name").alias("_n"))
            new = keep(name.join(told, "node", "left").select("node", F.greatest("name", F.coalesce("_n", "name")).alias("name"), (F.col("_n") > F.col("name")).alias("_c")))
            name = new.select("node", "name")
            if new.where("_c").isEmpty():
                break
        # Edges within one name, and backwards from its owner.
        inside = edges.join(name.select(F.col("node").alias("source"), F.col("name").alias("_s")), "source").join(name.select(F.col("node").alias("target"), F.col("name").alias("_t")), "target").where("_s = _t").select("source", "target")
        inside = keep(inside)
        reached = keep(name.where("node = name"))
        while True:
            more = inside.join(reached.select(F.col("node").alias("target"), "name"), "target").select(F.col("source").alias("node"), "name").distinct().join(reached.select("node"), "node", "left_anti")
            more = keep(more)
            if more.isEmpty():
                break
            reached = keep(reached.union(more))
        own = reached.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
        got = keep(reached.join(own.select("name"), "name").select("node", F.col("name").alias("component")))
        found = got if found is None else keep(found.union(got))
        gone = reached.select("node")
        edges = _trimmed(keep(inside.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti").select("source", "target")), keep)
    return found if found is not None else edges.select(F.col("source").alias("node"), F.col("source").alias("component")).where("false")


def cycles(edges: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """(node, component): the nodes on cycles of ``edges`` (source, target), and a name for each set of nodes that reach each other.

    types: the values of ``edge_type`` that count (``DERIVATION`` for evidence); None: all edges. A node with an edge to
    itself is on a cycle. Repeated edges count once; edges with a null end are none; an empty table gives an empty result."""
    if types is not None:
        edges = edges.where(F.col("edge_type").isin(*types))
    with Scratch(edges.sparkSession) as keep:
        return cut_lineage(_cycles(edges, keep))


def _cycles(edges: DataFrame, keep: Scratch) -> DataFrame:
    now = keep(edges.where("source is not null and target is not null").select("source", "target").distinct())
    folded, rings, loops = [], [], []
    while True:
        loops.append(keep(now.where("source = target").select(F.col("source").alias("node"))))
        now = _trimmed(keep(now.where("source <> target")), keep)
        chains, ring = _chains(now, keep)
        if chains.isEmpty() and ring.isEmpty():
            break
        folded.append(chains)
        rings.append(ring)
        gone = chains.select("node").union(ring.select("node"))
        rest = now.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti").select("source", "target")
        now = keep(rest.union(chains.select(F.col("before").alias("source"), F.col("after").alias("target"))).distinct())
    found = _core(now, keep)
    for level in range(len(loops) - 1, -1, -1):
        if level < len(folded):
            ends = folded[level]
            a, b = found.select(F.col("node").alias("before"), F.col("component").alias("_a")), found.select(F.col("node").alias("after"), F.col("component").alias("_b"))
            # A chain that leaves and meets one node is a cycle through it.
            met = ends.join(a, "before", "left").join(b, "after", "left").withColumn("component", F.when(F.col("before") == F.col("after"), F.coalesce("_a", "before")).when(F.col("_a") == F.col("_b"), F.col("_a")))
            found = keep(found.union(met.where("component is not null").select("node", "component")).union(rings[level].select("node", F.col("ring").alias("component"))))
        alone = loops[level].join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
        found = keep(found.union(alone))
    return found

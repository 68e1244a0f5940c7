"""Operators on directed graphs given as an edge table (src, dst).

All loops are semi-naive or label propagation over DataFrames with reliable checkpoints between rounds; a round's cost is
that of an equi join on node ids. Nothing is collected but convergence counts.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.functions.stats import rate, share
from sparkwright.sources.scratch import checkpoint, discard, materialize

#: Steps along edges between two checkpoints, of a graph with fewer than LARGE edges.
HOPS, LARGE = 2, 2_000_000
#: Neighbours of a node that are in one row.
LISTED = 65_536
#: Successors and predecessors that a node keeps where a graph is thinned, and edges a node from which it is.
KEPT, DENSE = 4, 16
#: Sources and targets whose pairs are made together, and pairs a task of the last step.
BLOCK, PAIRS, MOST_TASKS = 512, 8_000_000, 4096


def simple(edges: DataFrame) -> DataFrame:
    """Without self loops, repeated edges and null ends."""
    return edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def _further(step: DataFrame, known: DataFrame) -> DataFrame:
    """All pairs that lead on from ``known`` by any number of steps, ``known`` included."""
    delta = known
    while not delta.isEmpty():
        further = delta.alias("d").join(step.select(F.col("src").alias("via"), F.col("dst").alias("to")), F.col("d.dst") == F.col("via")).select("d.src", F.col("to").alias("dst")).distinct()
        delta = checkpoint(further.join(known, ["src", "dst"], "left_anti"))
        known = checkpoint(known.union(delta))
    return known


@dataclass(frozen=True)
class Condensed:
    """A graph by its strongly connected components: ``of`` (node, component), ``sizes`` (component, size), and ``reach``
    (a, b), the components to which a path of one edge or more leads, a component itself if it is a cycle."""

    of: DataFrame
    sizes: DataFrame
    reach: DataFrame


def condensed(edges: DataFrame, seeds: DataFrame | None = None) -> Condensed:
    """Pairs are of components only, however many nodes a cycle joins; ``seeds`` (node) bounds the sources."""
    e = checkpoint(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    of = checkpoint(strong_components(e, nodes_of(e)))
    sizes = checkpoint(of.groupBy("component").agg(F.count("*").alias("size")))
    a, b = of.select(F.col("node").alias("src"), F.col("component").alias("a")), of.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    step = checkpoint(e.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    own, dag = step.where("src = dst"), checkpoint(step.where("src <> dst"))
    if seeds is not None:
        start = checkpoint(of.join(seeds.select("node").distinct(), "node", "left_semi").select(F.col("component").alias("src")).distinct())
        own, first = own.join(start, "src", "left_semi"), checkpoint(dag.join(start, "src", "left_semi"))
    else:
        first = dag
    reach = checkpoint(_further(dag, first).union(own))
    return Condensed(of, sizes, reach.select(F.col("src").alias("a"), F.col("dst").alias("b")))


def closure(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(src, dst) for every node dst that a path of one edge or more leads to; ``seeds`` (node) bounds the sources.

    Only components are joined with what they reach. Pairs of nodes are made last, where they are used, out of blocks of at
    most about BLOCK sources and BLOCK targets, so a large cycle is neither written nor in one task.
    """
    found = condensed(edges, seeds)
    sources = found.of if seeds is None else found.of.join(seeds.select("node").distinct(), "node", "left_semi")
    from_node = found.reach.join(sources.withColumnRenamed("component", "a"), "a").select("b", F.col("node").alias("src"))
    many = checkpoint(from_node.groupBy("b").agg(F.count("*").alias("n")))
    total = many.join(found.sizes.withColumnRenamed("component", "b"), "b").agg(F.sum(F.col("n") * F.col("size"))).first()[0] or 0
    parts = max(1, min(MOST_TASKS, -(-total // PAIRS)))
    dealt = lambda node, n: F.pmod(F.xxhash64(node), F.ceil(F.col(n) / BLOCK))
    a = from_node.join(many, "b").groupBy("b", dealt("src", "n").alias("i")).agg(F.collect_list("src").alias("sources"))
    b = found.of.join(found.sizes, "component").groupBy(F.col("component").alias("b"), "size", dealt("node", "size").alias("k")).agg(F.collect_list("node").alias("targets"))
    asked = a.join(found.sizes.withColumnRenamed("component", "b"), "b").withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / BLOCK) - 1)))
    blocks = asked.drop("size").join(b.drop("size"), ["b", "k"]).repartition(parts, "b", "i", "k")
    return blocks.select(F.explode("sources").alias("src"), "targets").select("src", F.explode("targets").alias("dst"))


def strong_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): component is the smallest node of the strongly connected component.

    Forward-backward colouring: nodes without a predecessor or successor left are components of their own; the smallest label
    that reaches a node is its colour; what leads back to a colour's node within the colour is that node's component. At
    first only the outermost nodes go, so that large components are found before the rest is peeled round by round. Nodes that
    aren't numbers are numbered first.
    """
    every = nodes_of(edges) if nodes is None else nodes.select("node").distinct()
    if dict(edges.dtypes)["src"] in ("bigint", "int") and dict(edges.dtypes)["dst"] in ("bigint", "int"):
        done = _by_thinning(checkpoint(simple(edges)))
    else:
        e = materialize(simple(edges))
        number = materialize(nodes_of(e).select("node", F.monotonically_increasing_id().alias("number")))
        src, dst = number.select(F.col("node").alias("src"), F.col("number").alias("s")), number.select(F.col("node").alias("dst"), F.col("number").alias("d"))
        short = checkpoint(e.join(src, "src").join(dst, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst")))
        discard(e)
        done = _by_thinning(short)
        if done is not None:
            named = checkpoint(done.join(number.withColumnRenamed("node", "name"), F.col("node") == F.col("number")).select("colour", "name"))
            least = named.groupBy("colour").agg(F.min("name").alias("least"))
            done = named.join(least, "colour").select(F.col("name").alias("node"), F.col("least").alias("colour"))
    if done is None:
        return every.select("node", F.col("node").alias("component"))
    return every.join(done, "node", "left").select("node", F.coalesce("colour", "node").alias("component"))


def _by_thinning(e: DataFrame) -> DataFrame | None:
    """``_components`` of a checkpointed edge table, which loops over few of its edges where it has many a node.

    What is strongly connected by some of the edges is so by all: each such component becomes one node, and what is left of
    the edges between these is small where the graph is dense. Only that and the few edges are gone over round by round.
    """
    if e.count() < DENSE * nodes_of(e).count():
        return _components(e)
    # each seed orders the neighbours of a node in its own way
    few = lambda near, far: e.groupBy(near).agg(*(F.min_by(far, F.xxhash64(F.lit(seed), "src", "dst")).alias(f"k{seed}") for seed in range(KEPT)))
    listed = F.explode(F.array(*(f"k{seed}" for seed in range(KEPT))))
    thin = few("src", "dst").select("src", listed.alias("dst")).union(few("dst", "src").select(listed.alias("src"), "dst"))
    first = _components(checkpoint(thin.distinct()))
    if first is None:
        return _components(e)
    first = checkpoint(first)
    a, b = first.select(F.col("node").alias("src"), F.col("colour").alias("a")), first.select(F.col("node").alias("dst"), F.col("colour").alias("b"))
    between = e.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"))
    second = _components(checkpoint(simple(between)))
    if second is None:
        return first
    joined = first.join(second.select(F.col("node").alias("colour"), F.col("colour").alias("least")), "colour", "left").select("node", F.coalesce("least", "colour").alias("colour"))
    # nodes that the few edges left alone, unless they are named by a component
    alone = second.join(first.select("node"), "node", "left_anti")
    return joined.union(alone)


def _listed(edges: DataFrame, near: str, far: str) -> DataFrame:
    """A row for each ``near`` end with an array of its ``far`` ends, or some rows with LISTED each where they are many."""
    most = edges.groupBy(near).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    part = F.pmod(F.xxhash64(far), F.lit(max(1, -(-most // LISTED))))
    return checkpoint(edges.groupBy(near, part.alias("_part")).agg(F.collect_list(far).alias(f"{far}s")).drop("_part"))


def _components(left: DataFrame) -> DataFrame | None:
    """(node, colour) of the nodes of a checkpointed edge table that colouring finds; the others are components of their own."""
    done = None
    while not left.isEmpty():
        before = left.count()
        # a step reads what the steps before it made more than once, which only pays where there is little of it
        hops = HOPS if before < LARGE else 1
        while True:
            inner = left
            for _ in range(hops):
                inner = inner.join(inner.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
                inner = inner.join(inner.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            left = checkpoint(inner)
            after = left.count()
            if before == after or done is None:
                break
            before = after
        if not after:
            break
        colour = checkpoint(nodes_of(left).select("node", F.col("node").alias("colour")))
        out, total = _listed(left, "src", "dst"), None
        while True:
            new = colour
            for _ in range(hops):
                came = out.join(new.select(F.col("node").alias("src"), "colour"), "src").select(F.explode("dsts").alias("node"), "colour")
                new = new.union(came).groupBy("node").agg(F.min("colour").alias("colour"))
            colour = checkpoint(new)
            # colours only fall
            last, total = total, colour.agg(F.sum(F.col("colour").cast("decimal(20,0)"))).first()[0]
            if last == total:
                break
        own = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c1")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2")), "dst").where("c1 = c2").select("src", "dst")
        into = _listed(checkpoint(own), "dst", "src")
        delta = checkpoint(colour.where("node = colour"))
        parts = [delta]
        while not delta.isEmpty():
            back = into.join(delta.withColumnRenamed("node", "dst"), "dst").select(F.explode("srcs").alias("node"), "colour").distinct()
            delta = checkpoint(back.join(functools.reduce(DataFrame.union, parts), "node", "left_anti"))
            parts.append(delta)
        found = checkpoint(functools.reduce(DataFrame.union, parts))
        done = found if done is None else done.union(found)
        gone = found.select("node")
        left = checkpoint(left.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    return done


def cycles(components: DataFrame) -> DataFrame:
    """(component, size, members) of components of two nodes or more, members ascending."""
    return components.groupBy("component").agg(F.count("*").alias("size"), F.array_sort(F.collect_set("node")).alias("members")).where("size > 1")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, ca, ce): distinct direct predecessors and successors, self loops not counted."""
    e = simple(edges)
    ce = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("ce"))
    ca = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("ca"))
    return nodes.join(ca, "node", "left").join(ce, "node", "left").select("node", F.coalesce("ca", F.lit(0)).alias("ca"), F.coalesce("ce", F.lit(0)).alias("ce"))


def reach_counts(reach: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, vfi, vfo): nodes that reach it and that it reaches, itself never counted."""
    r = reach.where("src <> dst")
    out = r.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("vfo"))
    into = r.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("vfi"))
    return nodes.join(into, "node", "left").join(out, "node", "left").select("node", F.coalesce("vfi", F.lit(0)).alias("vfi"), F.coalesce("vfo", F.lit(0)).alias("vfo"))


def condensed_counts(found: Condensed, nodes: DataFrame) -> DataFrame:
    """``reach_counts`` without pairs of nodes: sums of sizes by component."""
    size = lambda c: found.sizes.select(F.col("component").alias(c), F.col("size").alias(f"size_{c}"))
    r = found.reach.join(size("a"), "a").join(size("b"), "b")
    itself = F.when(F.col("a") == F.col("b"), 1).otherwise(0)
    out = r.groupBy(F.col("a").alias("component")).agg(F.sum(F.col("size_b") - itself).alias("vfo"))
    into = r.groupBy(F.col("b").alias("component")).agg(F.sum(F.col("size_a") - itself).alias("vfi"))
    counted = found.of.join(into, "component", "left").join(out, "component", "left")
    return nodes.join(counted, "node", "left").select("node", F.coalesce("vfi", F.lit(0)).cast("long").alias("vfi"), F.coalesce("vfo", F.lit(0)).cast("long").alias("vfo"))


def heights(edges: DataFrame, components: DataFrame, transparent: DataFrame | None = None) -> DataFrame:
    """(node, height): 0 where nothing else is below, else one more than the highest component below.

    A component has one height. Nodes of ``transparent`` pass on the height below them without adding to it.
    """
    of = components.select("node", "component")
    e = simple(edges).join(of.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(of.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
    dag = checkpoint(e.where("a <> b").select("a", "b").distinct())
    if transparent is None:
        cost = of.select("component", F.lit(1).alias("cost")).distinct()
    else:
        marked = of.join(transparent.select("node", F.lit(0).alias("mark")), "node", "left")
        cost = marked.groupBy("component").agg(F.max(F.coalesce("mark", F.lit(1))).alias("cost"))
    cost = checkpoint(cost)
    height = checkpoint(cost.select("component", F.lit(0).cast("long").alias("height")))
    while True:
        below = dag.join(height.withColumnRenamed("component", "b"), "b").join(cost.withColumnRenamed("component", "b"), "b")
        below = below.groupBy(F.col("a").alias("component")).agg(F.max(F.col("height") + F.col("cost")).alias("low"))
        new = checkpoint(height.join(below, "component", "left").select("component", F.greatest("height", F.coalesce("low", F.lit(0))).cast("long").alias("height")))
        if new.join(height, ["component", "height"], "left_anti").isEmpty():
            return of.join(new, "component").select("node", "height")
        height = new


def instability(degrees: DataFrame) -> DataFrame:
    """ce / (ca + ce) to four decimals, null for a node without neighbours."""
    return degrees.withColumn("instability", share(rate(F.col("ce"), F.col("ca") + F.col("ce"))))


def system(reach: DataFrame, components: DataFrame) -> DataFrame:
    """One row: nodes, propagation cost, size and smallest member of the largest cycle, and its share of the nodes."""
    return _system(reach.where("src <> dst").agg(F.count("*").alias("sum_vfo")), components)


def condensed_system(found: Condensed) -> DataFrame:
    """``system`` without pairs of nodes."""
    size = lambda c: found.sizes.select(F.col("component").alias(c), F.col("size").alias(f"size_{c}"))
    pairs = F.col("size_a") * F.col("size_b") - F.when(F.col("a") == F.col("b"), F.col("size_a")).otherwise(0)
    reached = found.reach.join(size("a"), "a").join(size("b"), "b").agg(F.coalesce(F.sum(pairs), F.lit(0)).alias("sum_vfo"))
    return _system(reached, found.of)


def _system(reached: DataFrame, components: DataFrame) -> DataFrame:
    total = components.agg(F.count("*").alias("n"))
    core = components.groupBy("component").agg(F.count("*").alias("size")).where("size > 1").orderBy(F.desc("size"), "component").limit(1)
    n = F.col("n")
    return total.crossJoin(reached).join(core, F.lit(True), "left").select(
        "n",
        share(rate(F.col("sum_vfo") + n, n * n)).alias("propagation_cost"),
        F.col("component").alias("core"),
        F.coalesce("size", F.lit(0)).alias("core_size"),
        share(rate(F.coalesce("size", F.lit(0)), n)).alias("core_share"),
    )


def reaches(edges: DataFrame, sources: DataFrame, goals: DataFrame) -> DataFrame:
    """(node): sources from which a path of one edge or more leads to a goal, sought backwards from the goals by node sets."""
    step = checkpoint(edges.select("src", "dst").distinct())
    delta = checkpoint(step.join(goals.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").select(F.col("src").alias("node")).distinct())
    parts = [delta]
    while not delta.isEmpty():
        known = functools.reduce(DataFrame.union, parts)
        further = step.join(delta.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        delta = checkpoint(further.join(known, "node", "left_anti"))
        parts.append(delta)
    return functools.reduce(DataFrame.union, parts).join(sources.select("node").distinct(), "node", "left_semi")

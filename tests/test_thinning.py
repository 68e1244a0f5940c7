"""Strong components of dense graphs: found by few edges, and the same as by all."""

import random

from sparkwright.operators import graphs


def slow(edges, nodes):
    reach = {n: {n} for n in nodes}
    after = {n: {d for s, d in edges if s == n} for n in nodes}
    for n in nodes:
        todo = [n]
        while todo:
            for d in after[todo.pop()] - reach[n]:
                reach[n].add(d)
                todo.append(d)
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


def test_dense_graphs_are_thinned_and_components_stay(spark, monkeypatch):
    rnd = random.Random(3)
    nodes = list(range(150))
    # three dense parts in a row, one edge back joins the last two, and nodes that hang on by one edge
    edges = {(a, b) for p in range(3) for a in range(p * 45, p * 45 + 45) for b in range(p * 45, p * 45 + 45) if a != b and rnd.random() < 0.9}
    edges |= {(a, b) for a in range(45) for b in range(45, 90)} | {(50, 100), (130, 60)} | {(n, n - 40) for n in range(135, 150)} | {(120, 140), (3, 141)}
    sizes, found = [], graphs._components

    def counted(left):
        sizes.append(left.count())
        return found(left)

    monkeypatch.setattr(graphs, "_components", counted)
    got = {r.node: r.component for r in graphs.strong_components(spark.createDataFrame(sorted(edges), "src long, dst long")).collect()}
    assert got == slow(edges, nodes)
    assert len(sizes) == 2 and max(sizes) <= 2 * graphs.KEPT * len(nodes) < len(edges)

import math
import random

import pytest

from pyspark.sql import functions as F

from sparkwright.operators import edits, findings, graphs, joins, metrics, relations
from sparkwright.sources import model
from sparkwright.sources.scratch import materialize


def frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def test_chain(spark):
    e = frame(spark, [("a", "b"), ("b", "c")])
    nodes = graphs.nodes_of(e)
    reach = {r.node: (r.vfi, r.vfo) for r in graphs.reach_counts(graphs.closure(e), nodes).collect()}
    assert reach == {"a": (0, 2), "b": (1, 1), "c": (2, 0)}
    s = graphs.system(graphs.closure(e), graphs.strong_components(e)).first()
    assert (s.n, s.propagation_cost, s.core, s.core_size) == (3, 0.6667, None, 0)
    assert {r.node: r.height for r in graphs.heights(e, graphs.strong_components(e)).collect()} == {"a": 2, "b": 1, "c": 0}


def test_transparent_nodes_pass_heights_on(spark):
    e = frame(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    clear = spark.createDataFrame([("b",)], "node string")
    assert {r.node: r.height for r in graphs.heights(e, graphs.strong_components(e), clear).collect()} == {"a": 2, "b": 2, "c": 1, "d": 0}


def test_strong_components_on_random_graphs(spark):
    rnd = random.Random(5)
    for n, m in ((8, 12), (12, 30), (5, 0)):
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
        reach = {i: {i} for i in range(n)}
        for _ in range(n):
            for a, b in edges:
                for i in range(n):
                    if a in reach[i]:
                        reach[i].add(b)
        used = {x for e in edges for x in e}
        want = {i: min(j for j in range(n) if j in reach[i] and i in reach[j]) for i in used}
        got = graphs.strong_components(spark.createDataFrame(edges, "src long, dst long"))
        assert {r.node: r.component for r in got.collect()} == want


def test_reach_by_components_writes_no_pairs_of_nodes(spark, monkeypatch):
    """Random graphs against plain reach, with loops, texts and blocks of three; a cycle of 40 nodes never is 1600 checkpointed rows."""
    rnd = random.Random(11)
    written, plain = [], graphs.checkpoint

    def counted(df):
        saved = plain(df)
        written.append(saved.count())
        return saved

    monkeypatch.setattr(graphs, "checkpoint", counted)
    monkeypatch.setattr(graphs, "BLOCK", 3)
    ring = [(i, (i + 1) % 40) for i in range(40)] + [(40, 0), (3, 41), (41, 41)]
    for edges in (ring, [(rnd.randrange(12), rnd.randrange(12)) for _ in range(14)]):
        nodes = sorted({x for e in edges for x in e})
        reach = {i: {b for a, b in edges if a == i} for i in nodes}
        for _ in nodes:
            reach = {i: r | {x for j in r for x in reach[j]} for i, r in reach.items()}
        e = spark.createDataFrame([(f"n{a:02}", f"n{b:02}") for a, b in edges], "src string, dst string")
        name = lambda i: f"n{i:02}"
        pairs = [(r.src, r.dst) for r in graphs.closure(e).collect()]
        assert sorted(pairs) == sorted((name(i), name(j)) for i in nodes for j in reach[i])
        if edges is ring:
            seeds = spark.createDataFrame([("n00",), ("n03",)], "node string")
            assert sorted((r.src, r.dst) for r in graphs.closure(e, seeds).collect()) == sorted((name(i), name(j)) for i in (0, 3) for j in reach[i])
            continue
        found = graphs.condensed(e)
        counts = {r.node: (r.vfi, r.vfo) for r in graphs.condensed_counts(found, graphs.nodes_of(e)).collect()}
        assert counts == {name(i): (sum(i in reach[j] for j in nodes if j != i), len(reach[i] - {i})) for i in nodes}
        assert graphs.condensed_system(found).collect() == graphs.system(graphs.closure(e), graphs.strong_components(e)).collect()
    assert max(written) < 100


def test_load_needs_equal_plain_reach(spark):
    from sparkwright.operators.placement import load_needs

    rnd = random.Random(7)
    edges = {(rnd.randrange(14), rnd.randrange(14)) for _ in range(18)}
    reach = {i: {b for a, b in edges if a == i} for i in range(14)}
    for _ in range(14):
        reach = {i: r | {x for j in r for x in reach[j]} for i, r in reach.items()}
    got = load_needs(spark.createDataFrame(sorted(edges), "src long, dst long"), F.col("src") % 3 == 0)
    assert {r.src: r.needs for r in got.collect()} == {i: len(reach[i] - {i}) for i in range(0, 14, 3) if reach[i] - {i}}


def test_split_share_is_the_greatest_set(spark):
    f = spark.createDataFrame([("m", "f", "method"), ("h1", "f", "function"), ("h2", "f", "function"), ("x", "f", "function"), ("o", "g", "function"), ("c1", "f", "function"), ("c2", "f", "function")], "id string, file string, kind string")
    uses = spark.createDataFrame([("m", "h1", "semantic"), ("h1", "h2", "semantic"), ("o", "x", "semantic"), ("c1", "c2", "semantic"), ("c2", "c1", "semantic")], "src string, dst string, resolution string")
    got = {r.file: (r.methods, r.helpers) for r in metrics.split_share(f, uses).collect()}
    assert got == {"f": (1, 4), "g": (0, 0)}


def test_asof_over_stretches(spark):
    rnd = random.Random(2)
    left = [(i, rnd.randrange(3), rnd.randrange(100)) for i in range(80)]
    right = [(rnd.randrange(3), rnd.randrange(100), 1000 + i) for i in range(25)]
    lf = spark.createDataFrame(left, "id long, k long, t long")
    rf = spark.createDataFrame(right, "k long, t long, v long")
    for forward in (False, True):
        for strict in (False, True):
            got = {r.id: r.v for r in joins.asof(lf, rf, ["k"], "t", "v", F.floor(F.col("t") / 10), forward, strict).collect()}
            for i, k, t in left:
                if forward:
                    ok = [(rt, -v) for rk, rt, v in right if rk == k and (rt > t if strict else rt >= t)]
                    want = -min(ok)[1] if ok else None
                else:
                    ok = [(rt, v) for rk, rt, v in right if rk == k and (rt < t if strict else rt <= t)]
                    want = max(ok)[1] if ok else None
                assert got[i] == want, (forward, strict, i)


def test_overlapping_edits(spark):
    rows = [("f", 0, 10, 1, 1), ("f", 5, 6, 0, 9), ("f", 10, 12, 2, 1), ("f", 11, 13, 2, 2), ("g", 0, 1, 5, 5)]
    got = edits.together(spark.createDataFrame(rows, "file string, start long, end long, priority long, ordinal long"))
    assert sorted((r.file, r.start, r.end) for r in got.collect()) == [("f", 5, 6), ("f", 10, 12), ("g", 0, 1)]


def test_lifecycle_deactivates_and_reopens(spark):
    empty = spark.createDataFrame([], "fingerprint string, decision string, first_seen timestamp_ntz, last_seen timestamp_ntz, resolved_at timestamp_ntz, inactive_at timestamp_ntz, reopened bigint")
    run = lambda *f: spark.createDataFrame([(x, x[0]) for x in f], "fingerprint string, decision string")
    yes, no_b = F.lit(True), F.col("decision") != "b"
    one = findings.record_run(empty, run("a1", "b1", "a1"), yes, yes, "2024-01-01 00:00:00")
    two = materialize(findings.record_run(one, run("a2"), yes, no_b, "2024-01-02 00:00:00"))
    rows = {r.fingerprint: r for r in two.withColumn("state", findings.state(F.lit(False))).collect()}
    assert (rows["a1"].state, rows["b1"].state, rows["a2"].state) == ("resolved", "resolved", "open")
    kept = materialize(findings.record_run(one, run("a1"), no_b, no_b, "2024-01-02 00:00:00"))
    assert {r.fingerprint: r.s for r in kept.select("fingerprint", findings.state(F.lit(False)).alias("s")).collect()} == {"a1": "open", "b1": "inactive"}
    back = findings.record_run(two, run("a1", "a2"), yes, yes, "2024-01-03 00:00:00").where("fingerprint = 'a1'").first()
    assert back.reopened == 1 and back.resolved_at is None


def test_fragments_logs_reports_and_labels(spark, tmp_path):
    import hashlib
    import json

    span = {"start": {"line": 1, "col": 1}, "end": {"line": 2, "col": 1}}
    fragment = {
        "file": {"path": "a.go", "lang": "go", "facts": {"k": "v"}},
        "modules": [{"path": "m", "name": "m"}],
        "symbols": [{"id": "m::f#function", "kind": "function", "name": "f", "visibility": "public", "file": "a.go", "span": span}],
        "edges": [{"kind": "calls", "from": {"symbol": "m::f#function"}, "to": "m::g", "resolution": "semantic", "when": "call", "site": span}] * 2,
        "functions": [{"symbol": "m::f#function", "statements": 3, "flow": [{"kind": "if", "nesting": 0}]}],
        "tests": [], "comments": [{"span": span, "text": "// x"}],
    }
    (tmp_path / "f.json").write_text(json.dumps({"fragments": [fragment, {**fragment, "file": {"path": "b.go"}}]}))
    found = model.relations(model.read_fragments(spark, str(tmp_path / "f.json")))
    counts = {name: df.count() for name, df in found.items()}
    assert counts == {"files": 2, "modules": 1, "symbols": 1, "places": 1, "edges": 1, "functions": 1, "tests": 0, "comments": 2}
    assert found["edges"].first().file == "a.go" and found["files"].where("path = 'a.go'").first().facts == {"k": "v"}

    body = '{"judgment":"fail"}'
    good = json.dumps({"id": hashlib.sha256(body.encode()).hexdigest(), "body": body, "kind": "judgment"})
    (tmp_path / "log.jsonl").write_text(good + "\n\n" + good + '\n{"id": "torn')
    assert model.read_decision_log(spark, str(tmp_path / "log.jsonl")).count() == 1
    for name, text in (("id", json.dumps({"id": "0", "body": "x"}) + "\n" + good), ("garbage", "garbage line\n" + good), ("middle", good + '\n{"id": "torn\n' + good)):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match="not a record"):
            model.read_decision_log(spark, str(tmp_path / name)).collect()

    (tmp_path / "l.tsv").write_text("# reviewed\nfingerprint\trepo\tlocation\tverdict\treason\nab\tr\tx:1\tTP\tyes\n-\tr\tx:2\tFP\tno\ncd\tr\tx:3\tFP\tno\nef\tr\tx:4\t?\t\n")
    assert [(r.fingerprint, r.fails) for r in model.read_labels(spark, str(tmp_path / "l.tsv")).orderBy("fingerprint").collect()] == [("ab", True), ("cd", False)]


def test_sarif_round_trip(spark, tmp_path):
    import json

    from sparkwright.sources import sinks

    rows = [("r1", "error", "a.go", 3, "bad", "f1", False), ("r2", "info", "b.go", 1, 'say "x"', "f2", True)]
    found = spark.createDataFrame(rows, "rule string, severity string, file string, line int, message string, fingerprint string, suppressed boolean")
    sinks.write_sarif(found, str(tmp_path / "out"), "tool")
    back = model.read_sarif(spark, str(tmp_path / "out" / "*.txt"))
    assert sorted((r.rule, r.severity, r.file, r.line, r.message, r.suppressed) for r in back.collect()) == sorted((a, b, c, d, e, g) for a, b, c, d, e, _, g in rows)
    sinks.write_sarif(found.limit(0), str(tmp_path / "none"), 'a "tool"')
    (log,) = (tmp_path / "none").glob("*.txt")
    assert json.loads(log.read_text())["runs"] == [{"tool": {"driver": {"name": 'a "tool"'}}, "results": []}]
    shas = sinks.training_rows(found, "fingerprint").collect()
    assert [r.key for r in shas] == ["f1", "f2"] and all(len(r.sha256) == 64 for r in shas)


def test_ranges_nest_cross_and_stay_open(spark):
    """Every enable ends all open ranges of its rule; without a reason nothing opens; one that ends nothing says so."""
    kind = "claim long, file string, rule string, form string, line long, reason string, first_code long, symbol string"
    rows = [
        (1, "f", "a", "disable", 2, "r", 5, None), (2, "f", "a", "disable", 10, "r", 5, None), (3, "f", "b", "disable", 12, "r", 5, None), (4, "f", "a", "enable", 20, None, 5, None),
        (5, "f", "a", "enable", 21, None, 5, None), (6, "f", "a", "disable", 30, " ", 5, None), (7, "f", "a", "enable", 31, None, 5, None), (8, "f", "a", "disable", 40, "r", 5, None), (9, "g", "a", "next-line", 3, "r", 1, "s"),
    ]
    directives = findings.close_ranges(spark.createDataFrame(rows, kind))
    got = {r.claim: (r.kind, r.line, r.end, r.closes) for r in directives.collect()}
    assert got == {1: ("range", 1, 20, None), 2: ("range", 10, 20, None), 3: ("range", 12, None, None), 4: ("enable", 20, None, 2), 5: ("enable", 21, None, 0), 6: ("range", 30, None, None), 7: ("enable", 31, None, 0), 8: ("range", 40, None, None), 9: ("next-line", 3, None, None)}
    found = spark.createDataFrame([(1, "f", "a", 1, ""), (2, "f", "a", 19, ""), (3, "f", "a", 20, ""), (4, "f", "b", 99, ""), (5, "f", "a", 30, ""), (6, "f", "a", 50, ""), (7, "g", "a", 90, "s"), (8, "g", "a", 90, "t"), (9, "g", "a", 4, "t")], "id long, file string, rule string, line long, symbol string")
    assert {r.id: r.claim for r in findings.suppress(found, directives).collect()} == {1: 1, 2: 1, 3: None, 4: 3, 5: None, 6: 8, 7: 9, 8: None, 9: 9}


def test_prefixes_empty_null_and_repeated(spark):
    prints = spark.createDataFrame([("abc1",), ("abd2",), ("x",), ("x",)], "fingerprint string")
    asked = spark.createDataFrame([("ab",), ("abc",), ("abc",), (None,), ("zz",), ("x",), ("toolong",)], "prefix string")
    got = sorted(((r.prefix or "", r.n, r.fingerprint) for r in relations.by_prefix(prints, asked).collect()), key=str)
    assert got == sorted([("", 0, None), ("ab", 2, None), ("abc", 1, "abc1"), ("abc", 1, "abc1"), ("toolong", 0, None), ("x", 1, "x"), ("zz", 0, None)], key=str)
    assert relations.by_prefix(prints, asked.limit(0)).count() == 0


def test_cohesion_joins_only_what_several_methods_use(spark, monkeypatch):
    joined, plain = [], metrics.connected_components

    def seen(edges):
        joined.append(edges.count())
        return plain(edges)

    monkeypatch.setattr(metrics, "connected_components", seen)
    f = spark.createDataFrame([("a", "T"), ("b", "T"), ("c", "T"), ("d", "T"), ("x", None), ("y", None), ("z", None)], "id string, owner string")
    uses = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("c", "z"), ("a", "d")], "src string, dst string").withColumn("resolution", F.lit("semantic"))
    assert [tuple(r) for r in metrics.cohesion(f, uses).collect()] == [("T", 4, 2)]
    assert joined == [2]


def test_division_starts_at_the_rarest_item(spark):
    """A common item with 60 owners is never joined with the 50 needs that also have a rare one."""
    r = spark.createDataFrame([(n, i) for n in range(50) for i in (0, 1)] + [(99, 7), (98, 0), (98, 0)], "need long, item long")
    p = spark.createDataFrame([(o, 0) for o in range(60)] + [(3, 1), (70, 1), (3, 1)], "owner long, item long")
    got = sorted((x.need, x.owner) for x in joins.provides_all(r, p, "need", "owner", "item").collect())
    assert got == sorted([(n, 3) for n in range(50)] + [(98, o) for o in range(60)])


def test_nearest_in_blocks_with_ties_and_nulls(spark, monkeypatch):
    from sparkwright.operators import search

    monkeypatch.setattr(search, "VECTORS", 4)
    rows = [(i, [float(i % 3), 1.0]) for i in range(20)] + [(20, None), (21, [1.0])]
    v = spark.createDataFrame(rows, "k long, v array<float>")
    got = search.nearest(v, v.where("k in (0, 21)"), "k", "v", 3).collect()
    assert sorted((r.query, r["rank"], r.neighbour, r.cosine) for r in got if r.query == 0) == [(0, 1, 3, 1.0), (0, 2, 6, 1.0), (0, 3, 9, 1.0)]
    assert [(r["rank"], r.neighbour, r.cosine) for r in got if r.query == 21] == [(1, 0, None), (2, 1, None), (3, 2, None)]
    assert "MapInPandas" in search.nearest(v, v.limit(1), "k", "v", 3)._jdf.queryExecution().toString()


def test_lexical_rank_asks_for_every_item(spark):
    """Items of any number are ranked, with ties by the smaller document and null texts that count as documents."""
    from sparkwright.operators import search
    from sparkwright.plans.evaluation import lexical_rank
    from sparkwright.sources.scratch import read_table

    folder = "/root/testdata/sf0.001"
    items = {r.item_id for r in read_table(spark, folder, "benchmark").collect()}
    assert {r["query"] for r in lexical_rank(spark, folder).select("query").distinct().collect()} == items and any(i % 50 for i in items)
    docs = spark.createDataFrame([(3, "abcd abcd, x"), (1, "ABCD-abcd"), (2, "zzzz"), (4, None), (5, "ab cd")], "d long, s string")
    got = search.bm25(docs, spark.createDataFrame([("p", "abcd efgh"), ("q", "yyy"), ("r", "")], "q string, s string"), "d", "q", "s", 1).collect()
    weight = lambda df: math.log(1 + (5 - df + 0.5) / (df + 0.5))
    part = lambda tf, length: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / 2))
    want = 2 * weight(2) * part(2, 4) / (2 * (weight(2) + weight(0)) * part(1, 4))
    assert [(r["query"], r.doc, r["rank"]) for r in got] == [("p", 1, 1)] and got[0].similarity == pytest.approx(want, abs=1e-8)


def test_every_vector_is_voted_on(spark, monkeypatch):
    """All vectors are queries; those of several slices and blocks have the same neighbours as by brute force."""
    from sparkwright.operators import search
    from sparkwright.plans.evaluation import neighbour_vote
    from sparkwright.sources.scratch import read_table

    folder = "/root/testdata/sf0.001"
    rows = {r.vec_id: r.embedding for r in read_table(spark, folder, "embeddings").collect()}
    assert sorted(r["query"] for r in neighbour_vote(spark, folder).collect()) == sorted(rows)
    for name, value in (("VECTORS", 200), ("ASKED", 90), ("SLICE", (40, 30))):
        monkeypatch.setattr(search, name, value)
    rnd = random.Random(9)
    small = [(i, [float(rnd.randrange(-1, 2)), float(rnd.randrange(-1, 2)), 0.5 * rnd.randrange(3)]) for i in range(300)]
    v = spark.createDataFrame(small, "k long, v array<double>")
    cosine = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 9) if any(a) and any(b) else -9
    want = {(i, r + 1, j) for i, a in small for r, (_, j) in enumerate(sorted((-cosine(a, b), j) for j, b in small if j != i)[:4])}
    assert {(r["query"], r["rank"], r.neighbour) for r in search.nearest(v, v, "k", "v", 4).collect()} == want


def test_load_order_needs_writes_and_joins_no_ids(spark, monkeypatch):
    """Uses are of numbers when they are written and closed over, and are read from the lines once."""
    from sparkwright.operators import placement as operator
    from sparkwright.plans import placement

    closed, written = [], []
    plain, write = operator.load_needs, placement.materialize
    monkeypatch.setattr(operator, "load_needs", lambda uses, at_load: closed.append(dict(uses.dtypes)) or plain(uses, at_load))
    monkeypatch.setattr(placement, "materialize", lambda df: written.append(df.columns) or write(df))
    found = placement.load_order_needs(spark, "/root/testdata/sf0.001").collect()
    assert closed[0]["src"] == closed[0]["dst"] == "bigint" and written == [["src", "dst"]]
    assert found and all(r.src.endswith("7#function") for r in found)


def test_neighbours_of_a_hub_are_in_several_rows(spark, monkeypatch):
    monkeypatch.setattr(graphs, "LISTED", 5)
    monkeypatch.setattr(graphs, "LARGE", 0)
    e = spark.createDataFrame([(0, i) for i in range(1, 40)] + [(i, 0) for i in range(1, 30)] + [(50, 0)], "src long, dst long")
    assert graphs._listed(e, "src", "dst").where("src = 0").count() > 4
    got = {r.node: r.component for r in graphs.strong_components(e).collect()}
    assert got == {i: 0 if i < 30 else i for i in [*range(40), 50]}

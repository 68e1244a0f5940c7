import random
import time

import pytest
from pyspark.sql import functions as F

from sparkwright.functions import lists, text


def test_words_and_keys(spark):
    names = ["SDKThing", "parseHTTPResponse", "snake_case-name", "A", "", "x1Y2", "ÉcoleÉlève", "__init__"]
    got = [(r.w, r.k) for r in spark.createDataFrame([(n,) for n in names], "n string").select(text.words("n").alias("w"), text.name_key("n").alias("k")).collect()]
    want = [["sdk", "thing"], ["parse", "http", "response"], ["snake", "case", "name"], ["a"], [], ["x1y2"], ["école", "élève"], ["init"]]
    assert [w for w, _ in got] == want and [k for _, k in got] == ["_".join(w) for w in want]


@pytest.mark.parametrize(
    ("path", "glob", "takes"),
    [
        ("app/http", "app/*", True), ("app/http/x", "app/*", False), ("app", "app/**", True), ("app/a/b", "app/**", True), ("a::b::c", "a/*/c", True), ("x", "**", True), ("a/b/c", "**/c", True),
        ("c", "**/c", True), ("bc", "**/c", False), ("a/x/y/b", "a/**/b", True), ("a/b", "a/**/b", True), ("ab", "a*b", True), ("axxb", "a*b*", True), ("a.b", "a?b", False),
    ],
)
def test_globs(spark, path, glob, takes):
    import re

    assert bool(re.match(text.glob_pattern(glob), path.replace("::", "/"))) == takes


def test_lines_and_widths(spark):
    value = 'import x\r\n// https://a.b/c\n"one literal",\n# two words http://a\n\nlast\n'
    got = spark.createDataFrame([(value,)], "t string").select(text.line_widths("t").alias("w")).first().w
    assert [(x.line, x.exempt) for x in got] == [(1, True), (2, True), (3, True), (4, False), (5, False), (6, False)]
    assert [x.width for x in got] == [8, 16, 14, 20, 0, 4]


def test_limited_replace(spark):
    rows = spark.createDataFrame([("banana",), ("",), ("xyz",), ("a",)], "t string").select(text.limited_replace("t", "a", "x", 2).alias("r"), text.limited_replace("t", "(a)(n)", r"\2\1", 1).alias("s"))
    assert [tuple(r) for r in rows.collect()] == [("bxnxna", "bnaana"), ("", ""), ("xyz", "xyz"), ("x", "a")]


def test_order_functions():
    assert lists.misplaced_places([3, 0, 1, 2]) == [0] and lists.misplaced_places([10, 10, 0]) == [2] and lists.misplaced_places([]) == []
    assert lists.users_first_ranks([[], [0]]) == [1, 0] and lists.users_first_ranks([[1], [0], [5]]) == [0, 1, 2]


def longest_first(keys):
    best = None
    n = len(keys)
    for mask in range(1 << n):
        pick = [i for i in range(n) if mask >> i & 1]
        if all(keys[a] <= keys[b] for a, b in zip(pick, pick[1:], strict=False)) and (best is None or len(pick) > len(best)):
            best = pick
    return len(best or [])


def test_misplaced_is_fewest_and_anchors(spark):
    rnd = random.Random(1)
    cases = [[rnd.randint(0, 5) for _ in range(rnd.randint(0, 9))] for _ in range(60)]
    for keys in cases:
        gone = lists.misplaced_places(keys)
        kept = [k for i, k in enumerate(keys) if i not in gone]
        assert kept == sorted(kept) and len(kept) == longest_first(keys)
    got = spark.createDataFrame([(c,) for c in cases], "k array<int>").select(lists.anchors(F.col("k")).alias("a"), lists.misplaced(F.col("k")).alias("m")).collect()
    for keys, r in zip(cases, got, strict=True):
        assert r.a == [next((j for j in range(i + 1, len(keys)) if keys[j] < keys[i]), -1) for i in range(len(keys))]
        assert r.m == lists.misplaced_places(keys)


def test_components_on_random_graphs(spark):
    from sparkwright.functions.components import connected_components

    rnd = random.Random(3)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(None, 1), (7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def slow_misplaced(keys):
    length = []
    for i, k in enumerate(keys):
        length.append(max((length[j] + 1 for j in range(i) if keys[j] <= k), default=0))
    stays, at = set(), length.index(max(length)) if keys else None
    while at is not None:
        stays.add(at)
        at = next((j for j in range(at) if length[j] == length[at] - 1 and keys[j] <= keys[at]), None)
    return [i for i in range(len(keys)) if i not in stays]


def slow_users_first(uses):
    n = len(uses)
    reach = [{k for k in row if 0 <= k < n} for row in uses]
    direct = [set(r) for r in reach]
    for k in range(n):
        for r in reach:
            if k in r:
                r |= reach[k]
    unit = [min({i} | {j for j in reach[i] if i in reach[j]}) for i in range(n)]
    ranks, place, left = [0] * n, 0, set(unit)
    while left:
        u = min(u for u in left if not any(unit[j] == u and unit[i] != u and unit[i] in left for i in range(n) for j in direct[i]))
        left.remove(u)
        for i in range(n):
            if unit[i] == u:
                ranks[i], place = place, place + 1
    return ranks


def test_order_functions_equal_slow_ones_and_are_fast():
    rnd = random.Random(1)
    for _ in range(400):
        n = rnd.randint(0, 12)
        keys = [rnd.randint(0, 6) for _ in range(n)]
        assert lists.misplaced_places(keys) == slow_misplaced(keys)
        assert lists.next_smaller(keys) == [next((j for j in range(i + 1, n) if keys[j] < keys[i]), -1) for i in range(n)]
        uses = [[rnd.randint(-1, n) for _ in range(rnd.choice([0, 0, 1, 1, 2]))] for _ in range(n)]
        assert lists.users_first_ranks(uses) == slow_users_first(uses)
    n = 100_000
    many = [rnd.randrange(n) for _ in range(n)]
    for run in (lambda: lists.misplaced_places(many), lambda: lists.next_smaller(many), lambda: lists.users_first_ranks([[(i * 7 + 1) % n] if i % 3 else [i + 1] for i in range(n)]), lambda: lists.misplaced_places(list(range(n)))):
        began = time.perf_counter()
        run()
        assert time.perf_counter() - began < 2

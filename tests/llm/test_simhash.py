import random

import numpy as np
import xxhash

from sparkwright.llm import simhash


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values):
    """values: list of (id, fingerprint) to {fingerprint: smallest id reachable}."""
    fps = np.array(sorted({f for _, f in values}), dtype=np.uint64)
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in zip(*np.where(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3), strict=True):
        parent[root(i)] = root(j)
    place = {int(f): root(i) for i, f in enumerate(fps)}
    least = {}
    for i, f in values:
        least[place[f]] = min(i, least.get(place[f], i))
    return {f: least[p] for f, p in place.items()}


def test_fingerprints(edge_docs, edge_texts):
    got = sorted((r.doc_id or -1, r.fp % 2**64) for r in simhash.with_fingerprints(edge_docs).collect())
    assert got == sorted((i or -1, slow_fingerprint(t)) for i, t in edge_texts)


def test_links_of_random_clusters(spark):
    rnd = random.Random(4)
    fps = set()
    for _ in range(12):
        centre = rnd.getrandbits(64)
        for _ in range(rnd.choice((2, 5, 60, 150))):
            f = centre
            for b in rnd.sample(range(64), rnd.randint(0, 6)):
                f ^= 1 << b
            fps.add(f)
    fps |= {0, 7, 2**64 - 1, 2**63, 2**63 + 2**31 + 1, 15, 31}
    values = list(enumerate(sorted(fps)))
    want = components(values)
    table = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long").repartition(5)
    for block in (4096, 8):
        parent = {f: f for f in fps}

        def root(f, parent=parent):
            while parent[f] != f:
                f = parent[f]
            return f

        for r in simhash.links(table, block).collect():
            a, b = r.src % 2**64, r.dst % 2**64
            assert (a ^ b).bit_count() <= 3
            parent[root(a)] = root(b)
        groups = {}
        for f in fps:
            groups.setdefault(root(f), set()).add(want[f])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_near_duplicates_of_edge_cases(edge_docs, edge_texts, empty_docs):
    got = {(r.doc_id, r.fp % 2**64): r.component_id for r in simhash.near_duplicates(edge_docs).collect()}
    want = components([(i, slow_fingerprint(t)) for i, t in edge_texts if i is not None])
    for (i, f), c in got.items():
        if i is not None:
            assert c == want[f]
    assert simhash.near_duplicates(edge_docs).count() == len(edge_texts)
    assert simhash.near_duplicates(empty_docs).count() == 0


def test_one_of_each_stays(edge_docs, empty_docs):
    kept = simhash.keep_one_of_each(edge_docs)
    ids = sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect())
    assert kept.columns == edge_docs.columns
    assert 1 in ids and not {2, 3, 11} & set(ids) and ids.count(5) == 1 and ids.count(-1) == 1 and 10 in ids
    assert simhash.keep_one_of_each(empty_docs).count() == 0


def test_ids_that_repeat_lose_no_text(spark):
    a, b, c = ("north south east west " * 9, "some other words than these stand here " * 7, "alone " * 3)
    rows = [(1, a), (1, b), (2, b), (2, c), (None, c), (None, "nobody's copy without an id"), (None, None), (3, a), (3, a), (1, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = [(r.doc_id, r.text) for r in simhash.keep_one_of_each(docs).collect()]
    assert sorted(kept, key=repr) == sorted([(1, a), (1, b), (2, c), (None, "nobody's copy without an id"), (None, None)], key=repr)
    plan = simhash.keep_one_of_each(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = simhash.near_duplicates(docs).collect()
    want = components([(r.doc_id, r.fp % 2**64) for r in got])
    assert all(r.component_id == want[r.fp % 2**64] for r in got)

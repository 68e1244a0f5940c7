import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from sparkwright.llm import queries, search

SMALL = "/root/testdata/sf0.001"


def terms(text):
    return re.findall(search.TERM, (text or "").translate(str.maketrans(search.UPPER, search.LOWER)))


def brute(docs, items, k=50):
    """All scores, sorted."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_tokens = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    dfs = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 50 + 50 * sum(c.values()) * n_docs // max(1, n_tokens)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * dfs[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def plain(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def test_query_equals_brute_force_and_sql(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute(docs, items)
    assert plain(queries.op13_search(spark, SMALL)) == want
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    assert sorted(duck.execute(f"SELECT item_id, rank, doc_id, score FROM ({queries.oracle_sql()['op13_search']})").fetchall(), key=str) == want


TIGHT = search.Sizes(block=4, segment_docs=70, segment_matches=1500, window=16, kept_blocks=3, vocabulary_bytes=0, item_bytes=200)


@pytest.mark.parametrize("sizes", [search.SIZES, TIGHT])
def test_random_documents_in_small_segments_and_blocks(spark, sizes):
    """Frequent and rare terms, equal texts with equal scores, repeated rows, null ids and texts; few kept blocks, blocks of items."""
    rnd = random.Random(3)
    words = ["The", "of", "and", "Été", "x9", *(f"r{i}" for i in range(60))]
    text = lambda: " ".join(rnd.choices(words, [50, 30, 20, 5, 3, *[1] * 60], k=rnd.randint(0, 40)))
    texts = [text() for _ in range(250)]
    docs = [(i, rnd.choice(texts)) for i in range(600)] + [(None, texts[0]), (7, texts[1]), (7, texts[1]), (1000, None), (1001, "the " * 70_000 + "r5")]
    items = [(i, text()) for i in range(12)] + [(50, None), (51, "nothing"), (3, "the of r1 r2")]
    make = lambda rows, kind: spark.createDataFrame([(*r, "clash", 1) for r in rows], kind + ", item string, score int").repartition(2)
    got = plain(search.search(make(docs, "doc_id long, text string"), make(items, "item_id long, text string"), k=9, sizes=sizes))
    assert got == brute(docs, items, 9)


def test_segment_equals_all_scores_whatever_the_windows():
    """Block-max search of one segment against scores of all documents, and far fewer blocks unpacked than there are."""
    rnd = np.random.default_rng(4)
    n = 4000
    lengths = rnd.integers(50, 400, n)
    vocabulary = {f"t{j}": np.sort(rnd.choice(n, size, replace=False)) for j, size in enumerate((4000, 3000, 2500, 60, 20, 900))}
    tfs = {t: rnd.integers(1, 300 if t == "t1" else 5, len(d)) for t, d in vocabulary.items()}
    codes = np.concatenate([np.full(len(d), j + 1) for j, d in enumerate(vocabulary.values())])
    blocks, body = search.packed(codes, np.concatenate(list(vocabulary.values())), np.concatenate(list(tfs.values())), lengths)
    row = {"doc_ids": list(range(n)), "lengths": lengths.astype("<i8").tobytes(), "terms": list(vocabulary), "dfs": [len(d) for d in vocabulary.values()], "blocks": blocks.tobytes(), "postings": body}
    weights = [("t0", 2), ("t1", 300), ("t2", 500), ("t3", 4000), ("t4", 5000), ("t5", 1500), ("absent", 9)]
    for window in (64, 500, 4096):
        segment = search.Segment(row, 10 * n, 10 * int(lengths.sum()), search.Sizes(window=window))
        scores = np.zeros(n, np.int64)
        for t, w in weights[:-1]:
            scores[vocabulary[t]] += w * segment.impact(tfs[t], segment.norms[vocabulary[t]])
        want = sorted(((-int(s), i) for i, s in enumerate(scores)))[:50]
        assert sorted((-s, i) for i, s in segment.top(weights, 50)) == want
        if window == 64:
            assert len(segment.unpacked) < len(blocks)


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.search(none, one).count() == 0
    assert search.search(one.withColumnRenamed("item_id", "doc_id"), one.limit(0)).count() == 0

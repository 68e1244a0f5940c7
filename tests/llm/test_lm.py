import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from sparkwright.llm import lm, queries

SMALL = "/root/testdata/sf0.001"


def split(text):
    return (text or "").encode().lower().split()


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1


def base(rows):
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update([*split(t), b"\n"])
    n, v = sum(counts.values()), len(counts)
    one = lambda w: math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1)))
    return n, [(i, len(split(t)) + 1, sum(counts[w] > 0 for w in [*split(t), b"\n"]), sum(one(w) for w in [*split(t), b"\n"])) for i, t in rows]


def compare(got, rows):
    n, want = base(rows)
    assert len(got) == len(want)
    order = lambda r: (r[0] if r[0] is not None else -1, r[1], r[3])
    for g, w in zip(sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got), key=order), sorted(want, key=order), strict=True):
        assert g[:3] == w[:3] and math.isclose(g[3], w[3], rel_tol=1e-9, abs_tol=1e-9)
    assert all(r.train_tokens == n and r.held_out == held(r.doc_id) for r in got)


def test_base_on_a_whole_table_and_better_than_base(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    compare(queries.op7_lm(spark, SMALL).collect(), rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compare(lm.score_documents(docs, chunk=300, ranges=7).collect(), rows)  # counts that come from many chunks by many ranges
    out = [r for r in queries.op7_lm(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_edges(spark, edge_docs, edge_texts, empty_docs):
    compare(lm.score_documents(edge_docs).collect(), edge_texts)
    assert lm.score_documents(empty_docs).count() == 0
    only = spark.createDataFrame([(i, "a b") for i in range(50) if held(i)], "doc_id long, text string")
    compare(lm.score_documents(only).collect(), [(r.doc_id, r.text) for r in only.collect()])


def one_chunk(texts):
    """The automaton of texts that all train, through the same exchanges without Spark."""
    stream = [lm.xxhash.xxh3_64_intdigest(w) for t in texts for w in [*split(t), lm.END]]
    vocabulary, numbers = np.unique(np.array(stream, np.uint64), return_inverse=True)
    sizes = np.array([len(split(t)) + 1 for t in texts], np.uint32)
    row = {"origin": 0, "doc_ids": list(range(len(texts))), "held": [False] * len(texts), "sizes": lm.pack(sizes), "vocabulary": lm.pack(vocabulary), "stream": lm.pack(numbers.astype(np.uint32))}
    total, types = len(stream), len(vocabulary)
    visit = lambda step, told: [r for b in step(iter([pa.RecordBatch.from_pylist([row | {"answers": told}])])) for r in b.to_pylist()]
    by_kind = lambda rows, answer: [r for k in (1, 2, 3) if (part := [r for r in rows if r["kind"] == k]) for r in answer(pa.Table.from_pylist(part, lm._ROW_KINDS)).to_pylist()]
    counts = by_kind(visit(lm._ask_counts(1), []), lm._counted)
    asked = visit(lm._ask_triples(1, total, types), counts)
    triples = by_kind([r for r in asked if r["what"] == "ask"], lm._counted_triples(1))
    weights = by_kind([r for r in asked + triples if r["what"] == "mass"] + counts, lm._weighed)
    told = counts + [r for r in triples if r["what"] != "mass"] + weights
    return lm.automaton(lm.Chunk(row), lm.Answers(told), total, types), total, types


def test_probabilities_after_every_context_add_up_to_one():
    rnd = random.Random(8)
    model, total, types = one_chunk([" ".join(rnd.choice("aabbcde") for _ in range(rnd.randint(1, 9))) for _ in range(200)])
    assert len(model.fail) > types + 10
    unseen = 0.5 / (total + 0.5 * (types + 1))
    for state in range(len(model.fail)):
        mass = 0.0
        for w in range(types):
            s, p = state, 0.0
            while (arc := model.arcs.get(s << 32 | w) if s else model.root[w]) is None:
                p += model.weight[s]
                s = model.fail[s]
            mass += 10 ** (p + arc[1])
        s, p = state, 0.0
        while s:
            p += model.weight[s]
            s = model.fail[s]
        assert math.isclose(mass + 10**p * unseen, 1.0, rel_tol=1e-6)


def test_the_model_holds_every_word_and_repeated_ngram(spark):
    """Twelve thousand words in repeated texts: more than the 4095 that once were the whole vocabulary."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(12_000)]
    texts = [" ".join(rnd.choice(words) if rnd.random() < 0.8 else "the" for _ in range(rnd.randint(0, 60))) for _ in range(700)]
    rows = [(i, texts[i % len(texts)] if i < 1400 else "w1 never w2 the") for i in range(1500)]
    counts, grams = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            s = [b"\n", *split(t), b"\n"]
            counts.update(s[1:])
            grams.update(zip(s, s[1:], strict=False))
            grams.update(zip(s, s[1:], s[2:], strict=False))
    assert len(counts) > 5000
    total, types = sum(counts.values()), len(counts)
    p1 = lambda w: (counts[w] + 0.5) / (total + 0.5 * (types + 1))
    kept = {g: n for g, n in grams.items() if n > 1}
    of = lambda g: counts[g[0]] if len(g) == 2 else grams[g[:-1]]
    arc = {g: (n - lm.DISCOUNT) / of(g) for g, n in kept.items()}
    taken, lower = Counter(), Counter()
    for g, p in arc.items():
        taken[g[:-1]] += p
        lower[g[:-1]] += arc[g[1:]] if len(g) == 3 else p1(g[1])
    back = {c: max(1e-9, 1 - taken[c]) / max(1e-9, 1 - lower[c]) for c in taken}

    def p(context, w):
        if not context:
            return p1(w)
        return arc[*context, w] if (*context, w) in arc else back.get(context, 1.0) * p(context[1:], w)

    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for sizes in ({}, {"chunk": 500, "ranges": 5}):
        got = {r.doc_id: r for r in lm.score_documents(docs, **sizes).collect()}
        compare(got.values(), rows)
        for i, t in rows:
            s = [b"\n", *split(t), b"\n"]
            want = sum(math.log10(p(tuple(s[max(0, k - 2) : k]), s[k])) for k in range(1, len(s)))
            assert math.isclose(got[i].score, want, rel_tol=1e-9, abs_tol=1e-9)


def test_asks_come_by_slices_and_answers_carry_no_keys():
    """What is asked of all slices is what is asked at once, and what is told of pairs is one number each, in order."""
    texts = ["a b c d a b c", "b c d a b", "a b c"]
    words = [lm.xxhash.xxh3_64_intdigest(w) for t in texts for w in [*split(t), lm.END]]
    vocabulary, numbers = np.unique(np.array(words, np.uint64), return_inverse=True)
    row = {"origin": 0, "doc_ids": [0, 1, 2], "held": [False] * 3, "sizes": lm.pack(np.array([len(split(t)) + 1 for t in texts], np.uint32)), "vocabulary": lm.pack(vocabulary), "stream": lm.pack(numbers.astype(np.uint32))}
    visit = lambda step, told: [r for b in step(iter([pa.RecordBatch.from_pylist([row | {"answers": told}])])) for r in b.to_pylist()]
    asked = visit(lm._ask_counts(5), [])
    told = [r for k in (1, 2) for a in range(5) if (part := [r for r in asked if (r["kind"], r["range"]) == (k, a)]) for r in lm._counted(pa.Table.from_pylist(part, lm._ROW_KINDS)).to_pylist()]
    assert all(r["keys"] is None for r in told)
    asks = lambda *slices: [r for r in visit(lm._ask_triples(5, len(words), len(vocabulary), *slices), told) if r["what"] == "ask"]
    pieces = [r for i in range(lm.SLICES) for r in asks((i,), False)]
    assert sorted((r["range"], r["keys"], r["counts"]) for r in pieces) == sorted((r["range"], r["keys"], r["counts"]) for r in asks()) != []

import math
import random
import zlib
from collections import Counter

import numpy as np

from sparkwright.llm import queries, toxicity
from sparkwright.llm.text import plain_words

SMALL = "/root/testdata/sf0.001"


def test_nearest_equals_exact_cosine():
    rnd = random.Random(6)
    some = lambda: {rnd.randrange(30) if rnd.random() < 0.7 else rnd.randrange(2000): rnd.random() for _ in range(rnd.randint(1, 9))}
    vectors = []
    for _ in range(700):
        e = some()
        at = np.array(sorted(e))
        w = np.array([e[t] for t in at])
        vectors.append((at, w / math.sqrt((w * w).sum())))
    vectors[300:340] = [vectors[7]] * 40  # ties
    dense = np.zeros((700, 2000))
    for i, (at, w) in enumerate(vectors):
        dense[i, at] = w
    of = np.repeat(np.arange(700), [len(at) for at, _ in vectors])
    flat = [np.concatenate([v[k] for v in vectors]) for k in (0, 1)]
    asked = [*vectors[:60], (np.array([1999]), np.array([1.0])), (np.zeros(0, int), np.zeros(0))]
    for block in (4, 32):
        index = toxicity.Index(*toxicity.postings(700, of, *flat, 2000), block)
        assert len(index.most)
        got = index.nearest(np.repeat(np.arange(62), [len(at) for at, _ in asked]), *(np.concatenate([v[k] for v in asked]) for k in (0, 1)), 62, 10)
        for (at, w), (where, score) in zip(asked, got, strict=True):
            cosine = dense[:, at] @ w
            want = sorted((-round(c, 5), i) for i, c in enumerate(cosine) if c > 1e-6)[:10]
            assert np.allclose(score, [-c for c, _ in want], atol=2e-5)
            assert np.allclose(cosine[where], score, atol=2e-6) and (np.diff(score) <= 0).all()
            assert all(a < b for a, b, s, t in zip(where, where[1:], score, score[1:], strict=False) if s == t)
        start = np.r_[0, np.cumsum([len(at) for at, _ in asked])]
        terms = np.concatenate([v[0] for v in asked])
        for queries_, postings in ((64, 1 << 20), (7, 1 << 20), (64, 50), (1, 1)):
            runs = list(index.groups(start, terms, queries_, postings))
            assert [x for a, b in runs for x in range(a, b)] == list(range(62)) and max(b - a for a, b in runs) <= queries_
            read = [index.length[t := terms[start[a] : start[b]]][index.row[t] < 0].sum() for a, b in runs]
            assert all(n <= postings or b - a == 1 for n, (a, b) in zip(read, runs, strict=True))
        assert not list(index.groups(np.zeros(1, int), np.zeros(0, int)))
    place = toxicity.resembling(700, of, *flat, 2000)
    assert sorted(place) == list(range(700)) and np.ptp(place[300:340]) == 39


def test_terms_of_texts_equal_word_by_word():
    texts = [b"Alpha alphabet ALPHA", b"", "\u00c4pfelchen \u00e4pfel alphabetical".encode(), b"bro\xffken word", b"a " * 300]
    every = sorted({x for t in texts for w in plain_words(t) for x in toxicity.word_terms(w)} - {b"alpha"})
    of, term, count = toxicity.Terms(every).counts(texts)
    got = [{every[t]: n for t, n in zip(term[of == i], count[of == i], strict=True)} for i in range(len(texts))]
    assert got == [{x: n for x, n in Counter(x for w in plain_words(t) for x in toxicity.word_terms(w)).items() if x != b"alpha"} for t in texts]
    assert [len(p) for p in toxicity.parts([b"x" * 10] * 7, 25)] == [3, 3, 1]


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def brute(docs, labels):
    """Scores of all texts, by dictionaries and loops."""
    counted = lambda t: Counter(x for w in plain_words((t or "").encode()) for x in toxicity.word_terms(w))
    texts = dict(docs)
    known = {i: y for i, y in labels.items() if fold(i) and i in texts}
    pick = lambda calibrate: {(texts[i], y): i for i, y in sorted(known.items(), reverse=True) if (fold(i) == 1) == calibrate}
    examples = sorted((i, y, counted(t)) for (t, y), i in pick(False).items())
    n1 = sum(y for _, y, _ in examples)
    n0 = len(examples) - n1
    a, b = Counter(), Counter()
    for _, y, c in examples:
        (a if y else b).update(c.keys())
    df = Counter(x for _, t in docs for x in set(counted(t)))
    weight = {}
    for t in a | b:
        x, y, n = a[t], b[t], n1 + n0
        chi = (x * (n0 - y) - y * (n1 - x)) ** 2 * n / ((x + y) * (n - x - y) * n1 * n0) if x + y < n else 0.0
        weight[t] = (math.log((1 + len(docs)) / (1 + df[t])) + 1) * math.sqrt(1 + chi)

    def vector(counts):
        raw = {t: (1 + math.log(n)) * weight[t] for t, n in counts.items() if t in weight}
        norm = math.sqrt(sum(w * w for w in raw.values())) or 1.0
        return {t: w / norm for t, w in raw.items()}

    unit = [(i, y, vector(c)) for i, y, c in examples]
    fitted = [y for i, y in labels.items() if fold(i)]
    rate = (sum(fitted) + 0.5) / (len(fitted) + 2)

    def odds(text):
        q = vector(counted(text))
        near = sorted(((sum(w * v.get(t, 0.0) for t, w in q.items()), y) for _, y, v in unit), reverse=True)[: toxicity.NEAREST]
        p = (sum(c**toxicity.CLOSENESS * y for c, y in near) + toxicity.SHRINK * rate) / (sum(c**toxicity.CLOSENESS for c, _ in near) + toxicity.SHRINK)
        return math.log(p / (1 - p))

    check = [(odds(t), y) for (t, y) in pick(True)]
    slope, shift = toxicity.platt(np.array([z for z, _ in check]), np.array([y for _, y in check]))
    return [1 / (1 + math.exp(-(slope * odds(t) + shift))) for _, t in docs]


def test_whole_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    got = {r.doc_id: r.score for r in queries.op5_toxicity(spark, SMALL).collect()}
    want = brute(docs, labels)
    assert len(got) == len(docs)
    assert max(abs(got[i] - p) for (i, _), p in zip(docs, want, strict=True)) < 1e-3


def test_held_out_accuracy_and_labels_unseen(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = queries.op5_toxicity(spark, folder).collect()
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    hit = sum(p and y for p, y in held)
    print(hit, sum(y for _, y in held), sum(p for p, _ in held))
    assert hit >= 0.9 * sum(y for _, y in held) and hit >= 0.95 * sum(p for p, _ in held)
    assert sum(not r.evidence for r in got) < 0.1 * len(got)
    shown = {e for r in got for e in r.evidence}
    assert all(zlib.crc32(str(e).encode()) % 5 > 1 for e in shown)


def test_copies_of_examples_have_them_as_evidence(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = {i: " ".join(rnd.choice(words) for _ in range(40)) for i in range(200)}
    labels = [(i, i % 4 == 0) for i in range(150)]
    docs = [*texts.items(), *((1000 + i, t + " more") for i, t in texts.items() if i < 150)]
    got = toxicity.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic boolean").selectExpr("doc_id", "cast(toxic as int) as toxic"))
    near = {r.doc_id: r.evidence for r in got.collect()}
    assert all(near[1000 + i][0] == i for i in range(150) if fold(i) > 1)


def test_edges(spark, edge_docs, empty_docs):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(14)] + [(None, 1), (5, None), (5, 1), (5, 1)], "doc_id long, toxic int")
    got = toxicity.score_documents(edge_docs, labels).collect()
    assert len(got) == edge_docs.count() and all(0 < r.score < 1 for r in got)
    none = labels.where("false")
    assert {round(r.score, 3) for r in toxicity.score_documents(edge_docs, none).collect()} == {0.25}
    assert toxicity.score_documents(empty_docs, labels).count() == 0
    kept = toxicity.drop_toxic(edge_docs, none)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()
    assert toxicity.drop_toxic(empty_docs, labels).count() == 0


def test_platt_keeps_order():
    z = np.linspace(-3, 3, 50)
    a, b = toxicity.platt(z, (z > 0.5).astype(int))
    assert a > 0 and math.isfinite(b)


def test_the_fitted_model_is_broadcast_once(spark):
    docs = [(i, f"some {'vile' if i % 3 == 0 else 'calm'} text number {i % 40}") for i in range(200)]
    labels = [(i, int(i % 3 == 0)) for i, _ in docs]
    given = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(given, spark.createDataFrame(labels, "doc_id long, toxic int"))
    sent = []
    real, spark.sparkContext.broadcast = spark.sparkContext.broadcast, lambda value: sent.append(value) or real(value)
    try:
        got = given.select(toxicity.score_column(model, given)["score"].alias("s"), "doc_id").collect()
    finally:
        del spark.sparkContext.broadcast
    assert not any(isinstance(v, toxicity.Model) for v in sent)
    want = dict(zip([i for i, _ in docs], [p for p, _ in model.scores([t.encode() for _, t in docs])], strict=True))
    assert all(math.isclose(r.s, want[r.doc_id], abs_tol=1e-9) for r in got) and model.slope != 1.0

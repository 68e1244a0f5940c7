import zlib

import numpy as np

from sparkwright.llm import quality, queries


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = queries.op3_quality(spark, folder).collect()
    assert len(got) == 10_000 and all(0 <= r.score <= 1 for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    right = sum(p == y for p, y in held) / len(held)
    low = [p for p, y in held if not y]
    print(right, len(low), low.count(0))
    assert right > 0.9 and low.count(0) > 0.7 * len(low)


def test_edges(spark, edge_docs, empty_docs):
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(14)] + [(None, 1), (5, None), (5, 1)], "doc_id long, quality int")
    got = quality.score_documents(edge_docs, labels).collect()
    assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.score_documents(edge_docs, labels.where("false")).collect()} == {0.5}
    assert quality.score_documents(empty_docs, labels).count() == 0
    bare = edge_docs.select("doc_id", "text")
    assert quality.score_documents(bare, labels).count() == edge_docs.count()


def test_logistic_separates():
    rnd = np.random.default_rng(0)
    y = rnd.integers(0, 2, 400).astype(float)
    rows = quality.Rows.of([(np.array([int(v), 2 + rnd.integers(0, 5)]), np.ones(2)) for v in y], 8)
    w = quality.logistic(rows, y, np.ones(400))
    assert (((rows.dot(w[:-1]) + w[-1]) > 0) == (y > 0)).all()
    assert quality.meta_features({"a": None, "b": 3})[0].shape == (2,)


def dense(rows):
    out = np.zeros((rows.n, rows.size))
    np.add.at(out, (rows.row, rows.where), rows.value)
    return out


def test_co_training_equals_a_plain_version():
    """Rounds by dense matrices and loops: the confident ones of each view, good and bad in proportion, go to the other."""
    rnd = np.random.default_rng(3)
    y = (np.arange(60) % 3 > 0).astype(float)
    hidden = (np.arange(200) % 4 > 0).astype(float)

    def view(truth, noise):
        features = []
        for v in truth:
            flip = rnd.random() < noise
            features.append((np.array([int(v) ^ flip, 2 + rnd.integers(0, 6)]), np.array([1.0, 0.5])))
        return quality.Rows.of(features, 8)

    text, meta, pool_text, pool_meta = view(y, 0.05), view(y, 0.2), view(hidden, 0.05), view(hidden, 0.2)
    got = quality.co_train(text, meta, y, pool_text, pool_meta, rounds=3, share=0.1)

    def fit(x, labels, weight):
        w, b, vw, vb = np.zeros(8), 0.0, np.zeros(8), 0.0
        scale = 0.25 * (weight[:, None] * x**2).sum(0) + 1.0
        norm = 1 + np.sqrt((x != 0).sum(1).max())
        for _ in range(150):
            p = 1 / (1 + np.exp(-(x @ (w + 0.9 * vw) + b + 0.9 * vb)))
            r = weight * (p - labels)
            vw = 0.9 * vw - (x.T @ r + w + 0.9 * vw) / scale / norm
            vb = 0.9 * vb - r.sum() / (0.25 * weight.sum()) / norm
            w, b = w + vw, b + vb
        return np.r_[w, b]

    views = [(dense(text), dense(pool_text)), (dense(meta), dense(pool_meta))]
    given = [{}, {}]
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for turn in range(4):
        want = []
        for k, (x, pool) in enumerate(views):
            more = sorted(given[k])
            want.append(fit(np.r_[x, pool[more]] if more else x, np.r_[y, [given[k][i] for i in more]], np.r_[balance, np.full(len(more), 0.5)]))
        if turn < 3:
            for k in (0, 1):
                z = views[k][1] @ want[k][:-1] + want[k][-1]
                left = sorted((i for i in range(200) if i not in given[1 - k]), key=lambda i: (z[i], i))
                good = int(20 * y.mean())
                given[1 - k].update({i: 1.0 for i in left[-good:] if z[i] > 1} | {i: 0.0 for i in left[: 20 - good] if z[i] < -1})
    assert np.allclose(got[0], want[0], atol=1e-9) and np.allclose(got[1], want[1], atol=1e-9)
    assert given[0] and given[1]


def test_calibration_reaches_the_least_loss():
    rnd = np.random.default_rng(5)
    z = rnd.normal(size=(300, 2)) * 3
    y = (rnd.random(300) < 1 / (1 + np.exp(-(0.8 * z[:, 0] + 0.3 * z[:, 1] - 0.5)))).astype(float)
    w = quality.calibrated(z, y)
    prior = np.array([0.5, 0.5, 0.0])
    loss = lambda w: np.logaddexp(0, (1 - 2 * y) * (z @ w[:-1] + w[-1])).sum() + ((w - prior) ** 2).sum() / 2
    assert all(loss(w) <= loss(w + d * 1e-3) for d in np.r_[np.eye(3), -np.eye(3)])

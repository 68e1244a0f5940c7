"""Quality classification by co-training of two views.

The text view sees hashed words and the shape of the text; the metadata view sees language, source and stated length. Each is a logistic regression on a bounded, labelled sample. In every round each view scores a
pool of unlabelled documents and hands its most confident pseudo-labels to the other view's training set. At the end each
view is calibrated on labelled rows that trained neither, the calibrated log odds are combined with weights fitted there too,
and every document is scored where it is, without a shuffle.

Bounds, all parameters: ``sample`` labelled rows to fit, as many to calibrate, and ``pool`` unlabelled documents; these are
what the driver holds. Scoring and nothing else sees all documents.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.text import utf8
from sparkwright.sources.scratch import materialize

SAMPLE, POOL, ROUNDS, SHARE = 4096, 4096, 4, 0.05
#: Hashed dimensions of words and of metadata values.
WORDS, METADATA = 4096, 256
SHAPE = 12
#: Rows whose crc32(id as text) mod 5 is 0 are held out of all fitting; 1 calibrates; 2, 3 and 4 train.
FOLD = "pmod(crc32(cast(coalesce(cast({0} as string), '') as binary)), 5)"


class Buckets(dict):
    """word -> its hashed dimension, filled as words come."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        found = self[word] = zlib.crc32(word) % WORDS
        return found


def shape(text: bytes, words: list[bytes]) -> list[float]:
    """Figures of a text that need no vocabulary, each about between 0 and 1."""
    n, size = max(1, len(words)), max(1, len(text))
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = text.split(b"\n")
    return [
        math.log1p(len(words)) / 10,
        len(set(words)) / n,
        repeats / n,
        min(1.0, len(text) / n / 20),
        sum(text.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")) / size * 10,
        sum(text.count(c) for c in (b".", b",", b";", b":", b"!", b"?")) / n,
        sum(text.count(bytes([c])) for c in range(48, 58)) / size * 5,
        min(1.0, len(lines) / n * 5),
        1 - len(set(lines)) / len(lines),
        min(1.0, max(map(len, words), default=0) / 40),
        float(not words),
        float(len(words) < 50),
    ]


def text_features(text: bytes, buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions, values): log counts of hashed words at unit length, then the shape."""
    words = text.lower().split()
    where, count = np.unique(np.fromiter(map(buckets.__getitem__, words), np.int64, len(words)), return_counts=True)
    value = np.log1p(count)
    norm = math.sqrt(float((value * value).sum())) or 1.0
    return np.r_[where, WORDS : WORDS + SHAPE], np.r_[value / norm, shape(text, words)]


def meta_features(values: dict[str, object]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed name=value pairs; numbers are cut into half powers of two. Null is a value of its own."""
    pairs = []
    for name, value in sorted(values.items()):
        if isinstance(value, (int, float)) and not isinstance(value, bool) and value == value:
            pairs.append(f"{name}~{round(2 * math.log2(1 + max(0.0, float(value))))}")
        else:
            pairs.append(f"{name}={value}")
    where = np.array([zlib.crc32(p.encode()) % METADATA for p in pairs], dtype=np.int64)
    return where, np.ones(len(where))


@dataclass
class Rows:
    """Sparse rows of features."""

    size: int
    row: np.ndarray
    where: np.ndarray
    value: np.ndarray
    n: int

    @staticmethod
    def of(features: list[tuple[np.ndarray, np.ndarray]], size: int) -> Rows:
        lengths = [len(w) for w, _ in features]
        cat = lambda k, kind: np.concatenate([np.zeros(0, kind), *(np.asarray(f[k], kind) for f in features)])
        return Rows(size, np.repeat(np.arange(len(features)), lengths), cat(0, np.int64), cat(1, float), len(features))

    @staticmethod
    def of_arrow(where: pa.ChunkedArray, value: pa.ChunkedArray, size: int) -> Rows:
        """From two list columns, without Python objects for their items."""
        w, v = (c.combine_chunks() for c in (where, value))
        lengths = np.diff(w.offsets.to_numpy()) if len(w) else np.zeros(0, np.int64)
        return Rows(size, np.repeat(np.arange(len(w)), lengths), w.flatten().to_numpy().astype(np.int64), v.flatten().to_numpy(), len(w))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.where] * self.value, minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.where, weights=r[self.row] * self.value, minlength=self.size)


def logistic(rows: Rows, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0, steps: int = 150) -> np.ndarray:
    """Weights and, last, the intercept; gradient descent with momentum and diagonal scaling on the penalised loss."""
    w, b = np.zeros(rows.size), 0.0
    scale = 0.25 * np.bincount(rows.where, weights=weight[rows.row] * rows.value**2, minlength=rows.size) + penalty
    scale_b = 0.25 * weight.sum() + 1e-9
    row_norm = 1.0 + np.bincount(rows.row, minlength=rows.n).max(initial=1) ** 0.5
    vw, vb = np.zeros_like(w), 0.0
    for _ in range(steps):
        lw, lb = w + 0.9 * vw, b + 0.9 * vb
        p = 1 / (1 + np.exp(-np.clip(rows.dot(lw) + lb, -30, 30)))
        r = weight * (p - y)
        vw = 0.9 * vw - (rows.back(r) + penalty * lw) / scale / row_norm
        vb = 0.9 * vb - r.sum() / scale_b / row_norm
        w, b = w + vw, b + vb
    return np.r_[w, b]


def calibrated(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method for a small logistic regression on columns of log odds; weights then intercept, slightly penalised."""
    x = np.c_[z, np.ones(len(y))]
    w = np.r_[np.full(z.shape[1], 1 / z.shape[1]), 0.0]
    prior = w.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (p - y) + (w - prior))
        w = w - step
    return w


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    text_calibration: np.ndarray
    meta_calibration: np.ndarray
    combination: np.ndarray


def _odds(where: np.ndarray, value: np.ndarray, w: np.ndarray) -> float:
    return float((w[where] * value).sum() + w[-1])


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def co_train(text: Rows, meta: Rows, y: np.ndarray, pool_text: Rows, pool_meta: Rows, rounds: int = ROUNDS, share: float = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Weights of both views after exchanging pseudo-labels of the pool."""
    known = np.ones(len(y))
    balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
    given: dict[str, dict[int, float]] = {"text": {}, "meta": {}}  # what a view has got from the other
    views = {"text": (text, pool_text), "meta": (meta, pool_meta)}
    weights = {}
    for turn in range(rounds + 1):
        for name, (rows, pool) in views.items():
            extra = sorted(given[name])
            joined = _stack(rows, pool, extra)
            labels = np.r_[y, [given[name][i] for i in extra]]
            weights[name] = logistic(joined, labels, np.r_[known * balance, np.full(len(extra), 0.5)])
        if turn == rounds or not pool_text.n:
            break
        for name, other in (("text", "meta"), ("meta", "text")):
            z = views[name][1].dot(weights[name][:-1]) + weights[name][-1]
            order = np.argsort(z, kind="stable")
            new = [i for i in order if i not in given[other]]
            n = max(1, int(share * pool_text.n))
            good = max(1, int(n * y.mean()))
            for i in new[len(new) - good :]:
                if z[i] > 1:
                    given[other][int(i)] = 1.0
            for i in new[: max(1, n - good)]:
                if z[i] < -1:
                    given[other][int(i)] = 0.0
    return weights["text"], weights["meta"]


def _stack(rows: Rows, pool: Rows, extra: list[int]) -> Rows:
    if not extra:
        return rows
    number = np.full(pool.n, -1)
    number[extra] = np.arange(len(extra)) + rows.n
    keep = number[pool.row] >= 0
    return Rows(rows.size, np.r_[rows.row, number[pool.row[keep]]], np.r_[rows.where, pool.where[keep]], np.r_[rows.value, pool.value[keep]], rows.n + len(extra))


def _features(meta_cols: list[str]):
    kind = "doc_id long, use int, y int, tw array<int>, tv array<double>, mw array<int>, mv array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            texts = [text_features(t, buckets) for t in utf8(batch.column("text"))]
            metas = [meta_features(r) for r in batch.select(meta_cols).to_pylist()]
            lists = [pa.array([list(f[k]) for f in fs], pa.list_(t)) for fs in (texts, metas) for k, t in ((0, pa.int32()), (1, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("use"), batch.column("y"), *lists], names=["doc_id", "use", "y", "tw", "tv", "mw", "mv"])

    return run, kind


def _chosen(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, sample: int, pool: int) -> DataFrame:
    """(doc_id, use, y): bounded labelled rows to train (0) and calibrate (1), and unlabelled ones for the pool (2)."""
    fold = F.expr(FOLD.format("doc_id"))
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg((F.min(label_col) > 0).cast("int").alias("y"))
    pick = lambda rows, n: rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    train = [pick(known.where((fold > 1) & (F.col("y") == y)), sample // 2).select("doc_id", F.lit(0).alias("use"), "y") for y in (0, 1)]
    check = [pick(known.where(fold == 1), sample).select("doc_id", F.lit(1).alias("use"), "y")]
    others = docs.select(F.col(id_col).alias("doc_id")).where(F.col("doc_id").isNotNull() & (fold > 0)).join(known, "doc_id", "left_anti")
    free = [pick(others.distinct(), pool).select("doc_id", F.lit(2).alias("use"), F.lit(0).alias("y"))]
    out = train[0]
    for d in train[1:] + check + free:
        out = out.union(d)
    return materialize(out)


def fit(docs: DataFrame, labels: DataFrame, meta_cols: list[str], id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, pool: int = POOL) -> Model | None:
    """The fitted views, or None if the sample lacks one of the classes."""
    chosen = _chosen(docs, labels, id_col, label_col, sample, pool)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"m_{c}") for c in meta_cols))
    run, kind = _features([f"m_{c}" for c in meta_cols])
    table = materialize(rows.join(F.broadcast(chosen), "doc_id").mapInArrow(run, kind)).toArrow().sort_by("doc_id")
    if not table.num_rows:
        return None
    view = {}
    for use in (0, 1, 2):
        part = table.filter(pc.equal(table["use"], use))
        view[use] = part["y"].to_numpy().astype(float), Rows.of_arrow(part["tw"], part["tv"], WORDS + SHAPE), Rows.of_arrow(part["mw"], part["mv"], METADATA)
    y = view[0][0]
    if len(set(y)) < 2:
        return None
    wt, wm = co_train(view[0][1], view[0][2], y, view[2][1], view[2][2])
    yc = view[1][0]
    zt, zm = (r.dot(w[:-1]) + w[-1] for r, w in ((view[1][1], wt), (view[1][2], wm)))
    if len(set(yc)) < 2:
        one = np.array([1.0, 0.0])
        return Model(wt, wm, one, one, np.array([0.5, 0.5, 0.0]))
    ct, cm = calibrated(zt[:, None], yc), calibrated(zm[:, None], yc)
    return Model(wt, wm, ct, cm, calibrated(np.c_[ct[0] * zt + ct[1], cm[0] * zm + cm[1]], yc))


def score_documents(docs: DataFrame, labels: DataFrame, meta_cols: tuple[str, ...] = ("lang", "source", "n_chars"), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, pool: int = POOL) -> DataFrame:
    """(doc_id, text_score, meta_score, score) for every row: probabilities of good quality by view and combined.

    Null or empty texts and null metadata are values like others; repeated rows are scored each for itself, a very long text as
    a whole. Ties: equal odds of unlabelled documents are ordered by their ids, an id with two labels counts as bad. Without
    labels of both classes all scores are 0.5. An empty table gives an empty result; other columns are not read.
    """
    meta = [c for c in meta_cols if c in docs.columns]
    model = fit(docs, labels, meta, id_col, text_col, label_col, sample, pool)
    if model is None:
        half = F.lit(0.5)
        return docs.select(F.col(id_col).alias("doc_id"), half.alias("text_score"), half.alias("meta_score"), half.alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("text_score", pa.float64()), ("meta_score", pa.float64()), ("score", pa.float64())])

    @F.arrow_udf("struct<text_score:double,meta_score:double,score:double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m, buckets, metas = shared.value, Buckets(), {}
        for batch in batches:
            texts, *columns = batch.flatten()
            out = []
            values = zip(*(c.to_pylist() for c in columns), strict=True) if columns else [()] * len(texts)
            for text, row in zip(utf8(texts), values, strict=True):
                if row not in metas:
                    if len(metas) > 100_000:
                        metas.clear()
                    metas[row] = _odds(*meta_features(dict(zip((f"m_{c}" for c in meta), row, strict=True))), m.meta)
                t = m.text_calibration[0] * _odds(*text_features(text, buckets), m.text) + m.text_calibration[1]
                v = m.meta_calibration[0] * metas[row] + m.meta_calibration[1]
                out.append({"text_score": _sigmoid(t), "meta_score": _sigmoid(v), "score": _sigmoid(float(m.combination @ (t, v, 1.0)))})
            yield pa.array(out, type=kind)

    found = docs.select(F.col(id_col).alias("doc_id"), score(F.struct(F.col(text_col).alias("text"), *(F.col(c).alias(f"m_{c}") for c in meta))).alias("s"))
    return found.select("doc_id", "s.*")

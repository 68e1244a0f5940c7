"""Toxicity by the nearest labelled examples in exact TF-IDF cosine, found in a block-max inverted index.

Terms are all words and word beginnings of the labelled examples; none is left out. A term weighs log frequency in the text times inverse
document frequency over all documents times the root of 1 + chi-square, which is how far it stands out in one class of the
examples, so telling terms count for more and chance ones for less. Terms that no example has are no dimension of the space.

Every example is indexed. Examples that resemble each other lie in the same blocks of BLOCK. Short postings lists are added up
first; of long ones a block knows its largest weight. Both give an upper bound for each block, blocks are visited in the order
of their bounds, and the search ends where no further block can hold a nearer example, so the nearest examples are exact.
Votes weighted by closeness, shrunk towards the rate among labelled documents, go through a calibration fitted on labelled
rows that are not in the index.

Bounds, a parameter: ``examples`` labelled rows of each class are indexed, and as many of each calibrate. The index of these is
broadcast (some MB for thousands of examples); documents are scored where they are, without a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.text import give_back, plain_words, unused, utf8
from sparkwright.sources.scratch import materialize

EXAMPLES, NEAREST = 4096, 15
BLOCK = 32
#: Lists with more than one in so many of the examples are long: they are held by blocks.
LONG = 16
#: How many blocks of the largest bounds are searched before the others are weighed against what they gave.
FIRST = 4
#: Beginnings of words that are terms besides whole words, in characters.
BEGINNINGS = (4, 5, 6)
#: Exponent of a cosine in its vote, and the weight of the rate among all votes.
CLOSENESS, SHRINK = 4, 0.5
#: Rows whose crc32(id as text) mod 5 is 0 are held out; 1 calibrates; 2, 3 and 4 are indexed.
FOLD = "pmod(crc32(cast(cast({0} as string) as binary)), 5)"


def word_terms(word: bytes) -> list[bytes]:
    """A word as a term, and its beginnings marked with a star."""
    out = [word]
    text = word.decode("utf-8", "replace")
    out += [text[:n].encode() + b"*" for n in BEGINNINGS if len(text) > n]
    return out


class Terms:
    """The numbers of the terms that the index has, looked up for many texts at once."""

    def __init__(self, terms: list[bytes]) -> None:
        self.known = pa.array(terms, pa.binary())

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, frequency) of all texts, ascending by text and term."""
        words, sizes = [], []
        for text in texts:
            before = len(words)
            words += plain_words(text)
            sizes.append(len(words) - before)
        of = np.repeat(np.arange(len(texts)), sizes)
        coded = pa.array(words, pa.binary()).dictionary_encode()
        words.clear()
        try:
            unique = coded.dictionary.cast(pa.string())
        except pa.ArrowInvalid:
            unique = pa.array([w.decode("utf-8", "replace") for w in coded.dictionary.to_pylist()], pa.string())
        size = pc.utf8_length(unique)
        spelt = [coded.dictionary]
        for n in BEGINNINGS:
            longer = pc.if_else(pc.greater(size, n), pc.utf8_slice_codeunits(unique, 0, n), None)
            spelt.append(pc.binary_join_element_wise(longer, "*", "").cast(pa.binary()))
        codes, keys = coded.indices.to_numpy(), []
        found = pc.index_in(pa.chunked_array(spelt), value_set=self.known, skip_nulls=True).combine_chunks()
        for row in pc.fill_null(found, -1).to_numpy(zero_copy_only=False).reshape(len(spelt), -1):
            number = row[codes]
            has = np.flatnonzero(number >= 0)
            keys.append(of[has] << 32 | number[has])
        key = np.concatenate(keys)
        keys.clear()
        key.sort()
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        count, key = np.diff(np.r_[first, len(key)]), key[first]
        return key >> 32, key & 0xFFFFFFFF, count


def one_by_one(column: pa.Array, rows: int = 1024) -> Iterator[bytes]:
    """The texts of a column, of which only so many at once are Python objects."""
    for at in range(0, len(column), rows):
        yield from utf8(column.slice(at, rows))


def parts(texts: Iterable[bytes], most: int = 4 << 20) -> Iterator[list[bytes]]:
    """The texts in lists of about ``most`` bytes, at most 2048 each."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= most or len(some) == 2048:
            yield some
            some, size = [], 0
    if some:
        yield some


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    if not len(start):
        return np.zeros(0, np.int64)
    out = np.repeat(start - np.r_[0, np.cumsum(length)[:-1]], length)
    out += np.arange(len(out))
    return out


class Index:
    """Postings of n examples as (offset by term, example, weight), and the long ones of them by blocks as well."""

    def __init__(self, n: int, offset: np.ndarray, example: np.ndarray, value: np.ndarray, block: int = BLOCK) -> None:
        self.n, self.offset, self.example, self.value, self.block = n, offset, example, value, block
        self.length = np.diff(offset)
        self.blocks = -(-n // block)
        long = np.flatnonzero(self.length > max(block, n // LONG))
        self.row = np.full(len(self.length), -1, np.int64)
        self.row[long] = np.arange(len(long))
        self.dense = np.zeros((self.blocks, len(long), block), np.float32)
        for i, term in enumerate(long):
            held = slice(offset[term], offset[term + 1])
            self.dense[example[held] // block, i, example[held] % block] = value[held]
        self.most = np.ascontiguousarray(self.dense.max(axis=2, initial=0).T)

    def groups(self, start: np.ndarray, terms: np.ndarray, queries: int = 256, postings: int = 1 << 25) -> Iterator[tuple[int, int]]:
        """Runs of queries (from, to) for one call of ``nearest`` each: so many, with about so many short postings.

        ``start`` has where the terms of each query begin, and where the last ends.
        """
        read = np.r_[0, np.cumsum(np.where(self.row[terms] < 0, self.length[terms], 0))][start]
        a, n = 0, len(start) - 1
        while a < n:
            b = min(n, a + queries, max(a + 1, int(np.searchsorted(read, read[a] + postings, side="right")) - 1))
            yield a, b
            a = b

    def _short(self, of: np.ndarray, terms: np.ndarray, q: np.ndarray, queries: int) -> np.ndarray:
        """What short lists give to each query (rows) and example; so few queries at once that their postings stay in the cache."""
        width = self.blocks * self.block
        out = np.empty((queries, width))
        start = np.searchsorted(of, np.arange(queries + 1))
        length = self.length[terms]
        for a, b in self.groups(start, terms, queries, 1 << 16):
            some = slice(start[a], start[b])
            at = _ranges(self.offset[terms[some]], length[some])
            where = np.repeat((of[some] - a) * width, length[some])
            where += self.example[at]
            given = np.repeat(q[some].astype(np.float32), length[some])
            given *= self.value[at]
            out[a:b] = np.bincount(where, weights=given, minlength=(b - a) * width).reshape(b - a, width)
        return out

    def nearest(self, of: np.ndarray, terms: np.ndarray, q: np.ndarray, queries: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (examples, cosines) of the k largest cosines above 0, nearest first; ties go to the smaller number.

        ``of``, ``terms`` and ``q`` are the queries' terms and weights.
        """
        row = self.row[terms]
        long = row >= 0
        exact = self._short(of[~long], terms[~long], q[~long], queries)
        score = exact.reshape(queries, self.blocks, self.block)
        dense = np.zeros((queries, len(self.most)), np.float32)
        dense[of[long], row[long]] = q[long]
        bound = score.max(axis=2, initial=0) + dense @ self.most + 1e-5
        first = np.argsort(-bound, axis=1, kind="stable")[:, : FIRST + k // self.block]
        seen = np.zeros((queries, self.blocks), bool)
        np.put_along_axis(seen, first, True, axis=1)
        self._add(score, dense, seen)
        tried = np.take_along_axis(score, first[:, :, None], axis=1).reshape(queries, -1)
        last = max(0, tried.shape[1] - k)
        least = np.partition(tried, last, axis=1)[:, last] if last else np.zeros(queries)
        more = (bound >= least[:, None]) & ~seen
        self._add(score, dense, more)
        score[~(seen | more)] = 0
        query, where = np.nonzero(exact >= np.maximum(least - 2e-6, 1e-6)[:, None])
        found = np.round(exact[query, where], 6)
        best = np.lexsort((where, -found, query))
        start = np.searchsorted(query, np.arange(queries + 1))
        return [(where[best[a:b][:k]], found[best[a:b][:k]]) for a, b in zip(start, start[1:], strict=False)]

    def _add(self, score: np.ndarray, dense: np.ndarray, wanted: np.ndarray) -> None:
        """Add what long lists give to the wanted blocks of each query."""
        for b in np.flatnonzero(wanted.any(axis=0)):
            some = np.flatnonzero(wanted[:, b])
            score[some, b] += dense[some] @ self.dense[b]


def postings(examples: int, of: np.ndarray, terms: np.ndarray, value: np.ndarray, n_terms: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """What an Index is made of: (n, offset, example, value), from the unit vectors of examples."""
    order = np.argsort(terms, kind="stable")
    offset = np.r_[0, np.cumsum(np.bincount(terms, minlength=n_terms))]
    return examples, offset, of[order].astype(np.int32), value[order].astype(np.float32)


@dataclass
class Model:
    """What is broadcast: terms with their weights, postings, and the examples' ids and classes."""

    terms: bytes
    weight: np.ndarray
    n: int
    offset: np.ndarray
    example: np.ndarray
    value: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    rate: float
    slope: float = 1.0
    shift: float = 0.0
    nearest: int = NEAREST
    #: The broadcast of this model, once there is one.
    shared: Broadcast | None = None

    def ready(self) -> tuple[Terms, Index]:
        """The tables that a worker builds once."""
        if not hasattr(self, "_ready"):
            self._ready = Terms(self.terms.split(b"\n") if self.terms else []), Index(self.n, self.offset, self.example, self.value)
        return self._ready

    def votes(self, texts: Iterable[bytes]) -> list[tuple[float, list[int]]]:
        """Log odds of the weighted vote, and the ids of the nearest examples, for each text."""
        terms, index = self.ready()
        out = []
        for some in parts(texts, 2 << 20) if self.n else ():
            of, at, count = terms.counts(some)
            q = unit(of, count, self.weight[at])
            start = np.searchsorted(of, np.arange(len(some) + 1))
            for a, b in index.groups(start, at):
                part = slice(start[a], start[b])
                for near, cosine in index.nearest(of[part] - a, at[part], q[part], b - a, self.nearest):
                    w = cosine**CLOSENESS
                    out.append((self.odds(float((w * self.toxic[near]).sum()), float(w.sum())), self.ids[near].tolist()))
        return out if self.n else [(self.odds(0.0, 0.0), []) for _ in texts]

    def odds(self, toxic: float, every: float) -> float:
        p = min(max((toxic + SHRINK * self.rate) / (every + SHRINK), 1e-6), 1 - 1e-6)
        return math.log(p / (1 - p))

    def scores(self, texts: list[bytes]) -> list[tuple[float, list[int]]]:
        return [(1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * z + self.shift)))), near) for z, near in self.votes(texts)]


def unit(of: np.ndarray, count: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of texts' terms, each text at unit length."""
    raw = (1 + np.log(count)) * weight
    return raw / np.sqrt(np.bincount(of, weights=raw * raw))[of] if len(of) else raw


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (at least 0) and shift of a logistic calibration with the usual smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - target) * z).sum() + 1e-3 * (a - 1), (p - target).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = max(0.0, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(a), float(b)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) rows to (term, n_toxic, n_clean) of this task."""
    give_back()
    counts = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(one_by_one(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            counts[toxic].update({t for w in set(plain_words(text)) for t in word_terms(w)})
    terms = list(counts[0].keys() | counts[1].keys())
    for a in range(0, len(terms), 50_000):
        part = terms[a : a + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.binary()), pa.array([counts[1][t] for t in part]), pa.array([counts[0][t] for t in part])],
            names=["term", "n_toxic", "n_clean"],
        )


def _frequencies(terms: bytes):
    """Documents to (term, df) of this task; term -1 counts the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        known, n = Terms(terms.split(b"\n")), 0
        df = np.zeros(len(known.known), np.int64)
        for batch in batches:
            n += batch.num_rows
            for texts in parts(one_by_one(batch.column(0))):
                df += np.bincount(known.counts(texts)[1], minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some].astype(np.int32)), pa.array(np.r_[n, df[some]])], names=["term", "df"])

    return run


def _vectors(terms: bytes):
    """Examples to their term counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        known = Terms(terms.split(b"\n"))
        for batch in batches:
            at = 0
            for texts in parts(one_by_one(batch.column("text"))):
                of, term, count = known.counts(texts)
                stop = pa.array(np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(stop, pa.array(x.astype(np.int32))) for x in (term, count)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), batch.column("toxic").slice(at, len(texts)), *lists], names=["doc_id", "toxic", "terms", "counts"])
                at += len(texts)

    return run


def _votes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            z = [z for z, _ in shared.value.votes(one_by_one(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.float64()), batch.column("toxic")], names=["z", "toxic"])

    return run


def resembling(n: int, of: np.ndarray, terms: np.ndarray, value: np.ndarray, n_terms: int) -> np.ndarray:
    """A place for each example, such that those nearest to the same of about sqrt(n) seeds stand together."""
    seeds = np.unique(np.linspace(0, n - 1, math.isqrt(n)).astype(int))
    stop = np.searchsorted(of, np.arange(n + 1))
    nearest, cosine = np.zeros(n, np.int64), np.full(n, -1.0)
    for s in seeds:
        part = slice(stop[s], stop[s + 1])
        seed = np.zeros(n_terms)
        seed[terms[part]] = value[part]
        c = np.bincount(of, weights=value * seed[terms], minlength=n).round(6)
        nearer = c > cosine
        nearest[nearer], cosine[nearer] = s, c[nearer]
    place = np.empty(n, np.int64)
    place[np.lexsort((np.arange(n), -cosine, nearest))] = np.arange(n)
    return place


def labelled(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", examples: int = EXAMPLES) -> DataFrame:
    """(doc_id, toxic, fold): at most ``examples`` rows of each class and use, those with the smallest hash of the id.

    Only rows that are not held out. Null labels and ids are left out; an id that is labelled twice counts as toxic if either
    label says so.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg((F.max(label_col) > 0).cast("int").alias("toxic"))
    rows = rows.select("doc_id", "toxic", F.expr(FOLD.format("doc_id")).cast("int").alias("fold")).where("fold > 0")
    picks = [
        rows.where((F.col("toxic") == toxic) & (F.col("fold") == 1 if calibrate else F.col("fold") > 1)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
        for toxic in (0, 1)
        for calibrate in (True, False)
    ]
    out = picks[0]
    for p in picks[1:]:
        out = out.union(p)
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES, nearest: int = NEAREST) -> Model:
    """Index a bounded labelled sample by all its terms, with document frequencies from all of ``docs``."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chosen = materialize(labelled(labels, id_col, label_col, examples))
    sample = materialize(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "fold", "toxic", "text"))
    firsts = sample.groupBy(F.xxhash64("text").alias("h"), "toxic", (F.col("fold") == 1).alias("c")).agg(F.min("doc_id").alias("doc_id"))
    sample = sample.join(F.broadcast(materialize(firsts.select("doc_id"))), "doc_id", "left_semi")  # copies say nothing new
    totals = {r.toxic: r.n for r in sample.where("fold > 1").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    rate = _rate(labels, id_col, label_col)
    none = np.zeros(0)
    if not n1 or not n0:
        return Model(b"", none, 0, np.zeros(1, np.int64), none.astype(int), none, none, none, rate, nearest=nearest)
    found = (
        sample.where("fold > 1").select("text", "toxic").mapInArrow(_term_counts, "term binary, n_toxic long, n_clean long")
        .groupBy("term").agg(F.sum("n_toxic").alias("a"), F.sum("n_clean").alias("b")).toArrow().sort_by("term")
    )
    terms = b"\n".join(found["term"].to_pylist())
    a, b = (found[c].to_numpy().astype(float) for c in ("a", "b"))
    n = n1 + n0
    every = a + b
    chi = np.where(every < n, (a * (n0 - b) - b * (n1 - a)) ** 2 * n / (every * np.maximum(n - every, 1) * n1 * n0), 0.0)
    counted = texts.select("text").mapInArrow(_frequencies(terms), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(a) + 1)
    df[counted["term"].to_numpy()] = counted["df"].to_numpy()  # the last place, -1, is the number of documents
    weight = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1) * np.sqrt(1 + chi)
    rows = sample.where("fold > 1").mapInArrow(_vectors(terms), "doc_id long, toxic int, terms array<int>, counts array<int>").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("toxic", "ascending")]).combine_chunks()
    at, count = (pc.list_flatten(rows[c]).to_numpy() for c in ("terms", "counts"))
    of = np.repeat(np.arange(len(rows), dtype=np.int32), pc.list_value_length(rows["terms"]).to_numpy())
    value = unit(of, count, weight[at]).astype(np.float32)
    place = resembling(len(rows), of, at, value, len(a))
    model = Model(terms, weight, *postings(len(rows), place[of], at, value, len(a)), *(rows[c].to_numpy()[np.argsort(place)] for c in ("doc_id", "toxic")), rate, nearest=nearest)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    model.shared = shared  # what is fitted below is small and goes beside it, so that no task holds two copies
    checked = sample.where("fold = 1").select("text", "toxic").mapInArrow(_votes(shared), "z double, toxic int").toArrow()
    z, y = checked["z"].to_numpy(), checked["toxic"].to_numpy()
    by = np.lexsort((y, z))
    model.slope, model.shift = platt(z[by], y[by])
    return model


def _rate(labels: DataFrame, id_col: str, label_col: str) -> float:
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.expr(FOLD.format(f"`{id_col}`") + " > 0"))
    n, toxic = known.agg(F.count("*"), F.sum((F.col(label_col) > 0).cast("int"))).first()
    return ((toxic or 0) + 0.5) / (n + 2)


def score_column(model: Model, docs: DataFrame, text_col: str = "text") -> F.Column:
    """struct (score, evidence) for a text column: the calibrated probability and the ids of the nearest examples.

    A null or empty text, and one without any word of the examples, has no neighbours and gets the calibrated rate. A very long text is one
    vector like any other; equal texts get equal scores.
    """
    shared = model.shared or docs.sparkSession.sparkContext.broadcast(model)
    slope, shift = model.slope, model.shift

    @F.arrow_udf("struct<score:double,evidence:array<long>>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        give_back()
        m, known = shared.value, {}
        m.slope, m.shift = slope, shift
        kind = pa.struct([("score", pa.float64()), ("evidence", pa.list_(pa.int64()))])
        for batch in batches:
            found = []
            for at in range(0, len(batch), 1024):
                texts = utf8(batch.slice(at, 1024))
                keys = [xxhash.xxh3_128_digest(t) for t in texts]
                new = {k: t for k, t in zip(keys, texts, strict=True) if k not in known}
                fresh = {k: {"score": p, "evidence": near} for k, (p, near) in zip(new, m.scores(list(new.values())), strict=True)}
                found.append(pa.array([fresh.get(k) or known[k] for k in keys], type=kind))
                if len(known) + len(fresh) > 20_000:
                    known.clear()
                known |= fresh
            give_back()
            yield pa.concat_arrays(found) if found else pa.array([], kind)

    return score(F.col(text_col))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, evidence) for every row; repeated rows and null ids are scored like any other.

    Without labels of both classes every row gets the smoothed rate of toxic labels, 0.25 without any. An empty table gives an
    empty result. Other columns are not read, whatever their names.
    """
    model = fit(docs, labels, id_col, text_col)
    found = docs.select(F.col(id_col).alias("doc_id"), score_column(model, docs, text_col).alias("s"))
    return found.select("doc_id", "s.score", "s.evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", at: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``at``.

    Null texts, null ids and repeated rows are judged by their text like any other. Without labels of both classes all rows
    stay, as the rate is below ``at`` unless most labels are toxic; an empty table stays empty.
    """
    model = fit(docs, labels, text_col=text_col)
    name = unused(docs, "score")
    scored = docs.select("*", score_column(model, docs, text_col)["score"].alias(name))
    return scored.where(F.col(name) < at).drop(name)

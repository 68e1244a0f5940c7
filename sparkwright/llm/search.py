"""Ranked lexical search by Block-Max MaxScore over segments of an inverted index.

A task indexes its documents in segments: for each term, blocks of 128 postings (number in the segment, frequency), packed in
bytes, each with its largest frequency and its shortest document. Counts over all documents come from the segments and fix
the weights. A segment is then searched by itself for each item. Terms are ordered by their largest possible score there;
those whose sum stays below the worst of the best ``k`` so far are not essential: a document that holds no other term can't
rank. Documents of the essential lists are candidates; the bounds of the blocks in which they would stand on the other lists
reject most of them before those blocks are unpacked. The heaps of the segments are merged in two steps.

Scores are whole numbers, so the result doesn't depend on segments. Ties of the k-th score are kept until ids decide them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.llm.text import plain_words, utf8
from sparkwright.sources.scratch import discard, materialize


@dataclass(frozen=True)
class Sizes:
    """Bounds of what is in memory at once; no result depends on them."""

    #: Postings of a block; documents and matches of a segment; documents whose candidates are weighed at once.
    block: int = 128
    segment_docs: int = 16_384
    segment_matches: int = 3_000_000
    window: int = 2048
    #: Unpacked blocks that a search keeps for the next items.
    kept_blocks: int = 8192
    #: Bytes of the items' distinct terms up to which only these terms are indexed; bytes of items that are searched at once.
    vocabulary_bytes: int = 16 << 20
    item_bytes: int = 4 << 20


SIZES = Sizes()
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DOC_BITS = 20
DIRECTORY = np.dtype([("first", "<i4"), ("last", "<i4"), ("count", "<i4"), ("max_tf", "<i8"), ("min_n", "<i8"), ("at", "<i8"), ("gap_bytes", "<i1"), ("tf_bytes", "<i1")])
INDEX = "segment long, n_docs long, n_tokens long, doc_ids array<long>, lengths binary, terms array<string>, dfs array<int>, blocks binary, postings binary"
_INDEX_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary())
_INDEX_NAMES = [part.split()[0] for part in INDEX.split(", ")]


class Codes(dict):
    """term -> number from 1, given when first asked for."""

    def __missing__(self, term: bytes) -> int:
        found = self[term] = len(self) + 1
        return found


def _widths(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


def packed(terms: np.ndarray, docs: np.ndarray, tfs: np.ndarray, lengths: np.ndarray, size: int = SIZES.block) -> tuple[np.ndarray, bytes]:
    """Directory and bytes of postings in order of term and document."""
    n = len(terms)
    if not n:
        return np.zeros(0, DIRECTORY), b""
    new = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
    within = np.arange(n) - np.repeat(new, np.diff(np.r_[new, n]))
    starts = np.flatnonzero(within % size == 0)
    counts = np.diff(np.r_[starts, n])
    block = np.repeat(np.arange(len(starts)), counts)
    inside = np.arange(n) - starts[block]
    gaps = np.where(inside == 0, 0, docs - np.r_[0, docs[:-1]])
    out = np.zeros(len(starts), DIRECTORY)
    out["first"], out["last"], out["count"] = docs[starts], docs[starts + counts - 1], counts
    out["max_tf"], out["min_n"] = np.maximum.reduceat(tfs, starts), np.minimum.reduceat(lengths[docs], starts)
    out["gap_bytes"], out["tf_bytes"] = _widths(np.maximum.reduceat(gaps, starts)), _widths(out["max_tf"])
    sizes = counts * (out["gap_bytes"].astype(np.int64) + out["tf_bytes"])
    out["at"] = np.cumsum(sizes) - sizes
    body = np.zeros(int(sizes.sum()), np.uint8)
    for values, width, base in ((gaps, out["gap_bytes"], out["at"]), (tfs, out["tf_bytes"], out["at"] + counts * out["gap_bytes"].astype(np.int64))):
        for w in (1, 2, 4):
            chosen = width[block] == w
            place = base[block[chosen]] + inside[chosen] * w
            for byte in range(w):
                body[place + byte] = values[chosen] >> 8 * byte & 255
    return out, body.tobytes()


def _indexed(vocabulary, sizes: Sizes):
    """Rows of INDEX from rows (doc_id, text); with a vocabulary only its terms have postings, but all count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes() if vocabulary is None else {t: i + 1 for i, t in enumerate(vocabulary.value)}
        get = codes.__getitem__ if vocabulary is None else codes.get
        segment = TaskContext.get().partitionId() << 33
        ids: list[int | None] = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []
        matches = 0

        def flush() -> pa.RecordBatch:
            nonlocal segment, matches
            names = list(codes)
            keys, tfs = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True)
            terms, docs, long = keys >> DOC_BITS, keys & (1 << DOC_BITS) - 1, np.array(lengths, np.int64)
            blocks, postings = packed(terms, docs, tfs.astype(np.int64), long, sizes.block)
            found, dfs = np.unique(terms, return_counts=True)
            row = (segment, int((long > 0).sum()), int(long.sum()), list(ids), long.astype("<i8").tobytes(), [names[t - 1].decode() for t in found], dfs.astype(np.int32), blocks.tobytes(), postings)
            segment, matches = segment + 1, 0
            for x in (ids, lengths, parts):
                x.clear()
            if vocabulary is None:
                codes.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _INDEX_KINDS, strict=True)], names=_INDEX_NAMES)

        for batch in (whole.slice(a, 500) for whole in batches for a in range(0, whole.num_rows, 500)):
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                words = plain_words(text)
                found = np.array([*filter(None, map(get, words))], np.int64)
                parts.append(found << DOC_BITS | len(ids))
                ids.append(doc)
                lengths.append(len(words))
                matches += len(found)
                if len(ids) >= sizes.segment_docs or matches >= sizes.segment_matches:
                    yield flush()
        if ids:
            yield flush()

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary=None, sizes: Sizes = SIZES) -> DataFrame:
    """Segments of the inverted index of every row, by INDEX; all terms, or those of a broadcast list of UTF-8 terms.

    A null or empty text is a document without terms. Repeated rows and null ids are documents of their own.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_indexed(vocabulary, sizes), INDEX)


class Segment:
    """A segment with the scores that its blocks allow, given all documents' number and length."""

    def __init__(self, row: dict, total_docs: int, total_tokens: int, sizes: Sizes = SIZES) -> None:
        self.ids, self.sizes = row["doc_ids"], sizes
        lengths = np.frombuffer(row["lengths"], "<i8")
        self.norm = lambda n: 50 + (50 * n * total_docs) // total_tokens
        self.norms = self.norm(lengths)
        self.blocks = np.frombuffer(row["blocks"], DIRECTORY)
        self.postings = row["postings"]
        dfs = np.array(row["dfs"], np.int64)
        spans = -(-dfs // sizes.block)
        self.lists = {t: (int(e - n), int(e)) for t, e, n in zip(row["terms"], np.cumsum(spans), spans, strict=True)}
        self.bounds = self.impact(self.blocks["max_tf"], self.norm(self.blocks["min_n"])) if len(self.blocks) else np.zeros(0, np.int64)
        self.first, self.last = self.blocks["first"].astype(np.int64), self.blocks["last"].astype(np.int64)
        self.unpacked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        #: Lets ids decide ties: position of each document in order of id, null last.
        self.order = np.empty(len(self.ids), np.int64)
        self.order[sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))] = np.arange(len(self.ids))

    @staticmethod
    def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * tf) // (1000 * tf + 20 * norm)

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and their scores at weight 1 of a block, unpacked."""
        if b not in self.unpacked:
            if len(self.unpacked) >= self.sizes.kept_blocks:
                self.unpacked.clear()
            of = self.blocks[b]
            count, at, gap, tf = int(of["count"]), int(of["at"]), int(of["gap_bytes"]), int(of["tf_bytes"])
            docs = int(of["first"]) + np.cumsum(np.frombuffer(self.postings, f"<u{gap}", count, at), dtype=np.int64)
            tfs = np.frombuffer(self.postings, f"<u{tf}", count, at + count * gap).astype(np.int64)
            self.unpacked[b] = docs, self.impact(tfs, self.norms[docs])
        return self.unpacked[b]

    def top(self, weights: list[tuple[str, int]], k: int) -> list[tuple[int | None, int]]:
        """(id, score) of the k best documents with a score, ties by id."""
        lists = [(w * int(self.bounds[s:e].max()), w, s, e) for w, (s, e) in ((w, self.lists[t]) for t, w in weights if t in self.lists) if w > 0]
        lists.sort()
        below = np.cumsum([x[0] for x in lists])
        best_docs, best, least, essential = np.zeros(0, np.int64), np.zeros(0, np.int64), 1, 0
        window = self.sizes.window
        for low in range(0, len(self.ids), window):
            while essential < len(lists) and below[essential] < least:
                essential += 1
            if essential == len(lists):
                break
            sums = np.zeros(window, np.int64)
            for _, w, s, e in lists[essential:]:
                a, z = s + np.searchsorted(self.last[s:e], low), s + np.searchsorted(self.first[s:e], low + window)
                for b in range(int(a), int(z)):
                    docs, impacts = self.block(b)
                    i, j = np.searchsorted(docs, (low, low + window)) if b in (a, z - 1) else (0, len(docs))
                    sums[docs[i:j] - low] += w * impacts[i:j]
            at = np.flatnonzero(sums)
            docs, sums = at + low, sums[at]
            held = []  # (list, its block and bound for each candidate), the largest list last
            for _, w, s, e in lists[:essential]:
                b = s + np.searchsorted(self.last[s:e], docs)
                here = np.where(b < e, b, s)
                held.append([w, np.where((b < e) & (self.first[here] <= docs), here, -1)])
            bounds = [np.where(b >= 0, w * self.bounds[b], 0) for w, b in held]
            most = sums + sum(bounds) if bounds else sums
            for (w, b), bound in zip(reversed(held), reversed(bounds), strict=True):
                keep = np.flatnonzero((most >= least) & (bound > 0))
                for one in np.unique(b[keep]):
                    mine = keep[b[keep] == one]
                    found, impacts = self.block(int(one))
                    place = np.minimum(np.searchsorted(found, docs[mine]), len(found) - 1)
                    exact = np.where(found[place] == docs[mine], w * impacts[place], 0)
                    most[mine] += exact - bound[mine]
            keep = most >= least
            best_docs, best = np.r_[best_docs, docs[keep]], np.r_[best, most[keep]]
            if len(best) > k:
                chosen = np.lexsort((self.order[best_docs], -best))[:k]
                best_docs, best = best_docs[chosen], best[chosen]
            if len(best) == k:
                least = max(least, int(best.min()))
        return [(self.ids[d], int(x)) for d, x in zip(best_docs, best, strict=True)]


def _found(shared, total_docs: int, total_tokens: int, k: int, sizes: Sizes):
    kinds = pa.schema([("segment", pa.int64()), ("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 1) for whole in batches for i in range(whole.num_rows)):
            row = batch.to_pylist()[0]
            segment = Segment(row, total_docs, total_tokens, sizes)
            out = [(row["segment"], item, doc, score) for item, weights in shared.value for doc, score in segment.top(weights, k)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)

    return run


def _best(heaps: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def merged(heaps: DataFrame, k: int) -> DataFrame:
    """The k best of each item, first of groups of segments, then of all; each step keeps k rows a group where they are."""
    some = _best(heaps.withColumn("group", F.expr("pmod(hash(segment), 64)")), k, "item", "group")
    return _best(some.select("item", "doc_id", "score"), k, "item")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", sizes: Sizes = SIZES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0, ties by smaller id, null last.

    Terms count once an item. Null texts have no terms, so such items find nothing. Repeated rows of items are ranked each for
    itself; repeated rows of documents are ranked side by side. Items of any number are searched in blocks of bounded size;
    where their terms exceed ``vocabulary_bytes``, all terms of the documents are indexed instead. Empty tables give no rows.
    """
    spark = docs.sparkSession
    terms = F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(F.col(item_text_col), F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0)))
    asked = materialize(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), terms.alias("terms")))
    wanted = materialize(asked.select(F.explode("terms").alias("term")).distinct())
    size = wanted.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    bounded = size <= sizes.vocabulary_bytes
    vocabulary = spark.sparkContext.broadcast([t.encode() for t in wanted.toArrow()["term"].to_pylist()]) if bounded else None
    index = materialize(build_index(docs, id_col, text_col, vocabulary, sizes))
    total_docs, total_tokens = index.agg(F.sum("n_docs"), F.sum("n_tokens")).first()
    total_docs, total_tokens = total_docs or 0, total_tokens or 1
    counts = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.dfs").alias("n"))
    counts = (counts if bounded else counts.join(wanted, "term", "left_semi")).groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * total_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    exploded = asked.select("item", F.explode("terms").alias("term")).join(F.broadcast(counts) if bounded else counts, "term")
    weighted = materialize(exploded.groupBy("item").agg(F.collect_list(F.struct("term", weight.alias("w"))).alias("weights")))
    parts = 1 + (weighted.agg(F.sum(F.expr("aggregate(weights, 0L, (a, x) -> a + octet_length(x.term) + 16)"))).first()[0] or 0) // sizes.item_bytes
    done = None
    for part in range(parts):
        block = weighted.where(F.expr(f"pmod(hash(item), {parts}) = {part}"))
        shared = spark.sparkContext.broadcast([(r.item, [(x.term, x.w) for x in r.weights]) for r in block.toLocalIterator()])
        found = merged(index.mapInArrow(_found(shared, total_docs, total_tokens, k, sizes), "segment long, item long, doc_id long, score long"), k)
        found = materialize(found.select("item", "rank", "doc_id", "score"))
        done = found if done is None else done.union(found)
    for table in (index, wanted, weighted):
        discard(table)
    return done.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")

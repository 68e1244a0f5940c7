"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are all windows of 13 consecutive words of the benchmark's items (a shorter item is one window). Patterns of one
length m are searched together: blocks are two adjacent words, a shift table says how far a window may move when it ends in a
block (m - 1 words for a block in no pattern), and a block that ends patterns leads to the bucket of those patterns, which
are compared with the text. Most positions are skipped unread, and no pair of document and item is ever made.

The patterns go to the tasks as a broadcast of about ``bound`` bytes of benchmark text, compiled once in a worker. A larger
benchmark is searched in that many parts, one after another: each part's hits are written, and then united by an equality
join on the rows' numbers. So neither driver nor task ever holds more than a part, and none is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm.text import give_back, plain_words, unused, utf8
from sparkwright.sources.scratch import materialize

WINDOW = 13
#: Bytes of benchmark text whose patterns are held at once, a larger item aside; the patterns take some fifty times as much.
BOUND = 4 << 20


class Patterns:
    """Shift tables and buckets for windows of the same number of words."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.block = min(2, size)
        self.most = size - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], set[int]]] = {}

    def add(self, words: tuple[bytes, ...], item: int) -> None:
        for end in range(self.block, self.size + 1):
            block = words[end - self.block : end]
            self.shift[block] = min(self.shift.get(block, self.most), self.size - end)
        self.bucket.setdefault(words[-self.block :], {}).setdefault(words, set()).add(item)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        """(start, items) of every occurrence, from left to right."""
        size, step, most, shift, bucket = self.size, self.block, self.most, self.shift.get, self.bucket
        at, n = size, len(words)
        while at <= n:
            block = tuple(words[at - step : at])
            move = shift(block, most)
            if move:
                at += move
                continue
            items = bucket[block].get(tuple(words[at - size : at]))
            if items:
                yield at - size, items
            at += 1


def compiled(items: Iterable[tuple[int, str | None]], window: int = WINDOW) -> list[Patterns]:
    by_size: dict[int, Patterns] = {}
    for item, text in items:
        words = plain_words((text or "").encode())
        size = min(window, len(words))
        for start in range(len(words) - size + 1 if size else 0):
            by_size.setdefault(size, Patterns(size)).add(tuple(words[start : start + size]), item)
    return [by_size[k] for k in sorted(by_size)]


def hits(words: list[bytes], patterns: list[Patterns]) -> tuple[list[tuple[int, int]], set[int]]:
    """Disjoint [start, end) runs of words that occurrences cover, and the items that occur."""
    runs, items = [], set()
    for p in patterns:
        for start, found in p.search(words):
            runs.append((start, start + p.size))
            items |= found
    return united(runs), items


def united(runs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


FOUND = "struct<n_words:long,runs:array<struct<s:int,e:int>>,items:array<long>>"
RUNS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
KIND = pa.struct([("n_words", pa.int64()), ("runs", RUNS), ("items", pa.list_(pa.int64()))])


class Part:
    """A part of the benchmark; its patterns are compiled where they are first used and stay there."""

    def __init__(self, items: list[tuple[int, str | None]], window: int) -> None:
        self.items, self.window = items, window

    def patterns(self) -> list[Patterns]:
        if not hasattr(self, "_patterns"):
            self._patterns = compiled(self.items, self.window)
        return self._patterns

    def __getstate__(self) -> dict:
        return {"items": self.items, "window": self.window}


def _search(spark: SparkSession, items: list[tuple[int, str | None]], window: int):
    """A function from a text column to FOUND for these items, and what to free when it is done."""
    shared = spark.sparkContext.broadcast(Part(items, window))

    @F.arrow_udf(FOUND)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        give_back()
        patterns = shared.value.patterns()
        for batch in batches:
            rows = []
            for text in utf8(batch):
                words = plain_words(text)
                runs, found = hits(words, patterns)
                rows.append({"n_words": len(words), "runs": [{"s": s, "e": e} for s, e in runs], "items": sorted(found)})
            yield pa.array(rows, type=KIND)

    return search, shared


def _united(runs: F.Column) -> F.Column:
    @F.arrow_udf("array<struct<s:int,e:int>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([[{"s": s, "e": e} for s, e in united((r["s"], r["e"]) for r in runs)] for runs in batch.to_pylist()], type=RUNS)

    return of(runs)


def _counted(text: F.Column) -> F.Column:
    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([len(plain_words(t)) for t in utf8(batch)], pa.int64())

    return of(text)


def with_contamination(docs: DataFrame, benchmark: DataFrame, name: str = "found", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, bound: int = BOUND) -> DataFrame:
    """``docs`` with one more column: struct (n_words, runs, items) with the hit runs of words and the items that occur.

    A null or empty text has no words and no hits; a very long text is searched whole. Repeated items count once; items without an id are left out, items
    without words have no window. Repeated rows and null ids stay rows of their own. An empty benchmark hits nothing, an empty
    table gives an empty result. ``name`` must be no column of ``docs``; other names don't matter.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // bound))
    if n == 1:
        search, _ = _search(spark, sorted((r.i, r.t or "") for r in items.collect()), window)
        return docs.select("*", search(F.col(text_col)).alias(name))
    items = materialize(items.select("i", "t", F.pmod(F.xxhash64("i", "t"), F.lit(n)).cast("int").alias("part")))
    uid = unused(docs, "uid")
    rows = materialize(docs.select("*", F.monotonically_increasing_id().alias(uid)))
    hit = []
    for part in range(n):
        search, shared = _search(spark, sorted((r.i, r.t or "") for r in items.where(F.col("part") == part).collect()), window)
        found = rows.select(F.col(uid).alias("uid"), search(F.col(text_col)).alias("f")).where(F.size("f.items") > 0)
        hit.append(materialize(found.select("uid", "f.runs", "f.items")))
        shared.unpersist()
    every = hit[0]
    for h in hit[1:]:
        every = every.union(h)
    one = every.groupBy("uid").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    one = one.select(F.col("uid").alias(uid), F.struct(_united(F.col("runs")).alias("runs"), "items").alias(name))
    of = lambda field, kind: F.coalesce(F.col(name)[field], F.array().cast(kind)).alias(field)
    joined = rows.join(one, uid, "left")
    found = F.struct(_counted(F.col(text_col)).alias("n_words"), of("runs", "array<struct<s:int,e:int>>"), of("items", "array<bigint>"))
    return joined.select(*docs.columns, found.alias(name))


def n_hit(found: F.Column) -> F.Column:
    return F.aggregate(found["runs"], F.lit(0).cast("long"), lambda n, r: n + (r["e"] - r["s"]).cast("long"))


def is_contaminated(found: F.Column) -> F.Column:
    """Hit words are at least a twentieth of all."""
    hit = n_hit(found)
    return (hit > 0) & (20 * hit >= found["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated.

    Null and empty texts stay, repeated rows are judged each for itself; with an empty benchmark all rows stay.
    """
    name = unused(docs, "found")
    found = with_contamination(docs, benchmark, name, text_col)
    return found.where(~is_contaminated(F.col(name))).drop(name)


def items_digest(items: Iterable[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()

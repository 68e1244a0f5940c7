"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Fingerprints that differ in at most three bits differ in at most
one bit in one of the segments (pigeonhole), so both have that segment's variant with this bit wiped out. Each distinct
fingerprint is indexed under its 2 x 32 one-wildcard variants; an equality shuffle brings those with a common variant
together, and the whole fingerprints are compared. Linked fingerprints become components.

Skew: exact copies share one fingerprint and are collapsed by partial aggregation before anything is indexed. A variant that
more than ``block`` distinct fingerprints share is cut into blocks, and pairs of blocks are compared by different tasks.
Links come out as spanning trees of such groups, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.functions.components import connected_components
from sparkwright.llm.text import give_back, spaced_words, unused, utf8
from sparkwright.sources.scratch import materialize

SEED = 42
BITS = 64
SEGMENT = 32
DISTANCE = 3


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of word shingles: a bit is 1 if it is set in over half of the shingles' XXH64 values."""
    words = spaced_words(text)
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for part in np.array_split(hashes, max(1, len(hashes) // 4096)):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text: F.Column, shingle: int = 3) -> F.Column:
    """The signed 64-bit fingerprint of a text column. A null text counts as empty and has fingerprint 0."""

    @F.arrow_udf("long")
    def fp(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        give_back()
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in utf8(batch)], dtype=np.uint64)
            yield pa.array(values.view(np.int64))

    return fp(text)


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row."""
    return docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col), shingle).alias("fp"))


def indexed(fps: DataFrame) -> DataFrame:
    """(seg, bit, rest, fp): 64 rows for each distinct fingerprint."""
    return fps.select("fp", F.explode(F.expr(f"sequence(0, {BITS - 1})")).alias("slot")).select(
        F.expr(
            "cast((shiftrightunsigned(fp, if(slot < 32, 0, 32)) & 4294967295L) & ~shiftleft(1L, slot % 32) as bigint)"
            " | shiftleft(cast(slot as bigint), 32)"
        ).alias("key"),
        "fp",
    )


def _canonical(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """True for linked pairs in the first key that they share, so that a pair comes out once."""
    diff = a ^ b
    near = np.bitwise_count(diff) <= DISTANCE
    low = diff & np.uint64(0xFFFFFFFF)
    high = diff >> np.uint64(32)
    first = np.where(np.bitwise_count(low) <= 1, low, high)
    slot = np.where(np.bitwise_count(low) <= 1, 0, 32) + np.where(first == 0, 0, np.bitwise_count(first - np.uint64(1)))
    return near & (slot == (key >> np.uint64(32)).astype(np.int64))


def spanning_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links at most DISTANCE bits long that join what such links can join: a forest, breadth first."""
    left, src, dst = fps, [], []
    while len(left) > 1:
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            some, frontier = frontier[:64], frontier[64:]
            near = np.bitwise_count(some[:, None] ^ left[None, :]) <= DISTANCE
            hit = near.any(axis=0)
            if hit.any():
                src.append(some[near[:, hit].argmax(axis=0)])
                dst.append(left[hit])
                frontier = np.concatenate([frontier, left[hit]])
                left = left[~hit]
    none = np.empty(0, dtype=np.uint64)
    return np.concatenate([none, *src]), np.concatenate([none, *dst])


LINKS = "src long, dst long, hot long"


def _rows(src: np.ndarray, dst: np.ndarray, hot: np.ndarray | None = None) -> pa.RecordBatch:
    hot = pa.nulls(len(src), pa.int64()) if hot is None else pa.array(hot.view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64)), hot], names=["src", "dst", "hot"])


def _link_groups(block: int, small: int = 32):
    """A task's sorted (key, fp) rows to links. A group of over ``block`` rows comes out as it is, with ``hot`` = key."""

    def closed(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[start, len(key)])
        of = np.repeat(sizes, sizes)
        keep = (of > 1) & (of <= small)
        k, f = key[keep], fp[keep]
        for d in range(1, int(of[keep].max(initial=1))):
            same = k[d:] == k[:-d]
            a, b, kk = f[:-d][same], f[d:][same], k[d:][same]
            ok = _canonical(kk, a, b)
            if ok.any():
                yield _rows(a[ok], b[ok])
        for i in np.flatnonzero(sizes > small):
            yield _rows(*spanning_links(fp[start[i] : start[i] + sizes[i]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, hot = np.empty(0, np.uint64), np.empty(0, np.uint64), None
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)])
            fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(key):
                continue
            if hot is not None:  # the rest of a group that is already known as hot
                n = int(np.searchsorted(key != hot, True)) if key[0] == hot else 0
                if n:
                    yield _rows(fp[:n], fp[:n], key[:n])
                    key, fp = key[n:], fp[n:]
                    if not len(key):
                        continue
                hot = None
            last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
            start = 0
            if last:
                yield from emit(key[:last], fp[:last])
                start = last
            key, fp = key[start:], fp[start:]
            if len(key) > block:
                yield _rows(fp, fp, key)
                hot, key, fp = key[0], key[:0], fp[:0]
        if len(key):
            yield from emit(key, fp)

    def emit(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[start, len(key)])
        big = np.repeat(sizes > block, sizes)
        if big.any():
            yield _rows(fp[big], fp[big], key[big])
            key, fp = key[~big], fp[~big]
        if len(key):
            yield from closed(key, fp)

    return run


def _link_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, a, b): each such group, at most two blocks, to its links."""
    held: list[np.ndarray] = []
    name = None
    for batch in batches:
        names = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:3]], axis=1)
        fp = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
        cuts = np.r_[0, np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1, len(fp)] if len(fp) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if name is not None and (names[a] != name).any():
                yield _rows(*spanning_links(np.concatenate(held)))
                held = []
            name = names[a]
            held.append(fp[a:b])
    if held:
        yield _rows(*spanning_links(np.concatenate(held)))


def links(fps: DataFrame, block: int = 4096) -> DataFrame:
    """(src, dst): links between distinct fingerprints; following them reaches all that links of 3 bits or fewer reach."""
    by_key = indexed(fps).repartition("key").sortWithinPartitions("key")
    found = materialize(by_key.mapInArrow(_link_groups(block), LINKS))
    hot = found.where("hot is not null").select(F.col("hot").alias("key"), F.col("src").alias("fp"))
    sizes = hot.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    dealt = hot.join(sizes, "key").select("key", "n", "fp", F.pmod(F.xxhash64("fp"), "n").cast("int").alias("mine"))
    pairs = dealt.select("key", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    pairs = pairs.select("key", F.least("mine", "other").cast("long").alias("a"), F.greatest("mine", "other").cast("long").alias("b"), "fp")
    crossed = pairs.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(_link_blocks, LINKS)
    return found.where("hot is null").select("src", "dst").union(crossed.select("src", "dst"))


def components(fps: DataFrame, block: int = 4096) -> DataFrame:
    """(fp, root) of distinct fingerprints: those of one component have the same root."""
    roots = connected_components(links(fps, block))
    return fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 4096) -> DataFrame:
    """One row per row of ``docs``: (doc_id, fp, component_id).

    component_id is the smallest id that links reach, the row's own included. Repeated rows are rows of their own in one
    component. A null or empty text has fingerprint 0 and is linked like any other; null ids never become a component_id
    unless all ids of the component are null. A very long text is one fingerprint like any other. Other columns of ``docs``
    are not read, whatever their names; an empty table gives an empty result.
    """
    rows = materialize(with_fingerprints(docs, id_col, text_col))
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    placed = distinct.join(components(distinct.select("fp"), block), "fp")
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 4096) -> DataFrame:
    """``docs``, all columns, without near-duplicates: of each component one row stays.

    It is the row with the smallest id, null last; among rows that repeat an id, the one with the smallest hash of its text,
    then the first. A row stays if nothing in another row resembles it, whatever ids repeat. Texts are written once with their row numbers
    and never shuffled unless the numbers of the rows that go, the fewer ones, are too many to be broadcast by Spark's own limit of size.
    """
    uid, fp = unused(docs, "uid"), unused(docs, "fp")
    rows = materialize(docs.select("*", F.monotonically_increasing_id().alias(uid), fingerprint_column(F.col(text_col)).alias(fp)))
    known = rows.select(F.col(fp).alias("fp"), F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(uid).alias("uid")).alias("row"))
    firsts = materialize(known.groupBy("fp").agg(F.min("row").alias("row")))
    stay = firsts.join(components(firsts.select("fp"), block), "fp").groupBy("root").agg(F.min("row").alias("row"))
    gone = materialize(rows.select(uid).join(stay.select(F.col("row.uid").alias(uid)), uid, "left_anti"))
    return rows.join(gone, uid, "left_anti").select(*docs.columns)

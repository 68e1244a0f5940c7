"""Byte-level BPE: overlapping chunks of texts are pre-tokenised in parallel, stitched where they agree, then encoded.

A text is cut into chunks of ``size`` characters that reach ``overlap`` characters into the next one. Each chunk is split by
the pattern on its own, from its own start, so its first pieces may be wrong. A match depends on nothing before its start:
from the first boundary that a chunk shares with the chunk before it, both agree for good. There the two are stitched, and the
pieces between two seams are encoded by the ranks. Boundaries at a chunk's end, which what follows may move, don't count.
Where an overlap has no common boundary, as inside a very long word, the chunks are joined into one and split again, until
every seam is found; so the result is that of splitting the whole text.
"""

from __future__ import annotations

import base64
import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.sources.scratch import discard, materialize

SIZE, OVERLAP = 32_768, 1024
#: Distinct pieces whose ids a worker keeps, and the longest such piece.
KEPT, KEPT_LENGTH = 200_000, 40


class Pieces(dict):
    """piece -> its ids as little-endian 32-bit integers, each encoded once while it is kept."""

    def __init__(self, encoding: tiktoken.Encoding) -> None:
        super().__init__()
        self.encoding = encoding

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encoding.encode_ordinary(piece), dtype="<u4").tobytes()
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = ids
        return ids


@functools.lru_cache(maxsize=2)
def ranked(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    """The encoding takes whatever it is given as one piece; splitting is done before."""
    return Pieces(tiktoken.Encoding("pieces", pat_str="(?s).+", mergeable_ranks=ranked(path), special_tokens={}))


@functools.lru_cache(maxsize=2)
def tokens_of(path: str) -> list[bytes]:
    ranks = ranked(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def boundaries(pattern: regex.Pattern, text: str) -> list[int]:
    """Where pieces begin and end when the text is split from its start."""
    return [0, *(m.end() for m in pattern.finditer(text))]


def seam_candidates(found: list[int], length: int, size: int, overlap: int, last: bool) -> tuple[list[int], list[int]]:
    """A chunk's boundaries in its own first ``overlap`` characters, and in those that the next chunk begins with."""
    sure = found if last else [b for b in found if b < length]
    return [b for b in sure if b <= overlap], [] if last else [b for b in sure if b >= size]


CHUNKS = "uid long, part int, last boolean, doc_id long, at long, size long, text string"
SPLIT = f"{CHUNKS}, head array<long>, tail array<long>"
_KINDS = pa.schema([("uid", pa.int64()), ("part", pa.int32()), ("last", pa.bool_()), ("doc_id", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("text", pa.string())])
_SPLIT_KINDS = pa.schema([*_KINDS, ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _cut(size: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                starts = range(0, len(text), size)
                for a in range(0, len(starts), 64):
                    yield _batch([(uid, a + k, s + size >= len(text), doc, s, size, text[s : s + size + overlap]) for k, s in enumerate(starts[a : a + 64])], _KINDS)
                uid += 1

    return run


def _split(pattern: str, overlap: int):
    """Adds the boundaries of each chunk near its two seams, as positions in the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for batch in batches:
            heads, tails = [], []
            for last, at, size, text in zip(*(batch.column(c).to_pylist() for c in ("last", "at", "size", "text")), strict=True):
                head, tail = seam_candidates(boundaries(compiled, text), len(text), size, overlap, last)
                heads.append([at + b for b in head])
                tails.append([at + b for b in tail])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], schema=_SPLIT_KINDS)

    return run


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of one run as one chunk: each adds what reaches beyond those before it."""
    for batch in batches:
        for run in batch.column(0):
            parts = run.as_py()
            first, texts, end = parts[0], [], parts[0]["at"]
            for p in parts:
                texts.append(p["text"][end - p["at"] :])
                end = max(end, p["at"] + len(p["text"]))
            size = parts[-1]["at"] + parts[-1]["size"] - first["at"]
            yield _batch([(first["uid"], first["part"], parts[-1]["last"], first["doc_id"], first["at"], size, "".join(texts))], _KINDS)


def _seams(chunks: DataFrame) -> DataFrame:
    """(uid, part, start): the first boundary that a chunk shares with the one before; null if there is none."""
    order = Window.partitionBy("uid").orderBy("part")
    narrow = chunks.select("uid", "part", "head", "tail").withColumn("before", F.lag("tail").over(order))
    return narrow.select("uid", "part", F.when(F.col("part") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", "before"))).alias("start"))


def stitched(chunks: DataFrame, pattern: str, overlap: int) -> DataFrame:
    """(uid, doc_id, part, at, text, start, end): chunks and the range of the text that each of them has to encode.

    Each round joins every chunk without a seam to those before it. Chunks grow only over stretches without a boundary.
    """
    split = materialize(chunks.mapInArrow(_split(pattern, overlap), SPLIT))
    seams = materialize(_seams(split))
    while not seams.where("start is null").isEmpty():
        order = Window.partitionBy("uid").orderBy("part")
        runs = seams.withColumn("run", F.max(F.when(F.col("start").isNotNull(), F.col("part"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        runs = runs.withColumn("alone", F.count("*").over(Window.partitionBy("uid", "run")) == 1).select("uid", "part", "run", "alone")
        marked = split.join(runs, ["uid", "part"])
        joined = marked.where("not alone").groupBy("uid", "run").agg(F.array_sort(F.collect_list(F.struct("part", "at", "uid", "last", "doc_id", "size", "text"))).alias("parts"))
        again = joined.select("parts").mapInArrow(_join, CHUNKS).mapInArrow(_split(pattern, overlap), SPLIT)
        before, gone = split, seams
        split = materialize(marked.where("alone").select(*split.columns).union(again))
        seams = materialize(_seams(split))
        discard(before)
        discard(gone)
    ends = seams.withColumn("end", F.lead("start").over(Window.partitionBy("uid").orderBy("part")))
    return split.select("uid", "part", "doc_id", "at", "text").join(ends, ["uid", "part"])


def _encode_pieces(path: str, pattern: str):
    """Ids of the pieces of a range of each text: null ends at the text's end. What follows the range is seen by its last piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, pieces = regex.compile(pattern), pieces_of(path)
        for batch in (whole.slice(a, 500) for whole in batches for a in range(0, whole.num_rows, 500)):
            out = []
            for text, start, end in zip(*(batch.column(c).to_pylist() for c in ("text", "start", "end")), strict=True):
                found = compiled.findall(text or "", start) if end is None else (m[0] for m in itertools.takewhile(lambda m, end=end: m.end() <= end, compiled.finditer(text, start)))
                out.append(b"".join(map(pieces.__getitem__, found)))
            kept = [i for i, name in enumerate(batch.schema.names) if name not in ("text", "start", "end")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(out, pa.binary())], names=[*(batch.schema.names[i] for i in kept), "ids"])

    return run


def _concatenate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole = [b"".join(p["ids"] for p in parts.as_py()) for parts in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.binary())], names=["doc_id", "ids"])


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids) for every row: the ids of the whole text as little-endian unsigned 32-bit integers.

    A null or empty text has no ids. Repeated rows, null ids and rows of equal id are encoded each for itself; other columns
    are left alone; an empty table gives none. Texts of one chunk need no seam and are encoded where they are; only longer
    ones are dealt to tasks by chunk, so a very long text is the work of many.
    """
    if not 0 < overlap <= size:
        raise ValueError("an overlap must be positive and no longer than a chunk")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    nothing = F.lit(None).cast("long")
    short = rows.where(f"text is null or length(text) <= {size}").select("doc_id", "text", F.lit(0).cast("long").alias("start"), nothing.alias("end"))
    encoded = short.mapInArrow(_encode_pieces(path, pattern), "doc_id long, ids binary")
    chunks = rows.where(f"length(text) > {size}").mapInArrow(_cut(size, overlap), CHUNKS).repartition("uid", "part")
    ranges = stitched(chunks, pattern, overlap)
    inside = ranges.select("uid", "part", "doc_id", "text", (F.col("start") - F.col("at")).alias("start"), (F.col("end") - F.col("at")).alias("end"))
    parts = inside.mapInArrow(_encode_pieces(path, pattern), "uid long, part int, doc_id long, ids binary")
    whole = parts.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("parts"))
    return encoded.union(whole.select("doc_id", "parts").mapInArrow(_concatenate, "doc_id long, ids binary"))


def decoded(ids: F.Column | str, path: str) -> F.Column:
    """The raw bytes of encoded ids, concatenated; they need not be text. Null counts as no ids."""

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = tokens_of(path)
        for batch in batches:
            yield pa.array([b"".join(map(table.__getitem__, np.frombuffer(b.as_py() or b"", dtype="<u4").tolist())) for b in batch], pa.binary())

    return decode(ids)

"""The trie of conversation prefixes, found by peeling turns off from the deepest level.

A sequence of turns is a chain of digests: the d-th names the first d turns, so two conversations share a node of depth d
where their d-th digests are equal, and chains in byte order keep every subtree together. Equal sequences become one row
first. Rows are then dealt by ranges of chains, and each task peels runs of them: from the greatest depth down, conversations
that end at a depth join the nodes that survive from below, all lose their last turn, and what is equal then is one node of
the depth above; counts are summed up on the way, so nodes are discovered and aggregated in one pass.

Only prefixes of a run's first and last chain can have members in other runs. Those nodes stay open: their parts, at most
twice the depth for each run, are summed by digest and peeled once more. No node's members come together anywhere, whatever
their number, and a long conversation costs one row of its own length and no rounds of jobs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.sources.scratch import materialize

#: Bytes of a digest; rows and turns of a run; ids that are joined into one string before a node's ends are hashed.
DIGEST, RUN_ROWS, RUN_TURNS, BLOCK = 16, 50_000, 500_000, 4096
SHARED, EVERY = 6, 100
#: Open nodes are few (twice the depth for each run); beyond so many they are joined by a shuffle.
OPEN_LIMIT = 500_000
NOBODY = sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) with every conversation's turns as (digest, length), by turn, then by role and digest of the text.

    A null turn comes first; a null role or text is empty. Rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)), 256)), 1, DIGEST)
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", role.alias("role"), digest.alias("digest"), F.length(text).alias("length"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    turns = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["length"].alias("length")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the first h turns of the conversation at the hundred below, then the own turns from h on."""
    own = ordered_turns(conversations)
    first = own.where(F.col("conv_id") % EVERY == 0).select(F.col("conv_id").alias("of"), F.slice("turns", 1, SHARED - 1).alias("lent"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    found = own.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % EVERY).alias("of"), h.alias("h")).join(first, "of", "left")
    lent = F.coalesce(F.slice("lent", F.lit(1), F.col("h")), F.array().cast("array<struct<digest:binary,length:int>>"))
    return found.select("conv_id", F.concat(lent, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chains, lengths = [], []
        for turns in batch.column(1).to_pylist():
            chain, key = bytearray(), b""
            for t in turns:
                key = sha256(key + t["digest"]).digest()[:DIGEST]
                chain += key
            chains.append(bytes(chain))
            lengths.append([t["length"] for t in turns])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chains, pa.binary()), pa.array(lengths, pa.list_(pa.int32()))], names=["conv_id", "chain", "lengths"])


SEQUENCES = "chain binary, lengths array<int>, conv_id long, n long, ends string"


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each sequence from its blocks of ids, which come in order: smallest id, number, digest of all ids."""
    kinds = pa.schema([("chain", pa.binary()), ("lengths", pa.list_(pa.int32())), ("conv_id", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])
    now: list | None = None
    for batch in batches:
        out = []
        for chain, lengths, conv, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is not None and now[0] == chain:
                now[3] += n
                now[4].update(b"," + ids.encode())
                continue
            if now is not None:
                out.append((*now[:4], now[4].hexdigest()))
            now = [chain, lengths, conv, n, sha256(ids.encode())]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*now[:4], now[4].hexdigest()), kinds.types, strict=True)], schema=kinds)


def sequences(conversations: DataFrame) -> DataFrame:
    """Every distinct sequence of turns once: (chain, lengths, conv_id: the smallest, n: how many, ends: digest of their ids).

    Ids are joined by blocks before they meet, so a sequence that many conversations share is a few rows.
    """
    chained = conversations.mapInArrow(_chained, "conv_id long, chain binary, lengths array<int>")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = chained.groupBy("chain", "lengths", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), ids.alias("ids"))
    dealt = blocks.repartition("chain").sortWithinPartitions("chain", "block")
    return dealt.select("chain", "lengths", "conv_id", "n", "ids").mapInArrow(_ended, SEQUENCES)


NODES = "key binary, parent binary, depth int, open boolean, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, length long, ends_sha256 string"
FIELDS = ("key", "parent", "depth", "open", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "length", "ends_sha256")
_KINDS = dict(zip(FIELDS, (pa.binary(), pa.binary(), pa.int32(), pa.bool_(), *[pa.int64()] * 7, pa.string()), strict=True))


class Node:
    """What is known of a prefix: its members and the sums over those children that are complete."""

    __slots__ = ("children", "conv", "ends", "leaves", "length", "n", "parent", "saved")

    def __init__(self, parent: bytes | None, length: int) -> None:
        self.parent, self.length = parent, length
        self.conv: int | None = None
        self.n = self.children = self.leaves = self.saved = 0
        self.ends: str | None = None

    def meet(self, conv: int, n: int) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.n += n

    def close(self) -> None:
        """All children are in: a node without any is a leaf, and its own repeats of its last text count."""
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * self.length


def _rows(level: dict[bytes, Node], above: dict[bytes, Node], depth: int, is_open) -> Iterator[tuple]:
    """A level's nodes once the level above has all its members."""
    for key, v in level.items():
        up = None if v.parent is None or is_open(v.parent) else above[v.parent].conv
        yield key, v.parent, depth, is_open(key), v.conv, up, v.n, v.children, v.leaves, v.saved, v.length, v.ends


def peel(rows: list[tuple[bytes, list[int], int, int, str]]) -> Iterator[tuple]:
    """The nodes of sequences in byte order of their chains, deepest first, as rows of FIELDS.

    Prefixes of the first and the last chain are open; their sums leave out what their open children hold.
    """
    if not rows:
        return
    unsure = {b""} | {chain[at : at + DIGEST] for chain in (rows[0][0], rows[-1][0]) for at in range(0, len(chain), DIGEST)}
    is_open = unsure.__contains__
    ending: dict[int, list[int]] = defaultdict(list)
    for i, row in enumerate(rows):
        ending[len(row[1])].append(i)

    def node(i: int, depth: int) -> Node:
        chain = rows[i][0]
        return Node(chain[(depth - 2) * DIGEST : (depth - 1) * DIGEST] if depth > 1 else b"" if depth else None, rows[i][1][depth - 1] if depth else 0)

    level: dict[bytes, Node] = {}
    at: dict[bytes, int] = {}
    below: dict[bytes, Node] = {}
    for depth in range(max(ending), -1, -1):
        for i in ending.get(depth, ()):
            chain, _, conv, n, ends = rows[i]
            key = chain[-DIGEST:]
            if key not in level:
                level[key], at[key] = node(i, depth), i
            level[key].meet(conv, n)
            level[key].ends = ends
        yield from _rows(below, level, depth + 1, is_open)
        above: dict[bytes, Node] = {}
        above_at: dict[bytes, int] = {}
        for key, v in level.items():
            if not is_open(key):
                v.close()
            if depth:
                if v.parent not in above:
                    above[v.parent], above_at[v.parent] = node(at[key], depth - 1), at[key]
                up = above[v.parent]
                up.meet(v.conv, v.n)
                if not is_open(key):
                    up.children, up.leaves, up.saved = up.children + 1, up.leaves + v.leaves, up.saved + v.saved
        below, level, at = level, above, above_at
    yield from _rows(below, {}, 0, is_open)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS.values(), strict=True)], names=list(FIELDS))


def _batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) == 10_000:
            yield _batch(part)
            part = []
    if part:
        yield _batch(part)


def _peeled(run_rows: int, run_turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        turns = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                turns += len(row[1])
                if len(rows) >= run_rows or turns >= run_turns:
                    yield from _batches(peel(rows))
                    rows, turns = [], 0
        yield from _batches(peel(rows))

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open nodes with the sums of all their parts, peeled once more among themselves."""
    levels: dict[int, dict[bytes, Node]] = defaultdict(dict)
    for batch in batches:
        for key, parent, depth, conv, n, children, leaves, saved, length, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            v = levels[depth][key] = Node(parent, length)
            v.conv, v.n, v.children, v.leaves, v.saved, v.ends = conv, n, children, leaves, saved, ends
    for depth in sorted(levels, reverse=True):
        for v in levels[depth].values():
            v.close()
            if depth:
                up = levels[depth - 1][v.parent]
                up.children, up.leaves, up.saved = up.children + 1, up.leaves + v.leaves, up.saved + v.saved
    never = lambda key: False
    yield from _batches(row for depth in levels for row in _rows(levels[depth], levels.get(depth - 1, {}), depth, never))


def prefix_trie(conversations: DataFrame, run_rows: int = RUN_ROWS, run_turns: int = RUN_TURNS) -> DataFrame:
    """One row a node of the trie of (conv_id, turns): its smallest member, depth, parent's smallest member, sums, and the
    digest of the members that end there.

    ``turns`` are structs of a digest and a length. A conversation without turns is a member of the root alone. Equal
    conversations are members of the same nodes. Without any conversation there is no root. Very long conversations are
    rows of their own length; a run ends with ``run_rows`` conversations or ``run_turns`` turns.
    """
    found = materialize(sequences(conversations.select("conv_id", "turns")))
    dealt = found.repartitionByRange("chain").sortWithinPartitions("chain")
    nodes = materialize(dealt.mapInArrow(_peeled(run_rows, run_turns), NODES))
    parts = nodes.where("open").groupBy("key", "parent", "depth", "length")
    sums = parts.agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("ends_sha256").alias("ends"))
    sums = sums.select("key", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "length", "ends")
    shared = materialize(sums.coalesce(1).mapInArrow(_joined, NODES))
    above = shared.select(F.col("key").alias("parent"), F.col("conv_id").alias("shared_conv_id"))
    few = shared.limit(OPEN_LIMIT + 1).count() <= OPEN_LIMIT
    whole = nodes.where("not open").join(F.broadcast(above) if few else above, "parent", "left")
    whole = whole.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "shared_conv_id")).select(*FIELDS)
    return whole.union(shared.select(*FIELDS)).select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256"),
    )


def rebuilt_trie(conversations: DataFrame, **runs: int) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text); other columns are left alone."""
    return prefix_trie(rebuilt(conversations.select("conv_id", "turn", "role", "text")), **runs)

"""Selection in trees: documents as a table of nodes with entry and exit numbers and paths, selectors as conditions on paths.

A node's entry number is the place of its first token in its document's text, its exit that of its last one, so a node lies
below another if its numbers lie between the other's, and entry numbers are the order of the source. Node rows are
(tree, entry, exit, parent, key, index, kind, value, path): key within an object, index within an array, value of scalars,
and entry, key and index of all nodes from the root down to this one. So a node alone tells whether steps lead to it, and
only what filters compare has to meet the nodes that they test: one grouping by tree and tested node for each filter. Where only
what selectors find in each tree is asked for, trees are never taken apart: ``found`` follows the steps in many texts at once,
each where it is.

A selector starts with ``$``, the root. ``.key`` or ``['key']`` is a member of an object, ``[3]`` of an array, ``['a','b',0]``
several members in the order in which they are listed, ``.*`` all members of objects, ``[*]`` all of arrays, ``..`` a node and
all below it, parents first. ``?(@.path == value && ... || ...)``, in brackets or not, keeps those of the nodes selected so far
whose path leads to a scalar equal to the value, for ``!=`` those whose path leads to none that is; containers equal nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[{}\[\]:,]|[^\s{}\[\]:,"]+', re.S)
#: Characters of the texts that are read at once.
TEXT = 1 << 20
_NODE = "entry int, exit int, parent int, key string, index int, kind string, value string, path array<struct<entry:int,key:string,index:int>>"
_STEP = re.compile(
    r"""(?P<descend>\.\.(?=[\w\[?*-]))|\.?(?P<keys>\*)(?=$|[.\[?])|\.?(?P<key>[\w-]+)|(?P<indices>\[\*\])|(?P<filter>\[?\?\()|(?P<members>\[(?:\s*(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|\d+)\s*,?)+\])"""
)
_MEMBER = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|\d+""")
_QUOTED = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\"""")


@dataclass(frozen=True)
class Comparison:
    path: tuple
    equal: bool
    kind: str
    value: str | None


@dataclass(frozen=True)
class Step:
    """axis: member (``of`` keys and indexes), keys, indices, descend or filter (``of`` clauses of comparisons)."""

    axis: str
    of: tuple = ()


def _unquoted(text: str) -> str:
    return json.loads(text) if text[0] == '"' else re.sub(r"\\(.)", r"\1", text[1:-1])


def _scalar(text: str) -> tuple[str, str | None]:
    if text and text[0] in "'\"":
        return "string", _unquoted(text)
    if text in ("true", "false", "null"):
        return ("null", None) if text == "null" else ("boolean", text)
    if not re.fullmatch(r"-?\d+(\.\d+)?([eE][+-]?\d+)?", text):
        raise ValueError(f"no scalar: {text!r}")
    return "number", text


def _split(text: str, mark: str) -> list[str]:
    """Parts of an expression at a mark outside quotes and inner filters."""
    hidden = _QUOTED.sub(lambda m: "\0" * len(m[0]), text)
    while inner := re.search(r"\([^()]*\)", hidden):
        hidden = hidden[: inner.start()] + "\0" * len(inner[0]) + hidden[inner.end() :]
    ends = [m.start() for m in re.finditer(re.escape(mark), hidden)]
    return [text[a:b].strip() for a, b in zip([0, *(e + len(mark) for e in ends)], [*ends, len(text)], strict=True)]


def _comparison(text: str) -> Comparison:
    for mark in ("==", "!="):
        parts = _split(text, mark)
        if len(parts) == 2 and parts[0].startswith("@"):
            return Comparison(parse("$" + parts[0][1:]), mark == "==", *_scalar(parts[1]))
    raise ValueError(f"no comparison: {text!r}")


def parse(selector: str) -> tuple[Step, ...]:
    """The steps of a selector; ValueError says what can't be read."""
    if not selector.startswith("$"):
        raise ValueError("a selector must start with $")
    steps, at = [], 1
    while at < len(selector):
        m = _STEP.match(selector, at)
        if m is None or (m.lastgroup in ("key", "keys") and m[0][0] != "." and not (steps and steps[-1].axis == "descend")):
            raise ValueError(f"no selector step at {at}: {selector[at:]!r}")
        at = m.end()
        if m.lastgroup == "filter":
            hidden = _QUOTED.sub(lambda q: "\0" * len(q[0]), selector)
            depth, end = 1, at
            while depth and end < len(selector):
                depth += {"(": 1, ")": -1}.get(hidden[end], 0)
                end += 1
            closing = ")]" if m[0][0] == "[" else ")"
            if depth or selector[end - 1 : end - 1 + len(closing)] != closing:
                raise ValueError("a filter is not closed")
            steps.append(Step("filter", tuple(tuple(_comparison(c) for c in _split(clause, "&&")) for clause in _split(selector[at : end - 1], "||"))))
            at = end - 1 + len(closing)
        elif m.lastgroup == "members":
            steps.append(Step("member", tuple(int(x) if x.isdigit() else _unquoted(x) for x in _MEMBER.findall(m[0]))))
        elif m.lastgroup == "key":
            steps.append(Step("member", (m["key"],)))
        else:
            steps.append(Step(m.lastgroup))
    return tuple(steps)


def _plain(token: str) -> str | None:
    if token[0] != '"':
        return token
    try:
        return json.loads(token, strict=False).encode("utf-8", "replace").decode()
    except ValueError:
        return None


def _kind(token: str) -> str:
    first = {"{": "object", "[": "array", '"': "string"}.get(token[0])
    return first or ("boolean" if token in ("true", "false") else "null" if token == "null" else "number")


def _read(text: str, put: Callable[..., None]) -> None:
    """Puts the nodes of one JSON text, containers when they close."""
    tokens = TOKEN.findall(text)
    open_: list[list] = []  # entry, parent, key, index, kind, path, members so far
    key = None
    for pos, token in enumerate(tokens):
        if token in ("}", "]"):
            if open_:
                entry, parent, name, index, kind, path, _ = open_.pop()
                put(entry, pos, parent, name, index, kind, None, path)
        elif tokens[pos + 1 : pos + 2] == [":"]:
            key = _plain(token)
        elif token not in (":", ","):
            kind, parent, name, index, path = _kind(token), None, None, None, ()
            if open_:
                around = open_[-1]
                parent, path = around[0], around[5]
                name, index = (key, None) if around[4] == "object" else (None, around[6])
                around[6] += 1
            path = (*path, (pos, name, index))
            if kind in ("object", "array"):
                open_.append([pos, parent, name, index, kind, path, 0])
            else:
                put(pos, pos, parent, name, index, kind, None if kind == "null" else _plain(token), path)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node rows of batches of (tree, text), in pieces of some thousand rows."""
    for batch in batches:
        trees, texts = batch.column(0), batch.column(1)
        columns: list[list] = [[] for _ in range(8)]
        entries, keys, indexes, ends = [], [], [], [0]

        def put(entry, leave, parent, key, index, kind, value, path):
            for c, v in zip(columns, (i, entry, leave, parent, key, index, kind, value), strict=True):  # noqa: B023
                c.append(v)
            for e, k, x in path:
                entries.append(e)  # noqa: B023
                keys.append(k)  # noqa: B023
                indexes.append(x)  # noqa: B023
            ends.append(len(entries))  # noqa: B023

        def out() -> pa.RecordBatch:
            of, kinds = columns[0], (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string())  # noqa: B023
            path = pa.StructArray.from_arrays([pa.array(entries, pa.int32()), pa.array(keys, pa.string()), pa.array(indexes, pa.int32())], ["entry", "key", "index"])  # noqa: B023
            found = [trees.take(pa.array(of, pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], kinds, strict=True))]  # noqa: B023
            return pa.RecordBatch.from_arrays([*found, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), path)], ["tree", "entry", "exit", "parent", "key", "index", "kind", "value", "path"])  # noqa: B023

        for i, text in enumerate(texts):
            _read(text.as_py() or "", put)
            if len(ends) > 20_000:
                yield out()
                columns, entries, keys, indexes, ends = [[] for _ in range(8)], [], [], [], [0]
        yield out()


def nodes(trees: DataFrame, tree: str, text: str) -> DataFrame:
    """Node rows of JSON texts, each text's where it is. A null or empty text has no node; of a text that isn't JSON the nodes
    are undefined."""
    t = trees.select(F.col(tree).alias("tree"), F.col(text).alias("text"))
    return t.mapInArrow(_rows, f"tree {t.schema['tree'].dataType.simpleString()}, {_NODE}")


#: Where steps from some start have come on the way to a node: the place in its path, the order of selection, and the nodes
#: that filters test on the way.
_STATE = "array<struct<depth:int,rank:array<bigint>,tests:array<bigint>>>"


def _state(depth: Column, rank: Column, tests: Column) -> Column:
    return F.struct(depth.cast("int").alias("depth"), rank.cast("array<bigint>").alias("rank"), tests.cast("array<bigint>").alias("tests"))


def _advance(states: Column, step: Step) -> Column:
    """The states after one more step; none where it leads elsewhere."""
    path = F.col("path")

    def one(s: Column) -> Column:
        if step.axis == "filter":
            return F.array(_state(s["depth"], s["rank"], F.concat(s["tests"], F.array(F.get(path, s["depth"])["entry"].cast("long")))))
        if step.axis == "descend":
            return F.transform(F.sequence(s["depth"], F.size(path) - 1), lambda k: _state(k, F.concat(s["rank"], F.array(F.get(path, k)["entry"].cast("long"))), s["tests"]))
        child = F.get(path, s["depth"] + 1)

        def to(place: Column) -> Column:
            return _state(s["depth"] + 1, F.concat(s["rank"], F.array(place.cast("long"))), s["tests"])

        if step.axis in ("keys", "indices"):
            led = [F.when(child["key" if step.axis == "keys" else "index"].isNotNull(), to(child["entry"]))]
        else:
            led = [F.when(child["index" if isinstance(m, int) else "key"] == m, to(F.lit(i))) for i, m in enumerate(step.of)]
        return F.array_compact(F.array(*led))

    return F.flatten(F.transform(states, one)).cast(_STATE)


def _possible(steps: tuple[Step, ...], whole: bool) -> Column:
    """What a node's own columns say of whether steps may lead to it; ``whole`` if they start at the root."""
    moves = [step for step in steps if step.axis != "filter"]
    out = F.lit(True)
    if whole and all(m.axis != "descend" for m in moves):
        out = F.size("path") == len(moves) + 1
    if moves and moves[-1].axis == "member":
        keys, indexes = [m for m in moves[-1].of if isinstance(m, str)], [m for m in moves[-1].of if isinstance(m, int)]
        out = out & (F.coalesce(F.col("key").isin(keys), F.lit(False)) | F.coalesce(F.col("index").isin(indexes), F.lit(False)))
    return out


def select(table: DataFrame, selector: str) -> DataFrame:
    """The nodes that a selector selects in every tree, with ``position`` from 1 in order of selection; one that is selected
    twice comes twice. A node takes parts: it is selected, or it is what a comparison of a filter leads to."""
    parts: list[tuple[Column, Column]] = []
    filters: list[tuple[int, int, tuple[tuple[tuple[int, bool], ...], ...]]] = []

    def part(steps: tuple[Step, ...], whole: bool, also: Column) -> int:
        """Number of a part; what its filters compare gets its own parts, and is judged before."""
        tested = [tuple(tuple((part(c.path, False, _same(c)), c.equal) for c in clause) for clause in step.of) for step in steps if step.axis == "filter"]
        none = F.array().cast("array<bigint>")
        states = F.array(_state(F.lit(0), none, none)) if whole else F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda k: _state(k, F.array(F.get("path", k)["entry"].cast("long")), none))
        for step in steps:
            states = _advance(states, step)
        parts.append((_possible(steps, whole) & also, F.filter(states, lambda s: s["depth"] == F.size("path") - 1)))
        filters.extend((len(parts) - 1, i, clauses) for i, clauses in enumerate(tested))
        return len(parts) - 1

    main = part(parse(selector), True, F.lit(True))
    may = parts[0][0]
    for of, _ in parts[1:]:
        may = may | of

    def numbered(i: int, of: Column, states: Column) -> Column:
        return F.when(of, F.transform(states, lambda s: F.struct(F.lit(i).alias("part"), s.alias("s")))).otherwise(F.array())

    taken = [numbered(i, *p) for i, p in enumerate(parts)]
    rows = table.where(may).withColumn("_p", F.explode(F.concat(*taken))).select(*(c for c in table.columns if c != "path"), F.col("_p.part").alias("_part"), "_p.s.rank", "_p.s.tests")
    for of, i, clauses in filters:
        compared = sorted({c for clause in clauses for c, _ in clause})
        at = F.when(F.col("_part") == of, F.get("tests", F.lit(i))).when(F.col("_part").isin(compared), F.get("rank", F.lit(0)))
        met = Window.partitionBy("tree", "_at")
        rows = rows.withColumn("_at", at).withColumns({f"_hit{c}": F.coalesce(F.max(F.col("_part") == c).over(met), F.lit(False)) for c in compared})
        holds = F.lit(False)
        for clause in clauses:
            every = F.lit(True)
            for c, equal in clause:
                every = every & (F.col(f"_hit{c}") if equal else ~F.col(f"_hit{c}"))
            holds = holds | every
        rows = rows.where((F.col("_part") != of) | holds).where(~F.col("_part").isin(compared)).drop("_at", *(f"_hit{c}" for c in compared))
    position = F.row_number().over(Window.partitionBy("tree").orderBy("rank"))
    return rows.where(F.col("_part") == main).withColumn("position", position.cast("long")).drop("rank", "tests", "_part")


def _same(comparison: Comparison) -> Column:
    return (F.col("kind") == comparison.kind) & (F.lit(True) if comparison.value is None else F.coalesce(F.col("value") == comparison.value, F.lit(False)))


class _Forest:
    """The nodes of some texts as arrays, in the order of the source; of a text that isn't JSON they are undefined."""

    def __init__(self, texts: list[str]) -> None:
        read = [TOKEN.findall(t) for t in texts]
        of = np.repeat(np.arange(len(texts)), [len(r) for r in read])
        encoded = pa.array([t for r in read for t in r], pa.string()).dictionary_encode()
        code, tokens = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary.to_pylist()
        self.kinds = np.array([_kind(t) for t in tokens], object)
        self.plain = np.array([None if k in ("object", "array", "null") else _plain(t) for t, k in zip(tokens, self.kinds, strict=True)], object)
        of_class = {t: 1 + (t in "[{") + 2 * (t in "]}") for t in "[]{}:,"}
        token = np.array([of_class.get(t, 0) for t in tokens], np.int8)[code] if len(code) else np.zeros(0, np.int8)
        colon = np.array([t == ":" for t in tokens], bool)[code] if len(code) else np.zeros(0, bool)
        key = np.r_[colon[1:] & (of[1:] == of[:-1]), False][: len(code)] & (token == 0)
        opens, closes = token == 2, token == 3
        after = np.cumsum(opens.astype(np.int64) - closes)
        start = np.searchsorted(of, np.arange(len(texts)))
        before_text = np.r_[0, after][start]
        after = np.maximum(after - before_text[of], 0) if len(code) else after
        depth = after - opens
        at = np.flatnonzero((token == 0) & ~key | opens)
        # places of one depth of one text stand together
        wide, long = int(after.max(initial=0)) + 2, len(code) + 1
        spot = lambda rows, level: (of[rows] * wide + level) * long + rows
        self.of, self.code, self.container = of[at], code[at], opens[at]
        inner = np.flatnonzero(self.container)
        sites = spot(at[inner], depth[at[inner]])
        order = np.argsort(sites, kind="stable")
        sites, inner = sites[order], inner[order]
        above = np.searchsorted(sites, spot(at, depth[at] - 1)) - 1
        self.parent = np.where((depth[at] > 0) & (above >= 0), inner[above] if len(inner) else -1, -1)
        shut = np.flatnonzero(closes)
        ends = np.sort(spot(shut, after[shut]))
        until = np.searchsorted(ends, spot(at, depth[at]))
        ending = np.where(self.container & (until < len(ends)), ends[np.minimum(until, len(ends) - 1)] % long if len(ends) else 0, at)
        self.end = np.maximum(np.searchsorted(at, ending, "right") - 1, np.arange(len(at)))
        self.children = np.argsort(self.parent, kind="stable")
        self.first = np.searchsorted(self.parent[self.children], np.arange(len(at) + 1))
        of_object = np.where(self.parent >= 0, self.kinds[self.code[self.parent]] == "object", False) if len(at) else np.zeros(0, bool)
        self.key = np.where(of_object, code[np.maximum(at - 2, 0)] if len(at) else 0, -1)
        place = np.empty(len(at), np.int64)
        place[self.children] = np.arange(len(at)) - self.first[self.parent[self.children]]
        self.index = np.where((self.parent >= 0) & ~of_object, place, -1)
        self.roots = np.flatnonzero(self.parent < 0)

    def _below(self, at: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each node its run of so many places from ``first``: the places, and which of ``at`` they are of."""
        return np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count), np.repeat(np.arange(len(at)), count)

    def follow(self, at: np.ndarray, steps: tuple[Step, ...]) -> tuple[np.ndarray, np.ndarray]:
        """The nodes to which steps lead from each of ``at``, in order of selection, and which of ``at`` each comes from."""
        origin = np.arange(len(at))
        for step in steps:
            if step.axis == "filter":
                keep = np.zeros(len(at), bool)
                for clause in step.of:
                    keep |= np.logical_and.reduce([self._holds(at, c) for c in clause])
                at, origin = at[keep], origin[keep]
                continue
            if step.axis == "descend":
                nodes, of = self._below(at, at, self.end[at] - at + 1)
            else:
                places, of = self._below(at, self.first[at], self.first[at + 1] - self.first[at])
                nodes = self.children[places]
                if step.axis == "member":
                    led = [self._is(nodes, m) for m in step.of]
                    listed = np.repeat(np.arange(len(led)), [len(x) for x in led])
                    every = np.concatenate(led)
                    every = every[np.lexsort((every, listed, of[every]))] if len(led) > 1 else every
                else:
                    every = np.flatnonzero((self.key if step.axis == "keys" else self.index)[nodes] >= 0)
                nodes, of = nodes[every], of[every]
            at, origin = nodes, origin[of]
        return at, origin

    def _is(self, nodes: np.ndarray, member: str | int) -> np.ndarray:
        if isinstance(member, int):
            return np.flatnonzero(self.index[nodes] == member)
        keys = np.unique(self.key[nodes])
        return np.flatnonzero(np.isin(self.key[nodes], [k for k in keys if k >= 0 and self.plain[k] == member]))

    def _holds(self, at: np.ndarray, c: Comparison) -> np.ndarray:
        """Of which nodes a comparison holds."""
        nodes, of = self.follow(at, c.path)
        equal = self.kinds == c.kind
        if c.value is not None:
            equal &= self.plain == c.value
        met = np.zeros(len(at), bool)
        met[of[equal[self.code[nodes]]]] = True
        return met if c.equal else ~met


def found(trees: DataFrame, tree: str, text: str, selectors: dict[str, str]) -> DataFrame:
    """(selector, tree, n, found): for each named selector and JSON text in which it selects nodes, how many, and the values of
    scalars among them, but nulls, in order of selection and comma-joined. Texts are read where they are, and only this leaves
    their tasks."""
    parsed = {name: parse(selector) for name, selector in selectors.items()}
    t = trees.select(F.col(tree).alias("tree"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            piece = np.cumsum([len(x) + 1 for x in texts]) // TEXT
            for rows in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(piece)) + 1):
                if not len(rows):
                    continue
                forest = _Forest(texts[rows[0] : rows[-1] + 1])
                for name, steps in parsed.items():
                    nodes, origin = forest.follow(forest.roots, steps)
                    of = forest.of[forest.roots][origin]
                    n = np.bincount(of, minlength=len(rows))
                    some = np.flatnonzero(n)
                    values = forest.plain[forest.code[nodes]]
                    known = np.array([v is not None for v in values], bool)
                    ends = np.cumsum(np.bincount(of[known], minlength=len(rows))[some])
                    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(values[known], pa.string())), ",")
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), batch.column(0).take(pa.array(some + rows[0])), pa.array(n[some], pa.int64()), joined], ["selector", "tree", "n", "found"])

    return t.mapInArrow(run, f"selector string, tree {t.schema['tree'].dataType.simpleString()}, n long, found string")

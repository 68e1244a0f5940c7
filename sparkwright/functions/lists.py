"""List functions of the decision language. Order functions that no built-in expresses run as Arrow functions on arrays."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def index_of(items: Column, value: Column) -> Column:
    """Place from 0 of the first equal item, -1 if there is none."""
    return (F.array_position(items, value) - 1).cast("long")


def last_index_of(items: Column, value: Column) -> Column:
    at = F.array_position(F.reverse(items), value)
    return F.when(at == 0, F.lit(-1)).otherwise(F.size(items) - at).cast("long")


def slice_from(items: Column, start: int, end: int) -> Column:
    """Items from ``start`` up to, not including, ``end``, counted from 0."""
    return F.slice(items, start + 1, max(0, end - start))


def exists_one(items: Column, condition) -> Column:
    return F.size(F.filter(items, condition)) == 1


def or_value(values: Column, key: Column, default: Column) -> Column:
    """A map's value under a key, or a default."""
    return F.coalesce(F.try_element_at(values, key), default)


def misplaced_places(keys: list[int]) -> list[int]:
    """Places outside the first longest non-decreasing run of ``keys``, in O(n log n).

    A place goes on the pile of the longest run that it ends, so keys fall along a pile. The run is read backwards from the
    first place of the last pile, each time to the earliest place of the pile below whose key can stand before.
    """
    ends: list[int] = []
    piles: list[list[int]] = []
    falling: list[list[int]] = []  # keys of each pile, negated
    for i, key in enumerate(keys):
        n = bisect_right(ends, key)
        if n == len(ends):
            ends.append(key)
            piles.append([])
            falling.append([])
        ends[n] = key
        piles[n].append(i)
        falling[n].append(-key)
    stays = set()
    if piles:
        at = piles[-1][0]
        stays.add(at)
        for pile, down in zip(reversed(piles[:-1]), reversed(falling[:-1]), strict=True):
            at = pile[bisect_left(down, -keys[at])]
            stays.add(at)
    return [i for i in range(len(keys)) if i not in stays]


def next_smaller(items: list) -> list[int]:
    """For every item the place of the next smaller one, -1 if none; nulls are never smaller and have none. One pass."""
    out, waiting = [-1] * len(items), []
    for i, x in enumerate(items):
        if x is None:
            continue
        while waiting and x < items[waiting[-1]]:
            out[waiting.pop()] = i
        waiting.append(i)
    return out


def _cycle_units(edges: list[list[int]]) -> list[int]:
    """For each node the smallest node of its strongly connected component, by one depth-first walk without recursion."""
    n = len(edges)
    order, low, unit = [-1] * n, [0] * n, [-1] * n
    path: list[int] = []
    clock = 0
    for root in range(n):
        if order[root] >= 0:
            continue
        walk = [(root, 0)]
        while walk:
            v, k = walk.pop()
            if not k:
                order[v] = low[v] = clock
                clock += 1
                path.append(v)
            for at in range(k, len(edges[v])):
                w = edges[v][at]
                if order[w] < 0:
                    walk += [(v, at + 1), (w, 0)]
                    break
                if unit[w] < 0:
                    low[v] = min(low[v], low[w])
            else:
                if low[v] == order[v]:
                    members = [path.pop()]
                    while members[-1] != v:
                        members.append(path.pop())
                    least = min(members)
                    for w in members:
                        unit[w] = least
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[v])
    return unit


def users_first_ranks(uses: list[list[int]]) -> list[int]:
    """Ranks with users before what they use; of those ready the earliest goes first, and a cycle goes together.

    The condensation is walked with a heap of units that nothing left uses, so time grows with items and uses.
    """
    n = len(uses)
    edges = [sorted({k for k in row if 0 <= k < n}) for row in uses]
    unit = _cycle_units(edges)
    members: dict[int, list[int]] = {}
    below: dict[int, set[int]] = {}
    for i, u in enumerate(unit):
        members.setdefault(u, []).append(i)
        below.setdefault(u, set()).update(unit[j] for j in edges[i] if unit[j] != u)
    above = dict.fromkeys(below, 0)
    for targets in below.values():
        for v in targets:
            above[v] += 1
    ready = [u for u, count in above.items() if not count]
    heapify(ready)
    ranks, place = [0] * n, 0
    while ready:
        u = heappop(ready)
        for i in members[u]:
            ranks[i] = place
            place += 1
        for v in below[u]:
            above[v] -= 1
            if not above[v]:
                heappush(ready, v)
    return ranks


def _array_function(python, kind: str, arrow: pa.DataType, items: Column) -> Column:
    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if x is None else python(x) for x in batch.to_pylist()], type=arrow)

    return run(items)


def misplaced(items: Column) -> Column:
    return _array_function(misplaced_places, "array<int>", pa.list_(pa.int32()), items)


def users_first(items: Column) -> Column:
    return _array_function(users_first_ranks, "array<int>", pa.list_(pa.int32()), items)


def anchors(items: Column) -> Column:
    """For every item the place of the next smaller one, -1 if none: the first of the places after it that are smaller."""
    return _array_function(next_smaller, "array<int>", pa.list_(pa.int32()), items)

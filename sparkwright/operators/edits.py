"""Edits of files: operations lowered to ranges of characters, those that can stand together, and files after them.

An edit (file, start, end, text, rank) replaces a range of a file's text, an empty one inserts; ``rank`` orders inserts at one
place. Edits of one proposal, known by (priority, ordinal), are made together or not at all. Two ranges collide if they share
a character, an insert and a range if it lies strictly inside; inserts never collide with each other.

Proposals are taken in order of priority, then ordinal, unless they collide with one taken before. Edits of a file fall into
islands, runs of ranges that meet. A proposal that meets others in at most one island is judged there: a task reads an island's
edits in order and keeps those taken. Islands that a proposal joins with other ones, and very large ones, go by rounds: a
proposal that comes before all it collides with is taken, what collides with those is dropped, the rest go on, so rounds grow
with the longest chain of collisions in falling order. The best of an edit's rivals is found there without pairs: ranges are
covered by nodes of a binary tree over the island's positions, and two ranges meet if a node of one lies on or above a node of
the other, so least keys by node, looked up along both ends of a range, are enough.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from sparkwright.sources.scratch import discard, materialize

KEY = ("priority", "ordinal")
ISLAND = ("file", "_island")
#: Most edits of an island that one task reads in order; larger ones go by rounds.
LARGE = 1_000_000


def _cells(edits: DataFrame) -> DataFrame:
    """Positions doubled: characters are odd cells and gaps even ones, so that inserts strictly inside a range meet it."""
    insert = F.col("start") == F.col("end")
    return edits.withColumn("_insert", insert).withColumn("_s", F.when(insert, 2 * F.col("start")).otherwise(2 * F.col("start") + 1)).withColumn("_e", F.when(insert, 2 * F.col("start") + 1).otherwise(2 * F.col("end")))


def _node(level: Column, index: Column) -> Column:
    """Number of a node: the tree's levels one after another."""
    return F.struct(level.cast("int").alias("level"), index.cast("long").alias("index"))


def _nodes() -> tuple[Column, Column]:
    """Nodes that cover a range's cells exactly, and all nodes above its first and last cell, these included."""
    none = F.array().cast("array<struct<level:int,index:bigint>>")
    s, e = F.col("_s") - F.col("_island"), F.col("_e") - F.col("_island")
    begin = F.struct(s.cast("long").alias("l"), e.cast("long").alias("r"), none.alias("out"))

    def climb(a: Column, level: Column) -> Column:
        left = (a["l"] < a["r"]) & (a["l"] % 2 == 1)
        l = F.when(left, a["l"] + 1).otherwise(a["l"])  # noqa: E741
        right = (l < a["r"]) & (a["r"] % 2 == 1)
        r = F.when(right, a["r"] - 1).otherwise(a["r"])
        out = F.concat(a["out"], F.when(left, F.array(_node(level, a["l"]))).otherwise(none), F.when(right, F.array(_node(level, a["r"] - 1))).otherwise(none))
        return F.struct(F.shiftright(l, 1).alias("l"), F.shiftright(r, 1).alias("r"), out.alias("out"))

    levels = F.sequence(F.lit(0), F.length(F.bin("_width")))
    cover = F.aggregate(levels, begin, climb, lambda a: a["out"])
    above = F.flatten(F.transform(levels, lambda k: F.array(_node(k, F.floor(s / F.pow(F.lit(2.0), k))), _node(k, F.floor((e - 1) / F.pow(F.lit(2.0), k))))))
    return cover, F.array_distinct(above)


def _least_rival(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """(file, _island, priority, ordinal, rival): the least key among ``sources`` that an edit of each target proposal meets,
    itself included where it is one."""
    key = F.struct(*KEY)
    tables = []
    for column, name in (("_cover", "own"), ("_above", "inside")):
        found = sources.select(*ISLAND, "_insert", F.explode(column).alias("node"), key.alias("key")).groupBy(*ISLAND, "_insert", "node").agg(F.min("key").alias("key"))
        tables.append(found.withColumn("at", F.lit(name)))
    held = tables[0].union(tables[1]).select(*ISLAND, F.col("_insert").alias("_source_insert"), "node", "at", "key")
    wanted = F.concat(F.transform(F.array_union("_above", "_cover"), lambda n: F.struct(n.alias("node"), F.lit("own").alias("at"))), F.transform("_cover", lambda n: F.struct(n.alias("node"), F.lit("inside").alias("at"))))
    asked = targets.select(*ISLAND, "_insert", *KEY, F.explode(wanted).alias("w")).select(*ISLAND, "_insert", *KEY, "w.node", "w.at")
    met = asked.join(held, [*ISLAND, "node", "at"]).where("not (_insert and _source_insert)")
    return met.groupBy(*KEY, *ISLAND).agg(F.min("key").alias("rival"))


def _beaten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the proposals that meet one taken before; rows come by island, then key, and only what is taken is kept."""
    island, key, mine = None, None, []
    starts, ends, inserts = [], [], []

    def meets(s: int, e: int, insert: bool) -> bool:
        i = bisect_left(starts, e)
        if i and ends[i - 1] > s:
            return True
        i = bisect_left(inserts, s)
        return not insert and i < len(inserts) and inserts[i] < e

    def lost() -> bool:
        if any(meets(*m) for m in mine):
            return True
        for s, e, insert in mine:
            if insert:
                inserts.insert(bisect_left(inserts, s), s)
            else:
                i = bisect_left(starts, s)
                starts.insert(i, s)
                ends.insert(i, e)
        return False

    fields = None
    for batch in batches:
        fields, out = [batch.schema.field(k) for k in KEY], []
        columns = [batch.column(c).to_pylist() for c in (*ISLAND, *KEY, "_s", "_e", "_insert")]
        for file, start, priority, ordinal, s, e, insert in zip(*columns, strict=True):
            if key != (priority, ordinal) or island != (file, start):
                if mine and lost():
                    out.append(key)
                mine = []
                if island != (file, start):
                    island = file, start
                    starts, ends, inserts = [], [], []
                key = priority, ordinal
            mine.append((s, e, insert))
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in out], f.type) for i, f in enumerate(fields)], list(KEY))
    if mine and lost():
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(key, fields, strict=True)], list(KEY))


def _beaten_by_rounds(edits: DataFrame) -> DataFrame | None:
    """Keys of the proposals that meet one taken before."""
    cover, above = _nodes()
    left, lost = materialize(edits.withColumn("_cover", cover).withColumn("_above", above)), None
    while not left.isEmpty():
        rivals = _least_rival(left, left)
        ahead = F.col("rival") < F.struct(*KEY)
        now = materialize(left.join(rivals.where(ahead).select(*KEY).distinct(), list(KEY), "left_anti"))
        dropped = materialize(_least_rival(left, now).where(ahead).select(*KEY).distinct())
        rest = materialize(left.join(now.select(*KEY).distinct(), list(KEY), "left_anti").join(dropped, list(KEY), "left_anti"))
        discard(left)
        discard(now)
        left, lost = rest, dropped if lost is None else lost.union(dropped)
    return lost


def together(edits: DataFrame) -> DataFrame:
    """The edits (file, start, end, priority, ordinal, ...) of all proposals that are taken; see the module.

    Keys are those of proposals, across files. Repeated rows are one edit. A proposal whose own edits collide is never taken.
    """
    key = F.struct(*KEY)
    place = Window.partitionBy("file").orderBy("_s", "_e")
    same = Window.partitionBy("file", *KEY).orderBy("_s", "_e")
    island = Window.partitionBy(*ISLAND)
    past = (Window.unboundedPreceding, -1)
    # one shuffle by file serves the repeats and all windows
    work = _cells(edits.repartition("file").dropDuplicates()).select("file", "_insert", "_s", "_e", *KEY)
    begins = F.coalesce(F.col("_s") >= F.max("_e").over(place.rowsBetween(*past)), F.lit(True))
    work = work.withColumn("_begins", begins).withColumn("_island", F.last(F.when(F.col("_begins"), F.col("_s")), True).over(place.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.max(F.when(~F.col("_insert"), F.col("_e"))).over(same.rowsBetween(*past))
    torn = F.coalesce(F.col("_s") < before, F.lit(False)) | (~F.col("_insert") & F.coalesce(F.lead("_s").over(same) < F.col("_e"), F.lit(False)))
    work = work.withColumn("_torn", torn).withColumn("_met", F.min(key).over(island) < F.max(key).over(island))
    work = work.withColumn("_width", F.max("_e").over(island) - F.col("_island")).withColumn("_n", F.count("*").over(island)).drop("_begins")
    met = materialize(work.where("_met or _torn"))
    lost = materialize(met.where("_torn").select(*KEY).distinct())
    live = met.where("_met").join(lost, list(KEY), "left_anti").drop("_torn", "_met")
    spot = F.struct(*ISLAND)
    wide = materialize(live.groupBy(*KEY).agg(F.min(spot).alias("a"), F.max(spot).alias("b")).where("a <> b").select(*KEY))
    joined = materialize(live.join(wide, list(KEY), "left_semi").select(*ISLAND).union(live.where(F.col("_n") > LARGE).select(*ISLAND)).distinct())
    apart = live.join(joined, list(ISLAND), "left_anti").select(*ISLAND, *KEY, "_s", "_e", "_insert").repartition("file").sortWithinPartitions(*ISLAND, *KEY)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in live.select(*KEY).schema)
    gone = [lost, materialize(apart.mapInArrow(_beaten, kinds))]
    if not joined.isEmpty() and (found := _beaten_by_rounds(live.join(joined, list(ISLAND), "left_semi"))) is not None:
        gone.append(found)
    discard(met)
    out = gone[0]
    for g in gone[1:]:
        out = out.union(g)
    return edits.repartition(*KEY).dropDuplicates().join(out, list(KEY), "left_anti").select(*edits.columns)


@F.pandas_udf(ArrayType(LongType()))
def _sums(lengths: pd.Series) -> pd.Series:
    """Running sums of every array."""
    return lengths.map(lambda x: x.cumsum())


_LINE = r"[^\n]*\n|[^\n]+$"


def _measured(rows: DataFrame, text: str, pattern: str) -> DataFrame:
    """The rows with ``_parts``, matches of a pattern that covers the text, and ``_ends``, where each of them ends."""
    parts = rows.withColumn("_parts", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return parts.withColumn("_ends", _sums(F.transform("_parts", lambda p: F.length(p).cast("long"))))


def lines(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """(file, line, start, end, body) of every line, from 1, in characters; the end takes in the line's own end."""
    t = files.where(F.col(text).isNotNull() & (F.length(text) > 0)).select(F.col(file).alias("file"), F.col(text).alias("_t"))
    t = _measured(t, "_t", _LINE).select("file", F.posexplode(F.arrays_zip("_parts", "_ends")).alias("pos", "x"))
    end, body = F.col("x._ends"), F.col("x._parts")
    return t.select("file", (F.col("pos") + 1).cast("long").alias("line"), (end - F.length(body)).alias("start"), end.alias("end"), body.alias("body"))


EDIT = ("file", "start", "end", "text", "rank", *KEY)


def lowered(operations: DataFrame, files: DataFrame) -> DataFrame:
    """Operations as edits: (file, start, end, text, rank, priority, ordinal).

    An operation is (file, op, line, end_line, to_line, word, text, priority, ordinal). ``remove`` takes its lines and, where
    blank lines stand on both sides, those below; ``add`` inserts a line before ``to_line``; ``replace`` sets a text in place
    of its lines; ``move`` takes its lines before ``to_line``, ranked by where they came from; ``rename`` replaces every whole
    word; ``reorder`` sorts its lines by their text and replaces those that change. A line past the last one is the file's end.
    What names lines that aren't there, or would change nothing, gives no edit.
    """
    l = materialize(lines(files))  # noqa: E741
    blank = F.trim(F.regexp_replace("body", r"\s+", " ")) == ""
    sizes = l.groupBy("file").agg(F.max("line").alias("n_lines"), F.max("end").alias("size"))
    first = l.select("file", F.col("line"), F.col("start").alias("_from"))
    last = l.select("file", F.col("line").alias("end_line"), F.col("end").alias("_to"))
    o = operations.join(first, ["file", "line"], "left").join(last, ["file", "end_line"], "left").join(sizes, "file")
    target = l.select("file", F.col("line").alias("to_line"), F.col("start").alias("_line_at"))
    o = o.join(target, ["file", "to_line"], "left").withColumn("_at", F.coalesce("_line_at", F.when(F.col("to_line") == F.col("n_lines") + 1, F.col("size"))))
    o = materialize(o)
    spans = F.col("_from").isNotNull() & F.col("_to").isNotNull() & (F.col("_from") < F.col("_to"))
    inside = l.join(o.where(spans & F.col("op").isin("move", "reorder")).select("file", *KEY, F.col("line").alias("_a"), "end_line"), "file").where(F.col("line").between(F.col("_a"), F.col("end_line")))
    bodies = inside.groupBy("file", *KEY).agg(F.array_sort(F.collect_list(F.struct("line", "start", "end", "body"))).alias("bodies"))
    zero, none = F.lit(0).cast("long"), F.lit("")

    def edit(rows: DataFrame, start: Column, end: Column, text: Column, rank: Column = zero) -> DataFrame:
        values = (F.col("file"), start, end, text, rank, F.col("priority"), F.col("ordinal"))
        return rows.select(*(v.alias(n) for v, n in zip(values, EDIT, strict=True)))

    # the blank lines that follow a removed range: as far as the first line that isn't blank
    flags = l.withColumn("_blank", blank)
    next_full = F.min(F.when(~F.col("_blank"), F.col("start"))).over(Window.partitionBy("file").orderBy("line").rowsBetween(0, Window.unboundedFollowing))
    gaps = flags.withColumn("_full", next_full).select("file", "line", "_blank", F.coalesce("_full", F.max("end").over(Window.partitionBy("file"))).alias("_full"))
    removed = o.where(spans & (F.col("op") == "remove")).join(gaps.select("file", F.col("line").alias("_above"), F.col("_blank").alias("_blank_above")), (F.col("_above") == F.col("line") - 1) & (gaps["file"] == o["file"]), "left").drop(gaps["file"])
    below = gaps.select(F.col("file").alias("_f"), F.col("line").alias("_below"), "_blank", "_full")
    removed = removed.join(below, (F.col("_f") == F.col("file")) & (F.col("_below") == F.col("end_line") + 1), "left")
    both = F.coalesce("_blank_above", F.col("line") == 1) & F.coalesce("_blank", F.lit(False))
    out = edit(removed, F.col("_from"), F.when(both, F.col("_full")).otherwise(F.col("_to")), none)
    ended = lambda text: F.when(F.endswith(text, F.lit("\n")), text).otherwise(F.concat(text, F.lit("\n")))
    out = out.union(edit(o.where((F.col("op") == "add") & F.col("_at").isNotNull()), F.col("_at"), F.col("_at"), ended(F.col("text"))))
    out = out.union(edit(o.where(spans & (F.col("op") == "replace")), F.col("_from"), F.col("_to"), ended(F.col("text"))))
    moved = o.where(spans & (F.col("op") == "move") & F.col("_at").isNotNull() & ((F.col("_at") < F.col("_from")) | (F.col("_at") > F.col("_to")))).join(bodies, ["file", *KEY])
    whole = ended(F.array_join(F.transform("bodies", lambda b: b["body"]), ""))
    out = out.union(edit(moved, F.col("_from"), F.col("_to"), none)).union(edit(moved, F.col("_at"), F.col("_at"), whole, F.col("_from")))
    # lines of a reorder that keep their place at both ends of it stay
    sorted_bodies = F.array_sort(F.transform("bodies", lambda b: ended(b["body"])))
    r = o.where(spans & (F.col("op") == "reorder")).join(bodies, ["file", *KEY]).withColumn("_new", sorted_bodies).withColumn("_n", F.size("bodies"))
    changed = F.filter(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: ended(F.col("bodies")[i]["body"]) != F.col("_new")[i])
    r = r.withColumn("_changed", changed).where(F.size("_changed") > 0).withColumn("_lo", F.array_min("_changed")).withColumn("_hi", F.array_max("_changed"))
    out = out.union(edit(r, F.col("bodies")[F.col("_lo")]["start"], F.col("bodies")[F.col("_hi")]["end"], F.array_join(F.slice("_new", F.col("_lo") + 1, F.col("_hi") - F.col("_lo") + 1), "")))
    # words are looked for where the lines are; only those that are renamed leave them
    renames = operations.where("op = 'rename' and word <> text")
    held = l.select("file", "start", "body").join(renames.groupBy("file").agg(F.collect_set("word").alias("_words")), "file")
    spots = F.filter(F.arrays_zip("_parts", "_ends"), lambda x: F.array_contains("_words", x["_parts"]))
    words = _measured(held, "body", r"(?U)\w+|\W+").select("file", "start", F.explode(spots).alias("x"))
    stop = F.col("start") + F.col("x._ends")
    words = words.select("file", F.col("x._parts").alias("word"), (stop - F.length("x._parts")).alias("_a"), stop.alias("_b"))
    return out.union(edit(renames.join(words, ["file", "word"]), F.col("_a"), F.col("_b"), F.col("text")))


def applied(files: DataFrame, edits: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """(file, text) of every file after edits that can stand together; one without edits stays as it is."""
    of = edits.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "end", "rank", "priority", "ordinal", F.col("text").alias("new")))).alias("edits"))
    f = files.select(F.col(file).alias("file"), F.col(text).alias("text")).join(of, "file", "left")
    done = F.aggregate("edits", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")), lambda a, e: F.struct(e["end"].cast("long").alias("at"), F.concat(a["out"], F.array(F.substring("text", a["at"] + 1, e["start"] - a["at"]), e["new"])).alias("out")))
    f = f.withColumn("_done", done)
    tail = F.substring("text", F.col("_done.at") + 1, F.length("text"))
    return f.select("file", F.when(F.col("edits").isNull(), F.col("text")).otherwise(F.concat(F.array_join("_done.out", ""), tail)).alias("text"))

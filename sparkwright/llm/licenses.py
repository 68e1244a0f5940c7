"""License scans by diagonal voting, with DataFrame operations only.

Every rolling pair of words of every text is joined by its hash to the positions that pair has in the templates (a fixed,
small table, broadcast). A match votes for the diagonal text position - template position. Votes are counted by text, template
and diagonal; the words compared must be equal, so each vote is verified.

A short phrase needs all votes of one diagonal. For the sentences, each diagonal is merged with those up to DRIFT above it, which
allows for inserted words, and a band below, for missing ones; the longest run of votes that rises in text and template gives the verified span, reported
if it has enough of the template's places and isn't much longer than the template. Of spans that share half of the shorter
one's words the one with more votes stays, so a longer template wins over one that it contains.

A text is exploded and joined within its task; one shuffle brings a text's votes together. No text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Short phrases: fixed values. All their words must stand consecutively.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
#: Sentences of licenses, with labels of their own kind.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-text",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "gnu general public license as published by the free software foundation": "gpl-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "creative commons attribution 4 0 international": "cc-by-4.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
GRAM = 2
#: Least share of a template's words, and how far diagonals may lie apart to be merged.
COVER, DRIFT = 0.8, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Only the first and the last part of a split can be empty.
INNER = "slice(s, if(s[0] = '', 2, 1), size(s) - if(s[0] = '', 1, 0) - if(size(s) > 1 and s[size(s) - 1] = '', 1, 0))"
WORD_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_grams(spark: SparkSession, phrases: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """(template, label, exact, size, at, w1, w2): one row per pair of words of each template; as large as the templates."""
    rows = []
    for exact, found in ((True, phrases), (False, templates)):
        for text, label in found.items():
            words = text.split()
            if len(words) < GRAM:
                raise ValueError(f"a template needs {GRAM} words: {text!r}")
            rows += [(text, label, exact, len(words), i, words[i], words[i + 1]) for i in range(len(words) - 1)]
    return spark.createDataFrame(rows, "template string, label string, exact boolean, size int, at int, t1 string, t2 string")


def votes(docs: DataFrame, id_col: str, text_col: str, grams: DataFrame) -> DataFrame:
    """One row per matching pair of words, and the first pair of every text with its number of words."""
    words = F.split(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), WORD_SPLIT)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), words.alias("s"))
    rows = rows.select("uid", "doc_id", F.expr(INNER).alias("w"))
    rows = rows.select("uid", "doc_id", F.size("w").alias("n_words"), F.expr("arrays_zip(w, slice(w, 2, greatest(size(w), 1)))").alias("pairs"))
    rows = rows.select("uid", "doc_id", "n_words", F.posexplode_outer("pairs").alias("pos", "pair"))
    rows = rows.select("uid", "doc_id", "n_words", "pos", F.col("pair").getField("w").alias("w1"), F.col("pair").getField("1").alias("w2"))
    rows = rows.withColumn("gram", F.xxhash64("w1", "w2"))
    known = F.broadcast(grams.withColumn("gram", F.xxhash64("t1", "t2")))
    joined = rows.join(known, "gram", "left").withColumn("hit", F.coalesce((F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2")), F.lit(False)))
    return joined.where("hit or pos is null or pos = 0").select(
        "uid", "doc_id", "n_words", "hit", "template", "label", "exact", "size", "at", (F.col("pos") - F.col("at")).alias("diagonal")
    )


#: The longest run of places (pos, at), ordered by pos and then by falling at, that rises in both: (n, start, end).
#: Of runs of one length the one that starts last, the shortest, is taken.
RUN = """aggregate(places, cast(array() as array<struct<n:int,start:int,pos:int,at:int>>), (a, x) -> concat(a, array(
  aggregate(filter(a, y -> y.pos < x.pos and y.at < x.at), named_struct('n', 1, 'start', x.pos, 'pos', x.pos, 'at', x.at),
            (b, y) -> if(named_struct('n', y.n + 1, 'start', y.start) > named_struct('n', b.n, 'start', b.start), named_struct('n', y.n + 1, 'start', y.start, 'pos', x.pos, 'at', x.at), b)))),
  a -> array_max(transform(a, y -> struct(y.n, y.start, y.pos))))"""
SPAN = "struct<start:int,end:int,label:string,exact:boolean,covered:double>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, spans) for every row; a span is (start, end, label, exact, covered), in words from 0, end exclusive.

    Null and empty texts have no words and no spans. Repeated rows and null ids stay rows of their own. A template repeated in
    a row is found each time. Ties: of spans with as many votes and shared words the shorter stays, then the earlier, then the
    smaller label. A long text costs in proportion to its words and votes. Other columns are not read; an empty table gives an
    empty result.
    """
    found = votes(docs, id_col, text_col, template_grams(docs.sparkSession, phrases, templates)).repartition("uid")
    lines = found.groupBy("uid", "template", "diagonal").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.first("label", True).alias("label"),
        F.first("exact", True).alias("exact"),
        F.first("size", True).alias("size"),
        F.array_sort(F.collect_list(F.when(F.col("hit"), F.col("at")))).alias("ats"),
    )
    whole = F.size("ats") == F.col("size") - (GRAM - 1)
    band = Window.partitionBy("uid", "template").orderBy("diagonal").rangeBetween(-DRIFT, DRIFT)
    near = lines.withColumn("band", F.collect_list(F.struct("diagonal", "ats")).over(band))
    least = F.ceil(F.lit(COVER) * (F.col("size") - (GRAM - 1)))
    # a diagonal with all votes stands by itself; a band is aligned only if it has votes enough
    enough = F.expr("aggregate(band, 0, (n, b) -> n + size(b.ats))") >= least
    places = F.expr("array_sort(flatten(transform(band, b -> transform(b.ats, t -> struct(cast(b.diagonal + t as int) as pos, t as at)))), (x, y) -> if(x.pos <> y.pos, x.pos - y.pos, y.at - x.at))")
    own = F.expr("transform(ats, t -> struct(cast(diagonal + t as int) as pos, t as at))")
    near = near.withColumn("places", F.when(F.col("exact") | F.coalesce(whole, F.lit(False)), own).when(enough, places))
    run = F.when(F.col("exact") & ~whole, None).when(F.col("places").isNotNull() & (F.size("places") > 0), F.expr(RUN))
    spans = near.withColumn("run", run).withColumn("covered", F.col("run.n") / (F.col("size") - (GRAM - 1)))
    fits = F.col("run").isNotNull() & (F.col("covered") >= COVER) & (F.col("run.pos") + GRAM - F.col("run.start") <= F.col("size") + DRIFT)
    spans = spans.select(
        "uid", "doc_id", "n_words", F.when(fits, F.struct(F.col("run.start").alias("start"), (F.col("run.pos") + GRAM).alias("end"), "label", "exact", "covered")).alias("span"), F.col("run.n").alias("n"),
    ).distinct()
    # the better of spans that share words comes first by more votes, then fewer words, earlier start, smaller label
    rank = F.struct(-F.col("n"), F.col("span.end") - F.col("span.start"), F.col("span.start"), "span.label")
    reach = max([len(t.split()) for t in (*phrases, *templates)], default=0) + DRIFT
    around = Window.partitionBy("uid").orderBy(F.coalesce(F.col("span.start"), F.lit(-1 - 2 * reach))).rangeBetween(-reach, reach)
    ranked = spans.withColumn("rank", rank).withColumn("others", F.collect_set(F.when(~F.col("span.exact"), F.struct("rank", F.col("span.start").alias("s"), F.col("span.end").alias("e")))).over(around))
    lost = F.expr("exists(others, o -> o.rank < rank and 2 * (least(o.e, span.end) - greatest(o.s, span.start)) >= least(o.e - o.s, span.end - span.start))")
    stays = F.col("span").isNotNull() & (F.col("span.exact") | ~lost)
    return ranked.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_list(F.when(stays, F.col("span")))).cast(f"array<{SPAN}>").alias("spans"),
    ).drop("uid")

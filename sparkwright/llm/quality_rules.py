"""Quality rules by distribution divergence, with DataFrame operations only.

Every text's histogram of character classes and of its language's common words is compared with the language's reference by
Jensen-Shannon distance (base 2, so between 0 and 1). References are learnt from all documents of a language: its common words
are those that make up at least a share of all its words, case and punctuation folded. A text is compared with the others
only: its own counts are taken off the reference first. Texts under a minimum length, and languages with too few other words,
are not judged by a histogram. Simple counts stand beside it: words, symbols, repeated lines, and words within three-word
windows that the text has twice or more.

Counts of a text are made within its row, each class from one rewritten text by differences of length; only figures leave the
task. References have at most 1 / COMMON words a language. They are broadcast once their size is known to be small; else each
language's rows are dealt by salt, so a language that holds most rows is the work of many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.sources.scratch import materialize

#: Share of a language's words from which a word is common, and the words of other texts that a reference needs at least.
COMMON, LEAST_REFERENCE = 0.002, 10_000
#: Characters of each class, and the letter that stands for them. What is left is no ASCII.
CLASSES = {
    "U": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "l": "abcdefghijklmnopqrstuvwxyz",
    "D": "0123456789",
    "M": "!\"'(),.:;?-",
    "S": "#*$%&|<>",
    " ": "\t\n\x0b\x0c\r ",
}
#: All other ASCII characters.
CLASSES["o"] = "".join(c for c in map(chr, range(128)) if not any(c in of for of in CLASSES.values()))
#: Bytes of all references up to which they are broadcast, and the parts that a language's rows are dealt to beyond that.
BROADCAST, SALTS = 32 << 20, 64
#: Most common words of all languages that a plan names.
FEW = 4000
SPACE = r"[\x20\x09-\x0D]+"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Distances beyond which a text is dropped, and the numbers of characters and words from which it is judged by them.
FAR_CLASSES, FAR_WORDS, LEAST_CHARS, LEAST_WORDS = 0.25, 0.33, 200, 100


def _rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), text.alias("text"))


def common_words(rows: DataFrame, least: int = LEAST_REFERENCE) -> DataFrame:
    """(lang, common, ref_n): the common words with their counts, by word, and the number of words of each language."""
    words = rows.select("lang", F.explode(F.split(F.lower("text"), NO_WORD)).alias("word")).where("word <> ''")
    counted = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    # words too rare to be common in any language that is large enough become one row a language
    counted = counted.groupBy("lang", F.when(F.col("n") >= least * COMMON, F.col("word")).alias("word")).agg(F.sum("n").alias("n"))
    counted = materialize(counted)
    totals = counted.groupBy("lang").agg(F.sum("n").alias("ref_n")).where(F.col("ref_n") >= least)
    often = counted.join(totals, "lang").where(F.col("word").isNotNull() & (F.col("n") >= COMMON * F.col("ref_n")))
    return often.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("common"), F.max("ref_n").alias("ref_n"))


def is_small(common: DataFrame, most: int = BROADCAST) -> bool:
    """Whether the references, with some room for each language and word, have at most ``most`` bytes."""
    size = common.agg(F.sum(F.expr("aggregate(common, 200L, (a, c) -> a + octet_length(c.word) + 32)"))).first()[0] or 0
    return size <= most


def beside(rows: DataFrame, reference: DataFrame, small: bool) -> DataFrame:
    """Rows with what their language has in ``reference``, null without; no row is lost and no language meets in one task."""
    if small:
        return rows.join(F.broadcast(reference), "lang", "left")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    parts = reference.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(parts, ["lang", "salt"], "left").drop("salt")


def features(rows: DataFrame, common: DataFrame, small: bool = True) -> DataFrame:
    """Counts of every row, of its classes and of its language's common words (null without a reference).

    Other words are put aside first if the common ones of all languages are few enough to stand in the plan; the counts are
    the same without that.
    """
    found = common.select(F.explode("common.word").alias("word")).distinct().limit(FEW + 1).collect()
    among = sorted(r.word for r in found) if len(found) <= FEW else None
    rows = beside(rows, common.select("lang", F.col("common.word").alias("common")), small)
    trimmed = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    rows = rows.withColumn("w", F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("n", F.size("w"))
    # hashes that occur twice, then windows with such a hash as (hash, position), sorted: equal ones are neighbours, whose words are compared
    rows = rows.withColumn("h", F.expr("transform(if(n >= 3, sequence(0, n - 3), array()), i -> xxhash64(w[i], w[i + 1], w[i + 2]))"))
    rows = rows.withColumn("sorted", F.sort_array("h"))
    rows = rows.withColumn("twice", F.expr("array_distinct(filter(sorted, (x, k) -> k > 0 and sorted[k - 1] = x))"))
    places = "if(size(twice) = 0, array(), filter(sequence(0, n - 3), i -> size(twice) > 64 or array_contains(twice, h[i])))"
    rows = rows.withColumn("s", F.expr(f"sort_array(transform({places}, i -> struct(h[i] as h, i as i)))"))
    same = "s[{0}].h = x.h and w[s[{0}].i] = w[x.i] and w[s[{0}].i + 1] = w[x.i + 1] and w[s[{0}].i + 2] = w[x.i + 2]".format
    twice = f"(k > 0 and {same('k - 1')}) or (k < size(s) - 1 and {same('k + 1')})"
    rows = rows.withColumn("again", F.expr(f"sort_array(transform(filter(s, (x, k) -> {twice}), x -> x.i))"))
    covered = "aggregate(again, struct(0 as n, -1 as last), (a, i) -> struct(a.n + i + 3 - greatest(i, a.last) as n, i + 3 as last)).n"
    rows = rows.withColumn("l", F.expr("filter(split(text, '\\n'), l -> l rlike r'[^\\x20\\x09-\\x0D]')"))
    letters, stand_ins = "".join(CLASSES.values()), "".join(k * len(v) for k, v in CLASSES.items())
    rows = rows.withColumn("t", F.translate("text", letters, stand_ins))
    of = lambda name, part: F.octet_length(name) - F.octet_length(F.replace(F.col(name), part))
    for i, letter in enumerate(CLASSES):
        rows = rows.withColumn(f"c{i}", of("t", F.lit(letter)))
    # common words with a space on either side, so that taking one out shows by the length how often it stood there
    words = rows.withColumn("v", F.split(F.lower("text"), NO_WORD))
    some = F.col("v") if among is None else F.filter("v", lambda x: x.isin(among))
    rows = words.withColumn("f", F.concat(F.lit(" "), F.array_join(some, "  "), F.lit(" ")))
    rows = rows.withColumn("n_folded", F.size("v") - F.expr("if(v[0] = '', 1, 0) + if(size(v) > 1 and v[size(v) - 1] = '', 1, 0)"))
    own = F.transform("common", lambda c: ((F.octet_length("f") - F.octet_length(F.replace(F.col("f"), F.concat(F.lit(" "), c, F.lit(" "))))) / (F.octet_length(c) + 2)).cast("long"))
    ascii_chars = sum((F.col(f"c{i}") for i in range(len(CLASSES))), F.lit(0))
    spaces, symbols = (list(CLASSES).index(k) for k in (" ", "S"))
    counts = [F.col(f"c{i}").cast("long") for i in range(len(CLASSES)) if i != spaces]
    return rows.select(
        "doc_id",
        "lang",
        F.col("n").cast("long").alias("n_words"),
        (F.char_length("text") - F.col(f"c{spaces}")).cast("long").alias("word_chars"),
        F.col(f"c{symbols}").cast("long").alias("n_symbols"),
        F.expr("size(l) - size(array_distinct(l))").cast("long").alias("n_dup_lines"),
        F.expr(covered).cast("long").alias("n_repeat_words"),
        F.array(*counts, (F.char_length("text") - ascii_chars).cast("long")).alias("class_counts"),
        own.alias("own"),
        F.col("n_folded").cast("long").alias("n_folded"),
    )


def _distance(p: str, q: str) -> str:
    """SQL for the Jensen-Shannon distance of two arrays of counts; null if one of them is empty."""
    total = lambda a: f"aggregate({a}, 0d, (a, x) -> a + x)"
    term = lambda a, b: f"if({a} > 0, {a} * log2(2 * {a} / ({a} + {b})), 0d)"
    shares = f"zip_with(transform({p}, x -> x / nullif(p_total, 0)), transform({q}, x -> x / nullif(q_total, 0)), (a, b) -> struct(a as a, b as b))"
    summed = f"aggregate({shares}, 0d, (t, s) -> t + ({term('s.a', 's.b')} + {term('s.b', 's.a')}) / 2)"
    value = f"if(p_total > 0 and q_total > 0, sqrt(greatest(0d, {summed})), null)"
    for name, of in (("p_total", p), ("q_total", q)):
        value = f"element_at(transform(array({total(of)}), {name} -> {value}), 1)"
    return value


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", far_classes: float = FAR_CLASSES, far_words: float = FAR_WORDS, least_reference: int = LEAST_REFERENCE, most: int = BROADCAST) -> DataFrame:
    """Per row: counts, distances, base_failed and kept.

    base_failed: under 50 words, or over half of the words repeat. A distance is null, and judges nothing, for texts under
    the minimum length, and where the other texts of the language have fewer than ``least_reference`` words or characters.
    A null language is a language of its own. Ties: a word on the very share is common, a text at the very distance is kept.
    Repeated rows and null ids stay rows of their own, and copies are part of each other's reference. A very long text is
    counted whole. Only three columns are read, whatever other columns are called; an empty table gives an empty result.
    Windows are found by 64 bits of hash and then compared, so a chance collision in a text could at most hide a repeat.
    """
    rows = _rows(docs, id_col, text_col, lang_col)
    common = materialize(common_words(rows, least_reference))
    small = is_small(common, most)
    counted = materialize(features(rows, common, small))
    sums = [F.sum(F.get("class_counts", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))]
    classes = counted.groupBy("lang").agg(*sums).select("lang", F.array(*(f"c{i}" for i in range(len(CLASSES)))).alias("every"))
    joined = beside(beside(counted, materialize(classes), small), common.select("lang", F.col("common.n").alias("often"), "ref_n"), small)
    less = "zip_with({0}, {1}, (a, b) -> a - b)".format
    rest = "concat({0}, array({1} - aggregate({0}, 0L, (a, x) -> a + x)))".format
    joined = joined.withColumn("p_classes", F.col("class_counts")).withColumn("q_classes", F.expr(less("every", "class_counts")))
    joined = joined.withColumn("p_words", F.expr(rest("own", "n_folded"))).withColumn("q_words", F.expr(less(rest("often", "ref_n"), "p_words")))
    size = "aggregate({0}, 0L, (a, x) -> a + x)".format
    by_class = F.when((F.col("word_chars") >= LEAST_CHARS) & (F.expr(size("q_classes")) >= least_reference), F.expr(_distance("p_classes", "q_classes")))
    by_word = F.when((F.col("n_words") >= LEAST_WORDS) & (F.col("ref_n") - F.col("n_folded") >= least_reference), F.expr(_distance("p_words", "q_words")))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), by_class.alias("class_distance"), by_word.alias("word_distance")
    )
    far = (F.coalesce("class_distance", F.lit(0.0)) > far_classes) | (F.coalesce("word_distance", F.lit(0.0)) > far_words)
    return out.withColumn("kept", ~F.col("base_failed") & ~far)

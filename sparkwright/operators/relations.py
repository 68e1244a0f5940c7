"""Small relational operators on symbols, findings and judgments that other operators build on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Probability from which a model's answer fails a subject; below it the subject is left to review.
FAIL_AT = 0.9


def imports(edges: DataFrame) -> DataFrame:
    """(module, targets): the distinct modules that each module uses, sorted and joined."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    return e.groupBy(F.col("src").alias("module")).agg(F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("targets"))


def collisions(declared: DataFrame, name: str, language: str) -> DataFrame:
    """Names that are declared in more than one language, with how many."""
    return declared.groupBy(name).agg(F.countDistinct(language).alias("languages")).where("languages > 1")


def tested(functions: DataFrame, uses: DataFrame) -> DataFrame:
    """(id, touched, module_tested) of functions that are no tests: whether a test uses them, and whether their module has tests."""
    tests = functions.where("test").select(F.col("id").alias("src"))
    touched = uses.where("src <> dst").join(tests, "src", "left_semi").select(F.col("dst").alias("id"), F.lit(True).alias("_touched")).distinct()
    modules = functions.where("test").select("module", F.lit(True).alias("_tested")).distinct()
    out = functions.where("not test").join(touched, "id", "left").join(modules, "module", "left")
    return out.select("id", F.coalesce("_touched", F.lit(False)).alias("touched"), F.coalesce("_tested", F.lit(False)).alias("module_tested"))


def home_files(functions: DataFrame, uses: DataFrame) -> DataFrame:
    """(file, home): for each file with tests the file whose functions its tests use most; ties go to the smaller name."""
    tests = functions.where("test").select(F.col("id").alias("src"), "file")
    targets = functions.where("not test").select(F.col("id").alias("dst"), F.col("file").alias("home"))
    counted = uses.where("src <> dst").select("src", "dst").distinct().join(tests, "src").join(targets, "dst").groupBy("file", "home").agg(F.count("*").alias("n"))
    return counted.groupBy("file").agg(F.min_by("home", F.struct(-F.col("n"), "home")).alias("home"))


def reference_sites(uses: DataFrame, places: DataFrame) -> DataFrame:
    """(dst, ordinal, file, line): the distinct places that use a symbol, by file and then line; rows, so that no hot symbol is one list."""
    sites = uses.where("src <> dst").join(places.select(F.col("id").alias("src"), "file", "line"), "src").select("dst", "file", "line").distinct()
    return sites.withColumn("ordinal", F.row_number().over(Window.partitionBy("dst").orderBy("file", "line")) - 1)


def by_prefix(fingerprints: DataFrame, asked: DataFrame, most: int = 6) -> DataFrame:
    """(prefix, n, fingerprint): how many fingerprints begin with each asked prefix, ``most`` at most, and the one if it is unambiguous.

    Fingerprints are counted by their beginnings of the lengths that are asked for, at most 64, before they meet a prefix, so
    no prefix is compared with all of them. Repeated prefixes are answered each; a null one begins nothing; none give none.
    """
    lengths = asked.where("prefix is not null").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    begun = fingerprints.select("fingerprint").distinct().join(F.broadcast(lengths)).select("fingerprint", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("fingerprint"))
    counted = begun.groupBy(F.expr("left(fingerprint, n)").alias("prefix")).agg(F.least(F.count("*"), F.lit(most)).alias("n"), F.min("fingerprint").alias("one"))
    return asked.join(counted, "prefix", "left").select("prefix", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("one")).alias("fingerprint"))


def evidence_digest(*parts: Column) -> Column:
    """The first 16 characters of a digest of evidence, white space squeezed."""
    return F.left(F.sha2(F.regexp_replace(F.concat_ws("|", *parts), r"\s+", " "), 256), F.lit(16))


def trim_to_budget(blobs: DataFrame, budget: int) -> DataFrame:
    """Blobs (kind, id, bytes, cost, durable, used_at) that are dropped until a kind's bytes fit the budget: the least durable
    first, then those that take most bytes for their cost, then the longest unused."""
    order = Window.partitionBy("kind").orderBy("durable", F.desc(F.col("bytes") / (F.col("cost") + 1)), "used_at", "id")
    before = F.sum("bytes").over(order) - F.col("bytes")
    over = F.sum("bytes").over(Window.partitionBy("kind")) - F.lit(budget)
    return blobs.withColumn("before", before).withColumn("over", over).where("before < over").select("kind", "id", F.col("before").cast("long").alias("before"))


def ask_once(signals: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Signals with ``asks``: only the first of a key asks."""
    return signals.withColumn("asks", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) == 1)


def review(subjects: DataFrame, p: str = "p") -> DataFrame:
    """Subjects with what the host makes of a model's probability: fail with a confidence, or left to review."""
    c = F.col(p)
    return subjects.withColumn("verdict", F.when(c >= FAIL_AT, "fail").otherwise("review")).withColumn("confidence", F.when(c >= FAIL_AT, F.greatest(c, 1 - c)))


def selector_quality(subjects: DataFrame, selected: str, truth: str) -> DataFrame:
    """One row: subjects, how many are selected, the share of these that are true, and the share of the true that are selected."""
    s, t = F.col(selected), F.col(truth)
    both = F.count_if(s & t)
    of = lambda n: F.floor(both / F.nullif(n, F.lit(0)) * 10000 + 0.5) / 10000
    return subjects.agg(F.count("*").alias("subjects"), F.count_if(s).alias("selected"), of(F.count_if(s)).alias("precision"), of(F.count_if(t)).alias("coverage"))

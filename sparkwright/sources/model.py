"""Relations of a code model: schemas, and wire fragments, logs, reports and label tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "struct<line:int,col:int>"
SPAN = f"struct<start:{POINT},end:{POINT}>"
TYPE = "struct<text:string,symbol:string,exported:boolean>"
FLOW = "struct<kind:string,nesting:int,arms:int,operators:int,returning:boolean,guard:boolean>"
STEP = f"struct<span:{SPAN},kind:string,operators:int,indexing:int,literals:int,calls:array<struct<name:string,site:{SPAN}>>,nested:int,guard:boolean>"
EVENT = f"struct<kind:string,span:{SPAN},detail:string>"
FUNCTION = (
    f"struct<symbol:string,max_nesting:int,statements:int,top_level:int,params:int,returns:int,tokens:int,flow:array<{FLOW}>,signature:struct<params:array<{TYPE}>,results:array<{TYPE}>>,"
    f"events:array<{EVENT}>,steps:array<{STEP}>,forwards_to:string,manual_assertions:int,constructs:boolean,configures:string,implements:string>"
)
SYMBOL = f"struct<id:string,kind:string,name:string,visibility:string,owner:string,file:string,role:string,doc:string,optional:boolean,span:{SPAN},extent:{SPAN},type_ref:{TYPE},provides:array<string>,requires:array<string>>"
EDGE = f"struct<kind:string,from:struct<module:string,symbol:string>,to:string,resolution:string,when:string,site:{SPAN}>"
FRAGMENT = (
    "struct<file:struct<path:string,lang:string,generated:boolean,test:boolean,facts:map<string,string>>,modules:array<struct<path:string,name:string,test_of:string,language:string,example:boolean>>,"
    f"symbols:array<{SYMBOL}>,edges:array<{EDGE}>,functions:array<{FUNCTION}>,tests:array<struct<symbol:string,nesting:int,style:string,targets:array<string>>>,comments:array<struct<span:{SPAN},text:string,attached_to:string>>>"
)


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    """One row per fragment of wire documents {"fragments": [...]}; a document that isn't JSON fails the read."""
    docs = spark.read.schema(f"fragments array<{FRAGMENT}>").json(path, multiLine=True, mode="FAILFAST")
    return docs.select(F.explode("fragments").alias("f")).select("f.*")


def relations(fragments: DataFrame) -> dict[str, DataFrame]:
    """Fragments as one DataFrame a relation: each id once, the first in file order; file facts merged."""
    f = fragments.where("file.path is not null")
    path = F.col("file.path")

    def of(column: str) -> DataFrame:
        return f.select(path.alias("_file"), F.posexplode(column).alias("_at", "r"))

    def first(rows: DataFrame, key: str) -> DataFrame:
        whole = rows.groupBy(F.col(f"r.{key}").alias("_key")).agg(F.min_by("r", F.struct("_file", "_at")).alias("r"))
        return whole.select("r.*")

    entries = f.select(path.alias("path"), "file.lang", "file.generated", "file.test", F.explode_outer("file.facts").alias("k", "v"))
    merged = entries.groupBy("path").agg(F.first("lang", True).alias("lang"), F.max("generated").alias("generated"), F.max("test").alias("test"), F.collect_set(F.when(F.col("k").isNotNull(), F.struct("k", "v"))).alias("facts"))
    edges = of("edges").select("_file", "_at", "r.*")
    edges = edges.select(
        "kind",
        F.when(F.col("from.symbol").isNotNull(), "symbol").otherwise("module").alias("from_kind"),
        F.coalesce("from.symbol", "from.module").alias("from_id"),
        "to",
        "resolution",
        "when",
        "site",
        F.col("_file").alias("file"),
        F.col("_at").cast("long").alias("ordinal"),
    )
    deduped = edges.groupBy("kind", "from_kind", "from_id", "to", "resolution", "when").agg(F.min_by(F.struct("site", "file", "ordinal"), F.struct("file", "ordinal")).alias("s")).select("kind", "from_kind", "from_id", "to", "resolution", "when", "s.*")
    symbols = first(of("symbols"), "id")
    return {
        "files": merged.withColumn("facts", F.map_from_entries(F.array_sort("facts"))),
        "modules": first(of("modules"), "path"),
        "symbols": symbols.drop("span", "extent", "doc"),
        "places": symbols.select(F.col("id").alias("symbol"), "span", "extent", "doc"),
        "edges": deduped,
        "functions": first(of("functions"), "symbol"),
        "tests": first(of("tests"), "symbol"),
        "comments": of("comments").select(F.col("_file").alias("file"), "r.*").dropDuplicates(["file", "span"]),
    }


def read_decision_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of append-only logs of JSON lines, each once by id, which is the SHA-256 of its body.

    A last line that was cut short is skipped. Any other line that is no record, or whose id doesn't match its body, fails the
    read with its file and text, so that no decision is passed over in silence; blank lines are none.
    """
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), at.alias("at")).where("trim(value) <> ''")
    ends = lines.groupBy("file").agg(F.max("at").alias("last"))
    parsed = lines.join(ends, "file").withColumn("r", F.from_json("value", "id string, body string, kind string, fingerprint string, time string"))
    torn = (F.col("at") == F.col("last")) & F.col("r.id").isNull() & ~F.rtrim("value").endswith("}")
    sound = F.col("r.id").isNotNull() & F.coalesce(F.sha2("r.body", 256) == F.col("r.id"), F.lit(False))
    checked = parsed.withColumn("ok", F.when(torn, False).when(sound, True).otherwise(F.raise_error(F.concat(F.lit("not a record of "), "file", F.lit(": "), "value"))))
    return checked.where("ok").select("r.*").dropDuplicates(["id"])


SARIF = (
    "runs array<struct<tool:struct<driver:struct<name:string,rules:array<struct<id:string,defaultConfiguration:struct<level:string>>>>>,"
    "results:array<struct<ruleId:string,level:string,message:struct<text:string>,suppressions:array<struct<kind:string>>,"
    "locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,endLine:int>>>>>>>>"
)


def read_sarif(spark: SparkSession, path: str) -> DataFrame:
    """Results of SARIF 2.1.0 logs as findings; the level a result leaves out is warning."""
    runs = spark.read.schema(SARIF).json(path, multiLine=True).select(F.explode("runs").alias("run"))
    r = runs.select("run.tool.driver.name", F.explode("run.results").alias("x"))
    place = F.get("x.locations", F.lit(0))["physicalLocation"]
    level = F.coalesce("x.level", F.lit("warning"))
    return r.select(
        F.col("name").alias("tool"),
        F.col("x.ruleId").alias("rule"),
        F.when(level == "error", "error").when(level == "warning", "warn").otherwise("info").alias("severity"),
        place["artifactLocation"]["uri"].alias("file"),
        F.greatest(F.lit(1), place["region"]["startLine"]).alias("line"),
        F.col("x.message.text").alias("message"),
        (F.size(F.coalesce("x.suppressions", F.array())) > 0).alias("suppressed"),
    )


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed labels: TP fails, FP passes, any other verdict and the fingerprint - are left out."""
    rows = spark.read.csv(path, sep="\t", comment="#", header=True, schema="fingerprint string, repo string, location string, verdict string, reason string")
    return rows.where("fingerprint <> '-' and verdict in ('TP', 'FP')").withColumn("fails", F.col("verdict") == "TP")


def read_project(spark: SparkSession, path: str, glob: str, ignored: list[str]) -> DataFrame:
    """(path, text, readable) of a folder's files by a name pattern, without those that ignore patterns take.

    A file that isn't UTF-8 is kept as not readable, so a check can tell that it is incomplete.
    """
    from sparkwright.functions.text import glob_matches

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    for pattern in ignored:
        files = files.where(~glob_matches(F.regexp_replace("path", r"^[a-z]+:/*", ""), pattern))
    text = F.expr("try_validate_utf8(cast(content as string))")
    return files.select("path", text.alias("text"), text.isNotNull().alias("readable"))

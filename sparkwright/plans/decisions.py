"""The catalogue of decisions over the derived model, and the whole check as one query.

Conditions are SQL that both engines understand, but for MATCH(text, pattern); the facts under them are computed by this
library's operators on one side and by plain SQL on the other.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwright.functions import text as T
from sparkwright.operators import graphs, metrics, relations
from sparkwright.operators.conditions import condition as when
from sparkwright.operators.decisions import Decision, evaluate, incomplete, violations
from sparkwright.plans import conditions, model
from sparkwright.sources.scratch import materialize, read_table
from sparkwright.sources.tables import Numbered, relation, with_sql

QUERIES = {}
ORACLE = {}

DECISIONS = [
    Decision("complexity", "info", "function", when((("cyclomatic", ">", 12),), (("cognitive", ">", 15),), (("unit", ">", 20),)), "'complexity ' || cyclomatic || ', with helpers ' || unit", tests=False),
    Decision("coupling", "warn", "function", when((("fan_in", ">=", 2), ("fan_out", ">=", 3), ("statements", ">", 10))), "'hub: ' || fan_in || ' in, ' || fan_out || ' out'", (("coordinator", "fan_out > 2 * statements"),), tests=False),
    Decision("signature-size", "warn", "function", "params > most", "params || ' parameters, at most ' || most", (("most", "CASE WHEN visibility = 'public' THEN 5 ELSE 7 END"),)),
    Decision("max-name-words", "warn", "symbol", "n_words > most", "name || ' has ' || n_words || ' words'", (("most", "CASE WHEN kind = 'method' THEN 2 ELSE 3 END"),)),
    Decision("no-unused-symbol", "error", "function", when((("visibility", "=", "private"), ("users", "=", 0))), "name || ' is never used'", tests=False),
    Decision("feature-envy", "info", "function", when((("envied", ">=", 2),)), "name || ' uses ' || envied || ' members of ' || envy_target"),
    Decision("prefer-method", "warn", "function", "affinity is not null", "name || ' serves ' || affinity || ' only'"),
    Decision("vertical-distance", "warn", "function", when((("gap", ">", 8),)), "name || ' stands ' || gap || ' lines below its sibling'"),
    Decision("no-redundant-symbol", "warn", "function", when((("visibility", "=", "private"), ("users", "=", 1), ("fan_out", "=", 1), ("statements", "<=", 12))), "name || ' only wraps'"),
    Decision("reserved-verbs", "warn", "function", "MATCH(name, '^(new|get|is|has)_') and params = 1", "name || ' promises an action'"),
    Decision("no-type-encoding", "warn", "function", "MATCH(name, '(ring|widget)[0-9]+$')", "name || ' encodes a type'", (("suffix", "right(name, 4)"),)),
    Decision("abbreviations", "warn", "function", "MATCH(key, '(^|_)(gear|bolt)[0-9]*(_|$)')", "name || ' spells an initialism'"),
    Decision("short-names", "warn", "symbol", "length(name) = 1 and kind <> 'field'", "name || ' is one letter'"),
    Decision("exported-doc", "warn", "symbol", "visibility = 'public' and doc is null and kind <> 'field' and not MATCH(name, '^(new|get)_')", "name || ' has no doc'", tests=False),
    Decision("consistent-terms", "warn", "function", when((("others", ">=", 5),)), "plain || ' is exported in ' || others || ' other modules'", (), identity="plain"),
    Decision("top-down-order", "warn", "function", "first_user_line > line", "name || ' stands above its first user'", (), tests=False, fix="reorder"),
    Decision("no-single-line-bodies", "error", "function", "end_line = line", "name || ' has its body on one line'"),
    Decision("no-private-types", "warn", "function", "visibility = 'public' and owner is not null and owner_private", "name || ' names a private type'"),
    Decision("dispatcher", "info", "function", when((("dispatcher", "=", True), ("statements", "<", 30))), "name || ' only dispatches'"),
    Decision("context-first", "warn", "symbol", "kind in ('function', 'method') and MATCH(parameters, ',context[.]Context(,|$)') and not MATCH(parameters, '^context[.]Context(,|$)')", "name || ' takes its context late'", languages=("go",)),
    Decision("owner-file", "info", "function", "owner is not null and split_share < 0.45", "name || ' stands away from its type'"),
    Decision("max-case-depth", "warn", "test", when((("depth", ">", 2),)), "name || ' nests ' || depth || ' deep'"),
    Decision("no-hidden-target", "warn", "test", when((("fan_out", ">", 0), ("untested_reach", "=", 0))), "name || ' reaches code through helpers only'"),
    Decision("standard-assertions", "warn", "test", when((("statements", ">", 20), ("fan_out", "=", 0))), "name || ' asserts by hand'"),
    Decision("max-lines", "info", "file", when((("lines", ">", 500),)), "path || ' has ' || lines || ' lines'", identity="path", path="path", line="1"),
    Decision("public-boundary", "error", "file", when((("test", "=", True), ("private_reach", ">", 0))), "path || ' reaches ' || private_reach || ' private symbols'", identity="path", path="path", line="1"),
    Decision("declaration-blocks", "warn", "file", "functions > 2 and methods * 3 <= functions", "path || ' declares loose functions'", identity="path", path="path", line="1"),
    Decision("single-responsibility", "info", "file", when((("groups", ">", 3),)), "path || ' falls into ' || groups || ' groups'", identity="path", path="path", line="1"),
    Decision("module-layout", "warn", "module", when((("declares", ">", 0), ("files", ">", 5))), "path || ' mixes ' || declares || ' declarations'", identity="path", path="path", line="1"),
    Decision("meaningful-separation", "info", "module", when((("dependents", "=", 1), ("lines", "<", 3000))), "path || ' serves one module'", identity="path", path="path", line="1"),
    Decision("module-cycle", "warn", "module", when((("cycle_size", ">", 1),)), "path || ' is in a cycle of ' || cycle_size", identity="path", path="path", line="1"),
    Decision("no-conjoined-modules", "info", "edge", "mutual and src < dst", "src || ' and ' || dst || ' use each other'", identity="src || '>' || dst", path="src", line="1"),
    Decision("layers", "error", "edge", "src_region > dst_region and src_region <> 'europe'", "src || ' may not use ' || dst", identity="src || '>' || dst", path="src", line="1"),
    Decision("no-mutable-globals", "warn", "symbol", "kind = 'variable' and visibility = 'public' and owner is null", "name || ' is a variable that all may change'"),
    Decision("no-stored-context", "warn", "symbol", when((("kind", "=", "field"), ("type", "=", "context.Context"))), "name || ' keeps a context'", languages=("go",)),
    Decision("no-redundant-qualifier", "warn", "symbol", "left(name, length(module_name) + 1) = module_name || '_'", "name || ' repeats ' || module_name"),
    Decision("missing-owner", "warn", "symbol", "visibility = 'public' and kind in ('function', 'method') and module_tested and not touched", "name || ' is in a tested module and no test uses it'", tests=False),
    Decision("test-file", "error", "function", "test and home is not null and home <> file", "name || ' belongs to ' || home"),
    Decision("allow-reason", "error", "annotation", "trim(reason) = '' and ordinal = 0", "'a directive for ' || rule || ' gives no reason'", identity="CAST(claim AS STRING)", path="owner"),
    Decision("decision-naming", "warn", "decision", "not MATCH(name, '^[a-z][a-z0-9]*(-[a-z0-9]+)*$') or n_words > 3 or MATCH(name, '(^|-)(check|rule|lint)(-|$)') or MATCH(name, '(^|-)' || pack || '(-|$)')", "name || ' is no good name in ' || pack", identity="CAST(rid AS STRING)", path="pack", line="1"),
    Decision("no-conflicting-decisions", "warn", "decision", "rival is not null and not superseded", "name || ' may conflict with ' || rival", identity="CAST(rid AS STRING)", path="pack", line="1"),
    Decision("no-contradictory-decisions", "error", "decision", "contradicts is not null and not superseded", "name || ' contradicts ' || contradicts", identity="CAST(rid AS STRING)", path="pack", line="1"),
    Decision("independence", "error", "edge", "src_region = dst_region and src_region in ('asia', 'africa')", "src || ' and ' || dst || ' are to be independent'", identity="src || '>' || dst", path="src", line="1"),
    Decision("no-panic", "warn", "event", when((("kind", "=", "error"), ("value", ">", 60))), "'panic ' || ordinal || ' of ' || owner", identity="kind || ordinal", path="owner"),
    Decision("error-identity", "warn", "event", when((("kind", "=", "click"), ("ordinal", ">=", 3), ("value", "<", 5))), "'compared ' || ordinal", identity="kind || ordinal", path="owner"),
    Decision("max-len", "warn", "line", "width > 400 and not exempt", "'line is ' || width || ' wide'", identity="CAST(line AS STRING)", path="owner"),
    Decision("no-todo", "info", "line", "MATCH(trimmed, '^(TODO|FIXME|XXX|All rights)')", "'note: ' || substr(trimmed, 1, 20)", identity="trimmed", path="owner"),
    Decision("no-noise-comment", "warn", "line", "MATCH(trimmed, '[|] [^|]+ [|] [^|]+ [|]') or MATCH(trimmed, '^[=*-]+$')", "'banner of ' || width", identity="CAST(line AS STRING)", path="owner"),
    Decision("no-detached-comment", "warn", "line", "MATCH(trimmed, '^(TODO|Licensed|Released|All rights|Copyright)') and next_blank", "'comment stands apart'", identity="CAST(line AS STRING)", path="owner"),
]
RULES = {d.name: d for d in DECISIONS}
#: Facts that a greatest fixpoint gives, which a monotone recursion cannot.
NO_SQL = {"owner-file"}


def _spark(text: str) -> str:
    return re.sub(r"MATCH\(", "regexp(", text)


def _duck(text: str) -> str:
    return re.sub(r"MATCH\(", "regexp_matches(", text)


def _for_spark(d: Decision) -> Decision:
    return Decision(**{**vars(d), "where": _spark(d.condition), "variables": tuple((n, _spark(e)) for n, e in d.variables)})


def _needs(d: Decision) -> set[str]:
    """Names that a decision's expressions read; facts that none of them names are not built."""
    return set(re.findall(r"[a-z_]+", " ".join([d.condition, d.message, d.identity, d.path, d.line, d.scope(), *(e for _, e in d.variables)])))


#: Facts of functions that are on uses or on lines.
JOINED = {"cyclomatic", "cognitive", "depth", "dispatcher", "unit", "fan_in", "fan_out", "users", "first_user_line", "untested_reach", "envied", "envy_target", "affinity", "home", "split_share"}


def function_facts(spark: SparkSession, folder: str, needs: set[str] | None = None, known: Numbered | None = None) -> DataFrame:
    """Functions with the derived facts among ``needs`` (all if None), each family joined only if it is read.

    Families are joined by numbers of functions, of the model ``known`` or one made for them; ids are back at the end.
    """
    m = known or (Numbered(spark, folder) if needs is None or needs & JOINED else None)
    f = m.functions if m else relation(spark, folder, "functions").withColumn("text", F.col("id"))
    wanted = lambda *names: needs is None or bool(needs & set(names))
    named = f.withColumn("plain", F.regexp_replace("name", "[0-9]+$", ""))
    files = relation(spark, folder, "files").select(F.col("path").alias("file"), "lang", "generated", (F.col("fid") % 3 == 0).alias("owner_private"))
    out = named.join(files, "file")
    uses = m.uses if m and (needs is None or needs & (JOINED - {"cyclomatic", "cognitive", "depth", "dispatcher"})) else None
    distinct = uses and uses.where("src <> dst").select("src", "dst").distinct()
    place = f.select("id", "file", "line", "test")
    if wanted("cyclomatic", "cognitive", "depth", "dispatcher", "unit"):
        measured = metrics.measures(f, m.relation("flow"))
        if wanted("unit"):
            measured = materialize(measured)
        out = out.join(measured, "id")
        if wanted("unit"):
            out = out.join(metrics.unit_rollup(f, uses, measured.select("id", F.col("cyclomatic").alias("m"))).select("id", "unit"), "id")
    if wanted("fan_in", "fan_out"):
        out = out.join(metrics.fans(f, uses), "id")
    if wanted("users"):
        out = out.join(distinct.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("users")), "id", "left").fillna(0, ["users"])
    if wanted("first_user_line"):
        met = distinct.join(place.select(F.col("id").alias("src"), F.col("file").alias("sf"), F.col("line").alias("sl")), "src").join(place.select(F.col("id").alias("dst"), F.col("file").alias("df")), "dst")
        out = out.join(met.where("sf = df").groupBy(F.col("dst").alias("id")).agg(F.min("sl").alias("first_user_line")), "id", "left")
    if wanted("untested_reach"):
        met = distinct.join(place.select(F.col("id").alias("dst"), F.col("test").alias("t")), "dst")
        out = out.join(met.groupBy(F.col("src").alias("id")).agg(F.count_if(~F.col("t")).alias("untested_reach")), "id", "left").fillna(0, ["untested_reach"])
    if wanted("envied", "envy_target"):
        out = out.join(metrics.envy(f, uses).select("id", F.col("target").alias("envy_target"), F.col("members").alias("envied")), "id", "left")
    if wanted("affinity"):
        out = out.join(metrics.receiver_affinity(f, uses).select("id", F.col("owner").alias("affinity")), "id", "left")
    if wanted("home"):
        out = out.join(relations.home_files(f, uses), "file", "left")
    if wanted("gap"):
        out = out.join(model.siblings(spark, folder, f).select("id", "gap"), "id", "left")
    if wanted("split_share"):
        out = out.join(metrics.split_share(f, uses).select("file", F.col("share").alias("split_share")), "file", "left")
    if wanted("others"):
        out = out.join(metrics.homonyms(named.where("visibility = 'public'"), "plain", "module").select("plain", "module", "others"), ["plain", "module"], "left")
    out = out.withColumn("id", F.col("text")).drop("text")
    return out.withColumn("key", T.name_key("name")).withColumn("n_words", F.size(T.words("name")))


def test_facts(spark: SparkSession, folder: str, needs: set[str] | None = None, known: Numbered | None = None) -> DataFrame:
    return function_facts(spark, folder, needs, known).where("test")


def file_facts(spark: SparkSession, folder: str, needs: set[str] | None = None, known: Numbered | None = None) -> DataFrame:
    wanted = lambda *names: needs is None or bool(needs & set(names))
    out = relation(spark, folder, "files")
    m = known or Numbered(spark, folder)
    f = m.functions if known or wanted("private_reach", "groups") else relation(spark, folder, "functions")
    uses = m.uses if wanted("private_reach", "groups") else None
    if wanted("functions", "methods"):
        counts = f.groupBy(F.col("file").alias("path")).agg(F.count("*").alias("functions"), F.count_if(F.col("kind") == "method").alias("methods"))
        out = out.join(counts, "path", "left").fillna(0, ["functions", "methods"])
    if wanted("private_reach"):
        met = uses.where("src <> dst").select("src", "dst").distinct().join(f.select(F.col("id").alias("src"), F.col("file").alias("path")), "src").join(f.where("visibility = 'private'").select(F.col("id").alias("dst"), F.col("file").alias("df")), "dst")
        out = out.join(met.where("path <> df").groupBy("path").agg(F.countDistinct("dst").alias("private_reach")), "path", "left").fillna(0, ["private_reach"])
    if wanted("groups"):
        out = out.join(metrics.cohesion(f, uses).select(F.col("owner").alias("type_id"), "groups"), "type_id", "left").fillna(0, ["groups"])
    return out


def module_facts(spark: SparkSession, folder: str, needs: set[str] | None = None, known: Numbered | None = None) -> DataFrame:
    m = known or Numbered(spark, folder)
    stats = model.module_stats(spark, folder, m)
    if needs is not None and "cycle_size" not in needs:
        return stats
    found = graphs.strong_components(m.module_edges)
    size = found.groupBy("component").agg(F.count("*").alias("cycle_size"))
    return stats.join(found.join(size, "component").select(F.col("node").alias("path"), "cycle_size"), "path", "left").fillna(1, ["cycle_size"])


def edge_facts(spark: SparkSession, folder: str, needs: set[str] | None = None, known: Numbered | None = None) -> DataFrame:
    e = (known or Numbered(spark, folder)).module_edges
    out = e.select("src", "dst", F.substring_index("src", "/", 1).alias("src_region"), F.substring_index("dst", "/", 1).alias("dst_region"))
    if needs is None or "mutual" in needs:
        back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("mutual"))
        out = out.join(back, ["src", "dst"], "left").fillna(False, ["mutual"])
    return out


def symbol_facts(spark: SparkSession, folder: str, needs: set[str] | None = None, known: Numbered | None = None) -> DataFrame:
    """All declarations, with whether tests use them."""
    touched = needs is None or needs & {"touched", "module_tested"}
    m = (known or Numbered(spark, folder)) if touched else None
    out = (m.relation("symbols") if m else relation(spark, folder, "symbols")).withColumn("n_words", F.length("name") - F.length(F.replace(F.col("name"), F.lit("_"))) + 1)
    if m:
        out = out.join(relations.tested(m.functions, m.uses), "id", "left").fillna(False, ["touched", "module_tested"])
        out = m.named(out, "id")
    return out


def annotation_facts(spark: SparkSession, folder: str, needs: set[str] | None = None, known: Numbered | None = None) -> DataFrame:
    return relation(spark, folder, "annotations")


def decision_facts(spark: SparkSession, folder: str, needs: set[str] | None = None, known: Numbered | None = None) -> DataFrame:
    r = relation(spark, folder, "rules").withColumn("n_words", F.length("name") - F.length(F.replace(F.col("name"), F.lit("-"))) + 1)
    if needs is not None and not needs & {"rival", "contradicts"}:
        return r
    pairs = conditions.condition_conflicts(spark, folder)
    either = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "overlap", "b_in_a", "a_in_b"))
    proven = F.col("a_in_b") | F.col("b_in_a")
    met = either.where("overlap").groupBy(F.col("a").alias("rid")).agg(F.min(F.when(~proven, F.col("b"))).alias("rival"), F.min(F.when(proven, F.col("b"))).alias("contradicts"))
    return r.join(met, "rid", "left")


def event_facts(spark: SparkSession, folder: str, needs: set[str] | None = None, known: Numbered | None = None) -> DataFrame:
    e = read_table(spark, folder, "events")
    ordinal = F.row_number().over(Window.partitionBy("user_id", "event_type", F.to_date("ts")).orderBy("ts", "event_id")) - 1
    return e.select(F.concat(F.lit("u"), "user_id").alias("owner"), F.col("event_type").alias("kind"), "value", ordinal.cast("long").alias("ordinal"), F.col("event_id").alias("line"))


def line_facts(spark: SparkSession, folder: str, needs: set[str] | None = None, known: Numbered | None = None) -> DataFrame:
    """Lines of every document; what stands after a line is found within its text."""
    d = read_table(spark, folder, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("owner"), T.lines("text").alias("x"))
    d = d.select("owner", "x", F.posexplode("x").alias("pos", "t"))
    trimmed = F.trim("t")
    return d.select("owner", (F.col("pos") + 1).cast("long").alias("line"), trimmed.alias("trimmed"), F.char_length("t").cast("long").alias("width"), T.unbreakable(trimmed).alias("exempt"), (trimmed == "").alias("blank"), F.coalesce(F.char_length(F.get("x", F.col("pos") + 1)), F.lit(0)).cast("long").alias("next_width"), (F.trim(F.coalesce(F.get("x", F.col("pos") + 1), F.lit(""))) == "").alias("next_blank"))


FACTS = {"function": function_facts, "test": test_facts, "file": file_facts, "module": module_facts, "edge": edge_facts, "event": event_facts, "line": line_facts, "symbol": symbol_facts, "annotation": annotation_facts, "decision": decision_facts}


def _query(d: Decision):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return evaluate(_for_spark(d), FACTS[d.select](spark, folder, _needs(d)))

    return run


def decision_max_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with more lines than the limit, as findings; the flagship of the library."""
    lines = F.size(F.split("text", "\n"))
    path = F.concat(F.lit("doc/"), F.col("doc_id"))
    return (
        read_table(spark, folder, "documents")
        .select(path.alias("path"), lines.cast("long").alias("n_lines"))
        .where("n_lines > 20")
        .select("path", "n_lines", F.concat(F.lit("file has "), F.col("n_lines"), F.lit(" lines; at most 20 are allowed")).alias("message"), T.fingerprint(F.lit("core/max-lines"), F.col("path"), F.lit("")).alias("fingerprint"))
    )


def check_all(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of all decisions counted by decision, but owner-file's, which SQL can't state and which has a query of its own.

    The facts of each kind of subject, with what any of its decisions reads, are derived and judged in one pass; tests are functions.
    """
    some = [_for_spark(d) for d in DECISIONS if d.name not in NO_SQL]
    needs = {kind: set().union(*(_needs(d) for d in some if d.select == kind)) for kind in {d.select for d in some}}
    m = Numbered(spark, folder)
    needs["function"] |= needs.pop("test")
    kind = lambda d: "function" if d.select == "test" else d.select
    facts = {k: FACTS[k](spark, folder, of, m) for k, of in needs.items()}
    found = functools.reduce(DataFrame.union, [violations([d for d in some if kind(d) == k], of) for k, of in facts.items()])
    return found.groupBy("decision", "severity").agg(F.count("*").alias("findings"), F.countDistinct("path").alias("paths"))


def check_incomplete(spark: SparkSession, folder: str) -> DataFrame:
    """Functions that a decision on gaps cannot judge, as they have no sibling."""
    d = RULES["vertical-distance"]
    return incomplete(_for_spark(d), FACTS[d.select](spark, folder, _needs(d)))


QUERIES |= {"decision_" + d.name.replace("-", "_"): _query(d) for d in DECISIONS if d.name != "max-lines"}
QUERIES |= {"decision_max_lines": decision_max_lines, "decision_file_lines": _query(RULES["max-lines"]), "check_all": check_all, "check_incomplete": check_incomplete}

FUNCTION_SQL = with_sql("modules", "files", "functions", "uses", "flow") + model.USED + model.CYCLO + """,
w0 AS (SELECT DISTINCT src, dst FROM uses WHERE src <> dst),
s1 AS (SELECT u.dst AS id, min(u.src) AS caller FROM u GROUP BY u.dst HAVING count(*) = 1),
t1 AS (SELECT s1.id, s1.caller FROM s1 JOIN functions a ON a.id = s1.id JOIN functions b ON b.id = s1.caller WHERE a.module = b.module AND a.visibility = 'private'),
q1 AS (SELECT id, caller AS root FROM t1 UNION SELECT q1.id, t1.caller FROM q1 JOIN t1 ON q1.root = t1.id),
unit AS (SELECT m.id, CAST(m.m + coalesce((SELECT sum(h.m - 1) FROM q1 JOIN m h ON h.id = q1.id WHERE q1.root = m.id AND q1.id <> m.id), 0) AS BIGINT) AS unit FROM m),
mm AS (SELECT f.id, CAST(coalesce(sum(CASE WHEN w.kind IN ('if', 'switch', 'loop', 'catch') THEN 1 + nesting WHEN w.kind IN ('else-if', 'else', 'logic') THEN 1 ELSE 0 END), 0) AS BIGINT) AS cognitive,
 coalesce(max(nesting), 0) AS depth, count(*) FILTER (w.kind = 'switch') = 1 AND count(*) FILTER (w.kind IN ('if', 'loop', 'catch')) = 0 AS dispatcher FROM functions f LEFT JOIN flow w ON w.symbol = f.id GROUP BY f.id),
fi AS (SELECT u.dst AS id, count(*) AS n FROM u JOIN functions c ON c.id = u.src JOIN functions d ON d.id = u.dst WHERE c.module = d.module AND NOT c.test GROUP BY 1),
fo AS (SELECT src AS id, count(*) AS n FROM u GROUP BY 1),
us AS (SELECT dst AS id, count(*) AS n FROM w0 GROUP BY 1),
fu AS (SELECT w0.dst AS id, min(a.line) AS l FROM w0 JOIN functions a ON a.id = w0.src JOIN functions b ON b.id = w0.dst WHERE a.file = b.file GROUP BY 1),
ur AS (SELECT w0.src AS id, count(*) FILTER (NOT b.test) AS n FROM w0 JOIN functions b ON b.id = w0.dst GROUP BY 1),
ec AS (SELECT x.src AS id, d.owner AS target, count(DISTINCT x.dst) AS members FROM uses x JOIN functions s ON s.id = x.src JOIN functions d ON d.id = x.dst WHERE x.resolution <> 'heuristic' AND d.owner IS NOT NULL AND d.owner IS DISTINCT FROM s.owner GROUP BY ALL),
en AS (SELECT id, target, members FROM ec WHERE members >= 2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY members DESC, target) = 1),
ra AS (SELECT d.id, min(s.owner) AS owner FROM u JOIN functions s ON s.id = u.src JOIN functions d ON d.id = u.dst WHERE d.kind = 'function' AND d.visibility = 'private' GROUP BY d.id HAVING count(*) = count(s.owner) AND count(DISTINCT s.owner) = 1),
ga AS (SELECT id, CASE WHEN owner IS NOT NULL THEN line - lag(end_line) OVER (PARTITION BY file, owner ORDER BY line) END AS gap FROM functions),
pl AS (SELECT DISTINCT regexp_replace(name, '[0-9]+$', '') AS plain, module FROM functions WHERE visibility = 'public'),
hn AS (SELECT t.file, f.file AS home, count(DISTINCT (x.src, x.dst)) AS n FROM uses x JOIN functions t ON t.id = x.src JOIN functions f ON f.id = x.dst WHERE t.test AND NOT f.test AND x.src <> x.dst GROUP BY ALL),
hf AS (SELECT file, home FROM hn QUALIFY row_number() OVER (PARTITION BY file ORDER BY n DESC, home) = 1),
te AS (SELECT plain, module, count(*) OVER (PARTITION BY plain) - 1 AS others FROM pl QUALIFY others > 0),
function_facts AS (SELECT f.*, regexp_replace(f.name, '[0-9]+$', '') AS plain, fl.lang, fl.generated, fl.fid % 3 = 0 AS owner_private, m.m AS cyclomatic, mm.cognitive, mm.depth, mm.dispatcher, unit.unit,
 coalesce(fi.n, 0) AS fan_in, coalesce(fo.n, 0) AS fan_out, coalesce(us.n, 0) AS users, fu.l AS first_user_line, coalesce(ur.n, 0) AS untested_reach, en.target AS envy_target, en.members AS envied, ra.owner AS affinity, ga.gap, hf.home,
 te.others, array_to_string(list_filter(string_split_regex(lower(f.name), '[_-]+'), lambda x: x <> ''), '_') AS key, len(list_filter(string_split_regex(lower(f.name), '[_-]+'), lambda x: x <> '')) AS n_words
 FROM functions f JOIN files fl ON fl.path = f.file JOIN m ON m.id = f.id JOIN mm ON mm.id = f.id JOIN unit ON unit.id = f.id LEFT JOIN fi ON fi.id = f.id LEFT JOIN fo ON fo.id = f.id LEFT JOIN us ON us.id = f.id
 LEFT JOIN fu ON fu.id = f.id LEFT JOIN ur ON ur.id = f.id LEFT JOIN en ON en.id = f.id LEFT JOIN ra ON ra.id = f.id LEFT JOIN ga ON ga.id = f.id LEFT JOIN hf ON hf.file = f.file LEFT JOIN te ON te.plain = regexp_replace(f.name, '[0-9]+$', '') AND te.module = f.module)
"""
SQL_FACTS = {
    "function": FUNCTION_SQL,
    "test": FUNCTION_SQL + ", test_facts AS (SELECT * FROM function_facts WHERE test)\n",
    "file": with_sql("files", "functions", "uses") + model.USED + """,
ms AS (SELECT id, owner FROM functions WHERE owner IS NOT NULL),
l AS (SELECT a.id AS x, b.id AS y FROM u JOIN ms a ON a.id = u.src JOIN ms b ON b.id = u.dst WHERE a.owner = b.owner UNION SELECT a.id, b.id FROM u JOIN u v ON u.dst = v.dst JOIN ms a ON a.id = u.src JOIN ms b ON b.id = v.src WHERE a.owner = b.owner AND a.id <> b.id),
p AS (SELECT x, y FROM l UNION SELECT y, x FROM l), r AS (SELECT id AS x, id AS y FROM ms UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x), c AS (SELECT x, min(y) AS c FROM r GROUP BY x),
g AS (SELECT owner, count(DISTINCT c.c) AS groups FROM ms JOIN c ON c.x = ms.id GROUP BY owner),
pr AS (SELECT a.file AS path, count(DISTINCT b.id) AS n FROM uses x JOIN functions a ON a.id = x.src JOIN functions b ON b.id = x.dst WHERE a.file <> b.file AND b.visibility = 'private' GROUP BY 1),
file_facts AS (SELECT f.*, (SELECT count(*) FROM functions x WHERE x.file = f.path) AS functions, (SELECT count(*) FROM functions x WHERE x.file = f.path AND x.kind = 'method') AS methods, coalesce(pr.n, 0) AS private_reach, coalesce(g.groups, 0) AS groups
 FROM files f LEFT JOIN pr ON pr.path = f.path LEFT JOIN g ON g.owner = f.type_id)
""",
    "module": model.ORACLE["module_stats"].replace("SELECT m.path, (", ", st AS (SELECT m.path, (", 1) + """),
rm AS (SELECT src, dst FROM module_edges UNION SELECT rm.src, e.dst FROM rm JOIN module_edges e ON rm.dst = e.src),
cy AS (SELECT a.src AS node, count(DISTINCT a.dst) AS n FROM rm a JOIN rm b ON a.dst = b.src AND a.src = b.dst GROUP BY 1),
module_facts AS (SELECT st.*, greatest(1, coalesce(cy.n, 1)) AS cycle_size FROM st LEFT JOIN cy ON cy.node = st.path)
""",
    "edge": with_sql("module_edges") + ", edge_facts AS (SELECT src, dst, split_part(src, '/', 1) AS src_region, split_part(dst, '/', 1) AS dst_region, EXISTS (SELECT 1 FROM module_edges r WHERE r.src = e.dst AND r.dst = e.src) AS mutual FROM module_edges e)\n",
    "symbol": with_sql("symbols", "functions", "uses") + """,
symbol_facts AS (SELECT s.*, length(name) - length(replace(name, '_', '')) + 1 AS n_words, s.id IN (SELECT u.dst FROM uses u JOIN functions t ON t.id = u.src WHERE t.test AND u.src <> u.dst) AND NOT (SELECT test FROM functions f WHERE f.id = s.id) AS touched,
 s.module IN (SELECT module FROM functions WHERE test) AND NOT (SELECT test FROM functions f WHERE f.id = s.id) AS module_tested FROM symbols s)
""",
    "annotation": with_sql("annotations") + ", annotation_facts AS (SELECT * FROM annotations)\n",
    "decision": with_sql("rules") + conditions.PAIRS_SQL + """,
e AS (SELECT * FROM pairs UNION ALL SELECT b, a, overlap, b_in_a, a_in_b FROM pairs),
n AS (SELECT a AS rid, min(b) FILTER (NOT (a_in_b OR b_in_a)) AS rival, min(b) FILTER (a_in_b OR b_in_a) AS contradicts FROM e WHERE overlap GROUP BY a),
decision_facts AS (SELECT r.*, n.rival, n.contradicts, length(name) - length(replace(name, '-', '')) + 1 AS n_words FROM rules r LEFT JOIN n USING (rid))
""",
    "event": "WITH event_facts AS (SELECT 'u' || user_id AS owner, event_type AS kind, value, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS ordinal, event_id AS line FROM events)\n",
    "line": r"""WITH x AS (SELECT 'doc/' || doc_id AS owner, CASE WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[1:-2] ELSE string_split(text, chr(10)) END AS x FROM documents),
y AS (SELECT owner, unnest(x) AS t, generate_subscripts(x, 1) AS line FROM x),
z AS (SELECT owner, line, regexp_replace(t, '\r$', '') AS t, lead(regexp_replace(t, '\r$', '')) OVER (PARTITION BY owner ORDER BY line) AS nt FROM y),
line_facts AS (SELECT owner, line, trim(t) AS trimmed, length(t) AS width, regexp_matches(trim(t), '^(import |import\(|use |from )')
 OR CASE WHEN regexp_matches(trim(t), '^(///|//!|//|/\*|\*/|\*|#|--)') THEN regexp_matches(trim(regexp_replace(trim(regexp_replace(trim(t), '^(///|//!|//|/\*|\*/|\*|#|--)', '')), '(\*/)+$', '')), '^\S*://\S+$') ELSE regexp_matches(trim(t), '^("[^"]*"|`[^`]*`)[,;]?$') END AS exempt,
 trim(t) = '' AS blank, coalesce(length(nt), 0) AS next_width, trim(coalesce(nt, '')) = '' AS next_blank FROM z)
""",
}


def _findings_sql(d: Decision) -> str:
    inner = "*" + "".join(f", {_duck(e)} AS {n}" for n, e in d.variables)
    return f"""SELECT '{d.name}' AS decision, '{d.severity}' AS severity, {d.path} AS path, CAST(greatest(1, {d.line}) AS BIGINT) AS line, {d.message} AS message,
sha256('{d.name}' || chr(0) || ({d.path}) || chr(0) || trim(regexp_replace({d.identity}, '\\s+', ' ', 'g'))) AS fingerprint
FROM (SELECT {inner} FROM {d.select}_facts WHERE {d.scope()}) WHERE {_duck(d.condition)}"""


ORACLE |= {"decision_" + d.name.replace("-", "_"): SQL_FACTS[d.select] + _findings_sql(d) for d in DECISIONS if d.name not in NO_SQL | {"max-lines"}}


def _check_sql() -> str:
    """All decisions' findings by kind of subject, each kind's facts once."""
    kinds = {}
    for d in DECISIONS:
        if d.name not in NO_SQL:
            kinds.setdefault(d.select, []).append(f"SELECT decision, severity, path FROM ({_findings_sql(d)})")
    parts = [f"(SELECT * FROM ({SQL_FACTS[kind]} {' UNION ALL '.join(of)}))" for kind, of in kinds.items()]
    return f"SELECT decision, severity, count(*) AS findings, count(DISTINCT path) AS paths FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


ORACLE |= {
    "check_all": _check_sql(),
    "decision_file_lines": SQL_FACTS["file"] + _findings_sql(RULES["max-lines"]),
    "check_incomplete": SQL_FACTS["function"] + "SELECT 'vertical-distance' AS decision, count(*) FILTER (gap IS NULL) AS incomplete FROM function_facts WHERE NOT generated",
    "decision_max_lines": """SELECT path, n_lines, 'file has ' || n_lines || ' lines; at most 20 are allowed' AS message, sha256('core/max-lines' || chr(0) || path || chr(0)) AS fingerprint
FROM (SELECT 'doc/' || doc_id AS path, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines FROM documents) WHERE n_lines > 20""",
}

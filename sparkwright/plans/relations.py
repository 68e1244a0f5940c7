"""Queries on imports, tests, references, prefixes, budgets and reviews over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkwright.operators import relations as R
from sparkwright.sources.scratch import read_table
from sparkwright.sources.tables import Numbered, relation, with_sql

QUERIES = {}
ORACLE = {}


def imports(spark, folder):
    """Modules that each module uses."""
    return R.imports(Numbered(spark, folder).module_edges)


def module_collisions(spark, folder):
    """Symbol names declared in files of several languages."""
    return R.collisions(relation(spark, folder, "symbols"), "plain", "lang")


def tested_symbols(spark, folder):
    m = Numbered(spark, folder)
    return m.named(R.tested(m.functions, m.relation("uses")), "id")


def home_files(spark, folder):
    m = Numbered(spark, folder)
    return R.home_files(m.functions, m.relation("uses"))


def reference_sites(spark, folder):
    return R.reference_sites(relation(spark, folder, "uses"), relation(spark, folder, "functions"))


def _prints(spark, folder):
    return read_table(spark, folder, "orders").select("o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("fingerprint"))


def prefix_lookup(spark, folder):
    """The beginnings of customers' digests, of two to five characters, among the digests of orders."""
    c = read_table(spark, folder, "customer")
    asked = c.select(F.left(F.sha2(F.col("c_custkey").cast("string"), 256), (2 + F.col("c_custkey") % 4).cast("int")).alias("prefix")).distinct()
    return R.by_prefix(_prints(spark, folder), asked)


def findings_order(spark, folder):
    """Findings in the order of file, place and rule, within each file."""
    e = read_table(spark, folder, "events")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_type", "event_id"))
    return e.select(F.concat(F.lit("u"), "user_id").alias("file"), "event_id", place.cast("long").alias("place"))


def slowest_rules(spark, folder):
    """The five kinds of orders that took most, of all lines."""
    li = read_table(spark, folder, "lineitem").join(read_table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    took = li.groupBy(F.concat("o_orderpriority", F.lit("/"), "l_returnflag").alias("rule")).agg(F.sum(F.col("l_quantity").cast("long")).alias("took"))
    return took.orderBy(F.desc("took"), "rule").limit(5)


def status_filter(spark, folder):
    """Findings by the states that a filter names: open, narrowing (known lines only), suppressed, resolved."""
    o = read_table(spark, folder, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderpriority").startswith("5"), "suppressed").when(F.col("o_totalprice") < 100000, "narrowing").otherwise("open")
    return o.select("o_orderkey", state.alias("state")).where("state in ('open', 'narrowing')")


def evidence_digest(spark, folder):
    o = read_table(spark, folder, "orders")
    return o.select("o_orderkey", R.evidence_digest(F.concat(F.lit(" at \t"), "o_orderstatus"), "o_orderpriority", F.col("o_custkey").cast("string")).alias("digest"))


def meaning_version(spark, folder):
    """A version of each decision's meaning: severity, requirement and options as text."""
    r = relation(spark, folder, "rules")
    return r.select("rid", F.left(F.sha2(F.concat_ws("\x00", "name", "pack", "severity"), 256), F.lit(12)).alias("version"))


def budget_trim(spark, folder):
    """Orders of a year as blobs of a kind, trimmed to a budget."""
    li = read_table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("bytes"), F.count("*").alias("cost"))
    o = read_table(spark, folder, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    blobs = o.select(F.year("o_orderdate").alias("kind"), F.col("o_orderkey").alias("id"), "bytes", "cost", (F.col("o_orderstatus") == "F").cast("int").alias("durable"), F.col("o_orderdate").alias("used_at"))
    return R.trim_to_budget(blobs, 50_000)


def ask_once(spark, folder):
    """Signals of a user and kind on a day: the first asks."""
    e = read_table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    return R.ask_once(e, ["user_id", "event_type", "day"], ["ts", "event_id"]).select("event_id", "asks")


def sighting_cleanup(spark, folder):
    """Customers (sightings) without an order that is still open (finding): these go."""
    left = read_table(spark, folder, "orders").where("o_orderstatus = 'O' and o_orderpriority = '1-URGENT'")
    return read_table(spark, folder, "customer").join(left, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def sighting_findings(spark, folder):
    """Findings with the latest time at which they were seen and how many saw them."""
    seen = read_table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("latest"), F.count("*").alias("sightings"))
    return read_table(spark, folder, "customer").join(seen, "c_custkey").select("c_custkey", F.date_format("latest", "yyyy-MM-dd").alias("latest"), "sightings")


def _judged(spark, folder):
    """Documents with the share of bad ones among labelled documents like them, and whether they are bad."""
    d = read_table(spark, folder, "documents").select("doc_id", "lang", (F.col("text").contains("&&&") | F.col("text").contains(" | ")).alias("marked"))
    bad = read_table(spark, folder, "labels").select("doc_id", (F.col("quality") == 0).alias("bad"))
    like = d.join(bad, "doc_id").groupBy("lang", "marked").agg(((F.count_if("bad") + 1) / (F.count("*") + 2)).alias("p"))
    return d.join(like, ["lang", "marked"], "left").join(bad, "doc_id", "left")


def model_review(spark, folder):
    """What becomes of every document: it fails where bad documents like it are nine in ten or more, else it is left to review."""
    r = R.review(_judged(spark, folder))
    return r.select("doc_id", "verdict", (F.floor(F.col("confidence") * 10000 + 0.5) / 10000).alias("confidence"))


def selector_quality(spark, folder):
    return R.selector_quality(_judged(spark, folder).where("bad is not null"), "marked", "bad")


NAMED = (imports, module_collisions, tested_symbols, home_files, reference_sites, prefix_lookup, findings_order, slowest_rules, status_filter, evidence_digest, meaning_version, budget_trim, ask_once, sighting_cleanup, sighting_findings, model_review, selector_quality)
QUERIES |= {f.__name__: f for f in NAMED}

JUDGED = """j AS (SELECT d.doc_id, d.lang, contains(text, '&&&') OR contains(text, ' | ') AS marked, l.quality = 0 AS bad FROM documents d LEFT JOIN labels l USING (doc_id)),
k AS (SELECT lang, marked, (count(*) FILTER (bad) + 1) / (count(*) + 2) AS p FROM j WHERE bad IS NOT NULL GROUP BY ALL)"""
ORACLE |= {
    "imports": with_sql("module_edges") + " SELECT src AS module, string_agg(dst, ',' ORDER BY dst) AS targets FROM module_edges GROUP BY src",
    "module_collisions": with_sql("symbols") + " SELECT plain, count(DISTINCT lang) AS languages FROM symbols GROUP BY plain HAVING count(DISTINCT lang) > 1",
    "tested_symbols": with_sql("functions", "uses") + """ SELECT id, EXISTS (SELECT 1 FROM uses u JOIN functions t ON t.id = u.src WHERE t.test AND u.dst = f.id AND u.src <> u.dst) AS touched,
 module IN (SELECT module FROM functions WHERE test) AS module_tested FROM functions f WHERE NOT test""",
    "home_files": with_sql("functions", "uses") + """, n AS (SELECT t.file, f.file AS home, count(DISTINCT (u.src, u.dst)) AS n FROM uses u JOIN functions t ON t.id = u.src JOIN functions f ON f.id = u.dst
 WHERE t.test AND NOT f.test AND u.src <> u.dst GROUP BY ALL) SELECT file, home FROM n QUALIFY row_number() OVER (PARTITION BY file ORDER BY n DESC, home) = 1""",
    "reference_sites": with_sql("functions", "uses") + """, s AS (SELECT DISTINCT u.dst, f.file, f.line FROM uses u JOIN functions f ON f.id = u.src WHERE u.src <> u.dst)
 SELECT dst, file, line, row_number() OVER (PARTITION BY dst ORDER BY file, line) - 1 AS ordinal FROM s""",
    "prefix_lookup": """WITH a AS (SELECT DISTINCT left(sha256(CAST(c_custkey AS VARCHAR)), 2 + c_custkey % 4) AS prefix FROM customer), f AS (SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS fingerprint FROM orders),
m AS (SELECT a.prefix, count(f.fingerprint) AS n, min(f.fingerprint) AS one FROM a LEFT JOIN f ON left(f.fingerprint, length(a.prefix)) = a.prefix GROUP BY 1)
SELECT prefix, least(n, 6) AS n, CASE WHEN n = 1 THEN one END AS fingerprint FROM m""",
    "findings_order": "SELECT 'u' || user_id AS file, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type, event_id) AS place FROM events",
    "slowest_rules": "SELECT o_orderpriority || '/' || l_returnflag AS rule, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS took FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 ORDER BY took DESC, rule LIMIT 5",
    "status_filter": """SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '5%' THEN 'suppressed' WHEN o_totalprice < 100000 THEN 'narrowing' ELSE 'open' END AS state FROM orders
WHERE o_orderstatus <> 'F' AND o_orderpriority NOT LIKE '5%'""",
    "evidence_digest": r"SELECT o_orderkey, left(sha256(regexp_replace(' at ' || chr(9) || o_orderstatus || '|' || o_orderpriority || '|' || o_custkey, '\s+', ' ', 'g')), 16) AS digest FROM orders",
    "meaning_version": with_sql("rules") + " SELECT rid, left(sha256(name || chr(0) || pack || chr(0) || severity), 12) AS version FROM rules",
    "budget_trim": """WITH l AS (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes, count(*) AS cost FROM lineitem GROUP BY 1),
b AS (SELECT year(o_orderdate) AS kind, o_orderkey AS id, bytes, sum(bytes) OVER (PARTITION BY year(o_orderdate)) AS every,
 sum(bytes) OVER (PARTITION BY year(o_orderdate) ORDER BY CAST(o_orderstatus = 'F' AS INT), bytes / (cost + 1) DESC, o_orderdate, o_orderkey) - bytes AS before FROM orders JOIN l ON l_orderkey = o_orderkey)
SELECT kind, id, CAST(before AS BIGINT) AS before FROM b WHERE before < every - 50000""",
    "ask_once": "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) = 1 AS asks FROM events",
    "sighting_cleanup": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')",
    "sighting_findings": "SELECT c_custkey, strftime(max(o_orderdate), '%Y-%m-%d') AS latest, count(*) AS sightings FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "model_review": "WITH " + JUDGED + " SELECT doc_id, CASE WHEN p >= 0.9 THEN 'fail' ELSE 'review' END AS verdict, CASE WHEN p >= 0.9 THEN floor(greatest(p, 1 - p) * 10000 + 0.5) / 10000 END AS confidence FROM j LEFT JOIN k USING (lang, marked)",
    "selector_quality": "WITH " + JUDGED + """ SELECT count(*) AS subjects, count(*) FILTER (marked) AS selected, floor(count(*) FILTER (marked AND bad) / nullif(count(*) FILTER (marked), 0) * 10000 + 0.5) / 10000 AS precision,
 floor(count(*) FILTER (marked AND bad) / nullif(count(*) FILTER (bad), 0) * 10000 + 0.5) / 10000 AS coverage FROM j WHERE bad IS NOT NULL""",
}

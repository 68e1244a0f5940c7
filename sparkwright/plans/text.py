"""Queries of name, line and list functions over the tables' texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkwright.functions import lists as L
from sparkwright.functions import text as T
from sparkwright.operators import joins
from sparkwright.sources.scratch import read_table

QUERIES = {}
ORACLE = {}


def name_words(spark, folder):
    """Words, keys and test names of identifiers made of part names."""
    p = read_table(spark, folder, "part")
    name = F.concat(F.regexp_replace(F.initcap("p_name"), " ", ""), F.upper(F.substring("p_type", 1, 3)), F.initcap(F.lower("p_type")), F.when(F.col("p_partkey") % 3 == 0, "_x").otherwise("-y"))
    return p.select("p_partkey", name.alias("name")).select("p_partkey", F.size(T.words("name")).cast("long").alias("n"), T.name_key("name").alias("key"), T.snake("name").alias("snake"))


def line_widths(spark, folder):
    """Lines, widest line and unbreakable lines of every document."""
    d = read_table(spark, folder, "documents").select("doc_id", T.line_widths("text").alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("lines"), F.array_max(F.transform("w", lambda x: x["width"])).alias("widest"), F.size(F.filter("w", lambda x: x["exempt"])).cast("long").alias("exempt"))


def glob_scopes(spark, folder):
    """Which path globs take which page address."""
    p = read_table(spark, folder, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"\?.*$", "").alias("path"))
    globs = {"any": "**", "en": "*/en/**", "deep": "*/*/*/**", "exact": "*/fr/*", "colons": "*::de::**", "part": "th*.example.com/**"}
    return p.select("page_id", *(T.glob_matches("path", g).alias(name) for name, g in globs.items()))


def path_parts(spark, folder):
    p = read_table(spark, folder, "pages")
    return p.select("page_id", T.file_stem(F.regexp_replace("url", r"\?.*$", "")).alias("stem"), T.position(F.col("page_id"), F.length("url")).alias("pos"), F.sha2(T.squash("html"), 256).alias("squashed"))


def regex_functions(spark, folder):
    """First, all and limited matches of an expression."""
    p = read_table(spark, folder, "part")
    first = F.when(F.col("p_brand").rlike("[0-9]+"), F.regexp_extract("p_brand", "([0-9]+)", 1))
    return p.select("p_partkey", first.alias("first"), F.array_join(F.regexp_extract_all("p_name", F.lit("([aeiou])[a-z]"), F.lit(1)), ",").alias("every"), T.limited_replace("p_name", "[aeiou]", "x", 2).alias("two"), F.regexp_replace("p_name", "(e)([a-z])", "$2$1").alias("swapped"))


def list_functions(spark, folder):
    """List functions over the quantities of an order's lines."""
    li = read_table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q")))).alias("a"))
    li = li.select("l_orderkey", F.transform("a", lambda x: x["q"]).alias("q"))
    q = F.col("q")
    join = lambda c: F.array_join(c.cast("array<string>"), ",")
    return li.select(
        "l_orderkey",
        L.index_of(q, F.lit(10)).alias("first_ten"),
        L.last_index_of(q, F.lit(10)).alias("last_ten"),
        join(L.slice_from(q, 1, 3)).alias("middle"),
        L.exists_one(q, lambda x: x > 40).alias("one_large"),
        join(F.array_sort(F.array_distinct(q))).alias("distinct_sorted"),
        F.forall(q, lambda x: x > 5).alias("all_above"),
        F.coalesce(F.try_element_at(q, F.lit(4)), F.lit(-1)).cast("long").alias("fourth"),
        join(L.anchors(q)).alias("anchors"),
    )


def misplaced_lines(spark, folder):
    """Lines of an order out of the order of their ship dates, and their rank if users come first."""
    li = read_table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.datediff("l_shipdate", F.lit("1990-01-01")).alias("d"), F.col("l_quantity").cast("int").alias("q")))).alias("a"))
    li = li.select("l_orderkey", F.transform("a", lambda x: x["d"]).alias("d"), F.transform("a", lambda x: F.array(x["q"] % 7, x["l_partkey"].cast("int") % 5)).alias("u"))
    return li.select("l_orderkey", F.array_join(L.misplaced(F.col("d")).cast("array<string>"), ",").alias("misplaced"), F.array_join(L.users_first(F.col("u")).cast("array<string>"), ",").alias("ranks"))


def previous_purchase(spark, folder):
    """Every error with the user's nearest purchase before it, as of its time."""
    e = read_table(spark, folder, "events")
    left = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase"))
    return joins.asof(left, right, ["user_id"], "ts", "purchase", F.date_trunc("day", "ts")).select("event_id", "purchase")


def next_purchase(spark, folder):
    """Every error with the user's nearest purchase after it."""
    e = read_table(spark, folder, "events")
    left = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase"))
    return joins.asof(left, right, ["user_id"], "ts", "purchase", F.date_trunc("day", "ts"), forward=True, strict=True).select("event_id", "purchase")


def enclosing_order(spark, folder):
    """Every day of a customer's orders with the innermost span of an order that covers it."""
    o = read_table(spark, folder, "orders")
    day = F.datediff("o_orderdate", F.lit("1990-01-01"))
    spans = o.select("o_custkey", day.alias("a"), (day + F.col("o_orderkey") % 200).alias("b"), F.col("o_orderkey").alias("span"))
    points = o.select("o_custkey", F.col("o_orderkey").alias("k"), (day + 60).alias("at"))
    return joins.innermost(points, spans, ["o_custkey"], "at", "a", "b", "span", 100).select("k", "span")


def cache_trim(spark, folder):
    """Orders, largest price first within a customer, that go until an excess is freed: a running sum of what went before."""
    o = read_table(spark, folder, "orders")
    before = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey").rowsBetween(Window.unboundedPreceding, -1))
    return o.withColumn("b", F.coalesce(before, F.lit(0))).where("b < 500000").select("o_orderkey", F.col("b").cast("double").alias("freed_before"))


def event_ordinals(spark, folder):
    """The how-manieth event of its kind on its day an event is."""
    e = read_table(spark, folder, "events")
    w = Window.partitionBy("user_id", "event_type", F.to_date("ts")).orderBy("ts", "event_id")
    return e.select("event_id", (F.row_number().over(w) - 1).cast("long").alias("ordinal"))


def layer_contract(spark, folder):
    """Trade between nations whose regions a layer rule forbids: a region may only sell to itself or to later ones."""
    t = lambda n: read_table(spark, folder, n)
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat(F.lower(F.regexp_replace("r_name", " ", "_")), F.lit("/"), F.lower("n_name")).alias("path"))
    layers = {"africa/**": 0, "am*/**": 1, "asia/*": 2, "europe/**": 3, "middle_*/**": 4}
    level = F.coalesce(*(F.when(T.glob_matches("path", g), i) for g, i in layers.items()))
    n = n.withColumn("level", level)
    s = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    e = s.select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).distinct()
    a, b = n.select(F.col("n_nationkey").alias("src"), F.col("path").alias("src_path"), F.col("level").alias("sl")), n.select(F.col("n_nationkey").alias("dst"), F.col("path").alias("dst_path"), F.col("level").alias("dl"))
    ignored = T.glob_matches("src_path", "**/nation_7") | T.glob_matches("dst_path", "asia/*_2*")
    return e.join(a, "src").join(b, "dst").where((F.col("dl") < F.col("sl")) & ~ignored).select("src_path", "dst_path")


def json_select(spark, folder):
    """Values in events' properties as trees: a path, a filter on it, and its fields."""
    e = read_table(spark, folder, "events").withColumn("v", F.parse_json("props"))
    k = F.try_variant_get("v", "$.k", "int")
    none = F.try_variant_get("v", "$.none", "string")
    return e.where((k >= 50) & (k % 2 == 0)).select("event_id", k.cast("long").alias("k"), none.isNull().alias("missing"), F.schema_of_variant("v").alias("shape"))


NAMED = (name_words, line_widths, glob_scopes, path_parts, regex_functions, list_functions, misplaced_lines, previous_purchase, next_purchase, enclosing_order, cache_trim, event_ordinals, layer_contract, json_select)
QUERIES |= {f.__name__: f for f in NAMED}

ORACLE |= {
    "name_words": r"""WITH n AS (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), '') || upper(substr(p_type, 1, 3)) || upper(p_type[1]) || lower(p_type[2:]) || CASE WHEN p_partkey % 3 = 0 THEN '_x' ELSE '-y' END AS name FROM part),
c AS (SELECT p_partkey, lower(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g')) AS c FROM n)
SELECT p_partkey, len(list_filter(string_split_regex(c, '[_-]+'), lambda x: x <> '')) AS n, array_to_string(list_filter(string_split_regex(c, '[_-]+'), lambda x: x <> ''), '_') AS key, c AS snake FROM c""",
    "line_widths": r"""WITH l AS (SELECT doc_id, unnest(CASE WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[1:-2] ELSE string_split(text, chr(10)) END) AS x FROM documents),
m AS (SELECT doc_id, regexp_replace(x, '\r$', '') AS x FROM l)
SELECT doc_id, count(*) AS lines, max(length(x)) AS widest, count(*) FILTER (regexp_matches(trim(x), '^(import |import\(|use |from )')
 OR CASE WHEN regexp_matches(trim(x), '^(///|//!|//|/\*|\*/|\*|#|--)') THEN regexp_matches(trim(regexp_replace(trim(regexp_replace(trim(x), '^(///|//!|//|/\*|\*/|\*|#|--)', '')), '(\*/)+$', '')), '^\S*://\S+$')
 ELSE regexp_matches(trim(x), '^("[^"]*"|`[^`]*`)[,;]?$') END) AS exempt FROM m GROUP BY doc_id""",
    "glob_scopes": r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '\?.*$', '') AS path FROM pages)
SELECT page_id, true AS any, regexp_matches(path, '^[^/]*/en(/[^/]*)*$') AS en, regexp_matches(path, '^[^/]*/[^/]*/[^/]*(/[^/]*)*$') AS deep, regexp_matches(path, '^[^/]*/fr/[^/]*$') AS exact,
regexp_matches(path, '^[^/]*/de(/[^/]*)*$') AS colons, regexp_matches(path, '^th[^/]*\.example\.com(/[^/]*)*$') AS part FROM p""",
    "path_parts": r"""SELECT page_id, regexp_replace(regexp_extract(regexp_replace(url, '\?.*$', ''), '[^/]*$'), '(.)\.[^.]*$', '\1') AS stem, page_id * 1048576 + length(url) AS pos,
sha256(trim(regexp_replace(html, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS squashed FROM pages""",
    "regex_functions": r"""SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS first, array_to_string(regexp_extract_all(p_name, '([aeiou])[a-z]', 1), ',') AS every,
regexp_replace(regexp_replace(p_name, '[aeiou]', 'x'), '[aeiou]', 'x') AS two, regexp_replace(p_name, '(e)([a-z])', '\2\1', 'g') AS swapped FROM part""",
    "list_functions": """WITH a AS (SELECT l_orderkey, list(CAST(l_quantity AS INT) ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT)) AS q FROM lineitem GROUP BY 1)
SELECT l_orderkey, coalesce(list_position(q, 10), 0) - 1 AS first_ten, CASE WHEN list_contains(q, 10) THEN len(q) - list_position(list_reverse(q), 10) ELSE -1 END AS last_ten, array_to_string(q[2:3], ',') AS middle,
len(list_filter(q, lambda x: x > 40)) = 1 AS one_large, array_to_string(list_sort(list_distinct(q)), ',') AS distinct_sorted, len(list_filter(q, lambda x: x <= 5)) = 0 AS all_above, CAST(coalesce(q[4], -1) AS BIGINT) AS fourth,
array_to_string(list_transform(range(1, len(q) + 1), lambda i: coalesce(list_filter(range(i + 1, len(q) + 1), lambda j: q[j] < q[i])[1] - 1, -1)), ',') AS anchors FROM a""",
    "previous_purchase": """SELECT e.event_id, p.event_id AS purchase FROM (SELECT * FROM events WHERE event_type = 'error') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts""",
    "next_purchase": """SELECT e.event_id, p.event_id AS purchase FROM (SELECT * FROM events WHERE event_type = 'error') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts < p.ts""",
    "enclosing_order": """WITH o AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders)
SELECT p.o_orderkey AS k, arg_max(s.o_orderkey, {'d': s.d, 'k': s.o_orderkey}) AS span FROM o p LEFT JOIN o s ON p.o_custkey = s.o_custkey AND s.d <= p.d + 60 AND s.d + s.o_orderkey % 200 >= p.d + 60 GROUP BY 1""",
    "cache_trim": """SELECT o_orderkey, CAST(b AS DOUBLE) AS freed_before FROM (SELECT o_orderkey, coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM orders) WHERE b < 500000""",
    "event_ordinals": "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS ordinal FROM events",
    "layer_contract": """WITH n AS (SELECT n_nationkey, lower(replace(r_name, ' ', '_')) || '/' || lower(n_name) AS path, CASE WHEN r_name = 'AFRICA' THEN 0 WHEN r_name = 'AMERICA' THEN 1 WHEN r_name = 'ASIA' THEN 2 WHEN r_name = 'EUROPE' THEN 3 ELSE 4 END AS level FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT DISTINCT a.path AS src_path, b.path AS dst_path FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN n a ON a.n_nationkey = s_nationkey JOIN n b ON b.n_nationkey = c_nationkey
WHERE b.level < a.level AND a.path NOT LIKE '%/nation\\_7' ESCAPE '\\' AND NOT regexp_matches(b.path, '^asia/[^/]*_2[^/]*$')""",
    "json_select": """SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, (props->>'$.none') IS NULL AS missing, 'OBJECT<k: BIGINT>' AS shape FROM events WHERE CAST(props->>'$.k' AS INT) >= 50 AND CAST(props->>'$.k' AS INT) % 2 = 0""",
}

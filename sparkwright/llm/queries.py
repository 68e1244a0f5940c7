"""The numbered queries: each applies its operator to the whole of its tables and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm import byte_bpe, conversations, decontaminate, licenses, lm, packing, pii, quality, quality_rules, search, secrets, simhash, toxicity
from sparkwright.sources.scratch import read_table

HELD_OUT = "pmod(crc32(cast(cast({0} as string) as binary)), 5)"


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def _joined(spans: F.Column, kinds: tuple[str, ...] | None = None) -> F.Column:
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: F.Column, kind: str) -> F.Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_pii(read_table(spark, folder, "documents"))
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *(_count(spans, kind).alias(f"n_{kind}") for kind in pii.BASE),
        F.sha2(_joined(spans, pii.BASE), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
        F.round(F.coalesce(F.array_max(F.transform(spans, lambda s: s["score"])), F.lit(0.0)), 3).alias("top_score"),
    )


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.with_contamination(docs, read_table(spark, folder, "benchmark"), "f")
    ids = F.array_sort(F.transform("f.items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "f.n_words",
        decontaminate.n_hit(F.col("f")).alias("n_hit"),
        F.size("f.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated(F.col("f")).alias("contaminated"),
    )


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.score_documents(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))
    held = F.expr(HELD_OUT.format("doc_id") + " = 0")
    return found.select("doc_id", held.alias("held_out"), "text_score", "meta_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(read_table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["exact"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["start"])).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["covered"])), F.lit(0.0)).alias("score"),
    )


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    found = toxicity.score_documents(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))
    held = F.expr(HELD_OUT.format("doc_id") + " = 0")
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op7_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score_documents(read_table(spark, folder, "documents"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, folder, "documents"))


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        *(_count(F.col("base"), kind).alias(f"n_{kind}") for kind in secrets.BASE),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "linked"))).alias("spans"),
    )


def op11_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.rebuilt_trie(read_table(spark, folder, "conversations"))


def op12_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = byte_bpe.encode_documents(read_table(spark, folder, "documents"), path, public_tokenizers.PATTERN)
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(byte_bpe.decoded("ids", path), 256).alias("decoded_sha256"),
    )


def op13_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_pii": op2_pii,
    "op3_quality": op3_quality,
    "op4_licenses": op4_licenses,
    "op5_toxicity": op5_toxicity,
    "op6_simhash": op6_simhash,
    "op7_lm": op7_lm,
    "op8_quality_rules": op8_quality_rules,
    "op9_decontamination": op9_decontamination,
    "op10_secrets": op10_secrets,
    "op11_conversations": op11_conversations,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_search": op13_search,
}

ORACLE: dict[str, str] = {
    "op9_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM p),
x AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m),
h AS (SELECT x.doc_id, x.i, x.m, p.item_id FROM x JOIN p ON p.m = x.m AND p.t = array_to_string(x.w[x.i:x.i + x.m - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM h) GROUP BY doc_id),
k AS (SELECT doc_id, count(DISTINCT item_id) AS n,
             array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS s FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(k.n, 0) AS BIGINT) AS n_items, sha256(coalesce(k.s, '')) AS items_sha256,
       coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
""",
    "op13_search": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
f AS (SELECT doc_id, t, CAST(any_value(n) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS tf
      FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY doc_id, t),
k AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(s.n) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY t),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
r AS (
  SELECT item_id, doc_id, CAST(sum(k.w * ((1000000000 * f.tf) // (1000 * f.tf + 20 * (50 + (50 * f.n * s.n) // s.l)))) AS BIGINT) AS score
  FROM q JOIN k USING (t) JOIN f USING (t), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
WHERE rank <= 50
""",
    # CRC-32 of a decimal id bit by bit: a byte (0 or more) is mixed in, each of the eight -1 after it shifts once.
    "op11_conversations": r"""
WITH t AS (
  SELECT conv_id, list(x ORDER BY turn NULLS FIRST, x.role, x.h[:32]) AS turns
  FROM (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, {'role': coalesce(role, ''), 'n': length(coalesce(text, '')),
               'h': sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))} AS x
        FROM conversations WHERE conv_id IS NOT NULL)
  GROUP BY conv_id),
c AS (
  SELECT conv_id, turns, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(
               range(1, length(CAST(conv_id AS VARCHAR)) + 1),
               lambda i: [CAST(ascii(CAST(conv_id AS VARCHAR)[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a // 2, (a % 2) * 3988292384) END), 4294967295) % 6 AS h
  FROM t),
r AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM c LEFT JOIN t AS b ON b.conv_id = c.base),
p AS (
  SELECT conv_id, len(turns) AS size, d AS depth, list_transform(turns[:d], lambda x: x.h) AS path, CASE WHEN d > 0 THEN turns[d].n ELSE 0 END AS n
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
v AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS own,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
  FROM p GROUP BY path, depth),
k AS (SELECT path[:depth - 1] AS path, count(*) AS n FROM v WHERE depth > 0 GROUP BY path[:depth - 1]),
u AS (
  SELECT top, CAST(sum(own) AS BIGINT) AS saved, count(*) FILTER (NOT inner_node) AS leaves
  FROM (SELECT v.path[:unnest(range(0, v.depth + 1))] AS top, v.own, k.path IS NOT NULL AS inner_node FROM v LEFT JOIN k ON k.path = v.path)
  GROUP BY top)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, a.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n, 0) AS n_children,
       u.leaves AS n_leaves, u.saved AS saved_tokens, v.ends_sha256
FROM v JOIN u ON u.top = v.path LEFT JOIN k ON k.path = v.path LEFT JOIN v AS a ON v.depth > 0 AND a.path = v.path[:v.depth - 1]
""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

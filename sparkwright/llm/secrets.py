"""Secret scans with multipart credential linking, with DataFrame operations only.

Base secrets stand by themselves: assignments, access keys, long hexadecimal runs. Weak candidates are parts of a credential
that mean little alone: identifiers, keys under less telling names, and endpoints. Parts of one text are interval-joined:
they link if they lie within SCOPE characters, found by an equality join on the text and a stretch of that length. An
identifier is reported with a secret nearby, a weak key with an identifier or an endpoint, an endpoint with both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.sources.scratch import materialize

#: Patterns of base kinds: fixed values; possessive, so that a run of spaces is read once. The second is the group whose length counts, the third its least length.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Patterns of weak kinds, and the part of a credential that a kind is.
WEAK = {
    "id": (r"""(?i:user_?name|user_?id|client_?id|account_?id|access_?key_?id|login)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9@._-]++)""", 1, 3),
    "key": (r"""(?i:pwd|pass_?phrase|private_?key|access_?key|auth_?key|client_?key|signature|bearer)["']?(?:\x20*+[:=]\x20*+|\x20++)["']?([A-Za-z0-9+/_.=-]++)""", 1, 8),
    "endpoint": (r"""(?:https?|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9][^\x00-\x20"'<>]*""", 0, 8),
}
KINDS = (*BASE, *WEAK)
PART = {"assign": "secret", "access": "identifier", "hex": "secret", "id": "identifier", "key": "secret", "endpoint": "endpoint"}
SCOPE = 200
BUNDLE = 256
SPAN = "struct<start:int,rank:int,kind:string,end:int>"


def _spans(kind: str) -> str:
    """SQL for the spans of one kind in ``text``. Matches and the pieces between them give the positions by their lengths.

    Positions are summed up within pieces of BUNDLE matches and then over the pieces, so that time grows with the matches.
    """
    pattern, group, least = (BASE | WEAK)[kind]
    quoted = "r'" + pattern.replace("'", "\\x27") + "'"
    m, g, p = f"regexp_extract_all(text, {quoted}, 0)", f"regexp_extract_all(text, {quoted}, {group})", f"split(text, {quoted}, -1)"
    # from, to: where a match starts and ends after the last one's end; there is one more piece than matches, the text after the last
    steps = f"zip_with(zip_with({m}, {g}, (m, g) -> struct(m, g)), {p}, (y, p) -> named_struct('gap', length(p), 'long', length(y.m), 'ok', length(y.g) >= {least}))"
    step = "named_struct('at', a.at + x.gap + x.long, 'ends', concat(a.ends, array(a.at + x.gap + x.long)))"
    ends = lambda items, of: f"aggregate({items}, named_struct('at', 0, 'ends', cast(array() as array<int>)), (a, x) -> {of}, a -> a.ends)"
    bundles = f"transform(sequence(0, (size(s) - 1) div {BUNDLE}), i -> slice(s, i * {BUNDLE} + 1, {BUNDLE}))"
    inner = f"transform({bundles}, b -> named_struct('b', b, 'ends', {ends('b', step)}))"
    total = "named_struct('at', a.at + element_at(x.ends, -1), 'ends', concat(a.ends, array(a.at)))"
    span = f"named_struct('start', o + e - x.long, 'rank', {KINDS.index(kind)}, 'kind', '{kind}', 'end', o + e)"
    of_bundle = f"filter(zip_with(u.b, u.ends, (x, e) -> if(x.ok, {span}, null)), x -> x is not null)"
    shifted = f"flatten(zip_with(us, {ends('us', total)}, (u, o) -> {of_bundle}))"
    bound = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    found = bound("s", f"filter({steps}, x -> x.long is not null)", f"if(size(s) = 0, cast(array() as array<{SPAN}>), {bound('us', inner, shifted)})")
    return f"if(text rlike {quoted}, {found}, cast(array() as array<{SPAN}>))"


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, doc_id, base, weak) for every row: arrays of spans in the order of kinds."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    both = [F.concat(*(F.expr(_spans(kind)) for kind in kinds)).alias(name) for name, kinds in (("base", BASE), ("weak", WEAK))]
    return rows.select("uid", "doc_id", *both)


def _with_part(name: str) -> F.Column:
    column = F.lit(None).cast("string")
    for kind, part in PART.items():
        column = F.when(F.col(f"{name}.kind") == kind, part).otherwise(column)
    return column


def linked(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(uid, linked): weak spans with complementary parts in their scope; only texts that have weak spans."""
    every = rows.where(F.size("weak") > 0).select("uid", F.explode(F.concat("base", "weak")).alias("s")).withColumn("part", _with_part("s"))
    weak = every.where(F.col("s.kind").isin(*WEAK))
    reach = F.explode(F.sequence(F.expr(f"cast(floor((s.start - {scope}) / {scope}) as int)"), F.expr(f"cast(floor((s.end + {scope}) / {scope}) as int)")))
    asking = weak.select("uid", F.col("s").alias("w"), F.col("part").alias("w_part"), reach.alias("stretch"))
    # a part stands in the stretches that it covers, the first of which is where it is compared with those that start later
    given = every.select("uid", F.col("s").alias("o"), F.col("part").alias("o_part"), F.explode(F.sequence(F.expr(f"cast(floor(s.start / {scope}) as int)"), F.expr(f"cast(floor(s.end / {scope}) as int)"))).alias("stretch"))
    near = (F.col("o.start") <= F.col("w.end") + scope) & (F.col("o.end") >= F.col("w.start") - scope) & (F.col("o_part") != F.col("w_part"))
    apart = (F.col("o.end") <= F.col("w.start")) | (F.col("o.start") >= F.col("w.end"))
    met = asking.join(given, ["uid", "stretch"]).where(near & apart)
    has = lambda part: F.max((F.col("o_part") == part).cast("int")) == 1
    found = met.groupBy("uid", "w", "w_part").agg(has("identifier").alias("i"), has("secret").alias("s"), has("endpoint").alias("e"))
    enough = F.when(F.col("w_part") == "identifier", F.col("s")).when(F.col("w_part") == "secret", F.col("i") | F.col("e")).otherwise(F.col("i") & F.col("s"))
    return found.where(enough).groupBy("uid").agg(F.array_sort(F.collect_list("w")).alias("linked"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(doc_id, base, linked) for every row: spans (start, rank, kind, end) in characters, ordered by start, then kind.

    Null and empty texts have no spans. Repeated rows and null ids stay rows of their own. Parts that overlap do not link; of
    equal starts the kind listed first comes first. A very long text takes time in proportion to its length and matches. Other
    columns are not read, whatever their names; an empty table gives an empty result.
    """
    rows = materialize(parts(docs, id_col, text_col))
    none = F.array().cast(f"array<{SPAN}>")
    return rows.join(linked(rows, scope), "uid", "left").select("doc_id", F.array_sort("base").alias("base"), F.coalesce("linked", none).alias("linked"))

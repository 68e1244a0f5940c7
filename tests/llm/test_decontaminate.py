import random
import re

from sparkwright.llm import decontaminate, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=13):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        p = words(t)
        m = min(window, len(p))
        for a in range(len(p) - m + 1 if m else 0):
            for i in range(len(w) - m + 1):
                if w[i : i + m] == p[a : a + m]:
                    hit |= set(range(i, i + m))
                    found.add(item)
    return len(w), len(hit), found


def test_search_equals_brute_force_on_random_words():
    rnd = random.Random(2)
    for _ in range(300):
        items = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 7)))) for i in range(6)]
        text = " ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 60)))
        runs, found = decontaminate.hits(words_b(text), decontaminate.compiled(items, 4))
        assert (len(words(text)), sum(e - s for s, e in runs), found) == brute(text, items, 4)


def words_b(text):
    return [w.encode() for w in words(text)]


def test_parts_give_what_the_whole_gives(spark, edge_docs):
    items = [(i, f"the of tree and pot licence mit license filler{i} two three") for i in range(12)] + [(50, "mit license"), (51, None), (None, "two words"), (52, "same text"), (52, "same text")]
    assert sum(len(t or "") for _, t in items) > 700  # eight parts
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = decontaminate.with_contamination(edge_docs, bench, "f")
    parts = decontaminate.with_contamination(edge_docs, bench, "f", bound=100)
    assert whole.columns == parts.columns == [*edge_docs.columns, "f"]
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 3  # the parts were searched before, one at a time
    whole, parts = whole.collect(), parts.collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, parts))
    by_id = {r.doc_id: r.f for r in whole}
    assert 50 in by_id[6]["items"] and by_id[1]["n_words"] == 0 and by_id[10]["items"] == [52]


def test_empty_tables(spark, edge_docs, empty_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(edge_docs, bench).count() == edge_docs.count()
    assert decontaminate.decontaminate(empty_docs, bench).count() == 0


def test_query_finds_planted_passages(spark):
    got = queries.op9_decontamination(spark, "/root/testdata/sf0.01").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    hit = [r for r in got if r.n_hit][:5] + [r for r in got if not r.n_hit and r.n_words < 300][:3]
    assert any(r.contaminated for r in got)
    for r in hit:
        assert (r.n_words, r.n_hit, r.n_items) == (lambda n, h, f: (n, h, len(f)))(*brute(texts[r.doc_id], items))

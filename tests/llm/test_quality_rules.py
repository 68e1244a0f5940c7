import math
import random
import re
from collections import Counter

from sparkwright.llm import quality_rules, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def figures(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_base_on_a_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = queries.op8_quality_rules(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        assert figures(r) == brute(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
        assert r.class_distance is None or 0 <= r.class_distance <= 1
    good = [r for r in got if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.97 * len(good)


def test_edges(edge_docs, edge_texts, empty_docs):
    got = quality_rules.judge(edge_docs).collect()
    key = lambda r: (r[0] if r[0] is not None else -1, r[1])
    assert sorted(((r.doc_id, figures(r)) for r in got), key=key) == sorted(((i, brute(t)) for i, t in edge_texts), key=key)
    assert quality_rules.judge(empty_docs).count() == 0


def js(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b, strict=True) if x)
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    return math.sqrt(max(0.0, (kl(p, m) + kl(q, m)) / 2))


def classes_of(text):
    n = Counter(next((i for i, cs in enumerate(quality_rules.CLASSES.values()) if c in cs), -1) for c in text)
    return [n[i] for i, k in enumerate(quality_rules.CLASSES) if k != " "] + [n[-1]]


def folded(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()) if w]


def test_references_distances_and_kept_equal_brute_force(spark):
    least = 3000
    rows = [(r.doc_id, r.text or "", r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(1000, "xx yy " * 80, "tiny"), (1001, "the " * 30 + rows[0][1], None)]
    words, classes = {}, {}
    for _, t, lang in rows:
        words.setdefault(lang, Counter()).update(folded(t))
        classes[lang] = [a + b for a, b in zip(classes.get(lang, [0] * 7), classes_of(t), strict=True)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), least_reference=least).collect()}
    judged = 0
    for i, t, lang in rows:
        total = sum(words[lang].values())
        common = sorted(w for w, n in words[lang].items() if n >= quality_rules.COMMON * total)
        mine, own = classes_of(t), Counter(folded(t))
        others = [a - b for a, b in zip(classes[lang], mine, strict=True)]
        by_class = js(mine, others) if sum(mine) >= quality_rules.LEAST_CHARS and sum(others) >= least else None
        n = sum(own.values())
        p = [own[w] for w in common] + [n - sum(own[w] for w in common)]
        q = [words[lang][w] for w in common] + [total - sum(words[lang][w] for w in common)]
        q = [a - b for a, b in zip(q, p, strict=True)]
        by_word = js(p, q) if brute(t)[0] >= quality_rules.LEAST_WORDS and n and total - n >= least else None
        r = got[i]
        for have, want in ((r.class_distance, by_class), (r.word_distance, by_word)):
            assert (have is None) == (want is None) and (have is None or math.isclose(have, want, abs_tol=1e-6)), (i, have, want)
        judged += by_word is not None
        assert r.kept == (not brute(t)[5] and (by_class or 0) <= quality_rules.FAR_CLASSES and (by_word or 0) <= quality_rules.FAR_WORDS)
    assert judged > 100 and got[1000].class_distance is None


def test_junk_goes_and_clean_texts_stay(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [(r.kept, r.base_failed, labels[r.doc_id]) for r in queries.op8_quality_rules(spark, folder).collect() if r.doc_id in labels]
    clean, junk = ([(k, b) for k, b, q in got if q == y] for y in (1, 0))
    print(sum(k for k, b in clean), sum(not b for _, b in clean), sum(not k for k, _ in junk), len(junk))
    assert sum(k for k, b in clean) >= 0.99 * sum(not b for _, b in clean)
    assert sum(not k for k, _ in junk) >= 0.93 * len(junk)


def test_repeated_windows_are_compared_by_their_words(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice("abcdefgh"[: rnd.randint(1, 8)]) for _ in range(rnd.randint(0, 400)))) for i in range(120)]
    for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang")).collect():
        assert figures(r) == brute(rows[r.doc_id][1])


def test_distance(spark):
    for p, q in (([1, 2, 3], [3, 2, 1]), ([0, 0, 5], [5, 0, 0]), ([1, 1], [2, 2])):
        frame = spark.createDataFrame([(p, q)], "p array<long>, q array<long>").selectExpr(quality_rules._distance("p", "q") + " as d")
        assert math.isclose(frame.first().d, js(p, q), abs_tol=1e-7)
    assert spark.sql("select " + quality_rules._distance("array(0L)", "array(1L)") + " as d").first().d is None


def test_references_beyond_the_bound_are_dealt_by_salt(spark, edge_docs):
    """The same rows whether references are broadcast or a language's texts are dealt to many tasks."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").union(edge_docs.select("doc_id", "text", "lang"))
    plain = lambda most: sorted(map(repr, quality_rules.judge(docs, least_reference=500, most=most).collect()))
    assert plain(quality_rules.BROADCAST) == plain(-1)

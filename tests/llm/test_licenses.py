import random
import re

from sparkwright.llm import licenses, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    w = words(text)
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_base_on_whole_tables(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.op4_licenses(spark, folder).collect()
    assert len(got) == len(texts) and sum(r.n_base for r in got) > 10
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        if "Licensed under CC BY-NC 4.0" in texts[r.doc_id]:
            assert "cc-by-nc-4.0" in r.labels.split(",")


def test_edges(edge_docs, edge_texts, empty_docs):
    got = licenses.scan(edge_docs).collect()
    key = lambda r: (r[0] if r[0] is not None else -1, r[1], r[2])
    have = sorted(((r.doc_id, r.n_words, sum(s.exact for s in r.spans)) for r in got), key=key)
    assert have == sorted(((i, *brute(t)[:2]) for i, t in edge_texts), key=key)
    assert licenses.scan(empty_docs).count() == 0


def test_neighbouring_diagonals_merge(spark):
    text = "x " * 5 + "permission is hereby granted free of any charge to any person obtaining a copy of this fine software and associated documentation files"
    far = "permission is hereby granted to nobody"
    got = {r.doc_id: r.spans for r in licenses.scan(spark.createDataFrame([(1, text), (2, far)], "doc_id long, text string")).collect()}
    assert [(s.start, s.label) for s in got[1]] == [(5, "mit-text")] and got[1][0].covered < 1 and got[2] == []


def test_main_path_has_no_python(edge_docs):
    plan = licenses.scan(edge_docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("CreateDataFrame", "")) or "Scan ExistingRDD" in plan


def test_a_template_repeated_in_a_row_is_found_each_time(spark):
    texts = [(n, "x " + "All rights reserved. " * n) for n in (1, 2, 3, 4, 8)] + [(9, "all rights all rights all rights reserved")]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.label == "all-rights-reserved"] for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for n in (1, 2, 3, 4, 8):
        assert got[n] == [(1 + 3 * i, 4 + 3 * i) for i in range(n)]
    assert (4, 7) in got[9]


def rising(places):
    """The longest run of places that rises in both, the one that starts last, by trying all."""
    best = []
    for pos, at in sorted(places, key=lambda x: (x[0], -x[1])):
        before = [b for b in best if b[2] < pos and b[3] < at]
        n, start = max([(b[0] + 1, b[1]) for b in before], default=(1, pos))
        best.append((n, start, pos, at))
    return max(best)[:3] if best else (0, 0, 0)


def brute_spans(text):
    w, found = words(text), set()
    for template, label in licenses.TEMPLATES.items():
        t = template.split()
        places = [(i, a) for i in range(len(w) - 1) for a in range(len(t) - 1) if w[i : i + 2] == t[a : a + 2]]
        for d in {p - a for p, a in places}:
            own = [(p, a) for p, a in places if p - a == d]
            band = [(p, a) for p, a in places if abs(p - a - d) <= licenses.DRIFT]
            n, start, last = rising(own if len(own) == len(t) - 1 else band)
            if n >= licenses.COVER * (len(t) - 1) and last + 2 - start <= len(t) + licenses.DRIFT:
                found.add((-n, last + 2 - start, start, label, last + 2))
    lost = lambda s: any(o[:4] < s[:4] and 2 * (min(o[4], s[4]) - max(o[2], s[2])) >= min(o[1], s[1]) for o in found)
    return sorted((s[2], s[4], s[3]) for s in found if not lost(s))


def test_labels_equal_brute_force_on_random_texts(spark):
    rnd = random.Random(11)
    texts = ["licensed under CC BY-NC 4.0", "All rights reserved. " * 3, "licensed under cc by 4.0 licensed under cc by-sa 4.0"]
    for _ in range(250):
        out = []
        for _ in range(rnd.randint(1, 4)):
            t = rnd.choice(list(licenses.TEMPLATES)).split()
            for _ in range(rnd.choice((0, 0, 1, 2))):
                k = rnd.randrange(len(t))
                t[k : k + rnd.randint(0, 1)] = [rnd.choice(["x", "the", "license", "by"])][: rnd.randint(0, 1)]
            out += t * rnd.choice((1, 1, 2)) + rnd.choice(([], ["z"], ["filler"] * 5))
        texts.append(" ".join(out))
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        assert sorted((s.start, s.end, s.label) for s in r.spans if not s.exact) == brute_spans(texts[r.doc_id]), texts[r.doc_id]
    labels = {r.doc_id: {s.label for s in r.spans} for r in got}
    assert labels[0] == {"cc-by-nc-4.0"} and labels[1] == {"all-rights-reserved"} and labels[2] == {"cc-by-4.0", "cc-by-sa-4.0"}


def test_only_ascii_letters_are_lowered(spark):
    r = licenses.scan(spark.createDataFrame([(1, "M\u0130T license \u212a x")], "doc_id long, text string"), phrases={"k x": "k"}).first()
    assert r.n_words == 4 and not r.spans

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sparkwright.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected_ids(texts):
    t = Tokenizer.from_file(PATH)
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_pieces(pieces, docs, window=2048):
    """docs: list of (id, ids). Every id once, sequences gapless, and little padding."""
    by_doc = defaultdict(list)
    by_seq = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    want = defaultdict(list)
    for i, ids in docs:
        want[i].append(ids)
    assert set(by_doc) == set(want)
    for i, found in by_doc.items():
        copies = len(want[i])
        spans = sorted((p.start, p.length) for p in found)
        total = len(want[i][0])
        assert sum(n for _, n in spans) == copies * total
        for p in found:
            part = np.array(want[i][0][p.start : p.start + p.length], "<u4").tobytes()
            assert p.ids_crc32 == zlib.crc32(part) and p.doc_tokens == total
        if copies == 1:
            at = 0
            for s, n in spans:
                assert s == at
                at += n
    used = padding = 0
    for found in by_seq.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= window
        used += at
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / used


def test_ids_and_pieces_of_edge_cases(edge_docs, edge_texts):
    got = packing.pack_documents(edge_docs, PATH).collect()
    assert check_pieces(got, list(zip([i for i, _ in edge_texts], expected_ids([t for _, t in edge_texts]), strict=True))) < 0.02


def test_whole_table_has_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = packing.pack_documents(docs, PATH).collect()
    assert check_pieces(got, list(zip([i for i, _ in texts], expected_ids([t for _, t in texts]), strict=True))) < 0.01


def test_ids_come_along(spark, edge_docs):
    for p in packing.pack_documents(edge_docs, PATH, with_ids=True).collect():
        assert len(p.ids) == p.length and zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32


def test_cache_generations_keep_ids(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 40)
    words = packing.WordIds(PATH)
    rnd = random.Random(3)
    texts = [" ".join("".join(rnd.choice("abcdéßΣ1_.,'") for _ in range(rnd.randint(1, 7))) for _ in range(60)) for _ in range(40)]
    got = [np.frombuffer(b, "<u4").tolist() + [1] for a in range(0, 40, 4) for b in words.encode([t.encode() for t in texts[a : a + 4]])]
    assert got == expected_ids(texts)
    words.trim(10)
    assert len(words.cache) <= 10 and not words.older
    assert [np.frombuffer(b, "<u4").tolist() + [1] for b in words.encode([t.encode() for t in texts])] == expected_ids(texts)


def test_empty_table(empty_docs):
    assert packing.pack_documents(empty_docs, PATH).count() == 0


def test_recipes_fill_windows_and_nnls_is_near_optimal():
    rnd = np.random.default_rng(5)
    lengths = rnd.integers(1, 2048, 5000)
    assert sum(n for _, n in packing.recipes(lengths, 2048)) > 1000
    a, x = rnd.random((20, 30)), np.maximum(rnd.normal(size=30), 0)
    found = packing.nnls(a, a @ x)
    assert (found >= 0).all() and np.abs(a @ found - a @ x).max() < 0.05
    assert packing.pack([]) == [] and packing.pack([5]) == [[(0, 0, 4)], [(0, 4, 1)]]

import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from sparkwright.llm import byte_bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    encoding = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranked(PATH), special_tokens={})
    return lambda text: encoding.encode_ordinary(text or "")


def unpacked(ids):
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


def encoded(docs, **sizes):
    return byte_bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN, **sizes)


def test_query_equals_the_library_on_a_whole_table(spark, plain):
    for folder in (SMALL, "/root/testdata/sf0.01"):
        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
        got = queries.op12_byte_bpe(spark, folder).collect()
        assert sorted(r.doc_id for r in got) == sorted(texts)
        for r in got:
            want = plain(texts[r.doc_id])
            assert r.n_tokens == len(want)
            assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


@pytest.mark.parametrize("size, overlap", [(6, 3), (16, 16), (40, 7), (5, 1)])
def test_small_chunks_of_random_texts(spark, plain, size, overlap):
    """Alphabets of white space, apostrophes, digits and letters, and long words: seams are rare and often missing."""
    rnd = random.Random(size)
    rows = []
    for alphabet in (" \t\na", "'sdtlrevm x", "a1 - 　é", "aaaaaaaaaaaaaaaaaaab ", "   \n\n\u0001'"):
        rows += [(len(rows) + k, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 150)))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: unpacked(r.ids) for r in encoded(docs, size=size, overlap=overlap).collect()}
    assert got == {i: plain(t) for i, t in rows}


def test_edges(spark, plain, edge_docs, edge_texts, empty_docs):
    got = encoded(edge_docs, size=1000, overlap=100).withColumn("back", byte_bpe.decoded("ids", PATH)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, unpacked(r.ids)) for r in got), key=key) == sorted(((i, plain(t)) for i, t in edge_texts), key=key)
    assert sorted(bytes(r.back) for r in got) == sorted((t or "").encode() for _, t in edge_texts)
    assert encoded(empty_docs).count() == 0
    with pytest.raises(ValueError):
        encoded(edge_docs, size=10, overlap=11)

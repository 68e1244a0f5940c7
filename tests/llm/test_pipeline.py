import corpus_pipeline
from sparkwright.llm import decontaminate, pii, toxicity
from tests.llm.test_decontaminate import brute
from tests.llm.test_packing import check_pieces, expected_ids
from tests.llm.test_simhash import components, slow_fingerprint

FOLDER = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").cache()
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash", "decontamination", "pii", "packing"]
    kept = stages["toxicity"](spark, docs, FOLDER)
    scores = {r.doc_id: r.score for r in toxicity.score_documents(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s < 0.5}

    one = stages["simhash"](spark, docs, FOLDER)
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    least = components([(i, f) for i, f in prints.items()])
    assert one.columns == columns and sorted(r.doc_id for r in one.collect()) == sorted(set(least.values()))

    clean = stages["decontamination"](spark, docs, FOLDER)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    small = {i: t for i, t in texts.items() if len(t) < 4000}
    found = {i: brute(t, items) for i, t in small.items()}
    assert clean.columns == columns
    assert {r.doc_id for r in clean.collect()} & set(small) == {i for i, (n, h, _) in found.items() if not (h and 20 * h >= n)}

    redacted = stages["pii"](spark, docs, FOLDER)
    assert redacted.columns == columns
    for r in redacted.collect():
        assert r.text == pii.redacted(texts[r.doc_id], pii.find(texts[r.doc_id])) and r.n_chars == len(r.text)
    assert decontaminate.items_digest([10, 9]) == decontaminate.items_digest([9, 10])


def test_run_packs_what_the_stages_keep(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert 0 < len(rows) < 200
    got = corpus_pipeline.run(spark, FOLDER).collect()
    check_pieces(got, list(zip([i for i, _ in rows], expected_ids([t for _, t in rows]), strict=True)))


def test_odd_and_empty_tables(spark, tmp_path):
    """Null and empty texts, null and repeated ids, very long texts and digits, and each of the three tables empty."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(None, "no id at all, but words enough to stand", "en", "s", 1), (5000, None, None, None, None), (5001, "", "en", "s", 0), (5002, "host " + "0" * 5000 + "7.1.1.1 end", "en", "s", 9)]
    rows += [(5003, "one text of a repeated id", "en", "s", 1), (5003, "and quite another one, mail a@b.cd", "fr", "s", 1), (5004, "long words " * 20_000, "en", "s", 1), (5005, "9" * 200_000, "en", "s", 1)]
    odd = docs.limit(60).union(spark.createDataFrame(rows, docs.schema))
    tables = {"documents": odd, "labels": spark.read.parquet(f"{FOLDER}/labels.parquet"), "benchmark": spark.read.parquet(f"{FOLDER}/benchmark.parquet")}
    for empty in (None, *tables):
        at = str(tmp_path / (empty or "none"))
        for name, table in tables.items():
            (table.limit(0) if name == empty else table).write.parquet(f"{at}/{name}.parquet")
        got = corpus_pipeline.run(spark, at).collect()
        if empty == "documents":
            assert got == []
            continue
        ids = [r.doc_id for r in got]
        assert None in ids and {5002, 5003, 5004, 5005} <= set(ids) and len({r.doc_tokens for r in got if r.doc_id == 5003}) == 2
        assert sum(r.length for r in got if r.doc_id == 5004) == next(r.doc_tokens for r in got if r.doc_id == 5004)
        assert len({5000, 5001} & set(ids)) == 1  # texts without words are near-duplicates of each other

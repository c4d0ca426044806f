"""The pipeline: its stages, and its result against each operator applied by hand."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from sparrowgrid.llm import bpe, decontam, langid, toxicity  # noqa: E402

from test_nearcopies import brute_kept  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_drop_what_their_operators_reject(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "near_duplicates", "decontamination", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    left = {r.doc_id: r for r in docs.collect()}
    frame = lambda: spark.createDataFrame(list(left.values()), docs.schema)
    toxic = {r.doc_id for r in toxicity.score_documents(docs, toxicity.fit(docs, labels)).where("score >= 0.5").collect()}
    left = {k: v for k, v in left.items() if k not in toxic}
    und = {r.doc_id for r in langid.identify(frame(), langid.fit(frame())).where("lang_pred = 'und'").collect()}
    left = {k: v for k, v in left.items() if k not in und}
    # Five words and a similarity of 0.8, by brute force: the stage's own contract, wider than that of op5.
    copies = set(left) - set(brute_kept([(r.doc_id, r.text or "") for r in left.values()]))
    left = {k: v for k, v in left.items() if k not in copies}
    leaks = {r.doc_id for r in decontam.find_leaks(frame(), bench).collect()}
    left = {k: v for k, v in left.items() if k not in leaks}
    want = sorted(map(tuple, bpe.encode_documents(frame(), bpe.vocabulary_path()).collect()))
    assert toxic and copies and sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == want


def test_filtering_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_stages_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, component_id long, toxic int, held_out boolean"
    rows = [(i, f"some plain words of text number {i} and more of them here", "en", "s", 1, 1, 1, 1, True) for i in range(6)]
    rows += [rows[0], rows[1], (None,) * 9, (7, None, None, None, None, None, None, None, None), (8, "", "en", "s", 0, 1, 1, 1, True), (9, "!!!", "en", "s", 0, 1, 1, 1, True), (10, "word " * 20_000, "fr", "s", 0, 1, 1, 1, True)]
    docs = spark.createDataFrame(rows, schema)
    ids = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        ids[name] = sorted((r.doc_id for r in out.collect()), key=str)
    assert ids["toxicity"] == ids["decontamination"] == sorted((r[0] for r in rows), key=str)
    assert ids["language_id"] == sorted([0, 0, 1, 1, 2, 3, 4, 5, 10], key=str)
    assert ids["near_duplicates"].count(0) == 1 and ids["near_duplicates"].count(1) == 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)

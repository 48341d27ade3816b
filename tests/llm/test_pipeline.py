"""The pipeline's stages, each on its own input, and the registered queries."""

import corpus_pipeline
from conftest_llm import rows_of

import __spark_entry__ as entry_module
from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered_once():
    names = sorted(n for n in entry_module.queries() if n.startswith("op"))
    assert sorted(queries.QUERIES) == names and {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in entry_module.queries()
    assert set(queries.ORACLES) <= set(names)


def test_stages_keep_columns_and_drop_what_they_decide(spark, documents):
    docs = documents
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == documents.columns, name
        docs = corpus_pipeline.stored(out, name)
        sizes.append(docs.count())
    assert documents.count() > sizes[0] >= sizes[1] >= sizes[2] > 0
    before = {t for _, t in rows_of(documents)}
    assert {t for _, t in rows_of(docs)} <= before
    name, last = corpus_pipeline.STAGES[-1]
    tokens = last(spark, docs, SF)
    assert tokens.count() == sizes[3]
    total = tokens.agg({"n_tokens": "sum", "start": "max"}).first()
    assert total["sum(n_tokens)"] > total["max(start)"]


def test_run_is_its_stages(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_stages_take_awkward_and_empty_rows(spark, awkward, empty):
    for docs in (awkward, empty):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, SF), name)
            docs.count()

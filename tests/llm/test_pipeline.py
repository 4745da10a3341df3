"""The pipeline on a small table, stage by stage, and its registration."""

import __spark_entry__
import corpus_pipeline
from moderato.llm import decontaminate, pii_rules
from moderato.llm.queries import QUERIES


def test_all_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(f"op{n}_" in " ".join(names) for n in range(1, 11)) and set(QUERIES) <= set(names)


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = corpus_pipeline.documents(spark, sf)
    odd = spark.createDataFrame([(10_001, None, "en", None, None), (10_002, "", None, "s", 0), (10_003, "1 2 3", "en", "s", 5),
                                 (None, "a text without an id that stays in", "en", "s", 3),
                                 (10_004, "write to someone@host.example.org today please", "en", "s", 1)], docs.schema)
    docs = docs.unionByName(odd)
    given = {r.doc_id for r in docs.collect()}
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(step(spark, docs, sf), name)
        rows = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and set(rows) <= given
        if name == "language_id":
            assert given - set(rows) == {10_001, 10_002, 10_003}
        if name == "benchmark_decontamination":
            assert not any(b in r.text for r in rows.values() for b in bench)
        given = set(rows)
    assert not any(pii_rules.base_spans(r.text) for r in rows.values())
    assert None in rows and "[EMAIL]" in rows[10_004].text and rows[10_004].n_chars == len(rows[10_004].text)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == set(rows)


def test_stages_of_an_empty_table(spark):
    docs = corpus_pipeline.documents(spark, "/root/testdata/sf0.001").limit(0)
    for _, step in corpus_pipeline.STAGES:
        out = step(spark, docs, "/root/testdata/sf0.001")
        assert out.count() == 0


def test_decontamination_is_native(spark):
    docs = corpus_pipeline.documents(spark, "/root/testdata/sf0.001")
    found = decontaminate.contaminated(docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))
    plan = found._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))

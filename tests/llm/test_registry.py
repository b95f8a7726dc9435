import os

import pytest

import oracle
from pyspark.sql import functions as F
from pulsegrid.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    assert oracle.compare(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name], SF) == ""


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert {r.doc_id for r in rows} <= ids
        ids = {r.doc_id for r in rows}
        assert len(ids) > 100, name
        docs = spark.createDataFrame(rows, out.schema)
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in placed} == ids
    assert max(r.offset + r.length for r in placed) <= 2048


def test_pipeline_of_odd_documents(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    block = "\n".join(f"line {i} of a block" for i in range(12))
    words = " ".join(f"w{i}" for i in range(80))
    own = lambda d: " ".join(f"o{d}x{j}" for j in range(120))
    rows = [(i, f"own text {i} " + " ".join(f"{'vileword' if i % 3 == 0 else 'quiet'} x{i}y{j}" for j in range(12)), "en", "a", 0, i) for i in range(60)]
    rows += [(100, None, None, None, None, 1), (101, "", "en", "a", 0, 2), (102, block + "\n" + own(102), "en", "a", 0, 3), (103, own(103) + "\n" + block, "en", "a", 0, 4), (104, words + " " + own(104), "en", "a", 0, 5), (105, own(105) + " " + words, "en", "a", 0, 6), (105, own(105) + " " + words, "en", "a", 0, 6), (None, "no id", "en", "a", 0, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, starts int").withColumn("_row", F.lit(1)).withColumn("toxicity", F.lit("t")).withColumn("odd`name", F.struct(F.lit(1).alias("a b")))
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        got = out.collect()
        ids = {r.doc_id for r in got}
        assert {None, 100, 101, 102, 103, 104, 105} <= ids, name
        if name == "toxicity":
            assert not ids & set(range(0, 60, 3)) and ids >= {i for i in range(60) if i % 3}
        docs = spark.createDataFrame(got, docs.schema)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    texts = {r.doc_id: (r.text, r.n_chars) for r in got}
    assert texts[100] == (None, None) and len(texts[103][0]) < len(own(103) + "\n" + block) and texts[103][1] == len(texts[103][0])
    assert texts[105] == (own(105), len(own(105)))
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in placed} == {r.doc_id for r in got}

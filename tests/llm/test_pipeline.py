"""The pipeline stage by stage against plain versions of what each decides."""

import zlib

import numpy as np

import corpus_pipeline
from kgloom.llm import packing, quality
from kgloom.llm.common import written
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
    after = {}
    now = docs
    for name, stage in stages.items():
        now = after[name] = written(stage(spark, now, SF))
        if name != "packing":
            assert now.columns == docs.columns

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    good = {r.doc_id for r in quality.score(docs, model, ["doc_id"]).where("score >= 0.5").collect()}
    first = texts(after["quality"])
    assert {i for i, _ in first} == good

    second = texts(after["near_duplicates"])
    assert {i for i, _ in second} == {c for _, _, c in brute.jaccard(first)}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    third = texts(after["decontamination"])
    assert {i for i, _ in third} == {i for i, _ in second} - {r[0] for r in brute.contained(second, items)}

    fourth = texts(after["personal_data"])
    before = dict(third)
    assert {i for i, _ in fourth} == set(before)
    for i, t in fourth:
        found = brute.personal(before[i])
        assert (t == before[i]) if not found else t.count("[") >= len({s for s, _, _ in found}) > 0
        assert not brute.personal(t)

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    expected = set()
    for i, t in fourth:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        expected |= {(i, p, zlib.crc32(np.array(ids[a : a + 2048], dtype="<u4").tobytes())) for p, a in enumerate(range(0, len(ids), 2048))}
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in after["packing"].collect()} == expected
    assert corpus_pipeline.run(spark, SF).count() == len(expected)


def folder(tmp_path, spark, docs):
    """A folder of tables with these documents and the labels and items of the smallest one."""
    d = str(tmp_path / "sf")
    docs.write.parquet(f"{d}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
    return d


def test_pipeline_of_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert corpus_pipeline.run(spark, folder(tmp_path, spark, docs)).count() == 0


def test_pipeline_of_odd_rows(spark, tmp_path, repeated):
    """Clashing columns, null ids and texts, repeated rows: every document that stays is packed whole."""
    docs = repeated.withColumnRenamed("found", "_row").union(repeated.where("doc_id < 3").selectExpr("cast(null as long)", *repeated.columns[1:]))
    d = folder(tmp_path, spark, docs)
    now = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = written(stage(spark, now, d))
        assert now.columns == docs.columns, name
    pieces = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in now.collect()}

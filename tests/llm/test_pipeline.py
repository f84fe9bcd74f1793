"""The pipeline's stages one after the other on the smallest tables."""

from __future__ import annotations

import corpus_pipeline
from reviewminer.sources.tables import load


def test_stages(spark, sf, tmp_path):
    docs = load(spark, sf, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns and docs.count() > 0
        assert docs.count() <= before * (3 if name == "mixing" else 1)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    lengths = packed.groupBy().sum("length").first()[0]
    whole = packed.where("start = 0").groupBy().sum("doc_tokens").first()[0]
    assert lengths == whole


def test_repeated_and_null_ids(spark, sf):
    texts = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(40)]
    rows = [(k, texts[k], "ab"[k % 2]) for k in range(30)] + [(3, texts[3], "b")] * 20 + [(3, texts[30], "b")]
    rows += [(None, texts[31], "a")] * 5 + [(None, texts[k], "a") for k in range(32, 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = [tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()]
    assert sorted(map(str, got)) == sorted(map(str, {r[:2]: r for r in sorted(rows, key=str)}.values()))


def test_mix_takes_each_row_by_its_own_count(spark, sf):
    rows = [(k % 3 if k % 2 else None, "w " * (1 + k % 7), "abc"[k % 3]) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = corpus_pipeline.mixing(spark, docs, sf).collect()
    plan = corpus_pipeline.mixed(docs).collect()
    target = {r.sources[0]: r.target for r in plan}
    for s, words in target.items():
        assert abs(sum(len(r.text.split()) for r in got if r.source == s) - words) <= 7

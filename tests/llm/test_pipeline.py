from __future__ import annotations

import corpus_pipeline

import __spark_entry__ as entry
from tallyframe.llm import queries

SF = "/root/testdata/sf0.001"


def test_all_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in queries.QUERIES} and "pipeline" in names
    assert set(queries.ORACLES) <= set(names)


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts, ids = docs.columns, [docs.count()], None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        rows = out.collect()
        assert out.columns == (columns if k < 4 else [*columns, "shard", "slot"]), name
        counts.append(len(rows))
        if k < 3:
            assert len({r.doc_id for r in rows}) == len(rows)
        if k == 3:  # documents as they were, each twice at most
            assert all(sum(r.doc_id == i for r in rows) <= 2 for i in {r.doc_id for r in rows})
        before, ids = ids, {r.doc_id for r in rows}
        assert before is None or ids <= before
        docs = out
    assert counts[0] > counts[1] > counts[2] > counts[3] < counts[4] == counts[5]
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)

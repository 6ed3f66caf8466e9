"""The corpus pipeline, stage by stage against brute force where a stage decides."""

from __future__ import annotations

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402
from llm_rows import EDGE, documents, labels  # noqa: E402
from test_dedup import brute_exact, brute_near  # noqa: E402

from quillmart.llm.quality import score_quality  # noqa: E402


def test_stages_in_order(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    ids = {k: {r["doc_id"] for r in v.select("doc_id").collect()} for k, v in seen.items()}
    texts = lambda k: [(r["doc_id"], r["text"]) for r in seen[k].collect()]
    scored = score_quality(seen["documents"], spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    assert ids["quality"] == {r["doc_id"] for r in scored if r["score"] >= 0.5}
    assert ids["exact_dedup"] == {r[0] for r in brute_exact(texts("quality")) if r[3]}
    assert seen["exact_dedup"].count() == sum(r[3] for r in brute_exact(texts("quality")))
    assert ids["near_dedup"] == {r[0] for r in brute_near(texts("exact_dedup")) if r[3]}
    assert ids["mixing"] == ids["near_dedup"] == ids["packing"]
    assert all(seen[k].columns == seen["documents"].columns for k in ids if k != "packing")
    ran = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in ran.select("doc_id").collect()} == ids["packing"] and ran.columns == docs.columns
    import os

    folder = os.path.dirname(os.path.dirname(ran.inputFiles()[0].removeprefix("file://")))
    assert os.listdir(folder) == ["packing"]  # the folders of earlier stages are gone


def test_pipeline_takes_awkward_and_empty_tables(spark, tmp_path):
    for name, rows in (("odd", EDGE), ("none", [])):
        folder = tmp_path / name
        documents(spark, rows).write.parquet(str(folder / "documents.parquet"))
        labels(spark, [(1, 1, 0), (6, 0, 0)]).write.parquet(str(folder / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(folder))
        assert out.columns[:3] == ["doc_id", "piece", "start"]
        assert bool(out.count()) == bool(rows)


def test_packing_keeps_the_order_of_the_mix(spark, tmp_path):
    rows = [(i, "word " * (900 if i % 2 else 400), "en", "long" if i % 2 else "short") for i in range(600)]
    mixed = str(tmp_path / "mixed")
    corpus_pipeline.mixing(spark, documents(spark, rows), "").write.option("maxRecordsPerFile", 100).parquet(mixed)
    files = sorted({r[0] for r in spark.read.parquet(mixed).select("_metadata.file_name").collect()})
    came = [(r["doc_id"], r["source"]) for f in files for r in spark.read.parquet(f"{mixed}/{f}").collect()]
    assert len(files) > 1 and len(came) == 600
    packed = corpus_pipeline.packing(spark, spark.read.parquet(mixed), "").collect()
    assert sorted(r["doc_id"] for r in packed if r["piece"] == 0) == list(range(600))
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed)
    opened = [r["doc_id"] for r in sorted(packed, key=lambda r: r["sequence_id"]) if r["offset"] == 0]
    place = {doc: i for i, (doc, _) in enumerate(came)}
    assert [place[x] for x in opened] == sorted(place[x] for x in opened)
    # over a prefix of the sequences both sources have their share, long and short documents alike
    ids = sorted({r["sequence_id"] for r in packed})
    for part in (4, 2):
        first = set(ids[: len(ids) // part])
        inside = [r["doc_id"] % 2 for r in packed if r["sequence_id"] in first and r["piece"] == 0]
        assert abs(sum(inside) / len(inside) - 0.5) < 0.1

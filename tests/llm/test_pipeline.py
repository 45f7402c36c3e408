import random

import corpus_pipeline
from test_operators import frame, prose


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    items = [(i, prose(rng, 30)) for i in range(4)]
    rows = [(i, prose(rng, 120)) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[3][1].replace(" ", "  ")), (102, prose(rng, 20) + " " + items[1][1]), (103, None), (104, "12 34 !"), (105, prose(rng, 60) + " password=hunter2222 " + prose(rng, 10))]
    documents = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen, docs = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id for r in docs.collect()}
        assert name == "packing" or docs.columns == documents.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "packing"]
    everything = {r[0] for r in rows}
    assert seen["language"] == everything - {103, 104}
    assert seen["near_duplicates"] == seen["language"] - {100, 101}
    assert seen["decontamination"] == seen["secrets"] == seen["packing"] == seen["near_duplicates"] - {102}
    masked = spark.read.parquet(str(tmp_path / "secrets")).where("doc_id = 105").first()
    assert "[secret]" in masked.text and "hunter" not in masked.text and masked.n_chars == len(masked.text)
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in again.collect()} == seen["packing"] and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_masks_values_after_equals_signs(spark):
    rng = random.Random(12)
    values = ["a1" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(38)) for _ in range(2)]
    rows = [(1, prose(rng, 30) + " client_key=" + values[0] + " " + prose(rng, 10)), (2, prose(rng, 30) + " https://x.org/a?sig=" + values[1] + "&b=1")]
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    for r in corpus_pipeline.secrets(spark, docs, "").collect():
        assert values[r.doc_id - 1] not in r.text and "=[secret]" in r.text and r.n_chars == len(r.text)


def test_stages_on_hard_rows(spark, tmp_path):
    rng = random.Random(13)
    items = [(i, prose(rng, 20)) for i in range(2)] + [(None, prose(rng, 20)), (9, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    long = prose(rng, 60_000)
    rows = [(i, prose(rng, 90)) for i in range(40)] + [(50, long), (51, long + " end"), (52, None), (53, ""), (None, prose(rng, 90)), (None, prose(rng, 40) + " " + items[2][1])]
    rows += [rows[5], rows[5], (60, rows[6][1])]
    docs = frame(spark, rows)  # columns whose names clash with those used inside
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        ids = sorted((r.doc_id for r in out.collect()), key=str)
        if name == "language":
            assert ids == sorted([r[0] for r in rows if r[1]], key=str)
        elif name == "near_duplicates":
            assert ids == sorted([*range(40), 50, None, None], key=str)
        elif name in ("decontamination", "secrets"):
            assert ids == sorted([*range(40), 50, None], key=str)
        assert name == "packing" or out.columns == docs.columns
        docs = out
    assert out.where("doc_id = 50").count() > 10 and out.where("doc_id is null").count() == 1
    nulls = frame(spark, [(1, None), (None, None), (2, "")])
    assert [stage(spark, nulls, str(tmp_path)).count() for _, stage in corpus_pipeline.STAGES] == [0, 3, 3, 3, 3]

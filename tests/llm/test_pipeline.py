"""The pipeline over a small corpus: each stage's decisions take effect."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilframe.llm import near_duplicates, pii, queries, substrings

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before, seen = docs.columns, docs.count(), {}
    for name, stage in corpus_pipeline.STAGES:
        out = f"{tmp_path}/{name}"
        stage(spark, docs, SF).write.parquet(out)
        seen[name] = (docs, docs := spark.read.parquet(out))
        if name != "packing":
            assert docs.columns == columns
    good = seen["quality"][1]
    truth = spark.read.parquet(f"{SF}/labels.parquet")
    assert 0 < good.count() < before and good.join(truth.where("quality = 1"), "doc_id").count() >= 0.95 * truth.where("quality = 1").count()
    single = seen["minhash"][1]
    sets = collections.Counter(tuple(near_duplicates.shingle_set(r["text"], 5).tolist()) for r in single.collect())
    assert max(sets.values()) == 1
    clean = seen["suffix_array"][1]
    assert substrings.repeated_spans(clean).select(F.sum(F.size("spans"))).first()[0] in (None, 0) or clean.count() == single.count()
    private = seen["pii"][1]
    old = {r["doc_id"]: r["text"] for r in clean.collect()}
    for r in private.collect():
        for i, j, kind, _ in pii.find(old[r["doc_id"]]):
            assert kind not in ("card", "ip") or old[r["doc_id"]][i:j] not in r["text"]
    packed = seen["packing"][1]
    words = sum(len(r["text"].encode().split()) for r in private.collect())
    assert packed.agg(F.sum("n_tokens")).first()[0] == words


def test_run_and_registration(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11))
    assert corpus_pipeline.ORACLE_SQL is None


ODD = [(1, None), (2, ""), (None, "null id " * 20), (None, None), (3, "repeated row words " * 30), (3, "repeated row words " * 30), (3, "another text under one id " * 30), (4, "é中文😀"), (5, "x" * 50_000), (6, " \n\t ")]
NAMES = ["doc_id", "text", "lang", "source", "n_chars", "gone_id", "gone_th", "rejected_id", "_did", "span_did", "span_th", "span_list", "sid", "th", "my col"]


def test_stages_take_odd_rows_and_clashing_names(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{n}` string" for n in NAMES[5:])
    good = [(100 + i, f"Clean sentence number {i} about rivers, hills and {i * 7} towns. " * (3 + i % 5)) for i in range(60)]
    make = lambda rows: spark.createDataFrame([(i, t, "en", None, len(t or ""), *["clash"] * (len(NAMES) - 5)) for i, t in rows], schema)
    for rows in (ODD + good, []):
        docs = make(rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            got = out.collect()
            if name != "packing":
                assert out.columns == NAMES and all(r["my col"] == "clash" for r in got)
                docs = spark.createDataFrame(got, schema)
        assert rows or not got
    single = corpus_pipeline.minhash(spark, make(ODD), SF).collect()
    assert len(single) == len(ODD)  # nothing here is a near copy of another document; equal rows stay together


def test_key_of_the_pipeline(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "write to ann.lee@example.com now")], "doc_id long, text string")
    plain = corpus_pipeline.pseudonyms(spark, docs, SF).first()["text"]
    (tmp_path / "key").write_bytes(bytes(range(40)))
    monkeypatch.setenv(pii.KEY_FILE, str(tmp_path / "key"))
    own = corpus_pipeline.pseudonyms(spark, docs, SF).first()["text"]
    assert plain != own != "write to ann.lee@example.com now" and pii.restore(own, bytes(range(40))) == "write to ann.lee@example.com now"
    (tmp_path / "key").write_bytes(b"short")
    with pytest.raises(ValueError):
        pii.key_from_environment()

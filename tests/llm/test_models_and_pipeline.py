"""Classifiers by held-out accuracy, and the pipeline stage by stage."""

from __future__ import annotations

import random
import re
import tempfile
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioframe.llm import decontamination, langid, quality, secrets, simhash
from folioframe.llm.queries import ORACLE, QUERIES

from test_near_texts import wanted

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    sf = SF.replace("0.01", "0.001")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    told = con.execute(ORACLE[name])
    columns = [c[0] for c in told.description]
    assert sorted(map(str, told.fetchall())) == sorted(str(tuple(r)) for r in QUERIES[name](spark, sf).select(columns).collect())


def test_op4_held_out(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.op4_rows(documents, labels).toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got.doc_id, got.held_out, strict=True))
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all() and len(got) == documents.count()
    joined = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    bad, good = joined.score[joined.quality == 0].to_numpy(), joined.score[joined.quality == 1].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert (joined.predicted == joined.quality).mean() > 0.95


def test_op4_learns_from_no_held_out_label(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id"), 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit(documents, x, learn=quality.fold(F.col("doc"), 3) != 1) for x in (labels, turned))
    assert np.array_equal(a.weights, b.weights) and a.prior == b.prior


def test_op4_odd_rows(spark, documents):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(0, None, 1), (None, "", 2), (5, "x " * 100_000, 3), (5, "x " * 100_000, 3)], "doc_id long, text string, score int")
    assert quality.op4_rows(odd, labels).count() == 4
    assert {r.score for r in quality.op4_rows(odd, labels.filter("false")).collect()} == {0.5}
    assert quality.op4_rows(odd.filter("false"), labels).count() == 0


def test_op4_risk_needs_no_bad_example():
    gen = np.random.default_rng(0)
    positive, negative = gen.normal(1, 1, (2000, 5)), gen.normal(-1, 1, (2000, 5))
    unlabelled = np.concatenate([gen.normal(1, 1, (1400, 5)), gen.normal(-1, 1, (600, 5))])
    model = quality.train(positive, unlabelled, 0.7)
    z = lambda x: ((x - model.mean) / model.scale) @ model.weights + model.bias
    assert (z(positive) > 0).mean() > 0.9 and (z(negative) < 0).mean() > 0.9


@pytest.mark.parametrize("share", [0.2, 0.5, 0.9])
def test_op4_prior_is_estimated(share):
    gen = np.random.default_rng(1)
    good, bad = lambda n: gen.normal(0.8, 1, (n, 6)), lambda n: gen.normal(-0.8, 1, (n, 6))
    unlabelled = np.concatenate([good(int(3000 * share)), bad(int(3000 * (1 - share)))])
    assert abs(quality.estimate_prior(good(3000), unlabelled) - share) < 0.07


def test_op4_uses_no_bad_label(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    a, b = (quality.fit(documents, x, learn=quality.fold(F.col("doc"), 3) != 1) for x in (labels, labels.withColumn("quality", F.when(F.col("quality") == 0, -1).otherwise(1))))
    assert np.array_equal(a.weights, b.weights) and a.prior == b.prior
    repeated = quality.fit(documents.unionByName(documents.filter("doc_id < 20")), labels, learn=quality.fold(F.col("doc"), 3) != 1)
    assert np.array_equal(a.weights, repeated.weights)


def test_op5_held_out(documents):
    got = langid.op5_rows(documents).toPandas().merge(documents.select("doc_id", "lang").toPandas(), on="doc_id")
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out, strict=True))
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98 and got.score.between(0, 1).all()


def test_op5_odd_rows(spark):
    gen = random.Random(3)
    rows = [(k, " ".join(gen.choice(("the of and" if k % 2 else "der die und").split()) for _ in range(20)), "en" if k % 2 else "de", "x") for k in range(200)]
    rows += [(1000, None, "en", "x"), (1001, "123 !?", "de", "x"), (1002, "", None, "x"), (None, "the of", "en", "x"), (1003, "the and " * 50_000, None, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, letters string")
    got = {r.doc_id: r for r in langid.op5_rows(table).collect()}
    assert len(got) == len(rows)
    assert all(got[k].lang_pred == "und" and got[k].rejected for k in (1000, 1001, 1002))
    assert got[1003].lang_pred == "en" and got[None].held_out
    assert {r.lang_pred for r in langid.op5_rows(table.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.op5_rows(table.filter("false")).count() == 0


def test_op5_is_a_function_of_the_text(spark, documents):
    model = langid.fit(documents)
    texts = ["ab", "x", "", "der die das", "a", "zz zz", "the of and", "日本", "é", *(r.text[:n] for n, r in zip((7, 30, 500), documents.filter("text is not null").take(3), strict=True))]
    whole = model.logits(pa.array(texts * 50))
    for k, t in enumerate(texts):
        assert np.array_equal(model.logits(pa.array([t]))[0], whole[k])
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts * 20)], "doc_id long, text string")
    answers = [{r.doc_id: r[1:] for r in langid.identify(rows.repartition(n), model).collect()} for n in (1, 7)]
    assert answers[0] == answers[1] and all(answers[0][k] == answers[0][k % len(texts)] for k in answers[0])


def test_op5_calibration(documents):
    """Short held-out excerpts: confidence is near accuracy. A language left out of training is rejected, known ones are not."""
    learn = langid.fold(F.col("doc_id"), 4) != 2
    rows = documents.filter("text is not null and lang is not null").select("text", "lang", (~learn).alias("held")).toPandas()
    cut = lambda part: pa.array([t[:60] for t in part.text if len(t) >= 60])
    model = langid.fit(documents, learn=learn)
    held = rows[rows.held & (rows.text.str.len() >= 60)]
    p = model.probabilities(model.logits(cut(held)))
    right = np.array(model.languages)[p.argmax(1)] == held.lang.to_numpy()
    assert abs(p.max(1).mean() - right.mean()) < 0.03 and 1e-3 < model.temperature < 1e3
    model = langid.fit(documents.filter("lang <> 'fr'"), learn=learn)
    score = lambda part: model.probabilities(model.logits(cut(part))).max(1)
    assert (score(rows[rows.lang == "fr"]) < model.threshold).mean() > 0.9
    assert (score(held[held.lang != "fr"]) < model.threshold).mean() < 0.15


def test_op5_learns_from_one_row_a_document(spark):
    rows = [(1, "the of and to in is", "en")] * 50 + [(2, "der die und das ist", "de")] * 50 + [(3, "le la les et des", None)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]


def test_pipeline_stages(spark, documents):
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = simhash.durable(stage(spark, docs, SF))
        kept[name] = docs.count()
        if name != "byte_bpe":
            assert docs.columns == documents.columns and docs.dtypes == documents.dtypes
        if name == "quality_classifier":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            assert docs.join(labels.filter("quality = 1"), "doc_id").count() >= 0.99 * before.join(labels.filter("quality = 1"), "doc_id").count()
            assert docs.join(labels.filter("quality = 0"), "doc_id").count() <= 0.1 * before.join(labels.filter("quality = 0"), "doc_id").count()
        elif name == "simhash_near_dedup":
            assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == wanted([(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()])[0]
        elif name == "benchmark_decontamination":
            assert decontamination.op1_rows(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("contaminated").count() == 0
            assert decontamination.op1_rows(before, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("contaminated").count() > 0
            assert docs.filter("n_chars <> length(text)").count() == 0
        elif name == "secret_scan":
            assert secrets.op6_rows(docs).filter("n_assign + n_access + n_hex > 0").count() == 0
            assert not any(re.search(r"[0-9a-f]{32}", r.text) for r in docs.collect())
    assert docs.filter("not round_trip").count() == 0 and kept["byte_bpe"] == kept["secret_scan"]
    assert corpus_pipeline.run(spark, SF).count() == kept["byte_bpe"]


def test_stages_take_odd_rows(spark):
    """Null ids and texts, empty and very long texts, ties, repeated rows, clashing columns, and the empty table, stage by stage."""
    text = " ".join(f"word{k}" for k in range(40))
    bench = " ".join(f"q{k}" for k in range(12))
    rows = [(None, None, "x"), (None, text, "x"), (1, "", "x"), (2, "ab " * 60_000, "y"), (3, text, "y"), (3, text, "y"), (3, "another text of this id", "y"), (4, text + " more", None), (5, f"see {bench}. password=hunter2hunter2 end", "z"), (None, f"{bench}", "z")]
    kinds = "doc_id long, text string, said string, doc string, __score string, token_ids string, body string, row string, fp string, spans string"
    table = spark.createDataFrame([(i, t, s, "d", "s", "t", "b", "r", "f", "p") for i, t, s in rows], kinds)
    folder = tempfile.mkdtemp(prefix="odd-")
    spark.createDataFrame([(10, 1)], "doc_id long, quality int").filter("false").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, bench), (2, None), (None, "word1 word2")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, table.filter("false"), folder).count() == 0
        if name != "byte_bpe":
            assert f(spark, table, folder).dtypes == table.dtypes
    texts = lambda frame: sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)
    assert texts(stage["quality_classifier"](spark, table, folder)) == sorted(((i, t) for i, t, _ in rows), key=str)
    assert texts(stage["simhash_near_dedup"](spark, table, folder)) == sorted([(1, ""), (2, "ab " * 60_000), (3, text), (3, "another text of this id"), (5, rows[8][1]), (None, bench)], key=str)
    cut = dict(texts(stage["benchmark_decontamination"](spark, table.filter("doc_id = 5 or doc_id is null"), folder)))
    assert cut[5] == "see . password=hunter2hunter2 end"
    assert (None, "") in texts(stage["benchmark_decontamination"](spark, table, folder)) and (None, None) in texts(stage["benchmark_decontamination"](spark, table, folder))
    assert dict(texts(stage["secret_scan"](spark, table.filter("doc_id = 5"), folder)))[5] == f"see {bench}. [SECRET] end"
    out = stage["byte_bpe"](spark, table, folder)
    assert out.columns == [*(c for c in table.columns if c not in ("text", "token_ids")), "n_tokens", "token_ids", "round_trip"]
    assert out.filter("round_trip").count() == len(rows) and out.filter("n_tokens = 0").count() == 2

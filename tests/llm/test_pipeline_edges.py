"""The pipeline and its stages over odd rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from covelight.llm import language_id

CLASH = ("ids", "round_trip", "component_id", "n_tokens", "at", "window", "member", "score", "host")


def write(spark, folder, docs, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    plain = spark.read.parquet(f"{sf}/documents.parquet")
    base = plain.where("text is not null and length(text) > 400 and lang is not null").orderBy("doc_id").limit(90).cache()
    first = base.orderBy("doc_id").first()
    secret, rng, words = " password=hunter2hunter2 ", random.Random(1), first["text"].split()
    giant = secret.join(" ".join(rng.sample(words, len(words))) for _ in range(400))  # the words of one text in ever new order
    rows = [
        (9001, None, "en", "s", None), (9002, "", "en", "s", 0), (9003, "12 34 -- !!", None, None, 11), (None, first["text"] + " and a few words of its own", first["lang"], None, None),
        (9004, first["text"], None, None, len(first["text"])), (9004, first["text"], None, None, len(first["text"])), (9005, giant, first["lang"], "s", None),
        (9006, first["text"][::-1] + secret, first["lang"], "s", 5),
    ]
    docs = base.unionByName(spark.createDataFrame(rows, base.schema)).withColumns({c: F.lit(c) for c in CLASH}).repartition(5)
    items = spark.createDataFrame([(1, " ".join(base.orderBy(F.desc("doc_id")).first()["text"].split()[:30])), (None, "an item without an id that nothing holds at all, really nothing"), (3, None), (4, "")], "item_id long, text string")
    return write(spark, tmp_path_factory.mktemp("odd"), docs, items), first["text"], base.orderBy(F.desc("doc_id")).first()["doc_id"]


def test_stages_keep_the_columns_and_odd_rows_have_defined_results(spark, odd):
    folder, text, leaked = odd
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder).cache()
        assert out.columns == columns and out.schema == docs.schema
        seen[name] = {r["doc_id"]: r for r in out.collect()}
        docs = out
    assert not {9001, 9002, 9003} & set(seen["language_id"])  # no text, an empty one, none with a letter
    assert {9005, 9006, None} <= set(seen["language_id"])
    model = language_id.fit(spark.read.parquet(f"{folder}/documents.parquet"))
    sure = {r["doc_id"] for r in language_id.identify(spark.read.parquet(f"{folder}/documents.parquet"), model).collect() if r["lang_pred"] != "und" and r["score"] >= 0.5}
    assert set(seen["language_id"]) == sure
    assert 9004 not in seen["ngram_join"] and None in seen["ngram_join"]  # a copy goes, whatever its columns; a row without an id stays
    assert leaked in seen["ngram_join"] and leaked not in seen["decontaminate"]
    for i in (9005, 9006):
        got = seen["secret_scan"][i]
        assert "hunter2" not in got["text"] and "[secret]" in got["text"] and got["n_chars"] == len(got["text"])
    assert seen["secret_scan"].keys() == seen["decontaminate"].keys()
    coded = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()}
    assert coded.keys() == seen["secret_scan"].keys() and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in coded.values())
    assert coded[9005]["n_tokens"] > 100_000


def test_run_over_odd_rows_is_its_stages_in_turn(spark, odd):
    folder, _, leaked = odd
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "round_trip", "ids"]
    ids = {r["doc_id"] for r in got.collect()}
    assert {9005, 9006, None} <= ids and not {9001, 9002, 9003, 9004, leaked} & ids


def test_run_over_an_empty_table(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    folder = write(spark, tmp_path, docs.where("false"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert corpus_pipeline.run(spark, folder).count() == 0

"""Nulls, empty and long texts, repeats, clashing columns and empty tables, for every operator."""

import pytest
from pyspark.sql import functions as F

from sofralytics.llm import host_rules, imatch, katz, license_scan, mixing, pii, quality_cnn, sentencepiece, simhash, url_filter
from sofralytics.llm.queries import PIECES, RULES

LABELS = "doc_id long, quality int, toxic int"


def rows(frame):
    return sorted((tuple(str(v) for v in r) for r in frame.collect()))


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepiece.Vocabulary.load(PIECES)


def operators(spark, docs, vocabulary):
    labels = spark.createDataFrame([(1, 1, 0), (3, None, 0), (4, 0, 1), (None, 1, 1)], LABELS)
    urls = docs.select("doc_id", F.col("text").alias("url"))
    return {
        "licences": lambda: license_scan.scan(docs, license_scan.train(docs)),
        "urls": lambda: url_filter.judge(urls, RULES, url_filter.train(url_filter.labelled_by_rules(urls, RULES))),
        "quality": lambda: docs.select("doc_id", quality_cnn.text_score(quality_cnn.train(docs, labels)).alias("score")),
        "mixing": lambda: mixing.mix(docs),
        "simhash": lambda: simhash.near_duplicates(docs),
        "katz": lambda: katz.score(docs, katz.train(docs)),
        "pieces": lambda: sentencepiece.encode(docs, vocabulary, 3),
        "imatch": lambda: imatch.neighbours(docs),
        "rules": lambda: host_rules.apply_rules(docs, F.col("source")),
        "pii": lambda: pii.find(docs),
        "redact": lambda: pii.redact(docs),
    }


NAMES = ["licences", "urls", "quality", "mixing", "simhash", "katz", "pieces", "imatch", "rules", "pii", "redact"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd, vocabulary, name):
    found = operators(spark, odd, vocabulary)[name]().collect()
    if name != "mixing":
        assert len(found) == 8
        assert sorted(str(r["doc_id"]) for r in found) == sorted(str(x) for x in (1, 1, 2, 3, None, 4, 5, -7))


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, odd, vocabulary, name):
    assert operators(spark, odd.limit(0), vocabulary)[name]().collect() == []


def test_repeated_rows_agree(spark, odd, vocabulary):
    for name in ("quality", "simhash", "katz", "pieces", "rules", "pii"):
        found = [tuple(str(v) for v in r) for r in operators(spark, odd, vocabulary)[name]().where("doc_id = 1").collect()]
        assert len(found) == 2 and found[0] == found[1], name


CLASHING = ["_source", "_rate", "_copies", "_key", "_copy", "_email", "_text", "_clean", "_spans"]


@pytest.mark.parametrize("run", [mixing.mix, pii.redact, lambda d: simhash.first_rows(d, simhash.near_duplicates(d))], ids=["mix", "redact", "first_rows"])
def test_names_used_inside_do_not_touch_the_input(spark, odd, run):
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    named = run(plain.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHING}))
    found = named.collect()
    assert found and all(r[c] == f"{c}{'none' if r['doc_id'] is None else r['doc_id']}" for r in found for c in CLASHING)
    assert rows(named.select("doc_id", "text")) == rows(run(plain).select("doc_id", "text"))


@pytest.mark.parametrize("account", ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "de89370400440532013000"])
def test_accounts_stand_on_invoices(spark, account):
    docs = spark.createDataFrame([(1, f"Invoice 77: pay {account} today"), (2, "Invoice 77: pay DE88370400440532013000 today")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()} == {1: "Invoice 77: pay <IBAN> today", 2: "Invoice 77: pay DE88370400440532013000 today"}

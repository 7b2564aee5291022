"""Texts that one expression could take too long for, and counts beyond a table's."""

import re
import time

from pyspark.sql import functions as F

from tessella.llm import langid, licenses, secrets

BIG = 400_000


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_secrets_in_time(spark):
    units = ["eyJ", "eyJa.", "a.eyJ", "ghp_", "xoxb-", "token", "token ", "-----BEGIN ", "-----BEGIN PRIVATE KEY", "AKIA", "0123456789abcde-", "sk_live_"]
    texts = [t for u in units for t in (u * (BIG // len(u)), u * (BIG // len(u)) + ".eyJa")]
    began = time.time()
    assert secrets.find_secrets(docs(spark, texts)).count() == len(texts) and time.time() - began < 120


def test_web_tokens_are_as_from_the_left(spark):
    rule = next(r for r in secrets.RULES if r.kind == "web_token")
    texts = ["eyJa.eyJb.c", "-eyJa.eyJb.c.eyJd.eyJe.f", "xeyJeyJa.eyJb.c eyJ.eyJ.eyJ", "eyJa.eyJb. eyJa.eyJb.eyJc.eyJd", "éeyJa.eyJb.cé_eyJ1.eyJ2.3", "eyJa.b.eyJc.eyJd.e", "eyJ.eyJa.eyJb.c"]
    rows = secrets.find_secrets(docs(spark, texts)).orderBy("doc_id").collect()
    for t, r in zip(texts, rows, strict=True):
        assert [(s.start, s.end) for s in r.secret_spans if s.kind == "web_token"] == [m.span() for m in re.finditer(rule.regex, t)]


def test_licenses_in_time(spark):
    texts = ["x" + u * (BIG // len(u)) + "x" for u in (".", ".;", ". ", " ", "\t", "; ", "a.", "\n")]
    began = time.time()
    found = licenses.scan_licenses(docs(spark, texts)).collect()
    assert not any(r.licenses for r in found) and time.time() - began < 120


def test_language_sample_of_many_texts(spark):
    """Only the counts are large: the rate at which texts are drawn stays a number."""
    assert spark.range(1).select(F.try_divide(F.lit(float(2 * langid.SAMPLE_ROWS << 30)), F.lit(10**11)).alias("x")).first().x > 0
    rows = spark.range(3000).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    ((lang, texts),) = langid.labelled_sample(rows)
    assert lang == "en" and len(texts) == langid.SAMPLE_ROWS

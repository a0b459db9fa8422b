"""Held-out accuracy, and rows without anything to read."""

import pyarrow as pa
from pyspark.sql import functions as F

from camtrail.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string"


def test_presence_does_not_cross_texts_and_folds_case():
    bits = langid.presence(pa.array(["ab", "AB", "a", "", "b"]))
    assert (bits[0] == bits[1]).all() and bits[0].sum() == 3 and bits[2].sum() == 1 and bits[3].sum() == 0
    joined = langid.presence(pa.array(["a", "b"]))
    assert joined.sum() == 2


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = langid.identify(docs).filter("held_out and lang_pred <> 'und'")
    right, n = out.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 3000 and right / n >= 0.97
    low, high = out.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low and high <= 1


def test_odd_rows(spark):
    good = [(i, ("der hund und die katze " if i % 2 else "the dog and the cat ") * 5, "de" if i % 2 else "en", "x") for i in range(200)]
    odd = [(500, None, "en", None), (501, "", "en", None), (502, "12 34 !!", "de", None), (None, "the cat and the dog", "en", None), (503, "die katze und " * 20_000, None, None),
           (3, "der hund und die katze", "de", None)]
    out = langid.identify(spark.createDataFrame(good + odd, SCHEMA)).collect()
    assert len(out) == 206
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (500, 501, 502))
    assert by[None]["lang_pred"] == "en" and not by[None]["held_out"] and by[503]["lang_pred"] == "de"
    assert all(r["lang_pred"] == r["lang"] for r in out if r["doc_id"] is not None and r["doc_id"] < 200)
    none = langid.identify(spark.createDataFrame([(1, "no label", None, None)], SCHEMA)).first()
    assert none["lang_pred"] == "und" and langid.identify(spark.createDataFrame([], SCHEMA)).count() == 0

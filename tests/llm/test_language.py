"""Held-out accuracy, and that only text and training labels matter."""

import zlib

from pyspark.sql import functions as F

from wayfold.llm import language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs, ["doc_id"]).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.where(language.held_out()).agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).first()
    assert held.n > 200 and held.right > 0.95


def test_label_of_held_out_rows_is_unused_and_edges(spark):
    held = next(i for i in range(950, 999) if zlib.crc32(str(i).encode()) % 3 == 1)
    train = [(i, t, lang) for i, (t, lang) in enumerate([("der die und nicht ist ein", "de"), ("le la et les des une que", "fr"), ("the of and to in that is", "en")] * 30)]
    edge = [(held, "le la et les", "xx"), (902, None, "fr"), (903, "123 !!", "de"), (904, "", None), (905, "the and of " * 20000, None)]
    schema = "doc_id long, text string, lang string"
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(train + edge, schema), ["doc_id"]).collect()}
    assert got[held].lang_pred == "fr" and got[905].lang_pred == "en"
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (902, 903, 904))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(spark.createDataFrame([], schema), ["doc_id"]).count() == 0
    assert [r.lang_pred for r in language.identify(spark.createDataFrame([(1, "abc", None)], schema), ["doc_id"]).collect()] == ["und"]


def test_signs_are_no_letters_and_repeated_rows(spark):
    train = [(i, t, lang) for i, (t, lang) in enumerate([("der die und nicht ist ein", "de"), ("le la et les des une que", "fr")] * 30)]
    edge = [(900, "² ½ Ⅷ ① 12", None), (901, "ª", None), (902, "le la et", None), (902, "der die und", None), (None, "der die", "de"), (None, None, "de")]
    docs = spark.createDataFrame([(*x, 1.0) for x in train + edge], "doc_id long, text string, lang string, score double")
    got = sorted((str(r.doc_id), r.lang_pred) for r in language.identify(docs, ["doc_id"]).collect() if r.doc_id is None or r.doc_id >= 900)
    assert [x for x in got if x[0] != "901"] == [("900", "und"), ("902", "de"), ("902", "fr"), ("None", "de"), ("None", "und")]
    assert dict(got)["901"] != "und"


def test_ties_of_votes_go_to_the_first_name():
    import numpy as np

    model = language.Model([["a", "b", "c"]], np.zeros((3, language.DIMENSIONS + 1), np.float32), [], [[(0, 1, 0), (0, 2, 1), (1, 2, 2)]])
    assert model.predict(np.zeros((2, language.DIMENSIONS), np.float32))[0] == ["a", "a"]

"""Each stage on its own input: columns, what goes, what stays."""

import random

import corpus_pipeline as p


def test_stages_in_order(spark):
    r = random.Random(3)
    word = lambda: r.choice(["the", "of", "and", "in", "".join(chr(97 + r.randrange(26)) for _ in range(6))])
    shared = "this line stands on every page"
    rows = [(i, "\n".join([shared, *(" ".join(word() for _ in range(20)) for _ in range(4))]), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100, None, "en", "s0", 0), (101, "12 34", "en", "s0", 0), (102, rows[5][1], "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    before = {r.doc_id for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        assert tuple(docs.columns) == p.COLUMNS
        after = {r.doc_id for r in docs.collect()}
        gone, before = before - after, after
        if name == "language":
            assert gone == {100, 101}
        if name == "lines":
            # the shared line goes, all others and all documents stay
            assert not gone and {r.text.count("\n") for r in docs.collect()} == {3} and not any(shared in r.text for r in docs.collect())
        if name == "near_duplicates":
            assert 102 in gone and 5 in after
    tokens = {r.doc_id for r in p.STAGES[-1][1](spark, docs, "").collect()}
    assert tokens == before


def test_empty_tables_run_through(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, extra int")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0

"""Planted notices, whole and edited, with their spans."""

from pyspark.sql import functions as F

from wayfold.llm import licenses


def test_spans_and_coverage(spark):
    apache = licenses.TEMPLATES["Apache-2.0"][1]
    edited = apache.replace("you may not use", "you really may not ever use").replace("obtain a copy", "get a copy")
    rows = [(1, "é x. Released under the MIT License. tail"), (2, f"intro words\n{edited} end"), (3, "under the license of nothing"), (4, None), (5, ""), (6, "RELEASED under   the MIT license!\n" * 3), (7, "all of the text " * 9000)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit(1))).collect()
    by = {d: [r for r in got if r.doc_id == d] for d, _ in rows}
    text = dict(rows)
    (one,) = by[1]
    assert (one.license, one.coverage) == ("MIT", 1.0) and text[1][one.span_start : one.span_end] == "Released under the MIT License"
    long = [r for r in by[2] if r.template_words > 20]
    assert [r.license for r in long] == ["Apache-2.0"] and 0.85 < long[0].coverage < 1
    assert text[2][long[0].span_start : long[0].span_end].startswith("Licensed under") and text[2][: long[0].span_end].endswith("License at")
    assert not by[3] and not by[4] and not by[5] and not by[7]
    assert len([r for r in by[6] if r.coverage == 1.0]) == 3
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_licences_edited_licences_and_repeated_rows(spark):
    mit, bsd = licenses.TEXTS["MIT"][0], licenses.TEXTS["BSD-3-Clause"][0]
    cut = " ".join(w for i, w in enumerate(mit.split()) if i not in (20, 21, 90))
    rows = [(1, f"Copyright me\n\n{mit}\n\nmore"), (2, bsd.replace("the copyright holder", "Acme Corporation", 1)), (3, f"code {cut} code"), (4, mit + " " + bsd), (4, mit + " " + bsd)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {d: sorted((r.license, r.span_start, r.span_end, round(r.coverage, 3)) for r in got if r.doc_id == d) for d, _ in rows}
    n = len("Copyright me\n\n")
    assert by[1] == [("MIT", n, n + len(mit) - 1, 1.0)]
    ((name, a, b, share),) = by[2]
    assert name == "BSD-3-Clause" and a == 0 and 0.97 < share < 1
    ((name, a, b, share),) = by[3]
    assert name == "MIT" and dict(rows)[3][a:b] == cut.rstrip(".") and 0.97 < share < 1
    assert [x[0] for x in by[4]] == ["BSD-3-Clause"] * 2 + ["MIT"] * 2


def test_alignment_equals_full_table():
    import random

    import numpy as np

    r = random.Random(6)
    for _ in range(60):
        template = np.array([r.randrange(50) for _ in range(12)], np.uint64)
        middle = [x for x in template.tolist() if r.random() > 0.1]
        for _ in range(r.randrange(3)):
            middle.insert(r.randrange(len(middle) + 1), 99)
        text = np.array([r.randrange(60, 90) for _ in range(7)] + middle + [r.randrange(60, 90) for _ in range(7)], np.uint64)
        score = [[0] * (len(text) + 1)]
        for i in range(len(template)):
            row = [score[-1][0] - 1]
            for j in range(len(text)):
                row.append(max(score[-1][j] + (2 if text[j] == template[i] else -1), score[-1][j + 1] - 1, row[-1] - 1))
            score.append(row)
        matched, first, last = licenses.align(template, text, 7)
        assert 7 <= first <= last < 7 + len(middle) and max(score[-1]) <= 2 * matched
        # the score of the best whole alignment follows from what is matched: two for a match, one less for each other step
        assert matched == sum(x in template.tolist() for x in middle)

"""Base statistics against plain Python, and verdicts against labelled quality."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from wayfold.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def corpus():
    r = random.Random(2)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x\n" * 40, "é*é <b>\n\r\n é*é <b>", "a a a a a", " lead and  trail \n", "😀 😀 😀 😀"]
    texts += ["".join(r.choice(["the ", "of ", "a ", "b\n", "c# ", "\x0b", "é\r\n"]) for _ in range(r.randint(1, 120))) for _ in range(150)]
    texts += [" ".join(f"w{r.randrange(90)}" for _ in range(3000))]
    return list(enumerate(texts))


def test_statistics_and_sorted_repeats(spark, monkeypatch):
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (quality.COMPARISONS, 0):
        monkeypatch.setattr(quality, "COMPARISONS", limit)
        got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.statistics(frame).collect()}
        assert got == {d: brute(t) for d, t in rows}


def test_verdicts_follow_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = quality.judge(docs).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed")
    good = judged.where("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    bad = judged.where("quality = 0").agg(F.avg(F.col("kept").cast("int")), F.count("*")).first()
    assert good > 0.97 and bad[1] > 0 and bad[0] < 0.1, (good, bad)


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, kept int")).count() == 0

"""Substring removal against a dictionary of all word windows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import Row

from wayfold.llm.substrings import FingerprintIndex, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    seen, out = set(), set()
    for doc, text in sorted(rows):
        words = WORD.findall(text or "")
        drop = set()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                drop.update(range(i, i + window))
            seen.add(w)
        kept = " ".join(x for i, x in enumerate(words) if i not in drop)
        out.add((doc, len(words), len(drop), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus(seed, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "W1", "x|y"]
    passages = [[r.choice(vocabulary) for _ in range(r.randint(15, 60))] for _ in range(5)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "a " * 300), (4, "a b " * 100), (5, "a " * 19)]
    for i in range(6, n):
        words = []
        for _ in range(r.randint(0, 5)):
            words += r.choice(passages) if r.random() < 0.4 else [r.choice(vocabulary) for _ in range(r.randint(1, 50))]
        rows.append((i * 2, r.choice([" ", "\n", "\t "]).join(words)))
        if r.random() < 0.15:
            rows.append((i * 2 + 1, rows[-1][1]))
    r.shuffle(rows)
    return rows


def test_same_as_dictionary_of_windows(spark):
    rows = corpus(3)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for batches in (1, 3):
        got = remove_repeats(frame, batches=batches)
        assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()} == brute(rows, 20)


def test_compacted_runs_and_later_sessions_find_the_same(spark, tmp_path):
    rows = corpus(4, 60)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    cuts, found = range(0, 120, 24), []
    for kind in ("one", "many", "compacted", "reopened"):
        folder = f"file://{tmp_path}/index" if kind == "reopened" else None
        index = FingerprintIndex(spark, fan_in={"compacted": 1, "reopened": 2}.get(kind, 9), folder=folder)
        got = []
        for lo in [0] if kind == "one" else cuts:
            if kind == "reopened" and lo:
                index = FingerprintIndex.open(spark, folder)
            batch = frame if kind == "one" else frame.where(f"doc_id between {lo} and {lo + 23}")
            got.append(index.add(batch, frame))
            assert len(index.runs) <= max(2, index.fan_in)
        found.append({(r.doc_id, r.hashes[i : i + 8]) for x in got for r in map(lambda r: Row(doc_id=r.doc_id, hashes=bytes(r.hashes)), x.collect()) for i in range(0, len(r.hashes), 8)})
    assert found[0] and all(x == found[0] for x in found)
    # the runs that were compacted are gone, and an index is not overwritten
    assert sorted(x.name for x in (tmp_path / "index").iterdir() if not x.name.startswith(".")) == sorted([*index.names, "manifest.json"]) and index.added == 5
    with pytest.raises(FileExistsError):
        FingerprintIndex(spark, folder=f"file://{tmp_path}/index")


def twins(n):
    """Two different words that a polynomial hash modulo a power of two cannot tell apart."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_structured_words_long_texts_and_null_ids(spark):
    r = random.Random(7)
    rows = []
    for i, n in enumerate((512, 1024, 4096)):
        rest = " ".join(f"u{i}{r.randrange(10**6)}" for _ in range(19))
        rows += [(10 * i + j, f"{w} {rest}") for j, w in enumerate(twins(n))]
    long = " ".join(f"z{r.randrange(10**9)}" for _ in range(120_000))
    rows += [(50, long), (51, "head " + long), (52, long + " tail")]
    nulls = [(None, rows[0][1]), (None, " ".join(["again"] * 30)), (None, None)]
    got = remove_repeats(spark.createDataFrame([(*x, 1) for x in rows + nulls], "doc_id long, text string, hashes int").repartition(4))
    have = [(x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got.collect()]
    assert {x for x in have if x[0] is not None} == brute(rows, 20)
    # a row without doc_id loses only what repeats inside it
    assert sorted(x[1:3] for x in have if x[0] is None) == [(0, 0), (20, 0), (30, 29)]


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, hashes int, part int")
    assert remove_repeats(empty).count() == 0


def test_rows_of_one_doc_id_keep_the_first_start(spark):
    rows = corpus(5, 60)
    r = random.Random(6)
    passage = " ".join(f"p{r.randrange(9)}" for _ in range(50))
    rows += [r.choice(rows[:40]) for _ in range(10)] + [(7, passage)] * 3 + [(7, "x " + passage + " y"), (7, None), (7, None), (500, passage)]
    r.shuffle(rows)
    want = sorted((d, *x) for d, *x in brute_rows(rows, 20))
    for n, batches in ((1, 1), (5, 2), (30, 3)):
        got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), batches=batches)
        assert sorted((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got.collect()) == want
    assert any(d == 7 and n == 50 and not gone for d, n, gone, _ in want)


def brute_rows(rows, window):
    """As brute, with a row for each row; rows of one doc_id in order of their texts."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda x: (x[0], x[1] or "")):
        words = WORD.findall(text or "")
        drop = set()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                drop.update(range(i, i + window))
            seen.add(w)
        kept = " ".join(x for i, x in enumerate(words) if i not in drop)
        out.append((doc, len(words), len(drop), hashlib.sha256(kept.encode()).hexdigest()))
    return out

"""Marginals of the raked weights, the budget, and equal results of both ways to rake."""

import random

from pyspark.sql import functions as F

from wayfold.llm import mixing


def corpus(spark):
    r = random.Random(3)
    rows = [(i, f"s{min(r.randrange(9), 4)}", r.choice(["en", "en", "fr", None]), " ".join(f"longword{r.randrange(500)}" for _ in range(r.randint(0, 80)))) for i in range(900)]
    rows += [(1000, None, "de", None), (1001, "s0", "en", "")]
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")


def test_marginals_and_budget(spark, monkeypatch):
    docs = corpus(spark)
    mixed = mixing.mix_sources(docs).cache()
    total = mixed.agg(F.sum("n_tokens")).first()[0]
    for axis in mixing.AXES:
        got = {r[0]: (r.t, r.w) for r in mixed.groupBy(axis).agg(F.sum("n_tokens").alias("t"), F.sum(F.col("n_tokens") * F.col("weight")).alias("w")).collect()}
        share = {k: (1.0 if t else 0.0) if axis == "topic" else t**mixing.POWER for k, (t, _) in got.items()}
        whole = sum(share.values())
        assert all(abs(w / total - share[k] / whole) < 1e-6 for k, (_, w) in got.items())
    spent = mixed.agg(F.sum(F.col("n_tokens") * F.col("probability"))).first()[0]
    assert abs(spent / total - mixing.BUDGET) < 1e-6 and mixed.count() == 902
    drawn = mixed.where("selected").agg(F.sum("n_tokens")).first()[0]
    assert abs(drawn / total - mixing.BUDGET) < 0.06
    monkeypatch.setattr(mixing, "ROUNDS", 2)
    ways = [{r.doc_id: r.probability for r in mixing.mix_sources(docs, driver_cells=n).collect()} for n in (10**5, 3)]
    assert all(abs(ways[0][k] - ways[1][k]) < 1e-6 for k in ways[0])


def test_empty_table(spark):
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, source string, lang string, text string")).count() == 0


def test_given_targets_by_both_ways(spark):
    docs = corpus(spark).withColumn("topic", F.lit("clash")).withColumn("x", F.lit(1))
    targets = {"source": {"s0": 3, "s1": 1, "s4": 4, "none": 9}, "lang": {"en": 0.5, None: 0.5}}
    ways = [mixing.mix_sources(docs, 0.05, n, targets) for n in (10**5, 3)]
    found = []
    for mixed in ways:
        rows = mixed.collect()
        total = sum(r.n_tokens for r in rows)
        for axis, wanted in targets.items():
            real = {k: v for k, v in wanted.items() if k != "none"}
            for k in {r[axis] for r in rows}:
                share = sum(r.n_tokens * r.weight for r in rows if r[axis] == k) / total
                assert abs(share - real.get(k, 0) / sum(real.values())) < 1e-5, (axis, k)
        assert abs(sum(r.n_tokens * r.probability for r in rows) / total - 0.05) < 1e-6
        assert not any(r.selected for r in rows if r.source in ("s2", "s3") or r.lang == "fr")
        found.append({r.doc_id: r.probability for r in rows})
    assert all(abs(found[0][k] - found[1][k]) < 1e-5 for k in found[0])


def test_topics_group_vocabularies_and_repeated_rows(spark):
    r = random.Random(1)
    words = [[f"{c}longish{i}" for i in range(6)] for c in "abcdefgh"]
    rows = [(i, "s", "en", " ".join(r.choice(words[i % 8]) for _ in range(60))) for i in range(160)] + [(3, "s", "en", "other longishtext here"), (3, "s", "en", "other longishtext here"), (None, "s", "en", None)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")).collect()
    assert len(got) == 163 and sum(x.doc_id == 3 for x in got) == 3
    by = {}
    for x in got:
        if x.doc_id is not None and x.n_tokens == 60:
            by.setdefault(x.topic, []).append(x.doc_id % 8)
    assert len(by) >= 4 and sum(max(t.count(v) for v in t) for t in by.values()) >= 0.6 * 160

"""Readers, sinks, checks and features against plain Python."""

import json
import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.functions import columns as C
from wayfold.operators import checks, features, ranking
from wayfold.sources import readers, sinks


def save(spark):
    return sinks.Stage(spark).save


def test_records_of_lists_lines_and_folders(spark, tmp_path):
    rows = [{"a": i, "b": f"é{i}"} for i in range(7)]
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "part-0.json").write_text(json.dumps(rows[:3], ensure_ascii=False, indent=1), "utf-8")
    (folder / "part-1.json").write_text("﻿" + "\n".join(json.dumps(x) for x in rows[3:5]) + "\n\n", "utf-8")
    (folder / "part-2.json").write_text("\n  " + json.dumps(rows[5:]), "utf-8")
    (folder / "_SUCCESS").write_text("")
    got = readers.records(spark, str(folder), "a int, b string").orderBy("file", "row").collect()
    assert [(r.a, r.b) for r in got] == [(x["a"], x["b"]) for x in rows]
    assert [r.a for r in readers.records(spark, str(folder), "a int, b string", limit=4).collect()] == [0, 1, 2, 3]
    one = tmp_path / "one.json"
    one.write_text(json.dumps([{"a": 1}, 5, "x", {"a": 2}]))
    assert [r.a for r in readers.json_list(spark, str(one), "a int").orderBy("row").collect()] == [1, 2]
    one.write_text('{"a": 1}')
    with pytest.raises(Exception, match="not a JSON list"):
        readers.json_list(spark, str(one), "a int").collect()


def test_vectors_of_archives_and_pickles(spark, tmp_path):
    values = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.savez(tmp_path / "v.npz", pids=np.arange(4), embeddings=values)
    with open(tmp_path / "v.pkl", "wb") as f:
        pickle.dump({i: values[i] for i in range(4)}, f)
    for name in ("v.npz", "v.pkl"):
        got = {r.pid: list(r.v) for r in readers.vectors(spark, str(tmp_path / name), rows=3).collect()}
        assert got == {i: values[i].tolist() for i in range(4)}
    np.savez(tmp_path / "w.npz", pids=[1, 1], embeddings=values[:2])
    np.savez(tmp_path / "n.npz", pids=[1, 2], embeddings=[[1.0, np.nan], [1.0, 2.0]])
    with open(tmp_path / "x.pkl", "wb") as f:
        pickle.dump({"pids": print}, f)
    for name, why in (("w.npz", "twice"), ("n.npz", "finite"), ("x.pkl", "no plain value")):
        with pytest.raises(Exception, match=why):
            readers.vectors(spark, str(tmp_path / name)).collect()


def test_boundaries_and_aliases(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    made = lambda *codes: json.dumps({"features": [{"properties": {"adcode": c, "name": f"n{c}"}, "geometry": {"type": "Polygon", "coordinates": square}} for c in codes]})
    (tmp_path / "p.json").write_text(made("110000", "130000"))
    (tmp_path / "a_full.json").write_text(made("130100", "130200"))
    got = readers.boundaries(spark, str(tmp_path / "p.json"), str(tmp_path / "*_full.json")).collect()
    assert sorted(r.code for r in got) == ["110000", "130100", "130200"] and got[0]["shape"][0] == square
    with pytest.raises(ValueError):
        readers.boundaries(spark, None, None)
    df = spark.createDataFrame([(1, 2, 3)], "PID int, pid2 int, Lat int")
    assert readers.renamed(df, {"pid": ["pid", "poi"], "lat": ["latitude", "lat"]}).columns == ["pid", "pid2", "lat"]
    with pytest.raises(ValueError):
        readers.renamed(df, {"x": ["nope"]})


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 'q"x,', None), (1, "a|b", 0.5)], "k int, s string, f double")
    at = lambda n: f"file://{tmp_path}/{n}"
    assert sinks.write_ordered_csv(df, at("o.csv"), ["k"]) == 2
    assert (tmp_path / "o.csv").read_text() == 'k,s,f\n1,a|b,0.5\n2,"q""x,",\n'
    with pytest.raises(FileExistsError):
        sinks.write_ordered_csv(df, at("o.csv"), ["k"])
    assert sinks.write_json_list(df, at("l.json"), ["k"]) == 2
    assert json.loads((tmp_path / "l.json").read_text()) == [{"k": 1, "s": "a|b", "f": 0.5}, {"k": 2, "s": 'q"x,', "f": None}]
    sinks.write_statistics(df, at("s"), ["k"], ["k", "s", "f"])
    assert "| 1 | a\\|b | 0.5000 |\n| 2 | q\"x, | — |" in (tmp_path / "s.md").read_text()
    assert (tmp_path / "s.csv").read_bytes().startswith(b"\xef\xbb\xbfk,s,f\r\n")
    with pytest.raises(ValueError):
        sinks.write_statistics(df.withColumn("f", F.lit(float("nan"))), at("nan"), ["k"])
    assert sinks.write_verified(df, at("v")) == 2
    rows = spark.range(5).withColumnRenamed("id", "sample_index")
    found = sinks.write_shards(rows, at("shards"), 2)
    assert (found["samples"], found["shard_samples"]) == (5, [3, 2]) and json.loads((tmp_path / "shards_manifest.json").read_text()) == found
    for n, frame in ((0, rows), (6, rows), (2, rows.limit(0))):
        with pytest.raises(ValueError):
            sinks.write_shards(frame, at(f"bad{n}"), n)


def test_runner_skips_fails_and_archives(spark, tmp_path):
    folder, calls = f"file://{tmp_path}/run", []
    runner = sinks.Runner(spark, folder, log=calls.append)

    def work():
        spark.range(3).write.mode("overwrite").parquet(f"{folder}/out")
        return {"rows": 3}

    assert [runner.stage("one", [f"{folder}/out"], work)["skipped"] for _ in range(2)] == [False, True]
    with pytest.raises(RuntimeError):
        runner.stage("bad", [f"{folder}/none"], work)
    assert json.loads((tmp_path / "run" / "bad.failed.json").read_text())["status"] == "FAILED"
    with pytest.raises(RuntimeError):
        runner.stage("nan", [], lambda: {"x": [float("nan")]})
    assert checks.artifact_ready(spark, folder, ["out"], "one.json") and not checks.artifact_ready(spark, folder, ["none"], "one.json")
    assert runner.archive("one", f"{folder}/out", "a").endswith("out.incomplete_a") and not sinks.exists(spark, f"{folder}/out")
    with pytest.raises(ValueError):
        runner.archive("one", "file:///tmp/other", "a")


def test_checks_fail_when_read(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, float("nan")), (2, "c", None)], "k int, s string, x double")
    for made, why in ((checks.required_fields(df, ["s"]), "no s"), (checks.all_finite(df, ["x"]), "not finite"), (checks.unique(df, "k"), "twice"), (checks.covered_join(df.limit(1).select("k", "s"), spark.createDataFrame([(9, 1)], "k int, y int"), "k"), "different")):
        with pytest.raises(Exception, match=why):
            made.collect()
    found = checks.same_set(df, spark.createDataFrame([(1,), (7,)], "k int"), "k").first()
    assert (found.left_only, found.right_only, found.equal) == (1, 1, False)


def shards(spark, drop=(), repeat=(), k=(10, 10)):
    expected = spark.createDataFrame([(i, f"g{i}") for i in range(4)], "sample_index long, gold string")
    ranked = {0: ["g0"], 1: ["x", "g1"], 2: ["no"], 3: ["x", "x", "y", "g3"]}
    rows = [(i % 2, i, ranked[i]) for i in [*range(4), *repeat] if i not in drop]
    n = {s: sum(r[0] == s for r in rows) for s in (0, 1)}
    settings = spark.createDataFrame([(s, 2, n[s], k[s], s) for s in (0, 1)], "shard_index int, num_shards int, samples long, k int, illegal long")
    return expected, spark.createDataFrame(rows, "shard int, sample_index long, predictions array<string>"), settings


def test_merged_shards(spark):
    merged, report = checks.merged_shards(*shards(spark), 2)
    assert [r.sample_index for r in merged.collect()] == [0, 1, 2, 3]
    got = report.first()
    assert (got.r1, got.r5, got.r10, got.illegal_predictions, got.avg_unique_predictions) == (0.25, 0.75, 0.75, 1, 7 / 4)
    for bad in (shards(spark, drop=[3]), shards(spark, repeat=[1])):
        with pytest.raises(Exception, match="different values|twice"):
            checks.merged_shards(*bad, 2)[0].collect()
    with pytest.raises(ValueError):
        checks.merged_shards(*shards(spark, k=(10, 5)), 2)


def test_audit_finds_each_fault(spark):
    book = spark.createDataFrame([(i, f"<a_{i}>") for i in range(3)], "pid long, sid string")
    rows = spark.createDataFrame([(0, "q0", "<a_0>"), (1, "q1", "<a_1>")], "sample_index long, input string, output string")

    def audit(second, official=None):
        told = spark.createDataFrame([(0, "q0", "<a_0>", ["<a_0>"]), second], "sample_index long, input string, gold string, predictions array<string>")
        return checks.audited(rows, told, book, official or {"recall@1": 0.5, "recall@5": 1.0, "samples": 2, "legal_sid_count": 3}).first()

    good = (1, "q1", "<a_1>", ["<a_2>", "<a_1>"])
    assert audit(good).sound
    for second in ((1, "other", *good[2:]), (1, "q1", "<a_2>", good[3]), (*good[:3], [*good[3], "<a_9>"])):
        assert not audit(second).sound
    assert not audit(good, {"recall@1": 0.5 + 1e-9}).sound and not audit(good, {"samples": 3}).sound and not audit(good, {"k": 5}).sound


def test_lloyd_equals_plain_loops(spark):
    r = random.Random(3)
    points = [(i, i % 3, [r.random(), r.random()]) for i in range(90)]
    frame, quotas = spark.createDataFrame(points, "id long, g int, x array<double>"), {0: 4, 1: 1, 2: 7}
    hashes = {x.id: x.h for x in frame.select("id", F.xxhash64("id").alias("h")).collect()}
    got = {x.id: x.c for x in features.lloyd(frame, spark.createDataFrame(list(quotas.items()), "g int, k int"), rounds=5).collect()}
    for g, k in quotas.items():
        own = sorted((p for p in points if p[1] == g), key=lambda p: (hashes[p[0]], p[0]))
        centres, x = np.array([p[2] for p in own[:k]]), np.array([p[2] for p in own])
        for step in range(6):
            near = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
            if step < 5:
                centres = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(k)])
        assert {p[0]: int(c) for p, c in zip(own, near)} == {p[0]: got[p[0]] for p in own}


def test_region_codes_by_quota(spark):
    r = random.Random(4)
    places = spark.createDataFrame([(i, r.uniform(-50, 50), r.uniform(-90, 90)) for i in range(120)], "pid long, lat double, lon double")
    got = features.region_codes(places, 4, 12, save(spark)).collect()
    regions = {}
    for x in got:
        regions.setdefault(x.a, []).append(x.b)
    share = {a: len(b) ** 0.5 for a, b in regions.items()}
    raw = {a: s / sum(share.values()) * 12 for a, s in share.items()}
    quota = {a: max(1, int(v)) for a, v in raw.items()}
    for a in sorted(raw, key=lambda a: (-(raw[a] - int(raw[a])), a))[: 12 - sum(quota.values())]:
        quota[a] += 1
    start = 0
    assert len(got) == 120 and sorted(regions) == [0, 1, 2, 3]
    for a in sorted(regions):
        assert set(regions[a]) <= set(range(start, start + quota[a]))
        start += quota[a]


def test_place_vectors(spark):
    catalog = spark.createDataFrame([(1, 31.0, 121.0, "cafe"), (2, 0.0, 0.0, "bar"), (3, 10.0, 10.0, "cafe")], "pid long, lat double, lon double, l2 string")
    visits = spark.createDataFrame([(1, 6), (1, 6), (1, 12)], "pid long, hour int")
    got = {x.pid: np.array(x.v) for x in features.place_vectors(catalog, visits).collect()}
    assert all(len(v) == 79 for v in got.values()) and (got[1][:64] == got[3][:64]).all() and not got[2][67:].any()
    wave = [w for k in range(1, 7) for w in ((2 * np.sin(np.pi * k / 2) + np.sin(np.pi * k)) / 3, (2 * np.cos(np.pi * k / 2) + np.cos(np.pi * k)) / 3)]
    assert np.allclose(got[1][67:], wave) and np.allclose(got[2][64:67], [1, 0, 0])
    names = [f"kind {i} {'x' * (i % 5)}" for i in range(90)]
    full, part = features.hashed_letters(names), features.category_vectors(names, 64)
    assert part.shape == (90, 64)
    whole = features.category_vectors(names, 128)
    centred = full - full.mean(0)
    assert np.allclose(whole @ whole.T, centred @ centred.T) and np.allclose(part, whole[:, :64])
    spread = (part**2).sum(0)
    assert (np.diff(spread) <= 1e-9).all()


def test_bootstrap_covers_the_difference(spark):
    r = random.Random(9)
    rows = [("a", str(i), 4, float(r.randint(0, 4)), 2.0) for i in range(300)] + [("one", "x", 1, 1.0, 0.0), ("zero", "y", 3, 0.0, 0.0)]
    got = {x.city: x for x in ranking.bootstrap(spark.createDataFrame(rows, "city string, u string, n long, x double, y double"), rounds=400).collect()}
    a = got["a"]
    spread = np.std([(x - y) / n for c, _, n, x, y in rows if c == "a"]) / 300**0.5
    assert a.low < a.diff < a.high and abs((a.high - a.low) / (2 * 1.96 * spread) - 1) < 0.25
    assert (got["one"].low, got["one"].high, got["one"].relative_low) == (1.0, 1.0, None) and got["zero"].diff == 0


def test_names_codes_and_list_text(spark):
    row = spark.range(1).select(features.display_name(F.lit("乌鲁木齐市")).alias("a"), features.display_name(F.lit("某市")).alias("b"), features.parsed_code(F.lit("<a_1><b_2><c_3><d_0>"), 4).alias("c"), features.parsed_code(F.lit("<a_1><b_9><c_3>"), 4).alias("d"), features.listed_code(F.lit("[3, 1]")).alias("e"), C.sid_tokens(F.array(F.lit(1), F.lit(2))).alias("f")).first()
    assert tuple(row) == ("Urumqi", "某", [1, 2, 3], None, [3, 1], "<a_1><b_2>")
    with pytest.raises(Exception, match="26"):
        spark.range(1).select(C.sid_tokens(F.sequence(F.lit(0), F.lit(26)))).collect()
    with pytest.raises(ValueError):
        features.where_equal(spark.range(1), "city", "x")


def test_leading_md5_equals_hashlib():
    import hashlib

    from wayfold.functions.digests import leading_md5

    heads = [f"42:{u}:".encode() for u in ("", "7", "é乌", *["x" * n for n in (30, 43, 44, 45, 46, 47, 48, 60, 70)], *range(40))]
    tails = [str(b).encode() for b in (0, 9, 10, 99, 100, 1999)]
    assert leading_md5(heads, tails).tolist() == [[int(hashlib.md5(h + t).hexdigest()[:8], 16) for t in tails] for h in heads]


def test_bootstrap_equals_plain_sums_without_a_row_for_each_round(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(ranking, "_USERS", 5)
    monkeypatch.setattr(ranking, "_CITIES", 2)
    r, rounds = random.Random(4), 60
    users = [str(i) for i in range(17)] + ["x" * 60, "乌"]
    rows = [(c, u, r.randint(1, 4), float(r.randint(0, 3)), float(r.randint(0, 3))) for c in "abcdef" for u in users if r.random() < 0.7] + [("one", "0", 1, 1.0, 0.0), (None, "1", 2, 1.0, 1.0)]
    found = ranking.bootstrap(spark.createDataFrame(rows, "city string, u string, n long, x double, y double"), rounds)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    got = {x.city: tuple(x)[1:] for x in found.collect()}
    weight = lambda u, b: sum(int(hashlib.md5(f"42:{u}:{b}".encode()).hexdigest()[:8], 16) / 2**32 >= x for x in ranking._AT_MOST)
    assert set(got) == {c for c, *_ in rows} and got[None] == (0.0, None, None, None, None)
    for city in set(got) - {None}:
        own, d, rel = [x[1:] for x in rows if x[0] == city], [], []
        for b in range(rounds):
            w = [weight(u, b) for u, *_ in own]
            n, x, y = (sum(k * z[i] for k, z in zip(w, own)) for i in (1, 2, 3))
            if n:
                d.append((x - y) / n)
                rel += [(x - y) / y * 100] if y else []
        n, x, y = (sum(z[i] for z in own) for i in (1, 2, 3))
        want = ((x - y) / n, *np.quantile(d, [0.025, 0.975]), *(np.quantile(rel, [0.025, 0.975]) if rel else (None, None)))
        assert all(g == w or abs(g - w) < 1e-12 for g, w in zip(got[city], want)), city

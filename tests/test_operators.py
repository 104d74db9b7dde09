"""Goldens and properties of single operators."""

import random

import pytest
from pyspark.sql import functions as F

from wayfold.functions import columns as C
from wayfold.operators import codes, graph, ranking, trajectory
from wayfold.sources import readers, sinks


def test_geohash_golden(spark):
    assert spark.range(1).select(C.geohash(F.lit(40.7484), F.lit(-73.9857))).first()[0] == "dr5ru6j"


def test_collision_leaf_golden(spark):
    df = spark.createDataFrame([(9, [1, 2, 3]), (2, [1, 2, 3]), (5, [4, 5, 6]), (8, [1, 2, 3])], "pid long, code array<int>")
    got = {r.pid: r.code for r in codes.collision_leaves(df).collect()}
    assert got == {2: [1, 2, 3, 0], 5: [4, 5, 6], 8: [1, 2, 3, 1], 9: [1, 2, 3, 2]}


def test_boundaries():
    assert trajectory.boundaries("2024-01-01T08:00:00+08:00", None) == ("2024-01-01 00:00:00", None)
    for bad in (("2024-01-01", None), ("2024-01-02T00:00:00Z", "2024-01-01T00:00:00Z")):
        with pytest.raises(ValueError):
            trajectory.boundaries(*bad)


def test_dense_ids_are_sorted_positions(spark):
    keys = ["b", "a", "é", "z", "10", "9", "a", None, ""] + [f"k{i}" for i in range(200)]
    got = {r.k: r.id for r in trajectory.dense_ids(spark.createDataFrame([(k,) for k in keys], "k string").repartition(7), "k", "id").collect()}
    assert got == {k: i for i, k in enumerate(sorted({k for k in keys if k is not None}))}


def test_degree_cap_equals_scan(spark):
    r = random.Random(5)
    edges = [(a, b, float(r.randrange(6))) for a in range(12) for b in range(a + 1, 12) if r.random() < 0.6]
    degree, want = {}, set()
    for a, b, s in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if degree.get(a, 0) < 3 and degree.get(b, 0) < 3:
            want.add((a, b))
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    got = graph.degree_capped(spark.createDataFrame(edges, "l long, r long, score double"), 3, sinks.Stage(spark).save)
    assert {(x.l, x.r) for x in got.collect()} == want


def test_stable_assignment(spark):
    rows = [(1, 7, 0.9, 0), (1, 8, 0.5, 1), (2, 7, 0.95, 0), (2, 8, 0.1, 1), (3, 7, 0.2, 0)]
    got = graph.stable_assignment(spark.createDataFrame(rows, "pid long, code int, score double, rank int"), sinks.Stage(spark).save)
    assert {(r.pid, r.code) for r in got.collect()} == {(2, 7), (1, 8)}


def test_polygon_edges_and_holes(spark):
    shape = [[[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]], [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0], [1.0, 1.0]]]]
    points = [(0.0, 0.0, True), (4.0, 2.0, True), (1.5, 1.5, False), (1.0, 1.5, False), (3.0, 3.0, True), (5.0, 1.0, False)]
    df = spark.createDataFrame([(x, y, w, shape) for x, y, w in points], "x double, y double, w boolean, s array<array<array<array<double>>>>")
    assert df.where(C.in_polygons(F.col("x"), F.col("y"), F.col("s")) != F.col("w")).count() == 0


def test_zero_base_and_empty_city(spark):
    rows = spark.createDataFrame([("A", "u1", 1, 1, 0), ("A", "u2", 2, 0, 0)], "city string, u string, gold long, rank_x long, rank_y long")
    out = {r.city: r for r in ranking.by_city(rows, spark.createDataFrame([("A", 5), ("B", 2)], "city string, places long")).collect()}
    assert out["A"].x_r1 == 0.5 and out["A"].relative_r1 is None and out["B"].n == 0 and out["B"].x_r1 is None and out["ALL"].users == 2


def test_readers(spark, tmp_path):
    (tmp_path / "a.tsv").write_bytes("1\tp\tc\tCaf\xe9\t1.5\t2.5\t540\tTue Apr 03 18:00:09 +0000 2012\nbad\tline\n".encode("latin-1"))
    (r,) = readers.checkins_tsv(spark, str(tmp_path / "a.tsv")).collect()
    assert (r.category_name, r.latitude, r.tz_offset_min, r.time.year) == ("Café", 1.5, 540, 2012)
    (tmp_path / "l.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "j.json").write_text('{"a": 1}\n{"a": 2}\n')
    for name in ("l.json", "j.json"):
        assert [x.a for x in readers.records(spark, str(tmp_path / name), "a long").collect()] == [1, 2]
    (tmp_path / "g.json").write_text('{"features": [{"properties": {"adcode": "1", "name": "n"}, "geometry": {"type": "Polygon", "coordinates": [[[0,0],[1,0],[1,1],[0,0]]]}}]}')
    (g,) = readers.geojson(spark, str(tmp_path / "g.json")).collect()
    assert g.shape == [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]]
    sinks.write_shards(spark.range(7).withColumnRenamed("id", "sample_index"), str(tmp_path / "s"), 3)
    assert sorted(r["count"] for r in spark.read.json(str(tmp_path / "s")).groupBy("shard").count().collect()) == [2, 2, 3]


def _completed(priors, used, size):
    """One place after another, by rising id."""
    taken, out = set(used), {}
    for pid in sorted(priors):
        prior = priors[pid]
        tries = [prior]
        for at in (2, 1, 0):
            tries += [prior[:at] + (v,) + prior[at + 1 :] for v in range(size) if v != prior[at]]
        for keep in (0, 1, 2):
            pairs = [(f, g) for f in range(size) for g in range(size)]
            tries += [p[:keep] + (prior[keep],) + p[keep:] for p in pairs]
        tries += [(i // size**2, i // size % size, i % size) for i in range(size**3)]
        out[pid] = next(c for c in tries if c not in taken)
        taken.add(out[pid])
    return out


def test_unique_completion_equals_one_by_one(spark):
    r = random.Random(3)
    priors = {pid: (r.randrange(2), 1, r.randrange(2)) if pid % 3 else (0, 0, 0) for pid in range(24)}
    used = {(0, 0, 1), (1, 1, 0), (2, 2, 2)}
    rows = spark.createDataFrame([(k, *v) for k, v in priors.items()], "pid long, a long, b long, c long")
    taken = spark.createDataFrame([((a * 3 + b) * 3 + c,) for a, b, c in used], "code long")
    got = {x.pid: (x.code // 9, x.code // 3 % 3, x.code % 3) for x in graph.unique_completion(rows, taken, 3, sinks.Stage(spark).save).collect()}
    assert got == _completed(priors, used, 3)
    too_many = spark.range(9).selectExpr("id AS pid", "0L AS a", "0L AS b", "0L AS c")
    with pytest.raises(Exception, match="used up"):
        graph.unique_completion(too_many, taken.where("code < 0"), 2, sinks.Stage(spark).save).collect()


def test_unique_completion_of_a_crowded_space_takes_few_tables(spark, monkeypatch):
    r = random.Random(8)
    size, save = 5, sinks.Stage(spark).save
    priors = {pid: (pid % 2, pid % 2, 0) if pid < 70 else tuple(r.randrange(size) for _ in "abc") for pid in r.sample(range(200), 110)}
    used = r.sample([(a, b, c) for a in range(size) for b in range(size) for c in range(size)], 15)
    rows = spark.createDataFrame([(f"{k:03}", *v) for k, v in priors.items()], "pid string, a long, b long, c long").repartition(3)
    taken = spark.createDataFrame([((a * size + b) * size + c,) for a, b, c in used * 2] + [(-1,), (size**3,), (None,)], "code long")
    want, saved = {f"{k:03}": (a * size + b) * size + c for k, (a, b, c) in _completed(priors, used, size).items()}, []

    def noted(df, name):
        saved.append(name)
        return save(df, name)

    found = graph.unique_completion(rows, taken, size, noted)
    assert {x.pid: x.code for x in found.collect()} == want and len(set(want.values())) == size**3 - len(used)
    assert len(saved) == 3
    with pytest.raises(ValueError, match="used up"):
        graph.unique_completion(rows.union(spark.sql("SELECT '999', 0L, 0L, 0L")), taken, size, save)
    with pytest.raises(Exception, match="outside its levels"):
        graph.unique_completion(spark.sql("SELECT 1L AS pid, 0L AS a, 5L AS b, 0L AS c"), taken, size, save)
    few = rows.where("pid < '030'")
    want = {f"{k:03}": (a * size + b) * size + c for k, (a, b, c) in _completed({k: v for k, v in priors.items() if k < 30}, used, size).items()}
    monkeypatch.setattr(graph, "ONE_TASK", 1)
    assert {x.pid: x.code for x in graph.unique_completion(few, taken, size, save).collect()} == want


def test_reliability_groups(spark):
    from wayfold.operators.reliability import mode, reliability

    rows = [("s", ["a", "b", "a"], "a"), ("w", ["a", "b", "c", "d"], "x"), ("n", ["a", "a", "a"], "x"), ("w", [], "x"), ("n", ["a", "b", "c"], "a")]
    df = spark.createDataFrame([(w, h, g) for w, h, g in rows], "want string, h array<string>, g string")
    got = df.select("want", reliability(F.col("h"), F.col("g")).alias("r"), mode(F.col("h")).alias("m")).collect()
    assert all(x.r[0] == x.want for x in got)
    assert [x.m for x in got] == ["a", "a", "a", None, "a"]
    tail = df.select(reliability(F.col("h"), F.col("g"), F.lit(1), tail=1).alias("r")).collect()
    assert [x.r for x in tail] == ["strong", "weak", "weak", "weak", "normal"]


def test_sinkhorn_rows_and_columns(spark):
    from wayfold.operators.vectors import sinkhorn

    cells = spark.createDataFrame([(i, j, float((i * 7 + j * 3) % 5)) for i in range(4) for j in range(4)], "r long, c long, d double")
    q = sinkhorn(cells, 1.0, 10, sinks.Stage(spark).save)
    for key, near in (("r", 1e-6), ("c", 1e-2)):
        assert all(abs(x[1] - 1) < near for x in q.groupBy(key).sum("q").collect())


def test_unknown_code_and_repeated_key_are_errors(spark):
    book = spark.createDataFrame([("<a_1>", 7)], "sid string, pid long")
    texts = spark.createDataFrame([(1, "go <a_1>  <a_1> on"), (2, "none"), (3, None)], "k long, text string")
    assert {r.k: r.text for r in codes.with_pids(texts, book, "k", "text").collect()} == {1: "go [PID:7] [PID:7] on", 2: "none", 3: None}
    with pytest.raises(Exception, match="not in the codebook"):
        codes.with_pids(spark.createDataFrame([(1, "<a_2>")], "k long, text string"), book, "k", "text").collect()
    one = spark.range(3)
    assert ranking.disjoint_union([one, spark.range(3, 5)], "id").count() == 5
    with pytest.raises(Exception, match="twice"):
        ranking.disjoint_union([one, spark.range(2, 4)], "id").collect()


def test_best_epoch(spark):
    assert ranking.best_epoch(spark.createDataFrame([(1, 0.5), (2, 0.25), (3, 0.25)], "epoch long, loss double")).first().epoch == 2


def test_files(tmp_path):
    from wayfold.sources import files

    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    with pytest.raises(ValueError):
        files.one_of(a, b)
    files.write_report({"x": 1}, a)
    assert files.one_of(a, b) == a and not (tmp_path / "a.tmp").exists()
    with pytest.raises(ValueError):
        files.write_report({"x": float("nan")}, b)
    before = files.fingerprint(str(tmp_path))
    files.write_report({"x": 2}, a)
    assert files.fingerprint(str(tmp_path)) != before


def test_degree_cap_of_swing_pairs_ties_by_distance(spark):
    from wayfold.plans import bind, queries

    sf = "/root/testdata/sf0.01"
    items, places = bind.covisit_items(spark, sf), bind.covisit_places(spark, sf)
    scored = graph.distances(graph.swing(items, places).withColumn("score", F.round("score", 9)), places).collect()
    want, degree = set(), {}
    for x in sorted(scored, key=lambda x: (-x.score, x.km, x.l, x.r)):
        if degree.get(x.l, 0) < 50 and degree.get(x.r, 0) < 50:
            want.add((x.l, x.r))
            degree[x.l], degree[x.r] = degree.get(x.l, 0) + 1, degree.get(x.r, 0) + 1
    got = queries.degree_capped_pairs(spark, sf).collect()
    assert {(x.l, x.r) for x in got} == want and len(got) == len(want)
    edges = [(1, 2, 1.0, 2.0), (1, 3, 1.0, 1.0), (2, 4, 0.5, 0.1)]
    got = graph.degree_capped(spark.createDataFrame(edges, "l long, r long, score double, km double"), 1, sinks.Stage(spark).save)
    assert {(x.l, x.r) for x in got.collect()} == {(1, 3), (2, 4)}


def test_cpt_corpus_has_four_templates_and_counts_what_it_skips(spark):
    from wayfold.operators import corpus

    places = spark.createDataFrame([(1, 40.0, -73.0, "Food", "Cafe"), (2, 40.1, -73.1, "Travel", "Station")], "pid long, lat double, lon double, l1 string, l2 string")
    sids = spark.createDataFrame([(1, "<a_0><b_0><c_0>"), (2, "<a_0><b_0><c_1>")], "pid long, sid string")
    golden = [("[1, 2]", "['t1', 't2']")]
    bad = [("[1, 2", "['t1', 't2']"), ("[1, 2]", "['t1']"), ("[]", "[]"), ("[1, 9]", "['t1', 't2']"), (None, "[]")]
    for given, skipped in ((golden, (0, 0, 0)), (golden + bad, (2, 2, 1))):
        rows, report = corpus.cpt_corpus(places, sids, spark.createDataFrame(given, "seq string, times string"), sinks.Stage(spark).save)
        found = [(r.template, r.text) for r in rows.collect()]
        assert len(found) == 7 and len({t for t, _ in found}) == 4
        assert (corpus.TRAJECTORY, "User behavior trajectory modeling. Chronological POI visits: t1 visited <a_0><b_0><c_0>, t2 visited <a_0><b_0><c_1>.") in found
        about = "POI coordinates: latitude 40.000000, longitude -73.000000; geohash: dr5r0rb"
        assert sum(about[:60] in x and "category level 1: Food; category level 2: Cafe." in x and "<a_0><b_0><c_0>" in x for _, x in found) == 3
        counts = {r.name: r.n for r in report.collect()}
        assert tuple(counts[f"skipped_{x}"] for x in ("parse", "shape", "unknown_poi")) == skipped
        assert (counts["catalog_pois"], counts["train_sequence_rows"], counts["samples"], counts["template_poi_qa_definition"]) == (2, len(given), 7, 2)
    with pytest.raises(ValueError):
        corpus.cpt_rows(places, sids.where("pid = 1"))

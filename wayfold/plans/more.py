"""Sinks read back, checked joins, instruction data, audits and features as queries, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import catalog, checks, codes, corpus, features, ranking, trajectory
from ..sources import readers, sinks
from . import bind as B
from . import queries as Q
from .queries import query


def _place(spark, name: str) -> str:
    """A new place in the shared folder."""
    return f"{sinks.Stage(spark, 'sink').path}/{name}-{uuid.uuid4().hex}"


# --- sinks and sources --------------------------------------------------------------------------


@query("SELECT user_id, count(*) AS n, CAST(1 AS BIGINT) AS buckets FROM events GROUP BY 1")
def bucketed_sink(spark, sf_dir):
    """Events written by hash bucket of their user and read back: a user is in one bucket."""
    out = sinks.write_buckets(B.table(spark, sf_dir, "events").select("user_id", "event_id"), _place(spark, "buckets"), "user_id", 16)
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("_user_bucket").alias("buckets"))


@query("SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS price FROM orders")
def parquet_sink(spark, sf_dir):
    out = sinks.write_parquet(B.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("price")), _place(spark, "orders"), 4)
    return out


@query("SELECT row_number() OVER (ORDER BY s_nationkey, s_suppkey) AS line, s_suppkey || ',' || s_name || ',' || s_nationkey AS text FROM supplier")
def ordered_csv(spark, sf_dir):
    """One CSV file in order, line by line."""
    path = _place(spark, "ordered.csv")
    sinks.write_ordered_csv(B.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path, ["s_nationkey", "s_suppkey"])
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "text"))
    return lines.where("line > 0 and text != ''").select(F.col("line").cast("long").alias("line"), "text")


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS place, c_custkey, c_mktsegment FROM customer")
def json_list_sink(spark, sf_dir):
    """One JSON list in order, read by the strict reader."""
    path = _place(spark, "list.json")
    sinks.write_json_list(B.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), path, ["c_custkey"])
    return readers.json_list(spark, path, "c_custkey long, c_mktsegment string").select(F.col("row").cast("long").alias("place"), "c_custkey", "c_mktsegment")


@query("SELECT n_name AS name, count(s_suppkey) AS suppliers, round(avg(s_acctbal), 6) AS balance FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1")
def statistics_sink(spark, sf_dir):
    """A report as CSV, JSON and Markdown, the JSON read back."""
    path = _place(spark, "statistics")
    n = B.table(spark, sf_dir, "nation").join(B.table(spark, sf_dir, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    sinks.write_statistics(n.groupBy(F.col("n_name").alias("name")).agg(F.count("s_suppkey").alias("suppliers"), F.round(F.avg("s_acctbal"), 6).alias("balance")), path, ["name"])
    return spark.read.schema("name string, suppliers long, balance double").option("multiLine", True).json(f"{path}.json")


@query("SELECT o_orderkey, o_orderstatus, o_orderkey % 3 AS shard FROM orders")
def shard_sink(spark, sf_dir):
    """Rows dealt to three shards by index and read back."""
    path = _place(spark, "shards")
    sinks.write_shards(B.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), path, 3, "o_orderkey")
    return spark.read.schema("o_orderkey long, o_orderstatus string, shard long").json(path)


@query("SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders")
def json_records(spark, sf_dir):
    """JSON lines read with file and row, which keep the order."""
    path = _place(spark, "records")
    sinks.write_records(B.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey"), path)
    found = readers.records(spark, path, "o_orderkey long, o_orderpriority string")
    key = F.concat("file", F.lit("\u0001"), F.lpad(F.col("row").cast("string"), 20, "0"))
    found = sinks.Stage(spark).save(found.select("o_orderkey", "o_orderpriority", key.alias("key")), "records")
    return found.join(trajectory.dense_ids(found, "key", "place"), "key").select("o_orderkey", "o_orderpriority", "place")


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE event_id % 89 = 0 OR event_id % 97 = 0) AS dropped FROM events")
def jsonl_counts(spark, sf_dir):
    """Raw events as JSON lines, some cut short, read with a count of the dropped ones."""
    path, raw = _place(spark, "events"), B.raw_events(spark, sf_dir)
    line = F.to_json(F.struct(*[f.split()[0] for f in readers.EVENT_SCHEMA.split(", ")]))
    raw.select(F.when(F.col("event_id") % 89 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    return readers.events_counted(spark, path)[1]


@query("SELECT CAST(user_id AS VARCHAR) AS user_id, event_type AS poi_id, count(*) AS n FROM events WHERE event_id % 5 <> 0 GROUP BY 1, 2")
def checkins_scan(spark, sf_dir):
    """Eight-column lines with and without a ninth column; the latter go."""
    path, e = _place(spark, "checkins"), B.table(spark, sf_dir, "events")
    fields = [F.col("user_id").cast("string"), F.col("event_type"), F.lit("c1"), F.lit("Cafe"), F.lit("40.5"), F.lit("-73.9"), F.lit("480"), F.concat(F.date_format("ts", "EEE MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format("ts", "yyyy"))]
    line = F.concat_ws("\t", *fields, F.when(F.col("event_id") % 5 == 0, F.lit("more")))
    e.select(line.alias("value")).write.text(path)
    read = readers.checkins_tsv(spark, path).where("time is not null and latitude = 40.5")
    return read.groupBy("user_id", "poi_id").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS pid, s_name AS name, s_nationkey AS nation FROM supplier")
def csv_scan(spark, sf_dir):
    path = _place(spark, "csv")
    B.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey").write.option("header", True).csv(path)
    return readers.renamed(readers.table_csv(spark, path, "s_suppkey long, s_name string, s_nationkey long"), {"pid": ["pid", "S_SUPPKEY"], "name": ["s_name"], "nation": ["NationKey", "s_nationKey"]})


# --- projections, filters, checks ---------------------------------------------------------------


@query("SELECT s_suppkey AS pid, round(s_acctbal, 2) AS latitude FROM supplier")
def alias_columns(spark, sf_dir):
    found = readers.renamed(B.table(spark, sf_dir, "supplier"), {"pid": ["pid", "PoiId", "S_SuppKey"], "latitude": ["lat", "S_ACCTBAL"]})
    return found.select("pid", F.round("latitude", 2).alias("latitude"))


@query("SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'")
def city_event_filters(spark, sf_dir):
    """Market segments as cities, order states as event types."""
    events = features.where_equal(B.table(spark, sf_dir, "orders"), "o_orderstatus", "F")
    places = features.where_equal(B.table(spark, sf_dir, "customer"), "c_mktsegment", "BUILDING")
    return events.join(places, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN 'size ' || p_size ELSE 'L2-' || p_size END AS name FROM part")
def category_names(spark, sf_dir):
    """Given names, names of a mapping, names made of level and label."""
    part = B.table(spark, sf_dir, "part")
    mapping = part.select("p_size").distinct().select("p_size", F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("mapped"))
    k = F.col("p_partkey") % 3
    named = part.join(F.broadcast(mapping), "p_size").select("p_partkey", features.category_name(F.when(k == 0, F.col("p_brand")), F.when(k == 1, F.col("mapped")), F.col("p_size"), 2).alias("name"))
    return named


_CITY_CASE = "CASE n_nationkey % 4 WHEN 0 THEN '北京市' WHEN 1 THEN '香港特别行政区' WHEN 2 THEN n_name || '市' ELSE n_name END"


@query("SELECT n_name, CASE n_nationkey % 4 WHEN 0 THEN 'Beijing' WHEN 1 THEN 'Hong Kong' ELSE n_name END AS shown FROM nation")
def display_names(spark, sf_dir):
    return B.table(spark, sf_dir, "nation").select("n_name", features.display_name(F.expr(_CITY_CASE)).alias("shown"))


@query("SELECT c_custkey, c_mktsegment, round(c_acctbal, 2) AS balance FROM customer")
def row_checks(spark, sf_dir):
    """Required fields, finite numbers and unique keys, checked while the rows are read."""
    c = checks.required_fields(B.table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"])
    return checks.unique(checks.all_finite(c, ["c_acctbal"]), "c_custkey").select("c_custkey", "c_mktsegment", F.round("c_acctbal", 2).alias("balance"))


@query("SELECT (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)) AS left_only, (SELECT count(*) FROM (SELECT DISTINCT l_partkey FROM lineitem) WHERE l_partkey NOT IN (SELECT p_partkey FROM part)) AS right_only, NOT EXISTS (SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)) AS equal")
def set_equality(spark, sf_dir):
    return checks.same_set(B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), B.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")), "k")


@query("SELECT s_suppkey, s_name, n FROM supplier JOIN (SELECT s_suppkey AS k, count(l_suppkey) AS n FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1) ON k = s_suppkey")
def coverage_merge(spark, sf_dir):
    """Suppliers with the counts of the same suppliers, one to one."""
    s = B.table(spark, sf_dir, "supplier")
    n = s.join(B.table(spark, sf_dir, "lineitem"), F.col("s_suppkey") == F.col("l_suppkey"), "left").groupBy("s_suppkey").agg(F.count("l_suppkey").alias("n"))
    return checks.covered_join(s.select("s_suppkey", "s_name"), n, "s_suppkey")


@query("SELECT p_type AS category, count(*) AS n FROM part WHERE p_partkey % 7 <> 0 AND p_type NOT LIKE '%A%' GROUP BY 1 ORDER BY n DESC, category LIMIT 20")
def unmapped_categories(spark, sf_dir):
    """The twenty categories without a mapping that most rows have."""
    part = B.table(spark, sf_dir, "part").where("p_partkey % 7 != 0")
    mapped = part.where(F.col("p_type").contains("A")).select("p_type").distinct()
    return part.join(F.broadcast(mapped), "p_type", "left_anti").groupBy(F.col("p_type").alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(20)


# --- trajectories and instruction data ----------------------------------------------------------

_LOCAL = "strftime(t + INTERVAL 480 MINUTE, '%Y-%m-%d %H:%M:%S')"
_SEQS = f"WITH {Q.A_STATES}, ids AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS pid FROM (SELECT DISTINCT p FROM st)), x AS (SELECT u, p, t, pid, row_number() OVER w AS place, string_agg(CAST(pid AS VARCHAR), ',') OVER (PARTITION BY u ORDER BY t, p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS seq, string_agg({_LOCAL}, ',') OVER (PARTITION BY u ORDER BY t, p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS times FROM st JOIN ids USING (p) WINDOW w AS (PARTITION BY u ORDER BY t, p))"


def _local(t):
    return F.date_format(t + F.expr("INTERVAL 480 MINUTES"), "yyyy-MM-dd HH:mm:ss")


def _samples_a(spark, sf_dir):
    """split, u, t, place, seq, times (local text) of the samples of A, from states written once."""
    s = sinks.Stage(spark).save(Q.states_a(spark, sf_dir), "states")
    found = trajectory.rolling(s).withColumn("split", trajectory.split_of(B.A_TRAIN, B.A_VALID))
    return s, found.select("split", "u", "t", "place", "seq", F.transform("times", _local).alias("times"))


@query(f"""{_SEQS} SELECT u AS "UserId", strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS target_utc, seq AS "sequence_PoiId", times AS "sequence_UTCTimeOffset" FROM x WHERE place > 1""")
def sequence_columns(spark, sf_dir):
    """Samples under their published names; the last one holds local times."""
    s, found = _samples_a(spark, sf_dir)
    ids = trajectory.dense_ids(s, "p", "pid")
    visits = found.select("u", "t", "place", "times", F.posexplode("seq").alias("at", "p")).join(F.broadcast(ids), "p")
    told = visits.groupBy("u", "t", "place", "times").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "pid"))), lambda x: x["pid"].cast("string")).alias("pids"))
    return told.select(F.col("u").alias("UserId"), F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("target_utc"), F.array_join("pids", ",").alias("sequence_PoiId"), F.array_join("times", ",").alias("sequence_UTCTimeOffset"))


@query(f"{_SEQS} SELECT u, place, row_number() OVER (ORDER BY strftime(t, '%Y-%m-%dT%H:%M:%SZ'), u, place) - 1 AS n FROM x WHERE place > 1")
def sample_order(spark, sf_dir):
    """Samples numbered by (target time, user), without a window over all of them."""
    found = _samples_a(spark, sf_dir)[1].select("u", F.col("place").cast("long").alias("place"), F.concat_ws("\u0001", F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "u", F.lpad(F.col("place").cast("string"), 12, "0")).alias("key"))
    found = sinks.Stage(spark).save(found, "samples")
    return found.join(trajectory.dense_ids(found, "key", "n"), "key").select("u", "place", "n")


@query(f"""{_SEQS}, h AS (SELECT *, string_agg({_LOCAL} || ' visited <a_' || pid || '>', ', ') OVER (PARTITION BY u ORDER BY t, p ROWS BETWEEN 49 PRECEDING AND 1 PRECEDING) AS h FROM x)
 SELECT {Q._case(B.A_TRAIN, B.A_VALID)} AS split, '{features.INSTRUCTION.replace("'", "''")}' AS instruction, 'User_' || u || ' checkin history: ' || h || '.' || chr(10) || 'When ' || {_LOCAL} || ' user_' || u || ' is likely to visit:' AS input, '<a_' || pid || '>' AS output FROM h WHERE place > 1""")
def sft_splits(spark, sf_dir):
    """Instruction records of every split, written as JSON lines, counted and read back."""
    s, found = _samples_a(spark, sf_dir)
    book = trajectory.dense_ids(s, "p", "pid").select("p", C.sid_tokens(F.array("pid")).alias("sid"))
    rows = sinks.Stage(spark).save(features.sft_rows(found, book), "sft")
    path = _place(spark, "sft")
    if sinks.write_verified(rows, path) != rows.count():
        raise RuntimeError("records were lost in writing")
    return spark.read.schema(rows.schema).json(path)


@query(Q._GRID + f", d AS (SELECT pid, format('POI coordinates: latitude {{:.6f}}, longitude {{:.6f}}; geohash: {{}}; category level 1: {{}}; category level 2: {{}}.', lat, lon, {Q.geohash_sql('lat', 'lon')}, l1, l2) AS text, '<a_' || a || '><b_' || b || '><c_' || l1_label || '><d_' || l2_label || '><e_' || e || '>' AS sid FROM code) SELECT '{features.EM_INSTRUCTION}' AS instruction, text AS input, sid AS output, pid FROM d")
def em_records(spark, sf_dir):
    """The description of each place to its code."""
    places = sinks.Stage(spark).save(Q.coded(spark, sf_dir), "places")
    return features.em_records(places.select("pid", "lat", "lon", "l1", "l2"), places.select("pid", C.sid_tokens(F.array("a", "b", "l1_label", "l2_label", "e")).alias("sid")))


@query(f"WITH {Q._CATALOG} SELECT pid, format('Category level 1: {{}}; category level 2: {{}}; latitude: {{:.6f}}; longitude: {{:.6f}}.', l1, l2, lat, lon) AS text FROM full_cat")
def catalog_descriptions(spark, sf_dir):
    return Q.catalog_b(spark, sf_dir).select("pid", F.format_string("Category level 1: %s; category level 2: %s; latitude: %.6f; longitude: %.6f.", "l1", "l2", "lat", "lon").alias("text"))


# --- features and codes -------------------------------------------------------------------------

_Z = "(({c} - avg({c}) OVER ()) / (stddev_pop({c}) OVER () + 1e-12))"
_COORDS = ["zlat", "zlon"] + [f"{f}(2 * pi() * {k} * {z})" for z in ("zlat", "zlon") for k in features.FREQUENCIES for f in ("sin", "cos")]


@query(f"WITH m AS (SELECT p, median(lat) AS lat, median(lon) AS lon FROM ({B.B_SQL}) GROUP BY p), z AS (SELECT p, {_Z.format(c='lat')} AS zlat, {_Z.format(c='lon')} AS zlon FROM m) SELECT p, {', '.join(f'round({x}, 5) AS f{i}' for i, x in enumerate(_COORDS))} FROM z")
def coordinate_features(spark, sf_dir):
    z = features.z_scored(catalog.medians(B.visits_b(spark, sf_dir), "p", ["lat", "lon"]))
    return z.select("p", *[F.round(x, 5).alias(f"f{i}") for i, x in enumerate(features.coordinate_features())])


@query()
def region_codes(spark, sf_dir):
    """Five-level codes with learned regions: a and b by k-means with quotas, then categories and a number."""
    places = sinks.Stage(spark).save(Q.catalog_b(spark, sf_dir), "catalog")
    regions = features.region_codes(places, 8, 32, sinks.Stage(spark).save)
    made = codes.leaves(places.join(regions, "pid"), ["a", "b", "l1_label", "l2_label"], "pid")
    return made.select("pid", "a", "b", "l1_label", "l2_label", "e", C.sid_tokens(F.array("a", "b", "l1_label", "l2_label", "e")).alias("sid"))


@query()
def place_vectors(spark, sf_dir):
    """79 numbers of each place, by the pluggable encoder's default."""
    places = sinks.Stage(spark).save(Q.catalog_b(spark, sf_dir).select("pid", "p", "lat", "lon", "l2"), "catalog")
    visits = B.visits_b(spark, sf_dir).where(F.col("t") <= trajectory.bound(B.B_TRAIN)).join(places.select("p", "pid"), "p").select("pid", F.hour(F.col("t") + F.expr("INTERVAL 480 MINUTES")).alias("hour"))
    found = features.place_vectors(places.select("pid", "lat", "lon", "l2"), visits)
    return found.select("pid", F.array_join(F.transform("v", lambda x: F.format_number(x, 5)), " ").alias("v"))


_VOCAB = "{n}s AS (SELECT {x} AS l, row_number() OVER (ORDER BY count(*) DESC, {x}) - 1 AS id, count(*) AS c FROM tr GROUP BY 1)"


@query(Q._GRID + f""", sm AS (SELECT pid, '<a_' || a || '>' AS l1, '<b_' || b || '>' AS l2, '<a_' || a || '><b_' || b || '>' AS l12 FROM code), tr AS (SELECT * FROM sm WHERE pid % 3 <> 0 AND pid % 10 <> 0), {_VOCAB.format(n='z1', x='l1')}, {_VOCAB.format(n='z2', x='l2')}, {_VOCAB.format(n='z12', x='l12')},
 r AS (SELECT pid AS id, CASE WHEN pid % 10 = 0 THEN 'bad_sid' WHEN z1s.id IS NULL OR z2s.id IS NULL THEN 'unknown_prefix' WHEN pid % 11 = 0 THEN 'empty_prompt' END AS reason, z1s.id AS z1, z2s.id AS z2, coalesce(z12s.id, -1) AS z12, CASE WHEN z1s.c >= 5 THEN 1 ELSE 0 END AS sibling FROM sm LEFT JOIN z1s ON l1 = z1s.l LEFT JOIN z2s ON l2 = z2s.l LEFT JOIN z12s ON l12 = z12s.l)
 SELECT id, reason, CASE WHEN reason IS NULL THEN z1 END AS z1, CASE WHEN reason IS NULL THEN z2 END AS z2, CASE WHEN reason IS NULL THEN z12 END AS z12, CASE WHEN reason IS NULL THEN CAST(sibling AS BIGINT) END AS sibling FROM r""")
def encoded_labels(spark, sf_dir):
    """Label ids of samples whose outputs are codes; ids come from two thirds of them, a tenth have a broken code."""
    places = sinks.Stage(spark).save(Q.coded(spark, sf_dir).select("pid", "a", "b"), "places")
    k = F.col("pid")
    sid = F.when(k % 10 == 0, F.concat(F.lit("<a_"), "a", F.lit(">"))).otherwise(C.sid_tokens(F.array("a", "b")))
    samples = places.select(k.alias("id"), F.when(k % 11 == 0, "").otherwise("prompt").alias("input"), sid.alias("output"))
    return features.encoded_labels(samples, samples.where("id % 3 != 0 and id % 10 != 0"))


_REASONS = Q.ORACLES["encoded_labels"]


@query(f"SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM ({_REASONS}) GROUP BY 1")
def label_skips(spark, sf_dir):
    return encoded_labels(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT size, count(*) AS places FROM (SELECT l_suppkey, count(DISTINCT l_partkey) AS size FROM lineitem GROUP BY 1) GROUP BY 1")
def candidate_histogram(spark, sf_dir):
    """How many places have how many candidates."""
    per = B.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("size"))
    return per.groupBy("size").agg(F.count("*").alias("places"))


_SIX = "(SELECT range AS a FROM range(6))"


@query(f"WITH v AS (SELECT string_agg(a, ',' ORDER BY a) AS next FROM {_SIX}) SELECT prefix, next FROM (SELECT '' AS prefix UNION ALL SELECT CAST(a AS VARCHAR) FROM {_SIX} UNION ALL SELECT x.a || ',' || y.a FROM {_SIX} x, {_SIX} y), v")
def combination_trie(spark, sf_dir):
    """All codes of three levels of six values."""
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return features.combination_trie(spark, 6).select(text("prefix").alias("prefix"), text("next").alias("next"))


@query("SELECT p_partkey, CASE WHEN p_size < 40 AND p_partkey % 4 <> 0 THEN p_size || ',' || p_partkey % 40 || ',0' END AS code, CASE WHEN p_partkey % 4 <> 0 THEN p_size + p_partkey % 40 END AS total FROM part")
def code_parse(spark, sf_dir):
    """Codes out of running text, in range or null, and out of list text."""
    part, k = B.table(spark, sf_dir, "part"), F.col("p_partkey")
    text = F.when(k % 4 == 0, F.lit("none <a_1><c_2>")).otherwise(F.concat(F.lit("see <a_"), "p_size", F.lit("><b_"), k % 40, F.lit("><c_0> there")))
    listed = F.when(k % 4 == 0, F.lit("no list")).otherwise(F.concat(F.lit("["), "p_size", F.lit(", "), k % 40, F.lit("]")))
    total = F.aggregate(features.listed_code(listed), F.lit(0), lambda s, x: s + x)
    return part.select("p_partkey", F.array_join(F.transform(features.parsed_code(text, 40), lambda x: x.cast("string")), ",").alias("code"), F.when(k % 4 != 0, total).cast("long").alias("total"))


@query(Q._GRID + ", n AS (SELECT *, CASE WHEN pid % 3 = 0 THEN a + 1 ELSE a END AS before FROM code) SELECT count(DISTINCT a) AS used_a, count(DISTINCT b) AS used_b, count(DISTINCT l1_label) AS used_c, count(*) FILTER (WHERE before <> a) AS changed, count(*) FILTER (WHERE before = a) AS retained, count(*) FILTER (WHERE e > 0) AS with_leaf, max(e) AS max_leaf FROM n")
def code_usage(spark, sf_dir):
    """Used codes of each level, and how many places changed theirs."""
    c = Q.coded(spark, sf_dir).withColumn("before", F.when(F.col("pid") % 3 == 0, F.col("a") + 1).otherwise(F.col("a")))
    return c.agg(F.count_distinct("a").alias("used_a"), F.count_distinct("b").alias("used_b"), F.count_distinct("l1_label").alias("used_c"), F.count_if(F.col("before") != F.col("a")).alias("changed"), F.count_if(F.col("before") == F.col("a")).alias("retained"), F.count_if(F.col("e") > 0).alias("with_leaf"), F.max("e").alias("max_leaf"))


@query("SELECT l_returnflag AS epoch, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS loss FROM lineitem GROUP BY 1")
def weighted_means(spark, sf_dir):
    """Losses averaged by the sizes of their batches."""
    q = F.col("l_quantity")
    return B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("epoch")).agg(F.round(F.sum(q * F.col("l_extendedprice")) / F.sum(q), 4).alias("loss"))


# --- predictions and audits ---------------------------------------------------------------------


def _kept(k):
    return ranking.filtered(Q._predicted(k), lambda v: v >= 0)[1]


@query(Q._RANKS + ", ks AS (SELECT i, x FROM x_d WHERE r <= 10) SELECT CAST(x % 3 + 1 AS BIGINT) AS length, count(*) AS n FROM ks GROUP BY 1")
def prediction_lengths(spark, sf_dir):
    """How many levels the kept predictions have."""
    sid = F.explode(F.transform(_kept(F.col("i") % 13), lambda x: C.sid_tokens(F.slice(F.array(x, x, x), F.lit(1), (x % 3 + 1).cast("int")))))
    rows = Q.samples_b(spark, sf_dir).select(sid.alias("sid"))
    return rows.groupBy(F.size(F.regexp_extract_all("sid", F.lit(r"<[a-z]_\d+>"), F.lit(0))).cast("long").alias("length")).agg(F.count("*").alias("n"))


@query(Q._RANKS + f", c AS (SELECT i, count(*) AS c FROM x_d WHERE r <= 10 GROUP BY i) SELECT 'x' AS method, round(avg(coalesce(c, 0)), 9) AS unique_predictions, {Q._HITS} FROM x LEFT JOIN c USING (i)")
def unique_predictions(spark, sf_dir):
    s = Q.samples_b(spark, sf_dir).withColumn("kept", _kept(F.col("i") % 13)).withColumn("rank", ranking.ranked(F.col("kept"), F.col("gold")))
    found = s.agg(F.round(F.avg(F.size("kept")), 9).alias("unique_predictions"), *ranking.metrics()).drop("n")
    return found.withColumns({c: F.round(c, 9) for c in ("r1", "r5", "r10", "ndcg10")}).withColumn("method", F.lit("x"))


_METRICS = "count(*) AS n, " + Q._HITS


@query(Q._RANKS + f" SELECT {_METRICS}, CAST(0 AS BIGINT) AS gold_differs, CAST(0 AS BIGINT) AS input_differs, CAST(0 AS BIGINT) AS gold_illegal, CAST(0 AS BIGINT) AS predictions_illegal, (SELECT count(*) FROM nums) AS codes, true AS sound FROM x")
def method_audit(spark, sf_dir):
    """A method's predictions against its samples, its codebook and the metrics that it reports."""
    save = sinks.Stage(spark).save
    s = save(Q.samples_b(spark, sf_dir).withColumn("kept", _kept(F.col("i") % 13)), "predicted")
    sid = lambda c: F.concat(F.lit("<a_"), c, F.lit(">"))
    rows = s.select(F.col("i").alias("sample_index"), F.concat(F.lit("user "), "u").alias("input"), sid(F.col("gold")).alias("output"))
    told = s.select(F.col("i").alias("sample_index"), F.concat(F.lit("user "), "u").alias("input"), sid(F.col("gold")).alias("gold"), F.transform("kept", lambda x: sid(x.cast("string"))).alias("predictions"))
    # the shared states hold every place, so its places are numbered 0 to n - 1
    n = s.agg(F.max("n")).first()[0] or 0
    book = spark.range(n).select(F.col("id").alias("pid"), sid(F.col("id")).alias("sid"))
    reported = s.withColumn("rank", ranking.ranked(F.col("kept"), F.col("gold"))).agg(*ranking.metrics()).first()
    official = {"recall@1": reported.r1 or 0.0, "recall@5": reported.r5 or 0.0, "recall@10": reported.r10 or 0.0, "ndcg@10": reported.ndcg10 or 0.0, "samples": reported.n, "legal_sid_count": n, "k": 10}
    return checks.audited(rows, told, book, official).withColumns({c: F.round(c, 9) for c in ("r1", "r5", "r10", "ndcg10")})


@query(Q._RANKS + f", c AS (SELECT i, count(*) AS c FROM x_d WHERE r <= 10 GROUP BY i) SELECT {_METRICS}, round(avg(coalesce(c, 0)), 9) AS avg_unique_predictions, count(*) AS illegal_predictions, CAST(5 AS BIGINT) AS num_shards, CAST(10 AS BIGINT) AS k FROM x LEFT JOIN c USING (i)")
def shard_merge(spark, sf_dir):
    """Five shards of predictions, merged, checked and measured again."""
    save = sinks.Stage(spark).save
    s = save(Q.samples_b(spark, sf_dir).select(F.col("i").alias("sample_index"), "gold", Q._predicted(F.col("i") % 13).alias("predictions")), "predicted")
    dealt = ranking.shards(s.select("sample_index", "predictions"), 5)
    settings = dealt.groupBy(F.col("shard").alias("shard_index")).agg(F.count("*").alias("samples"), F.sum(F.size(F.filter("predictions", lambda x: x < 0))).alias("illegal"))
    settings = spark.range(5).select(F.col("id").alias("shard_index")).join(settings, "shard_index", "left").select("shard_index", F.lit(5).alias("num_shards"), F.lit(10).alias("k"), F.coalesce("samples", F.lit(0)).alias("samples"), F.coalesce("illegal", F.lit(0)).alias("illegal"))
    report = checks.merged_shards(s.select("sample_index", "gold"), dealt, settings, 5, lambda x: x >= 0)[1]
    return report.withColumns({c: F.round(c, 9) for c in ("r1", "r5", "r10", "ndcg10", "avg_unique_predictions")})


@query(Q._RANKS + " SELECT x.i AS sample_index, x.gold, coalesce(c, 0) AS kept FROM x LEFT JOIN (SELECT i, count(*) AS c FROM x_d WHERE r <= 10 GROUP BY i) c ON x.i = c.i")
def positional_join(spark, sf_dir):
    """Samples and predictions by index."""
    s = sinks.Stage(spark).save(Q.samples_b(spark, sf_dir).select(F.col("i").alias("sample_index"), "gold", _kept(F.col("i") % 13).alias("predictions")), "predicted")
    return checks.by_position(s.select("sample_index", "gold"), s.select("sample_index", "predictions")).select("sample_index", "gold", F.size("predictions").cast("long").alias("kept"))


_CONDS = ["lat BETWEEN -60 AND 0 AND lon <= 0", "lat BETWEEN -60 AND 0 AND lon >= 0", "lat BETWEEN 10 AND 60 AND lon <= 0 AND NOT (lon BETWEEN -100 AND -50 AND lat BETWEEN 20 AND 40)", "(lon BETWEEN 20 AND 60 AND lat BETWEEN 10 AND 50) OR (lon BETWEEN 100 AND 150 AND lat BETWEEN 10 AND 30)"]


@query(f"SELECT matches, count(*) AS n FROM (SELECT {' + '.join(f'CASE WHEN {c} THEN 1 ELSE 0 END' for c in _CONDS)} AS matches FROM (SELECT DISTINCT p, lat, lon FROM ({B.B_SQL}))) GROUP BY 1")
def region_ambiguity(spark, sf_dir):
    """How many points lie in no, one or several regions."""
    regions = spark.createDataFrame(Q.REGIONS, "code string, shape array<array<array<array<double>>>>")
    points = B.visits_b(spark, sf_dir).select("p", "lat", "lon").distinct()
    hit = points.join(F.broadcast(regions), C.in_polygons(F.col("lon"), F.col("lat"), F.col("shape")), "left")
    return hit.groupBy("p", "lat", "lon").agg(F.count("code").alias("matches")).groupBy("matches").agg(F.count("*").alias("n"))


@query(f"WITH c AS (SELECT l2 AS city, count(*) AS n, count(DISTINCT p) AS places FROM ({B.B_SQL}) GROUP BY 1) SELECT (SELECT CAST(sum(n) AS BIGINT) FROM c) AS summed, (SELECT count(*) FROM ({B.B_SQL})) AS rows, (SELECT CAST(sum(n) AS BIGINT) FROM c) = (SELECT count(*) FROM ({B.B_SQL})) AS conserved")
def count_conservation(spark, sf_dir):
    """The rows of all cities add up to all rows."""
    v = B.visits_b(spark, sf_dir)
    per = v.groupBy(F.col("l2").alias("city")).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("summed")).crossJoin(F.broadcast(v.agg(F.count("*").alias("rows")))).withColumn("conserved", F.col("summed") == F.col("rows"))


@query("SELECT o_orderpriority AS stage, count(*) AS n FROM orders GROUP BY 1")
def stage_runner(spark, sf_dir):
    """Two runs of a stage: the second finds the first one's output and report."""
    folder = sinks.Stage(spark, "runner").path
    runner, path = sinks.Runner(spark, folder, log=lambda _: None), f"{folder}/counts"

    def run():
        sinks.write_parquet(B.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("stage")).agg(F.count("*").alias("n")), path, 1)
        return {"kind": "counts"}

    first, second = (runner.stage("counts", [path], run) for _ in range(2))
    if first["skipped"] or not second["skipped"] or not checks.artifact_ready(spark, folder, ["counts"], "counts.json"):
        raise RuntimeError("the second run did not find the first")
    return spark.read.parquet(path)

"""Operators of the reference's surface as queries over the driver's tables, with SQL where it can express them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import catalog, codes, graph, ranking, trajectory
from . import bind as B

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _time(c="t"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


TIME = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def _visible(sql: str, end: str) -> str:
    return f"v AS ({sql}), vis AS (SELECT * FROM v WHERE u IN (SELECT u FROM v WHERE t <= TIMESTAMP '{end}') AND p IN (SELECT p FROM v WHERE t <= TIMESTAMP '{end}'))"


def _states(sql: str, end: str) -> str:
    dedup = f"SELECT DISTINCT u, p, t FROM ({sql})"
    return _visible(dedup, end) + ", lagged AS (SELECT *, lag(p) OVER (PARTITION BY u ORDER BY t, p) AS b FROM vis), st AS (SELECT u, p, t FROM lagged WHERE b IS NULL OR b <> p)"


A_STATES, B_STATES = _states(B.A_SQL, B.A_TRAIN), _states(B.B_SQL, B.B_TRAIN)


def states_a(spark, sf_dir):
    return trajectory.collapsed(trajectory.train_visible(trajectory.deduplicated(B.visits_a(spark, sf_dir)), B.A_TRAIN))


def states_b(spark, sf_dir):
    return trajectory.collapsed(trajectory.train_visible(trajectory.deduplicated(B.visits_b(spark, sf_dir).select("u", "p", "t")), B.B_TRAIN))


# --- cleaning -----------------------------------------------------------------------------------

_CLEAN = "nullif(regexp_replace({}, '^\\s+|\\s+$', '', 'g'), '')"
_LEVELS = "list_transform(string_split(list_filter(string_split(new_key_type, '|'), lambda x: trim(x) <> '')[1], ';'), lambda x: trim(x))"


@query(f"""SELECT event_id, {_CLEAN.format('user_id')} AS u, {_CLEAN.format('poiid')} AS p, try_cast(latitude AS DOUBLE) AS lat, {_LEVELS}[1] AS l1, {_LEVELS}[3] AS l2
 FROM ({B.R_SQL}) WHERE {_CLEAN.format('user_id')} IS NOT NULL AND {_CLEAN.format('poiid')} IS NOT NULL AND try_cast(latitude AS DOUBLE) BETWEEN -90 AND 90
 AND try_cast(longitude AS DOUBLE) BETWEEN -180 AND 180 AND len({_LEVELS}) = 3 AND len(list_filter({_LEVELS}, lambda x: x = '')) = 0""")
def normalize_events(spark, sf_dir):
    raw = B.raw_events(spark, sf_dir).select("event_id", C.clean(F.col("user_id")).alias("u"), C.clean(F.col("poiid")).alias("p"), F.col("latitude").try_cast("double").alias("lat"), F.col("longitude").try_cast("double").alias("lon"), C.category_levels(F.col("new_key_type")).alias("levels"))
    kept = raw.where("u is not null and p is not null").where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)).where(C.full_path(F.col("levels")))
    return kept.select("event_id", "u", "p", "lat", F.get("levels", F.lit(0)).alias("l1"), F.get("levels", F.lit(2)).alias("l2"))


@query(f"""SELECT CASE WHEN {_CLEAN.format('user_id')} IS NULL THEN 'user' WHEN NOT coalesce(try_cast(latitude AS DOUBLE) BETWEEN -90 AND 90, false) THEN 'latitude'
 WHEN NOT coalesce(try_cast(longitude AS DOUBLE) BETWEEN -180 AND 180, false) THEN 'longitude' WHEN log_time = 'junk' THEN 'time' ELSE 'kept' END AS reason, count(*) AS n FROM ({B.R_SQL}) GROUP BY 1""")
def skip_reasons(spark, sf_dir):
    ok = lambda c, m: F.coalesce(F.col(c).try_cast("double").between(-m, m), F.lit(False))
    reason = F.when(C.clean(F.col("user_id")).isNull(), "user").when(~ok("latitude", 90), "latitude").when(~ok("longitude", 180), "longitude").when(C.utc_time(F.col("log_time")).isNull(), "time").otherwise("kept")
    return B.raw_events(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


_DAY = "strftime(date_trunc('second', ts){}, '%Y-%m-%d %H:%M:%S')"


@query(f"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN {_DAY.format(' - INTERVAL 480 MINUTE')} WHEN 1 THEN {_DAY.format('')} WHEN 2 THEN {_DAY.format(' - INTERVAL 480 MINUTE')}
 WHEN 3 THEN {_DAY.format(' + INTERVAL 210 MINUTE')} END AS utc FROM events""")
def parse_time_zone(spark, sf_dir):
    return B.raw_events(spark, sf_dir).select("event_id", F.date_format(C.utc_time(F.col("log_time")), "yyyy-MM-dd HH:mm:ss").alias("utc"))


# --- trajectories -------------------------------------------------------------------------------


@query(f"SELECT count(*) AS n, count(DISTINCT u) AS users, count(DISTINCT p) AS places FROM (SELECT DISTINCT u, p, t FROM ({B.B_SQL}))")
def dedup_events(spark, sf_dir):
    d = trajectory.deduplicated(B.visits_b(spark, sf_dir).select("u", "p", "t"))
    return d.agg(F.count("*").alias("n"), F.count_distinct("u").alias("users"), F.count_distinct("p").alias("places"))


@query(f"WITH {_visible(B.A_SQL, B.A_TRAIN)} SELECT u, p, {TIME.format('t')} AS t FROM vis")
def train_visible_events(spark, sf_dir):
    return trajectory.train_visible(B.visits_a(spark, sf_dir), B.A_TRAIN).select("u", "p", _time().alias("t"))


@query(f"WITH {B_STATES} SELECT u, p, {TIME.format('t')} AS t FROM st")
def collapse_states(spark, sf_dir):
    return states_b(spark, sf_dir).select("u", "p", _time().alias("t"))


_ROLL = "roll AS (SELECT u, p, t, row_number() OVER w AS place, string_agg(p, '|') OVER (PARTITION BY u ORDER BY t, p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS seq FROM st WINDOW w AS (PARTITION BY u ORDER BY t, p))"


@query(f"WITH {A_STATES}, {_ROLL} SELECT u, place, seq, {TIME.format('t')} AS t FROM roll WHERE place > 1")
def rolling_sequences(spark, sf_dir):
    return trajectory.rolling(states_a(spark, sf_dir)).select("u", F.col("place").cast("long").alias("place"), F.array_join("seq", "|").alias("seq"), _time().alias("t"))


def _case(train, valid):
    return f"CASE WHEN t <= TIMESTAMP '{train}' THEN 'train' WHEN t <= TIMESTAMP '{valid}' THEN 'val' ELSE 'test' END"


@query(f"WITH {A_STATES}, {_ROLL} SELECT {_case(B.A_TRAIN, B.A_VALID)} AS split, count(*) AS n, count(DISTINCT u) AS users FROM roll WHERE place > 1 GROUP BY 1")
def split_counts(spark, sf_dir):
    s = trajectory.rolling(states_a(spark, sf_dir)).withColumn("split", trajectory.split_of(B.A_TRAIN, B.A_VALID))
    return s.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("u").alias("users"))


@query(f"WITH {B_STATES}, {_ROLL}, k AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY t DESC, p DESC) AS r FROM roll WHERE place > 1 AND t <= TIMESTAMP '{B.B_TRAIN}') SELECT u, place, seq FROM k WHERE r <= 5")
def last_k_train(spark, sf_dir):
    s = trajectory.rolling(states_b(spark, sf_dir)).where(F.col("t") <= trajectory.bound(B.B_TRAIN))
    return trajectory.last_k(s).select("u", F.col("place").cast("long").alias("place"), F.array_join("seq", "|").alias("seq"))


@query(f"""WITH {A_STATES}, {_ROLL} SELECT u, place, sha256('{{"u":"' || u || '","target":"' || strftime(t, '%Y-%m-%dT%H:%M:%SZ') || '","seq":["' || replace(seq, '|', '","') || '"]}}') AS sample_id FROM roll WHERE place > 1""")
def sample_id_hash(spark, sf_dir):
    s = trajectory.rolling(states_a(spark, sf_dir))
    body = F.to_json(F.struct("u", F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("target"), "seq"))
    return s.select("u", F.col("place").cast("long").alias("place"), F.sha2(body, 256).alias("sample_id"))


@query(f"SELECT u, row_number() OVER (ORDER BY u) - 1 AS id FROM (SELECT DISTINCT u FROM ({B.B_SQL}))")
def dense_user_ids(spark, sf_dir):
    return trajectory.dense_ids(B.visits_b(spark, sf_dir), "u", "id")


# --- catalog ------------------------------------------------------------------------------------


@query(f"SELECT p, l1, l2 FROM (SELECT p, l1, l2, row_number() OVER (PARTITION BY p ORDER BY count(*) DESC, l1, l2) AS r FROM ({B.B_SQL}) GROUP BY p, l1, l2) WHERE r = 1")
def poi_category_mode(spark, sf_dir):
    return catalog.modal(B.visits_b(spark, sf_dir), "p", ["l1", "l2"])


@query(f"SELECT p, round(median(lat), 6) AS lat, round(median(lon), 6) AS lon FROM ({B.B_SQL}) GROUP BY p")
def poi_median_exact(spark, sf_dir):
    return catalog.medians(B.visits_b(spark, sf_dir), "p", ["lat", "lon"]).select("p", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(f"SELECT p, quantile_disc(lat, 0.5) AS lat, quantile_disc(lon, 0.5) AS lon FROM ({B.B_SQL}) GROUP BY p")
def poi_median_disc(spark, sf_dir):
    return catalog.medians(B.visits_b(spark, sf_dir), "p", ["lat", "lon"], exact=False)


@query("SELECT p_brand AS l2, count(DISTINCT p_type) AS parents FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def l2_parent_conflicts(spark, sf_dir):
    return catalog.conflicting_parents(B.table(spark, sf_dir, "part"), "p_brand", "p_type").withColumnRenamed("p_brand", "l2")


_CATALOG = f"""cat AS (SELECT p, l1, l2 FROM (SELECT p, l1, l2, row_number() OVER (PARTITION BY p ORDER BY count(*) DESC, l1, l2) AS r FROM ({B.B_SQL}) WHERE p IN (SELECT p FROM ({B.B_SQL}) WHERE t <= TIMESTAMP '{B.B_TRAIN}') GROUP BY p, l1, l2) WHERE r = 1),
 med AS (SELECT p, median(lat) AS lat, median(lon) AS lon FROM ({B.B_SQL}) GROUP BY p),
 ids AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS pid FROM cat), l1s AS (SELECT l1, row_number() OVER (ORDER BY l1) - 1 AS l1_label FROM (SELECT DISTINCT l1 FROM cat)), l2s AS (SELECT l2, row_number() OVER (ORDER BY l2) - 1 AS l2_label FROM (SELECT DISTINCT l2 FROM cat)),
 full_cat AS (SELECT p, pid, lat, lon, l1, l2, l1_label, l2_label FROM cat JOIN med USING (p) JOIN ids USING (p) JOIN l1s USING (l1) JOIN l2s USING (l2))"""


def catalog_b(spark, sf_dir):
    visits = B.visits_b(spark, sf_dir)
    found = catalog.catalog(visits, visits.where(F.col("t") <= trajectory.bound(B.B_TRAIN)).select("p").distinct())
    found = _saver(spark)(found, "catalog")  # numbered three times, joined once
    for key, name in (("p", "pid"), ("l1", "l1_label"), ("l2", "l2_label")):
        found = found.join(trajectory.dense_ids(found, key, name), key)
    return found


@query(f"WITH {_CATALOG} SELECT pid, p, l1, l2, l1_label, l2_label, round(lat, 6) AS lat, round(lon, 6) AS lon FROM full_cat")
def catalog_join(spark, sf_dir):
    return catalog_b(spark, sf_dir).select("pid", "p", "l1", "l2", "l1_label", "l2_label", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(f"WITH {B_STATES}, uid AS (SELECT u, row_number() OVER (ORDER BY u) - 1 AS user_id FROM (SELECT DISTINCT u FROM st)), pid AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS pid FROM (SELECT DISTINCT p FROM st)) SELECT user_id, pid, {TIME.format('t')} AS t FROM st JOIN uid USING (u) JOIN pid USING (p)")
def indexed_states(spark, sf_dir):
    s = _saver(spark)(states_b(spark, sf_dir), "states")
    return s.join(trajectory.dense_ids(s, "u", "user_id"), "u").join(trajectory.dense_ids(s, "p", "pid"), "p").select("user_id", "pid", _time().alias("t"))


_LOOKUP = [("view", "browse"), ("click", "browse"), ("purchase", "buy")]


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'browse' WHEN 'click' THEN 'browse' WHEN 'purchase' THEN 'buy' ELSE 'Other' END AS category FROM events")
def category_lookup_default(spark, sf_dir):
    lookup = spark.createDataFrame(_LOOKUP, "event_type string, category string")
    return B.table(spark, sf_dir, "events").join(F.broadcast(lookup), "event_type", "left").select("event_id", F.coalesce("category", F.lit("Other")).alias("category"))


# --- features -----------------------------------------------------------------------------------


@query("SELECT event_type AS p, hour(ts + INTERVAL 480 MINUTE) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def local_hour_hist(spark, sf_dir):
    return B.visits_a(spark, sf_dir).groupBy("p", F.hour(F.col("t") + F.expr("INTERVAL 480 MINUTES")).cast("long").alias("hour")).agg(F.count("*").alias("n"))


@query("WITH h AS (SELECT event_type AS p, hour(ts) AS h, count(*) AS n FROM events GROUP BY 1, 2), w AS (SELECT p, h, n / sum(n) OVER (PARTITION BY p) AS w FROM h) SELECT p, f, round(sum(w * sin(2 * pi() * f * h / 24)), 6) AS s, round(sum(w * cos(2 * pi() * f * h / 24)), 6) AS c FROM w, range(1, 7) r(f) GROUP BY p, f")
def temporal_fourier(spark, sf_dir):
    h = B.visits_a(spark, sf_dir).groupBy("p", F.hour("t").alias("h")).agg(F.count("*").alias("n"))
    w = h.withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy("p"))).withColumn("f", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(6).cast("long"))))
    angle = 2 * F.pi() * F.col("f") * F.col("h") / 24
    return w.groupBy("p", "f").agg(F.round(F.sum(F.col("w") * F.sin(angle)), 6).alias("s"), F.round(F.sum(F.col("w") * F.cos(angle)), 6).alias("c"))


@query(f"SELECT p, round(cos(radians(lat)) * cos(radians(lon)), 6) AS x, round(cos(radians(lat)) * sin(radians(lon)), 6) AS y, round(sin(radians(lat)), 6) AS z FROM (SELECT DISTINCT p, lat, lon FROM ({B.B_SQL}))")
def spherical_xyz(spark, sf_dir):
    d = B.visits_b(spark, sf_dir).select("p", "lat", "lon").distinct()
    return d.select("p", *[F.round(c, 6).alias(n) for c, n in zip(C.spherical(F.col("lat"), F.col("lon")), "xyz")])


@query(f"WITH m AS (SELECT p, median(lat) AS lat FROM ({B.B_SQL}) GROUP BY p) SELECT p, round((lat - (SELECT avg(lat) FROM m)) / ((SELECT stddev_pop(lat) FROM m) + 1e-12), 6) AS z, round(sin(2 * pi() * 4 * (lat - (SELECT avg(lat) FROM m)) / ((SELECT stddev_pop(lat) FROM m) + 1e-12)), 5) AS s4 FROM m")
def coord_zscore_fourier(spark, sf_dir):
    m = catalog.medians(B.visits_b(spark, sf_dir), "p", ["lat"])
    z = m.crossJoin(F.broadcast(m.agg(F.avg("lat").alias("a"), F.stddev_pop("lat").alias("s")))).withColumn("z", (F.col("lat") - F.col("a")) / (F.col("s") + 1e-12))
    return z.select("p", F.round("z", 6).alias("z"), F.round(F.sin(2 * F.pi() * 4 * F.col("z")), 5).alias("s4"))


# --- codes --------------------------------------------------------------------------------------

_GRID = f"WITH {_CATALOG}, grid AS (SELECT *, CAST(floor((lat + 90) / 30) AS BIGINT) AS a, CAST(floor((lat + 90) / 30) AS BIGINT) * 12 + CAST(floor((lon + 180) / 30) AS BIGINT) AS b FROM full_cat), code AS (SELECT *, row_number() OVER (PARTITION BY a, b, l1_label, l2_label ORDER BY pid) - 1 AS e FROM grid)"


def coded(spark, sf_dir):
    a = F.floor((F.col("lat") + 90) / 30)
    grid = catalog_b(spark, sf_dir).withColumn("a", a).withColumn("b", a * 12 + F.floor((F.col("lon") + 180) / 30))
    return codes.leaves(grid, ["a", "b", "l1_label", "l2_label"], "pid")


@query(_GRID + " SELECT pid, '<a_' || a || '><b_' || b || '><c_' || l1_label || '><d_' || l2_label || '><e_' || e || '>' AS sid FROM code")
def sid_tokens(spark, sf_dir):
    return coded(spark, sf_dir).select("pid", C.sid_tokens(F.array("a", "b", "l1_label", "l2_label", "e")).alias("sid"))


@query("SELECT conv_id, turn, '<a_' || conv_id || '><b_' || turn || '>' AS canonical, conv_id + turn AS total FROM conversations")
def sid_canonical_parse(spark, sf_dir):
    noisy = F.concat(F.lit("x <a_"), "conv_id", F.lit("> and <b_"), "turn", F.lit("> <C_1> <d_x>"))
    t = B.table(spark, sf_dir, "conversations").select("conv_id", "turn", C.sid_canonical(noisy).alias("canonical"))
    levels = C.sid_levels(F.col("canonical"))
    return t.select("conv_id", "turn", "canonical", (F.get(levels, F.lit(0)) + F.get(levels, F.lit(1))).cast("long").alias("total"))


@query(_GRID + ", c AS (SELECT pid, a, count(*) OVER (PARTITION BY a) AS n, row_number() OVER (PARTITION BY a ORDER BY pid) - 1 AS r FROM code) SELECT pid, CASE WHEN n > 1 THEN a || ',' || r ELSE CAST(a AS VARCHAR) END AS code FROM c")
def collision_leaf(spark, sf_dir):
    c = coded(spark, sf_dir).select("pid", F.array(F.col("a").cast("int")).alias("code"))
    return codes.collision_leaves(c).select("pid", F.array_join(F.transform("code", lambda x: x.cast("string")), ",").alias("code"))


@query(_GRID + """, g AS (SELECT 5 - (GROUPING(a) + GROUPING(b) + GROUPING(l1_label) + GROUPING(l2_label) + GROUPING(e)) AS depth, count(*) AS size FROM code GROUP BY GROUPING SETS ((a), (a, b), (a, b, l1_label), (a, b, l1_label, l2_label), (a, b, l1_label, l2_label, e)))
 SELECT CAST(depth AS BIGINT) AS depth, count(*) AS buckets, round(avg(size), 6) AS mean_size, round(median(size), 6) AS median_size, round(quantile_cont(size, 0.9), 6) AS p90_size, max(size) AS max_size, CAST(sum(CASE WHEN size = 1 THEN 1 ELSE 0 END) AS BIGINT) AS singletons, CAST(sum(CASE WHEN size > 1 THEN size ELSE 0 END) AS BIGINT) AS colliding FROM g GROUP BY depth""")
def prefix_bucket_stats(spark, sf_dir):
    s = codes.prefix_stats(coded(spark, sf_dir), ["a", "b", "l1_label", "l2_label", "e"])
    return s.withColumn("depth", F.col("depth").cast("long")).withColumns({c: F.round(c, 6) for c in ("mean_size", "median_size", "p90_size")})


@query(_GRID + " SELECT a, b, count(*) AS size, min(pid) AS first FROM code GROUP BY a, b ORDER BY size DESC, first LIMIT 20")
def top_prefix_buckets(spark, sf_dir):
    return coded(spark, sf_dir).groupBy("a", "b").agg(F.count("*").alias("size"), F.min("pid").alias("first")).orderBy(F.desc("size"), "first").limit(20)


@query(_GRID + ", p AS (SELECT a, b, count(*) AS n FROM code GROUP BY a, b) SELECT count(*) AS paths, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS colliding_paths, max(n) AS max_group, round(1 - count(*) / sum(n), 6) AS rate FROM p")
def collision_report(spark, sf_dir):
    p = coded(spark, sf_dir).groupBy("a", "b").agg(F.count("*").alias("n"))
    return p.agg(F.count("*").alias("paths"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("colliding_paths"), F.max("n").alias("max_group"), F.round(1 - F.count("*") / F.sum("n"), 6).alias("rate"))


@query(_GRID + ", c AS (SELECT a AS g, count(*) AS n FROM code GROUP BY a), s AS (SELECT g, n, sqrt(n) / sum(sqrt(n)) OVER () * 64 AS share FROM c), b AS (SELECT *, greatest(floor(share), 1) AS base, row_number() OVER (ORDER BY share - floor(share) DESC, g) AS r FROM s) SELECT g, n, CAST(base + CASE WHEN r <= 64 - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM b")
def sqrt_allocation(spark, sf_dir):
    return codes.sqrt_allocation(coded(spark, sf_dir).groupBy(F.col("a").alias("g")).agg(F.count("*").alias("n")), 64)


# --- records ------------------------------------------------------------------------------------


@query(f"WITH {A_STATES}, h AS (SELECT u, t, row_number() OVER w AS place, string_agg(strftime(t + INTERVAL 480 MINUTE, '%Y-%m-%d %H:%M:%S') || ' visited <' || p || '>', ', ') OVER (PARTITION BY u ORDER BY t, p ROWS BETWEEN 49 PRECEDING AND 1 PRECEDING) AS h, '<' || p || '>' AS output FROM st WINDOW w AS (PARTITION BY u ORDER BY t, p)) SELECT 'User_' || u || ' checkin history: ' || h || '.' || chr(10) || 'When ' || strftime(t + INTERVAL 480 MINUTE, '%Y-%m-%d %H:%M:%S') || ' user_' || u || ' is likely to visit:' AS input, output FROM h WHERE place > 1")
def sft_records(spark, sf_dir):
    s = trajectory.rolling(states_a(spark, sf_dir))
    local = lambda t: F.date_format(t + F.expr("INTERVAL 480 MINUTES"), "yyyy-MM-dd HH:mm:ss")
    visit = F.zip_with(F.slice("times", 1, F.size("times") - 1), F.slice("seq", 1, F.size("seq") - 1), lambda t, p: F.concat(local(t), F.lit(" visited <"), p, F.lit(">")))
    text = F.concat(F.lit("User_"), "u", F.lit(" checkin history: "), F.array_join(visit, ", "), F.lit(".\nWhen "), local(F.col("t")), F.lit(" user_"), "u", F.lit(" is likely to visit:"))
    return s.select(text.alias("input"), F.concat(F.lit("<"), "p", F.lit(">")).alias("output"))


@query(f"WITH {_CATALOG} SELECT template, count(*) AS n, sum(length(text)) AS chars FROM (SELECT 'category' AS template, 'Place ' || pid || ' is a ' || l2 || ' in ' || l1 AS text FROM full_cat UNION ALL SELECT 'label', 'Place ' || pid || ' has labels ' || l1_label || ' and ' || l2_label FROM full_cat) GROUP BY template")
def cpt_corpus(spark, sf_dir):
    c = catalog_b(spark, sf_dir)
    text = lambda *parts: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in parts])
    rows = F.array(
        F.struct(F.lit("category").alias("template"), text("Place ", F.col("pid"), " is a ", F.col("l2"), " in ", F.col("l1")).alias("text")),
        F.struct(F.lit("label").alias("template"), text("Place ", F.col("pid"), " has labels ", F.col("l1_label"), " and ", F.col("l2_label")).alias("text")),
    )
    return c.select(F.inline(rows)).groupBy("template").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def _cpt(spark, sf_dir):
    """Rows and report of the four templates over the places, their SIDs and the train sequences."""
    from ..operators import corpus

    save = _saver(spark)
    places = save(coded(spark, sf_dir).select(F.col("p").alias("pid"), "lat", "lon", "l1", "l2", C.sid_tokens(F.array("a", "b", "l1_label", "l2_label", "e")).alias("sid")), "places")
    train = trajectory.rolling(states_b(spark, sf_dir).where(F.col("t") <= trajectory.bound(B.B_TRAIN)))
    local = lambda t: F.date_format(t + F.expr("INTERVAL 480 MINUTES"), "yyyy-MM-dd HH:mm:ss")
    return corpus.cpt_corpus(places.drop("sid"), places.select("pid", "sid"), train.select("seq", F.transform("times", local).alias("times")), save)


@query()
def cpt_records(spark, sf_dir):
    return _cpt(spark, sf_dir)[0]


@query()
def cpt_report(spark, sf_dir):
    return _cpt(spark, sf_dir)[1]


@query("SELECT count(*) AS missing FROM (SELECT DISTINCT l_suppkey FROM lineitem) WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 <> 0)")
def missing_pid_check(spark, sf_dir):
    book = B.table(spark, sf_dir, "supplier").where("s_suppkey % 10 != 0")
    return B.table(spark, sf_dir, "lineitem").select("l_suppkey").distinct().join(book, F.col("l_suppkey") == F.col("s_suppkey"), "left_anti").agg(F.count("*").alias("missing"))


# --- ranking ------------------------------------------------------------------------------------

_SAMPLES = f"{B_STATES}, nums AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS pid FROM (SELECT DISTINCT p FROM st)), s0 AS (SELECT u, p, t, row_number() OVER (PARTITION BY u ORDER BY t, p) AS place FROM st), s AS (SELECT u, pid AS gold, p, row_number() OVER (ORDER BY u, t, s0.p) - 1 AS i FROM s0 JOIN nums USING (p) WHERE place > 1 AND t > TIMESTAMP '{B.B_VALID}'), n AS (SELECT count(*) AS n FROM nums)"


def _ranks(k: str, name: str) -> str:
    pred = f"CASE WHEN j = 3 THEN CASE WHEN {k} = 2 THEN gold ELSE (gold + 21) % n END WHEN j = 8 THEN -1 WHEN j = {k} THEN gold ELSE (gold + 7 * (j + 1)) % n END"
    return f"{name}_p AS (SELECT i, gold, j, {pred} AS x FROM s, n, range(12) r(j)), {name}_d AS (SELECT i, gold, x, row_number() OVER (PARTITION BY i ORDER BY min(j)) AS r FROM {name}_p WHERE x >= 0 GROUP BY i, gold, x), {name} AS (SELECT s.i, s.u, s.gold, s.p, coalesce(r, 0) AS rank FROM s LEFT JOIN {name}_d d ON s.i = d.i AND d.x = s.gold AND d.r <= 10)"


_RANKS = f"WITH {_SAMPLES}, {_ranks('i % 13', 'x')}, {_ranks('(i * 5) % 13', 'y')}"


def samples_b(spark, sf_dir):
    """Test samples in order with a dense sample index, gold id and the number of places."""
    save = _saver(spark)
    s = save(states_b(spark, sf_dir), "states")
    ids = trajectory.dense_ids(s, "p", "gold")
    found = trajectory.rolling(s).where(F.col("t") > trajectory.bound(B.B_VALID)).select("u", "p", "t").withColumn("key", F.concat_ws("\u0001", "u", F.date_format("t", "yyyyMMddHHmmss"), "p"))
    found = save(found, "samples")
    order = trajectory.dense_ids(found, "key", "i")
    return found.join(order, "key").join(ids, "p").crossJoin(F.broadcast(ids.agg(F.count("*").alias("n"))))  # one row


def with_ranks(spark, sf_dir):
    s = samples_b(spark, sf_dir)
    for name, k in (("x", F.col("i") % 13), ("y", (F.col("i") * 5) % 13)):
        at = lambda j, k=k: F.lit(-1).cast("long") if j == 8 else F.when(k == 2, F.col("gold")).otherwise((F.col("gold") + 21) % F.col("n")) if j == 3 else F.when(k == j, F.col("gold")).otherwise((F.col("gold") + 7 * (j + 1)) % F.col("n"))
        s = s.withColumn(f"rank_{name}", ranking.ranked(F.array(*[at(j) for j in range(12)]), F.col("gold"), lambda v: v >= 0))
    return s


@query(_RANKS + " SELECT i, gold, rank FROM x")
def rank_of_gold(spark, sf_dir):
    return with_ranks(spark, sf_dir).select("i", "gold", F.col("rank_x").alias("rank"))


_HITS = ", ".join(f"round(avg(CASE WHEN rank BETWEEN 1 AND {k} THEN 1.0 ELSE 0 END), 9) AS r{k}" for k in (1, 5, 10)) + ", round(avg(CASE WHEN rank BETWEEN 1 AND 10 THEN 1 / log2(rank + 1) ELSE 0 END), 9) AS ndcg10"


@query(_RANKS + f" SELECT 'x' AS method, count(*) AS n, {_HITS} FROM x UNION ALL SELECT 'y', count(*), {_HITS} FROM y")
def ranking_metrics(spark, sf_dir):
    s = with_ranks(spark, sf_dir)
    rows = s.select(F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"rank_{m}").alias("rank")) for m in "xy"])))
    return rows.groupBy("method").agg(*ranking.metrics()).withColumns({c: F.round(c, 9) for c in ("r1", "r5", "r10", "ndcg10")})


@query(f"WITH {_SAMPLES} SELECT i % 7 AS shard, count(*) AS n, min(i) AS first, max(i) AS last FROM s GROUP BY 1")
def shard_roundrobin(spark, sf_dir):
    return ranking.shards(samples_b(spark, sf_dir), 7, "i").groupBy("shard").agg(F.count("*").alias("n"), F.min("i").alias("first"), F.max("i").alias("last"))


@query(f"WITH {_SAMPLES} SELECT CAST(sum(CASE WHEN i % 50 = 3 THEN 1 ELSE 0 END) AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, CAST(sum(CASE WHEN i % 50 = 4 THEN 1 ELSE 0 END) AS BIGINT) AS repeated FROM s")
def shard_merge_coverage(spark, sf_dir):
    s = samples_b(spark, sf_dir).select(F.col("i").alias("sample_index"))
    got = s.where("sample_index % 50 != 3")
    return ranking.coverage(s, got.union(s.where("sample_index % 50 = 4")))


_CITY = f"{_RANKS}, city AS (SELECT p, l2 AS city FROM (SELECT p, l2, row_number() OVER (PARTITION BY p ORDER BY count(*) DESC, l2) AS r FROM ({B.B_SQL}) GROUP BY p, l2) WHERE r = 1), j AS (SELECT city, x.u, x.gold, x.rank AS rx, y.rank AS ry FROM x JOIN y USING (i) JOIN city ON x.p = city.p)"


def _city_values(alias: str) -> str:
    out = ["count(*) AS n", "count(DISTINCT u) AS users", "count(DISTINCT gold) AS targets"]
    for m in "xy":
        out += [f"avg(CASE WHEN r{m} BETWEEN 1 AND {k} THEN 1.0 ELSE 0 END) AS {m}_r{k}" for k in (1, 5, 10)] + [f"avg(CASE WHEN r{m} BETWEEN 1 AND 10 THEN 1 / log2(r{m} + 1) ELSE 0 END) AS {m}_ndcg10"]
    return ", ".join(out)


_ROUND = ", ".join(f"round({c}, 9) AS {c}" for c in [f"{m}_{k}" for m in "xy" for k in ("r1", "r5", "r10", "ndcg10")]) + ", " + ", ".join(f"round(x_{k} - y_{k}, 9) AS delta_{k}, round(CASE WHEN y_{k} <> 0 THEN (x_{k} - y_{k}) / y_{k} * 100 END, 6) AS relative_{k}" for k in ("r1", "r5", "r10", "ndcg10"))


def city_rows(spark, sf_dir):
    city = catalog.modal(B.visits_b(spark, sf_dir), "p", ["l2"]).withColumnRenamed("l2", "city")
    cities = city.groupBy("city").agg(F.count("*").alias("places")).unionByName(spark.createDataFrame([("EMPTY", 1)], "city string, places long"))
    return with_ranks(spark, sf_dir).join(city, "p"), cities


@query(f"{_CITY}, c AS (SELECT city, count(*) AS places FROM city GROUP BY city UNION ALL SELECT 'EMPTY', 1), m AS (SELECT city, {_city_values('j')} FROM j GROUP BY city), a AS (SELECT c.city, c.places, coalesce(n, 0) AS n, m.* EXCLUDE (city, n) FROM c LEFT JOIN m ON c.city = m.city UNION ALL SELECT 'ALL', (SELECT CAST(sum(places) AS BIGINT) FROM c), {_city_values('j')} FROM j) SELECT city, places, n, users, targets, {_ROUND} FROM a")
def city_metrics(spark, sf_dir):
    rows, cities = city_rows(spark, sf_dir)
    out = ranking.by_city(rows, cities)
    nine = [c for c in out.columns if c[:2] in ("x_", "y_") or c.startswith("delta_")]
    six = [c for c in out.columns if c.startswith("relative_")]
    return out.withColumns({c: F.round(c, 9) for c in nine} | {c: F.round(c, 6) for c in six})


@query(f"{_CITY}, w AS (SELECT city, count(*) AS n FROM j GROUP BY city) SELECT city, round(100.0 * n / sum(n) OVER (), 6) AS share FROM w")
def city_share(spark, sf_dir):
    rows, _ = city_rows(spark, sf_dir)
    return rows.groupBy("city").agg(F.count("*").alias("n")).select("city", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


_WEIGHT = " + ".join(f"CASE WHEN v >= CAST({x!r} AS DOUBLE) THEN 1 ELSE 0 END" for x in ranking._AT_MOST)
_ENDS = ("low", "high", "relative_low", "relative_high")


@query(f"""{_CITY}, pu AS (SELECT city, u, count(*) AS n, CAST(sum(CASE WHEN rx BETWEEN 1 AND 5 THEN 1 ELSE 0 END) AS DOUBLE) AS x, CAST(sum(CASE WHEN ry BETWEEN 1 AND 5 THEN 1 ELSE 0 END) AS DOUBLE) AS y FROM j GROUP BY city, u),
 dr AS (SELECT *, CAST(('0x' || substr(md5('42:' || u || ':' || b), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS v FROM pu, range(2000) r(b)), ws AS (SELECT *, {_WEIGHT} AS w FROM dr), su AS (SELECT city, b, sum(w * n) AS n, sum(w * x) AS x, sum(w * y) AS y FROM ws WHERE w > 0 GROUP BY city, b),
 ci AS (SELECT city, quantile_cont((x - y) / n, 0.025) AS low, quantile_cont((x - y) / n, 0.975) AS high, quantile_cont(CASE WHEN y <> 0 THEN (x - y) / y * 100 END, 0.025) AS relative_low, quantile_cont(CASE WHEN y <> 0 THEN (x - y) / y * 100 END, 0.975) AS relative_high FROM su GROUP BY city)
 SELECT pt.city, round(d, 6) AS diff, {", ".join(f"round({c}, 6) AS {c}" for c in _ENDS)} FROM (SELECT city, (sum(x) - sum(y)) / sum(n) AS d FROM pu GROUP BY city) pt LEFT JOIN ci ON pt.city = ci.city""")
def city_bootstrap_ci(spark, sf_dir):
    rows, _ = city_rows(spark, sf_dir)
    hit = lambda c: F.sum(F.when(F.col(c).between(1, 5), 1.0).otherwise(0.0))
    found = ranking.bootstrap(rows.groupBy("city", "u").agg(F.count("*").alias("n"), hit("rank_x").alias("x"), hit("rank_y").alias("y")))
    return found.withColumns({c: F.round(c, 6) for c in ("diff", *_ENDS)})


@query("WITH a AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events), b AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events WHERE event_id % 10 <> 0) SELECT count(*) AS n, count(a.event_id) AS l, count(b.event_id) AS r, count(a.event_id) - count(b.event_id) AS unmatched FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.k = b.k")
def multiset_align(spark, sf_dir):
    e = B.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    left, right = e.withColumn("l", F.col("event_id")), e.where("event_id % 10 != 0").withColumn("r", F.col("event_id"))
    m = ranking.aligned(left, right.drop("event_id").withColumn("event_id", F.col("r")), ["user_id", "event_type"], "event_id")
    return m.agg(F.count("*").alias("n"), F.count("l").alias("l"), F.count("r").alias("r"), (F.count("l") - F.count("r")).alias("unmatched"))


# --- geography ----------------------------------------------------------------------------------

#: Synthetic regions on the latitude/longitude plane: two that share an edge, one with a hole, one of two parts.
REGIONS = [
    ("01", [[[[-180.0, -60.0], [0.0, -60.0], [0.0, 0.0], [-180.0, 0.0], [-180.0, -60.0]]]]),
    ("02", [[[[0.0, -60.0], [180.0, -60.0], [180.0, 0.0], [0.0, 0.0], [0.0, -60.0]]]]),
    ("03", [[[[-180.0, 10.0], [0.0, 10.0], [0.0, 60.0], [-180.0, 60.0], [-180.0, 10.0]], [[-100.0, 20.0], [-50.0, 20.0], [-50.0, 40.0], [-100.0, 40.0], [-100.0, 20.0]]]]),
    ("04", [[[[20.0, 10.0], [60.0, 10.0], [60.0, 50.0], [20.0, 50.0], [20.0, 10.0]]], [[[100.0, 10.0], [150.0, 10.0], [150.0, 30.0], [100.0, 30.0], [100.0, 10.0]]]]),
]


@query(f"""SELECT p, lat, lon, CASE WHEN lat BETWEEN -60 AND 0 AND lon <= 0 THEN '01' WHEN lat BETWEEN -60 AND 0 THEN '02' WHEN lat BETWEEN 10 AND 60 AND lon <= 0 AND NOT (lon BETWEEN -100 AND -50 AND lat BETWEEN 20 AND 40) THEN '03'
 WHEN (lon BETWEEN 20 AND 60 AND lat BETWEEN 10 AND 50) OR (lon BETWEEN 100 AND 150 AND lat BETWEEN 10 AND 30) THEN '04' ELSE 'UNMATCHED' END AS city FROM (SELECT DISTINCT p, lat, lon FROM ({B.B_SQL}))""")
def city_assign(spark, sf_dir):
    """Points to regions: an equi-join on 10-degree cells of each region's box, then the exact test; smallest code wins."""
    regions = spark.createDataFrame(REGIONS, "code string, shape array<array<array<array<double>>>>")
    at = F.flatten(F.flatten("shape"))
    cell = lambda c: F.floor(c / 10)
    x, y = F.transform(at, lambda q: q[0]), F.transform(at, lambda q: q[1])
    ends = {"lo0": F.array_min(x), "hi0": F.array_max(x), "lo1": F.array_min(y), "hi1": F.array_max(y)}
    boxes = regions.withColumns(ends).withColumn("cx", F.explode(F.sequence(cell(F.col("lo0")), cell(F.col("hi0"))))).withColumn("cy", F.explode(F.sequence(cell(F.col("lo1")), cell(F.col("hi1")))))
    points = B.visits_b(spark, sf_dir).select("p", "lat", "lon").distinct()
    on = (cell(points.lon) == boxes.cx) & (cell(points.lat) == boxes.cy) & C.in_polygons(points.lon, points.lat, boxes["shape"])
    return points.join(boxes, on, "left").groupBy("p", "lat", "lon").agg(F.coalesce(F.min("code"), F.lit("UNMATCHED")).alias("city"))


@query(f"WITH q AS ({B.C_PLACES}) SELECT a.i AS l, b.i AS r, round(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2)))), 6) AS km FROM q a JOIN q b ON b.i = a.i + 1")
def haversine_pairs(spark, sf_dir):
    a, b = (B.covisit_places(spark, sf_dir).select(F.col("i").alias(n), F.col("lat").alias(f"y{n}"), F.col("lon").alias(f"x{n}")) for n in "lr")
    return a.join(b, F.col("r") == F.col("l") + 1).select("l", "r", F.round(C.haversine_km(F.col("yl"), F.col("xl"), F.col("yr"), F.col("xr")), 6).alias("km"))


def geohash_sql(lat: str, lon: str) -> str:
    """Seven letters of the interleaved cell numbers, as in functions.columns.geohash."""
    x, y = f"least(CAST(floor(({lon} + 180) / 360 * 262144) AS BIGINT), 262143)", f"least(CAST(floor(({lat} + 90) / 180 * 131072) AS BIGINT), 131071)"
    bit = lambda i: f"(({x} >> {17 - i // 2}) & 1)" if i % 2 == 0 else f"(({y} >> {16 - i // 2}) & 1)"
    letter = lambda k: "substr('" + C.GEOHASH + "', 1 + " + " + ".join(f"{bit(5 * k + j)} * {16 >> j}" for j in range(5)) + ", 1)"
    return " || ".join(letter(k) for k in range(7))


@query(f"SELECT lat, lon, {geohash_sql('lat', 'lon')} AS geohash FROM (SELECT DISTINCT lat, lon FROM ({B.B_SQL}))")
def geohash7(spark, sf_dir):
    return B.visits_b(spark, sf_dir).select("lat", "lon").distinct().select("lat", "lon", C.geohash(F.col("lat"), F.col("lon")).alias("geohash"))


# --- graph and assignment -----------------------------------------------------------------------


@query(f"WITH ui AS ({B.C_SQL}) SELECT a.i AS l, b.i AS r, count(*) AS users FROM ui a JOIN ui b ON a.u = b.u AND a.i < b.i GROUP BY 1, 2 HAVING count(*) >= 2")
def covisit_pairs(spark, sf_dir):
    return graph.covisits(B.covisit_items(spark, sf_dir))


_SWING = f"ui AS ({B.C_SQL}), q AS ({B.C_PLACES}), pr AS (SELECT a.i AS l, b.i AS r FROM ui a JOIN ui b ON a.u = b.u AND a.i < b.i GROUP BY 1, 2 HAVING count(*) >= 2), nr AS (SELECT l, r FROM pr JOIN q a ON a.i = l JOIN q b ON b.i = r WHERE 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2)))) <= 3), mem AS (SELECT l, r, a.u FROM nr JOIN ui a ON a.i = l JOIN ui b ON b.i = r AND a.u = b.u), up AS (SELECT x.l, x.r, x.u AS x, y.u AS y FROM mem x JOIN mem y ON x.l = y.l AND x.r = y.r AND x.u < y.u), ov AS (SELECT x, y, count(*) AS c FROM (SELECT DISTINCT x, y FROM up) JOIN ui a ON a.u = x JOIN ui b ON b.u = y AND a.i = b.i GROUP BY x, y)"


@query(f"WITH {_SWING} SELECT l, r, round(sum(1.0 / (1 + c)), 6) AS score FROM up JOIN ov USING (x, y) GROUP BY l, r")
def swing_scores(spark, sf_dir):
    return graph.swing(B.covisit_items(spark, sf_dir), B.covisit_places(spark, sf_dir)).select("l", "r", F.round("score", 6).alias("score"))


def _saver(spark):
    from ..sources.sinks import Stage

    return Stage(spark).save


@query()
def degree_capped_pairs(spark, sf_dir):
    # sums of the same terms in another order must tie, so that the distance decides
    places = B.covisit_places(spark, sf_dir)
    pairs = graph.swing(B.covisit_items(spark, sf_dir), places).select("l", "r", F.round("score", 9).alias("score"))
    return graph.degree_capped(graph.distances(pairs, places), 50, _saver(spark))


@query()
def stable_assignment(spark, sf_dir):
    made = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pid"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("rank"))
    code = F.pmod(F.xxhash64("pid", "rank"), F.lit(60))
    made = made.select("pid", code.alias("code"), (F.pmod(F.xxhash64("rank", "pid"), F.lit(1000)) / 10).alias("score"), "rank").groupBy("pid", "code").agg(F.max("score").alias("score"), F.min("rank").alias("rank"))
    return graph.stable_assignment(made, _saver(spark))


# --- labels -------------------------------------------------------------------------------------


@query("SELECT event_type AS label, row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS id, count(*) AS n FROM events GROUP BY 1")
def label_vocab(spark, sf_dir):
    n = B.visits_a(spark, sf_dir).groupBy(F.col("p").alias("label")).agg(F.count("*").alias("n"))
    return n.select("label", (F.row_number().over(Window.partitionBy().orderBy(F.desc("n"), "label")) - 1).cast("long").alias("id"), "n")


@query(f"SELECT l1, string_agg(l2, ',' ORDER BY n DESC, l2) AS children FROM (SELECT l1, l2, count(*) AS n FROM ({B.B_SQL}) GROUP BY 1, 2) GROUP BY l1")
def parent_child(spark, sf_dir):
    n = B.visits_b(spark, sf_dir).groupBy("l1", "l2").agg(F.count("*").alias("n"))
    return n.groupBy("l1").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "l2"))), lambda x: x["l2"]), ",").alias("children"))


_ENTROPY = "SELECT user_id AS u, event_type AS p, count(*) AS n FROM events GROUP BY 1, 2"


@query(f"WITH c AS ({_ENTROPY}), q AS (SELECT u, n / sum(n) OVER (PARTITION BY u) AS s FROM c), e AS (SELECT u, count(*) AS k, -sum(s * ln(s)) AS h FROM q GROUP BY u) SELECT u, round(CASE WHEN k = 1 THEN 0 ELSE h / ln(k) END, 9) AS entropy, CASE WHEN (CASE WHEN k = 1 THEN 0 ELSE h / ln(k) END) <= 0.55 THEN 'strong' WHEN (CASE WHEN k = 1 THEN 0 ELSE h / ln(k) END) >= 0.85 THEN 'weak' ELSE 'normal' END AS reliability FROM e")
def entropy_reliability(spark, sf_dir):
    c = B.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("u"), "event_type").agg(F.count("*").alias("n"))
    s = F.col("n") / F.sum("n").over(Window.partitionBy("u"))
    e = c.withColumn("s", s).groupBy("u").agg(F.count("*").alias("k"), (-F.sum(F.col("s") * F.ln("s"))).alias("h"))
    e = e.withColumn("e", F.when(F.col("k") == 1, 0.0).otherwise(F.col("h") / F.ln("k")))
    return e.select("u", F.round("e", 9).alias("entropy"), F.when(F.col("e") <= 0.55, "strong").when(F.col("e") >= 0.85, "weak").otherwise("normal").alias("reliability"))


# --- checks and reports -------------------------------------------------------------------------


@query(f"WITH c AS (SELECT u, count(*) AS n, count(DISTINCT p) AS places FROM ({B.B_SQL}) GROUP BY u), m AS (SELECT min(n) AS least, max(n) AS most FROM c) SELECT least, most, u, places FROM c JOIN m ON n = most")
def user_event_extremes(spark, sf_dir):
    """The users with most events, their places, and the least and most events of any user."""
    c = B.visits_b(spark, sf_dir).groupBy("u").agg(F.count("*").alias("n"), F.count_distinct("p").alias("places"))
    m = c.agg(F.min("n").alias("least"), F.max("n").alias("most"))
    return c.join(F.broadcast(m), F.col("n") == F.col("most")).select("least", "most", "u", "places")


@query(f"SELECT l2 AS city, count(*) AS n FROM ({B.B_SQL}) WHERE l2 <> 'CHINA' GROUP BY 1 ORDER BY n DESC, city LIMIT 8")
def top_cities(spark, sf_dir):
    """The eight cities with most visits, one left out as a sentinel."""
    return B.visits_b(spark, sf_dir).where("l2 != 'CHINA'").groupBy(F.col("l2").alias("city")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "city").limit(8)


@query(f"WITH {A_STATES}, {_ROLL} SELECT 'raw' AS stage, count(*) AS n FROM ({B.A_SQL}) UNION ALL SELECT 'visible', count(*) FROM vis UNION ALL SELECT 'states', count(*) FROM st UNION ALL SELECT 'samples', count(*) FROM roll WHERE place > 1")
def stage_counts(spark, sf_dir):
    raw = B.visits_a(spark, sf_dir)
    visible = trajectory.train_visible(trajectory.deduplicated(raw), B.A_TRAIN)
    states = trajectory.collapsed(visible)
    steps = [("raw", raw), ("visible", visible), ("states", states), ("samples", trajectory.rolling(states))]
    found = [d.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n") for name, d in steps]
    return found[0].union(found[1]).union(found[2]).union(found[3])


@query(f"WITH {A_STATES}, {_ROLL} SELECT u AS user, strftime(t + INTERVAL 480 MINUTE, '%Y-%m-%d %H:%M:%S') AS time, count(*) AS n FROM roll WHERE place > 1 GROUP BY 1, 2")
def prompt_parse(spark, sf_dir):
    time, user = C.prompt_parts(F.col("input"))
    return sft_records(spark, sf_dir).groupBy(user.alias("user"), time.alias("time")).agg(F.count("*").alias("n"))


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS utc FROM events")
def parse_weekday_time(spark, sf_dir):
    made = F.concat(F.date_format("ts", "EEE MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format("ts", "yyyy"))
    return B.table(spark, sf_dir, "events").select("event_id", F.date_format(C.weekday_time(made), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("SELECT p_partkey, 'cafe ' || lower(p_type) || ' x' AS key FROM part")
def category_keys(spark, sf_dir):
    noisy = F.concat(F.lit("Café-"), F.col("p_type"), F.lit("  -x"))
    return B.table(spark, sf_dir, "part").select("p_partkey", C.category_key(noisy).alias("key"))


@query(_GRID + ", t AS (SELECT DISTINCT '' AS prefix, a AS next FROM code UNION ALL SELECT DISTINCT a || '', b FROM code UNION ALL SELECT DISTINCT a || ',' || b, l1_label FROM code) SELECT prefix, string_agg(next, ',' ORDER BY next) AS next FROM t GROUP BY prefix")
def catalog_trie(spark, sf_dir):
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return codes.trie(coded(spark, sf_dir), ["a", "b", "l1_label"]).select(text("prefix").alias("prefix"), text("next").alias("next"))


@query(_GRID + " SELECT count(*) FILTER (WHERE pid % 20 <> 0) AS codes, count(*) FILTER (WHERE pid % 20 <> 0) AS unique_codes, CAST(0 AS BIGINT) AS wrong_depth, count(*) FILTER (WHERE pid % 20 = 0) AS missing FROM code")
def codebook_check(spark, sf_dir):
    c = coded(spark, sf_dir)
    book = c.where("pid % 20 != 0").select("pid", C.sid_tokens(F.array("a", "b", "l1_label", "l2_label", "e")).alias("sid"))
    return codes.validated(book, c, 5)


@query(f"WITH {_CATALOG} SELECT pid, format('Place {{}} is a {{}} at {{:.6f}}, {{:.6f}}', pid, l2, lat, lon) AS text FROM full_cat")
def place_descriptions(spark, sf_dir):
    return catalog_b(spark, sf_dir).select("pid", F.format_string("Place %d is a %s at %.6f, %.6f", "pid", "l2", "lat", "lon").alias("text"))


# --- vectors ------------------------------------------------------------------------------------


@query()
def residual_kmeans(spark, sf_dir):
    from ..operators.vectors import residual_codes

    return residual_codes(B.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), F.col("embedding").alias("v")), 3, 8)


@query()
def region_kmeans(spark, sf_dir):
    from ..operators.vectors import regions

    return regions(catalog_b(spark, sf_dir).select("pid", "lat", "lon"), 6)


@query("WITH e AS (SELECT vec_id, unnest(embedding) AS x FROM embeddings) SELECT vec_id, round(sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 4) AS norm FROM e GROUP BY vec_id")
def vector_norms(spark, sf_dir):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return B.table(spark, sf_dir, "embeddings").select("vec_id", F.round(norm, 4).alias("norm"))


# --- reliability --------------------------------------------------------------------------------

_HISTORY = f"{_visible('SELECT DISTINCT u, p, t FROM (' + B.A_SQL + ')', B.A_TRAIN)}, hist AS (SELECT u, p, t, row_number() OVER (PARTITION BY u ORDER BY t, p) AS place, list(p) OVER (PARTITION BY u ORDER BY t, p ROWS BETWEEN 49 PRECEDING AND 1 PRECEDING) AS h FROM vis), hs AS (SELECT u, p, t, h FROM hist WHERE place > 1)"
_GROUPS = f"""{_HISTORY}, f AS (SELECT *, len(list_filter(h[-5:], lambda x: x = p)) AS near, h[-1] = p AS last, list_sort(list_transform(list_distinct(h), lambda l: {{'n': -len(list_filter(h, lambda x: x = l)), 'l': l}}))[1].l = p AS same, CASE WHEN len(list_distinct(h)) = 1 THEN 0 ELSE list_entropy(h) / log2(len(list_distinct(h))) END AS e FROM hs),
 g AS (SELECT u, t, p, CASE WHEN (last AND (near >= 2 OR e <= 0.55 OR same)) OR (near >= 2 AND same) THEN 'strong' WHEN near = 0 AND e >= 0.85 THEN 'weak' ELSE 'normal' END AS reliability FROM f)"""


def samples_with_reliability(spark, sf_dir):
    """Samples of all visible visits (runs kept) with the group of each."""
    from ..operators.reliability import reliability

    s = trajectory.rolling(trajectory.train_visible(trajectory.deduplicated(B.visits_a(spark, sf_dir)), B.A_TRAIN))
    return s.select("u", "t", "p", reliability(F.slice("seq", 1, F.size("seq") - 1), F.col("p")).alias("reliability"))


@query(f"WITH {_GROUPS} SELECT u, p, {TIME.format('t')} AS t, reliability FROM g")
def sample_reliability(spark, sf_dir):
    return samples_with_reliability(spark, sf_dir).select("u", "p", _time().alias("t"), "reliability")


@query(f"WITH {_GROUPS}, n AS (SELECT reliability, w, (SELECT count(*) FROM g WHERE g.reliability = k.reliability) AS samples FROM (VALUES ('strong', 1.3::DOUBLE), ('normal', 1.0), ('weak', 0.7)) k(reliability, w)) SELECT reliability, samples, round(samples / sum(samples) OVER (), 9) AS ratio, CASE WHEN samples > 0 THEN w ELSE 0 END AS raw_weight_mean, round(CASE WHEN samples > 0 THEN w ELSE 0 END / (sum(samples * w) OVER () / sum(samples) OVER ()), 9) AS weight_mean FROM n")
def reliability_summary(spark, sf_dir):
    from ..operators.reliability import summary

    return summary(samples_with_reliability(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("ratio", "weight_mean")})


@query(f"WITH {A_STATES}, h AS (SELECT row_number() OVER w AS place, list(p) OVER (PARTITION BY u ORDER BY t, p ROWS BETWEEN 49 PRECEDING AND 1 PRECEDING) AS h FROM st WINDOW w AS (PARTITION BY u ORDER BY t, p)) SELECT '<' || x || '>' AS sid, count(*) AS n FROM (SELECT unnest(h) AS x FROM h WHERE place > 1) GROUP BY 1")
def history_events(spark, sf_dir):
    """How often each token comes in the histories of the prompts."""
    events = F.regexp_extract_all("input", F.lit(r"(\d{4}-\d{2}-\d{2}) (\d{2}:\d{2}:\d{2}) visited ((?:<[^>]+>)+)"), F.lit(3))
    return sft_records(spark, sf_dir).select(F.explode(events).alias("sid")).groupBy("sid").agg(F.count("*").alias("n"))


# --- predictions, codes and checks --------------------------------------------------------------


@query("SELECT event_type AS p, '{' || string_agg('\"' || h || '\":' || n, ',' ORDER BY h) || '}' AS hours FROM (SELECT event_type, hour(ts + INTERVAL 480 MINUTE) AS h, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def hour_json(spark, sf_dir):
    entries = F.transform(F.sort_array(F.collect_list(F.struct("hour", "n"))), lambda x: F.struct(x["hour"].cast("string").alias("k"), x["n"].alias("v")))
    return local_hour_hist(spark, sf_dir).groupBy("p").agg(F.to_json(F.map_from_entries(entries)).alias("hours"))


@query("SELECT event_type AS key, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def histogram_merge(spark, sf_dir):
    per = B.table(spark, sf_dir, "events").groupBy((F.col("event_id") % 7).alias("shard"), "event_type").agg(F.count("*").alias("n"))
    return ranking.merged_counts(per.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("h")), "h")


def _predicted(k):
    at = lambda j: F.lit(-1).cast("long") if j == 8 else F.when(k == 2, F.col("gold")).otherwise((F.col("gold") + 21) % F.col("n")) if j == 3 else F.when(k == j, F.col("gold")).otherwise((F.col("gold") + 7 * (j + 1)) % F.col("n"))
    return F.array(*[at(j) for j in range(12)])


@query(_RANKS + " SELECT i, CAST(sum(CASE WHEN x < 0 THEN 1 ELSE 0 END) AS BIGINT) AS illegal, CAST(least(count(DISTINCT CASE WHEN x >= 0 THEN x END), 10) AS BIGINT) AS kept FROM x_p GROUP BY i")
def prediction_filter(spark, sf_dir):
    illegal, kept = ranking.filtered(_predicted(F.col("i") % 13), lambda v: v >= 0)
    return samples_b(spark, sf_dir).select("i", illegal, kept).select("i", F.col("illegal").cast("long").alias("illegal"), F.size("kept").cast("long").alias("kept"))


@query("SELECT conv_id, turn, 'see [PID:' || turn * 3 || '] then [PID:0] end ' || role AS text FROM conversations")
def normalized_prompt(spark, sf_dir):
    c = B.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    text = F.concat(F.lit("see  <a_"), "turn", F.lit("><b_1> \n then <a_0><b_1>end "), "role")
    book = c.select("turn").union(spark.range(1)).distinct().select(F.concat(F.lit("<a_"), "turn", F.lit("><b_1>")).alias("sid"), (F.col("turn") * 3).alias("pid"))
    keyed = c.select(F.struct("conv_id", "turn").alias("k"), text.alias("text"))
    return codes.with_pids(keyed, book, "k", "text").select("k.*", "text")


@query(f"SELECT CAST(sum(CASE WHEN cats > 1 THEN 1 ELSE 0 END) AS BIGINT) AS category_conflicts, CAST(sum(CASE WHEN coords > 1 THEN 1 ELSE 0 END) AS BIGINT) AS coordinate_conflicts, CAST(sum(n) - sum(visits) AS BIGINT) AS surplus FROM (SELECT p, count(DISTINCT (l1, l2)) AS cats, count(DISTINCT (lat, lon)) AS coords, count(*) AS n, count(DISTINCT (u, t)) AS visits FROM ({B.B_SQL}) GROUP BY p)")
def conflict_counts(spark, sf_dir):
    """Places with several categories or coordinates, and visits beyond the first of a (user, place, time)."""
    per = B.visits_b(spark, sf_dir).groupBy("p").agg(F.count_distinct("l1", "l2").alias("cats"), F.count_distinct("lat", "lon").alias("coords"), F.count("*").alias("n"), F.count_distinct("u", "t").alias("visits"))
    return per.agg(F.count_if(F.col("cats") > 1).alias("category_conflicts"), F.count_if(F.col("coords") > 1).alias("coordinate_conflicts"), (F.sum("n") - F.sum("visits")).alias("surplus"))


@query("SELECT epoch, loss FROM (SELECT CAST(label AS BIGINT) AS epoch, count(*) % 3 AS loss FROM embeddings GROUP BY 1) ORDER BY loss, epoch LIMIT 1")
def best_epoch(spark, sf_dir):
    return ranking.best_epoch(B.table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("long").alias("epoch")).agg((F.count("*") % 3).alias("loss")))


@query(_GRID + " SELECT count(*) AS places, CAST(sum(CASE WHEN pid % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS no_vector, CAST(sum(CASE WHEN pid % 20 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS no_code, CAST(0 AS BIGINT) AS repeated, CAST(sum(CASE WHEN pid % 20 <> 0 AND (b >= 40 OR a < 0 OR l1_label >= 40) THEN 1 ELSE 0 END) AS BIGINT) AS out_of_range, 64000 >= count(*) AS fits FROM code")
def pipeline_contract(spark, sf_dir):
    c = coded(spark, sf_dir)
    return codes.contract(c, c.where("pid % 7 != 0"), c.where("pid % 20 != 0").select("pid", F.array("a", "b", "l1_label").alias("code")), 40)


_BOOKS = "SELECT {layer} AS layer, a.vec_id % 8 AS k, list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) + CAST(z[2] AS DOUBLE)) AS x FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 16 WHERE a.vec_id BETWEEN {lo} AND {hi}"
_COSINE = f"books AS ({_BOOKS.format(layer=0, lo=0, hi=7)} UNION ALL {_BOOKS.format(layer=1, lo=8, hi=15)}), dirs AS (SELECT layer, k, list_transform(x, lambda v: v / sqrt(list_dot_product(x, x))) AS d FROM books), v0 AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _layer(i: int, out: str) -> str:
    return f"s{i} AS (SELECT vec_id, k, d, v, list_dot_product(v, d) AS s, row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(v, d) DESC, k) AS r FROM v{i}, dirs WHERE layer = {i}), v{i + 1} AS (SELECT vec_id, {out} AS code, list_transform(list_zip(v, d), lambda z: z[1] - greatest(s, 0) * z[2]) AS v FROM s{i} WHERE r = 1)"


@query(f"WITH {_COSINE}, {_layer(0, 'k')}, {_layer(1, 'k')} SELECT vec_id, v1.code || ',' || v2.code AS code FROM v1 JOIN v2 USING (vec_id)")
def cosine_quantiser(spark, sf_dir):
    from ..operators.vectors import cosine_codes

    e = B.table(spark, sf_dir, "embeddings")
    first = {r["vec_id"]: [float(x) for x in r["embedding"]] for r in e.where("vec_id < 32").collect()}  # the parameter: 16 entries
    books = [[[x + y for x, y in zip(first[k], first[k + 16])] for k in range(lo, lo + 8)] for lo in (0, 8)]
    found = cosine_codes(e.select(F.col("vec_id").alias("pid"), F.col("embedding").alias("v")), books)
    return found.select(F.col("pid").alias("vec_id"), F.array_join(F.transform("code", lambda x: x.cast("string")), ",").alias("code"))


def _scaled(table: str, key: str) -> str:
    return f"SELECT r, c, q / (sum(q) OVER (PARTITION BY {key}) + 1e-8) AS q FROM ({table})"


_SINKHORN = "SELECT vec_id AS r, j AS c, exp(-abs(CAST(embedding[j + 1] AS DOUBLE)) / (CAST(0.5 AS DOUBLE) + 1e-8)) AS q FROM embeddings, range(8) x(j)"
for _key in "rcrcr":
    _SINKHORN = _scaled(_SINKHORN, _key)


@query(f"SELECT r, c, round(q, 7) AS q FROM ({_SINKHORN})")
def sinkhorn_balance(spark, sf_dir):
    from ..operators.vectors import sinkhorn

    cells = B.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("r"), F.posexplode(F.transform(F.slice("embedding", 1, 8), lambda x: F.abs(x.cast("double")))).alias("c", "d"))
    return sinkhorn(cells.withColumn("c", F.col("c").cast("long")), 0.5, 2, _saver(spark)).withColumn("q", F.round("q", 7))


@query()
def unique_completion(spark, sf_dir):
    places = trajectory.dense_ids(B.visits_b(spark, sf_dir), "p", "pid")
    priors = places.select("pid", (F.col("pid") % 16).alias("a"), (F.col("pid") % 8).alias("b"), F.lit(0).cast("long").alias("c"))
    return graph.unique_completion(priors, spark.range(0, 32 * 32, 5).select(F.col("id").alias("code")), 32, _saver(spark))


from . import more  # noqa: E402, F401  (adds its queries)

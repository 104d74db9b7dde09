"""Features of places, regions by quota, encoded labels, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import sid_canonical, spherical

FREQUENCIES = (1, 2, 4, 8)
#: City names by their official name.
CITIES = {
    "北京市": "Beijing", "天津市": "Tianjin", "上海市": "Shanghai", "重庆市": "Chongqing", "石家庄市": "Shijiazhuang", "太原市": "Taiyuan", "沈阳市": "Shenyang", "大连市": "Dalian",
    "长春市": "Changchun", "哈尔滨市": "Harbin", "南京市": "Nanjing", "苏州市": "Suzhou", "无锡市": "Wuxi", "杭州市": "Hangzhou", "宁波市": "Ningbo", "合肥市": "Hefei",
    "福州市": "Fuzhou", "厦门市": "Xiamen", "南昌市": "Nanchang", "济南市": "Jinan", "青岛市": "Qingdao", "郑州市": "Zhengzhou", "武汉市": "Wuhan", "长沙市": "Changsha",
    "广州市": "Guangzhou", "深圳市": "Shenzhen", "南宁市": "Nanning", "成都市": "Chengdu", "贵阳市": "Guiyang", "昆明市": "Kunming", "西安市": "Xi'an", "兰州市": "Lanzhou",
    "乌鲁木齐市": "Urumqi", "海口市": "Haikou", "香港特别行政区": "Hong Kong", "澳门特别行政区": "Macao",
}


def display_name(city: Column) -> Column:
    """The English name of a known city, else the name without its closing suffix."""
    known = F.create_map(*[F.lit(x) for pair in CITIES.items() for x in pair])
    return F.coalesce(known[city], F.regexp_replace(city, "市$", ""))


def category_name(given: Column, mapped: Column, label: Column, level: int) -> Column:
    """The given name, else the mapped one, else the level and the label."""
    return F.coalesce(given, mapped, F.concat(F.lit(f"L{level}-"), label.cast("string")))


def where_equal(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows of one city or event type; a missing column is an error."""
    if column not in df.columns:
        raise ValueError(f"there is no column {column} to filter by")
    return df.where(F.col(column).cast("string") == value)


def z_scored(places: DataFrame, columns: tuple[str, ...] = ("lat", "lon")) -> DataFrame:
    """With z_<column>: less the mean, over the population's deviation (one row of statistics, broadcast)."""
    stats = places.agg(*[f(c).alias(f"{n}_{c}") for c in columns for f, n in ((F.avg, "a"), (F.stddev_pop, "s"))])
    out = places.crossJoin(F.broadcast(stats)).withColumns({f"z_{c}": (F.col(c) - F.col(f"a_{c}")) / (F.col(f"s_{c}") + 1e-12) for c in columns})
    return out.drop(*[f"{n}_{c}" for c in columns for n in "as"])


def coordinate_features() -> list[Column]:
    """18 columns of z_lat and z_lon: both, then sine and cosine of each at four frequencies."""
    out = [F.col("z_lat"), F.col("z_lon")]
    for axis in ("z_lat", "z_lon"):
        for f in FREQUENCIES:
            out += [F.sin(2 * F.pi() * f * F.col(axis)), F.cos(2 * F.pi() * f * F.col(axis))]
    return out


def nearest(points: DataFrame, centres: list[tuple]) -> DataFrame:
    """points(g, x, ...) with c, the nearest centre of their group, the first of equals; centres (g, c, m) are few."""
    groups: dict = {}
    for g, c, m in sorted(centres, key=lambda t: t[:2]):
        groups.setdefault(g, []).append((c, m))
    every = points.sparkSession.createDataFrame(list(groups.items()), f"g {points.schema['g'].dataType.simpleString()}, centres array<struct<c: int, m: array<double>>>")
    gap = lambda t: F.aggregate(F.zip_with("x", t["m"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    near = F.array_min(F.transform("centres", lambda t: F.struct(gap(t).alias("d"), t["c"].alias("c"))))
    return points.join(F.broadcast(every.coalesce(1)), "g").withColumn("c", near["c"]).drop("centres")


def lloyd(points: DataFrame, quotas: DataFrame, rounds: int = 10) -> DataFrame:
    """``points`` with c: k-means inside every group at once; points(id, g, x array<double>, ...), quotas(g, k).

    The first centres of a group are its k points of smallest hash, of which each task sends on k at
    most.  A round sends each point to the nearest centre of its group and averages the points of
    every centre, as grouped sums; the driver holds the centres only (the sum of the quotas).  A centre
    without points stays where it is.
    """
    most = quotas.agg(F.max("k")).first()[0] or 0
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("id"), "id"))
    first = points.select("g", "id", "x").withColumn("place", place).where(F.col("place") <= F.lit(int(most)))
    first = first.join(F.broadcast(quotas), "g").where(F.col("place") <= F.col("k"))
    centres = {(r.g, r.place - 1): list(r.x) for r in first.select("g", "place", "x").collect()}
    width = len(next(iter(centres.values()), []))
    listed = lambda: [(g, c, m) for (g, c), m in centres.items()]
    for _ in range(rounds if centres else 0):
        means = nearest(points.select("g", "x"), listed()).groupBy("g", "c").agg(F.array(*[F.avg(F.get("x", F.lit(i))) for i in range(width)]).alias("m"))
        centres |= {(r.g, r.c): list(r.m) for r in means.collect()}
    return nearest(points, listed())


def region_codes(places: DataFrame, coarse: int, fine: int, save, rounds: int = 10) -> DataFrame:
    """pid, a, b: coarse regions of z-scored coordinates, and finer ones of coordinate features inside each by quota.

    Quotas follow the root of a region's places; fine numbers go on from region to region.
    """
    from .codes import sqrt_allocation

    z = save(z_scored(places.select("pid", "lat", "lon")), "z")
    n = z.count()
    one = places.sparkSession.createDataFrame([(0, min(coarse, n))], "g int, k int")
    found = lloyd(z.select(F.col("pid").alias("id"), F.lit(0).alias("g"), F.array("z_lat", "z_lon").alias("x")), one, rounds)
    regions = save(found.select(F.col("id").alias("pid"), F.col("c").alias("g")), "regions")
    sizes = save(regions.groupBy("g").agg(F.count("*").alias("n")), "sizes")
    quotas = sqrt_allocation(sizes, min(fine, n)).select("g", F.least("quota", "n").cast("int").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy(F.lit(0)).orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quotas = save(quotas.withColumn("start", before), "quotas")  # one row for each coarse region
    points = z.join(regions, "pid").select(F.col("pid").alias("id"), "g", F.array(*coordinate_features()).alias("x"))
    inner = lloyd(points, quotas.select("g", "k"), rounds)
    return inner.join(F.broadcast(quotas), "g").select(F.col("id").alias("pid"), F.col("g").cast("long").alias("a"), (F.col("start") + F.col("c")).cast("long").alias("b"))


def hashed_letters(names: list[str], width: int = 128):
    """Vectors of category names by their hashed three-letter runs; stands in for a text encoder, which is a parameter."""
    import zlib

    import numpy as np

    out = np.zeros((len(names), width))
    for row, name in zip(out, names):
        padded = f"  {name.lower()} "
        for i in range(len(padded) - 2):
            row[zlib.crc32(padded[i : i + 3].encode()) % width] += 1
    return out


def category_vectors(names: list[str], size: int = 64, encoder=hashed_letters):
    """Principal components of the names' vectors, padded with zeros to ``size``; each one's largest weight is positive."""
    import numpy as np

    found = encoder(names)
    centred = found - found.mean(0)
    u, s, v = np.linalg.svd(centred, full_matrices=False)
    keep = min(size, *found.shape)
    sign = np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])
    reduced = (u * s * np.where(sign == 0, 1, sign))[:, :keep]
    return np.pad(reduced, ((0, 0), (0, size - keep)))


def place_vectors(catalog: DataFrame, visits: DataFrame, size: int = 64, encoder=hashed_letters) -> DataFrame:
    """pid, v array<double>: category components, unit vector, and twelve waves of the visits' local hours (zeros without visits).

    catalog(pid, lat, lon, l2), visits(pid, hour).  Categories are few and are reduced on the driver.
    """
    import numpy as np

    spark = catalog.sparkSession
    names = [r[0] for r in catalog.select("l2").distinct().orderBy("l2").collect()]
    parts = category_vectors(names, size, encoder) if names else np.zeros((0, size))
    named = spark.createDataFrame([(n, [float(x) for x in p]) for n, p in zip(names, parts)], "l2 string, category array<double>")
    hours = visits.groupBy("pid", "hour").agg(F.count("*").alias("n"))
    waves = [f(2 * F.pi() * k * F.col("hour") / 24) for k in range(1, 7) for f in (F.sin, F.cos)]
    time = hours.groupBy("pid").agg(*[(F.sum(F.col("n") * w) / F.sum("n")).alias(f"t{i}") for i, w in enumerate(waves)])
    time = time.select("pid", F.array(*[f"t{i}" for i in range(12)]).alias("time"))
    joined = catalog.join(F.broadcast(named), "l2").join(time, "pid", "left")
    zeros = F.array(*[F.lit(0.0)] * 12)
    return joined.select("pid", F.concat("category", F.array(*spherical(F.col("lat"), F.col("lon"))), F.coalesce("time", zeros)).alias("v"))


def frequency_ids(labels: DataFrame, label: str, name: str) -> DataFrame:
    """label, id, n of the distinct labels: most frequent first, then by label; one array of the (few) labels is sorted."""
    n = labels.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    ordered = n.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), label))).alias("all"))
    return ordered.select(F.posexplode("all").alias("id", "x")).select(F.col(f"x.{label}").alias(label), F.col("id").cast("long").alias(name), (-F.col("x.m")).alias("n"))


def encoded_labels(samples: DataFrame, train: DataFrame, least: int = 5, tokens: int = 2048, used: Column | None = None) -> DataFrame:
    """id, reason, z1, z2, z12, sibling of samples(id, input, output): label ids, or why a sample is skipped.

    Labels are the first, the second, and the first two codes of the output; ids come from train
    (output) by falling frequency, -1 for an unseen pair; ``sibling`` is 1 where the first code has
    ``least`` train samples.  ``used`` is the number of tokens of the response (default: its codes).
    """

    def coded(df: DataFrame) -> DataFrame:
        atoms = F.regexp_extract_all(sid_canonical(F.col("output")), F.lit(r"<[a-z]_\d+>"), F.lit(0))
        df = df.withColumn("atoms", atoms)
        return df.withColumns({"l1": F.get("atoms", F.lit(0)), "l2": F.get("atoms", F.lit(1))}).withColumn("l12", F.concat("l1", "l2"))

    made, seen = coded(samples), coded(train).where("l2 is not null")
    for label, name in (("l1", "z1"), ("l2", "z2"), ("l12", "z12")):
        ids = frequency_ids(seen, label, name)
        made = made.join(F.broadcast(ids.withColumnRenamed("n", f"n_{name}")), label, "left")
    size = used if used is not None else F.size("atoms")
    reason = F.when(F.size("atoms") < 2, "bad_sid").when(F.col("z1").isNull() | F.col("z2").isNull(), "unknown_prefix").when(F.lit(tokens) - size <= 1, "too_long_response").when(F.coalesce(F.length("input"), F.lit(0)) == 0, "empty_prompt")
    ok = F.col("reason").isNull()
    out = made.withColumn("reason", reason)
    sibling = F.when(ok, (F.col("n_z1") >= least).cast("long"))
    return out.select("id", "reason", F.when(ok, F.col("z1")).alias("z1"), F.when(ok, F.col("z2")).alias("z2"), F.when(ok, F.coalesce("z12", F.lit(-1).cast("long"))).alias("z12"), sibling.alias("sibling"))


def combination_trie(spark, size: int, levels: int = 3) -> DataFrame:
    """prefix array, next array: every code of a level may follow every prefix; a whole code allows none."""
    values = F.sequence(F.lit(0), F.lit(size - 1))
    out = level = spark.range(1).select(F.array().cast("array<int>").alias("prefix"))
    for _ in range(levels - 1):
        level = level.select("prefix", F.explode(values).alias("v")).select(F.concat("prefix", F.array("v")).alias("prefix"))
        out = out.unionByName(level)
    return out.withColumn("next", values)


def parsed_code(text: Column, size: int, levels: int = 3) -> Column:
    """The codes of the first whole run of levels in a text; null where there is none or one is out of range."""
    pattern = "".join(rf"<{chr(97 + i)}_(\d+)>" for i in range(levels))
    found = [F.regexp_extract(text, pattern, i + 1).try_cast("int") for i in range(levels)]
    inside = found[0].between(0, size - 1)
    for x in found[1:]:
        inside = inside & x.between(0, size - 1)
    return F.when(F.coalesce(inside, F.lit(False)), F.array(*found))


def listed_code(text: Column) -> Column:
    """A text such as "[1, 2, 3]" as an array; null where it is none."""
    return F.from_json(text, "array<int>", {"mode": "PERMISSIVE"})


def em_records(catalog: DataFrame, codes: DataFrame) -> DataFrame:
    """instruction, input, output, pid: the description of each place and its code; both tables must hold the same places."""
    from .checks import covered_join
    from .corpus import about

    joined = covered_join(catalog, codes.select("pid", "sid"), "pid")
    return joined.select(F.lit(EM_INSTRUCTION).alias("instruction"), about().alias("input"), F.col("sid").alias("output"), "pid")


#: The wording of instructions.
EM_INSTRUCTION = "Given the public attributes of a POI, generate its current three-level geographic collaborative semantic identifier."
INSTRUCTION = "Here is a record of a user's POI accesses, your task is based on the history to predict the POI that the user is likely to access at the specified time."


def sft_rows(samples: DataFrame, codes: DataFrame) -> DataFrame:
    """split, instruction, input, output of samples(split, u, place, seq, times text); an unknown place is an error.

    Visits are joined with codes(p, sid) one by one and put in order again, so the codebook may be large.
    """
    visits = samples.select("split", "u", "place", F.posexplode(F.arrays_zip("seq", "times")).alias("at", "v"))
    visits = visits.select("split", "u", "place", "at", F.col("v.seq").alias("p"), F.col("v.times").alias("time")).join(codes.select("p", "sid"), "p", "left")
    sid = F.coalesce("sid", F.raise_error(F.lit("a place is not in the codebook")).cast("string"))
    told = visits.groupBy("split", "u", "place").agg(F.sort_array(F.collect_list(F.struct("at", "time", sid.alias("sid")))).alias("e"))
    past = F.array_join(F.transform(F.slice("e", 1, F.size("e") - 1), lambda x: F.concat(x["time"], F.lit(" visited "), x["sid"])), ", ")
    last = F.element_at("e", -1)
    text = F.concat(F.lit("User_"), "u", F.lit(" checkin history: "), past, F.lit(".\nWhen "), last["time"], F.lit(" user_"), "u", F.lit(" is likely to visit:"))
    return told.select("split", F.lit(INSTRUCTION).alias("instruction"), text.alias("input"), last["sid"].alias("output"))

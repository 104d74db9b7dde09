"""Hierarchical codes of places: numbering, collisions, statistics, allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def leaves(df: DataFrame, prefix: list[str], key: str = "p", name: str = "e") -> DataFrame:
    """Numbers 0.. within each prefix by key."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*prefix).orderBy(key)) - 1).cast("long"))


def collision_leaves(df: DataFrame, code: str = "code", key: str = "pid") -> DataFrame:
    """A number appended to codes that several keys share, and only to those."""
    by = Window.partitionBy(code)
    place = (F.row_number().over(by.orderBy(key)) - 1).cast("int")
    return df.withColumn("shared", F.count("*").over(by)).withColumn("place", place).withColumn(code, F.when(F.col("shared") > 1, F.concat(code, F.array("place"))).otherwise(F.col(code))).drop("shared", "place")


def prefix_sizes(df: DataFrame, levels: list[str]) -> DataFrame:
    """depth, the levels (null below depth), size, first key: all prefix buckets in one pass."""
    sets = [levels[: i + 1] for i in range(len(levels))]
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in levels])
    depth = sum((1 - F.grouping(c)).cast("int") for c in levels)
    return grouped.agg(F.count("*").alias("size"), depth.alias("depth"))


def prefix_stats(df: DataFrame, levels: list[str]) -> DataFrame:
    found = prefix_sizes(df, levels)
    return found.groupBy("depth").agg(
        F.count("*").alias("buckets"), F.avg("size").alias("mean_size"), F.percentile("size", 0.5).alias("median_size"), F.percentile("size", 0.9).alias("p90_size"), F.max("size").alias("max_size"),
        F.sum(F.when(F.col("size") == 1, 1).otherwise(0)).alias("singletons"), F.sum(F.when(F.col("size") > 1, F.col("size")).otherwise(0)).alias("colliding"),
    )


def sqrt_allocation(counts: DataFrame, total: int) -> DataFrame:
    """g, n -> quota: at least 1 each, the rest by largest remainder of root counts (ties by g)."""
    whole = Window.partitionBy()
    share = F.sqrt("n") / F.sum(F.sqrt("n")).over(whole) * F.lit(total)
    base = counts.withColumn("share", share).withColumn("base", F.greatest(F.floor("share"), F.lit(1)))
    left = F.lit(total) - F.sum("base").over(whole)
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc(F.col("share") - F.floor("share")), "g"))
    return base.withColumn("left", left).withColumn("rank", rank).select("g", "n", (F.col("base") + (F.col("rank") <= F.col("left")).cast("int")).alias("quota"))


def trie(df: DataFrame, levels: list[str]) -> DataFrame:
    """prefix array, next array: the values allowed after each prefix, in order; a whole code allows none."""
    code = df.select(F.array(*levels).alias("code")).distinct()
    step = F.transform(F.sequence(F.lit(0), F.lit(len(levels) - 1)), lambda i: F.struct(F.slice("code", F.lit(1), i).alias("prefix"), F.get("code", i).alias("value")))
    edges = code.select(F.inline(step)).distinct()
    return edges.groupBy("prefix").agg(F.sort_array(F.collect_list("value")).alias("next"))


def validated(codebook: DataFrame, catalog: DataFrame, depth: int) -> DataFrame:
    """One row of counts: codes, distinct codes, codes of a wrong depth, places of the catalog without one; codebook(pid, sid)."""
    wrong = F.size(F.regexp_extract_all("sid", F.lit(r"<[a-z]_\d+>"), F.lit(0))) != depth
    number = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    held = catalog.select("pid").distinct().join(codebook.withColumn("has", F.lit(1)), "pid", "left")
    return held.agg(F.count("has").alias("codes"), F.count_distinct("sid").alias("unique_codes"), number(F.coalesce(wrong, F.lit(False)), "wrong_depth"), number(F.col("has").isNull(), "missing"))


def with_pids(df: DataFrame, codebook: DataFrame, key: str, text: str) -> DataFrame:
    """key, text with every run of code tokens as ``[PID:n] `` and single blanks; an unknown code is an error; codebook(sid, pid)."""
    pattern = r"(?:<[a-z]_\d+>)+"
    cut = df.select(key, F.split(text, pattern).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("runs"))
    found = cut.select(key, F.posexplode("runs").alias("at", "sid")).join(codebook.select("sid", "pid"), "sid", "left")
    pid = F.coalesce(F.col("pid").cast("string"), F.raise_error(F.lit("a code is not in the codebook")).cast("string"))
    pids = found.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", pid.alias("pid")))), lambda x: F.concat(F.lit("[PID:"), x["pid"], F.lit("] "))).alias("pids"))
    whole = F.zip_with("pieces", F.coalesce("pids", F.array().cast("array<string>")), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return cut.join(pids, key, "left").select(key, F.trim(F.regexp_replace(F.array_join(whole, ""), r"\s+", " ")).alias(text))


def contract(catalog: DataFrame, vectors: DataFrame, codes: DataFrame, size: int) -> DataFrame:
    """One row: places, places without vector or code, repeated pids, codes out of range, whether all fit; codes(pid, code array)."""
    number = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    bad = (F.size("code") != 3) | F.exists("code", lambda x: (x < 0) | (x >= size))
    per = codes.groupBy("pid").agg(F.count("*").alias("n"), F.max(bad.cast("int")).alias("bad"))
    held = catalog.select("pid").distinct().join(vectors.select("pid").distinct().withColumn("v", F.lit(1)), "pid", "left").join(per, "pid", "left")
    return held.agg(F.count("*").alias("places"), number(F.col("v").isNull(), "no_vector"), number(F.col("n").isNull(), "no_code"), number(F.coalesce(F.col("n") > 1, F.lit(False)), "repeated"), number(F.coalesce(F.col("bad") == 1, F.lit(False)), "out_of_range"), (F.lit(size) ** 3 >= F.count("*")).alias("fits"))

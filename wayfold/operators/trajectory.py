"""From visits (u, p, t) to states, samples and splits."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import Stage

ORDER = ("t", "p")


def boundaries(train_end: str, validation_end: str | None) -> tuple[str, str | None]:
    """Checked split bounds as UTC wall times; each must carry a zone, the second must be later."""
    found = [datetime.fromisoformat(x) if x else None for x in (train_end, validation_end)]
    if any(x is not None and x.tzinfo is None for x in found):
        raise ValueError("a split boundary needs a time zone")
    if found[1] is not None and found[1] <= found[0]:
        raise ValueError("the validation end must be after the train end")
    return tuple(x and x.astimezone(tz=__import__("datetime").timezone.utc).strftime("%Y-%m-%d %H:%M:%S") for x in found)


def bound(when: str) -> Column:
    return F.expr(f"timestamp_ntz'{when}'")


def deduplicated(visits: DataFrame) -> DataFrame:
    """One row for each (u, p, t): the smallest by the other columns, whatever the input order."""
    rest = [c for c in visits.columns if c not in ("u", "p", "t")]
    if not rest:
        return visits.select("u", "p", "t").distinct()
    least = visits.groupBy("u", "p", "t").agg(F.min(F.struct(*rest)).alias("r"))
    return least.select("u", "p", "t", "r.*")


def train_visible(visits: DataFrame, train_end: str) -> DataFrame:
    """Visits whose user and place both occur in the train period."""
    train = visits.where(F.col("t") <= bound(train_end))
    return visits.join(train.select("u").distinct(), "u", "left_semi").join(train.select("p").distinct(), "p", "left_semi")


def collapsed(visits: DataFrame) -> DataFrame:
    """Visits that change the place: the first report of each run."""
    before = F.lag("p").over(Window.partitionBy("u").orderBy(*ORDER))
    return visits.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("p"))).drop("before")


def split_of(train_end: str, validation_end: str | None) -> Column:
    train = F.when(F.col("t") <= bound(train_end), "train")
    return train.when(F.col("t") <= bound(validation_end), "val").otherwise("test") if validation_end else train.otherwise("test")


def rolling(states: DataFrame, length: int = 50, min_history: int = 1) -> DataFrame:
    """u, p, t, place (1-based), seq (places up to this one), times; one shuffle by user serves both windows."""
    if length < 2:
        raise ValueError("a sequence has two states at least")
    by = Window.partitionBy("u").orderBy(*ORDER)
    recent = F.collect_list(F.struct("p", "t")).over(by.rowsBetween(-(length - 1), 0))
    found = states.select("u", "p", "t", F.row_number().over(by).alias("place"), recent.alias("recent"))
    return found.where(F.col("place") > min_history).select("u", "p", "t", "place", F.col("recent.p").alias("seq"), F.col("recent.t").alias("times"))


def last_k(samples: DataFrame, k: int = 5) -> DataFrame:
    if k <= 0:
        raise ValueError("k must be positive")
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("t"), F.desc("p")))
    return samples.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def dense_ids(keys: DataFrame, key: str, name: str) -> DataFrame:
    """0..n-1 in order of the distinct keys, without gathering them in one task.

    Keys are range-partitioned, sorted and written with their place to the shared folder, so a lost
    executor cannot change who holds which key; only each partition's count goes to the driver, and
    a partition's numbers start where the earlier ones end.
    """
    spark = keys.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = keys.select(F.col(key).cast("string").alias(key)).where(F.col(key).isNotNull()).distinct().repartitionByRange(n, key).sortWithinPartitions(key)
    # the partition in the upper bits, the place in it in the lower 33
    place = F.monotonically_increasing_id()
    saved = Stage(spark).save(ranged.withColumn("place", place), "keys").withColumn("part", F.shiftright("place", 33).cast("int"))
    counts = sorted((r["part"], r["count"]) for r in saved.groupBy("part").count().collect())
    starts, total = [], 0
    for part, count in counts:
        starts.append((part, total))
        total += count
    offsets = spark.createDataFrame(starts, "part int, start long")
    return saved.join(F.broadcast(offsets), "part").select(key, (F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))

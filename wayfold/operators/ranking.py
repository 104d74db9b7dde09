"""Ranked predictions: filtering, metrics, shards, cities, intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import dcg, relative


def ranked(predictions: Column, gold: Column, legal: Column | None = None, k: int = 10) -> Column:
    """1-based rank of gold among the first k distinct legal predictions, 0 if absent."""
    kept = F.filter(predictions, lambda x: legal(x)) if legal else predictions
    return F.array_position(F.slice(F.array_distinct(kept), 1, k), gold).cast("long")


def metrics(rank: str = "rank") -> list[Column]:
    r = F.col(rank)
    hits = [F.avg(F.when(r.between(1, k), 1.0).otherwise(0.0)).alias(f"r{k}") for k in (1, 5, 10)]
    return [F.count("*").alias("n"), *hits, F.avg(dcg(r)).alias("ndcg10")]


def shards(rows: DataFrame, n: int, index: str = "sample_index") -> DataFrame:
    if n <= 0:
        raise ValueError("the number of shards must be positive")
    return rows.withColumn("shard", F.pmod(index, F.lit(n)).cast("long"))


def coverage(expected: DataFrame, got: DataFrame, index: str = "sample_index") -> DataFrame:
    """One row: how many indexes are missing, extra, or there more than once."""
    counts = got.groupBy(index).agg(F.count("*").alias("c"))
    both = expected.select(index).distinct().withColumn("e", F.lit(1)).join(counts, index, "full_outer")
    number = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).alias
    return both.agg(number(F.col("c").isNull())("missing"), number(F.col("e").isNull())("extra"), number(F.col("c") > 1)("repeated"))


def aligned(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The k-th row of a key on the left with the k-th on the right; unmatched rows stay with nulls."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    a, b = (x.withColumn("k", rank) for x in (left, right))
    return a.join(b, [*keys, "k"], "full_outer")


def by_city(rows: DataFrame, cities: DataFrame) -> DataFrame:
    """Metrics of two methods by city and overall (city null); catalog cities without samples keep null metrics.

    rows: city, u, gold, rank_x, rank_y.  cities: city, places.
    """
    hit = lambda c, k: F.avg(F.when(F.col(c).between(1, k), 1.0).otherwise(0.0))
    values = [F.count("*").alias("n"), F.count_distinct("u").alias("users"), F.count_distinct("gold").alias("targets")]
    for m in "xy":
        values += [hit(f"rank_{m}", k).alias(f"{m}_r{k}") for k in (1, 5, 10)] + [F.avg(dcg(F.col(f"rank_{m}"))).alias(f"{m}_ndcg10")]
    grouped = rows.groupingSets([[F.col("city")], []], F.col("city")).agg(*values, F.grouping("city").alias("overall"))
    named = cities.select(F.col("city").alias("c"), "places")
    joined = named.join(grouped.where("overall = 0"), F.col("c") == F.col("city"), "left").drop("city").withColumnRenamed("c", "city").withColumn("n", F.coalesce("n", F.lit(0)))
    whole = grouped.where("overall = 1").crossJoin(cities.agg(F.sum("places").alias("places"))).withColumn("city", F.lit("ALL"))
    out = joined.drop("overall").unionByName(whole.drop("overall"))
    for k in ("r1", "r5", "r10", "ndcg10"):
        out = out.withColumn(f"delta_{k}", F.col(f"x_{k}") - F.col(f"y_{k}")).withColumn(f"relative_{k}", relative(F.col(f"x_{k}"), F.col(f"y_{k}")))
    return out


#: Chances that a Poisson variable of mean 1 is at most 0, 1, ... 8 (exp(-1) times the partial sums of 1 / k!).
_AT_MOST = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402]


#: Users whose weights are held at once, and cities whose sums a task holds before it hands them on.
_USERS, _CITIES = 512, 256


def _resampled(rounds: int):
    """Batches of (city, head, n, x, y) to city, round and the sums of weight, weight * n, * x and * y; round -1 weighs all users 1.

    head is the digested text before the round.  The sums are parts of a city's: it may come again.
    """
    import numpy as np
    import pyarrow as pa

    from ..functions.digests import leading_md5

    # a draw of v / 2^32 reaches a chance as soon as v reaches it times 2^32, rounded up
    reached = [np.uint32(math.ceil(x * (1 << 32))) for x in _AT_MOST]
    tails = [str(b).encode() for b in range(rounds)]

    def weights(heads):
        drawn = leading_md5(heads, tails)
        found = np.ones((len(heads), rounds + 1), np.uint8)
        found[:, 1:] = sum((drawn >= x).view(np.uint8) for x in reached)
        return found

    def handed(sums, kind):
        for city, found in sums.items():
            at = np.flatnonzero(found[0])
            yield pa.RecordBatch.from_arrays([pa.array([city] * len(at), kind), pa.array(at - 1, pa.int32()), *[pa.array(found[i, at]) for i in range(4)]], ["city", "round", "w", "n", "x", "y"])

    def run(batches):
        sums, kind = {}, None
        for batch in batches:
            cities = batch.column("city").dictionary_encode("encode")
            kind, names, code = cities.dictionary.type, cities.dictionary.to_pylist(), cities.indices.to_numpy()
            heads, user = np.unique(np.array(batch.column("head").to_pylist(), object), return_inverse=True)
            values = np.stack([np.ones(len(code)), *[batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in "nxy"]])
            for k in range(0, len(heads), _USERS):
                drawn = weights([h.encode() for h in heads[k : k + _USERS]])
                rows = np.flatnonzero((user >= k) & (user < k + _USERS))
                rows = rows[np.argsort(code[rows], kind="stable")]
                for part in np.split(rows, np.flatnonzero(np.diff(code[rows])) + 1):
                    added = values[:, part] @ drawn[user[part] - k].astype(float)
                    name = names[code[part[0]]]
                    sums[name] = sums[name] + added if name in sums else added
                if len(sums) > _CITIES:
                    yield from handed(sums, kind)
                    sums = {}
        yield from handed(sums, kind)

    return run


def bootstrap(per_user: DataFrame, rounds: int = 2000, seed: int = 42) -> DataFrame:
    """city, diff, low, high, relative_low, relative_high: 95 % intervals of x - y, absolute and in percent of y.

    Users are resampled inside their city by Poisson weights, which a digest of (seed, user, round)
    fixes, so every run gives the same intervals.  Users are dealt out whole: a weight is drawn once
    for all cities of a user, and a task adds its users up by city and round, so no city's users meet
    in one task and no row is made for each user and round.  per_user(city, u, n, x, y) holds sums
    without nulls, which doubles add up exactly as far as they are whole numbers below 2^53.  A round
    without users is left out.
    """
    spark = per_user.sparkSession
    head = F.concat_ws(":", F.lit(str(seed)), F.col("u").cast("string"), F.lit(""))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = per_user.select("city", head.alias("head"), "n", "x", "y").repartition(tasks, "head").sortWithinPartitions("head")
    parts = dealt.mapInArrow(_resampled(rounds), f"city {per_user.schema['city'].dataType.simpleString()}, round int, w double, n double, x double, y double")
    sums = parts.groupBy("city", "round").agg(*[F.sum(c).alias(c) for c in "nxy"])
    whole, drawn = F.col("round") < 0, (F.col("round") >= 0) & F.col("city").isNotNull()
    d, r = (F.col("x") - F.col("y")) / F.col("n"), F.when(F.col("y") != 0, (F.col("x") - F.col("y")) / F.col("y") * 100)
    ends = [F.percentile(F.when(drawn, c), p).alias(name) for c, p, name in ((d, 0.025, "low"), (d, 0.975, "high"), (r, 0.025, "relative_low"), (r, 0.975, "relative_high"))]
    return sums.groupBy("city").agg(F.max(F.when(whole, d)).alias("diff"), *ends)


def filtered(predictions: Column, legal, k: int = 10) -> list[Column]:
    """How many predictions are illegal, and the first k distinct legal ones."""
    return [F.size(F.filter(predictions, lambda x: ~legal(x))).alias("illegal"), F.slice(F.array_distinct(F.filter(predictions, legal)), 1, k).alias("kept")]


def merged_counts(shards: DataFrame, column: str) -> DataFrame:
    """key, n: the counters of all shards added up; column is map<string, long>."""
    return shards.select(F.explode(column).alias("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))


def disjoint_union(parts: list[DataFrame], key: str) -> DataFrame:
    """All rows of the parts; a key that comes twice is an error when the result is read."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    n = F.count("*").over(Window.partitionBy(key))
    return whole.withColumn("_n", n).withColumn(key, F.when(F.col("_n") == 1, F.col(key)).otherwise(F.raise_error(F.lit("a key comes twice")).cast(whole.schema[key].dataType))).drop("_n")


def best_epoch(losses: DataFrame) -> DataFrame:
    """The epoch of least loss, the earlier of equals; losses(epoch, loss)."""
    return losses.agg(F.min(F.struct("loss", "epoch")).alias("b")).select("b.epoch", "b.loss")

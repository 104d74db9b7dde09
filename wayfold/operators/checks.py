"""Checks that fail when the checked rows are read, joins that prove their coverage, and audits of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import filtered, metrics, ranked


def guarded(df: DataFrame, column: str, bad: Column, message: str) -> DataFrame:
    """``df`` whose ``column`` raises an error in rows where ``bad`` holds."""
    kind = df.schema[column].dataType
    return df.withColumn(column, F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(message)).cast(kind)).otherwise(F.col(column)))


def required_fields(df: DataFrame, names: list[str]) -> DataFrame:
    """Every row must have a value in each of the fields."""
    for name in names:
        df = guarded(df, name, F.col(name).isNull(), f"a row has no {name}")
    return df


def all_finite(df: DataFrame, numbers: list[str], arrays: list[str] = ()) -> DataFrame:
    """Numbers and members of arrays must be neither null nor NaN nor infinite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    for name in numbers:
        df = guarded(df, name, odd(F.col(name)), f"{name} is not finite")
    for name in arrays:
        df = guarded(df, name, F.col(name).isNull() | F.exists(name, odd), f"{name} is not finite")
    return df


def unique(df: DataFrame, key: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy(key))
    return guarded(df.withColumn("_n", n), key, F.col("_n") > 1, f"{key} comes twice").drop("_n")


def same_set(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: how many keys are on the left or right only, and whether the sets are equal."""
    a, b = (x.select(key).distinct().withColumn(n, F.lit(1)) for x, n in ((left, "l"), (right, "r")))
    both = a.join(b, key, "full_outer")
    found = both.agg(F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))
    return found.withColumn("equal", (F.col("left_only") == 0) & (F.col("right_only") == 0))


def covered_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One to one: each key once on either side and on both, else an error when the rows are read."""
    left, right = (unique(x, key) for x in (left, right))
    both = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), key, "full_outer")
    return guarded(both, key, F.col("_l").isNull() | F.col("_r").isNull(), f"the tables hold different values of {key}").drop("_l", "_r")


def by_position(rows: DataFrame, predictions: DataFrame, index: str = "sample_index") -> DataFrame:
    """Rows with their predictions by index; an index that is missing, extra or repeated is an error."""
    return covered_join(rows, predictions, index)


def audited(rows: DataFrame, predictions: DataFrame, codebook: DataFrame, official: dict, k: int = 10) -> DataFrame:
    """One row of counts and metrics of a method's predictions, with whether they are sound.

    rows(sample_index, input, output), predictions(sample_index, input, gold, predictions array),
    codebook(pid, sid).  Counted: golds and inputs that differ, golds and predictions outside the
    codebook; compared within 1e-10: the metrics recomputed and the official ones.
    """
    sids = codebook.select("sid").distinct()
    joined = by_position(rows, predictions.withColumnsRenamed({"input": "shown", "gold": "told"}))
    flat = joined.select("sample_index", F.explode("predictions").alias("sid")).join(sids, "sid", "left_anti").groupBy("sample_index").agg(F.count("*").alias("illegal"))
    known = sids.withColumnRenamed("sid", "output").withColumn("legal", F.lit(1))
    full = joined.join(flat, "sample_index", "left").join(known, "output", "left").withColumn("rank", ranked(F.col("predictions"), F.col("output"), None, k))
    counted = full.agg(
        *metrics(), F.count_if(~F.col("told").eqNullSafe(F.col("output"))).alias("gold_differs"), F.count_if(~F.col("shown").eqNullSafe(F.col("input"))).alias("input_differs"),
        F.count_if(F.col("legal").isNull()).alias("gold_illegal"), F.coalesce(F.sum("illegal"), F.lit(0)).alias("predictions_illegal"),
    )
    names = {"recall@1": "r1", "recall@5": "r5", "recall@10": "r10", "ndcg@10": "ndcg10"}
    close = [F.abs(F.col(names[n]) - F.lit(float(v))) <= 1e-10 for n, v in official.items() if n in names]
    exact = [F.col("n") == int(official[n]) for n in ("samples", "prediction_samples") if n in official] + [F.lit(int(official.get("k", 10)) == k)]
    sizes = [F.col("codes") == int(official["legal_sid_count"])] if "legal_sid_count" in official else []
    # one row on either side
    counted = counted.crossJoin(F.broadcast(sids.agg(F.count("*").alias("codes"))))
    clean = [F.col(c) == 0 for c in ("gold_differs", "input_differs", "gold_illegal", "predictions_illegal")]
    sound = F.lit(True)
    for x in [*clean, *close, *exact, *sizes]:
        sound = sound & x
    return counted.withColumn("sound", sound)


def merged_shards(expected: DataFrame, shards: DataFrame, settings: DataFrame, n: int, legal=None, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(predictions in order of sample_index, one row of metrics) of shards, recomputed from their rows.

    shards(shard, sample_index, predictions array), settings(shard_index, num_shards, samples, k,
    illegal, histogram map).  Missing shards, wrong counts or different settings are errors at once
    (settings has one row for each shard); an index that is missing, extra or repeated when read.
    """
    told = sorted(settings.collect(), key=lambda r: r.shard_index)
    counts = {r["shard"]: r["count"] for r in shards.groupBy("shard").count().collect()}
    if [r.shard_index for r in told] != list(range(n)) or any(r.num_shards != n for r in told):
        raise ValueError("the shards are not those numbered 0 to n - 1 of n")
    if any(counts.get(r.shard_index, 0) != r.samples for r in told):
        raise ValueError("a shard's rows are not as many as it says")
    if len({r.k for r in told}) > 1:
        raise ValueError("the shards were made with different settings")
    merged = by_position(expected, shards.drop("shard"))
    rank = ranked(F.col("predictions"), F.col("gold"), legal, k)
    kept = F.size(filtered(F.col("predictions"), legal or (lambda x: F.lit(True)), k)[1])
    report = merged.withColumn("rank", rank).agg(*metrics(), F.avg(kept).alias("avg_unique_predictions"))
    illegal = settings.agg(F.sum("illegal").alias("illegal_predictions"))
    report = report.crossJoin(F.broadcast(illegal)).withColumns({"num_shards": F.lit(n).cast("long"), "k": F.lit(k).cast("long")})
    return merged.orderBy("sample_index"), report


def artifact_ready(spark, folder: str, files: list[str], report: str = "report.json") -> bool:
    """Whether a stage's folder is whole: each file there and not empty, its report an object of finite numbers."""
    import json

    from ..sources import sinks

    if not sinks.exists(spark, f"{folder}/{report}"):
        return False
    for name in files:
        fs, at = sinks._hadoop(spark, f"{folder}/{name}")
        if not fs.exists(at) or not fs.getContentSummary(at).getLength():
            return False
    try:
        found = json.loads(sinks.read_text(spark, f"{folder}/{report}"))
    except ValueError:
        return False
    return isinstance(found, dict) and bool(found) and sinks.finite(found)

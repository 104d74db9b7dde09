"""How far a sample's history supports its target, from the labels of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight of a sample by its group.
WEIGHTS = {"strong": 1.3, "normal": 1.0, "weak": 0.7}


def _counts(labels: Column) -> Column:
    return F.transform(F.array_distinct(labels), lambda v: F.struct((-F.size(F.filter(labels, lambda x: x == v))).alias("n"), v.alias("label")))


def mode(labels: Column) -> Column:
    """The most frequent label, the smallest of several; null where there is none."""
    return F.array_min(_counts(labels))["label"]


def entropy(labels: Column) -> Column:
    """Entropy over its largest value: 1 without labels, 0 with one label."""
    share = F.transform(_counts(labels), lambda c: -c["n"] / F.size(labels))
    h = F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.ln(p))
    kinds = F.size(F.array_distinct(labels))
    return F.when(kinds == 0, 1.0).when(kinds == 1, 0.0).otherwise(h / F.ln(kinds))


def reliability(labels: Column, gold: Column, support: Column | None = None, window: int = 5, strong: float = 0.55, weak: float = 0.85, tail: int = 0, head: int = 0) -> Column:
    """strong, normal or weak; ``support`` (the target label's samples) and ``tail`` mark rare targets as weak unless seen before."""
    recent = F.slice(labels, F.greatest(F.size(labels) - window, F.lit(0)) + 1, window) if window > 0 else labels
    near, far = (F.size(F.filter(x, lambda v: v == gold)) for x in (recent, labels))
    same = F.coalesce(mode(labels) == gold, F.lit(False))
    last = F.coalesce(F.get(labels, F.size(labels) - 1) == gold, F.lit(False))
    is_strong = (last & ((near >= 2) | (entropy(labels) <= strong) | same)) | ((near >= 2) & same)
    is_weak = (near == 0) & (entropy(labels) >= weak)
    if support is not None and tail > 0:
        is_weak = is_weak | ((support <= tail) & (far == 0))
    return F.when(is_strong, "strong").when(is_weak, "weak").otherwise("normal")


def weight(group: Column) -> Column:
    return F.coalesce(*[F.when(group == g, w) for g, w in WEIGHTS.items()])


def summary(samples: DataFrame, group: str = "reliability") -> DataFrame:
    """reliability, samples, ratio, raw_weight_mean, weight_mean of all three groups; weights are normalised by their mean."""
    spark = samples.sparkSession
    n = samples.groupBy(F.col(group).alias("reliability")).agg(F.count("*").alias("samples"))
    groups = spark.createDataFrame(list(WEIGHTS.items()), "reliability string, w double")
    every = groups.join(n, "reliability", "left").withColumn("samples", F.coalesce("samples", F.lit(0)))
    total = every.agg(F.sum("samples").alias("all"), F.sum(F.col("samples") * F.col("w")).alias("mass"))
    seen = F.when(F.col("samples") > 0, F.col("w")).otherwise(0.0)
    one = every.crossJoin(F.broadcast(total))  # three rows and one
    return one.select("reliability", "samples", (F.col("samples") / F.greatest("all", F.lit(1))).alias("ratio"), seen.alias("raw_weight_mean"), F.coalesce(seen / F.nullif(F.col("mass") / F.col("all"), F.lit(0.0)), F.lit(0.0)).alias("weight_mean"))

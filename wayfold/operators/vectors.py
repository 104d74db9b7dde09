"""Vector quantisation: residual k-means codes and coordinate regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def residual_codes(vectors: DataFrame, layers: int, k: int, seed: int = 2024) -> DataFrame:
    """pid, code array<int>: each layer clusters what the layers above left over; vectors(pid, v)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    state = vectors.select("pid", F.transform("v", lambda x: x.cast("double")).alias("v"), F.array().cast("array<int>").alias("code"))
    for layer in range(layers):
        # centres are k small vectors, so they travel as literals
        model = KMeans(k=k, seed=seed + layer, featuresCol="x", predictionCol="c").fit(state.withColumn("x", array_to_vector("v")))
        centres = F.array(*[F.array(*[F.lit(float(x)) for x in centre]) for centre in model.clusterCenters()])
        state = model.transform(state.withColumn("x", array_to_vector("v"))).select("pid", F.zip_with("v", F.get(centres, F.col("c")), lambda a, b: a - b).alias("v"), F.concat("code", F.array("c")).alias("code"))
    return state.select("pid", F.array_join(F.transform("code", lambda x: x.cast("string")), ",").alias("code"))


def regions(places: DataFrame, k: int, seed: int = 2024) -> DataFrame:
    """pid, region: k-means over z-scored coordinates."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    one = places.agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for f, n in ((F.avg, "a"), (F.stddev_pop, "s"))]).first()
    z = places.withColumn("x", array_to_vector(F.array(*[(F.col(c) - one[f"a_{c}"]) / (one[f"s_{c}"] + 1e-12) for c in ("lat", "lon")])))
    return KMeans(k=k, seed=seed, featuresCol="x", predictionCol="region").fit(z).transform(z).select("pid", "region")


def cosine_codes(vectors: DataFrame, books: list[list[list[float]]]) -> DataFrame:
    """pid, code array<int>: each layer takes the entry of largest cosine and subtracts the projection on it (none if negative); vectors(pid, v)."""
    state = vectors.select("pid", F.transform("v", lambda x: x.cast("double")).alias("v"), F.array().cast("array<int>").alias("code"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    for book in books:
        # a book is a parameter of few entries, so its directions travel as literals
        norms = [max(sum(x * x for x in row) ** 0.5, 1e-8) for row in book]
        directions = F.array(*[F.array(*[F.lit(x / n) for x in row]) for row, n in zip(book, norms)])
        sims = state.withColumn("sims", F.transform(directions, lambda d: dot(F.col("v"), d)))
        best = sims.withColumn("best", (F.array_position("sims", F.array_max("sims")) - 1).cast("int"))
        along = F.greatest(F.get("sims", F.col("best")), F.lit(0.0))
        state = best.select("pid", F.zip_with("v", F.get(directions, F.col("best")), lambda x, d: x - along * d).alias("v"), F.concat("code", F.array("best")).alias("code"))
    return state.select("pid", "code")


def sinkhorn(cells: DataFrame, epsilon: float, rounds: int, save) -> DataFrame:
    """r, c, q: exp(-d / epsilon) with rows, then in turn columns and rows, scaled to sum 1; cells(r, c, d).

    Each step reads its input twice, so ``save(df, name)`` cuts lineage before it.
    """
    d = F.greatest(F.least(F.col("d"), F.lit(1e3)), F.lit(-1e3))
    q = cells.select("r", "c", F.exp(-d / (epsilon + 1e-8)).alias("q"))
    for step, key in enumerate(["r"] + ["c", "r"] * rounds):
        q = save(q, f"scaled-{step}")
        q = q.join(q.groupBy(key).agg(F.sum("q").alias("s")), key).select("r", "c", (F.col("q") / (F.col("s") + 1e-8)).alias("q"))
    return q

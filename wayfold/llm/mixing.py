"""Mixing sources to target weights by iterative proportional fitting.

Token counts of the (source, language, topic) cells are raked until the mixture's source, language
and topic marginals meet their targets within ``TOLERANCE``, or for ``ROUNDS`` rounds; a cell's weight
times one scale is the probability with which each of its documents is kept, capped at 1, and the
scale is calibrated so that the expected tokens of the sample meet the budget.  A document is drawn by
a hash of its id, so the sample is the same on every run and a larger budget only adds documents.

Targets are shares of values by axis, for any of the axes; a value that they do not name gets none.
An axis without targets takes sources and languages at the power ``POWER`` of their tokens (rare ones
gain) and topics alike.  Topics are learned from all documents: k-means over unit vectors of the root
counts of their long words in ``BUCKETS`` hash classes.

Cells are pre-aggregated counts.  Up to ``DRIVER_CELLS`` of them are raked in arrays on the driver,
more by the same steps as DataFrames.

Defined results: null source or language is a category of its own; a text without words has no
tokens, a zero vector and the weight of its cell; equal distances go to the first topic; rows of one
doc_id are drawn alike, each by its own cell; a null doc_id is drawn by the hash of nothing; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import lloyd
from .scratch import BROADCAST_IDS, Scratch
from .textkit import U64, Batch, slices, to_bytes

TOPICS, POWER, BUDGET, ROUNDS, DRIVER_CELLS, SEED = 8, 0.7, 0.5, 200, 100_000, 3
TOLERANCE, BUCKETS, LEARNING = 1e-7, 32, 4
AXES = ("source", "lang", "topic")
LONG_WORD = 6


def _measured(batches):
    import pyarrow as pa

    for whole in batches:
        for batch in slices(whole):
            words = Batch(to_bytes(batch.column("text")), lower=True)
            n = np.diff(words.offsets)
            owner = np.repeat(np.arange(batch.num_rows), n)
            long = (words.ends - words.starts) >= LONG_WORD
            group = (words.hashes >> U64(59)).astype(np.int64) % BUCKETS
            counts = np.bincount((owner * BUCKETS + group)[long], minlength=batch.num_rows * BUCKETS).reshape(-1, BUCKETS)
            root = np.sqrt(counts)
            x = np.round(root / np.maximum(np.linalg.norm(root, axis=1, keepdims=True), 1e-9), 6)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * BUCKETS, pa.int32()), pa.array(x.ravel()))
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "source", "lang")), vectors, pa.array(n, pa.int64())], ["doc_id", "source", "lang", "x", "n_tokens"])


def measured(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic (learned), n_tokens (words) of every row."""
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string"))
    rows = chosen.mapInArrow(_measured, "doc_id long, source string, lang string, x array<double>, n_tokens long")
    rows = scratch.save(rows.withColumn("id", F.monotonically_increasing_id()).withColumn("g", F.lit(0)), "vectors")
    one = docs.sparkSession.createDataFrame([(0, TOPICS)], "g int, k int")
    found = lloyd(rows, one, LEARNING)
    return found.select("doc_id", "source", "lang", F.col("c").cast("long").alias("topic"), "n_tokens")


def _targets(axis: str, names: list, tokens: np.ndarray, targets: dict) -> np.ndarray:
    """The shares wanted of an axis' values, in order of ``names``."""
    if axis in targets:
        share = np.array([float(targets[axis].get(x, 0.0)) for x in names])
    else:
        share = (tokens > 0).astype(float) if axis == "topic" else np.power(tokens, POWER)
    share = np.where(tokens > 0, share, 0.0)
    return share / max(share.sum(), 1e-300)


def _rake_arrays(rows: list, budget: float, targets: dict) -> list[tuple]:
    tokens = np.array([r.tokens for r in rows], float)
    codes, goals = [], []
    for a in AXES:
        names = sorted({r[a] for r in rows}, key=lambda x: (x is not None, x if x is not None else 0))
        at = {x: i for i, x in enumerate(names)}
        codes.append(np.array([at[r[a]] for r in rows]))
        goals.append(_targets(a, names, np.bincount(codes[-1], tokens, len(names)), targets))
    total = tokens.sum()
    weight = np.ones(len(rows))
    for _ in range(ROUNDS):
        worst = 0.0
        for code, goal in zip(codes, goals):
            now = np.bincount(code, weight * tokens, len(goal)) / max(total, 1e-300)
            worst = max(worst, float(np.abs(now - goal).max()))
            weight *= np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[code]
        if worst < TOLERANCE:
            break
    low, high = 0.0, 1.0
    while high < 1e12 and np.minimum(1, weight * high) @ tokens < budget * total * (1 - 1e-12) and (weight * high)[weight > 0].min(initial=1) < 1:
        high *= 2
    for _ in range(80):
        scale = (low + high) / 2
        low, high = (scale, high) if np.minimum(1, weight * scale) @ tokens < budget * total else (low, scale)
    return [(*(r[a] for a in AXES), float(w), float(min(1, w * high))) for r, w in zip(rows, weight)]


def _rake_frames(scratch: Scratch, cells: DataFrame, budget: float, targets: dict) -> DataFrame:
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    state = cells.withColumn("weight", F.lit(1.0))
    goals = {}
    for axis in AXES:
        sums = cells.groupBy(axis).agg(F.sum("tokens").alias("t"))
        share = F.when(F.col("t") > 0, 1.0).otherwise(0.0) if axis == "topic" else F.pow("t", F.lit(POWER))
        if axis in targets:
            kind = cells.schema[axis].dataType.simpleString()
            told = scratch.spark.createDataFrame([(k, float(v)) for k, v in targets[axis].items()], f"told {kind}, wanted double")
            sums = sums.join(F.broadcast(told), sums[axis].eqNullSafe(told.told), "left")
            share = F.when(F.col("t") > 0, F.coalesce("wanted", F.lit(0.0))).otherwise(0.0)
        sums = sums.withColumn("share", share)
        goals[axis] = scratch.save(sums.select(F.col(axis).alias("k"), (F.col("share") / F.lit(sums.agg(F.sum("share")).first()[0] or 1.0)).alias("goal")), f"goal-{axis}")
    for step in range(ROUNDS):
        gaps = []
        for axis in AXES:
            now = state.groupBy(F.col(axis).alias("k2")).agg((F.sum(F.col("weight") * F.col("tokens")) / total).alias("now"))
            met = now.join(goals[axis], now.k2.eqNullSafe(goals[axis].k))
            if step:
                # what the round before left over
                gaps.append(met.agg(F.max(F.abs(F.col("now") - F.col("goal")))).first()[0] or 0.0)
            factor = met.select("k", F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(0.0).alias("f"))
            state = state.join(factor, state[axis].eqNullSafe(factor.k), "left").withColumn("weight", F.col("weight") * F.coalesce("f", F.lit(0.0))).drop("k", "f")
        state = scratch.save(state, f"round-{step}")
        if step > 1:
            scratch.drop(f"round-{step - 2}")
        if gaps and max(gaps) < TOLERANCE:
            break
    held = lambda scale: state.agg(F.sum(F.least(F.lit(1.0), F.col("weight") * scale) * F.col("tokens"))).first()[0] or 0.0
    low, high, most = 0.0, 1.0, state.agg(F.sum(F.when(F.col("weight") > 0, F.col("tokens")))).first()[0] or 0
    while high < 1e12 and held(high) < min(budget * total, most) * (1 - 1e-12):
        high *= 2
    for _ in range(40):
        scale = (low + high) / 2
        low, high = (scale, high) if held(scale) < budget * total else (low, scale)
    return state.select(*AXES, "weight", F.least(F.lit(1.0), F.col("weight") * high).alias("probability"))


def draw(key: str = "doc_id") -> Column:
    """A number in [0, 1) fixed by the id."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def mix_sources(docs: DataFrame, budget: float = BUDGET, driver_cells: int = DRIVER_CELLS, targets: dict | None = None) -> DataFrame:
    """``targets`` has shares of values for some axes, as {"source": {"web": 2, "books": 1}}.

    doc_id, source, lang, topic, n_tokens, weight, probability, selected of every document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    targets = targets or {}
    if unknown := set(targets) - set(AXES):
        raise ValueError(f"no axis {unknown}")
    rows = scratch.save(measured(scratch, docs), "measured")
    cells = scratch.save(rows.groupBy(*AXES).agg(F.sum("n_tokens").alias("tokens")), "cells")
    n = cells.limit(driver_cells + 1).count()
    schema = "source string, lang string, topic long, weight double, probability double"
    raked = spark.createDataFrame(_rake_arrays(cells.collect(), budget, targets) if n else [], schema) if n <= driver_cells else scratch.save(_rake_frames(scratch, cells, budget, targets), "raked")
    raked = raked.select(*[F.col(a).alias(f"cell_{a}") for a in AXES], "weight", "probability")
    same = [rows[a].eqNullSafe(raked[f"cell_{a}"]) for a in AXES]
    joined = rows.join(F.broadcast(raked) if n <= min(driver_cells, BROADCAST_IDS) else raked, same[0] & same[1] & same[2], "left")
    return joined.select("doc_id", *AXES, "n_tokens", "weight", "probability", (draw() < F.col("probability")).alias("selected"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.withColumns({c: F.round(c, 9) for c in ("weight", "probability")})

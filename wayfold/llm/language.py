"""Hierarchical language identification: a family first, then one-versus-one linear SVMs inside it.

A text is a vector of hashed byte pairs and triples of its letters (root counts, unit length).
Languages are grouped into families by average linkage of their mean training vectors; families are
told apart one against the rest, languages of a family by a vote of pairwise machines.  Machines are
L2-loss linear SVMs trained by dual coordinate descent on a bounded sample, at most ``SAMPLE``
labelled documents of each language picked by a hash of doc_id; predictions cover every text.

Defined results: a null text, or one without any letter, is ``und`` with score 0 (digits, signs and
numerals such as a superscript two are no letters); with no labelled rows every text is; rows without
a label never train; repeated rows train and are predicted each; a null doc_id is held out of nothing
and trains nothing; equal votes go to the language that comes first in its family; long texts are
read whole; other columns pass or are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import slices, to_bytes

SAMPLE, DIMENSIONS, EPOCHS, COST = 400, 1 << 13, 30, 4.0
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def vector(text: bytes) -> np.ndarray:
    data = _FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]
    capital = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
    data[1:][capital] += 32
    blank = data == 32
    data = data[~(blank & np.concatenate([[False], blank[:-1]]))].astype(np.uint32)
    pairs = data[:-1] << 8 | data[1:]
    triples = pairs[:-1] << 8 | data[2:]
    codes = np.concatenate([pairs * np.uint32(0x9E3779B1), triples * np.uint32(0x85EBCA6B) + np.uint32(1)])
    counts = np.bincount(codes >> np.uint32(32 - 13), minlength=DIMENSIONS)
    root = np.sqrt(counts).astype(np.float32)
    return root / max(1.0, float(np.sqrt(counts.sum())))


def _machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (bias last) of a binary L2-loss SVM, y in -1, 1; classes weighted to equal mass."""
    x = np.hstack([x, np.full((len(x), 1), 0.3, np.float32)])
    share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    damp = 1 / (2 * COST * share)
    diagonal = (x * x).sum(1) + damp
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1], np.float32)
    random = np.random.default_rng(9)
    for _ in range(EPOCHS):
        for i in random.permutation(len(x)):
            step = (y[i] * float(x[i] @ w) - 1 + damp[i] * alpha[i]) / diagonal[i]
            new = max(0.0, alpha[i] - step)
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    w[-1] *= 0.3
    return w


def families(means: dict[str, np.ndarray]) -> list[list[str]]:
    """Languages grouped to about the root of their number by average linkage of mean vectors."""
    groups = [[name] for name in sorted(means)]
    while len(groups) > max(1, round(len(means) ** 0.5)):
        best = max(
            ((np.mean([means[a] @ means[b] for a in groups[i] for b in groups[j]]), -i, -j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        )
        i, j = -best[1], -best[2]
        groups[i] += groups.pop(j)
    return groups


@dataclass
class Model:
    groups: list[list[str]]
    weights: np.ndarray
    first: list[int]
    pairs: list[list[tuple[int, int, int]]]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        n = len(x)
        sure = 1 / (1 + np.exp(-3 * np.clip(margins, -9, 9)))
        family = np.zeros(n, int) if len(self.groups) == 1 else margins[:, self.first].argmax(1)
        score = np.ones(n) if len(self.groups) == 1 else sure[:, self.first].max(1)
        names = []
        for i in range(n):
            group, votes = self.groups[family[i]], None
            votes = np.zeros(len(group))
            for a, b, k in self.pairs[family[i]]:
                votes[a] += sure[i, k]
                votes[b] += 1 - sure[i, k]
            best = int(votes.argmax())
            if len(group) > 1:
                score[i] *= votes[best] / (len(group) - 1)
            names.append(group[best])
        return names, np.clip(score, 0, 1)


def fit(x: np.ndarray, labels: list[str]) -> Model:
    labels = np.array(labels)
    means = {}
    for name in sorted(set(labels.tolist())):
        mean = x[labels == name].mean(0)
        means[name] = mean / max(1e-9, float(np.linalg.norm(mean)))
    groups = families(means)
    weights, first, pairs = [], [], []
    for group in groups:
        if len(groups) > 1:
            first.append(len(weights))
            weights.append(_machine(x, np.where(np.isin(labels, group), 1.0, -1.0)))
    for group in groups:
        own = []
        for a in range(len(group)):
            for b in range(a + 1, len(group)):
                pick = (labels == group[a]) | (labels == group[b])
                own.append((a, b, len(weights)))
                weights.append(_machine(x[pick], np.where(labels[pick] == group[a], 1.0, -1.0)))
        pairs.append(own)
    matrix = np.array(weights, np.float32) if weights else np.zeros((1, DIMENSIONS + 1), np.float32)
    return Model(groups, matrix, first, pairs)


def _vectors(batches):
    import pyarrow as pa

    for whole in batches:
        for batch in slices(whole):
            found = [vector(t) for t in to_bytes(batch.column("text"))]
            yield pa.record_batch([batch.column("lang"), pa.array([v.astype(np.float16).tobytes() for v in found], pa.binary())], ["lang", "vector"])


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from labelled(doc_id, text, lang); the sample is bounded, the rest is only counted."""
    rows = labelled.where("lang is not null and text is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    take = F.lit(0)
    for name, n in sorted(counts.items()):
        take = F.when(F.col("lang") == name, int(min(1.0, sample / n) * (1 << 20))).otherwise(take)
    picked = rows.where(place < take).select("text", "lang").mapInArrow(_vectors, "lang string, vector binary").collect()
    if not picked:
        return None
    picked.sort(key=lambda r: (r.lang, bytes(r.vector)))
    x = np.array([np.frombuffer(r.vector, np.float16) for r in picked]).astype(np.float32)
    return fit(x, [r.lang for r in picked])


def _predictor(model: Model | None, others: int):
    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, 2_000_000):
                texts = to_bytes(batch.column("text"))
                real = [i for i, t in enumerate(texts) if model and any(map(str.isalpha, t.decode()))]
                names, scores = ["und"] * len(texts), np.zeros(len(texts))
                for at in range(0, len(real), 256):
                    some = real[at : at + 256]
                    found, sure = model.predict(np.array([vector(texts[i]) for i in some]))
                    for i, name, s in zip(some, found, sure):
                        names[i], scores[i] = name, float(s)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(others)), pa.array(names), pa.array(scores)], [*batch.schema.names[:others], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs with lang_pred and score of its column text."""
    chosen = docs.select(*keep, *(["text"] if "text" not in keep else []))
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return chosen.mapInArrow(_predictor(model, len(keep)), f"{fields}, lang_pred string, score double")


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def identify(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Trains on the rows that are not held out and predicts all."""
    labelled = docs.where(~held_out()).select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
    return predict(docs, train(labelled), keep)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")

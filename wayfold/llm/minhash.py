"""Near duplicates by circulant MinHash, banding, and confirmation on full shingle sets.

Two fixed permutations of a universe of 2^20 places serve for all coordinates: the first scatters a
shingle's hash, the second, shifted circularly by k, gives coordinate k.  A shingle's coordinates
are therefore one contiguous slice of the second table, and a signature is a running minimum of
such slices.

Steps: sketch every text; texts with equal shingle sets form a class and its smallest id stands for
it; in each bucket of a band every member is compared with the bucket's smallest id only (a star,
never all pairs); confirmed links give components; documents of a bucket that still holds several
components are compared by an exact prefix join of their full sets, so that no link is lost to the
star.  24 bands of 4 rows miss a pair of similarity 0.8 with probability 3e-6.

Defined results: a null or blank text has no shingles, is its own component and is kept; a text of
fewer words than a shingle has one shingle, the whole sequence; repeated rows with one id count as
one document; a row without doc_id is never kept and links nothing; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, with_ids
from .textkit import _PLACES, U64, Batch, mix, slices, to_bytes, window_hashes

UNIVERSE_BITS = 20
BANDS, ROWS = 24, 4
#: Words of 64 bits in a parity map; a longer map tells more pairs of long texts apart.
MAPS = 8
#: Rows held in a task before their prefixes are cut.
PREFIX_ROWS = 500_000
#: Components settle in a few rounds; a chain of n links needs about log2(n).
MAX_ROUNDS = 60

_tables: list[np.ndarray] = []


def _permutations() -> list[np.ndarray]:
    if not _tables:
        random = np.random.default_rng(20)
        first = random.permutation(1 << UNIVERSE_BITS).astype(np.uint32)
        second = random.permutation(1 << UNIVERSE_BITS).astype(np.uint32)
        ring = np.concatenate([second, second[: BANDS * ROWS]])
        _tables.extend([first, np.lib.stride_tricks.sliding_window_view(ring, BANDS * ROWS)])
    return _tables


def shingle_set(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter sequence is one shingle, an empty one has none."""
    if not len(word_hashes):
        return np.zeros(0, U64)
    found = np.sort(window_hashes(word_hashes, min(width, len(word_hashes))))
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def signature(shingles: np.ndarray) -> np.ndarray:
    first, ring = _permutations()
    at = first[(shingles >> U64(64 - UNIVERSE_BITS)).astype(np.int64)]
    return np.minimum.reduce([ring[at[i : i + 256]].min(axis=0) for i in range(0, len(at), 256)])


_BAND_SALT = np.arange(BANDS, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """The bucket of each band, for rows of signatures."""
    rows = sigs.astype(U64).reshape(len(sigs), BANDS, ROWS)
    return mix(mix((rows * _PLACES[:ROWS]).sum(axis=2, dtype=U64)) + _BAND_SALT)


def _sketcher(width: int):
    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole):
                words = Batch(to_bytes(batch.column("text")), lower=True)
                sizes, keys, sigs = [], [], []
                for i in range(batch.num_rows):
                    found = shingle_set(words.of(i), width)
                    sizes.append(len(found))
                    keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    if len(found):
                        sigs.append(signature(found))
                buckets = band_keys(np.array(sigs, np.uint32).reshape(len(sigs), BANDS * ROWS)).view(np.int64).ravel()
                real = np.array(sizes) > 0
                # a list's offset is null where the list is
                offsets = pa.array(np.append(np.cumsum(real) - real, len(sigs)) * BANDS, pa.int32(), mask=np.append(~real, False))
                yield pa.record_batch(
                    [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(buckets))],
                    ["doc_id", "n_shingles", "set_key", "bands"],
                )

    return run


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets), bands (one bucket key for each band)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _sketcher(width), "doc_id long, n_shingles long, set_key binary, bands array<long>"
    )


def _confirmer(width: int, percent: int):
    def run(batches):
        import pyarrow as pa

        last: dict[int, np.ndarray] = {}
        for whole in batches:
            for batch in slices(whole):
                columns = [batch.column(i).to_pylist() for i in (0, 1)]
                sides = [Batch(to_bytes(batch.column(i)), lower=True) for i in (2, 3)]
                keep = []
                for i, a in enumerate(columns[0]):
                    if a not in last:
                        last = {a: shingle_set(sides[0].of(i), width)}
                    x, y = last[a], shingle_set(sides[1].of(i), width)
                    both = np.concatenate([x, y])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs(a, b) those whose full shingle sets meet the threshold."""
    sides = [texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab"]
    both = pairs.select("a", "b").join(sides[1], "b").join(sides[0], "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_confirmer(width, percent), "a long, b long")


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """id, component (smallest id reachable) of every id in links(a, b), by alternating star contraction.

    Each round hangs every neighbour and the node itself on the smallest of them (large stars, then
    small stars); the edges written after each round cut the lineage.  Grouping pre-aggregates, so a
    hub's links never meet in one task.
    """
    edges = scratch.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), f"{name}-0")

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        met = both.join(least, "u")
        if large:
            return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        hung = met.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return hung.union(least.where("u != m").select("u", F.col("m").alias("v"))).where("u != v").distinct()

    before = None
    for step in range(1, MAX_ROUNDS):
        edges = scratch.save(star(star(edges, True), False), f"{name}-{step}")
        if step > 1:
            scratch.drop(f"{name}-{step - 2}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))


def _shingle_rows(width: int):
    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, 1_000_000):
                words = Batch(to_bytes(batch.column("text")), lower=True)
                sets = [shingle_set(words.of(i), width) for i in range(batch.num_rows)]
                n = np.array([len(x) for x in sets], np.int64)
                if n.sum():
                    ids, parts = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), n) for c in ("doc_id", "component"))
                    yield pa.record_batch([ids, parts, np.repeat(n, n), np.concatenate(sets).view(np.int64)], ["doc_id", "component", "n", "shingle"])

    return run


def _prefixes(percent: int):
    """Prefix entries of each document with its first place and parity maps; a document's rows come one after another."""
    names = ["doc_id", "component", "n", "first", *(f"map{k}" for k in range(MAPS)), "place", "shingle"]

    def cut(doc, component, n, df, shingle):
        import pyarrow as pa

        order = np.lexsort((shingle, df, doc))
        doc, component, n, shingle = (x[order] for x in (doc, component, n, shingle))
        begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        size = np.diff(np.append(begin, len(doc)))
        first = n[begin] - size
        flip = np.left_shift(U64(1), shingle.view(U64) >> U64(6) & U64(63))
        maps = [np.bitwise_xor.reduceat(np.where(shingle % MAPS == k, flip, U64(0)), begin).view(np.int64) for k in range(MAPS)]
        taken = n[begin] + (-n[begin] * percent // 100) + 1 - first
        place = np.arange(len(doc)) - np.repeat(begin, size)
        pick = place < np.repeat(taken, size)
        own = [np.repeat(x, size)[pick] for x in (first, *maps)]
        columns = [doc[pick], component[pick], n[pick], *own, own[0] + place[pick], shingle[pick]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

    def run(batches):
        kept, size, limit = [], 0, PREFIX_ROWS
        for batch in batches:
            kept.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)])
            size += batch.num_rows
            if size >= limit:
                rows = [np.concatenate(x) for x in zip(*kept)]
                # the last document may go on
                end = int(np.flatnonzero(rows[0] != rows[0][-1])[-1]) + 1 if rows[0][0] != rows[0][-1] else 0
                if end:
                    yield cut(*(x[:end] for x in rows))
                kept, size = [[x[end:] for x in rows]], size - end
                limit = max(PREFIX_ROWS, 2 * size)
        if size:
            yield cut(*(np.concatenate(x) for x in zip(*kept)))

    return run


def prefix_pairs(texts: DataFrame, labels: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may meet the threshold; none that does is left out.

    Shingles are ordered globally: first those of one component only (they match nothing elsewhere),
    then by rising document frequency.  Two sets of the similarity asked for share a shingle in the
    first n - ceil(t n) + 1 places, and at the first one they share enough places must be left.  What
    two sets do not share is at least their shingles of one component only and the bits in which the
    parity maps of the others differ (one bit for each shingle, flipped by it); a pair for which that
    is too much is not emitted, so a large group of texts just below the threshold makes few pairs.
    """
    rows = texts.join(labels, "doc_id").select("doc_id", "component", "text").mapInArrow(
        _shingle_rows(width), "doc_id long, component long, n long, shingle long"
    )
    spread = rows.groupBy("shingle").agg(F.count("*").alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
    met = rows.join(spread.select("shingle", "df"), "shingle")
    # grouped by an exchange and a sort: an aggregate of lists would merge nothing before the exchange
    listed = met.select("doc_id", "component", "n", "df", "shingle").repartition("doc_id").sortWithinPartitions("doc_id")
    longs = ", ".join(f"{c} long" for c in ("doc_id", "component", "n", "first", *(f"map{k}" for k in range(MAPS)), "place", "shingle"))
    entry = Scratch(texts.sparkSession, "prefix").save(listed.mapInArrow(_prefixes(percent), longs), "entries")
    a, b = entry.alias("a"), entry.alias("b")
    need = F.ceil((F.col("a.n") + F.col("b.n")) * percent / (100 + percent))
    enough = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place")) >= need
    close = (F.col("a.n") * 100 >= F.col("b.n") * percent) & (F.col("b.n") * 100 >= F.col("a.n") * percent)
    apart = F.col("a.first") + F.col("b.first")
    for k in range(MAPS):
        apart = apart + F.bit_count(F.col(f"a.map{k}").bitwiseXOR(F.col(f"b.map{k}")))
    alike = apart <= F.col("a.n") + F.col("b.n") - need * 2
    on = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.doc_id") < F.col("b.doc_id")) & (F.col("a.component") != F.col("b.component")) & close & enough & alike
    return a.join(b, on).select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, kept for every document (smallest id of each component kept)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sketch = scratch.save(sketches(docs, width), "sketch")
    full = sketch.where("set_key is not null and doc_id is not null")
    classes = scratch.save(full.groupBy("set_key").agg(F.min("doc_id").alias("class_id"), F.first("bands").alias("bands")), "classes")
    buckets = classes.select(F.col("class_id").alias("doc_id"), F.explode("bands").alias("bucket"))
    shared = scratch.save(buckets.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1").select("bucket", "a"), "shared")
    members = scratch.save(buckets.join(shared, "bucket"), "members")
    stars = scratch.save(members.where("doc_id != a").select("a", F.col("doc_id").alias("b")).distinct(), "stars")
    texts = scratch.save(with_ids(docs, members.select("doc_id")).dropDuplicates(["doc_id"]), "texts")
    links = scratch.save(confirmed(stars, texts, width, percent), "links")
    labels = components(scratch, links, "first").withColumnRenamed("id", "doc_id")
    labels = scratch.save(members.select("doc_id").distinct().join(labels, "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component")), "labels")
    labelled = members.select("bucket", "doc_id").join(labels, "doc_id")
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
    rest = scratch.save(labelled.join(mixed, "bucket", "left_semi").select("doc_id").distinct(), "rest")
    pairs = scratch.save(prefix_pairs(with_ids(texts, rest), labels, width, percent), "pairs")
    more = scratch.save(links.union(confirmed(pairs, texts, width, percent)), "more")
    final = scratch.save(components(scratch, more, "last"), "final")
    named = classes.join(final, classes.class_id == final.id, "left").select("set_key", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    result = sketch.drop("bands").join(named, "set_key", "left")
    result = result.withColumns({c: F.coalesce(c, "doc_id") for c in ("class_id", "component_id")})
    return result.select("doc_id", "n_shingles", "class_id", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, width=4, percent=80)

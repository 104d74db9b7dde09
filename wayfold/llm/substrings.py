"""Exact substring removal with a log-structured fingerprint index.

Every window of ``window`` words has one anchor: the smallest of the hashes of its inner runs of
``inner`` words, so equal windows have equal anchors and about one place in seven is an anchor.
The index keeps anchors, not all windows.  Documents come in batches of rising doc_id; a batch is
written as an immutable run of segments (anchor hashes of one hash range, sorted, with the documents
that hold them), merge-joined with the segments of all earlier runs and of its own; a batch that finds
``fan_in`` runs has them compacted into one first, and their files are dropped.  The stable sort of a
range's concatenated segments is a merge, since it takes up sorted stretches as they are.  An index
in a folder of its own outlives its session: runs and settings stand in a manifest there, written
after each run, and ``open`` goes on from it.  Documents with a shared anchor,
old or new, are verified: the full hashes of exactly the windows of those anchors are compared, and
a window is a repeat if its words start earlier (smaller doc_id, or earlier in the document).

A hash that many documents share travels once for each chunk of documents, since the chunk itself
knows all but its first holder to be repeats; no list of holders is ever gathered.

Defined results: null, blank and short texts have no windows and lose nothing; rows that share a
doc_id come one after another in order of their texts, so the first to hold a window keeps it; a row
without doc_id loses only what repeats inside it; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks
from .scratch import Scratch, hash_ranges, with_ids
from .textkit import U64, Batch, slices, to_bytes, window_hashes

WINDOW, INNER = 20, 8
#: Batches in which the query feeds a table to the index, and runs at which they are compacted: the last batch meets a compacted run.
BATCHES, FAN_IN = 3, 2
#: Entries of a compacted segment at most; a run may have several segments for one hash range.
SEGMENT = 2_000_000
RUN = "part int, run int, hashes binary, many binary, docs binary, holders binary"


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[: len(values) - have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(word_hashes: np.ndarray, window: int, inner: int) -> np.ndarray:
    """The anchor of each window of a text, in order of their starts."""
    if len(word_hashes) < window:
        return np.zeros(0, U64)
    return _sliding_min(window_hashes(word_hashes, inner), window - inner + 1)


def _distinct(values: np.ndarray) -> np.ndarray:
    if not len(values):
        return values
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])]


def _cuts(values: np.ndarray, n_parts: int) -> np.ndarray:
    """Where each hash range begins among sorted hashes: n_parts equal ranges of 64 bits."""
    edges = (np.arange(1, n_parts, dtype=object) * (2**64 // n_parts)).astype(U64)
    return np.concatenate([[0], np.searchsorted(values, edges), [len(values)]]).astype(np.int64)


def _starts(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _run_writer(window: int, inner: int, n_parts: int, run: int):
    def write(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, 8_000_000):
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                words = Batch(to_bytes(batch.column("text")))
                hashes, owner, again = [], [], []
                for i in range(len(ids)):
                    found = anchors(words.of(i), window, inner)
                    if not len(found):
                        continue
                    # an anchor that comes back after another one, or whose windows reach too far, may hide a repeat inside the text
                    changes = found[_starts(found)]
                    own = np.sort(changes)
                    first = _starts(own)
                    hashes.append(own[first])
                    owner.append(np.full(len(first), i, np.uint32))
                    again.append(np.diff(np.append(first, len(own))) > 1)
                    spans = np.diff(np.append(_starts(found), len(found)))
                    if (long := changes[spans > window - inner + 1]).size:
                        again[-1] |= np.isin(own[first], long)
                if not hashes:
                    continue
                h, o, m = (np.concatenate(x) for x in (hashes, owner, again))
                order = np.argsort(h, kind="stable")
                h, o, m = h[order], o[order], m[order]
                first = _starts(h)
                sizes = np.diff(np.append(first, len(h)))
                many = (sizes > 1) | np.logical_or.reduceat(m, first)
                cuts = _cuts(h[first], n_parts)
                places = np.append(first, len(h))
                rows = []
                for p in range(n_parts):
                    a, b = cuts[p], cuts[p + 1]
                    if a < b:
                        x, y = places[a], places[b]
                        rows.append((p, run, h[first[a:b]].tobytes(), many[a:b].tobytes(), ids[o[x:y]].tobytes(), sizes[a:b].astype(np.uint32).tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), *[pa.binary()] * 4))], ["part", "run", "hashes", "many", "docs", "holders"])

    return write


def _shared(run: int):
    """Merge of one hash range: the anchors that run ``run`` shares with itself or with earlier runs."""

    def merge(table):
        import pyarrow as pa

        hashes = [np.frombuffer(x, U64) for x in table.column("hashes").to_pylist()]
        many = np.concatenate([np.frombuffer(x, bool) for x in table.column("many").to_pylist()])
        new = np.repeat(np.array(table.column("run").to_pylist()) == run, [len(x) for x in hashes])
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        h, many, new = h[order], many[order], new[order]
        first = _starts(h)
        count = np.diff(np.append(first, len(h)))
        found = np.logical_or.reduceat(new, first) & ((count > 1) | np.logical_or.reduceat(many, first))
        return pa.table({"part": table.column("part")[:1], "shared": pa.array([h[first][found].tobytes()], pa.binary())})

    return merge


def _dealt(groups: int, docs: np.ndarray, hashes: np.ndarray, fresh: np.ndarray):
    """(doc_id, hash) entries as one row for each group of documents, for ``_gathered``."""
    import pyarrow as pa

    group = (docs.view(U64) * U64(0x9E3779B97F4A7C15) >> U64(33)).astype(np.int64) % groups
    order = np.argsort(group, kind="stable")
    group, docs, hashes, fresh = (x[order] for x in (group, docs, hashes, fresh))
    first = np.append(_starts(group), len(group))
    columns = [pa.array(group[first[:-1]].astype(np.int32))]
    columns += [pa.array([x[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary()) for x in (docs, hashes, fresh)]
    return columns, ["part", "docs", "hashes", "fresh"]


def _gathered(table):
    """One row for each document of a group: doc_id, whether new, all its hashes."""
    import pyarrow as pa

    docs, hashes, fresh = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in (("docs", np.int64), ("hashes", U64), ("fresh", bool)))
    order = np.argsort(docs, kind="stable")
    docs, hashes, fresh = docs[order], hashes[order], fresh[order]
    first = np.append(_starts(docs), len(docs))
    found = [hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
    return pa.table({"doc_id": pa.array(docs[first[:-1]]), "fresh": pa.array(fresh[first[:-1]]), "found": pa.array(found, pa.binary())})


DEALT = "part int, docs binary, hashes binary, fresh binary"
GATHERED = "doc_id long, fresh boolean, found binary"


def _holders(run: int, groups: int):
    """The documents of the segments that hold a shared anchor, with those anchors."""

    def look(batches):
        import pyarrow as pa

        kept, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                shared = np.frombuffer(batch.column("shared")[i].as_py(), U64)
                h = np.frombuffer(batch.column("hashes")[i].as_py(), U64)
                hit = np.isin(h, shared, assume_unique=True)
                if not hit.any():
                    continue
                sizes = np.frombuffer(batch.column("holders")[i].as_py(), np.uint32)
                pick = np.repeat(hit, sizes)
                docs = np.frombuffer(batch.column("docs")[i].as_py(), np.int64)[pick]
                kept.append((docs, np.repeat(h, sizes)[pick], np.full(len(docs), batch.column("run")[i].as_py() == run)))
                size += len(docs)
                if size > SEGMENT:
                    yield pa.record_batch(*_dealt(groups, *(np.concatenate(x) for x in zip(*kept))))
                    kept, size = [], 0
        if kept:
            yield pa.record_batch(*_dealt(groups, *(np.concatenate(x) for x in zip(*kept))))

    return look


def _windows(window: int, inner: int, n_parts: int):
    """Full hashes of the windows of shared anchors: per chunk the first holder goes to the merge
    (part >= 0), and later holders in the chunk are known to be repeats (part = -1)."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, 8_000_000):
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                fresh = batch.column("fresh").to_numpy(zero_copy_only=False)
                words = Batch(to_bytes(batch.column("text")))
                hashes, owner = [], []
                for i, shared in enumerate(batch.column("found").to_pylist()):
                    shared = np.frombuffer(shared, U64)
                    own = words.of(i)
                    own = _distinct(window_hashes(own, window)[np.isin(anchors(own, window, inner), shared)])
                    hashes.append(own)
                    owner.append(np.full(len(own), i, np.int64))
                h, o = np.concatenate(hashes), np.concatenate(owner)
                if not len(h):
                    continue
                order = np.lexsort((ids[o], h))
                h, o = h[order], o[order]
                # rows of one doc_id hold a window once: none of them is later than another
                own = np.concatenate([[True], (h[1:] != h[:-1]) | (ids[o[1:]] != ids[o[:-1]])])
                h, o = h[own], o[own]
                first = np.concatenate([[True], h[1:] != h[:-1]])
                rows = []
                later = ~first & fresh[o]
                mine = np.argsort(o[later], kind="stable")
                known, held = o[later][mine], h[later][mine]
                at = np.append(_starts(known), len(known))
                for a, b in zip(at[:-1], at[1:]):
                    rows.append((-1, int(ids[known[a]]), held[a:b].tobytes(), b"", b""))
                h, o = h[first], o[first]
                cuts = _cuts(h, n_parts)
                for p in range(n_parts):
                    a, b = cuts[p], cuts[p + 1]
                    if a < b:
                        rows.append((p, None, h[a:b].tobytes(), ids[o[a:b]].tobytes(), fresh[o[a:b]].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), *[pa.binary()] * 3))], ["part", "doc_id", "hashes", "docs", "fresh"])

    return run


def _repeats(groups: int):
    """Of one hash range, the new documents whose window an earlier document has, dealt by document."""

    def merge(table):
        import pyarrow as pa

        h, d, f = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in (("hashes", U64), ("docs", np.int64), ("fresh", bool)))
        order = np.lexsort((d, h))
        h, d, f = h[order], d[order], f[order]
        own = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
        h, d, f = h[own], d[own], f[own]
        later = np.concatenate([[False], h[1:] == h[:-1]]) & f
        columns, names = _dealt(groups, d[later], h[later], f[later])
        return pa.table(columns, names)

    return merge


def _compact(into: int):
    """Segments of one hash range merged into few larger ones of ``SEGMENT`` entries at most."""

    def merge(table):
        import pyarrow as pa

        h = [np.frombuffer(x, U64) for x in table.column("hashes").to_pylist()]
        sizes = [np.frombuffer(x, np.uint32) for x in table.column("holders").to_pylist()]
        docs = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("docs").to_pylist()])
        many = np.repeat(np.concatenate([np.frombuffer(x, bool) for x in table.column("many").to_pylist()]), np.concatenate(sizes))
        h = np.repeat(np.concatenate(h), np.concatenate(sizes))
        order = np.lexsort((docs, h))
        rows = []
        for at in range(0, len(h), SEGMENT):
            o = order[at : at + SEGMENT]
            own, first = h[o], _starts(h[o])
            n = np.diff(np.append(first, len(own)))
            rows.append((own[first].tobytes(), ((n > 1) | np.logical_or.reduceat(many[o], first)).tobytes(), docs[o].tobytes(), n.astype(np.uint32).tobytes()))
        columns = [pa.array(c, pa.binary()) for c in zip(*rows)]
        n = len(rows)
        return pa.table([pa.array([table.column("part")[0].as_py()] * n, pa.int32()), pa.array([into] * n, pa.int32()), *columns], ["part", "run", "hashes", "many", "docs", "holders"])

    return merge


class FingerprintIndex:
    """Sorted immutable runs of anchors; ``add`` takes the next batch and says what it repeats.

    Batches must come in order of doc_id.  ``texts`` gives doc_id and text of all documents added so
    far and is read for documents with shared anchors only.  With ``folder`` (in a store that all
    share) the runs stay there for later sessions; without it they go with the session.
    """

    def __init__(self, spark: SparkSession, window: int = WINDOW, inner: int = INNER, fan_in: int = FAN_IN, folder: str | None = None, ranges: int | None = None):
        self.spark, self.scratch, self.folder = spark, Scratch(spark, "substrings"), folder
        self.window, self.inner, self.fan_in, self.parts = window, inner, fan_in, ranges
        self.names, self.runs, self.added = [], [], 0
        if folder and sinks.exists(spark, f"{folder}/manifest.json"):
            raise FileExistsError(f"{folder} holds an index; open it")

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> "FingerprintIndex":
        """The index that an earlier session left in a folder."""
        told = json.loads(sinks.read_text(spark, f"{folder}/manifest.json"))
        found = cls(spark, told["window"], told["inner"], told["fan_in"], None, told["ranges"])
        found.folder, found.names, found.added = folder, told["runs"], told["added"]
        found.runs = [spark.read.schema(RUN).parquet(f"{folder}/{name}") for name in told["runs"]]
        return found

    def _keep(self, run: DataFrame, name: str) -> DataFrame:
        if not self.folder:
            return self.scratch.save(run, name)
        run.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(RUN).parquet(f"{self.folder}/{name}")

    def _listed(self, old: list[str]) -> None:
        """The manifest of the runs that count now; only then files of older ones go."""
        if self.folder:
            told = {"window": self.window, "inner": self.inner, "fan_in": self.fan_in, "ranges": self.parts, "added": self.added, "runs": self.names}
            sinks.write_text(self.spark, f"{self.folder}/manifest.json", json.dumps(told))
        for name in old:
            sinks.remove(self.spark, f"{self.folder or self.scratch.path}/{name}")

    def _index(self) -> DataFrame:
        index = self.runs[0]
        for run in self.runs[1:]:
            index = index.union(run)
        return index

    def add(self, batch: DataFrame, texts: DataFrame) -> DataFrame:
        """doc_id, hashes (binary, 64 bits each) of the windows of the batch that start earlier elsewhere."""
        self.parts = self.parts or hash_ranges(texts)
        if len(self.runs) >= self.fan_in:
            self.compact()
        n, save = self.added, self.scratch.save
        written = batch.where("doc_id is not null").select("doc_id", "text").mapInArrow(_run_writer(self.window, self.inner, self.parts, n), RUN)
        self.runs.append(self._keep(written, f"run-{n}"))
        self.names.append(f"run-{n}")
        self.added += 1
        self._listed([])
        index = self._index()
        shared = index.select("part", "run", "hashes", "many").groupBy("part").applyInArrow(_shared(n), "part int, shared binary")
        shared = save(shared.where(F.length("shared") > 0), f"shared-{n}")
        held = index.join(shared, "part").select("run", "hashes", "docs", "holders", "shared").mapInArrow(_holders(n, self.parts), DEALT)
        held = save(held.groupBy("part").applyInArrow(_gathered, GATHERED), f"held-{n}")
        matched = with_ids(texts.select("doc_id", "text"), held).join(held, "doc_id").select("doc_id", "fresh", "found", "text")
        windows = matched.mapInArrow(_windows(self.window, self.inner, self.parts), "part int, doc_id long, hashes binary, docs binary, fresh binary")
        windows = save(windows, f"windows-{n}")
        across = windows.where("part >= 0").select("part", "hashes", "docs", "fresh").groupBy("part").applyInArrow(_repeats(self.parts), DEALT)
        across = across.groupBy("part").applyInArrow(_gathered, GATHERED).select("doc_id", F.col("found").alias("hashes"))
        found = save(across.union(windows.where("part < 0").select("doc_id", "hashes")), f"found-{n}")
        for name in ("shared", "held", "windows"):
            self.scratch.drop(f"{name}-{n}")
        return found

    def compact(self) -> None:
        """All runs become one, its segments merged within each hash range; the files of the old ones go."""
        # segments of a hash range are dealt to bounded groups, so a hash with very many holders fills several segments
        group = F.floor(F.sum(F.length("docs")).over(_by_part()) / (8 * SEGMENT))
        merged = self._index().withColumn("g", group).groupBy("part", "g").applyInArrow(_dropping_group(_compact(self.added - 1)), RUN)
        old, name = self.names, f"compacted-{self.added}"
        self.runs, self.names = [self._keep(merged, name)], [name]
        self._listed(old)


def _by_part():
    from pyspark.sql import Window

    return Window.partitionBy("part").orderBy("run", F.xxhash64("hashes")).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _dropping_group(merge):
    return lambda table: merge(table.drop_columns(["g"]))


def _remover(window: int, together: bool = False):
    """Texts without repeats; ``together`` takes all rows as one document's, in the order they come."""

    def run(batches):
        import pyarrow as pa

        before = np.zeros(0, U64)
        for whole in batches:
            for batch in slices(whole):
                words = Batch(to_bytes(batch.column("text")))
                lists = batch.column("hashes").to_pylist()
                total, removed, digests, texts = [], [], [], []
                for i in range(batch.num_rows):
                    a, b = words.offsets[i], words.offsets[i + 1]
                    keep = np.ones(b - a, bool)
                    own = window_hashes(words.hashes[a:b], window)
                    if len(own):
                        hit = np.ones(len(own), bool)
                        hit[np.unique(own, return_index=True)[1]] = False
                        if lists[i]:
                            hit |= np.isin(own, np.concatenate([np.frombuffer(x, U64) for x in lists[i]]))
                        if together:
                            hit |= np.isin(own, before)
                            before = np.union1d(before, own)
                        if hit.any():
                            steps = np.zeros(b - a + 1, np.int64)
                            at = np.flatnonzero(hit)
                            np.add.at(steps, at, 1)
                            np.add.at(steps, at + window, -1)
                            keep = np.cumsum(steps[:-1]) == 0
                    left = b" ".join([words.buffer[x:y] for x, y in zip(words.starts[a:b][keep].tolist(), words.ends[a:b][keep].tolist())])
                    total.append(b - a)
                    removed.append(b - a - int(keep.sum()))
                    digests.append(hashlib.sha256(left).hexdigest())
                    texts.append(left)
                yield pa.record_batch(
                    [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests), pa.array(texts, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    return run


def _rows_of_one(window: int):
    """All rows of a doc_id, each without what the ones before it hold."""

    def run(table):
        import pyarrow as pa

        return pa.Table.from_batches(_remover(window, True)(table.sort_by("text").combine_chunks().to_batches()))

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, inner: int = INNER, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text: every document without the windows that start earlier."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    index = FingerprintIndex(spark, window, inner, ranges=hash_ranges(docs))
    cuts = docs.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    found = None
    for i, (lo, hi) in enumerate(zip([None, *cuts], [*cuts, None])):
        batch = docs if lo is None else docs.where(F.col("doc_id") > lo)
        seen = docs if hi is None else docs.where(F.col("doc_id") <= hi)
        rows = index.add(batch if hi is None else batch.where(F.col("doc_id") <= hi), seen)
        found = rows if found is None else found.union(rows)
    repeats = index.scratch.save(found.groupBy("doc_id").agg(F.collect_list("hashes").alias("hashes")), "repeats")
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    none = F.lit(None).cast("array<binary>").alias("hashes")
    several = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    several = index.scratch.save(several, "several")
    single = docs
    if not several.isEmpty():
        single = with_ids(docs, several, keep=False)
    clean = with_ids(single, repeats, keep=False).select("doc_id", "text", none).mapInArrow(_remover(window), out)
    cut = with_ids(single, repeats).join(repeats, "doc_id").select("doc_id", "text", "hashes").mapInArrow(_remover(window), out)
    if single is docs:
        return clean.union(cut)
    rows = with_ids(docs, several).join(repeats, "doc_id", "left").select("doc_id", "text", "hashes")
    return clean.union(cut).union(rows.groupBy("doc_id").applyInArrow(_rows_of_one(window), out))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")

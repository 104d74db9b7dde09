"""Line deduplication by a fixed-depth tree of line templates.

A line's way down the tree is its token count, then its leading ``DEPTH`` tokens; it ends at a leaf.
Tokens with a digit are fields everywhere.  Which other places of a leaf are fields is learned from
counts: a token is constant where at least ``SHARE`` of the leaf's rows, and ``min_docs``, have it at
its place; any other token is a field, in one place or in several neighbouring ones.  So a line has
two templates: its tokens with digits generalised, and the learned one where no more than a third of
the places are fields.  A line recurs if one of them stands in documents of ``min_docs`` classes of
near copies (``WIDTH`` words, ``PERCENT``) or more: lines of copied documents are no boilerplate.
Recurring lines are dropped, whatever their length and their share of a document.

Leaves, tokens of a leaf and templates are hashes.  A template is no more frequent than its leaf, so
the first counts are of leaves alone, for which leading tokens are hashed, and of the templates of
lines that have none; other lines are hashed whole where their leaf is frequent.  Chunks of rows send each of theirs once, with the
number of rows that hold it, to hash ranges, which sum them.  The frequent ones go to all workers
where they take ``BROADCAST_BYTES`` at most (measured), else by joins to the documents that hold
them, with the same result.  Only the lines with a frequent leaf or template are kept for what
follows, and only documents with a template of ``min_docs`` rows are sorted into classes.  The number
of hash ranges follows the size of the input.

Defined results: blank lines are always kept; a line of which every token holds a digit has only
itself as template; rows of one doc_id are judged each and are one document in the count; a row
without doc_id is neither counted nor changed; a null or empty text stays as it is; a document may be
left without a word; templates of equal counts need no order; other columns pass through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .minhash import near_duplicates
from .scratch import Scratch, hash_ranges, with_ids
from .substrings import _cuts, _starts
from .textkit import _PLACES, U64, hash_words, is_space, mix, slices, to_bytes, word_edges, word_hashes

DEPTH, LEAST, MIN_DOCS, SHARE = 2, 4, 10, 0.1
#: One of so many places may be a field in a learned template.
FIELDS = 3
#: Near copies as the pipeline's near-duplicate step takes them.
WIDTH, PERCENT = 5, 80
#: Entries held in a task before they are sent on.
ENTRIES = 2_000_000
#: Bytes of frequent hashes up to which they are broadcast.
BROADCAST_BYTES = 32 << 20
VARIABLE, _N, _LEAF, _PLACE = U64(0x2A), U64(0x9E3779B97F4A7C15), U64((1 << 61) - 1), U64(0xD6E8FEB86659FD93)
_COUNTED = "part int, hashes binary, docs binary, holders binary, least binary"
_DEALT = "part int, docs binary, hashes binary, counts binary"


def _digits(data: np.ndarray) -> np.ndarray:
    """The places of the digits 0-9."""
    return np.flatnonzero(data - np.uint8(48) < 10)


def leaf_of(leads: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The hash of a leaf, from the sum over its leading tokens; odd, where templates are even."""
    return mix(leads + tokens * _N + _LEAF) | U64(1)


class Lines:
    """The lines of many texts: token counts, templates with digits generalised, leaves, tokens of leaves."""

    def __init__(self, texts: list[bytes]):
        buffer = b"\n".join(texts)
        data = np.frombuffer(buffer, np.uint8)
        hashes, starts, _ = word_hashes(buffer)
        variable = np.zeros(len(starts), bool)
        variable[np.searchsorted(starts, _digits(data), "right") - 1] = True
        breaks = np.flatnonzero(data == 10)
        self.line = np.searchsorted(breaks, starts)
        n_lines = len(breaks) + 1
        self.tokens = np.bincount(self.line, minlength=n_lines)
        fields = np.bincount(self.line[variable], minlength=n_lines)
        bare = fields == self.tokens
        self.variable = variable & ~bare[self.line]
        self.fields = np.where(bare, 0, fields)
        self.hashes = np.where(self.variable, VARIABLE, hashes)
        self.first = np.concatenate([[0], np.cumsum(self.tokens)[:-1]])
        self.place = np.arange(len(hashes)) - np.repeat(self.first, self.tokens)
        self.turn = _PLACES[self.place % 64] * (self.place // 64 + 1).astype(U64)
        self.plain = self.template(np.ones(len(hashes), bool))
        lead = np.where(self.place < DEPTH, mix(self.hashes + self.turn), 0)
        self.leaf = leaf_of(self._sum(lead), self.tokens.astype(U64))
        self.deep = (self.tokens >= LEAST) & ~bare
        # a document's lines: one more than its line breaks; the join itself breaks lines between documents
        counts = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
        self.of_doc = np.repeat(np.arange(len(texts)), counts)
        self.offsets = np.concatenate([[0], np.cumsum(counts)])

    def _sum(self, terms: np.ndarray) -> np.ndarray:
        total = np.concatenate([[U64(0)], np.cumsum(terms.astype(U64))])
        return total[self.first + self.tokens] - total[self.first]

    def template(self, constant: np.ndarray) -> np.ndarray:
        terms = mix(np.where(constant, self.hashes, VARIABLE) + self.turn)
        return mix(self._sum(terms) + self.tokens.astype(U64) * _N) & ~U64(1)

    def inner(self) -> tuple[np.ndarray, np.ndarray]:
        """(places among all tokens, hashes) of the tokens below the leading ones, with leaf and place."""
        at = np.flatnonzero(self.deep[self.line] & (self.place >= DEPTH) & ~self.variable)
        return at, mix(self.leaf[self.line[at]] + self.hashes[at] * _PLACE + self.turn[at])

    def learned(self, leaves: "Known", inner: "Known", min_docs: int) -> np.ndarray:
        """The learned template of every line; the plain one again where there is none."""
        at, hashes = self.inner()
        constant = (self.place < DEPTH) & ~self.variable
        constant[at] = inner.counts(hashes, self.of_doc[self.line[at]]) > 0
        fields = self.tokens - np.bincount(self.line[constant], minlength=len(self.tokens))
        usable = self.deep & (leaves.counts(self.leaf, self.of_doc) >= min_docs) & (fields * FIELDS <= self.tokens)
        return np.where(usable, self.template(constant), self.plain)


class Heads:
    """The lines of many texts as the tree places them: by their leaf, or by their template where they have none.

    Only leading tokens are hashed, and the whole of the lines too short for a leaf or led by fields.
    """

    def __init__(self, texts: list[bytes]):
        buffer = b"\n".join(texts) + b"\n"
        data = np.frombuffer(buffer, np.uint8)
        starts, ends = word_edges(is_space(data))
        breaks = np.flatnonzero(data == 10)
        first = np.searchsorted(starts, np.concatenate([[0], breaks]))
        self.tokens = np.diff(first)
        lead = np.minimum(first[:-1, None] + np.arange(DEPTH), max(0, len(starts) - 1))
        digits = _digits(data)
        long = np.flatnonzero(self.tokens >= LEAST)
        at = lead[long]
        variable = np.zeros(at.shape, bool)
        if len(long):
            variable = np.searchsorted(digits, ends[at]) > np.searchsorted(digits, starts[at])
        # a line of fields only begins with fields
        whole = (self.tokens > 0) & (self.tokens < LEAST)
        whole[long] = variable.all(axis=1)
        some = ~variable.all(axis=1)
        at, variable, tokens = at[some], variable[some], self.tokens[long[some]].astype(U64)
        hashes = np.where(variable.ravel(), VARIABLE, hash_words(data, starts[at.ravel()], ends[at.ravel()])).reshape(at.shape)
        self.key = np.zeros(len(self.tokens), U64)
        self.key[long[some]] = leaf_of(mix(hashes + _PLACES[:DEPTH]).sum(axis=1, dtype=U64), tokens)
        if whole.any():
            sizes = np.diff(breaks, prepend=-1)
            lines = Lines([data[np.repeat(whole, sizes)].tobytes()[:-1]])
            self.key[whole] = np.where(lines.deep, lines.leaf, lines.plain)
        counts = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
        self.of_doc = np.repeat(np.arange(len(texts)), counts)
        self.offsets = np.concatenate([[0], np.cumsum(counts)])


class Known:
    """The counts of hashes that each of a batch's documents was told."""

    def __init__(self, hashes: list, counts: list | None = None):
        found = [np.frombuffer(x or b"", U64) for x in hashes]
        owner = np.repeat(np.arange(len(found)), [len(x) for x in found]).astype(U64)
        every = np.concatenate(found) if found else np.zeros(0, U64)
        keys = mix(every + owner * _N)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        told = np.concatenate([np.frombuffer(x or b"", np.uint32) for x in counts]) if counts is not None and found else np.ones(len(every), np.uint32)
        self.told = told[order].astype(np.int64)

    def counts(self, hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64)
        keys = mix(hashes + docs.astype(U64) * _N)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.told[at], 0)


class Everywhere:
    """The counts of frequent hashes, told to all alike."""

    def __init__(self, rows: list):
        hashes = np.concatenate([np.frombuffer(r.shared, U64) for r in rows]) if rows else np.zeros(0, U64)
        order = np.argsort(hashes)
        self.keys = hashes[order]
        self.told = np.concatenate([np.frombuffer(r.total, np.uint32) for r in rows]).astype(np.int64)[order] if rows else np.zeros(0, np.int64)

    def counts(self, hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.told[at], 0)


class Told:
    """Frequent hashes and how they reach the lines: ``everywhere`` (a broadcast), else columns of each document."""

    def __init__(self, name: str, everywhere=None):
        self.name, self.everywhere = name, everywhere

    def of(self, batch):
        if self.everywhere is not None:
            return self.everywhere.value
        return Known(batch.column(self.name).to_pylist(), batch.column(f"{self.name}_counts").to_pylist())


def _ranged(hashes: np.ndarray, rows: np.ndarray, ids: np.ndarray, n_parts: int, least: np.ndarray | None = None):
    """An Arrow batch of (hash, row) entries, each hash once with its rows' doc_ids, by hash range.

    ``least`` is the number of rows that a hash must have to be frequent, where it has its own.
    """
    import pyarrow as pa

    order = np.lexsort((rows, hashes))
    hashes, rows = hashes[order], rows[order]
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])]) if len(hashes) else np.zeros(0, bool)
    hashes, rows = hashes[new], rows[new]
    own = least[order][new].astype(np.uint32) if least is not None else None
    first = _starts(hashes)
    places = np.append(first, len(hashes))
    sizes, cuts, out = np.diff(places).astype(np.uint32), _cuts(hashes[first], n_parts), []
    for p in range(n_parts):
        a, b = cuts[p], cuts[p + 1]
        if a < b:
            out.append((p, hashes[first[a:b]].tobytes(), ids[rows[places[a] : places[b]]].astype(np.int64).tobytes(), sizes[a:b].tobytes(), own[first[a:b]].tobytes() if own is not None else b""))
    columns = zip(*out) if out else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.binary()] * 4))], ["part", "hashes", "docs", "holders", "least"])


def _tree(n_parts: int):
    """Leaves of all lines, and templates of those that have none."""

    def write(batches):
        for whole in batches:
            for batch in slices(whole, 8_000_000):
                heads = Heads(to_bytes(batch.column("text")))
                real = heads.tokens > 0
                yield _ranged(heads.key[real], heads.of_doc[real], batch.column("doc_id").to_numpy(zero_copy_only=False), n_parts)

    return write


def _picked(raw: list[bytes], told) -> tuple[list[bytes], list[np.ndarray]]:
    """Of each text the lines with a frequent leaf or, without one, template (joined), and their numbers."""
    heads = Heads(raw)
    pick = (heads.tokens > 0) & (told.counts(heads.key, heads.of_doc) > 0)
    texts, numbers = [], []
    for text, a, b in zip(raw, heads.offsets[:-1].tolist(), heads.offsets[1:].tolist()):
        own = np.flatnonzero(pick[a:b])
        cut = text.split(b"\n") if len(own) else []
        texts.append(b"\n".join([cut[j] for j in own.tolist()]))
        numbers.append(own.astype(np.int32))
    return texts, numbers


def _candidates(tree: Told, others: int):
    """The lines that have a frequent leaf or template, with their numbers."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, 4_000_000):
                texts, numbers = _picked(to_bytes(batch.column("text")), tree.of(batch))
                columns = [*(batch.column(i) for i in range(others)), pa.array(texts, pa.binary()), pa.array([x.tobytes() for x in numbers], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:others], "lines", "numbers"])

    return run


def _tokens(n_parts: int, min_docs: int, tree: Told):
    """Tokens, with place and leaf, of the lines of frequent leaves."""

    def write(batches):
        for whole in batches:
            for batch in slices(whole, 4_000_000):
                lines = Lines(to_bytes(batch.column("lines")))
                of_leaf = tree.of(batch).counts(lines.leaf, lines.of_doc)
                at, hashes = lines.inner()
                mine = of_leaf[lines.line[at]]
                pick = mine >= min_docs
                least = np.maximum(min_docs, np.ceil(mine[pick] * SHARE))
                yield _ranged(hashes[pick], lines.of_doc[lines.line[at[pick]]], batch.column("doc_id").to_numpy(zero_copy_only=False), n_parts, least)

    return write


def _templates(n_parts: int, min_docs: int, tree: Told, inner: Told):
    """Both templates of the candidate lines."""

    def write(batches):
        for whole in batches:
            for batch in slices(whole, 4_000_000):
                lines, told = Lines(to_bytes(batch.column("lines"))), tree.of(batch)
                plain = lines.tokens > 0
                found = lines.learned(told, inner.of(batch), min_docs)
                more = lines.deep & (found != lines.plain)
                hashes, rows = np.concatenate([lines.plain[plain], found[more]]), np.concatenate([lines.of_doc[plain], lines.of_doc[more]])
                yield _ranged(hashes, rows, batch.column("doc_id").to_numpy(zero_copy_only=False), n_parts)

    return write


def _frequent(min_docs: int):
    """The hashes of one range that ``min_docs`` rows hold, with their counts."""

    def merge(table):
        import pyarrow as pa

        h, n = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in (("hashes", U64), ("holders", np.uint32)))
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order].astype(np.int64)
        first = _starts(h)
        n = np.add.reduceat(n, first) if len(first) else n
        own = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("least").to_pylist()])
        pick = n >= (own[order][first] if len(own) else min_docs)
        return pa.table({"part": table.column("part")[:1], "shared": pa.array([h[first][pick].tobytes()], pa.binary()), "total": pa.array([np.minimum(n[pick], 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    return merge


def _told(groups: int):
    """(document, frequent hash, count) of each segment, dealt to groups of documents."""
    import pyarrow as pa

    def sent(kept):
        docs, hashes, counts = (np.concatenate(x) for x in zip(*kept))
        group = (docs.view(U64) * _N >> U64(33)).astype(np.int64) % groups
        order = np.argsort(group, kind="stable")
        group, docs, hashes, counts = (x[order] for x in (group, docs, hashes, counts))
        first = np.append(_starts(group), len(group))
        columns = [pa.array(group[first[:-1]].astype(np.int32))]
        columns += [pa.array([x[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary()) for x in (docs, hashes, counts)]
        return pa.RecordBatch.from_arrays(columns, ["part", "docs", "hashes", "counts"])

    def look(batches):
        kept, size = [], 0
        for batch in batches:
            for hashes, docs, holders, shared, total in zip(*(batch.column(c).to_pylist() for c in ("hashes", "docs", "holders", "shared", "total"))):
                h, s, n = np.frombuffer(hashes, U64), np.frombuffer(shared, U64), np.frombuffer(total, np.uint32)
                at = np.minimum(np.searchsorted(s, h), len(s) - 1)
                hit = s[at] == h
                if hit.any():
                    sizes = np.frombuffer(holders, np.uint32)
                    pick = np.repeat(hit, sizes)
                    kept.append((np.frombuffer(docs, np.int64)[pick], np.repeat(h, sizes)[pick], np.repeat(n[at], sizes)[pick]))
                    size += len(kept[-1][0])
                if size > ENTRIES:
                    yield sent(kept)
                    kept, size = [], 0
        if kept:
            yield sent(kept)

    return look


def _by_document(table):
    """One row for each document of a group: its frequent hashes with their counts."""
    import pyarrow as pa

    docs, hashes, counts = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in (("docs", np.int64), ("hashes", U64), ("counts", np.uint32)))
    order = np.lexsort((hashes, docs))
    docs, hashes, counts = docs[order], hashes[order], counts[order]
    new = np.concatenate([[True], (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])]) if len(docs) else np.zeros(0, bool)
    docs, hashes, counts = docs[new], hashes[new], counts[new]
    first = np.append(_starts(docs), len(docs))
    cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())
    return pa.table({"doc_id": pa.array(docs[first[:-1]]), "found": cut(hashes), "counts": cut(counts)})


def _of_classes(n_parts: int):
    """The templates of documents, each once for a class in a batch, dealt to their hash ranges."""

    def deal(batches):
        for batch in batches:
            found = [np.frombuffer(x, U64) for x in batch.column("found").to_pylist()]
            if found:
                h = np.concatenate(found)
                c = np.repeat(batch.column("class_id").to_numpy(zero_copy_only=False).astype(np.int64), [len(x) for x in found])
                classes, rows = np.unique(c, return_inverse=True)
                yield _ranged(h, rows, classes, n_parts)

    return deal


def _over_classes(min_docs: int):
    """The templates of one range that ``min_docs`` classes hold."""

    def merge(table):
        import pyarrow as pa

        h, n = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in (("hashes", U64), ("holders", np.uint32)))
        c = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("docs").to_pylist()])
        h = np.repeat(h, n)
        order = np.lexsort((c, h))
        h, c = h[order], c[order]
        h = h[np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])] if len(h) else h
        first = _starts(h)
        n = np.diff(np.append(first, len(h)))
        pick = n >= min_docs
        return pa.table({"part": table.column("part")[:1], "shared": pa.array([h[first][pick].tobytes()], pa.binary()), "total": pa.array([n[pick].astype(np.uint32).tobytes()], pa.binary())})

    return merge


def _recur(texts: list[bytes], numbers: list[np.ndarray], batch, min_docs: int, tree: Told, inner: Told, last: Told) -> list[np.ndarray]:
    """Of the numbers of candidate lines those of lines that recur."""
    lines, recurring = Lines(texts), last.of(batch)
    drop = recurring.counts(lines.plain, lines.of_doc) > 0
    drop |= recurring.counts(lines.learned(tree.of(batch), inner.of(batch), min_docs), lines.of_doc) > 0
    drop &= lines.tokens > 0
    return [x[drop[a:b][: len(x)]] for x, a, b in zip(numbers, lines.offsets[:-1], lines.offsets[1:])]


def _numbers(min_docs: int, *told: Told):
    """The numbers of the lines of each row that recur."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, 4_000_000):
                numbers = [np.frombuffer(x, np.int32) for x in batch.column("numbers").to_pylist()]
                gone = _recur(to_bytes(batch.column("lines")), numbers, batch, min_docs, *told)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array([x.tobytes() for x in gone], pa.binary())], ["doc_id", "row", "gone"])

    return run


def _dropper(others: int, min_docs: int = 0, *told: Told):
    """Texts without their recurring lines: those numbered in ``gone``, or found again where all is told to all."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for whole in batches:
            for batch in slices(whole):
                raw, texts, n_lines, dropped = to_bytes(batch.column("text")), [], [], []
                if told:
                    gone = _recur(*_picked(raw, told[0].of(batch)), batch, min_docs, *told)
                else:
                    gone = [np.frombuffer(x or b"", np.int32) for x in batch.column("gone").to_pylist()]
                for text, numbers in zip(raw, gone):
                    cut = text.split(b"\n")
                    keep = np.ones(len(cut), bool)
                    keep[numbers] = False
                    texts.append(b"\n".join([x for x, k in zip(cut, keep.tolist()) if k]))
                    n_lines.append(len(cut))
                    dropped.append(len(numbers))
                kept = pc.if_else(batch.column("text").is_null(), pa.nulls(len(texts), pa.string()), pa.array(texts, pa.binary()).cast(pa.string()))
                columns = [*(batch.column(i) for i in range(others)), kept, pa.array(n_lines, pa.int64()), pa.array(dropped, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:others], "kept_text", "n_lines", "n_dropped"])

    return run


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep``, kept_text, n_lines, n_dropped of all rows of documents with recurring lines."""
    spark = docs.sparkSession
    scratch, n = Scratch(spark, "lines"), hash_ranges(docs)
    others = F.struct(F.lit(0).alias("wayfold_none"), *keep).alias("others")
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), others)
    # rows of one doc_id are told apart by their texts
    row = F.xxhash64("text").alias("row")

    def counted(rows: DataFrame, write, name: str) -> DataFrame:
        return scratch.save(rows.mapInArrow(write, _COUNTED), name)

    def frequent(index: DataFrame, merge, name: str) -> tuple[DataFrame, Told]:
        """part, shared, total of the frequent hashes, and the way in which they are told."""
        # no column of documents is read where counts are enough
        index = index if merge is over_classes else index.drop("docs")
        shared = scratch.save(index.groupBy("part").applyInArrow(merge, "part int, shared binary, total binary").where(F.length("shared") > 0), f"{name}-shared")
        size = shared.agg(F.sum(F.length("shared") + F.length("total"))).first()[0] or 0
        return shared, Told(name, spark.sparkContext.broadcast(Everywhere(shared.collect())) if size <= BROADCAST_BYTES else None)

    def by_document(shared: DataFrame, holders: DataFrame, name: str) -> DataFrame:
        """doc_id, <name>, <name>_counts: the frequent hashes of the documents that hold any."""
        held = holders.join(shared, "part").select("hashes", "docs", "holders", "shared", "total").mapInArrow(_told(n), _DEALT)
        found = held.groupBy("part").applyInArrow(_by_document, "doc_id long, found binary, counts binary")
        return scratch.save(found.select("doc_id", F.col("found").alias(name), F.col("counts").alias(f"{name}_counts")), name)

    counts, over_classes = _frequent(min_docs), _over_classes(min_docs)
    texts, binary = docs.select("doc_id", row, "text"), " binary, {0}_counts binary"
    index = counted(docs.select("doc_id", "text"), _tree(n), "tree")
    shared, tree = frequent(index, counts, "leaves")
    fields = "doc_id long, row long"
    if tree.everywhere is None:
        told = by_document(shared, index, "leaves")
        texts = with_ids(texts, told).join(told, "doc_id").select("doc_id", "row", "leaves", "leaves_counts", "text")
        fields += ", leaves" + binary.format("leaves")
    known = scratch.save(texts.mapInArrow(_candidates(tree, fields.count(",") + 1), fields + ", lines binary, numbers binary").where(F.length("numbers") > 0), "lines")
    index = counted(known, _tokens(n, min_docs, tree), "tokens")
    shared, inner = frequent(index, counts, "inner")
    if inner.everywhere is None:
        known = scratch.save(known.join(by_document(shared, index, "inner"), "doc_id", "left"), "known")
    templates = counted(known, _templates(n, min_docs, tree, inner), "templates")
    held = by_document(frequent(templates, counts, "held")[0], templates, "held")
    for name in ("tree", "tokens"):
        scratch.drop(name)
    texts = docs.select("doc_id", "text")
    classes = near_duplicates(with_ids(texts, held), WIDTH, PERCENT).groupBy("doc_id").agg(F.min("component_id").alias("class_id"))
    of_classes = held.join(classes, "doc_id").select("class_id", F.col("held").alias("found")).mapInArrow(_of_classes(n), _COUNTED)
    shared, last = frequent(of_classes, over_classes, "recurring")
    if last.everywhere is None:
        known = known.join(by_document(shared, templates, "recurring"), "doc_id")
    gone = known.mapInArrow(_numbers(min_docs, tree, inner, last), "doc_id long, row long, gone binary").where(F.length("gone") > 0)
    gone = scratch.save(gone.dropDuplicates(["doc_id", "row"]), "gone")
    found = with_ids(docs.select("doc_id", "others", "text", row), gone)
    if all(x.everywhere is not None for x in (tree, inner, last)):
        drop = _dropper(2, min_docs, tree, inner, last)
        found = found.select("doc_id", "others", "text")
    else:
        drop = _dropper(2)
        found = found.join(gone, ["doc_id", "row"], "left").select("doc_id", "others", "text", "gone")
    kind = docs.schema["others"].dataType.simpleString()
    changed = scratch.save(found.mapInArrow(drop, f"doc_id long, others {kind}, kept_text string, n_lines long, n_dropped long"), "changed")
    for name in ("lines", "known", "templates", "held"):
        scratch.drop(name)
    return changed.select("doc_id", *[F.col("others")[c].alias(c) for c in keep], "kept_text", "n_lines", "n_dropped")


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("string"))
    changed = drop_recurring(docs)
    same = with_ids(docs, changed, keep=False)
    text = F.coalesce("text", F.lit(""))
    same = same.select("doc_id", (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"))) + 1).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.sha2(text, 256).alias("kept_sha256"))
    return same.union(changed.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256")))

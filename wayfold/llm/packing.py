"""Packing in the order of a space-filling curve.

A document's vector is the mean of hashed word projections in four dimensions; its place along a
Hilbert curve through that space is its key.  Each text is read once, for its key and its token ids,
which are written; the written rows are range-sorted by (key, doc_id, row), so equal keys still
spread over many partitions, and written again with the place of each document's first token in its
partition.  The partitions' totals (one number each) give its place in the whole stream, so where a
document is cut depends on the order alone: sequences hold ``LENGTH`` tokens, neighbours along the
curve share them, and the same table gives the same rows whatever the partitions.  Only the very end
of the stream becomes sequences whose lengths are powers of two, which need no padding.

Ids are those of the ``tokenizers`` file.  Where that is byte-level byte-pair merging in rank order,
``tiktoken`` applies the same ranks, which gives equal ids at a third of the time; a text with a
run of white space too long for it goes through ``tokenizers`` itself.

Defined results: a null or empty text is its end token alone; equal keys are ordered by doc_id (null
first), then by row; repeated rows are packed each; an empty table gives no pieces; other columns
are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, parts
from .textkit import U64, Batch, slices, to_bytes

LENGTH, END_ID = 2048, 1
DIMENSIONS, BITS = 4, 10
#: Bytes of ids in one range at most, about; small inputs take as many ranges as shuffle partitions.
RANGE_BYTES = 64 << 20
#: The pattern that byte-level pre-tokenising cuts texts by (fixed values).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A run of white space that overflows the stack of the faster library's pattern is several times longer.
BLANK_RUN = 50_000
_LONG_RUN = re.compile(rf"\s{{{BLANK_RUN}}}")


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of each row of cells (n, dimensions), by bit planes from the top."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    gray = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        gray = np.where(x[n - 1] & (1 << level), gray ^ ((1 << level) - 1), gray)
    x ^= gray
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> level & 1)
    return key


def curve_keys(texts: list[bytes]) -> np.ndarray:
    """The Hilbert key of every text: mean projections of its words, spread over the grid's cells."""
    words = Batch(texts, lower=True)
    n = np.diff(words.offsets)
    key_space = 1 << BITS
    cells = np.zeros((len(texts), DIMENSIONS), np.int64)
    for d in range(DIMENSIONS):
        values = ((words.hashes >> U64(16 * d)) & U64(0xFFFF)).astype(np.float64) / 32768 - 1
        sums = np.concatenate([[0.0], np.cumsum(np.rint(values * 1024))])
        mean = (sums[words.offsets[1:]] - sums[words.offsets[:-1]]) / 1024 / np.maximum(n, 1)
        cells[:, d] = np.clip((np.tanh(mean * 4) + 1) / 2 * key_space, 0, key_space - 1)
    return hilbert(cells)


class Encoder:
    """Token ids of texts as arrays of 32-bit integers, equal to the ``tokenizers`` file's own."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        ranks = _ranks(path)
        self.merger = None
        if ranks:
            import tiktoken

            self.merger = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.merger is None:
            return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return [self._slow(t) if len(t) >= BLANK_RUN and _LONG_RUN.search(t) else np.array(self.merger.encode_ordinary(t), "<u4") for t in texts]

    def _slow(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


def _ranks(path: str) -> dict[bytes, int] | None:
    """Byte strings by id, if the file is plain byte-level merging whose ids rise with the merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
    if not plain or spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return None
    # printable bytes stand for themselves, the others for the code points from 256 on, in order
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    vocabulary = model["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if any(vocabulary.get("".join(m)) != 256 + i for i, m in enumerate(merges)):
        return None
    ids = {t: i for t, i in vocabulary.items() if i < 256 + len(merges)}
    return {bytes(letters[c] for c in t): i for t, i in ids.items()} if all(c in letters for t in ids for c in t) else None


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder for each worker process: later tasks find its vocabulary in place."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _kind(spark: SparkSession, path: str, end_id: int) -> str:
    """The type in which ids are written between the steps: 16 bits where the vocabulary allows (an executor looks)."""

    def look(batches):
        import pyarrow as pa

        for batch in batches:
            size = _encoder(path).tokenizer.get_vocab_size()
            yield pa.RecordBatch.from_arrays([pa.array([size] * batch.num_rows, pa.int64())], ["size"])

    size = spark.range(0, 1, 1, 1).mapInArrow(look, "size long").first()[0]
    return "<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4"


def _tokenised(path: str, end_id: int, kind: str):
    end = np.array([end_id], "<u4")

    def run(batches):
        import pyarrow as pa

        encoder = _encoder(path)
        for whole in batches:
            for batch in slices(whole, 1_000_000):
                keys = curve_keys(to_bytes(batch.column("text")))
                ids = [np.concatenate([x, end]).astype(kind).tobytes() for x in encoder.encode([t or "" for t in batch.column("text").to_pylist()])]
                n = [len(x) // np.dtype(kind).itemsize for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "key", "n", "ids"])

    return run


def _placed(kind: str):
    """Rows of a partition in order, with the partition's number and the tokens before each."""
    size = np.dtype(kind).itemsize

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column("ids")
            n = np.array(pc.binary_length(ids).to_numpy(zero_copy_only=False), np.int64) // size
            at = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part), pa.int32()), pa.array(at), pa.array(n), batch.column("doc_id"), ids], ["part", "at", "n", "doc_id", "ids"])

    return run


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cutter(base: dict[int, int], total: int, length: int, with_ids: bool, kind: str):
    """Pieces of each document from its place in the stream of ``total`` tokens."""
    whole_sequences = total // length
    # where the sequences after the whole ones begin: falling powers of two
    ends, left = [whole_sequences * length], total % length
    while left:
        size = 1 << (left.bit_length() - 1)
        ends.append(ends[-1] + size)
        left -= size
    tail = np.array(ends)

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + (["ids"] if with_ids else [])
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for part, at, n, doc, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "n", "doc_id", "ids"))):
                    first = place = base[part] + at
                    ids = np.frombuffer(ids, kind).astype("<u4").tobytes()
                    while place < first + n:
                        if place < tail[0]:
                            sequence, begin = divmod(place, length)
                            begin, end = place - begin, place - begin + length
                        else:
                            k = int(np.searchsorted(tail, place, "right"))
                            sequence, begin, end = whole_sequences + k - 1, int(tail[k - 1]), int(tail[k])
                        take = min(end, first + n) - place
                        own = ids[4 * (place - first) : 4 * (place - first + take)]
                        rows.append((doc, place - first, take, zlib.crc32(own), n, sequence, place - begin, own)[: len(names)])
                        place += take
                kinds = [pa.int64()] * 7 + [pa.binary()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """Pieces of all documents along the curve; with ids, each piece's token ids as 32-bit bytes."""
    if length & (length - 1) or length < 1:
        raise ValueError("the length of a sequence must be a power of two")
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    scratch, kind = Scratch(docs.sparkSession, "packing"), _kind(docs.sparkSession, tokenizer, end_id)
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keyed = chosen.mapInArrow(_tokenised(tokenizer, end_id, kind), "doc_id long, key long, n long, ids binary").withColumn("row", F.monotonically_increasing_id())
    keyed = scratch.save(keyed, "tokens")
    order = ("key", "doc_id", "row")
    written = keyed.agg(F.sum("n")).first()[0] or 0
    ranges = max(parts(docs.sparkSession), written * np.dtype(kind).itemsize // RANGE_BYTES)
    ranged = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    placed = scratch.save(ranged.mapInArrow(_placed(kind), "part int, at long, n long, doc_id long, ids binary"), "stream")
    scratch.drop("tokens")
    # one number for each partition
    totals = dict(placed.groupBy("part").agg(F.sum("n")).collect())
    base, total = {}, 0
    for part in sorted(totals):
        base[part], total = total, total + totals[part]
    return placed.mapInArrow(_cutter(base, total, length, ids, kind), PIECES + (", ids binary" if ids else ""))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))

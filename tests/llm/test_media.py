"""Round trips of the progressive files, by arrays and bit by bit."""

import hashlib
import random

import numpy as np

from wayfold.llm import media


def test_round_trip_and_both_readers():
    r = random.Random(5)
    for n in (1, 2, 5, 6, 7, 13, 60):
        payload = bytes(r.randrange(256) for _ in range(64 * n))
        stored = media.encode(payload)
        fast, slow = media.coefficients(stored), media.coefficients(stored, whole=False)
        assert all((a == b).all() for a, b in zip(fast[3], slow[3]))
        assert media.payload_of(fast[0], fast[3]) == payload
    long = bytes(range(256)) * 64 * 900
    stored = media.encode(long)
    comments, rows, columns, planes = media.coefficients(stored)
    assert media.payload_of(comments, planes) == long and len(planes[0]) > media.RUN_LIMIT


def test_reader_of_sparse_scans():
    """A hand-made band with zero runs, an end-of-band run, and refinement of old and new coefficients."""
    blocks = np.zeros((3, 64), np.int16)
    table = {(2, 0): 0x12, (2, 1): 0x10, (2, 2): 0x01, (3, 6): 0x00}
    bits = "00" "11" + "10" "0" + "110" + "01" "1"
    media._ac_first(media._Bits(int(bits.ljust(24, "1"), 2).to_bytes(3, "big")), table, blocks, 1, 5, 1)
    assert blocks[0, :6].tolist() == [0, 0, 6, -2, 0, 0] and not blocks[1:].any()
    bits = "00".replace("00", "10") + "1" + "110" + "1" "0" + "01" "0"
    media._ac_refine(media._Bits(int(bits.ljust(24, "0"), 2).to_bytes(3, "big")), table, blocks, 1, 5, 0)
    assert blocks[0, :6].tolist() == [0, 1, 7, -2, 0, 0] and not blocks[1:].any()


def test_flat_image_is_its_mean():
    planes = [np.zeros((4, 64), np.int16), np.zeros((1, 64), np.int16), np.zeros((1, 64), np.int16)]
    planes[0][:, 0] = 80
    assert (media.rgb(1, 1, planes) == 138).all()


def test_query_rows(spark):
    rows = [(1, None, 0), (2, "", 1), (3, "a" * 64, 2), (4, "é" * 50, 3), (5, "é" * 50, 4), (6, "long " * 9000, 5)]
    got = {r.doc_id: r for r in media.media_columns(spark.createDataFrame(rows, "doc_id long, text string, feature int")).collect()}
    for doc, text, _ in rows:
        data = (text or "").encode()
        padded = data + bytes(-len(data) % 64 if data else 64)
        assert (got[doc].n_bytes, got[doc].payload_bytes, got[doc].payload_sha256) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert got[doc].media_sha256 == hashlib.sha256(got[doc].media).hexdigest()
        assert len(got[doc].rgb) == np.prod(got[doc]["shape"])
    assert got[4][1:] == got[5][1:] and got[1].payload_sha256 == got[2].payload_sha256
    assert media.media_columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0

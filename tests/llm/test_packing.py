"""Pieces rebuild every document's ids, sequences are gapless, padding is nil, the curve is continuous."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from wayfold.llm import packing


def test_units_encode_like_the_tokenizer():
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    r = random.Random(7)
    bits = ["it's", "we'LL", " ", "  ", "\n", "\n\n ", "\t", " ", "　", " ", "\x1c", "\x85", "é", "naïve", "123", "!?", "***", "<|endoftext|>", "漢字", "x" * 300, "​", "🙂"]
    texts = ["", " ", " a", "a ", "\n"] + ["".join(r.choice(bits) for _ in range(r.randint(1, 30))) for _ in range(3000)]
    words = ["it's", "the", "é***", "a\tb", "x\xa0", "\x02", "漢字", "12", "<|endoftext|>", "", "don't,"]
    texts += [r.choice([" ", "\n", " ", "\n\n"]).join(r.choice(words) for _ in range(r.randint(1, 12))) + r.choice(["", "", "\n", " "]) for _ in range(2000)]
    texts += ["\n".join(" ".join(r.choice(words[:3] + words[6:9]) for _ in range(5)) for _ in range(3)) for _ in range(500)]
    want = [np.array(e.ids, "<u4").tobytes() for e in own.encode_batch(texts, add_special_tokens=False)]
    found = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert found.merger is not None
    assert [x.tobytes() for x in found.encode(texts)] == want


def test_long_runs_and_other_vocabularies():
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text in [c * 1_200_000 for c in " \n　x1^"] + ["a" + " " * 49_999 + "b " * 30_000]:
        assert found.encode([text])[0].tolist() == own.encode(text, add_special_tokens=False).ids
    other = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert other.merger is None
    want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want.encode_special_tokens = True
    assert other.encode(["Two words"])[0].tolist() == want.encode("Two words", add_special_tokens=False).ids


def test_every_character_encodes_like_the_tokenizer():
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    found = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b {chr(c)}1{chr(c)}!{chr(c)}{chr(c)} " for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    assert [x.tolist() for x in found.encode(texts)] == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


def test_curve_visits_neighbouring_cells():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = packing.hilbert(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_rows_do_not_depend_on_partitions(spark):
    """Repeated rows, equal keys, a null id and clashing columns; the order is the curve's, found again by sorting."""
    r = random.Random(5)
    rows = [(r.randrange(60), " ".join(r.choice(["the", "of", "ñandú", "x1"]) for _ in range(r.randint(0, 400))), 1) for _ in range(150)] + [(7, "same text", 1)] * 30 + [(None, "no id", 2), (None, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long").coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(packing.pack(docs, ids=True).collect(), key=lambda p: (p.sequence_id, p.offset)))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json")).encode
    keys = packing.curve_keys([(t or "").encode() for _, t, _ in rows])
    order = sorted(range(len(rows)), key=lambda i: (keys[i], rows[i][0] is not None, rows[i][0] or 0, i))
    stream = b"".join(np.append(x, 1).astype("<u4").tobytes() for x in encode([rows[i][1] or "" for i in order]))
    assert b"".join(p.ids for p in found[0]) == stream
    sizes = [sum(p.length for p in found[0] if p.sequence_id == s) for s in range(found[0][-1].sequence_id + 1)]
    total, left = len(stream) // 4, len(stream) // 4 % 2048
    assert sizes == [2048] * (total // 2048) + [1 << b for b in range(10, -1, -1) if left >> b & 1]


def test_pieces_rebuild_documents(spark):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(1)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "word " * 9000)] + [(i, " ".join(r.choice(["the", "of", "ñandú", "x1"]) for _ in range(r.randint(1, 900)))) for i in range(4, 90)] + [(200 + i, "same text") for i in range(40)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), ids=True).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(p.ids) and p.length == len(p.ids) // 4
        docs[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    for doc, text in rows:
        want = np.array([*own.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        mine = sorted(docs[doc], key=lambda p: p.start)
        assert b"".join(p.ids for p in mine) == want and mine[0].doc_tokens == len(want) // 4
        assert [p.start for p in mine] == list(np.cumsum([0, *[p.length for p in mine]])[:-1])
    for own_pieces in sequences.values():
        total = 0
        for p in sorted(own_pieces, key=lambda p: p.offset):
            assert p.offset == total
            total += p.length
        assert total <= 2048 and total & (total - 1) == 0
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0

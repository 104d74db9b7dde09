"""Near duplicates against a comparison of all pairs of full shingle sets."""

import random
import re

import numpy as np
import pyarrow as pa

from wayfold.llm import minhash, textkit
from wayfold.llm.minhash import near_duplicates, prefix_pairs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width, percent):
    sets = {}
    for doc, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = WORD.findall(low)
        sets[doc] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())
    up = {doc: doc for doc in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {(d, len(sets[d]), top(d), top(d) == d) for d in ids}


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "ß", "Δ", " x"]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "a b c"), (6, "A  b\nc"), (7, "x " * 5000)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    for _ in range(60):
        base = [r.choice(vocabulary) for _ in range(r.randint(4, 150))] + (passage if r.random() < 0.5 else [])
        for _ in range(r.randint(1, 9)):
            copy = list(base)
            for _ in range(r.randint(0, 6)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            base = copy if r.random() < 0.5 else base
            rows.append((len(rows) * 3, " ".join(copy).replace("w1", "W1") + r.choice(["", "\n"])))
    return rows


def test_same_components_as_all_pairs(spark):
    for seed, width in ((1, 4), (2, 5)):
        rows = corpus(seed)
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, 80)
        assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute(rows, width, 80)


def test_prefix_join_keeps_links_and_emits_few_others(spark):
    """Edited copies of one text, each its own component: all links are among the pairs, and few pairs are no links."""
    r = random.Random(7)
    base = [f"w{i}" for i in range(140)]
    rows = []
    for i in range(200):
        copy = list(base)
        for at in r.sample(range(140), 1 if i % 10 == 0 else 2):
            copy[at] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = {tuple(p) for p in prefix_pairs(texts, texts.selectExpr("doc_id", "doc_id component"), 5, 80).collect()}
    assert links and links <= pairs
    assert 2 * len(links) < 199 * 100
    assert len(pairs) < 1.5 * len(links)


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, component string, bands int")
    assert near_duplicates(empty).count() == 0
    one = spark.createDataFrame([(1, "a b c d e f", "x", 2)], "doc_id long, text string, component string, bands int")
    assert [tuple(r) for r in near_duplicates(one).collect()] == [(1, 2, 1, 1, True)]


def test_structured_words_and_ties(spark):
    """Words that a polynomial hash modulo a power of two cannot tell apart, and pairs right at the threshold."""
    rows, word = [], "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
        other = word.translate(str.maketrans("ab", "ba"))
        if len(word) in (512, 1024, 4096):
            rows += [(len(rows), f"{w} one two three four") for w in (word, other)] + [(len(rows) + 2, word), (len(rows) + 3, other)]
    base = [f"t{i}" for i in range(93)]
    rows += [(100, " ".join(base)), (101, " ".join(base[:74] + ["x", *base[75:]])), (102, " ".join(base[:72] + ["y", *base[73:]][:20]))]
    rows += [(110, " ".join(f"v{i}" for i in range(12))), (111, " ".join(f"v{i}" for i in range(10)))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute(rows, 4, 80)


def test_repeated_rows_and_null_ids(spark):
    """Equal rows are one document; rows of one id with different texts are sketched each; a null id links nothing."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (5, text + " more"), (7, "quite other words stand in here"), (7, "and these are the second text of it"), (None, text), (None, None)]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect())
    assert got == sorted([("1", 37, "1", True), ("1", 37, "1", True), ("5", 38, "1", False), ("7", 3, "7", True), ("7", 5, "7", True), ("None", 37, "1", False), ("None", 0, "None", False)])


def test_prefixes_of_sorted_rows_over_batches(monkeypatch):
    """Entries as counted by hand, whatever the batches that a document's rows are dealt to."""
    r = random.Random(5)
    rows, want = [], set()
    for doc in range(40):
        size = 300 if doc == 7 else r.randint(1, 30)
        n = size + r.randint(0, 8)
        own = sorted((r.randint(2, 5), r.randrange(-(2**63), 2**63)) for _ in range(size))
        maps, first = [0] * 8, n - size
        for _, x in own:
            maps[x % 8] ^= 1 << ((x % 2**64) >> 6 & 63)
        maps = [x - 2**64 if x >= 2**63 else x for x in maps]
        for i, (_, x) in enumerate(own[: max(0, n - (n * 80 + 99) // 100 + 1 - first)]):
            want.add((doc, doc % 3, n, first, *maps, first + i, x))
        r.shuffle(own)
        rows += [(doc, doc % 3, n, df, x) for df, x in own]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 11])], list("abcde")) for i in range(0, len(rows), 11)]
    for limit in (1, 50, 10**6):
        monkeypatch.setattr(minhash, "PREFIX_ROWS", limit)
        got = [tuple(x.values()) for b in minhash._prefixes(80)(iter(batches)) for x in b.to_pylist()]
        assert len(got) == len(want) and set(got) == want
    assert list(minhash._prefixes(80)(iter([]))) == []


def test_buckets_of_many_signatures():
    sigs = np.random.default_rng(2).integers(0, 2**20, (5, 96), dtype=np.uint32)
    for sig, keys in zip(sigs, minhash.band_keys(sigs)):
        assert (keys == textkit.mix(textkit.window_hashes(sig.astype(np.uint64), 4)[::4] + minhash._BAND_SALT)).all()

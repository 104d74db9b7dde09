"""Line templates against brute-force trees of lists and dictionaries."""

import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from wayfold.llm import lines, textkit
from wayfold.llm.minhash import near_duplicates

SCHEMA = "doc_id long, text string, lang string, found int"


def brute(rows, classes, min_docs=10):
    """(doc_id, kept text, lines, dropped) of all rows of documents with a recurring line; rows is a list of (doc_id, text)."""

    def plain(line):
        t = line.split()
        fields = ["<*>" if any(c in "0123456789" for c in w) else w for w in t]
        return tuple(t) if all(x == "<*>" for x in fields) else tuple(fields)

    def leaf(t):
        return (len(t), *t[: lines.DEPTH]) if len(t) >= lines.LEAST and not bare(t) else None

    bare = lambda t: all(any(c in "0123456789" for c in w) for w in t)
    texts = [(d, [plain(x) for x in (t or "").split("\n")]) for d, t in rows if d is not None]
    leaves, tokens = defaultdict(set), defaultdict(set)
    for i, (_, own) in enumerate(texts):
        for t in own:
            if leaf(t):
                leaves[leaf(t)].add(i)
                for p in range(lines.DEPTH, len(t)):
                    if t[p] != "<*>":
                        tokens[leaf(t), p, t[p]].add(i)

    def templates(t):
        if not t:
            return set()
        found, n = {t}, len(leaves[leaf(t)]) if leaf(t) else 0
        if n >= min_docs:
            least = max(min_docs, math.ceil(n * lines.SHARE))
            made = tuple(w if p < lines.DEPTH or w != "<*>" and len(tokens[leaf(t), p, w]) >= least else "<*>" for p, w in enumerate(t))
            if made.count("<*>") * lines.FIELDS <= len(t):
                found.add(made)
        return found

    held = defaultdict(set)
    for d, own in texts:
        for t in own:
            for k in templates(t):
                held[k].add(classes[d])
    drops = [[any(len(held[k]) >= min_docs for k in templates(t)) for t in own] for _, own in texts]
    hit = {d for (d, _), drop in zip(texts, drops) if any(drop)}
    real = [(d, t) for d, t in rows if d is not None]
    kept = lambda t, drop: "\n".join(x for x, gone in zip(t.split("\n"), drop) if not gone) if any(drop) else t
    return sorted(((d, kept(t, drop), len(drop), sum(drop)) for (d, t), drop in zip(real, drops) if d in hit), key=str)


def check(spark, rows, partitions=3):
    frame = spark.createDataFrame([(d, t, "xx", 1) for d, t in rows], SCHEMA).repartition(partitions)
    classes = {}
    for r in near_duplicates(frame.where("doc_id is not null"), lines.WIDTH, lines.PERCENT).collect():
        classes[r.doc_id] = min(r.component_id, classes.get(r.doc_id, r.component_id))
    got = sorted(((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in lines.drop_recurring(frame, 10).collect()), key=str)
    want = brute(rows, classes)
    assert got == want
    return want


def words(r, n):
    return [r.choice("alpha beta gamma delta eps zeta eta theta é ñu".split()) + "".join(chr(97 + r.randrange(26)) for _ in range(3)) for _ in range(n)]


@pytest.mark.parametrize("limit", [lines.BROADCAST_BYTES, -1])
def test_same_as_brute_force_tree(spark, monkeypatch, limit):
    monkeypatch.setattr(lines, "BROADCAST_BYTES", limit)
    r = random.Random(4)
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "Read 5 more pages here"), (None, "Read 7 more pages here"), (None, None)]
    for i in range(4, 90):
        own = [" ".join(words(r, r.randint(0, 30))) for _ in range(r.randint(1, 6))]
        own += [f"Read {r.randrange(99)} more pages here"] * (r.random() < 0.5)
        own += ["Cookies are used on this {} by us for you".format(*words(r, 1))] * (r.random() < 0.5)
        # two neighbouring fields, frequent values in one of them, and a leaf that two patterns share
        own += ["Posted by {} {} on {} in the news".format(*words(r, 2), r.choice(["Monday", "Tuesday"]))] * (r.random() < 0.6)
        own += ["Posted by the editor of {} as a note".format(*words(r, 1))] * (r.random() < 0.3)
        own += ["one two three", "12 13 14", " \t"]
        r.shuffle(own)
        rows.append((i, "\n".join(own)))
    rows += [(100 + i, rows[25][1]) for i in range(12)]
    rows += [(30, "its other text\nRead 1 more pages here"), (31, "a second row"), (32, rows[37][1]), (33, None)]
    want = check(spark, rows)
    dropped = "\n".join(t for _, t in rows if t)
    assert "Posted by" in dropped and not any("Posted by" in (t or "") and "news" in t for _, t, _, _ in want)
    assert (31, "a second row", 1, 0) in want and lines.drop_recurring(spark.createDataFrame([], SCHEMA)).count() == 0


def test_short_documents_and_lines_lose_what_recurs_but_copies_stay(spark):
    word = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    boiler, short = "And there is a line", "Les."
    rows = [(i, f"{boiler}\nonly {word(i)}") for i in range(12)]
    rows += [(20 + i, "\n".join([short, "", f"{i + 100}", " ".join(word(i * 50 + j) for j in range(1, 8))])) for i in range(12)]
    rows.append((40, boiler))
    copied = "\n".join(" ".join(word(1000 + 9 * i + j) for j in range(9)) for i in range(20))
    rows += [(50 + i, copied) for i in range(11)] + [(70 + i, copied + f"\nlast {word(i)} word") for i in range(11)]
    want = {i: (f"only {word(i)}", 2, 1) for i in range(12)}
    want |= {d: (t.removeprefix(short + "\n"), 4, 1) for d, t in rows if 20 <= d < 32}
    want[40] = ("", 1, 1)
    assert {d: x for d, *x in check(spark, rows)} == {d: list(x) for d, x in want.items()}


def test_ties_and_a_very_long_line(spark):
    """Nine documents are too few, ten are enough; a long line and long documents are read whole."""
    r = random.Random(8)
    long = " ".join(words(r, 20_000))
    rows = [(i, f"nine of us say this\n{' '.join(words(r, 30))}") for i in range(9)] + [(20 + i, f"{long}\n" + "\n".join(" ".join(words(r, 9)) for _ in range(3000))) for i in range(10)]
    want = check(spark, rows, 2)
    assert [(d, n) for d, _, _, n in want] == [(20 + i, 1) for i in range(10)] or not want


def test_other_columns_pass(spark):
    rows = [(i, f"this line is on all pages\n{i} own {'x' * i}", f"l{i}", i) for i in range(12)]
    got = lines.drop_recurring(spark.createDataFrame(rows, SCHEMA), 10, keep=("lang", "found")).collect()
    assert sorted((r.doc_id, r.lang, r.found) for r in got) == [(i, f"l{i}", i) for i in range(12)]


def test_tree_places_lines_by_few_hashes(monkeypatch):
    """Leaves and short templates are those of the whole lines, but of a long line only leading tokens are hashed."""
    r = random.Random(3)
    parts = ["a", "b1", "é", "22", "3", " ", "  ", "\n", "\n\n", "\t", "\r", "\x0b", "y" * 40]
    batches = [["".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randrange(60))).encode() for _ in range(r.randrange(1, 6))] for _ in range(300)]
    for texts in [*batches, [b""], [b"", b""], [b"\n"], [b"1 2 3 4"], [b"1 2 3 4 a\n1 2 3 4 5"]]:
        whole, heads = lines.Lines(texts), lines.Heads(texts)
        assert (whole.tokens == heads.tokens).all() and (whole.of_doc == heads.of_doc).all() and (whole.offsets == heads.offsets).all()
        real = whole.tokens > 0
        assert (np.where(whole.deep, whole.leaf, whole.plain)[real] == heads.key[real]).all()
    mixed, mix = [], textkit.mix
    for module in (lines, textkit):
        monkeypatch.setattr(module, "mix", lambda h: (mixed.append(h.size), mix(h))[1])
    texts = ["\n".join(" ".join(words(r, 100)) for _ in range(20)) for _ in range(10)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(10)), "text": texts})
    assert sum(x.num_rows for x in lines._tree(4)([batch])) and sum(mixed) < 200 * 10

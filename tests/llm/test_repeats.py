"""Repeated bytes against a table of all strings of 400 bytes."""

import hashlib
import random
from collections import Counter

import numpy as np

from cadenza.llm import repeats as R


def naive(docs, length=400):
    texts = [(t or "").encode() for _, t in docs]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc, _), t in zip(docs, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        steps = np.diff(np.concatenate([[False], gone[:-1], [False]]).astype(int))
        out.append((doc, len(t), int(gone.sum()), int((steps > 0).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def corpus():
    rng = random.Random(4)
    words = ["the", "of", "über", "naïve", "tale", "river", "日本", "seven", "stone", "q"]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    passages = [prose(n) for n in (60, 90, 150, 400)]
    out = []
    for k in range(90):
        text = prose(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            cut = rng.randint(0, len(text))
            text = text[:cut] + rng.choice(passages) + text[cut:]
        if rng.random() < 0.3 and text:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice("xyz") + text[at + 1 :]
        out.append((k, text))
    copies = [(100 + k, out[k % 7][1]) for k in range(25)]
    edges = [(200, None), (201, ""), (202, "a" * 399), (203, "b" * 400), (204, "c" * 401), (205, "ab" * 700), (206, "abc" * 133), (207, prose(70) + "\n" + "go " * 500), (208, "ä" * 200), (209, "ä" * 201), (None, passages[3]), (None, passages[3]), (300, passages[2]), (300, passages[2]), (300, prose(90))]
    return out + copies + edges


def test_against_all_strings(spark):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in corpus()], "doc_id long, text string, name string, core int").repartition(6)
    want = naive(corpus())
    assert Counter(map(tuple, R.digested(docs).collect())) == want
    assert sum(r[2] > 0 for r in want.elements()) > 60


def test_hot_classes_are_cut(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    assert Counter(map(tuple, R.digested(docs, hot=2).collect())) == naive(corpus())


def test_a_passage_in_many_contexts(spark):
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefgh ", k=520))
    docs = [(k, "".join(rng.choices("ijklmnop ", k=300)) + passage[: 420 + k % 5 * 25] + "".join(rng.choices("ijklmnop ", k=300))) for k in range(60)]
    assert Counter(map(tuple, R.digested(spark.createDataFrame(docs, "doc_id int, text string"), hot=4).collect())) == naive(docs)


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert R.digested(none).count() == 0
    text = "".join(random.Random(1).choices("abc ", k=450))
    docs = spark.createDataFrame([("x1", text), ("7", text + "!"), (None, "short")], "doc_id string, text string")
    assert {tuple(r)[:4] for r in R.digested(docs).collect()} == {(None, 450, 450, 1), (7, 451, 450, 1), (None, 5, 0, 0)}
    assert {(r["n_bytes"], bytes(r["kept"])) for r in R.remaining(docs).collect()} == {(450, b""), (451, b"!"), (5, b"short")}


def test_anchors_follow_the_string():
    rng = random.Random(2)
    shared = bytes(rng.choices(b"abcd", k=460))
    a, b = bytes(rng.choices(b"abcd", k=300)) + shared, bytes(rng.choices(b"abcd", k=77)) + shared + b"zz"

    def places(text, at):
        start, count, anchor = R.anchors(np.frombuffer(text, np.uint8))
        return [int(anchor[np.searchsorted(start, at + k, "right") - 1]) - at for k in range(61)]

    assert places(a, 300) == places(b, 77)
    for width in (1, 2, 3, 200):
        hashes = R.grams(np.frombuffer(a, np.uint8), width)
        assert len(hashes) == len(a) - width + 1 and len(set(hashes.tolist())) == len({a[i : i + width] for i in range(len(hashes))})


def test_common_prefixes():
    rng = random.Random(3)
    for _ in range(200):
        parts = []
        base = [rng.randint(1, 3) for _ in range(20)]
        for _ in range(rng.randint(1, 6)):
            part = list(base) if rng.random() < 0.6 else [rng.randint(1, 3) for _ in range(rng.randint(1, 25))]
            part[rng.randrange(len(part))] = rng.randint(1, 4)
            parts += [*part, 0]
        depth = rng.choice([1, 3, 5, 8])
        x = np.array(parts, np.int16)
        order, place = R.suffix_order(x, depth)
        tops = [tuple((parts[i:] + [0] * depth)[:depth]) for i in order]
        assert tops == sorted(tops) and list(place[order]) == list(range(len(x)))
        got = R.common_prefixes(x, order, depth)
        for k in range(1, len(x)):
            a, b = parts[order[k - 1] :], parts[order[k] :]
            n = next(i for i in range(len(a) + 1) if i >= min(len(a), len(b)) or a[i] != b[i])
            if n <= a.index(0):
                assert got[k] == min(n, depth)

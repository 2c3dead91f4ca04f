"""Periodic runs against a search of all periods."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.llm import runs as R
from cadenza.llm.wordcodes import bounds, codes


def naive_runs(x, exponent=4, shortest=6):
    """All stretches that agree with themselves one period on, whose period no shorter one is."""
    n, out = len(x), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(shortest, exponent * q) and not any(all(x[i + k] == x[i + k + p] for k in range(length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1 if j == i else j
    return sorted(out, key=lambda r: (r[0], r[2]))


@st.composite
def sequences(draw):
    x = draw(st.lists(st.integers(0, 3), max_size=50))
    if len(x) > 3 and draw(st.booleans()):
        a = draw(st.integers(0, len(x) - 1))
        p = 1 + (len(x) - a) // draw(st.integers(3, 10))
        x = [x[i] if i < a else x[a + (i - a) % p] for i in range(len(x))]
    return x


@settings(max_examples=400, deadline=None)
@given(sequences())
def test_runs_equal_the_search(x):
    assert R.runs(x) == naive_runs(x)


@settings(max_examples=200, deadline=None)
@given(st.lists(sequences(), max_size=5))
def test_zones_lose_no_run(rows):
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    got = R.rows_runs(np.array(sum(rows, []), np.int64), first)
    assert got == {k: own for k, r in enumerate(rows) if (own := naive_runs(r))}


def test_next_smaller_suffixes():
    rng = random.Random(5)
    for _ in range(300):
        x = [rng.randrange(3) for _ in range(rng.randint(0, 30))]
        after, shared = R.lyndon_edges(x)
        for i in range(len(x)):
            want = next((j for j in range(i + 1, len(x)) if x[j:] < x[i:]), len(x))
            assert after[i] == want
            if want < len(x):
                assert shared[i] == next((k for k in range(len(x)) if want + k >= len(x) or x[i + k] != x[want + k]), 0)


def test_words_have_their_own_numbers():
    rng = random.Random(3)
    words = ["a", "b", "ab", "a\0", "abcdefgh", "abcdefghi", "abcdefgh\0", "ä" * 4, "x" * 64, "x" * 65, "x" * 70, "x" * 69 + "y"]
    own = [rng.choice(words) for _ in range(300)]
    data = np.frombuffer(" ".join(own).encode(), np.uint8)
    begin, end, first = bounds(data, np.array([0, len(data)]), R._WORD)
    numbers, n = codes(data, begin, end - begin)
    assert list(first) == [0, 300] and n == len(set(own))
    assert all((numbers[i] == numbers[j]) == (own[i] == own[j]) for i in range(300) for j in range(i))


def naive_row(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = naive_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def rows():
    rng = random.Random(7)
    words = ["the", "a", "Haus", "über", "l'été", "x" * 80, "1.5", " "]
    out = []
    for k in range(150):
        text = [rng.choice(words) for _ in range(rng.randint(0, 90))]
        if k % 3 == 0 and text:
            a = rng.randrange(len(text))
            text += text[a : a + rng.randint(1, 6)] * rng.randint(2, 9)
        out.append((k, rng.choice(["", " ", "\n"]) + "".join(w + rng.choice([" ", "\n", "\t  "]) for w in text)))
    return out + [(200, None), (201, ""), (202, " \n "), (203, "go " * 3_000), (None, "a b " * 9), (None, None), (7, "z " * 6), (7, "z " * 6), (204, "z " * 5)]


def test_digests(spark):
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows()], "doc_id long, text string, start string, n_runs string").repartition(3)
    assert Counter(map(tuple, R.digested(docs, exercise=True).collect())) == Counter(naive_row(d, t) for d, t in rows())
    assert R.digested(docs.limit(0)).count() == 0


def test_lists_and_collapsed_texts(spark):
    docs = spark.createDataFrame([("a", "one two one two one two one two end", 1), ("b", "plain  text", 2), (None, None, 3), ("c", "x x\nx x x x", 4)], "doc_id string, text string, length int")
    assert {tuple(r) for r in R.listed(docs).collect()} == {("a", 0, 8, 2), ("c", 0, 6, 1)}
    short = R.collapsed(docs)
    assert short.dtypes == docs.dtypes
    assert {tuple(r) for r in short.collect()} == {("a", "one two end", 1), ("b", "plain  text", 2), (None, None, 3), ("c", "x", 4)}
    assert R.digested(docs).where("doc_id is null").count() == 4

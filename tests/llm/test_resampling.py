"""Importance resampling against feature strings and their checksums."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from cadenza.llm import resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def bucket(feature, n=10_000):
    return zlib.crc32(feature.encode()) % n


def naive(docs, target):
    s, t = Counter(bucket(f) for _, x in docs for f in features(x)), Counter(bucket(f) for x in target for f in features(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    rows = []
    for k, (doc, x) in enumerate(docs):
        h = int(hashlib.sha256(f"42:{'null' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in features(x))
        rows.append([doc, len(features(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x)), k])
    long = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0], r[6]))
    for rank, r in enumerate(long[: len(long) * 5 // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in rows)


def corpus(n=400):
    rng = random.Random(11)
    pool = ["alpha", "Beta", "gamma9", "straße", "ÉTÉ", "x" * 70, "don't", "a-b", "日本", "z"]
    out = [(k, " ".join(rng.choices(pool, k=rng.randint(0, 60)))) for k in range(n)]
    return out + [(900, None), (901, ""), (902, " ... "), (903, "beta gamma " * 20_000), (None, "alpha " * 30), (5, "alpha beta " * 12), (5, "alpha beta " * 12)]


TARGET = ["alpha beta gamma9 z z", "STRASSE straße", "", None]


def test_against_strings(spark):
    docs = spark.createDataFrame([(d, t, 1.5) for d, t in corpus()], "doc_id long, text string, score double").repartition(5)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    assert Counter(map(tuple, R.resampled(docs, target).collect())) == naive(corpus(), TARGET)


def test_ranks_do_not_depend_on_the_split(spark):
    docs = spark.createDataFrame(corpus(150), "doc_id long, text string")
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    found = [Counter(map(tuple, R.resampled(docs.repartition(n), target, percent=40).collect())) for n in (1, 7)]
    assert found[0] == found[1] and sorted(r[4] for r in found[0].elements() if r[4]) == list(range(1, 1 + max(r[4] or 0 for r in found[0])))


def test_empty_tables(spark):
    docs, none = spark.createDataFrame(corpus(30), "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert R.resampled(none, docs).count() == 0
    assert Counter(map(tuple, R.resampled(docs, none).collect())) == naive(corpus(30), [])


def test_states_of_paths():
    texts = [t or "" for _, t in corpus(40)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    trie = R.Trie(data, offsets)
    want = Counter(zlib.crc32(f.encode()) for t in texts for f in features(t))
    got = Counter()
    for count, state in zip(trie.count, trie.state, strict=True):
        for c, s in zip(count.tolist(), state.tolist(), strict=True):
            got[s] += c
    assert got == want
    for n in (1, 2, 3, 80):
        state = np.array([zlib.crc32(b"head")], np.uint32)
        assert R._apply(R._moved(n)[None], np.zeros(1, np.int64), state)[0] ^ zlib.crc32(bytes(n)) == zlib.crc32(b"head" + bytes(n))

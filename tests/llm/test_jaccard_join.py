import random
import re

import pytest

from cadenza.llm import jaccard_join as jj


def brute(rows, width=5):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets, parent = {}, {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())
        parent[doc] = doc

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in docs}


def made(seed, n=220):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    passage = rng.choices(vocabulary, k=60)
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.35 and texts:
            words = rng.choice(texts).split()
            for _ in range(rng.randint(0, 3)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
        elif kind < 0.5:
            texts.append(" ".join([*rng.choices(vocabulary, k=rng.randint(1, 40)), *passage]))
        else:
            texts.append(" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 14, 30, 90]))))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    texts = made(seed)
    rows = [(3 * k + 1, t) for k, t in enumerate(texts)] + [(0, None), (2, " \t\n"), (5, "Ünïcode ÉÈ word  x y"), (6, "ünïcode ÉÈ word  x y")]
    rows += [(700 + k, " ".join(f"m{j}" for j in range(200)) + f" {k}") for k in range(60)]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, key string, n int").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jj.similar(df, bins=1 << 12).collect()}
    assert got == brute(rows)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jj.similar(empty, bins=1 << 10).collect() == []
    long = " ".join(f"word{k}" for k in range(100_000))
    rows = [(9, long), (4, long + " end"), (None, long), (None, None), (7, "a" * 300_000), (8, "a" * 300_000)]
    got = jj.similar(spark.createDataFrame(rows, "doc_id long, text string"), bins=1 << 10).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (-1, -1), (4, 4), (7, 7), (8, 7), (9, 4)]


def test_plan_of_sizes():
    assert [jj.ceil_part(n) for n in (1, 4, 5, 8)] == [1, 3, 4, 6]
    for a in range(1, 30):
        for b in range(a, 30):
            o = jj.overlap(a, b)
            assert 4 * o >= 3 * (a + b - o) and 4 * (o - 1) < 3 * (a + b - o + 1)


def test_family_of_near_copies_that_are_not_linked(spark):
    """2,000 edits of one text, of which many are near to each other and yet unlinked: same components as by all pairs."""
    rng = random.Random(4)
    base = [f"b{k}" for k in range(110)]
    rows = []
    for k in range(2000):
        words = list(base)
        for at in rng.sample(range(len(words)), rng.randint(2, 9)):
            words[at] = f"e{k}x{at}" if rng.random() < 0.8 else f"e{rng.randint(0, 9)}"
        rows.append((k * 7 % 4001, " ".join(words)))
    rows += [(rows[5][0], rows[900][1] + " and more"), (rows[17][0], "an other text of one doc_id " * 9)]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jj.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), bins=1 << 14).collect()}
    parts = brute_by_rows(rows)
    assert {(d, c) for d, _, c in got} == set(parts.items())
    assert len(set(parts.values())) > 500 and max(list(parts.values()).count(c) for c in set(parts.values())) > 100


def brute_by_rows(rows, width=5):
    """doc_id -> component, by comparing all pairs of rows in numpy; rows of one doc_id are one node."""
    import numpy as np

    sets = [frozenset(zip(*(t.split()[k:] for k in range(width)), strict=False)) for _, t in rows]
    place = {s: k for k, s in enumerate({x for own in sets for x in own})}
    m = np.zeros((len(rows), len(place)), np.float32)
    for k, own in enumerate(sets):
        m[k, [place[x] for x in own]] = 1
    both, n = m @ m.T, m.sum(1)
    near = 100 * both >= 75 * (n[:, None] + n[None, :] - both)
    ids = np.array([d for d, _ in rows])
    near |= ids[:, None] == ids[None, :]
    best = ids.copy()
    while True:
        new = np.where(near, best[None, :], 1 << 60).min(1)
        if (new == best).all():
            return dict(zip(ids.tolist(), best.tolist(), strict=True))
        best = new


def test_ids_that_are_no_numbers(spark):
    docs = spark.createDataFrame([("x", "a b c d e f g"), ("1", "a b c d e f g"), ("2", "a b c d e f g"), (None, "h")], "doc_id string, text string")
    assert sorted(map(tuple, jj.similar(docs, bins=1 << 10).collect()), key=str) == [(1, 3, 1), (2, 3, 1), (None, 1, None), (None, 3, None)]
    assert sorted(str(r["doc_id"]) for r in jj.kept_rows(docs).collect()) == ["1", "None", "x"]

"""Exact deduplication, fingerprints, token counts and the pipeline."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from cadenza.llm import arrays, exact_dedup, fingerprints, queries, token_counts, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string"
SPACE = re.compile("[\x20\x09-\x0d]")


def rows(n=150, seed=1):
    rng = random.Random(seed)
    base = [" ".join(f"w{rng.randint(0, 500)}" for _ in range(rng.randint(0, 30))) for _ in range(40)]
    out = [(k, rng.choice(base).replace(" ", rng.choice([" ", "  ", "\n"])), "en", "s", 1, "k") for k in range(n)]
    return out + [(1000, None, None, None, None, None), (1001, "", "en", "s", 0, "k"), (1002, " \t\n\x0b\x0c\r ", "en", "s", 7, "k"), (1003, "a\u00a0b", "en", "s", 3, "k"), (1004, "ab", "en", "s", 2, "k"), (1005, "é" * 100_000, "en", "s", 1, "k"), (1006, "é" * 50_000 + " " + "é" * 50_000, "en", "s", 1, "k"), (7, out[7][1], "en", "s", 1, "k")]


@pytest.mark.parametrize("capacity", [3, 4096])
def test_exact_dedup(spark, capacity):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = exact_dedup.deduplicated(docs, capacity=capacity).collect()
    groups = {}
    for doc, text, *_ in data:
        groups.setdefault(SPACE.sub("", text or ""), []).append((-len(text or ""), doc))
    assert len(got) == len(data) and sum(r["kept"] for r in got) == len(groups)
    by_id = {r["doc_id"]: r for r in got}
    for doc, text, *_ in data:
        own = groups[SPACE.sub("", text or "")]
        r = by_id[doc]
        assert r["keep_id"] == min(own)[1] and r["group_size"] == len(own) and r["text_sha256"] == hashlib.sha256(SPACE.sub("", text or "").encode()).hexdigest()
    if capacity == 3:
        assert len({r["bucket"] for r in got}) > 4
    kept = exact_dedup.kept_rows(docs, capacity=capacity)
    assert kept.dtypes == docs.dtypes and sorted(r["doc_id"] for r in kept.collect()) == sorted(min(g)[1] for g in groups.values())
    assert exact_dedup.deduplicated(docs.limit(0)).count() == 0 and exact_dedup.kept_rows(docs.limit(0)).count() == 0


def test_collisions_are_told_apart_by_bytes(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA).repartition(5)
    want = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.deduplicated(docs).collect()}
    got = exact_dedup.deduplicated(docs, capacity=4, bits=2).collect()  # four keys and sixteen digests for all texts
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got} == want and len(got) == len(data)


def test_a_second_batch_goes_into_the_index(spark):
    first = [(k, f"text {k % 30}", "en", "s", 1, "k") for k in range(50)]
    second = [(k, f"text {k % 40}" + " " * (k % 3), "en", "s", 1, "k") for k in range(100, 180)]
    a, b = spark.createDataFrame(first, SCHEMA).repartition(3), spark.createDataFrame(second, SCHEMA).repartition(4)
    entries = exact_dedup.segments(a)
    before = exact_dedup.index(entries, capacity=8)
    after, judged = exact_dedup.inserted(before, b, batch=1, capacity=8)
    whole = exact_dedup.deduplicated(a.union(b), capacity=8).collect()
    assert after.count() == len({r["text_sha256"] for r in whole}) and after.select("bucket").distinct().count() >= before.select("bucket").distinct().count() > 2
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in judged.collect()} == {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in whole if r["doc_id"] >= 100}


def test_kept_rows_hand_on_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b", 1, 2, 3, 4), (1, "a b", 5, 6, 7, 8), (2, "ab", 1, 2, 3, 4), (None, None, 0, 0, 0, 0), (None, " ", 9, 9, 9, 9)], "doc_id long, text string, raw int, _raw int, __raw int, kept int")
    got = exact_dedup.kept_rows(docs)
    assert got.dtypes == docs.dtypes and sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == [(0, " "), (1, "a b")]


def naive_directory(counts, capacity, bits):
    """Buckets are split and the directory doubles until none is overfull: the bucket of each slot, by its first one."""
    depth, slots = 0, [(0, 0)]  # (prefix, local depth)
    keys = lambda b: sum(n for p, n in counts.items() if p >> (bits - b[1]) == b[0])
    while overfull := {b for b in slots if b[1] < bits and keys(b) > capacity}:
        if any(b[1] == depth for b in overfull):
            slots, depth = [b for b in slots for _ in range(2)], depth + 1
        slots = [((k >> (depth - b[1] - 1), b[1] + 1) if b in overfull else b) for k, b in enumerate(slots)]
    return {p: b[0] << (bits - b[1]) for p in counts for b in [slots[p >> (bits - depth)]]}


@pytest.mark.parametrize("capacity", [1, 20, 50, 10_000])
def test_directory_doubles(spark, capacity):
    rng = random.Random(capacity)
    for counts in ({0: 100, 1: 1, 2: 1, 3: 1, 31: 60}, {k: rng.randint(1, 30) for k in rng.sample(range(32), 20)}, {}):
        rows = spark.createDataFrame(list(counts.items()), "slot long, n long")
        assert {r["slot"]: r["bucket"] for r in exact_dedup.directory(rows, capacity, 5).collect()} == naive_directory(counts, capacity, 5)


def test_exact_dedup_with_ids_of_any_type(spark):
    data = [("x9", "one  two"), ("x10", "one two"), ("a", "onetwo"), (None, "one  two"), (None, None), ("b", ""), ("c", "else")]
    docs = spark.createDataFrame(data, "doc_id string, text string")
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.deduplicated(docs, capacity=1).collect()}
    assert got == {("x9", "x9", 4, True), ("x10", "x9", 4, False), ("a", "x9", 4, False), (None, "x9", 4, False), (None, "b", 2, False), ("b", "b", 2, True), ("c", "c", 1, True)}
    assert sorted(r["doc_id"] for r in exact_dedup.kept_rows(docs).collect()) == ["b", "c", "x9"]


def test_fingerprints(spark):
    data = [r for r in rows() if r[0] != 7 or r[1] is None] + [(5000, "one\ntwo\nthree three", "en", "s", 1, "k"), (5001, "three three\none\ntwo", "en", "s", 1, "k"), (None, "no id", None, None, None, None)]
    docs = spark.createDataFrame(data, SCHEMA).repartition(6)
    got = fingerprints.fingerprinted(docs).collect()
    order = sorted(data, key=lambda r: -1 if r[0] is None else r[0])
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(data)
    for k, (doc, text, *_) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        new = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        r = by_id[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.vectors([text]).texts()[0] and r["edited_fingerprint"] == fingerprints.vectors([new]).texts()[0]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert by_id[5000]["fingerprint"] == by_id[5001]["fingerprint"] and by_id[1001]["fingerprint"] != by_id[1002]["fingerprint"]
    assert fingerprints.fingerprinted(docs.limit(0)).count() == 0
    assert fingerprints.fingerprinted(docs.where("doc_id = 5000")).first()["near_next"] == 1.0


def test_fingerprints_are_homomorphic():
    v = fingerprints.vectors
    assert (v(["a b c\nd e f"]) - v(["d e f"])).texts() == v(["a b c"]).texts()
    assert (v(["a b c"]) + v(["x"])).texts() == v(["x\na b c"]).texts()
    many = [" ".join(f"w{np.random.default_rng(k).integers(0, 10**6)}" for k in range(s, s + 400)) for s in (0, 100, 5000)]
    near = fingerprints.likeness(v([many[0], many[0]]), v([many[1], many[2]]))
    assert abs(near[0] - 0.75) < 0.25 and near[1] < 0.3


def naive_vectors(text):
    """Exact lanes and sketch, paragraph by paragraph and word by word."""
    exact, sketch = [0] * fingerprints.EXACT, [0] * fingerprints.SKETCH
    for paragraph in text.split("\n"):
        digest = hashlib.blake2b(paragraph.encode(), digest_size=8 * fingerprints.EXACT).digest()
        for k in range(fingerprints.EXACT):
            exact[k] = (exact[k] + int.from_bytes(digest[8 * k : 8 * k + 8], "little")) % (1 << 64)
        found = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", paragraph)]
        runs = [found[k : k + fingerprints.WIDTH] for k in range(len(found) - fingerprints.WIDTH + 1)] or ([found] if found else [])
        for run in runs:
            data = np.frombuffer(b" ".join(run), np.uint8)
            (h,), _ = arrays.shingles(*arrays.words(data, np.array([0, len(data)]), lower=False), fingerprints.WIDTH)
            sketch[int(h) % fingerprints.SKETCH] += -1 if int(h) >> 40 & 1 else 1
    return exact, sketch


def naive_likeness(a, b):
    if a == b:
        return 1.0
    size = sum(x * x for x in a[1]) * sum(x * x for x in b[1])
    return min(1.0, max(0.0, sum(x * y for x, y in zip(a[1], b[1], strict=True)) / size**0.5)) if size else 0.0


def test_fingerprints_against_naive_sums(spark):
    rng = random.Random(6)
    data = [(k, "\n".join(" ".join(f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 5)))) for k in range(40)] + [(50, None), (51, ""), (52, "\n"), (53, "é\u00a0b  c\n\nx"), (54, "same\ntext"), (55, "text\nsame"), (55, "text\nsame")]
    got = {}
    for r in fingerprints.fingerprinted(spark.createDataFrame(data, "doc_id long, text string").repartition(7)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(data)
    for k, (doc, text) in enumerate(data):
        text, after = text or "", data[(k + 1) % len(data)][1] or ""
        new = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        own, other, following = naive_vectors(text), naive_vectors(new), naive_vectors(after)
        written = lambda v: "".join(f"{x:016x}" for x in v[0]) + "".join(f"{x % (1 << 32):08x}" for x in v[1])
        r = got[doc][data[:k].count(data[k])]
        assert r["fingerprint"] == written(own) and r["edited_fingerprint"] == written(other)
        assert abs(r["near_edited"] - naive_likeness(own, other)) < 1e-9 and abs(r["near_next"] - naive_likeness(own, following)) < 1e-9


def test_stored_fingerprints_are_changed_without_texts(spark):
    v = fingerprints.vectors
    texts = {1: "a b c\nd e f", 2: "x", 3: "", 4: "keep"}
    table = spark.createDataFrame([(k, f) for k, f in zip(texts, v(list(texts.values())).texts(), strict=True)], "doc_id long, fingerprint string")
    assert fingerprints.Vectors.read(v(["a\nb"]).texts()).texts() == v(["a\nb"]).texts()
    moves = [(1, "d e f", -1), (1, "new one", 1), (2, "y", 1), (2, "y", 1), (2, "y", -1), (3, "", -1), (3, "z z z", 1), (9, "unknown", 1), (4, "nothing", None)] + [(1, "hot", 1), (1, "hot", -1)] * 500
    got = {r[0]: r[1] for r in fingerprints.changed(table, spark.createDataFrame(moves, "doc_id long, paragraph string, sign int").repartition(5)).collect()}
    assert got == dict(zip(texts, v(["new one\na b c", "x\ny", "z z z", "keep"]).texts(), strict=True))
    assert fingerprints.changed(table.limit(0), spark.createDataFrame(moves, "doc_id long, paragraph string, sign int")).count() == 0


def test_likeness_of_long_repetitive_texts():
    v, text = fingerprints.vectors, "a b " * 50_000  # more on a lane than 16 bits hold; in three fifths of it they are not
    assert fingerprints.likeness(v([text, text]), v(["a b " * 30_000, "c d " * 50_000])).round(3).tolist() == [1.0, 0.0]


def test_token_counts(spark, tmp_path):
    docs = spark.createDataFrame(rows(), SCHEMA)
    rollup = token_counts.Rollup(spark, str(tmp_path / "r"))
    assert rollup.totals().count() == 0
    assert rollup.commit("a", token_counts.inserted(docs, "words-1")) and not rollup.commit("a", token_counts.inserted(docs, "words-1"))
    one = {tuple(r) for r in rollup.totals().collect()}
    rollup.compact()
    assert not rollup.commit("a", token_counts.inserted(docs, "words-1")) and {tuple(r) for r in rollup.totals().collect()} == one
    rollup.commit("b", token_counts.revised(docs, "words-1", "pieces-2"))
    assert {r["version"] for r in rollup.totals().collect()} == {"pieces-2"}
    rollup.commit("c", token_counts.inserted(docs, "pieces-2", -1))
    rollup.compact()
    assert rollup.totals().count() == 0 and rollup.commit("d", token_counts.inserted(docs.limit(0), "words-1"))
    want = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows())
    assert sum(r[4] for r in one) == want and sum(r[3] for r in one) == len(rows())


def test_public_tokenizers_are_counted(spark, tmp_path):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    from cadenza.llm import pieces

    docs = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    exact, library = Tokenizer.from_file(tokens.vocabulary_path(tokens.VOCABULARY)), SentencePieceProcessor(model_file=tokens.vocabulary_path(pieces.MODEL))
    rollup = token_counts.Rollup(spark, str(tmp_path / "r"))
    rollup.commit("load", token_counts.inserted(docs, "byte_bpe_50k"))
    rollup.commit("half", token_counts.revised(docs.where("doc_id % 2 = 0"), "byte_bpe_50k", "piece_bpe_32k"))
    got = {}
    for r in rollup.totals().collect():
        got[r["version"]] = got.get(r["version"], 0) + r["tokens"]
    want = {"byte_bpe_50k": sum(len(exact.encode(t or "", add_special_tokens=False).ids) for d, t, *_ in rows() if d % 2), "piece_bpe_32k": sum(len(library.encode(t or "")) for d, t, *_ in rows() if d % 2 == 0)}
    assert got == want


def test_other_rows_under_a_known_name_are_an_error(spark, tmp_path):
    docs = spark.createDataFrame([*rows(), (None, "no id", "en", "s", 1, "k")], SCHEMA)
    rollup = token_counts.Rollup(spark, str(tmp_path / "r"))
    assert rollup.commit("a", token_counts.inserted(docs, "words-1"))
    with pytest.raises(ValueError):
        rollup.commit("a", token_counts.inserted(docs.where("doc_id > 3"), "words-1"))
    assert not rollup.commit("a", token_counts.inserted(docs.where("doc_id > 3"), "words-1"), verify=False)
    assert not rollup.commit("a", token_counts.inserted(docs.repartition(7), "words-1"))


def test_fingerprints_of_ids_that_are_no_numbers(spark):
    docs = spark.createDataFrame([("x", "one two"), ("7", "one two"), (None, None)], "doc_id string, text string")
    got = fingerprints.fingerprinted(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (0, 7), (7, 7)]


def test_registry():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)


def test_pipeline(spark):
    import corpus_pipeline as p

    from .test_jaccard_join import brute
    from .test_models import WORDS
    from .test_pii import base

    rng = random.Random(9)
    texts = [" ".join(rng.choices(WORDS[lang], k=rng.randint(6, 40))) for lang in sorted(WORDS) for _ in range(30)]
    data = [(k, t, "en de fr".split()[0], "s", len(t), "k") for k, t in enumerate(texts)]
    data += [(500, texts[0] + " ", "en", "s", 1, "k"), (501, texts[1], "en", "s", 1, "k"), (502, "1 2 3", "en", "s", 5, "k"), (503, None, "en", "s", 0, "k"), (504, "mail me at a.b@c.de the and of with", "en", "s", 1, "k")]
    docs = spark.createDataFrame(data, SCHEMA)
    steps = {}
    now = docs
    for name, stage in p.STAGES[:-1]:
        now = stage(spark, now, "")
        assert now.dtypes == docs.dtypes, name
        steps[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    assert steps["language_id"].keys() == {r[0] for r in data} - {502, 503}
    best = {}
    for doc, text in steps["language_id"].items():
        key = SPACE.sub("", text)
        best[key] = min(best.get(key, (0, 10**9)), (-len(text), doc))
    assert steps["exact_dedup"].keys() == {d for _, d in best.values()}
    near = brute(list(steps["exact_dedup"].items()))
    assert steps["jaccard_join"].keys() == {d for d, (_, c) in near.items() if d == c}
    assert steps["pii"].keys() == steps["jaccard_join"].keys() and all(not base(t) for t in steps["pii"].values())
    packed = p.STAGES[-1][1](spark, now, "").toPandas()
    for (doc, text), ids in zip(steps["pii"].items(), tokens.encode(steps["pii"].values()), strict=True):
        own = packed[packed["doc_id"] == doc].sort_values("start")
        ids = np.append(ids, 0).astype("<u4")
        assert own["length"].sum() == len(ids) and [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own.itertuples()] == own["ids_crc32"].tolist()


def test_pipeline_edges(spark):
    """Empty tables, very long texts and columns that clash with what the operators use, through all stages."""
    import corpus_pipeline as p

    from .test_models import WORDS

    rng = random.Random(3)
    names = ["found", "raw", "_raw", "row", "kept", "component", "lists", "doc", "start", "a", "b", "key2", "id", "keep_id", "score", "part"]
    long = " ".join(rng.choices(WORDS["en"], k=120_000))
    texts = [(k, " ".join(rng.choices(WORDS[lang], k=20 + k)), lang) for k, lang in enumerate(sorted(WORDS) * 12)] + [(90, long, "en"), (91, long + " and", "en"), (92, None, None), (93, "\u0301", "en"), (None, "the and of with that", "en"), (94, "the and of with " * 30 + "a.b@c.de", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names)
    docs = spark.createDataFrame([(d, t, lang, "s", len(t or ""), *range(len(names))) for d, t, lang in texts], schema).repartition(4)
    for now in (docs, docs.limit(0)):
        for name, stage in p.STAGES[:-1]:
            now = stage(spark, now, "")
            assert now.dtypes == docs.dtypes, name
        got = {r["doc_id"]: r for r in now.collect()}
        out = p.STAGES[-1][1](spark, now, "")
        if not got:
            assert out.count() == 0
            continue
        assert set(got) == {d for d, *_ in texts} - {91, 92, 93} and all([*r][5:] == list(range(len(names))) for r in got.values())
        assert got[90]["text"] == long and got[94]["text"].endswith("<email>") and got[94]["n_chars"] == len(got[94]["text"])
        assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == set(got)

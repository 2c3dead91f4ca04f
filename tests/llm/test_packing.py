import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from cadenza.llm import packing, tokens

TEXTS = [None, "", "a", "Hello  world\n\n 123 é😀", "x" * 5000, "the cat sat " * 900, "<|endoftext|> in a text", "tab\t \r\n nbsp\u00a0 end ", "don't we'll I'M"] + [f"document {k} " * (k % 37) for k in range(60)]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(k if k else None, t, 7, "s") for k, t in enumerate(texts)], "doc_id long, text string, start long, tier string")


def test_ids_are_those_of_the_tokenizers_file():
    exact = Tokenizer.from_file(tokens.vocabulary_path(tokens.VOCABULARY))
    rng = random.Random(5)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice("ab 'sté1٣\n\t.,!?_日本😀\u2003\u0301") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for text, ids in zip(texts, tokens.encode(texts), strict=True):
        assert ids.tolist() == exact.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("pool", [300, 1 << 20])
def test_every_id_is_packed_once(spark, pool):
    window = 64
    rows = packing.packed(docs(spark).repartition(3), window=window, pool=pool, floor=8).toPandas()
    want = {(-1 if k == 0 else k): np.append(ids, 0).astype("<u4") for k, ids in enumerate(tokens.encode([t or "" for t in TEXTS]))}
    for doc, own in rows.fillna({"doc_id": -1}).groupby("doc_id"):
        own = own.sort_values("start")
        assert own["start"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() == len(want[int(doc)]) == own["doc_tokens"].iloc[0]
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(want[int(doc)][r.start : r.start + r.length].tobytes())
    assert rows["doc_id"].fillna(-1).nunique() == len(TEXTS)
    sums = rows.groupby("sequence_id")["length"].sum()
    assert sums.max() <= window and sum(n & (n - 1) != 0 for n in sums) <= 3  # one padded sequence for each task
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]]
        assert (own["tier"] == own["length"].sum()).all() or ((own["tier"] == window).all() and own["length"].sum() < window)
    short = rows[rows["doc_tokens"] <= window].groupby("doc_id").size()
    assert short.max() <= 1 + packing.MAX_CUTS


def test_steps_are_balanced(spark):
    rows = packing.packed(spark.createDataFrame([(k, "word " * (17 * k % 400)) for k in range(1, 600)], "doc_id long, text string").coalesce(1), window=256).toPandas()
    rows["cost"] = rows["length"] ** 2
    own = rows[rows["tier"] == 256].groupby("step_group").agg(n=("sequence_id", "nunique"), cost=("cost", "sum"))
    own = own[own["n"] == packing.STEP]
    assert own["cost"].max() < 1.15 * own["cost"].min()


def test_empty_and_bad(spark):
    assert packing.packed(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        packing.packed(docs(spark), window=1000)


def test_short_documents_are_joined_and_hardly_cut(spark):
    rng = random.Random(8)
    lengths = [rng.randint(2, 60) for _ in range(3000)] + [1, 1, 1, 1024, 1023, 40, 40]
    out, rest = packing.pack([p for k, n in enumerate(lengths) for p in packing.pieces_of(k, np.zeros(n, np.uint32))])
    assert rest == [] and sum(len(p.ids) for _, own in out for p in own) == sum(lengths)
    by_size = {}
    for tier, own in out:
        by_size[sum(len(p.ids) for p in own)] = by_size.get(sum(len(p.ids) for p in own), 0) + 1
    assert 1024 * by_size[1024] >= 0.5 * sum(lengths) and set(by_size) - {1024, 512, 256} and sum(n for s, n in by_size.items() if s not in (1024, 512, 256)) == 1
    pieces = [p.doc for _, own in out for p in own]
    assert max(pieces.count(k) for k in (0, 1, 2999, 3003, 3004)) <= 3 and len(pieces) < 1.05 * len(lengths)


@pytest.mark.parametrize("lengths", [[5], [1023], [1000] * 90, [513] * 70, [1] * 700, [3000] * 9, [1024] * 3, [700, 700, 2], list(range(1, 1200, 7))])
def test_pack_keeps_every_id_and_bounds_cuts(lengths):
    for pool in (2000, 1 << 20):
        held, out, n = [], [], 0
        for k, size in enumerate(lengths):
            held += packing.pieces_of(k, np.arange(size, dtype=np.uint32))
            n += size
            if n >= pool:
                full, held = packing.pack(held, last=False)
                out, n = out + full, sum(len(p.ids) for p in held)
        out += packing.pack(held)[0]
        runs, lost = {}, 0
        for _, own in out:
            size = sum(len(p.ids) for p in own)
            lost += 0 if size & (size - 1) == 0 else 1024 - size
            assert 0 < size <= 1024
            for p in own:
                runs.setdefault(p.doc, []).append((p.start, p.ids.tolist()))
        assert {k: [x for _, ids in sorted(r) for x in ids] for k, r in runs.items()} == {k: list(range(n)) for k, n in enumerate(lengths)}
        assert all(len(runs[k]) <= 3 + 2 * ((n - 1) // 1024) for k, n in enumerate(lengths)) and lost <= 1024 + 0.05 * sum(lengths)


def test_ids_of_any_type_ties_repeated_rows_and_very_long_texts(spark):
    text = "many words " * 60_000
    rows = [("7", "same"), ("7", "same"), ("x", "other id"), (None, None), ("12", text)]
    got = packing.packed(spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id string, text string, sequence_id string").coalesce(1)).toPandas()
    n = {len(ids) + 1 for ids in tokens.encode([text])}
    assert got[got["doc_id"] == 12]["length"].sum() in n and len(got[got["doc_id"] == 12]) <= n.pop() // 1024 + 4
    assert sorted(got[got["doc_id"] == 7].groupby("start")["length"].sum() % 2) == [0] * got[got["doc_id"] == 7]["start"].nunique() and got["doc_id"].isna().sum() >= 2

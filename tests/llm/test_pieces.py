import hashlib
import random
import zlib

import numpy as np
from sentencepiece import SentencePieceProcessor

from cadenza.llm import pieces

TEXTS = ["", " ", "a  b", "   x\n\t", "Hello world, this is it.", "é😀ｆ日本", "x" * 3000, "😀" * 50, "    return  y  ", "aaaaaaa aaaa aa", "1234567890" * 20]


def random_texts(n=300):
    rng = random.Random(3)
    return ["".join(rng.choice("eetaoin shrdlu  \n.,é日😀12") for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_ids_are_those_of_the_library():
    own, library = pieces.vocabulary(pieces.vocabulary_path(pieces.MODEL)), SentencePieceProcessor(model_file=pieces.vocabulary_path(pieces.MODEL))
    texts = TEXTS + random_texts()
    for text, ids in zip(texts, pieces.encoded(texts, own), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text)
        assert pieces.decoded(np.frombuffer(ids, "<u4"), own) == text


def test_digests_are_those_of_ids_and_their_decoding():
    own = pieces.vocabulary(pieces.vocabulary_path(pieces.MODEL))
    texts = TEXTS + random_texts() + [TEXTS[4]] * 3 + ["a \u2581b", "\u2581", " lead", "trail ", "long " * 900_000]
    for text, ids, got in zip(texts, pieces.encoded(texts, own), pieces.digests(texts, own), strict=True):
        back = pieces.decoded(np.frombuffer(ids, "<u4"), own)
        assert got == (len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode()).hexdigest()) and back == text.replace("\u2581", " ")


def test_best_scores_against_brute_force():
    own = pieces.Vocabulary(pieces.vocabulary_path(pieces.MODEL))
    own.pieces = {"▁": (1, -4.0), "▁a": (2, -2.0), "a": (3, -3.0), "b": (4, -3.0), "ab": (5, -4.5), "▁ab": (6, -6.5), "ba": (7, -3.5)}
    own.longest, own.penalty = 3, -20.0

    def best(word):
        if not word:
            return 0.0
        options = [own.pieces[word[:n]][1] + best(word[n:]) for n in range(1, 4) if word[:n] in own.pieces and len(word) >= n]
        return max([*options, own.penalty + best(word[1:])])

    by_id = {k: s for k, s in own.pieces.values()}
    words = ["", "a", "ab", "aba", "abab", "bab", "aabb"]
    assert [w for w, _ in pieces._best(words, own)] == sorted(words)
    for word, ids in pieces._best(words, own):
        assert sum(by_id[k] for k in ids) == best("▁" + word)


def test_round_trip_on_spark(spark):
    rows = [(k, t, b"x") for k, t in enumerate(TEXTS)] + [(None, "null id", b""), (99, None, b"")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids binary")
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(docs)).collect()}
    assert back == {k: t or "" for k, t, _ in rows}
    assert pieces.digested(docs.limit(0)).count() == 0 and pieces.digested(docs).count() == len(rows)

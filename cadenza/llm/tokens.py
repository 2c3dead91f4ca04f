"""Byte-level BPE ids of whole texts, by the public vocabulary files."""

from __future__ import annotations

import base64
import importlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str) -> str:
    return importlib.import_module("public_tokenizers").path(name)


@lru_cache(maxsize=4)
def _exact(vocabulary: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


@lru_cache(maxsize=4)
def _specials(vocabulary: str) -> tuple[str, ...]:
    with open(vocabulary, encoding="utf-8") as file:
        return tuple(t["content"] for t in json.load(file).get("added_tokens", []))


@lru_cache(maxsize=4)
def _fast(ranks: str):
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("bpe", pat_str=importlib.import_module("public_tokenizers").PATTERN, mergeable_ranks=table, special_tokens={})


def encode(texts: Iterable[str], vocabulary: str | None = None, ranks: str | None = None) -> Iterator[np.ndarray]:
    """The ids of each text as unsigned 32-bit integers, without added special tokens.

    The ids are those of the tokenizers file. A text that holds none of its special tokens' strings gets them from the
    same vocabulary's rank file, which is some times faster; a text that holds one goes through the tokenizers library,
    which is loaded only then.
    """
    if vocabulary is None:
        vocabulary, ranks = vocabulary_path(VOCABULARY), vocabulary_path(RANKS)
    fast, special = _fast(ranks) if ranks else None, _specials(vocabulary)
    for text in texts:
        if not text:
            yield np.zeros(0, np.uint32)
        elif fast is None or any(s in text for s in special):
            yield np.array(_exact(vocabulary).encode(text, add_special_tokens=False).ids, np.uint32)
        else:
            yield np.array(fast.encode_ordinary(text), np.uint32)

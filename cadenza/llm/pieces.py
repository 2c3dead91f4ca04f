"""Operator 2: SentencePiece encoding and decoding over a trie of distinct words, with the forward state of shared prefixes; for BPE models, as in the registered query, that state is a merge automaton's and holds no scores.

Spaces become marks (U+2581), one more is set before the text, and the text falls into marked words: a run of marks and what
follows. The distinct words of a batch are sorted, so that they form a trie in depth-first order: going from one word to the
next keeps the forward state of their common prefix and computes only what is new. The pieces that end at a place come from
an automaton over all pieces, whose node is part of the state, so that a character costs a step and not a search.

For a unigram model the forward state of a prefix is its best score and the last piece on the best way there; ties go to the longest
last piece. For a BPE model it is the last piece of the prefix's encoding, which the prefix alone determines: it is the one
piece that may follow the last piece of what stands before it, two pieces being compatible if no merge across their border
comes before those that make them. Characters without a piece become the bytes of their UTF-8 form. Either way the ids are those
of the library.

Null and empty texts have no ids and decode to the empty text. Very long words are searched whole, in linear time. Repeated rows are
encoded each. A mark in a text decodes to a space, as in the library. Empty tables give no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cadenza.session import ship

from .tokens import vocabulary_path

MODEL = "piece_bpe_32k.model"
#: Words whose ids a Python worker remembers between batches, and characters in them.
KNOWN_WORDS, KNOWN_CHARACTERS = 1 << 20, 1 << 24
MARK = "▁"
_WORDS = re.compile(f"{MARK}+[^{MARK}]*")


class Vocabulary:
    """pieces: text -> (id, score); the ids of single bytes; what each id decodes to."""

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=model)
        plain = [k for k in range(p.vocab_size()) if not (p.is_control(k) or p.is_unknown(k) or p.is_byte(k) or p.is_unused(k))]
        self.pieces = {p.id_to_piece(k): (k, p.get_score(k)) for k in plain}
        self.bytes = {int(p.id_to_piece(k)[3:5], 16): k for k in range(p.vocab_size()) if p.is_byte(k)}
        self.unknown = p.unk_id()
        self.decoded = [b""] * p.vocab_size()
        for text, (k, _) in self.pieces.items():
            self.decoded[k] = text.replace(MARK, " ").encode()
        for b, k in self.bytes.items():
            self.decoded[k] = bytes([b])
        self.bpe = all(float(s).is_integer() for _, s in self.pieces.values())
        self.rank = {t: -s for t, (_, s) in self.pieces.items()}
        self.splits: dict[str, tuple[str, str] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.text_of = {k: t for t, (k, _) in self.pieces.items()}
        self.words: dict[str, bytes] = {}  # by what follows the mark that begins a word
        self.texts: dict[str, bytes] = {}  # what their ids decode to
        self.held = 0  # characters of them
        self.longest = max(map(len, self.pieces))
        self.penalty = min(s for _, s in self.pieces.values() if s > -1e8) - 10.0
        if any(MARK in t.lstrip(MARK) for t in self.pieces):
            raise ValueError("a piece crosses the start of a word")
        if self.bpe:
            self._automaton()

    def _automaton(self) -> None:
        """The trie of the pieces that merges make: for each node the nodes that characters lead to, the node of its longest proper suffix, and the (length, id) of the pieces that end there, long ones first."""
        self.next: list[dict[str, int]] = [{}]
        ends: list[int | None] = [None]
        for text, (k, _) in self.pieces.items():
            if len(text) > 1 and self.split(text):
                node = 0
                for c in text:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                        ends.append(None)
                    node = self.next[node][c]
                ends[node] = k
        self.suffix, self.found = [0] * len(self.next), [()] * len(self.next)
        row = [0]
        for node in row:  # shorter prefixes come first, so suffixes are known before they are needed
            for c, child in list(self.next[node].items()):
                self.suffix[child] = self._after(self.suffix[node], c) if node else 0
                own = ((len(self.text_of[ends[child]]), ends[child]),) if ends[child] is not None else ()
                self.found[child] = own + self.found[self.suffix[child]]
                row.append(child)
        self.steps = [dict(x) for x in self.next]  # with the steps by way of a suffix that were taken so far
        self.taken = 0

    def _after(self, node: int, c: str) -> int:
        while node and c not in self.next[node]:
            node = self.suffix[node]
        return self.next[node].get(c, 0)

    def follow(self, node: int, c: str) -> int:
        """The node after one more character, remembered."""
        if self.taken > 1 << 20:
            for own, first in zip(self.steps, self.next, strict=True):
                own.clear()
                own.update(first)
            self.taken = 0
        self.taken += 1
        to = self.steps[node][c] = self._after(node, c)
        return to

    def fallback(self, character: str) -> list[int]:
        return [self.bytes.get(b, self.unknown) for b in character.encode()]

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that the last merge of a piece joins; None for a character, and for a piece that merges don't make."""
        if piece not in self.splits:
            parts, last = list(piece), None
            while len(parts) > 1:
                ranks = [self.rank.get(a + b, math.inf) for a, b in zip(parts, parts[1:], strict=False)]
                k = min(range(len(ranks)), key=ranks.__getitem__)
                if ranks[k] == math.inf:
                    last = None
                    break
                last = (parts[k], parts[k + 1])
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self.splits[piece] = last
        return self.splits[piece]

    def compatible(self, first: int, second: int) -> bool:
        """Whether merging both pieces' text ends with these two. Their merges are undone, the latest first; at each step a merge across the border must not come before the border's pieces are used up."""
        if len(self.pairs) > 1 << 19:
            self.pairs.clear()
        x, y, used_x, used_y, out = self.text_of[first], self.text_of[second], math.inf, math.inf, None
        rank = self.rank
        while out is None:
            across = rank.get(x + y)
            if across is not None and across < used_x and across <= used_y:
                out = False
            elif len(x) == len(y) == 1:
                out = True
            elif len(y) == 1 or (len(x) > 1 and rank[x] > rank[y]):
                used_x, x = rank[x], self.split(x)[1]
            else:
                used_y, y = rank[y], self.split(y)[0]
        self.pairs[first << 32 | second] = out
        return out


@lru_cache(maxsize=2)
def vocabulary(model: str) -> Vocabulary:
    return Vocabulary(model)


def segmented(distinct: Iterable[str], own: Vocabulary) -> Iterator[tuple[str, list[int]]]:
    """Each word, sorted, and its ids, encoded as if one more mark stood before it."""
    return _merged(distinct, own) if own.bpe else _best(distinct, own)


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    for k in range(n):
        if a[k] != b[k]:
            return k
    return n


def _merged(distinct: Iterable[str], own: Vocabulary) -> Iterator[tuple[str, list[int]]]:
    pieces, pairs, compatible, found, follow, steps = own.pieces, own.pairs, own.compatible, own.found, own.follow, own.steps
    alone = {c: k for c, (k, _) in pieces.items() if len(c) == 1}
    # for each prefix of the marked word: the longest end that begins pieces, the last piece of its encoding (-1: none) and its length
    node, last, width = [0, follow(0, MARK)], [-1, alone.get(MARK, -1)], [0, 1]
    before = ""
    for word in sorted(distinct):
        end = _common(before, word) + 1
        del node[end + 1 :], last[end + 1 :], width[end + 1 :]
        at = node[end]
        for c in word[end - 1 :]:
            end += 1
            to = steps[at].get(c)
            at = follow(at, c) if to is None else to
            for n, piece in found[at]:
                border = last[end - n]
                if n == end or border < 0:
                    break
                fits = pairs.get(border << 32 | piece)
                if fits or (fits is None and compatible(border, piece)):
                    break
            else:  # a character alone
                n, piece = 1, alone.get(c, -1)
            node.append(at)
            last.append(piece)
            width.append(n)
        ids = []
        while end:
            piece = last[end]
            if piece >= 0:
                ids.append(piece)
            else:
                ids.extend(own.fallback(word[end - 2] if end > 1 else MARK)[::-1])
            end -= width[end]
        ids.reverse()
        yield word, ids
        before = word


def _best(distinct: Iterable[str], own: Vocabulary) -> Iterator[tuple[str, list[int]]]:
    pieces, longest, penalty = own.pieces, own.longest, own.penalty
    best, start, piece = [0.0], [0], [-1]  # for each prefix of the marked word: its best score, where its last piece begins and that piece
    before = ""
    for plain in sorted(distinct):
        word = MARK + plain
        keep = _common(before, word)
        del best[keep + 1 :], start[keep + 1 :], piece[keep + 1 :]
        for end in range(keep + 1, len(word) + 1):
            top, at, which = best[end - 1] + penalty, end - 1, -1
            for begin in range(max(0, end - longest), end):
                found = pieces.get(word[begin:end])
                if found is not None and best[begin] + found[1] > top:
                    top, at, which = best[begin] + found[1], begin, found[0]
            best.append(top)
            start.append(at)
            piece.append(which)
        ids: list[int] = []
        end = len(word)
        while end:
            ids.extend([piece[end]] if piece[end] >= 0 else own.fallback(word[end - 1])[::-1])
            end = start[end]
        ids.reverse()
        yield plain, ids
        before = word


def _split(text: str) -> list[str]:
    """The marked words of a text without their first mark; most texts have single spaces and no marks, and fall apart at the spaces."""
    words = text.split(" ") if text else []
    if "" in words or MARK in text:
        words = [w[1:] for w in _WORDS.findall(MARK + text.replace(" ", MARK))] if text else []
    return words


def _learned(split: list[list[str]], own: Vocabulary) -> None:
    """Encodes and decodes the words that are not known yet."""
    new = set().union(*split)
    if len(own.words) + len(new) > KNOWN_WORDS or own.held > KNOWN_CHARACTERS:
        own.words.clear()
        own.texts.clear()
        own.held = 0
    new.difference_update(own.words)
    own.held += sum(map(len, new))
    table, words, back = own.decoded, own.words, own.texts
    for word, ids in segmented(new, own):
        words[word] = array("I", ids).tobytes()
        back[word] = b"".join([table[k] for k in ids])


def encoded(texts: list[str], own: Vocabulary) -> list[bytes]:
    """The ids of each text as bytes; see segmented()."""
    split = [_split(t) for t in texts]
    _learned(split, own)
    known = own.words.__getitem__
    return [b"".join(map(known, words)) for words in split]


def decoded(ids: np.ndarray, own: Vocabulary) -> str:
    table = own.decoded
    return b"".join([table[k] for k in ids.tolist()]).decode("utf-8", "replace").removeprefix(" ")


def digests(texts: list[str], own: Vocabulary) -> list[tuple[int, int, str]]:
    """Of each text the number of its ids, their crc32, and the SHA-256 of what they decode to: the decoded bytes of its words, one after the other."""
    split = [_split(t) for t in texts]
    _learned(split, own)
    known, back, out = own.words.__getitem__, own.texts.__getitem__, []
    for words in split:
        ids, text = b"".join(map(known, words)), b"".join(map(back, words))
        out.append((len(ids) // 4, zlib.crc32(ids), hashlib.sha256(text.removeprefix(b" ")).hexdigest()))
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """doc_ids and texts, in runs of about four million characters; null texts are empty."""
    for batch in batches:
        at, texts = 0, [x or "" for x in batch.column(1).to_pylist()]
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size < 1 << 22):
                size += len(texts[to])
                to += 1
            yield batch.column(0).slice(at, to - at), texts[at:to]
            at = to


def _task(model: str | None):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model or vocabulary_path(MODEL))
        for ids, texts in _runs(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(encoded(texts, own), pa.binary())], ["doc_id", "ids"])

    return task


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit) of each row. model: a SentencePiece file (None: the public one)."""
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_task(model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of rows as encode() gives them; null ids: null."""
    ship(rows.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model or vocabulary_path(MODEL))
        for batch in batches:
            texts = [None if x is None else decoded(np.frombuffer(x, "<u4"), own) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digested(docs: DataFrame, model: str | None = None) -> DataFrame:
    """For each row: doc_id, n_ids, ids_crc32 (unsigned) and decoded_sha256 (of the text that the ids decode to)."""
    ship(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model or vocabulary_path(MODEL))
        for ids, texts in _runs(batches):
            n, crc, back = list(zip(*digests(texts, own), strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(back, pa.string())], ["doc_id", "n_ids", "ids_crc32", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_ids long, ids_crc32 long, decoded_sha256 string")

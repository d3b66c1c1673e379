"""Cost-balanced packing of token ids into sequences of a fixed length.

The cost of a piece of n tokens is estimated as ``LINEAR`` n + n^2: what grows with every token (projections, feed-forward
layers) and what grows with the square (attention inside a document).  Pieces are taken by descending cost, and each goes to the
sequence with the lowest cost so far that has room for it.  Where none has room for the whole piece, it is cut: one part
fills the cheapest sequence among those with much room, and the rest takes its place among the pieces again.  So sequences cost about the
same and leave no padding.

A task packs its own documents, without a shuffle: it reads texts until a window of ``WINDOW`` sequences can be filled, packs the
window, and keeps what is over, less than one sequence, for the next.  What is over at the end of a task is cut into pieces whose
lengths are powers of two, each a sequence of its own that needs no padding.  No task holds more than its window and one text, every
source or key is spread like any other rows, and a lost task is done again on its own.  A sequence's id is made of the partition's
number and its place there, so ids are unique, and the same for the same partitions.

The vocabulary is a ``tokenizers`` file at the same path on every machine.  Long texts are coded in blocks that are cut before
a space that follows a letter and stands before one: no token of a byte-level vocabulary spans that place.

Defined results: a null or empty text is its end token alone; repeated rows and rows without id are packed each on its own;
without documents, there are no pieces; only the two named columns are read.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quarterlight.llm.bpe import byte_letters
from quarterlight.llm.common import map_rows

LENGTH, END, WINDOW = 1024, 0, 1024
#: Six times the width of a model of 768 numbers a token: where linear and quadratic work are equal.
LINEAR = 4608
TEXT_BLOCK = 1 << 19
#: Fixed value of the format: the pattern of a byte-level vocabulary's words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNCOMMON = re.compile("[^\\t\\n\\r -~\xa0-\u024f\u2010-\u2015\u2018-\u201e\u2026\u20ac]|\\s{200}")
_CUT = re.compile(r"(?<=[^\W\d_])(?= [^\W\d_])")
#: Partition number above, place in it below.
PLACES = 1 << 32

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, sequence_cost long"


def cost(n: int) -> int:
    return LINEAR * n + n * n


class Coder:
    """Ids of texts by a byte-level vocabulary.

    Where the merges' order is the ids' order, a rank table says the same as the merge list, and the faster library that
    works on ranks is used, but only for texts of common characters, whose classes no two Unicode versions see differently; all
    others, and texts with very long runs of space, go to the library that the file is written for.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel units
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.ranks = self.by_ranks(path)

    @staticmethod
    def by_ranks(path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, vocab = spec.get("pre_tokenizer") or {}, spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        results = [vocab[a + b] for a, b in merges]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if not plain or results != sorted(set(results)) or not all(t["special"] and not t["lstrip"] and not t["rstrip"] for t in spec["added_tokens"]):
            return None
        import tiktoken

        of = {letter: bytes([b]) for b, letter in enumerate(byte_letters())}
        ranks = {b"".join(of[x] for x in token): i for token, i in vocab.items() if token not in special}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        """As the file's library gives them without special tokens added."""
        if self.ranks is None or _UNCOMMON.search(text):
            parts = [c.ids for c in self.whole.encode_batch_fast(list(blocks(text)), add_special_tokens=False)]
        else:
            parts = [self.ranks.encode(part, allowed_special="all") for part in blocks(text)]
        return np.array(parts[0], np.uint32) if len(parts) == 1 else np.concatenate([np.array(p, np.uint32) for p in parts])


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def blocks(text: str, size: int = TEXT_BLOCK) -> Iterator[str]:
    """The text in blocks that are tokenized independently; without a safe place, a block is longer."""
    at = 0
    while len(text) - at > size:
        found = _CUT.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


class Piece:
    """Consecutive tokens of one document."""

    __slots__ = ("doc", "start", "ids", "tokens")

    def __init__(self, doc, start: int, ids: np.ndarray, tokens: int):
        self.doc, self.start, self.ids, self.tokens = doc, start, ids, tokens

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:n], self.tokens), Piece(self.doc, self.start + n, self.ids[n:], self.tokens)


def balance(pieces: list[Piece], sequences: int, length: int = LENGTH) -> tuple[list[list[Piece]], list[Piece]]:
    """Fill ``sequences`` sequences; what is left over comes back too."""
    queue: list[tuple[int, int, Piece]] = []  # ascending, taken from the end; ties by place
    for k, p in enumerate(pieces):
        at = 0
        while len(p.ids) - at > length:
            queue.append((length, -k, Piece(p.doc, p.start + at, p.ids[at : at + length], p.tokens)))
            at += length
        queue.append((len(p.ids) - at, -k, Piece(p.doc, p.start + at, p.ids[at:], p.tokens)))
    queue.sort(key=lambda q: q[:2])
    costs, room = np.zeros(sequences, np.int64), np.full(sequences, length, np.int64)
    filled: list[list[Piece]] = [[] for _ in range(sequences)]
    most = length
    while queue:
        n, k, piece = queue.pop()
        fits = np.flatnonzero(room >= n)
        if not len(fits):
            most = int(room.max(initial=0))
            if not most:
                queue.append((n, k, piece))
                break
            fits = np.flatnonzero(2 * room >= most)
        to = int(fits[np.argmin(costs[fits])])
        if n > room[to]:
            piece, rest = piece.cut(int(room[to]))
            bisect.insort(queue, (len(rest.ids), k, rest), key=lambda q: q[:2])
        filled[to].append(piece)
        costs[to] += cost(len(piece.ids))
        room[to] -= len(piece.ids)
    return filled, [p for *_, p in reversed(queue)]


def powers(pieces: list[Piece]) -> list[list[Piece]]:
    """Sequences whose lengths are powers of two, the largest first."""
    total, out, waiting = sum(len(p.ids) for p in pieces), [], list(pieces)[::-1]
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        mine = []
        while room:
            piece = waiting.pop()
            if len(piece.ids) > room:
                piece, rest = piece.cut(room)
                waiting.append(rest)
            room -= len(piece.ids)
            mine.append(piece)
        out.append(mine)
    return out


class Packer:
    def __init__(self, first_sequence: int, length: int = LENGTH, window: int = WINDOW):
        self.next, self.length, self.window = first_sequence, length, window
        self.pieces: list[Piece] = []
        self.size = 0

    def rows(self, sequences: Iterable[list[Piece]]) -> Iterator[tuple]:
        for sequence in sequences:
            whole, offset = sum(cost(len(p.ids)) for p in sequence), 0
            tokens = sum(len(p.ids) for p in sequence)
            for p in sequence:
                n = len(p.ids)
                yield p.doc, p.start, n, zlib.crc32(p.ids.astype("<u4").tobytes()), p.tokens, self.next, offset, tokens, whole
                offset += n
            self.next += 1

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        """Pieces of the window that the document fills, if it does."""
        at = 0
        while at < len(ids):
            # A document of any length goes in window by window.
            part = ids[at : at + self.window * self.length - self.size]
            self.pieces.append(Piece(doc, at, part, len(ids)))
            self.size += len(part)
            at += len(part)
            if self.size >= self.window * self.length:
                filled, self.pieces = balance(self.pieces, self.window, self.length)
                self.size = sum(len(p.ids) for p in self.pieces)
                yield from self.rows(filled)

    def end(self) -> Iterator[tuple]:
        filled, over = balance(self.pieces, self.size // self.length, self.length)
        yield from self.rows(filled)
        yield from self.rows(powers(over))


def pack(
    docs: DataFrame, path: str, length: int = LENGTH, window: int = WINDOW, end: int = END, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """A row for every piece: its document, place, tokens and digest, and its sequence and place there."""

    def run(rows):
        packer = Packer(TaskContext.get().partitionId() * PLACES, length, window)
        ids_of = coder(path).ids
        for doc, text in rows:
            yield from packer.add(doc, np.append(ids_of(text or ""), np.uint32(end)))
        yield from packer.end()

    return map_rows(docs.select(id_column, text_column), run, SCHEMA)

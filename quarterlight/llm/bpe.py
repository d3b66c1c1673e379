"""BPE encoding and decoding with a bounded-lookahead transducer.

Merges of a word can only depend on a bounded number of symbols to the right: ``sufficient_lookahead`` computes
that number from the merge list.  A long word is therefore read in blocks; tokens that end before the last
``lookahead`` symbols of the block are stable and leave, and the rest starts the next block, so that a word of
any length needs the memory of one block.  A block in which no token is stable, as one token fills it, is doubled; the
longest token and the lookahead bound that.  (Merging the rest anew is right: no merge of the whole word crosses
a token's end, so both sides merge independently.)  Short words are merged at once and kept in a
cache of bounded size.  Decoding feeds token bytes through an incremental UTF-8 decoder, whose state
carries characters that are cut between tokens.

The vocabulary is a ``tokenizers`` JSON file of a byte-level BPE with word ends; its path is a parameter and the
file has to be at that path on every machine.  Results are those of the library: special tokens are found in the raw text,
the rest is normalised (NFC, lower case), cut into words, and merged.  Defined results: a null text counts as
empty and has no tokens; every row is on its own, repeated ones too; only the given columns are read.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from quarterlight.llm.common import map_rows

#: Fixed values of the vocabulary's format: the bytes that stand for themselves, and the pattern of words.
PRINTABLE = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

CACHE_ENTRIES, CACHED_LETTERS, SHORT_WORD = 300_000, 48, 96
TEXT_BLOCK = 1 << 16
NO_MERGE = 1 << 62
_ODD_SPACE = re.compile("[\x1c-\x1f]")  # str.split() takes these as space, the word pattern doesn't
_SPACE = regex.compile(r"\s")


def byte_letters() -> list[str]:
    """The letter of each byte: printable bytes are their own, the others follow from U+0100 on."""
    spare = iter(range(256))
    own = frozenset(PRINTABLE)
    return [chr(b) if b in own else chr(256 + next(spare)) for b in range(256)]


def symbols_in(token: str, suffix: str) -> int:
    return len(token) - (len(suffix) if suffix and token.endswith(suffix) else 0)


def sufficient_lookahead(merges: Iterable[tuple[str, str]], suffix: str = "") -> int:
    """How many symbols to the right of a token's end can decide whether the token stands.

    Going through the merges by rank, ``grabbed[a]`` is the reach of those that take a token ``a`` away to its right, and
    ``inner[t]`` the reach of what could have taken the last part of ``t`` before ``t`` was formed.
    A merge (a, b) is decided by b's symbols and whatever decides, at its rank, that b stands.  One
    symbol more tells whether the word ends, which changes the last symbol.
    """
    grabbed: dict[str, int] = {}
    inner: dict[str, int] = {}
    most = 0
    for a, b in merges:
        stands = max(grabbed.get(b, 0), inner.get(b, 0))
        reach = symbols_in(b, suffix) + stands
        grabbed[a] = max(grabbed.get(a, 0), reach)
        inner[a + b] = max(inner.get(a + b, 0), stands)
        most = max(most, reach)
    return most + 1


def little(ids: array) -> bytes:
    if sys.byteorder != "little":
        ids.byteswap()
    return ids.tobytes()


class Transducer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (vocab | self.special).items()}
        self.base = max(self.names) + 1
        #: rank * base + result, by pair of ids
        self.merges = {vocab[a] * self.base + vocab[b]: rank * self.base + vocab[a + b] for rank, (a, b) in reversed(list(enumerate(merges)))}
        letters = byte_letters()
        self.inside = [vocab[x] for x in letters]
        self.last = [vocab[x + self.suffix] for x in letters]
        self.lookahead = sufficient_lookahead(merges, self.suffix)
        self.block = 4 * self.lookahead
        self.find_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(WORDS)
        self.bytes_of = {letter: b for b, letter in enumerate(letters)}
        self.kept: dict[str, bytes] = {}
        self.kept_words: dict[str, bytes] = {}
        # Without a decoder in the file, a text is the tokens' names with a space between.
        self.named = [self.names.get(i, "").encode() for i in range(self.base)]

    # -- encoding

    def merged(self, ids: list[int]) -> list[int]:
        """All merges of a short run of symbols: the best pair first, the leftmost of equals."""
        get, base = self.merges.get, self.base
        if len(ids) > SHORT_WORD:
            return self.merged_by_heap(ids)
        pairs = [get(a * base + b, NO_MERGE) for a, b in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best == NO_MERGE:
                break
            i = pairs.index(best)
            ids[i : i + 2] = (best % base,)
            del pairs[i]
            if i:
                pairs[i - 1] = get(ids[i - 1] * base + ids[i], NO_MERGE)
            if i < len(pairs):
                pairs[i] = get(ids[i] * base + ids[i + 1], NO_MERGE)
        return ids

    def merged_by_heap(self, ids: list[int]) -> list[int]:
        """The same for long runs, with a heap of (merge, place) and links between the symbols left."""
        get, base, n = self.merges.get, self.base, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i) for i in range(n - 1) if (m := get(ids[i] * base + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            merge, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] * base + ids[j]) != merge:
                continue
            ids[i], ids[j], after[i] = merge % base, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (m := get(ids[i] * base + ids[after[j]])) is not None:
                    heapq.heappush(heap, (m, i))
            if (h := before[i]) >= 0 and (m := get(ids[h] * base + ids[i])) is not None:
                heapq.heappush(heap, (m, h))
        return [x for x in ids if x >= 0]

    def word(self, symbols: bytes) -> Iterator[list[int]]:
        """Token ids of one word, block by block as they become stable."""
        at, n, block = 0, len(symbols), self.block
        width = None
        while at < n:
            stop = min(n, at + block)
            ids = [self.inside[b] for b in symbols[at:stop]]
            if stop == n:
                ids[-1] = self.last[symbols[-1]]
                yield self.merged(ids)
                return
            ids, stable, end = self.merged(ids), [], at
            width = width or self.widths()
            for t in ids:
                end += width[t]
                if end > stop - self.lookahead:
                    break
                stable.append(t)
                at = end
            # A token of the block's length leaves none stable: a larger block, at most the longest token and the lookahead, has one.
            block = self.block if stable else 2 * block
            yield stable

    @lru_cache(maxsize=1)  # noqa: B019
    def widths(self) -> list[int]:
        return [symbols_in(self.names.get(i, ""), self.suffix) for i in range(self.base)]

    def segment(self, text: str) -> bytes:
        """Ids of a piece of text without special tokens, as little-endian 32-bit integers."""
        if text.isascii():
            text = text.lower()
        else:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # letter by letter: no final sigma
        words = (text,) if text.isalpha() else self.words.findall(text)
        kept, out = self.kept_words, []
        for w in words:
            ids = kept.get(w)
            if ids is None:
                ids = self.word_ids(w)
                if len(w) <= CACHED_LETTERS:
                    if len(kept) >= CACHE_ENTRIES:
                        kept.clear()
                    kept[w] = ids
            out.append(ids)
        return out[0] if len(out) == 1 else b"".join(out)

    def word_ids(self, w: str) -> bytes:
        symbols = w.encode("utf-8", "replace")
        if len(symbols) <= SHORT_WORD:
            ids = [self.inside[b] for b in symbols]
            ids[-1] = self.last[symbols[-1]]
            return little(array("I", self.merged(ids)))
        return b"".join([little(array("I", ids)) for ids in self.word(symbols)])

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of the whole text in pieces, as little-endian 32-bit integers."""
        parts = self.find_special.split(text) if self.find_special else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield self.special[part].to_bytes(4, "little")
                continue
            at = 0
            while at < len(part):
                space = _SPACE.search(part, at + TEXT_BLOCK) if at + TEXT_BLOCK < len(part) else None
                stop = space.start() if space else len(part)
                yield self.block_of_text(part[at:stop])
                at = stop

    def block_of_text(self, text: str) -> bytes:
        if _ODD_SPACE.search(text):
            return self.segment(text)
        kept, out = self.kept, []
        for s in text.split():
            ids = kept.get(s)
            if ids is None:
                ids = self.segment(s)
                if len(s) <= CACHED_LETTERS:
                    if len(kept) >= CACHE_ENTRIES:
                        kept.clear()
                    kept[s] = ids
            out.append(ids)
        return b"".join(out)

    # -- decoding

    def plain_bytes(self) -> list[bytes]:
        """The bytes of each token in running text: word ends as spaces, special tokens as their names."""
        table = []
        for i in range(self.base):
            name = self.names.get(i, "")
            if name in self.special:
                table.append(name.encode())
                continue
            end = bool(self.suffix) and name.endswith(self.suffix)
            body = name[: len(name) - len(self.suffix)] if end else name
            table.append(bytes(self.bytes_of[x] for x in body if x in self.bytes_of) + b" " * end)
        return table

    def decode(self, pieces: Iterable[bytes], table: list[bytes] | None = None, between: bytes = b" ") -> Iterator[str]:
        """Text of ids that arrive in pieces.  By default that of the library, the tokens' names with a space between;
        with ``plain_bytes()`` and nothing between, running text."""
        table, feed, first = table or self.named, codecs.getincrementaldecoder("utf-8")("replace").decode, True
        for piece in pieces:
            ids = array("I", piece)
            if sys.byteorder != "little":
                ids.byteswap()
            if ids:
                raw = between.join([table[i] for i in ids])
                yield feed(raw if first else between + raw)
                first = False
        yield feed(b"", True)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id column and ``ids array<int>`` of every whole text."""
    kind = dict(docs.dtypes)[id_column].replace("bigint", "long")

    def run(rows):
        t = transducer(path)
        for key, text in rows:
            yield key, list(array("I", b"".join(t.encode(text or ""))))

    return map_rows(docs.select(id_column, text_column), run, f"{id_column} {kind}, ids array<long>")


def decode(tokens: DataFrame, path: str, id_column: str = "doc_id", plain: bool = True) -> DataFrame:
    """The id column and ``text`` of every row of ids; null ids count as none."""
    kind = dict(tokens.dtypes)[id_column].replace("bigint", "long")

    def run(rows):
        t = transducer(path)
        table = t.plain_bytes() if plain else None
        for key, ids in rows:
            piece = array("I", ids or []).tobytes()
            yield key, "".join(t.decode([piece], table, b"" if plain else b" "))

    return map_rows(tokens.select(id_column, "ids"), run, f"{id_column} {kind}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, number of tokens, digest of the ids, digest of the text that the library decodes from them.

    Ids and text pass through in pieces; neither is ever whole in memory.
    """

    def run(rows):
        t = transducer(path)
        for doc_id, text in rows:
            n, ids, back = 0, hashlib.sha256(), hashlib.sha256()

            def pieces(text=text or ""):
                nonlocal n
                for piece in t.encode(text):
                    n += len(piece) // 4
                    ids.update(piece)
                    yield piece

            for part in t.decode(pieces()):
                back.update(part.encode("utf-8", "replace"))
            yield doc_id, n, ids.hexdigest(), back.hexdigest()

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Language-model scores by cross-entropy difference.

Two bigram models of the same order, smoothing and vocabulary are counted: a target model over the documents that are marked as
such, a background model over all documents.  A document's score is the mean, over its tokens, of the target's loss
less the background's: the lower, the more it is like the target.

The shared vocabulary is every word of all documents, and every pair of neighbours is counted, so what is gathered grows
with the corpus.  Words are known by a 64-bit hash: among fifteen million words, two share one with probability 6e-6.
``learn`` counts the words into a table.  Pairs are counted and scored in one shuffle (``Tables.score``): every occurrence goes to its
word's part, where all counts that its loss needs meet, and only sums for each document come back.  Words with a ``HOT`` share of
all occurrences are dealt by pair, and pairs with that share are counted before and scored where they are read, so no word or pair
gathers in one task; of both there are at most 1 / ``HOT``, and nothing else but totals comes to the driver.

Only where a caller of ``learn`` names a ``size`` is the vocabulary bounded: then it has the most frequent words, the others fall
into classes by their ending, and a model is a table of ``size`` rows and columns that is broadcast.

Words are runs of ASCII letters, digits and other characters beyond ASCII, in lower case.  Defined results: a null or
empty text, or one without words, has no tokens and zero losses; a target without documents gives the uniform model;
repeated rows count and are scored each on its own; only doc_id, text and the mark are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterlight.llm.common import map_batches, map_rows
from quarterlight.llm.decontamination import words_of
from quarterlight.session import stored

CLASSES, STRENGTH, FLUSH = 256, 20.0, 200_000
TOKENS = 1 << 20
#: Stands before the first word of a text.
START = 0
#: Words and pairs with this share of all occurrences are frequent.
HOT = 1 / 1024
#: Occurrences that a task gathers before it hands them on, and that one part of the shuffle has.
GATHERED, PART = 1 << 21, 1 << 21
#: Bits of a row's number inside its chunk: a chunk's sums travel together.
CHUNK = 8


@dataclass
class Vocabulary:
    """Entry 0 starts a text, words follow, and the last ``classes`` entries are for all other words."""

    number: dict[bytes, int]
    size: int
    classes: int

    def tokens(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        first, classes, known = self.size - self.classes, self.classes, self.number.get
        other = zlib.crc32
        return np.array([known(w) or first + other(w[-3:]) % classes for w in words], np.int64)

    def pairs(self, text: str | None) -> np.ndarray:
        """Place in a model's table of every token after the one before it."""
        t = self.tokens(text)
        return t + self.size * np.concatenate(([0], t[:-1])) if len(t) else t


def vocabulary(docs: DataFrame, size: int, classes: int = CLASSES) -> Vocabulary:
    """The most frequent words over all documents, ties by the word."""

    def run(rows):
        counts: Counter[bytes] = Counter()
        for (text,) in rows:
            counts.update(words_of(text))
            if len(counts) > FLUSH:
                yield from ((w.decode("utf-8", "replace"), n) for w, n in counts.items())
                counts.clear()
        yield from ((w.decode("utf-8", "replace"), n) for w, n in counts.items())

    words = map_rows(docs.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = words.orderBy(F.desc("n"), "word").limit(size - classes - 1).collect()
    return Vocabulary({r["word"].encode(): i + 1 for i, r in enumerate(top)}, size, classes)


def counts(marked: DataFrame, words: Vocabulary) -> DataFrame:
    """(pair, background, target): occurrences in all documents and in those with ``is_target``; zero pairs are left out."""
    cells = words.size**2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, cells), np.int64)
        waiting: tuple[list, list] = ([], [])
        size = 0

        def add():
            for total, parts in zip(totals, waiting):
                if parts:
                    total += np.bincount(np.concatenate(parts), minlength=cells)
                    parts.clear()

        for batch in batches:
            for text, target in zip(batch.column(0), batch.column(1)):
                pairs = words.pairs(text.as_py())
                waiting[0].append(pairs)
                if target.as_py():
                    waiting[1].append(pairs)
                size += len(pairs)
                if size > TOKENS:
                    add()
                    size = 0
        add()
        seen = np.flatnonzero(totals[0])
        for at in range(0, len(seen), 100_000):
            part = seen[at : at + 100_000]
            columns = [pa.array(part), pa.array(totals[0][part]), pa.array(totals[1][part])]
            yield pa.RecordBatch.from_arrays(columns, names=["pair", "background", "target"])

    parts = map_batches(marked.select("text", "is_target"), run, "pair long, background long, target long")
    return parts.groupBy("pair").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


def losses(table: np.ndarray, strength: float = STRENGTH) -> np.ndarray:
    """Negative log-probabilities of a table of counts [before, word]: bigrams leaning on unigrams, these on the uniform."""
    size = len(table)
    single = table.sum(axis=0)
    single = (single + 1) / (single.sum() + size)
    return -np.log((table + strength * single) / (table.sum(axis=1, keepdims=True) + strength)).astype(np.float32)


@dataclass
class Models:
    words: Vocabulary
    background: np.ndarray
    target: np.ndarray

    def score(self, text: str | None) -> tuple[int, float, float, float]:
        pairs = self.words.pairs(text)
        if not len(pairs):
            return 0, 0.0, 0.0, 0.0
        b, t = float(self.background[pairs].mean(dtype=float)), float(self.target[pairs].mean(dtype=float))
        return len(pairs), t, b, t - b


class Hashes(dict):
    """The 64-bit hash of every word asked for; forgotten when there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > FLUSH:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def pairs(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Every word of a text and the one before it."""
        words = words_of(text)
        t = np.fromiter(map(self.__getitem__, words), np.uint64, len(words)).view(np.int64)
        return np.concatenate(([START], t[:-1])) if len(t) else t, t


def summed(first: np.ndarray, second: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different pairs of numbers, and the sums of the values of each."""
    order = np.lexsort((first, second))
    first, second = first[order], second[order]
    starts = np.flatnonzero(np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1]))))
    return first[starts], second[starts], *[np.add.reduceat(v[order], starts) for v in values]


def grams(marked: DataFrame) -> DataFrame:
    """(before, word, background, target): occurrences of pairs, of words (no ``before``) and of words as the first of a pair (no ``word``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        waiting: list[tuple[np.ndarray, np.ndarray, bool]] = []

        def batch(before, word, n, target):
            for at in range(0, len(n), 100_000):
                part = slice(at, at + 100_000)
                columns = [pa.nulls(len(n[part]), pa.int64()) if c is None else pa.array(c[part]) for c in (before, word, n, target)]
                yield pa.RecordBatch.from_arrays(columns, names=["before", "word", "background", "target"])

        def add():
            if not waiting:
                return
            before, word = (np.concatenate([w[k] for w in waiting]) for k in (0, 1))
            target = np.repeat([int(w[2]) for w in waiting], [len(w[1]) for w in waiting])
            waiting.clear()
            before, word, n, target = summed(before, word, np.ones(len(word), np.int64), target)
            yield from batch(before, word, n, target)
            none = np.zeros(len(n), np.int64)
            for k, one in enumerate((word, before)):
                one, _, *sums = summed(one, none, n, target)
                yield from batch(None if k == 0 else one, one if k == 0 else None, *sums)

        size = 0
        for rows in batches:
            for text, target in zip(rows.column(0), rows.column(1)):
                pairs = hashes.pairs(text.as_py())
                if len(pairs[1]):
                    waiting.append((*pairs, bool(target.as_py())))
                    size += len(pairs[1])
                if size > 4 * TOKENS:
                    yield from add()
                    size = 0
        yield from add()

    parts = map_batches(marked.select("text", "is_target"), run, "before long, word long, background long, target long")
    return parts.groupBy("before", "word").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


class Gathered:
    """Occurrences of pairs in many texts, in the order of the texts: ``of`` says which one, ``ends`` where a text is over."""

    def __init__(self) -> None:
        self.hashes, self.texts, self.about, self.size = Hashes(), [], [], 0

    def add(self, text: str | None, *about) -> bool:
        """Whether there are enough to be handed on."""
        words = words_of(text)
        self.texts.append(np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words)).view(np.int64))
        self.about.append(about)
        self.size += len(words)
        return self.size >= GATHERED or len(self.texts) >= GATHERED >> 4

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
        """(before, word, of, ends) of every occurrence, and what was said about the texts."""
        lengths = np.array([len(t) for t in self.texts])
        word = np.concatenate(self.texts)
        of, over = np.repeat(np.arange(len(lengths)), lengths), np.cumsum(lengths)[lengths > 0]
        before, ends = np.roll(word, 1), np.zeros(len(word), bool)
        before[over - lengths[lengths > 0]] = START
        ends[over - 1] = True
        about, self.texts, self.about, self.size = self.about, [], [], 0
        return before, word, of, ends, about


def mixed(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Deals pairs evenly; two pairs may share a number."""
    m = (before.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.view(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return m ^ (m >> np.uint64(29))


def dealt(values: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(values, values) % np.uint64(parts)).astype(np.int64)


def place(sorted_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values stand among sorted ones, and whether they do."""
    at = np.searchsorted(sorted_, values)
    at[at == len(sorted_)] = 0
    return at, sorted_[at] == values if len(sorted_) else np.zeros(len(values), bool)


def word_counts(marked: DataFrame) -> DataFrame:
    """Occurrences of words, and how often texts end with them; with ``before``, those of pairs, as far as a task saw many of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Gathered()

        def out():
            before, word, of, ends, about = gathered.take()
            if not len(word):
                return
            target = np.array([bool(a[0]) for a in about])[of].astype(np.int64)
            none, one = np.zeros(len(word), np.int64), np.ones(len(word), np.int64)
            order = np.argsort(word)
            ordered = word[order]
            starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
            words, sums = ordered[starts], [np.add.reduceat(v[order], starts) for v in (one, target, ends.astype(np.int64), ends * target)]
            yield from batch(None, words, *sums)
            # A pair that is frequent anywhere has that share in a gathering too, and so has its word.
            often = place(words[sums[0] >= HOT * len(word)], word)[1]
            first, second, *sums = summed(before[often], word[often], one[often], target[often]) if often.any() else [none[:0]] * 4
            many = sums[0] >= HOT * len(word)
            yield from batch(first[many], second[many], *(s[many] for s in sums), none[: many.sum()], none[: many.sum()])

        def batch(before, *columns):
            for at in range(0, len(columns[0]), 100_000):
                part = [c[at : at + 100_000] for c in columns]
                first = pa.nulls(len(part[0]), pa.int64()) if before is None else before[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (first, *part)], names=names)

        for rows in batches:
            for text, target in zip(rows.column(0), rows.column(1)):
                if gathered.add(text.as_py(), target.as_py()):
                    yield from out()
        if gathered.size:
            yield from out()

    names = ["before", "word", "background", "target", "ends", "target_ends"]
    parts = map_batches(marked.select("text", "is_target"), run, ", ".join(f"{n} long" for n in names))
    return parts.groupBy("before", "word").agg(*[F.sum(n).alias(n) for n in names[2:]])


def pair_counts(marked: DataFrame, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each of the few given pairs occurs in all documents, and in the target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, totals, frequent = Gathered(), np.zeros((2, len(word)), np.int64), Frequent(before, word)

        def add():
            first, second, of, _, about = gathered.take()
            at, found = frequent.of(first, second)
            target = np.array([bool(a[0]) for a in about], bool)[of[found]]
            totals[0] += np.bincount(at[found], minlength=len(word))
            totals[1] += np.bincount(at[found][target], minlength=len(word))

        for rows in batches:
            for text, target in zip(rows.column(0), rows.column(1)):
                if gathered.add(text.as_py(), target.as_py()):
                    add()
        if gathered.size:
            add()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(word))), pa.array(totals[0]), pa.array(totals[1])], names=["pair", "background", "target"])

    parts = map_batches(marked.select("text", "is_target"), run, "pair long, background long, target long")
    rows = parts.groupBy("pair").agg(F.sum("background").alias("background"), F.sum("target").alias("target")).collect()
    by = {r["pair"]: r for r in rows}
    return tuple(np.array([by[i][side] for i in range(len(word))]) for side in SIDES)


SIDES = ("background", "target")


class Frequent:
    """Some pairs, to be looked up by the many."""

    def __init__(self, before: np.ndarray, word: np.ndarray):
        mix = mixed(before, word)
        self.order = np.argsort(mix)
        self.mix, self.before, self.word = mix[self.order], before[self.order], word[self.order]

    def of(self, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, found = place(self.mix, mixed(before, word))
        if len(self.mix):
            found &= (self.before[at] == before) & (self.word[at] == word)
            at = self.order[at]
        return at, found


_DOCUMENT = np.dtype([("row", "u8"), ("known", "?"), ("doc_id", "i8"), ("n", "i8"), ("target", "f8"), ("background", "f8")])


@dataclass
class Counts:
    """What every task knows: totals, and the counts of frequent words and pairs; lists are of (background, target)."""

    size: int
    totals: list[int]
    texts: list[int]
    words: np.ndarray
    single: list[np.ndarray]
    before: list[np.ndarray]
    pairs: Frequent
    pair: list[np.ndarray]

    def word_loss(self, side: int, n: np.ndarray, single: np.ndarray) -> np.ndarray:
        return -np.log(n + STRENGTH * ((single + 1) / float(self.totals[side] + self.size)))

    def split(self, batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
        """Documents to (part, base, words, sizes, before, rows, documents): the occurrences of each part's words, sorted.

        What frequent words and pairs and the beginnings of texts add is summed here, one row of ``documents`` for a text.
        """
        gathered = Gathered()

        def out():
            before, word, of, ends, about = gathered.take()
            ids, rows, target, counted, scored = (list(c) for c in zip(*about))
            rows, counted, scored = np.array(rows, np.int64), np.array(counted, bool), np.array(scored, bool)
            base = int(rows.min())
            flags = np.array(target, np.int64) + 2 * counted + 4 * scored
            at, hot = place(self.words, word)
            pair, local = self.pairs.of(before, word)
            document = np.zeros(len(ids), _DOCUMENT)
            document["row"], document["known"], document["doc_id"] = rows - base, [i is not None for i in ids], [i or 0 for i in ids]
            n = document["n"] = np.bincount(of, minlength=len(ids))
            leads = hot & ~ends
            for side, name in enumerate(SIDES):
                seen = self.word_loss(side, self.pair[side][pair[local]], self.single[side][at[local]])
                led = np.log(self.before[side][at[leads]] + STRENGTH)
                document[name] = np.bincount(of[local], seen, len(ids)) + np.bincount(of[leads], led, len(ids)) + (n > 0) * np.log(self.texts[side] + STRENGTH)
            document = document[scored]
            rest = np.flatnonzero(~local)
            before, word, of, ends, hot = before[rest], word[rest], of[rest], ends[rest], hot[rest]
            part = dealt(np.where(hot, mixed(before, word).view(np.int64), word), parts)
            code = ((rows - base)[of] << 4) | ends << 3 | flags[of]
            order = np.lexsort((word, part))
            before, word, part, code = before[order], word[order], part[order], code[order]
            whose = dealt((document["row"].astype(np.int64) + base) >> CHUNK, parts)
            order = np.argsort(whose, kind="stable")
            document, whose = document[order], whose[order]
            begins = np.ones(len(word), bool)
            begins[1:] = (word[1:] != word[:-1]) | (part[1:] != part[:-1])
            columns = []
            for p in np.union1d(part, whose).tolist():
                a, b = np.searchsorted(part, (p, p + 1))
                c, d = np.searchsorted(whose, (p, p + 1))
                starts = np.flatnonzero(begins[a:b])
                sizes = np.diff(np.append(starts, b - a))
                columns.append((p, base, word[a:b][starts].tobytes(), _short(sizes), before[a:b].tobytes(), _short(code[a:b]), document[c:d].tobytes()))
            if columns:
                yield _batch(columns, _SPLIT)

        for batch in batches:
            for doc_id, text, *about in zip(*(c.to_pylist() for c in batch.columns)):
                if gathered.add(text, doc_id, *about):
                    yield from out()
        if gathered.about:
            yield from out()

    def score(self, batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
        """(deal, base, rows, target, background, documents): what one part's occurrences add to the documents, those of a chunk together."""
        found: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for part, base, words, sizes, before, codes, documents in zip(*(c.to_pylist() for c in batch.columns)):
                if words:
                    words = np.frombuffer(words, np.int64)
                    before, codes = np.frombuffer(before, np.int64), _long(codes, len(before) // 8)
                    found.append((np.repeat(words, _long(sizes, len(words))), before, (codes >> 4) + base, (codes & 15).astype(np.uint8)))
                if documents:
                    yield _batch([(part, base, b"", b"", b"", documents)], _SUMS)
        if not found:
            return
        word, before, row, flags = (np.concatenate(c) for c in zip(*found))
        found.clear()
        order = np.lexsort((before, word))
        word, before, row, flags = word[order], before[order], row[order], flags[order]
        counted, scored, leads = (flags & 2) > 0, (flags & 4) > 0, (flags & 8) == 0
        counts = [counted, counted & ((flags & 1) > 0)]
        starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        pairs = np.union1d(starts, np.flatnonzero(before[1:] != before[:-1]) + 1)
        of_word, of_pair = np.diff(np.append(starts, len(word))), np.diff(np.append(pairs, len(word)))
        at, hot = place(self.words, word[starts])
        sums = []
        for side in (1, 0):
            add = lambda c, places: np.add.reduceat(c.astype(np.int64), places)
            n, single, first = add(counts[side], pairs), add(counts[side], starts), add(counts[side] & leads, starts)
            if side == 0 and (np.repeat(n, of_pair)[scored] == 0).any():
                raise ValueError("a pair of words is not in the background: score the documents that were counted")
            if hot.any():
                single = np.where(hot, self.single[side][at], single)
            loss = self.word_loss(side, np.repeat(n, of_pair), np.repeat(single, of_word))
            # Frequent words' part as the first of a pair was added where the text was read.
            sums.append(loss + leads * np.repeat(np.where(hot, 0.0, np.log(first + STRENGTH)), of_word))
        row = row[scored]
        if not len(row):
            return
        order = np.argsort(row, kind="stable")
        row = row[order]
        starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        rows = row[starts]
        target, background = (np.add.reduceat(s[scored][order], starts) for s in sums)
        chunks = rows >> CHUNK
        first = np.flatnonzero(np.concatenate(([True], chunks[1:] != chunks[:-1])))
        deals, ends = dealt(chunks[first], parts).tolist(), [*first[1:].tolist(), len(rows)]
        for k in range(0, len(first), 1000):
            ready = []
            for i, a in enumerate(first[k : k + 1000].tolist(), k):
                p, base = slice(a, ends[i]), int(chunks[a]) << CHUNK
                ready.append((deals[i], base, _short(rows[p] - base), target[p].tobytes(), background[p].tobytes(), b""))
            yield _batch(ready, _SUMS)

    @staticmethod
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every document with the sums of its parts."""
        documents, found = [], []
        for batch in batches:
            for base, rows, target, background, own in zip(*(c.to_pylist() for c in batch.columns[1:])):
                if own:
                    d = np.frombuffer(own, _DOCUMENT).copy()
                    d["row"] += np.uint64(base)
                    documents.append(d)
                else:
                    target, background = np.frombuffer(target, float), np.frombuffer(background, float)
                    found.append((_long(rows, len(target)) + base, target, background))
        if not documents:
            return
        own = np.concatenate(documents)
        own = own[np.argsort(own["row"])]
        if found:
            rows, *sums = (np.concatenate(c) for c in zip(*found))
            at = np.searchsorted(own["row"].astype(np.int64), rows)
            for name, values in zip(("target", "background"), sums):
                own[name] += np.bincount(at, values, len(own))
        for k in range(0, len(own), 100_000):
            d = own[k : k + 100_000]
            n = np.maximum(d["n"], 1)
            target, background = d["target"] / n, d["background"] / n
            columns = [pa.array(d["doc_id"], mask=~d["known"]), *map(pa.array, (d["n"], target, background, target - background))]
            yield pa.RecordBatch.from_arrays(columns, names=_SCORES)


_SPLIT = ["part", "base", "words", "sizes", "before", "rows", "documents"]
_SUMS = ["deal", "base", "rows", "target", "background", "documents"]
_SCORES = ["doc_id", "n_tokens", "ce_target", "ce_background", "score"]


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Two numbers and pieces of binary data a row."""
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * (len(names) - 2)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _schema(names: list[str]) -> str:
    return f"{names[0]} int, {names[1]} long, " + ", ".join(f"{n} binary" for n in names[2:])


def _short(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs."""
    return values.astype(np.min_scalar_type(int(values.max()))).tobytes() if len(values) else b""


def _long(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.int64)


@dataclass
class Tables:
    """Counts over the full vocabulary, of ``size`` entries with the one before the first word, and all words' occurrences."""

    docs: DataFrame
    marked: DataFrame
    size: int
    background: int
    target: int
    counts: Counts

    @cached_property
    def grams(self) -> DataFrame:
        return stored(grams(self.marked), "grams")

    def losses(self, strength: float = STRENGTH) -> DataFrame:
        """(before, word, target_loss, background_loss) of every pair: bigrams leaning on unigrams, these on the uniform."""
        single = self.grams.filter("before is null").select("word", *[F.col(s).alias(f"{s}_single") for s in SIDES])
        first = self.grams.filter("word is null").select("before", *[F.col(s).alias(f"{s}_before") for s in SIDES])

        def loss(side: str, total: int) -> Column:
            one = (F.col(f"{side}_single") + 1) / F.lit(float(total + self.size))
            return -F.log((F.col(side) + strength * one) / (F.col(f"{side}_before") + strength))

        pairs = self.grams.filter("before is not null and word is not null")
        # One strategy at every size, as all of these grow with the corpus.
        pairs = pairs.join(single.hint("merge"), "word").join(first.hint("merge"), "before")
        return pairs.select("before", "word", loss("target", self.target).alias("target_loss"), loss("background", self.background).alias("background_loss"))

    def score(self, docs: DataFrame) -> DataFrame:
        same = docs.sameSemantics(self.docs)
        rows = self.marked.select("doc_id", "text", "row", "is_target", F.lit(True).alias("counted"), F.lit(same).alias("scored"))
        if not same:
            others = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
            rows = rows.unionByName(others.withColumns({"is_target": F.lit(False), "counted": F.lit(False), "scored": F.lit(True)}))
        spark = docs.sparkSession
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), self.background // PART)
        sent = spark.sparkContext.broadcast(self.counts)
        split = map_batches(rows, lambda batches: sent.value.split(batches, parts), _schema(_SPLIT)).repartitionById(parts, "part")
        sums = map_batches(split, lambda batches: sent.value.score(batches, parts), _schema(_SUMS)).repartitionById(parts, "deal")
        return map_batches(sums, Counts.total, "doc_id long, n_tokens long, ce_target double, ce_background double, score double")


def marks(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, text, row, is_target).  Targets are a bit each, 64 ids a row, so that the texts need not be shuffled to meet them."""
    chosen = targets.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null")
    bits = chosen.groupBy(F.shiftright("doc_id", 6).alias("_ids")).agg(F.bit_or(F.expr("shiftleft(1L, cast(doc_id & 63 as int))")).alias("_bits"))
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    # It is stored, so that Spark knows its size when it plans the join.
    joined = rows.withColumn("_ids", F.shiftright(F.col("doc_id").cast("long"), 6)).join(stored(bits, "targets"), "_ids", "left")
    is_target = F.expr("coalesce((shiftrightunsigned(_bits, cast(doc_id & 63 as int)) & 1L) = 1L, false)")
    return joined.select("doc_id", "text", "row", is_target.alias("is_target"))


def counted(docs: DataFrame, targets: DataFrame) -> Tables:
    marked = marks(docs, targets)
    table = stored(word_counts(marked), "words")
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0))
    size, *totals = table.filter("before is null").agg(F.count(F.lit(1)), *[whole(c) for c in (*SIDES, "ends", "target_ends")]).first()
    often = table.filter(F.col("background") >= F.lit(HOT * totals[0])).orderBy("word", "before").collect()
    column = lambda rows, name: np.array([r[name] for r in rows], np.int64)
    words, pairs = ([r for r in often if (r["before"] is None) == alone] for alone in (True, False))
    single = [column(words, side) for side in SIDES]
    before, word = column(pairs, "before"), column(pairs, "word")
    return Tables(docs, marked, size + 1, *totals[:2], Counts(
        size + 1, totals[:2], totals[2:], column(words, "word"), single, [s - column(words, e) for s, e in zip(single, ("ends", "target_ends"))],
        Frequent(before, word), list(pair_counts(marked, before, word)) if len(word) else [column([], "")] * 2,
    ))


def learn(docs: DataFrame, targets: DataFrame, size: int | None = None, classes: int = CLASSES) -> Tables | Models:
    """``targets``: the doc_id of the documents that are like the target.  ``size`` bounds the vocabulary; without it every word counts."""
    if size is None:
        return counted(docs, targets)
    marked = marks(docs, targets)
    words = vocabulary(docs, size, classes)
    got = counts(marked, words).toArrow()
    tables = []
    for name in ("background", "target"):
        table = np.zeros(size * size, np.float32)
        table[got.column("pair").to_numpy()] = got.column(name).to_numpy()
        tables.append(losses(table.reshape(size, size)).ravel())
    return Models(words, *tables)


def score(docs: DataFrame, models: Tables | Models) -> DataFrame:
    """doc_id, n_tokens, ce_target, ce_background, score of every document; with ``Tables``, of documents that were counted."""
    if isinstance(models, Tables):
        return models.score(docs)
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(rows):
        models = sent.value
        for doc_id, text in rows:
            yield doc_id, *models.score(text)

    schema = "doc_id long, n_tokens long, ce_target double, ce_background double, score double"
    return map_rows(docs.select("doc_id", "text"), run, schema)

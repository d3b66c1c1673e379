"""Phrases of two to four words by the stripes pattern.

For every prefix of none to three words there is a stripe: a counter of the words that follow it.  Tasks fill stripes from the text;
those of one prefix are merged elementwise.  The counters of all stripes are the
frequencies of all phrases (extensions), the stripe of the empty prefix has the words and, summed, their number (the
prefix's total), and a stripe's largest counter is the largest frequency of any phrase that adds a word to its prefix; the same
counters, seen from the phrase without its first word, give the other side (``subsumption``).

A phrase can only be frequent if what is left without its first or last word is.  So stripes are filled prefix length by prefix
length, and a task takes up a word only where both shorter phrases are in a filter (a bit table, at most ``FILTER_BITS``) of the
frequent ones: a false hit there costs work and changes nothing.

A row holds a task's stripes of one bucket of prefixes, and a bucket is merged at once; there are as many as keep it at about
``BUCKET_BYTES`` of text.  Hot prefixes: a stripe whose prefix has more than one in ``SHARES`` of all words is dealt to several buckets by the
next word's digest; at most ``SHARES`` prefixes of a length can be that frequent, which bounds the table of them that is
broadcast.  The empty prefix is dealt to all buckets.  No task holds more than one bucket, or its own ``FLUSH`` words and one text.

Words are runs without space and tab inside the pieces between ``. , ; : ! ?`` and line breaks, A-Z in lower case; everything is counted
per lang.  Defined results: a null or empty text has no words; a null lang is ``und``; repeated rows count each; without
documents or frequent phrases, the result is empty; only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import groupby

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quarterlight.llm.common import map_rows
from quarterlight.session import stored

LONGEST, LEAST, SUBSUMED, TOP = 4, 30, 80, 2000
SCORE = 2_000_000
SHARES, FILTER_BITS, FLUSH = 4096, 1 << 26, 1 << 22
BUCKETS, BUCKET_BYTES = 256, 1 << 22
#: No byte of UTF-8; stands between pieces.
BREAK = b"\xff"
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes.maketrans(SEPARATORS + b"\t", BREAK * len(SEPARATORS) + b" ")
TEXT_BLOCK = 1 << 20


def tokens_of(text: str | None):
    """Lists of words and breaks of a text, block by block; a break ends it."""
    raw = (text or "").encode("utf-8", "replace").lower().translate(TABLE)
    at = 0
    while at < len(raw):
        stop = raw.find(b" ", at + TEXT_BLOCK)
        stop = len(raw) if stop < 0 else stop
        yield raw[at:stop].replace(BREAK, b" \xff ").split()
        at = stop
    yield [BREAK]


class Filter:
    """Bits of phrases; ``has`` never misses one that was added."""

    def __init__(self, size: int, words: np.ndarray | None = None):
        self.size = size
        self.words = np.zeros(size // 64, np.uint64) if words is None else words

    @staticmethod
    def size_for(n: int, most: int) -> int:
        size = 1 << 12
        while size < 16 * n and size < most:
            size *= 2
        return size

    def places(self, digests: np.ndarray) -> list[np.ndarray]:
        mask = np.uint64(self.size - 1)
        return [digests & mask, (digests >> np.uint64(32)) & mask]

    def add(self, digests: np.ndarray) -> None:
        for place in self.places(digests):
            np.bitwise_or.at(self.words, place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63)))

    def has(self, digests: np.ndarray) -> np.ndarray:
        out = np.ones(len(digests), bool)
        for place in self.places(digests):
            out &= (self.words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def extended(digests: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Digests of phrases with one word more; the empty phrase has its language's."""
    return mixed(mixed(digests) * np.uint64(5) + words)


def word_digest(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


class Words(dict):
    """Numbers of the words of a flush; 0 is the break."""

    def __init__(self):
        super().__init__({BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Filler:
    """The stripes of one task: for prefixes of ``length`` words, counters of the next word."""

    def __init__(self, length: int, frequent: Filter | None, parts: dict[tuple[str, bytes], int], buckets: int, flush: int):
        self.length, self.frequent, self.parts, self.buckets, self.flush = length, frequent, parts, buckets, flush
        self.waiting: dict[str, list[np.ndarray]] = defaultdict(list)
        self.words: dict[str, Words] = defaultdict(Words)
        self.size = 0

    def take(self, lang: str, tokens: list[bytes]):
        number = self.words[lang]
        self.waiting[lang].append(np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens)))
        self.size += len(tokens)
        if self.size >= self.flush:
            # Only the language just read can be inside a text: its last words are the first of the next flush.
            yield from self.out(lang)

    def out(self, open_lang: str | None = None):
        for lang in list(self.waiting):
            ids, number = np.concatenate(self.waiting.pop(lang)), self.words.pop(lang)
            names = list(number)
            yield from self.stripes(lang, ids, names)
            if lang == open_lang and self.length:
                tail, fresh = ids[-self.length :], self.words[lang]
                self.waiting[lang].append(np.array([fresh[names[i]] for i in tail], np.int64))
        self.size = 0

    def stripes(self, lang: str, ids: np.ndarray, names: list[bytes]):
        """(lang, bucket, prefixes, sizes, words, counts) of all phrases of ``length`` + 1 words that lie in ``ids``."""
        hashes = np.fromiter(map(word_digest, names), np.uint64, len(names))
        n = len(ids) - self.length
        if n <= 0:
            return
        start = np.flatnonzero(ids[:n] != 0)
        base = np.full(len(names), word_digest(lang.encode()), np.uint64)
        digest = extended(base, hashes)
        if self.length == 0:
            yield from self.packed(lang, [b""], np.zeros(len(start), np.int64), ids[start], names)
            return
        if self.length == 1:
            good = self.frequent.has(digest)
            start = start[good[ids[start]]]
            follow = ids[start + 1]
            stay = (follow != 0) & good[follow]
            yield from self.packed(lang, names, ids[start[stay]], follow[stay], names)
            return
        # Phrases of ``length`` words at every place, numbered; -1 where a break or a rare phrase is.
        number = np.where(ids != 0, ids, -1)
        spelled = names
        for k in range(1, self.length):
            follow = np.full(len(ids), -1, np.int64)
            follow[: len(ids) - k] = np.where(ids[k:] != 0, ids[k:], -1)
            both = np.flatnonzero((number >= 0) & (follow >= 0))
            keys, inverse = np.unique(number[both] * len(names) + follow[both], return_inverse=True)
            before, last = keys // len(names), keys % len(names)
            digest = extended(digest[before], hashes[last])
            renumbered = np.full(len(ids), -1, np.int64)
            if k == self.length - 1:
                good = self.frequent.has(digest)
                place = np.cumsum(good) - 1
                renumbered[both] = np.where(good[inverse], place[inverse], -1)
                before, last, digest = before[good], last[good], digest[good]
            else:
                renumbered[both] = inverse
            number = renumbered
            spelled = [spelled[b] + b" " + names[w] for b, w in zip(before.tolist(), last.tolist())] if k == self.length - 1 else _Pairs(spelled, names, before, last)
        # A phrase is extended where the one that starts a word later is frequent too.
        at = np.flatnonzero((number[:-1] >= 0) & (number[1:] >= 0))
        at = at[at < n]
        yield from self.packed(lang, spelled, number[at], ids[at + self.length], names)

    def packed(self, lang: str, prefixes: list[bytes], prefix: np.ndarray, follow: np.ndarray, names: list[bytes]):
        if not len(prefix):
            return
        keys, counts = np.unique(prefix * len(names) + follow, return_counts=True)
        before, last = keys // len(names), keys % len(names)
        starts = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
        sizes = np.diff(np.append(starts, len(keys)))
        named = [prefixes[i] for i in before[starts].tolist()]
        bucket = np.repeat(np.fromiter((zlib.crc32(n) % self.buckets for n in named), np.int64, len(named)), sizes)
        for a, n, name in zip(starts.tolist(), sizes.tolist(), named) if self.parts or not self.length else ():
            # A hot stripe is dealt out by its words.
            parts = self.parts.get((lang, name), 1) if self.length else self.buckets
            if parts > 1:
                spelled = (names[i] for i in last[a : a + n].tolist())
                bucket[a : a + n] = [zlib.crc32(b"%s %d" % (name, zlib.crc32(w) % parts)) % self.buckets for w in spelled]
        order = np.argsort(bucket, kind="stable")
        bucket, before, last, counts = bucket[order], before[order], last[order].tolist(), counts[order].astype("<u4")
        new = np.concatenate(([True], bucket[1:] != bucket[:-1]))
        edges = np.flatnonzero(new | np.concatenate(([True], before[1:] != before[:-1])))
        sizes = np.diff(np.append(edges, len(bucket))).astype("<u4")
        first_edges = np.flatnonzero(new[edges])
        for x, y in zip(first_edges.tolist(), [*first_edges[1:].tolist(), len(edges)]):
            a, b = int(edges[x]), int(edges[y]) if y < len(edges) else len(bucket)
            some = b"\n".join([prefixes[i] for i in before[edges[x:y]].tolist()]).decode()
            yield lang, int(bucket[a]), some, sizes[x:y].tobytes(), b" ".join([names[i] for i in last[a:b]]).decode(), counts[a:b].tobytes()


class _Pairs:
    """Spellings of phrases, made when asked for."""

    def __init__(self, spelled, names, before, last):
        self.spelled, self.names, self.before, self.last = spelled, names, before, last

    def __getitem__(self, i: int) -> bytes:
        return self.spelled[int(self.before[i])] + b" " + self.names[int(self.last[i])]


def stripes(docs: DataFrame, length: int, least: int, frequent: Filter | None, parts: dict, buckets: int, flush: int) -> DataFrame:
    """(lang, prefix, total, words, counts): merged stripes; counters under ``least`` are only in the total."""
    sent = docs.sparkSession.sparkContext.broadcast((frequent, parts))

    def fill(rows):
        filler = Filler(length, *sent.value, buckets, flush)
        for lang, text in rows:
            for tokens in tokens_of(text):
                if tokens:
                    yield from filler.take(lang, tokens)
        yield from filler.out()

    def merge(rows):
        for (lang, _), group in groupby(rows, key=lambda r: r[:2]):
            packed, totals = [], defaultdict(int)
            for _, _, prefixes, sizes, words, counts in group:
                prefixes, sizes, counts = prefixes.split("\n"), np.frombuffer(sizes, "<u4"), np.frombuffer(counts, "<u4")
                packed.append((prefixes, sizes, words, counts))
                for prefix, n in zip(prefixes, np.add.reduceat(counts, np.cumsum(sizes, dtype=np.int64) - sizes, dtype=np.int64).tolist()):
                    totals[prefix] += n
            merged: dict[str, defaultdict[str, int]] = {p: defaultdict(int) for p, n in totals.items() if n >= least}
            for prefixes, sizes, words, counts in packed if merged else ():
                words, counts, at = words.split(" "), counts.tolist(), 0
                for prefix, size in zip(prefixes, sizes.tolist()):
                    if (stripe := merged.get(prefix)) is not None:
                        for word, n in zip(words[at : at + size], counts[at : at + size]):
                            stripe[word] += n
                    at += size
            for prefix, total in totals.items():
                kept = [(w, n) for w, n in merged[prefix].items() if n >= least] if prefix in merged else []
                if kept or not length:
                    yield lang, prefix, total, [w for w, _ in kept], [n for _, n in kept]

    marked = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    filled = map_rows(marked, fill, "lang string, bucket long, prefixes string, sizes binary, words string, counts binary")
    dealt = filled.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")
    return map_rows(dealt, merge, "lang string, prefix string, total long, words array<string>, counts array<long>")


def phrase(prefix: str = "prefix", word: str = "word"):
    return F.when(F.col(prefix) == "", F.col(word)).otherwise(F.concat_ws(" ", prefix, word))


def filter_of(found: DataFrame, n: int, most: int) -> Filter:
    """Bits of the phrases of a table (lang, phrase), set in every task and united in Spark."""
    size = Filter.size_for(n, most)

    def run(rows):
        mine = Filter(size)
        langs: dict[str, int] = {}
        digests = []
        for lang, text in rows:
            base = langs.setdefault(lang, word_digest(lang.encode()))
            d = np.array([base], np.uint64)
            for word in text.encode().split(b" "):
                d = extended(d, np.array([word_digest(word)], np.uint64))
            digests.append(d[0])
            if len(digests) >= 100_000:
                mine.add(np.array(digests, np.uint64))
                digests.clear()
        if digests:
            mine.add(np.array(digests, np.uint64))
        for cell in np.flatnonzero(mine.words).tolist():
            yield cell, int(mine.words[cell].view(np.int64))

    cells = map_rows(found.select("lang", "phrase"), run, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size // 64, np.int64)
    words[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    return Filter(size, words.view(np.uint64))


def frequencies(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, shares: int = SHARES, filter_bits: int = FILTER_BITS, flush: int = FLUSH
) -> tuple[DataFrame, DataFrame]:
    """(lang, length, phrase, prefix, f) of all phrases of up to ``longest`` words with f >= ``least``, and (lang, n)."""
    tables, frequent, parts, every = [], None, {}, None
    buckets = max(BUCKETS, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES)
    for length in range(longest):
        merged = stored(stripes(docs, length, least, frequent, parts, buckets, flush), "stripes")
        if length == 0:
            every = stored(merged.groupBy("lang").agg(F.sum("total").alias("n")), "words")
            total = every.agg(F.sum("n")).first()[0] or 0
        cells = merged.select("lang", "prefix", F.explode(F.arrays_zip("words", "counts")).alias("cell"))
        cells = cells.select("lang", F.lit(length + 1).alias("length"), "prefix", F.col("cell.words").alias("word"), F.col("cell.counts").alias("f"))
        found = cells.withColumn("phrase", phrase()).select("lang", "length", "phrase", "prefix", "f")
        tables.append(found)
        n = merged.agg(F.sum(F.size("words"))).first()[0] or 0
        if length + 1 == longest or not n:
            break
        frequent = filter_of(found, n, filter_bits)
        hot = found.filter(F.col("f") * shares > total).select("lang", "phrase", F.ceil(F.col("f") * shares / F.lit(float(total))).alias("parts"))
        parts = {(r["lang"], r["phrase"].encode()): int(r["parts"]) for r in hot.collect()}  # at most ``shares`` rows
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out, every


def subsumption(found: DataFrame) -> DataFrame:
    """(lang, phrase, around): the largest frequency among phrases that add a word to its end or to its start.

    A longer phrase that holds this one is never more frequent than the part of it that adds one word, so one word decides.
    """
    longer = found.filter("length > 2")
    ends = longer.select("lang", F.col("prefix").alias("phrase"), "f")
    starts = longer.select("lang", F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("phrase"), "f")
    return ends.unionByName(starts).groupBy("lang", "phrase").agg(F.max("f").alias("around"))


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, subsumed: int = SUBSUMED, top: int = TOP, shares: int = SHARES, filter_bits: int = FILTER_BITS, flush: int = FLUSH
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` phrases of each lang."""
    found, every = frequencies(docs, longest, least, shares, filter_bits, flush)
    candidates = found.filter("length > 1")
    around = subsumption(found)
    kept = candidates.join(around, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("around") < subsumed * F.col("f"), F.lit(True)))
    kept = stored(kept.select("lang", "phrase", "length", F.col("f").alias("a")), "candidates")
    words = F.split("phrase", " ")
    cuts = kept.select("lang", "phrase", "length", "a", words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    spelled = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", spelled(F.lit(1), F.col("k")).alias("left"), spelled(F.col("k") + 1, F.col("length") - F.col("k")).alias("right"))
    # One strategy at every size: all of these grow with the corpus.
    part = found.select("lang", "phrase", "f").hint("merge")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr(f"(cast({SCORE} as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    cuts = cuts.withColumn("score", score)
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut")).select("lang", "phrase", "cut.*")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = best.withColumn("rank", rank).filter(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))
    # At most ``top`` rows for each lang meet one row for each lang.
    return best.join(every, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

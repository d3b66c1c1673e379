"""Benchmark decontamination with a generalised suffix automaton.

The items' words, ASCII letters in lower case, go into one automaton.  A document's words are streamed through it; after
each word the state tells the longest piece of some item that ends there.  Where that is a window long,
or a whole item shorter than a window ends, the words of the match are hit.  Items are a query set:
they are taken in blocks of at most ``BLOCK_WORDS`` words or one item (``blocks``), each block is broadcast,
and each block's automaton, at most two states a word, is built once in a task.

Defined results: null texts have no words; items without words are in no window; repeated items count by their
item_id; other columns of the documents come through ``remove`` unchanged, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterlight.llm.common import fresh, map_batches, map_rows, whole_text
from quarterlight.session import stored

WINDOW = 10
BLOCK_WORDS = 200_000

#: Bytes that are not in words become spaces, capital letters small ones.
_WORD_BYTES = frozenset((*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)))
_TABLE = bytes(b if b in _WORD_BYTES else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


class Automaton:
    """Suffix automaton of many word sequences."""

    def __init__(self, items: Iterable[tuple[str, str]], window: int = WINDOW):
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = [(item, words) for item, text in items if (words := words_of(text))]
        for _, words in sequences:
            last = 0
            for w in words:
                last = self._extend(last, w)
        states = range(len(self.step))
        self.short: list[tuple] = [() for _ in states]
        self.holders: dict[int, set[str]] = {}
        own: dict[int, list[tuple[int, str]]] = {}
        for item, words in sequences:
            state = 0
            for i, w in enumerate(words):
                state = self.step[state][w]
                if i + 1 >= window:
                    self.holders.setdefault(self.window_state(state), set()).add(item)
            if len(words) < window:
                own.setdefault(self.state_of(state, len(words)), []).append((len(words), item))
        for s in sorted(states, key=self.length.__getitem__):
            above = self.short[self.link[s]] if s else ()
            self.short[s] = (*above, *own.get(s, ()))

    def _extend(self, last: int, w: bytes) -> int:
        step, link, length = self.step, self.link, self.length
        if (q := step[last].get(w)) is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p != -1:
            q = step[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: bytes, q: int) -> int:
        step, link, length = self.step, self.link, self.length
        copy = len(step)
        step.append(dict(step[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p != -1 and step[p].get(w) == q:
            step[p][w] = copy
            p = link[p]
        return copy

    def state_of(self, state: int, n: int) -> int:
        """The state of the last n words of a match at ``state``."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def window_state(self, state: int) -> int:
        return self.state_of(state, self.window)

    def hits(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Runs of hit words (start, stop), and the items with occurring windows."""
        step, link, length, short, window = self.step, self.link, self.length, self.short, self.window
        runs: list[list[int]] = []
        items: set[str] = set()
        state, n, here = 0, 0, step[0]
        for i, w in enumerate(words):
            new = here.get(w)
            while new is None and state:
                state = link[state]
                n = length[state]
                new = step[state].get(w)
            if new is None:
                here = step[0]
                continue
            state, n, here = new, n + 1, step[new]
            if n >= window:
                items |= self.holders[self.window_state(state)]
                size = n
            elif short[state]:
                size = 0
            else:
                continue
            for k, item in short[state]:
                if k <= n:
                    items.add(item)
                    size = max(size, k)
            if size:
                start = i + 1 - size
                while runs and runs[-1][1] >= start:
                    start = min(start, runs.pop()[0])
                runs.append([start, i + 1])
        return runs, items


def blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded size, one at a time; one item is never split.  There is always a first block."""
    block: list[tuple[str, str]] = []
    size = 0
    for item, text in items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), whole_text()).toLocalIterator():
        n = len(words_of(text))
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += n
    yield block


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, ``runs`` (word numbers start, stop, start, stop ...) and ``items`` with occurring windows.

    One row per input row.  With several blocks, the documents are read once for each and the small results of a row are merged.
    """
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    parts = []
    for block in blocks(items):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(rows, sent=sent):
            automaton = Automaton(sent.value, window)
            for doc_id, text, row in rows:
                words = words_of(text)
                runs, hit = automaton.hits(words)
                yield row, doc_id, len(words), [x for r in runs for x in r], sorted(hit)

        parts.append(map_rows(rows, run, "row long, doc_id long, n_words long, runs array<long>, items array<string>"))
    if len(parts) == 1:
        return parts[0].drop("row")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    none = F.array().cast("array<array<bigint>>")
    pairs = F.when(F.size("runs") == 0, none).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.floor(F.size("runs") / 2) - 1), lambda i: F.array(F.get("runs", (2 * i).cast("int")), F.get("runs", (2 * i + 1).cast("int"))))
    )
    merged = every.withColumn("runs", pairs).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.sort_array(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    def join(out, r):
        last = F.element_at(out, -1)
        touches = (F.size(out) > 0) & (F.get(r, 0) <= last)
        longer = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.greatest(last, F.get(r, 1))))
        return F.when(touches, longer).otherwise(F.concat(out, r))

    return merged.select("doc_id", "n_words", F.aggregate("runs", F.array().cast("array<bigint>"), join).alias("runs"), "items")


def report(found: DataFrame) -> DataFrame:
    """Counts and the digest of the items, per document."""
    n = F.aggregate(F.transform("runs", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select(
        "doc_id", "n_words", n.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n > 0).alias("contaminated"),
    )


def cut(text: str, automaton: Automaton, min_span: int, max_coverage: float) -> str | None:
    """The text without its hit runs of ``min_span`` words or more, again until none is left; None if more than
    ``max_coverage`` of its words were hit at first."""
    data, first = text.encode("utf-8", "replace"), True
    while True:
        words = data.translate(_TABLE).split()
        runs = [r for r in automaton.hits(words)[0] if r[1] - r[0] >= min_span]
        if not runs:
            return text if first else data.decode("utf-8")
        if first and sum(b - a for a, b in runs) > max_coverage * len(words):
            return None
        first = False
        data = spliced(data, runs)


def spliced(data: bytes, runs: list) -> bytes:
    """The text without the words of the runs."""
    places = [m.span() for m in _WORD.finditer(data)]
    kept, at = [], 0
    for a, b in runs:
        kept.append(data[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, data[at:]])


def remove(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_span: int = 1, max_coverage: float = 0.5) -> DataFrame:
    """The documents with their hit spans cut out (``n_chars`` follows where it exists); those mostly hit go.

    All columns come through; a null text stays null.  The number of blocks makes no difference to the result.
    """
    of_items = blocks(items)
    block = next(of_items)
    if next(of_items, None) is not None:
        return remove_by_rounds(docs, items, window, min_span, max_coverage)
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        automaton = Automaton(sent.value, window)
        for batch in batches:
            column = batch.schema.get_field_index("text")
            new = [None if t is None else cut(t, automaton, min_span, max_coverage) for t in batch.column(column).to_pylist()]
            gone = [n is None and t for n, t in zip(new, batch.column(column).is_valid().to_pylist())]
            batch = batch.set_column(column, batch.schema.field(column), pa.array(new, batch.schema.field(column).type))
            if (k := batch.schema.get_field_index("n_chars")) >= 0:
                kind = batch.schema.field(k).type
                lengths = [old if t is None else len(t) for t, old in zip(new, batch.column(k).to_pylist())]
                batch = batch.set_column(k, batch.schema.field(k), pa.array(lengths, kind))
            yield batch.filter(pa.array([not g for g in gone]))

    return map_batches(docs, run, docs.schema)


def remove_by_rounds(docs: DataFrame, items: DataFrame, window: int, min_span: int, max_coverage: float) -> DataFrame:
    """``remove`` for several blocks: every round finds the hits of all blocks and cuts their union, until no block hits.

    Only the documents that a round has cut are looked at again.
    """
    row_, round_, new_ = fresh(docs, "_row", "_round", "_new")
    base = stored(docs.withColumn(row_, F.monotonically_increasing_id()), "decontaminate-rows")
    active = base.filter("text is not null").select(F.col(row_).alias("doc_id"), "text")
    changes = []
    while True:
        hit = find(active, items, window).filter(F.size("runs") > 0).select("doc_id", "n_words", "runs")

        def run(rows, first=not changes):
            for row, text, n_words, flat in rows:
                runs = [(a, b) for a, b in zip(flat[::2], flat[1::2]) if b - a >= min_span]
                if runs:
                    mostly = first and sum(b - a for a, b in runs) > max_coverage * n_words
                    yield row, None if mostly else spliced(text.encode("utf-8", "replace"), runs).decode("utf-8")

        found = active.join(hit, "doc_id").select("doc_id", "text", "n_words", "runs")
        change = stored(map_rows(found, run, "doc_id long, text string"), f"decontaminate-round-{len(changes)}")
        if change.isEmpty():
            break
        changes.append(change.withColumn("round", F.lit(len(changes))))
        active = change.filter("text is not null")
    if not changes:
        return base.drop(row_)
    every = changes[0]
    for change in changes[1:]:
        every = every.unionByName(change)
    last = every.groupBy(F.col("doc_id").alias(row_)).agg(F.max("round").alias(round_), F.max_by("text", "round").alias(new_))
    joined = base.join(last, row_, "left").filter(F.col(round_).isNull() | F.col(new_).isNotNull())
    joined = joined.withColumn("text", F.coalesce(F.col(new_), F.col("text")))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        joined = joined.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])

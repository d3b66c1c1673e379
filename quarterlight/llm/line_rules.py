"""Quality rules, line first: lines are judged one by one, failing lines go, and a document that loses too
much of its text is rejected.  DataFrame functions only.

A line is a piece between ``\\n``; words are runs of characters other than space and U+0009 to U+000D.  Rules:

- punctuation: symbols make up a tenth of the line's characters or more, exclamation marks a twentieth
  or more with at least three of them, or a long line has no punctuation mark at all;
- navigation: at least three bars (``|``) that stand between entries;
- boilerplate: a short line with a notice (licence, rights, cookies, sign-in ...).

Defined results: a null or empty text has no words, fails and is rejected; lines without a word are never
failures and weigh nothing.  Repeated rows are judged each on its own; no row is added or dropped.  Input columns stay, but for
those named like a result, which the result replaces.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterlight.llm.common import fresh, whole_text
from quarterlight.operators.joins import computed_once

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
MARKS = r"[.,;:!?\"'()/-]"
NOTICE = (
    r"all rights reserved|licensed under|released under the|terms of (use|service)|privacy policy|cookie policy"
    r"|use cookies|sign up for|log in to|subscribe to our|enable javascript|copyright \(c\)|share this (page|post|article)"
)
NOTICE_ANY_CASE = re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", NOTICE)
#: Words of a repeated window; white space in a line, at most for notices and at least for missing marks.
WINDOW, NOTICE_BLANKS, UNMARKED_BLANKS = 8, 24, 60


def words_of(text: Column) -> Column:
    """The words; an empty array for a text without words."""
    inner = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(inner) == 0, F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def count_of(text: Column, character: str) -> Column:
    """How often the character stands in the text."""
    return (F.length(text) - F.length(F.replace(text, F.lit(character)))).cast("long")


def symbols_in(text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")


def inked(text: Column) -> Column:
    """Code points in words."""
    for character in SPACE:
        text = F.replace(text, F.lit(character))
    return F.length(text).cast("long")


def line_facts(line: Column) -> Column:
    """What the rules look at, each worked out once."""
    return F.struct(line.alias("line"), inked(line).alias("ink"), symbols_in(line).alias("symbols"))


def line_fails(f: Column) -> Column:
    """True if one of the line rules rejects the line; cheap conditions stand first."""
    line, ink, blanks = f["line"], f["ink"], F.length(f["line"]) - f["ink"]
    shouts = F.when(line.contains("!!"), count_of(line, "!")).otherwise(0)
    return (ink > 0) & (
        (f["symbols"] * 10 >= ink)
        | ((shouts >= 3) & (shouts * 20 >= ink))
        | ((blanks >= UNMARKED_BLANKS) & ~line.rlike(MARKS))
        | ((blanks <= NOTICE_BLANKS) & line.rlike(NOTICE_ANY_CASE))
        | (F.when(line.contains("|"), count_of(line, "|")).otherwise(0) >= 3)
    )


def judge(docs: DataFrame, min_words: int = 20, max_repeat_pct: int = 30, min_kept_pct: int = 40) -> DataFrame:
    """The given columns plus counts, verdicts, ``clean_text`` (without failing lines) and ``lost_chars``.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_pct`` percent of them in windows of
    eight words that occur twice.  ``kept``: not so, and the lines left hold ``min_kept_pct`` percent of the characters.
    No shuffle: all is worked out inside the row.  Windows are compared by 64-bit hashes; only documents with
    a repeated hash sort theirs, with their places, to find the words covered.
    """
    text_, lines_, words_, halves_, hashes_, sorted_, repeat_, failing_, found_ = fresh(
        docs, "_text", "_lines", "_words", "_halves", "_hashes", "_sorted", "_repeat", "_failing", "_found"
    )
    text = F.col(text_)
    rows = docs.select("*", whole_text().alias(text_))
    rows = computed_once(rows, lines_, F.transform(F.split(text, "\n"), line_facts))
    rows = computed_once(rows, words_, F.transform(words_of(text), lambda w: F.xxhash64(w)))
    n_words, half = F.size(words_), WINDOW // 2
    nothing = F.array().cast("array<bigint>")
    halves = F.transform(F.sequence(F.lit(0), n_words - half), lambda i: F.xxhash64(*[F.get(words_, i + k) for k in range(half)]))
    rows = computed_once(rows, halves_, F.when(n_words < WINDOW, nothing).otherwise(halves))
    # Few texts repeat half a window; only those can repeat a whole one.
    windows = F.transform(F.sequence(F.lit(0), n_words - WINDOW), lambda i: F.xxhash64(F.get(halves_, i), F.get(halves_, i + half)))
    suspect = F.size(F.array_distinct(halves_)) < F.size(halves_)
    rows = computed_once(rows, hashes_, F.when(suspect, windows).otherwise(nothing))
    repeats = F.size(F.array_distinct(hashes_)) < F.size(hashes_)
    placed = F.transform(hashes_, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = computed_once(rows, sorted_, F.when(repeats, F.sort_array(placed)))

    def twin(x, k):
        return ((k > 0) & (F.get(sorted_, k - 1)["h"] == x["h"])) | F.coalesce(F.get(sorted_, k + 1)["h"] == x["h"], F.lit(False))

    twins = F.sort_array(F.transform(F.filter(sorted_, twin), lambda x: x["i"]))
    covered = F.aggregate(
        twins,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n")),
        lambda s: s["n"],
    )
    rows = computed_once(rows, repeat_, F.coalesce(F.when(repeats, covered), F.lit(0).cast("long")))
    rows = computed_once(rows, failing_, F.transform(lines_, line_fails))
    with_word = F.transform(F.filter(lines_, lambda f: f["ink"] > 0), lambda f: f["line"])
    lost = F.aggregate(
        F.zip_with(lines_, failing_, lambda f, bad: F.when(bad, f["ink"]).otherwise(0)), F.lit(0).cast("long"), lambda s, n: s + n
    )
    passing = F.filter(lines_, lambda f, i: ~F.get(failing_, i))
    clean = F.array_join(F.transform(passing, lambda f: f["line"]), "\n")
    found = F.struct(
        n_words.cast("long").alias("n_words"),
        F.aggregate(lines_, F.lit(0).cast("long"), lambda s, f: s + f["ink"]).alias("word_chars"),
        F.aggregate(lines_, F.lit(0).cast("long"), lambda s, f: s + f["symbols"]).alias("n_symbols"),
        (F.size(with_word) - F.size(F.array_distinct(with_word))).cast("long").alias("n_dup_lines"),
        F.col(repeat_).alias("n_repeat_words"),
        ((n_words < min_words) | (F.col(repeat_) * 100 > n_words * max_repeat_pct)).alias("base_failed"),
        lost.alias("lost_chars"),
        clean.alias("clean_text"),
    )
    rows = computed_once(rows, found_, found)
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "clean_text")
    of = lambda c: F.col(f"{found_}.{c}")
    kept = ~of("base_failed") & (of("lost_chars") * 100 <= of("word_chars") * (100 - min_kept_pct))
    stay = [c for c in docs.columns if c.lower() not in (*new, "kept")]
    return rows.select(*[F.col(f"`{c}`") for c in stay], *[of(c).alias(c) for c in new], kept.alias("kept"))

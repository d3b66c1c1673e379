"""Packing against plain greedy and the library's ids; phrases against plain counts; clusters against plain rounds; all three against their SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from quarterlight.llm import drift_clusters, packing, phrases
from quarterlight.llm.common import read
from quarterlight.llm.queries import BYTE_BPE, QUERIES
from quarterlight.llm.sql import SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, table", [("op12_phrase_stripes", "documents"), ("op13_drift_clusters", "embeddings")])
def test_sql(spark, name, table):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = connection.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(tuple(r) for r in got.select(*columns).collect())
    assert rows and rows == sorted(cursor.fetchall())


# -- packing


def sequences_of(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["sequence_id"]].append(r)
    return {k: sorted(v, key=lambda r: r["offset"]) for k, v in out.items()}


def check_pieces(rows, texts, length=1024):
    """Every id lies in one piece, offsets have no gap, sequences are full or a power of two long."""
    own = Tokenizer.from_file(BYTE_BPE)
    ids = {i: [*own.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts.items()}
    of = defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append(r)
    assert set(of) == set(ids)
    for i, pieces in of.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            part = np.array(ids[i][at : at + r["length"]], "<u4")
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids[i]), zlib.crc32(part.tobytes()))
            at += r["length"]
        assert at == len(ids[i])
    for pieces in sequences_of(rows).values():
        at = 0
        for r in pieces:
            assert r["offset"] == at
            at += r["length"]
        assert at == pieces[0]["sequence_tokens"] and (at == length or (at < length and at & (at - 1) == 0))
        assert sum(packing.cost(r["length"]) for r in pieces) == pieces[0]["sequence_cost"]


def test_pieces_of_the_table(spark):
    texts = {r["doc_id"]: r["text"] for r in read(spark, SF, "documents").collect()}
    check_pieces(QUERIES["op11_balanced_packing"](spark, SF).collect(), texts)


@pytest.mark.parametrize("length, window", [(1024, 1024), (64, 4), (8, 1)])
def test_awkward_pieces(documents, awkward, length, window):
    awkward += ["<|endoftext|> said <|endoftext|>", "a" * 5000, " ".join(["x"] * 3000), "😀".encode("utf-16", "surrogatepass").decode("utf-16")]
    rows = packing.pack(documents(awkward, sequence_id=3, length="x"), BYTE_BPE, length, window).collect()
    check_pieces(rows, dict(enumerate(awkward)), length)


def test_repeated_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, "one two"), (None, "one two"), (7, None)], "doc_id long, text string").coalesce(1)
    rows = packing.pack(docs, BYTE_BPE).collect()
    assert sorted(((r["doc_id"], r["start"], r["doc_tokens"]) for r in rows if r["start"] == 0), key=str) == [(7, 0, 1), (None, 0, 3), (None, 0, 3)]
    assert sum(r["length"] for r in rows) == 7
    assert packing.pack(docs.filter("doc_id < 0"), BYTE_BPE).count() == 0


def plain_balance(sizes, sequences, length):
    """The same rule with lists only: sequences as lists of (document, first, last)."""
    queue = []
    for k, n in enumerate(sizes):
        queue += [(at, min(n, at + length), k) for at in range(0, n, length)]
    cost, room, filled = [0] * sequences, [length] * sequences, [[] for _ in range(sequences)]
    while queue and max(room):
        queue.sort(key=lambda q: (-(q[1] - q[0]), q[2]))
        a, b, k = queue.pop(0)
        able = [s for s in range(sequences) if room[s] >= b - a] or [s for s in range(sequences) if 2 * room[s] >= max(room)]
        s = min(able, key=lambda s: (cost[s], s))
        cut = min(b, a + room[s])
        filled[s].append((k, a, cut))
        cost[s] += packing.cost(cut - a)
        room[s] -= cut - a
        if cut < b:
            queue.append((cut, b, k))
    return filled, queue


@pytest.mark.parametrize("seed", range(6))
def test_balance_against_plain_rule(seed):
    rng = random.Random(seed)
    # Distinct remainders: the plain rule and the queue may order equal sizes of one document differently.
    sizes = rng.sample(range(1, 130), 40)
    pieces = [packing.Piece(k, 0, np.full(n, k), n) for k, n in enumerate(sizes)]
    filled, over = packing.balance(pieces, sum(sizes) // 64, 64)
    expected, rest = plain_balance(sizes, sum(sizes) // 64, 64)
    size = lambda f: [sorted(len(p.ids) if isinstance(p, packing.Piece) else p[2] - p[1] for p in s) for s in f]
    assert size(filled) == size(expected)
    assert sum(len(p.ids) for p in over) == sum(b - a for a, b, _ in rest) < 64


def test_costs_are_closer_than_by_best_fit():
    rng = random.Random(3)
    sizes = [rng.randint(1, 500) for _ in range(2000)]
    pieces = [packing.Piece(k, 0, np.zeros(n, np.uint32), n) for k, n in enumerate(sizes)]
    filled, _ = packing.balance(pieces, sum(sizes) // 1024)
    balanced = [sum(packing.cost(len(p.ids)) for p in s) for s in filled]
    room, costs = [], []
    for n in sorted(sizes, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if not fits:
            room.append(1024)
            costs.append(0)
            fits = [len(room) - 1]
        k = min(fits, key=room.__getitem__)
        room[k] -= n
        costs[k] += packing.cost(n)
    assert np.std(balanced) < 0.3 * np.std(costs) and len(balanced) <= len(costs)
    assert sum(len(s) for s in filled) < 1.25 * len(sizes)


def test_powers_of_two():
    parts = packing.powers([packing.Piece(k, 0, np.arange(n), n) for k, n in enumerate((300, 5, 400))])
    assert [sum(len(p.ids) for p in s) for s in parts] == [512, 128, 64, 1]
    assert packing.powers([]) == []


def test_text_blocks_do_not_change_ids():
    rng = random.Random(5)
    text = "".join(rng.choice(["word", " ", "  ", "\n", "it's", ". ", "É", " né", "42", " <|endoftext|>", "\xa0", "日本"]) for _ in range(4000))
    own = Tokenizer.from_file(BYTE_BPE)
    for size in (1, 7, 100):
        parts = list(packing.blocks(text, size))
        assert "".join(parts) == text and len(parts) > 10
        assert [i for p in parts for i in own.encode(p, add_special_tokens=False).ids] == own.encode(text, add_special_tokens=False).ids


# -- phrases


def plain_phrases(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    found = {p for p, c in f.items() if len(p) > 2 and c >= least}
    gone = set()
    for lang, *words in found:
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                if 100 * f[(lang, *words)] >= 80 * f[(lang, *words[i : i + k])]:
                    gone.add((lang, *words[i : i + k]))
    out = defaultdict(list)
    for p in found - gone:
        lang, a = p[0], f[p]
        cuts = [(2_000_000 * a // (f[p[: k + 1]] + f[(lang, *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p[1:]).encode(), a, f[p[: k + 1]], f[(lang, *p[k + 1 :])]))
    return sorted(
        (lang, rank + 1, p.decode(), a, x, y, n[lang], -score)
        for lang, some in out.items()
        for rank, (score, _, p, a, x, y) in enumerate(sorted(some)[:top])
    )


@pytest.mark.parametrize("flush, shares, bits, top", [(1 << 20, 4096, 1 << 26, 2000), (7, 3, 1 << 12, 5), (50, 40, 64, 2000)])
def test_phrases_against_plain_counts(spark, awkward, flush, shares, bits, top):
    """Small flushes cut texts in the middle, many parts cut stripes, a full filter lets everything through."""
    rng = random.Random(flush)
    words = ["new", "york", "city", "a", "The", "the", "of", "é", "zz", "\xa0", "tab\tbed"]
    texts = [" ".join(rng.choices(words, [9, 8, 7, 5, 5, 5, 4, 3, 2, 1, 1], k=rng.randint(0, 60))).replace("a b", "a, b").replace("of the", "of\nthe") for _ in range(60)]
    rows = [(rng.choice(["en", "en", "fr", None]), t) for t in [*awkward, *texts]]
    docs = spark.createDataFrame([(i, t, lang, 1) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, f int")
    got = phrases.collocations(docs, least=4, top=top, shares=shares, filter_bits=bits, flush=flush)
    got = got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    expected = plain_phrases(rows, 4, top)
    assert len(expected) > 20 or top == 5
    assert sorted(tuple(r) for r in got) == expected


def test_no_phrases(documents):
    docs = documents(["a b", None, ""])
    assert phrases.collocations(docs).collect() == []
    assert phrases.collocations(docs.filter("doc_id < 0")).collect() == []


def test_long_text_in_blocks(monkeypatch):
    monkeypatch.setattr(phrases, "TEXT_BLOCK", 16)
    text = "One two, three\tFOUR five six seven. eight\x0bnine" * 9
    parts = [t for block in phrases.tokens_of(text) for t in block]
    monkeypatch.setattr(phrases, "TEXT_BLOCK", 1 << 20)
    assert parts == [t for block in phrases.tokens_of(text) for t in block]


# -- clusters


def plain_clusters(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in first[:k]]
    for turn in range(rounds + 1):
        square = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
        own = [min(range(len(centers)), key=lambda j: (square(v, centers[j]), j)) for _, v in kept]
        if turn < rounds:
            for j in range(len(centers)):
                mine = [v for (_, v), o in zip(kept, own) if o == j]
                if mine:
                    centers[j] = [sum(c) // len(mine) for c in zip(*mine)]
    away = [square(v, centers[o]) for (_, v), o in zip(kept, own)]
    each = Counter()
    for o, d in zip(own, away):
        each[o] += d
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, o, d, each[o], sum(away), text[o]) for (i, _), o, d in zip(kept, own, away)), key=str)


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster string")


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def test_clusters_against_plain_rounds(spark):
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=64).astype("float32").tolist()) for i in range(120)]
    rows += [(i, v) for i, v in rows[:40]] + [(None, rows[0][1]), (500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 65)]
    rows += [(504, [1.0] * 63 + [None]), (505, [math.inf] + [0.0] * 63), (506, [0.0] * 63 + [math.nan]), (507, [0.0] * 64), (508, [-0.25] * 64)]
    got = drift_clusters.cluster(vectors(spark, rows)).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_clusters(rows)


def test_huge_components_are_exact(spark):
    rows = [(i, [float(i * 10**5 + k) for k in range(3)]) for i in range(12)] + [(20, [3.0, 1.0, 2.0]), (21, [-2.0, 0.0, 0.5])]
    got = drift_clusters.cluster(vectors(spark, rows, "double"), k=3, rounds=4, dims=3).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_clusters(rows, 3, 4, 3)
    assert drift_clusters.cluster(vectors(spark, [(1, [3e38, -3e38, 0.0]), (2, [0.0] * 3)], "double"), k=1, dims=3).count() == 2


def test_few_and_no_vectors(spark):
    rows = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [9.0, -1.0])]
    got = drift_clusters.cluster(vectors(spark, rows), dims=2).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_clusters(rows, dims=2)
    assert drift_clusters.cluster(vectors(spark, rows)).collect() == []


def test_bounds_hold_and_save_work():
    """Of every cluster's members, no lower bound passes the true second distance, and few vectors are scanned."""
    rng = np.random.default_rng(2)
    x = np.floor(1024 * (rng.normal(size=(6, 64))[rng.integers(0, 6, 3000)] * 0.5 + rng.normal(size=(3000, 64)) * 0.1)).astype(np.int64)
    centers = x[rng.choice(len(x), 8, replace=False)].tolist()
    step, own, upper, lower, scanned, tighter = drift_clusters.Step(centers), None, None, None, [], 0
    for _ in range(12):
        own, upper, lower, n = step.assign(x, own, upper, lower)
        scanned.append(n)
        true = np.sqrt(step.squared(x).astype(float))
        assert (own == step.squared(x).argmin(axis=1)).all()
        mine = true[np.arange(len(x)), own]
        true[np.arange(len(x)), own] = np.inf
        assert (upper >= mine - 1e-6).all() and (lower <= true.min(axis=1) + 1e-6).all()
        radii = [float(upper[own == j].max(initial=0)) for j in range(8)]
        moved = [(x[own == j].sum(axis=0) // (own == j).sum()).tolist() if (own == j).any() else centers[j] for j in range(8)]
        step = drift_clusters.Step.after(centers, moved, radii)
        drifts = step.raised - drift_clusters.MARGIN
        for i in range(8):
            full = max(drifts[j] for j in range(8) if j != i)
            assert step.loosened[i] <= full + 2 * drift_clusters.MARGIN
            tighter += step.loosened[i] < 0.9 * full
        centers = moved
    assert tighter > 10 and sum(scanned[1:]) < 0.3 * 11 * len(x)


def test_approach_is_never_too_small():
    rng = np.random.default_rng(4)
    for _ in range(200):
        center, before, after = rng.normal(size=(3, 5)) * rng.uniform(1, 50)
        radius = rng.uniform(0, 30)
        points = rng.normal(size=(300, 5))
        points = center + radius * points / np.linalg.norm(points, axis=1, keepdims=True) * rng.uniform(0, 1, (300, 1)) ** 0.2
        nearer = np.linalg.norm(points - before, axis=1) - np.linalg.norm(points - after, axis=1)
        assert nearer.max() <= drift_clusters.approach(center, radius, before, after)


def test_both_libraries_give_the_same_ids(spark):
    rng = random.Random(8)
    own, coder = Tokenizer.from_file(BYTE_BPE), packing.coder(BYTE_BPE)
    assert coder.ranks is not None
    letters = [chr(c) for c in (*range(32, 127), *range(0xA0, 0x250), 9, 10, 13, 0x2019, 0x20AC)] + [" ", "  ", "\n\n", "'s", "'LL", " the", "ing", "<|endoftext|>", "<|end"] * 20
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 300))) for _ in range(400)] + ["a" * 3000, "12 " * 900, "x" + " " * 900 + "y", "﻿ß᠎中文 \x85 \x1c", "ǅ²½ª"]
    texts += [r["text"] or "" for r in read(spark, SF, "documents").collect()]
    used = 0
    for text in texts:
        expected = own.encode(text, add_special_tokens=False).ids
        assert coder.ids(text).tolist() == expected
        used += not packing._UNCOMMON.search(text)
    assert used > 0.5 * len(texts)

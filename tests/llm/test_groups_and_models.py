"""Near-duplicates against brute force; the learned scores on held-out rows and odd inputs; the pipeline."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from quarterlight.llm import bpe, credentials, cross_entropy, decontamination, line_field, line_rules, near_duplicates, toxicity
from quarterlight.llm.common import read
from quarterlight.llm.queries import QUERIES, WORD_BPE

SF = "/root/testdata/sf0.001"


def sets_of(rows, width):
    out = {}
    for i, text in rows:
        words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[i] = frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()
    return out


def plain_groups(rows, width, percent):
    sets = sets_of(rows, width)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: (len(sets[i]), find(i)) for i in sets}


def grouped(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


@pytest.mark.parametrize("block_shingles", [near_duplicates.BLOCK_SHINGLES, 400])
def test_groups(documents, awkward, block_shingles):
    """Chains of edits, copies and odd texts; with small blocks, clusters are cut and meet block by block."""
    rng = random.Random(9)
    texts = list(awkward)
    for _ in range(6):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 90))]
        for _ in range(12):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = f"v{rng.randint(0, 99)}"
    docs = documents(texts)
    for width, similarity in ((3, 0.85), (5, 0.8)):
        got = grouped(near_duplicates.near_duplicates(docs, width, similarity, block_shingles))
        assert got == plain_groups(list(enumerate(texts)), width, round(100 * similarity))


def test_groups_of_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in read(spark, SF, "documents").collect()]
    assert grouped(QUERIES["op3_near_duplicates"](spark, SF)) == plain_groups(rows, 3, 85)


def test_no_documents_no_groups(documents):
    assert near_duplicates.near_duplicates(documents(["x"]).filter("doc_id < 0")).count() == 0
    assert grouped(near_duplicates.near_duplicates(documents([None, "", "a"]))) == {0: (0, 0), 1: (0, 1), 2: (1, 2)}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91)], "a long, b long")
    got = {r["node"]: r["label"] for r in near_duplicates.components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 91: 90}


def test_bayesian_bounds():
    steps = near_duplicates.needed_matches(0.8, 100)
    assert [s[:2] for s in steps] == [(0, 32), (32, 64), (64, 96), (96, 100)]
    rng = np.random.default_rng(1)
    alive = rng.random((20000, 100)) < 0.8
    assert all((alive[:, :stop].sum(axis=1) >= least).all() for _, stop, least in steps)
    assert steps[-1][2] > 50


def plain_area(score, label):
    pairs = [(a > b) + 0.5 * (a == b) for a, x in zip(score, label) if x for b, y in zip(score, label) if not y]
    return sum(pairs) / len(pairs)


@pytest.mark.parametrize("name, column, least", [("op2_line_field", "quality", 0.97), ("op4_subword_toxicity", "toxic", 0.9)])
def test_held_out_area(spark, name, column, least):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES[name](spark, sf)
    assert rows.count() == read(spark, sf, "documents").count()
    held = rows.filter("held_out").join(read(spark, sf, "labels"), "doc_id").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in held)
    assert plain_area([r["score"] for r in held], [r[column] for r in held]) >= least


def test_marginals_against_enumeration():
    rng = np.random.default_rng(3)
    field = line_field.Field(rng.normal(size=4), rng.normal(size=(2, 2)), np.zeros(4), np.ones(4), (0.0, 1.0), 0.5)
    x = rng.normal(size=(5, 4))
    lean, weight = x @ field.weights, {}
    for code in range(32):
        y = [code >> t & 1 for t in range(5)]
        weight[code] = math.exp(sum(lean[t] for t in range(5) if y[t]) + sum(field.moves[a, b] for a, b in zip(y, y[1:])))
    expected = [sum(w for c, w in weight.items() if c >> t & 1) / sum(weight.values()) for t in range(5)]
    assert np.allclose(field.marginals(x), expected)


def test_learned_scores_of_odd_inputs(spark, documents, awkward):
    texts = [*awkward, "some good text, as it should be.\nAnother line, fine."] * 2 + ["bad *** $$$ ### %%%\n" * 3, "fool idiot fool"] * 3
    docs = documents(texts)
    labels = spark.createDataFrame([(i, int(i >= 16)) for i in range(len(texts))] + [(None, 1), (1, None), (999, 0)], "doc_id long, label int")
    for learned, rows in (
        (line_field.learn(docs, labels), lambda m: line_field.score(docs, m)),
        (toxicity.learn(docs, labels), lambda m: toxicity.score(docs, m)),
    ):
        scores = [r["score"] for r in rows(learned).orderBy("doc_id").collect()]
        assert len(scores) == len(texts) and all(0 <= s <= 1 for s in scores)
        assert scores[0] == scores[1] == scores[2] == pytest.approx(learned.prior)
        assert scores[4] == scores[5]
    nobody = labels.filter("doc_id < 0")
    assert line_field.learn(docs, nobody).quality("a text") == pytest.approx(0.5)
    assert toxicity.learn(docs, nobody).score("a text") == pytest.approx(0.5)


def test_misspellings_share_subwords():
    rng = random.Random(1)
    plain = ["".join(rng.choice("aeioulmnrst") for _ in range(6)) for _ in range(300)]
    text = lambda *more: " ".join([*rng.sample(plain, 20), *more])
    texts = [text() for _ in range(150)] + [text(rng.choice(["blockhead", "blockheads", "blockheaded"])) for _ in range(150)]
    order = rng.sample(range(300), 300)
    model = toxicity.fitted([texts[i] for i in order], [int(i >= 150) for i in order], 0.5)
    assert model.score(text("blockheedz")) > 0.5 > model.score(text())


def test_cross_entropy_against_plain_counts(spark, documents, awkward):
    texts = [*awkward, "the cat sat on the mat", "The cat, the dog.", "a dog sat", "xx yy zz xx yy"]
    docs = documents(texts)
    targets = spark.createDataFrame([(7,), (8,), (8,), (None,)], "doc_id long")
    size, classes = 16, 4
    models = cross_entropy.learn(docs, targets, size, classes)
    count = Counter(w for t in texts for w in decontamination.words_of(t))
    known = sorted(count, key=lambda w: (-count[w], w))[: size - classes - 1]
    assert models.words.number == {w: i + 1 for i, w in enumerate(known)}

    def ids(text):
        return [known.index(w) + 1 if w in known else size - classes + cross_entropy.zlib.crc32(w[-3:]) % classes for w in decontamination.words_of(text)]

    def loss(of, text):
        pairs = Counter(p for t in of for p in zip([0, *ids(t)], ids(t)))
        total, before = sum(pairs.values()), Counter()
        single = Counter()
        for (a, b), n in pairs.items():
            before[a] += n
            single[b] += n
        s, own = cross_entropy.STRENGTH, ids(text)
        one = lambda b: (single[b] + 1) / (total + size)
        return sum(-math.log((pairs[a, b] + s * one(b)) / (before[a] + s)) for a, b in zip([0, *own], own)) / max(1, len(own))

    for row, text in zip(cross_entropy.score(docs, models).orderBy("doc_id").collect(), texts):
        assert row["n_tokens"] == len(ids(text))
        assert row["ce_target"] == pytest.approx(loss(texts[7:9], text), rel=1e-4)
        assert row["ce_background"] == pytest.approx(loss(texts, text), rel=1e-4)
        assert row["score"] == pytest.approx(row["ce_target"] - row["ce_background"])


def test_cross_entropy_over_every_word(spark, documents, awkward):
    """More words than any fixed table has, in documents that differ only in words which occur once or twice."""
    rare = [f"w{i}qqq" for i in range(3000)]
    texts = [*awkward, " ".join(rare), "the cat " + " ".join(rare[:40]) + " the cat", "the cat " + " ".join(rare[40:80]), "the cat"]
    docs = documents(texts)
    docs = docs.union(docs.filter("doc_id = 10")).union(docs.filter("doc_id = 10").selectExpr("null", *docs.columns[1:]))
    texts += [texts[10]] * 2
    models = cross_entropy.learn(docs, spark.createDataFrame([(8,), (8,), (None,)], "doc_id long"))
    ids = decontamination.words_of
    size = len({w for t in texts for w in ids(t)}) + 1
    assert size > 3000 and models.size == size

    def loss(of, text):
        pairs = Counter(p for t in of for p in zip([None, *ids(t)], ids(t)))
        total, before, single = sum(pairs.values()), Counter(), Counter()
        for (a, b), n in pairs.items():
            before[a] += n
            single[b] += n
        s, own = cross_entropy.STRENGTH, ids(text)
        one = lambda b: (single[b] + 1) / (total + size)
        return sum(-math.log((pairs[a, b] + s * one(b)) / (before[a] + s)) for a, b in zip([None, *own], own)) / max(1, len(own))

    found = cross_entropy.score(docs, models).collect()
    assert Counter(r["doc_id"] for r in found) == Counter([*range(len(texts) - 2), 10, None])
    for row in found:
        text = texts[10 if row["doc_id"] is None else row["doc_id"]]
        assert row["n_tokens"] == len(ids(text))
        assert row["ce_target"] == pytest.approx(loss([texts[8]], text))
        assert row["ce_background"] == pytest.approx(loss(texts, text))
        assert row["score"] == pytest.approx(row["ce_target"] - row["ce_background"])
    scores = {r["doc_id"]: r["score"] for r in found}
    assert scores[8] < scores[9]


def test_cross_entropy_in_one_shuffle(spark, documents):
    """No join of pairs and no shuffled text: that took more disk than four times the input."""
    chance = random.Random(7)
    # Frequent words and pairs, and many rare ones.
    texts = [" ".join(["the cat", *(f"w{int(chance.paretovariate(0.3)) % 5000}" for _ in range(60))] * (1 + i % 2)) for i in range(200)]
    docs = documents([*texts, "", None, *texts[:3]])
    models = cross_entropy.learn(docs, docs.filter("doc_id % 3 = 0").select("doc_id"))
    assert 0 < len(models.counts.words) < 1024 < models.size and 0 < len(models.counts.pair[0]) < 1024
    found = cross_entropy.score(docs, models)
    assert "SortMergeJoin" not in found._jdf.queryExecution().toString()
    every = {r["doc_id"]: tuple(r) for r in found.collect()}
    loss = {(r["before"], r["word"]): (r["target_loss"], r["background_loss"]) for r in models.losses().collect()}
    for doc_id, n, target, background, score in every.values():
        text = [*texts, "", None, *texts[:3]][doc_id]
        before, word = cross_entropy.Hashes().pairs(text)
        own = [loss[p] for p in zip(before.tolist(), word.tolist())]
        assert n == len(own) and score == pytest.approx(target - background)
        assert (target, background) == pytest.approx(tuple(sum(c) / len(own) for c in zip(*own)) if own else (0, 0))
    # Some of the documents that were counted, and one that was not.
    some = {r["doc_id"]: tuple(r) for r in cross_entropy.score(docs.filter("doc_id > 150"), models).collect()}
    assert len(some) == 54 and all(row == pytest.approx(every[i]) for i, row in some.items())
    with pytest.raises(Exception, match="not in the background"):
        cross_entropy.score(documents(["w1 unseen the"]), models).collect()


def test_cross_entropy_of_no_documents(spark, documents):
    none = documents(["x"]).filter("doc_id < 0")
    assert cross_entropy.score(none, cross_entropy.learn(none, none)).count() == 0


def test_cross_entropy_without_rows(spark, documents):
    none = documents(["x"]).filter("doc_id < 0")
    models = cross_entropy.learn(none, none, 16, 4)
    assert cross_entropy.score(none, models).count() == 0
    assert models.score("a b")[1:] == pytest.approx((math.log(16), math.log(16), 0.0))


def test_pipeline_against_plain_stages(spark):
    """Each stage's decisions, by the plain versions, on all that the stage before kept."""
    docs = {r["doc_id"]: r["text"] for r in read(spark, SF, "documents").collect()}
    frame = read(spark, SF, "documents")
    columns = frame.columns
    judged = {r["doc_id"]: r for r in line_rules.judge(frame).collect()}
    docs = {i: judged[i]["clean_text"] for i in docs if judged[i]["kept"]}
    groups = plain_groups(list(docs.items()), 5, 80)
    docs = {i: t for i, t in docs.items() if groups[i][1] == i}
    automaton = decontamination.Automaton([(str(r["item_id"]), r["text"]) for r in read(spark, SF, "benchmark").collect()])
    docs = {i: n for i, t in docs.items() if (n := decontamination.cut(t, automaton, 1, 0.5)) is not None}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    docs = {r["doc_id"]: r["text"] for r in credentials.masked(frame).collect()}
    transducer = bpe.transducer(WORD_BPE)
    expected = {i: sum(len(p) for p in transducer.encode(t)) // 4 for i, t in docs.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, SF).collect()} == expected
    stage = read(spark, SF, "documents")
    for _, function in corpus_pipeline.STAGES[:-1]:
        assert function(spark, stage, SF).columns == columns


def test_pipeline_stages_on_odd_rows(spark, documents, awkward):
    docs = documents(awkward)
    for _, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs.withColumn("n_chars", docs.doc_id), SF)
        assert "lang" in out.columns and out.count() <= len(awkward)
        assert function(spark, docs.withColumn("n_chars", docs.doc_id).filter("doc_id < 0"), SF).count() == 0


def test_rows_without_or_with_repeated_ids(spark):
    secret = "a password=hunter2hunter2 in a text that goes on for a while, with more than twenty words of no meaning at all, one after the other."
    rows = [(None, secret), (None, "x " + secret), (1, secret), (1, "other words"), (2, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = sorted(r["text"] or "" for r in credentials.masked(docs).collect())
    assert texts == sorted((t or "").replace("password=hunter2hunter2", "[secret]") for _, t in rows)
    assert credentials.report(credentials.scan(docs)).count() == line_rules.judge(docs).count() == bpe.digests(docs, WORD_BPE).count() == 6
    groups = near_duplicates.near_duplicates(docs).collect()
    assert len(groups) == 6 and not any(r["kept"] for r in groups if r["doc_id"] is None)
    assert near_duplicates.deduplicated(docs).filter("doc_id = 2").count() == 1
    field = line_field.learn(docs, docs.selectExpr("doc_id", "1 as label"))
    assert line_field.score(docs, field).count() == 6
    items = spark.createDataFrame([(None, "text that goes on for a while with more than twenty words")], "item_id long, text string")
    assert decontamination.report(decontamination.find(docs, items)).filter("contaminated").count() == 3
    assert decontamination.remove(docs, items).count() == 6


def test_one_row_of_each_group_stays(spark):
    text = "a text that goes on for a while, with more than twenty words of no meaning at all, one after the other, until it ends"
    rows = [
        (None, "clean and unique, without any id"), (None, None), (None, ""), (3, ""),
        (7, text), (7, text), (None, text), (9, text + " soon"), (7, "another text under the same id"),
        (None, "copies, all of them without an id"), (None, "copies, all of them without an id"),
    ]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, place long").repartition(3, "place")
    out = near_duplicates.deduplicated(docs)
    assert out.columns == docs.columns
    left = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert left == Counter({rows[k]: 1 for k in (0, 1, 2, 3, 4, 8, 9)})


def test_few_links_for_many_near_copies(spark):
    """Members of a large group keep about one link each, and the components are those of all their ties."""
    rng, signer = random.Random(6), near_duplicates.Signer(0.8)
    words, rows = [f"w{i}" for i in range(300)], []
    for i in range(600):
        own = list(words)
        for _ in range(6):
            own[rng.randrange(300)] = f"v{rng.randint(0, 9)}"
        rows.append((i, signer.sign(near_duplicates.shingles(" ".join(own), 5))[1]))
    low = {}
    for i, bands in reversed(rows):
        low |= {(k, key): i for k, key in enumerate(bands)}
    tied = [(i, low[k, key]) for i, bands in rows for k, key in enumerate(bands) if low[k, key] != i]
    tied += [(900, 901), (900, 902), (903, 902)]
    links = near_duplicates.ties(spark.createDataFrame(tied, "rep long, low long"))
    assert links.count() < 0.4 * len(set(tied))
    parent = {x: x for pair in tied for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in tied:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert {r["node"]: r["label"] for r in near_duplicates.components(links).collect()} == {x: find(x) for x in parent}

"""BPE encoding and decoding against the tokenizers library."""

import hashlib
import json
import random
from array import array

import pytest

from quarterlight.llm import bpe
from quarterlight.llm.common import read
from quarterlight.llm.queries import WORD_BPE

tokenizers = pytest.importorskip("tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(WORD_BPE)


@pytest.fixture(scope="module")
def ours():
    return bpe.transducer(WORD_BPE)


def ids(transducer, text):
    return list(array("I", b"".join(transducer.encode(text))))


def test_odd_texts(library, ours):
    texts = [
        "", " \n", "Hello WORLD's 'S don'T", "a<|endoftext|>b <|startoftext|><|END|>", "İstanbul ΣΑΣ ﬁ é \x1c a\x85b c d '",
        "x" * 5000, "the" * 3000, "*" * 3000, "é" * 3000, "ha" * 4000 + "!" * 700, "12 345 ²Ⅷ", "日本語テキスト", "🙂🙃" * 300,
    ]
    for text in texts:
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids(ours, text) == expected, text[:40]
        pieces = [array("I", expected[i : i + 3]).tobytes() for i in range(0, len(expected), 3)]
        assert "".join(ours.decode(pieces)) == library.decode(expected, skip_special_tokens=False)


def test_random_long_words(library, ours):
    rng = random.Random(2)
    for _ in range(120):
        letters = "abcdefghijklmnopqrstuvwxyz"[: rng.choice([2, 4, 26])] + rng.choice(["", "é", "!?*", "'s"])
        text = "".join(rng.choice(letters) for _ in range(rng.choice([10, 100, 700, 2000])))
        assert ids(ours, text) == library.encode(text, add_special_tokens=False).ids


def test_blocks_do_not_change_the_result(ours):
    rng = random.Random(4)
    for _ in range(60):
        word = "".join(rng.choice("aeinorst") for _ in range(1500)).encode()
        whole = [ours.inside[b] for b in word]
        whole[-1] = ours.last[word[-1]]
        assert [i for part in ours.word(word) for i in part] == ours.merged_by_heap(whole)


def test_lookahead_of_small_merge_lists():
    assert bpe.sufficient_lookahead([]) == 1
    # b c first takes b away from a b, so "a" needs to see two symbols.
    assert bpe.sufficient_lookahead([("b", "c"), ("a", "b")]) == 3
    # c d decides whether b c stands, which decides a b, and so on.
    assert bpe.sufficient_lookahead([("c", "d"), ("b", "c"), ("a", "b")]) == 4


def test_running_text_decoding(ours):
    text = "hello wörld"
    assert "".join(ours.decode(ours.encode(text), ours.plain_bytes(), b"")) == text + " "
    cut = [array("I", [i]).tobytes() for i in ids(ours, "é🙂" * 3)]
    assert "".join(ours.decode(cut, ours.plain_bytes(), b"")).replace(" ", "") == "é🙂" * 3


def test_digests_and_tables(spark, documents, awkward, library):
    docs = documents(awkward).union(documents(awkward[:1]))
    for row, text in zip(sorted(bpe.digests(docs, WORD_BPE).collect(), key=lambda r: r[0]), [None, *awkward]):
        expected = library.encode(text or "", add_special_tokens=False).ids
        assert row["n_tokens"] == len(expected)
        assert row["ids_sha256"] == hashlib.sha256(array("I", expected).tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(expected, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(documents(awkward), WORD_BPE), WORD_BPE)
    assert {r["doc_id"]: " ".join(r["text"].split()) for r in back.collect()} == {i: " ".join((t or "").split()) for i, t in enumerate(awkward)}
    assert bpe.digests(docs.filter("doc_id < 0"), WORD_BPE).count() == 0


def test_whole_table(spark, library):
    docs = read(spark, SF, "documents")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(docs, WORD_BPE).collect()}
    for row in docs.collect():
        assert got[row["doc_id"]] == library.encode(row["text"] or "", add_special_tokens=False).ids


def test_token_longer_than_a_block(tmp_path):
    """Merges that grow by one letter need little lookahead, yet one token fills many blocks."""
    letters, merges = bpe.byte_letters(), []
    for k in range(1, 26):
        merges.append(("abcdefghijklmnopqrstuvwxyz"[:k], "abcdefghijklmnopqrstuvwxyz"[k]))
    names = [*letters, *(a + b for a, b in merges)]
    vocab = {n: i for i, n in enumerate(names)}
    path = tmp_path / "letters.json"
    path.write_text(json.dumps({"added_tokens": [], "model": {"type": "BPE", "vocab": vocab, "merges": [f"{a} {b}" for a, b in merges]}}))
    t = bpe.Transducer(str(path))
    assert (t.lookahead, t.block) == (2, 8)
    word = "abcdefghijklmnopqrstuvwxyz" * 40 + "abcx" + "a" * 200
    expected = t.merged_by_heap([t.inside[b] for b in word.encode()])
    assert ids(t, word) == expected and expected[:40] == [vocab["abcdefghijklmnopqrstuvwxyz"]] * 40

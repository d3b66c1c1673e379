"""Personal data, benchmark overlap and page text against plain versions."""

import hashlib
import random
import re

import pytest

from quarterlight.llm import decontamination, main_text, personal_data
from quarterlight.llm.common import read

SF = "/root/testdata/sf0.001"


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in doubled) % 10 == 0


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[ -]", "", m)) <= 19 and luhn(re.sub("[ -]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def plain_spans(text):
    return {k: [m.span() for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in PLAIN.items()}


def test_spans_on_random_texts():
    rng = random.Random(3)
    pieces = ["4041894974608795", "404-1894 9746-08795", "1.2.3.4", "300.1.1.1", "+1 (988) 555-2485", "a.b@c.de", "@", " ", "-", "+", ".", "é", "7"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))
        got = personal_data.spans(text)
        assert {k: got[k] for k in PLAIN} == plain_spans(text), text


def test_added_spans():
    text = "IBAN DE89 3704 0044 0532 0130 00, at 12 Main Street, Springfield, IL 62704, ftp://bob:pw1@h.example/x, account no. 12345678"
    got = personal_data.spans(text)
    assert [text[a:b] for k in ("iban", "address", "account") for a, b in got[k]] == [
        "DE89 3704 0044 0532 0130 00", "12 Main Street, Springfield, IL 62704", "12345678",
    ]
    assert len(got["login"]) == 1
    assert not any(personal_data.spans("IBAN DE88 3704 0044 0532 0130 00 in the Street, account of things").values())


def test_scan_and_masking(spark, documents, awkward):
    texts = [*awkward, "write to a.b@c.de or +1 (988) 555-2485", "5" * 5000 + "." + "0" * 5000 + ".1.1"]
    rows = personal_data.scan(documents(texts)).orderBy("doc_id").collect()
    for text, row in zip(texts, rows):
        listed = ",".join(f"{k}:{a}:{b}" for k, spans in plain_spans(text or "").items() for a, b in spans)
        assert row["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
    masked = personal_data.masked(documents(texts)).orderBy("doc_id").collect()
    assert [r["text"] for r in masked[:7]] == awkward
    assert masked[7]["text"] == "write to [email] or [phone]" and masked[7]["kept"] == "x"
    assert personal_data.scan(documents(texts).filter("doc_id < 0")).count() == 0


def plain_hits(words, items, window):
    hit, met = set(), set()
    for item, text in items:
        own = decontamination.words_of(text)
        n = min(window, len(own))
        grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in grams:
                hit.update(range(i, i + n))
                met.add(item)
    return hit, met


def test_automaton_on_random_words():
    rng = random.Random(5)
    for _ in range(1500):
        items = [(str(k), " ".join(rng.choice("abd"[: rng.choice([1, 2, 3])]) for _ in range(rng.randint(0, 14)))) for k in range(rng.randint(0, 4))]
        window = rng.choice([2, 3, 5, 10])
        automaton = decontamination.Automaton(items, window)
        words = [rng.choice([b"a", b"b", b"d", b"x"]) for _ in range(rng.randint(0, 40))]
        runs, met = automaton.hits(words)
        assert ({k for a, b in runs for k in range(a, b)}, met) == plain_hits(words, items, window)


def benchmark(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "short item"), (3, None), (4, ""), (5, "short item")]
    return spark.createDataFrame(items, "item_id long, text string")


def test_overlap_and_removal(spark, documents, awkward, monkeypatch):
    passage = "One, two THREE four five six seven eight nine ten"
    clean = "Nothing of it here, " * 8
    texts = [*awkward, clean + passage + "\n" + clean, clean + "a Short; item!", passage, clean]
    items = benchmark(spark)
    expected = None
    for block_words in (1000, 5):  # one block, and a block for each item
        monkeypatch.setattr(decontamination.blocks, "__defaults__", (block_words,))
        rows = decontamination.report(decontamination.find(documents(texts), items)).orderBy("doc_id").collect()
        for text, row in zip(texts, rows):
            words = decontamination.words_of(text)
            hit, met = plain_hits(words, [(str(i), t) for i, t in items.collect()], 10)
            assert (row["n_words"], row["n_hit"], row["n_items"]) == (len(words), len(hit), len(met))
            assert row["items_sha256"] == hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()
        assert expected in (None, rows)
        expected = rows
        left = {r["doc_id"]: r["text"] for r in decontamination.remove(documents(texts), items).collect()}
        assert [left[i] for i in range(7)] == awkward
        assert left[7] == clean + "\n" + clean and left[8] == clean + "a !" and 9 not in left and left[10] == clean


def test_blocks_make_no_difference_to_removal(spark, documents, awkward, monkeypatch):
    """Documents hit by the items of two blocks: mostly benchmark together, unequally covered, and parts that meet after a cut of another block."""
    one, two = (" ".join(f"{k}{i}" for i in range(12)) for k in "ab")
    items = spark.createDataFrame([(1, one), (2, two), (3, "p q r s t u"), (4, None)], "item_id long, text string")
    other = lambda n: " ".join(f"z{i}" for i in range(n))
    texts = [
        *awkward,
        f"{one} {other(16)} {two}",  # 30 % and 30 %
        f"{one} {other(100)} {two}",
        f"p q r {two} s t u {other(60)}",  # the first block's item appears when the second's is out
        f"{one[:20]} p q r s t u {one[20:]} {other(60)}",
        other(30),
    ]
    results = []
    for block_words in (1000, 3):
        monkeypatch.setattr(decontamination.blocks, "__defaults__", (block_words,))
        docs = documents(texts, n_chars=-1)
        rows = decontamination.remove(docs, items).orderBy("doc_id").collect()
        assert rows[0].asDict().keys() == set(docs.columns)
        results.append(rows)
    assert results[0] == results[1]
    left = {r["doc_id"]: r["text"] for r in results[1]}
    assert 7 not in left and len(left) == len(texts) - 1
    assert left[8].split() == other(100).split() and left[9].split() == other(60).split() and left[11] == other(30)
    assert all(r["n_chars"] == (-1 if r["text"] is None else len(r["text"])) for r in results[1])


def test_no_items(spark, documents):
    none = benchmark(spark).filter("item_id < 0")
    assert [r["n_hit"] for r in decontamination.report(decontamination.find(documents(["a b", None]), none)).collect()] == [0, 0]


def test_cut_again_when_parts_meet():
    automaton = decontamination.Automaton([("1", "a b c d")], 4)
    assert decontamination.cut("a b a b c d c d " + "z " * 9, automaton, 1, 0.9).split() == ["z"] * 9


PAGE = """<html><head><title>T</title><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="cookie-notice">We use cookies, and more cookies.</div>{open}<h1>Title &amp; more</h1><p>First <b>bold</b>
 line, with a   gap.<p>Second one&nbsp;here.<br></p><ul><li>point</li></ul><form><p>Your name, please.</p></form>{close}
<div class="comments"><p>A reader says, this is long, and has marks. Really, it does.</p></div><aside>Side.</aside><footer>&copy; me</footer>"""
TEXT = "Title & more\nFirst bold line, with a gap.\nSecond one here.\npoint"


@pytest.mark.parametrize("tags", [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-body">', "</div>"), ("<div>", "</div>")])
def test_page_text(tags):
    assert main_text.main_text(PAGE.format(open=tags[0], close=tags[1])) == TEXT


@pytest.mark.parametrize("page", [None, "", "<p", "<!-- x", "<script>x", "<nav>menu</nav>", "</p></p>", "<table><tr><td>"])
def test_pages_without_text(page):
    assert main_text.main_text(page) == ""


LONG = "This is the article, and it goes on for a while; it has commas, clauses and full stops. So does this sentence, which ends here."


def test_ratios_decide_and_not_names():
    """Teasers named as posts, and an article without a name: what is long and punctuated is the text."""
    teasers = "".join(f'<div class="post"><p>Teaser {i}</p></div>' for i in range(4))
    article = "".join(f"<p>{i} {LONG}</p>" for i in range(6))
    page = f'<html><body><div class="left">{teasers}</div><div class="x"><h1>Title</h1>{article}<ul><li>point</li></ul></div></body></html>'
    assert main_text.main_text(page) == "\n".join(["Title", *[f"{i} {LONG}" for i in range(6)], "point"])
    # In a named wrapper that holds both, too.
    inner = f'<main><div class="left">{"<p>Go</p>" * 12}</div><div class="x"><h1>Title</h1>{article}</div></main>'
    assert "Go\nGo" not in main_text.main_text(inner) and main_text.main_text(inner).endswith(f"5 {LONG}")
    # Several named articles.
    two = "".join(f"<article><header><h2>Part {k}</h2></header><div>{article}</div></article>" for k in range(2))
    assert main_text.main_text(two).count("\n") == 13


@pytest.mark.parametrize("tags", [("<article>", "</article>"), ("<div>", "</div>")])
@pytest.mark.parametrize("linked", ["A source, in short.", "A quotation, set as a link, that is long. " * 12])
def test_linked_paragraphs_of_the_article(tags, linked):
    linked = linked.strip()
    paragraphs = [f"{i} {LONG}" for i in range(6)]
    paragraphs[3] = linked
    body = "".join(f"<p>{'<a href=x>' + p + '</a>' if p == linked else p}</p>" for p in paragraphs)
    menu = "<ul>" + '<li><a href="x">More</a></li>' * 12 + "</ul>"
    assert main_text.main_text(f"<body>{tags[0]}{body}{menu}{tags[1]}</body>").split("\n")[:6] == paragraphs
    assert main_text.main_text(f"<body>{tags[0]}{menu}{body}{tags[1]}</body>").count("More") < 4
    alone = f"<article><p><a href=x>{linked}</a></p></article>"
    assert main_text.main_text(alone) == linked


def test_all_pages(spark):
    pages = read(spark, SF, "pages")
    rows = {r["page_id"]: r for r in main_text.extract(pages).collect()}
    assert len(rows) == pages.count()
    for page in pages.collect():
        article = re.search(r"<article>(.*?)</article>", page["html"], re.S)[1]
        blocks = [main_text.html.unescape(re.sub("<[^>]*>", " " if "<br>" in b else "", b)) for b in re.split(r"</?p>|</?h1>", article)]
        assert rows[page["page_id"]]["text"] == "\n".join(" ".join(b.split()) for b in blocks if b.split())


def test_long_page_is_linear():
    page = "<article>" + "<div>" * 3000 + "<p>word, word." * 20000
    assert main_text.main_text(page).count("\n") == 19999


PROSE = "A sentence of some length, with marks; it goes on for a while, and then it ends. "


@pytest.mark.parametrize(
    "page, expected",
    [
        ("<article><p title=don't>First part of it.</p><p>It's more of it.</p><p>Third part.</p></article>", "First part of it.\nIt's more of it.\nThird part."),
        ('<article><p a=\'>\' b="x>y">One.</p><p class="q"r\'s>Two.</p></article>', "One.\nTwo."),
        ("<article><p>Before.</p><svg viewBox='0 0 1 1' /><p>After the picture.</p></article>", "Before.\nAfter the picture."),
        ("<article><p>Before.</p><div><svg><path></div><p>After the picture.</p></article>", "Before.\nAfter the picture."),
        ('<div class="legal content"><article><p>' + PROSE * 3 + "</p></article></div>", (PROSE * 3).strip()),
        ('<div class="search-results entry"><article><p>' + PROSE * 3 + "</p></article></div>", (PROSE * 3).strip()),
        ('<article><p>' + PROSE * 2 + '</p><section id="discussion"><h2>Discussion</h2><p>' + PROSE * 3 + "</p></section></article>", f"{(PROSE * 2).strip()}\nDiscussion\n{(PROSE * 3).strip()}"),
        ('<body><ul><li><a href=x>Home page</a></li><li><a href=y>News of the day</a></li></ul><div class=layout><div class=col><p>' + PROSE * 4 + "</p><p>" + PROSE * 3 + "</p></div><div class=rail><a href=z>More</a></div></div></body>", f"{(PROSE * 4).strip()}\n{(PROSE * 3).strip()}"),
    ],
)
def test_odd_pages(page, expected):
    assert main_text.main_text(page) == expected

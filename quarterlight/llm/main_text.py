"""Main text of a page by tag-path ratios.

A page is read as a sequence of blocks, each with its root-to-leaf tag path (inline markup is no part of it,
links are).  Text length and punctuation are summed by path and divided by the path's blocks, smoothed along the page,
fused, and compared with a threshold; on every page the paths above it are content.  Content paths then grow to
their common container, so that short headings and list entries of the article are kept; a block that is mostly
link stays in it by its own fused score, whatever its length.  Elements that name
themselves as menus, headers, footers, sidebars, notices, adverts, forms or comments never count.  Elements that
name themselves as the article bound the container if they have most of the content that the ratios chose, and weigh then:
links cost their blocks half, and their blocks' scores count twice.

Defined results: a null, empty or text-free page gives an empty text; broken markup is read as far as it goes, an
unclosed tag at the end is dropped; repeated pages are each on their own; only page_id, url and html are read.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from functools import lru_cache

from pyspark.sql import DataFrame

from quarterlight.llm.common import map_rows

SKIPPED = frozenset("script style template noscript svg math iframe object canvas audio video head title select textarea button".split())
FOREIGN, RAW_TEXT = frozenset(("svg", "math")), frozenset(("script", "style", "textarea", "title", "iframe"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strong strike sub sup time tt u var".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: An opening tag of the key closes an open element of the values, unless a barrier stands between.
CLOSES = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
} | {t: {"p"} for t in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
BARRIERS = frozenset("table ul ol dl article section div body html aside main nav footer header form blockquote".split())
BARRIER_FREE = {"tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}}
#: Elements and words of class, id or role that are no article text, and those that are the article.
OUTSIDE_TAGS = frozenset("nav footer aside form dialog menu".split())
OUTSIDE_WORDS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside notice cookie cookies consent banner ad ads advert adverts advertisement"
    " sponsor sponsored promo promotion comment comments reply replies respond discussion related share sharing social breadcrumb breadcrumbs"
    " pagination pager subscribe subscription newsletter signup login popup modal overlay toolbar widget complementary contentinfo search"
    " alert disclaimer legal copyright skip".split()
)
#: Outside words that an article's own parts bear as well; they count only outside of an article element.
AMBIGUOUS_WORDS = frozenset("discussion legal search alert copyright skip overlay toolbar widget header banner".split())
INSIDE_TAGS = frozenset(("article", "main"))
INSIDE_WORDS = frozenset("article articlebody post content maincontent entry story main".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：؟]")

#: A quote opens a value only straight after the equals sign.
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_NAMING = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


@lru_cache(maxsize=256)
def closing_tag(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I)


class Block:
    __slots__ = ("path", "text", "linked", "outside", "inside", "score")

    def __init__(self, path, text, linked, outside, inside):
        self.path, self.text, self.linked, self.outside, self.inside, self.score = path, text, linked, outside, inside, 0.0


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order; ``inside`` numbers the elements around a block that name themselves as the article."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool, tuple[int, ...]]] = []  # tag, label, outside, inside
    pieces: list[str] = []
    in_link, linked, at, n, named_elements = False, 0, 0, len(page), 0

    def flush():
        nonlocal linked
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            top = stack[-1] if stack else ("", "", False, ())
            label = "/".join(s[1] for s in stack)
            out.append(Block(label + "/a" if linked * 2 > len(text) else label, text, min(linked, len(text)), top[2], top[3]))
        linked = 0

    def leave(names: set[str], barriers: frozenset | set) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                # Several may be open, as a paragraph in a cell in a row.
                del stack[k:]
                return leave(names, barriers)
            if stack[k][0] in barriers:
                return

    while at < n:
        open_at = page.find("<", at)
        raw = page[at : open_at if open_at >= 0 else n]
        if raw:
            text = html.unescape(raw)
            pieces.append(text)
            linked += len(text.strip()) if in_link else 0
        if open_at < 0:
            break
        if page.startswith("<!--", open_at):
            end = page.find("-->", open_at + 4)
            at = end + 3 if end >= 0 else n
            continue
        if page.startswith(("<!", "<?"), open_at):
            end = page.find(">", open_at)
            at = end + 1 if end >= 0 else n
            continue
        m = _TAG.match(page, open_at) or _LOOSE_TAG.match(page, open_at)
        if not m:
            if page[open_at + 1 : open_at + 2].isalpha() or page.startswith("</", open_at):
                break  # a tag that never ends
            pieces.append("<")
            at = open_at + 1
            continue
        at = m.end()
        closing, tag, attributes = bool(m[1]), m[2].lower(), m[3]
        if tag in INLINE:
            continue
        if tag == "a":
            in_link = not closing
            continue
        if tag in VOID:
            pieces.append(" ")
            if tag == "hr":
                flush()
            continue
        flush()
        in_link = False
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in SKIPPED and tag != "head":
            if tag in FOREIGN and attributes.rstrip().endswith("/"):
                continue
            end = closing_tag(tag).search(page, at)
            if end:
                at = end.end()
            else:  # raw text runs to the end of the page, other elements to that of their parent
                parent_end = closing_tag(stack[-1][0]).search(page, at) if stack and tag not in RAW_TEXT else None
                at = parent_end.start() if parent_end else n
            continue
        if tag in CLOSES:
            leave(CLOSES[tag], BARRIER_FREE.get(tag, BARRIERS))
        parent = stack[-1] if stack else ("", "", False, ())
        named = [_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", x[0] or x[1] or x[2]).lower()) for x in _NAMING.findall(attributes)] if attributes else []
        words = {w for group in named for w in group}
        page_header = tag == "header" and not parent[3]
        inside = tag in INSIDE_TAGS or bool(words & INSIDE_WORDS)
        in_article = any(s[0] in INSIDE_TAGS and not s[2] for s in stack)
        telling = words & OUTSIDE_WORDS - AMBIGUOUS_WORDS if in_article else words & OUTSIDE_WORDS
        # A name that says both says nothing.
        named_outside = bool(telling) and not (words & INSIDE_WORDS and words & OUTSIDE_WORDS <= AMBIGUOUS_WORDS) and tag not in ("html", "body", "article", "main")
        outside = parent[2] or tag in OUTSIDE_TAGS or page_header or named_outside
        outside = outside or tag in INSIDE_TAGS and bool(words & {"comment", "comments", "reply", "related"})
        label = f"{tag}.{'.'.join(sorted(words))}" if words else tag
        named_elements += inside
        stack.append((tag, label, outside, (*parent[3], named_elements) if inside else parent[3]))
    flush()
    return out


def smoothed(values: list[float], radius: int = 2) -> list[float]:
    """Gaussian smoothing along the page."""
    weights = [math.exp(-((k / radius) ** 2)) for k in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        near = [(weights[k + radius], values[i + k]) for k in range(-radius, radius + 1) if 0 <= i + k < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def content(blocks: list[Block]) -> list[Block]:
    """The blocks of the main text."""
    own = [b for b in blocks if not b.outside]
    if not own:
        return []
    by_path: dict[str, list[Block]] = defaultdict(list)
    for b in own:
        by_path[b.path].append(b)
    ratio = {}
    for path, group in by_path.items():
        n, length = len(group), sum(len(b.text) for b in group)
        marks = sum(len(PUNCTUATION.findall(b.text)) for b in group)
        linked = sum(b.linked / 2 if b.inside else b.linked for b in group)
        ratio[path] = (length / n) * (1 + marks / n) * (1 - linked / max(1, length))
    for b, score in zip(own, smoothed([math.log1p(ratio[b.path]) for b in own])):
        b.score = score
    mean = sum(b.score for b in own) / len(own)
    spread = math.sqrt(sum((b.score - mean) ** 2 for b in own) / len(own))
    best = max(b.score for b in own)
    threshold = min(best, max(mean - spread, best / 2))
    path_score = {p: sum(b.score for b in group) / len(group) for p, group in by_path.items()}
    # Blocks that are mostly link are judged one by one below, unless the article has no others.
    plain = {p: s for p, s in path_score.items() if not p.endswith("/a")} or {p: path_score[p] for p, g in by_path.items() if g[0].inside}
    if not plain:
        return []
    chosen = {p for p, s in plain.items() if s >= threshold} or {max(plain, key=plain.__getitem__)}
    bound = bounds([b for b in own if b.path in chosen])
    if bound:
        own = [b for b in own if not bound.isdisjoint(b.inside)]
        chosen &= {b.path for b in own}
    container = common_container(chosen)

    def stays(b: Block) -> bool:
        if b.path in chosen:
            return True
        near = bool(container) and within(b.path, container)
        if b.path.endswith("/a"):
            return (near or bool(bound)) and b.score * (2 if bound else 1) >= threshold
        return near or bool(bound) and (2 * b.score >= threshold or b.path.rpartition("/")[2].partition(".")[0] in HEADINGS)

    return [b for b in own if stays(b)]


def bounds(chosen: list[Block]) -> set[int]:
    """The elements named as the article that have most of the chosen text, each as deep as all its chosen text lies; none if others have it."""
    size: dict[int, int] = defaultdict(int)
    chains = set()
    for b in chosen:
        chains.add(b.inside)
        for e in b.inside:
            size[e] += len(b.text)
    outer = {c[0] for c in chains if c}
    if 2 * sum(size[e] for e in outer) <= sum(len(b.text) for b in chosen):
        return set()
    return {max(e for c in chains if c and c[0] == o for e in c if size[e] == size[o]) for o in outer}


def common_container(paths: set[str]) -> str:
    """The longest path that all chosen paths go through, without their leaf; empty if that is the whole body."""
    parts = [p.split("/")[:-1] for p in paths]
    shared = []
    for step in zip(*parts):
        if len(set(step)) > 1:
            break
        shared.append(step[0])
    return "/".join(shared) if shared and shared[-1] not in ("html", "body") else ""


def within(path: str, container: str) -> bool:
    return path == container or path.startswith(container + "/")


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in content(blocks_of(page or "")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its length in code points, for every page."""

    def run(rows):
        for page_id, url, page in rows:
            text = main_text(page)
            yield page_id, url, text, len(text)

    return map_rows(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")

"""Main text of web pages by a maximum-scoring subsequence: words score positive, tags negative, and the weights come from
labelled pages."""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions

#: Fixed values of the markup: what holds no text of the page, what starts a new block, what is empty.
RAW = {"script", "style", "noscript", "template", "title", "iframe", "svg", "math", "canvas", "object", "noembed", "xmp"}
TEXT_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dd", "dt", "blockquote", "pre", "figcaption", "summary", "caption", "address"}
BLOCKS = TEXT_BLOCKS | RAW | {
    "article", "aside", "body", "button", "center", "details", "dialog", "div", "dl", "fieldset", "figure", "footer", "form", "head", "header", "hgroup", "hr",
    "html", "main", "menu", "nav", "ol", "section", "select", "table", "tbody", "textarea", "tfoot", "thead", "tr", "ul", "audio", "video",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
MAIN, PAGE = {"article", "main"}, {"#root", "html", "body"}
#: Elements that a start tag of the same group closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr"}, "option": {"option"}}
#: Elements, and words of class, id and role, that the standard and common practice give to page furniture. They
#: are no more than a prior of PRIOR observations, which labelled pages outweigh.
FURNITURE = {"nav", "header", "footer", "aside", "form", "button", "select", "textarea", "dialog", "menu", "fieldset", "head", "audio", "video"}
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "dialog", "disclaimer", "disqus", "footer", "gdpr", "masthead",
    "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promotion", "related",
    "replies", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Words that may stand beside a mark in one name without changing what it says.
BESIDE = {"area", "bar", "block", "bottom", "box", "container", "inner", "left", "list", "main", "outer", "page", "primary", "right", "secondary", "section", "site", "slot", "top", "unit", "wrap", "wrapper"}
PRIOR, LIMIT = (0.05, 6.0), 2.0

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|["'=])*?)(?:>|\Z)"""
    r"""|[^<]+|<""",
    re.S,
)
ATTR = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements nested deeper than this become siblings, as in browsers, which bounds the walk from an element to the root. No
#: text is lost by it.
DEPTH = 512
#: Observations (main text goes on, it doesn't) that tags count for before any page has been seen: within an element that is
#: known to hold main text, elsewhere by name, across the border of such an element, and for a whole piece of furniture.
PRIOR_WITHIN, PRIOR_TAG = (8.0, 0.5), {"a": (1.0, 2.0), "li": (1.0, 1.0), "inline": (6.0, 1.0), "text": (2.0, 1.0), "container": (0.05, 2.0)}
PRIOR_BORDER, PRIOR_CUT = (0.01, 6.0), {"within": (6.0, 4.0), "plain": (0.02, 6.0)}


def features(name: str, attrs: str, inside_main: bool) -> tuple[str, ...]:
    """What an element is known by: the tokens of its class, id and role, and its name if that has a meaning of its own. Names
    of layout on the page's own containers say nothing, nor do paragraphs, lists and the like."""
    if name in PAGE:
        return ()
    if name in MAIN:
        return (name,)
    own = (name,) if name in FURNITURE and not (name == "header" and inside_main) else ()
    return (*(f"{k.lower()}={t.lower()}" for k, v in ATTR.findall(attrs) for t in v.strip("\"'").split()), *own)


def is_mark(feature: str) -> bool:
    """Whether a class, id or role token is made of marks, perhaps beside words of layout, and of nothing else."""
    words = [w.lower() for w in WORDS.findall(feature.partition("=")[2])]
    return any(w in MARKS for w in words) and all(w in MARKS or w in BESIDE for w in words)


class Page:
    """A page as a list of items in order, ("w", element, text, n_words) and ("t", element, tag name), and its elements."""

    def __init__(self, source: str) -> None:
        self.names, self.parents, self.features, self.inside = ["#root"], [0], [()], [False]
        self.items: list[tuple] = []
        self._parse(source)

    def _open(self, name: str, attrs: str, stack: list[int]) -> None:
        if len(stack) > DEPTH:
            stack.pop()
        self.features.append(features(name, attrs, self.inside[stack[-1]]))
        self.inside.append(self.inside[stack[-1]] or name in MAIN)
        self.names.append(name)
        self.parents.append(stack[-1])
        stack.append(len(self.names) - 1)

    def _parse(self, source: str) -> None:
        stack, at, n, seen_main = [0], 0, len(source), False
        names, items = self.names, self.items
        while at < n:
            m = TOKEN.match(source, at)
            at, name = m.end(), m.group("name")
            if name is None:
                text = m.group()
                if text[0] != "<" or text == "<":
                    text = html.unescape(text)
                    items.append(("w", stack[-1], text, len(text.split())))
                continue
            name = name.lower()
            if m.group("end"):
                for k in range(len(stack) - 1, 0, -1):
                    if names[stack[k]] == name:
                        items.append(("t", stack[k], name))
                        del stack[k:]
                        break
                    if name not in BLOCKS and names[stack[k]] in BLOCKS:
                        break
                continue
            if name in MAIN and not seen_main:
                seen_main = True
                while any(names[e] in FURNITURE for e in stack[1:]):  # an unclosed menu doesn't hold the article
                    stack.pop()
            if name in BLOCKS and (name in CLOSES or names[stack[-1]] == "p"):
                closes = CLOSES.get(name, set()) | {"p"}
                for k in range(len(stack) - 1, 0, -1):
                    if names[stack[k]] in closes:
                        del stack[k:]
                        break
                    if names[stack[k]] in BLOCKS:
                        break
            if name in VOID or m.group("attrs").endswith("/") and name not in BLOCKS:
                items.append(("t", stack[-1], name))
                if name == "br":
                    items.append(("w", stack[-1], " ", 0))
                continue
            self._open(name, m.group("attrs"), stack)
            items.append(("t", stack[-1], name))
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                at = end.end() if end else n
                items.append(("t", stack.pop(), name))


class Weights:
    """What labelled pages say: seen, a feature's counts of (elements within the main text, elements without); tags, log-odds
    by key that the main text goes on across a tag; words, what a word weighs by its place."""

    def __init__(self, seen: dict[str, tuple[int, int]] | None = None, tags: dict[str, float] | None = None, words: dict[str, float] | None = None) -> None:
        self.seen, self.tags, self.words = seen or {}, tags or {}, words or {}

    def odds(self, feature: str) -> float:
        """Log-odds that an element of this feature lies in the main text."""
        inside, outside = self.seen.get(feature, (0, 0))
        if feature in MAIN:
            a, b = PRIOR[::-1]
        else:
            a, b = PRIOR if feature in FURNITURE or "=" in feature and is_mark(feature) else (1.0, 1.0)
        return math.log((inside + a) / (outside + b))

    def places(self, page: Page) -> list[str]:
        """Each element's place by its innermost decided ancestor or itself: within, cut (furniture) or plain."""
        known, out = {f: self.odds(f) for f in {f for x in page.features for f in x}}, ["plain"]
        for e in range(1, len(page.names)):
            above = out[page.parents[e]]
            if page.names[e] in PAGE:
                out.append(above)
            elif min((known[f] for f in page.features[e]), default=0) <= -LIMIT:
                out.append("cut")
            elif above != "cut" and max((known[f] for f in page.features[e]), default=0) >= LIMIT:
                out.append("within")
            else:
                out.append(above)
        return out

    def tag(self, key: str) -> float:
        if key in self.tags:
            return self.tags[key]
        return go_on(0, 0, key)

    def word(self, place: str) -> float:
        return self.words.get(place, {"within": 1.0, "plain": 1.0, "beside": 0.15}[place])


def go_on(yes: int, no: int, key: str) -> float:
    """Log-odds, at most -0.02, that the main text goes on across a tag: counts smoothed by the prior of the key."""
    place, _, name = key.partition(":")
    if place == "cut":
        a, b = PRIOR_CUT[name]
    elif place == "border":
        a, b = PRIOR_BORDER
    elif place == "within":
        a, b = PRIOR_WITHIN
    else:
        a, b = PRIOR_TAG.get(name) or PRIOR_TAG["text" if name in TEXT_BLOCKS else "container" if name in BLOCKS else "inline"]
    return min(-0.02, math.log((yes + a) / (yes + no + a + b)))


def sequence(page: Page, places: Sequence[str]) -> list[tuple[str, str, int, int]]:
    """The page as the scan reads it: (kind, key, first item, last item). A word item has the key of its place; a tag that of
    its place and name; a whole piece of furniture is one entry."""
    main = "within" in places
    out, at, items = [], 0, page.items
    while at < len(items):
        e = items[at][1]
        if places[e] == "cut":
            top = e
            while places[page.parents[top]] == "cut":
                top = page.parents[top]
            to, inner = at, {top}
            while to < len(items):
                trail, x = [], items[to][1]
                while x not in inner and x:
                    trail.append(x)
                    x = page.parents[x]
                if x not in inner:
                    break
                inner.update(trail)
                to += 1
            out.append(("cut", f"cut:{'within' if places[page.parents[top]] == 'within' else 'plain'}", at, to - 1))
            at = to
            continue
        place = places[e]
        if items[at][0] == "w":
            out.append(("w", "beside" if main and place == "plain" else place, at, at))
        else:
            name = items[at][2]
            border = place == "within" and places[page.parents[e]] != "within" and page.names[e] == name
            out.append(("t", "border:" if border else f"{place}:{name}", at, at))
        at += 1
    return out


def best_run(scores: Sequence[float]) -> tuple[int, int] | None:
    """(first, last) of the contiguous run with the greatest sum, the earliest and shortest such run; None if no sum is
    positive. One linear scan."""
    best, total, start, found = 0.0, 0.0, 0, None
    for k, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += x
        if total > best:
            best, found = total, (start, k)
    return found


def told_words(page: Page, entries: Sequence[tuple[str, str, int, int]], known: set[tuple[str, ...]]) -> dict[int, list[bool]]:
    """For each word entry, whether its words lie within the known main text: whether one of a word's triples is among those known.
    Inline tags don't cut a word; a word belongs to the entry that it begins in."""
    words: list[str] = []
    at: list[int] = []
    open_word = False
    for k, (kind, _, first, _) in enumerate(entries):
        if kind == "w":
            text = page.items[first][2]
            for n, word in enumerate(text.split()):
                if open_word and not n and not text[0].isspace():
                    words[-1] += word
                else:
                    words.append(word)
                    at.append(k)
            open_word = bool(text) and not text[-1].isspace() and (open_word or bool(text.strip()))
        elif kind == "cut" or page.items[first][2] in BLOCKS:
            open_word = False
    hit = [False] * len(words)
    for i in range(max(0, len(words) - 2)):
        if (words[i], words[i + 1], words[i + 2]) in known:
            hit[i] = hit[i + 1] = hit[i + 2] = True
    share: dict[int, list[bool]] = defaultdict(list)
    for k, h in zip(at, hit, strict=True):
        share[k].append(h)
    return share


def learn(labelled: Iterable[tuple[str, str]]) -> Weights:
    """Weights from (html, known main text) pairs.

    Elements are counted where they are topmost: the largest ones whose words all but wholly lie without, and the
    largest, below the page's own, whose words all but wholly lie within. So what stands in a menu says nothing of lists, nor
    an article of its paragraphs. With the places that follow, tags are counted by whether the main text goes on
    across them, and words by place."""
    pages, seen = [], defaultdict(lambda: [0, 0])
    for source, gold in labelled:
        page, known = Page(source or ""), (gold or "").split()
        known = {tuple(known[i : i + 3]) for i in range(max(1, len(known) - 2))}
        share = told_words(page, [(x[0], "", k, k) for k, x in enumerate(page.items)], known)
        total = [[0, 0] for _ in page.names]
        for k, hits in share.items():
            for h in hits:
                total[page.items[k][1]][h] += 1
        for e in range(len(page.names) - 1, 0, -1):  # children come after their parents
            for h in (0, 1):
                total[page.parents[e]][h] += total[e][h]
        part = [inside / (inside + outside) if inside + outside else None for outside, inside in total]
        for e in range(1, len(page.names)):
            above = page.parents[e]
            if part[e] is None or page.names[e] in PAGE:
                continue
            if part[e] <= 0.1 < part[above]:
                for f in page.features[e]:
                    seen[f][1] += 1
            elif part[e] >= 0.9 and (part[above] < 0.9 or page.names[above] in PAGE):
                for f in page.features[e]:
                    seen[f][0] += 1
        pages.append((page, known))
    weights = Weights({f: (i, o) for f, (i, o) in seen.items()})
    tags, words = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for page, known in pages:
        entries = sequence(page, weights.places(page))
        share = told_words(page, entries, known)
        before, pending = False, []
        for k, (kind, key, _, _) in enumerate(entries):
            if kind != "w":
                pending.append(key)
            elif share.get(k):
                own = share[k]
                words[key][0] += sum(own)
                words[key][1] += len(own) - sum(own)
                for tag in pending:
                    tags[tag][before and own[0]] += 1
                before, pending = own[-1], []
        for tag in pending:
            tags[tag][0] += 1
    weights.tags = {key: go_on(yes, no, key) for key, (no, yes) in tags.items()}
    weights.words = {key: max(0.05, min(3.0, math.log((yes + 2) / (no + 1)))) for key, (yes, no) in words.items()}
    return weights


def main_text(source: str | None, weights: Weights) -> str:
    """The main text of one page: its best-scoring contiguous run of words and tags, out to the ends of the text blocks that
    it begins and ends in. Pieces of furniture between two words of the run are left out; those at its ends are no part of
    it by their score. White space inside a block becomes one space, blocks are joined by one line feed."""
    page = Page(source or "")
    entries = sequence(page, weights.places(page))
    span = best_run([page.items[at][3] * weights.word(key) if kind == "w" else weights.tag(key) for kind, key, at, _ in entries])
    if span is None:
        return ""
    (first, last), run = span, range(span[0], span[1] + 1)
    for step, limit in ((-1, -1), (1, len(entries))):
        k = first if step < 0 else last
        block = page.items[entries[k][2]][1]
        while block and page.names[block] not in TEXT_BLOCKS:
            block = page.parents[block]
        while block and k + step != limit and within(page, page.items[entries[k + step][2]][1], block):
            k += step
        first, last = (k, last) if step < 0 else (first, k)
    told = [k for k in range(first, last + 1) if entries[k][0] == "w" and page.items[entries[k][2]][3]]
    blocks, now = [], []

    def close() -> None:
        if now and (text := " ".join("".join(now).split())):
            blocks.append(text)
        now.clear()

    for k in range(first, last + 1):
        kind, _, at, to = entries[k]
        if kind == "cut" and (k not in run or told and told[0] < k < told[-1]):
            if page.names[page.items[at][1]] in BLOCKS:
                close()
            continue
        for x in page.items[at : to + 1]:
            if x[0] == "w":
                now.append(x[2])
            elif x[2] in BLOCKS:
                close()
            elif x[2] in ("td", "th"):
                now.append(" ")
    close()
    return "\n".join(blocks)


def within(page: Page, element: int, ancestor: int) -> bool:
    while element > ancestor:
        element = page.parents[element]
    return element == ancestor


def extract_main_text(pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole html.

    Null and empty html, and pages without any main text, give the empty text; pages of any length are read whole, with
    attributes of any length; repeated rows stay repeated; an empty table gives an empty result; other columns are ignored.
    The scan is linear in the page, and each page is handled alone, so nothing is shuffled.
    """
    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for whole in batches for p in portions(whole, 2)):
            texts = [main_text(x, weights) for x in batch.column(2).to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")

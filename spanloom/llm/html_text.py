"""Main text of web pages by two passes of rules over blocks.

A page is cut into blocks at block tags. First pass: a block is decided by its share of links, its length and its share of
stop words; short and preformatted blocks stay open. On a page in whose blocks none of the listed stop words are found, which is in
another language, length, sentence ends and links decide alone. Where it stands is one more feature: menus, forms, notices and the like are out; in an
article element short text is in, and text of few stop words or many links stays open; outside of the page's articles only
long running text is in. Articles count for nothing if they are cards, beside which the page has more running text. Second
pass: an open block takes the label of the nearest decided block, the earlier one if two are as near, measured in blocks; in
an article of the blocks of that article, outside of articles of the others. Pages are independent: a map without shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spanloom.llm.common import by_batch

#: Blocks of fewer characters are short; longer ones are decided by stop words.
SHORT, LONG = 70, 200
STOPS_LOW, STOPS_HIGH, LINKS = 0.18, 0.28, 0.4
#: Characters in links, and their share, that make a block of the article a link; it is in only between blocks that are in.
MANY, PURE = 20, 0.9

# Function words of English, German, French and Spanish.
STOP_WORDS = frozenset("""
a an and are as at be by for from has have he her his in is it not of on or she that the their there they this to was were which with you
als auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch oder sich sie sind über um und von vor war wie wir zu zum zur
au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous
al como con de del el ella en entre es esta este ha la las le lo los más me no o para pero por que se ser sin sobre su sus también un una y ya
""".split())
#: Elements that never hold main text; their content is skipped as a whole.
RAW = "script|style|noscript|template|textarea|svg|iframe|select|object|canvas|math|title"
OUT = frozenset("head nav footer aside form menu dialog button fieldset".split())
#: Of these, elements that may also wrap a whole page.
WRAPS = frozenset("form dialog fieldset header".split())
ARTICLE = frozenset("article main".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4
h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul button""".split())
#: Words in class, id or role that mark what is not the article.
MARKS = frozenset("""ad ads adv advert advertisement advertising banner banners breadcrumb breadcrumbs comment comments commentlist complementary consent
contentinfo cookie cookies disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup
promo promotion related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget""".split())
#: Marks that are not structural: their elements may hold main text. Advertisements are named by the whole name only.
LOOSE = frozenset("banner banners disclaimer newsletter notice notices promo promotion related search share sharing social sponsor sponsored subscribe widget".split())
ADS = frozenset("ad ads adv advert advertisement advertising".split())
#: Words that turn a compound name into a state (has-sidebar, ad-free), or into the name of a layout (sidebar-layout).
STATES = frozenset("closed disabled enabled free has hidden hide is less no non not open show with without".split())
LAYOUTS = frozenset("content layout main page site wrap".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {"p": BLOCKS, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}),
             "head": frozenset({"body"})}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)>", re.S | re.I)
NAMED = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
WORD = re.compile(r"[^\W\d_]+")
#: Kana, ideographs and Hangul; ends of sentences.
SYLLABLES = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\U00020000-\U0003ffff]")
SENTENCE = re.compile("[.!?\u2026\u3002\uff01\uff1f\u0964\u061f\u06d4\u0589\u1362]")


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    place: str  # "out", "article", "main" (around an article) or ""
    heading: bool
    article: int = -1  # the article it stands in
    code: bool = False  # preformatted, so no running text to look for


@dataclass
class Element:
    name: str
    parent: int  # place in the list of elements, parents first; -1 for none
    mark: int
    chars: int = 0  # outside links
    dense: bool = False  # holds a long block of running text
    holds: bool = False  # holds article or main elements
    whole: bool = False  # holds a main element, or the article of most text
    around: bool = False  # a main element, most of whose text is in one article


def _mark(name: str) -> int:
    """What a name says: 0 nothing, 1 perhaps not main text, 2 and 3 (the whole name) a part of the page beside it."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    marks = {w for i, w in enumerate(words) if w in MARKS and not (w == "widget" and i)}
    if not marks or len(words) > 1 and not STATES.isdisjoint(words):
        return 0
    if len(words) == 1:
        return 1 if marks <= LOOSE else 3
    return 1 if marks <= LOOSE | ADS or not LAYOUTS.isdisjoint(words) else 2


def _marked(attributes: str) -> int:
    return max((_mark(w) for m in NAMED.finditer(attributes) for w in m[1].strip("\"'").lower().split()), default=0)


def _stops(text: str) -> float:
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def blocks(html: str, trust: int = 0) -> list[Block]:
    """Blocks with text, in page order; character references decoded, white space made one space."""
    found, elements = _parse(html)
    return _placed(found, elements, trust)


def _parse(html: str) -> tuple[list[tuple[Block, int]], list[Element]]:
    """Blocks, each with the element it stands in, and all block elements."""
    out: list[tuple[Block, int]] = []
    elements: list[Element] = []
    stack: list[tuple[str, int]] = []  # open element, its place in the list
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked: list[str] = []
    in_link, at = False, 0

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                links = len(" ".join(unescape("".join(linked)).split()))
                out.append((Block(text, links, "", bool(stack) and stack[-1][0] in HEADINGS, code=opened["pre"] > 0), stack[-1][1] if stack else -1))
            parts.clear()
            linked.clear()

    def add(text: str) -> None:
        parts.append(text)
        if in_link:
            linked.append(text)

    def close(k: int) -> None:
        opened.subtract(name for name, _ in stack[k:])
        del stack[k:]

    for m in TOKEN.finditer(html):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        if name == "a":
            in_link = not (m[2] or m[5])
            continue
        if name == "br":
            add(" ")
        if name not in BLOCKS:
            continue
        flush()
        in_link = False
        if m[2] or m[5]:
            if opened[name]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            continue
        while stack and name in CLOSED_BY.get(stack[-1][0], ()):
            close(len(stack) - 1)
        if name in VOID:
            continue
        elements.append(Element(name, stack[-1][1] if stack else -1, 0 if name in ("html", "body") else _marked(m[4] or m[7] or "")))
        stack.append((name, len(elements) - 1))
        opened[name] += 1
    if at < len(html):
        add(html[at:])
    flush()
    for b, k in out:
        if k >= 0:
            elements[k].chars += len(b.text) - b.links
            elements[k].dense |= len(b.text) >= LONG and b.links <= LINKS * len(b.text) and _stops(b.text) >= STOPS_HIGH
    for e in reversed(elements):  # children before their parents
        if e.parent >= 0:
            up = elements[e.parent]
            up.chars += e.chars
            up.holds |= e.holds or e.name in ARTICLE
            up.dense |= e.dense and e.mark < 2 and (e.name not in OUT or e.name in WRAPS)
    largest = max((e for e in elements if e.name == "article" and e.mark < 2), key=lambda e: e.chars, default=None)
    for e in reversed(elements):
        e.whole |= e.name == "main" or e is largest
        if e.whole and e.parent >= 0:
            elements[e.parent].whole = True
    up = largest.parent if largest else -1
    while up >= 0:
        elements[up].around = elements[up].name == "main" and 2 * largest.chars > elements[up].chars
        up = elements[up].parent
    return out, elements


def _placed(found: list[tuple[Block, int]], elements: list[Element], trust: int) -> list[Block]:
    """Blocks with their places. Of marks count all (``trust`` 0), those that are whole names (1), or none (2).

    No mark counts on article and main, nor on what holds a main element or the largest article; a mark that is not structural
    counts neither around any article, nor around a long block of running text. Elements of ``WRAPS`` are out on the same terms.
    """
    places: list[str] = []
    articles: list[int] = []
    for k, e in enumerate(elements):
        place = places[e.parent] if e.parent >= 0 else ""
        article = articles[e.parent] if e.parent >= 0 else -1
        if place != "out":
            if e.name in ARTICLE:
                place = "main" if e.around and place != "article" else "article"
                article = k if place == "article" else article
            elif e.name in OUT - WRAPS or not e.whole and (
                    trust < 2 and (e.name in WRAPS and (e.name != "header" or place != "article") or e.mark == 3) or trust == 0 and (e.mark == 2 or e.mark == 1 and not e.holds and not e.dense)):
                place = "out"
        places.append(place)
        articles.append(article)
    return [Block(b.text, b.links, places[k] if k >= 0 else "", b.heading, articles[k] if k >= 0 else -1, b.code) for b, k in found]


def _extent(text: str) -> int:
    """Characters, ideographs and syllables that stand for a word or half of one counted thrice."""
    return len(text) + 2 * len(SYLLABLES.findall(text))


def plain_pass(block: Block, stops: float, foreign: bool = False) -> bool | None:
    """In, out or open, by the text alone. On a ``foreign`` page, in whose blocks no stop words are found, by length and links."""
    if block.links > LINKS * len(block.text):
        return False
    if len(block.text) < SHORT and not foreign or block.code:
        return None
    if foreign:
        return True if _extent(block.text) >= LONG and SENTENCE.search(block.text) else None
    if stops >= STOPS_HIGH or stops >= STOPS_LOW and len(block.text) >= LONG:
        return True
    return None if stops >= STOPS_LOW else False


def first_pass(found: list[Block]) -> tuple[list[bool | None], bool]:
    """Of each block in, out or open, and whether the articles of the page hold its main text."""
    stops = [_stops(b.text) for b in found]
    foreign = not any(b.place != "out" and b.links <= LINKS * len(b.text) and len(b.text) >= SHORT and s >= STOPS_LOW for b, s in zip(found, stops))
    plain = [False if b.place == "out" else plain_pass(b, s, foreign) for b, s in zip(found, stops)]
    chars: Counter[int] = Counter()  # of each article outside links
    running: Counter[int] = Counter()  # its stop words, by characters
    beside = 0
    for b, s, good in zip(found, stops, plain):
        if b.place == "article":
            chars[b.article] += len(b.text) - b.links
            running[b.article] += s * (len(b.text) - b.links)
        elif good:
            beside += len(b.text)
    trusted = bool(chars) and sum(chars.values()) >= beside
    labels: list[bool | None] = []
    for b, s, good in zip(found, stops, plain):
        if b.place == "article" and (trusted or chars[b.article] >= LONG):
            known = running[b.article] >= STOPS_LOW * chars[b.article]  # its language has these stop words
            labels.append(None if b.links > LINKS * len(b.text) or known and good is False else True)
        elif b.place in ("article", "out", "main") or not trusted:
            if b.place == "article":
                b.place, b.article = "", -1
            labels.append(good)
        else:
            labels.append(None if good and len(b.text) < LONG else good)
    return labels, trusted


def _nearest(labels: list[bool | None], seq: range, of: list[int]) -> list[tuple[int, bool]]:
    """Distance and label of the nearest decided block of the same group, seen backwards along ``seq``; far if there is none."""
    n = len(labels)
    out, last = [(n + 1, False)] * n, {}
    for i in seq:
        if labels[i] is not None:
            last[of[i]] = i
        if of[i] in last:
            out[i] = (abs(i - last[of[i]]), labels[last[of[i]]])
    return out


def second_pass(found: list[Block], labels: list[bool | None], trusted: bool) -> list[bool]:
    """Open blocks take the label of the nearest decided one of their group, headings that of the next one.

    Groups are the articles and what is outside of them; around an article, and on pages whose main text is not in articles,
    the whole page. Without a decided block an article is in, and the rest of a page with articles out.
    """
    n, far = len(labels), len(labels) + 1
    whole = [b.place == "main" or b.article < 0 and not trusted for b in found]
    near = []
    for of in ([b.article for b in found], [-2] * n):
        near.append([_nearest(labels, seq, of) for seq in (range(n), range(n - 1, -1, -1))])
    out = []
    for i, (block, label) in enumerate(zip(found, labels)):
        b, a = (x[i] for x in near[whole[i]])
        if label is not None:
            out.append(label)
        elif block.article >= 0 and block.links >= max(MANY, PURE * len(block.text)):
            out.append(b[1] and a[1])
        elif b[0] == a[0] == far:
            out.append(block.article >= 0 or whole[i])
        else:
            out.append((a if b[0] > a[0] or block.heading and a[0] < far else b)[1])
    return out


def main_text(html: str | None) -> str:
    """Blocks of the main text, joined by an empty line; empty for null, for no text, and for no main text.

    If marks leave nothing, they are taken back, compound names first, where the first pass then finds main text.
    """
    parsed, elements = _parse(html or "")
    for trust in (0, 1, 2):
        found = _placed(parsed, elements, trust)
        first, trusted = first_pass(found)
        if trust and True not in first:
            continue
        labels = second_pass(found, first, trusted)
        if any(labels):
            return "\n\n".join(b.text for b, good in zip(found, labels) if good)
    return ""


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: id, url, ``text``, ``n_chars``.

    A null page is empty; a null url stays null. Repeated rows are extracted alike. Other columns are not read.
    """
    kinds = [pages.schema[c].dataType for c in (page_id, url)]
    schema = pa.schema([("id", to_arrow_type(kinds[0])), ("url", to_arrow_type(kinds[1])), ("text", pa.string())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(h.as_py()) for h in b.column(2)], pa.string())], schema=schema)

    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    out = rows.mapInArrow(by_batch(run), f"id {kinds[0].simpleString()}, url {kinds[1].simpleString()}, text string")
    return out.select(F.col("id").alias(page_id), F.col("url").alias(url), "text", F.length("text").cast("bigint").alias("n_chars"))

"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass weighs each block's density of stop words, its length, its
share of linked text and what its containers say about themselves, none of which decides alone; the second gives
ambiguous and short blocks the label of their nearest decided neighbour.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of the languages served.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be because been but by can could do for from had has have he her his how i if in into is it its
    just like more no not of on one only or other our out she so some than that the their them then there these they this to up was we were what
    when which who will with would you your
    au aux avec ce ces dans de des du elle en est et eux il je la le les leur lui mais me même mes moi mon ne nos notre nous on ou où par pas pour
    qu que qui sa se ses son sur ta te tu un une vos votre vous
    aber als am an auch auf aus bei bin bis das dass dem den der des die du durch ein eine einem einen einer er es für hat ich ihr im in ist kein
    man mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur
    al algo como con cuando de del donde el ella ellas ellos en entre era es esa ese eso esta este esto ha hay la las le lo los más me mi muy no
    nos o para pero por porque que quien se sin sobre su sus también te tiene todo un una uno y ya yo
    """.split()
)

# Elements whose text is never shown or never prose.
HIDDEN = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "select", "textarea", "button", "option", "title", "head"}
RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
# Elements that hold everything around the article.
AROUND = {"nav", "footer", "aside", "form", "menu", "dialog", "header"}
ARTICLE = {"article", "main"}
# Elements that don't interrupt a block.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

_ROLE_WORDS = (
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-ads comment comments commentlist cookie cookies consent "
    "disqus footer gdpr menu modal nav navbar navigation newsletter notice notices outbrain paywall popup promo promoted promotion related reply replies "
    "respond share sharing sidebar side-bar signup skip-link social sponsor sponsored subscribe subscription taboola toolbar widget"
)
_ROLE = re.compile(r"(?:^|[\s_-])(?:" + "|".join(map(re.escape, _ROLE_WORDS.split())) + r")(?:$|[\s_\d-])")
_ARIA = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_QUOTE_OR_END = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Token:
    """A comment or declaration (without a name), or a tag: its place, name, whether it closes, and its attributes."""

    start: int
    end: int
    name: str = ""
    closing: bool = False
    attributes: str = ""


class _Reader:
    """Finds the tokens of a page in one pass. Ends that are looked for in vain once aren't looked for again."""

    def __init__(self, html: str):
        self.html = html
        self.missing: set[str] = set()

    def _find(self, mark: str, at: int) -> int:
        """The place of a mark from there on, -1 if there is none."""
        if mark in self.missing:
            return -1
        found = self.html.find(mark, at)
        if found < 0:
            self.missing.add(mark)
        return found

    def _tag_end(self, at: int) -> int:
        """Behind the > that ends a tag, quoted ones passed over; a quote that isn't closed is a character like others."""
        while True:
            found = _QUOTE_OR_END.search(self.html, at)
            if not found:
                return len(self.html)
            if found[0] == ">":
                return found.end()
            closed = self._find(found[0], found.end())
            at = closed + 1 if closed >= 0 else found.end()

    def next(self, at: int) -> Token | None:
        found = _OPEN.search(self.html, at)
        if not found:
            return None
        if found[2] is None:
            mark = {"<!--": "-->", "<![CDATA[": "]]>"}.get(found[0], ">")
            end = self._find(mark, found.end())
            return Token(found.start(), end + len(mark) if end >= 0 else len(self.html))
        end = self._tag_end(found.end())
        return Token(found.start(), end, found[2].lower(), bool(found[1]), self.html[found.end() : end - (self.html[end - 1] == ">")])

    def raw_end(self, name: str, at: int) -> int:
        """Behind the closing tag of an element of raw text, -1 if there is none."""
        if name in self.missing:
            return -1
        found = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(self.html, at)
        if not found:
            self.missing.add(name)
            return -1
        return found.end()


@dataclass
class Block:
    """A run of text between block-level tags."""

    parts: list[str] = field(default_factory=list)
    linked: int = 0
    around: bool = False
    article: bool = False
    heading: bool = False
    text: str = ""
    label: str = ""
    final: str = ""


def _says_around(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element's name, class, id or role mark it as something around the article."""
    if name in AROUND and not (name == "header" and in_article):
        return True
    if not attributes or name in ("body", "html", "article", "main"):
        return False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return True
        if key == "role" and value in _ARIA or key in ("class", "id") and _ROLE.search(value):
            return True
    return False


def blocks(html: str) -> list[Block]:
    """The page's blocks in order, with what their containers say. Malformed tags are text or end with the page."""
    out, block = [], Block()
    stack: list[tuple[str, bool, bool]] = []  # name, around, article
    standing: Counter[str] = Counter()  # how often each name is in the stack
    links, at, reader = 0, 0, _Reader(html)

    def leave(depth: int) -> None:
        nonlocal links
        for name, _, _ in stack[depth:]:
            standing[name] -= 1
            links -= name == "a"
        del stack[depth:]

    def close() -> None:
        nonlocal block
        text = " ".join(unescape("".join(block.parts)).split())
        if text:
            block.text = text
            out.append(block)
        block = Block()

    def add(text: str) -> None:
        if text:
            if not block.parts and stack:
                block.around, block.article = stack[-1][1], stack[-1][2]
                block.heading = any(x[0] in HEADINGS for x in stack[-3:])
            block.parts.append(text)
            if links:
                block.linked += len(text.strip())

    while True:
        token = reader.next(at)
        add(html[at : token.start] if token else html[at:])
        if not token:
            break
        at, name, closing = token.end, token.name, token.closing
        if not name:
            continue
        if name not in INLINE:
            close()
        elif name in ("br", "img", "input"):
            add(" ")
        if closing:
            if standing[name]:
                leave(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        if name in RAW or name in HIDDEN:
            end = reader.raw_end(name, at)
            if end >= 0 or name in RAW:
                at = end if end >= 0 else len(html)
            continue
        if name in VOID or token.attributes.rstrip().endswith("/"):
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or name in HEADINGS:
            # These end an open one of their kind, and with it inline elements left open.
            depth = next((i for i in range(len(stack) - 1, max(-1, len(stack) - 6), -1) if stack[i][0] not in INLINE), None)
            if depth is not None and (stack[depth][0] == name or stack[depth][0] == "p"):
                leave(depth)
        around, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if name in ARTICLE:
            article = True
        if not around and name not in INLINE:
            around = _says_around(name, token.attributes, article)
        links += name == "a"
        standing[name] += 1
        stack.append((name, around, article))
    close()
    return out


def _density(text: str) -> tuple[float, int]:
    """Share of stop words among the words of a text, and the number of words."""
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words)), len(words)


def points(block: Block, in_article: bool) -> int:
    """What speaks for a block being part of the article, less what speaks against it.

    Its containers count as others do: two for standing in the article, three against standing in something around it, one
    against standing outside an article that the page has. So do stop words (two for many, one for some, one against
    hardly any in a block of words), length (one for a long block), and links (three against mostly linked text, one
    against much of it).
    """
    linked = block.linked / len(block.text)
    density, words = _density(block.text)
    score = -3 if block.around else 2 if block.article else -1 if in_article else 0
    if words >= 8:
        score += 2 if density >= 0.3 else 1 if density >= 0.15 else -1
    score += len(block.text) > 200
    return score - (3 if linked > 0.5 else 1 if linked > 0.2 else 0)


def _first_pass(block: Block, in_article: bool) -> str:
    """good or bad where the points are clear and the block has words enough to tell; near (leaning to good), far (leaning to bad), short or heading otherwise."""
    score = points(block, in_article)
    linked = block.linked / len(block.text)
    if block.heading and linked <= 0.5:
        return "heading"
    if linked > 0.5:
        return "bad"
    if len(block.text) < 70 or _density(block.text)[1] < 8:
        return "short"
    return "good" if score >= 3 else "near" if score >= 1 else "far" if score >= 0 else "bad"


def _nearest(labels: list[str]) -> list[tuple[str, int]]:
    """For each place the nearest decided label up to it and its distance; none is ("", length)."""
    out, last, distance = [], "", len(labels)
    for label in labels:
        last, distance = (label, 0) if label in ("good", "bad") else (last, distance + 1 if last else distance)
        out.append((last, distance))
    return out


def _place(block: Block) -> tuple[bool, bool]:
    """Blocks of one place may be neighbours: the article's border and that of what stands around it end a neighbourhood."""
    return block.article, block.around


def _second_pass(found: list[Block], in_article: bool) -> None:
    """Decide near, far, short and heading blocks by the nearest decided ones before and after them, of the same place.

    A near or far block goes with a neighbour that agrees with its leaning, and a far one against it only between two
    good ones; a short one inherits from the nearer neighbour. Without neighbours the points decide.
    """
    for place in ((True, False), (True, True), (False, False), (False, True)):
        own = [b for b in found if _place(b) == place]
        before = _nearest([b.label for b in own])
        after = _nearest([b.label for b in reversed(own)])[::-1]
        for b, (one, far), (two, wide) in zip(own, before, after):
            sides = [x for x in (one, two) if x]
            alone = "good" if points(b, in_article) >= 1 else "bad"
            if b.label == "near":
                b.final = "good" if "good" in sides or not sides and alone == "good" else "bad"
            elif b.label == "far":
                b.final = "good" if sides and set(sides) == {"good"} else "bad"
            elif b.label == "short":
                b.final = alone if not sides or len(set(sides)) == 2 and far == wide else sides[0] if len(sides) == 1 else one if far <= wide else two
            else:
                b.final = b.label
    # A heading goes with its section, or with the next heading where that follows at once; the article's end ends both.
    section, following = [], None
    for b in reversed(found):
        if b.label == "heading":
            own = [x.final for x in section if x.article >= b.article and x.around == b.around]
            if not own:
                own = [following.final] if following and not section and following.article >= b.article and following.around == b.around else ["good" if points(b, in_article) >= 1 else "bad"]
            b.final = "good" if "good" in own else "bad"
            section, following = [], b
        else:
            section.append(b)


def main_text(html: str | None) -> str:
    """The article of a page: its blocks joined by blank lines, white space inside each as one space.

    All pages go through both passes. Where nothing is good, the prose-like blocks are the text, and where there are
    none of these either, the short ones with their headings.
    """
    found = blocks(html or "")
    in_article = any(b.article and not b.around for b in found)
    for b in found:
        b.label = _first_pass(b, in_article)
    _second_pass(found, in_article)
    kept = [b.text for b in found if b.final == "good"]
    kept = kept or [b.text for b in found if b.label == "near" and not b.around]
    if not kept and any(b.label == "short" and not b.around for b in found):
        kept = [b.text for b in found if b.label in ("short", "heading") and not b.around]
    return "\n\n".join(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html) for html in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    A null or empty html, or one without an article, has an empty text. Ids and urls are passed on, nulls and repeated
    rows included; other columns are ignored; an empty table gives no rows. No text is dropped or cut for its length.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")

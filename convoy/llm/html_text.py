"""Main text of web pages by two passes over their blocks.

A page is cut into blocks at block-level tags; scripts, styles, comments and the like are left out
with all they hold. The first pass judges each block on its own. Blocks inside navigation, footers
and asides are boilerplate, and so are those inside headers, forms and containers that role, class
or id name as sidebars, adverts, notices, reader comments and the like. Such a name or form says
nothing on ``article`` and ``main``, nor on a container that holds most of what the page marks as
its article or, where it marks none and inside the article, most of its dense text and of its text
at all; reader comments must hold all of it. Names of a state (``with-sidebar``, ``comments-open``)
say nothing either. A page that marks its article (``article``, ``main``) has decided against the blocks outside it. Inside
it and on other pages density of stop words, length and density of links decide: dense and long is
text, links or a copyright line are not, and what is short or in between stays open, links or not.
Inside a marked article links decide only against items of a list, and no copyright line does. In the
second pass an open block takes the label of its nearest decided neighbours among the blocks that no
container has decided. Where the two sides differ, it takes the nearer one's, and at equal distances
it is dropped unless a heading stands before text; inside a marked article it is dropped only if both
sides are.

White space inside a block becomes one space, blocks are trimmed and joined by one space in page
order. Nothing else is dropped or cut.

Defined cases. Null or empty html gives an empty text, as does a page without text. Unclosed
elements end with the page. Rows, other columns and their order are kept; a column named as the
new one is replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from convoy.llm.common import in_arrow, slices

# Elements whose content is no text of the page.
HIDDEN = "script|style|noscript|template|svg|math|object|iframe|canvas|audio|video|select|textarea|title"
TOKEN = re.compile(
    # Comments may be empty at once, and foreign elements may close themselves; other elements may not.
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:svg|math)\b[^>]*/>|<({HIDDEN})\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset(("article", "main"))
LISTED = frozenset(("li", "dd", "dt"))
# Containers of boilerplate, by tag and by words in class, id and role.
BOILER_TAGS = frozenset("nav footer aside button menu dialog".split())
SUSPECT_TAGS = frozenset("form fieldset".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner popup modal overlay "
    "cookie cookies consent gdpr notice notices notification alert nav navbar navigation menu breadcrumb breadcrumbs "
    "pagination pager toolbar sidebar aside widget footer copyright comment comments commentlist disqus reply replies "
    "respond share sharing social related recommended newsletter subscribe subscription signup login search "
    "masthead skip contentinfo complementary dialog alertdialog".split()
)
# Words of reader comments, and words before and after which a word names a state of the page.
READERS = frozenset("comment comments commentlist disqus reply replies respond".split())
STATE_BEFORE = frozenset("with without no not has have hide show".split())
STATE_AFTER = frozenset("open opened closed enabled disabled allowed on off".split())
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
# A copyright line, not a sentence that speaks of copyright.
LEGAL = re.compile(
    r"\s*(?:copyright\W*)?©|\s*(?:copyright\W*|\(c\)\s*)+(?:\d{4}\b|\(c\))|.*\ball rights reserved\W*\Z",
    re.IGNORECASE | re.DOTALL,
)
# Frequent function words of six languages.
STOP = frozenset(
    "a an and are as at be been but by for from had has have he her his i if in is it its not of on or she that the "
    "their they this to was we were which who will with would you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas pour que "
    "qui sa se ses son sur un une vous "
    "aber als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im ist mit "
    "nach nicht noch nur oder sich sie sind so über um und von war wie wird zu zum zur "
    "al como con del el ella en era es esta este fue ha la las lo los más no para pero por que se ser si sin sobre su "
    "sus un una y "
    "che di e gli i il non per si sono um não na os da dos uma".split()
)
LONG, SHORT = 200, 70
DENSE, SOME = 0.30, 0.15
LINKS = 0.5


@dataclass
class Block:
    text: str
    linked: int
    boiler: bool
    article: bool
    heading: bool
    listed: bool = False  # an item of a list
    suspect: int = -1  # the innermost container under suspicion


@dataclass
class Suspect:
    """A container that its name or tag makes boilerplate, unless it turns out to hold the page's text."""

    parent: int
    article: bool
    readers: bool
    text: int = 0
    dense: int = 0
    boiler: bool = True


def _marks(attributes: str) -> frozenset[str]:
    """The words in class, id and role that name a boilerplate container."""
    found = set()
    for _, double, single, bare in ATTRIBUTE.findall(attributes):
        for name in CAMEL.sub("-", double or single or bare).lower().split():
            words = WORDS.findall(name)
            for i, word in enumerate(words):
                state = STATE_AFTER.intersection(words[i + 1 :]) or STATE_BEFORE.intersection(words[:i])
                if word in BOILER_WORDS and not state:
                    found.add(word)
    return frozenset(found)


def _is_comment(attributes: str) -> bool:
    """Whether an article is a reader's comment by a class of that very name."""
    for kind, double, single, bare in ATTRIBUTE.findall(attributes):
        if kind.lower() == "class" and READERS.intersection((double or single or bare).lower().split()):
            return True
    return False


def blocks_of(page: str) -> tuple[list[Block], bool]:
    """The page's blocks in order, and whether the page marks its article."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = []  # tag, inside boilerplate, inside the article, suspect
    suspects: list[Suspect] = []
    parts: list[str] = []
    links: list[str] = []
    anchors, heading, marked = 0, False, False

    def close() -> None:
        nonlocal heading
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            boiler, article, suspect = stack[-1][1:] if stack else (False, False, -1)
            linked = len(" ".join(html.unescape("".join(links)).split()))
            listed = any(s[0] in LISTED for s in stack)
            out.append(Block(text, linked, boiler, article, heading, listed, suspect))
        parts.clear()
        links.clear()
        heading = False

    def add(text: str) -> None:
        if text:
            parts.append(text)
            if anchors:
                links.append(text)

    at = 0
    for token in TOKEN.finditer(page):
        add(page[at : token.start()])
        at = token.end()
        name = token[3] or token[6]
        if name is None:
            continue
        name, ending = name.lower(), bool(token[2] or token[5])
        attributes = token[4] or token[7] or ""
        if name == "a":
            anchors = max(0, anchors + (-1 if ending else 1))
        if name in INLINE:
            named = _marks(attributes) if not ending and name != "img" and attributes else None
            if named:
                close()
                boiler, article, suspect = stack[-1][1:] if stack else (False, False, -1)
                suspects.append(Suspect(suspect, article, named <= READERS))
                stack.append((name, boiler, article, len(suspects) - 1))
            elif ending and stack and stack[-1][0] == name:
                close()
                stack.pop()
            continue
        close()
        if name in VOID:
            continue
        if ending:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    break
            anchors = 0 if not stack else anchors
            continue
        if name == "p" and stack and stack[-1][0] == "p":
            stack.pop()  # an open paragraph ends where the next begins
        boiler, article, suspect = stack[-1][1:] if stack else (False, False, -1)
        outer, named = article, frozenset()
        article = article or name in ARTICLE
        marked = marked or name in ARTICLE
        if name in ARTICLE:
            doubtful = readers = name == "article" and bool(attributes) and _is_comment(attributes)
        else:
            if name not in ("html", "body") and attributes:
                named = _marks(attributes)
            doubtful = bool(named) or name in SUSPECT_TAGS or (name == "header" and not article)
            readers = bool(named) and named <= READERS
        if name in BOILER_TAGS:
            boiler = True
        elif doubtful:
            suspects.append(Suspect(suspect, outer, readers))
            suspect = len(suspects) - 1
        stack.append((name, boiler, article, suspect))
        heading = name in HEADINGS
    add(page[at:])
    close()
    _resolve(out, suspects, marked)
    return out, marked


def _resolve(blocks: list[Block], suspects: list[Suspect], marked: bool) -> None:
    """Settle which suspects are boilerplate, and mark the blocks in them."""
    if not suspects:
        return
    judge = not marked or any(s.article for s in suspects)
    text = dense = 0
    for block in blocks:
        if block.boiler or (marked and not block.article):
            continue
        size = len(block.text) - block.linked
        thick = size if judge and is_dense(block) else 0
        text, dense = text + size, dense + thick
        if block.suspect >= 0:
            suspects[block.suspect].text += size
            suspects[block.suspect].dense += thick
    for suspect in reversed(suspects):  # a container stands before those in it
        if suspect.parent >= 0:
            suspects[suspect.parent].text += suspect.text
            suspects[suspect.parent].dense += suspect.dense
    for suspect in suspects:
        around = marked and not suspect.article  # of the article, if anything of it
        held, whole = (suspect.text, text) if around else (suspect.dense, dense)
        most = held == whole > 0 if suspect.readers else 2 * held > whole
        most = most and 2 * suspect.text > text
        suspect.boiler = not most or (suspect.parent >= 0 and suspects[suspect.parent].boiler)
    for block in blocks:
        block.boiler = block.boiler or (block.suspect >= 0 and suspects[block.suspect].boiler)


def is_dense(block: Block) -> bool:
    """Whether a block is text by its length, its stop words and its links."""
    if len(block.text) < SHORT or block.linked > LINKS * len(block.text):
        return False
    words = block.text.lower().split()
    dense = sum(w.strip(".,;:!?()\"'") in STOP for w in words) / len(words)
    return dense >= DENSE or (len(block.text) >= LONG and (dense >= SOME or not block.linked))


def judged(block: Block, marked: bool) -> bool | None:
    """First pass: text, boilerplate, or open."""
    share = block.linked / len(block.text)
    if block.boiler or (marked and not block.article):
        return False
    if marked:
        # Inside the article links decide in lists only; a paragraph that is one link is text.
        if share > LINKS and block.listed and not block.heading and len(block.text) < LONG:
            return False
    elif share > LINKS or (len(block.text) < LONG and LEGAL.match(block.text)):
        return False
    return True if not block.heading and is_dense(block) else None


def inherited(labels: list[bool | None], headings: list[bool], marked: bool = False) -> list[bool]:
    """Second pass: open blocks take the label of their nearest decided neighbours.

    Inside a marked article an open block goes only where it stands between two blocks that go.
    """
    n = len(labels)
    before, after = [-1] * n, [n] * n
    last = -1
    for i in range(n):
        before[i] = last
        if labels[i] is not None:
            last = i
    last = n
    for i in range(n - 1, -1, -1):
        after[i] = last
        if labels[i] is not None:
            last = i
    if all(label is None for label in labels):
        return [True] * n
    out = []
    for i, label in enumerate(labels):
        if label is not None:
            out.append(label)
            continue
        left = labels[before[i]] if before[i] >= 0 else marked
        right = labels[after[i]] if after[i] < n else marked
        if marked:
            out.append(left or right)
        elif left == right:
            out.append(left)
        elif headings[i]:
            out.append(right)
        else:
            gap = (i - before[i] if before[i] >= 0 else n + 1) - (after[i] - i if after[i] < n else n + 1)
            out.append(left if gap < 0 else right if gap > 0 else False)
    return out


def main_text(page: str | None) -> str:
    blocks, marked = blocks_of(page or "")
    # What its container decides tells nothing about the blocks beside the container.
    near = [b for b in blocks if not b.boiler and (b.article or not marked)]
    kept = inherited([judged(b, marked) for b in near], [b.heading for b in near], marked)
    return " ".join(b.text for b, keep in zip(near, kept, strict=True) if keep)


def extract(pages: DataFrame, html_column: str = "html", text_column: str = "text") -> DataFrame:
    """``pages`` with the main text of their html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, html_column):
                raw = batch.column(html_column).cast(pa.binary())
                texts = [main_text((v.as_py() or b"").decode("utf-8", "replace")) for v in raw]
                names = [n for n in batch.schema.names if n != text_column]
                columns = [batch.column(n) for n in names] + [pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, text_column])

    schema = T.StructType([f for f in pages.schema if f.name != text_column] + [T.StructField(text_column, T.StringType())])
    return in_arrow(pages, run, schema)

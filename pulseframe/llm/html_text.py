"""Main text of web pages by two passes of block rules.

The page is cut into blocks at block-level tags.  First pass, each block on its own: density of links, density of
stop words and length make it good, bad, nearly good or short; elements that are menus, footers, forms, adverts
and the like by tag, or that a whole class word, id or role names so, are outside.  An article element is one feature among
these: inside it fewer stop words and letters are asked for, beside it no block can be better than nearly good.
Second pass: nearly good blocks stay beside good ones, short blocks between good ones or between one
and an edge (of the page, of the article or of what is outside); headings go with good text that follows.  Where no block
is good, the nearly good ones are, else the short ones (of the article, if there is one).

Text is decoded once, white space in a block is one space, blocks are joined by a line feed.
A null or empty page has an empty text; unclosed elements end with the page; repeated rows
give repeated results; an empty table gives no row.  Rows with a null id or address are kept.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseframe.llm.common import by_batch, prepare, text_or_empty

# One match per comment, hidden element, declaration or tag; possessive, so time is linear.
MARKUP = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(?P<hidden>script|style|noscript|template|svg|math|iframe|object|select|textarea|title)\b[^>]*+>(?:.*?</(?P=hidden)\s*>|.*\Z)"
    r"|<[!?][^>]*+>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)/?>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest2>[^>]*+)>", re.S | re.I)
# Elements of HTML by their role.
BLOCKS = frozenset("address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption "
                   "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol optgroup option p "
                   "pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("aside button dialog footer form head menu nav".split())
NESTED = BLOCKS - VOID - frozenset("p li dd dt td th tr option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("p li dd dt td th".split())
# Words of a class, id or role that name what is not the article; a word of what an element merely has or lacks doesn't count.
MARKS = re.compile(r"(?<![^\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo(?:tion)?|banner|menu|nav(?:bar|igation)?|breadcrumbs?|sidebar|"
                   r"footer|comments?|disqus|replies|respond|cookies?|consent|notice|gdpr|popup|modal|overlay|newsletter|subscribe|"
                   r"signup|share|sharing|social|related|recommended|toolbar|pagination|pager|widget|login|search|complementary)(?![^\s_\d-])", re.I)
HEAD_MARKS = re.compile(r"(?<![^\s_-])(?:header|masthead)(?![^\s_\d-])", re.I)
OWNED = re.compile(r"(?:^|[_-])(?:has|have|with|without|no|not|non|hide|hides)[_-]", re.I)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
# Frequent words of the languages read.
STOP_WORDS = frozenset("""
a about after all also an and are as at be been but by can could did do for from had has have he her his how i if in into is it its more my no not of on
one or our out she so some than that the their them then there these they this to up was we were what when which who will with would you your
au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sur un une vous
aber als am auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für haben hat ich im ist mit nach nicht noch nur oder
sich sie sind so um und uns unter vom von vor war was wie wird zu zum zur
al como con cuando del el ella en entre era es esta este fue ha hay la las lo los más me muy no o para pero por que se si sin sobre su sus también un una y ya
""".split())
GOOD, BAD, NEAR, SHORT, OUT = "good", "bad", "near", "short", "outside"


class Block:
    """A run of text between block-level tags."""

    __slots__ = ("parts", "linked", "tag", "inside", "outside")

    def __init__(self, tag: str, inside: bool, outside: bool):
        self.parts, self.linked, self.tag, self.inside, self.outside = [], 0, tag, inside, outside


def blocks_of(page: str) -> list[tuple[str, int, str, bool, bool]]:
    """``text, letters in links, tag, in the article, in menus and the like`` of each block that has text."""
    found, stack, links = [], [], 0
    state = [False, False]  # in the article; outside it
    seen = False  # an article or main element
    items: dict[int, tuple[str, bool]] = {}  # the open paragraph or list item of each depth, and whether it is outside
    block = Block("", False, False)

    def end(tag: str = "") -> Block:
        text = " ".join(html.unescape("".join(block.parts)).split())
        if text:
            found.append((text, block.linked, block.tag, block.inside, block.outside))
        return Block(tag, state[0], state[1] or any(i[1] for i in items.values()))

    def add(text: str) -> None:
        if text:
            block.parts.append(text)
            if links:
                block.linked += len(text)

    at = 0
    for m in MARKUP.finditer(page):
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        closes = m["close"] or m["close2"]
        if tag == "br":
            block.parts.append(" ")
        elif tag == "a":
            links = max(0, links - 1) if closes else links + 1
        elif tag in BLOCKS:
            links = 0
            rest, depth = m["rest"] or m["rest2"] or "", len(stack)
            if tag in ITEMS or items.get(depth, ("",))[0] == "p":
                items.pop(depth, None)  # a paragraph ends at any block, an item at the next or at its end
            if tag in ITEMS and not closes:
                items[depth] = tag, marked(rest, state[0])
            if tag in NESTED:
                if closes:
                    if any(s[0] == tag for s in stack):
                        while True:
                            name, was = stack.pop()
                            state = was
                            if name == tag:
                                break
                        items = {d: i for d, i in items.items() if d <= len(stack)}
                else:
                    stack.append((tag, state))
                    state = enter(tag, rest, *state, first=not seen)
                    seen = seen or tag in ("article", "main")
            block = end("" if closes else tag)
    if at < len(page):
        add(page[at:])
    end()
    return found


def marked(rest: str, inside: bool) -> bool:
    """Whether an element's attributes hide it or name it as something else than the article."""
    if not rest:
        return False
    if HIDDEN.search(rest):
        return True
    words = [w for _, v in ATTRIBUTE.findall(rest) for w in v.strip("\"'").split() if not OWNED.search(w)]
    return any(MARKS.search(w) or (not inside and HEAD_MARKS.search(w)) for w in words)


def enter(tag: str, rest: str, inside: bool, outside: bool, first: bool = True) -> list[bool]:
    """Whether a nested element's text is in the article, and in what is not the article.

    The page's first article or main element is taken out of whatever class words its surroundings have.
    """
    if tag in ("article", "main"):
        return [True, outside and not first or not first and marked(rest, True)]
    if tag in OUTSIDE or tag == "header" and not inside:
        outside = True
    if tag not in ("html", "body") and tag not in HEADINGS and marked(rest, inside):
        outside = True
    if tag in HEADINGS and rest and HIDDEN.search(rest):
        outside = True
    return [inside, outside]


def alone(text: str, linked: int, tag: str, inside: bool, outside: bool, has_article: bool) -> str:
    """The first pass: a block's label by itself."""
    if outside:
        return OUT
    links, beside = linked / len(text), has_article and not inside
    if links > (0.6 if inside else 0.3):
        return BAD
    if tag in HEADINGS or len(text) < (25 if inside else 70):
        return BAD if links > 0 and not inside else SHORT
    words = text.lower().split()
    stops = sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / len(words)
    if stops >= (0.1 if inside else 0.32) and not beside:
        return GOOD if inside or len(text) > 200 else NEAR
    return NEAR if inside or stops >= 0.15 or not linked else BAD  # lists, tables, code and other languages have few stop words


def with_neighbours(labels: list[str], tags: list[str], inside: list[bool]) -> list[bool]:
    """The second pass: which blocks are kept once undecided ones have looked at their neighbours on the same side of the article's edge."""
    n = len(labels)
    if GOOD not in labels:  # no better block: the best of the undecided are the text
        where = any(i and label in (NEAR, SHORT) for i, label in zip(inside, labels))
        best = NEAR if any(label == NEAR and i == where for i, label in zip(inside, labels)) else SHORT
        labels = [GOOD if label == best and i == where and (best == NEAR or tag not in HEADINGS) else label for label, tag, i in zip(labels, tags, inside)]

    def nearest(order) -> list[str]:
        out, last, side = [OUT] * n, OUT, None
        for i in order:
            if side != inside[i]:  # an edge is like what is outside
                last, side = OUT, inside[i]
            out[i] = last
            # Adverts and the like inside an article don't part its blocks.
            last = labels[i] if labels[i] in (GOOD, BAD) or labels[i] == OUT and not inside[i] else last
        return out

    before, after, out = nearest(range(n)), nearest(range(n - 1, -1, -1)), []
    for i, label in enumerate(labels):
        sides = (before[i] == GOOD) + (after[i] == GOOD)
        if label == SHORT and tags[i] in HEADINGS:
            out.append(after[i] == GOOD or inside[i] and before[i] == GOOD)
        elif label == SHORT:
            out.append(sides == 2 or sides == 1 and OUT in (before[i], after[i]))
        elif label == NEAR:
            out.append(sides >= 1)
        else:
            out.append(label == GOOD)
    return out


def main_text(page: str) -> str:
    found = blocks_of(page)
    has_article = any(b[3] and not b[4] for b in found)
    labels = [alone(*b, has_article) for b in found]
    keep = with_neighbours(labels, [b[2] for b in found], [b[3] for b in found])
    return "\n".join(b[0] for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, *, keys: tuple[str, ...] = ("page_id", "url"), markup: str = "html") -> DataFrame:
    """``*keys, text`` of each whole page."""
    prepare(pages.sparkSession)
    names = [f"k{i}" for i in range(len(keys))]

    def run(c):
        return {**{n: c[n] for n in names}, "text": [main_text(p) for p in c["page"]]}

    schema = ", ".join(f"{n} {pages.schema[k].dataType.simpleString()}" for n, k in zip(names, keys))
    out = by_batch(pages.select(*(F.col(k).alias(n) for n, k in zip(names, keys)), text_or_empty(markup).alias("page")), run, f"{schema}, text string")
    return out.select(*(F.col(n).alias(k) for n, k in zip(names, keys)), "text")


def op5_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))

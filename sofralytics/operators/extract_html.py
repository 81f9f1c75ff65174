"""Raw pages to review blocks.

Splitting HTML needs a parser, so a small standard-library one runs per page inside ``mapInPandas``; every
rule that turns a block's raw strings into values (stars, dates, ids, clean text) is a column expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sofralytics.functions import parsing
from sofralytics.functions.text import clean_scraped, language_flag

VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())


@dataclass(frozen=True)
class Rules:
    """Where things are on a page; a selector is ``tag``, ``.class``, ``tag.class`` or ``tag[attribute]``,
    optionally ``parent child``.  Earlier selectors win."""

    # --- fixed values: selectors of the review dialog ---
    block: tuple[str, ...] = ("div.gws-localreviews__google-review", "div[data-review-id]", "div.WMbnJf")
    author: tuple[str, ...] = ("div.TSUbDb a", "a.DHIhE", "div.d4r55", ".reviewer-name a")
    author_link: tuple[str, ...] = ("div.TSUbDb a", "a.DHIhE")
    star_label: tuple[str, ...] = ("span.lTi8oc", "span[role=img]", "div.dHX2k")
    star_filled: tuple[str, ...] = ("span.elGi1d", "span.hCCjke.vzX5Ic")
    star_width: tuple[str, ...] = ("span.fzvQIb",)
    text: tuple[str, ...] = (
        "span.review-full-text", "div.review-full-text *", "span.wiI7pd", "div.MyEned span", "div.Jtu6Td *", "span.review-text",
    )
    date: tuple[str, ...] = ("span.dehysf", "span.rsqaWe", ".review-date span")
    reply: tuple[str, ...] = ("div.d6SCIc", "div.CDe7pd")
    likes: tuple[str, ...] = ("span.GBkF3d", "span.pkWtMe")
    photo: tuple[str, ...] = ("button.Tya61d",)


@dataclass
class Node:
    tag: str
    attrs: dict
    parent: "Node | None"
    children: list = field(default_factory=list)  # nodes and strings in document order

    def nodes(self) -> Iterator["Node"]:
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def own_text(self) -> list[str]:
        return [c for c in self.children if isinstance(c, str)]

    def strings(self) -> Iterator[str]:
        stack = list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                yield item
            else:
                stack.extend(reversed(item.children))


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open)
        self.open.children.append(node)
        if tag not in VOID_TAGS:
            self.open = node

    def handle_startendtag(self, tag, attrs):
        self.open.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.open))

    def handle_endtag(self, tag):
        node = self.open
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.open = node.parent

    def handle_data(self, data):
        self.open.children.append(data)


def _is(node: Node, part: str) -> bool:
    head, _, attribute = part.partition("[")
    tag, *classes = head.split(".")
    if tag not in ("", "*", node.tag) or not set(classes) <= set(node.attrs.get("class", "").split()):
        return False
    name, _, value = attribute.rstrip("]").partition("=")
    return not name or (name in node.attrs and (not value or node.attrs[name] == value))


def select(root: Node, selector: str) -> list[Node]:
    *above, last = selector.split()

    def under(node: Node) -> bool:
        want = list(above)
        up = node.parent
        while want and up is not None:
            if _is(up, want[-1]):
                want.pop()
            up = up.parent
        return not want

    return [n for n in root.nodes() if _is(n, last) and under(n)]


def _first(root: Node, selectors, value) -> str:
    for selector in selectors:
        for node in select(root, selector)[:1]:
            got = value(node)
            if got:
                return got
    return ""


BLOCK_SCHEMA = (
    "page_id bigint, block_no int, given_id string, author string, author_url string, star_label string, "
    "stars_filled int, star_style string, body string, fallback array<string>, date_text string, owner_reply string, "
    "likes_text string, photos int, block_text string"
)


def page_blocks(html: str, rules: Rules) -> Iterator[tuple]:
    """Raw strings of every review block of one page."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    blocks: list[Node] = []
    for selector in rules.block:
        blocks = select(tree.root, selector)
        if blocks:
            break
    own = lambda n: (n.own_text() or [""])[0]
    for number, block in enumerate(blocks):
        body = ""
        for selector in rules.text:
            parts = [s.strip() for n in select(block, selector) for s in n.own_text() if s.strip()]
            if parts:
                body = " ".join(parts)
                break
        inner = block.attrs.get("data-review-id") or _first(block, ("*[data-review-id]",), lambda n: n.attrs["data-review-id"])
        strings = list(block.strings())
        yield (
            number, inner, _first(block, rules.author, own).strip(), _first(block, rules.author_link, lambda n: n.attrs.get("href", "")),
            _first(block, rules.star_label, lambda n: n.attrs.get("aria-label", "")),
            sum(len(select(block, s)) for s in rules.star_filled),
            _first(block, rules.star_width, lambda n: n.attrs.get("style", "")),
            body, [s.strip() for s in strings if s.strip()], _first(block, rules.date, own).strip(),
            _first(block, rules.reply, own).strip(), _first(block, rules.likes, own), sum(len(select(block, s)) for s in rules.photo),
            "".join(strings),
        )


def raw_blocks(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per review block of every page, values still as found."""
    names = [part.strip().split()[0] for part in BLOCK_SCHEMA.split(", ")]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(page, *block) for page, html in zip(batch["page_id"], batch["html"]) if html for block in page_blocks(html, rules)]
            yield pd.DataFrame(rows, columns=names)

    return pages.select("page_id", "html").mapInPandas(split, BLOCK_SCHEMA)


def extract_reviews(pages: DataFrame, scraped_at, rules: Rules = Rules()) -> DataFrame:
    """Parsed reviews of every page: id, author, stars, text, date, reply, likes, photos, language.

    Without a text element the block's longer strings that are no dates are joined; blocks without text
    are dropped.  Relative dates count back from ``scraped_at``.
    """
    long_strings = F.filter(
        "fallback", lambda s: (F.length(s) > 10) & ~s.rlike(r"^[0-9]+\s*(ay|hafta|gun|yil|saat)")
    )
    text = clean_scraped(F.when(F.col("body") != "", F.col("body")).otherwise(F.array_join(long_strings, " ")))
    return (
        raw_blocks(pages, rules)
        .withColumn("text", text)
        .filter(F.col("text") != "")
        .select(
            "page_id", "block_no", parsing.review_id_or_hash(F.col("given_id"), F.col("block_text")).alias("review_id"),
            "author", "author_url", parsing.stars(F.col("star_label"), F.col("stars_filled"), F.col("star_style")).alias("rating"),
            "text", parsing.relative_timestamp(F.col("date_text"), scraped_at).alias("review_date"), "owner_reply",
            parsing.short_count(F.col("likes_text")).alias("likes"), "photos", language_flag(F.col("text")).alias("language"),
        )
    )

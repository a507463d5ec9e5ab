"""Text of a page for extraction: noise stripped, sliced to where the prices are, hashed."""

from __future__ import annotations

import hashlib
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements and class or id words that never hold prices, and the sizes of the slice.
STRIPPED = frozenset(("script", "style", "svg", "noscript", "iframe", "template", "nav", "header", "footer"))
NOISE = re.compile("(cookie|consent|gdpr|intercom|drift|zendesk|crisp|chat-widget|livechat|banner-notice)", re.I)
PRICE = re.compile(r"[$€£][ \t\n\r\f\v\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]?[0-9]")
SHARE = 0.8
SLICE_CHARS = 30_000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACE = re.compile("[ \t\n\r\f\v\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
LATE_CLOSER = r"(?i)</(script|style|pre|noscript|textarea|template|title)\s+>"


def normal_closers(c: Column) -> Column:
    """End tags of raw elements without white space before their bracket."""
    return F.regexp_replace(c, LATE_CLOSER, "</$1>")


class _Page(HTMLParser):
    """Elements as (tag, first piece, children), with the text that counts in ``pieces``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.root = ["", 0, 0, []]  # tag, first piece, piece after the last, children
        self.open = [(self.root, False)]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        marker = " ".join(v or "" for k, v in attrs if k in ("class", "id"))
        dropped = self.open[-1][1] or tag in STRIPPED or bool(NOISE.search(marker))
        node = [tag, len(self.pieces), len(self.pieces), []]
        if not dropped:
            self.open[-1][0][3].append(node)
        if tag not in VOID:
            self.open.append((node, dropped))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if any(node[0] == tag for node, _ in self.open[1:]):
            while self.open[-1][0][0] != tag:
                self.open.pop()[0][2] = len(self.pieces)
            self.open.pop()[0][2] = len(self.pieces)

    def handle_data(self, data: str) -> None:
        if not self.open[-1][1]:
            self.pieces.append(data)

    def ended(self) -> list:
        self.close()
        for node, _ in self.open:
            node[2] = len(self.pieces)
        return self.root


def densest(text: str, size: int = SLICE_CHARS) -> str:
    """The window of most prices, in steps of an eighth of its size; the first of equals."""
    if len(text) <= size:
        return text
    starts = range(0, len(text) - size + 1, max(1, size // 8))
    best = max(starts, key=lambda s: (len(PRICE.findall(text, s, s + size)), -s))
    return text[best : best + size]


def normal_text(html: str | None, widen: bool = False) -> str:
    """The text of the smallest element that holds most of the prices; of the body if there are none or ``widen``."""
    page = _Page()
    page.feed(html or "")
    root = page.ended()
    text = lambda node: "".join(page.pieces[node[1] : node[2]])

    def body(node: list) -> list | None:
        todo = [node]
        while todo:
            found = todo.pop()
            if found[0] == "body":
                return found
            todo += reversed(found[3])
        return None

    here = body(root) or root
    total = 0 if widen else len(PRICE.findall(text(here)))
    while total:
        heir = next((child for child in here[3] if len(PRICE.findall(text(child))) >= total * SHARE), None)
        if heir is None:
            break
        here = heir
    return densest(SPACE.sub(" ", text(here)).strip())


def _normal(html: pa.Array) -> pa.Array:
    texts = [normal_text(x) for x in html.to_pylist()]
    rows = [{"text": t, "normalized_hash": hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()} for t in texts]
    return pa.array(rows, pa.struct([("text", pa.string()), ("normalized_hash", pa.string())]))


def normalized(html: Column) -> Column:
    """struct of text and normalized_hash; null pages are empty."""
    return F.arrow_udf(_normal, "struct<text:string,normalized_hash:string>")(normal_closers(html))

"""HTML as a node list, and CSS selectors as Column predicates over it.

Python only tokenises: one Arrow UDF turns a page into a flat list of elements and
text pieces, numbered in document order.  Which elements are cards, anchors, titles or dates
is decided by Catalyst expressions on that list, driven by rule tables.

An element carries ``path``: one line per ancestor and itself, each line the tag and its
classes separated by tabs.  A selector is then a regular expression on the path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubwatch.functions.base import q, sql_any
from pubwatch.functions.text import sql_clean_text
from pubwatch.session import bounded_batches

NODE_SCHEMA = (
    "struct<nodes:array<struct<pre:int,post:int,tag:string,path:string,prev:int,next:int,parent:int,attrs:map<string,string>>>,"
    "texts:array<struct<pos:int,text:string,raw:boolean>>>"
)
_NODE_TYPE = pa.struct({
    "nodes": pa.list_(pa.struct({
        "pre": pa.int32(), "post": pa.int32(), "tag": pa.string(), "path": pa.string(), "prev": pa.int32(), "next": pa.int32(), "parent": pa.int32(),
        "attrs": pa.map_(pa.string(), pa.string()),
    })),
    "texts": pa.list_(pa.struct({"pos": pa.int32(), "text": pa.string(), "raw": pa.bool_()})),
})
#: A task holds the node lists of at most so many pages, and no further page once they come from so many characters.
PAGES_AT_ONCE, CHARACTERS_AT_ONCE = 64, 1 << 18
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset(("script", "style", "template"))


class _Tokens(HTMLParser):
    """Numbers start tags and text pieces in document order and closes elements like a lenient tree builder."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.texts: list[dict] = []
        self.open: list[int] = []
        self.last_child: dict[int, int] = {}
        self.clock = 0

    def handle_starttag(self, tag, attrs):
        self.clock += 1
        values = {k: v or "" for k, v in reversed(attrs)}
        parent = self.open[-1] if self.open else -1
        above = self.nodes[parent]["path"] if parent >= 0 else ""
        line = "\n" + "\t".join([tag, *values.get("class", "").split()])
        index, previous = len(self.nodes), self.last_child.get(parent, -1)
        if previous >= 0:
            self.nodes[previous]["next"] = index
        self.last_child[parent] = index
        self.nodes.append({"pre": self.clock, "post": self.clock, "tag": tag, "path": above + line, "prev": previous,
                           "next": -1, "parent": parent, "attrs": values})
        if tag not in _VOID:
            self.open.append(index)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if any(self.nodes[i]["tag"] == tag for i in self.open):
            while self.open:
                index = self.open.pop()
                self.nodes[index]["post"] = self.clock
                if self.nodes[index]["tag"] == tag:
                    break

    def handle_data(self, data):
        stripped = data.strip()
        if stripped:
            self.clock += 1
            hidden = bool(self.open) and self.nodes[self.open[-1]]["tag"] in _HIDDEN
            if not hidden or self.nodes[self.open[-1]]["attrs"].get("type") == "application/ld+json":
                self.texts.append({"pos": self.clock, "text": stripped, "raw": hidden})

    def finish(self) -> dict:
        self.close()
        for index in self.open:
            self.nodes[index]["post"] = self.clock
        for node in self.nodes:
            node["attrs"] = list(node["attrs"].items())
        return {"nodes": self.nodes, "texts": self.texts}


def _tokenise(html: str | None) -> dict:
    tokens = _Tokens()
    tokens.feed(html or "")
    return tokens.finish()


def _page_nodes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for bodies in batches:
        found, characters = [], 0
        for body in bodies:
            html = body.as_py()
            found.append(_tokenise(html))
            characters += len(html or "")
            if len(found) >= PAGES_AT_ONCE or characters >= CHARACTERS_AT_ONCE:
                yield pa.array(found, type=_NODE_TYPE)
                found, characters = [], 0
        if found:
            yield pa.array(found, type=_NODE_TYPE)


def with_nodes(pages: DataFrame, body: str = "body") -> DataFrame:
    """Add the node list of each page; a few pages' lists at a time, however many pages an input batch holds."""
    bounded_batches(pages.sparkSession)
    return pages.withColumn("dom", F.arrow_udf(_page_nodes, NODE_SCHEMA)(F.col(body)))


# --- selectors -------------------------------------------------------------------------------------
# Everything below is SQL text over the columns ``dom`` (see NODE_SCHEMA) and, where a page has
# been exploded into elements, ``card``.

NODES, TEXTS, CARD = "dom.nodes", "dom.texts", "card"
_PART = re.compile(r"([.#]?[\w-]+|\*)|\[([\w:-]+)(?:([*^~]?=)[\"']?([^\"'\]]*)[\"']?)?\]")


def _element(compound: str) -> tuple[str, list[tuple[str, str, str]]]:
    """(regular expression for one path line, attribute tests) of a compound selector."""
    tag, classes, tests = "[^\\t\\n]+", [], []
    for name, attribute, operator, value in _PART.findall(compound):
        if attribute:
            tests.append((attribute, operator, value))
        elif name.startswith("."):
            classes.append(re.escape(name[1:]))
        elif name != "*":
            tag = re.escape(name)
    looks = "".join(rf"(?=[^\n]*\t{c}(?:[\t\n]|\z))" for c in classes)
    return rf"\n{looks}{tag}(?:\t[^\n]*)?", tests


def path_pattern(selector: str) -> tuple[str, list[tuple[str, str, str]]]:
    """(regular expression for the whole path, attribute tests) of one selector without commas."""
    pattern, tests, gap = "^", [], True
    for token in selector.replace(">", " > ").split():
        if token == ">":
            gap = False
            continue
        line, tests = _element(token)
        pattern += (r"(?:\n[^\n]*)*" if gap else "") + line
        gap = True
    return pattern + r"\z", tests


def _attribute_test(node: str, test: tuple[str, str, str]) -> str:
    name, operator, value = test
    found = f"{node}.attrs[{q(name)}]"
    if operator == "=":
        return f"coalesce({found} = {q(value)}, false)"
    if operator == "^=":
        return f"coalesce(startswith({found}, {q(value)}), false)"
    if operator == "*=":
        return f"coalesce(contains({found}, {q(value)}), false)"
    return f"{found} is not null"


def css(selector: str, node: str) -> str:
    """Does ``node`` match the selector list?  Tags, classes, attributes, descendants and children."""
    plain, alternatives = [], []
    for single in selector.split(","):
        pattern, tests = path_pattern(single)
        if tests:
            alternatives.append("(" + " and ".join([f"{node}.path rlike {q(pattern)}", *[_attribute_test(node, t) for t in tests]]) + ")")
        else:
            plain.append(pattern)
    if plain:
        alternatives.append(f"{node}.path rlike {q('|'.join(plain))}")
    return sql_any(alternatives)


def below(node: str, within: str) -> str:
    return f"{node}.pre > {within}.pre and {node}.pre <= {within}.post"


def select(selector: str, within: str | None = None) -> str:
    """All nodes below ``within`` (or of the page) that match, in document order."""
    scope = f"{below('n', within)} and " if within else ""
    return f"filter({NODES}, n -> {scope}{css(selector, 'n')})"


def first(selector: str, within: str | None = None) -> str:
    return f"get({select(selector, within)}, 0)"


def _pieces(condition: str) -> str:
    return f"filter({TEXTS}, p -> {condition})"


def text_of(node: str) -> str:
    """Text pieces below a node, joined by one blank."""
    seen = _pieces(f"p.pos > {node}.pre and p.pos <= {node}.post and not p.raw")
    return f"array_join(transform({seen}, p -> p.text), ' ')"


def page_text() -> str:
    return f"array_join(transform({_pieces('not p.raw')}, p -> p.text), ' ')"


def script_text(node: str) -> str:
    """Raw content of a structured-data script."""
    raw = _pieces(f"p.pos > {node}.pre and p.pos <= {node}.post and p.raw")
    return f"array_join(transform({raw}, p -> p.text), '')"


def clean_text_of(node: str) -> str:
    return sql_clean_text(text_of(node))


def attr(node: str, name: str) -> str:
    return f"coalesce({node}.attrs[{q(name)}], '')"


def inside_any(path: str, *tags: str) -> str:
    """Is the node below one of these elements?"""
    pattern = r"^(?:\n[^\n]*)*\n(?:" + "|".join(tags) + r")(?:\t[^\n]*)?\n"
    return f"{path} rlike {q(pattern)}"

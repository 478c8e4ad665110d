"""Records from HTML pages by CSS selectors."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tierflow.workspace import runs_on_executors

runs_on_executors(__name__)

# Fixed values of HTML: elements without content, elements holding raw text, and the open
# elements that a starting element ends.
VOID = frozenset(
    "area base br col embed hr img input link meta source track wbr".split()
)
RAW_TEXT = frozenset({"script", "style"})
INLINE = frozenset("a b big code em font i label s small span strike strong tt u".split())
BLOCKS = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main "
    "nav ol p pre section table ul".split()
)
ENDED_BY = {
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "option": frozenset({"option"}),
    "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}),
    "th": frozenset({"td", "th"}),
    "tbody": frozenset({"thead", "tbody", "tr", "td", "th"}),
    **{block: frozenset({"p"}) for block in BLOCKS},
}

# Characters of pages whose records are held at a time, beyond one page.
HELD_CHARS = 1 << 20
# A name without its semicolon is text and no entity; its ampersand is set aside while parsing.
_BARE_AMPERSAND = re.compile(r"&(?=[A-Za-z][A-Za-z0-9]*(?![A-Za-z0-9;]))")
_KEPT = "\0"


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    parent: "Node | None" = None
    children: list = field(default_factory=list)
    nth: int = 1  # position among the siblings of the same tag
    tags: dict[str, int] = field(default_factory=dict)

    def add(self, tag: str, attrs: dict[str, str]) -> "Node":
        self.tags[tag] = self.tags.get(tag, 0) + 1
        child = Node(tag, attrs, self, nth=self.tags[tag])
        self.children.append(child)
        return child

    def walk(self) -> Iterator["Node"]:
        """Descendant elements in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        """Stripped text pieces, joined without a separator; scripts and styles count only
        for their own element."""
        pieces, stack = [], list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                pieces.append(item.strip())
            elif item.tag not in RAW_TEXT:
                stack.extend(reversed(item.children))
        return "".join(pieces)


class _TreeBuilder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("[document]", {})
        self.open = self.root

    def _end_implied(self, tag: str) -> None:
        ended = ENDED_BY.get(tag)
        if not ended:
            return
        node, last = self.open, None
        while node.parent is not None and (node.tag in ended or node.tag in INLINE):
            if node.tag in ended:
                last = node
            node = node.parent
        if last is not None:
            self.open = last.parent

    def handle_starttag(self, tag, attrs):
        self._end_implied(tag)
        node = self.open.add(tag, {k: (v or "").replace(_KEPT, "&") for k, v in attrs})
        if tag not in VOID:
            self.open = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        node = self.open
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.open = node.parent

    def handle_data(self, data):
        data = data.replace(_KEPT, "&")
        siblings = self.open.children
        if siblings and isinstance(siblings[-1], str):
            siblings[-1] += data
        else:
            siblings.append(data)


def parse_html(html: str) -> Node:
    builder = _TreeBuilder()
    builder.feed(_BARE_AMPERSAND.sub(_KEPT, html))
    builder.close()
    return builder.root


_SIMPLE = re.compile(
    r"(?P<tag>^(?:[A-Za-z][\w-]*|\*))"
    r"|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)"
    r"|\[(?P<attr>[\w-]+)(?:=[\"']?(?P<value>[^\"'\]]*)[\"']?)?\]"
    r"|:nth-of-type\((?P<nth>\d+)\)"
)


@dataclass(frozen=True)
class Compound:
    """One step of a selector, with how it hangs on the step before (' ' or '>')."""

    link: str
    tests: tuple[tuple[str, str, "str | None"], ...]

    def matches(self, node: Node) -> bool:
        for kind, name, value in self.tests:
            if kind == "tag" and name != "*" and node.tag != name.lower():
                return False
            if kind == "id" and node.attrs.get("id") != name:
                return False
            if kind == "cls" and name not in node.attrs.get("class", "").split():
                return False
            if kind == "attr" and (
                name not in node.attrs or (value is not None and node.attrs[name] != value)
            ):
                return False
            if kind == "nth" and node.nth != int(name):
                return False
        return True


def parse_selector(selector: str) -> list[list[Compound]]:
    """Alternatives of compound chains: tags, ids, classes, attributes, ``:nth-of-type(n)``,
    descendant and child steps."""
    alternatives = []
    for part in selector.split(","):
        chain, link = [], " "
        for token in part.replace(">", " > ").split():
            if token == ">":
                link = ">"
                continue
            tests, position = [], 0
            while position < len(token):
                found = _SIMPLE.match(token, position) if position else _SIMPLE.match(token)
                if found is None:
                    raise ValueError(f"unsupported selector: {selector}")
                kind = found.lastgroup if found.lastgroup != "value" else "attr"
                tests.append((kind, found.group(kind), found.group("value")))
                position = found.end()
            chain.append(Compound(link, tuple(tests)))
            link = " "
        if not chain:
            raise ValueError(f"unsupported selector: {selector}")
        alternatives.append(chain)
    return alternatives


def _chain_matches(chain: list[Compound], node: Node) -> bool:
    if not chain[-1].matches(node):
        return False
    if len(chain) == 1:
        return True
    parent = node.parent
    while parent is not None and parent.parent is not None:
        if _chain_matches(chain[:-1], parent):
            return True
        if chain[-1].link == ">":
            return False
        parent = parent.parent
    return False


def select(scope: Node, alternatives: list[list[Compound]]) -> Iterator[Node]:
    """Descendants of ``scope`` that match, in document order."""
    for node in scope.walk():
        if any(_chain_matches(chain, node) for chain in alternatives):
            yield node


def _records(html: str, container, fields) -> Iterator[dict]:
    root = parse_html(html)
    for scope in select(root, container) if container else (root,):
        record = {}
        for name, selector in fields.items():
            node = next(select(scope, selector), None)
            record[name] = None if node is None else node.text()
        if any(record.values()):
            yield record


def page_links(url: Column, base_url: str | None) -> Column:
    """Relative URLs below ``base_url``; absolute ones stay as they are."""
    if not base_url:
        return url
    below = F.concat(F.lit(base_url.rstrip("/") + "/"), F.ltrim(url, F.lit("/")))
    return F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(below)


def scrape(
    pages: DataFrame,
    fields: Mapping[str, str],
    container: str | None = None,
    html: str = "html",
) -> DataFrame:
    """One row per record: the other columns of ``pages``, the record's ``position`` on its
    page, and the fields. Records without any text are dropped."""
    parsed_fields = {name: parse_selector(s) for name, s in fields.items()}
    parsed_container = parse_selector(container) if container else None
    kept = [f for f in pages.schema.fields if f.name != html]
    schema = T.StructType(
        kept
        + [T.StructField("position", T.IntegerType())]
        + [T.StructField(name, T.StringType()) for name in fields]
    )
    names = [f.name for f in kept]

    def made(batch: pa.RecordBatch, rows: list, positions: list, records: list) -> pa.RecordBatch:
        chosen = pa.array(rows, type=pa.int32())
        found = [pa.array([r[name] for r in records], type=pa.string()) for name in fields]
        return pa.RecordBatch.from_arrays(
            [batch.column(i).take(chosen) for i in range(len(names))] + [pa.array(positions, type=pa.int32()), *found], names=schema.names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages_of = batch.column(len(names))
            rows, positions, records, held = [], [], [], 0
            for i in range(batch.num_rows):
                text = pages_of[i].as_py()
                if text is None:
                    continue
                for position, record in enumerate(_records(text, parsed_container, parsed_fields), start=1):
                    rows.append(i)
                    positions.append(position)
                    records.append(record)
                held += len(text)
                if held > HELD_CHARS:
                    yield made(batch, rows, positions, records)
                    rows, positions, records, held = [], [], [], 0
            yield made(batch, rows, positions, records)

    return pages.select(*names, html).mapInArrow(run, schema)

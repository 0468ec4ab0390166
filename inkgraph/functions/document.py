"""One document: source text to blocks, headings, wiki links, front matter and diagnostics, in byte offsets."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

from inkgraph.functions.blocks import Block, BlockParser, Definition, Joined, definitions, front_matter, normal_label, tables
from inkgraph.functions.inlines import Inline, InlineParser, flatten, wikilinks


#: The characters with the Unicode property White_Space, which trimming removes.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


class Offsets:
    """Byte offsets of characters."""

    def __init__(self, text: str):
        self.plain = text.isascii()
        self.starts = None if self.plain else [0, *accumulate(len(c.encode("utf-8", "surrogatepass")) for c in text)]

    def __call__(self, at: int) -> int:
        return at if self.plain else self.starts[at]


@dataclass
class Document:
    text: str
    offsets: Offsets
    blocks: list[Block]
    front: tuple[int, bool] | None
    definitions: list[Definition]
    notes: set[str]
    diagnostics: list[tuple[str, int, int]]
    targets: dict[str, tuple[str, str | None]] = field(default_factory=dict)

    def joined(self, block: Block) -> Joined:
        return Joined(self.text, block.fragments)

    def inlines(self, block: Block | Joined) -> list[Inline]:
        joined = block if isinstance(block, Joined) else self.joined(block)
        return InlineParser(joined.text, self.targets, self.notes).parse()

    def below(self, block: Block | None = None) -> Iterator[Block]:
        """All blocks, or those of one, in document order."""
        for top in self.blocks if block is None else [block]:
            yield from top.below()


def parse(text: str, front_allowed: bool = True) -> Document:
    front = front_matter(text) if front_allowed else None
    parser = BlockParser(text, front[0] if front else 0)
    found: list[Definition] = []
    notes: set[str] = set()
    tables(text, parser.root)
    definitions(text, parser.root, found, notes)
    diagnostics = list(parser.diagnostics)
    if front and not front[1]:
        diagnostics.insert(0, ("UnterminatedFrontmatter", 0, front[0]))
    targets: dict[str, tuple[str, str | None]] = {}
    for one in sorted(found, key=lambda d: d.start):
        targets.setdefault(normal_label(one.label), (one.dest, one.title))
    return Document(text, Offsets(text), parser.root.children, front, found, notes, diagnostics, targets)


def heading_text(doc: Document, block: Block) -> str:
    return flatten(doc.inlines(block)).strip(WHITE)


def links(doc: Document, block: Block) -> list[tuple[int, int, str, str | None]]:
    """(start, end, target, label) in bytes of the wiki links below ``block``, in document order."""
    out = []
    for one in block.below():
        if one.kind in ("paragraph", "heading", "cell") and any(doc.text.find("[[", a, b) >= 0 for a, b in one.fragments):
            joined = doc.joined(one)
            for node in wikilinks(doc.inlines(joined)):
                start, end = joined.source(node.start), joined.source(node.end - 1) + 1
                out.append((doc.offsets(start), doc.offsets(end), node.attrs["target"], node.attrs["label"]))
    return out


def front_yaml(text: str) -> str:
    """What stands between the fences of terminated front matter."""
    body = text.removeprefix("﻿")
    lines = re.split(r"(?<=\n)|(?<=\r)(?!\n)", body)
    lines = [x for x in lines if x]
    return "".join(lines[1:-1])


#: Nodes that front matter may stand for once aliases are followed.
MOST_NODES = 100_000


def metadata(doc: Document) -> tuple[str | None, str | None]:
    """(JSON, error) of the front matter; both None without any. Whatever it holds, this tells an error at most."""
    if not doc.front or not doc.front[1]:
        return None, None
    source = front_yaml(doc.text[: doc.front[0]])
    try:
        import yaml
    except ImportError:
        return _simple_yaml(source)
    try:
        root = yaml.compose(source, Loader=_loader(yaml))
        return (None if root is None else yaml_json(root)), None
    except (yaml.YAMLError, ValueError, RecursionError) as error:
        said = "nested too deeply" if isinstance(error, RecursionError) else " ".join(str(error).split())
        return None, f"invalid YAML frontmatter: {said}"


#: Plain scalars of the core schema of YAML 1.2.
CORE = (
    ("null", re.compile(r"~|null|Null|NULL|")),
    ("bool", re.compile(r"true|True|TRUE|false|False|FALSE")),
    ("int", re.compile(r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+")),
    ("float", re.compile(r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)")),
)


def _scalar(value: str, tag: str, plain: bool) -> str:
    """JSON of a scalar: by its tag, if it has one, else by the core schema if it is plain. Infinities are numbers beyond any
    double, as JSON has no others, and what isn't a number is null."""
    kind = tag.removeprefix("tag:yaml.org,2002:")
    kinds = dict(CORE)
    if not tag:
        kind = next((k for k, pattern in CORE if pattern.fullmatch(value)), "str") if plain else "str"
    elif kind not in kinds:
        kind = "str"
    elif not kinds[kind].fullmatch(value):
        raise ValueError(f"'{value[:40]}' is no {kind}")
    if kind == "null":
        return "null"
    if kind == "bool":
        return value.lower()
    sign, digits = ("-" if value.startswith("-") else ""), value.lstrip("+-")
    if kind == "int":
        if digits[:2] in ("0o", "0x"):
            return str(int(digits[2:], 8 if digits[1] == "o" else 16))
        return sign + (digits.lstrip("0") or "0")
    if kind == "float":
        if digits.lower() == ".inf":
            return sign + "1e999"
        if digits.lower() == ".nan":
            return "null"
        whole, _, exponent = digits.lower().partition("e")
        before, _, after = whole.partition(".")
        return sign + (before.lstrip("0") or "0") + (f".{after}" if after else "") + (f"e{exponent}" if exponent else "" if after else ".0")
    return json.dumps(value, ensure_ascii=False)


def _loader(yaml):
    """A loader under which only nodes that the document tags have a tag."""

    class Loader(yaml.SafeLoader):
        def resolve(self, kind, value, implicit):
            return ""

    return Loader


def yaml_json(root) -> str:
    """JSON of a composed YAML node, keys in order of their text; ValueError for what JSON cannot say."""
    out: list[str] = []
    active: set[int] = set()
    count = 0
    todo: list = [root]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        if isinstance(node, int):
            active.discard(node)
            continue
        count += 1
        if count > MOST_NODES:
            raise ValueError("more nodes than front matter may have")
        if id(node) in active:
            raise ValueError("an alias within what it stands for")
        if node.id == "scalar":
            out.append(_scalar(node.value, node.tag, node.style is None))
            continue
        active.add(id(node))
        todo.append(id(node))
        if node.id == "sequence":
            parts: list = ["["]
            for k, child in enumerate(node.value):
                parts += [", ", child] if k else [child]
            todo += reversed([*parts, "]"])
            continue
        keyed = {}
        for key, value in node.value:
            if key.id != "scalar":
                raise ValueError("a key that is no scalar")
            said = _scalar(key.value, key.tag, key.style is None)
            name = json.loads(said) if said.startswith('"') else said
            if name in keyed:
                raise ValueError(f"duplicate entry with key '{name[:40]}'")
            keyed[name] = value
        parts = ["{"]
        for k, name in enumerate(sorted(keyed)):
            parts += [(", " if k else "") + json.dumps(name, ensure_ascii=False) + ": ", keyed[name]]
        todo += reversed([*parts, "}"])
    return "".join(out)


def _simple_yaml(text: str) -> tuple[str | None, str | None]:
    """Flat front matter (``key: scalar`` and ``key: [a, b]``), where no YAML library is installed."""

    def scalar(raw: str):
        raw = raw.strip()
        if raw in ("", "~", "null", "Null", "NULL"):
            return None
        if raw in ("true", "True", "TRUE", "false", "False", "FALSE"):
            return raw.lower() == "true"
        if re.fullmatch(r"[-+]?[0-9]+", raw):
            return int(raw)
        if re.fullmatch(r"[-+]?(\.[0-9]+|[0-9]+\.[0-9]*)([eE][-+]?[0-9]+)?", raw):
            return float(raw)
        if len(raw) > 1 and raw[0] == raw[-1] and raw[0] in "\"'":
            return raw[1:-1]
        return raw

    out: dict = {}
    key = None
    for number, line in enumerate(text.splitlines(), 1):
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        if body.lstrip().startswith("- ") and key is not None:
            if not isinstance(out[key], list):
                out[key] = []
            out[key].append(scalar(body.lstrip()[2:]))
            continue
        name, colon, value = body.partition(":")
        value = value.strip()
        if not colon or (value and not body[len(name) + 1].isspace()):
            return None, f"invalid YAML frontmatter: no mapping at line {number}"
        key = name.strip().strip("\"'")
        if value.startswith("["):
            if not value.endswith("]"):
                return None, f"invalid YAML frontmatter: unclosed sequence at line {number}"
            out[key] = [scalar(x) for x in value[1:-1].split(",")] if value[1:-1].strip() else []
        else:
            out[key] = scalar(value)
    return json.dumps(out or None, ensure_ascii=False, sort_keys=True), None


#: What nodes say of blocks only while they are parsed.
_OWN = ("mark", "filled", "blank", "underline", "underlined", "closed")


def nodes(doc: Document) -> list[tuple]:
    """The whole tree as rows (node_id, parent_id, ord, layer, kind, start, end, text, attrs), in pre-order."""
    out: list[tuple] = []
    todo: list[tuple] = [(block, None, None, k) for k, block in reversed(list(enumerate(doc.blocks)))]
    while todo:
        node, joined, parent, order = todo.pop()
        own = len(out)
        attrs = json.dumps({k: v for k, v in node.attrs.items() if k not in _OWN}, sort_keys=True, ensure_ascii=False)
        if joined is not None:
            start, end = joined.source(node.start), joined.source(max(node.start, node.end - 1)) + (node.end > node.start)
            out.append((own, parent, order, "inline", node.kind, doc.offsets(start), doc.offsets(end), node.text, attrs))
            todo += [(child, joined, own, k) for k, child in reversed(list(enumerate(node.children)))]
            continue
        out.append((own, parent, order, "block", node.kind, doc.offsets(node.start), doc.offsets(node.end), None, attrs))
        todo += [(child, None, own, k) for k, child in reversed(list(enumerate(node.children)))]
        if node.kind in ("paragraph", "heading", "cell") and node.fragments:
            within = doc.joined(node)
            todo += [(child, within, own, k) for k, child in reversed(list(enumerate(doc.inlines(within))))]
    return out


def line_of(newlines: list[int], at: int) -> int:
    """1-based line of a byte offset."""
    return 1 + bisect_right(newlines, at - 1) if at else 1

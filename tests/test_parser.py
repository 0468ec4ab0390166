from __future__ import annotations

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkgraph.functions.blake3 import blake3_hex, blake3_many
from inkgraph.functions.document import heading_text, links, metadata, nodes, parse
from inkgraph.functions.inlines import decode_reference
from inkgraph.functions.sections import owned_links, section_tree


def shape(text: str) -> list[tuple]:
    doc = parse(text)
    return [(b.kind, doc.offsets(b.start), doc.offsets(b.end)) for b in doc.blocks]


def targets(text: str) -> list[str]:
    doc = parse(text)
    return [link[2] for block in doc.blocks for link in links(doc, block)]


def kinds(text: str) -> list[str]:
    return [n[4] for n in nodes(parse(text)) if n[3] == "inline"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("  \n\t\r\n\n", []),
        ("   text  ", [("paragraph", 3, 9)]),
        ("one\r\ntwo\r\n", [("paragraph", 0, 8)]),
        ("####### x\n#foo", [("paragraph", 0, 14)]),
        ("## ##", [("heading", 0, 5)]),
        ("   ### x", [("heading", 3, 8)]),
        ("    ### x", [("code", 4, 9)]),
        ("one\ntwo\n---", [("heading", 0, 11)]),
        ("[foo]: /url\nbar\n===\n\n[foo]", [("heading", 12, 19), ("paragraph", 21, 26)]),
        ("[foo]: /url\n===", [("paragraph", 12, 15)]),
        ("[foo]: /url\n---", [("break", 12, 15)]),
        ("foo\n-", [("heading", 0, 5)]),
        ("foo\n+", [("paragraph", 0, 5)]),
        ("foo\n2. bar", [("paragraph", 0, 10)]),
        ("foo\n1. bar", [("paragraph", 0, 3), ("list", 4, 10)]),
        ("> foo\n===", [("quote", 0, 9)]),
        ("> foo\n---", [("quote", 0, 5), ("break", 6, 9)]),
        ("- a\n\n", [("list", 0, 3)]),
        ("- a\n\n  b\n\nc", [("list", 0, 8), ("paragraph", 10, 11)]),
        ("* a\n* * *\nb", [("list", 0, 3), ("break", 4, 9), ("paragraph", 10, 11)]),
        ("```\na\n```\nb", [("code", 0, 9), ("paragraph", 10, 11)]),
        ("    a\n\n    b\n\nc", [("code", 4, 12), ("paragraph", 14, 15)]),
        ("foo\n:-:", [("table", 0, 7)]),
        ("---\ntitle: Notes\n", []),
        ("﻿# x", [("paragraph", 0, 6)]),
        ("é\n# ü", [("paragraph", 0, 2), ("heading", 3, 7)]),
        ("# a\r# b\r\n# c", [("heading", 0, 3), ("heading", 4, 7), ("heading", 9, 12)]),
        ("[a]: /x\n[b]: <y z> 'title'\n\n# A", [("heading", 28, 31)]),
        ("> # in\n\n# out", [("quote", 0, 6), ("heading", 8, 13)]),
    ],
)
def test_blocks(text, expected):
    assert shape(text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("[[Note]]", ["Note"]),
        ("[[Note|shown]]", ["Note"]),
        ("[[ a |]]", [" a "]),
        ("[[x]](y)", ["x"]),
        ("[[unclosed", []),
        ("[[]]", []),
        ("[[|x]]", []),
        ("[[a\nb]]", []),
        ("![[e]]", []),
        ("\\[[x]]", []),
        ("`[[x]]` $[[y]]$", []),
        ("http://a.b/[[z]]", []),
        ("**[[in]]** ==[[hi]]== ~~[[st]]~~ [a [[w]]](c)", ["in", "hi", "st", "w"]),
        ("# h [[h]]\n\n> q [[q]]\n\n- l [[l]]\n\n| a |\n|---|\n| [[t]] |\n\n[^n]: f [[f]]", ["h", "q", "l", "t", "f"]),
        ("intro\n*a*|`b`|[[C]]\n---|---|---\nx \\| y|z|w", ["C"]),
        ("```\n[[x]]\n```", []),
        ("[^a]\n\n[^a]: see [[x#y]]", ["x#y"]),
    ],
)
def test_wikilinks(text, expected):
    assert targets(text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("# A *b* &amp; `c` [d](e) ==f== $x$", "A b & c d f x"),
        ("# a\\*b &#35; &#x41; &nope;", "a*b # A &nope;"),
        ("# [[t|label]] [[t]] <http://x.y> ![alt](u)", "label t http://x.y alt"),
        ("two\nlines\n===", "two lines"),
        ("# [r][] and [s] and [u]\n\n[r]: /r\n[s]: /s", "r and s and [u]"),
        ("# a_b_c _d_ __e__ ***f***", "a_b_c d e f"),
        ("# $5 and $6", "$5 and $6"),
    ],
)
def test_heading_text(text, expected):
    doc = parse(text)
    assert heading_text(doc, next(b for b in doc.blocks if b.kind == "heading")) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("$ x$", ["text"]),
        ("$x $", ["text"]),
        ("$x$5", ["text"]),
        ("$x$", ["math"]),
        ("$$x$$", ["math"]),
        ("a  \nb", ["text", "hard", "text"]),
        ("a\\\nb", ["text", "hard", "text"]),
        ("a\nb", ["text", "soft", "text"]),
        ("``a`b``", ["code"]),
        ("~~a~~", ["strike", "text"]),
        ("<me@x.org>", ["autolink"]),
        ("www.a.com.", ["autolink", "text"]),
    ],
)
def test_inlines(text, expected):
    assert kinds(text) == expected


def test_references():
    assert decode_reference("&amp;") == "&"
    assert decode_reference("&#0;") == "�"
    assert decode_reference("&amp") is None
    assert decode_reference("x&amp;") is None


def test_many_delimiters_are_fast():
    start = time.perf_counter()
    doc = parse("*a" * 2000)
    doc.inlines(doc.blocks[0])
    assert time.perf_counter() - start < 1


NESTED = "intro\n\n# Player\nlead\n\n## Skills\nskill intro\n\n### Gun\nbang\n\n### Gun\nbang2\n\n## Inventory\nitems"


def test_section_paths():
    tree = section_tree(parse(NESTED))
    assert [s.heading_path for s in tree] == [
        "Preamble", "Player", "Player > Skills", "Player > Skills > Gun", "Player > Skills > Gun[2]", "Player > Inventory",
    ]
    assert [s.parent_ord for s in tree] == [None, None, 1, 2, 2, 1]
    assert (tree[1].start, tree[1].end) == (7, len(NESTED))
    assert [s.heading_path for s in section_tree(parse("# Root\n\n### Deep\nbody"))] == ["Root", "Root > Deep"]
    assert [s.heading_path for s in section_tree(parse("x\n\n# Preamble"))] == ["Preamble", "Preamble[2]"]
    assert [s.heading_path for s in section_tree(parse("first\n\nsecond"))] == ["Preamble"]
    assert [s.heading_path for s in section_tree(parse("# Gun\n# Gun\n# Gun[2]"))] == ["Gun", "Gun[2]", "Gun[2]"]
    assert [s.heading_path for s in section_tree(parse("#\n## a"))] == ["", "a"]
    assert section_tree(parse("---\nopen")) == []


def test_setext_heading_span():
    one = section_tree(parse("Title\n=====\nbody line"))[0]
    assert (one.heading_start, one.heading_end, one.line_start, one.line_end) == (0, 11, 1, 3)


def test_front_matter():
    assert metadata(parse("---\ntags: [character]\nlevel: 3\n---\n# P"))[0] == '{"level": 3, "tags": ["character"]}'
    data, error = metadata(parse("---\ntags: [broken\n---\n# Still indexed\nbody"))
    assert data is None and error.startswith("invalid YAML frontmatter: ")
    assert metadata(parse("# no")) == (None, None)
    assert metadata(parse("---\nyes: no\n---\n"))[0] == '{"yes": "no"}'
    assert [d[0] for d in parse("---\nx").diagnostics] == ["UnterminatedFrontmatter"]
    assert [d[0] for d in parse("```\nx").diagnostics] == ["UnclosedCodeFence"]


def test_blake3():
    assert blake3_hex(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    data = bytes(i % 251 for i in range(3072))
    assert blake3_hex(data) == "b98cb0ff3623be03326b373de6b9095218513e64f1ee2edd2525c7ad1e5cffd2"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab#->*_`~=[]()|\\!$&:é\n\r\t 1.", max_size=60))
def test_spans_nest(text):
    """Rows of the tree are in order, inside their parents and on character boundaries."""
    doc = parse(text)
    data = text.encode()
    rows = nodes(doc)
    for node_id, parent, _, _, _, start, end, _, _ in rows:
        assert 0 <= start <= end <= len(data)
        data[:start].decode()
        data[:end].decode()
        if parent is not None and rows[parent][3] == "block" and rows[node_id][3] == "block":
            assert rows[parent][5] <= start and end <= rows[parent][6]
    tops = [(r[5], r[6]) for r in rows if r[1] is None]
    assert all(a[1] <= b[0] for a, b in zip(tops, tops[1:], strict=False))
    section_tree(doc)


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("zip: 08123", '{"zip": 8123}'),
        ("1: a\nb: c\ntrue: 1\n~: 2", '{"1": "a", "b": "c", "null": 2, "true": 1}'),
        ("a: 010\nb: 0x1F\nc: 0o17\nd: +5\ne: -0", '{"a": 10, "b": 31, "c": 15, "d": 5, "e": -0}'),
        ("a: .inf\nb: -.INF\nc: .nan\nd: .5\ne: 3.\nf: 1e3", '{"a": 1e999, "b": -1e999, "c": null, "d": 0.5, "e": 3.0, "f": 1e3}'),
        ("a: !!timestamp 99\nb: !!str 5\nc: '5'\nd: !own x\ne: !!int '7'", '{"a": "99", "b": "5", "c": "5", "d": "x", "e": 7}'),
        ("a: &x [1, 2]\nb: *x", '{"a": [1, 2], "b": [1, 2]}'),
        ("- a\n- {b: [~]}", '["a", {"b": [null]}]'),
        ("yes: on\ndate: 2001-01-01\ntime: 1:30", '{"date": "2001-01-01", "time": "1:30", "yes": "on"}'),
        ("", None),
    ],
)
def test_front_matter_values(source, expected):
    assert metadata(parse(f"---\n{source}\n---\n")) == (expected, None)


@pytest.mark.parametrize("source", ["a: &x [*x]", "a: 1\na: 2", "? [a]\n: b", "a: " + "[" * 5000, "a: " + "[" * 5000 + "]" * 5000, "a: !!int x", "\tbad: 1", "a: *none", "x: &a [" + "1," * 400 + "]\ny: &b [" + "*a," * 400 + "]\nz: [" + "*b," * 400 + "]"])
def test_front_matter_errors_are_told(source):
    value, error = metadata(parse(f"---\n{source}\n---\n# A"))
    assert value is None and error.startswith("invalid YAML frontmatter: ")


#: Documents that nest deeply or repeat what is costly, each of them about 20 KB to 1 MB.
HOSTILE = {
    "list markers": "- " * 10_000 + "x [[y]]", "quote markers": ">" * 10_000 + " x [[y]]", "stars": "* " * 10_000 + "x", "nested lists": "".join("  " * i + "- a\n" for i in range(1000)),
    "brackets": "[" * 20_000 + "[[a]]", "dead brackets": "[ " * 5000 + "[a](b) " * 5000 + "[[x]]", "delimiters": "*a _b " * 5000 + "[[x]]", "emphasis": "*a **b " * 3000 + " c** d*" * 3000 + "[[x]]",
    "definitions": "".join(f"[a{i}]: /x{i}\n" for i in range(8000)), "paragraph": "some words in a line [[w]] and so on to the end\n" * 20_000, "line": "word [[w]] " * 60_000,
    "address": "www.a.com/" + ")" * 50_000 + " [[x]]", "table": "|a" * 20_000 + "\n" + "|-" * 20_000 + "\n" + "|b" * 20_000, "backslashes": "a|" + "\\" * 50_000 + "|\n-|-\n",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_documents_are_fast(name):
    text = HOSTILE[name]
    start = time.perf_counter()
    doc = parse(text)
    assert len(nodes(doc)) > 0 or name == "definitions"
    owned_links(doc, section_tree(doc))
    assert time.perf_counter() - start < 1 + 8 * len(text) / 1e6


def test_blake3_of_many():
    data = [bytes(i * 7 % 251 for i in range(n)) for n in (0, 1, 64, 1023, 1024, 1025, 2048, 5000, 70_000)]
    assert blake3_many(data) == [blake3_hex(d) for d in data] and blake3_many([]) == []
    assert blake3_hex(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"

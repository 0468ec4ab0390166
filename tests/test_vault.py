from __future__ import annotations

import hashlib
import io
import json
import os

import pytest
from pyspark.sql import functions as F

from inkgraph.functions import text as X
from inkgraph.functions.blake3 import blake3_hex
from inkgraph.operators.edit import EditRejected, apply_edit, escaping_heading
from inkgraph.functions.document import parse
from inkgraph.functions.sections import section_tree
from inkgraph.operators.search import search, search_many
from inkgraph.plans.vault import NotFound, Vault
from inkgraph.sources.vault import VaultError, list_markdown, read_store

HERBS = (
    "---\nkind: [plant]\n---\n# Basil\nLikes warmth.\n\n## Sowing\nIn spring, under glass.\n\n## Harvest\nBefore it flowers.\n\n"
    "# Care\nSee [[soil]], [[soil#Mixing]], [[#Basil]], [[gone]], [[soil#Absent]] and [[water#Timing]].\n"
)
FILES = {
    "herbs.md": HERBS,
    "beds/soil.md": "# Soil\n\n## Mixing\nTwo parts compost.\n",
    "beds/water.md": "# Water\n\n## Timing\nIn the morning.\n\n## Timing\nIn the evening.\n",
    "list.txt": "# No vault file",
}


def save(root, files):
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8", newline="") as out:
            out.write(text)


@pytest.fixture
def folder(tmp_path):
    save(tmp_path, FILES)
    return str(tmp_path)


def test_tables(spark, folder):
    vault = Vault(spark, folder)
    assert [r["file"] for r in vault.files().collect()] == ["beds/soil.md", "beds/water.md", "herbs.md"]
    rows = {(r["file"], r["heading_path"]): r for r in vault.snapshot.sections.collect()}
    sowing, own = rows["herbs.md", "Basil > Sowing"], "## Sowing\nIn spring, under glass."
    at = HERBS.index(own)
    assert (sowing["start"], sowing["end"], sowing["line_start"], sowing["line_end"]) == (at, at + len(own), 7, 8)
    assert sowing["content_hash"] == hashlib.sha256(own.encode()).hexdigest() and len(rows) == 9
    edges = {tuple(r) for r in vault.snapshot.backlinks.select("target_file", "from_heading_path", "raw_target", "target_heading_path").collect()}
    assert edges == {("beds/soil.md", "Care", "soil", None), ("beds/soil.md", "Care", "soil#Mixing", "Soil > Mixing"), ("herbs.md", "Care", "#Basil", "Basil")}
    said = [r["message"] for r in vault.diagnostics().collect()]
    assert len(said) == 3 and any(m.endswith("no file matches 'gone'") for m in said) and any(m.endswith("no heading named 'Absent'") for m in said)
    assert any(m.endswith("heading 'Timing' is ambiguous: Water > Timing, Water > Timing[2]") for m in said)


def test_search_and_lookups(spark, folder):
    vault = Vault(spark, folder)
    found = lambda q: [(r["score"], r["file"], r["heading_path"]) for r in vault.search(q).collect()]
    assert found("harvest basil") == [(20200, "herbs.md", "Basil > Harvest"), (10101, "herbs.md", "Basil"), (10101, "herbs.md", "Basil > Sowing")]
    assert found("Basil > Harvest")[0] == (40000, "herbs.md", "Basil > Harvest")
    assert found("mixing")[0] == (30000, "beds/soil.md", "Soil > Mixing") and [s for s, *_ in found("timing")] == [30000, 30000]
    assert [s for s, *_ in found("sow")] == [20000] and found("?!") == []
    got = vault.get_section("./herbs.md", "Basil > Harvest")
    assert got["content"] == "## Harvest\nBefore it flowers." and got["provenance"]["line_range"] == {"start": 10, "end": 11}
    with pytest.raises(NotFound) as error:
        vault.get_section("herbs.md", "Basil > Sawing")
    assert error.value.suggestions == ["Basil > Sowing", "Basil > Harvest", "Basil"]
    with pytest.raises(NotFound, match="file 'herb.md' is not indexed"):
        vault.outline("herb.md")
    assert [(r["heading"], r["line_start"], r["line_end"]) for r in vault.outline("herbs.md").collect()] == [("Basil", 4, 11), ("Sowing", 7, 8), ("Harvest", 10, 11), ("Care", 13, 14)]
    assert vault.backlinks("beds/soil.md").count() == 2
    assert vault.backlinks("beds/soil.md", "Soil > Mixing").count() == 1
    assert vault.backlinks("beds/soil.md", "No such").count() == 0


def test_edit_and_reindex(spark, folder):
    vault = Vault(spark, folder)
    before = vault.get_section("herbs.md", "Basil > Sowing")["provenance"]["content_hash"]
    rows = vault.edit_section("herbs.md", "Basil > Sowing", "Outdoors in May.", before).collect()
    assert [(r["heading_path"], r["line_start"]) for r in rows] == [("Basil", 4), ("Basil > Sowing", 7), ("Basil > Harvest", 10), ("Care", 13)]
    with open(os.path.join(folder, "herbs.md")) as file:
        assert file.read() == HERBS.replace("In spring, under glass.", "Outdoors in May.")
    assert not [f for f in os.listdir(folder) if f.endswith("tmp")]
    with pytest.raises(EditRejected) as error:
        vault.edit_section("herbs.md", "Basil > Sowing", "x", before)
    assert error.value.kind == "conflict" and error.value.current_hash == rows[1]["content_hash"]
    with pytest.raises(NotFound):
        vault.edit_section("../herbs.md", "Basil", "x", before)
    save(folder, {"beds/soil.md": FILES["beds/soil.md"] + "\n## Absent\nx\n\n### Below\ny\n", "tools.md": "# T"})
    os.unlink(os.path.join(folder, "beds/water.md"))
    changes = vault.reindex()
    inside = {"file": "beds/soil.md", "sections_added": ["Soil > Absent"], "sections_removed": [], "sections_modified": []}
    assert changes == {"files_added": ["tools.md"], "files_removed": ["beds/water.md"], "files_changed": [inside]}
    assert vault.backlinks("beds/soil.md").count() == 3
    assert vault.reindex() == {"files_added": [], "files_removed": [], "files_changed": []}


def test_index_is_the_state_when_it_was_read(spark, folder):
    save(folder, {"broken.md": "---\na: [\n---\n# B\n"})
    with open(os.path.join(folder, "bytes.md"), "wb") as out:
        out.write(b"# \xff")
    os.mkfifo(os.path.join(folder, "pipe.md"))
    vault = Vault(spark, folder)
    save(folder, {"beds/soil.md": "# Soil\n\n## Mixing\nThree parts.\n"})
    assert vault.get_section("beds/soil.md", "Soil > Mixing")["content"] == "## Mixing\nTwo parts compost."
    assert vault.search("timing").count() == 2
    inside = {"file": "beds/soil.md", "sections_added": [], "sections_removed": [], "sections_modified": ["Soil > Mixing"]}
    assert vault.reindex() == {"files_added": [], "files_removed": [], "files_changed": [inside]}
    before = {tuple(r) for r in vault.diagnostics().collect()}
    assert {f for f, _ in before} >= {"bytes.md", "herbs.md", "broken.md"}
    save(folder, {"plain.txt": "# Plain\n[[soil]]"})
    vault.reindex_file("./plain.txt")
    assert {tuple(r) for r in vault.diagnostics().collect()} == before
    assert vault.backlinks("beds/soil.md").count() == 3
    with pytest.raises(NotFound) as error:
        vault.reindex_file("beds/sail.md")
    assert error.value.suggestions[0] == "beds/soil.md"
    with pytest.raises(NotFound):
        vault.reindex_file("../herbs.md")


def test_many_replacements(spark, folder, monkeypatch):
    monkeypatch.setattr("inkgraph.plans.vault.REPLACED", 2)
    vault = Vault(spark, folder)
    for i in range(3):
        path = "Soil > Mixing"
        rows = vault.edit_section("beds/soil.md", path, f"Body {i}", vault.get_section("beds/soil.md", path)["provenance"]["content_hash"])
        assert rows.count() == 2
    assert vault.get_section("beds/soil.md", path)["content"] == "## Mixing\nBody 2"
    assert vault.files().count() == 3 and vault.backlinks("beds/soil.md").count() == 2
    assert vault.reindex() == {"files_added": [], "files_removed": [], "files_changed": []}


def _hash(text, path):
    return next(s.content_hash for s in section_tree(parse(text)) if s.heading_path == path)


def test_edit_rules():
    crlf = "# Tea\r\ngreen\r\n\r\n# Milk\r\nwhole"
    assert apply_edit("f", crlf, "Tea", "black\n\n", _hash(crlf, "Tea")) == "# Tea\r\nblack\r\n\r\n# Milk\r\nwhole"
    assert apply_edit("f", crlf, "Tea", "\t\n", _hash(crlf, "Tea")) == "# Tea\r\n\r\n# Milk\r\nwhole"
    assert apply_edit("f", crlf, "Milk", "## Oat", _hash(crlf, "Milk")).endswith("# Milk\r\n## Oat")
    for body in ("### Equal", "## Above\nx", "Under\n===", "x\n\n---\nUnder\n---"):
        assert escaping_heading(body, 3)
    for body in ("#### Below\nx", "- # In a list", "```\n# code\n```", "words"):
        assert not escaping_heading(body, 3)
    # an open fence, or a line that becomes part of the next heading, takes in what follows the section
    glued = "# A\n> quote\nTitle\n=====\nb"
    for path, body, kind in (("A", "~~~\nopen", "restructure"), ("B", "x", "not_found"), ("A", "Two\n===", "escape")):
        with pytest.raises(EditRejected) as error:
            apply_edit("f", glued if kind != "restructure" else "# A\nx\n# C\ny", path, body, _hash(glued if kind != "restructure" else "# A\nx\n# C\ny", "A"))
        assert error.value.kind == kind
    with pytest.raises(EditRejected) as error:
        apply_edit("f", "words\n\n# A", "Preamble", "x", "")
    assert error.value.kind == "invalid_target"


def test_diff_rules(spark):
    def changes(old, new):
        make = lambda rows: spark.createDataFrame(rows, "file string, text string")
        vault = Vault(spark, docs=make(old))
        out = vault.reindex(make(new))
        return {c["file"]: (c["sections_added"], c["sections_removed"], c["sections_modified"]) for c in out["files_changed"]}

    before = "# Tea\nhot\n\n## Green\nmild\n\n## Black\nstrong\n\n# Milk\ncold"
    after = "# Tea\nhot\n\n## Green\nvery mild\n\n## Black\nstrong\n\n# Juice\ncold\n\n## Apple\nx"
    assert changes([("d.md", before)], [("d.md", after)]) == {"d.md": (["Juice"], ["Milk"], ["Tea > Green"])}
    assert changes([("d.md", "# Tea\nhot")], [("d.md", "# Tea\nhot\n\n## Cups\na\n\n### Small\nb")]) == {"d.md": (["Tea > Cups"], [], [])}
    assert changes([("d.md", "# Tea\nhot")], [("d.md", "# Tea\ncold")]) == {"d.md": ([], [], ["Tea"])}
    assert changes([("d.md", "# Tea\n\nhot")], [("d.md", "# Tee\n\nhot")]) == {"d.md": (["Tee"], ["Tea"], [])}
    assert changes([("d.md", "---\nx: 1\n---\n# Tea\n\n# Milk")], [("d.md", "---\nx: 2\n---\n# Tea\n\n\n\n# Milk")]) == {}


def test_link_resolution(spark):
    docs = [
        ("a.md", "# A\n## B#C\n\n[[x/b]] [[x/b.md]] [[b]] [[b.md]] [[#B#C]] [[c#]] [[Foo.MD]] [[dup]] [[no/pe]] [[#Preamble]]"),
        ("x/b.md", "pre\n\n#\ntext"), ("c.md", "#\ntext"), ("Foo.MD", "# F"), ("d/dup.md", "x"), ("e/dup.md", "x"),
    ]
    vault = Vault(spark, docs=spark.createDataFrame(docs, "file string, text string"))
    rows = {r["raw_target"]: (r["target_file"], r["target_heading_path"], r["reason"]) for r in vault.snapshot.resolved.collect()}
    assert rows["x/b"] == rows["x/b.md"] == rows["b"] == ("x/b.md", None, None)
    assert rows["b.md"][2] == "no file matches 'b.md'"
    assert rows["#B#C"] == ("a.md", "A > B#C", None)
    assert rows["c#"] == ("c.md", "", None)
    assert rows["Foo.MD"] == ("Foo.MD", None, None)
    assert rows["dup"][2] == "'dup' matches multiple files: d/dup.md, e/dup.md"
    assert rows["no/pe"][2] == "no file matches path 'no/pe'"
    assert rows["#Preamble"][2] == "no heading named 'Preamble'"


def test_sources(spark, tmp_path):
    with pytest.raises(VaultError, match="does not exist"):
        Vault(spark, str(tmp_path / "none"))
    (tmp_path / "file").write_text("x")
    with pytest.raises(VaultError, match="is not a directory"):
        list_markdown(str(tmp_path / "file"))
    root = tmp_path / "v"
    save(root, {"A.MD": "# A", ".hid/h.md": "# H", "sub/x.txt": "no"})
    (root / "bad.md").write_bytes(b"\xff\xfe")
    os.symlink(root / "A.MD", root / "link.md")
    vault = Vault(spark, str(root))
    assert [r["file"] for r in vault.files().collect()] == [".hid/h.md", "A.MD"]
    assert [(r["file"], r["message"][:29]) for r in vault.diagnostics().collect()] == [("bad.md", "failed to read Markdown file:")]
    good, bad = read_store(spark, str(root))
    assert {r["file"] for r in good.collect()} == {"A.MD", "link.md"} and bad.count() == 1


def test_scalar_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.normalize_path(F.lit("a\\.//b/./c.md"))) == "a/b/c.md"
    assert one(X.normalize_path(F.lit("a/../b"))) is None
    assert one(X.tokens(F.lit("Ab-Cd é2 ΑΣ"))) == ["ab", "cd", "é2", "ασ"]
    assert one(X.prefixes(F.lit("A > > B > C"))) == ["A", "A >", "A > > B"]
    assert one(X.target_heading(F.lit("A#B#C"))) == "B#C" and one(X.target_heading(F.lit("A"))) is None


def test_folders_are_walked_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("inkgraph.sources.vault.FOLDERS", 2)
    save(tmp_path, {f"{a}/{b}/{c}.md": f"# {a}{b}{c}" for a in "xyz" for b in "pq" for c in "12"} | {"top.md": "# top"})
    assert [r["file"] for r in Vault(spark, str(tmp_path)).files().collect()] == sorted([f"{a}/{b}/{c}.md" for a in "xyz" for b in "pq" for c in "12"] + ["top.md"])


def test_search_many_matches_single_searches(spark):
    docs = [(f"{i}.md", f"# {h}\n\n## {h[::-1]} part\n") for i, h in enumerate(["Apple pie", "Applesauce", "Pie chart", "ap", "Äpfel", "a", "chart-2 part"])]
    sections = Vault(spark, docs=spark.createDataFrame(docs, "file string, text string")).snapshot.sections
    asked = ["apple", "pie a", "applesauces", "part", "äpf x", "?", "chart 2", "ap ap"]
    found = search_many(sections, spark.createDataFrame(list(enumerate(asked)), "query_id int, query string"))
    rows = {}
    for r in found.orderBy("query_id", "rank").collect():
        rows.setdefault(r["query_id"], []).append((r["score"], r["file"], r["heading_path"]))
    for i, query in enumerate(asked):
        assert rows.get(i, []) == [(r["score"], r["file"], r["heading_path"]) for r in search(sections, query).collect()]
    assert search_many(sections, spark.createDataFrame([], "query_id int, query string")).count() == 0


def test_stream(spark, tmp_path):
    """A version may come in several files; it is told once a later one has come, also after a restart."""
    from inkgraph.streaming.reindex import stream_changes

    folder, store = str(tmp_path / "in"), str(tmp_path / "store")
    told = []
    tell = lambda files, sections, version: told.append((version, sorted(map(tuple, files.collect())), sorted(map(tuple, sections.collect()))))

    def arrive(*rows):
        spark.createDataFrame(rows, "version long, file string, text string").repartition(2).write.mode("append").parquet(folder)

    arrive((1, "a.md", "# A\nx"), (1, "plain.md", ""))
    query = stream_changes(spark, folder, store, tell)
    query.processAllAvailable()
    assert told == []
    arrive((2, "a.md", "# A\ny"))
    query.processAllAvailable()
    assert told == [(1, [("added", "a.md"), ("added", "plain.md")], [])]
    query.stop()
    arrive((2, "b.md", "# B"), (2, "plain.md", ""))
    query = stream_changes(spark, folder, store, tell)
    query.processAllAvailable()
    assert len(told) == 1
    arrive((3, "b.md", "# B"))
    query.processAllAvailable()
    arrive((4, "b.md", "# B"))
    query.processAllAvailable()
    query.stop()
    assert told[1:] == [(2, [("added", "b.md")], [("a.md", "modified", "A")]), (3, [("removed", "a.md"), ("removed", "plain.md")], [])]


def test_cli(spark, folder, monkeypatch, capsys):
    from inkgraph.cli import main

    assert main(["nonsense"]) == 1
    call = lambda i, name, **a: {"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": name, "arguments": a}}
    asked = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {"protocolVersion": "2025-03-26"}}, {"jsonrpc": "2.0", "method": "notifications/initialized"},
        {"jsonrpc": "2.0", "id": 2, "method": "tools/list"}, call(3, "search", query="Sowing"), call(4, "get_section", file="herbs.md", heading_path="No"),
        call(5, "outline", file="beds/water.md"), call(6, "backlinks", file="beds/soil.md"), call(7, "reindex_vault"), call(8, "x"), call(9, "outline"),
        {"jsonrpc": "2.0", "id": 10, "method": "nope"},
    ]
    monkeypatch.setattr("sys.stdin", io.StringIO("\n".join(map(json.dumps, asked)) + "\n{\n"))
    assert main(["serve", folder]) == 0
    said = {m["id"]: m for m in map(json.loads, capsys.readouterr().out.splitlines())}
    assert len(said) == 11 and said[1]["result"]["protocolVersion"] == "2025-03-26" and len(said[2]["result"]["tools"]) == 6
    got = {i: json.loads(said[i]["result"]["content"][0]["text"]) for i in range(3, 10)}
    first, own = got[3]["results"][0], "## Sowing\nIn spring, under glass."
    assert first["score"] == 30000 and first["provenance"]["byte_range"] == {"start": HERBS.index(own), "end": HERBS.index(own) + len(own)}
    assert first["provenance"]["content_hash"] == blake3_hex(own.encode())
    assert got[4]["suggestions"] and said[4]["result"]["isError"] and said[8]["result"]["isError"] and said[9]["result"]["isError"]
    assert [c["heading_path"] for c in got[5]["sections"][0]["children"]] == ["Water > Timing", "Water > Timing[2]"]
    assert got[5]["sections"][0]["line_range"] == {"start": 1, "end": 7}
    assert len(got[6]["backlinks"]) == 2 and got[7]["files_added"] == [] and "error" in said[10] and said[None]["error"]["code"] == -32700

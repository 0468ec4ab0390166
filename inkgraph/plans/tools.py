"""The tools of the server, the folder source and the sink over folders and tables made from regions and nations."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgraph import cli
from inkgraph.operators import parse
from inkgraph.plans.vault import Vault
from inkgraph.sources import vault as source


def _folder(spark: SparkSession) -> str:
    """A fresh folder that tasks can read too: below a checkpoint folder of this machine, if there is one."""
    base = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file:")
    base = "/" + base.lstrip("/") if base.startswith("/") else None
    if base:
        os.makedirs(base, exist_ok=True)
    path = tempfile.mkdtemp(prefix="folder-", dir=base)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def _save(root: str, name: str, data: bytes) -> None:
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(data)


def _keys(spark: SparkSession, sf_dir: str, name: str) -> list[tuple[int, str]]:
    """Keys and names of regions or nations, five and twenty-five rows at any scale."""
    prefix = name[0]
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(f"{prefix}_{name}key", f"{prefix}_name")
    return sorted((r[0], r[1]) for r in rows.collect())


def folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, sha256, message) of a folder with files of any case, hidden folders, other names, links and bytes that are
    no text; of the latter the message's fixed part."""
    root = _folder(spark)
    for key, name in _keys(spark, sf_dir, "nation"):
        _save(root, f"n/{key}.md", f"# {name}\r\né\n".encode())
        _save(root, f"n/deep/{key % 3}/.hid/{key}.Md", name.encode())
        _save(root, f"n/{key}.txt", b"no")
        _save(root, f"_x/{key}.md", b"\xff\xfe" if key % 4 == 0 else b"")
        os.symlink(os.path.join(root, f"n/{key}.md"), os.path.join(root, f"n/link{key}.md"))
    os.symlink(os.path.join(root, "n"), os.path.join(root, "linked"))
    docs, said = source.read_folder(spark, root)
    none = F.lit(None).cast("string")
    return docs.select("file", F.sha2("text", 256).alias("sha256"), none.alias("message")).union(said.select("file", none, F.regexp_extract("message", "^failed to read Markdown file: ", 0)))


def region_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, text): regions and nations, which link to their region; one file a key."""
    c = F.col
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.concat(F.lit("r/"), c("r_regionkey"), F.lit(".md")).alias("file"), F.concat(F.lit("# "), c("r_name"), F.lit("\n\n## Note\nkept\n")).alias("text"))
    nation = F.concat(F.lit("# "), c("n_name"), F.lit("\nSee [[r/"), c("n_regionkey"), F.lit("]] and [[r/"), c("n_regionkey"), F.lit("#Note]] and [[gone]].\n"))
    return regions.union(spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("n/"), c("n_nationkey"), F.lit(".md")).alias("file"), nation.alias("text")))


def _said(spark: SparkSession, rows: list[tuple[str, str, tuple[dict, bool]]]) -> DataFrame:
    """(tool, request, result, failed) with the result as JSON of sorted keys."""
    flat = [(tool, request, json.dumps(result, sort_keys=True, ensure_ascii=False), failed) for tool, request, (result, failed) in rows]
    return spark.createDataFrame(flat, "tool string, request string, result string, failed boolean")


def tool_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the reading tools for each region, and to requests that fail."""
    vault = Vault(spark, docs=region_vault(spark, sf_dir))
    out = []
    for key, name in _keys(spark, sf_dir, "region"):
        file = f"r/{key}.md"
        asked = [
            ("outline", {"file": f".//r\\{key}.md"}), ("get_section", {"file": file, "heading_path": f"{name} > Note"}), ("search", {"query": f"note {name.lower()}"}),
            ("backlinks", {"file": file}), ("backlinks", {"file": file, "heading_path": f"{name} > Note"}), ("backlinks", {"file": file, "heading_path": "none"}),
            ("get_section", {"file": file, "heading_path": f"{name} > Nota"}), ("outline", {"file": f"r/{key}.m"}),
        ]
        out += [(tool, f"{file} {i}", cli.answer(vault, tool, a)) for i, (tool, a) in enumerate(asked)]
    vault.snapshot.close()
    return _said(spark, out)


def tool_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to edits, stale ones too, and to reading a folder again whose files were edited, added and removed."""
    root, regions = _folder(spark), _keys(spark, sf_dir, "region")
    for key, name in regions:
        _save(root, f"r{key}.md", f"# {name}\n\n## Note\nkept\n\n## Rest\n".encode())
    vault = Vault(spark, root)
    out = []
    for key, name in regions:
        path = f"{name} > Note"
        good = vault.get_section(f"r{key}.md", path)["provenance"]["content_hash"]
        edit = {"file": f"r{key}.md", "heading_path": path, "body": f"new {key}\n\n", "expected_hash": good if key % 2 == 0 else "stale"}
        out.append(("edit_section", f"r{key}", cli.answer(vault, "edit_section", edit)))
    _save(root, "s.md", b"# S\n")
    os.unlink(os.path.join(root, "r0.md"))
    _save(root, "r1.md", f"# {regions[1][1]}\n\n## Rest\n\n## More\n\n### Sub\n".encode())
    vault.reindex_file("r3.md")
    out.append(("reindex_vault", "", cli.answer(vault, "reindex_vault", {})))
    out.append(("reindex_vault", "again", cli.answer(vault, "reindex_vault", {})))
    for key, _ in regions[1:]:
        with open(os.path.join(root, f"r{key}.md"), "rb") as file:
            out.append(("file", f"r{key}", (file.read().decode(), False)))
    return _said(spark, out)


def vault_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(place, file, message) of a vault's diagnostics, in their order."""
    vault = Vault(spark, docs=region_vault(spark, sf_dir).union(spark.createDataFrame([("a.md", "---\na: 1\na: 2\n---\n# A\n")], "file string, text string")))
    rows = [(i, r["file"], r["message"]) for i, r in enumerate(vault.diagnostics().collect())]
    vault.snapshot.close()
    return spark.createDataFrame(rows, "place int, file string, message string")


def vault_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All changes between two states, with paths that several sections share."""
    old = region_vault(spark, sf_dir)
    twice = F.concat("text", F.when(F.col("file") == "r/1.md", F.lit("## X\na\n\n## X[2]\nb\n\n## X\nc\n")).otherwise(F.lit("")))
    first = old.where("file <> 'r/2.md'").select("file", twice.alias("text"))
    text = F.when(F.col("file") == "r/0.md", F.replace("text", F.lit("kept"), F.lit("lost"))).when(F.col("file") == "r/1.md", F.concat("text", F.lit("## X\na\n\n## X\nnew\n"))).otherwise(F.col("text"))
    state = lambda p: SimpleNamespace(files=p.select("file"), sections=parse.sections(p))
    return Vault.changes(state(parse.parse_documents(first)), state(parse.parse_documents(old.where("file <> 'r/3.md'").select("file", text.alias("text")))))


QUERIES = {f.__name__: f for f in (folder_scan, tool_reads, tool_writes, vault_messages, vault_changes)}


# ---- SQL

_NL = "chr(10)"


def _object(**values: str) -> str:
    """SQL of a JSON object, keys sorted, of SQL of its values."""
    return "'{' || " + " || ', ' || ".join(f"""'"{k}": ' || {v}""" for k, v in sorted(values.items())) + " || '}'"


def _string(value: str) -> str:
    return f"""'"' || replace({value}, {_NL}, '\\n') || '"'"""


def _range(start: str, end: str) -> str:
    return _object(start=f"CAST({start} AS VARCHAR)", end=f"CAST({end} AS VARCHAR)")


def _node(heading: str, path: str, level: int, lines: tuple[str, str], children: str, **more: str) -> str:
    return _object(heading=_string(heading), heading_path=_string(path), level=f"'{level}'", line_range=_range(*lines), children=f"'[' || {children} || ']'", **more)


def _provenance(file: str, path: str, spans: tuple[str, str], lines: tuple[str, str], content: str) -> str:
    return _object(file=_string(file), heading_path=_string(path), byte_range=_range(*spans), line_range=_range(*lines), content_hash=_string(f"sha256({content})"))


def _reads_sql() -> str:
    file = "'r/' || r_regionkey || '.md'"
    note, path = f"'## Note' || {_NL} || 'kept'", "r_name || ' > Note'"
    start = "strlen(r_name) + 4"
    provenance = _provenance(file, path, (start, "strlen(r_name) + 16"), ("3", "4"), note)
    whole = _provenance(file, "r_name", ("0", "strlen(r_name) + 16"), ("1", "4"), f"'# ' || r_name || {_NL} || {_NL} || {note}")
    others = f"""(SELECT string_agg({_object(heading=_string("'Note'"), provenance=_provenance("'r/' || o.r_regionkey || '.md'", "o.r_name || ' > Note'", ("strlen(o.r_name) + 4", "strlen(o.r_name) + 16"), ("3", "4"), note), score="'10101'")}, ', ' ORDER BY 'r/' || o.r_regionkey || '.md')
      FROM region o WHERE o.r_regionkey <> region.r_regionkey)"""
    source = "'# ' || n_name || chr(10) || 'See [[r/' || n_regionkey || ']] and [[r/' || n_regionkey || '#Note]] and [[gone]].'"

    def links(extra: str, target: str, chosen: str) -> str:
        edge = _object(**{"from": _provenance("'n/' || n_nationkey || '.md'", "n_name", ("0", f"strlen({source})"), ("1", "2"), source)}, raw_target=_string(f"'r/' || n_regionkey || {extra}"), target_heading_path=target)
        return f"(SELECT string_agg({edge}, ', ' ORDER BY 'n/' || n_nationkey || '.md', o) FROM nation, range(2) x(o) WHERE n_regionkey = r_regionkey AND {chosen})"

    both = links("CASE o WHEN 0 THEN '' ELSE '#Note' END", f"CASE o WHEN 0 THEN 'null' ELSE {_string(path)} END", "true")
    one = links("'#Note'", _string(path), "o = 1")
    answers = [
        ("outline", _object(file="'\".//r\\\\' || r_regionkey || '.md\"'", sections="'[' || " + _node("r_name", "r_name", 1, ("1", "4"), _node("'Note'", path, 2, ("3", "4"), "''")) + " || ']'"), "false"),
        ("get_section", _object(content=_string(note), provenance=provenance), "false"),
        ("search", _object(query=_string("'note ' || lower(r_name)"), results="'[' || " + _object(heading=_string("'Note'"), provenance=provenance, score="CAST(20100 + 100 * len(string_split(r_name, ' ')) AS VARCHAR)") + f" || ', ' || {_object(heading=_string('r_name'), provenance=whole, score="CAST(10000 + 101 * len(string_split(r_name, ' ')) AS VARCHAR)")} || ', ' || {others} || ']'"), "false"),
        ("backlinks", _object(backlinks=f"'[' || {both} || ']'", file=_string(file), heading_path="'null'"), "false"),
        ("backlinks", _object(backlinks=f"'[' || {one} || ']'", file=_string(file), heading_path=_string(path)), "false"),
        ("backlinks", _object(backlinks="'[]'", file=_string(file), heading_path=_string("'none'")), "false"),
        ("get_section", _object(message=_string(f"'heading path ''' || r_name || ' > Nota'' was not found in file ''' || {file} || ''''"), suggestions=f"'[' || {_string(path)} || ', ' || {_string('r_name')} || ']'"), "true"),
    ]
    parts = [f"SELECT '{tool}' AS tool, {file} || ' {i}' AS request, {sql} AS result, {failed} AS failed FROM region" for i, (tool, sql, failed) in enumerate(answers)]
    near = """SELECT r_regionkey, '["' || string_agg(file, '", "' ORDER BY d, file) || '"]' AS s FROM (
        SELECT r_regionkey, file, levenshtein('r/' || r_regionkey || '.m', file) AS d, row_number() OVER (PARTITION BY r_regionkey ORDER BY levenshtein('r/' || r_regionkey || '.m', file), file) AS k
        FROM region, (SELECT 'r/' || r_regionkey || '.md' AS file FROM region UNION ALL SELECT 'n/' || n_nationkey || '.md' FROM nation)) WHERE k <= 3 GROUP BY r_regionkey"""
    missing = _object(message=_string("'file ''r/' || r_regionkey || '.m'' is not indexed'"), suggestions="s")
    parts.append(f"SELECT 'outline' AS tool, {file} || ' 7' AS request, {missing} AS result, true AS failed FROM ({near})")
    return " UNION ALL ".join(parts)


def _writes_sql() -> str:
    file, path = "'r' || r_regionkey || '.md'", "r_name || ' > Note'"
    # hashes are those of the folder's vault: SHA-256
    hashed = lambda content: {"content_hash": _string(f"sha256({content})")}
    note, old = f"'## Note' || {_NL} || 'new ' || r_regionkey", f"'## Note' || {_NL} || 'kept'"
    whole = f"'# ' || r_name || {_NL} || {_NL} || {note} || {_NL} || {_NL} || '## Rest'"
    tree = _node("r_name", "r_name", 1, ("1", "6"), _node("'Note'", path, 2, ("3", "4"), "''", **hashed(note)) + " || ', ' || " + _node("'Rest'", "r_name || ' > Rest'", 2, ("6", "6"), "''", **hashed("'## Rest'")), **hashed(whole))
    stale = f"'section ''' || {path} || ''' in ''' || {file} || ''' changed since it was read: expected hash stale, current hash ' || sha256({old})"
    changed = _object(file=_string("'r1.md'"), sections_added=f"'[' || {_string(chr(39) + '@' + chr(39))} || ']'", sections_modified="'[]'", sections_removed=f"'[' || {_string(path)} || ']'")
    changed = changed.replace("'@'", "r_name || ' > More'")
    text = f"CASE WHEN r_regionkey = 1 THEN '# ' || r_name || {_NL} || {_NL} || '## Rest' || {_NL} || {_NL} || '## More' || {_NL} || {_NL} || '### Sub' || {_NL} ELSE '# ' || r_name || {_NL} || {_NL} || CASE WHEN r_regionkey % 2 = 0 THEN {note} ELSE {old} END || {_NL} || {_NL} || '## Rest' || {_NL} END"
    return f"""
      SELECT 'edit_section' AS tool, 'r' || r_regionkey AS request, {_object(file=_string(file), sections="'[' || " + tree + " || ']'")} AS result, false AS failed FROM region WHERE r_regionkey % 2 = 0
      UNION ALL SELECT 'edit_section', 'r' || r_regionkey, {_object(message=_string(stale), current_hash=_string(f"sha256({old})"))}, true FROM region WHERE r_regionkey % 2 = 1
      UNION ALL SELECT 'reindex_vault', '', {_object(files_added=_string("'s.md'").replace("'\"'", "'[\"'", 1) + " || ']'", files_changed=f"'[' || {changed} || ']'", files_removed="'[\"r0.md\"]'")}, false FROM region WHERE r_regionkey = 1
      UNION ALL SELECT 'reindex_vault', 'again', '{{"files_added": [], "files_changed": [], "files_removed": []}}', false
      UNION ALL SELECT 'file', 'r' || r_regionkey, {_string(text)}, false FROM region WHERE r_regionkey > 0"""


def oracle_sql() -> dict[str, str]:
    message = "'wikilink ''[[gone]]'' in section ''' || n_name || ''' of ''n/' || n_nationkey || '.md'' does not resolve: no file matches ''gone'''"
    return {
        "folder_scan": """
          SELECT 'n/' || n_nationkey || '.md' AS file, sha256('# ' || n_name || chr(13) || chr(10) || chr(233) || chr(10)) AS sha256, NULL AS message FROM nation
          UNION ALL SELECT 'n/deep/' || (n_nationkey % 3) || '/.hid/' || n_nationkey || '.Md', sha256(n_name), NULL FROM nation
          UNION ALL SELECT '_x/' || n_nationkey || '.md', CASE WHEN n_nationkey % 4 <> 0 THEN sha256('') END, CASE WHEN n_nationkey % 4 = 0 THEN 'failed to read Markdown file: ' END FROM nation""",
        "tool_reads": _reads_sql(),
        "tool_writes": _writes_sql(),
        "vault_messages": f"""
          WITH m AS (SELECT 'n/' || n_nationkey || '.md' AS file, {message} AS message FROM nation
            UNION ALL SELECT 'a.md', 'invalid YAML frontmatter: duplicate entry with key ''a''')
          SELECT CAST(row_number() OVER (ORDER BY file, message) - 1 AS INTEGER) AS place, file, message FROM m""",
        "vault_changes": """
          SELECT 'r/2.md' AS file, 'added' AS change, NULL AS heading_path UNION ALL SELECT 'r/3.md', 'removed', NULL
          UNION ALL SELECT 'r/0.md', 'modified', r_name || ' > Note' FROM region WHERE r_regionkey = 0
          UNION ALL SELECT 'r/1.md', 'modified', r_name || ' > X[2]' FROM region WHERE r_regionkey = 1""",
    }

"""``python -m inkgraph.cli serve <vault-dir>``: the six verbs as tools of an MCP server, hashes by BLAKE3.

JSON-RPC 2.0 messages, one a line, on standard input and output: initialize, ping, tools/list and tools/call.
"""

from __future__ import annotations

import json
import sys

from inkgraph.operators.edit import EditRejected
from inkgraph.plans.vault import NotFound, Vault
from inkgraph.sources.vault import VaultError

#: Name, what it does, required and optional text arguments.
TOOLS = (
    ("outline", "Heading tree of a file, without bodies.", ("file",), ()),
    ("get_section", "Exact text of a section with its provenance.", ("file", "heading_path"), ()),
    ("search", "Sections ranked by heading and path.", ("query",), ()),
    ("backlinks", "Links to a file or to one of its sections.", ("file",), ("heading_path",)),
    ("reindex_vault", "Read the vault again and tell what changed.", (), ()),
    ("edit_section", "Replace a section's body if its hash is the expected one.", ("file", "heading_path", "body", "expected_hash"), ()),
)


def listing() -> list[dict]:
    text = lambda names: {n: {"type": "string"} for n in names}
    return [
        {"name": name, "description": said, "inputSchema": {"type": "object", "properties": text(needed + extra), "required": list(needed)}}
        for name, said, needed, extra in TOOLS
    ]


def provenance(row: dict, prefix: str = "") -> dict:
    get = lambda name: row[prefix + name]
    return {
        "file": get("file"), "heading_path": get("heading_path"), "byte_range": {"start": get("start"), "end": get("end")},
        "line_range": {"start": get("line_start"), "end": get("line_end")}, "content_hash": get("content_hash"),
    }


def tree(rows: list[dict]) -> list[dict]:
    """Nested sections of flat outline rows in document order."""
    made: dict[int, dict] = {}
    roots = []
    for row in rows:
        node = {k: row[k] for k in ("heading", "level", "heading_path", "content_hash") if k in row}
        node |= {"line_range": {"start": row["line_start"], "end": row["line_end"]}, "children": []}
        made[row["ord"]] = node
        (roots if row["parent_ord"] is None else made[row["parent_ord"]]["children"]).append(node)
    return roots


def answer(vault: Vault, tool: str, a: dict) -> tuple[dict, bool]:
    """(result, whether it is an error) of one tool call."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    try:
        match tool:
            case "outline":
                return {"file": a["file"], "sections": tree(rows(vault.outline(a["file"])))}, False
            case "get_section":
                return vault.get_section(a["file"], a["heading_path"]), False
            case "search":
                found = [{"heading": r["heading"], "score": r["score"], "provenance": provenance(r)} for r in rows(vault.search(a["query"]))]
                return {"query": a["query"], "results": found}, False
            case "backlinks":
                found = rows(vault.backlinks(a["file"], a.get("heading_path")))
                links = [{"from": provenance(r, "from_"), "raw_target": r["raw_target"], "target_heading_path": r["target_heading_path"]} for r in found]
                return {"file": a["file"], "heading_path": a.get("heading_path"), "backlinks": links}, False
            case "reindex_vault":
                return vault.reindex(), False
            case "edit_section":
                found = rows(vault.edit_section(a["file"], a["heading_path"], a["body"], a["expected_hash"]))
                return {"file": a["file"], "sections": tree(found)}, False
        return {"message": f"unknown tool '{tool}'"}, True
    except KeyError as error:
        return {"message": f"missing argument {error}"}, True
    except NotFound as error:
        return {"message": error.message, "suggestions": error.suggestions}, True
    except EditRejected as error:
        return {"message": error.message} | ({"current_hash": error.current_hash} if error.current_hash else {}), True
    except VaultError as error:
        return {"message": str(error)}, True


def respond(vault: Vault, message: dict) -> dict | None:
    """The response to a message; None to a notification."""
    if "id" not in message:
        return None
    out = {"jsonrpc": "2.0", "id": message["id"]}
    params = message.get("params") or {}
    match message.get("method"):
        case "initialize":
            version = params.get("protocolVersion", "2025-06-18")
            return out | {"result": {"protocolVersion": version, "capabilities": {"tools": {}}, "serverInfo": {"name": "inkgraph", "version": "1"}}}
        case "ping":
            return out | {"result": {}}
        case "tools/list":
            return out | {"result": {"tools": listing()}}
        case "tools/call":
            result, failed = answer(vault, params.get("name", ""), params.get("arguments") or {})
            return out | {"result": {"content": [{"type": "text", "text": json.dumps(result, ensure_ascii=False)}], "isError": failed}}
    return out | {"error": {"code": -32601, "message": "method not found"}}


def main(args: list[str]) -> int:
    if len(args) != 2 or args[0] != "serve":
        print("usage: python -m inkgraph.cli serve <vault-dir>", file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("inkgraph").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        vault = Vault(spark, args[1], digest="blake3")
    except VaultError as error:
        print(error, file=sys.stderr)
        return 1
    for line in sys.stdin:
        try:
            message = json.loads(line)
        except ValueError:
            said = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
        else:
            said = respond(vault, message)
        if said is not None:
            print(json.dumps(said, ensure_ascii=False), flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

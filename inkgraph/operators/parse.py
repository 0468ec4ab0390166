"""Documents to tables: one pass of the parser over each text, without a shuffle.

The parser runs once a document in Arrow batches and yields nested rows; the tables below are explodes of its result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgraph.functions import document as D
from inkgraph.functions.inlines import decode_reference
from inkgraph.functions.sections import owned_links, section_tree

SECTION = (
    "struct<ord:int,parent_ord:int,level:int,heading:string,heading_path:string,start:int,end:int,heading_start:int,"
    "heading_end:int,line_start:int,line_end:int,content_hash:string>"
)
LINK = "struct<link_ord:int,start:int,end:int,target:string,label:string,section_ord:int>"
BLOCK = "struct<ord:int,kind:string,start:int,end:int,level:int,heading:string>"
DIAGNOSTIC = "struct<kind:string,start:int,end:int,message:string>"
NODE = "struct<node_id:int,parent_id:int,ord:int,layer:string,kind:string,start:int,end:int,text:string,attrs:string>"
PARSED = (
    f"struct<front_end:int,front_terminated:boolean,metadata:string,sections:array<{SECTION}>,links:array<{LINK}>,"
    f"blocks:array<{BLOCK}>,diagnostics:array<{DIAGNOSTIC}>>"
)


def _records(kind: str, rows: list[tuple]) -> list[dict]:
    names = [part.split(":")[0] for part in kind[len("struct<") : -1].split(",")]
    return [dict(zip(names, row, strict=True)) for row in rows]


def parse_one(text: str | None, digest: str) -> dict:
    doc = D.parse(text or "")
    sections = section_tree(doc, digest)
    data, error = D.metadata(doc)
    blocks = [
        (i, b.kind, doc.offsets(b.start), doc.offsets(b.end), b.attrs.get("level") if b.kind == "heading" else None, None)
        for i, b in enumerate(doc.blocks)
    ]
    by_start = {s.start: s.heading for s in sections if s.heading is not None}
    blocks = [(*b[:5], by_start.get(b[2]) if b[1] == "heading" else None) for b in blocks]
    said = [(k, doc.offsets(a), doc.offsets(b), None) for k, a, b in doc.diagnostics]
    if error:
        said.append(("InvalidFrontmatter", 0, doc.offsets(doc.front[0]), error))
    return {
        "front_end": doc.offsets(doc.front[0]) if doc.front else None,
        "front_terminated": doc.front[1] if doc.front else None,
        "metadata": data,
        "sections": _records(SECTION, [s.row() for s in sections]),
        "links": _records(LINK, owned_links(doc, sections)),
        "blocks": _records(BLOCK, blocks),
        "diagnostics": _records(DIAGNOSTIC, said),
    }


def parse_documents(docs: DataFrame, digest: str = "sha256") -> DataFrame:
    """``docs`` (file, text) with a column ``parsed``. A null text parses as an empty one."""
    schema = T.StructType.fromDDL(f"parsed {PARSED}")["parsed"].dataType

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([parse_one(t, digest) for t in texts], columns=schema.names)

    # else filters that Spark infers from explodes would run the parser a second time
    return docs.withColumn("parsed", run.asNondeterministic()("text"))


def sections(parsed: DataFrame) -> DataFrame:
    return parsed.select("file", F.inline("parsed.sections"))


def blocks(parsed: DataFrame) -> DataFrame:
    return parsed.select("file", F.inline("parsed.blocks"))


def raw_links(parsed: DataFrame) -> DataFrame:
    return parsed.select("file", F.inline("parsed.links"))


def metadata(parsed: DataFrame) -> DataFrame:
    """(file, metadata): front matter as VARIANT, null where there is none or it is invalid."""
    return parsed.select("file", F.try_parse_json("parsed.metadata").alias("metadata"))


def document_diagnostics(parsed: DataFrame) -> DataFrame:
    """(file, message) of invalid front matter; the parser's other findings stay in ``parsed``."""
    rows = parsed.select("file", F.explode("parsed.diagnostics").alias("d"))
    return rows.where("d.message IS NOT NULL").select("file", "d.message")


def syntax_nodes(docs: DataFrame) -> DataFrame:
    """The whole syntax tree of each document as an adjacency list."""
    schema = T.ArrayType(T.StructType.fromDDL(f"n {NODE}")["n"].dataType)

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_records(NODE, D.nodes(D.parse(t or ""))) for t in texts], dtype=object)

    return docs.select("file", F.inline(run.asNondeterministic()("text")))


def character_references(text: Column) -> Column:
    """Column of the characters that a character reference stands for; null if it is none."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else decode_reference(v))

    return run(text)

"""WARC archives: written by tasks, read back in byte ranges.

A reader of a range cannot tell a record's start from the same bytes inside a payload. Every occurrence of the magic
is a candidate, with the offset of its successor by its own length field. Only what the chain from the file's start
reaches is a record: chains are followed within each range at once, and between ranges by pointer jumping.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.llm.shared import bound_batches, discard, join_hot, materialize, open_filesystem, scratch_path, tidy

MAGIC = b"WARC/1.1\r\n"
#: Bytes of an archive that one task reads, and pages' payloads below which no revisit is written.
SPLIT = 8 << 20
MIN_REVISIT = 100
#: Least bytes read past a range at a time, while a header is not complete.
AHEAD = 64 << 10
_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*\r\n", re.I)
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record(kind: str, page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """Bytes of one record; a revisit has no payload, but its length and digest."""
    block = _HTTP + (payload if kind == "response" else b"")
    fields = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        fields.insert(3, f"WARC-Refers-To: <urn:page:{refers_to}>")
        fields.insert(4, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return MAGIC + "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(file, bytes) of archives with a record for every row of ``pages``.

    Of equal payloads of ``min_revisit`` bytes or more the rows of the smallest id are responses, others revisit it;
    rows of no id too, if a row has one. A null html is an empty payload. Each task attempt writes a file of its own
    name, and only files that finished tasks name are read, so lost executors leave nothing half-written behind.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    copies = rows.where(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    copies = materialize(copies.where("n > 1 AND first IS NOT NULL"), "copies")
    rows = join_hot(rows, copies, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    # ids in decimal: as numbers beside nulls they would come as floats
    rows = rows.select(F.col("page_id").cast("string"), "url", "payload", "digest", F.when(again, F.col("first")).cast("string").alias("refers_to"))
    folder = scratch_path(spark, "warc")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = open_filesystem(folder)
        out = name = None
        size = 0
        for batch in batches:
            for page, url, data, digest, first in batch.itertuples(index=False, name=None):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc"
                    out = fs.open_output_stream(f"{root}/{name}")
                data = record("response" if first is None else "revisit", page, url, bytes(data), digest, first)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            yield pd.DataFrame({"file": [f"{folder}/{name}"], "bytes": [size]})
        tidy()

    return materialize(rows.mapInPandas(run, "file string, bytes long"), "archives")


class _Range:
    """Bytes of an archive from ``start``, read on as far as they are asked for."""

    def __init__(self, file, start: int, end: int, size: int):
        self.file, self.start, self.size = file, start, size
        file.seek(start)
        self.data = file.read(max(0, min(end, size) - start))

    def upto(self, end: int) -> bytes:
        missing = min(end, self.size) - self.start - len(self.data)
        if missing > 0:
            self.file.seek(self.start + len(self.data))
            self.data += self.file.read(missing)
        return self.data

    def header(self, at: int) -> tuple[bytes, int] | None:
        """Header of the record at offset ``at`` and the offset of its block. Every record ends with what ends a header,
        so one sought inside a payload is read no further than to the end of that record."""
        local, scan = at - self.start, at - self.start
        while True:
            found = self.data.find(b"\r\n\r\n", scan)
            if found >= 0:
                return self.data[local : found + 2], self.start + found + 4
            known = len(self.data)
            if self.start + known >= self.size:
                return None
            scan = max(local, known - 3)
            self.upto(self.start + known + max(AHEAD, known - local))

    def successor(self, at: int) -> int | None:
        """Offset after the record at ``at``, None if there is no record."""
        head = self.header(at)
        length = head and _LENGTH.search(head[0])
        if not length:
            return None
        after = head[1] + int(length[1]) + 4
        return after if after <= self.size else None


def candidates(splits: DataFrame) -> DataFrame:
    """(file, part, off, exit) of every magic in every range: exit is the first offset outside its range that the
    chain from off comes to, null where the chain breaks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, part, start, end, size in batch[["file", "part", "start", "end", "bytes"]].itertuples(index=False, name=None):
                fs, path = open_filesystem(file)
                with fs.open_input_file(path) as handle:
                    chunk = _Range(handle, start, end, size)
                    chunk.upto(end + len(MAGIC))
                    at = [start + m.start() for m in re.finditer(re.escape(MAGIC), chunk.data) if start + m.start() < end]
                    leave: dict[int, int | None] = {}
                    for off in reversed(at):
                        after = chunk.successor(off)
                        leave[off] = after if after is None or after >= end else leave.get(after)
                if at:
                    yield pd.DataFrame({"file": file, "part": part, "off": at, "exit": pd.array([leave[o] for o in at], dtype="Int64")})

    return splits.mapInPandas(run, "file string, part long, off long, exit long")


def entries(found: DataFrame, rounds: int) -> DataFrame:
    """(file, off) of the records at which the chains from the files' starts enter ranges.

    ``rounds`` doublings follow 2 ** rounds ranges. Only candidates that another's chain exits to take part."""
    links = found.where("exit IS NOT NULL").select("file", "off", "exit")
    targets = links.select("file", F.col("exit").alias("off")).distinct()
    jump = materialize(links.where("off = 0").unionByName(links.where("off > 0").join(targets, ["file", "off"], "left_semi")), "jumps")
    starts = found.where("off = 0").select("file", "off")
    reached = materialize(starts, "reached")
    for _ in range(rounds):
        further = materialize(reached.union(reached.join(jump, ["file", "off"]).select("file", F.col("exit").alias("off"))).distinct(), "reached")
        then = jump.select("file", F.col("off").alias("exit"), F.col("exit").alias("then"))
        double = materialize(jump.join(then, ["file", "exit"]).select("file", "off", F.col("then").alias("exit")), "jumps")
        discard(reached)
        discard(jump)
        reached, jump = further, double
    discard(jump)
    return reached


def read(archives: DataFrame, split: int = SPLIT) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of every record that is reachable from
    its file's start; digest and length of a response are taken from its payload anew. A response whose digest
    differs from its header's raises an error. Empty archives give no rows."""
    most = archives.agg(F.max("bytes")).first()[0] or 0
    parts = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("bytes") / split) - 1, F.lit(0)))
    splits = archives.select("file", "bytes", F.explode(parts).alias("part"))
    splits = splits.withColumns({"start": F.col("part") * split, "end": F.least((F.col("part") + 1) * split, F.col("bytes"))})
    tasks = max(1, splits.count())
    splits = materialize(splits.repartition(min(tasks, 100_000), "file", "part"), "splits")
    found = materialize(candidates(splits), "candidates")
    at = entries(found, math.ceil(math.log2(most / split + 1)) + 1 if most > split else 1)
    discard(found)
    known = at.withColumn("part", F.floor(F.col("off") / split)).join(splits, ["file", "part"])
    known = known.select("file", "off", "end", "bytes").repartition(min(tasks, 100_000), "file", "off")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, off, end, size in batch.itertuples(index=False, name=None):
                fs, path = open_filesystem(file)
                rows = []
                with fs.open_input_file(path) as handle:
                    chunk = _Range(handle, off, end, size)
                    while off < end:
                        head, block = chunk.header(off)
                        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if line)
                        after = block + int(fields["Content-Length"]) + 4
                        chunk.upto(after)
                        page = fields["WARC-Record-ID"][10:-1]
                        digest, length = fields["WARC-Payload-Digest"].partition(":")[2], int(fields["WARC-Payload-Length"])
                        kind = fields["WARC-Type"]
                        if kind == "response":
                            body = chunk.data[block - chunk.start : after - 4 - chunk.start]
                            payload = body[body.index(b"\r\n\r\n") + 4 :]
                            length = len(payload)
                            if hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{file} at {off}: the payload differs from its digest")
                        refers = fields.get("WARC-Refers-To")
                        rows.append((None if page == "null" else page, length, digest, kind, refers[10:-1] if refers else None, fields["WARC-Target-URI"]))
                        off = after
                if rows:
                    yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])
        tidy()

    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string"
    return known.mapInPandas(run, schema).withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})

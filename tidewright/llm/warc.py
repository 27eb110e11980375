"""WARC archives: one gzip member per record, written and read in sequence.

A record is a WARC header block, its content by Content-Length, and two line ends, compressed as one gzip member. Of records with
equal payloads of some length one is a response, the others are revisits that refer to it and carry no content. The
reader decompresses member by member, frames each record by its header, and checks the digest of every content; resolved()
holds the digest and length of every revisit against the response that it names.

An archive is a byte string of bounded size, rolled over like a file. Archives are kept as rows of a table in the shared folder, so any store that Spark
writes can hold them; save_archives() puts them as files into a mounted folder, and read_files() reads archive files of any size in steps.

A payload has to fit in memory, as it does in its row. An empty table gives no archives. A null payload is empty. Rows that repeat a page_id are records of their own, all responses where it is the largest of their
payload; a null page_id is written as "null", read back as null, and always a response. Other columns are ignored.

A record's id names the page and its place, the writing task and its number there, so no two records share one however often a page_id occurs. The page's own
number stands in a header of its own, and a revisit tells the number and the URL of the page that it refers to.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.shared import _slices, materialise

#: Payloads of at least so many bytes are written once.
LEAST_BYTES = 1000
#: An archive is closed when it has so many compressed bytes.
ROLL_BYTES = 1 << 20

# Names of the WARC 1.1 format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE = "archive string, content binary"
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, content binary"


class WarcError(ValueError):
    """An archive that breaks the format or a digest."""


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, refers_url: str | None = None, place: str = "0") -> bytes:
    """One record as a gzip member; place is unique among all records. A header's value can't hold line ends; those of a URL are escaped."""
    content = payload if refers_to is None else b""
    escaped = lambda u: u.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    number = lambda n: "null" if n is None else str(n)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{number(page_id)}:{place}>"),
        ("Page-ID", number(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        *([] if url is None else [("WARC-Target-URI", escaped(url))]),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Payload-Length", str(len(payload))),
        *([] if refers_to is None else [("Refers-To-Page-ID", number(refers_to)), ("WARC-Profile", PROFILE)]),
        *([] if refers_to is None or refers_url is None else [("WARC-Refers-To-Target-URI", escaped(refers_url))]),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(content))),
    ]
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode("utf-8", "surrogatepass") for k, v in fields) + b"\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(head) + press.compress(content) + press.compress(b"\r\n\r\n") + press.flush()


def members(data: bytes | BinaryIO, step: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of an archive, bytes or an open file, one after the other, decompressed in steps."""
    file = io.BytesIO(data) if isinstance(data, bytes) else data
    piece = file.read(step)
    while piece:
        engine, out = zlib.decompressobj(31), []
        while not engine.eof:
            if not piece:
                raise WarcError("the archive ends within a member")
            try:
                out.append(engine.decompress(piece))
            except zlib.error as error:
                raise WarcError(f"not a gzip member: {error}") from None
            piece = engine.unused_data or file.read(step)
        yield b"".join(out)


def _number(value: str | None) -> int | None:
    if not re.fullmatch(r"-?\d+|null", value or ""):
        raise WarcError(f"not a page's number: {value}")
    return None if value == "null" else int(value)


def parse(member: bytes) -> dict:
    """A record of RECORD's fields; raises WarcError where the format, a length or a digest is wrong."""
    head, found, rest = member.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] != VERSION:
        raise WarcError("a record without its header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError("a header line without a name")
        fields[name.decode().lower()] = value.strip(b" \t").decode("utf-8", "surrogatepass")
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise WarcError("the content isn't as long as its header says")
    content, digest, kind = rest[:size], fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and (hashlib.sha1(content).hexdigest() != digest or str(size) != fields["warc-payload-length"]):
        raise WarcError("the content doesn't match its digest")
    if not re.fullmatch(rf"<urn:page:{re.escape(fields.get('page-id', ''))}:\S+>", fields.get("warc-record-id", "")):
        raise WarcError("a record id that isn't the page's")
    url = fields.get("warc-target-uri")
    return {
        "page_id": _number(fields.get("page-id")), "payload_bytes": int(fields["warc-payload-length"]), "payload_digest": digest, "record_type": kind,
        "refers_to": _number(fields.get("refers-to-page-id")) if kind == "revisit" else None, "url": url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"), "content": content,
    }


def planned(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """pages with refers_to: of equal payloads of at least `least` bytes, those without the largest page_id refer to it.

    Only digests and ids are grouped, and the maxima combine before the shuffle. What joins back to the pages is one row
    per payload that occurs twice: where Spark finds it small the pages stay where they are, else the join can split a hot payload.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    own = pages.select("page_id", "url", payload.alias("payload")).select("*", F.sha1("payload").alias("digest"))
    large = F.octet_length("payload") >= least
    last = own.filter(large & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max(F.struct("page_id", F.col("url").alias("last_url"))).alias("last"), F.min("page_id").alias("first"))
    last = last.filter("first < last.page_id").select(F.col("digest").alias("twice"), F.col("last.page_id").alias("last"), "last.last_url")
    last = materialise(last, "warc-last")
    refers = F.when(large & (F.col("page_id") < F.col("last")), F.col("last"))
    return own.join(last, own.digest == last.twice, "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"), "last_url")


def write_archives(pages: DataFrame, least: int = LEAST_BYTES, roll: int = ROLL_BYTES) -> DataFrame:
    """The archives, written to the shared folder: archive (name), content."""
    schema = pages.sparkSession.createDataFrame([], ARCHIVE).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, place, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"archive": f"pages-{part:05d}-{number:05d}.warc.gz", "content": b"".join(held)}], pa.schema([("archive", pa.string()), ("content", pa.binary())]))

        for batch in batches:
            for piece in _slices(batch, 256):
                for row in piece.to_pylist():
                    held.append(record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], row["last_url"], f"{part}:{place}"))
                    place += 1
                    size += len(held[-1])
                    if size >= roll:
                        yield closed()
                        number, held, size = number + 1, [], 0
        if held:
            yield closed()

    return materialise(planned(pages, least).mapInArrow(run, schema), "warc")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of archives; a task fails on the first that breaks the format."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from _records(io.BytesIO(content.as_py()))

    return archives.select("content").mapInArrow(run, RECORD)


def _records(file: BinaryIO) -> Iterator[pa.RecordBatch]:
    """Parsed records of an archive, some MB at a time."""
    arrow = pa.schema([(name, {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[kind]) for name, kind in (x.split() for x in RECORD.split(", "))])
    held, size = [], 0
    for member in members(file):
        held.append(parse(member))
        size += len(member)
        if size >= 4 << 20:
            yield pa.RecordBatch.from_pylist(held, arrow)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, arrow)


def resolved(records: DataFrame) -> DataFrame:
    """The records; fails where a revisit's digest and length aren't those of the response that it refers to.

    Only ids, digests and lengths of revisits and of the responses they name are joined, both written once; what is wrong is looked for before the records go on.
    """
    told = materialise(records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "warc-told")
    named = told.filter("record_type = 'revisit'").select(F.col("refers_to").alias("named"), "payload_bytes", "payload_digest").distinct()
    own = told.filter("record_type = 'response'").select(F.col("page_id").alias("named"), "payload_bytes", "payload_digest").distinct()
    wrong = named.join(own, ["named", "payload_bytes", "payload_digest"], "left_anti").limit(1).collect()
    if wrong:
        raise WarcError(f"a revisit doesn't match the record {wrong[0].named}")
    return told


def save_archives(archives: DataFrame, folder: str) -> None:
    """As files in a folder that every executor has mounted. A task that runs again writes the same files again."""

    def save(rows) -> None:
        for row in rows:
            with open(f"{folder}/{row.archive}.part", "wb") as file:
                file.write(row.content)
            os.replace(f"{folder}/{row.archive}.part", f"{folder}/{row.archive}")

    archives.foreachPartition(save)


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The records of archive files, read in steps: paths in a folder that every executor has mounted, or URIs of a store that Arrow's file systems open.

    One task reads a file, as gzip members can only be found in sequence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)
                with system.open_input_file(at) as file:
                    yield from _records(file)

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInArrow(run, RECORD)

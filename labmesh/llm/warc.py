"""WARC archives: an index of byte ranges first, then coalesced range reads.

Pages are dealt by id; each task appends gzip members, one per record, to archive
files in the shared folder and returns an index row per record: file, offset,
length, url, digest. The index table is the commit: a task that is repeated writes
files of other names, and files that no index row names are never read. Readers
pick records in the index, sort them by file and offset, and read neighbouring
ranges in one go.

Of records with equal payloads the one with the smallest id is a response and the
others are revisits without a payload. Only digests of repeated payloads are
shuffled to find them; the pages themselves move once.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha1, sha256

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labmesh.llm.common import stored
from labmesh.sources.scratch import fresh_folder

FILE_BYTES = 256 << 20
REVISIT_BYTES = 100
READ_BYTES = 4 << 20
GAP_BYTES = 64 << 10
RANGE_BYTES = 32 << 20
DATE = "2025-01-01T00:00:00Z"

_END = b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = (
    "page_id {kind}, url string, file string, offset long, length long, "
    "payload_digest string, record_type string"
)


def _header(value) -> str:
    """A header value on one line; a url with blanks or line breaks is escaped."""
    return "".join(c if " " < c else f"%{ord(c):02X}" for c in str(value))


def record(
    page_id, url: str | None, payload: bytes, digest: str, refers_to, refers_to_url: str | None
) -> bytes:
    """One WARC record, not compressed: a response, or a revisit if it refers to another page."""
    http = [
        "HTTP/1.1 200 OK",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(payload)}",
    ]
    block = "\r\n".join(http).encode() + _END
    revisit = refers_to is not None
    # Records are named by their page, so that a repeated task writes equal records.
    name = uuid.UUID(bytes=sha1(f"{page_id}|{url}|{digest}".encode("utf-8", "replace")).digest()[:16])
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url:
        head.append(f"WARC-Target-URI: {_header(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"X-Refers-To-Page: {refers_to}"]
        if refers_to_url:
            head.append(f"WARC-Refers-To-Target-URI: {_header(refers_to_url)}")
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "replace") + _END + block + _END


def parse_record(data: bytes) -> dict:
    """Headers, HTTP headers and payload of one record; a revisit has no payload of its own."""
    head, _, rest = data.partition(_END)
    headers = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != _END:
        raise ValueError("a record does not end where its length says")
    http, _, payload = block.partition(_END)
    lines = http.decode("utf-8").split("\r\n")[1:]
    return {"headers": headers, "http": dict(x.split(": ", 1) for x in lines), "payload": payload}


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The store that a folder is in, and its path there; a plain path is a local one."""
    return fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")


def _compressed(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def revisits(pages: DataFrame, id: str, url: str, html: str) -> DataFrame:
    """id, refers_to, refers_to_url: the pages whose payload a page with a smaller id has.

    Payloads below REVISIT_BYTES are never revisits. Rows that share the smallest
    id of a payload are responses all; rows without an id are responses too.
    """
    named = pages.select(
        F.col(f"`{id}`").alias("id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html")
    ).filter(F.col("id").isNotNull() & (F.octet_length("html") >= REVISIT_BYTES))
    digests = stored(named.select("id", "url", F.sha2("html", 256).alias("digest")), "digests")
    firsts = (
        digests.groupBy("digest")
        .agg(
            F.min("id").alias("refers_to"),
            F.max("id").alias("last"),
            F.min_by("url", F.struct("id", "url")).alias("refers_to_url"),
        )
        .filter(F.col("refers_to") != F.col("last"))
        .drop("last")
    )
    return (
        digests.select("id", "digest")
        .join(stored(firsts, "first-payloads"), "digest")
        .filter(F.col("id") != F.col("refers_to"))
        .select("id", F.col("digest").alias("known_digest"), "refers_to", "refers_to_url")
        .distinct()
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    id: str = "page_id",
    url: str = "url",
    html: str = "html",
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write a record per row into `folder` and return the index, one row per record.

    The payload is the text in UTF-8, empty for NULL. Repeated rows have a record
    each. Rows with a NULL id or url are written without that header. Other columns
    are not read. An empty table writes no file and gives an empty index.
    """
    kind = pages.select(F.col(f"`{id}`")).dtypes[0][1]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page, address, body, digest, refers, refers_url in batch.itertuples(index=False):
                    if out is None or offset >= file_bytes:
                        if out is not None:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    payload = body or b""
                    digest = sha256(payload).hexdigest()
                    refers = None if refers is None or refers != refers else refers
                    data = _compressed(record(page, address, payload, digest, refers, refers_url))
                    out.write(data)
                    record_type = "response" if refers is None else "revisit"
                    rows.append((page, address, name, offset, len(data), digest, record_type))
                    offset += len(data)
                yield pd.DataFrame(
                    rows,
                    columns=["page_id", "url", "file", "offset", "length", "payload_digest", "record_type"],
                )
        finally:
            if out is not None:
                out.close()

    given = pages.select(
        F.col(f"`{id}`").alias("id"),
        F.col(f"`{url}`").alias("url"),
        F.col(f"`{html}`").cast("binary").alias("html"),
    )
    known = revisits(pages, id, url, html)
    rows = (
        given.withColumn("known_digest", F.sha2(F.coalesce("html", F.lit(b"")), 256))
        .join(known, ["id", "known_digest"], "left")
        # Ids go over as text, so that NULL does not turn whole numbers into floats.
        .select(
            F.col("id").cast("string"),
            "url",
            "html",
            "known_digest",
            F.col("refers_to").cast("string"),
            "refers_to_url",
        )
    )
    index = rows.mapInPandas(write, INDEX.format(kind="string"))
    return stored(index.withColumn("page_id", F.col("page_id").cast(kind)), "warc-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of the index rows: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest, payload.

    A task takes the records of a stretch of a file in order of their offsets and
    reads ranges that lie close together at once. The payload of a response is
    checked against its digest; that of a revisit is empty, its size and digest are
    those of the page that it refers to. An empty index gives an empty result.
    """
    kind = dict(index.dtypes)["page_id"]

    def ranges(rows: pd.DataFrame) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        start = end = -1
        members: list[tuple[int, int]] = []
        for offset, length in zip(rows["offset"].tolist(), rows["length"].tolist()):
            far = offset - end > GAP_BYTES or offset + length - start > READ_BYTES
            if members and far:
                yield start, end, members
                members = []
            if not members:
                start = end = offset
            members.append((offset, length))
            end = max(end, offset + length)
        if members:
            yield start, end, members

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = file_system(folder)
        for batch in batches:
            for name, rows in batch.groupby("file", sort=False):
                with system.open_input_file(f"{root}/{name}") as file:
                    for start, end, members in ranges(rows):
                        data = file.read_at(end - start, start)
                        out = []
                        for offset, length in members:
                            packed = data[offset - start : offset - start + length]
                            found = parse_record(zlib.decompress(packed, 31))
                            out.append(_row(found))
                        yield pd.DataFrame(out, columns=_COLUMNS)

    spread = index.select("file", "offset", "length").withColumn(
        "stretch", F.floor(F.col("offset") / RANGE_BYTES)
    )
    # As many tasks as the archives have stretches: the index is too small to tell.
    size = index.agg(F.sum("length").alias("n")).head()["n"] or 0
    tasks = max(1, -(-size // RANGE_BYTES))
    dealt = spread.repartition(tasks, "file", "stretch").sortWithinPartitions("file", "offset")
    records = dealt.drop("stretch").mapInPandas(
        read,
        "page_id string, url string, record_type string, refers_to string, payload_bytes long, "
        "payload_digest string, payload binary",
    )
    return records.withColumns(
        {c: F.col(c).cast(kind) for c in ("page_id", "refers_to")}
    )


_COLUMNS = [
    "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload",
]


def _row(found: dict) -> tuple:
    headers, payload = found["headers"], found["payload"]
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    record_type = headers["WARC-Type"]
    if record_type == "response" and sha256(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {headers['WARC-Record-ID']} differs from its digest")
    return (
        headers.get("X-Page-Id"),
        headers.get("WARC-Target-URI"),
        record_type,
        headers.get("X-Refers-To-Page"),
        int(found["http"]["Content-Length"]),
        digest,
        payload,
    )


def archive_folder(spark) -> str:
    """A new folder for archives in the shared folder."""
    return fresh_folder(spark, "warc")

"""WARC archives: write with an index first, then read records by coalesced byte ranges.

Each record is a gzip member of its own, so offset and length select it. A task writes
archives of its own under names that no other attempt uses and yields their index rows;
the index is written as a table before anything is read, and only archives that it names
count. Reading takes the selected index rows in order of archive and offset, joins
neighbours to one range and reads each range once.

Archives are written and read through Arrow's file systems, by the URI of the shared folder.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, functions as F

from arbora.llm.common import small, written
from arbora.session import scratch_path

#: Smallest payload that may become a revisit record; bytes after which a task begins another archive; payload bytes for a task.
LEAST_BYTES, ARCHIVE_BYTES, TASK_BYTES = 100, 1 << 28, 1 << 26
#: Bytes that one task reads in a row; a gap up to which two ranges are read as one; the longest range.
STRETCH, GAP, RANGE = 1 << 25, 1 << 16, 1 << 23
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"
DATE = "1970-01-01T00:00:00Z"


def record_types(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is the page with the smallest id of equal payloads, or null for responses.

    Payloads below ``least_bytes`` are all responses. Rows with the smallest id, also if
    repeated, are responses; a row with a null id refers to the smallest id, if there is one.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    long_enough = F.octet_length("html") >= least_bytes
    first = (rows.where(long_enough).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1 and first is not null").select(F.col("digest").alias("same"), "first"))
    first = small(written(first, "warc-repeated"))  # html moves only if very many payloads repeat
    joined = rows.join(first, (F.col("digest") == F.col("same")) & long_enough, "left")
    return joined.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def _value(text: str | None) -> str:
    """A header value on one line."""
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record (not compressed): an HTTP response, or a revisit without its payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(block)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_value(url)}")
        if _value(url) != url:
            head.append(f"X-Page-URL: {json.dumps(url)}")  # as it was given, line breaks and all
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers, length of the full payload, and the payload as stored (empty for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    full = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields, full, payload


def _file_system(uri: str):
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pyarrow.fs.FileSystem.from_uri(uri)


def write_archives(typed: DataFrame, folder: str) -> DataFrame:
    """Writes rows of `record_types` as archives into ``folder`` and returns the index, itself written."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _file_system(folder)
        fs.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in it:
                rows = []
                for page_id, url, html, digest, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to"))):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = record(page_id.as_py(), url.as_py(), html.as_py().encode(), digest.as_py(), refers_to.as_py())
                    member = packer.compress(data) + packer.flush()
                    out.write(member)
                    rows.append((name, at, len(member), page_id.as_py(), url.as_py(), digest.as_py(), "response" if refers_to.as_py() is None else "revisit"))
                    at += len(member)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                                                 names=[f.split()[0] for f in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return written(typed.mapInArrow(batches, INDEX), "warc-index")


def _in_tasks(df: DataFrame, total: int, each: int) -> DataFrame:
    """``df`` in no more tasks than ``total`` bytes need, but at least two for each core."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-total // each)))


def coalesced(offsets: list[int], lengths: list[int]) -> Iterator[tuple[int, int, list[int]]]:
    """(start, end, records) of the ranges to read for records sorted by offset."""
    start = end = None
    held: list[int] = []
    for k, (a, n) in enumerate(zip(offsets, lengths)):
        if held and (a - end > GAP or max(end, a + n) - start > RANGE):
            yield start, end, held
            held = []
        if not held:
            start, end = a, a
        held.append(k)
        end = max(end, a + n)
    if held:
        yield start, end, held


def read_records(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of the records in ``index``.

    ``index`` may be any selection of index rows. The digest of a response is computed
    anew from the payload read and compared with its header.
    """
    schema = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
              + ", payload string" * with_payload)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _file_system(folder)
        name, source = None, None
        for batch in it:
            files, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            cuts = [0, *(k for k in range(1, len(files)) if files[k] != files[k - 1]), len(files)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b == a:
                    continue
                if files[a] != name:
                    name, source = files[a], fs.open_input_file(f"{path}/{files[a]}")
                for start, end, held in coalesced(offsets[a:b], lengths[a:b]):
                    data = source.read_at(end - start, start)
                    rows = []
                    for k in held:
                        at = offsets[a + k] - start
                        fields, full, payload = parsed(zlib.decompress(data[at:at + lengths[a + k]], 31))
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        kind = fields["WARC-Type"]
                        if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != full):
                            raise ValueError(f"damaged record in {name} at {offsets[a + k]}")
                        page, refers = (fields.get(x) for x in ("X-Page-ID", "X-Refers-To-Page-ID"))
                        url = json.loads(fields["X-Page-URL"]) if "X-Page-URL" in fields else fields.get("WARC-Target-URI")
                        rows.append((page and int(page), url, full, digest, kind, refers and int(refers),
                                     payload.decode() if with_payload and kind == "response" else None))
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())[:6 + with_payload]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                                                     names=[f.split()[0] for f in schema.split(", ")])

    total = index.agg(F.sum("length")).first()[0] or 0
    wanted = index.select("file", "offset", "length", F.floor(F.col("offset") / STRETCH).alias("stretch"))
    # tasks by the bytes to read: index rows are far too small to tell
    wanted = wanted.repartition(max(2 * index.sparkSession.sparkContext.defaultParallelism, -(-total // STRETCH)), "file", "stretch")
    return wanted.sortWithinPartitions("file", "offset").mapInArrow(batches, schema)


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes every row of (page_id, url, html) as a record, then reads the archives back.

    One row for each input row: null html is an empty payload, null urls and ids are kept as
    null, repeated rows are records each, an empty table gives no archive and an empty result.
    ``folder`` is a URI in the shared file system; unset, a fresh folder of the checkpoint folder.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    return read_records(write_archives(_in_tasks(record_types(pages), total, TASK_BYTES), folder), folder)

"""WARC archives: one gzip member per record, revisit records for repeated payloads, and a salvage reader.

The reader checks every member (gzip checksum), record (lengths, version line) and payload (SHA-256).  After a failed
check it searches on for the next valid member or version line, recovers what follows, and logs the bytes it passed
over as a quarantined gap.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import shared_dir, written

#: Payloads below this size are never referred to.
LEAST_REVISIT = 100
#: Archive files are closed beyond this size, so each is read by one task in bounded memory.
FILE_BYTES = 8 << 20
GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."
LINE = re.compile(rb"(?<=\n)WARC/1\.")
START = re.compile(rb"\x1f\x8b\x08|(?:^|(?<=\n))WARC/1\.")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = ("file string, offset long, length long, status string, reason string, page_id string, url string, "
          "record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary")


def record(page_id: str, url: str, payload: bytes | None, digest: str, size: int, refers_to: str | None) -> bytes:
    """One record, uncompressed; ``payload`` None makes a revisit."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n").encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
            f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}",
            f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _fed(reader, piece, out: list[bytes]):
    """The reader after ``piece``, its output appended to ``out``; None if it is damaged: then up to the damage.

    A failing call gives no output at all, so its input is halved until the damaged byte is alone.
    """
    before = reader.copy()
    try:
        out.append(reader.decompress(piece))
        return reader
    except zlib.error:
        if len(piece) == 1:
            return None
        half = _fed(before, piece[:len(piece) // 2], out)
        return half and _fed(half, piece[len(piece) // 2:], out)


def _unpacked(data: memoryview, at: int) -> tuple[bytes, int, str | None]:
    """Content and end of the gzip member at ``at``; of a damaged or cut-off one what comes before, and the reason."""
    reader, parts, pos = zlib.decompressobj(31), [], at
    while not reader.eof:
        if pos >= len(data):
            return b"".join(parts), pos, "member is cut off"
        piece = data[pos:pos + 65536]
        reader = _fed(reader, piece, parts)
        if reader is None:
            return b"".join(parts), pos, "member is damaged"
        pos += len(piece)
    return b"".join(parts), pos - len(reader.unused_data), None


def _parsed(data, at: int) -> tuple[dict, int]:
    """The record whose version line starts at ``at``, and its end; raises ValueError if a check fails."""
    data = bytes(data) if not isinstance(data, bytes) else data
    if not data.startswith(VERSION, at):
        raise ValueError("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise ValueError("header is cut off")
    head = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("bad header line")
        head[key.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
    if not head.get("content-length", "").isdigit():
        raise ValueError("no content length")
    begin = stop + 4
    end = begin + int(head["content-length"])
    if data[end:end + 4] != b"\r\n\r\n":
        raise ValueError("record is cut off or has a wrong length")
    block = data[begin:end]
    named = head.get("warc-block-digest", "")
    if named.startswith("sha256:") and hashlib.sha256(block).hexdigest() != named[7:]:
        raise ValueError("block digest differs")
    http, blank, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
    digest = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
    kind = head.get("warc-type")
    if kind == "response":
        if size and int(size[1]) != len(payload):
            raise ValueError("payload length differs")
        if digest and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("payload digest differs")
    page = lambda key: (re.fullmatch(r"<urn:page:(.*)>", head.get(key, "")) or [None, None])[1]
    return {"page_id": page("warc-record-id") or None, "url": head.get("warc-target-uri"), "record_type": kind,
            "refers_to": page("warc-refers-to"), "payload_bytes": int(size[1]) if size else len(payload),
            "payload_digest": digest, "payload": payload if kind == "response" else None}, end + 4


def _content(content: bytes) -> Iterator[dict]:
    """Records of a member's content; after one that fails, those from the next version line on.  Gaps have no place in
    the file of their own: their reason says which bytes of the content they are."""
    pos, bad, why = 0, None, ""

    def gap(end):
        return {"status": "gap", "reason": f"{why} (bytes {bad} to {end} of the member's content)"}

    while pos < len(content):
        try:
            one, end = _parsed(content, pos)
        except ValueError as e:
            if bad is None:
                bad, why = pos, str(e)
            following = LINE.search(content, pos + 1)
            pos = following.start() if following else len(content)
            continue
        if bad is not None:
            yield gap(pos)
            bad = None
        yield one | {"status": "ok", "reason": None}
        pos = end
    if bad is not None:
        yield gap(len(content))


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of one archive, compressed by member or plain, in order; their lengths add up to the file's.

    Of a member with several records the first row has its length.  A record that fails its check costs no other of its
    member, and of a member that is damaged or cut off the records before the damage are kept.
    """
    view, at, bad, why = memoryview(data), 0, None, ""

    def gap(end):
        return {"offset": bad, "length": end - bad, "status": "gap", "reason": why}

    while at < len(data):
        found, end, failed = [], at, None
        if data.startswith(GZIP, at):
            content, end, failed = _unpacked(view, at)
            found = list(_content(content))
            if not any(x["status"] == "ok" for x in found):
                failed = failed or (found[0]["reason"] if found else "member is empty")
                found = []
        else:
            try:
                one, end = _parsed(data, at)
                found = [one | {"status": "ok", "reason": None}]
            except ValueError as e:
                failed = str(e)
        if failed is None:
            if bad is not None:
                yield gap(at)
                bad = None
            for i, one in enumerate(found):
                yield one | {"offset": at, "length": end - at if i == 0 else 0}
            at = end
            continue
        if bad is None:
            bad, why = at, failed
        for one in found:  # the gap to come has the length of the damaged member
            if one["status"] == "ok":
                yield one | {"offset": at, "length": 0}
        following = START.search(data, at + 1)
        at = following.start() if following else len(data)
    if bad is not None:
        yield gap(len(data))


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload (null for revisits), n, digest, refers_to: what each page's record holds."""
    html = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("payload")) \
        .withColumn("n", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    ids = rows.filter(F.col("n") >= LEAST_REVISIT).select("page_id", "digest")
    first = written(ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("c"))
                    .filter("c > 1 AND refers_to IS NOT NULL").drop("c"), "warc-first")
    again = written(ids.join(first, "digest").filter("page_id IS NULL OR page_id <> refers_to")
                    .select("page_id", "digest", "refers_to").distinct()
                    .withColumnsRenamed({"page_id": "_p", "digest": "_d"}), "warc-again")
    return rows.join(again, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d")), "left").select(
        "page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "n", "digest", "refers_to")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> DataFrame:
    """Write all pages as gzip-member WARC files below ``folder`` (a URI); returns the manifest (file, records, bytes).

    Files of attempts that failed are not in the manifest.  Null html is an empty payload, a null url is empty, a null
    id is written as an empty one; rows that repeat an id give a record each.
    """

    def run(batches):
        from pyarrow import fs
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        tag = f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}"
        done, sink, state = [], None, None
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(batch.num_columns))):
                page_id, url, payload, n, digest, refers = (x.as_py() for x in row)
                if sink is None:
                    name = f"{tag}-{len(done):05d}.warc.gz"
                    sink, state = store.open_output_stream(f"{base}/{name}", compression=None), [name, 0, 0]
                url = quote(url or "", safe="".join(map(chr, range(33, 127))))
                data = member(record("" if page_id is None else str(page_id), url, payload, digest, n,
                                     None if refers is None else str(refers)))
                sink.write(data)
                state[1] += 1
                state[2] += len(data)
                if state[2] >= FILE_BYTES:
                    sink.close()
                    done.append(state)
                    sink = None
        if sink is not None:
            sink.close()
            done.append(state)
        if done:
            yield pa.record_batch([pa.array(list(x)) for x in zip(*done)], names=["file", "records", "bytes"])

    return written(planned(pages, id_col, url_col, html_col).mapInArrow(run, "file string, records long, bytes long"),
                   "warc-manifest")


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """Records (status ok) and quarantined gaps (status gap) of the archives in ``folder``: columns of ``RECORD``."""
    files = spark.read.format("binaryFile").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    if manifest is not None:
        files = files.join(manifest.select("file"), "file", "left_semi")
    return files.mapInArrow(_read, RECORD)


def _read(batches):
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("status", pa.string()),
                        ("reason", pa.string()), ("page_id", pa.string()), ("url", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("payload", pa.binary())])
    for batch in batches:
        for name, content in zip(batch.column(0), batch.column(1)):
            rows, held = [], 0
            for one in salvage(content.as_buffer().to_pybytes()):
                rows.append(one | {"file": name.as_py()})
                held += len(one.get("payload") or b"") + 200
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive all pages in the shared folder and read the archives back: one row per record."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    manifest = write_archives(pages, folder)
    if manifest.isEmpty():
        return spark.createDataFrame([], RECORD)
    return read_archives(spark, folder, manifest).filter("status = 'ok'")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, strlen(h) AS n, sha256(h) AS g, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, g AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""

"""WARC archives: writing with revisits and segments, and reassembly on reading.

Writing: of records with equal payloads the one with the largest page_id becomes
a response, the others revisits that name it. A response's block is an HTTP
message with a chunked body; a block longer than ``segment`` bytes is cut into a
first record and continuation records. Each record is one gzip member, and the
members put one after another are a .warc.gz file, of at most ``FILE_RECORDS``
records. Spark's text writer makes the files, so they may lie wherever Spark can
write; it ends each member with an empty one.

Reading: an archive is inflated and cut into records piece by piece, whether it is
one member, many, or plain. Segments are grouped by the identifier of their origin, ordered by
segment number, and checked for gaps and against the total length before the
chunked framing is decoded and the payload compared with its digest. Only
segmented records are shuffled. Revisits meet their response in a join on its
identifier. A record that stands in an archive more than once counts as often. A record that is incomplete or whose digest differs has ``complete``
false and no payload.

Which payload is a response is found by a maximum per digest, aggregated before
the shuffle; the joins are ones that adaptive execution can split, so a payload
that a third of all pages share is no single task's work.

Defined cases: null html is an empty payload; null page_id and url are kept (a
null id is smaller than any); rows that repeat the largest page_id of a payload are
responses each; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm._store import cut

SEGMENT, CHUNK = 16 << 10, 4 << 10
FILE_RECORDS = 2048
BROADCAST_ROWS = 100_000
# Fixed values of the formats.
EOL = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in HTTP's chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(c := payload[i : i + size]), c) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(EOL, at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if len(body) < at + n + 2 or body[at + n : at + n + 2] != EOL:
            raise ValueError("a chunk is cut off")
        out.append(body[at : at + n])
        at += n + 2


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*of) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(of).encode()).digest()[:16], version=4)}>"


def record(kind: str, ident: str, block: bytes, **fields) -> bytes:
    """One record as a gzip member. Fields are header lines, with _ for -."""
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {ident}", "WARC-Date: 2026-01-01T00:00:00Z", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    return gzip.compress(b"WARC/1.0\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def _one_line(url: str | None) -> str | None:
    return None if url is None else "".join(url.split())


def response(page_id, url: str | None, payload: bytes, ident: str, segment: int = SEGMENT) -> list[bytes]:
    """The records of a response: one, or a first one and its continuations."""
    block = HTTP + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    own = {"WARC_Target_URI": _one_line(url), "X_Page_ID": page_id, "WARC_Payload_Digest": f"sha1:{digest(payload)}", "Content_Type": "application/http; msgtype=response"}
    if len(parts) == 1:
        return [record("response", ident, block, **own)]
    out = [record("response", ident, parts[0], **own, WARC_Segment_Number=1)]
    for n, part in enumerate(parts[1:], 2):
        total = len(block) if n == len(parts) else None
        out.append(record("continuation", record_id(ident, n), part, WARC_Segment_Origin_ID=ident, WARC_Segment_Number=n, WARC_Segment_Total_Length=total))
    return out


def _write(batches: Iterator[pa.RecordBatch], segment: int):
    for batch in batches:
        out = []
        for page, url, html, again, to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "again", "to")), strict=True):
            payload = (html or "").encode()
            sha = digest(payload)
            if not again:
                out += response(page, url, payload, record_id("response", page, sha), segment)
            else:
                out.append(record("revisit", record_id("revisit", page, sha), HTTP, WARC_Target_URI=_one_line(url), X_Page_ID=page, WARC_Profile=PROFILE, WARC_Refers_To=record_id("response", to, sha), WARC_Payload_Digest=f"sha1:{sha}"))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def write_archive(pages: DataFrame, least: int = 0, segment: int = SEGMENT) -> DataFrame:
    """Column ``member``: the archive's gzip members, one for each record.

    Payloads of fewer than ``least`` bytes are never revisits. pages is read twice.
    """
    base = pages.select("page_id", "url", "html", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("sha"))
    large = base.where(F.coalesce(F.octet_length("html"), F.lit(0)) >= least)
    tops = large.groupBy(F.col("sha").alias("s")).agg(F.max("page_id").alias("to"), F.count("*").alias("n"))
    tops = cut(tops.where("n > 1").select("s", "to"))  # payloads that occur once need no join
    if tops.count() <= BROADCAST_ROWS:
        tops = F.broadcast(tops)
    joined = base.join(tops, F.col("sha") == F.col("s"), "left")
    again = F.col("s").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("to"))
    return joined.select("page_id", "url", "html", again.alias("again"), "to").mapInArrow(lambda it: _write(it, segment), "member binary")


def write_files(archive: DataFrame, path: str, records_a_file: int = FILE_RECORDS) -> str:
    """Writes the members to .warc.gz files in a new folder, and returns its path."""
    empty = gzip.compress(b"", mtime=0).decode("latin-1")
    writer = archive.select(F.col("member").cast("string").alias("value")).write
    writer.option("encoding", "ISO-8859-1").option("lineSep", empty).option("maxRecordsPerFile", records_a_file).text(path)
    spark = archive.sparkSession
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = own.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(own):
        old = f.getPath()
        if old.getName().startswith("part-"):
            fs.rename(old, spark._jvm.org.apache.hadoop.fs.Path(own, old.getName().removesuffix(".txt") + ".warc.gz"))
    return path


_FIELDS = {"warc-type": "kind", "warc-record-id": "ident", "x-page-id": "page", "warc-payload-digest": "sha", "warc-refers-to": "refers", "warc-segment-origin-id": "origin", "warc-segment-number": "number", "warc-segment-total-length": "total"}
_RECORD = "kind string, ident string, page string, sha string, refers string, origin string, number int, total long, block binary"


def _inflated(data, size: int = 1 << 16) -> Iterator[bytes]:
    """The bytes of gzip members, one after another, or of plain data, piece by piece."""
    view, at = memoryview(data), 0
    while bytes(view[at : at + 2]) == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        while not d.eof:
            part = view[at : at + size]
            if not part:
                raise ValueError("a gzip member is cut off")
            out = d.decompress(part)
            at += len(part) - len(d.unused_data)
            if out:
                yield out
    while at < len(view):
        yield bytes(view[at : at + size])
        at += size


def records(data) -> Iterator[dict]:
    """The records of an archive or of a part that begins at one; gzip members or plain. ValueError if it is cut off."""
    pieces, held, at = _inflated(data), bytearray(), 0

    def more():
        nonlocal at
        part = next(pieces, None)
        if part is None:
            return False
        del held[:at]
        at = 0
        held.extend(part)
        return True

    while at < len(held) or more():
        seen = at
        while (end := held.find(b"\r\n\r\n", seen)) < 0:
            back = max(0, len(held) - 3 - at)
            if not more():
                raise ValueError("a record is cut off")
            seen = back
        head = {}
        for line in bytes(held[at:end]).split(EOL)[1:]:
            k, _, v = line.partition(b":")
            head[k.strip().lower().decode()] = v.strip().decode()
        size, at = int(head["content-length"]), end + 4
        while len(held) < at + size + 4:
            if not more():
                raise ValueError("a record is cut off")
        yield {f: head.get(k) for k, f in _FIELDS.items()} | {"block": bytes(held[at : at + size])}
        at += size + 4


def _parse(batches: Iterator[pa.RecordBatch]):
    names = [x.split()[0] for x in _RECORD.split(", ")]
    types = {"number": pa.int32(), "total": pa.int64(), "block": pa.binary()}
    for batch in batches:
        rows = [r for m in batch.column("member") if m.is_valid for r in records(m.as_buffer())]
        for r in rows:
            r["number"], r["total"] = (int(r[k]) if r[k] else None for k in ("number", "total"))
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in names], names)


def _payload(block: bytes, sha: str | None) -> bytes | None:
    head, _, body = block.partition(b"\r\n\r\n")
    try:
        payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    except ValueError:
        return None
    return payload if sha is None or sha == f"sha1:{digest(payload)}" else None


def _reassemble(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            parts = sorted({p["number"] or 1: p for p in r["parts"]}.items())
            parts = [p for _, p in parts]
            copies = max(1, sum((p["number"] or 1) == 1 for p in r["parts"]))
            first = parts[0]
            block = b"".join(p["block"] for p in parts)
            whole = first["kind"] == "response" and (first["number"] is None and len(parts) == 1 or [p["number"] for p in parts] == list(range(1, len(parts) + 1)) and parts[-1]["total"] == len(block))
            payload = _payload(block, first["sha"]) if whole else None
            rows += copies * [(r["ident"], first["page"], None if payload is None else len(payload), None if payload is None else digest(payload), len(parts), payload is not None, payload)]
        cols = list(zip(*rows, strict=True)) or [()] * 7
        types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["ident", "page", "payload_bytes", "payload_digest", "n_segments", "complete", "payload"])


def read_responses(archive: DataFrame) -> DataFrame:
    """ident, page (id as text), payload_bytes, payload_digest, n_segments, complete, payload of each response."""
    return _responses(archive.select("member").mapInArrow(_parse, _RECORD))


def _responses(rows: DataFrame) -> DataFrame:
    part = F.struct("kind", "page", "sha", "number", "total", "block")
    own = rows.where("kind in ('response', 'continuation')").select(F.coalesce("origin", "ident").alias("ident"), "number", part.alias("part"))
    single = own.where("number is null").select("ident", F.array("part").alias("parts"))
    many = own.where("number is not null").groupBy("ident").agg(F.collect_list("part").alias("parts"))  # the segments of one record
    return single.union(many).mapInArrow(_reassemble, "ident string, page string, payload_bytes long, payload_digest string, n_segments int, complete boolean, payload binary")


def read_archive(archive: DataFrame, page_type: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, n_segments, complete: a row for each page."""
    rows = archive.select("member").mapInArrow(_parse, _RECORD)
    found = cut(_responses(rows).drop("payload"))
    page = F.col("page").cast(page_type)
    revisits = rows.where("kind = 'revisit'").select(page.alias("page_id"), F.col("refers"))
    of = found.groupBy("ident").agg(F.any_value(page).alias("refers_to"), F.any_value("payload_bytes").alias("payload_bytes"), F.any_value("payload_digest").alias("payload_digest"), F.bool_and("complete").alias("complete"))
    again = revisits.join(of, F.col("refers") == F.col("ident"), "left").select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to", F.lit(0).alias("n_segments"), F.coalesce("complete", F.lit(False)).alias("complete"))
    return found.select(page.alias("page_id"), "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast(page_type).alias("refers_to"), "n_segments", "complete").union(again)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Column ``member`` of the .warc and .warc.gz files of a folder, a row for each: no larger than Spark's 2 GB a value."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc{,.gz}").load(path)
    return files.select(F.col("content").alias("member"))

"""Legacy archives to WARC.

An ARC file begins with a version block (``filedesc://``) whose body names the version and the fields of the URL
records' header lines; each record is a header line, the declared number of bytes, and a newline. Version 1 lines are
URL, IP, date, type, length; version 2 adds result code, checksum, location, offset and file name before the length.
The converter parses them by version and declared length, and synthesises for each record the WARC identifier,
timestamp, type and digests. Of records with equal payloads one is a response, the others revisits of it.

WARC files are written by Spark's text writer with the record separator as line separator: a value's bytes go out as
they are. They are read back as binary files, by declared lengths.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The field lists of the two versions of the format.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORD = "id string, url string, ip string, date string, mime string, block binary, payload_at int, digest string, block_digest string, kind string"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- writing legacy archives -------------------------------------------------------------------------------------


def _quoted(url: str | None) -> str:
    """A header line is split at spaces, so white space and control characters in a URL are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "") or "-"


def arc_records(version: int, name: str, pages) -> bytes:
    """An ARC file of (url, ip, 14-digit date, content type, status, block) records."""
    body = f"{version} 0 quaywork\n{FIELDS[version]}\n\n".encode()
    out = [_arc_line(version, f"filedesc://{name}", "0.0.0.0", "20240101000000", "text/plain", 200, len(body)), body]
    for url, ip, date, mime, status, block in pages:
        out += [_arc_line(version, _quoted(url), ip, date, mime, status, len(block)), block, b"\n"]
    return b"".join(out)


def _arc_line(version: int, url: str, ip: str, date: str, mime: str, status: int, length: int) -> bytes:
    middle = "" if version == 1 else f" {status} - - 0 -"
    return f"{url} {ip} {date} {mime}{middle} {length}\n".encode()


def pages_to_arc(pages: DataFrame, target: int = 4 << 20) -> DataFrame:
    """(name, content): pages (page_id, url, html) as ARC files of about ``target`` bytes, of both versions in turn.

    The block is an HTTP response whose headers carry the page's id; the payload is the html in UTF-8 (null: empty).
    """

    def run(batches):
        from pyspark import TaskContext

        task, n, waiting, size = TaskContext.get().partitionId(), 0, [], 0

        def made():
            nonlocal n, waiting, size
            name = f"part-{task:06d}-{n:06d}.arc"
            blob = arc_records(1 + (task + n) % 2, name, waiting)
            n, waiting, size = n + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([blob], pa.binary())], names=["name", "content"])

        for batch in batches:
            for i, url, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                payload = html.encode("utf-8", "surrogatepass") if html else b""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {'' if i is None else i}\r\n\r\n"
                seconds = (i or 0) % 86400
                date = f"20240101{seconds // 3600:02d}{seconds // 60 % 60:02d}{seconds % 60:02d}"
                waiting.append((url, "0.0.0.0", date, "text/html", 200, head.encode() + payload))
                size += len(payload)
                if size >= target:
                    yield made()
        if waiting:
            yield made()

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "name string, content binary")


# --- parsing legacy archives ---------------------------------------------------------------------------------------


def parse_arc(content: bytes):
    """Dicts of the records' header fields, with their ``block``, by the version that the file declares."""
    at, fields = 0, None
    while at < len(content):
        if content[at : at + 1] in (b"\n", b"\r"):  # between records
            at += 1
            continue
        end = content.index(b"\n", at)
        line = content[at:end].rstrip(b"\r").decode("utf-8", "surrogateescape")
        if fields is None:
            if not line.startswith("filedesc://"):
                raise ValueError("an ARC file begins with its version block")
            length = int(line.rsplit(" ", 1)[1])
            body = content[end + 1 : end + 1 + length].decode("utf-8", "replace").split("\n")
            version = int(body[0].split(" ")[0])
            fields = (body[1].strip() or FIELDS[version]).split(" ")
            at = end + 1 + length
            continue
        values = line.split(" ")
        if len(values) > len(fields):  # a URL with spaces, from the left
            extra = len(values) - len(fields)
            values = [" ".join(values[: extra + 1]), *values[extra + 1 :]]
        record = dict(zip(fields, values, strict=True))
        length = int(record["Archive-length"])
        if end + 1 + length > len(content):
            raise ValueError(f"the record of {record['URL']} is cut short")
        yield record | {"block": content[end + 1 : end + 1 + length]}
        at = end + 1 + length


def _payload_at(block: bytes) -> int:
    """Where the payload begins: after the headers of an HTTP response, else at the start."""
    if not block.startswith(b"HTTP/"):
        return 0
    at = block.find(b"\r\n\r\n")
    return at + 4 if at >= 0 else len(block)


def convert(archives: DataFrame) -> DataFrame:
    """(id, url, ip, date, mime, block, payload_at, digest, block_digest, kind) of ARC files (name, content).

    The identifier is a name-based UUID of file and place, so a task that runs again makes the same one; digests are
    SHA-1 in base 32; the type is ``response`` for HTTP and ``resource`` for anything else.
    """

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cols = [[] for _ in range(10)]
                for n, r in enumerate(parse_arc(content or b"")):
                    d, block, url = r["Archive-date"].ljust(14, "0"), r["block"], r["URL"]
                    p = _payload_at(block)
                    when = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                    row = (f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{n}')}", url, r["IP-address"], when, r["Content-type"], block, p, digest32(block[p:]), digest32(block), "response" if p else "resource")
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                types = [pa.string()] * 5 + [pa.binary(), pa.int32()] + [pa.string()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")])

    return archives.mapInArrow(run, RECORD)


def mark_revisits(records: DataFrame, order: str, at_least: int = 0) -> DataFrame:
    """``records`` with ``refers_to``: for those with a payload (of ``at_least`` bytes) that another also has, the
    identifier of the one with the largest ``order``; null for that one and for all others. Of records that tie, the
    one with the largest identifier is referred to, and those of its ``order`` are responses like it.
    """
    size = F.octet_length("block") - F.col("payload_at")
    keyed = records.withColumn("_size", size)
    heads = keyed.where(F.col("_size") >= at_least).groupBy("digest", "_size").agg(F.max(F.struct(order, "id")).alias("_head"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    joined = keyed.join(heads, ["digest", "_size"], "left")
    other = F.col("_head").isNotNull() & ~F.col(order).eqNullSafe(F.col(f"_head.{order}"))
    return joined.withColumn("refers_to", F.when(other, F.col("_head.id"))).drop("_size", "_head")


# --- WARC ----------------------------------------------------------------------------------------------------------


def _warc_rows(batches):
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            block, kind = r["block"], r["kind"]
            extra = []
            if r["refers_to"]:
                kind, block = "revisit", block[: r["payload_at"]]
                extra = [f"WARC-Refers-To: <{r['refers_to']}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
            lines = [
                "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{r['id']}>", f"WARC-Date: {r['date']}", f"WARC-Target-URI: {r['url']}", f"WARC-IP-Address: {r['ip']}",
                f"WARC-Payload-Digest: sha1:{r['digest']}", f"WARC-Block-Digest: sha1:{digest32(block) if r['refers_to'] else r['block_digest']}", *extra,
                f"Content-Type: {'application/http; msgtype=response' if r['payload_at'] else r['mime']}", f"Content-Length: {len(block)}", "", "",
            ]
            out.append("\r\n".join(lines).encode("utf-8", "surrogateescape") + block)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write_warc(records: DataFrame, path: str, per_file: int = 2000) -> None:
    """WARC files (gzip over each whole file) in the folder ``path``, of at most ``per_file`` records."""
    cols = ["id", "url", "ip", "date", "mime", "block", "payload_at", "digest", "block_digest", "kind", "refers_to"]
    rows = records.select(cols).mapInArrow(_warc_rows, "value binary")
    # a cast keeps the bytes as they are; two line ends close each record
    rows.select(F.col("value").cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse_warc(content: bytes):
    """(headers, block) of each record, by declared lengths."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a WARC record begins with its version")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        start = end + 4
        stop = start + int(headers["Content-Length"])
        yield headers, content[start:stop]
        at = stop + 4


READ = "id string, kind string, url string, date string, digest string, refers_to string, http string, payload binary, payload_bytes long"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files in ``path``, a file at a time: their headers, HTTP headers and payload.

    ``payload_bytes`` is that of the full payload, also for revisits, which keep the HTTP headers of the original.
    """

    def run(batches):
        import gzip

        for batch in batches:
            for blob in batch.column(0).to_pylist():
                cols = [[] for _ in range(9)]
                for h, block in parse_warc(gzip.decompress(blob) if blob[:2] == b"\x1f\x8b" else blob):
                    http = h.get("Content-Type", "").startswith("application/http")
                    p = block.find(b"\r\n\r\n") + 4 if http else 0
                    head, payload = block[:p].decode("utf-8", "surrogateescape"), block[p:]
                    full = len(payload)
                    if h["WARC-Type"] == "revisit":
                        full = next((int(x.split(":")[1]) for x in head.split("\r\n") if x.lower().startswith("content-length:")), 0)
                    row = (h["WARC-Record-ID"].strip("<>"), h["WARC-Type"], h["WARC-Target-URI"], h["WARC-Date"], h["WARC-Payload-Digest"].removeprefix("sha1:"), h.get("WARC-Refers-To", "").strip("<>") or None, head, payload, full)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                types = [pa.string()] * 7 + [pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in READ.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READ)


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Pages to ARC, to WARC files in ``path``, and back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Null html is an empty payload; rows without a page id sort below all others. An empty table gives no rows;
    repeated rows give a record each, those of the referred-to id being responses. Other columns are ignored.
    """
    spark = pages.sparkSession
    page = F.regexp_extract(F.decode(F.substring("block", 1, 400), "ISO-8859-1"), r"X-Page-Id: (-?\d+)", 1)
    records = convert(pages_to_arc(pages)).withColumn("page_id", page.try_cast("long"))
    write_warc(mark_revisits(records, "page_id"), path)
    back = read_warc(spark, path).select("id", "kind", "digest", "refers_to", "payload_bytes", F.regexp_extract("http", r"X-Page-Id: (-?\d+)", 1).try_cast("long").alias("page_id"))
    targets = back.join(back.where("refers_to is not null").select(F.col("refers_to").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("refers_to"), F.col("page_id").alias("target"))
    # a response looks for itself, so that not all of them share the key null
    keyed = back.withColumn("key", F.coalesce("refers_to", "id")).join(targets.withColumnRenamed("refers_to", "key"), "key", "left")
    target = F.when(F.col("refers_to").isNotNull(), F.col("target"))
    return keyed.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), target.alias("refers_to"))


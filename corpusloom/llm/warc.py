"""WARC archives: a writer with revisit records and a splittable reader.

The reader's tasks each take a byte range of a file. They look for gzip magic from the range's beginning on, check a
candidate by decoding it until the WARC header shows, and own the records whose member starts inside their range; the last
one is read past its end. A record's member is inflated in pieces, and one record at a time is in memory.

Digests and sizes are those of the payload as it was read back; a record whose payload does not have the digest that its
header states is reported as not intact, and so is one whose member cannot be inflated to its end (its digest is null). A
revisit is intact if a response with the stated page and digest was read.

Files are written to a new name by each task attempt; only those that the written manifest names are read.

Cases: a null html is an empty payload, a null url is left out; payloads of any length that a Spark string has go through,
one at a time; rows that repeat a page are records each; a null page_id is kept as such; an empty table gives an empty
manifest, and that no records. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, scratch, ship

_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:corpusloom:page:"
_MAGIC = b"\x1f\x8b\x08"
_STEP = 1 << 18


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record; a revisit (refers_to not null) has the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_URN}{'null' if page_id is None else page_id}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _writer(base: str, roll: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(base)
        store.create_dir(folder, recursive=True)
        out, path, size, n = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{base}/{path}"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["path", "size", "records"])

        for t in batches:
            for k in range(t.num_rows):
                page_id, url, payload, digest, length, refers_to = (t.column(c)[k].as_py() for c in range(6))
                if out is None:
                    path, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{folder}/{path}", compression=None)
                c = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = c.compress(record(page_id, url, payload or b"", digest, length, refers_to)) + c.flush()
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= roll:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return run


def write_warc(pages: DataFrame, *, least_bytes: int = 100, roll: int = 64 << 20, level: int = 4) -> DataFrame:
    """pages (page_id, url, html) -> manifest (path, size, records) of archives in the shared folder.

    Of records with equal payloads (html in UTF-8; null is empty) of at least `least_bytes`, that with the smallest
    page_id is a response and the others revisit it; rows that repeat this page_id are responses too. Rows with a null
    page_id refer to the group's smallest, and are responses where the group has none.
    """
    spark = pages.sparkSession
    ship(spark)
    base = f"{scratch(spark)}/corpusloom/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    first = rows.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(first, "digest", "left").withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")))
    rows = rows.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "digest", "bytes", "refers_to")
    return saved(rows.mapInArrow(_writer(base, roll, level), "path string, size long, records long"), "manifest")


def _inflated(f, at: int, size: int, step: int, need: int | None = None) -> tuple[bytes, int | None]:
    """What the gzip member at a place holds, at least `need` bytes of it, and where it ends; None for that if it isn't whole.

    step: bytes inflated at once, of which the last ones are lost where the member is damaged.
    """
    d, out, got, pos, data = zlib.decompressobj(31), [], 0, at, b""
    f.seek(at)
    try:
        while not d.eof:
            if not data:
                data = f.read(min(4096 if need else _STEP, size - pos))
                if not data:
                    break
                pos += len(data)
            out.append(d.decompress(data, step))
            data, got = d.unconsumed_tail, got + len(out[-1])
            if need and got >= need:
                break
    except zlib.error:
        return b"".join(out), None
    return b"".join(out), pos - len(d.unused_data) if d.eof else None


def records_in(f, size: int, start: int, end: int) -> Iterator[tuple[int, bytes, bool]]:
    """(place, record, whether it is whole) of the WARC records whose member starts in [start, end)."""
    at = start
    while at < end:
        f.seek(at)
        window = f.read(min(_STEP, size - at))
        hit = window.find(_MAGIC)
        if hit < 0 or at + hit >= end:
            if at + len(window) >= min(end, size):
                return
            at += max(1, len(window) - len(_MAGIC) + 1)
            continue
        at += hit
        if not _inflated(f, at, size, 64, need=64)[0].startswith(b"WARC/1."):
            at += 1
            continue
        raw, after = _inflated(f, at, size, 1 << 20)
        if after is None:
            raw = _inflated(f, at, size, 256)[0]
        yield at, raw, after is not None
        at = at + 1 if after is None else after


def parse(raw: bytes) -> dict:
    """Headers (lower-cased names) and block of a record, and of an HTTP block its head and payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    block = rest[: int(length)] if length.isdigit() else rest
    http, _, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    return {"fields": fields, "http": http, "payload": payload}


def _page(urn: str) -> int | None:
    value = urn.strip("<>").removeprefix(_URN)
    return int(value) if value.lstrip("-").isdigit() else None


def _reader(keep_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for r in t.to_pylist():
                store, path = filesystem(r["path"])
                rows: list[tuple] = []
                with store.open_input_file(path) as f:
                    for at, raw, whole in records_in(f, r["size"], r["start"], r["end"]):
                        got = parse(raw)
                        h = got["fields"]
                        kind, payload = h.get("warc-type", ""), got["payload"]
                        stated, size = h.get("warc-payload-digest", "").removeprefix("sha256:"), len(payload)
                        if not whole:
                            digest, intact = None, False
                        elif kind == "revisit":
                            told = [x.split(b":")[1].strip() for x in got["http"].split(b"\r\n") if x.lower().startswith(b"content-length:")]
                            digest, intact, size = stated, None, int(told[0]) if told and told[0].isdigit() else 0
                        else:
                            digest = hashlib.sha256(payload).hexdigest()
                            intact = digest == stated
                        refers = h.get("warc-refers-to")
                        uri = h.get("warc-target-uri")
                        uri = uri and uri.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                        rows.append((_page(h.get("warc-record-id", "")), uri, kind, size, digest, _page(refers) if refers else None, intact, payload if keep_payload else None, r["path"], at))
                        if len(rows) >= 64:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return run


_RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, intact boolean, payload binary, path string, place long"
_TYPES = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.string(), pa.int64())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in _RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_TYPES)], names)


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size) of the files of a folder, as the reader takes them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("size"))


def read_warc(files: DataFrame, *, split: int = 8 << 20, keep_payload: bool = True) -> DataFrame:
    """(path, size) of gzip WARC files -> a row for each record, whatever byte range it starts in, with its intact."""
    spark = files.sparkSession
    ship(spark)
    ranges = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split).cast("long"))))
    ranges = ranges.select("path", "size", "start", F.least(F.col("start") + split, F.col("size")).alias("end"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(parts, "path", "start").mapInArrow(_reader(keep_payload), _RECORD)


def checked_revisits(records: DataFrame) -> DataFrame:
    """The records with `intact` of revisits: whether the response that they name was read with the digest that they state."""
    records = saved(records, "records")
    of = records.where("record_type = 'response' and intact").select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")).distinct()
    # one response may have very many revisits: a plain join, which adaptive execution can split
    named = (F.col("record_type") == "revisit") & (F.col("refers_to") == F.col("_page")) & (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes"))
    intact = F.when((F.col("record_type") == "revisit") & F.col("intact").isNull(), F.col("_page").isNotNull()).otherwise(F.col("intact"))
    return records.join(of, named, "left").withColumn("intact", intact).drop("_page", "_digest", "_bytes")

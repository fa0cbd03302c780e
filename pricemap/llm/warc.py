"""WARC archives: write captures, read records, assemble transactions.

A capture is three records: a request, a response (or a revisit of an equal payload) and metadata; the
first and the last name the response's record in ``WARC-Concurrent-To``.  Every record is its own gzip
member.  Reading streams the archives record by record; the records of a capture meet again through
the concurrent-to identifiers.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricemap.llm.store import WholeFile, filesystem, new_dir, saved
from pricemap.work import qualified

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:pricemap:warc")
#: Bytes that may not stand in a header line.
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")

RECORD_SCHEMA = (
    "type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, digest string, "
    "http_length long, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"
)


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _named(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, '|'.join(map(str, parts)))}>"


def _record(kind: str, record_id: str, block: bytes, content_type: str, **more: str | None) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": DATE, **{k.replace("_", "-"): v for k, v in more.items() if v is not None}}
    head |= {"Content-Type": content_type, "Content-Length": str(len(block))}
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in head.items()), b"", b""]
    press = zlib.compressobj(4, zlib.DEFLATED, 31)
    return press.compress(b"\r\n".join(lines) + block + b"\r\n\r\n") + press.flush()


def capture_records(page_id, url: str | None, payload: bytes, key: str, copy: int, refers_to: str | None) -> list[bytes]:
    """The three records of one page; ``refers_to`` is the response's record where this one revisits it."""
    uri = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else None
    host, _, path = (uri or "").partition("://")[2].partition("/")
    own = _named(key, copy, "response")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    digest = "sha1:" + payload_digest(payload)
    answer = "application/http; msgtype=response"
    if refers_to:
        main = _record("revisit", own, http, answer, WARC_Target_URI=uri, WARC_Payload_Digest=digest, WARC_Refers_To=refers_to, WARC_Profile=PROFILE)
    else:
        main = _record("response", own, http + payload, answer, WARC_Target_URI=uri, WARC_Payload_Digest=digest)
    request = f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode("utf-8", "replace")
    fields = (f"page-id: {page_id}\r\n" if page_id is not None else "").encode()
    return [
        _record("request", _named(key, copy, "request"), request, "application/http; msgtype=request", WARC_Target_URI=uri, WARC_Concurrent_To=own),
        main,
        _record("metadata", _named(key, copy, "metadata"), fields, "application/warc-fields", WARC_Target_URI=uri, WARC_Concurrent_To=own),
    ]


def write_captures(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) as a capture; (path, n_bytes) per archive.

    Of rows with equal payloads of ``least_bytes`` or more, the one with the smallest page_id is a
    response and the others revisit it; smaller payloads are all responses.  A null html is an empty
    payload; a null url leaves the target out; rows that repeat a page_id and payload are captures of
    their own, of which the first is the response; null page_ids come after all others.
    """
    path = qualified(pages.sparkSession, path)
    raw = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), raw.alias("payload"))
    keyed = rows.withColumn("digest", F.sha1("payload")).withColumn("key", F.concat_ws("/", "digest", F.col("page_id").cast("string")))
    # which payloads repeat, from digests alone
    narrow = keyed.select("digest", "key", "page_id", F.length("payload").alias("size"))
    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"), F.first("size").alias("size"))
    firsts = firsts.filter((F.col("n") > 1) & (F.col("size") >= least_bytes)).select("digest", "first")
    shared = narrow.select("digest", "key").distinct().join(firsts.hint("merge"), "digest")
    shared = saved(shared.select("key", "first", F.concat_ws("/", "digest", F.col("first").cast("string")).alias("first_key")), "warc-shared")
    # the key holds the page, so a payload that many pages share is spread over all tasks
    copy = F.row_number().over(Window.partitionBy("key").orderBy(F.col("url").asc_nulls_first()))
    placed = keyed.withColumn("copy", copy).join(shared.hint("merge"), "key", "left")

    def write(batches):
        name = f"{path}/capture-{uuid.uuid4().hex}.warc.gz"
        out = None
        for batch in batches:
            for page_id, url, payload, key, number, first_key in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "key", "copy", "first_key"))):
                revisits = first_key is not None and (key, number) != (first_key, 1)
                if out is None:
                    out = WholeFile(name)
                for record in capture_records(page_id, url, payload, key, number, _named(first_key, 1, "response") if revisits else None):
                    out.write(record)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([out.close()], pa.int64())], ["path", "n_bytes"])

    columns = placed.select("page_id", "url", "payload", "key", "copy", "first_key")
    # only the archives that this table names are read: a task that ran twice left another file that it doesn't name
    return saved(columns.mapInArrow(write, "path string, n_bytes long"), "warc-files")


def _records(stream):
    """(headers with lower-case names, block) of each record of a decompressed archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        yield head, stream.read(int(head["content-length"]))


def read_records(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the archives; payload sizes and digests are computed from what was read."""

    def read(batches):
        names = RECORD_SCHEMA_NAMES
        for batch in batches:
            for path in batch.column("path").to_pylist():
                where, name = filesystem(path)
                rows = []
                with where.open_input_stream(name, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, block in _records(stream):
                        rows.append(_row(head, block, with_payload))
                        if len(rows) >= 256:
                            yield _batch(rows, names)
                            rows = []
                yield _batch(rows, names)

    n = files.count()
    return files.select("path").repartition(max(1, min(n, 4096))).mapInArrow(read, RECORD_SCHEMA)


RECORD_SCHEMA_NAMES = [x.split()[0] for x in re.sub(r"<.*?>", "", RECORD_SCHEMA).split(", ")]


def _row(head: dict, block: bytes, with_payload: bool) -> tuple:
    kind, http_length, payload, fields = head.get("warc-type"), None, None, None
    if kind in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        for line in http.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length":
                http_length = int(value)
        payload = payload if kind == "response" else None
    elif kind == "metadata":
        fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").splitlines() if x)]
    digest = (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None
    own = payload_digest(payload) if payload is not None else None
    if own and digest and own != digest:
        raise ValueError(f"the payload of {head.get('warc-record-id')} doesn't have the digest that its header states")
    found = (kind, head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"), digest, http_length)
    return (*found, len(payload) if payload is not None else None, own, fields, payload if with_payload else None)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string()] * 7 + [pa.int64()] * 2 + [pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, request, response, metadata (null where a record is missing).

    Records without a concurrent-to identifier stand for themselves, so a request or metadata record
    whose response isn't there gives a capture without a response.  Of several records of one kind the
    one with the smallest record_id stays, and n_records counts them all.
    """
    capture = F.coalesce("concurrent_to", "record_id")
    main = F.struct("record_id", "type", "target_uri", "date", "digest", "refers_to", "http_length", "payload_bytes", "payload_digest", "payload")
    request = F.struct("record_id", "target_uri", "date")
    metadata = F.struct("record_id", F.col("fields")["page-id"].alias("page_id"), "date")
    return (
        records.withColumn("capture", capture)
        .groupBy("capture")
        .agg(
            F.min(F.when(F.col("type") == "request", request)).alias("request"),
            F.min(F.when(F.col("type").isin("response", "revisit"), main)).alias("response"),
            F.min(F.when(F.col("type") == "metadata", metadata)).alias("metadata"),
            F.count("*").alias("n_records"),
        )
        .withColumnRenamed("capture", "record_id")
    )


def page_captures(captures: DataFrame) -> DataFrame:
    """Per capture with a response: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri.

    A revisit has no payload of its own: its size is the one its HTTP header states, and refers_to is
    the page of the response that it names.
    """
    own = captures.filter(F.col("response").isNotNull()).select(
        "record_id",
        F.col("metadata.page_id").cast("long").alias("page_id"),
        F.coalesce("response.payload_bytes", "response.http_length").alias("payload_bytes"),
        F.coalesce("response.payload_digest", "response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("refers_id"),
        F.col("response.target_uri").alias("target_uri"),
    )
    own = saved(own, "captures")
    revisits = own.filter(F.col("refers_id").isNotNull())
    named = revisits.select("refers_id").distinct()
    first = own.select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to")).join(named.hint("merge"), "refers_id", "left_semi")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]
    resolved = revisits.join(first.hint("merge"), "refers_id", "left").select(*out)
    rest = own.filter(F.col("refers_id").isNull()).withColumn("refers_to", F.lit(None).cast("long")).select(*out)
    return resolved.unionByName(rest)


def round_trip(pages: DataFrame, least_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write the archives of ``pages``, read them back and assemble the captures."""
    where = path or new_dir(pages.sparkSession, "warc")
    return page_captures(assemble(read_records(write_captures(pages, where, least_bytes))))

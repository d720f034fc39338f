"""WARC archives: writer with revisit records and a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import new_folder, stored

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
#: Bytes of an archive that one reading task scans.
SPLIT = 4 << 20
#: Reading tasks at most; beyond it a task takes several ranges.
MOST_TASKS = 20_000
#: Bytes read at once.
CHUNK = 1 << 20
#: Payloads of fewer bytes are always stored in full.
MIN_REVISIT = 0
#: The date of all records unless another is given: the tables hold none, and two runs write the same records.
DATE = "2000-01-01T00:00:00Z"
#: Groups of equal payloads are broadcast up to so many rows, otherwise joined by sort and merge.
BROADCAST_ROWS = 1_000_000

READ = (
    "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, "
    "payload binary, path string, at long"
)


def _open(path: str, mode: str):
    """A file of the shared folder, by its own file system."""
    if path.startswith("file:"):
        return open("/" + path.removeprefix("file:").lstrip("/"), mode)
    if "://" not in path:
        return open(path, mode)
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_output_stream(inner) if "w" in mode else system.open_input_file(inner)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, page_id: int | None, url: str | None, payload_digest: str) -> str:
    """The same id for the same record in every run, so that a revisit can name its response without having seen it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr((kind, page_id, url, payload_digest)))}>"


def _packed(fields: list[tuple[str, str]], block: bytes) -> bytes:
    text = VERSION + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]).encode() + b"\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(text + block + b"\r\n\r\n") + pack.flush()


def _header(name: str, value: str) -> list[tuple[str, str]]:
    """A header field; a value that no header line can hold as it is goes into a second one, in base64."""
    plain = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)
    if plain == value and value:
        return [(name, value)]
    return [(name, plain), (f"X-Exact-{name}", base64.b64encode(value.encode("utf-8", "surrogatepass")).decode())]


def info(name: str, date: str = DATE) -> bytes:
    """The record that opens an archive."""
    fields = [
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", record_id("warcinfo", None, name, "")),
        ("WARC-Date", date),
        ("WARC-Filename", name),
        ("Content-Type", "application/warc-fields"),
    ]
    return _packed(fields, b"format: WARC File Format 1.1\r\n")


def record(
    page_id: int | None,
    url: str | None,
    payload: bytes,
    payload_digest: str,
    refers_to: tuple[int | None, str | None] | None,
    date: str = DATE,
) -> bytes:
    """One WARC record as one gzip member. With ``refers_to``, the page_id and url of the response that holds the payload,
    it is a revisit, which keeps the HTTP head, with the length of the payload that it leaves out."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "response" if refers_to is None else "revisit"
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(kind, page_id, url, payload_digest)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if url is not None:
        fields += _header("WARC-Target-URI", url)
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        first, first_url = refers_to
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("WARC-Refers-To", record_id("response", first, first_url, payload_digest)))
        fields.append(("WARC-Refers-To-Date", date))
        if first_url is not None:
            fields += _header("WARC-Refers-To-Target-URI", first_url)
        if first is not None:
            fields.append(("X-Refers-To-Page-ID", str(first)))
    return _packed(fields, head + payload if refers_to is None else head)


def write_archives(pages: DataFrame, min_revisit: int = MIN_REVISIT, date: str = DATE) -> DataFrame:
    """Write every page to gzip archives in the shared folder; returns the manifest (path, bytes, records).

    Of pages with equal payloads of at least ``min_revisit`` bytes the one with the largest page_id is stored, the
    others refer to it. The choice is made on digests alone; groups are summed before they are shuffled and only those
    with several pages are joined back, by broadcast if they are few, else by a join whose hot keys the engine may split.
    Each task writes files of its own under unguessable names and only what a finished task reports enters the manifest, so
    a task may run again.
    """
    folder = new_folder(pages.sparkSession, "warc")
    html = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload")).withColumn(
        "sha", F.sha1("payload")
    )
    firsts = (
        rows.select("page_id", "url", "sha", F.octet_length("payload").alias("n"))
        .where(F.col("n") >= min_revisit)
        .groupBy("sha")
        .agg(F.max(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("times"))
        .where("times > 1")
        .select("sha", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"), F.lit(True).alias("shared"))
    )
    firsts = stored(firsts, "warc-firsts")
    few = firsts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    chosen = rows.join(F.broadcast(firsts) if few else firsts, "sha", "left").select(
        "page_id",
        "url",
        "payload",
        "first",
        "first_url",
        F.coalesce(F.col("shared") & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False)).alias("revisit"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for page_id, url, payload, first, first_url, revisit in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    out, head = _open(path, "wb"), info(path.rpartition("/")[2], date)
                    out.write(head)
                    size += len(head)
                member = record(page_id, url, payload, digest(payload), (first, first_url) if revisit else None, date)
                out.write(member)
                n, size = n + 1, size + len(member)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [n]})

    return stored(chosen.mapInArrow(write, "path string, bytes long, records long"), "warc-manifest")


def _member(data: bytes, at: int, source, offset: int) -> tuple[bytes, int] | None:
    """The gzip member at ``at`` of ``data`` if it holds a WARC record, and the archive offset after it."""
    unpack = zlib.decompressobj(31)
    end = offset + len(data)
    parts, seen, rest = [], b"", data[at:]
    try:
        while True:
            out = unpack.decompress(rest, 0 if len(seen) >= 7 else 64)
            parts.append(out)
            if len(seen) < 7:
                seen = b"".join(parts)
                if len(seen) >= 7 and not seen.startswith(b"WARC/1."):
                    return None
            if unpack.eof:
                return (b"".join(parts), end - len(unpack.unused_data)) if len(seen) >= 7 else None
            rest = unpack.unconsumed_tail
            if not rest:
                source.seek(end)
                rest = source.read(CHUNK)
                if not rest:
                    return None
                end += len(rest)
    except zlib.error:
        return None


def _records(source, low: int, high: int) -> Iterator[tuple[int, bytes]]:
    """Offset and content of the records that start in low..high-1.

    Members are found by their magic bytes; one counts only if it decodes to a WARC version line. After a record the next
    one starts where it ends, so the scan for magic bytes serves only to get in step.
    """
    at = low
    while at < high:
        source.seek(at)
        data = source.read(CHUNK + len(MAGIC) - 1)
        if len(data) < len(MAGIC):
            return
        k = 0
        while (k := data.find(MAGIC, k)) >= 0 and at + k < high:
            found = _member(data, k, source, at)
            if found is None:
                k += 1
                continue
            content, after = found
            yield at + k, content
            k = after - at
            if k >= len(data):
                break
        at = at + k if k >= len(data) else at + max(1, len(data) - len(MAGIC) + 1)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k.strip()}


def _value(fields: dict[str, str], name: str) -> str | None:
    exact = fields.get(f"x-exact-{name}")
    return fields.get(name) if exact is None else base64.b64decode(exact).decode("utf-8", "surrogatepass")


def _parse(content: bytes) -> tuple | None:
    """What a response or revisit record says; None for other kinds."""
    head, _, block = content.partition(b"\r\n\r\n")
    fields = _fields(head)
    if fields["warc-type"] not in ("response", "revisit"):
        return None
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["warc-type"] == "revisit"
    n = int(_fields(b"\r\n" + http if not http.startswith(b"HTTP") else http)["content-length"])
    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
    found = digest(payload) if not revisit else fields["warc-payload-digest"].removeprefix("sha1:")
    return (
        int(page) if page else None,
        _value(fields, "warc-target-uri"),
        fields["warc-type"],
        found,
        n if revisit else len(payload),
        int(refers) if refers else None,
        None if revisit else payload,
    )


def read_archives(manifest: DataFrame, split: int = SPLIT) -> DataFrame:
    """Read archives (path, bytes) in byte ranges; a record belongs to the range it starts in.

    Returns page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload (null for revisits), path, at.
    The digest of a response is computed from the payload read; a revisit's is the one its record names.
    """
    ranges = manifest.where("bytes > 0").select(
        "path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("low")
    )
    ranges = ranges.select("path", "low", F.least(F.col("low") + split, F.col("bytes")).alias("high"))
    schema = pa.schema(
        [
            ("page_id", pa.int64()),
            ("url", pa.string()),
            ("record_type", pa.string()),
            ("payload_digest", pa.string()),
            ("payload_bytes", pa.int64()),
            ("refers_to", pa.int64()),
            ("payload", pa.binary()),
            ("path", pa.string()),
            ("at", pa.int64()),
        ]
    )

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, low, high in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows, size = [], 0
                with _open(path, "rb") as source:
                    for at, content in _records(source, low, high):
                        if (found := _parse(content)) is None:
                            continue
                        rows.append((*found, path, at))
                        size += len(content)
                        if size > 8 << 20 or len(rows) >= 4096:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    spread = max(1, manifest.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 1)
    return ranges.repartition(min(spread, MOST_TASKS), F.col("path"), F.col("low")).mapInArrow(read, READ)


def archive_round_trip(pages: DataFrame, min_revisit: int = MIN_REVISIT, split: int = SPLIT) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives and read the archives back.

    Defined cases: a null html is an empty payload, like an empty text; a null page_id is kept as null and never chosen
    over an id; rows with equal page_id and payload are all stored if theirs is the largest id; a null url stays null, any
    other comes back as it was;
    an empty table writes nothing and gives no rows; other columns are ignored. Memory: a payload and its
    record, on reading those of 8 MB of records or one record.
    """
    return read_archives(write_archives(pages, min_revisit), split)

"""From legacy ARC archives to WARC, and back to rows.

An ARC file begins with a version block whose last line names the fields of the header
lines; version 1 has five of them, version 2 ten. Each record is one header line, the
declared number of bytes and a line end. The converter reads a file in two passes. The
first gives one small row per record: where it lies, the digest and length of its
payload, the identifier that the WARC record will have. Rows with equal payloads are
compared by Spark, which decides what becomes a ``response`` and what a ``revisit``. The
second pass writes a WARC file for each ARC file with these decisions. Payloads cross no
shuffle. Identifiers, timestamps, types and digests are synthesised from the ARC record
alone, so a repeated task writes the same bytes.

Files lie in the folder that the caller names and are written under a temporary name
first; a file holds a bounded number of bytes, one gzip member for each record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidegap.cluster import pin

# The header fields of the two ARC versions and names from the WARC standard.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Uncompressed bytes after which a new file is begun.
FILE_BYTES = 32 << 20
_LEVEL = 4
_HEAD_END = re.compile(rb"\r?\n\r?\n")
#: Header of a converted record with the length of its payload, which a revisit does not hold.
_LENGTH = "X-Payload-Length"
#: Name under which identifiers are derived.
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-to-warc")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _one_token(text: str) -> str:
    """Percent-encode what would break a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


class _Files:
    """Gzip files of bounded size that appear under their name only when complete."""

    def __init__(self, folder: str, stem: str, ending: str) -> None:
        self.fs, self.folder = arrow_fs.FileSystem.from_uri(folder)
        self.uri, self.stem, self.ending = folder, stem, ending
        self.number, self.out, self.size = 0, None, 0

    def name(self) -> str:
        return f"{self.stem}-{self.number:05d}.{self.ending}.gz"

    def write(self, record: bytes) -> None:
        if self.out is None:
            self.fs.create_dir(self.folder, recursive=True)
            self.attempt = f"{self.folder}/.{self.name()}.{TaskContext.get().taskAttemptId()}"
            self.out, self.size = self.fs.open_output_stream(self.attempt, compression=None), 0
        self.out.write(gzip.compress(record, _LEVEL, mtime=0))
        self.size += len(record)

    def close(self) -> str:
        self.out.close()
        self.out = None
        self.fs.move(self.attempt, f"{self.folder}/{self.name()}")
        self.number += 1
        return f"{self.uri}/{self.stem}-{self.number - 1:05d}.{self.ending}.gz"


def _open(uri: str):
    fs, path = arrow_fs.FileSystem.from_uri(uri)
    return gzip.GzipFile(fileobj=fs.open_input_stream(path, compression=None))


def _arc_record(version: int, values: dict[str, str], content: bytes) -> bytes:
    values = values | {"Archive-length": str(len(content))}
    line = " ".join(values.get(name, "-") for name in FIELDS[version].split())
    return line.encode() + b"\n" + content + b"\n"


def _version_block(version: int, name: str, date: str) -> bytes:
    content = f"{version} 0 tidegap\n{FIELDS[version]}\n\n".encode()
    return _arc_record(version, {
        "URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain",
        "Result-code": "200", "Offset": "0", "Filename": name}, content)


def write_arc(pages: DataFrame, folder: str, date: str = "20240101000000") -> DataFrame:
    """Write ``pages(page_id, url, html)`` as ARC files; returns their ``path``.

    Even partitions are written in version 1, odd ones in version 2. The page id is a
    header of the archived HTTP response. A null id has none; a null html is empty. An
    empty table writes no file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        version = 1 + number % 2
        files, done = _Files(folder, f"part-{number:06d}", "arc"), []
        for batch in batches:
            for page_id, url, html in zip(batch["page_id"].to_pylist(), batch["url"].to_pylist(),
                                          batch["html"].cast(pa.large_binary())):
                if files.out is None:
                    files.write(_version_block(version, files.name(), date))
                payload = html.as_py() or b""
                own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n"
                files.write(_arc_record(version, {
                    "URL": _one_token(url or "urn:page:unknown"), "IP-address": "0.0.0.0", "Archive-date": date,
                    "Content-type": "text/html", "Result-code": "200", "Checksum": f"{zlib.crc32(payload):08x}",
                    "Offset": str(files.size), "Filename": files.name()}, head.encode() + payload))
                if files.size > FILE_BYTES:
                    done.append(files.close())
        if files.out is not None:
            done.append(files.close())
        yield pa.RecordBatch.from_pydict({"path": pa.array(done, pa.string())})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return pin(rows.mapInArrow(write, "path string"), "arc")


def arc_records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """``fields, content`` of every record behind the version block."""
    with _open(uri) as file:
        names = list(FIELDS.values())[0].split()
        first = True
        while line := file.readline():
            if not line.strip():
                continue
            # The address is first and may hold anything but a line end; the rest does not hold spaces.
            width = next(len(f.split()) for f in FIELDS.values()) if first else len(names)
            values = line.rstrip(b"\r\n").decode("utf-8", "replace").rsplit(" ", width - 1)
            length = int(values[-1])
            content = file.read(length)
            if len(content) != length:
                raise ValueError(f"{uri}: {len(content)} of {length} declared bytes")
            if first:
                names = content.split(b"\n", 2)[1].decode().split()
                if " ".join(names) not in FIELDS.values():
                    raise ValueError(f"{uri}: unknown header fields {names}")
                first = False
            else:
                yield dict(zip(names, values)), content


def _http(content: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Head, its headers in lower case, payload. Without an HTTP head that ends all is payload.

    Lines of a head end in CRLF or, as old servers sent them, in LF alone.
    """
    end = _HEAD_END.search(content) if content.startswith(b"HTTP/") else None
    if end is None:
        return b"", {}, content
    lines = re.split("\r?\n", content[:end.start()].decode("latin-1"))
    headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    return content[:end.end()], headers, content[end.end():]


def _number(text: str | None) -> int | None:
    """A whole number that fits, or nothing."""
    if text is None or not re.fullmatch(r"[+-]?[0-9]{1,19}", text.strip()):
        return None
    n = int(text)
    return n if -(1 << 63) <= n < 1 << 63 else None


def _identity(fields: dict[str, str], headers: dict[str, str], payload_digest: str) -> str:
    own = " ".join((fields["URL"], fields["Archive-date"], headers.get("x-page-id", ""), payload_digest))
    return str(uuid.uuid5(_SPACE, own))


_INDEX = ("path string, number int, page_id bigint, record_id string, url string, "
          "payload_digest string, payload_bytes bigint")


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch["path"].to_pylist():
            rows = []
            for number, (fields, content) in enumerate(arc_records(path)):
                _, headers, payload = _http(content)
                sha = digest(payload)
                rows.append((path, number, _number(headers.get("x-page-id")), _identity(fields, headers, sha),
                             fields["URL"], sha, len(payload)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, (
                    pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()))],
                names=["path", "number", "page_id", "record_id", "url", "payload_digest", "payload_bytes"])


def _warc_record(kind: str, record_id: str, date: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", date), *headers,
            ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _convert(folder: str):
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for path, decided in zip(batch["path"].to_pylist(), batch["revisits"].to_pylist()):
                revisits = {d["number"]: d for d in decided or ()}
                stem = path.rsplit("/", 1)[1].removesuffix(".arc.gz")
                files = _Files(folder, stem, "warc")
                for number, (fields, content) in enumerate(arc_records(path)):
                    stamp = fields["Archive-date"].ljust(14, "0")
                    date = f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z"
                    if files.out is None:
                        files.write(_warc_record(
                            "warcinfo", str(uuid.uuid5(_SPACE, files.name())), date,
                            [("WARC-Filename", files.name()), ("Content-Type", "application/warc-fields")],
                            b"format: WARC File Format 1.1\r\nconformsTo: converted from ARC\r\n"))
                    head, own, payload = _http(content)
                    sha = digest(payload)
                    headers = [("WARC-Target-URI", fields["URL"]), ("WARC-IP-Address", fields["IP-address"]),
                               ("WARC-Payload-Digest", f"sha1:{sha}"), (_LENGTH, str(len(payload))),
                               ("Content-Type", "application/http; msgtype=response" if head else fields["Content-type"])]
                    kind, block = ("response" if head else "resource"), content
                    if (to := revisits.get(number)) is not None:
                        kind, block = "revisit", head
                        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{to['record_id']}>"),
                                    ("WARC-Refers-To-Target-URI", to["url"])]
                        if to["page_id"] is not None:
                            headers.append(("X-Refers-To-Page-Id", str(to["page_id"])))
                    files.write(_warc_record(kind, _identity(fields, own, sha), date, headers, block))
                    if files.size > FILE_BYTES:
                        done.append(files.close())
                if files.out is not None:
                    done.append(files.close())
            yield pa.RecordBatch.from_pydict({"path": pa.array(done, pa.string())})

    return convert


def convert_arc(arcs: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Convert the ARC files in ``arcs(path)`` to WARC files in ``folder``; returns their ``path``.

    Of the records with equal payloads of at least ``least_bytes`` bytes, the one with the
    largest page id is written in full and the others as revisits of it; records without
    an id, or with one that is no number, come last. Shorter ones are all written in full.
    Records without an HTTP head are all payload and become resources. No files give none.
    """
    n = max(1, arcs.count())
    index = pin(arcs.repartition(n, "path").mapInArrow(_index, _INDEX), "cdx")
    best = F.max(F.struct("page_id", "path", "number", "record_id", "url")).alias("to")
    groups = (index.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes")
              .agg(F.count(F.lit(1)).alias("n"), best).where("n > 1"))
    revisits = (index.select("path", "number", "payload_digest", "payload_bytes")
                .join(groups, ["payload_digest", "payload_bytes"])
                .where("path <> to.path or number <> to.number")
                # Bounded by the records of a file, whose bytes are bounded.
                .groupBy("path").agg(F.collect_list(F.struct(
                    "number", "to.page_id", "to.record_id", "to.url")).alias("revisits")))
    decided = arcs.join(revisits, "path", "left").repartition(n, "path")
    return pin(decided.mapInArrow(_convert(folder), "path string"), "warc")


def warc_records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a WARC file, by declared lengths."""
    with _open(uri) as file:
        while line := file.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{uri}: not a WARC record: {line[:40]!r}")
            headers = {}
            while (line := file.readline().rstrip(b"\r\n")):
                name, _, value = line.decode().partition(": ")
                headers[name] = value
            block = file.read(int(headers["Content-Length"]))
            if digest(block) != headers["WARC-Block-Digest"].removeprefix("sha1:"):
                raise ValueError(f"{uri}: damaged record {headers['WARC-Record-ID']}")
            yield headers, block


_READ = ("page_id bigint, record_type string, record_id string, url string, warc_date string, payload_bytes bigint, "
         "payload_digest string, refers_to bigint, payload binary")


def _read(payloads: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 9, kinds)],
                                              names=[c.split()[0] for c in _READ.split(", ")])

        for batch in batches:
            for path in batch["path"].to_pylist():
                rows, size = [], 0
                for headers, block in warc_records(path):
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    _, own, payload = _http(block)
                    sha, revisit = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"] == "revisit"
                    if not revisit and digest(payload) != sha:
                        raise ValueError(f"{path}: payload of {headers['WARC-Record-ID']} differs from its digest")
                    length = len(payload)
                    if revisit:  # of another writer: what the server said, if it did
                        length = next(filter(None.__ne__, map(_number, (headers.get(_LENGTH), own.get("content-length")))), None)
                    rows.append((_number(own.get("x-page-id")), headers["WARC-Type"], headers["WARC-Record-ID"].strip("<>"),
                                 headers["WARC-Target-URI"], headers["WARC-Date"], length, sha,
                                 _number(headers.get("X-Refers-To-Page-Id")), payload if payloads and not revisit else None))
                    size += len(payload) if payloads else 200
                    if size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                yield batch_of(rows)

    return read


def read_warc(warcs: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of the files in ``warcs(path)``; block and payload digests are checked.

    ``page_id, record_type, record_id, url, warc_date, payload_bytes, payload_digest`` (of
    the full payload also for revisits), ``refers_to`` (page id of the record that holds
    the payload) and, if asked for, ``payload`` (null for revisits). Records of any input
    come back one for one, also repeated ones, empty ones and ones without an id. The
    length of a revisit that names none is null. No files give no rows.
    """
    return warcs.repartition(max(1, warcs.count()), "path").mapInArrow(_read(payloads), _READ)

"""WARC: write archives, rewrite whole-file gzip into one member per record, read by offset."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.base import ordinals, view
from larder.sources.shared import materialize, shared_dir

#: A writer starts the next archive after this many bytes of records.
ARCHIVE_BYTES = 64 << 20
#: Compressed bytes that a task reads back.
READ_BYTES = 16 << 20
CHUNK = 1 << 20
#: Records whose places a task passes on at once.
INDEX_ROWS = 1 << 12
#: A record's header is no longer than this; a longer one is a broken archive.
HEAD_BYTES = 1 << 24
GZIP = 31
HEAD_END = b"\r\n\r\n"

INDEX = "path string, offset long, length long, record_id string, record_type string, page_id long"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: str) -> str:
    """A record's id by the key of its page; keys of different records differ."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def _clean(value: str) -> str:
    """A header value cannot hold line ends or other control characters."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, key: str | None = None, refers_key: str | None = None) -> bytes:
    """A response with the payload, or a revisit with its HTTP header only; the keys are those of ``record_id``."""
    key = f"{page_id}" if key is None else key
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {_clean(url)}"] if url else []
    head += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_key or str(refers_to))}", f"X-Refers-To-Page: {refers_to}"]
    head += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + HEAD_END + block + HEAD_END


def parse_head(head: bytes) -> dict[str, str]:
    first, *rest = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in rest if line)}


class Inflated:
    """Bytes of a gzip file of one or many members, inflated once as they are read."""

    def __init__(self, stream):
        self.stream, self.left, self.buffer, self.ended = stream, zlib.decompressobj(GZIP), bytearray(), False

    def _more(self) -> bool:
        while not self.ended:
            data = self.left.unconsumed_tail or self.left.unused_data or self.stream.read(CHUNK)
            if self.left.eof and data:
                self.left = zlib.decompressobj(GZIP)
            if not data:
                if not self.left.eof:
                    raise EOFError("the gzip stream ends early")
                self.ended = True
            else:
                got = self.left.decompress(data, CHUNK)
                if got:
                    self.buffer += got
                    return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """Bytes before the next mark, which is skipped; None at the end."""
        at = 0
        while (found := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark) + 1)
            if at > HEAD_BYTES:
                raise ValueError(f"no end of a record's header within {HEAD_BYTES} bytes")
            if not self._more():
                if self.buffer.strip():
                    raise EOFError("the archive ends inside a record")
                return None
        out = bytes(self.buffer[:found])
        del self.buffer[: found + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces of bounded size."""
        while n:
            if not self.buffer and not self._more():
                raise EOFError("the archive ends inside a record")
            piece = bytes(self.buffer[: min(n, CHUNK)])
            del self.buffer[: len(piece)]
            n -= len(piece)
            yield piece


def write_archives(records: DataFrame, folder: str, date: str, level: int = 1) -> DataFrame:
    """One row ``path, n`` per archive of ``page_id, url, payload, refers_to, key, refers_key`` rows, each one gzip member as a whole.

    File names carry the task attempt; the written list of names is what counts,
    so a lost or repeated task leaves at most a file that nothing reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        names, counts, out = [], [], None
        for batch in batches:
            for page_id, url, payload, refers_to, key, refers_key in zip(*[batch.column(i) for i in range(6)], strict=True):
                if out is None:
                    name = f"raw-{task.partitionId():06d}-{task.taskAttemptId()}-{len(names):04d}.warc.gz"
                    out, gz, size = fs.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, GZIP), 0
                    names.append(f"{folder}/{name}")
                    counts.append(0)
                record = build_record(page_id.as_py(), url.as_py(), payload.as_py() or b"", refers_to.as_py(), date, key.as_py(), refers_key.as_py())
                out.write(gz.compress(record))
                size += len(record)
                counts[-1] += 1
                if size >= ARCHIVE_BYTES:
                    out.write(gz.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(gz.flush())
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["path", "n"])

    return materialize(records.select("page_id", "url", "payload", "refers_to", "key", "refers_key").mapInArrow(run, "path string, n long"), "raw-archives")


def normalise_one(fs: FileSystem, source: str, target: str, level: int = 4) -> Iterator[tuple]:
    """Rewrite an archive with every record as its own gzip member; yields offset, length and header fields.

    The input is inflated once, from its start, and copied in pieces, so a record
    of any size needs little memory. The index goes to a sidecar file too.
    """
    with fs.open_input_stream(source, compression=None) as stream, fs.open_output_stream(target, compression=None) as out, fs.open_output_stream(f"{target}.idx", compression=None) as side:
        data, offset = Inflated(stream), 0
        while (head := data.until(HEAD_END)) is not None:
            head = head.lstrip(b"\r\n")
            fields = parse_head(head)
            gz = zlib.compressobj(level, zlib.DEFLATED, GZIP)
            length = out.write(gz.compress(head + HEAD_END)) or 0
            for piece in data.take(int(fields["content-length"])):
                length += out.write(gz.compress(piece)) or 0
            length += out.write(gz.compress(HEAD_END) + gz.flush()) or 0
            list(data.take(len(HEAD_END)))
            page = fields.get("x-page-id")
            row = (offset, length, fields.get("warc-record-id"), fields.get("warc-type"), int(page) if page else None)
            side.write(json.dumps(dict(zip(("offset", "length", "record_id", "record_type", "page_id"), row, strict=True))).encode() + b"\n")
            yield row
            offset += length


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """The offset index (INDEX) of the archives of ``path``, rewritten below ``folder``; one file is one unit of work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for path in batch.column(0).to_pylist():
                source = FileSystem.from_uri(path)[1]
                name = f"{source.rpartition('/')[2].removesuffix('.warc.gz')}-{attempt}.warc.gz"
                for rows in batched(normalise_one(fs, source, f"{root}/{name}"), INDEX_ROWS):
                    columns = [[f"{folder}/{name}"] * len(rows), *zip(*rows, strict=True)]
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])

    # One short row per archive: dealt out by number, as Spark would join such small partitions into one.
    each = archives.select("path").coalesce(1).repartition(max(1, archives.count()))
    return materialize(each.mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """The records at the index's offsets: page_id, record_type, url, payload, payload_bytes, payload_digest, refers_to.

    A task has READ_BYTES of archives or so, in order. Each record is sought and inflated alone. The digest of a response is worked
    out anew and must equal its header; a revisit has no payload and gives size
    and digest from its headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, file = [], None, None
            for path, offset, length in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if path != at:
                    fs, name = FileSystem.from_uri(path)
                    at, file = path, fs.open_input_file(name)
                file.seek(offset)
                head, _, rest = zlib.decompress(file.read(length), GZIP).partition(HEAD_END)
                fields = parse_head(head)
                http, _, payload = rest[: int(fields["content-length"])].partition(HEAD_END)
                size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                revisit = fields["warc-type"] == "revisit"
                if not revisit and (len(payload) != size or sha1_base32(payload) != digest):
                    raise ValueError(f"{path} at {offset}: the payload does not match its digest")
                page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page")
                rows.append((int(page) if page else None, fields["warc-type"], fields.get("warc-target-uri"), None if revisit else payload, size, digest, int(refers) if refers else None))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
            names = ("page_id", "record_type", "url", "payload", "payload_bytes", "payload_digest", "refers_to")
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = "page_id long, record_type string, url string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    ranges = index.select("path", "offset", "length").repartitionByRange(1 + size // READ_BYTES, "path", "offset")
    return ranges.sortWithinPartitions("path", "offset").mapInArrow(run, schema)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row, normalise the archives, and return their index.

    Of rows with equal payloads (by size, SHA-256 and SHA-1) of at least
    ``min_bytes`` the one with the largest id is the response, the others revisit
    it; rows that repeat that id are responses too. A null html is an empty
    payload, a null id has no id header and is never a revisit's target unless
    all of its group are null. A record's own id comes from the row's id, url and
    payload and its number among rows equal in all of them, so no two records
    share one. Payloads move once, by id, so a payload that a third of all rows
    share meets nowhere: groups are made of digests, combined before the shuffle.
    """
    rows = view(pages, page_id=id_col, url=url_col, html=html_col)
    rows = rows.withColumn("payload", F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))).drop("html")
    key = lambda page_id, url, sha: F.md5(F.concat_ws("|", page_id.cast("string"), F.when(url.isNull(), F.lit("n")).otherwise(F.concat(F.lit("u"), url)), sha).cast("binary"))
    sha = F.sha2("payload", 256)
    rows = ordinals(rows.withColumn("_page", key(F.col("page_id"), F.col("url"), sha)), "_page", "_k")
    rows = rows.withColumn("key", F.concat("_page", F.lit("|"), F.col("_k").cast("string"))).drop("_page", "_k")
    digests = materialize(rows.select("page_id", "url", sha.alias("sha"), F.length("payload").cast("long").alias("n")), "digests")
    # The largest id, and of rows that repeat it the one with the largest url; every such row is a response.
    groups = digests.where(F.col("n") >= min_bytes).groupBy("sha", "n").agg(
        F.max("page_id").alias("refers_to"), F.max(F.struct("page_id", "url")).alias("_last"), F.count(F.lit(1)).alias("rows")
    )
    groups = groups.where("rows > 1").withColumn("refers_key", F.concat(key(F.col("_last.page_id"), F.col("_last.url"), F.col("sha")), F.lit("|0"))).drop("_last")
    groups = materialize(groups, "equal-payloads")
    revisits = digests.join(groups, ["sha", "n"]).where("page_id < refers_to").select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), "refers_to", "refers_key").distinct()
    revisits = materialize(revisits, "revisits")
    decided = rows.join(revisits, (F.col("page_id") == F.col("_id")) & (sha == F.col("_sha")), "left").drop("_id", "_sha")
    folder = shared_dir(pages.sparkSession, "warc")
    return normalise(write_archives(decided, f"{folder}/raw", date), f"{folder}/records")


def query(pages: DataFrame) -> DataFrame:
    return read_records(archive(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

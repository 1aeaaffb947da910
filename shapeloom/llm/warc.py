"""WARC archives: write pages with revisit records, and read archives back record by record.

Every record is a gzip member of its own. The reader takes a byte stream of any length: it inflates
member by member with bounded buffers, frames blocks by Content-Length and verifies digests.

Of equal payloads of at least `min_bytes` bytes the page with the largest id is the response, the
others revisit it. Rows that share payload and page id are all responses. A null payload is empty;
a null page id loses against any other; a null URL gives a record without a target. An empty table
gives no archive. Executors may be lost: an attempt writes files of its own name, moved into place
when complete, and only those that the successful attempt lists are read.
"""
import base64
import hashlib
import posixpath
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import saved, scratch

CRLF = b"\r\n"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
RECORDS = ("page_id long, url string, record_type string, payload_digest string, payload_bytes long, "
           "refers_to long, payload binary, path string, offset long")


class WarcError(ValueError):
    pass


def b32(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def filesystem(uri: str):
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://") if "://" in uri or uri.startswith("/")
                                  else uri.replace("file:", "", 1))


def record(kind, page_id, url, payload, size, digest, refers_to, block):
    """One compressed record. `block` is the HTTP header and, unless it revisits, the payload."""
    clean = None if url is None else "".join(f"%{ord(c):02X}" if c < " " else c for c in url)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{clean}|{digest}")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", DATE),
            ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("WARC-Block-Digest", f"sha1:{b32(hashlib.sha1(block).digest())}"), ("X-Payload-Length", str(size))]
    if clean is not None:
        head.append(("WARC-Target-URI", clean))
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("X-Refers-To-Page", str(refers_to))]
    head.append(("Content-Length", str(len(block))))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(text.encode() + block + CRLF + CRLF) + z.flush()


class Reader:
    """Records of a stream of gzip members, one at a time."""

    def __init__(self, stream, step=1 << 16):
        self.stream, self.step, self.raw, self.at = stream, step, b"", 0

    def _member(self):
        """Decompressed bytes of the next member, piece by piece; every piece is at most `step` long."""
        z = zlib.decompressobj(31)
        while not z.eof:
            if not self.raw:
                self.raw = self.stream.read(self.step)
                if not self.raw:
                    raise WarcError("the archive ends inside a record")
            out = z.decompress(self.raw, self.step)
            rest = z.unused_data if z.eof else z.unconsumed_tail
            self.at += len(self.raw) - len(rest)
            self.raw = rest
            yield out

    def __iter__(self):
        while True:
            if not self.raw:
                self.raw = self.stream.read(self.step)
            if not self.raw:
                return
            begin, parts, held = self.at, self._member(), bytearray()
            while (end := held.find(b"\r\n\r\n")) < 0:
                piece = next(parts, None)
                if piece is None:
                    raise WarcError("a record without the end of its header")
                held += piece
            version, *lines = bytes(held[:end]).decode().split("\r\n")
            if not version.startswith("WARC/1."):
                raise WarcError(f"not a WARC record: {version[:40]!r}")
            head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
            size = int(head["content-length"])
            for piece in parts:
                held += piece
            block = bytes(held[end + 4:end + 4 + size])
            if len(block) != size or held[end + 4 + size:] != CRLF + CRLF:
                raise WarcError("content length and record differ")
            yield begin, head, block


def parsed(begin, head, block, path):
    """A row of RECORDS; raises when a digest does not hold."""
    if (said := head.get("warc-block-digest")) and said != "sha1:" + b32(hashlib.sha1(block).digest()):
        raise WarcError("block digest does not hold")
    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
    payload = None
    size = int(head["x-payload-length"])
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4:]
        if len(payload) != size or b32(hashlib.sha1(payload).digest()) != digest:
            raise WarcError("payload digest does not hold")
    number = lambda k: int(head[k]) if k in head else None
    return (number("x-page-id"), head.get("warc-target-uri"), kind, digest, size, number("x-refers-to-page"),
            payload, path, begin)


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, page_id: str = "page_id",
          url: str = "url", html: str = "html", archive_bytes: int = 64 << 20) -> DataFrame:
    """Write archives below `folder` (default: the shared checkpoint folder); returns their manifest.

    Payloads are compared by SHA-1; only the digest groups' largest ids are shuffled for that,
    pre-aggregated per task, and stored, so that a hot digest is split in the join that follows.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    groups = saved(rows.groupBy("digest").agg(F.max("page_id").alias("top")), "warc-groups")
    rows = rows.join(groups.withColumnRenamed("digest", "g"), F.col("digest") == F.col("g"), "left").drop("g")
    again = (F.octet_length("payload") >= min_bytes) & F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    rows = rows.withColumn("revisit", F.coalesce(again, F.lit(False)))

    def task(batches):
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        out = temp = None
        done, count, size = [], 0, 0

        def close():
            nonlocal out, count, size
            if out is not None:
                out.close()
                final = temp.removesuffix(".part")
                store.move(temp, final)
                done.append((posixpath.join(folder, posixpath.basename(final)), count, size))
                out, count, size = None, 0, 0

        for batch in batches:
            for i in range(batch.num_rows):
                page, link, body, digest, top, revisit = (batch.column(n)[i].as_py() for n in
                                                          ("page_id", "url", "payload", "digest", "top", "revisit"))
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % len(body)
                data = record("revisit" if revisit else "response", page, link, body, len(body), b32(digest), top,
                              http if revisit else http + body)
                if out is None:
                    temp = posixpath.join(base, f"{uuid.uuid4().hex}.warc.gz.part")
                    out = store.open_output_stream(temp, compression=None)
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pydict(
            {"path": pa.array([d[0] for d in done], pa.string()), "records": pa.array([d[1] for d in done], pa.int64()),
             "bytes": pa.array([d[2] for d in done], pa.int64())})

    columns = ("page_id", "url", "payload", "digest", "top", "revisit")
    return saved(rows.select(*columns).mapInArrow(task, MANIFEST), "warc-manifest")


def read(spark: SparkSession, manifest: DataFrame, payloads: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """Every record of the archives that a manifest (or any table with a `path` column) lists."""
    def task(batches):
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in RECORDS.split(", ")]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for given in batches:
            for path in given.column("path").to_pylist():
                store, inner = filesystem(path)
                rows, size = [], 0
                with store.open_input_stream(inner, compression=None) as stream:
                    for begin, head, block in Reader(stream):
                        row = parsed(begin, head, block, path)
                        rows.append(row if payloads else (*row[:6], None, *row[7:]))
                        size += len(block) * payloads + 200
                        if size >= batch_bytes:
                            yield batch(rows)
                            rows, size = [], 0
                yield batch(rows)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(n, "path").mapInArrow(task, RECORDS)

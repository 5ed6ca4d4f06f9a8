"""Deterministic sharded WARC writer and reader.

Writing. Payload digests are computed in the scan; of equal payloads the
smallest page id is the response. Records are sorted by page id and digest: the
running sum of their bytes in that order cuts them into shards of equal bytes,
whatever the ids are, and a null or repeated id is cut between its digests. Marks
and records meet in one shuffle by shard, so the archives don't depend on how
the input was cut. A task streams its shard to gzip members, one a record, and
rolls to the next file once ``roll_bytes`` of compressed data are written;
headers, record ids and digests are made anew.

Commit. Tasks write under temporary names of their own attempt and return one
manifest row per file. Spark keeps the rows of successful attempts only; the
files they name are then renamed, and the manifest table is written last. A
lost executor leaves temporary files that no manifest names; readers open the
files of the manifest alone.

Files are opened through ``pyarrow.fs`` by the folder's URI, so any file system
that it supports will do.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirefold.llm.common import broadcast_if_small, scratch, stored, table
from wirefold.operators.ordinal import keyed_ordinal

#: Bytes of a shard, and shards of a table: beyond their product shards are larger.
SHARD_BYTES, MAX_SHARDS = 16 << 20, 50_000
#: A file takes this part of its shard's bytes, compressed.
ROLL_SHARE = 4
#: Bytes that a record's headers count for.
HEADER_BYTES = 512
#: The record date, the name space of record ids, the revisit profile.
DATE = "2000-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "shard long, seq int, temporary string, file string, records long, bytes long, sha1 string"
RECORDS = ("page_id long, url string, record_id string, record_type string, refers_to long, payload_bytes long, "
           "payload_digest string, payload binary, digest_ok boolean")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def open_fs(uri: str):
    """(file system, path in it) of a folder's URI or path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI: one without scheme lies on the cluster's default
    file system, also for readers and writers outside Spark."""
    if "://" in folder or folder.startswith("file:"):
        return folder
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return path.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()


def record_id(page_id, digest: str, copy: int) -> str:
    return f"urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}/{copy}')}"


def make_record(page_id, url, payload: bytes, copy: int, revisit: bool, refers_to) -> bytes:
    """One record: WARC headers, HTTP headers and, for a response, the payload."""
    digest = base32_sha1(payload)
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <{record_id(page_id, digest, copy)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        # a header is one line: line ends and percent signs in an address are escaped
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines.append(f"WARC-Profile: {PROFILE}")
        if refers_to is not None:
            lines += [f"WARC-Refers-To: <{record_id(refers_to, digest, 0)}>", f"X-Refers-To-Page-Id: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """One gzip member without a time stamp."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class RollingFiles:
    """Files of one task: a new one for each shard and after each ``roll`` compressed bytes."""

    def __init__(self, folder: str, roll: int):
        self.fs, self.root = open_fs(folder)
        self.attempt = uuid.uuid4().hex
        self.roll, self.out, self.done = roll, None, []
        self.shard, self.seq = None, 0
        self.fs.create_dir(f"{self.root}/_temporary", recursive=True)

    def write(self, shard: int, data: bytes) -> None:
        if self.out is not None and (shard != self.shard or self.size >= self.roll):
            self.close()
        if shard != self.shard:
            self.shard, self.seq = shard, 0
        if self.out is None:
            self.name = f"shard-{shard:05d}-{self.seq:05d}.warc.gz"
            self.temporary = f"_temporary/{self.name}.{self.attempt}"
            self.out = self.fs.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
            self.size, self.records, self.sha1 = 0, 0, hashlib.sha1()
        member = gzip_member(data)
        self.out.write(member)
        self.sha1.update(member)
        self.size += len(member)
        self.records += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.seq, self.temporary, self.name, self.records, self.size, self.sha1.hexdigest()))
            self.out, self.seq = None, self.seq + 1


def _rename(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pfs

        fs, root = open_fs(folder)
        for batch in batches:
            for r in batch.to_pylist():
                source, target = f"{root}/{r['temporary']}", f"{root}/{r['file']}"
                # a second attempt finds the file already in place
                if fs.get_file_info(source).type == pfs.FileType.File:
                    fs.move(source, target)
                if fs.get_file_info(target).size != r["bytes"]:
                    raise OSError(f"{target} is not complete")
            yield batch
    return run


def sort_key(page_id: Column, sha1: Column) -> Column:
    """A text that sorts as (page id with nulls first, digest) does."""
    number = F.lpad(F.hex(page_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(F.concat(F.lit("1"), number), F.lit("0")), F.hex(sha1))


def shard_bounds(marks: DataFrame, shard_bytes: int) -> list[str]:
    """The first sort key of each shard but for the first one: shards hold about
    ``shard_bytes`` each. ``marks``: page_id, sha1 and n (bytes). A row per
    shard comes to the driver."""
    sizes = (marks.groupBy(sort_key(F.col("page_id"), F.col("sha1")).alias("key"))
             .agg(F.sum(F.col("n") + HEADER_BYTES).cast("double").alias("size")))
    placed = keyed_ordinal(sizes, [], ["key"], measure="size", cum_out="before",
                           num_partitions=int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = placed.groupBy(F.floor(F.col("before") / shard_bytes).alias("shard")).agg(F.min("key").alias("key"))
    return sorted(r["key"] for r in first.filter("shard > 0").select("key").collect())


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               least_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int | None = None) -> DataFrame:
    """Write one record per row of ``pages`` to ``folder`` and return its manifest.

    Null payloads are empty. Of records with equal payloads of at least
    ``least_bytes`` bytes the one with the smallest id is a response (of
    repeated rows with that id, the first one written) and the others revisit
    it; smaller ones are all responses. Null ids sort first; they name no
    response while a group has another id, and a group of null ids has one
    response, revisited without a name. Null urls get no target header. Rows of
    one id and payload stay in one shard. An empty table gives an empty manifest
    and no file; further columns are not read.
    """
    spark = pages.sparkSession
    folder = qualified(spark, folder)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    marks = stored(rows.select("page_id", F.unhex(F.sha1("payload")).alias("sha1"),
                               F.octet_length("payload").alias("n")), "warc-digests")
    first = (marks.filter(F.col("n") >= least_bytes).groupBy("sha1")
             .agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
             .select("sha1", "refers_to"))
    total = marks.agg(F.sum(F.col("n") + HEADER_BYTES)).first()[0] or 0
    shard_bytes = max(shard_bytes, -(-total // MAX_SHARDS))
    roll_bytes = roll_bytes or max(1, shard_bytes // ROLL_SHARE)
    bounds = shard_bounds(marks, shard_bytes)
    place = F.udf(lambda key: bisect_right(bounds, key), "long", useArrow=True)
    shard = place(sort_key(F.col("page_id"), F.col("sha1")))
    # marks of rows in groups of copies, one per id and digest, sort before their records
    noted = (marks.join(broadcast_if_small(stored(first, "warc-first")), "sha1")
             .select("page_id", "sha1", "refers_to").distinct())
    lines = (rows.withColumn("sha1", F.unhex(F.sha1("payload")))
             .select(shard.alias("shard"), "page_id", "sha1", F.lit(1).alias("kind"),
                     F.lit(None).cast("long").alias("refers_to"), "url", "payload")
             .unionAll(noted.select(shard.alias("shard"), "page_id", "sha1", F.lit(0).alias("kind"), "refers_to",
                                    F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))))
    order = ["shard", "page_id", "sha1", "kind", "url"]
    dealt = lines.repartitionById(len(bounds) + 1, F.col("shard").cast("int")).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = RollingFiles(folder, roll_bytes)
        key = mark = None
        copy = 0
        for batch in batches:
            columns = [batch.column(i) for i in range(7)]
            for i in range(batch.num_rows):
                number, page_id, sha1, kind, refers_to, url, payload = (c[i].as_py() for c in columns)
                if (page_id, sha1) != key:
                    key, mark, copy = (page_id, sha1), None, 0
                if kind == 0:
                    mark = (refers_to,)
                    continue
                revisit = False
                if mark is not None:
                    # of rows with the response's own id the first is the response
                    revisit = mark[0] != page_id or copy > 0
                files.write(number, make_record(page_id, url, payload, copy, revisit, mark[0] if revisit else None))
                copy += 1
        files.close()
        if files.done:
            yield pa.RecordBatch.from_pydict(
                dict(zip(("shard", "seq", "temporary", "file", "records", "bytes", "sha1"), map(list, zip(*files.done, strict=True)), strict=True)),
                schema=pa.schema([("shard", pa.int64()), ("seq", pa.int32()), ("temporary", pa.string()), ("file", pa.string()),
                                  ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())]))

    pending = stored(dealt.mapInArrow(run, MANIFEST), "warc-pending")
    movers = min(len(bounds) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = (pending.repartitionById(movers, F.pmod("shard", F.lit(movers)).cast("int"))
              .mapInArrow(_rename(folder), MANIFEST).drop("temporary"))
    path = f"{folder.rstrip('/')}/manifest"
    placed.write.parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def parse_members(stream, block: int = 1 << 20) -> Iterator[bytes]:
    """The content of each gzip member of a stream."""
    data = b""
    while True:
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            if not data and not (data := stream.read(block)):
                if out:
                    raise ValueError("a record is cut off")
                return
            out.append(unpack.decompress(data))
            data = unpack.unused_data
        yield b"".join(out)


def parse_record(data: bytes) -> dict:
    """Headers (lower-case names) of a record, its block and the block's payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[:int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return {"version": lines[0], "headers": headers, "block": block, "payload": payload, "http_length": length}


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the files that ``manifest`` names: page_id, url,
    record_id, record_type, refers_to, payload_bytes, payload_digest, payload
    (null for a revisit) and digest_ok (block and payload digests hold). A task
    reads about one file."""
    spark = manifest.sparkSession
    folder = qualified(spark, folder)
    files = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        names = [x.split()[0] for x in RECORDS.split(", ")]
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()),
                            ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("payload", pa.binary()), ("digest_ok", pa.bool_())])

        def emit(rows):
            return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for member in parse_members(stream):
                        r = parse_record(member)
                        h = r["headers"]
                        full = h["warc-type"] == "response"
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        ok = base32_sha1(r["block"]) == h["warc-block-digest"].removeprefix("sha1:")
                        ok &= not full or (base32_sha1(r["payload"]) == digest and len(r["payload"]) == r["http_length"])
                        url = h.get("warc-target-uri")
                        rows.append((int(h["x-page-id"]) if "x-page-id" in h else None,
                                     url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
                                     h["warc-record-id"].strip("<>"), h["warc-type"],
                                     int(h["x-refers-to-page-id"]) if "x-refers-to-page-id" in h else None,
                                     r["http_length"], digest, r["payload"] if full else None, ok))
                        size += len(member)
                        if size >= 4 << 20:
                            yield emit(rows)
                            rows, size = [], 0
                if rows:
                    yield emit(rows)

    return manifest.select("file").repartition(files, "file").mapInArrow(run, RECORDS)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    manifest = write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

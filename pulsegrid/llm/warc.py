"""A deterministic, sharded WARC writer and its reader.

Records are sorted by page and dealt to shards by ranges of page_id and payload hash, of about equal bytes; a shard's files roll by compressed
size; WARC and HTTP headers, lengths and digests are made anew from the payloads. Each file is written under a
temporary name and renamed when it is whole, unless an earlier attempt has already put the same bytes there; a
manifest, written last and committed by Spark, lists the files that count, and what attempts that failed have left
goes after it. The same rows give the same files, whatever the input's partitions or a task's second attempts.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import lean
from .ranges import range_bounds, range_of
from .workspace import small_batches

#: A file is closed at the first record after so many compressed bytes.
FILE_BYTES = 64 << 20
#: Payloads of fewer bytes are never replaced by a reference.
REVISIT_BYTES = 1000
LEVEL = 6
#: Fixed: the records' date, so that reruns agree.
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6f1c4d5e-0000-5000-8000-000000000000")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}|{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, uncompressed: WARC headers, HTTP headers, and of a response the payload."""
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{b32}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        # line breaks would end the header: as in a URI, they are percent-encoded
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-Id: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _sha1(fs, name: str) -> str:
    sha = hashlib.sha1()
    with fs.open_input_stream(name, compression=None) as source:
        while data := source.read(1 << 20):
            sha.update(data)
    return sha.hexdigest()


def _place(fs, temp: str, name: str, size: int, sha1: str) -> None:
    """Give a whole file its name. Attempts of one task write the same bytes, so these stay if they are there already, as size and digest tell; they may appear between the look and the move. Other bytes of that name, of an earlier run, are replaced."""
    from pyarrow.fs import FileType

    there = lambda: (i := fs.get_file_info(name)).type == FileType.File and i.size == size and _sha1(fs, name) == sha1
    if not there():
        try:
            fs.move(temp, name)
            return
        except OSError:
            if not there():
                raise
    fs.delete_file(temp)


def _sweep(spark: SparkSession, out: str) -> None:
    """Delete temporary files of failed attempts."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top, "_temporary-*")) or ():
        fs.delete(status.getPath(), False)


def write(pages: DataFrame, out: str, shards: int | None = None, file_bytes: int = FILE_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write one record per row into `out` and return the manifest (file, shard, part, records, bytes, sha1).

    A null payload is empty. Of records with equal payloads of at least REVISIT_BYTES bytes the one with the
    largest id is a response and the others are revisits of it; of rows that share that id too, the first is the
    response. Null ids sort first and lose every such choice; a null url gives no target header. Other columns
    are ignored; an empty table gives no files. Payloads are shuffled once, to their shards: who refers to whom
    is found out on digests alone and arrives in the shard as a row of its own, right before its page.
    """
    spark = pages.sparkSession
    small_batches(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page"), F.col(url_col).alias("url"), body.alias("body")).withColumn("tie", F.xxhash64("body"))
    # null ids come first: below every other key
    key = F.coalesce("page", F.lit(-(2**63)))
    bounds = range_bounds(rows, key, F.col("tie"), F.octet_length("body") + 500, shards)
    keys = rows.select("page", "tie", F.octet_length("body").alias("n"), F.sha1("body").alias("digest")).where(F.col("n") >= REVISIT_BYTES)
    # of each payload that several rows have: the page to refer to
    lead = keys.groupBy("digest").agg(F.max("page").alias("to"), F.count("*").alias("rows")).where("rows > 1").select("digest", "to")
    # a row per page and payload that is a copy; the page referred to has one as well, for its own further copies
    refer = keys.select("page", "tie", "digest").join(lead, "digest").distinct()
    dealt = (
        rows.select(F.lit(1).alias("kind"), "page", "tie", "url", "body", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("bigint").alias("to"))
        .unionByName(refer.select(F.lit(0).alias("kind"), "page", "tie", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("body"), "digest", "to"))
        .withColumn("shard", range_of(key, F.col("tie"), bounds))
        .repartitionById(shards, "shard")
        .sortWithinPartitions("shard", "page", "tie", "kind", "url", "body")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _filesystem(out)
        fs.create_dir(top, recursive=True)
        listed: list[tuple] = []
        sink = temp = None
        shard_now, part, count, size = None, 0, 0, 0
        sha = hashlib.sha1()
        here, known, done = None, {}, set()

        def close() -> None:
            nonlocal sink, part, count, size, sha
            if sink is not None:
                sink.close()
                name = f"shard-{shard_now:06d}-{part:05d}.warc.gz"
                _place(fs, temp, f"{top}/{name}", size, sha.hexdigest())
                listed.append((name, shard_now, part, count, size, sha.hexdigest()))
                sink, part, count, size, sha = None, part + 1, 0, 0, hashlib.sha1()

        for whole in batches:
            for batch in (whole.slice(at, 64) for at in range(0, whole.num_rows, 64)):
                for r in batch.to_pylist():
                    if r["shard"] != shard_now:
                        close()
                        shard_now, part, here, known, done = r["shard"], 0, None, {}, set()
                    if (r["page"], r["tie"]) != here:
                        here, known, done = (r["page"], r["tie"]), {}, set()
                    if r["kind"] == 0:
                        known[r["digest"]] = r["to"]
                        continue
                    digest = hashlib.sha1(r["body"]).hexdigest()
                    # the page that others refer to is itself a response, its first such row at least
                    revisit = digest in known and (known[digest] != r["page"] or digest in done)
                    done.add(digest)
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    data = packer.compress(record(r["page"], r["url"], r["body"], len(r["body"]), digest, known.get(digest), revisit)) + packer.flush()
                    if sink is not None and size >= file_bytes:
                        close()
                    if sink is None:
                        temp = f"{top}/_temporary-{uuid.uuid4().hex}"
                        sink = fs.open_output_stream(temp, compression=None)
                    sink.write(data)
                    sha.update(data)
                    count, size = count + 1, size + len(data)
        close()
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "shard", "part", "records", "bytes", "sha1"), x, strict=True)) for x in listed], _MANIFEST)

    dealt.select("kind", "page", "tie", "url", "body", "digest", "to", "shard").mapInArrow(lean(run), "file string, shard bigint, part bigint, records bigint, bytes bigint, sha1 string").write.mode("overwrite").parquet(f"{out}/_manifest")
    _sweep(spark, out)
    return spark.read.parquet(f"{out}/_manifest")


_MANIFEST = pa.schema([("file", pa.string()), ("shard", pa.int64()), ("part", pa.int64()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())])


def members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a file in which each is a gzip member of its own."""
    unpack, out = zlib.decompressobj(31), []
    for data in chunks:
        while data:
            out.append(unpack.decompress(data))
            if not unpack.eof:
                break
            yield b"".join(out)
            data, unpack, out = unpack.unused_data, zlib.decompressobj(31), []
    if any(out):
        raise ValueError("the file ends within a record")


def parse(data: bytes) -> dict:
    """A record's fields, with its lengths and digests checked."""
    head, block = data.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    if lines[0] != "WARC/1.1" or not block.endswith(b"\r\n\r\n") or len(block) - 4 != int(fields["Content-Length"]):
        raise ValueError("not a whole record")
    block = block[:-4]
    if base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"][5:]:
        raise ValueError("a block differs from its digest")
    http, payload = block.split(b"\r\n\r\n", 1)
    size = int(http.split(b"Content-Length: ")[1].split(b"\r\n")[0])
    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a payload differs from its digest")
    number = lambda key: int(fields[key]) if key in fields else None
    return {"page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page-Id"), "payload": payload if kind == "response" else None}


def read(spark: SparkSession, out: str, payloads: bool = False) -> DataFrame:
    """Read the archives that the manifest in `out` lists: page_id, payload_bytes, payload_digest, record_type, refers_to, url, and with `payloads` the payload (binary; null of revisits). Every digest and length is checked, and each file's bytes, records and SHA-1 against the manifest: a file that isn't the one listed, even if it is whole, is an error."""
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string" + ", payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]
    types = pa.schema([(n, {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]]) for n, x in zip(names, schema.split(", "), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _filesystem(out)
        for batch in batches:
            for name, records, size, sha1 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_stream(f"{top}/{name}", compression=None) as source:
                    sha, found = hashlib.sha1(), [0, 0]

                    def chunks(source=source, sha=sha, found=found) -> Iterator[bytes]:
                        while data := source.read(1 << 20):
                            sha.update(data)
                            found[0] += len(data)
                            yield data

                    rows: list[dict] = []
                    held = 0
                    for data in members(chunks()):
                        r = parse(data)
                        rows.append({n: r[n] for n in names})
                        found[1] += 1
                        held += len(data) if payloads else 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, types)
                            rows, held = [], 0
                    if (*found, sha.hexdigest()) != (size, records, sha1):
                        raise ValueError(f"{name} differs from the manifest")
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, types)

    files = spark.read.parquet(f"{out}/_manifest").select("file", "records", "bytes", "sha1")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, "file").mapInArrow(lean(run), schema)

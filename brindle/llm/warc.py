"""Operator 8: dictionary-compressed WARC archives.

A Zstandard dictionary is built from archived records (a bounded sample), embedded in a leading skippable frame of every
archive, and each record is compressed as a frame of its own. Each task writes one archive into the shared folder, under a
name of its own attempt; only the names in the manifest, which is itself a table, count, so that a lost or repeated task
leaves no record twice. Archives are read back by the same rules: skippable frame, dictionary, records.

Of the records with equal payloads of at least LEAST_REVISIT bytes that with the least page_id is the response; the others are
revisits of it. Defined results: null html is an empty payload; a null page_id is written without an id and never referred to
while others exist; rows that repeat the least page_id are all responses; extra columns are ignored; no rows, no archives.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import cut, pick, shared_dir, stream_task

LEAST_REVISIT = 100
#: Skippable frame that holds the dictionary (as web archives use it), and Zstandard's level.
DICT_MAGIC, LEVEL = 0x184D2A5D, 3
#: The dictionary's sample: records, and bytes of each; and the dictionary's size.
SAMPLE_RECORDS, SAMPLE_BYTES, DICT_BYTES = 1500, 16_384, 65_536
CRLF = b"\r\n"


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head (and so the payload's length) without the payload."""
    digest = hashlib.sha256(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + CRLF + CRLF + block + CRLF + CRLF


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; too few samples to train on serve as raw content."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=1024, d=8).as_bytes() if len(samples) >= 32 else b"".join(samples)[-DICT_BYTES:]
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


def write_archive(out, dictionary: bytes, records: Iterator[bytes]) -> int:
    """Write one archive; the number of records."""
    import zstandard

    out.write(struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary)
    options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    compress = zstandard.ZstdCompressor(level=LEVEL, **options).compress
    n = 0
    for r in records:
        out.write(compress(r))
        n += 1
    return n


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, streamed."""
    import zstandard

    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICT_MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    dictionary = source.read(size)
    options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    text = io.BufferedReader(zstandard.ZstdDecompressor(**options).stream_reader(source, read_across_frames=True), 1 << 18)
    while line := text.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError("a record does not begin where it should")
        headers: dict[str, str] = {}
        while (line := text.readline()) != CRLF:
            key, _, value = line.decode("utf-8", "surrogatepass").rstrip("\r\n").partition(": ")
            headers[key] = value
        block = text.read(int(headers["Content-Length"]))
        if text.read(4) != CRLF + CRLF:
            raise ValueError("a record does not end where it should")
        yield headers, block


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write archives into folder (by default a new one in the shared folder); the manifest: uri, records."""
    from pyarrow import fs

    pages = pick(pages, ("page_id", "long"), ("url", "string"), ("html", "string")).withColumn("html", F.coalesce("html", F.lit("")))
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    # the sample's ids first (numbers only), then their pages: what reaches the driver does not grow with the tasks
    chosen = pages.select("page_id").filter("page_id is not null").orderBy(F.xxhash64("page_id", F.lit(5)), "page_id").limit(SAMPLE_RECORDS).distinct()
    sample = pages.join(F.broadcast(chosen), "page_id").select("page_id", "url", F.substring("html", 1, SAMPLE_BYTES).alias("html"))
    sample = sorted(sample.dropDuplicates(["page_id"]).collect(), key=lambda r: r["page_id"])
    dictionary = build_dictionary([record(r["page_id"], r["url"], r["html"].encode("utf-8", "surrogatepass"), None, False) for r in sample])

    # equal payloads: one row per digest after partial aggregation; only digests that occur twice go on
    skinny = pages.filter(F.octet_length("html") >= LEAST_REVISIT).select("page_id", F.sha2(F.encode("html", "UTF-8"), 256).alias("digest"))
    first = skinny.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    revisits = skinny.join(first, "digest").filter("page_id is null or page_id <> first").select(F.col("page_id").alias("own"), F.col("digest").alias("same"), "first").distinct()
    typed = pages.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256)).join(revisits, F.col("page_id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("same")), "left").select("page_id", "url", "html", "first", F.col("same").isNotNull().alias("revisit"))

    def task(slices: Iterator[list[list]]) -> Iterator[list[tuple]]:
        from pyarrow import fs
        from pyspark import TaskContext

        head = next(slices, None)
        if head is None:
            return
        store, path = fs.FileSystem.from_uri(folder)
        c = TaskContext.get()
        name = f"part-{c.partitionId():06d}-{c.taskAttemptId()}.warc.zst"

        def records() -> Iterator[bytes]:
            for part in (head, *()):
                yield from (record(i, u, h.encode("utf-8", "surrogatepass"), f, r) for i, u, h, f, r in zip(*part))
            for part in slices:
                yield from (record(i, u, h.encode("utf-8", "surrogatepass"), f, r) for i, u, h, f, r in zip(*part))

        with store.open_output_stream(f"{path}/{name}", compression=None) as out:
            n = write_archive(out, dictionary, records())
        yield [(f"{folder}/{name}", n)]

    return cut(stream_task(typed, task, "uri string, records long"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Read the archives of a manifest back, an archive to a task; payload digests are computed anew for responses."""
    spark = manifest.sparkSession
    n = max(1, min(manifest.count(), 10_000))

    def task(slices: Iterator[list[list]]) -> Iterator[list[tuple]]:
        from pyarrow import fs

        for uris, counts in slices:
            for uri, count in zip(uris, counts):
                store, path = fs.FileSystem.from_uri(uri)
                out, seen = [], 0
                with store.open_input_stream(path, compression=None) as source:
                    for headers, block in read_archive(source):
                        seen += 1
                        http, _, payload = block.partition(CRLF + CRLF)
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        if headers["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
                        number = lambda v: int(x) if (x := v.removeprefix("<urn:page:").removesuffix(">")) else None
                        out.append((number(headers["WARC-Record-ID"]), size, digest, headers["WARC-Type"], number(headers["WARC-Refers-To"]) if "WARC-Refers-To" in headers else None))
                        if len(out) == 1024:
                            yield out
                            out = []
                if seen != count:
                    raise ValueError(f"{uri} holds {seen} records, not {count}")
                yield out

    return stream_task(manifest.repartition(n, "uri"), task, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")

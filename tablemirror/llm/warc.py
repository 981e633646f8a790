"""WARC archives: write records, normalise monolithic gzip files, read back through the offset index.

``write_monolithic`` writes one WARC/1.1 record per row with Spark's gzip text writer (the record separator
is the writer's line separator), so each file is one gzip stream over all its records. ``normalise`` inflates
such a stream once, in chunks, rewrites every record as a gzip member of its own and writes a sidecar index
(`<archive>.idx`, one JSON line a record: offset and length of the member). ``read_records`` opens any
record by its offset alone.

Files are opened by their URI through pyarrow's file systems, so all folders must be shared by the
executors. A task writes to a name of its own and renames it at the end; a repeated task replaces the file
by an equal one.

Defined cases: a null payload is empty; null keys or urls leave their header out; control characters and
blanks of an url are percent-encoded; payloads shorter than ``least`` are always responses; of equal payloads
every row with the smallest non-null key is a response (all rows, if every key is null), the others revisit it;
other columns stay outside; an empty table gives no records.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemirror.llm.common import framed, only
from tablemirror.operators.joins import lookup
from tablemirror.session import cut

END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20
SPAN = 8 << 20      # bytes of an archive that one reading task takes together


def with_revisits(pages: DataFrame, key: str, url: str, payload: str, least: int = 100) -> DataFrame:
    """_key, _url, _payload, _bytes, _digest, _first (key of the response that a revisit refers to, else null)."""
    body = F.coalesce(F.col("_payload"), F.lit("")).cast("binary")
    rows = only(pages, _key=key, _url=url, _payload=payload).select(
        "_key", "_url", F.coalesce("_payload", F.lit("")).alias("_payload"),
        F.octet_length(body).cast("long").alias("_bytes"), F.sha2(body, 256).alias("_digest"))
    repeated = (rows.filter(F.col("_bytes") >= least).groupBy("_digest")
                .agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_n"))
                .filter((F.col("_n") > 1) & F.col("_first").isNotNull()).select("_digest", "_first"))
    first = F.when(~F.col("_key").eqNullSafe(F.col("_first")), F.col("_first"))
    return lookup(rows, repeated, ["_digest"]).withColumn("_first", first)


def record_text(date: str = "2024-01-01T00:00:00Z") -> Column:
    """The whole WARC record of a row of ``with_revisits``, without the blank lines after it."""
    revisit = F.col("_first").isNotNull()
    http = F.concat(F.lit(END.join(("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "))),
                    F.col("_bytes").cast("string"), F.lit(END * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("_payload")))
    unsafe = F.col("_url")
    for code in (*range(33), 127):
        unsafe = F.replace(unsafe, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    uri = F.when(F.col("_url").rlike(r"[\x00-\x20\x7F]"), unsafe).otherwise(F.col("_url"))
    target = F.concat(F.lit("WARC-Target-URI: "), uri)
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"),
                 F.regexp_replace(F.md5(F.concat_ws("|", F.coalesce(F.col("_key").cast("string"), F.lit("")), "_digest")),
                                  "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">")),
        F.lit(f"WARC-Date: {date}"), F.when(F.col("_url") != "", target),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("_digest")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(F.lit("X-Refers-To-Key: "), F.col("_first").cast("string")),
        F.concat(F.lit("X-Key: "), F.col("_key").cast("string")),
        F.concat(F.lit("X-Payload-Length: "), F.col("_bytes").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(END, *lines), F.lit(END * 2), block)


def write_monolithic(records: DataFrame, folder: str, per_file: int = 20_000) -> None:
    """Records as gzip files of at most ``per_file`` records, each file one stream."""
    (records.select(record_text().alias("value")).write.option("lineSep", END * 2).option("compression", "gzip")
     .option("maxRecordsPerFile", per_file).text(folder))


def _opened(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def split_stream(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records (head and block, without the blank lines after it) of an inflated WARC stream."""
    buffer, at = bytearray(), 0
    source = iter(chunks)

    def more() -> bool:
        nonlocal at
        del buffer[:at]
        at = 0
        got = next(source, None)
        buffer.extend(got or b"")
        return got is not None

    while True:
        while buffer[at:at + 2] == b"\r\n":
            at += 2
        head = buffer.find(b"\r\n\r\n", at)
        if head < 0 or head - at < 4:
            if more():
                continue
            if buffer[at:].strip():
                raise ValueError("the archive ends inside a record")
            return
        length = re.search(rb"\r\ncontent-length:\s*(\d+)", bytes(buffer[at:head]).lower())
        if length is None:
            raise ValueError("a record has no length")
        size = head - at + 4 + int(length[1])
        while len(buffer) - at < size:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield bytes(buffer[at:at + size])
        at += size


def inflated(stream) -> Iterator[bytes]:
    """Chunks of a gzip file of one or many members, inflated once."""
    inflate = zlib.decompressobj(31)
    while raw := stream.read(CHUNK):
        while raw:
            yield inflate.decompress(raw)
            raw = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
    if tail := inflate.flush():
        yield tail


def member(record: bytes, level: int = 6) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(record + b"\r\n\r\n") + pack.flush()


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the block."""
    head, _, block = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split(END)[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, block


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite every gzip file of ``source`` into ``target``; one row per archive: its path, records and bytes."""
    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                yield framed([rewritten(path, target)], ["archive", "records", "bytes"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    return cut(files.repartition(spark.sparkContext.defaultParallelism * 4, "path")
               .mapInPandas(rewrite, "archive string, records long, bytes long"))


def rewritten(path: str, target: str) -> tuple[str, int, int]:
    files, name = _opened(path)
    out, folder = _opened(target)
    out.create_dir(folder, recursive=True)
    final = posixpath.join(folder, re.sub(r"(\.warc|\.txt)?\.gz$", "", posixpath.basename(name)) + ".warc.gz")
    own = f"{final}.{uuid.uuid4().hex}"
    count = at = 0
    with files.open_input_stream(name, compression=None) as stream, out.open_output_stream(own, compression=None) as sink, \
            out.open_output_stream(f"{own}.idx", compression=None) as index:
        for record in split_stream(inflated(stream)):
            packed, (fields, _) = member(record), parsed(record)
            sink.write(packed)
            index.write((json.dumps({"record_id": fields.get("warc-record-id"), "type": fields.get("warc-type"),
                                     "uri": fields.get("warc-target-uri"), "offset": at, "length": len(packed)})
                         + "\n").encode())
            at += len(packed)
            count += 1
    out.move(own, final)
    out.move(f"{own}.idx", f"{final}.idx")
    return posixpath.join(target, posixpath.basename(final)), count, at


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """archive, record_id, type, uri, offset, length of every record, from the sidecar files."""
    lines = spark.read.schema("record_id string, type string, uri string, offset long, length long").option(
        "pathGlobFilter", "*.idx").json(folder)
    return lines.withColumn("archive", F.regexp_replace(F.input_file_name(), r"\.idx$", ""))


def read_records(index: DataFrame) -> DataFrame:
    """Every indexed record: its fields of interest and the payload's own length and digest."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, part in batch.groupby("archive"):
                files, name = _opened(archive)
                rows = []
                with files.open_input_file(name) as source:
                    for offset, length in zip(part["offset"], part["length"], strict=True):
                        source.seek(int(offset))
                        fields, block = parsed(zlib.decompress(source.read(int(length)), 31)[:-4])
                        payload = block.partition(b"\r\n\r\n")[2]
                        revisit = fields["warc-type"] == "revisit"
                        rows.append((
                            fields.get("x-key"), int(fields["x-payload-length"]) if revisit else len(payload),
                            fields["warc-payload-digest"].removeprefix("sha256:") if revisit
                            else hashlib.sha256(payload).hexdigest(), fields["warc-type"], fields.get("x-refers-to-key")))
                yield framed(rows, ["key", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    spread = index.select("archive", "offset", "length").repartition(
        index.sparkSession.sparkContext.defaultParallelism * 2, "archive", F.floor(F.col("offset") / SPAN))
    return spread.mapInPandas(read, "key string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def warc_round_trip(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html",
                    least: int = 100) -> DataFrame:
    """Write all rows below ``folder``, normalise the archives and read every record back."""
    spark, kind = pages.sparkSession, pages.schema[key].dataType
    write_monolithic(with_revisits(pages, key, url, payload, least), f"{folder}/monolithic")
    normalise(spark, f"{folder}/monolithic", f"{folder}/archives")
    back = read_records(read_index(spark, f"{folder}/archives"))
    return back.select(F.col("key").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast(kind).alias("refers_to"))

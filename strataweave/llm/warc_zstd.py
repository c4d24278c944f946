"""WARC archives as Zstandard frames: one frame per record, the dictionary in a leading skippable frame.

Archive layout: an optional skippable frame (magic 0x184D2A5D) whose content is the Zstandard dictionary,
plain or itself a Zstandard frame; then one frame per WARC record, compressed with that dictionary.

Writing: rows become records; of equal payloads of at least ``least`` bytes the one with the largest id is a
response, the others revisit it. Each task writes archives of a bounded size below a folder that all
executors share; names come from the partition, and a file appears under its name only when it is
complete, so a repeated or speculative task replaces a file by an equal one.

Reading: Spark's binary reader lists and loads the archives, so any store that Spark reads will do. Frames
are decoded one at a time and every header and length is checked; what is wrong with a record is told in
``error`` and never stops the job.

Nulls: a null payload is empty, a null url an empty target, a null id has no number in its record id and
is never revisited by a row with an id. Rows that repeat the largest id of a payload are all responses.
"""

from __future__ import annotations

import hashlib
import re
import struct
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from strataweave.llm.textops import map_batches
from strataweave.scratch import shared_root

LEAST_REVISIT = 1000
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 32 << 10
SAMPLE_ROWS, SAMPLE_BYTES = 200, 4 << 20
LEVEL = 3
FRAME_BYTES = 1 << 16
SKIPPABLE = 0x184D2A5D
MOST_DICTIONARY = 1 << 30
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
COLUMNS = (
    "archive string, at long, version string, record_type string, record_id string, refers_id string, "
    "target_uri string, payload_digest string, content_length long, payload_bytes long, payload binary, error string"
)


def plan_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(id, url, payload, digest, bytes, refers_to): refers_to is null for responses.

    ``pages(id, url, payload)`` has binary payloads, which are shuffled once by digest to meet the owner.
    """
    rows = pages.select("id", "url", F.coalesce("payload", F.lit(b"")).alias("payload")).select(
        "*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("bytes")
    )
    owners = (
        rows.where(F.col("bytes") >= least)
        .groupBy("digest", "bytes")
        .agg(F.max("id").alias("owner"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "bytes", "owner")
    )
    refers = F.when(~F.col("id").eqNullSafe(F.col("owner")), F.col("owner"))
    return rows.join(owners, ["digest", "bytes"], "left").select(
        "id", "url", "payload", "digest", "bytes", refers.alias("refers_to")
    )


def _record_id(number: int | None) -> str:
    return f"<urn:x-row:{'' if number is None else number}>"


def make_record(number: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(number)}",
        f"WARC-Date: {DATE}",
        # characters that would end the header line are escaped
        "WARC-Target-URI: " + urllib.parse.quote(url or "", safe="".join(map(chr, range(33, 127)))),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def make_dictionary(records: list[bytes]) -> bytes:
    """A dictionary trained on ``records``; empty where they are too few or too small for one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r[:FRAME_BYTES] for r in records]).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Write ``pages(id, url, payload)`` below ``folder`` (a URI that all executors reach): archive, records."""
    planned = plan_records(pages, least).select("id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        parts, size, records, number, dictionary, compressor = [], 0, 0, 0, None, None
        waiting: list[bytes] = []

        def start() -> None:
            nonlocal dictionary, compressor
            if dictionary is None:
                dictionary = make_dictionary(waiting)
                data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
                compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=True)
            if not parts and dictionary:
                packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary)
                parts.append(struct.pack("<II", SKIPPABLE, len(packed)) + packed)

        def finish() -> pa.RecordBatch:
            nonlocal parts, size, records, number
            name = f"{base}/part-{part:06d}-{number:05d}.warc.zst"
            with store.open_output_stream(f"{name}.{attempt}.tmp") as out:
                for piece in parts:
                    out.write(piece)
            store.move(f"{name}.{attempt}.tmp", name)
            done = pa.RecordBatch.from_pydict({"archive": [name.rsplit("/", 1)[1]], "records": [records]})
            parts, size, records, number = [], 0, 0, number + 1
            return done

        def add(record: bytes) -> None:
            nonlocal size, records
            start()
            parts.append(compressor.compress(record))
            size += len(parts[-1])
            records += 1

        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            for i in range(batch.num_rows):
                record = make_record(*[c[i].as_py() for c in columns])
                if dictionary is None and len(waiting) < SAMPLE_ROWS and sum(map(len, waiting)) < SAMPLE_BYTES:
                    waiting.append(record)
                    continue
                if waiting:
                    start()
                    for earlier in waiting:
                        add(earlier)
                    waiting = []
                add(record)
                if size >= ARCHIVE_BYTES:
                    yield finish()
        if waiting:
            start()
            for earlier in waiting:
                add(earlier)
        if records:
            yield finish()

    return map_batches(planned, run, "archive string, records long")


def load_dictionary(data: memoryview, length: int) -> zstandard.ZstdCompressionDict:
    """The dictionary in the payload of a skippable frame, which may be compressed itself."""
    raw = bytes(data)
    if len(raw) < length:
        raise ValueError("frame is cut short")
    if raw[:4] == zstandard.FRAME_HEADER:
        size = zstandard.get_frame_parameters(raw).content_size
        if size != zstandard.CONTENTSIZE_UNKNOWN and size > MOST_DICTIONARY:
            raise ValueError("larger than a dictionary may be")
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=MOST_DICTIONARY)
    return zstandard.ZstdCompressionDict(raw)


def number(text: str | bytes) -> int | None:
    """A length of a header: ASCII digits that fit into a long, or None."""
    text = text if isinstance(text, str) else text.decode("latin-1")
    return int(text) if re.fullmatch("[0-9]{1,18}", text) else None


def frames(data: memoryview) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, content, error) of the frames after the dictionary; stops at a frame that is broken."""
    data = data.cast("B")  # Arrow buffers are signed
    at, dictionary = 0, None
    try:
        if len(data) >= 8:
            magic, length = struct.unpack_from("<II", data, 0)
            if magic == SKIPPABLE:
                dictionary, at = load_dictionary(data[8 : 8 + length], length), 8 + length
        decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    except (zstandard.ZstdError, ValueError) as error:
        yield 0, None, f"dictionary {error}"
        return
    while at < len(data):
        begin, out = at, []
        try:
            if data[at : at + 4] != zstandard.FRAME_HEADER:
                magic, length = struct.unpack_from("<II", data, at)
                if magic & 0xFFFFFFF0 != 0x184D2A50:
                    raise zstandard.ZstdError("not a frame")
                if at + 8 + length > len(data):
                    raise zstandard.ZstdError("skippable frame is cut short")
                at += 8 + length  # other skippable frames are passed over
                continue
            frame = decoder.decompressobj()
            while not frame.eof:
                piece = data[at : at + FRAME_BYTES]
                if not len(piece):
                    raise zstandard.ZstdError("frame is cut short")
                out.append(frame.decompress(piece))
                at += len(piece) - len(frame.unused_data)
        except (zstandard.ZstdError, struct.error) as error:
            yield begin, None, f"frame: {error}"
            return
        content = b"".join(out)
        declared = zstandard.get_frame_parameters(data[begin : begin + 18]).content_size
        wrong = declared not in (zstandard.CONTENTSIZE_UNKNOWN, len(content))
        yield begin, content, "frame: content size differs" if wrong else None


def parse_record(content: bytes) -> dict:
    """The fields of one WARC record; ``error`` says what is wrong with it."""
    out: dict = dict.fromkeys(c.split()[0] for c in COLUMNS.split(", "))
    head, blank, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            out["error"] = "header line without colon"
        fields[name.strip().lower()] = value.strip()
    out |= {
        "version": lines[0],
        "record_type": fields.get("warc-type"),
        "record_id": fields.get("warc-record-id"),
        "refers_id": fields.get("warc-refers-to"),
        "target_uri": fields.get("warc-target-uri"),
        "payload_digest": fields.get("warc-payload-digest"),
    }
    missing = [n for n in ("warc-type", "warc-record-id", "warc-date", "content-length") if not fields.get(n)]
    length = number(fields.get("content-length", ""))
    if not blank or not lines[0].startswith("WARC/1."):
        out["error"] = "no WARC header"
    elif missing:
        out["error"] = f"missing {', '.join(missing)}"
    elif length is None or len(rest) != length + 4 or not rest.endswith(b"\r\n\r\n"):
        out["error"] = "length differs"
    if out["error"]:
        return out
    block = rest[:-4]
    out["content_length"] = len(block)
    http, blank, payload = block.partition(b"\r\n\r\n")
    told = [h.split(b":", 1)[1].strip() for h in http.split(b"\r\n")[1:] if h.lower().startswith(b"content-length:")]
    if not blank or len(told) != 1 or number(told[0]) is None:
        out["error"] = "no HTTP length"
        return out
    out["payload_bytes"] = number(told[0])
    if out["record_type"] == "revisit":
        if payload or not out["refers_id"]:
            out["error"] = "revisit with payload or without target"
        return out
    out["payload"] = payload
    if len(payload) != out["payload_bytes"]:
        out["error"] = "payload length differs"
    elif out["payload_digest"] != f"sha1:{hashlib.sha1(payload).hexdigest()}":
        out["error"] = "payload digest differs"
    return out


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All records below ``folder``, one row per frame; broken ones carry an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        kinds = {"at": pa.int64(), "content_length": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                held, size = [], 0
                for at, record, error in frames(memoryview(content.as_buffer())):
                    row = parse_record(record) if error is None else dict.fromkeys(names) | {"error": error}
                    held.append(row | {"archive": path.as_py(), "at": at})
                    size += len(record or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return map_batches(files, run, COLUMNS)


def round_trip(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Write ``pages(id, url, payload)``, read the archives back: id, type, digest, bytes, refers_to, error.

    An empty table writes no archive and returns no rows.
    """
    import uuid

    spark = pages.sparkSession
    folder = f"{shared_root(spark)}/llm-warc-{uuid.uuid4().hex[:12]}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    write_archives(pages, folder, least).write.format("noop").mode("overwrite").save()
    row = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:x-row:(-?\d+)>$", 1), F.lit("")).cast("long")
    return read_archives(spark, folder).select(
        row("record_id").alias("id"),
        "record_type",
        F.regexp_extract("payload_digest", "^sha1:([0-9a-f]{40})$", 1).alias("payload_digest"),
        "payload_bytes",
        row("refers_id").alias("refers_to"),
        "target_uri",
        "payload",
        "error",
    )


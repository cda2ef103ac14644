"""WARC archives in Zstandard form: a dictionary in a leading skippable frame, then one frame for each record.

Writing: each task sorts its records by id and writes archives of bounded size; a file is written under another name
and then moved, and equal input gives equal files, so a repeated task replaces what it left. Reading: whole archives come from any store
that Spark reads; each frame is bounded by its block headers, decoded with the archive's dictionary and checked.

Defined cases: null payloads are empty, null targets become the record's own URI; repeated rows give one record each,
and rows of equal payload and equal id are all responses; null ids are written as `null` and read back as null; an
empty table gives no archives and an empty result; payloads are never cut. Columns beyond id, url and payload are not
archived.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, joined_to_groups

#: Fixed values of the formats: magic numbers of the dictionary frame, of a Zstandard frame and of a dictionary.
DICTIONARY_FRAME, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
VERSION = b"WARC/1.1"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
#: Fixed value: the profile of a revisit of an identical payload.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Uncompressed bytes of records after which a new archive begins; a single larger record makes an archive of its own.
ARCHIVE_BYTES = 16 << 20
#: Bytes of an archive's first records that its dictionary is trained on, in samples of SAMPLE_BYTES, and its size.
TRAINING_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 256 << 10, 2 << 10, 16 << 10
#: Payloads below this many bytes are never written as revisits.
REVISIT_FROM = 1000

_HEADER = re.compile(r"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*([^\x00-\x08\x0a-\x1f\x7f]*)\Z")


class WarcError(ValueError):
    """An archive or record that breaks its format."""


def record_bytes(kind: str, record_id: str, target: str, payload: bytes, digest: str, length: int, date: str, refers_to: str | None = None) -> bytes:
    """A response or revisit record; a revisit has the head of the response but no payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + (payload if kind == "response" else b"")
    head = [VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}"]
    if refers_to:
        head += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: <{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive_bytes(records: list[bytes]) -> bytes:
    """One archive: the dictionary's frame, unless there is too little to train one, then a frame for each record."""
    import zstandard

    samples, size = [], 0
    for r in records:
        samples += [r[i : i + SAMPLE_BYTES] for i in range(0, min(len(r), TRAINING_BYTES - size), SAMPLE_BYTES)]
        size += len(r)
        if size >= TRAINING_BYTES:
            break
    try:
        own = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, size // 8)), samples, level=3)
    except zstandard.ZstdError:
        own = None
    coder = zstandard.ZstdCompressor(level=3, dict_data=own, write_checksum=True, write_content_size=True)
    out = [coder.compress(r) for r in records]
    if own is not None:
        body = zstandard.ZstdCompressor(level=3).compress(own.as_bytes())
        out.insert(0, struct.pack("<II", DICTIONARY_FRAME, len(body)) + body)
    return b"".join(out)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at `at` ends, from its block headers."""
    import zstandard

    head = bytes(data[at : at + 18])
    try:
        end = at + zstandard.frame_header_size(head)
        checksum = 4 * zstandard.get_frame_parameters(head).has_checksum
    except zstandard.ZstdError as e:
        raise WarcError(f"no frame at byte {at}: {e}") from e
    last = False
    while not last:
        if end + 3 > len(data):
            raise WarcError(f"the frame at byte {at} is cut off")
        block = int.from_bytes(data[end : end + 3], "little")
        last, kind = bool(block & 1), block >> 1 & 3
        if kind == 3:
            raise WarcError(f"a reserved block in the frame at byte {at}")
        end += 3 + (1 if kind == 1 else block >> 3)
    if end + checksum > len(data):
        raise WarcError(f"the frame at byte {at} is cut off")
    return end + checksum


def frames(data: bytes) -> Iterator[tuple[int, bytes | WarcError]]:
    """(byte, content) of each frame after the dictionary; what can't be decoded is a WarcError in its place."""
    import zstandard

    view, at, own = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        at = 8 + struct.unpack_from("<I", data, 4)[0]
        if at > len(data):
            raise WarcError("the dictionary's frame is cut off")
        raw = bytes(view[8:at])
        if raw[:4] == struct.pack("<I", FRAME):
            try:
                raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 26)
            except zstandard.ZstdError as e:
                raise WarcError(f"the dictionary can't be decoded: {e}") from e
        if raw[:4] != struct.pack("<I", DICTIONARY):
            raise WarcError("the leading skippable frame holds no dictionary")
        own = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT)
    coder = zstandard.ZstdDecompressor(dict_data=own)
    while at < len(data):
        if len(data) - at >= 8 and 0x184D2A50 <= struct.unpack_from("<I", data, at)[0] <= 0x184D2A5F:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            if at > len(data):
                raise WarcError("a skippable frame is cut off")
            continue
        end = frame_end(view, at)
        try:
            yield at, coder.decompressobj().decompress(bytes(view[at:end]))
        except zstandard.ZstdError as e:
            yield at, WarcError(f"the frame at byte {at} can't be decoded: {e}")
        at = end


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a frame's content, which must be exactly one valid record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("the header has no end")
    try:
        first, *lines = head.decode().split("\r\n")
    except UnicodeDecodeError as e:
        raise WarcError("the header is not UTF-8") from e
    if first.encode() != VERSION and first != "WARC/1.0":
        raise WarcError(f"unknown version {first[:20]!r}")
    headers: dict[str, str] = {}
    for line in lines:
        if not (m := _HEADER.match(line)):
            raise WarcError(f"not a header: {line[:60]!r}")
        name = m[1].lower()
        if name in headers and name != "warc-concurrent-to":
            raise WarcError(f"{m[1]} is there twice")
        headers[name] = m[2].strip()
    for name in REQUIRED:
        if not headers.get(name.lower()):
            raise WarcError(f"{name} is missing")
    if not re.fullmatch("[0-9]+", headers["content-length"]):
        raise WarcError("Content-Length is no number")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {n}, the block has {len(rest) - 4} bytes")
    block = rest[:n]
    want = headers.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != hashlib.sha1(block).hexdigest():
        raise WarcError("the block's digest differs")
    return headers, block


def parse_http(headers: dict[str, str], block: bytes) -> tuple[bytes | None, int]:
    """Payload and its full length; a revisit holds the length alone."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("the HTTP head has no end")
    m = re.search(rb"\r\nContent-Length: ?([0-9]+)(?:\r\n|\Z)", head, re.I)
    n = int(m[1]) if m else len(payload)
    if headers["warc-type"] == "revisit":
        if payload or "warc-refers-to" not in headers:
            raise WarcError("a revisit has a payload or names no record")
        return None, n
    if n != len(payload):
        raise WarcError(f"the HTTP length is {n}, the payload has {len(payload)} bytes")
    want = headers.get("warc-payload-digest", "")
    if want.startswith("sha1:") and want[5:] != hashlib.sha1(payload).hexdigest():
        raise WarcError("the payload's digest differs")
    return payload, n


def mark_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", from_bytes: int = REVISIT_FROM) -> DataFrame:
    """Adds payload_digest, payload_bytes and refers_to: of equal payloads of at least from_bytes bytes, all refer to
    the largest key but the rows that have it; columns of these names are replaced. Only digests of which there are two
    rows or more are joined back, the most frequent by a broadcast, so that no task gets all copies of a payload."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    pages = pages.drop("payload_digest", "payload_bytes", "refers_to")
    rows = pages.withColumns({"payload_digest": F.sha1(body), "payload_bytes": F.octet_length(body).cast("bigint")})
    slim = pages.select(F.sha1(body).alias("payload_digest"), F.octet_length(body).alias("n"), F.col(key).alias("k")).filter(F.col("n") >= from_bytes)
    largest = slim.groupBy("payload_digest").agg(F.max("k").alias("refers_to"), F.count("*").alias("__n")).filter("__n > 1")
    joined = joined_to_groups(rows, largest, ["payload_digest"], "__n", F.col(key), pages.count())
    return joined.withColumn("refers_to", F.when((F.col("payload_bytes") >= from_bytes) & ~F.col(key).eqNullSafe(F.col("refers_to")), F.col("refers_to")))


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "2000-01-01T00:00:00Z", archive_bytes_: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages, marked as by mark_revisits, as archives into folder; returns name and number of records of each."""
    from urllib.parse import quote

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        part, made, records, size = TaskContext.get().partitionId(), [], [], 0

        def flush():
            nonlocal records, size
            if not records:
                return
            name = f"pages-{part:06d}-{len(made):05d}.warc.zst"
            own = f"{path}/.{name}.{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(own) as out:
                out.write(archive_bytes(records))
            store.move(own, f"{path}/{name}")
            made.append((name, len(records)))
            records, size = [], 0

        def urn(x) -> str:
            return f"urn:page:{'null' if x is None else x}"

        for batch in batches:
            for k, target, body, digest, n, refers in zip(*(c.to_pylist() for c in batch.columns)):
                kind = "response" if refers is None else "revisit"
                target = quote(target, safe="!#$%&'()*+,/:;=?@[]~") if target else urn(k)
                records.append(record_bytes(kind, urn(k), target, body or b"", digest, n, date, None if refers is None else urn(refers)))
                size += len(records[-1])
                if size >= archive_bytes_:
                    flush()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())], names=["archive", "records"])

    body = F.when(F.col("refers_to").isNull(), F.coalesce(F.col(payload), F.lit("")).cast("binary")).alias("body")
    rows = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("url"), body, "payload_digest", "payload_bytes", F.col("refers_to"))
    return rows.sortWithinPartitions("k", "payload_digest").mapInArrow(write, "archive string, records bigint")


_READ = "archive string, at bigint, record_type string, record_id string, target string, refers_to string, payload_digest string, payload_bytes bigint, payload binary, error string"


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True, on_error: str = "raise") -> DataFrame:
    """One row for each record of the archives in folder. on_error: raise, or keep (then `error` says what is wrong and
    the other columns are null). A valid response's digest was computed from its payload."""
    if on_error not in ("raise", "keep"):
        raise ValueError(on_error)

    def read(batches):
        schema = pa.schema([("archive", pa.string()), ("at", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])

        def rows(name, data):
            try:
                for at, content in frames(data):
                    row = dict.fromkeys(schema.names) | {"archive": name, "at": at}
                    try:
                        if isinstance(content, WarcError):
                            raise content
                        headers, block = parse_record(content)
                        payload, n = parse_http(headers, block)
                        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or hashlib.sha1(payload or b"").hexdigest()
                        strip = lambda x: x and x.strip("<>")
                        row |= {"record_type": headers["warc-type"], "record_id": strip(headers["warc-record-id"]), "target": headers.get("warc-target-uri"), "refers_to": strip(headers.get("warc-refers-to")), "payload_digest": digest, "payload_bytes": n, "payload": payload if with_payload else None}
                    except WarcError as e:
                        if on_error == "raise":
                            raise WarcError(f"{name}, byte {at}: {e}") from e
                        row["error"] = str(e)
                    yield row
            except WarcError as e:  # the archive can't be followed further
                if on_error == "raise":
                    raise WarcError(f"{name}: {e}") from e
                yield dict.fromkeys(schema.names) | {"archive": name, "error": str(e)}

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                some, size = [], 0
                for row in rows(name, data.as_py()):
                    some.append(row)
                    size += len(row["payload"] or b"") + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(some, schema=schema)
                        some, size = [], 0
                yield pa.RecordBatch.from_pylist(some, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    one = files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    return one.mapInArrow(read, _READ)


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages (page_id, url, html) as archives, reads those back and returns the records of each page."""
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", "html")
    folder = folder or fresh_path(spark, "warc")
    written = write_archives(mark_revisits(pages), folder).agg(F.sum("records")).first()[0]
    kind = pages.schema["page_id"].dataType
    number = lambda c: F.when(F.col(c) != "urn:page:null", F.substring(c, len("urn:page:") + 1, 40)).cast(kind)
    if not written:
        return pages.limit(0).select("page_id", F.lit(0).cast("bigint").alias("payload_bytes"), F.lit("").alias("payload_digest"), F.lit("").alias("record_type"), F.col("page_id").alias("refers_to"))
    records = read_archives(spark, folder, with_payload=False)
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))

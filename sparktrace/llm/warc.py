"""WARC archives: a writer of record-wise gzip members and a splittable reader.

Reader: tasks get byte ranges of files. A task looks for the gzip magic in its range, takes a place as a member
only if its bytes decode to the start of a WARC record header, and owns the records that start inside its range; the last
one may end beyond it. Nothing is left out silently: a record that cannot be read to its end, and bytes after a record that begin
no other, are errors or rows that say so.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrace.llm.common import new_folder, written

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a range, and the most tasks; beyond, a task reads several ranges in a row.
SPLIT_BYTES, MOST_TASKS = 16 << 20, 50_000
#: Up to so many digests of repeated payloads are broadcast (some 50 bytes each).
BROADCAST_DIGESTS = 500_000
CHUNK, STEP = 1 << 20, 1 << 10
VERSION = re.compile(rb"WARC/\d\.\d")
DATE = "2024-01-01T00:00:00Z"
SCHEMA = "record_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary, damage string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, size: int, sha1: str, first: int | None) -> bytes:
    """One gzip member. `first`: the page that holds the payload, for a revisit record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if first is None else b"")
    uri = re.sub(r"[\s\x00-\x1f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if first is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{first}>"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, folder: str, least_revisit: int = 0) -> None:
    """Writes a record per row of `pages(page_id, url, html)` into `folder/part-<task>.warc.gz`.

    Rows with equal payloads of at least `least_revisit` bytes: the smallest page_id is the response, the
    others are revisits of it. A null html is an empty payload; a null page_id is a response; rows that
    repeat the smallest page_id are all responses; an empty table writes archives without records. A file is
    written under a name of its own attempt and renamed when complete, so a task that runs again replaces it.
    Very long payloads are records of their own size, in the memory of one task. Other columns are not read.
    """
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", raw.alias("payload"), F.unhex(F.sha1(raw)).alias("key"), F.octet_length(raw).alias("size"))
    # Only digests of repeated payloads are joined, found from digests and ids alone: payloads stay where they are when
    # these are few, and else the written table leaves Spark free to split a very common one.
    repeats = F.col("page_id").isNotNull() & (F.col("size") >= least_revisit)
    first = rows.where(repeats).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    first = written(first, "repeated-payloads")
    first = F.broadcast(first) if first.count() <= BROADCAST_DIGESTS else first
    told = rows.join(first, "key", "left").withColumn("first", F.when(repeats & (F.col("page_id") > F.col("first")), F.col("first"))).sortWithinPartitions("page_id", "url")

    def run(batches):
        from pyspark import TaskContext

        store, at = pafs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        task = TaskContext.get()
        name = f"{at}/part-{task.partitionId():06d}.warc.gz"
        part = f"{at}/.part-{task.partitionId():06d}-{task.taskAttemptId()}"
        n = 0
        with store.open_output_stream(part, compression=None) as out:
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "size", "key", "first"))):
                    page_id, url, payload, size, key, other = row
                    out.write(record(page_id, url, payload, size, base64.b32encode(key).decode(), other))
                    n += 1
        store.move(part, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "records"])

    told.select("page_id", "url", "payload", "size", "key", "first").mapInArrow(run, "file string, records long").agg(F.sum("records")).first()


def headers(head: bytes) -> dict[str, str] | None:
    """The fields of a WARC record header, a continued line joined to the one before; None if `head` is none."""
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")
    if not VERSION.fullmatch(lines[0]):
        return None
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        out[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return out if "warc-type" in out and out.get("content-length", "").isdigit() else None


class Window:
    """Bytes of a file from a moving position; holds what one record needs and no more."""

    def __init__(self, file, start: int):
        self.file, self.start, self.data = file, start, bytearray()
        file.seek(start)

    def upto(self, end: int) -> bool:
        """Makes bytes before `end` available; False at the end of the file."""
        while self.start + len(self.data) < end:
            more = self.file.read(CHUNK)
            if not more:
                return False
            self.data += more
        return True

    def drop(self, before: int) -> None:
        del self.data[: before - self.start]
        self.start = before


class Damaged(Exception):
    """A record that begins and cannot be read; `fields` are those of its header, if that is whole."""

    def __init__(self, reason: str, fields: dict | None = None):
        super().__init__(reason)
        self.fields = fields or {}


def member(window: Window, at: int) -> tuple[dict, bytes, int] | None:
    """Fields and block of the WARC record of the gzip member at `at`, and the member's end; None if no record begins there.

    Once the decoded bytes begin with the first line of a header, whatever keeps the record from being read whole is `Damaged`.
    """
    unpack, head, out, end, fields = zlib.decompressobj(31), bytearray(), [], at, None
    begun = lambda: b"\r\n" in head[:12] and VERSION.fullmatch(bytes(head[:12]).partition(b"\r\n")[0])

    def lost(reason: str) -> None:
        if fields is not None or begun():
            raise Damaged(reason, fields)

    while not unpack.eof:
        more = window.upto(end + 1)
        # A header is decoded in small steps, as a step that meets an error gives nothing of what is before it.
        known = fields is not None
        piece = bytes(memoryview(window.data)[end - window.start :][: CHUNK if known else STEP])
        try:
            got = unpack.decompress(piece, 0 if known else STEP)
        except zlib.error as error:
            return lost(f"the record does not decode: {error}")
        if not more and not got and not unpack.eof:
            return lost("the file ends inside a record")
        end += len(piece) - len(unpack.unused_data if unpack.eof else unpack.unconsumed_tail)
        if fields is not None:
            out.append(got)
            continue
        seen = max(0, len(head) - 3)
        head += got
        if len(head) >= 12 and not begun():
            return None
        whole = head.find(b"\r\n\r\n", seen)
        if whole >= 0:
            fields = headers(bytes(head[:whole]))
            if fields is None:
                return lost("the record's header has no type or length")
            out.append(bytes(head[whole + 4 :]))
    if fields is None:
        return lost("the record ends inside its header")
    block, size = b"".join(out), int(fields["content-length"])
    if len(block) < size:
        return lost("the record is shorter than its length")
    return fields, block[:size], end


def begins(window: Window, at: int) -> bool:
    """Whether the gzip member at `at` decodes to the start of a record's header."""
    unpack, head, end = zlib.decompressobj(31), b"", at
    while len(head) < 10 and not unpack.eof and window.upto(end + 1):
        piece = bytes(memoryview(window.data)[end - window.start :][:CHUNK])
        try:
            head += unpack.decompress(piece, 10)
        except zlib.error:
            return False
        end += len(piece) if not unpack.unconsumed_tail else 0
        if unpack.unconsumed_tail:
            break
    return bool(VERSION.match(head))


def records(file, start: int, end: int):
    """(fields, block, damage) of the records whose members start in [start, end). `damage` is null, or says what could not be read.

    Bytes after a record, or at the start of the file, that begin no record are damage too, found by the range that owns the record before.
    """
    window, at, joined = Window(file, start), start, start == 0
    while at < end or joined:
        window.upto(at + CHUNK)
        found = window.data.find(MAGIC, at - window.start)
        # The range after this one cannot know that a record has to begin where it finds none.
        if joined and window.upto(at + 1) and (found != at - window.start or at >= end and not begins(window, at)):
            yield {}, b"", f"the bytes at {at} are no record"
        if at >= end:
            return
        if found < 0:
            joined = False
            at = max(at + 1, window.start + len(window.data) - len(MAGIC) + 1)
            window.drop(min(at, window.start + len(window.data)))
            if not window.upto(at + len(MAGIC)):
                return
            continue
        exact, at = joined and found == at - window.start, window.start + found
        joined = False
        if at >= end:
            return
        try:
            got = member(window, at)
        except Damaged as damage:
            yield damage.fields, b"", f"{damage} (at {at})"
            at += 1
            continue
        if got is None:
            if exact:
                yield {}, b"", f"the bytes at {at} are no record"
            at += 1
            continue
        fields, block, at = got
        joined = True
        window.drop(at)
        yield fields, block, None


def stated_digest(fields: dict[str, str], payload: bytes, chunked: bool) -> tuple[str | None, bool]:
    """The payload digest a header states, without its algorithm, and whether the payload contradicts it.

    Base32 and hex forms of the algorithms that hashlib knows are compared; other ones, and bodies sent in chunks, are not.
    """
    name, colon, value = fields.get("warc-payload-digest", "").partition(":")
    if not colon:
        return None, False
    if chunked or name.lower() not in hashlib.algorithms_guaranteed or name.lower().startswith("shake"):
        return value, False
    own = hashlib.new(name.lower(), payload)
    return value, value.upper().rstrip("=") != base64.b32encode(own.digest()).decode().rstrip("=") and value.lower() != own.hexdigest()


def read_archives(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES, on_damage: str = "raise") -> DataFrame:
    """Records of all `*.warc.gz` in `folder`, of whatever writer, read in ranges of `split_bytes`. Columns as in SCHEMA.

    `record_id` and `refers_to` are the texts of the header. The payload of a response is what follows its HTTP header, of a revisit null, of any
    other record its block. `payload_digest` is the SHA-1 of the payload in base32, of a revisit the digest it states; `payload_bytes` of a
    revisit is the length its HTTP header states, or null. A record that cannot be read whole (cut off, damaged, shorter than it says, its payload
    not that of its digest), and bytes where a record should begin, are an error; with `on_damage` = "keep" they are rows with the reason in
    `damage` and no payload. Headers may have any length. A record that lies uncompressed inside another's member, as in an
    archive of archives, is taken for one of its own where a range begins inside that member. Empty folders give no rows.
    """
    if on_damage not in ("raise", "keep"):
        raise ValueError("on_damage is 'raise' or 'keep'")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length").where("length > 0")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    tasks = max(1, min(MOST_TASKS, ranges.count()))

    def row(fields: dict, block: bytes, damage: str | None) -> tuple:
        kind, payload, http = fields.get("warc-type"), block, b""
        if kind in ("response", "revisit") and fields.get("content-type", "application/http").startswith("application/http"):
            http, _, payload = block.partition(b"\r\n\r\n")
        stated, wrong = stated_digest(fields, payload, bool(re.search(rb"(?i)\r\ntransfer-encoding:\s*chunked", http)))
        if damage is None and wrong and kind != "revisit":
            damage = f"the payload of {fields.get('warc-record-id')} does not match its digest"
        size = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
        whole = damage is None and kind != "revisit"
        n = len(payload) if whole else int(size[1]) if size and damage is None else None
        name = digest(payload) if whole else stated
        return fields.get("warc-record-id"), fields.get("warc-target-uri") or None, kind, fields.get("warc-refers-to"), name, n, payload if whole else None, damage

    def run(batches):
        kinds = {"record_id": pa.string(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "payload": pa.binary(), "damage": pa.string()}

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=[*kinds])

        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                store, at = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
                rows, held = [], 0
                with store.open_input_file(at) as file:
                    for found in records(file, start, start + split_bytes):
                        rows.append(row(*found))
                        if rows[-1][-1] is not None and on_damage == "raise":
                            raise ValueError(f"{path}: {rows[-1][-1]}")
                        held += len(found[1])
                        if held > 16 << 20 or len(rows) >= 5000:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    return ranges.repartitionByRange(tasks, "path", "start").mapInArrow(run, SCHEMA)


def page_of(record_id: str):
    """The page number of a record id of `write_archives`; null for any other."""
    return F.regexp_extract(record_id, "^<urn:x-page:(-?[0-9]+)>$", 1).try_cast("long")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(spark, folder).select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"))


QUERIES = {"op2_warc": op2_warc}
SQL: dict[str, str] = {}

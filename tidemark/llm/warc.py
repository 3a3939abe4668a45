"""WARC archives with revisit records, and a parallel reader with boundary-chain verification (operator 10).

Writing: a page whose payload equals that of a page with a smaller page_id becomes a revisit of it. Each task writes files of
its own, closed at `ROTATE` bytes. Reading: files are cut into ranges; a task emits, for every place in its range where
a record could begin, the offset and the offset of the successor that the record's own length announces. Per file (bounded by
ROTATE) pointer jumping from offset 0 then keeps what is reachable, so that record magic inside payloads is rejected.

Defined results: a null html is an empty payload; a null url is written as about:blank; rows that repeat the smallest page_id
of a payload are all responses; a null page_id counts as larger than every other; an empty table writes no file and gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, files

MAGIC = b"WARC/1.1\r\n"
_MAGICS = re.compile(rb"WARC/1\.[01]\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
ROTATE = 256 << 20
RANGE = 8 << 20
HEADER_LIMIT = 64 << 10
BROADCAST_GROUPS = 1_000_000
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:tidemark:page")
_RECORD = "file string, at long, next long, size long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"
_FIELDS = _RECORD.replace(" string", "").replace(" long", "").replace(" boolean", "").split(", ")


def base32_sha1(payload: bytes | memoryview) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id} {digest}')}>"


def _shown(value: int | None) -> str:
    return "-" if value is None else str(value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """One whole record; a revisit holds the HTTP head only, whose Content-Length is that of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"X-Page-Id: {_shown(page_id)}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(first, digest)}", f"X-Refers-To-Page-Id: {_shown(first)}"]
    head.append(f"Content-Length: {len(block)}")
    return MAGIC + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> list[tuple[str, int]]:
    """Write all pages below the folder; payloads of fewer than `least_bytes` bytes are never revisits. Files and sizes."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.unhex(F.sha1(html)).alias("sha1"))
    long_enough = F.octet_length("html") >= least_bytes
    groups = rows.where(long_enough).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select(F.col("sha1").alias("known"), "first")
    groups = common.materialise(groups, "copies")
    if groups.count() <= BROADCAST_GROUPS:  # 28 bytes each; beyond that, rows and groups are shuffled by digest
        groups = F.broadcast(groups)
    marked = rows.join(groups, (F.col("sha1") == F.col("known")) & long_enough, "left").withColumn("revisit", F.col("known").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, out, number, done = TaskContext.get(), None, 0, []
        for batch in batches:
            for page_id, url, text, sha1, first, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "sha1", "first", "revisit")), strict=True):
                if out is not None and out.size >= ROTATE:
                    out.commit()
                    done.append((name, out.size))
                    out, number = None, number + 1
                if out is None:
                    name = f"{folder}/part-{context.partitionId():06d}-{number:04d}.warc"
                    out = files.Replacing(name, context.taskAttemptId())
                out.write(record(page_id, url, text.encode(), base64.b32encode(sha1).decode(), first, revisit))
        if out is not None:
            out.commit()
            done.append((name, out.size))
        yield pa.record_batch([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["file", "size"])

    written = marked.select("page_id", "url", "html", "sha1", "first", "revisit").mapInArrow(run, "file string, size long")
    return sorted((r["file"], r["size"]) for r in written.collect())


def _header(raw: bytes) -> tuple[dict[bytes, bytes], int] | None:
    """The fields of a record's head by lower-case name, in any order, and its length; None where the bytes are no head."""
    end = raw.find(b"\r\n\r\n")
    if end < 0 or not raw.startswith(b"WARC/1."):
        return None
    fields = (x.split(b":", 1) for x in raw[:end].split(b"\r\n")[1:] if b":" in x)
    return {name.strip().lower(): value.strip() for name, value in fields}, end + 4


def _number(value: bytes | None) -> int | None:
    return int(value) if value and re.fullmatch(rb"-?\d{1,18}", value) else None


def parse(data: memoryview, at: int) -> tuple | None:
    """(length, page_id, payload_bytes, digest, type, refers_to, intact) of the record that begins at `at`, or None where
    the bytes are no whole record. Records of other types, or without an HTTP head, are links of the chain without payload."""
    raw = bytes(data[at : at + HEADER_LIMIT])
    found = _header(raw)
    size = _number(found[0].get(b"content-length")) if found else None
    if size is None or size < 0 or b"warc-type" not in found[0]:
        return None
    fields, head = found
    body = at + head
    if body + size + 4 > len(data) or data[body + size : body + size + 4] != b"\r\n\r\n":
        return None
    kind, length = fields[b"warc-type"].decode("utf-8", "replace"), body + size + 4 - at
    page_id, refers = _number(fields.get(b"x-page-id")), _number(fields.get(b"x-refers-to-page-id"))
    digest = fields.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha1:")
    block = data[body : body + size]
    http = bytes(block[:HEADER_LIMIT])
    split = http.find(b"\r\n\r\n")
    if kind not in ("response", "revisit") or split < 0:
        return length, page_id, None, digest, kind, refers, True
    told = re.search(rb"\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*\r\n", http[: split + 2], re.IGNORECASE)
    if kind == "revisit":
        return length, page_id, int(told[1]) if told else None, digest, kind, refers, size == split + 4
    payload = block[split + 4 :]
    intact = (not told or len(payload) == int(told[1])) and (not digest or base32_sha1(payload) == digest)
    return length, page_id, len(payload), digest or base32_sha1(payload), kind, None, intact


def candidates(spark: SparkSession, listed: list[tuple[str, int]], step: int = RANGE) -> DataFrame:
    """Every place that could begin a record, with its successor's offset and what its header says."""
    ranges = [(file, size, lo) for file, size in listed for lo in range(0, size, step)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, lo in zip(*(batch.column(c).to_pylist() for c in ("file", "size", "lo")), strict=True):
                system, path = files.at(file)
                rows = []
                with system.open_input_file(path) as f:
                    f.seek(lo)
                    data = f.read(min(size - lo, step + len(MAGIC) - 1))
                    for at in (m.start() for m in _MAGICS.finditer(data)):
                        if at >= step:
                            break
                        found = parse(memoryview(data), at)
                        if found is None and lo + len(data) < size:  # it may end beyond what has been read
                            more = _whole(f, lo + at, size)
                            found = parse(memoryview(more), 0) if more else None
                        if found:
                            rows.append((file, lo + at, lo + at + found[0], size, *found[1:]))
                yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(_FIELDS)}, schema=_ARROW)

    return spark.createDataFrame(ranges, "file string, size long, lo long").repartition(max(1, len(ranges)), "file", "lo").mapInArrow(run, _RECORD)


_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in (x.split(" ") for x in _RECORD.split(", "))])


def _whole(f, at: int, size: int) -> bytes | None:
    """The bytes of the record at `at`, by the length in its header, or None where there is none."""
    f.seek(at)
    found = _header(f.read(min(HEADER_LIMIT, size - at)))
    length = _number(found[0].get(b"content-length")) if found else None
    if length is None or length < 0 or at + found[1] + length + 4 > size:
        return None
    f.seek(at)
    return f.read(found[1] + length + 4)


def reachable(at: np.ndarray, following: np.ndarray, size: int) -> np.ndarray:
    """Which candidates a chain from offset 0 reaches, by pointer jumping; the chain must end at the end of the file."""
    order = np.argsort(at)
    offsets, n = at[order], len(at)
    place = np.searchsorted(offsets, following[order])
    jump = np.where((place < n) & (offsets[np.minimum(place, n - 1)] == following[order]), place, n)
    jump = np.append(jump, n)  # n: beyond the last record
    found = np.zeros(n + 1, bool)
    found[0] = n > 0 and offsets[0] == 0
    for _ in range(max(1, n).bit_length()):
        found[jump[found]] = True
        jump = jump[jump]
    found = found[:n]
    last = following[order][found]
    if not len(last) or last.max() != size:
        raise ValueError(f"the chain of records breaks off at {last.max(initial=0)} of {size} bytes")
    out = np.zeros(n, bool)
    out[order] = found
    return out


def read(spark: SparkSession, listed: list[tuple[str, int]], step: int = RANGE) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and intact of every response and revisit in the files. Archives of
    other writers are read too, if not compressed: page_id is null there, and records of other types are only links of the chain."""

    def chain(table: pa.Table) -> pa.Table:
        kept = reachable(table["at"].to_numpy(), table["next"].to_numpy(), table["size"][0].as_py())
        held = table.filter(pa.array(kept))
        return held.filter(pc.is_in(held["record_type"], pa.array(["response", "revisit"]))).select(_FIELDS[4:])

    return candidates(spark, listed, step).groupBy("file").applyInArrow(chain, ", ".join(_RECORD.split(", ")[4:]))


def round_trip(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    return read(spark, write(pages, common.scratch_path(spark, "warc")))

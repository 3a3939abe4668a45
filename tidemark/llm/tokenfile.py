"""Token files: canonical length-limited Huffman codes of ids, in independent blocks with bit-offset checkpoints (operator 8).

One pass encodes the texts, stores the packed ids and counts every id; code lengths of at most `MAX_BITS` come from these
global counts by package-merge. A range partitioning by doc_id then writes one file per partition, in ascending order.

File: b"TMHF1\\n", u32 size of the length table, that table (u8 per id, zlib), then blocks. A block holds whole documents:
u32 documents, u32 ids, u32 payload bytes, then i64 doc_id, u8 doc_id-is-null and u32 ids per document, u16 bits per CHECK ids
(the checkpoints, as differences), and the payload (most significant bit first). Decoding steps through the
checkpoints of a block side by side, each step taking one id per checkpoint from a table of 2**MAX_BITS entries.

Defined results: a null or empty text is one id, the end id; null doc_ids come first; repeated doc_ids follow each other in an
order fixed by their ids; an empty table gives no file and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bpe, common, files, kernels
from tidemark.llm.packing import END_ID, with_end

MAGIC = b"TMHF1\n"
CHECK = 64
MAX_BITS = 16
BLOCK_IDS = 1 << 18


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code length (u8) of each id under the limit, 0 for ids that do not occur; by package-merge."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    used = used[np.argsort(counts[used], kind="stable")]
    n = len(used)
    if n <= 2:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit codes of {limit} bits")
    leaves = counts[used].astype(np.float64)
    level, kinds = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        packs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        kinds.append(order < n)
    take, lengths = 2 * n - 2, np.zeros(n, np.uint8)
    for kind in reversed(kinds):
        chosen = int(kind[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out[used] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each id: by length, then by id."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), np.uint64)
    code, before = 0, 0
    for bits in range(1, int(lengths.max(initial=0)) + 1):
        code <<= bits - before
        same = order[lengths[order] == bits]
        codes[same] = code + np.arange(len(same))
        code, before = code + len(same), bits
    return codes


def decode_table(lengths: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Id and length by the next `bits` bits."""
    ids, size = np.zeros(1 << bits, np.uint32), np.ones(1 << bits, np.uint8)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = 1 << (bits - lengths[order].astype(np.int64))
    total = int(span.sum())
    ids[:total], size[:total] = np.repeat(order, span), np.repeat(lengths[order], span)
    return ids, size


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The code bits of the ids, and each id's bit offset (with the end)."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    at = ends - size
    word, room = at >> 6, 64 - (at & 63)
    value, over = codes[ids], size - room
    spill = over > 0
    upper = np.where(spill, value >> np.maximum(over, 0).astype(np.uint64), value << np.maximum(-over, 0).astype(np.uint64))
    words = np.zeros((total + 63 >> 6) + 1, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    if len(first):
        words[word[first]] = np.add.reduceat(upper, first)
    words[word[spill] + 1] += value[spill] << (64 - over[spill]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: total + 7 >> 3], np.append(at, total)


def unpack_bits(payload: bytes, starts: np.ndarray, count: int, table: tuple[np.ndarray, np.ndarray], bits: int = MAX_BITS) -> np.ndarray:
    """`count` ids from a payload whose every CHECK-th id starts at one of the bit offsets."""
    raw = np.frombuffer(payload + bytes(8), np.uint8)
    quad = raw[:-3].astype(np.uint32) << 24 | raw[1:-2].astype(np.uint32) << 16 | raw[2:-1].astype(np.uint32) << 8 | raw[3:]
    out = np.zeros((CHECK, len(starts)), np.uint32)
    at, last = starts.astype(np.int64), len(quad) - 1
    ids, size = table
    for k in range(CHECK):
        window = (quad[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> np.uint32(32 - bits)
        out[k] = ids[window]
        at = at + size[window]
    return out.T.ravel()[:count]


def block(doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    payload, at = pack_bits(ids, codes, lengths)
    checks = np.diff(at[:-1][::CHECK], prepend=0).astype("<u2")
    return b"".join([struct.pack("<3I", len(counts), len(ids), len(payload)), doc_ids.astype("<i8").tobytes(), nulls.astype("u1").tobytes(), counts.astype("<u4").tobytes(), checks.tobytes(), payload])


def read_blocks(stream) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids, nulls, counts and ids of each block of an open file."""
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    lengths = np.frombuffer(zlib.decompress(stream.read(struct.unpack("<I", stream.read(4))[0])), np.uint8)
    table = decode_table(lengths)
    while head := stream.read(12):
        docs, n, size = struct.unpack("<3I", head)
        doc_ids = np.frombuffer(stream.read(8 * docs), "<i8")
        nulls = np.frombuffer(stream.read(docs), "u1").astype(bool)
        counts = np.frombuffer(stream.read(4 * docs), "<u4").astype(np.int64)
        starts = np.cumsum(np.frombuffer(stream.read(2 * -(-n // CHECK)), "<u2").astype(np.int64))
        yield doc_ids, nulls, counts, unpack_bits(stream.read(size), starts, n, table)


def _encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, n, ids (packed), and, with n = -1, the counts of all ids of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, counts = bpe.load(path), np.zeros(0, np.int64)
        wide = np.dtype("<u2") if vocabulary.size <= 1 << 16 else np.dtype("<u4")
        pack = zstandard.ZstdCompressor(level=1).compress
        for chunk in kernels.chunks(batches):
            ids, bounds = with_end(*vocabulary.encode(*kernels.utf8(chunk.column("text"))), end_id)
            seen = np.bincount(ids, minlength=max(len(counts), vocabulary.size, end_id + 1))
            seen[: len(counts)] += counts
            counts = seen
            raw, ends = memoryview(ids.astype(wide).tobytes()), (bounds * wide.itemsize).tolist()
            packed = [pack(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch([chunk.column("doc_id"), pa.array(np.diff(bounds)), pa.array(packed, pa.binary()), pa.array([wide.itemsize] * len(packed), pa.int32())], ["doc_id", "n", "ids", "wide"])
        if len(counts):
            yield pa.record_batch([pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([pack(counts.astype("<i8").tobytes())], pa.binary()), pa.array([8], pa.int32())], ["doc_id", "n", "ids", "wide"])

    return common.doc_key(docs).mapInArrow(run, "doc_id long, n long, ids binary, wide int")


def _global_counts(stored: DataFrame) -> np.ndarray:
    """Sum of the tasks' counts; partial sums are formed on the workers and each has one entry per id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for raw in batch.column("ids").to_pylist():
                more = np.frombuffer(unpack(raw), "<i8").copy()
                more[: min(len(more), len(total))] += total[: len(more)]
                total = more if len(more) >= len(total) else total
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], ["id", "n"])

    rows = stored.where("n = -1").select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, np.int64)
    counts[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> list[tuple[str, int]]:
    """Write the ids of all documents below the folder in ascending doc_id order; each file in order, and its number of ids."""
    path = path or bpe.default_path()
    spark = docs.sparkSession
    stored = common.materialise(_encoded(docs, path, end_id), "ids")
    lengths = code_lengths(_global_counts(stored))
    table = zlib.compress(lengths.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, codes = TaskContext.get(), canonical_codes(lengths)
        name = f"{folder}/part-{context.partitionId():06d}.tmh"
        unpack = zstandard.ZstdDecompressor().decompress
        out, held, waiting, total = None, [], 0, 0

        def flush() -> None:
            ids = np.concatenate([x[2] for x in held])
            doc_ids = np.array([x[0] or 0 for x in held])
            nulls = np.array([x[0] is None for x in held])
            out.write(block(doc_ids, nulls, np.array([len(x[2]) for x in held]), ids, codes, lengths))
            held.clear()

        for batch in batches:
            for doc_id, raw, wide in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), batch.column("wide").to_pylist(), strict=True):
                if out is None:
                    out = files.Replacing(name, context.taskAttemptId())
                    out.write(MAGIC + struct.pack("<I", len(table)) + table)
                ids = np.frombuffer(unpack(raw), f"<u{wide}")
                held.append((doc_id, wide, ids))
                waiting, total = waiting + len(ids), total + len(ids)
                if waiting >= BLOCK_IDS:
                    flush()
                    waiting = 0
        if out is not None:
            if held:
                flush()
            out.commit()
            yield pa.record_batch([pa.array([context.partitionId()], pa.int32()), pa.array([name]), pa.array([total], pa.int64())], ["part", "file", "n"])

    n = common.shuffle_partitions(spark)
    ordered = stored.where("n >= 0").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n", "ids")
    return [(r["file"], r["n"]) for r in sorted(ordered.mapInArrow(run, "part int, file string, n long").collect(), key=lambda r: r["part"])]


def read(spark, written: list[tuple[str, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files, which are read block by block."""
    start, rows = 0, []
    for file, n in written:
        rows.append((file, start))
        start += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                system, path = files.at(file)
                with system.open_input_stream(path) as stream:
                    for doc_ids, nulls, counts, ids in read_blocks(stream):
                        bounds = np.concatenate([[0], np.cumsum(counts)])
                        crc = kernels.crc32_rows(ids.astype("<u4").tobytes(), 4 * bounds)
                        yield pa.record_batch([pa.array(doc_ids, mask=nulls), pa.array(before + bounds[:-1]), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        before += len(ids)

    listed = spark.createDataFrame(rows, "file string, before long").repartition(max(1, len(rows)), "file")
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    folder = common.scratch_path(docs.sparkSession, "tokens")
    return read(docs.sparkSession, write(docs, folder, path))

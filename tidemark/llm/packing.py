"""Sum-of-squares packing of token pieces into sequences (operator 7).

Documents become ids with an end id; those longer than a sequence are cut so that only their first piece may be shorter.
Full pieces are sequences of their own. The others are dealt to shards by a hash of their key, and each shard places them,
longest first, into the open sequence for which the sum over gaps of the squared number of open sequences with that gap
becomes smallest; ties go to the smallest gap, and a new sequence begins only where no open one fits. Sequences that end with a gap are
opened again and their pieces are packed in a further round with fewer shards, until one shard holds what is left, or until a
round fills hardly a sequence: then nothing more fits together, and all stay as they are. A task never holds more than some
`shard_items` pieces.

Defined results: a null or empty text is one piece that holds only the end id; repeated rows and null doc_ids each keep
their pieces; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bpe, common, kernels

CAPACITY = 1024
END_ID = 2
SHARD_ITEMS = 50_000
#: A round that leaves more than this share of its pieces in sequences with a gap is the last one.
STALLED = 0.9
NEVER = np.iinfo(np.int64).max
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = f"{_PIECES}, sequence_id long, offset long, closed boolean"


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each row followed by the end id."""
    rows = np.arange(1, len(bounds))
    out = np.full(len(ids) + len(rows), end_id, "<u4")
    keep = np.ones(len(out), bool)
    keep[bounds[1:] + rows - 1] = False
    out[keep] = ids
    return out, bounds + np.arange(len(bounds))


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    path = path or bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = bpe.load(path)
        for chunk in kernels.chunks(batches):
            ids, bounds = with_end(*vocabulary.encode(*kernels.utf8(chunk.column("text"))), end_id)
            size = np.diff(bounds)
            first = np.where(size % capacity, size % capacity, capacity)
            count = 1 + (size - first) // capacity
            row = np.repeat(np.arange(len(size)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = np.where(piece > 0, first[row] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first[row])
            crc = kernels.crc32_rows(ids.tobytes(), 4 * np.append(bounds[:-1][row] + start, bounds[-1]))
            yield pa.record_batch([chunk.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return common.doc_key(docs).mapInArrow(run, _PIECES)


def place(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, in the order given, and the final gap of each bin."""
    gaps = np.zeros(capacity + 1, np.int64)  # open bins by gap; none counts for gap 0 or for an empty bin
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, left = [], [], []
    for size in lengths:
        after = gaps[: capacity - size + 1]  # by the gap that would remain
        cost = 2 * (after - gaps[size:]) + 2
        cost[0] -= 1
        cost[gaps[size:] == 0] = NEVER
        rest = int(cost.argmin())
        if cost[rest] < NEVER:  # some open sequence fits
            gap = rest + size
            b = held[gap].pop()
            gaps[gap] -= 1
        else:
            gap, rest, b = capacity, capacity - size, len(left)
            left.append(capacity)
        bins.append(b)
        offsets.append(capacity - gap)
        left[b] = rest
        if rest:
            gaps[rest] += 1
            held[rest].append(b)
    return bins, offsets, left


def _pack_round(items: DataFrame, shards: int, number: int, last: bool, capacity: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending")]).combine_chunks()
        bins, offsets, left = place(table["length"].to_pylist(), capacity)
        base = number << 56 | TaskContext.get().partitionId() << 32
        closed = [last or not left[b] for b in bins]
        out = table.append_column("sequence_id", pa.array([base + b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64())).append_column("closed", pa.array(closed))
        yield from out.to_batches(max_chunksize=20_000)

    return items.repartition(shards, "doc_id", "piece", "start").mapInArrow(run, _PLACED)


def pack(found: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """sequence_id and offset for every piece; `found` should be a stored table, since it is read more than once."""

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for b in batches:
            ids = np.arange(at, at + b.num_rows)
            at += b.num_rows
            yield pa.record_batch([*b.columns, pa.array(ids), pa.array(np.zeros(b.num_rows, np.int64))], [*b.schema.names, "sequence_id", "offset"])

    done = [found.where(F.col("length") == capacity).mapInArrow(alone, f"{_PIECES}, sequence_id long, offset long")]
    rest, number = found.where(F.col("length") < capacity), 1
    count = rest.count()
    while count:
        shards = max(1, math.ceil(count / shard_items))
        placed = _pack_round(rest, shards, number, shards == 1, capacity)
        if shards > 1:
            placed = common.materialise(placed, f"packed{number}")
            before, count = count, placed.where("not closed").count()
            if count > STALLED * before:
                placed = placed.withColumn("closed", F.lit(True))
        done.append(placed.where("closed").drop("closed"))
        if shards == 1 or count > STALLED * before:
            break
        rest, number = placed.where("not closed").drop("sequence_id", "offset", "closed"), number + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    return pack(common.materialise(pieces(docs, path), "pieces"))

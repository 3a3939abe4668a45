"""Nearest neighbours by cross-polytope hashing (operator 3).

Each of `TABLES` tables turns unit vectors by fast Hadamard pseudo-rotations (three rounds of random signs and a transform) and
assigns them to the nearest signed axis of each; the axes of a row's rotations together name its cell. The first rotation has all
axes, and further ones, of which the last may be cut to fewer coordinates, make the cells of a table grow with the number of rows, so that
one holds CELL_ROWS / (2 x width) rows or so; beyond FEW_ROWS rows, cells grow more slowly than the rows, since recall would fall. A query also probes the cells that cost it least, where a cell costs the sum of
the squared distances by which its axes are further than the nearest ones. Buckets of cells, which hold ids alone, answer each
query with ids; blocks of rows score these in double precision on the original vectors and return the best k of a block. Cells of
more than HOT_ROWS rows are split over several buckets. Rows with equal vectors are indexed once, so a group of copies costs one entry.
Queries for which fewer than k rows were found are scored against all rows, in the same blocks.

Where norms differ, all index vectors get a further coordinate that makes them equally long; the order by inner product is then the
order by angle.

Defined results: rows whose id is null, or whose vector is null, empty, zero or holds a null or non-finite component, take no part;
vectors only meet those of their own length; a repeated id stands once for each of its different vectors (the others are candidates for
each of them), and rows equal in id and vector count once; ties go to the smaller vec_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common, kernels

TABLES = 42
PROBES = 28
NEIGHBOURS = 20
#: The cells of a table are this times fewer than the rows, after the axes of the first rotation.
CELL_ROWS = 400
#: Beyond so many rows the number of cells grows with their power 0.3 only, by which recall stays.
FEW_ROWS = 51_200
BLOCK_ROWS = 32_768
BUCKET_ENTRIES = 2 << 20
HOT_ROWS = 2 << 20
IDS = 512
SEED = 20_240_101


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        pairs = x.reshape(n, -1, 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, width)
        h *= 2
    return x


def rotated(x: np.ndarray, *which: int) -> np.ndarray:
    """A pseudo-rotation of each row, padded to a power of two; the same for every task."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    signs = np.random.default_rng([SEED, *which, width]).choice([-1.0, 1.0], (3, width))
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    for s in signs:
        x = hadamard(x * s) / math.sqrt(width)
    return x


def axis_counts(n: int, width: int) -> list[int]:
    """The number of signed axes of each rotation of a table, by the number of rows: powers of two, 2 * width at most."""
    out, wanted = [2 * width], min(n, FEW_ROWS * (n / FEW_ROWS) ** 0.3) / CELL_ROWS
    while wanted >= 2:
        out.append(min(2 * width, 1 << int(math.log2(wanted))))
        wanted /= out[-1]
    return out


def cells(x: np.ndarray, table: int, counts: list[int], probes: int) -> np.ndarray:
    """The `probes` cells of each row that cost least, cheapest first."""
    cell, cost = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for number, axes in enumerate(counts):
        turned = rotated(x, table, number)[:, : axes // 2]
        both = np.concatenate([turned, -turned], 1)
        far = np.square(both.max(1, keepdims=True) - both)
        axis = np.argpartition(far, min(probes, axes) - 1, axis=1)[:, :probes]
        # the cheapest cells begin with the cheapest ones of the rotations before
        cost = (cost[:, :, None] + np.take_along_axis(far, axis, 1)[:, None, :]).reshape(len(x), -1)
        cell = (cell[:, :, None] * axes + axis[:, None, :]).reshape(len(x), -1)
        best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        cell, cost = np.take_along_axis(cell, best, 1), np.take_along_axis(cost, best, 1)
    return cell


def _vectors(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat doubles of a list column (nulls as NaN) and the n + 1 bounds."""
    rows = rows.cast(pa.list_(pa.float64()))
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.nan_to_num(rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    return flat, np.concatenate([[0], np.cumsum(size)])


def valid_vectors(table: DataFrame) -> DataFrame:
    """vec_id, key (a digest of the vector), vid (its first 8 bytes), vec (the components as bytes, of their own width), dim and norm of
    the rows that take part."""
    kind = _kind(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, bounds = _vectors(batch.column("embedding"))
            out = []
            for vec_id, a, b in zip(batch.column("vec_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                x = flat[a:b] + 0.0  # no negative zeros
                if vec_id is not None and len(x) and np.isfinite(x).all() and x.any():
                    raw = x.astype(kind).tobytes()
                    key = hashlib.blake2b(raw, digest_size=16).digest()
                    out.append((vec_id, key, int.from_bytes(key[:8], "little", signed=True), raw, len(x), float(np.sqrt(x @ x))))
            names, kinds = ["vec_id", "key", "vid", "vec", "dim", "norm"], [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.float64()]
            yield pa.record_batch([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names)

    return table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, key binary, vid long, vec binary, dim int, norm double")


def _kind(table: DataFrame) -> str:
    """Single precision holds what it is given exactly; everything else is kept as doubles."""
    return "<f4" if table.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"


def _smallest_ids(rows: DataFrame, keep: int) -> DataFrame:
    """key, vid, vec, dim and the `keep` smallest ids of each distinct vector; tasks trim their own lists first."""

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, list] = {}
            for vec_id, key, vid, vec, dim in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "key", "vid", "vec", "dim")), strict=True):
                held.setdefault(key, [vid, vec, dim, set()])[3].add(vec_id)
            first = [pa.array([h[k] for h in held.values()], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.int32()))]
            yield pa.record_batch([pa.array(list(held), pa.binary()), *first, pa.array([sorted(h[3])[:keep] for h in held.values()], pa.list_(pa.int64()))], ["key", "vid", "vec", "dim", "ids"])

    trimmed = rows.select("vec_id", "key", "vid", "vec", "dim").mapInArrow(trim, "key binary, vid long, vec binary, dim int, ids array<long>")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    return trimmed.groupBy("key").agg(*(F.first(c).alias(c) for c in ("vid", "vec", "dim")), ids.alias("ids"))


def _slots(rows: DataFrame, kind: str, tables: int, probes: int, n: int, longest: float | None, index: bool) -> DataFrame:
    """slot (a hash of width, table and cell) and vid, a row for each table and probed cell. `longest`: extend index vectors to this norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                for at in range(0, part.num_rows, 1000):
                    some = part.slice(at, 1000)
                    x = np.frombuffer(b"".join(some.column("vec").to_pylist()), kind).reshape(-1, dim).astype(np.float64)
                    norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
                    if longest is not None:
                        more = np.sqrt(np.maximum(longest**2 - norm**2, 0)) if index else np.zeros_like(norm)
                        x = np.concatenate([x / (longest if index else norm), more / longest], 1)
                    else:
                        x = x / norm
                    counts = axis_counts(n, 1 << max(0, x.shape[1] - 1).bit_length())
                    found = np.concatenate([kernels.mix(cells(x, t, counts, probes).astype(np.uint64) + np.uint64(dim << 48 | t << 40)) for t in range(tables)], 1)
                    vid = np.repeat(some.column("vid").to_numpy(), found.shape[1])
                    yield pa.record_batch([pa.array(found.ravel().view(np.int64)), pa.array(vid)], ["slot", "vid"])

    return rows.select("vid", "vec", "dim").mapInArrow(run, "slot long, vid long")


def _dealt(slots: DataFrame, buckets: int, hot: np.ndarray, parts: np.ndarray, index: bool) -> DataFrame:
    """The slots and ids by bucket, packed. Of a hot slot, an index row goes to one of its parts and a query to each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot, vid = batch.column("slot").to_numpy(), batch.column("vid").to_numpy()
            part = np.zeros(len(slot), np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, slot), len(hot) - 1)
                n = np.where(hot[at] == slot, parts[at], 1)
                if index:
                    part = (vid.view(np.uint64) >> np.uint64(8)).astype(np.int64) % n
                else:
                    slot, vid = np.repeat(slot, n), np.repeat(vid, n)
                    part = np.arange(len(slot)) - np.repeat(np.cumsum(n) - n, n)
            bucket = (kernels.mix(slot.view(np.uint64) + part.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((slot, bucket))
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            spans = [order[a:b] for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True)]
            yield pa.record_batch([pa.array(bucket[order][cuts]), pa.array([slot[x].tobytes() for x in spans], pa.binary()), pa.array([vid[x].tobytes() for x in spans], pa.binary())], ["bucket", "slots", "vids"])

    return slots.mapInArrow(run, "bucket long, slots binary, vids binary")


def _met(probes: DataFrame, index: DataFrame, blocks: int) -> DataFrame:
    """block, query (vid) and vids: the upper halves of the ids that share a cell with a query, by block of rows, at most IDS in a row. A task holds the
    index entries of one bucket; the probes pass by."""
    names, kinds = ["block", "query", "vids"], [pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, slot, vid = None, [], None, None
        for batch in batches:
            buckets, sides = batch.column("bucket").to_numpy(), batch.column("side").to_numpy()
            cuts = np.flatnonzero(np.append(True, (np.diff(buckets) != 0) | (np.diff(sides) != 0))).tolist() if len(buckets) else []
            for a, b in zip(cuts, [*cuts[1:], len(buckets)], strict=True):
                if buckets[a] != at:
                    at, held, slot, vid = buckets[a], [], None, None
                read = [np.frombuffer(b"".join(batch.column(c)[a:b].to_pylist()), np.int64) for c in ("slots", "vids")]
                if not sides[a]:
                    held.append(read)
                    continue
                if slot is None:
                    slot, vid = (np.concatenate([h[k] for h in held] or [np.zeros(0, np.int64)]) for k in (0, 1))
                    order = np.argsort(slot, kind="stable")
                    held, slot, vid = [], slot[order], vid[order]
                wanted, query = read
                place = np.argsort(query, kind="stable")
                query, wanted = query[place], wanted[place]
                low, high = np.searchsorted(slot, wanted), np.searchsorted(slot, wanted, "right")
                new = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
                out, size = [], 0
                for c, d in zip(new.tolist(), [*new[1:].tolist(), len(query)], strict=True):
                    found = np.unique(np.concatenate([vid[i:j] for i, j in zip(low[c:d].tolist(), high[c:d].tolist(), strict=True)]))
                    block = found % blocks
                    order = np.argsort(block, kind="stable")
                    upper, block = (found[order] >> 32).astype(np.int32), block[order]
                    edges = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
                    for e, f in zip(edges, [*edges[1:], len(found)], strict=True):
                        out += [(int(block[e]), int(query[c]), upper[g : min(f, g + IDS)].tobytes()) for g in range(e, f, IDS)]
                    size += len(found)
                    if size >= 64 * IDS:
                        yield pa.record_batch([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names)
                        out, size = [], 0
                if out:
                    yield pa.record_batch([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names)

    both = index.withColumn("side", F.lit(0)).union(probes.withColumn("side", F.lit(1)))
    return both.repartition("bucket").sortWithinPartitions("bucket", "side").mapInArrow(run, "block long, query long, vids binary")


def _scored(asked: DataFrame, queries: DataFrame, index: DataFrame, blocks: int, kind: str, k: int) -> DataFrame:
    """query, found (keys) and score: the best k + 1 of a block, with ties, among the upper halves of ids that `asked` (block, query, vids) lists
    for each query; null vids ask for all rows of the query's length. A task holds the rows of one block; each query's vector and lists pass by."""
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    there = index.select(F.pmod("vid", F.lit(blocks)).alias("block"), F.lit(0).alias("side"), F.col("vid").alias("query"), "key", F.col("vec").alias("body"), "dim")
    asking = queries.select(every.alias("block"), F.lit(1).alias("side"), F.col("vid").alias("query"), "key", F.col("vec").alias("body"), "dim")
    lists = asked.select("block", F.lit(2).alias("side"), "query", F.lit(None).cast("binary").alias("key"), F.col("vids").alias("body"), F.lit(None).cast("int").alias("dim"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, name, loading, rows = None, None, [], {}
        vectors: list[tuple] = []
        wanted: list = []
        found: list[tuple] = []

        def load() -> None:
            for dim in {r[3] for r in loading}:
                part = sorted((r for r in loading if r[3] == dim), key=lambda r: r[0])
                rows[dim] = ((np.array([r[0] for r in part]) >> 32).astype(np.int32), [r[1] for r in part], np.frombuffer(b"".join(r[2] for r in part), kind).reshape(-1, dim).astype(np.float64))
            loading.clear()

        def answer() -> None:
            for key, vec, dim in vectors if wanted else ():
                if dim not in rows:
                    continue
                own, keys, v = rows[dim]
                if any(x is None for x in wanted):
                    here = np.arange(len(own))
                else:
                    ids = np.unique(np.frombuffer(b"".join(wanted), np.int32))
                    low, high = np.searchsorted(own, ids), np.searchsorted(own, ids, "right")
                    here = low[high > low]
                    if (high - low).max(initial=0) > 1:  # different vectors with equal upper halves
                        here = np.concatenate([np.arange(i, j) for i, j in zip(low.tolist(), high.tolist(), strict=True)])
                score = np.einsum("ij,j->i", v[here], np.frombuffer(vec, kind).astype(np.float64))
                if len(here) > k + 1:
                    # ties with the last one stay: their ids decide
                    some = np.flatnonzero(score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1])
                    here, score = here[some], score[some]
                found.extend((key, keys[i], x) for i, x in zip(here.tolist(), score.tolist(), strict=True))
            vectors.clear()
            wanted.clear()

        def told() -> pa.RecordBatch:
            out = pa.record_batch([pa.array([r[c] for r in found], t) for c, t in enumerate((pa.binary(), pa.binary(), pa.float64()))], ["query", "found", "score"])
            found.clear()
            return out

        for batch in batches:
            for block, side, query, key, body, dim in zip(*(batch.column(c).to_pylist() for c in ("block", "side", "query", "key", "body", "dim")), strict=True):
                if block != at or (side and query != name):
                    answer()
                    name = query
                    if block != at:
                        at, rows = block, {}
                        loading.clear()
                if not side:
                    loading.append((query, key, body, dim))
                    continue
                if loading:
                    load()
                if side == 1:
                    vectors.append((key, body, dim))
                else:
                    wanted.append(body)
                if len(found) >= 20_000:
                    yield told()
        answer()
        yield told()

    both = there.union(asking).union(lists).repartition("block").sortWithinPartitions("block", F.col("side") > 0, "query", "side")
    return both.mapInArrow(run, "query binary, found binary, score double")


def search(table: DataFrame, is_query, k: int = NEIGHBOURS, tables: int = TABLES, probes: int = PROBES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows found for each row for which the Column `is_query` (over vec_id)
    holds, itself excluded."""
    kind = _kind(table)
    rows = common.materialise(valid_vectors(table), "vectors")
    index = common.materialise(_smallest_ids(rows, k + 1), "distinct")
    queries = common.materialise(rows.where(is_query).select("key", "vid", "vec", "dim").dropDuplicates(["key"]), "queries")
    spread = rows.agg(F.min("norm").alias("low"), F.max("norm").alias("high")).first()
    longest = spread["high"] if spread["high"] and spread["low"] < 0.999 * spread["high"] else None
    n, nq = index.count(), queries.count()
    blocks, buckets = max(1, math.ceil(n / block_rows)), max(1, math.ceil((n * tables + nq * tables * probes) / BUCKET_ENTRIES))
    coded = _slots(index, kind, tables, 1, n, longest, True)
    hot, parts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n > HOT_ROWS:  # else no cell can be hot; there are tables * n / HOT_ROWS of these at most
        coded = common.materialise(coded, "slots")
        found = coded.groupBy("slot").count().where(F.col("count") > HOT_ROWS).orderBy("slot").toArrow()
        hot, parts = found["slot"].to_numpy(), -(-found["count"].to_numpy() // HOT_ROWS)
    met = _met(_dealt(_slots(queries, kind, tables, probes, n, longest, False), buckets, hot, parts, False), _dealt(coded, buckets, hot, parts, True), blocks)
    pairs = common.materialise(_scored(met, queries, index, blocks, kind, k), "scored")
    sizes = index.select(F.col("key").alias("found"), "dim", F.size("ids").alias("n"))
    there = sizes.groupBy("dim").agg(F.least(F.sum("n"), F.lit(k + 1)).alias("there"))
    reached = pairs.join(sizes, "found").groupBy("query").agg(F.sum("n").alias("n"))
    short = queries.join(there, "dim").join(reached, F.col("key") == F.col("query"), "left").where(F.coalesce("n", F.lit(0)) < F.col("there"))
    short = common.materialise(short.select("key", "vid", "vec", "dim"), "short")
    if not short.isEmpty():
        every = short.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.col("vid").alias("query"), F.lit(None).cast("binary").alias("vids"))
        pairs = pairs.join(short.select(F.col("key").alias("query")), "query", "left_anti").union(_scored(every, short, index, blocks, kind, k))
    pairs = pairs.join(index.select(F.col("key").alias("found"), "ids"), "found")
    # k + 1 distinct vectors hold k rows beside the query; equal scores of several vectors are told apart by single ids below
    near = pairs.withColumn("place", F.rank().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("place") <= k + 1)
    listed = near.select("query", "found", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "found")
    listed = listed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    packed = listed.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score", "found"))).alias("near"))
    asking = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("key").alias("query")).distinct()
    others = F.filter("near", lambda x: (x["vec_id"] != F.col("query_id")) | (x["found"] != F.col("query")))
    answers = asking.join(packed, "query").select("query_id", F.slice(others, 1, k).alias("near"))
    return answers.select("query_id", F.posexplode("near").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))

"""N-gram Jaccard join over size-banded tiles with hashed bitmap signatures (operator 5).

A document's set holds its distinct word shingles as 64-bit hashes; documents with equal sets are one node, and links with
intersection / union >= `threshold` join nodes. (1) Linked sets share a shingle among their first |A| - ceil(t |A|) + 1 in any
common order; hot shingles come last in it, so that a passage many documents share puts few of them together. (2) Documents that
share such a shingle, in runs of sizes that can link, are candidates. Runs of up to `SMALL` documents give pairs, weighed by
bitmaps of the sets. Larger runs give no pairs: each member names the run's first, and what such stars connect is a family. Tasks
form the stars of what they hold themselves and send only the ends of each size band on, so that a shingle of a third of all
documents is no group of that size. (3) A family is dealt to tiles by bands of size, of at most `TILE_BYTES` of shingles each. In a
tile, bitmaps bound the overlap from above, by the bits that both sides have, and the intersection of sorted arrays decides;
rows that are already connected are not compared, so a tile returns fewer links than it has rows. Each tile also gets some
members of its own and of the neighbouring bands. Where a family is then still in several components, all rows but those of its
largest component visit the other tiles of their own and of the neighbouring bands.

Defined results: texts null or without words have an empty set and link with nothing; a text with fewer words than a
shingle is one shingle; a null doc_id links with nothing and has a null component; several texts under one doc_id are one node with
the set of smallest digest; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, kernels
from tidemark.llm.components import components

WORDS = 5
PERCENT = 80
SMALL = 96
HOT_SHINGLES = 2_000_000
HOT_IN_WINDOW = 2
WINDOW_SHINGLES = 1 << 20
CHUNK_BYTES = 1 << 20
BUCKET_TEXT = 4 << 20
PACK_SHINGLES = 1 << 19
TILE_BYTES = 4 << 20
LEADERS = 4
_REPRESENTS = np.uint32(1 << 31)  # marks, beside a place, a row that stands for a run in its task
SIEVE_BITS = 1 << 27


def shingle_sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row."""
    data, offsets = kernels.utf8(column)
    data = kernels.LOWER[data]
    starts, ends, rows = kernels.word_spans(data, offsets)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(column)
    hashes = kernels.word_hashes(data, starts, ends)
    grams = kernels.gram_hashes(hashes, words)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        else:
            out.append(kernels.mix(kernels.gram_hashes(hashes[a:b], b - a) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def short(key: bytes) -> int:
    """The first 8 bytes of a digest, by which the prefixes name a set: rows with equal sets are one from the start."""
    return int.from_bytes(key[:8], "little", signed=True)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Hashed bitmap of a set; its width follows the size."""
    width = min(1 << 16, max(64, 1 << max(1, 2 * len(shingles) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(shingles & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap at a smaller width."""
    return bits if len(bits) == words else np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def enough(overlap, a, b, percent: int):
    """Whether 100 * overlap >= percent * union."""
    return (100 + percent) * overlap >= percent * (a + b)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _runs(h: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """Starts of the runs of one shingle whose sizes, in ascending order, can link from each to the next."""
    if not len(h):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (100 * size[:-1] < percent * size[1:])))


def _band(size: np.ndarray, percent: int) -> np.ndarray:
    return np.floor(np.log(np.maximum(size, 1)) / math.log(100 / percent)).astype(np.int64)


def _stars(doc: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distinct (first of the run, member) of the given rows."""
    first = doc[starts[np.searchsorted(starts, rows, "right") - 1]]
    pairs = np.stack([first, doc[rows]], 1)
    return np.unique(pairs[first != doc[rows]], axis=0)


def sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n, key (digest), short (its first bytes) and bits of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernels.release()
        for chunk in kernels.chunks(batches, limit=CHUNK_BYTES):
            found = shingle_sets(chunk.column("text"), words)
            keys = [digest(s) for s in found]
            yield pa.record_batch([chunk.column("doc_id"), pa.array([len(s) for s in found], pa.int64()), pa.array(keys, pa.binary()), pa.array([short(k) for k in keys], pa.int64()), pa.array([bitmap(s).tobytes() if len(s) else b"" for s in found], pa.binary())], ["doc_id", "n", "key", "short", "bits"])

    return common.doc_key(docs).mapInArrow(run, "doc_id long, n long, key binary, short long, bits binary")


def hot_shingles(docs: DataFrame, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of at most HOT_SHINGLES shingles that many documents share, by the counts of windows of WINDOW_SHINGLES where several
    do, and their places in the order from the rarest to the most frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernels.release()
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            many = n >= HOT_IN_WINDOW
            return pa.record_batch([pa.array(h[many].view(np.int64)), pa.array(n[many])], ["h", "n"])

        for chunk in kernels.chunks(batches, limit=CHUNK_BYTES):
            held.append(np.concatenate(shingle_sets(chunk.column("text"), words)))
            if sum(map(len, held)) >= WINDOW_SHINGLES:
                yield flush()
        if held:
            yield flush()

    counted = common.doc_key(docs).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    with common.small_batches(docs.sparkSession):
        top = counted.orderBy(F.desc("n"), "h").limit(HOT_SHINGLES).toArrow()
    h, n = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(h)
    place = np.empty(len(h), np.int32)
    place[np.lexsort((h, n))] = np.arange(len(h))
    return h[order], place[order]


def _prefixes(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], buckets: int, words: int, percent: int) -> DataFrame:
    """Packed (shingle, set, size, place) of the prefixes of all non-empty sets, by bucket; a set goes by the short form of its digest
    (in doc), so that copies count once within a pack, and again once where packs meet. Buckets below zero hold stars (in h and doc) of the large runs within a pack."""
    known = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernels.release()
        hot, hotness = known.value
        pack = zstandard.ZstdCompressor(level=1).compress
        held: dict[int, tuple[int, np.ndarray]] = {}
        waiting = 0

        def flush() -> pa.RecordBatch:
            rows = list(held.values())
            count = [len(r[1]) for r in rows]
            h = np.concatenate([r[1] for r in rows])
            doc, size = np.repeat(np.fromiter(held, np.int64, len(held)), count), np.repeat(np.array([r[0] for r in rows]), count)
            held.clear()
            del rows
            place = np.concatenate([np.arange(c) for c in count])
            # where this is the first shared shingle, no partner is larger than this; some partner must have the least size
            top = (100 + percent) * (size - place) // percent - size
            order = np.flatnonzero(100 * top >= percent * size)
            order = order[np.lexsort((doc[order], size[order], h[order]))]
            h, doc, size, place = h[order], doc[order], size[order], place[order].astype(np.uint32)
            starts = _runs(h, size, percent)
            large = np.repeat(np.diff(np.append(starts, len(h))) > SMALL, np.diff(np.append(starts, len(h))))
            stars = _stars(doc, starts, np.flatnonzero(large))
            band = _band(size, percent)
            edge = np.zeros(len(h) + 1, bool)  # first and last rows of each band of a run
            edge[starts] = edge[-1:] = True
            edge[1:-1] |= band[1:] != band[:-1]
            keep = ~large | edge[:-1] | edge[1:]
            place = np.where(large, place | _REPRESENTS, place)
            bucket = ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            order = np.flatnonzero(keep)[np.argsort(bucket[keep], kind="stable")]
            h, doc, size, place, bucket = h[order], doc[order], size[order], place[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            bounds = np.append(cuts, len(h)).tolist()
            spans = list(zip(bounds[:-1], bounds[1:], strict=True))
            cells = [[pack(x[a:b].tobytes()) for a, b in spans] for x in (h, doc.astype("<i8"), size.astype("<u4"), place.astype("<u4"))]
            numbers = bucket[cuts]
            for part in np.array_split(stars, 1 + len(stars) // 50_000) if len(stars) else ():
                numbers = np.append(numbers, -1 - int(part[0, 1]) % buckets)
                for cell, x in zip(cells, (part[:, 0], part[:, 1], part[:0, 0], part[:0, 0]), strict=True):
                    cell.append(pack(x.astype("<i8").tobytes()))
            return pa.record_batch([pa.array(numbers), *(pa.array(c, pa.binary()) for c in cells)], ["bucket", "h", "doc", "size", "place"])

        for chunk in kernels.chunks(batches, limit=CHUNK_BYTES):
            for doc, s in zip(chunk.column("doc_id").to_pylist(), shingle_sets(chunk.column("text"), words), strict=True):
                if doc is None or not len(s):
                    continue
                key = short(digest(s))
                if key in held:
                    continue
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    late = hot[at] == s
                    s = np.concatenate([s[~late], s[late][np.argsort(hotness[at[late]])]])
                first = s[: prefix_size(len(s), percent)].copy()  # a view would keep the whole set
                waiting += len(first)
                held[key] = (len(s), first)
            if waiting >= PACK_SHINGLES:
                yield flush()
                waiting = 0
        if held:
            yield flush()

    return common.doc_key(docs).mapInArrow(run, "bucket long, h binary, doc binary, size binary, place binary")


def _meet(prefixes: DataFrame, percent: int) -> DataFrame:
    """(pair, x, y): the candidate pairs of sets x < y of small runs, each once in a bucket; with pair false, x is the first of a large run and y its member."""

    def meet(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        read = lambda c, t: np.concatenate([np.frombuffer(unpack(x), t) for x in table[c].to_pylist()])
        pairs = np.zeros((0, 2), np.int64)
        if table["bucket"][0].as_py() < 0:
            stars = np.unique(np.stack([read("h", "<i8"), read("doc", "<i8")], 1), axis=0)
        else:
            h, doc, size, place = read("h", "u8"), read("doc", "<i8"), read("size", "<u4").astype(np.int64), read("place", "<u4")
            order = np.lexsort((~place, doc, size, h))  # of a set's copies from several packs the first stays, and it is marked if any is
            order = order[np.append(True, (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1]))]
            h, doc, size, place = h[order], doc[order], size[order], place[order]
            left = size - (place & ~_REPRESENTS).astype(np.int64)  # what can still be shared from this shingle on
            starts = _runs(h, size, percent)
            count = np.diff(np.append(starts, len(h)))
            large = np.repeat((count > SMALL) | (np.maximum.reduceat(place, starts) >= _REPRESENTS), count)
            stars = _stars(doc, starts, np.flatnonzero(large))
            small = np.flatnonzero(~large)
            run = np.repeat(np.arange(len(starts)), count)[small]
            doc, size, left = doc[small], size[small], left[small]
            found = [pairs]
            for step in range(1, SMALL):  # pairs at each distance within the small runs, vectorised over all of them
                a = np.flatnonzero(run[:-step] == run[step:]) if len(run) > step else np.zeros(0, np.int64)
                if not len(a):
                    break
                b = a + step
                fits = (100 * size[a] >= percent * size[b]) & enough(np.minimum(left[a], left[b]), size[a], size[b], percent) & (doc[a] != doc[b])
                a, b = a[fits], b[fits]
                found.append(np.stack([np.minimum(doc[a], doc[b]), np.maximum(doc[a], doc[b])], 1))
            pairs = np.unique(np.concatenate(found), axis=0)
        both = np.concatenate([pairs, stars])
        return pa.table([pa.array(np.arange(len(both)) < len(pairs)), pa.array(both[:, 0]), pa.array(both[:, 1])], ["pair", "x", "y"])

    return prefixes.groupBy("bucket").applyInArrow(meet, "pair boolean, x long, y long")


def _bound(a: bytes, na: int, b: bytes, nb: int) -> int:
    """The largest overlap that the bitmaps leave."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    words = min(len(x), len(y))
    x, y = fold(x, words), fold(y, words)
    return min(na - int(np.bitwise_count(x & ~y).sum()), nb - int(np.bitwise_count(y & ~x).sum()))


def _weigh(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose bitmaps leave room for enough overlap."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"b{c}"))
    joined = pairs.join(side("x"), "x").join(side("y"), "y").where(f"100 * least(nx, ny) >= {percent} * greatest(nx, ny)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [enough(_bound(bx, nx, by, ny), nx, ny, percent) for nx, bx, ny, by in zip(*(batch.column(c).to_pylist() for c in ("nx", "bx", "ny", "by")), strict=True)]
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("x", "y", "nx", "bx", "ny", "by").mapInArrow(run, "x long, y long")


def _verify(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the pairs that are links, by exact intersection."""
    side = lambda c: arrays.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, keep = batch.slice(at, 500), []
                for a, b in zip(part.column("sx").to_pylist(), part.column("sy").to_pylist(), strict=True):
                    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                    keep.append(enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent))
                yield pa.record_batch([part.column("x"), part.column("y")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "sx", "sy").mapInArrow(run, "u long, v long")


def _sieve(ids: DataFrame) -> np.ndarray:
    """SIEVE_BITS bits, those set that the listed ids hash to; the words that are not zero come to the driver."""
    place = F.pmod(F.xxhash64("node"), F.lit(SIEVE_BITS))
    words = ids.select(place.alias("at")).selectExpr("shiftright(at, 6) AS w", "shiftleft(1L, CAST(at & 63 AS INT)) AS b")
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(SIEVE_BITS >> 6, np.int64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return out.view(np.uint64)


def _arrays(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """node and shingles (sorted hashes) of the documents whose id is listed and whose digest is the node's. The texts stay
    where they are read: a sieve of bounded size lets through what is listed (and some more, which the join removes)."""
    sieve = docs.sparkSession.sparkContext.broadcast(_sieve(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernels.release()
        bits = sieve.value
        for batch in batches:
            at = batch.column("at").to_numpy().astype(np.uint64)
            listed = batch.filter(pa.array((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0))
            for chunk in kernels.chunks(iter([listed]), limit=CHUNK_BYTES):
                found = shingle_sets(chunk.column("text"), words)
                yield pa.record_batch([chunk.column("doc_id"), pa.array([digest(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "own", "shingles"])

    rows = common.doc_key(docs).where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE_BITS)).alias("at"))
    found = rows.mapInArrow(run, "node long, own binary, shingles binary")
    return found.join(ids, "node").where("own = key").select("node", "shingles").dropDuplicates(["node"])


def forest(sets_: list[np.ndarray], label: np.ndarray, guest: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links that join rows of different labels, enough of them to connect all that links connect. With `guest`, only pairs of a
    guest and another row are compared."""
    size = np.array([len(s) for s in sets_], np.int64)
    order = np.argsort(size, kind="stable")
    size, label = size[order], label[order].copy()
    guest = None if guest is None else guest[order]
    width = max(64, 1 << int(8 * size.mean() - 1).bit_length())
    mark = np.zeros((len(size), width), np.uint8)
    for row, k in enumerate(order.tolist()):
        mark[row, (sets_[k] & np.uint64(width - 1)).astype(np.int64)] = 1
    bits = np.packbits(mark, axis=1, bitorder="little").view(np.uint64)
    del mark
    count = np.bitwise_count(bits).sum(1, dtype=np.int64)
    from_, upto = np.searchsorted(100 * size, percent * size), np.searchsorted(percent * size, 100 * size, "right")
    links = []
    for i in range(len(size)) if guest is None else np.flatnonzero(guest).tolist():
        low, high = (i + 1 if guest is None else from_[i]), upto[i]
        k = low + np.flatnonzero(label[low:high] != label[i] if guest is None else (label[low:high] != label[i]) & ~guest[low:high])
        if not len(k):
            continue
        both = np.bitwise_count(bits[i] & bits[k]).sum(1, dtype=np.int64)
        room = np.minimum(size[i] - count[i], size[k] - count[k]) + both
        hit = np.flatnonzero(enough(room, size[i], size[k], percent))
        for j in k[hit[np.argsort(-room[hit], kind="stable")]].tolist():
            if label[j] != label[i] and enough(len(np.intersect1d(sets_[order[i]], sets_[order[j]], assume_unique=True)), size[i], size[j], percent):
                links.append((int(order[i]), int(order[j])))
                label[label == label[j]] = label[i]
    return links


def _edges(node: np.ndarray, links: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array(node[[i for i, _ in links]], pa.int64()), pa.array(node[[j for _, j in links]], pa.int64())], ["u", "v"])


def _placed(families: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """family, band, block, node: the tile of each member. A family that fits one tile has band -1."""
    rows = families.join(nodes.select("node", "n"), "node").withColumn("band", F.floor(F.log("n") / F.lit(math.log(100 / percent))).cast("long"))
    sizes = rows.groupBy("family", "band").agg((8 * F.sum("n")).alias("bytes"))
    whole = sizes.groupBy("family").agg((F.sum("bytes") <= TILE_BYTES).alias("whole"))
    sizes = sizes.join(whole, "family").select("family", "band", "whole", F.ceil(F.col("bytes") / TILE_BYTES).alias("blocks"))
    block = F.when(F.col("whole"), F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), F.col("blocks")))
    return rows.join(sizes, ["family", "band"]).select("family", F.when(F.col("whole"), F.lit(-1)).otherwise(F.col("band")).cast("long").alias("band"), block.cast("long").alias("block"), "node")


def _within(placed: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """(u, v): links within the tiles, and with LEADERS members of each band that the tiles of the bands around it share."""
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band")
    tiles = placed.where("band >= 0").select("family", "band", "block").distinct()
    leaders = placed.where("band >= 0").groupBy("family", "band", F.pmod(F.xxhash64("node", F.lit("leader")), F.lit(LEADERS)).alias("slot")).agg(F.min("node").alias("node"))
    visits = leaders.select("family", near, "node").join(tiles, ["family", "band"]).select("family", "band", "block", "node")
    rows = placed.select("family", "band", "block", "node").union(visits).distinct().join(arrays, "node")

    def run(table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        return _edges(node, forest([np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()], np.arange(len(node)), None, percent))

    return rows.groupBy("family", "band", "block").applyInArrow(run, "u long, v long")


def _across(placed: DataFrame, found: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """(u, v): links between tiles of a family, where it is in several components. The rows outside its largest component visit."""
    rows = placed.where("band >= 0").join(found, "node", "left").select("family", "band", "block", "node", F.coalesce("component", "node").alias("component"))
    parts = rows.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("family", "largest")
    rows = rows.join(largest, "family")
    tiles = rows.select("family", "band", "block").distinct()
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band")
    guests = rows.where("component <> largest").select("family", near, F.col("block").alias("home"), F.col("band").alias("home_band"), "node", "component").join(tiles, ["family", "band"])
    guests = guests.where("band <> home_band or block <> home").join(arrays, "node")
    guests = guests.select(F.col("family").alias("family_"), F.col("band").alias("band_"), F.col("block").alias("block_"), F.col("node").alias("node_"), F.col("component").alias("component_"), F.col("shingles").alias("shingles_"))
    hosts = rows.select("family", "band", "block", "node", "component").join(arrays, "node")

    def run(there: pa.Table, visiting: pa.Table) -> pa.Table:
        if not there.num_rows or not visiting.num_rows:
            return _edges(np.zeros(0, np.int64), [])
        node, label = (np.append(there[c].to_numpy(), visiting[f"{c}_"].to_numpy()) for c in ("node", "component"))
        held = [np.frombuffer(x, np.uint64) for t, c in ((there, "shingles"), (visiting, "shingles_")) for x in t[c].to_pylist()]
        return _edges(node, forest(held, label, np.arange(len(node)) >= there.num_rows, percent))

    return hosts.groupBy("family", "band", "block").cogroup(guests.groupBy("family_", "band_", "block_")).applyInArrow(run, "u long, v long")


def link(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row."""
    rows = common.streamed(sets(docs, words), "sets")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / BUCKET_TEXT))
    chosen = common.materialise(rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("key"), F.min_by("short", "key").alias("short")), "keys")
    heads = common.materialise(chosen.groupBy("key").agg(F.min("doc_id").alias("node"), F.first("short").alias("short")), "heads")
    classes = common.materialise(chosen.join(heads.select("key", "node"), "key").select("doc_id", "node"), "classes")
    nodes = rows.join(heads.withColumnRenamed("key", "own"), (F.col("doc_id") == F.col("node")) & (F.col("key") == F.col("own"))).select("node", "key", "n", "bits").dropDuplicates(["node"])
    nodes = common.materialise(nodes, "nodes")
    common.forget(docs.sparkSession)
    # a set that is not its document's own stands for that document's node
    others = rows.where("n > 0").join(chosen.select("doc_id", F.col("key").alias("own")), "doc_id").where("key <> own").select("doc_id", "key", "short")
    others = others.join(heads.select("key"), "key", "left_anti").join(classes, "doc_id").groupBy("key", "short").agg(F.min("node").alias("node"))
    alias = common.materialise(heads.select("short", "node").union(others.select("short", "node")), "alias")
    met = common.streamed(_meet(_prefixes(docs, hot_shingles(docs, words), buckets, words, percent), percent).distinct(), "met")
    common.forget(docs.sparkSession)
    of = lambda c: alias.select(F.col("short").alias(c), F.col("node").alias(f"node_{c}"))
    met = met.join(of("x"), "x").join(of("y"), "y").where("node_x <> node_y")
    met = common.materialise(met.select("pair", F.least("node_x", "node_y").alias("x"), F.greatest("node_x", "node_y").alias("y")).distinct(), "candidates")
    likely = common.streamed(_weigh(met.where("pair").select("x", "y"), nodes, percent), "likely")
    common.forget(docs.sparkSession)
    stars = met.where("not pair").select(F.col("y").alias("u"), F.col("x").alias("v"))
    families = components(stars).select("node", F.col("component").alias("family"))
    families = common.materialise(families.union(families.select("family", "family").distinct()), "families")
    ids = likely.select(F.col("x").alias("node")).union(likely.select("y")).union(families.select("node")).distinct()
    arrays = common.streamed(_arrays(docs, ids.join(nodes.select("node", "key"), "node"), words), "arrays")
    common.forget(docs.sparkSession)
    # each document of a pair is first compared with its smallest partner only; pairs inside what this connects need no comparison
    first = likely.groupBy("y").agg(F.min("x").alias("x")).select("x", "y")
    placed = common.materialise(_placed(families, nodes, percent), "placed")
    found = components(common.streamed(_verify(first, arrays, percent).union(_within(placed, arrays, percent)), "links"))
    found = common.materialise(found, "found")
    common.forget(docs.sparkSession)
    label = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    named = lambda pairs, x, y: pairs.join(label(x), x, "left").join(label(y), y, "left").select(x, y, F.coalesce(f"c{x}", x).alias("cx"), F.coalesce(f"c{y}", y).alias("cy")).where("cx <> cy")
    rest = named(likely.join(first, ["x", "y"], "left_anti"), "x", "y").select("x", "y")
    more = common.streamed(_verify(rest, arrays, percent).union(_across(placed, found, arrays, percent)), "links")
    joined = components(named(more, "u", "v").select(F.col("cx").alias("u"), F.col("cy").alias("v")))
    labels = classes.join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("first"))
    labels = labels.join(joined.select(F.col("node").alias("first"), "component"), "first", "left").select("doc_id", F.coalesce("component", "first").alias("component_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(labels, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents but one (the smallest doc_id) of each component left out; rows with a null doc_id stay, and of rows
    that repeat a doc_id all stay or go."""
    gone = link(docs, words, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("gone_id"), "left_anti")

"""Language-model scores from a log-frequency Bloom filter (operator 9).

Documents are dealt to blocks by a hash of their id. Each block sends its distinct words and bigrams (with their training counts, zero
for those that only held-out texts have) to buckets by hash. A bucket sums the counts and builds its own segment of the filter: an
n-gram with count c is stored under the levels 1 .. 1 + floor(log_BASE c), so that probing level after level until the first miss
gives the quantised count. It answers each block with the exact counts of its words and with the levels that its segment gives
the block's words and bigrams. A segment takes FILTER_BITS_PER_LEVEL for each level it stores, so that the filter grows with the input
and the rate of false positives is the same at every size; no task and no driver holds more of it than one segment.

The model interpolates: p(w | v) = (1 - WEIGHT) p(w) + WEIGHT c(v w) / c(v), with p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)) and
all c from the filter. base_score takes p(w) from the exact counts.

Defined results: a null or empty text is the end token alone; a null doc_id counts as training; repeated rows each get their
row and count each; an empty table gives no rows; without training texts every c, N and V is 0; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, kernels

BASE = 1.5
WEIGHT = 0.3
PROBES = 4
BLOCK_TEXT = 16 << 20
FILTER_BITS_PER_LEVEL = 9
BUCKET_TEXT = 4 << 20
HELD_OUT = 10
_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_PAIR = np.uint64(0xDA942042E4DD58B5)
_LEVEL = np.uint64(0x9E3779B97F4A7C15)
_SENT = ["h", "c", "pairs", "pair_c"]
_ANSWER = ["c", "level", "pair_level"]


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (each row's words, then the end) and the n + 1 bounds of the rows."""
    data = kernels.LOWER[data]
    starts, ends, rows = kernels.word_spans(data, offsets)
    words = kernels.word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    bounds = rows + np.arange(len(rows))
    out = np.full(len(words) + len(rows) - 1, _END)
    keep = np.ones(len(out), bool)
    keep[bounds[1:] - 1] = False
    out[keep] = words
    return out, bounds


def bigrams(tokens_: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each token with its predecessor, and the predecessors."""
    before = np.append(_START, tokens_[:-1])
    before[bounds[:-1]] = _START
    return kernels.mix(before * _PAIR + tokens_), before


def counted(h: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order and their counts (or sums of weights)."""
    if weights is None:
        return np.unique(h, return_counts=True)
    order = np.argsort(h, kind="stable")
    h = h[order]
    new = np.flatnonzero(np.diff(h, prepend=~h[:1])) if len(h) else np.zeros(0, np.int64)
    return h[new], np.add.reduceat(weights[order], new) if len(new) else np.zeros(0, np.int64)


def levels(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(count, 1)) / math.log(BASE) + 1e-9).astype(np.int64)


def level_count(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of the counts it holds."""
    low = np.ceil(BASE ** (level - 1.0) - 1e-9)
    high = np.ceil(BASE ** (level + 0.0) - 1e-9) - 1
    return np.where(level > 0, (low + np.maximum(low, high)) / 2, 0.0)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _seeds(h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and step of the PROBES bit places of a key at a level."""
    x = kernels.mix(h + _LEVEL * np.array([level], np.uint64))
    return x, kernels.mix(x) | np.uint64(1)


def segment(h: np.ndarray, count: np.ndarray, bits: int) -> np.ndarray:
    """The bits of all levels of the keys, as bytes."""
    out, level, top = np.zeros(bits, bool), 1, levels(count)
    while len(h):
        x, step = _seeds(h, level)
        for k in range(PROBES):
            out[((x + step * np.uint64(k)) % np.uint64(bits)).astype(np.int64)] = True
        level += 1
        keep = top >= level
        h, top = h[keep], top[keep]
    return np.packbits(out, bitorder="little")


def probe(filter_: np.ndarray, h: np.ndarray, top: int) -> np.ndarray:
    """The level of each key, 0 where it is not held, `top` (the highest level stored) at most; the filter is a (buckets, bytes)
    table of segments."""
    buckets, size = filter_.shape
    out, live, level = np.zeros(len(h), np.int64), np.arange(len(h)), 1
    flat, base = filter_.reshape(-1), bucket_of(h, buckets) * size
    while len(live) and level <= top:
        x, step = _seeds(h[live], level)
        for k in range(PROBES):
            at = ((x + step * np.uint64(k)) % np.uint64(8 * size)).astype(np.int64)
            hit = (flat[base[live] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 > 0
            live, x, step = live[hit], x[hit], step[hit]
        out[live] = level
        level += 1
    return out


def _squeeze(h: np.ndarray, pack) -> bytes:
    """Sorted hashes as byte planes of their differences."""
    return pack(np.ascontiguousarray(np.diff(h, prepend=np.zeros(1, np.uint64)).view(np.uint8).reshape(-1, 8).T).tobytes())


def _widen(cell: bytes, unpack) -> np.ndarray:
    planes = np.frombuffer(unpack(cell), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _cut(h: np.ndarray, buckets: int) -> np.ndarray:
    """The buckets + 1 bounds of sorted hashes by bucket."""
    return np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1))


def _table(rows: list[tuple], cells: list[str], sums: list[str]) -> pa.Table:
    names = ["block", "bucket", *cells, *sums]
    return pa.table([pa.array([r[k] for r in rows], pa.binary() if x in cells else pa.int64()) for k, x in enumerate(names)], names)


def _schema(cells: list[str], sums: list[str]) -> str:
    return ", ".join(["block long", "bucket long", *(f"{x} binary" for x in cells), *(f"{x} long" for x in sums)])


def _blocked(docs: DataFrame, blocks: int) -> DataFrame:
    """doc_id, held_out, text and block; the block does not depend on how the table is stored."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(HELD_OUT)) == 0, F.lit(False))
    return common.doc_key(docs).select("doc_id", held.alias("held_out"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"))


def segment_bits(count: np.ndarray) -> int:
    """The size of a segment that is to hold keys with these counts."""
    return 8 * max(8, math.ceil(FILTER_BITS_PER_LEVEL * int(levels(count).sum()) / 8))


def _gathered(docs: DataFrame, blocks: int, buckets: int) -> DataFrame:
    """Answers (block, bucket, c: the exact counts of the block's words of the bucket, their levels and those of its bigrams, all in the
    order of the hashes); v and n of each bucket stand in one of its rows."""

    def send(table: pa.Table) -> pa.Table:
        pack = zstandard.ZstdCompressor(level=1).compress
        single, double = [], []
        for chunk in kernels.chunks(iter(table.combine_chunks().to_batches())):
            t, bounds = tokens(*kernels.utf8(chunk.column("text")))
            train = np.repeat(~chunk.column("held_out").to_numpy(zero_copy_only=False), np.diff(bounds)).astype(np.int64)
            single.append(counted(t, train))
            double.append(counted(bigrams(t, bounds)[0], train))
        block, cells = table["block"][0].as_py(), []
        for parts in (single, double):
            h, c = counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            parts.clear()
            cuts = _cut(h, buckets).tolist()
            cells.append([(_squeeze(h[a:b], pack), pack(c[a:b].astype("<u4").tobytes())) if a < b else (None, None) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        return _table([(block, k, *one, *two) for k, (one, two) in enumerate(zip(*cells, strict=True)) if one[0] or two[0]], _SENT, [])

    def meet(table: pa.Table) -> pa.Table:
        pack, unpack = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
        none = np.zeros(0, np.uint64)
        hs, keys, counts = [], [], []
        for h, c in (("h", "c"), ("pairs", "pair_c")):
            hs.append([none if x is None else _widen(x, unpack) for x in table[h].to_pylist()])
            cs = [none.view(np.int64) if x is None else np.frombuffer(unpack(x), "<u4").astype(np.int64) for x in table[c].to_pylist()]
            key, count = counted(np.concatenate(hs[-1]), np.concatenate(cs))
            keys.append(key)
            counts.append(count)
        known = [c > 0 for c in counts]
        held, stored = (np.concatenate([x[k] for x, k in zip(xs, known, strict=True)]) for xs in (keys, counts))
        filter_ = segment(held, stored, segment_bits(stored))[None, :]
        top = int(levels(stored).max(initial=0))
        level = [probe(filter_, key, top).astype(np.uint8) for key in keys]
        rows, sums = [], (int(known[0].sum()), int(counts[0].sum()))
        for block, bucket, words, pairs in zip(table["block"].to_pylist(), table["bucket"].to_pylist(), *hs, strict=True):
            at, pair_at = np.searchsorted(keys[0], words), np.searchsorted(keys[1], pairs)
            rows.append((block, bucket, pack(counts[0][at].astype("<i8").tobytes()), pack(level[0][at].tobytes()), pack(level[1][pair_at].tobytes()), *(sums if not rows else (None, None))))
        return _table(rows, _ANSWER, ["v", "n"])

    return _blocked(docs, blocks).groupBy("block").applyInArrow(send, _schema(_SENT, [])).groupBy("bucket").applyInArrow(meet, _schema(_ANSWER, ["v", "n"]))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_TEXT))
    buckets = max(1, min(4096, math.ceil(size / BUCKET_TEXT)))
    met = common.materialise(_gathered(docs, blocks, buckets), "counts")
    sums = met.agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    known, total = sums["v"] or 0, sums["n"] or 0
    floor = total + 0.1 * (known + 1)

    def judge(there: pa.Table, answered: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        # the answers of the buckets, one after another, are in the order of the block's sorted hashes
        order = np.argsort(answered["bucket"].to_numpy())
        count, guess, pair_guess = (np.frombuffer(b"".join(unpack(cells[k]) for k in order), kind) for cells, kind in ((answered[x].to_pylist(), k) for x, k in zip(_ANSWER, ("<i8", "u1", "u1"), strict=True)))
        guess = level_count(guess.astype(np.int64))
        chunks, words, pairs = [], [], []
        for chunk in kernels.chunks(iter(there.combine_chunks().to_batches())):
            t, bounds = tokens(*kernels.utf8(chunk.column("text")))
            chunks.append((chunk.select(["doc_id", "held_out"]), t, bounds))
            words.append(np.unique(t))
            pairs.append(np.unique(bigrams(t, bounds)[0]))
        words, pairs = (np.unique(np.concatenate(x)) if x else np.zeros(0, np.uint64) for x in (words, pairs))
        out = []
        for chunk, t, bounds in chunks:
            pair, before = bigrams(t, bounds)
            pair_count = level_count(pair_guess[np.searchsorted(pairs, pair)].astype(np.int64))
            at = np.searchsorted(words, t)
            c, own = count[at], guess[at]
            # texts begin as often as they end
            context = guess[np.searchsorted(words, np.where(before == _START, _END, before))]
            single = (own + 0.1) / max(floor, 0.1)
            double = np.minimum(pair_count, context) / np.maximum(context, 1.0)
            model = np.log10((1 - WEIGHT) * single + WEIGHT * double)
            base = np.log10((c + 0.1) / max(floor, 0.1))
            ends = bounds[:-1]
            sums = [np.add.reduceat(x, ends) for x in ((c > 0).astype(np.int64), base, model)]
            out.append(pa.record_batch([chunk.column("doc_id"), chunk.column("held_out"), pa.array(np.diff(bounds)), pa.array(sums[0]), pa.array(np.full(len(ends), total)), pa.array(sums[1]), pa.array(sums[2])], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        return pa.Table.from_batches(out, schema)

    rows = _blocked(docs, blocks)
    answers = met.select(F.col("block").alias("to"), "bucket", *_ANSWER)
    judged = rows.groupBy("block").cogroup(answers.groupBy("to")).applyInArrow(judge, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return judged

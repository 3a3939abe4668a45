"""Removal of byte strings that also start in a document with a smaller id, over suffix arrays (operator 4).

Every window of `WINDOW` bytes belongs to an anchor, the smallest hash among its GRAM-byte strings (the last of equals), so
equal windows have equal anchors. (1) Anchors met in one document only can hold no repeated window; the others are found by
hash buckets, to which each task sends a string it has itself seen in several documents just once. (2) For those
anchors, the bytes of all their windows (a context) go to buckets by anchor, once per task and distinct context, with the
smallest document; larger documents with the same context, byte for byte, lose it at once. (3) Each bucket builds a suffix array of its distinct
contexts in two stages: of the suffixes that begin a window, only those smaller than their successors are sorted directly, the rest is
induced by scans over the buckets of first bytes. Adjacent common prefixes of WINDOW bytes or more make runs, and a window goes
where its run holds a smaller document. (4) The spans come back to the documents.

Defined results: a null text is empty; a null doc_id counts as larger than every other; rows with equal doc_id never remove from
each other; texts shorter than a window are untouched; an empty table gives no rows; other columns are ignored (`clean` keeps
them). Cut texts whose edges split a character drop the split bytes in `clean` only, where a string is asked for.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import bpe, common, kernels

WINDOW = 50
GRAM = 16
BUCKET_TEXT = 1 << 20
BUCKET_ANCHOR_TEXT = 16 << 20
PACK_TEXT = 48 << 20
PACK_ANCHORS = 1 << 20
_LAST = (1 << 63) - 1
_LOW = np.uint64(0xFFFFFFFF)
_SHORT = np.uint64(0xFFFFFFFFFFFF)  # what is sent of an anchor's hash; more anchors may only become candidates


def anchors(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Position, hash, first and last window start, and row of every anchor, in order of position."""
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return none, none.astype(np.uint64), none, none, none
    at = np.arange(len(data) - gram + 1)
    hashes = kernels.span_hash(kernels.prefix_hash(data), at, at + gram)
    key = (hashes & ~_LOW) | (_LOW - at.astype(np.uint64))  # the last of equal hashes is the smallest
    reach, width, n = window - gram + 1, 1, len(data) - window + 1
    least = key
    while 2 * width <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[reach - width : reach - width + n])
    size = np.diff(offsets)
    starts = np.repeat(np.arange(len(size)), np.maximum(size - window + 1, 0))  # the row of each window
    if not len(starts):
        return none, none.astype(np.uint64), none, none, none
    count = np.maximum(size - window + 1, 0)
    windows = np.arange(len(starts)) - np.repeat(np.cumsum(count) - count, count) + offsets[starts]
    chosen = (_LOW - (least[windows] & _LOW)).astype(np.int64)
    first = np.flatnonzero(np.diff(chosen, prepend=-1))
    last = np.append(first[1:], len(chosen)) - 1
    pos = chosen[first]
    return pos, hashes[pos], windows[first], windows[last], starts[first]


def _eights(data: np.ndarray, more: int, order: str) -> np.ndarray:
    """The eight bytes from each place on as one number, as a view; `more` zeros follow the data."""
    padded = np.concatenate([data, np.zeros(more + 8, np.uint8)])
    return np.ndarray((len(data) + more,), f"{order}u8", padded, strides=(1,))


def _sorted_by_words(words: np.ndarray, mask: np.ndarray, at: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes by eight bytes at a time; each step only takes those that are still equal to a neighbour."""
    order = np.argsort(words[at].astype(np.uint64) & mask[np.minimum(left, 8)], kind="stable")
    live = np.arange(len(at))  # places in the order that are not settled
    rank = np.zeros(len(at), np.int64)  # start of each place's run of equals
    for j in range(0, depth, 8):
        here = order[live]
        key = words[at[here] + j].astype(np.uint64) & mask[np.clip(left[here] - j, 0, 8)]
        if j:
            inner = np.lexsort((key, rank[live]))
            here, key = here[inner], key[inner]
            order[live] = here
        run = rank[live]
        new = np.append(True, (run[1:] != run[:-1]) | (key[1:] != key[:-1]))
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(live)))
        rank[live] = np.repeat(live[starts], size)
        live = live[np.repeat(size > 1, size)]
        if not len(live):
            return order
    # equal bytes: the shorter suffix comes first
    order[live] = order[live][np.lexsort((left[order[live]], rank[live]))]
    return order


def suffix_array(text: np.ndarray, ends: np.ndarray, depth: int, least: int = 1) -> np.ndarray:
    """Positions of the suffixes of at least `least` bytes, ordered by their first `depth` bytes at least; a suffix ends where
    its string does.

    `ends` holds the (exclusive) end of each string; the strings fill the text. Stage one sorts the suffixes that are smaller than
    their successors; stage two runs through the buckets of first bytes in order and puts the predecessors that are larger than
    their successors behind what their own bucket has so far. Shorter suffixes take part only where a wanted one is induced from
    them: those up to the next suffix that is sorted directly.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    # string ends become symbol 0 of a longer text; bytes become 1..256
    joined = np.zeros(n + len(ends), np.int16)
    place = np.arange(n) + np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    joined[place] = text.astype(np.int16) + 1
    m = len(joined)
    following = np.append(joined[1:], np.int16(0))
    stop = np.flatnonzero(joined != following)  # ends of runs of one symbol
    run_end = np.append(np.repeat(stop, np.diff(stop, prepend=-1)), np.full(m - 1 - stop[-1], stop[-1]))
    smaller = joined[run_end] < following[run_end]
    smaller[joined == 0] = True
    end_at = np.flatnonzero(joined == 0)
    left = np.repeat(end_at, np.diff(end_at, prepend=-1)) - np.arange(m)
    wanted = left >= least
    # what a wanted suffix is induced from ends with the next one that is sorted directly (or with the string's end)
    direct = np.flatnonzero(smaller)
    source = direct[np.searchsorted(direct, np.flatnonzero(wanted))]
    taking = np.cumsum(wanted - np.bincount(source + 1, minlength=m + 1)[:m]) > 0
    direct = direct[taking[direct] & (joined[direct] > 0)]
    words = _eights(np.maximum(joined - 1, 0).astype(np.uint8), depth + 8, ">")
    mask = np.array([0xFFFFFFFFFFFFFFFF << 8 * (8 - k) & 0xFFFFFFFFFFFFFFFF for k in range(9)], np.uint64)
    if len(direct):
        direct = direct[_sorted_by_words(words, mask, direct, np.minimum(left[direct], depth), depth)]
    head = joined[direct]
    induced = taking & ~smaller
    parts: list[list[np.ndarray]] = [[] for _ in range(257)]

    def induce(here: np.ndarray, symbol: int) -> np.ndarray:
        """Put away the larger predecessors of these suffixes; those of the same bucket are returned."""
        before = here[here > 0] - 1
        before = before[induced[before]]
        symbols = joined[before]
        same = before[symbols == symbol]
        rest = symbols != symbol
        before, symbols = before[rest], symbols[rest]
        if len(before):
            order = np.argsort(symbols, kind="stable")
            before, symbols = before[order], symbols[order]
            cuts = np.flatnonzero(np.diff(symbols, prepend=np.int16(-1)))
            for piece, s in zip(np.split(before, cuts[1:]), symbols[cuts].tolist(), strict=True):
                parts[s].append(piece)
        return same

    out = [np.zeros(0, np.int64)]
    induce(end_at, 0)
    for symbol in range(1, 257):
        front = np.concatenate(parts[symbol]) if parts[symbol] else np.zeros(0, np.int64)
        while len(front):
            out.append(front)
            front = induce(front, symbol)
        sorted_ones = direct[np.searchsorted(head, symbol) : np.searchsorted(head, symbol, "right")]
        if len(sorted_ones):
            out.append(sorted_ones)
            induce(sorted_ones, symbol)
    found = np.concatenate(out)
    found = found[wanted[found]]
    return found - np.repeat(np.arange(len(end_at)), np.diff(end_at, prepend=-1))[found]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix with its predecessor in the order, at most `depth`; all must have depth bytes."""
    out = np.zeros(len(order), np.int64)
    words = _eights(text, depth + 8, "<")
    live = np.arange(1, len(order))
    for j in range(0, depth, 8):
        differ = words[order[live] + j] ^ words[order[live - 1] + j]
        lowest = differ & (~differ + np.uint64(1))  # the lowest bit is in the first byte that differs
        same = np.where(differ == 0, 8, (np.bitwise_count(lowest - np.uint64(1)) >> 3).astype(np.int64))
        out[live] += same
        live = live[differ == 0]
        if not len(live):
            break
    return np.minimum(out, depth)


def repeated_windows(text: np.ndarray, ends: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows that also start in a string with a smaller owner."""
    order = suffix_array(text, ends, window, window)
    string = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    if not len(order):
        return order
    runs = np.flatnonzero(common_prefixes(text, order, window) < window)
    owners = owner[string[order]]
    least = np.repeat(np.minimum.reduceat(owners, runs), np.diff(np.append(runs, len(order))))
    return np.sort(order[owners > least])


def _union(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of (k, 2) spans, overlapping or touching ones merged."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    top = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > top[:-1])
    return np.stack([spans[new, 0], top[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]], 1)


def _keyed(docs: DataFrame, rest: Column | None = None) -> DataFrame:
    """Internal key columns (d, v) beside doc_id, text and what is to go along: d orders documents, v tells texts under one id apart."""
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    return docs.select(d.alias("d"), _version("text").alias("v"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *([] if rest is None else [rest]))


def _version(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(1 << 16)).cast("int")


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys in sorted columns."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))


def _spread(starts: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(values, np.diff(np.append(starts, n)))


def _several(starts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Whether a row's group holds different documents."""
    return _spread(starts, np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts), len(d)) if len(d) else np.zeros(0, bool)


def _pack(values: np.ndarray, dtype: str, differences: bool = False) -> bytes:
    """Compressed byte planes of a column."""
    if differences:
        values = np.diff(values, prepend=values[:1] * 0)
    planes = np.ascontiguousarray(values.astype(dtype).view(np.uint8).reshape(len(values), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(cell: bytes, dtype: str, differences: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(cell), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    values = np.ascontiguousarray(planes.T).view(dtype).ravel()
    return np.cumsum(values) if differences else values


_SENT = "bucket long, a binary, b binary, c binary, e binary, f binary, g binary"
_COLUMNS = [x.split(" ")[0] for x in _SENT.split(", ")]


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] + [pa.binary()] * 6
    return pa.record_batch([pa.array([r[k] if k < len(r) else None for r in rows], kind) for k, kind in enumerate(kinds)], _COLUMNS)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)


def _positions(d: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """(d, at): one row per document with the positions of its repeated anchors."""
    order = np.lexsort((pos, d))
    d, pos = d[order], pos[order]
    new = _groups(d)
    cells = [v.astype("<u4").tobytes() for v in np.split(pos, new[1:])] if len(d) else []
    return pa.record_batch([pa.array(d[new]), pa.array(cells, pa.binary())], ["d", "at"])


def _hits(rows: DataFrame, buckets: int, window: int, gram: int) -> DataFrame:
    """(d, at): positions (u4) of the anchors whose string occurs in several documents. Texts under one id share their rows here,
    which only makes more candidates."""
    shards = 4 * buckets

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, d, pos = (np.concatenate([x[k] for x in held]) for k in range(3))
            held.clear()
            order = np.argsort(h, kind="stable")
            h, d, pos = h[order], d[order], pos[order]
            new = _groups(h)
            several = _several(new, d)
            done = _positions(d[several], pos[several])
            # settled rows are dealt by their document, so that they form no group of their own
            yield _sent([(-1 - i % buckets, None, at, None, None, None, i.to_bytes(8, "little", signed=True)) for i, at in zip(done.column("d").to_pylist(), done.column("at").to_pylist(), strict=True)])
            keep = ~several
            keep[new] = True
            # and one of another document, so that the bucket sees two whatever the other tasks send
            other = np.flatnonzero(several & (d != _spread(new, d[new], len(d))))
            keep[other[np.flatnonzero(np.diff(np.searchsorted(new, other, "right"), prepend=-1))]] = True
            h, d, pos = h[keep], d[keep], pos[keep]
            bucket = _bucket(h, buckets)
            order = np.lexsort((pos, d, bucket))
            h, d, pos, bucket = h[order] & _SHORT, d[order], pos[order], bucket[order]
            bounds = np.append(_groups(bucket), len(h)).tolist()
            yield _sent([(int(bucket[a]), _pack(h[a:b], "<u8"), _pack(pos[a:b], "<u4"), _pack(d[a:b], "<i8", True)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])

        for chunk in kernels.chunks(batches):
            data, offsets = kernels.utf8(chunk.column("text"))
            pos, h, _, _, row = anchors(data, offsets, window, gram)
            held.append((h, chunk.column("d").to_numpy()[row], pos - offsets[row]))
            waiting += len(h)
            if waiting >= PACK_ANCHORS:
                yield from flush()
                waiting = 0
        if waiting:
            yield from flush()

    def packed(d: np.ndarray, pos: np.ndarray) -> pa.Table:
        """One row per shard of documents, so that the rows do not grow with buckets times documents."""
        shard = d % shards
        order = np.lexsort((pos, d, shard))
        d, pos, shard = d[order], pos[order], shard[order]
        bounds = np.append(_groups(shard), len(d)).tolist()
        spans = list(zip(bounds[:-1], bounds[1:], strict=True))
        return pa.table([pa.array([int(shard[i]) for i, _ in spans], pa.int64()), pa.array([_pack(d[i:j], "<i8", True) for i, j in spans], pa.binary()), pa.array([_pack(pos[i:j], "<u4") for i, j in spans], pa.binary())], ["shard", "d", "at"])

    def meet(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < 0:
            cells = [np.frombuffer(x, "<u4") for x in table["b"].to_pylist()]
            d = np.array([int.from_bytes(x, "little", signed=True) for x in table["g"].to_pylist()], np.int64)
            return packed(np.repeat(d, [len(c) for c in cells]), np.concatenate(cells))
        h, pos, d = (np.concatenate([_unpack(x, t, k) for x in table[c].to_pylist()]) for c, t, k in (("a", "<u8", False), ("b", "<u4", False), ("c", "<i8", True)))
        order = np.argsort(h, kind="stable")
        h, d, pos = h[order], d[order], pos[order]
        several = _several(_groups(h), d)
        return packed(d[several], pos[several])

    def spread(table: pa.Table) -> pa.Table:
        d, pos = (np.concatenate([_unpack(x, t, k) for x in table[c].to_pylist()]) for c, t, k in (("d", "<i8", True), ("at", "<u4", False)))
        return pa.Table.from_batches([_positions(d, pos)])

    met = rows.select("d", "text").mapInArrow(scan, _SENT).groupBy("bucket").applyInArrow(meet, "shard long, d binary, at binary")
    return met.groupBy("shard").applyInArrow(spread, "d long, at binary")


def _span_rows(d: np.ndarray, v: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """(d, v, spans): one row per text with its merged (start, end) pairs (i8)."""
    order = np.lexsort((a, v, d))
    d, v, spans = d[order], v[order], np.stack([a[order], b[order]], 1)
    new = _groups(d, v)
    cells = [_union(x).astype("<i8").tobytes() for x in np.split(spans, new[1:])] if len(d) else []
    return pa.record_batch([pa.array(d[new], pa.int64()), pa.array(v[new], pa.int32()), pa.array(cells, pa.binary())], ["d", "v", "spans"])


def _least(text: np.ndarray, start: np.ndarray, size: np.ndarray, h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by context and document; the starts of the groups of equal contexts, and each ordered row's smallest document.

    A hash brings equal contexts together, and their bytes are compared with those of the row before; rows whose hash alone is
    equal are groups of their own, which only makes the array hold a context more than once."""
    order = np.lexsort((d, size, h))
    new = np.append(True, (np.diff(h[order]) != 0) | (np.diff(size[order]) != 0)) if len(h) else np.zeros(0, bool)
    words, some, j = _eights(text, 8, "<"), np.flatnonzero(~new), 0
    while len(some):
        n = size[order[some]]
        step = np.minimum(j, np.maximum(n - 8, 0))
        new[some] |= words[start[order[some]] + step] != words[start[order[some - 1]] + step]
        j += 8
        some = some[n > j]
    starts = np.flatnonzero(new)
    return order, starts, _spread(starts, d[order][starts], len(d))


def _spans(rows: DataFrame, hits: DataFrame, buckets: int, window: int, gram: int) -> DataFrame:
    """(d, v, spans): (start, end) pairs (i8) of the removed bytes, merged within a row."""
    listed = hits.groupBy("d").agg(F.collect_list("at").alias("at"))
    wanted = rows.join(listed, "d").select(*rows.columns, "at")  # the columns of the last join too, so that one shuffle of the texts serves both

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, waiting, length = [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, d, v, at, start, size, bucket = (np.concatenate([x[k] for x in held]) for k in range(7))
            text = np.concatenate(texts)
            held.clear()
            texts.clear()
            order, _, least = _least(text, start, size, h, d)
            d, v, at, start, size, bucket = d[order], v[order], at[order], start[order], size[order], bucket[order]
            gone = d > least
            done = _span_rows(d[gone], v[gone], at[gone], at[gone] + size[gone])
            yield _sent([(-1 - i % buckets, None, spans, None, None, None, i.to_bytes(8, "little", signed=True) + k.to_bytes(4, "little")) for i, k, spans in zip(*(c.to_pylist() for c in done.columns), strict=True)])
            kept = np.flatnonzero(~gone)
            kept = kept[np.lexsort((at[kept], d[kept], bucket[kept]))]
            bounds = np.append(_groups(bucket[kept]), len(kept)).tolist()
            out = []
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                k = kept[i:j]
                blob = zstandard.ZstdCompressor(level=3).compress(bpe.ragged(text, start[k], size[k]).tobytes())
                out.append((int(bucket[k[0]]), blob, _pack(size[k], "<u4"), _pack(d[k], "<i8", True), _pack(at[k], "<u4"), _pack(v[k], "<u2")))
            yield _sent(out)

        for chunk in kernels.chunks(batches):
            data, offsets = kernels.utf8(chunk.column("text"))
            pos, h, first, last, row = anchors(data, offsets, window, gram)
            known = [np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in chunk.column("at").to_pylist()]
            marked = np.concatenate([k + o for k, o in zip(known, offsets[:-1].tolist(), strict=True)])
            use = np.isin(pos, marked)
            if not use.any():
                continue
            a, b, row = first[use], last[use] + window, row[use]
            held.append((kernels.span_hash(kernels.prefix_hash(data), a, b), chunk.column("d").to_numpy()[row], chunk.column("v").to_numpy()[row], a - offsets[row], a + length, b - a, _bucket(h[use], buckets)))
            texts.append(data)
            waiting, length = waiting + len(a), length + len(data)
            if waiting >= PACK_ANCHORS // 2 or length >= PACK_TEXT:
                yield from flush()
                waiting = length = 0
        if waiting:
            yield from flush()

    def settle(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < 0:
            keys = table["g"].to_pylist()
            return pa.table([pa.array([int.from_bytes(x[:8], "little", signed=True) for x in keys], pa.int64()), pa.array([int.from_bytes(x[8:], "little") for x in keys], pa.int32()), table["b"]], ["d", "v", "spans"])
        expand = zstandard.ZstdDecompressor().decompress
        text = np.frombuffer(b"".join(expand(x) for x in table["a"].to_pylist()), np.uint8)
        size, d, at, v = (np.concatenate([_unpack(x, t, k) for x in table[c].to_pylist()]).astype(np.int64) for c, t, k in (("b", "<u4", False), ("c", "<i8", True), ("e", "<u4", False), ("f", "<u2", False)))
        start = np.cumsum(size) - size
        order, starts, least = _least(text, start, size, kernels.span_hash(kernels.prefix_hash(text), start, start + size), d)
        d, v, at, size, start = d[order], v[order], at[order], size[order], start[order]
        # the array holds each distinct context once; its owner is the smallest document
        ends = np.cumsum(size[starts])
        windows = repeated_windows(bpe.ragged(text, start[starts], size[starts]), ends, d[starts], window)
        context = np.searchsorted(ends, windows, "right")
        inside = windows - (ends[context] - size[starts][context])
        # windows of a context that go, for each row that holds it on behalf of its owner
        count = np.bincount(context, minlength=len(starts))
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(d))))
        own = np.flatnonzero(d == least)
        picked = bpe.ragged(inside, (np.cumsum(count) - count)[group[own]], count[group[own]])
        who = np.repeat(own, count[group[own]])
        gone = np.flatnonzero(d > least)
        a = np.append(at[gone], at[who] + picked)
        b = np.append(at[gone] + size[gone], at[who] + picked + window)
        rows_ = np.append(gone, who)
        return pa.Table.from_batches([_span_rows(d[rows_], v[rows_], a, b)])

    return wanted.mapInArrow(cut, _SENT).groupBy("bucket").applyInArrow(settle, "d long, v int, spans binary")


def with_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, rest: Column | None = None) -> DataFrame:
    """d, v, doc_id, text, what is to go along, and spans (array of binary pairs, null where nothing goes) of every row."""
    rows = _keyed(docs, rest)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    hits = _hits(rows, max(1, math.ceil(size / BUCKET_ANCHOR_TEXT)), window, gram)
    spans = _spans(rows, hits, max(1, math.ceil(size / BUCKET_TEXT)), window, gram)
    listed = spans.groupBy("d").agg(F.collect_list(F.struct("v", "spans")).alias("found"))
    own = F.transform(F.filter("found", lambda x: x["v"] == F.col("v")), lambda x: x["spans"])
    return rows.join(listed, "d", "left").withColumn("spans", own).drop("found")


def _removed(cell: list[bytes] | None) -> np.ndarray:
    return _union(np.frombuffer(b"".join(cell or ()), "<i8").reshape(-1, 2))


def _kept(raw: bytes, spans: np.ndarray) -> bytes:
    edges = [0, *spans.ravel().tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, cell in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                spans = _removed(cell)
                out.append((len(raw), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(_kept(raw, spans)).hexdigest()))
            yield pa.record_batch([batch.column("doc_id"), *(pa.array([o[k] for o in out], t) for k, t in enumerate([pa.int64()] * 3 + [pa.string()]))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_spans(docs, window).select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def clean(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with the removed bytes cut out of their texts; all columns stay, and n_chars (where there is one) follows. A row's
    other columns go along with its text, so that texts are shuffled once."""
    others = [c for c in docs.columns if c != "text"]
    rest = F.struct(F.col("text").isNull().alias("_none"), F.struct(*(F.col(f"`{c}`") for c in others)).alias("_row")).alias("rest")
    found = with_spans(docs, window, rest=rest).select("text", "spans", "rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cut = batch.column("text").to_pylist(), []
            for k, cell in enumerate(batch.column("spans").to_pylist()):
                cut.append(bool(cell))
                if cell:
                    texts[k] = _kept(texts[k].encode(), _removed(cell)).decode("utf-8", "ignore")
            yield pa.record_batch([pa.array(texts, pa.string()), pa.array(cut), batch.column("rest")], ["text", "cut", "rest"])

    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("cut", T.BooleanType()), found.schema["rest"]])
    made = found.mapInArrow(run, schema)
    own = {"text": F.when(~F.col("rest._none"), F.col("text"))}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("cut"), F.char_length("text").cast(T.LongType())).otherwise(F.col("rest._row.n_chars"))
    return made.select(*(own.get(c, F.col(f"rest._row.`{c}`")).alias(c) for c in docs.columns))

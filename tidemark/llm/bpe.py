"""BPE encoding and decoding with contiguous rank arrays (operator 6), shared by packing and token output.

A chunk of texts is split into pre-tokens by vectorised rules on its bytes, distinct pre-tokens are found by an Arrow
dictionary, and only those not seen before are merged. A short word is an array of part ids beside an array of the ranks of
adjacent parts: the smallest rank is looked for by a scan, one boundary is deleted, and the two neighbouring ranks are
refreshed. Words of over 64 bytes take the same merges in the same order from a heap, so none costs the square of its length.

Defined results: a null text is empty and has no ids; repeated rows each get their row; other columns are ignored; a null
doc_id is kept as null. A file with other pre-tokenizers, normalisers or post-processing, or with added tokens that take
their surroundings along, is refused when loaded.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import common, kernels

TOKENIZER = "byte_bpe_50k.json"
SHORT_WORD = 64
CACHE_WORDS = 800_000
_NONE = 0x7FFFFFFF

#: The Unicode White_Space code points.
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@cache
def _classes() -> np.ndarray:
    """Class of each code point: space, letter, number or other."""
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[_SPACES] = _SPACE
    return table


def byte_symbols() -> list[str]:
    """The printable stand-in for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    table = _classes()
    out = table[: 0x100][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
        b0, b1, b2, b3 = (padded[lead + k] for k in range(4))
        two, four = b0 < 0xE0, b0 >= 0xF0
        point = np.where(two, (b0 & 0x1F) << 6 | b1 & 0x3F, np.where(four, (b0 & 7) << 18 | (b1 & 0x3F) << 12 | (b2 & 0x3F) << 6 | b3 & 0x3F, (b0 & 0xF) << 12 | (b1 & 0x3F) << 6 | b2 & 0x3F))
        kind = table[np.minimum(point, 0x10FFFF)]
        out[lead] = kind
        out[lead + 1] = kind
        for k, rows in ((2, ~two), (3, four)):
            out[lead[rows] + k] = kind[rows]
    return out


def pretokens(data: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Start of every pre-token; `segments` holds the start of each non-empty segment, which no pre-token crosses."""
    n = len(data)
    kind = byte_classes(data)
    run = np.ones(n, bool)
    run[1:] = kind[1:] != kind[:-1]
    run[segments] = True
    head = np.zeros(n + 1, bool)
    head[segments] = True
    begin = run.copy()
    at = np.flatnonzero(run & (kind != _SPACE) & ~head[:n])
    after = at[kind[at - 1] == _SPACE]  # runs that follow white space in their segment
    wide = data[after - 1] >= 0x80
    last = after - 1 - wide - (wide & (data[after - 2] < 0xC0))
    begin[last] = True
    begin[after[data[after - 1] == 0x20]] = False
    quote = np.flatnonzero(run & (data == 0x27))
    quote = quote[(quote + 2 <= n) & (head[quote] | (data[quote - 1] != 0x20))]
    quote = quote[run[quote + 1] & ~head[quote + 1] & (kind[quote + 1] == _LETTER)] if len(quote) else quote
    if len(quote):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        a, b = padded[quote + 1], padded[quote + 2]
        b = np.where(head[np.minimum(quote + 2, n)], 0, b)
        one = np.isin(a, list(b"stmd"))
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        begin[quote[one | two] + 1] = False
        for rows, k in ((one, 2), (two, 3)):
            cut = quote[rows] + k
            begin[cut[cut < n]] = True
    return np.flatnonzero(begin)


def ragged(values: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """values[start[i] : start[i] + count[i]] for every i, end to end."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(start - (ends - count), count) + np.arange(total)]


class Bpe:
    """A byte-level BPE vocabulary with a bounded cache of encoded pre-tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or spec["post_processor"] or pre != pre | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} or model.get("ignore_merges"):
            raise ValueError(f"{path}: only plain byte-level BPE is supported")
        if any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path}: added tokens that take their surroundings along are not supported")
        symbols = byte_symbols()
        of_symbol = {s: b for b, s in enumerate(symbols)}
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.pieces[i] = bytes(of_symbol[c] for c in token)
        for token, i in self.special.items():
            self.pieces[i] = token
        self.size = size
        self._byte_list = [vocab[s] for s in symbols]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = [vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs]
        self.made = [vocab[a + b] for a, b in pairs]
        self._rank = {a << 20 | b: r for r, (a, b) in enumerate(zip(left, right, strict=True))}
        first = self._byte_list
        self._byte_pairs = [[self._rank.get(a << 20 | b, _NONE) for b in first] for a in first]
        self.piece_bytes = self._flat(self.pieces)
        self.piece_decimals = self._flat([b"%d," % i for i in range(size)])
        self._forget()

    @staticmethod
    def _flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        count = np.array([len(p) for p in parts], np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(count) - count, count

    def _forget(self) -> None:
        self._index: dict[bytes, int] = {}
        self._ids = np.zeros(1 << 16, np.int32)
        self._start = np.zeros(1 << 16, np.int64)
        self._count = np.zeros(1 << 16, np.int64)
        self._used = 0

    def merge_short(self, word: bytes) -> list[int]:
        """Ids of one short word: parts and the ranks of adjacent parts lie in two small arrays."""
        ids, table, made, get = self._byte_list, self._byte_pairs, self.made, self._rank.get
        parts = [ids[b] for b in word]
        ranks = [table[a][b] for a, b in pairwise(word)]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            at = ranks.index(least)
            new = parts[at] = made[least]
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = get(new << 20 | parts[at + 1], _NONE)
            if at:
                ranks[at - 1] = get(parts[at - 1] << 20 | new, _NONE)
        return parts

    def merge_long(self, word: bytes) -> list[int]:
        """Ids of one long word: the same merges in the same order, by a heap over linked parts."""
        part, n = [self._byte_list[b] for b in word], len(word)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        get = self._rank.get
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := get(part[i] << 20 | part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if part[i] == a else -1
            if j < 0 or part[j] != b:
                continue
            part[i], part[j] = self.made[r], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (s := get(part[x] << 20 | part[y])) is not None:
                    heapq.heappush(heap, (s, x, part[x], part[y]))
        return [p for p in part if p >= 0]

    def _learn(self, words: list[bytes]) -> None:
        done = [[self.special[w]] if w in self.special else self.merge_short(w) if len(w) <= SHORT_WORD else self.merge_long(w) for w in words]
        ids, first = np.fromiter(chain.from_iterable(done), np.int32), len(self._index)
        count = np.fromiter(map(len, done), np.int64, len(words))
        for name, need in (("_ids", self._used + len(ids)), ("_start", first + len(words)), ("_count", first + len(words))):
            have = getattr(self, name)
            if need > len(have):
                setattr(self, name, np.concatenate([have, np.zeros(max(need, 2 * len(have)) - len(have), have.dtype)]))
        self._ids[self._used : self._used + len(ids)] = ids
        self._start[first : first + len(words)] = self._used + np.cumsum(count) - count
        self._count[first : first + len(words)] = count
        self._index.update(zip(words, range(first, first + len(words)), strict=True))
        self._used += len(ids)

    def _special_spans(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        raw, found = data.tobytes(), []
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                row_end = offsets[np.searchsorted(offsets, at, "right")]
                inside = at + len(token) <= row_end
                if inside:
                    found.append((at, at + len(token)))
                at = raw.find(token, at + (len(token) if inside else 1))
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, end to end, and the n + 1 bounds of each row's ids."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        special = self._special_spans(data, offsets)
        cuts = np.unique(np.concatenate([offsets, *([np.array(special).ravel()] if special else [])]))
        begin = pretokens(data, cuts[cuts < len(data)])
        if special:
            keep = np.ones(len(begin), bool)
            for a, b in special:
                keep[np.searchsorted(begin, a + 1) : np.searchsorted(begin, b)] = False
            begin = begin[keep]
        bounds = np.append(begin, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self._index) + len(distinct) > CACHE_WORDS:
            self._forget()
        if new := [w for w in distinct if w not in self._index]:
            self._learn(new)
        index = np.fromiter(map(self._index.__getitem__, distinct), np.int64, len(distinct))[words.indices.to_numpy()]
        count = self._count[index]
        ends = np.concatenate([[0], np.cumsum(count)])
        return ragged(self._ids, self._start[index], count), ends[np.searchsorted(begin, offsets)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Each row's text in UTF-8; bytes that are no UTF-8 turn into replacement characters."""
        flat, start, count = self.piece_bytes
        raw = ragged(flat, start[ids], count[ids]).tobytes()
        ends = np.concatenate([[0], np.cumsum(count[ids])])[bounds].tolist()
        return [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decimals(self, ids: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
        """Each row's ids in decimal, joined by commas."""
        flat, start, count = self.piece_decimals
        raw = memoryview(ragged(flat, start[ids], count[ids]).tobytes())
        ends = np.concatenate([[0], np.cumsum(count[ids])])[bounds].tolist()
        return [raw[a : max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:], strict=True)]


@cache
def load(path: str) -> Bpe:
    return Bpe(path)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>): the ids of every whole text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for chunk in kernels.chunks(batches):
            ids, bounds = bpe.encode(*kernels.utf8(chunk.column("text")))
            yield pa.record_batch([chunk.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))], ["doc_id", "ids"])

    return common.doc_key(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text: the inverse of encode_documents."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            rows = batch.column("ids").cast(pa.list_(pa.int32()))
            flat = rows.flatten().to_numpy()
            bounds = np.concatenate([[0], np.cumsum(np.nan_to_num(rows.value_lengths().to_numpy(zero_copy_only=False)))]).astype(np.int64)
            yield pa.record_batch([batch.column("doc_id"), pa.array([t.decode() for t in bpe.decode(flat, bounds)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text is encoded and its ids are decoded again."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for chunk in kernels.chunks(batches):
            ids, bounds = bpe.encode(*kernels.utf8(chunk.column("text")))
            shown = [hashlib.sha256(x).hexdigest() for x in bpe.decimals(ids, bounds)]
            back = [hashlib.sha256(x).hexdigest() for x in bpe.decode(ids, bounds)]
            yield pa.record_batch([chunk.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(shown, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.doc_key(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

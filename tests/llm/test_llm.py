"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing
column names."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bloomlm, bpe, common, components, crosspolytope, jaccard, kernels, kneserney, outliers, packing, suffix, tokenfile, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["alpha", "Beta", "gamma", "déjà", "it's", "x1", "omega,", "the"]) + str(rng.randint(0, 9)) * rng.randint(0, 2) for _ in range(n))


def corpus() -> list[tuple]:
    rng = random.Random(5)
    base = [prose(rng, rng.randint(3, 150)) for _ in range(40)]
    texts = [*base, base[0], base[0], base[1] + " tail", base[2][:400] + base[3], "intro " + base[4], None, "", " \n ", "one", "One", "<|endoftext|>x<|endoftext|>", "a" * 3000, "ab " * 2000, "日本語 " * 40, base[5].upper()]
    return [(k * 3, t, "en" if k % 2 else None, "s", len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = ["n", "key", "bits", "node", "bucket", "d", "v", "spans", "h", "block", "n_words", "ids", "length"]
    return spark.createDataFrame(rows, DOCS).repartition(3).withColumns({c: F.lit("clash") for c in clash}).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df) -> dict:
    out = {r["doc_id"]: r for r in df.collect()}
    return out


# 6: BPE


def test_bpe_equals_the_library(docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    got = by_id(bpe.digests(docs))
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        r = got[doc_id]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_bpe_round_trip_and_empty(docs, empty):
    back = by_id(bpe.decode_documents(bpe.encode_documents(docs)))
    assert all(back[r["doc_id"]]["text"] == (r["text"] or "") for r in docs.collect())
    assert bpe.digests(empty).count() == 0


def test_bpe_pretokens_on_odd_texts():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(bpe.default_path()), bpe.load(bpe.default_path())
    rng = random.Random(1)
    parts = ["a", "s", "'", "'s", "'ll", " ", "  ", "\n", " ", "　", "1", "!", "é", "中", "<|endoftext|>", "\x1c", "'re", "T"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 24))) for _ in range(4000)]
    from tidemark.llm import kernels

    ids, bounds = own.encode(*kernels.utf8(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


# 7: packing


def check_packing(got: list, sizes: dict, capacity: int) -> int:
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    for doc_id, n in sizes.items():
        own = sorted((r["piece"], r["start"], r["length"]) for r in got if r["doc_id"] == doc_id)
        assert [p for p, *_ in own] == list(range(-(-n // capacity)))
        assert sum(x for *_, x in own) == n and all(x == capacity for *_, x in own[1:])
    return len(held)


def test_bpe_classes_equal_the_library_for_all_code_points():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(bpe.default_path()), bpe.load(bpe.default_path())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}!\n" for c in points[k : k + 256]) for k in range(0, len(points), 256)]
    for at in range(0, len(texts), 200):
        ids, bounds = own.encode(*kernels.utf8(pa.array(texts[at : at + 200])))
        for k, found in enumerate(library.encode_batch(texts[at : at + 200], add_special_tokens=False)):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == found.ids


def test_bpe_refuses_added_tokens_that_take_spaces(tmp_path):
    import json

    with open(bpe.default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="surroundings"):
        bpe.Bpe(str(tmp_path / "t.json"))


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, 2] for d, t, *_ in rows}
    got = packing.pack_documents(docs).collect()
    n = check_packing(got, {d: len(x) for d, x in ids.items()}, 1024)
    assert n <= math.ceil(sum(map(len, ids.values())) / 1024) + 2
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())


def test_packing_in_shards_stays_dense(spark):
    rng = random.Random(2)
    rows = [(k, 0, 0, rng.randint(1, 1023), 0) for k in range(3000)]
    found = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(found, shard_items=500).collect()
    n = check_packing(got, {r[0]: r[3] for r in rows}, 1024)
    assert len(got) == 3000 and n <= 1.03 * sum(r[3] for r in rows) / 1024


def test_packing_ends_where_nothing_fits_together(spark):
    found = spark.createDataFrame([(k, 0, 0, 600 + k % 100, 0) for k in range(900)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(found, shard_items=100).collect()
    assert len({r["sequence_id"] for r in got}) == 900 and all(r["offset"] == 0 for r in got)


def test_packing_choice_by_plain_counting():
    """Each piece goes where the squared counts of open sequences per gap become smallest, to the smallest gap of equals."""
    rng = random.Random(14)
    lengths = sorted((rng.randint(1, 60) for _ in range(400)), reverse=True)
    bins, offsets, left = packing.place(lengths, 64)
    gaps, used = Counter(), {}
    for size, b, offset in zip(lengths, bins, offsets, strict=True):
        open_ = sorted(g for g, n in gaps.items() if n and g >= size)

        def after(g, size=size):
            moved = Counter(gaps)
            moved[g] -= 1
            moved[g - size] += g > size
            return sum(n * n for n in moved.values())

        if open_:
            least = min(after(g) for g in open_)
            gap = next(g for g in open_ if after(g) == least)
            assert used[b] == 64 - gap
            gaps[gap] -= 1
        else:
            gap = 64
            assert b not in used
        assert offset == 64 - gap
        used[b] = offset + size
        gaps[gap - size] += gap > size
    assert [64 - used[b] for b in range(len(left))] == left


def test_packing_empty(empty):
    assert packing.pack_documents(empty).count() == 0


# 8: token files


def test_token_files(docs, rows, empty):
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(bpe.default_path()), 0
    got = by_id(tokenfile.round_trip(docs))
    for doc_id, text, *_ in sorted(rows):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        r = got[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert tokenfile.round_trip(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 700])
def test_huffman_is_optimal_within_the_limit(n):
    rng = np.random.default_rng(n)
    counts = np.zeros(1000, np.int64)
    counts[rng.choice(1000, n, replace=False)] = (rng.pareto(0.6, n) * 10).astype(int) + 1
    lengths = tokenfile.code_lengths(counts)
    assert lengths.max() <= tokenfile.MAX_BITS and sum(2.0 ** -int(x) for x in lengths if x) <= 1
    ids = rng.choice(np.flatnonzero(counts), 1000).astype(np.uint32)
    payload, at = tokenfile.pack_bits(ids, tokenfile.canonical_codes(lengths), lengths)
    assert (tokenfile.unpack_bits(payload, at[:-1][:: tokenfile.CHECK], len(ids), tokenfile.decode_table(lengths)) == ids).all()
    limited = tokenfile.code_lengths(np.array([1, 1, 2, 4, 8, 16, 32, 64]), 4)
    assert limited.max() == 4 and sum(2.0 ** -int(x) for x in limited) == 1


# 4: suffix arrays


def brute_removed(rows: list[tuple], window: int = 50) -> dict:
    seen, out = set(), {}
    for doc_id, text, *_ in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone, own = bytearray(len(raw)), [raw[i : i + window] for i in range(len(raw) - window + 1)]
        for i, w in enumerate(own):
            if w in seen:
                gone[i : i + window] = b"\1" * window
        seen.update(own)
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        out[doc_id] = (len(raw), sum(gone), sum(1 for i in range(len(raw)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_removal(docs, rows, empty):
    got = {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in by_id(suffix.digest(docs)).items()}
    assert got == brute_removed(rows)
    assert suffix.digest(empty).count() == 0


def test_suffix_clean_and_repeated_ids(spark):
    passage = "a passage of some length that two documents share, word for word."
    rows = [(1, passage + " first", "x"), (2, "second " + passage, "y"), (2, passage, "y2"), (None, passage, "z"), (3, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, d string")
    out = sorted(((r["doc_id"] is None, r["doc_id"], r["d"], r["text"]) for r in suffix.clean(docs).collect()), key=str)
    assert [x[1:] for x in out] == [(1, "x", passage + " first"), (2, "y", "second"), (2, "y2", ""), (3, "n", None), (None, "z", "")] or [x[3] for x in out if x[2] == "z"] == [""]


def test_suffix_repeated_ids_across_tasks(spark):
    passage = "a passage of some length that three documents share, word for word."
    rows = [(None, passage + " in the first task"), (5, "five " + passage), (None, "elsewhere " + passage), (6, "nothing of that kind")]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    assert not any(passage in r["text"] for r in suffix.clean(docs).where("doc_id is null").collect())
    assert suffix.clean(docs).where("doc_id = 5").first()["text"] == "five " + passage


@pytest.mark.parametrize("seed", range(5))
def test_suffix_array_orders_all_suffixes(seed):
    rng = np.random.default_rng(seed)
    for _ in range(40):
        parts = [bytes(rng.choice([0, 65, 66, 255], rng.integers(1, 14)).astype(np.uint8)) for _ in range(rng.integers(1, 12))]
        text, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
        order = suffix.suffix_array(text, ends, 20)
        own = np.searchsorted(ends, np.arange(len(text)), "right")
        suffixes = [bytes(text[i : ends[own[i]]]) for i in range(len(text))]
        assert sorted(order.tolist()) == list(range(len(text)))
        assert [suffixes[i] for i in order] == sorted(suffixes)
        long_ones = suffix.suffix_array(text, ends, 20, 4)
        assert sorted(long_ones.tolist()) == [i for i, s in enumerate(suffixes) if len(s) >= 4]
        assert [suffixes[i] for i in long_ones] == sorted(s for s in suffixes if len(s) >= 4)


# 5: Jaccard join


def brute_links(rows: list[tuple]) -> dict:
    sets, parent = {}, {r[0]: r[0] for r in rows}
    for doc_id, text, *_ in rows:
        w = words_of(text)
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_jaccard(docs, rows, empty):
    got = {k: (r["n_shingles"], r["component_id"]) for k, r in by_id(jaccard.link(docs)).items()}
    assert got == brute_links(rows)
    assert jaccard.link(empty).count() == 0


@pytest.mark.parametrize(("tile_bytes", "leaders", "tasks"), [(4 << 20, 4, 1), (2000, 1, 3)])
def test_jaccard_large_tiles(spark, monkeypatch, tile_bytes, leaders, tasks):
    """Tiles of more than SMALL documents, with chains of near copies and one passage that all share."""
    monkeypatch.setattr(jaccard, "SMALL", 3)
    monkeypatch.setattr(jaccard, "TILE_BYTES", tile_bytes)
    monkeypatch.setattr(jaccard, "LEADERS", leaders)
    rng, rows = random.Random(9), []
    vocabulary = [f"w{k}" for k in range(500)]
    for group in range(4):
        text = rng.choices(vocabulary, k=80)
        for copy in range(12):
            own = list(text)
            for _ in range(copy % 3):
                own[rng.randrange(80)] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(own)))
    shared = " ".join(rng.choices(vocabulary, k=30))
    rows += [(len(rows) + k, shared + " " + " ".join(rng.choices(vocabulary, k=k))) for k in range(12)]
    got = {k: (r["n_shingles"], r["component_id"]) for k, r in by_id(jaccard.link(spark.createDataFrame(spark.sparkContext.parallelize(rows, tasks), "doc_id long, text string"))).items()}
    assert got == brute_links(rows)


def test_jaccard_pairs_do_not_grow_with_copies(spark, monkeypatch):
    """Copies far apart, in packs of their own, are one set where packs meet: no pair of copies, and a link of two texts once in a bucket."""
    monkeypatch.setattr(jaccard, "PACK_SHINGLES", 1)
    monkeypatch.setattr(jaccard, "CHUNK_BYTES", 1)
    rng = random.Random(14)
    one = rng.choices([f"w{k}" for k in range(500)], k=200)
    other = [*one[:-3], "x", "y", "z"]
    texts = [" ".join(one)] * 20 + [" ".join(other)] * 20
    rows = [(k, t) for k, t in enumerate(texts)] + [(7, " ".join(other[:-1])), (50, None), (None, texts[0])]
    table = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "doc_id long, text string")
    met = jaccard._meet(jaccard._prefixes(table, jaccard.hot_shingles(table), 2, 5, 80), 80).collect()
    assert 0 < len(met) <= 2 * 3 and all(r["x"] != r["y"] for r in met)
    got = jaccard.link(table).where("doc_id is not null").select("doc_id", "component_id").distinct().collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {**dict.fromkeys(range(40), 0), 50: 50}


def test_jaccard_leaves_no_shuffle_files_of_its_prefixes(spark, monkeypatch):
    files = lambda: sum(f.getName().startswith("shuffle_") for f in (x.apply(i) for x in [spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()] for i in range(x.size())))
    real_meet, real_weigh, seen = jaccard._meet, jaccard._weigh, {}

    def waited(*args):
        ends = time.time() + 20
        while (left := files()) > seen["before"] and time.time() < ends:
            time.sleep(0.2)
        seen["left"] = left
        return real_weigh(*args)

    def met(*args):
        common.forget(spark)
        time.sleep(2)
        seen["before"] = files() + 12  # the steps between leave some of their own
        return real_meet(*args)

    monkeypatch.setattr(jaccard, "_meet", met)
    monkeypatch.setattr(jaccard, "_weigh", waited)
    rng = random.Random(4)
    base = prose(rng, 60)
    docs = spark.createDataFrame([(k, prose(rng, 60) if k % 3 else f"{base} {k}") for k in range(240)], "doc_id long, text string").repartition(24, "doc_id")
    assert jaccard.link(docs).where("component_id = 0").count() == 80
    assert seen["left"] <= seen["before"]


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 20)] + [(30, 31), (31, 30), (5, 5)], "u long, v long")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {**{k: 1 for k in range(2, 21)}, 31: 30}


# 3: nearest neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:140] = x[7]  # copies
    rows = [(k, [float(v) for v in row], 0) for k, row in enumerate(x)] + [(900, None, 0), (901, [0.0] * 16, 0), (902, [1.0] + [None] * 15, 0), (903, [float("nan")] * 16, 0), (None, [1.0] * 16, 0), (904, [], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in crosspolytope.search(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    full = x.astype(np.float64) @ x.astype(np.float64).T
    hit = total = 0
    for q in range(0, 600, 20):
        near = sorted(got[q])
        assert [n[0] for n in near] == list(range(1, 21)) and q not in [n[1] for n in near]
        assert [(-round(n[2], 9), n[1]) for n in near] == sorted((-round(n[2], 9), n[1]) for n in near)
        assert all(abs(n[2] - full[q, n[1]]) < 1e-9 for n in near)
        best = sorted((k for k in range(600) if k != q), key=lambda k: (-round(full[q, k], 9), k))[:20]
        hit, total = hit + len({n[1] for n in near} & set(best)), total + 20
    assert set(got) == set(range(0, 600, 20)) and hit >= 0.9 * total
    assert crosspolytope.search(table.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_of_few_rows_are_all_found(spark):
    x = np.random.default_rng(6).normal(size=(15, 64)).astype(np.float32)
    table = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)] + [(0, [1.0] * 64), (3, [1.0] * 5)], "vec_id long, embedding array<float>")
    got = crosspolytope.search(table, F.col("vec_id") % 20 == 0).collect()
    full = x.astype(np.float64) @ x.astype(np.float64).T
    # each of the two vectors under id 0 has the other one and the 14 others; the short vector meets none
    assert len(got) == 30
    own = [(r["rank"], r["vec_id"], r["score"]) for r in got]
    for k in range(1, 15):
        assert any(i == k and abs(score - full[0, k]) < 1e-9 for _, i, score in own)


def test_recall_at_64_dimensions(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(6000, 64)) + 0.7 * rng.normal(size=(60, 64))[rng.integers(0, 60, 6000)]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    table = spark.createDataFrame([(k, row) for k, row in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    full = x[::20].astype(np.float64) @ x.astype(np.float64).T
    full[np.arange(300), np.arange(0, 6000, 20)] = -2
    best = np.argsort(-full, axis=1, kind="stable")[:, :20]
    got = {(r["query_id"], r["vec_id"]) for r in crosspolytope.search(table, F.col("vec_id") % 20 == 0, block_rows=2500).collect()}
    assert len(got) == 6000 and sum((20 * q, int(v)) in got for q in range(300) for v in best[q]) >= 0.9 * 6000


def test_cells_do_not_grow_as_fast_as_many_rows():
    assert [crosspolytope.axis_counts(n, 64) for n in (100, 10_256, 51_282)] == [[128], [128, 16], [128, 128]]
    assert crosspolytope.axis_counts(615_384, 64) == [128, 128, 2]  # recall 0.95, where 8 axes gave 0.79


def test_lists_of_ids_pass_in_bounded_rows(spark, monkeypatch):
    """Many queries against one block: no row holds more than IDS ids, and short rows give what a scan gives."""
    monkeypatch.setattr(crosspolytope, "IDS", 3)
    rng = np.random.default_rng(15)
    x = rng.normal(size=(400, 8))
    table = spark.createDataFrame([(k, row) for k, row in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    rows = crosspolytope.valid_vectors(table)
    index = crosspolytope._smallest_ids(rows, 21)
    dealt = [crosspolytope._dealt(crosspolytope._slots(rows, "<f8", 4, p, 400, None, p == 1), 2, np.zeros(0, np.int64), np.zeros(0, np.int64), p == 1) for p in (8, 1)]
    met = crosspolytope._met(*dealt, 2)
    assert max(len(r["vids"]) for r in met.collect()) == 3 * 4
    every = rows.select(F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("block"), F.col("vid").alias("query"), F.lit(None).cast("binary").alias("vids"))
    best = {}
    for r in crosspolytope._scored(every, rows.select("key", "vid", "vec", "dim"), index, 2, "<f8", 5).collect():
        best.setdefault(bytes(r["query"]), []).append(r["score"])
    key = {r["vec_id"]: bytes(r["key"]) for r in rows.collect()}
    full = np.sort(x @ x.T, axis=1)[:, ::-1]
    assert all(np.allclose(sorted(best[key[k]], reverse=True)[:6], full[k, :6]) for k in range(400))


def test_hot_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(crosspolytope, "HOT_ROWS", 20)
    monkeypatch.setattr(crosspolytope, "BUCKET_ENTRIES", 2000)
    rng = np.random.default_rng(12)
    x = np.concatenate([np.ones((300, 16)) + 1e-3 * rng.normal(size=(300, 16)), rng.normal(size=(100, 16))])
    table = spark.createDataFrame([(k, row) for k, row in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in crosspolytope.search(table, F.col("vec_id") == 0).collect()}
    best = np.argsort(-(x @ x[0]), kind="stable")
    assert [got[0, k + 1] for k in range(20)] == [int(k) for k in best if k][:20]


def test_neighbours_with_different_norms(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8)) * rng.uniform(0.5, 2, (300, 1))
    table = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["score"] for r in crosspolytope.search(table, F.col("vec_id") % 20 == 0).collect()}
    full = x @ x.T
    good = [abs(got[q, 1] - max(full[q, k] for k in range(300) if k != q)) < 1e-9 for q in range(0, 300, 20)]
    assert sum(good) >= 0.9 * len(good)


# 9: LM scoring


def test_bloom_scores(docs, rows, empty):
    counts, tokens = Counter(), {}
    for doc_id, text, *_ in rows:
        t = [*words_of(text), None]
        tokens[doc_id] = (zlib.crc32(str(doc_id).encode()) % 10 == 0, t)
        if not tokens[doc_id][0]:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    got = by_id(bloomlm.score(docs))
    for doc_id, (held, t) in tokens.items():
        r = got[doc_id]
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, len(t), sum(counts[x] > 0 for x in t), n)
        assert r["base_score"] == pytest.approx(base, abs=1e-6) and r["score"] < 0
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())
    assert bloomlm.score(empty).count() == 0


def test_filter_never_forgets():
    rng = np.random.default_rng(1)
    h, c = rng.integers(0, 1 << 64, 5000, np.uint64), rng.integers(1, 1000, 5000)
    order = np.argsort(bloomlm.bucket_of(h, 4), kind="stable")
    h, c = h[order], c[order]
    parts = [bloomlm.segment(h[bloomlm.bucket_of(h, 4) == b], c[bloomlm.bucket_of(h, 4) == b], 1 << 18) for b in range(4)]
    found = bloomlm.probe(np.stack(parts), h, 64)
    assert (found >= bloomlm.levels(c)).all() and (found == bloomlm.levels(c)).mean() > 0.97
    other = bloomlm.probe(np.stack(parts), rng.integers(0, 1 << 64, 5000, np.uint64), 64)
    assert (other > 0).mean() < 0.1
    assert np.allclose(np.round(bloomlm.level_count(bloomlm.levels(np.array([1, 2, 100]))) / np.array([1, 2, 100]) - 1, 1), 0, atol=0.25)


def test_filter_follows_the_input(spark, monkeypatch):
    """Many n-grams a byte, with the former bound on the filter's size far below what they need: unseen bigrams stay unseen."""
    monkeypatch.setattr(bloomlm, "FILTER_LIMIT", 1 << 12, raising=False)
    rng = random.Random(17)
    texts = {k: [f"{rng.randrange(300):x}" for _ in range(100)] for k in range(300)}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in texts}
    single, double = Counter(), Counter()
    for k, t in texts.items():
        if not held[k]:
            single.update([*t, None])
            double.update(zip([None, *t], [*t, None], strict=True))
    quantised = lambda c: float(bloomlm.level_count(bloomlm.levels(np.array([c])))[0]) if c else 0.0
    floor = sum(single.values()) + 0.1 * (len(single) + 1)
    got = by_id(bloomlm.score(spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")))
    off = []
    for k, t in texts.items():
        exact = 0.0
        for v, w in zip([None, *t], [*t, None], strict=True):
            context = quantised(single[v])
            exact += math.log10(0.7 * (quantised(single[w]) + 0.1) / floor + 0.3 * min(quantised(double[v, w]), context) / max(context, 1.0))
        if held[k]:
            off.append((got[k]["score"] - exact) / (len(t) + 1))
    assert len(off) >= 20 and abs(float(np.mean(off))) < 0.03


def test_a_full_segment_gives_the_highest_level():
    assert bloomlm.probe(np.full((1, 64), 255, np.uint8), np.arange(100, dtype=np.uint64), 7).tolist() == [7] * 100


def test_false_positives_do_not_grow():
    rng = np.random.default_rng(3)
    for n in (2_000, 200_000):
        h, c = rng.integers(0, 1 << 64, n, np.uint64), rng.integers(1, 6, n)
        other = bloomlm.probe(bloomlm.segment(h, c, bloomlm.segment_bits(c))[None, :], rng.integers(0, 1 << 64, 20_000, np.uint64), 64)
        assert (other > 0).mean() < 0.025


# 10: WARC


def test_warc(spark):
    rows = [(5, "http://a/", "<p>x</p>"), (3, "http://b/ c\r\nX: y", "<p>x</p>"), (9, None, None), (4, "u", ""), (7, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 3), (8, "u", "é" * 5000), (7, "u2", "other"), (None, "u", "é" * 5000)]
    rows.append((11, "u", warc.record(99, "http://inner/", b"inner", warc.base32_sha1(b"inner"), None, False).decode() * 2))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit("clash"))
    for step in (warc.RANGE, 64):
        folder_rows = warc.read(spark, warc.write(pages, f"{spark.conf.get('spark.checkpoint.dir')}/warc{step}"), step).collect()
        first = {}
        for page_id, _, html in rows:
            html = html or ""
            first[html] = min(first.get(html, math.inf), math.inf if page_id is None else page_id)
        expected = []
        for page_id, _, html in rows:
            raw = (html or "").encode()
            own = first[html or ""]
            kind = "response" if page_id == own or (page_id is None and own == math.inf) else "revisit"
            expected.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, own if kind == "revisit" else None, True))
        assert sorted(map(str, expected)) == sorted(str(tuple(r)) for r in folder_rows)
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_of_another_writer(spark, tmp_path):
    payload = b"<p>hello</p>"
    http = b"HTTP/1.1 200 OK\r\ncontent-length: %d\r\n\r\n" % len(payload) + payload
    record = lambda kind, block, version=b"1.0": b"WARC/" + version + b"\r\nContent-Length: %d\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:x>\r\n\r\n" % (len(block), kind) + block + b"\r\n\r\n"
    raw = record(b"warcinfo", b"software: x\r\n") + record(b"request", b"GET / HTTP/1.1\r\n\r\n") + record(b"response", http) + record(b"response", http, b"1.1") + record(b"metadata", b"")
    (tmp_path / "a.warc").write_bytes(raw)
    for step in (warc.RANGE, 50):
        got = warc.read(spark, [(f"file://{tmp_path}/a.warc", len(raw))], step).collect()
        assert [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["intact"]) for r in got] == [(None, len(payload), warc.base32_sha1(payload), "response", True)] * 2


def test_warc_broken_chain():
    with pytest.raises(ValueError, match="breaks off"):
        warc.reachable(np.array([0, 10, 25]), np.array([10, 20, 30]), 30)
    assert warc.reachable(np.array([20, 0, 7, 10]), np.array([30, 10, 20, 20]), 30).tolist() == [True, True, False, True]


# 1: quality classifier


def kneser_ney(texts: list[str], model: kneserney.Model) -> object:
    """The same model by plain counting."""
    order = kneserney.ORDER
    counts: dict[int, Counter] = {order: Counter()}
    for t in texts:
        s = (kneserney.BOUNDARY,) * (order - 1) + tuple(t.encode())
        counts[order].update(s[i : i + order] for i in range(len(t.encode())))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discounts = {n: kneserney._discounts(Counter(c.values())) for n, c in counts.items()}

    def p(gram: tuple) -> float:
        n = len(gram)
        if n == 0:
            return model.unseen
        same = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        if not same:
            return p(gram[1:])
        total, d = sum(same.values()), discounts[n]
        taken = sum(d[min(c, 3) - 1] for c in same.values())
        a = counts[n][gram]
        return max(a - (d[min(a, 3) - 1] if a else 0), 0) / total + taken / total * p(gram[1:])

    return p


def test_perplexity_equals_plain_counting(spark):
    rng = random.Random(8)
    train = [prose(rng, 12) for _ in range(6)]
    model = kneserney.Model(spark.createDataFrame([(t,) for t in train], "text string"))
    p = kneser_ney(train, model)
    tests = [(1, train[0], "en"), (2, "zzz unseen ☃ 日本", "en"), (3, "", None), (4, None, None), (5, "al", "en")]
    docs = spark.createDataFrame(tests, "doc_id long, text string, lang string")
    for limit in (10**6, 0):
        got = by_id(kneserney.perplexities(docs, model, limit))
        for doc_id, text, _ in tests:
            if not text:
                assert got[doc_id]["log_ppl"] is None
                continue
            s = (kneserney.BOUNDARY,) * (kneserney.ORDER - 1) + tuple(text.encode())
            expected = -sum(math.log(p(s[i : i + kneserney.ORDER])) for i in range(len(text.encode()))) / len(text)
            assert got[doc_id]["log_ppl"] == pytest.approx(expected, rel=1e-9)


def test_classifier_keeps_like_texts(spark, empty):
    rng = random.Random(3)
    rows = [(k, prose(rng, 40), "en") for k in range(120)] + [(1000 + k, "".join(rng.choices("#@!§ÞÆqzXJ", k=200)), "en") for k in range(10)]
    docs = spark.createDataFrame([(a, b, c, "s", 0) for a, b, c in rows], DOCS)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(80)] + [(1000, 0, 0), (None, 1, None), (3, None, None)], "doc_id long, quality int, toxic int")
    got = by_id(kneserney.classify(docs, labels))
    assert all(got[k]["kept"] for k in range(120)) and not any(got[1000 + k]["kept"] for k in range(10))
    assert kneserney.keep(docs, labels).count() == 120 and kneserney.keep(docs, labels).schema == docs.schema
    assert kneserney.classify(empty, labels).count() == 0
    assert kneserney.classify(docs, labels.where("false")).where("kept").count() == 130


def test_classifier_hands_each_text_on_once_and_in_small_batches(spark, monkeypatch):
    asked, real = [], kneserney.perplexities
    monkeypatch.setattr(kneserney, "perplexities", lambda rows, *a, **b: asked.append(rows) or real(rows, *a, **b))
    rng = random.Random(11)
    docs = spark.createDataFrame([(k, prose(rng, 40), "en", "s", k) for k in range(60)], DOCS)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(50)], "doc_id long, quality int, toxic int")
    kept = kneserney.keep(docs, labels)
    assert kept.schema == docs.schema and {r["doc_id"]: r for r in docs.collect()}.items() >= by_id(kept).items() and kept.count() > 40
    assert asked[0].schema.simpleString().count("text:") == 1

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], ["n"])

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting, None)
    large = spark.range(0, 12, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    found = [r["n"] for r in common.streamed(large.mapInArrow(sizes, "n long"), "sizes").collect()]
    assert len(found) > 1 and max(found) <= common.BATCH_BYTES + (2 << 20)
    assert spark.conf.get(setting, None) == before


def test_classifier_finds_a_few_odd_words_in_long_texts(spark):
    rng = random.Random(12)
    odd = lambda: prose(rng, 150) + " Qwrtzky " + prose(rng, 150)
    rows = [(k, prose(rng, 300), "en") for k in range(200)] + [(1000 + k, odd(), "en") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(150)] + [(1000 + k, 1, 1) for k in range(15)], "doc_id long, quality int, toxic int")
    got = by_id(kneserney.classify(docs, labels))
    assert not any(got[1000 + k]["kept"] for k in range(30)) and sum(got[k]["kept"] for k in range(200)) >= 190


def test_local_perplexity_by_either_way(spark):
    rng = random.Random(9)
    model = kneserney.Model(spark.createDataFrame([(prose(rng, 60),)], "text string"))
    docs = spark.createDataFrame([(1, prose(rng, 30), "en"), (2, "zz", None), (None, "zz ☃", "en"), (4, "", "en"), (5, prose(rng, 9) + "~~~~" + prose(rng, 9), "en")], "doc_id long, text string, lang string")
    one, two = (by_id(kneserney.perplexities(docs, model, limit)) for limit in (10**6, 0))
    assert one[4]["log_local"] is None and one[2]["log_local"] == pytest.approx(one[2]["log_ppl"])
    for k in (1, 2, None, 5):
        assert two[k]["log_local"] == pytest.approx(one[k]["log_local"]) and two[k]["log_ppl"] == pytest.approx(one[k]["log_ppl"])


def plain_limits(marked: list[tuple], quantile: float, margin: float) -> dict:
    """The limit of each language, and of all under None, by plain loops over all levels."""
    good = {k: sorted(v for lang, v, bad in marked if not bad and k in (None, lang)) for k in [None, *{m[0] for m in marked}]}
    middle = {k: v[(len(v) - 1) // 2] if v else None for k, v in good.items()}
    offset = [(lang, math.floor((v - (middle[lang] if good[lang] else middle[None])) * kneserney.BINS), bad) for lang, v, bad in marked]
    out = {}
    for k in good:
        if not good[k]:
            continue
        weight = lambda lang, k=k: 1.0 if k is None else (lang == k) + kneserney.PRIOR / len(good[None])
        bins = sorted({b for lang, b, _ in offset if weight(lang)})
        cost = [sum(weight(lang) for lang, b, bad in offset if bad and b <= x) + kneserney.FOLDS * sum(weight(lang) for lang, b, bad in offset if not bad and b > x) for x in bins]
        best = max(i for i, c in enumerate(cost) if round(c, 6) == round(min(cost), 6))
        if best + 1 < len(bins):
            level = (bins[best] + 1 + bins[best + 1]) / (2 * kneserney.BINS)
        else:
            total = sum(weight(lang) for lang, _, bad in offset if not bad)
            reached = next(x for x in bins if sum(weight(lang) for lang, b, bad in offset if not bad and b <= x) >= quantile * total - 1e-6)
            level = (reached + 1) / kneserney.BINS + margin
        out[k] = (middle[k] if k is not None else middle[None]) + level
    return out


@pytest.mark.parametrize("bad", [0, 12])
def test_limits_equal_plain_counting(spark, bad):
    rng = random.Random(4)
    marked = [(lang, rng.gauss(2 + at, 0.1), False) for lang, at, n in (("=a", 0, 60), ("=b", 1, 7), ("=c", 3, 1)) for _ in range(n)]
    marked += [(lang, rng.gauss(2.5 + at, 0.2), True) for lang, at in (("=a", 0), ("=b", 1), ("=d", 0)) for _ in range(bad)]
    own, rest = kneserney._limits(spark.createDataFrame(marked, "lang_key string, log_ppl double, bad boolean"), "log_ppl", 0.95, 0.1)
    expected = plain_limits(marked, 0.95, 0.1)
    assert rest == pytest.approx(expected.pop(None))
    assert {r["lang_key"]: r["log_ppl_limit"] for r in own.collect()} == pytest.approx(expected)


def test_verdicts_follow_the_limits_of_each_language(spark):
    rng = random.Random(21)
    rows = [(k, prose(rng, 30), ("en", "de", None)[k % 3]) for k in range(90)] + [(100 + k, "".join(rng.choices("qxzj#", k=80)), "de") for k in range(6)] + [(None, prose(rng, 20), "fr"), (None, "", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_key", F.lit("clash"))
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)] + [(100, 0, 1)], "doc_id long, quality int, toxic int")
    got = kneserney.classify(docs, labels).collect()
    assert len({r["threshold"] for r in got if r["lang"] != "fr"}) == 3
    for r in got:
        assert r["kept"] == (r["perplexity"] is not None and r["perplexity"] <= r["threshold"] and r["local_perplexity"] <= r["local_threshold"])
    kept = kneserney.keep(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)


# 2: quality rules


def brute_statistics(text: str | None) -> tuple:
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_statistics(docs, rows, empty):
    got = by_id(outliers.score(docs))
    for doc_id, text, *_ in rows:
        n, chars, symbols, lines, repeats = brute_statistics(text)
        r = got[doc_id]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats), text
        assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n)
        assert not (r["base_failed"] and r["kept"])
    assert outliers.score(empty).count() == 0


def plain_mcd(z: np.ndarray, ridge: np.ndarray, starts: list[np.ndarray]) -> tuple[float, np.ndarray]:
    """The smallest determinant and its distances, by concentration steps over whole bins of log distances."""
    n, p = z.shape
    q = outliers.chi_square_quantile(outliers.SUBSET, p)
    factor = outliers.SUBSET / outliers.chi_square_cdf(q, p + 2)

    def step(mean, cov):
        far = np.einsum("ij,ij->i", z - mean, np.linalg.solve(cov, (z - mean).T).T)
        bins = np.floor(outliers.BINS * np.log(far + 1e-6))
        limit = np.sort(bins)[math.ceil(outliers.SUBSET * n) - 1]
        near = z[bins <= limit]
        return near.mean(0), np.cov(near.T, bias=True) * factor + np.diag(ridge), near

    found = []
    for cov in starts:
        mean = np.zeros(p)
        for _ in range(outliers.STARTING):
            mean, cov, _ = step(mean, cov)
        found.append((np.linalg.slogdet(cov)[1], mean, cov))
    det, mean, cov = min(found, key=lambda x: x[0])
    for _ in range(outliers.MOST_STEPS - outliers.STARTING):
        mean, cov, _ = step(mean, cov)
        before, det = det, np.linalg.slogdet(cov)[1]
        if abs(det - before) < outliers.STILL:
            break
    return mean, cov


def test_estimates_equal_plain_concentration(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(801, 5)) @ np.diag([1, 0.3, 0.5, 0.4, 0.2]) @ (np.eye(5) + 0.3 * rng.normal(size=(5, 5))) + 3
    x[:120] += 6
    got = outliers.fit(spark.createDataFrame([("k", *row) for row in x.tolist()], "key string, x0 double, x1 double, x2 double, x3 double, x4 double")).first()
    middle = np.sort(x, 0)[400]
    scale = np.sqrt((1.4826 * np.sort(np.abs(x - middle), 0)[400]) ** 2 + np.square(outliers.FLOORS))
    z, ridge = (x - middle) / scale, np.square(outliers.FLOORS / scale)
    unit = z / np.sqrt((z * z).sum(1, keepdims=True) + 1e-12)
    mean, cov = plain_mcd(z, ridge, [np.eye(5), np.tanh(z).T @ np.tanh(z) / 801 + np.diag(ridge), 5 * unit.T @ unit / 801 + np.diag(ridge)])
    root = np.array([[got[f"l{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    assert np.allclose([got[f"m{i}"] for i in range(5)], middle + scale * mean, atol=1e-3)
    assert np.allclose(root @ root.T, cov * np.outer(scale, scale), atol=2e-3)
    assert abs(np.median(x[120:], 0) - [got[f"m{i}"] for i in range(5)]).max() < 0.2


def test_tails_of_f():
    assert outliers.f_tail(2.852409, 5, 16) == pytest.approx(0.05, abs=1e-5) and outliers.f_tail(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-5)
    assert outliers.cutoff(1e-6, 3000, 5) == pytest.approx(outliers.cutoff(1e-6, 10**6, 5), rel=0.02)


def test_statistics_can_be_filtered(spark):
    docs = spark.createDataFrame([(1, "a b c " * 200 + "\nline\nline"), (2, "one two three")], "doc_id long, text string")
    assert [r["doc_id"] for r in outliers.with_statistics(docs).where("n_repeat_words > 10 and n_dup_lines > 0").collect()] == [1]


def test_repetition_alone_is_an_outlier(spark):
    rng = random.Random(18)
    words = [f"{rng.choice('abcdefgh')}{k}ord" for k in range(3000)]
    lines = lambda n: [" ".join(rng.choices(words, k=9)) for _ in range(n)]
    rows = [(k, "\n".join(lines(rng.randint(8, 40))), "en" if k % 2 else None, None) for k in range(120)] + [(None, "\n".join(lines(9)), None, None)]
    odd = lines(12)
    rows += [(500, "\n".join([*odd, *["read more of it"] * 14]), "en", None)]
    got = by_id(outliers.score(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    assert not got[500]["kept"] and not got[500]["base_failed"] and all(got[k]["kept"] for k in [*range(120), None])


def test_outliers_go_and_the_rest_stays(spark):
    rng = random.Random(6)
    vocabulary = [f"{rng.choice('abcdefgh')}{k}ord" for k in range(3000)]
    rows = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(60, 400))), "en", f"s{k % 2}", 0) for k in range(400)]
    rows += [(1000 + k, " ".join(w + "###" for w in rng.choices(vocabulary, k=120)), "en", "s0", 0) for k in range(60)]
    got = by_id(outliers.score(spark.createDataFrame(rows, DOCS)))
    assert sum(got[k]["kept"] for k in range(400)) >= 398 and not any(got[1000 + k]["kept"] for k in range(60))


def test_chi_square():
    assert outliers.chi_square_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)


# pipeline


def test_pipeline(spark, rows):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before, passed = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            from tidemark.llm import common

            before = common.materialise(out, "stage")
            passed[name] = {r["doc_id"] for r in before.select("doc_id").collect()}
        else:
            assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == passed["suffix-array dedup"]
    clean = {d for d, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0}
    toxic = {d for d, r in labels.items() if r["toxic"] == 1}
    assert len(clean & passed["quality classifier"]) >= 0.9 * len(clean) and len(toxic & passed["quality classifier"]) <= 0.5 * len(toxic)
    assert passed["n-gram Jaccard join"] <= passed["quality rules"] <= passed["quality classifier"]


# the queries that SQL can express


@pytest.mark.parametrize("name", ["op4_suffix_array_dedup", "op5_ngram_jaccard_join", "op10_warc_boundary_chain"])
def test_equals_sql(spark, name):
    import oracle

    from tidemark.llm.oracles import ORACLES
    from tidemark.llm.queries import QUERIES

    assert set(ORACLES) == {"op4_suffix_array_dedup", "op5_ngram_jaccard_join", "op10_warc_boundary_chain"}
    folder = "/root/testdata/sf0.001"
    assert oracle.difference(QUERIES[name](spark, folder), oracle.connect(folder), ORACLES[name]) is None


def test_forget_gives_the_drivers_memory_back(spark):
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    options = jvm.java.lang.management.ManagementFactory.getPlatformMXBean(jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean"))
    ratios = lambda: [options.getVMOption(f"{x}HeapFreeRatio").getValue() for x in ("Min", "Max")]
    own = ratios()
    held = jvm.java.lang.StringBuilder()
    held.ensureCapacity(1 << 30)
    grown = runtime.totalMemory()
    assert grown > 1 << 30
    held.trimToSize()
    common.forget(spark)
    total = runtime.totalMemory()
    assert total - runtime.freeMemory() > 0.5 * total and total < grown / 2 and ratios() == own
    assert "Trim native heap" in common.trim(spark)


def test_each_stage_begins_with_a_driver_that_forgot_the_last(spark, monkeypatch):
    import corpus_pipeline

    said = []
    monkeypatch.setattr(common, "forget", lambda s: said.append("forgot"))
    noted = corpus_pipeline.stage(lambda s, docs, sf_dir: said.append("ran") or docs)
    assert noted(spark, "docs", "") == "docs" and said == ["forgot", "ran"]

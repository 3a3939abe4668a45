"""Quality classifier: an interpolated modified Kneser-Ney model over the bytes of texts (operator 1).

The model is trained on trusted texts, a bounded sample of the labelled documents (TRAIN_DOCS). N-grams of ORDER bytes of UTF-8, so that no
character of any script is merged with another, are counted, lower orders get continuation counts, and three discounts per order follow
from the counts of counts; all of this, and the interpolated probabilities, are joins of count tables sharded by n-gram or
context. The distinct n-grams of all documents are then joined with these tables, suffix by suffix, which gives each its
probability, seen in training or not. A document's perplexity is the exponential of its negative log probability per character, over its
whole text. A table of up to BROADCAST_GRAMS n-grams goes to the workers; a larger one is joined with the distinct n-grams of blocks of
documents. Its local perplexity is that of its least likely LOCAL bytes in a row, which a few odd words raise however long the text is.

A document is kept if neither its local perplexity nor that of its whole text is beyond a limit of its language: a quantile of the
language's held-out trusted documents (one of FOLDS folds). The labels set the level of each, first of the local one and then, among
documents within it, of the other: it is where the fewest labelled documents are on the wrong side, counting those labelled bad or toxic
(none of them is trained on) and, FOLDS times, the held-out trusted ones, and lies halfway to the next labelled document. Where no
level tells any bad document from the trusted ones, or none is labelled, it is QUANTILE, with MARGIN added to the limit. Documents
count by their distance from the median of their language's held-out trusted ones. Beside its own, a language counts those of all
languages, weighed as PRIOR trusted documents, so that one with few labels has a level too; one without any trusted document has
the limit of all. The levels come from histograms.

Defined results: a null or empty text has no perplexity and is not kept; without any trusted text there is no perplexity
and every document with a character is kept; null languages are a language; repeated rows and null doc_ids each get their row
and are judged alone; repeated or null labels count where one of them is trusted; other columns are ignored (`keep` keeps them).
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common, kernels

ORDER = 5
BITS = 8
#: Before a text's first byte; no UTF-8 text holds this one.
BOUNDARY = 0xFF
TRAIN_DOCS = 4000
BROADCAST_GRAMS = 4_000_000
BROADCAST_LANGUAGES = 10_000
QUANTILE = 0.995
MARGIN = 0.1
PRIOR = 50
LOCAL = 8
BLOCK_TEXT = 16 << 20
CHUNK_TEXT = 512 << 10
#: One fold of the trusted documents sets the thresholds and takes no part in training.
FOLDS = 4
BINS = 256


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The distinct ids of documents labelled good and not toxic."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return good.select(F.col("doc_id").cast("long").alias("trusted_id")).distinct()


def bad_ids(labels: DataFrame, trusted: DataFrame) -> DataFrame:
    """The distinct ids of documents labelled bad or toxic and nowhere trusted."""
    bad = labels.where(((F.col("quality") == 0) | (F.col("toxic") == 1)) & F.col("doc_id").isNotNull())
    bad = bad.select(F.col("doc_id").cast("long").alias("bad_id")).distinct()
    return bad.join(trusted, F.col("bad_id") == F.col("trusted_id"), "left_anti")


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte, the n + 1 row bounds, and the number of characters of each row."""
    data, bounds = kernels.utf8(column)
    key, starts = data.astype(np.int64), bounds[:-1]
    for k in range(1, ORDER):
        earlier = np.full(len(data), BOUNDARY, np.uint8)
        earlier[k:] = data[:-k]
        for j in range(k):  # the row's first bytes have no byte so far before them
            at = starts + j
            earlier[at[at < bounds[1:]]] = BOUNDARY
        key |= earlier.astype(np.int64) << (BITS * k)
    characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
    return key, bounds, np.diff(characters)


def _distinct_grams(texts: DataFrame) -> DataFrame:
    """gram and its number of occurrences; tasks merge what their chunks hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernels.release()
        held, waiting = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, n = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            new = np.flatnonzero(np.diff(keys, prepend=-1))
            return keys[new], np.add.reduceat(n, new)

        for chunk in kernels.chunks(batches, limit=CHUNK_TEXT):
            key, _, _ = grams(chunk.column("text"))
            if len(key):
                held.append(np.unique(key, return_counts=True))
                waiting += len(held[-1][0])
            if waiting > 1_500_000:
                held = [merged()]
                waiting = len(held[0][0])
                if waiting > 1_000_000:
                    yield pa.record_batch([pa.array(held[0][0]), pa.array(held[0][1])], ["gram", "a"])
                    held, waiting = [], 0
        if held:
            key, n = merged()
            yield pa.record_batch([pa.array(key), pa.array(n)], ["gram", "a"])

    return texts.select("text").mapInArrow(run, "gram long, a long").groupBy("gram").agg(F.sum("a").alias("a"))


def _suffix(order: int) -> Column:
    return F.col("gram").bitwiseAND(F.lit((1 << BITS * order) - 1))


def _discounts(counts: dict[int, int]) -> list[float]:
    """D1, D2 and D3+ from the counts of counts, within 0 and the count."""
    n = [counts.get(k, 0) for k in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return [min(k - 0.01, max(0.05, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] and n[k] else 0.5 * k for k in (1, 2, 3)]


class Model:
    """Per order the tables (gram, p) and (context, gamma), as DataFrames in the shared folder."""

    def __init__(self, texts: DataFrame) -> None:
        texts = common.materialise(texts.select("text"), "trusted")
        counts = {ORDER: common.streamed(_distinct_grams(texts), "grams")}
        self.empty = counts[ORDER].isEmpty()
        for order in range(ORDER - 1, 0, -1):
            longer = counts[order + 1]
            counts[order] = common.materialise(longer.select(_suffix(order).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("a")), "grams")
        self.probability: dict[int, DataFrame] = {}
        self.backoff: dict[int, DataFrame] = {}
        self.unseen = 1.0 / (1 << BITS)
        for order in range(1, ORDER + 1):
            rows = counts[order].where("a <= 4").groupBy("a").agg(F.count(F.lit(1)).alias("n")).collect()
            d1, d2, d3 = _discounts({r["a"]: r["n"] for r in rows})
            context = F.shiftright("gram", BITS)
            tally = lambda c: F.sum(c.cast("double"))
            a = F.col("a")
            sums = counts[order].groupBy(context.alias("context")).agg(F.sum("a").alias("total"), (d1 * tally(a == 1) + d2 * tally(a == 2) + d3 * tally(a >= 3)).alias("taken"))
            sums = sums.select("context", "total", (F.col("taken") / F.col("total")).alias("gamma"))
            discount = F.when(a == 1, d1).when(a == 2, d2).otherwise(d3)
            joined = counts[order].withColumn("context", context).join(sums, "context")
            if order == 1:
                lower = F.lit(self.unseen)
            else:
                shorter = self.probability[order - 1].select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
                joined, lower = joined.withColumn("suffix", _suffix(order - 1)).join(shorter, "suffix"), F.col("lower")
            p = F.greatest(a - discount, F.lit(0.0)) / F.col("total") + F.col("gamma") * lower
            self.probability[order] = common.materialise(joined.select("gram", p.alias("p")), f"p{order}")
            self.backoff[order] = common.materialise(sums.select("context", "gamma"), f"gamma{order}")

    def log_probabilities(self, wanted: DataFrame) -> DataFrame:
        """gram and logp (natural) of every wanted n-gram, by joins from the shortest suffixes up."""
        below = None
        for order in range(1, ORDER + 1):
            asked = wanted.select(_suffix(order).alias("gram")).distinct()
            gamma = self.backoff[order].withColumnRenamed("context", "of")
            joined = asked.join(self.probability[order], "gram", "left").join(gamma, F.shiftright("gram", BITS) == F.col("of"), "left")
            lower = F.lit(self.unseen)
            if below is not None:
                joined, lower = joined.withColumn("suffix", _suffix(order - 1)).join(below, "suffix"), F.col("below")
            found = joined.select(F.col("gram").alias("suffix"), F.coalesce("p", F.coalesce("gamma", F.lit(1.0)) * lower).alias("below"))
            below = common.materialise(found, f"score{order}")
        return below.select(F.col("suffix").alias("gram"), F.log("below").alias("logp"))


#: What the operators below add to the rows that they are given.
_JUDGED = [T.StructField("n_chars", T.LongType()), T.StructField("log_ppl", T.DoubleType()), T.StructField("log_local", T.DoubleType())]


def _judged(chunk: pa.RecordBatch, keys: np.ndarray, logs: np.ndarray, kept: list[str]) -> pa.RecordBatch:
    """The columns that are kept, the number of characters of each row, its negative log probability per character, and that per byte of
    its least likely LOCAL bytes in a row (all, if it has fewer)."""
    key, bounds, characters = grams(chunk.column("text"))
    distinct, back = np.unique(key, return_inverse=True)
    total = np.zeros(len(key) + 1)
    if len(key):
        np.cumsum(logs[np.searchsorted(keys, distinct)][back], out=total[1:])
    n = np.diff(bounds)
    some = n > 0
    mean = -(total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(characters, 1)
    local = np.zeros(len(n))
    if len(key):
        ends, at = np.repeat(bounds[1:], n), np.arange(LOCAL, len(key) + LOCAL)
        # windows that the row's end cuts short are part of its last whole one, whose sum is no smaller
        local[some] = np.maximum.reduceat(total[:-1] - total[np.minimum(at, ends)], bounds[:-1][some]) / np.minimum(n[some], LOCAL)
    return pa.record_batch([*(chunk.column(c) for c in kept), pa.array(characters), pa.array(mean, mask=~some), pa.array(local, mask=~some)], [*kept, "n_chars", "log_ppl", "log_local"])


def perplexities(rows: DataFrame, model: Model, broadcast_grams: int = BROADCAST_GRAMS, with_text: bool = False) -> DataFrame:
    """The rows, without their text unless it is asked for, with n_chars, log_ppl (negative natural log probability per character, null for empty texts) and log_local."""
    wanted = common.streamed(_distinct_grams(rows).select("gram"), "wanted")  # one pass over the texts
    scored = common.materialise(model.log_probabilities(wanted), "logp")
    kept = [f for f in rows.schema if with_text or f.name != "text"]
    schema, kept = T.StructType([*kept, *_JUDGED]), [f.name for f in kept]
    if scored.count() > broadcast_grams:
        return _by_join(rows, scored, schema, kept)
    frame = scored.toArrow()  # 16 bytes a row on the driver, where rows as objects would take many times that
    keys = frame["gram"].to_numpy()
    order = np.argsort(keys)
    known = rows.sparkSession.sparkContext.broadcast((keys[order], frame["logp"].to_numpy()[order]))
    del frame, keys, order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernels.release()
        for chunk in kernels.chunks(batches, limit=CHUNK_TEXT):
            yield _judged(chunk, *known.value, kept)

    return rows.mapInArrow(run, schema)


def _by_join(rows: DataFrame, scored: DataFrame, schema: T.StructType, kept: list[str]) -> DataFrame:
    """The same by a join on the distinct n-grams of each block of documents, which come back to the block's texts."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_TEXT))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    def run(there: pa.Table) -> pa.Table:
        held = [np.unique(grams(chunk.column("text"))[0]) for chunk in kernels.chunks(iter(there.combine_chunks().to_batches()), limit=CHUNK_TEXT)]
        gram = np.unique(np.concatenate(held))
        return pa.table({"block": pa.array(np.full(len(gram), there["block"][0].as_py())), "gram": pa.array(gram)})

    def judge(there: pa.Table, answered: pa.Table) -> pa.Table:
        keys = answered["gram"].to_numpy()
        order = np.argsort(keys)
        keys, logs = keys[order], answered["logp"].to_numpy()[order]
        return pa.Table.from_batches([_judged(chunk, keys, logs, kept) for chunk in kernels.chunks(iter(there.combine_chunks().to_batches()), limit=CHUNK_TEXT)])

    listed = rows.select("block", "text").groupBy("block").applyInArrow(run, "block long, gram long")
    answers = listed.join(scored, "gram").select(F.col("block").alias("to"), "gram", "logp")
    return rows.groupBy("block").cogroup(answers.groupBy("to")).applyInArrow(judge, schema)


def _limits(marked: DataFrame, column: str, quantile: float, margin: float) -> tuple[DataFrame, float]:
    """The limit of each language with trusted documents (lang_key, and the limit named by the column), and that of all others."""
    median = F.percentile_approx(F.when(~F.col("bad"), F.col(column)), 0.5, 10_000)
    middle = marked.groupBy("lang_key").agg(median.alias("middle"), F.sum((~F.col("bad")).cast("long")).alias("own"))
    overall = marked.agg(median.alias("middle"), F.sum((~F.col("bad")).cast("long")).alias("own")).first()
    if not overall["own"]:
        return middle.where("false").select("lang_key", F.lit(math.inf).alias(f"{column}_limit")), math.inf
    middle = common.materialise(middle.select("lang_key", F.coalesce("middle", F.lit(overall["middle"])).alias("middle"), "own"), "medians")
    offset = F.floor((F.col(column) - F.col("middle")) * BINS).alias("bin")
    counts = marked.join(F.broadcast(middle) if middle.count() <= BROADCAST_LANGUAGES else middle, "lang_key").groupBy("lang_key", offset).agg(F.sum(F.col("bad").cast("double")).alias("d"), F.sum((~F.col("bad")).cast("double")).alias("g"))
    counts = common.materialise(counts, "offsets")
    everywhere = counts.groupBy("bin").agg(F.sum("d").alias("d"), F.sum("g").alias("g"))
    # as many rows as a logarithm of perplexities has bins, a few thousand
    histogram = F.from_json(F.lit(json.dumps([r.asDict() for r in everywhere.collect()])), "array<struct<bin long, d double, g double>>")
    weight = F.lit(PRIOR / overall["own"])
    pooled = middle.where("own > 0").select("lang_key", F.explode(histogram).alias("x")).select("lang_key", "x.bin", weight * F.col("x.d"), weight * F.col("x.g"))
    both = counts.join(middle.where("own > 0").select("lang_key"), "lang_key", "left_semi").union(pooled).union(everywhere.select(F.lit(""), "bin", "d", "g"))
    both = both.groupBy("lang_key", "bin").agg(F.sum("d").alias("d"), F.sum("g").alias("g"))
    all_, upto = Window.partitionBy("lang_key"), Window.partitionBy("lang_key").orderBy("bin")
    both = both.withColumns({"total": F.sum("g").over(all_), "reached": F.sum("g").over(upto), "cost": F.round(F.sum("d").over(upto) + FOLDS * (F.sum("g").over(all_) - F.sum("g").over(upto)), 6), "next": F.lead("bin").over(upto)})
    found = both.groupBy("lang_key").agg(
        F.min_by(F.struct("bin", "next"), F.struct("cost", -F.col("bin"))).alias("best"),
        F.min(F.when(F.col("reached") >= quantile * F.col("total") - 1e-6, F.col("bin"))).alias("bin"),
    )
    limit = F.coalesce((F.col("best.bin") + 1 + F.col("best.next")) / (2 * BINS), (F.col("bin") + 1) / BINS + margin)
    found = found.join(middle, "lang_key", "left").select("lang_key", (F.coalesce("middle", F.lit(overall["middle"])) + limit).alias(f"{column}_limit"))
    found = common.materialise(found, "limits")
    return found.where("lang_key <> ''"), found.where("lang_key = ''").first()[1]


def _decided(rows: DataFrame, labels: DataFrame, quantile: float, margin: float, train_docs: int, with_text: bool = False) -> DataFrame:
    """`rows` (doc_id, text, lang_key and what else there is), without their text unless it is asked for, with what the classifier finds and kept."""
    trusted = common.materialise(trusted_ids(labels), "trusted-ids")
    held_out = F.pmod(F.xxhash64("trusted_id", F.lit("fold")), F.lit(FOLDS)) == 0
    sample = trusted.where(~held_out).orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(train_docs)
    texts = rows.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("trusted_id")).where("text <> ''")
    model = Model(texts)
    limits = ["log_ppl_limit", "log_local_limit"]
    if model.empty:
        nothing = {c: F.lit(None).cast("double") for c in ("log_ppl", "log_local", *limits)}
        found = rows.withColumns({"n_chars": F.coalesce(F.char_length("text"), F.lit(0)).cast("long"), **nothing})
        return (found if with_text else found.drop("text")).withColumn("kept", F.col("n_chars") > 0)
    found = common.streamed(perplexities(rows, model, with_text=with_text), "perplexity")
    marks = trusted.where(held_out).select(F.col("trusted_id").alias("mark_id"), F.lit(False).alias("bad")).union(bad_ids(labels, trusted).select("bad_id", F.lit(True)))
    scores = found.where("log_ppl is not null").select("doc_id", "lang_key", "log_ppl", "log_local")
    marked = common.materialise(scores.join(marks, F.col("doc_id") == F.col("mark_id")).select("lang_key", "log_ppl", "log_local", "bad"), "marked")
    few = lambda t: F.broadcast(t) if t.count() <= BROADCAST_LANGUAGES else t
    own, rest = _limits(marked, "log_local", quantile, margin)
    bounded = lambda t: t.join(few(own), "lang_key", "left").withColumn("log_local_limit", F.coalesce("log_local_limit", F.lit(rest)))
    within = bounded(marked).where("log_local <= log_local_limit").drop("log_local_limit")
    found = bounded(found)
    own, rest = _limits(within, "log_ppl", quantile, margin)
    found = found.join(few(own), "lang_key", "left").withColumn("log_ppl_limit", F.coalesce("log_ppl_limit", F.lit(rest)))
    return found.withColumn("kept", F.coalesce((F.col("log_ppl") <= F.col("log_ppl_limit")) & (F.col("log_local") <= F.col("log_local_limit")), F.lit(False)))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold, local_perplexity, local_threshold and kept of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", _lang_key())
    found = _decided(rows, labels, quantile, margin, train_docs)
    shown = [F.exp(c).alias(n) for c, n in (("log_ppl", "perplexity"), ("log_ppl_limit", "threshold"), ("log_local", "local_perplexity"), ("log_local_limit", "local_threshold"))]
    return found.select("doc_id", "lang", "n_chars", *shown, "kept")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps. They stay where they are: each row takes its columns along while it is scored, the text once."""
    rest = F.struct(*(c for c in docs.columns if c != "text")).alias("row")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), _lang_key(), rest)
    found = _decided(rows, labels, QUANTILE, MARGIN, TRAIN_DOCS, with_text=True).where("kept")
    return found.select(*(F.col("text" if c == "text" else f"row.`{c}`") for c in docs.columns))


def _lang_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("~")).alias("lang_key")

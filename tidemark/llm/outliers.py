"""Quality rules by robust multivariate outliers (operator 2), with DataFrame functions only.

Each text gives a vector of transformed statistics. Per language and source, a minimum-covariance-determinant estimate is sought:
the statistics are standardised by their medians and median absolute deviations; three starts (the medians with unit scales, the
covariance of hyperbolic tangents, that of spatial signs) each take STARTING concentration steps, the one with the smallest
determinant goes on until its determinant stands still (or MOST_STEPS). A step fits mean and covariance to the share SUBSET of
rows with the smallest Mahalanobis distances. It is one aggregation of all rows into moments per bin of the log distance (BINS per
unit); the subset is made of whole bins, so that no group is ever sorted or gathered and what follows is as small as the
number of groups. Texts beyond the quantile of 1 - TAIL of the distances of such an estimate (an F distribution whose second
parameter follows the size of the subset) are rejected. Groups of fewer than LEAST rows, five for each statistic, use the estimate of their
language, and languages of fewer that of all rows.

Defined results: a null or empty text has no words and fails the base rules; null languages and sources are groups of their own;
repeated rows and null doc_ids each get their row; other columns are ignored (`keep` keeps them); an empty table
gives no rows. Only rows that pass the base rules enter the estimates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common

SUBSET = 0.75
STARTING = 2
MOST_STEPS = 12
STILL = 1e-3
BINS = 32
LEAST = 25
TAIL = 1e-6
NAMES = ("x0", "x1", "x2", "x3", "x4")
#: The least standard deviation of each statistic: what hardly varies among clean texts does not reject on its own within
#: about six of these.
FLOORS = (0.2, 0.06, 0.2, 0.12, 0.1)
#: Estimates go to the workers up to this many groups (some 300 bytes each); beyond, rows are shuffled to them.
BROADCAST_GROUPS = 20_000
_SPACE = r"[\x20\x09-\x0D]+"
_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
_PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]


def chi_square_cdf(x: float, k: int) -> float:
    """By the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, half = k / 2, x / 2
    term = total = 1 / a
    for n in range(1, 2000):
        term *= half / (a + n)
        total += term
        if term < total * 1e-17:
            break
    return min(1.0, total * math.exp(-half + a * math.log(half) - math.lgamma(a)))


def chi_square_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, k) < p else (low, middle)
    return high


def f_tail(x: float, a: int, b: int) -> float:
    """The probability that an F variable with a and b degrees of freedom exceeds x, by the series of the incomplete beta function."""
    y = b / (b + a * x)  # the tail is that of a beta variable (b / 2, a / 2) below y
    p, q = b / 2, a / 2
    term, total = 1.0, 1 / p
    for n in range(1, 100_000):
        term *= (n - q) / n * y
        total += (add := term / (p + n))
        if abs(add) < abs(total) * 1e-15:
            break
    return total * math.exp(p * math.log(y) + math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q))


def cutoff(tail: float, rows: int, p: int) -> float:
    """The squared distance that an estimate from this many rows leaves to a share `tail` of normal rows."""
    free = rows - p + 1
    if free > 4000:
        return chi_square_quantile(1 - tail, p)
    low, high = 0.0, 1e6
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if f_tail(middle, p, free) > tail else (low, middle)
    return high * p * rows / free


def with_statistics(docs: DataFrame) -> DataFrame:
    """The documents with the statistics of their texts as further columns."""
    n = F.size("_words")
    part = lambda k: F.slice("_words", k, F.greatest(n - 2, F.lit(0)))
    # neighbours stand beside each element, so that no lambda refers to a column that would be computed anew for each
    triples = F.arrays_zip(part(1), part(2), part(3))
    windows = F.transform(triples, lambda x, i: F.struct(F.xxhash64(x["0"], x["1"], x["2"]).alias("h"), i.alias("i")))
    hashes = F.transform("_sorted", lambda x: x["h"])
    none = F.array(F.lit(None).cast("long"))
    around = F.arrays_zip(F.col("_sorted"), F.concat(none, hashes), F.concat(F.slice(hashes, 2, F.greatest(F.size(hashes), F.lit(1))), none))
    twice = F.filter(around, lambda x: x["_sorted"].isNotNull() & ((x["_sorted"]["h"] == x["1"]) | (x["_sorted"]["h"] == x["2"])))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["_sorted"]["i"], x["_sorted"]["i"] + 1, x["_sorted"]["i"] + 2))))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    rows = rows.withColumns({"_words": F.array_remove(F.split("_text", _SPACE), ""), "_lines": lines})
    rows = rows.withColumn("_sorted", F.sort_array(windows))
    return rows.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.size(covered).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
        }
    ).drop("_text", "_words", "_lines", "_sorted")


def _vector() -> dict[str, Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return {
        "x0": F.log(words),
        "x1": F.log(chars / words),
        "x2": F.log1p(F.lit(100.0) * F.col("n_symbols") / chars),
        "x3": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double")),
        "x4": F.sqrt(F.col("n_repeat_words") / words),
    }


def _rooted(rows: DataFrame) -> DataFrame:
    """The lower triangle l00.. of the root of the covariance c00.. of each row and logdet, column by column: an entry is
    computed once and the next ones refer to it."""
    for j in range(len(NAMES)):
        less = lambda i, j=j: F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        rows = rows.withColumn(f"l{j}{j}", F.sqrt(F.greatest(less(j), F.lit(1e-9))))
        rows = rows.withColumns({f"l{i}{j}": less(i) / F.col(f"l{j}{j}") for i in range(j + 1, len(NAMES))}) if j + 1 < len(NAMES) else rows
    return rows.withColumn("logdet", 2 * sum((F.log(f"l{i}{i}") for i in range(1, len(NAMES))), F.log("l00")))


def _with_distance(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The squared Mahalanobis distance `far` of the named columns from the estimate m0.. and l00.., by forward substitution."""
    for i, x in enumerate(names):
        rows = rows.withColumn(f"y{i}", (F.col(x) - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return rows.withColumn("far", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, len(names))), F.col("y0") * F.col("y0")))


_Z = tuple(f"z{i}" for i in range(len(NAMES)))
_ROOT = [f"l{i}{j}" for i, j in _PAIRS]
_ESTIMATE = ["key", "start", "n", "h", *(f"m{i}" for i in range(len(NAMES))), *_ROOT, "logdet"]


def _few(groups: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(groups) if small else groups


def _starts(members: DataFrame, scales: DataFrame) -> DataFrame:
    """Three estimates per key. Only the order of their distances counts, so none is made consistent."""
    length = sum((F.col(z) * F.col(z) for z in _Z[1:]), F.col(_Z[0]) * F.col(_Z[0])) + 1e-12
    tangents = [F.sum(F.tanh(_Z[i]) * F.tanh(_Z[j])).alias(f"t{i}{j}") for i, j in _PAIRS]
    signs = [F.sum(F.col(_Z[i]) * F.col(_Z[j]) / F.col("length")).alias(f"s{i}{j}") for i, j in _PAIRS]
    sums = members.withColumn("length", length).groupBy("key").agg(F.count(F.lit(1)).alias("n"), *tangents, *signs).join(scales.select("key", *(f"r{i}" for i in range(len(NAMES)))), "key")
    ridge = lambda i, j: F.col(f"r{i}") if i == j else F.lit(0.0)
    covariances = [[F.lit(float(i == j)) for i, j in _PAIRS], [F.col(f"t{i}{j}") / F.col("n") + ridge(i, j) for i, j in _PAIRS], [len(NAMES) * F.col(f"s{i}{j}") / F.col("n") + ridge(i, j) for i, j in _PAIRS]]
    of = [F.struct(F.lit(k).alias("start"), *(c.alias(f"c{i}{j}") for c, (i, j) in zip(cov, _PAIRS, strict=True))) for k, cov in enumerate(covariances)]
    rows = sums.select("key", "n", F.explode(F.array(*of)).alias("of")).select("key", "n", F.col("n").alias("h"), "of.*", *(F.lit(0.0).alias(f"m{i}") for i in range(len(NAMES))))
    return _rooted(rows).select(_ESTIMATE)


def _step(members: DataFrame, now: DataFrame, scales: DataFrame, subset: float, small: bool) -> DataFrame:
    """One concentration step of every estimate."""
    far = _with_distance(members.join(_few(now.drop("h", "logdet"), small), "key"), _Z)
    moments = [F.count(F.lit(1)).alias("c"), *(F.sum(z).alias(f"t{i}") for i, z in enumerate(_Z)), *(F.sum(F.col(_Z[i]) * F.col(_Z[j])).alias(f"q{i}{j}") for i, j in _PAIRS)]
    bins = far.withColumn("bin", F.floor(BINS * F.log(F.col("far") + 1e-6)).cast("int")).groupBy("key", "start", "n", "bin").agg(*moments)
    before = F.coalesce(F.sum("c").over(Window.partitionBy("key", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = bins.withColumn("before", before).where(F.col("before") < F.ceil(subset * F.col("n")))
    sums = near.groupBy("key", "start", "n").agg(F.sum("c").alias("h"), *(F.sum(f"t{i}").alias(f"t{i}") for i in range(len(NAMES))), *(F.sum(f"q{i}{j}").alias(f"q{i}{j}") for i, j in _PAIRS))
    sums = sums.join(_few(scales.select("key", *(f"r{i}" for i in range(len(NAMES)))), small), "key").withColumns({f"m{i}": F.col(f"t{i}") / F.col("h") for i in range(len(NAMES))})
    # a subset of normal rows with the smallest distances understates the covariance by this factor
    factor = subset / chi_square_cdf(chi_square_quantile(subset, len(NAMES)), len(NAMES) + 2)
    cov = {f"c{i}{j}": (F.col(f"q{i}{j}") / F.col("h") - F.col(f"m{i}") * F.col(f"m{j}")) * factor + (F.col(f"r{i}") if i == j else F.lit(0.0)) for i, j in _PAIRS}
    return common.materialise(_rooted(sums.withColumns(cov)).select(_ESTIMATE), "estimate")


def fit(rows: DataFrame, subset: float = SUBSET, starting: int = STARTING, most_steps: int = MOST_STEPS, small: bool = True) -> DataFrame:
    """An estimate per key of the vectors in `rows` (key, x0..): h, m0.. and the root l00.. of the covariance. `small`: there are few keys."""
    medians = rows.groupBy("key").agg(*(F.percentile_approx(x, 0.5, 10_000).alias(f"e{i}") for i, x in enumerate(NAMES)))
    medians = common.materialise(medians, "medians")
    spreads = rows.join(_few(medians, small), "key").groupBy("key").agg(*(F.first(f"e{i}").alias(f"e{i}") for i in range(len(NAMES))), *(F.percentile_approx(F.abs(F.col(x) - F.col(f"e{i}")), 0.5, 10_000).alias(f"d{i}") for i, x in enumerate(NAMES)))
    spreads = spreads.withColumns({f"s{i}": F.sqrt(F.pow(1.4826 * F.col(f"d{i}"), F.lit(2.0)) + floor**2) for i, floor in enumerate(FLOORS)})
    scales = common.materialise(spreads.select("key", *(f"e{i}" for i in range(len(NAMES))), *(f"s{i}" for i in range(len(NAMES))), *(F.pow(floor / F.col(f"s{i}"), F.lit(2.0)).alias(f"r{i}") for i, floor in enumerate(FLOORS))), "scales")
    standard = rows.join(_few(scales, small), "key").select("key", *(((F.col(x) - F.col(f"e{i}")) / F.col(f"s{i}")).alias(_Z[i]) for i, x in enumerate(NAMES)))
    members = common.materialise(standard, "members")
    now = common.materialise(_starts(members, scales), "estimate")
    for _ in range(starting):
        now = _step(members, now, scales, subset, small)
    now = now.groupBy("key").agg(F.min_by(F.struct(*_ESTIMATE[1:]), F.struct("logdet", "start")).alias("best")).select("key", "best.*")
    now = common.materialise(now, "estimate")
    for _ in range(most_steps - starting):
        after = _step(members, now, scales, subset, small)
        moved = after.join(now.select("key", F.col("logdet").alias("before")), "key").agg(F.max(F.abs(F.col("logdet") - F.col("before")))).first()[0]
        now = after
        if moved is None or moved < STILL:
            break
    back = now.join(scales, "key")
    means = [(F.col(f"e{i}") + F.col(f"s{i}") * F.col(f"m{i}")).alias(f"m{i}") for i in range(len(NAMES))]
    return common.materialise(back.select("key", "h", *means, *((F.col(f"l{i}{j}") * F.col(f"s{i}")).alias(f"l{i}{j}") for i, j in _PAIRS)), "estimate")


def score(docs: DataFrame, subset: float = SUBSET, tail: float = TAIL, least: int = LEAST, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """doc_id, the statistics, base_failed, distance (squared; null where the base rules fail) and kept of every row."""
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("~"))
    rows = with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.select("doc_id", *_STATS, named("lang").alias("lang_key"), named("source").alias("source_key"), failed.alias("base_failed")).withColumns(_vector())
    rows = common.materialise(rows, "statistics")
    passed = rows.where("not base_failed")
    groups = common.materialise(passed.groupBy("lang_key", "source_key").agg(F.count(F.lit(1)).alias("n")), "groups")
    small = groups.count() <= broadcast_groups
    totals = groups.groupBy("lang_key").agg(F.sum("n").alias("nl"))
    own, language = F.to_json(F.array("lang_key", "source_key")), F.to_json(F.array("lang_key"))
    key = F.when(F.col("n") >= least, own).when(F.col("nl") >= least, language).otherwise(F.lit("[]"))
    groups = common.materialise(groups.join(totals, "lang_key").select("lang_key", "source_key", key.alias("key"), F.array(own, language, F.lit("[]")).alias("levels")), "groups")
    used = groups.select("key").distinct()
    levels = groups.select("lang_key", "source_key", F.explode("levels").alias("key")).join(used, "key", "left_semi")
    estimates = fit(passed.join(_few(levels, small), ["lang_key", "source_key"]).select("key", *NAMES), subset, small=small)
    # the quantile for a power of two of rows, at most those of the subset
    limits = F.array(*(F.lit(cutoff(tail, max(2**k, least // 2), len(NAMES))) for k in range(14)))
    limit = F.element_at(limits, F.least(F.floor(F.log2("h")).cast("int"), F.lit(13)) + 1)
    estimates = estimates.withColumn("limit", limit).drop("h")
    judged = rows.join(_few(groups.drop("levels"), small), ["lang_key", "source_key"], "left").join(_few(estimates, small), "key", "left")
    judged = _with_distance(judged, NAMES).withColumn("distance", F.when(~F.col("base_failed"), F.col("far")))
    return judged.select("doc_id", *_STATS[:-1], "base_failed", "distance", F.coalesce(~F.col("base_failed") & (F.col("distance") <= F.col("limit")), F.lit(False)).alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep; rows that repeat a doc_id stay if one of them is kept, and null doc_ids go."""
    kept = score(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").cast("long") == F.col("kept_id"), "left_semi")

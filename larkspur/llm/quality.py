"""Quality rules on whole texts: base counts and a log-likelihood ratio of hashed n-grams.

Words and pairs of words are hashed into `BUCKETS` buckets. Two multinomials over the buckets are counted over all
documents: the trusted target (labelled good) and the raw corpus. A document's score is the mean over its n-grams of
log(p_target / p_raw), so it doesn't grow with length. Every document is kept or dropped by comparing that score with a
fixed threshold; no random draw is involved. Everything is built-in Spark functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 10_000
#: Documents whose mean log ratio lies below this are dropped. See README for how scores are spread.
THRESHOLD = -0.04
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
#: \t \n \v \f \r and the space
SPACE = "[\\x20\\x09-\\x0D]+"
_BLANKS = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def _grams(words: Column) -> Column:
    """Buckets of the words and of the pairs of neighbours."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    two = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.pmod(F.xxhash64(F.get(words, i), w), F.lit(BUCKETS)).cast("int"))
    return F.concat(one, two)


def _with_words(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("_words", words_of(F.col(f"`{text}`")))


def target_ids(labels: DataFrame, max_rows: int) -> DataFrame:
    """Ids of documents labelled good, about max_rows at most: beyond that a fixed share of them by a hash of the id."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    n = good.count()
    share = min(1.0, max_rows / max(n, 1))
    return good if share == 1.0 else good.where(F.pmod(F.xxhash64("doc_id", F.lit("target")), F.lit(1 << 20)) < int(share * (1 << 20)))


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", max_target_rows: int = 200_000) -> list[float]:
    """log(p_target / p_raw) of each bucket, with one added to every count.

    The raw counts cover all documents. Of the labelled ones, a sample of about max_target_rows at most is the target,
    which bounds the broadcast of their ids. Without any target the ratios are all 0 and the score drops nothing.
    """
    target = F.broadcast(target_ids(labels, max_target_rows).select(F.col("doc_id").alias("_target")))
    grams = _with_words(docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text")), "_text").join(target, F.col("_id") == F.col("_target"), "left")
    grams = grams.select(F.explode(_grams(F.col("_words"))).alias("bucket"), F.col("_target").isNotNull().cast("long").alias("good"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("good")).collect()  # BUCKETS rows at most
    raw, good = [1] * BUCKETS, [1] * BUCKETS
    for r in counts:
        raw[r["bucket"]] += r["raw"]
        good[r["bucket"]] += r["good"]
    if sum(good) == BUCKETS:
        return [0.0] * BUCKETS
    shift = math.log(sum(raw)) - math.log(sum(good))
    return [round(math.log(g) - math.log(r) + shift, 6) for g, r in zip(good, raw, strict=True)]


def judge(docs: DataFrame, ratios: list[float], *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept.

    Null and empty texts have no words, score 0 and fail the base rules. Repeated rows are judged alike, each by itself.
    Columns of docs with these names, or starting with `_`, are replaced. Nothing is shuffled.
    """
    t, words = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.col("_words")
    rows = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
    rows = _with_words(rows, text)
    n = F.size(words) - 2
    windows = F.transform(F.slice(words, 1, F.greatest(n, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    rows = rows.withColumns({"_grams": _grams(words), "_windows": windows})
    # only texts that repeat a window sort them, each beside its position
    order = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_order", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), order))
    o = F.col("_order")
    same = F.filter(o, lambda x, j: F.coalesce(F.get(o, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(o, j + 1)["h"] == x["h"], F.lit(False)))
    rows = rows.withColumn("_at", F.sort_array(F.transform(same, lambda x: x["i"])))
    # positions are sorted: each window adds the words beyond the one before it
    at = F.col("_at")
    covered = F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(3), p - F.coalesce(F.get(at, j - 1), F.lit(-3)))), F.lit(0), lambda acc, x: acc + x)
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, _BLANKS, "")) > 0)
    rows = rows.withColumn("_lines", lines)
    table = F.expr("array(" + ",".join(f"{x!r}D" for x in ratios) + ")")  # folded into one constant
    total = F.aggregate("_grams", F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    rows = rows.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(t, _BLANKS, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "score": F.when(F.size("_grams") > 0, F.round(total / F.size("_grams"), 6)).otherwise(0.0),
    })
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).drop("_words", "_grams", "_windows", "_order", "_at", "_lines")

"""Language identification by interpolated Kneser-Ney character models, one for each learned language.

The models are fitted on a bounded sample of labelled documents (`MAX_ROWS` a language, chosen by a hash of the id). A text
goes to the language with the lowest cross-entropy per character over all its words. It is rejected where that is far above
what held-back documents of that language have (a quantile for each language, and the spread by length).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.charlm import SortedModel, kneser_ney
from larkspur.llm.common import held

ORDER = 5
#: Labelled documents of a language to fit on, about, and to calibrate on.
MAX_ROWS, CALIBRATION_ROWS = 1500, 300
#: A text is rejected if its entropy lies beyond what held-back documents of its language have: above their QUANTILE by
#: more than MARGIN times the distance from their median to it, and SPREADS * spread / sqrt(characters) for chance.
QUANTILE, MARGIN, SPREADS = 0.99, 4.0, 8.0
#: Words whose scores a worker remembers at a time.
MEMORY = 400_000
UNKNOWN = "und"
#: Characters that count towards the confidence at most.
CONFIDENT = 40
_WORDS, _LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")
RESULT = "struct<lang_pred:string,score:double,entropy:double,chars:bigint,rejected:boolean>"


def words_of(text: str | None) -> list[str]:
    """Runs of letters (general category L) in lower case; fractions and circled numbers are none, so they part words."""
    found = _WORDS.findall(text.lower()) if text else []
    return found if all(map(str.isalpha, found)) else [x for w in found for x in _LETTERS.findall(w)]


@dataclass
class LanguageModel:
    model: SortedModel
    limit: np.ndarray
    spread: np.ndarray


class _Scorer:
    """Scores texts with remembered words."""

    def __init__(self, fitted: LanguageModel) -> None:
        self.fitted = fitted
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.fitted.model.classes) + 1))

    def score(self, texts: list[str | None]) -> list[dict]:
        index, first, ids = self.index, len(self.index), []
        for text in texts:
            ids.append(np.fromiter((index.setdefault(w, len(index)) for w in words_of(text)), np.int64))
        if len(index) > first:
            new = list(index)[first:]
            own = np.fromiter((len(w) + 1 for w in new), float, len(new))
            self.rows = np.concatenate([self.rows, np.column_stack([self.fitted.model.word_logs(new), own])])
        out = [self._verdict(i) for i in ids]
        if len(index) > MEMORY:
            self.reset()
        return out

    def _verdict(self, ids: np.ndarray) -> dict:
        if not len(ids) or not self.fitted.model.classes:
            return {"lang_pred": UNKNOWN, "score": 0.0, "entropy": None, "chars": 0, "rejected": True}
        sums = self.rows[ids].sum(axis=0)
        entropy = -sums[:-1] / sums[-1]
        best = int(entropy.argmin())
        p = 1 / np.exp((entropy[best] - entropy) * min(sums[-1], CONFIDENT)).sum()
        f = self.fitted
        limit = f.limit[best] + SPREADS * f.spread[best] / np.sqrt(sums[-1])
        return {"lang_pred": f.model.classes[best], "score": round(float(p), 6), "entropy": float(entropy[best]), "chars": int(sums[-1]), "rejected": bool(entropy[best] > limit)}


def predicted(text: Column, spark, fitted: LanguageModel) -> Column:
    shared = spark.sparkContext.broadcast(fitted)

    @F.arrow_udf(RESULT)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held("language", lambda: None)  # what another operator left in this worker goes; the scorer itself goes with its task
        scorer = _Scorer(shared.value)
        kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("entropy", pa.float64()), ("chars", pa.int64()), ("rejected", pa.bool_())])
        for batch in batches:
            rows: list[dict] = []
            for a in range(0, len(batch), 500):
                rows += scorer.score(batch.slice(a, 500).to_pylist())
            yield pa.array(rows, kind)

    return predict(text)


def _split(text: str) -> Column:
    @F.arrow_udf("array<string>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([words_of(x) for x in batch.to_pylist()], pa.list_(pa.string()))

    return split(F.col(text))


def fit(train: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", max_rows: int = MAX_ROWS) -> LanguageModel:
    """Models of the languages in train. Rows with null text or language are left out; without any, no language is known."""
    rows = train.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageModel(SortedModel([], np.zeros(0)), np.zeros(0), np.zeros(0))
    place = F.pmod(F.xxhash64(F.col("id"), F.lit("language")), F.lit(1 << 30))

    def limit(n: int) -> Column:
        shares = [x for k, v in sorted(sizes.items()) for x in (F.lit(k), F.lit(int(min(1.0, n / v) * (1 << 30))))]
        return F.create_map(*shares)[F.col("lang")]

    wanted = max_rows + CALIBRATION_ROWS
    # a fixed share of the sample is held back for calibration, unless a language has too few documents
    part = F.when(F.pmod(F.xxhash64(F.col("id"), F.lit("held back")), F.lit(wanted)) < CALIBRATION_ROWS, "calibrate").otherwise("fit")
    sample = rows.where(place < limit(wanted)).withColumn("part", part)
    counted = sample.where("part = 'fit'").select("lang", F.explode(_split("text")).alias("word")).groupBy("lang", "word").count().toArrow().to_pydict()
    by: dict[str, tuple[list[str], list[int]]] = {}
    for language, word, n in sorted(zip(counted["lang"], counted["word"], counted["count"], strict=True)):
        words, counts = by.setdefault(language, ([], []))
        words.append(word)
        counts.append(n)
    if not by:
        return LanguageModel(SortedModel([], np.zeros(0)), np.zeros(0), np.zeros(0))
    model = kneser_ney({k: (w, np.array(c)) for k, (w, c) in by.items()}, ORDER)
    n = len(model.classes)
    fitted = LanguageModel(model, np.full(n, np.inf), np.zeros(n))
    seen = sample.where("part = 'calibrate'").withColumn("p", predicted(F.col("text"), train.sparkSession, fitted)).where("p.lang_pred = lang")
    # some CALIBRATION_ROWS rows a language
    found: dict[str, list[tuple[float, int]]] = {}
    for r in seen.select("lang", F.col("p.entropy").alias("e"), F.col("p.chars").alias("c")).collect():
        found.setdefault(r["lang"], []).append((r["e"], r["c"]))
    for language, pairs in found.items():
        k, (e, c) = model.classes.index(language), np.array(pairs).T
        middle, high = np.quantile(e, [0.5, QUANTILE])
        fitted.limit[k] = high + MARGIN * (high - middle)
        fitted.spread[k] = np.sqrt(np.mean((e - e.mean()) ** 2 * c))
    return LanguageModel(fitted.model, fitted.limit, fitted.spread)


def identify(docs: DataFrame, fitted: LanguageModel, *, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (confidence), entropy, chars and rejected.

    Null texts and those without a letter are `und` with score 0 and are rejected; so are all where no language is known. Other texts get the nearest language,
    rejected or not. Repeated rows get the same; an empty table stays empty. Columns of docs with these names are replaced.
    """
    rows = docs.drop("lang_pred", "score", "entropy", "chars", "rejected").withColumn("_p", predicted(F.col(f"`{text}`"), docs.sparkSession, fitted))
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != "_p"], "_p.*")

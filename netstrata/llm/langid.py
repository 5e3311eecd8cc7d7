"""Language identification by interpolated Kneser-Ney character models, one column per language of a shared table.

Training counts words of each language over all its training texts in Spark, cuts distinct words into grams of at most
``ORDER`` characters, sums again and smooths all grams there (``charmodel``); nothing is pruned. A text is cut at blanks and
its words, letters only and made small, are scored once each; the language with the lowest cross-entropy for each character
wins. The score is its softmax share at a fixed sharpness. Rejection is calibrated on all labelled texts of one fold that
the model hasn't seen: for each language, the cross-entropy that nearly all texts predicted as it stay below. A text goes
if its own is above that, with an allowance for short texts; a language without calibration texts takes the largest limit.

Nulls and odd input: a null text, and one without letters, gets ``und``, score 0 and is rejected. With no labelled text
at all every text gets ``und``. Ties go to the language that sorts first. Repeated rows get equal results. Very long texts
take memory in proportion in the task that reads them. An empty table gives no rows. Other columns of the input are kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .charmodel import Model, count_units, kneser_ney
from .common import keeps_columns, kept, materialise, slices, table

ORDER = 4
#: Entries that a task counts before it passes them on.
FLUSH = 200_000
#: Rejection: the fold it is calibrated on, letters a text must have for that, the share that must pass, and the allowance.
CALIBRATION_FOLD, FEWEST_LETTERS, CALIBRATION_QUANTILE, SHORT_ALLOWANCE = 4, 50, 0.999, 4.0
SHARPNESS = 6.0
UNKNOWN = "und"
KNOWN_WORDS = 200_000


def letters(word: str) -> str:
    return "".join(c for c in word.lower() if c.isalpha()) if not word.isalpha() else word.lower()


def _counts(batches: Iterator[pa.RecordBatch], add, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Partial counts of (label, key); add(counter, batch) counts a batch."""

    def flushed() -> pa.RecordBatch:
        rows = [(label, key, n) for (label, key), n in counter.items()]
        columns = list(zip(*rows, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names)

    counter: Counter = Counter()
    for batch in slices(batches):
        add(counter, batch)
        if len(counter) > FLUSH:
            yield flushed()
            counter.clear()
    yield flushed()


def word_counts(texts: DataFrame) -> DataFrame:
    """(label, unit, n) from texts(label, text): how often each word of letters stands in the texts of a label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def add(counter: Counter, batch: pa.RecordBatch) -> None:
            own: dict[str, Counter] = {}
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own.setdefault(label, Counter()).update(text.split())
            for label, words in own.items():
                for word, n in words.items():
                    if unit := letters(word):
                        counter[label, unit] += n

        return _counts(batches, add, ["label", "unit", "n"])

    parts = texts.select("label", "text").mapInArrow(count, "label string, unit string, n long")
    return parts.groupBy("label", "unit").agg(F.sum("n").alias("n"))


def gram_counts(units: DataFrame, order: int) -> DataFrame:
    """(label, gram, n) from units(label, unit, n)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def add(counter: Counter, batch: pa.RecordBatch) -> None:
            rows = zip(*(batch.column(c).to_pylist() for c in ("label", "unit", "n")), strict=True)
            counter.update(count_units({(label, unit): n for label, unit, n in rows}, order))

        return _counts(batches, add, ["label", "gram", "n"])

    return units.mapInArrow(count, "label string, gram string, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))


def train(texts: DataFrame, order: int = ORDER) -> Model | None:
    """The model of texts(label, text) without nulls; None if there is no letter in them."""
    counts = materialise(gram_counts(word_counts(texts), order), "gram-counts")
    labels = sorted(r["label"] for r in counts.select("label").distinct().collect())
    return kneser_ney(counts, order, labels) if labels else None


class Scorer:
    """Cross-entropies of texts; remembers about ``limit`` words that it has scored."""

    def __init__(self, model: Model, limit: int = KNOWN_WORDS):
        self.model, self.limit = model, limit
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, len(model.labels) + 1), np.float64)

    def _learn(self, words: list[str]) -> None:
        units = [letters(word) for word in words]
        first, need = len(self.place), len(self.place) + len(words)
        if need > len(self.rows):
            self.rows = np.concatenate([self.rows[:first], np.zeros((max(need, 2 * len(self.rows)) - first, self.rows.shape[1]))])
        self.rows[first:need] = 0
        some = np.array([i for i, unit in enumerate(units) if unit], np.int64)
        if len(some):
            sums, sizes = self.model.score([units[i] for i in some])
            self.rows[first + some] = np.c_[sums, sizes]
        self.place.update(zip(words, range(first, need), strict=True))

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, labels) mean negative log probability of a character, and the number of characters (0: no letter)."""
        totals = np.zeros((len(texts), self.rows.shape[1]))
        held: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            words = (text or "").split()
            for at in range(0, len(words), self.limit):
                part = words[at : at + self.limit] if len(words) > self.limit else words
                if size + len(part) > self.limit:
                    self._add(totals, held)
                    held, size = [], 0
                held.append((i, part))
                size += len(part)
        self._add(totals, held)
        sizes = totals[:, -1]
        return -totals[:, :-1] / np.maximum(sizes, 1)[:, None], sizes

    def _add(self, totals: np.ndarray, parts: list[tuple[int, list[str]]]) -> None:
        """Add the scores of each part's words, at most ``limit`` in all, to its row of totals."""
        if len(self.place) > self.limit:
            self.place.clear()
        if new := list({word for _, words in parts for word in words if word not in self.place}):
            self._learn(new)
        for i, words in parts:
            totals[i] += self.rows[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))].sum(axis=0)


class _Held:
    """A broadcast model and a number that tells it from others."""

    def __init__(self, spark: SparkSession, model: Model):
        self.broadcast = spark.sparkContext.broadcast(model)
        self.id = self.broadcast._jbroadcast.id() if self.broadcast._jbroadcast is not None else id(model)

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self) -> Model:
        return self.broadcast.value


@keeps_columns("_lang", "_score", "_entropy", "_letters")
def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """The input's columns with _lang, _score, _entropy and _letters."""
    if model is None:
        return docs.withColumns({"_lang": F.lit(UNKNOWN), "_score": F.lit(0.0), "_entropy": F.lit(None).cast("double"), "_letters": F.lit(0).cast("long")})
    held, names = _Held(docs.sparkSession, model), docs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(("scorer", held.id), lambda: Scorer(held.value))
        labels = np.array([*scorer.model.labels, UNKNOWN], object)
        for batch in slices(batches):
            entropy, sizes = scorer.entropies(batch.column("text").to_pylist())
            best = entropy.argmin(axis=1)
            least = entropy[np.arange(len(best)), best]
            share = 1 / np.exp(-SHARPNESS * (entropy - least[:, None])).sum(axis=1)
            none = sizes == 0
            lang = labels[np.where(none, -1, best)]
            extra = [pa.array(lang, pa.string()), pa.array(np.where(none, 0.0, share)), pa.array(least, mask=none), pa.array(sizes.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*names, "_lang", "_score", "_entropy", "_letters"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(score, f"{fields}, _lang string, _score double, _entropy double, _letters long")


def fold(doc_id: str = "doc_id") -> F.Column:
    """0 for held-out documents, 1 to 4 for those that may be learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def _labelled(docs: DataFrame) -> DataFrame:
    return docs.filter((fold() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def training_texts(docs: DataFrame) -> DataFrame:
    return _labelled(docs).filter(fold() != CALIBRATION_FOLD).select(F.col("lang").alias("label"), "text")


def calibrate(docs: DataFrame, model: Model | None) -> dict[str, float]:
    """By language, the cross-entropy that nearly all texts of the calibration fold stay below."""
    if model is None:
        return {}
    texts = _labelled(docs).filter(fold() == CALIBRATION_FOLD).select("text")
    seen = predict(texts, model).filter(F.col("_letters") >= FEWEST_LETTERS)
    found = seen.groupBy("_lang").agg(F.percentile_approx("_entropy", CALIBRATION_QUANTILE, 10_000).alias("limit"))
    return {r["_lang"]: r["limit"] for r in found.collect()}


def accepted(limits: dict[str, float]) -> F.Column:
    """Whether a predicted row is in a known language; without limits every text with a letter is."""
    some = F.col("_letters") > 0
    if not limits:
        return some
    limit = F.coalesce(*(F.when(F.col("_lang") == lang, F.lit(top)) for lang, top in sorted(limits.items())), F.lit(max(limits.values())))
    return some & (F.col("_entropy") <= limit + SHORT_ALLOWANCE / F.sqrt("_letters"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(training_texts(docs))
    found = predict(docs.select("doc_id", "text"), model).drop("text")
    limits = calibrate(docs, model)
    return found.select("doc_id", (fold() == 0).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.coalesce(accepted(limits), F.lit(False)).alias("accepted"))

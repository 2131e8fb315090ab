"""Language identification by word-first backoff.

A known word counts with its log frequency in every language. For an unseen word the longest character n-grams of which
the model knows any stand in, with their mean log frequency, down to single letters.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tallyloom.llm.common import collected, fitting_texts, held_out, one_row_each, pieces, within

FOLDS, REST = 5, 0
#: documents to learn from at most, longest text among them, occurrences that make a word known
MOST_DOCUMENTS, MOST_CHARS, LEAST_COUNT = 6000, 200_000, 3
#: characters of all of them together
MOST_TOTAL_CHARS = 16_000_000
LONGEST = 4
SMOOTHING = 0.5
UNKNOWN = "und"
#: words a worker remembers
REMEMBERED = 200_000

_WORD = regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$" if n > 1 else word
    return [marked[k : k + n] for k in range(len(marked) - n + 1)]


def _log_frequencies(counts: list[Counter], least: int) -> dict[str, tuple[float, ...]]:
    """Smoothed log frequency per language of everything seen at least ``least`` times in all."""
    names = sorted(w for w, n in sum(counts, Counter()).items() if n >= least)
    totals = [c.total() + SMOOTHING * (len(names) + 1) for c in counts]
    return {w: tuple(float(np.log((c[w] + SMOOTHING) / t)) for c, t in zip(counts, totals)) for w in names}


@dataclass
class Model:
    languages: list[str]
    words: dict[str, tuple[float, ...]]
    grams: dict[int, dict[str, tuple[float, ...]]]

    def scores(self, word: str) -> tuple[float, ...]:
        """Log frequencies per language of a word, by backoff where it is unseen; zeros where nothing is known."""
        if (known := self.words.get(word)) is not None:
            return known
        for n in range(LONGEST, 0, -1):
            table = self.grams[n]
            if found := [table[g] for g in grams(word, n) if g in table]:
                return tuple(sum(c) / len(found) for c in zip(*found))
        return (0.0,) * len(self.languages)


def fit(texts: list[str], langs: list[str]) -> Model:
    languages = sorted(set(langs))
    words = [Counter() for _ in languages]
    for text, lang in zip(texts, langs):
        words[languages.index(lang)].update(words_of(text))
    tables = {}
    for n in range(1, LONGEST + 1):
        counts = [Counter() for _ in languages]
        for own, out in zip(words, counts):
            for word, times in own.items():
                for g in grams(word, n):
                    out[g] += times
        tables[n] = _log_frequencies(counts, LEAST_COUNT)
    return Model(languages, _log_frequencies(words, LEAST_COUNT), tables)


def shares(sizes: dict[str, int], most: int) -> dict[str, int]:
    """``most`` shared out evenly, none getting more than its size."""
    out, left = {}, most
    for k, (name, size) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[name] = min(size, left // (len(sizes) - k))
        left -= out[name]
    return out


def train(
    documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
    folds: int = FOLDS, rest: int = REST, most: int = MOST_DOCUMENTS, most_total: int = MOST_TOTAL_CHARS,
) -> Model:
    """Learned from a bounded sample of documents with a language outside the held-out fold, one text for each key.

    Documents and characters are shared out among the languages, what a small one leaves going to the others, and
    each language is drawn on its own by hash; one document of every language is always in.
    """
    texts = fitting_texts(documents.where(F.col(lang).isNotNull()), key, text, MOST_CHARS, F.col(lang).alias("label"))
    own = one_row_each(texts.where(~held_out("k", folds, rest)))
    # a row for each language
    sizes = own.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")).collect()
    n, chars = {r["label"]: r["n"] for r in sizes}, {r["label"]: r["chars"] for r in sizes}
    rows_of, chars_of = shares(n, most), shares(chars, most_total)
    # somewhat more than the shares are drawn by hash, then cut exactly
    rates = [(x, (50 + 1.2 * min(rows_of[x], n[x] * chars_of[x] / max(chars[x], 1))) / n[x]) for x in n]
    spark = documents.sparkSession
    drawn = own.join(F.broadcast(spark.createDataFrame(rates, "label string, rate double")), "label").where(
        F.pmod(F.xxhash64("k", F.lit("language")), F.lit(1 << 31)) < F.col("rate") * (1 << 31)
    )
    found: dict[str, list] = {}
    for r in drawn.select(own.columns).collect():
        found.setdefault(r["label"], []).append(r)
    chosen = []
    for x, rows in found.items():
        chosen += within(rows, chars_of[x])[: rows_of[x]] or [min(rows, key=lambda r: (r["place"], r["k"]))]
    rows = collected(texts, spark.createDataFrame(chosen, own.schema))
    return fit([r["t"] for r in rows], [r["label"] for r in rows])


class _Remembered(dict):
    """Row of a word in a growing matrix of scores."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.table = np.zeros((1 << 12, len(model.languages)))

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at] = self.model.scores(word)
        self[word] = at
        return at


RESULT = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


def predict(texts: list[str], memory: _Remembered) -> tuple[list[str], list[float]]:
    """Language and its posterior under equal priors; ties go to the first language in alphabetical order."""
    languages = memory.model.languages
    names, scores = [], []
    for text in texts:
        words = words_of(text)
        if not words or not languages:
            names.append(UNKNOWN)
            scores.append(0.0)
            continue
        # summed after the look-up, which may grow the table
        rows = np.fromiter(map(memory.__getitem__, words), np.int64, len(words))
        total = memory.table[rows].sum(0)
        odds = np.exp(total - total.max())
        names.append(languages[int(total.argmax())])
        scores.append(float(odds.max() / odds.sum()))
    if len(memory) > REMEMBERED:
        memory.clear()
    return names, scores


def broadcast(spark: SparkSession, model: Model) -> Broadcast:
    """The model's tables; their size is bounded by the sample they were learned from."""
    return spark.sparkContext.broadcast((model.languages, model.words, model.grams))


_memories: list[_Remembered] = []


def _memory_of(tables: tuple) -> _Remembered:
    """What this worker remembers of the words of a model."""
    if not _memories or _memories[0].model.words is not tables[1]:
        _memories[:] = [_Remembered(Model(*tables))]
    return _memories[0]


def predictor(model: Broadcast):
    """text -> struct of lang_pred and score; ``und`` and 0 for NULL, texts without a letter or an empty model."""

    @F.arrow_udf(RESULT)
    def language(texts: pa.Array) -> pa.Array:
        memory = _memory_of(model.value)
        names, scores = [], []
        for piece in pieces(texts):
            some = predict([t.decode("utf-8", "replace") for t in piece], memory)
            names += some[0]
            scores += some[1]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return language

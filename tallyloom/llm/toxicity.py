"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Every sentence has a logistic score over its words and their beginnings (stems of
inflected words), and the document's probability is the noisy-or of its sentences: toxic where at least one sentence
is. Weights are fitted to document labels alone, and the sentences whose own score is high are the offending ones.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from tallyloom.llm.common import flat, labelled_sample, pieces, training_texts

FOLDS, REST = 3, 1
#: labelled documents to fit on at most, and the longest text among them
MOST_DOCUMENTS, MOST_CHARS = 4000, 200_000
#: lengths of the beginnings of words
BEGINNINGS = range(3, 9)
#: a word or beginning is a feature when it is in so many documents and the share of label 1 among them differs from its
#: share among all documents by so many standard errors
LEAST_DOCUMENTS, LEAST_Z = 4, 4.5
ROUNDS, RATE, RIDGE = 300, 0.1, 1e-5
THRESHOLD, OFFENDING = 0.7, 0.5
#: words a task remembers
REMEMBERED = 100_000

_END = b"."
#: letters become lower case, marks that end a sentence a full stop, all else of ASCII a space
_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x2E if b in b".!?\n" else 0x20
    for b in range(256)
)
_ENDS = re.compile(rb"[.!?\n]")


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case with a full stop after each sentence."""
    return text.translate(_BYTES).replace(_END, b" . ").split()


def features(word: bytes) -> list[str]:
    """The word and its beginnings, which end in a star."""
    letters = word.decode("utf-8", "replace")
    return [letters, *(f"{letters[:n]}*" for n in BEGINNINGS if n <= len(letters))]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float


class WordWeights(dict):
    """Weight of a word: the sum over its features, remembered; NaN for the end of a sentence."""

    def __init__(self, weights: dict[str, float]):
        super().__init__({_END: float("nan")})
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        weight = self.weights.get
        value = self[word] = sum(weight(f, 0.0) for f in features(word))
        return value


def _bags(token_lists, number: dict[str, int]):
    """Document of each sentence with a word, and sentence and feature of every occurrence of a feature."""
    words, n = flat(token_lists)
    known = {w: [number[f] for f in features(w) if f in number] for w in set(words)}
    stop = np.fromiter((w == _END for w in words), bool, len(words))
    owner = np.repeat(np.arange(len(n)), n)
    sentence = np.cumsum(np.concatenate([[0], stop[:-1]])) + owner if len(words) else np.zeros(0, np.int64)
    spoken = ~stop
    labels, sentence = np.unique(sentence[spoken], return_inverse=True)
    document = np.zeros(len(labels), np.int64)
    document[sentence] = owner[spoken]
    found, times = flat([known[w] for w, s in zip(words, stop.tolist()) if not s])
    return document, np.repeat(sentence, times), np.array(found, np.int64)


def telling_features(lists: list[list[bytes]], labels: np.ndarray) -> list[str]:
    """Features of documents with label 1 whose documents have another share of label 1 than all, beyond chance."""

    def found(words):
        return set(chain.from_iterable(map(features, set(words) - {_END})))

    positive = Counter(f for words, label in zip(lists, labels) if label for f in found(words))
    spread = Counter(f for words in lists for f in found(words) if f in positive)
    share = labels.mean()
    return sorted(
        f
        for f, n in spread.items()
        if n >= LEAST_DOCUMENTS and abs(positive[f] - n * share) >= LEAST_Z * np.sqrt(n * share * (1 - share))
    )


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """Weights of the telling features by Adam on the noisy-or likelihood; a constant model without both labels."""
    lists = [tokens(t.encode()) for t in texts]
    labels = (labels > 0).astype(int)
    if not len(labels) or labels.min() == labels.max():
        return Model({}, -20.0 if not labels.sum() else 0.0)
    names = telling_features(lists, labels)
    document, sentence, feature = _bags(lists, {w: k for k, w in enumerate(names)})
    n_docs, n_sentences = len(lists), len(document)
    theta = np.zeros(len(names) + 1)
    theta[-1] = -4.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        z = theta[-1] + np.bincount(sentence, theta[feature], n_sentences)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.bincount(document, np.log1p(-np.minimum(p, 1 - 1e-12)), n_docs)
        none = np.minimum(np.exp(clean), 1 - 1e-9)
        slope = np.where(labels > 0, -none / (1 - none), 1.0)[document] * p / n_docs
        gradient = np.append(np.bincount(feature, slope[sentence], len(names)), slope.sum())
        gradient[:-1] += RIDGE * theta[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return Model({w: float(t) for w, t in zip(names, theta)}, float(theta[-1]))


def train(
    documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    folds: int = FOLDS, rest: int = REST, most: int = MOST_DOCUMENTS,
) -> Model:
    """Fitted on a bounded sample of the labelled documents outside the held-out fold."""
    sample = labelled_sample(labels, label, key, folds, rest, most)
    return fit(*training_texts(documents, sample, key, text, MOST_CHARS))


def sentence_scores(texts: list[bytes], weights: WordWeights, bias: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, ordinal (counting all sentence ends) and probability of every sentence with a word."""
    words, n = flat([tokens(t) for t in texts])
    none = np.zeros(0, np.int64)
    if not words:
        return none, none, none.astype(float)
    w = np.fromiter(map(weights.__getitem__, words), float, len(words))
    stop = np.isnan(w)
    owner = np.repeat(np.arange(len(n)), n)
    before = np.concatenate([[0], np.cumsum(stop)[:-1]])
    starts = np.cumsum(n) - n
    ordinal = before - before[np.minimum(starts, len(words) - 1)][owner]
    head = np.concatenate([[True], (owner[1:] != owner[:-1]) | (before[1:] != before[:-1])])
    group = np.cumsum(head) - 1
    z = np.bincount(group, np.where(stop, 0, w)) + bias
    spoken = np.bincount(group, ~stop) > 0
    heads = np.flatnonzero(head)[spoken]
    return owner[heads], ordinal[heads], 1 / (1 + np.exp(-np.clip(z[spoken], -30, 30)))


def offending_sentences(texts: list[bytes], document: np.ndarray, ordinal: np.ndarray, p: np.ndarray) -> list[list[dict]]:
    """The sentences of each text whose own score is high, a text being split once."""
    found: list[list[dict]] = [[] for _ in texts]
    high = np.flatnonzero(p >= OFFENDING)
    for d, own in groupby(high.tolist(), key=lambda k: int(document[k])):
        sentences = _ENDS.split(texts[d])
        for k in own:
            text = sentences[ordinal[k]].strip().decode("utf-8", "replace")
            found[d].append({"ordinal": int(ordinal[k]), "text": text, "score": float(p[k])})
    return found


RESULT = StructType(
    [
        StructField("score", DoubleType()),
        StructField(
            "offending",
            ArrayType(
                StructType(
                    [StructField("ordinal", IntegerType()), StructField("text", StringType()), StructField("score", DoubleType())]
                )
            ),
        ),
    ]
)


def scorer(model: Model):
    """text -> struct of the document's score and its offending sentences.

    NULL and wordless texts score 0; equal texts score alike. A text of any length is one bag, split once.
    """

    # weights of words seen, kept from batch to batch of a task, which gets a copy of the list
    held: list[WordWeights] = []

    @F.arrow_udf(RESULT)
    def score(texts: pa.Array) -> pa.Array:
        scores, offending = [], []
        for piece in pieces(texts):
            if not held or len(held[0]) > REMEMBERED:
                held[:] = [WordWeights(model.weights)]
            document, ordinal, p = sentence_scores(piece, held[0], model.bias)
            clean = np.bincount(document, np.log1p(-p), len(piece)) if len(p) else np.zeros(len(piece))
            scores += (-np.expm1(clean)).tolist()
            offending += offending_sentences(piece, document, ordinal, p)
        sentences = pa.list_(pa.struct([("ordinal", pa.int32()), ("text", pa.string()), ("score", pa.float64())]))
        return pa.StructArray.from_arrays(
            [pa.array(scores, pa.float64()), pa.array(offending, sentences)], ["score", "offending"]
        )

    return score


def predicted(score: Column) -> Column:
    return F.when(score >= THRESHOLD, 1).otherwise(0)


def keep_clean(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that are not judged toxic, with all their columns."""
    rows = documents.select(F.struct("*").alias("row"))
    return rows.where(predicted(scorer(model)(F.col(f"row.`{text}`"))["score"]) == 0).select("row.*")

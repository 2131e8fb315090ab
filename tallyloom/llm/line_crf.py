"""Document quality by a linear-chain conditional random field over lines.

Every line with a word is good or bad. Features are figures of the line and of its neighbours; forward-backward gives
each line's probability of being good, and a document's quality is their mean weighted by line length. The field is
fitted to document labels, which stand for all lines of a document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallyloom.llm.common import flat, labelled_sample, pieces, starts_of, training_texts

FOLDS, REST = 5, 0
#: labelled documents to fit on at most, longest text among them
MOST_DOCUMENTS, MOST_CHARS = 4000, 200_000
ROUNDS, RATE, RIDGE = 250, 0.1, 1e-5
THRESHOLD = 0.3

_SYMBOLS, _CALLS, _DIGITS = b"#*$%&|<>{}[]=+~^_\\", b"!?", b"0123456789"
_UPPER, _LOWER = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))


def line_figures(line: bytes, words: list[bytes]) -> tuple[float, ...]:
    """Shares and lengths of one line with a word, each about 0 to 1."""
    size = len(line)
    share = lambda of: (size - len(line.translate(None, of))) / size
    upper, lower = share(_UPPER), share(_LOWER)
    n = len(words)
    symbols, calls = share(_SYMBOLS), share(_CALLS)
    return (
        min(1.0, 10 * symbols),
        float(symbols > 0.02),
        min(1.0, 10 * calls),
        min(1.0, 5 * share(_DIGITS)),
        upper / (upper + lower) if upper + lower else 0.0,
        float(upper > lower),
        len(set(words)) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        float(n > 8 and len(set(words)) < 0.5 * n),
        min(1.0, n / 40),
        float(n < 4),
        min(1.0, size / n / 16),
        float(line[-1:] in (b".", b"?", b"!", b":", b'"')),
    )


N_FIGURES = 13


@dataclass
class Lines:
    """Features of the lines with a word of some documents, their lengths in bytes and how many each document has."""

    x: np.ndarray
    size: np.ndarray
    n: np.ndarray


def lines_of(texts: list[bytes]) -> Lines:
    """Own figures of a line, those of the line before and after (zeros at the ends), marks for the ends, and one."""
    found = [[(line, words) for line in t.split(b"\n") if (words := line.split())] for t in texts]
    items, n = flat(found)
    own = np.array([line_figures(*i) for i in items], float).reshape(-1, N_FIGURES)
    first, last = np.zeros(len(items), bool), np.zeros(len(items), bool)
    ends = np.cumsum(n)[n > 0]
    first[(np.cumsum(n) - n)[n > 0]], last[ends - 1] = True, True
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[first], after[last] = 0, 0
    x = np.hstack([own, before, after, first[:, None], last[:, None], np.ones((len(items), 1))])
    return Lines(x, np.array([len(line) for line, _ in items], float), n)


@dataclass(frozen=True)
class Model:
    """Score of good against bad by feature, and of each pair of neighbouring labels (bad, good)."""

    weights: np.ndarray
    moves: np.ndarray


def _marginals(emit: np.ndarray, moves: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line and the expected label pairs (2 x 2) of each line with the next, documents side by side."""
    order = np.argsort(-n, kind="stable")
    starts, longest = starts_of(n)[order], int(n.max(initial=0))
    active = [int(np.searchsorted(-n[order], -t, "left")) for t in range(longest + 1)]
    score = np.stack([np.zeros(len(emit)), emit], 1)
    ahead, back = score.copy(), np.zeros_like(score)
    for t in range(1, longest):
        at = starts[: active[t]] + t
        ahead[at] += np.logaddexp(ahead[at - 1, 0, None] + moves[0], ahead[at - 1, 1, None] + moves[1])
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        after = score[at + 1] + back[at + 1]
        back[at] = np.logaddexp(moves[:, 0] + after[:, 0, None], moves[:, 1] + after[:, 1, None])
    joint = ahead + back
    total = np.logaddexp(joint[:, 0], joint[:, 1])
    good = np.exp(joint[:, 1] - total)
    inner = np.ones(len(emit), bool)
    inner[np.cumsum(n)[n > 0] - 1] = False
    at = np.flatnonzero(inner)
    pairs = ahead[at, :, None] + moves[None] + (score[at + 1] + back[at + 1])[:, None, :] - total[at, None, None]
    return good, np.exp(pairs)


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """Conditional maximum likelihood with a ridge, by Adam; a flat model without lines or without both labels."""
    lines = lines_of([t.encode() for t in texts])
    width = 3 * N_FIGURES + 3
    if not len(lines.x) or labels.min() == labels.max():
        flat_weights = np.zeros(width)
        flat_weights[-1] = 0.0 if not len(labels) else 10.0 if labels.max() else -10.0
        return Model(flat_weights, np.zeros((2, 2)))
    y = np.repeat((labels > 0).astype(int), lines.n)
    inner = np.ones(len(y), bool)
    inner[np.cumsum(lines.n)[lines.n > 0] - 1] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner], y[inner]), 1)
    theta = np.zeros(width + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        good, pairs = _marginals(lines.x @ theta[:width], theta[width:].reshape(2, 2), lines.n)
        slope = np.concatenate([lines.x.T @ (good - y), (pairs.sum(0) - seen).ravel()]) / len(y) + RIDGE * theta
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return Model(theta[:width], theta[width:].reshape(2, 2))


def train(
    documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    folds: int = FOLDS, rest: int = REST, most: int = MOST_DOCUMENTS,
) -> Model:
    """Fitted on a bounded sample of the labelled documents outside the held-out fold."""
    sample = labelled_sample(labels, label, key, folds, rest, most)
    return fit(*training_texts(documents, sample, key, text, MOST_CHARS))


def line_quality(texts: list[bytes], model: Model) -> tuple[np.ndarray, Lines]:
    """P(good) of every line with a word."""
    lines = lines_of(texts)
    return _marginals(lines.x @ model.weights, model.moves, lines.n)[0], lines


def scorer(model: Model):
    """text -> quality from 0 to 1; texts without a word, NULL included, have quality 0."""

    @F.arrow_udf(DoubleType())
    def quality(texts: pa.Array) -> pa.Array:
        out = []
        for piece in pieces(texts):
            good, lines = line_quality(piece, model)
            owner = np.repeat(np.arange(len(piece)), lines.n)
            total = np.bincount(owner, lines.size, len(piece))
            out += (np.bincount(owner, lines.size * good, len(piece)) / np.where(total > 0, total, 1)).tolist()
        return pa.array(out, pa.float64())

    return quality


def predicted(score: Column) -> Column:
    return F.when(score >= THRESHOLD, 1).otherwise(0)

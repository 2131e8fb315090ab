"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

The model is fitted to a small labelled URL table and is one weight per hash bucket; scoring hashes whole batches of
URLs with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

ALLOW, BLOCK = "allow", "block"
SIZES = (3, 4, 5)
BUCKETS = 1 << 16
#: labelled URLs to fit on at most
MOST_LABELLED = 20_000
ROUNDS, RATE, RIDGE = 300, 0.5, 1e-4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


@dataclass(frozen=True)
class Rule:
    """``name`` is a host, then a path that starts with ``/``."""

    name: str
    verdict: str

    def fits(self, host_of: Column, path_of: Column) -> Column:
        domain, slash, rest = self.name.partition("/")
        below = (host_of == domain) | host_of.endswith(f".{domain}")
        return below & path_of.startswith(slash + rest)


def first_rule(rules: Sequence[Rule], host_of: Column, path_of: Column, value) -> Column:
    """``value(rule)`` of the longest rule that fits (the first of equals), else NULL."""
    out = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        out = F.when(rule.fits(host_of, path_of), F.lit(value(rule))).otherwise(out)
    return out


def hashed_grams(texts: list[bytes], salt: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every character n-gram of the texts, one pair of arrays for each size."""
    joined = np.frombuffer(b"\0".join(t.replace(b"\0", b"\1") for t in texts) + b"\0", np.uint8)
    row = np.cumsum(joined == 0) - (joined == 0)
    for n in SIZES:
        if len(joined) <= n:
            continue
        last = len(joined) - n + 1
        value = np.full(last, 1469598103 + salt * 7919 + n, np.uint64)
        for k in range(n):
            value = value * np.uint64(1099511628211) + joined[k : k + last]
        value ^= value >> np.uint64(29)
        inside = row[:last] == row[n - 1 :]
        inside &= joined[n - 1 :] != 0
        yield row[:last][inside], ((value * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48))[inside].astype(np.int64) % BUCKETS


def features(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all n-grams of marked hosts and paths."""
    found = [
        *hashed_grams([f".{h}.".encode("utf-8", "replace") for h in hosts], 0),
        *hashed_grams([p.encode("utf-8", "replace") for p in paths], 1),
    ]
    none = [np.zeros(0, np.int64)]
    return np.concatenate([r for r, _ in found] or none), np.concatenate([b for _, b in found] or none)


def _scores(weights: np.ndarray, rows: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
    """Probability of block; features of a URL are scaled to length one."""
    size = np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
    z = np.bincount(rows, weights[buckets], n) / size + weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(hosts: Sequence[str], paths: Sequence[str], blocked: np.ndarray) -> np.ndarray:
    """A weight for each bucket and the bias, by accelerated gradient steps on the ridge-penalised likelihood.

    Without labelled URLs the model allows all.
    """
    rows, buckets = features(hosts, paths)
    n = len(hosts)
    weights, ahead = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    if not n:
        weights[-1] = -20.0
        return weights
    size = np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
    for step in range(ROUNDS):
        slope = _scores(ahead, rows, buckets, n) - blocked
        gradient = np.append(np.bincount(buckets, (slope / size)[rows], BUCKETS), slope.sum()) / n
        gradient[:-1] += RIDGE * ahead[:-1]
        after = ahead - 4 * RATE * gradient
        weights, ahead = after, after + step / (step + 3) * (after - weights)
    return weights


def train(labelled: DataFrame, url: str = "url", verdict: str = "verdict", most: int = MOST_LABELLED) -> np.ndarray:
    """Fitted on a small labelled table; of more than ``most`` URLs those of the smallest hashes are used."""
    rows = (
        labelled.where(F.col(url).isNotNull() & F.col(verdict).isin(ALLOW, BLOCK))
        .select(host(F.col(url)).alias("h"), path(F.col(url)).alias("p"), (F.col(verdict) == BLOCK).alias("b"))
        .distinct()
        .orderBy(F.xxhash64("h", "p"), "h", "p", "b")
        .limit(most)
        .collect()
    )
    return fit([r["h"] for r in rows], [r["p"] for r in rows], np.array([r["b"] for r in rows], float))


def scorer(weights: np.ndarray):
    """(host, path) -> probability of block; the weights are one array of fixed size."""

    @F.arrow_udf(DoubleType())
    def score(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        rows, buckets = features([h or "" for h in hosts.to_pylist()], [p or "" for p in paths.to_pylist()])
        return pa.array(_scores(weights, rows, buckets, len(hosts)))

    return score


def judged(
    urls: DataFrame, weights: np.ndarray, rules: Sequence[Rule], key: str = "page_id", url: str = "url"
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row; other columns are not read.

    ``score`` is the model's probability of block, for every URL; the verdict is the longest rule's, else block from
    one half on. NULL and URLs without ``://`` have an empty host and path, which no rule fits; the model judges them.
    """
    parts = urls.select(F.col(key).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    h, p = F.col("host"), F.col("path")
    scored = parts.select("*", scorer(weights)("host", "path").alias("score"))
    model = F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW)
    return scored.select(
        "page_id",
        "host",
        "path",
        first_rule(rules, h, p, lambda r: r.name).alias("rule"),
        F.coalesce(first_rule(rules, h, p, lambda r: r.verdict), model).alias("verdict"),
        "score",
    )

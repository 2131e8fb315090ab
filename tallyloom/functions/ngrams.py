"""N-grams of token arrays, and token arrays of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions import text as X

SEPARATOR = "\u0001"


def ngrams(tokens, n: int) -> Column:
    """All n-grams of a token array as joined strings; empty when it is shorter than ``n``."""
    tokens = X.col(tokens)
    starts = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    grams = F.transform(starts, lambda k: F.array_join(F.slice(tokens, k, n), SEPARATOR))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def counted_ngrams(tokens, order: int) -> Column:
    """STRUCT(n, gram) for every n-gram of lengths 1 .. order."""
    return F.concat(*[_tagged(tokens, n) for n in range(1, order + 1)])


def _tagged(tokens, n: int) -> Column:
    return F.transform(ngrams(tokens, n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))


# fixed values: punctuation rules of the mteval tokenizer, applied in this order
JOIN_RULES = [("<skipped>", ""), (r"-\n", ""), (r"\n", " ")]
ENTITIES = [("&gt;", ">"), ("&lt;", "<"), ("&quot;", '"'), ("&amp;", "&")]
SPLIT_RULES = [
    (r"([{-~\[-` -&(-+:-@/])", " $1 "),
    (r"([^0-9])([.,])", "$1 $2 "),
    (r"([.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]


def mteval_tokens(c, lower: bool = True) -> Column:
    out = X.col(c)
    for pattern, put in JOIN_RULES:
        out = F.regexp_replace(out, pattern, put)
    for entity, put in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(put))
    out = F.concat(F.lit(" "), F.lower(out) if lower else out, F.lit(" "))
    for pattern, put in SPLIT_RULES:
        out = F.regexp_replace(out, pattern, put)
    return X.words(out)


WORD_OR_MARK = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


def split_marks(c) -> Column:
    """Words and single punctuation marks separated by spaces."""
    return F.array_join(F.regexp_extract_all(X.col(c), F.lit(WORD_OR_MARK), F.lit(0)), " ")


def characters(c) -> Column:
    return F.filter(F.split(X.col(c), ""), lambda ch: ch != "")

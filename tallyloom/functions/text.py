"""Text columns: cleaning, number extraction, counters, sentence transforms, truncation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: number pattern (commas or whitespace may join digit groups) and the no-number mark
NUMBER_PATTERN = r"-?\d+(?:[,\s]\d+)*(?:\.\d+)?"
NO_NUMBER = "-999999999"
FLOAT_PATTERN = r"[-+]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][-+]?\d+)?"

# fixed values: code and math hints
CODE_HINT = r"(```|def\s+\w+\(|class\s+\w+|#include|public\s+static\s+void|function\s+\w+\(|=>|<\w+>)"
MATH_HINT = r"(\d+\s*[\+\-\*/=]\s*\d+|\\frac|\\sum|\\int|\btheorem\b|\bproof\b)"

CONSONANTS = "bcdfghjklmnpqrstvwxyz"
VOWELS = "aeiou"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(col(value)), use), 1)


SPACES = " \t\n\x0b\f\r"
LINE_ENDS = ("\x85", "\u2028", "\u2029")  # fixed values: no whitespace to a pattern, but the end of text may stand before one


def strip(c) -> Column:
    """What replacing the pattern ``^\\s+|\\s+$`` leaves, without searching the text for it."""
    c = col(c)
    ended = c.endswith(LINE_ENDS[0]) | c.endswith(LINE_ENDS[1]) | c.endswith(LINE_ENDS[2])
    return F.when(ended, F.regexp_replace(c, r"^\s+|\s+$", "")).otherwise(F.btrim(c, F.lit(SPACES)))


def strip_fields(fields) -> Column:
    """Every value of a MAP<STRING, STRING> without surrounding whitespace."""
    return F.transform_values(col(fields), lambda _, v: strip(v))


def words(c) -> Column:
    """Non-empty pieces between whitespace."""
    return F.filter(F.split(col(c), r"\s+"), lambda w: w != "")


def word_count(c) -> Column:
    return F.size(words(c))


def blank(c) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def first_non_blank(*values, default=None) -> Column:
    """First value that is not NULL or blank, stripped."""
    kept = [F.when(~blank(v), strip(v)) for v in values]
    return F.coalesce(*kept, *([] if default is None else [default if isinstance(default, Column) else F.lit(default)]))


def first_truthy(*values) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[F.when(F.length(col(v)) > 0, col(v)) for v in values])


def last_integer(c) -> Column:
    """Text of the last number without separators; the no-number mark if absent or not whole."""

    def whole(found):
        number = F.replace(F.replace(found, F.lit(",")), F.lit(" "))
        fractional = F.regexp_extract(number, r"\.(\d+)$", 1).rlike("[1-9]")
        return F.when(found.isNull() | fractional, F.lit(NO_NUMBER)).otherwise(F.regexp_replace(number, r"\.\d+$", ""))

    numbers = F.regexp_extract_all(col(c), F.lit(NUMBER_PATTERN), F.lit(0))
    return bind(F.try_element_at(numbers, F.lit(-1)), whole)


def canonical_integer(c) -> Column:
    """Integer text of any size without leading zeros, NULL if it is not an integer."""

    def canonical(v):
        plain = F.regexp_replace(v, r"^(-?)0+(?=\d)", "$1")
        return F.when(v.rlike(r"^-?\d+$"), F.when(plain == "-0", "0").otherwise(plain))

    return bind(c, canonical)


def last_float(c) -> Column:
    found = F.try_element_at(F.regexp_extract_all(col(c), F.lit(FLOAT_PATTERN), F.lit(0)), F.lit(-1))
    return found.try_cast("double")


def contains_code(c) -> Column:
    return col(c).rlike(CODE_HINT)


def contains_math(c) -> Column:
    return col(c).rlike(MATH_HINT)


def contains_any(c, phrases: Sequence[str]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | col(c).contains(phrase)
    return found


def before_first(c, stops: Sequence[str]) -> Column:
    """Text before the earliest of the stop strings."""

    def cut(v):
        places = [F.nullif(F.locate(s, v), F.lit(0)) for s in stops]
        first = F.least(*places) if len(places) > 1 else places[0]
        return F.substring(v, F.lit(1), F.coalesce(first - 1, F.length(v)))

    return bind(c, cut)


def after_first(c, mark: str) -> Column:
    """Text after the first ``mark``; all of it when the mark is absent."""

    def cut(v):
        place = F.locate(mark, v)
        return F.when(place == 0, v).otherwise(F.substring(v, place + len(mark), F.length(v)))

    return bind(c, cut)


def after_last(c, mark: str) -> Column:
    return F.element_at(F.split(col(c), F.lit("\\Q" + mark + "\\E"), F.lit(-1)), -1)


def after_nth(c, mark: str, n: int) -> Column:
    """Text after at most ``n`` marks: what is left of the last of ``n + 1`` pieces."""
    return F.element_at(F.split(col(c), F.lit("\\Q" + mark + "\\E"), F.lit(n + 1)), -1)


# --- sentence transforms and counters, by name ---------------------------------------------------


def _alternate_case(c) -> Column:
    letters = F.split(col(c), "")
    return F.array_join(F.transform(letters, lambda ch, i: F.when(i % 2 == 0, F.lower(ch)).otherwise(F.upper(ch))), "")


def _capitalised(w) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))


def _joined(c, per_word: Callable[[Column], Column], sep: str = " ") -> Column:
    return F.array_join(F.transform(words(c), per_word), sep)


TRANSFORMS: dict[str, Callable[..., Column]] = {
    "Reverse Order of Words": lambda c: F.array_join(F.reverse(words(c)), " "),
    "Capitalize Every Other Letter": _alternate_case,
    "Insert Number 1 Between Every Word": lambda c: F.array_join(words(c), " 1 "),
    "Replace Vowels with *": lambda c: F.regexp_replace(col(c), f"(?i)[{VOWELS}]", "*"),
    "Double Every Consonant": lambda c: F.regexp_replace(col(c), f"(?i)([{CONSONANTS}])", "$1$1"),
    "Capitalize Every Word": lambda c: _joined(c, _capitalised),
    "Remove All Vowels": lambda c: F.regexp_replace(col(c), f"(?i)[{VOWELS}]", ""),
    "Add 'ly' To End of Each Word": lambda c: _joined(c, lambda w: F.concat(w, F.lit("ly"))),
    "Remove All Consonants": lambda c: F.regexp_replace(col(c), f"(?i)[{CONSONANTS}]", ""),
    "Repeat Each Word Twice": lambda c: _joined(c, lambda w: F.concat(w, F.lit(" "), w)),
}


def _matches(c, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(pattern))


def _of(c, letters: str) -> Column:
    """Number of characters that are one of ``letters``, in either case."""
    return F.length(col(c)) - F.length(F.translate(col(c), letters + letters.upper(), ""))


COUNTERS: dict[str, Callable[..., Column]] = {
    "Count Occurrences of letter A": lambda c: _of(c, "a"),
    "Count Words": word_count,
    "Count Uppercase Letters": lambda c: _matches(c, r"\p{Lu}"),
    "Count Vowels": lambda c: _of(c, VOWELS),
    "Count Consonants": lambda c: _of(c, CONSONANTS),
    "Count Numbers": lambda c: _matches(c, r"\p{Nd}"),
    "Count Characters Without Spaces": lambda c: F.length(F.replace(col(c), F.lit(" "))),
    "Count Words that end in a vowel": lambda c: F.size(F.filter(words(c), lambda w: F.lower(F.right(w, F.lit(1))).isin(*VOWELS))),
    "Count Non-Alphanumeric Characters": lambda c: _matches(c, r"[^\p{L}\p{N}\s]"),
    "Count Words Longer Than 4 Letters": lambda c: F.size(F.filter(words(c), lambda w: F.length(w) > 4)),
}

"""Rows with every awkward case, and plain-Python versions of what the operators compute."""

import re

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    # names that operators use inside
    "fp bigint, text_key string, spans string, row string, cut string, score double, id string, bad string, hits string, "
    "host string, hash bigint, lines string, words string, k string, t string, label int, p string, s string, root bigint, "
    "component_id bigint, ids binary, segment string, `from` int, digest string, n_words string, kept string"
)
N_EXTRA = 26


def passage(seed: int, n: int) -> str:
    return " ".join(f"w{(seed * 7919 + k * k * 31 + k) % 9973}x{k % 13}" for k in range(n))


def awkward_rows() -> list[tuple]:
    shared = passage(1, 60)
    texts = [
        (1, shared + " " + passage(2, 80), "en", "a"),
        (2, passage(3, 40) + "\n" + shared + "\n" + passage(4, 10), "en", "a"),
        (3, "", "en", "a"),
        (4, " \t\n \x0b", None, "b"),
        (5, None, "de", None),
        (6, "Ünïcode wörd ñandú 中文 ½ Ⅷ\x1c\x85\xa0 end.", "de", "b"),
        (7, "word " * 3000, "en", "b"),
        (8, " ".join([passage(9, 500)] * 30), None, "b"),
        (9, passage(2, 80), "en", "a"),
        (9, passage(2, 80), "en", "a"),  # a repeated row
        (9, passage(5, 70), "fr", "a"),  # a repeated key with another text
        (None, passage(5, 70), "fr", "a"),
        (None, None, None, None),
        (10, passage(6, 9) + " 123.", "en", "a"),
        (11, passage(6, 9) + " 123.", "en", "a"),
        (12, "a" * 20000, "en", "a"),
    ]
    return [(*r, None if r[1] is None else len(r[1]), *[None] * N_EXTRA) for r in texts]


def documents(spark, rows=None):
    return spark.createDataFrame(awkward_rows() if rows is None else rows, SCHEMA)


def space_words(text) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def letter_words(text) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))

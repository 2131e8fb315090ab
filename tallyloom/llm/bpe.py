"""Byte-level BPE by forced boundaries.

A merge can only join two neighbouring bytes that stand next to each other inside some vocabulary token. Every byte
pair that occurs in no token is therefore a certain cut: the fragments between cuts are encoded on their own, with a
memory of fragments already seen, and their ids concatenated. The vocabulary file is read on the driver and travels as
a broadcast, whose size is that of the vocabulary.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from tallyloom.llm.common import pieces

# fixed value: the public pattern of byte-level tokenizers; white space is Unicode's, spelled out
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: bytes of remembered pieces and their ids in one task, about, and what one takes beside its letters and ids
REMEMBERED, OVERHEAD = 8 << 20, 200
NO_MERGE, ID_BITS = 1 << 60, 28
#: fragments of more bytes are merged with a heap
LONG = 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is printable, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def check_supported(spec: dict) -> None:
    """Refuses a vocabulary file that asks for another way of cutting or merging than the one built here."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [
        name
        for name, found in {
            "model": model.get("type", "BPE") != "BPE",
            "normalizer": spec.get("normalizer"),
            "pre_tokenizer": before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True),
            "ignore_merges": model.get("ignore_merges"),
            "dropout": model.get("dropout"),
            "byte_fallback": model.get("byte_fallback"),
            "affixes": model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"),
        }.items()
        if found
    ]
    if wrong:
        raise ValueError(f"vocabulary file not supported: {', '.join(wrong)}")


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        check_supported(spec)
        model = spec["model"]
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        self.bytes_of: dict[int, bytes] = {i: bytes(byte_of[c] for c in t) for t, i in model["vocab"].items()}
        self.first = np.array([model["vocab"][letter] for letter in byte_letters()], np.int64)
        #: rank and new id of a pair of ids, packed so that a lower rank is a smaller number
        self.merges: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[model["vocab"][left], model["vocab"][right]] = rank << ID_BITS | model["vocab"][left + right]
        keys = np.array([x << ID_BITS | y for x, y in self.merges], np.int64)
        order = np.argsort(keys)
        self.merge_keys, self.merge_values = keys[order], np.array(list(self.merges.values()), np.int64)[order]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        #: pairs of bytes that stand side by side in no token
        self.apart = np.ones((256, 256), bool)
        for token in self.bytes_of.values():
            codes = np.frombuffer(token, np.uint8)
            self.apart[codes[:-1], codes[1:]] = False
        self.pattern = regex.compile(PATTERN)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        #: ids of pieces of text as little-endian unsigned 32-bit integers
        self.known: dict[str, bytes] = {}
        self.forget()

    def forget(self) -> None:
        """Drops the remembered pieces."""
        self.known = {t: np.array([i], "<u4").tobytes() for t, i in self.special.items()}
        self.held = 0

    def pieces(self, text: str) -> list[str]:
        """The pieces that are merged on their own, special tokens among them."""
        if self.marks is None or not self.marks.search(text):
            return self.pattern.findall(text)
        out = []
        for part in self.marks.split(text):
            out += [part] if part in self.special else self.pattern.findall(part)
        return out

    def cuts(self, codes: np.ndarray) -> np.ndarray:
        """For each byte but the first whether it starts a fragment: no token holds it after the byte before."""
        return self.apart[codes[:-1], codes[1:]]

    def learn(self, pieces: list[str]) -> None:
        """Encodes the pieces, fragment by fragment, and remembers them."""
        raw = [p.encode("utf-8", "replace") for p in pieces]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        codes = np.frombuffer(b"".join(raw), np.uint8)
        head = np.zeros(len(codes), bool)
        head[np.cumsum(lengths) - lengths] = True
        head[1:] |= self.cuts(codes)
        ids, fragment = self.merged(self.first[codes], np.cumsum(head) - 1)
        piece_of = np.repeat(np.arange(len(raw)), lengths)[head]
        ends = np.cumsum(np.bincount(piece_of[fragment], minlength=len(raw))) * 4
        packed, start = ids.astype("<u4").tobytes(), 0
        for piece, own, end in zip(pieces, raw, ends.tolist()):
            self.known[piece] = packed[start:end]
            # a letter takes up to four bytes in memory, about twice its bytes in UTF-8
            self.held += OVERHEAD + 2 * len(own) + end - start
            start = end

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The packed merge of each pair, NO_MERGE where it has none."""
        wanted = left << ID_BITS | right
        at = np.minimum(np.searchsorted(self.merge_keys, wanted), len(self.merge_keys) - 1)
        return np.where(self.merge_keys[at] == wanted, self.merge_values[at], NO_MERGE)

    def merged(self, ids: np.ndarray, fragment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their fragments once nothing can be merged, in order.

        In a round every fragment merges its pair of lowest rank, the leftmost first; finished fragments step out, and
        so do those that would need very many rounds, which are merged with a heap.
        """
        done: list[tuple[np.ndarray, np.ndarray]] = []
        long = np.bincount(fragment)[fragment] > LONG
        if long.any():
            for f in np.unique(fragment[long]).tolist():
                own = np.array(self.merged_long(ids[fragment == f].tolist()), np.int64)
                done.append((own, np.full(len(own), f)))
            ids, fragment = ids[~long], fragment[~long]
        merge = np.full(len(ids), NO_MERGE)
        merge[:-1] = np.where(fragment[1:] == fragment[:-1], self.ranks(ids[:-1], ids[1:]), NO_MERGE)
        while len(ids):
            head = np.concatenate([[True], fragment[1:] != fragment[:-1]])
            starts, group = np.flatnonzero(head), np.cumsum(head) - 1
            lowest = np.minimum.reduceat(merge, starts)
            ended = (lowest == NO_MERGE)[group]
            if ended.any():
                done.append((ids[ended], fragment[ended]))
                ids, fragment, merge, lowest_of = ids[~ended], fragment[~ended], merge[~ended], lowest[group][~ended]
                if not len(ids):
                    break
            else:
                lowest_of = lowest[group]
            found = np.flatnonzero(merge == lowest_of)
            owner = fragment[found]
            at = found[np.concatenate([[True], owner[1:] != owner[:-1]])]
            ids[at] = merge[at] & ((1 << ID_BITS) - 1)
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, fragment, merge = ids[stay], fragment[stay], merge[stay]
            at -= np.arange(len(at))
            for left in (at - 1, at):
                left = left[(left >= 0) & (left + 1 < len(ids))]
                same = fragment[left] == fragment[left + 1]
                merge[left] = np.where(same, self.ranks(ids[left], ids[left + 1]), NO_MERGE)
            if at[-1] == len(ids) - 1:
                merge[-1] = NO_MERGE
        if not done:
            return ids, fragment
        ids, fragment = (np.concatenate(parts) for parts in zip(*done))
        order = np.argsort(fragment, kind="stable")
        return ids[order], fragment[order]

    def merged_long(self, ids: list[int]) -> list[int]:
        """The same for one fragment of any length, with a heap over a linked list."""
        merges, n = self.merges, len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(merges[p], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heapq.heapify(heap)
        while heap:
            merge, k, left, right = heapq.heappop(heap)
            j = after[k]
            if not alive[k] or j >= n or ids[k] != left or ids[j] != right:
                continue
            ids[k], alive[j], after[k] = merge & ((1 << ID_BITS) - 1), False, after[j]
            if after[k] < n:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (p := (ids[a], ids[b])) in merges:
                    heapq.heappush(heap, (merges[p], a, *p))
        return [i for i, kept in zip(ids, alive) if kept]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        pieces = [self.pieces(t) for t in texts]
        if self.held > REMEMBERED:
            self.forget()
        if new := list(set(chain.from_iterable(pieces)).difference(self.known)):
            self.learn(new)
        ids_of = self.known.__getitem__
        return [b"".join(map(ids_of, own)) for own in pieces]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        token = self.bytes_of.__getitem__
        return b"".join(map(token, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@dataclass(frozen=True)
class Vocabulary:
    """A vocabulary file as a broadcast, and the digest by which a worker knows it again."""

    raw: Broadcast
    digest: str


def load(spark: SparkSession, path: str) -> Vocabulary:
    """The vocabulary file as a broadcast; ``path`` is read on the driver."""
    with open(path, "rb") as file:
        raw = file.read()
    return Vocabulary(spark.sparkContext.broadcast(raw), hashlib.sha256(raw).hexdigest())


_codecs: dict[str, Codec] = {}


def _codec(vocabulary: Vocabulary) -> Codec:
    """One codec for each worker and vocabulary."""
    if vocabulary.digest not in _codecs:
        _codecs.clear()
        _codecs[vocabulary.digest] = Codec(vocabulary.raw.value)
    return _codecs[vocabulary.digest]


def encoded(
    documents: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", decode: bool = False
) -> DataFrame:
    """(doc_id, ids) of every document row, and with ``decode`` the text that the ids decode to.

    ``ids`` is BINARY of little-endian unsigned 32-bit integers. NULL encodes like the empty text; other columns are
    not read. Repeated rows give repeated rows. A task holds one piece of text, or one text that is longer, beside the
    batch it reads, and forgets the pieces it remembered when it ends.
    """
    rows = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        for batch in batches:
            at = 0
            for piece in pieces(batch.column(1)):
                ids = codec.encode_all([t.decode("utf-8", "replace") for t in piece])
                columns = [batch.column(0).slice(at, len(piece)), pa.array(ids, pa.binary())]
                if decode:
                    columns.append(pa.array(map(codec.decode, ids), pa.string(), size=len(ids)))
                at += len(piece)
                yield pa.record_batch(columns, ["doc_id", "ids", "decoded"][: len(columns)])
        codec.forget()

    schema = StructType([rows.schema["doc_id"], StructField("ids", BinaryType())])
    return rows.mapInArrow(run, schema.add("decoded", StringType()) if decode else schema)


def decoder(vocabulary: Vocabulary) -> Callable[[Column], Column]:
    """BINARY token ids -> text; NULL decodes to the empty text."""

    @F.arrow_udf(StringType())
    def decode(ids: pa.Array) -> pa.Array:
        codec = _codec(vocabulary)
        return pa.array((codec.decode(i.as_py() or b"") for i in ids), pa.string(), size=len(ids))

    return decode


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("bigint")

"""Byte-level BPE encoding and decoding (operator 1).

The tokenizers library encodes Arrow batches.  Its model works on characters, so each
of the 256 bytes has a character of its own (`byte_characters`); vocabulary and merges
come from a rank file, and the text is cut by the given pattern before bytes are mapped.
Decoding takes the characters of the token strings back to bytes by the reversed table.
A token may hold part of a character: bytes are joined first and read as UTF-8 last,
and `token_spans` widens the span of such a token to the whole character.

Defined results: a null text is encoded as an empty one; special tokens do not exist,
their strings are ordinary text; rows with an unknown id stay; repeated rows each have
their result; other columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.shipping import ship_package

#: Texts of one call into the library; it works through them on one core.
CHUNK = 256
#: Parts of texts in one generation of what a worker remembers, and the longest such part.
KNOWN_PARTS = 250_000
LONG_PART = 40
#: A place where a text may be cut, and a space before which one must look closer.
CUT = re.compile(r"(?= \S)")
LOOSE = re.compile(r" (?:\s|$)")
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_characters() -> list[str]:
    """A printable character for each byte: printable ones stand for themselves, the others
    take the code points from 256 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """For each token the two tokens whose merge makes it, in the order of ranks.

    They are what is left of its bytes after all merges of smaller rank."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            made = [ranks.get(a + b, rank) for a, b in zip(parts, parts[1:])]
            best = min(made)
            if best >= rank:
                break
            i = made.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


@functools.cache
def tokenizer(path: str, pattern: str):
    """The library's tokenizer for a rank file, and the bytes of each id."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, names = read_ranks(path), byte_characters()
    said = lambda token: "".join(names[b] for b in token)
    model = models.BPE(vocab={said(t): r for t, r in ranks.items()}, merges=[(said(a), said(b)) for a, b in merges_of(ranks)], cache_capacity=200_000)
    own = Tokenizer(model)
    own.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    back = {c: b for b, c in enumerate(names)}
    table: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for name, i in own.get_vocab().items():
        table[i] = bytes(back[c] for c in name)
    return own, table


class _Parts(dict):
    """Ids of the parts of texts met so far, in two generations: when the young one is
    full it becomes the old one, and what is still in use moves over again."""

    def __init__(self, own, size: int):
        super().__init__()
        self.own, self.size, self.old = own, size, {}
        self.shared = list(range(size))  # one object for each id

    def learn(self, parts) -> dict[str, tuple[int, ...]]:
        """Have all these parts; returns the long ones, which are not kept."""
        if len(self) > KNOWN_PARTS:
            self.old = dict(self)
            self.clear()
        fresh, once, old, shared = [], {}, self.old, self.shared
        for part in set(parts).difference(self):
            ids = old.get(part)
            if ids is None:
                fresh.append(part)
            else:
                self[part] = ids
        for part, e in zip(fresh, self.own.encode_batch_fast(fresh, add_special_tokens=False)):
            (self if len(part) <= LONG_PART else once)[part] = tuple([shared[i] for i in e.ids])
        return once


@functools.cache
def _known(path: str, pattern: str) -> _Parts:
    own, table = tokenizer(path, pattern)
    return _Parts(own, len(table))


def encoded(texts: list[str], path: str, pattern: str) -> list[list[int]]:
    """The ids of each text.

    Every match of the pattern begins anew at a space that stands before a character
    other than white space, so a text is cut there, and a worker encodes each different
    part of its texts once."""
    known = _known(path, pattern)
    parts = [CUT.split(t) if LOOSE.search(t) else [p if i == 0 else " " + p for i, p in enumerate(t.split(" "))] for t in texts]
    once = known.learn(itertools.chain.from_iterable(parts))
    flat = itertools.chain.from_iterable
    return [list(flat([known[p] if p in known else once[p] for p in row])) if once else list(flat(map(known.__getitem__, row))) for row in parts]


def decoded(ids: list[int], path: str, pattern: str) -> bytes:
    """The bytes of a sequence of ids; cut characters are whole again once their parts meet."""
    table = tokenizer(path, pattern)[1]
    return b"".join([table[i] for i in ids])


def token_spans(ids: list[int], path: str, pattern: str) -> list[tuple[int, int]]:
    """First and last code point (exclusive) that each token touches."""
    table = tokenizer(path, pattern)[1]
    raw = np.frombuffer(decoded(ids, path, pattern), np.uint8)
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters begun before each byte
    ends = np.cumsum([len(table[i]) for i in ids])
    spans, at = [], 0
    for end in ends.tolist():
        first = int(starts[at]) - (0 if at < len(raw) and (raw[at] & 0xC0) != 0x80 else 1)
        spans.append((first, int(starts[end])))
        at = end
    return spans


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            yield part, [x or "" for x in part.column(1).to_pylist()]


def _prepared(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    spark = docs.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids of the whole text."""

    def each(batches):
        for part, texts in _chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(encoded(texts, path, pattern), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _prepared(docs, id_col, text_col).mapInArrow(each, "doc_id long, ids array<int>")


def bpe_decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the bytes of its ids; null ids have none."""
    ship_package(tokens.sparkSession)

    def each(batches):
        for batch in batches:
            texts = [decoded(ids or [], path, pattern) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "bytes"])

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(each, "doc_id long, bytes binary")


def bpe_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Number of tokens, digest of the ids and digest of what they decode to, by row, with the columns to keep."""
    rows = _prepared(docs, id_col, text_col, keep)
    kept = [f for f in rows.schema.fields if f.name in keep]
    schema = DIGESTS + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kept)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *[f.name for f in kept]]

    def each(batches):
        table = tokenizer(path, pattern)[1]
        numbers = [str(i) for i in range(len(table))]
        for part, texts in _chunks(batches):
            many, ids_hex, raw_hex = [], [], []
            for ids in encoded(texts, path, pattern):
                many.append(len(ids))
                ids_hex.append(hashlib.sha256(" ".join([numbers[i] for i in ids]).encode()).hexdigest())
                raw_hex.append(hashlib.sha256(b"".join([table[i] for i in ids])).hexdigest())
            columns = [part.column(0), pa.array(many, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(raw_hex, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [part.column(2 + i) for i in range(len(kept))], names)

    return rows.mapInArrow(each, schema)


def vocabulary() -> tuple[str, str]:
    """Path of the rank file and the pattern of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), *vocabulary())

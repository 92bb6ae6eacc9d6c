"""Document fingerprints from Lempel-Ziv phrases (operator 5).

A text is parsed into phrases: each is the shortest stretch from where the last one
ended that has not been a phrase before.  The hashes of the phrases, a set, are reduced
to a minimum-hash signature: the hash range is cut into BINS bins and the least hash of
each is kept.  The share of equal bins among those that either signature fills estimates
the Jaccard similarity of the phrase sets, which rises as texts compress each other.

Neighbours in the order of ids are found without a global sort on one task: documents
are dealt into ranges of ids, sorted within them, and the first document of each range
is also sent, once, to the range before."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.llm.arrays import U64, Rolling, mixed
from airloom.shipping import ship_package

BINS = 128
_SHIFT = U64(64 - 7)
FINGERPRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def phrase_ends(text: str, start: int, known: set[str], ends: list[int]) -> None:
    """Parse from `start` on, adding to the known phrases and their ends.

    Each prefix of a phrase is a phrase, so the length is searched from that of the last
    one; what is left at the end and known already is no phrase."""
    n, add, push = len(text), known.add, ends.append
    size = 1
    while start < n:
        part = text[start : start + size]
        if part in known:
            while part in known:
                if start + size >= n:
                    return
                size += 1
                part = text[start : start + size]
        else:
            if start + size > n:
                size = n - start
            while size > 1:
                shorter = text[start : start + size - 1]
                if shorter in known:
                    break
                part, size = shorter, size - 1
        add(part)
        start += size
        push(start)


def phrase_hashes(text: str, ends: list[int], skip: int = 0) -> np.ndarray:
    """Hashes of the phrases from number `skip` on."""
    if len(ends) <= skip:
        return np.zeros(0, U64)
    begin = ends[skip - 1] if skip else 0
    codes = np.frombuffer(text[begin : ends[-1]].encode("utf-32-le", "surrogatepass"), np.uint32)
    cuts = np.array([begin, *ends[skip:]]) - begin
    return Rolling(mixed(codes.astype(U64) + U64(1))).of(cuts[:-1], cuts[1:])


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least hash of each bin, in 16 bits; 0 for an empty bin."""
    out = np.zeros(BINS, np.uint16)
    if len(hashes):
        ordered = np.sort(hashes)
        bins = (ordered >> _SHIFT).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(bins)) + 1])
        out[bins[first]] = (ordered[first] & U64(0xFFFF)) % U64(65535) + U64(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bins among the filled ones; two empty signatures are alike."""
    filled = (a | b) > 0
    n = int(filled.sum())
    return float((filled & (a == b)).sum() / n) if n else 1.0


def printed(sign: np.ndarray) -> str:
    return sign.astype(">u2").tobytes().hex()


class _Parsed:
    """A text with its phrases; those of its first half are kept apart, as the edited text shares it."""

    __slots__ = ("key", "text", "half", "known", "ends", "head", "sign")

    def __init__(self, key, text: str):
        n = len(text)
        self.key, self.text, self.half = key, text, n - n // 2
        known, ends = set(), []
        phrase_ends(text[: self.half], 0, known, ends)
        self.known, self.ends = set(known), list(ends)
        phrase_ends(text, ends[-1] if ends else 0, known, ends)
        hashes = phrase_hashes(text, ends)
        self.head, self.sign = hashes[: len(self.ends)], signature(hashes)

    def row(self, after: _Parsed) -> tuple:
        edited = self.text[: self.half] + after.text[: len(self.text) - self.half]
        ends, shared = self.ends, len(self.ends)
        phrase_ends(edited, ends[-1] if ends else 0, self.known, ends)
        sign = signature(np.concatenate([self.head, phrase_hashes(edited, ends, shared)]))
        digest = hashlib.sha256(edited.encode()).hexdigest()
        return self.key, len(self.text), digest, printed(self.sign), printed(sign), likeness(self.sign, sign), likeness(self.sign, after.sign)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in FINGERPRINTS.split(", ")]
    last, block = None, None
    for batch in batches:
        rows = []
        for at, ahead, key, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if at != block:
                last, block = None, at
            if ahead and last is None:  # only the first document of the next range counts
                continue
            now = _Parsed(key, text or "")
            if last is not None:
                rows.append(last.row(now))
            last = None if ahead else now
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(block, ahead, doc_id, text) in ranges of ids, sorted; each range ends with the row that follows it."""
    spark = docs.sparkSession
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    cuts = rows.agg(F.percentile_approx(F.col("doc_id").cast("double"), [k / parts for k in range(1, parts)], 10 * parts)).first()[0] or [0.0]
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    rows = Bucketizer(splits=splits, inputCol="place", outputCol="range").transform(rows.withColumn("place", F.col("doc_id").cast("double")))
    rows = rows.select(F.col("range").cast("int").alias("block"), "doc_id", "text")
    heads = sorted((r["block"], r["head"]) for r in rows.groupBy("block").agg(F.min("doc_id").alias("head")).collect())
    before = [(heads[k][1], heads[k - 1][0]) for k in range(len(heads))]  # the last range is followed by the first
    ahead = spark.createDataFrame(before, "head long, to int")
    heads = rows.join(F.broadcast(ahead), rows["doc_id"] == ahead["head"]).select(F.col("to").alias("block"), F.lit(1).alias("ahead"), "doc_id", "text")
    every = rows.select("block", F.lit(0).alias("ahead"), "doc_id", "text").union(heads)
    return every.repartition(parts, "block").sortWithinPartitions("block", "ahead", "doc_id", "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and the likeness to that and to the next text.

    Defined results: a null text is empty and has the empty fingerprint, which is alike
    to itself only; rows without an id are left out; rows with equal ids follow each
    other in the order of their texts; a single document is its own next; other columns
    are ignored; an empty table gives an empty result."""
    ship_package(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return with_next(docs, id_col, text_col).mapInArrow(_stream, FINGERPRINTS)


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))

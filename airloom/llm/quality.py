"""Quality by nearest-neighbour voting in a latent-semantic space (operator 4).

A text is counted into hashed features: its byte trigrams, trigrams of its character
shapes (upper case, lower case, digit, white space, each sign for itself), and how often
words repeat.  Counts are damped, weighted by the inverse document frequency over all
documents and scaled to length one.  The leading singular vectors of a labelled sample
span the latent space.  Every document is compared with all sample rows by exact cosine
products, in blocks; its nearest rows vote with their labels, weighted by similarity.

Bounds.  The sample has about SAMPLE_ROWS labelled rows (whole texts, chosen by a hash
of the id); its vectors, which every worker gets, are SAMPLE_ROWS x DIMENSIONS numbers
whatever the size of the corpus.  The document frequencies cover every document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.llm.arrays import BYTE_VALUES, U64, Rolling, mixed, word_bounds
from airloom.llm.packs import text_buffers
from airloom.shipping import ship_package

SAMPLE_ROWS = 3000
DIMENSIONS = 64
NEIGHBOURS = 40
#: How fast a vote falls with the distance in cosine.
SHARPNESS = 12.0
#: Hashed features of each of the two kinds of trigrams, and features of repetition.
KIND = 2048
REPEATS = 24
WIDTH = 2 * KIND + REPEATS
#: Texts counted at once, and bytes of them.
ROWS, BYTES = 256, 1 << 20

_SHAPE = np.arange(256, dtype=np.uint32)
_SHAPE[65:91] = 1
_SHAPE[97:123] = 2
_SHAPE[128:192] = 2
_SHAPE[192:256] = 2
_SHAPE[48:58] = 3
_SHAPE[[0x20, *range(0x09, 0x0E)]] = 4


def _trigrams(codes: np.ndarray, salt: int) -> np.ndarray:
    """A feature for each position, from three codes of 8 bits."""
    code = (codes[:-2] << np.uint32(16)) | (codes[1:-1] << np.uint32(8)) | codes[2:]
    return ((code + np.uint32(salt)) * np.uint32(2654435761)) >> np.uint32(32 - 11)


def _repeats(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """By text, how often a word equals the one before, comes again, or is new, in steps of the text's length."""
    starts, ends, cuts = word_bounds(data, offsets)
    words = Rolling(BYTE_VALUES[data]).of(starts, ends)
    n = np.diff(cuts)
    doc = np.repeat(np.arange(len(n)), n)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    kinds = np.unique(mixed(words + doc.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)[1]
    fresh = np.bincount(doc[kinds], minlength=len(n))
    some = np.maximum(n, 1)
    out = np.zeros((len(n), REPEATS), np.float32)
    rows = np.arange(len(n))
    out[rows, np.minimum((np.bincount(doc[same], minlength=len(n)) * 8) // some, 7)] = some
    out[rows, 8 + np.minimum(((n - fresh) * 8) // some, 7)] = some
    length = np.bincount(doc, weights=ends - starts, minlength=len(n)) if len(doc) else np.zeros(len(n))
    out[rows, 16 + np.minimum((length / some).astype(np.int64) // 2, 7)] = some
    return out


def features(array: pa.Array) -> Iterator[np.ndarray]:
    """Blocks of rows of damped feature counts, in the order of the texts."""
    data, offsets = text_buffers(array)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = min(at + ROWS, n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + BYTES, "right")) - 1))
        part, cuts = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        out = np.zeros((to - at, WIDTH), np.float32)
        if len(part) > 2:
            doc = np.repeat(np.arange(to - at), np.diff(cuts))
            inside = doc[2:] == doc[:-2]
            base = doc[:-2][inside] * (2 * KIND)
            for k, codes in enumerate((part.astype(np.uint32), _SHAPE[part])):
                spots = base + _trigrams(codes, 7919 * k)[inside] + k * KIND
                out[:, : 2 * KIND] += np.bincount(spots, minlength=(to - at) * 2 * KIND).reshape(to - at, 2 * KIND)
        out[:, 2 * KIND :] = _repeats(part, cuts)
        yield np.log1p(out)
        at = to


@dataclass
class Voters:
    """Everything that scoring needs; its size does not depend on the corpus."""

    weights: np.ndarray  # inverse document frequencies
    basis: np.ndarray  # WIDTH x DIMENSIONS
    vectors: np.ndarray  # sample rows, of length one
    labels: np.ndarray

    def latent(self, block: np.ndarray) -> np.ndarray:
        x = (_unit(block * self.weights)) @ self.basis
        return _unit(x)

    def score(self, block: np.ndarray) -> np.ndarray:
        """The weighted share of good neighbours; one half where there is nothing to go by."""
        if not len(self.labels):
            return np.full(len(block), 0.5)
        near = self.latent(block) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        cosine = np.take_along_axis(near, best, axis=1).astype(np.float64)
        votes = np.exp(SHARPNESS * (cosine - cosine.max(axis=1, keepdims=True)))
        return np.clip((votes * self.labels[best]).sum(axis=1) / votes.sum(axis=1), 0.0, 1.0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _basis(x: np.ndarray, k: int) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    k = min(k, *x.shape)
    q = np.linalg.qr(x.T @ np.random.default_rng(1).standard_normal((x.shape[0], k)).astype(np.float32))[0]
    for _ in range(6):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    return q.astype(np.float32)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Voters:
    """Voters from labelled rows outside the held-out quarter, and document frequencies of all rows.

    A row that `labels` names several times counts as good only if all its labels say so."""
    texts = _texts(docs, id_col, text_col)

    def frequencies(batches):
        sums, rows = np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            for block in features(batch.column(0)):
                sums += (block > 0).sum(axis=0)
                rows += len(block)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDTH + 1, dtype=np.int32)), pa.array(np.append(sums, rows))], ["at", "n"])

    counts = texts.select("text").mapInArrow(frequencies, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(WIDTH + 1)
    df[counts.column("at").to_numpy()] = counts.column("n").to_numpy()
    weights = np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32) + np.float32(0.1)

    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality")).where(~held_out())
    rows = texts.select("doc_id").join(marks, "doc_id")
    share = min(1.0, sample_rows / max(1, rows.count()))
    picked = rows.where((F.pmod(F.xxhash64("doc_id", F.lit("vote")), F.lit(1 << 30)) / (1 << 30)) < share)

    chosen = texts.join(F.broadcast(picked.distinct()), "doc_id")  # as bounded as the sample

    def counted(batches):
        for batch in batches:
            blocks = np.concatenate([_unit(b * weights) for b in features(batch.column(0))]) if batch.num_rows else np.zeros((0, WIDTH), np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in blocks.astype(np.float16)], pa.binary()), batch.column(1)], ["x", "y"])

    sample = chosen.select("text", "quality").mapInArrow(counted, "x binary, y int").limit(2 * sample_rows + 1).toArrow()
    if sample.num_rows > 2 * sample_rows:
        raise ValueError("the sample of labelled texts has more rows than its bound allows: one id has many of them")
    if not sample.num_rows:
        return Voters(weights, np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    x = np.stack([np.frombuffer(v, np.float16) for v in sample.column("x").to_pylist()]).astype(np.float32)
    order = np.lexsort((sample.column("y").to_numpy(), *x[:, :4].T))  # the same result in whatever order rows came
    x, y = x[order], sample.column("y").to_numpy()[order].astype(np.float64)
    basis = _basis(x, DIMENSIONS)
    return Voters(weights, basis, _unit(x @ basis), y)


def quality(docs: DataFrame, voters: Voters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row.

    Defined results: a null text counts as empty and is scored like any other; rows
    without an id stay; repeated rows each have their score; other columns are ignored."""
    texts = _texts(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(voters)

    def each(batches):
        for batch in batches:
            scores = [sent.value.score(block) for block in features(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["doc_id", "score"])

    return texts.mapInArrow(each, "doc_id long, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality(docs, fitted(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))

"""Packs: whole documents put together to rows of about half a megabyte of text.

A pack is the unit in which the text operators hand keys to Spark.  Packs are
written once to the shared folder, bucketed by their number, so a pack has the same
content in each later pass and meets its answers without a shuffle of the texts; a pass can therefore send keys grouped by bucket and get answers by pack and
position.  Texts are kept compressed.  Within a pack equal keys are combined before
the shuffle, so a key that is everywhere is sent once a pack."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.llm.arrays import owners
from airloom.shipping import ship_package
from airloom.sources.scratch import fresh_path

#: Bytes of text after which a pack is closed; a longer document has its own.
PACK_BYTES = 1 << 19
#: Documents after which a pack is closed, so that a place in it has 16 bits.
PACK_DOCUMENTS = 1 << 16
#: Bytes of keys that one bucket should hold; a worker needs about twenty times as much.
BUCKET_BYTES = 2 << 20

PACKS = "pack long, n_bytes long, ids binary, lengths binary, text binary"
MESSAGES = "bucket int, pack long, keys binary"
ANSWERS = "pack long, bucket int, answer binary"


def column(values: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.array(values, type=kind)


def text_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null has no bytes."""
    if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type):
        kind = np.int64
    else:
        kind = np.int32
    if array.null_count:
        array = array.fill_null("" if not pa.types.is_binary(array.type) else b"")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    number = (TaskContext.get().partitionId() << 27) if TaskContext.get() else 0
    ids, sizes, texts, total, many = [], [], [], 0, 0

    def close():
        nonlocal number, ids, sizes, texts, total, many
        row = pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([total]), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(sizes).tobytes()], pa.binary()), pa.array([press.compress(np.concatenate(texts).tobytes())], pa.binary())],
            ["pack", "n_bytes", "ids", "lengths", "text"],
        )
        number, ids, sizes, texts, total, many = number + 1, [], [], [], 0, 0
        return row

    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < len(keys):
            room = PACK_BYTES - total
            to = max(int(np.searchsorted(offsets, offsets[at] + room, "right")) - 1, at + (0 if ids else 1))
            to = min(to, at + PACK_DOCUMENTS - many, len(keys))
            if to > at:
                ids.append(keys[at:to])
                sizes.append(np.diff(offsets[at : to + 1]))
                texts.append(data[offsets[at] : offsets[to]].copy())
                total += int(offsets[to] - offsets[at])
                many += to - at
            if to < len(keys):
                yield close()
            at = to
    if ids:
        yield close()


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packs of all documents with an id, written to the shared folder."""
    spark = docs.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    chosen = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"packs_{uuid.uuid4().hex}"
    parts = chosen.mapInArrow(_closed, PACKS).repartition(size, "pack")
    parts.write.bucketBy(size, "pack").option("path", fresh_path(spark, "packs")).saveAsTable(name)
    return spark.table(name)


class Pack:
    """One row of the pack table, unpacked."""

    __slots__ = ("number", "ids", "offsets", "data")

    def __init__(self, number: int, ids: bytes, lengths: bytes, text: bytes):
        self.number = number
        self.ids = np.frombuffer(ids, np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, np.int64))])
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(text), np.uint8) if self.offsets[-1] else np.zeros(0, np.uint8)

    @property
    def documents(self) -> np.ndarray:
        return owners(self.offsets)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[Pack]:
    for batch in batches:
        for row in batch.select(["pack", "ids", "lengths", "text"]).to_pylist():
            yield Pack(row["pack"], row["ids"], row["lengths"], row["text"])


def bucket_count(packs: DataFrame, bytes_per_text_byte: float) -> int:
    """Buckets so that each holds about BUCKET_BYTES: it grows with the input."""
    total = packs.agg(F.sum("n_bytes")).first()[0] or 0
    return max(64, int(total * bytes_per_text_byte / BUCKET_BYTES) + 1)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each 64-bit hash, from its upper 32 bits; monotonous in the hash."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def sent(numbers: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, p, k = zip(*numbers) if numbers else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(p, pa.int64()), pa.array(k, pa.binary())], ["bucket", "pack", "keys"])


def by_bucket(pack: int, hashes: np.ndarray, fields: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Messages of one pack.  `hashes` ascend; `fields` are what is sent of each."""
    of = bucket_of(hashes, buckets)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]]) if len(of) else np.zeros(1, np.int64)
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        rows.append((int(of[a]), pack, b"".join(f[a:b].tobytes() for f in fields)))
    return sent(rows)


def fields_of(keys: bytes, kinds: list) -> list[np.ndarray]:
    """The arrays that by_bucket put together."""
    kinds = [np.dtype(k) for k in kinds]
    n = len(keys) // sum(k.itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(keys, k, n, at))
        at += n * k.itemsize
    return out


def answered(packs: DataFrame, answers: DataFrame, work: Callable, schema: str) -> DataFrame:
    """Run work(Pack, {bucket: answer}) -> iterator of record batches for each pack with its answers."""
    gathered = answers.groupBy("pack").agg(F.collect_list(F.struct("bucket", "answer")).alias("answers"))
    joined = packs.join(gathered, "pack", "left")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                got: dict[int, list[bytes]] = {}
                for x in row["answers"] or []:
                    got.setdefault(x["bucket"], []).append(x["answer"])
                yield from work(Pack(row["pack"], row["ids"], row["lengths"], row["text"]), got)

    return joined.mapInArrow(each, schema)

"""Removal of repeated byte strings by ranked positions (operator 8).

A byte is removed when a string of `length` bytes that covers it also starts in a
document with a smaller id.  No ranks and no rank pairs are sorted here: windows are
matched as minimizer stretches by hash, then one by one by hash, see `repeats`.  The
windows of all texts take part; nothing is sampled.

Defined results: a null text is empty; a text under `length` bytes keeps everything;
rows with equal ids do not remove from each other; rows without an id are left out;
an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from airloom.llm.arrays import BYTE_VALUES, covered, per_document, runs
from airloom.llm.packs import Pack, packed
from airloom.llm.repeats import repeated_windows

SEED = 20
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _bytes(pack: Pack):
    return BYTE_VALUES[pack.data], pack.offsets


def _removed(pack: Pack, offsets, starts, ends) -> tuple[np.ndarray, list[bytes]]:
    gone = covered(len(pack.data), starts, ends)
    kept = pack.data[~gone].tobytes()
    cuts = np.concatenate([[0], np.cumsum(per_document(~gone, offsets))])
    return gone, [kept[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _digests(pack: Pack, offsets, starts, ends) -> pa.RecordBatch:
    gone, kept = _removed(pack, offsets, starts, ends)
    return pa.RecordBatch.from_arrays(
        [pa.array(pack.ids), pa.array(np.diff(offsets)), pa.array(per_document(gone, offsets)), pa.array(runs(gone, offsets)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    )


def _kept_texts(pack: Pack, offsets, starts, ends) -> pa.RecordBatch:
    gone, kept = _removed(pack, offsets, starts, ends)
    return pa.RecordBatch.from_arrays([pa.array(pack.ids), pa.array(kept, pa.binary()), pa.array(per_document(gone, offsets))], ["doc_id", "kept", "n_removed"])


def suffix_dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the kept bytes (binary: a cut may fall inside a character) and n_removed."""
    seed = max(1, min(SEED, length // 2))
    return repeated_windows(packed(docs, id_col, text_col), _bytes, length, seed, False, _kept_texts, "doc_id long, kept binary, n_removed long", 0.75)


def suffix_dedup_digests(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts and the digest of what `suffix_dedup` keeps, by document."""
    seed = max(1, min(SEED, length // 2))
    return repeated_windows(packed(docs, id_col, text_col), _bytes, length, seed, False, _digests, SCHEMA, 0.75)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))

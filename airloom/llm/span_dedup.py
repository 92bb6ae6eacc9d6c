"""Removal of repeated word spans (operator 9).

A window is `length` consecutive words.  Windows are dealt by the minimizer of their words, and
consecutive windows of a document with one minimizer are sent as one stretch; where different
stretches share a minimizer, their windows are compared one by one, all by hash (see
`repeats`).  No graph is built: there are no nodes, degrees or joins of paths.  What is
covered is joined back to its documents.

A word is removed when a window that covers it also starts earlier: in a document with
a smaller id, or before in the same document.

Defined results: words are runs of anything but space, tab, newline, vertical tab, form
feed and return; a null text has none; under `length` words everything is kept; rows
with equal ids do not remove from each other; rows without an id are left out; other
columns are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.llm.arrays import covered, per_document, word_bounds, word_hashes
from airloom.llm.packs import Pack, packed
from airloom.llm.repeats import repeated_windows

SEED = 5
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _words(pack: Pack):
    starts, ends, offsets = word_bounds(pack.data, pack.offsets)
    return word_hashes(pack.data, starts, ends), offsets


def _kept(pack: Pack, offsets, starts, ends) -> tuple[np.ndarray, list[bytes]]:
    """Which words go, and by document the kept words joined by single spaces."""
    gone = covered(int(offsets[-1]), starts, ends)
    first, last, _ = word_bounds(pack.data, pack.offsets)
    out = []
    raw = pack.data.tobytes()
    for a, b in zip(offsets[:-1], offsets[1:]):
        if not gone[a:b].any():
            out.append(b" ".join(raw[first[a] : last[b - 1]].split()) if b > a else b"")
        else:
            keep = a + np.flatnonzero(~gone[a:b])
            out.append(b" ".join([raw[x:y] for x, y in zip(first[keep].tolist(), last[keep].tolist())]))
    return gone, out


def _digests(pack: Pack, offsets, starts, ends) -> pa.RecordBatch:
    gone, kept = _kept(pack, offsets, starts, ends)
    return pa.RecordBatch.from_arrays(
        [pa.array(pack.ids), pa.array(np.diff(offsets)), pa.array(per_document(gone, offsets)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
        ["doc_id", "n_words", "n_removed", "kept_sha256"],
    )


def _texts(pack: Pack, offsets, starts, ends) -> pa.RecordBatch:
    """Documents that lost words, with the digest of what they were and what is left; the others need no row."""
    gone, kept = _kept(pack, offsets, starts, ends)
    lost = np.flatnonzero(per_document(gone, offsets))
    raw, at = pack.data.tobytes(), pack.offsets
    was = [hashlib.sha256(raw[at[i] : at[i + 1]]).hexdigest() for i in lost]
    return pa.RecordBatch.from_arrays([pa.array(pack.ids[lost]), pa.array(was, pa.string()), pa.array([kept[i] for i in lost], pa.binary()).cast(pa.string())], ["doc_id", "was", "kept"])


def span_dedup_digests(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    seed = max(1, min(SEED, length // 2))
    return repeated_windows(packed(docs, id_col, text_col), _words, length, seed, True, _digests, SCHEMA, 0.25)


def span_dedup(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without their repeated spans.  A document that lost words has the kept
    words joined by single spaces; the others keep their text byte by byte.  All columns
    stay, and n_chars, where there is one, is the new number of code points.  Every row
    stays once: rows meet their cut text by id and digest of the text, so rows of equal
    ids each keep what is left of their own."""
    seed = max(1, min(SEED, length // 2))
    cut = repeated_windows(packed(docs, id_col, text_col), _words, length, seed, True, _texts, "doc_id long, was string, kept string", 0.25)
    cut = cut.groupBy(F.col("doc_id").alias("_cut_id"), F.col("was").alias("_cut_was")).agg(F.min("kept").alias("_cut_text"))
    was = F.sha2(docs[text_col].cast("string").cast("binary"), 256)
    joined = docs.join(cut, (docs[id_col] == cut["_cut_id"]) & (was == cut["_cut_was"]), "left")
    text = F.when(F.col("_cut_id").isNotNull(), F.col("_cut_text")).otherwise(F.col(text_col))
    out = {text_col: text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("_cut_id").isNotNull(), F.length("_cut_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return joined.withColumns(out).select(*docs.columns)


def op9_span_dedup(spark, sf_dir: str) -> DataFrame:
    return span_dedup_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))

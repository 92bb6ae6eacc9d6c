"""Divergence between the sources of a language, from bitmaps of count levels.

A term's share in a group depends on its count there alone, so a pair of groups needs to know
only how many terms have count i here and j there.  The terms of a language are numbered from the
most frequent on; all terms of one count in one group are a bitset, kept as words of 64
terms (group, count, word, bits) and only where it is not empty.  Words of two groups meet
by AND, popcount gives the joint cells with both counts above zero, times f.  Cells with a zero
follow by complement:

    sum f = V f(0,0) + sum_i n_i (f(i,0) - f(0,0)) + sum_j n_j (f(0,j) - f(0,0))
            + sum_ij n_ij (f(i,j) - f(i,0) - f(0,j) + f(0,0)).

All numbers are integers.  Frequent terms have counts of their own and so words of few bits; the
long tail of the others has few counts, and there one AND serves up to 64 terms.

Counts are added up in the task that reads the texts, by pieces of `PIECE` bytes.  The number of a term is its place in sampled ranges
(`operators.ranges`), so no language is numbered in one task; the pairs of a word are
spread by word, those of a language over `PARTS` parts.  The result itself has a row for each
pair of sources of a language.

Defined results: null text, lang and source are ''; repeated rows are documents like others,
also where they share an id; a language without kept terms has pairs of value 0 and no
terms; a source without terms is in the pairs of its language; an empty table gives no row; other
columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airloom.operators.ranges import numbered
from airloom.shipping import ship_package
from airloom.sources.scratch import written

#: In UTF-8 every byte of a character beyond ASCII is one of 80..FF, so bytes are cut like characters.
_INSIDE = np.zeros(256, bool)
for _low, _high in ((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _INSIDE[_low : _high + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
LEAST_DOCS, SCALE, TOP = 10, 1_000_000_000, 10
WORD, PARTS = 64, 64
#: Bytes of texts that are counted together.
PIECE = 8 << 20
CELLS = "lang string, source string, term string, n bigint, docs bigint"


def _texts(docs: DataFrame) -> DataFrame:
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(whole("lang").alias("lang"), whole("source").alias("source"), whole("text").cast("binary").alias("text"))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The document of each term in `data`, whose documents begin at `offsets`, and the terms."""
    inside = _INSIDE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < data.size]
    begins[cuts] = inside[cuts]
    starts = np.flatnonzero(begins)
    places = np.cumsum(inside, dtype=np.int32)[starts] - 1
    letters = _LOWER[data[inside]]
    bounds = np.append(places, letters.size).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), starts.size, [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
    return np.searchsorted(offsets, starts, "right") - 1, terms.dictionary_encode()


def _sums(keys: np.ndarray, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys, the sum of their values (of ones) and the number of rows."""
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if keys.size else np.zeros(0, np.int64)
    rows = np.diff(np.append(first, keys.size))
    return sorted_[first], rows if values is None or not keys.size else np.add.reduceat(values[order], first), rows


def _rows(groups: list[tuple[str, str]], group, terms, n, docs) -> pa.RecordBatch:
    named = [pa.array([g[i] for g in groups], pa.string()).take(pa.array(group)) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([*named, terms.cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])


def _long_text(group: tuple[str, str], data: np.ndarray):
    """The counts of one text that is longer than a piece, cut between terms; its terms are one document's."""
    seen, at = set(), 0
    while at < data.size:
        end = min(at + PIECE, data.size)
        while end < data.size and _INSIDE[data[end]]:
            end += 1
        terms = _words(data[at:end], np.array([0, end - at]))[1]
        codes, n, _ = _sums(terms.indices.to_numpy())
        if codes.size:
            found = terms.dictionary.take(pa.array(codes))
            seen.update(found.to_pylist())
            yield _rows([group], np.zeros(codes.size, np.int64), found, n, np.zeros(codes.size, np.int64))
        at = end
    if seen:
        ones = np.ones(len(seen), np.int64)
        yield _rows([group], ones - 1, pa.array(seen, pa.binary()), ones - 1, ones)


def _partial_counts(batches):
    """Counts of terms and of the documents that have them, by pieces of the texts of a task."""
    for batch in batches:
        text = batch.column(2)
        offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        first = 0
        while first < len(names):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1)
            piece = data[offsets[first] : offsets[last]]
            if last == first + 1 and piece.size > PIECE:
                yield from _long_text(names[first], piece)
            elif piece.size:
                groups = sorted(set(names[first:last]))
                number = {g: i for i, g in enumerate(groups)}
                doc, terms = _words(piece, offsets[first : last + 1] - offsets[first])
                width = max(len(terms.dictionary), 1)
                pairs, n, _ = _sums(doc * width + terms.indices.to_numpy())
                group = np.array([number[g] for g in names[first:last]])[pairs // width]
                cells, total, docs = _sums(group * width + pairs % width, n)
                if cells.size:
                    yield _rows(groups, cells // width, terms.dictionary.take(pa.array(cells % width)), total, docs)
            first = last


def cells(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) over whole texts, written."""
    ship_package(docs.sparkSession)
    return written(_texts(docs).mapInArrow(_partial_counts, CELLS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-cells")


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)) of named columns, exact at any size."""
    return F.expr(f"1 + ({SCALE} * cast({count} + 2 as decimal(28,0))) div cast({total} + 2 * {terms} as decimal(38,0))")


def gap(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so the square fits."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence from the other sources of the language
    (`pair`), and the terms that a source has more of than its language (`term`, the first `top`)."""
    counted = cells(docs)
    kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs")
    placed = written(numbered(written(kept, "kept-terms"), ["lang"], [F.desc("lang_n"), F.col("term")], "place"), "numbered-terms")
    langs = placed.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    here = written(counted.join(placed, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n", (F.col("place") - 1).alias("id")), "kept-cells")

    totals = here.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = _texts(docs).select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("total", "terms", "lang_total")])
    # without kept terms there is no share and no value
    groups = written(groups.withColumn("none", F.when(F.col("terms") > 0, share("0", "total", "terms"))), "audit-groups")

    pairs = _pairs(here, groups)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))

    shares = here.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "terms")).withColumn("q", share("lang_n", "lang_total", "terms"))
    more = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap("p", "q").alias("value"))
    terms = more.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)
    return pairs.unionByName(terms)


def _pairs(here: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two different sources of a language."""
    rated = here.groupBy("lang", "source", "n", F.expr(f"id div {WORD}").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(id % {WORD} as int))")).alias("bits"))
    rated = rated.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "terms"))
    bitmaps = written(rated.select("lang", "source", "word", "bits", "p", "none"), "level-bitmaps")

    left = bitmaps.select("lang", "word", *[F.col(c).alias(f"{c}_a") for c in ("source", "bits", "p", "none")])
    right = bitmaps.select("lang", "word", *[F.col(c).alias(f"{c}_b") for c in ("source", "bits", "p", "none")])
    met = left.join(right, ["lang", "word"]).filter((F.col("source_a") < F.col("source_b")) & (F.col("bits_a").bitwiseAND(F.col("bits_b")) != 0))
    joint = F.bit_count(F.col("bits_a").bitwiseAND(F.col("bits_b"))).cast("long") * (gap("p_a", "p_b") - gap("p_a", "none_b") - gap("none_a", "p_b") + gap("none_a", "none_b"))
    both = met.groupBy("lang", "source_a", "source_b").agg(F.sum(joint).alias("value"))

    # all pairs of one language, made in parts of the first source
    part = F.expr(f"pmod(xxhash64(source), {PARTS})")
    first = groups.select("lang", part.alias("part"), F.col("source").alias("source_a"), F.col("none").alias("none_a"), "terms")
    second = groups.select("lang", F.explode(F.expr(f"sequence(0L, {PARTS - 1}L)")).alias("part"), F.col("source").alias("source_b"), F.col("none").alias("none_b"))
    every = written(first.join(second, ["lang", "part"]).filter("source_a <> source_b").drop("part"), "source-pairs")

    levels = bitmaps.groupBy("lang", F.col("source").alias("source_a"), "p").agg(F.sum(F.bit_count("bits").cast("long")).alias("cells"))
    zeros = every.join(levels, ["lang", "source_a"]).groupBy("lang", "source_a", "source_b").agg(
        F.sum(F.col("cells") * (gap("p", "none_b") - gap("none_a", "none_b"))).alias("value")
    )
    turned = lambda df: df.select("lang", F.col("source_b").alias("source_a"), F.col("source_a").alias("source_b"), "value")
    empty = every.select("lang", "source_a", "source_b", F.coalesce(F.col("terms") * gap("none_a", "none_b"), F.lit(0)).alias("value"))
    parts = empty.unionByName(zeros).unionByName(turned(zeros)).unionByName(both).unionByName(turned(both))
    return parts.groupBy("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item")).agg(F.sum("value").alias("value"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))

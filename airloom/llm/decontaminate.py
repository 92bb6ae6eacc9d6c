"""Benchmark decontamination by a BM25 index with block-max WAND (operator 6).

The test items are indexed: each term has the BM25 impact it gives an item, as a share
of what the item scores against itself.  Every passage of every document is a query: a
window of words, moved on by a quarter of its length.  All items whose score reaches
the threshold are retrieved, and no other item needs to be scored:

* terms of the least impact, which together cannot lift any item to half the threshold,
  are never looked up first (they only enter as a bound);
* items lie in blocks, and for each block and term the index holds the largest impact.
  The sum of these over a window bounds the score of every item of the block.  Blocks
  under the threshold are skipped; the items of the others are scored exactly.

A retrieved item is verified against the text around the window: its words that lie in
shared word trigrams must make up the given share of the whole item.  The items name no
answer of their own, so the shares of the last sentence and of what is before it are told
as well, but decide nothing: an item without its last sentence is a leak, too.

The index is sent to all workers, so its size is bounded: the items lie in a row by their
words, and each stretch of INDEX_TERMS words is the index of one pass over the documents (an
item goes whole to the pass in which it begins).  Document frequencies and the mean length
come from all items, so the passes do not show in scores or hits."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.llm.arrays import BYTE_VALUES, LOWER, Rolling, word_bounds
from airloom.llm.packs import text_buffers
from airloom.operators.ranges import running
from airloom.shipping import ship_package
from airloom.sources.scratch import written

K1, B = 1.2, 0.75
WINDOW = 64
BLOCK = 16
BLOCKS_AT_ONCE = 64
THRESHOLD = 0.5
OVERLAP = 0.5
GRAM = 3
#: Words of the items of one index; a larger benchmark is searched in several passes.
INDEX_TERMS = 2_000_000
#: Anything but ASCII letters, digits and bytes of other scripts parts words here.
PARTS = np.ones(256, bool)
PARTS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, position long, item_overlap double"
LISTED = "item_id long, words array<long>, answer long"
_LAST_SENTENCE = re.compile(r"[.!?\n]\s+(?=\S[^.!?\n]*[.!?]*\s*$)")


def _words(data: np.ndarray, offsets: np.ndarray):
    data = LOWER[data]
    starts, ends, cuts = word_bounds(data, offsets, PARTS)
    return Rolling(BYTE_VALUES[data]).of(starts, ends), cuts


def words_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return _words(raw, np.array([0, len(raw)]))[0]


@dataclass
class Index:
    """Impacts of the items of one length class; postings are ordered by term."""

    window: int
    terms: np.ndarray  # sorted hashes
    common: np.ndarray  # whether a term is one of the bound-only ones
    bounds: np.ndarray  # terms x blocks: the largest impact in each block
    rest: np.ndarray  # by block: the most that all common terms can add
    impacts: list[dict[int, float]]  # by item: term number -> impact
    items: np.ndarray
    words: list[np.ndarray]
    answers: list[int]  # by item: where the answer begins, in words


@dataclass
class Statistics:
    """What all items say about a term, for the items of one index."""

    items: int
    mean: float
    terms: np.ndarray  # sorted hashes
    df: np.ndarray


def listed(item: int, text: str) -> tuple[int, np.ndarray, int]:
    """An item, its words, and the word its answer begins with."""
    last = _LAST_SENTENCE.search(text)
    return item, words_of(text), len(words_of(text[: last.end()])) if last else 0


def built(items: list[tuple[int, str]], threshold: float = THRESHOLD) -> list[Index]:
    """Indexes of all items that have words, one for each length class."""
    rows = [row for row in (listed(i, t) for i, t in items if t) if len(row[1])]
    if not rows:
        return []
    terms, df = np.unique(np.concatenate([np.unique(w) for _, w, _ in rows]), return_counts=True)
    return indexed(rows, Statistics(len(rows), float(np.mean([len(w) for _, w, _ in rows])), terms, df), threshold)


def indexed(listed: list[tuple[int, np.ndarray, int]], known: Statistics, threshold: float) -> list[Index]:
    """Indexes of listed items, whose terms are among the known ones."""
    terms, df, mean = known.terms, known.df, known.mean
    idf = np.log1p((known.items - df + 0.5) / (df + 0.5))
    classes: dict[int, list] = {}
    for row in listed:
        window = WINDOW
        while window < len(row[1]):
            window *= 2
        classes.setdefault(window, []).append(row)
    out = []
    for window, rows in sorted(classes.items()):
        rows.sort(key=lambda r: (len(r[1]), r[0]))
        impacts = []
        for _, w, _ in rows:
            u, tf = np.unique(w, return_counts=True)
            at = np.searchsorted(terms, u)
            score = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
            impacts.append(dict(zip(at.tolist(), (score / score.sum()).tolist())))
        own = np.unique(np.concatenate([list(x) for x in impacts]).astype(np.int64))
        place = {t: k for k, t in enumerate(own.tolist())}
        impacts = [{place[t]: v for t, v in x.items()} for x in impacts]
        # the terms of the most items first, as long as no item can get half the threshold from them
        spread = df[own]
        common, sums = np.zeros(len(own), bool), np.zeros(len(rows))
        having: dict[int, list[tuple[int, float]]] = {}
        for i, x in enumerate(impacts):
            for t, v in x.items():
                having.setdefault(t, []).append((i, v))
        for t in np.argsort(-spread, kind="stable").tolist():
            if all(sums[i] + v < threshold / 2 for i, v in having[t]):
                common[t] = True
                for i, v in having[t]:
                    sums[i] += v
        blocks = -(-len(rows) // BLOCK)
        bounds = np.zeros((len(own), blocks), np.float32)
        for i, x in enumerate(impacts):
            for t, v in x.items():
                bounds[t, i // BLOCK] = max(bounds[t, i // BLOCK], np.nextafter(np.float32(v), np.float32(2)))
        rest = np.array([sums[b * BLOCK : (b + 1) * BLOCK].max() for b in range(blocks)])
        out.append(Index(window, terms[own], common, bounds, rest, impacts, np.array([i for i, _, _ in rows]), [w for _, w, _ in rows], [a for _, _, a in rows]))
    return out


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    return Rolling(words).every(n) if len(words) >= n else np.zeros(0, np.uint64)


def overlap(item: np.ndarray, answer: int, around: np.ndarray) -> tuple[float, float, float]:
    """Shares of the words of question, answer and whole item that lie in n-grams of the text around."""
    n = min(GRAM, len(item))
    hit = np.isin(_grams(item, n), _grams(around, n))
    marks = np.zeros(len(item), bool)
    for k in range(n):
        marks[k : k + len(hit)] |= hit
    question, rest = marks[:answer], marks[answer:]
    share = float(rest.mean()) if len(rest) else 1.0
    return (float(question.mean()) if len(question) else share), share, float(marks.mean())


def retrieved(index: Index, words: np.ndarray, cuts: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(document, item, score, first word, last word) of the best window of each item that reaches the threshold."""
    at = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    essential = np.flatnonzero((index.terms[at] == words) & ~index.common[at])
    if not len(essential):
        return
    step = index.window // 4
    n = np.diff(cuts)
    many = np.maximum(-(-np.maximum(n - index.window, 0) // step) + 1, 0) * (n > 0)
    doc = np.repeat(np.arange(len(n)), many)
    low = cuts[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * step
    high = np.minimum(low + index.window, cuts[1:][doc])
    a, b = np.searchsorted(essential, low), np.searchsorted(essential, high)
    # block sums over all occurrences bound those over different terms: most windows end here
    blocks = index.bounds.shape[1]
    alive = np.zeros(len(low), bool)
    for k in range(0, blocks, BLOCKS_AT_ONCE):
        part = slice(k, k + BLOCKS_AT_ONCE)
        sums = np.zeros((len(essential) + 1, len(index.rest[part])))
        np.cumsum(index.bounds[at[essential], part], axis=0, out=sums[1:])
        alive |= (sums[b] - sums[a] + index.rest[part] >= threshold - 1e-6).any(axis=1)
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    for w in np.flatnonzero(alive).tolist():
        inside = np.unique(at[essential[a[w] : b[w]]])
        bound = index.bounds[inside].sum(axis=0, dtype=np.float64) + index.rest
        for block in np.flatnonzero(bound >= threshold - 1e-6).tolist():
            lo, hi = int(low[w]), int(high[w])
            here = at[lo:hi]
            here = set(here[index.terms[here] == words[lo:hi]].tolist())
            for i in range(block * BLOCK, min((block + 1) * BLOCK, len(index.items))):
                score = sum(v for t, v in index.impacts[i].items() if t in here)
                if score >= threshold:
                    key = (int(doc[w]), i)
                    if key not in found or score > found[key][0]:
                        found[key] = (score, lo, hi)
    for (d, i), (score, lo, hi) in found.items():
        yield d, i, score, lo, hi


def _searched(indexes: list[Index], batch: pa.RecordBatch, threshold: float) -> list[tuple]:
    data, offsets = text_buffers(batch.column(1))
    words, cuts = _words(data, offsets)
    ids, rows = batch.column(0).to_pylist(), []
    for index in indexes:
        for d, i, score, lo, hi in retrieved(index, words, cuts, threshold):
            around = words[max(cuts[d], lo - index.window) : min(cuts[d + 1], hi + index.window)]
            question, answer, whole = overlap(index.words[i], index.answers[i], around)
            rows.append((ids[d], int(index.items[i]), score, question, answer, int(lo - cuts[d]), whole))
    return rows


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [row for row in (listed(i, t) for i, t in zip(*(c.to_pylist() for c in batch.columns))) if len(row[1])]
        words = pa.array([w.view(np.int64) for _, w, _ in rows], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), words, pa.array([r[2] for r in rows], pa.int64())], ["item_id", "words", "answer"])


def index_passes(items: DataFrame, threshold: float, index_terms: int) -> Iterator[list[Index]]:
    """The indexes of (item_id, text), pass by pass.

    A pass holds less than `index_terms` words and the last item that begins in it; only its
    own items and the document frequencies of their terms come to the driver."""
    rows = written(items.mapInArrow(_listed, LISTED), "items")
    n, words = rows.agg(F.count(F.lit(1)), F.sum(F.size("words"))).first()
    if not n:
        return
    df = written(rows.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "terms")
    size = F.size("words").cast("long")
    begun = running(rows, [], ["item_id", "words"], size, "upto").withColumn("pass", F.floor((F.col("upto") - size) / index_terms))
    begun = written(begun.drop("upto"), "passes")
    for number in range(-(-words // index_terms)):
        own = begun.where(F.col("pass") == number)
        part = [(r["item_id"], np.array(r["words"], np.int64).view(np.uint64), r["answer"]) for r in own.toArrow().to_pylist()]
        if part:
            found = own.select(F.explode("words").alias("term")).distinct().join(df, "term").toArrow()
            terms, counts = found.column("term").to_numpy().view(np.uint64), found.column("df").to_numpy()
            order = np.argsort(terms)
            yield indexed(sorted(part, key=lambda r: r[0]), Statistics(n, words / n, terms[order], counts[order]), threshold)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, share: float = OVERLAP, id_col: str = "doc_id", text_col: str = "text", index_terms: int = INDEX_TERMS) -> DataFrame:
    """Verified pairs of document and item, with score, overlaps and the first word of the best window.

    `share` is the least overlap of a whole item; `index_terms` bounds the words of the items of
    one pass and changes no result.

    Defined results: null and empty texts, documents without words and items without
    words have no pairs; rows without an id are left out on both sides; equal pairs from
    repeated rows come once, with the best score; other columns are ignored."""
    spark = docs.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = spark.createDataFrame([], FOUND)
    for built_pass in index_passes(items, threshold, index_terms):
        indexes = spark.sparkContext.broadcast(built_pass)

        def each(batches, indexes=indexes):
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    rows = _searched(indexes.value, batch.slice(at, 512), threshold)
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], [c.split()[0] for c in FOUND.split(", ")])

        out = out.union(texts.mapInArrow(each, FOUND))
    best = F.max_by(F.struct("score", "question_overlap", "answer_overlap", "position", "item_overlap"), F.struct("score", F.negative("position"))).alias("best")
    good = out.where(F.col("item_overlap") >= share)
    return good.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose text holds no benchmark item; rows without an id stay.

    Each row is judged by its own text, also where several share an id: a row is known by a
    64-bit hash of its id and text."""
    row = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")))
    keyed = docs.withColumn("_row", row)
    hits = benchmark_hits(keyed, benchmark, id_col="_row", text_col=text_col).select(F.col("doc_id").alias("_hit")).distinct()
    return keyed.join(hits, keyed["_row"] == F.col("_hit"), "left_anti").select(*docs.columns)


def op6_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold which test items: one row for each such pair."""
    return benchmark_hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

"""Set similarity join on word n-grams by vertical partitioning (operator 3).

A document's set holds its distinct shingles of five words.  Two documents link when
the Jaccard similarity of their sets reaches the threshold.

1. Every shingle of every document is counted: packs send their distinct shingles to
   buckets, which answer with a frequency class (the binary logarithm of the number of
   documents).  The global order of the shingles is by class, then by hash.
2. A shingle of one document takes no part in any overlap.  A document of which less
   than the threshold is shared cannot link at all; it is done.
3. The others keep their shared shingles in global order.  Linked documents share one
   within their prefixes, so prefixes cut the candidates into groups that have no link
   between them; equal sets count as one.
4. Inside a group the global order is cut into fragments.  The overlap of each pair is
   counted in each fragment separately and summed over the fragments.  Groups of any
   size are split into blocks, and each pair of blocks is a unit of work; only a
   spanning star of the links leaves it.
5. Components of the links give the answer."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.llm.arrays import BYTE_VALUES, LOWER, U64, Rolling, mixed, window_starts, word_bounds
from airloom.llm.components import components
from airloom.llm.packs import ANSWERS, MESSAGES, Pack, answered, bucket_count, packed, sent, unpacked
from airloom.llm.repeats import _answer, _slices
from airloom.sources.scratch import written

#: Sets of one block, and bytes of their shingles.
BLOCK_SETS = 1024
BLOCK_BYTES = 12 << 20
#: Shingles of one fragment of the global order.
FRAGMENT = 1024
#: Rows of a matrix of pairs that are compared at once.
ROWS = 256
_LOW32 = U64(0xFFFFFFFF)

SETS = "doc_id long, n_shingles long, node long, key binary, prefix array<long>, shared binary, n_shared long"


def shingle_sets(pack: Pack, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each document, end to end, and their offsets."""
    data = LOWER[pack.data]
    starts, ends, offsets = word_bounds(data, pack.offsets)
    rolling = Rolling(Rolling(BYTE_VALUES[data]).of(starts, ends))
    counts = np.diff(offsets)
    at = window_starts(offsets, words)
    hashes = rolling.of(at, at + words)
    size = np.maximum(counts - words + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):  # the whole sequence as one
        whole = mixed(rolling.of(offsets[short], offsets[short + 1]) + counts[short].astype(U64))
        hashes = np.insert(hashes, np.concatenate([[0], np.cumsum(size)])[short], whole)
        size[short] = 1
    cuts = np.concatenate([[0], np.cumsum(size)])
    keep = np.ones(len(hashes), bool)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a > 1:
            mine = hashes[a:b]
            mine.sort()
            keep[a + 1 : b] = mine[1:] != mine[:-1]
    sums = np.concatenate([[0], np.cumsum(keep)])
    return hashes[keep], sums[cuts]


def _counts_out(words: int, buckets: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in unpacked(batches):
            keys, many = np.unique(shingle_sets(pack, words)[0], return_counts=True)
            many = np.minimum(many, 255).astype(np.uint8)
            rows = [(bucket, pack.number, (keys[a:b] & _LOW32).astype(np.uint32).tobytes() + many[a:b].tobytes()) for bucket, a, b in _slices(keys, buckets)]
            if rows:
                yield sent(rows)

    return each


def _classes(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    sizes = [len(r["keys"]) // 5 for r in rows]
    keys = np.concatenate([np.frombuffer(r["keys"], np.uint32, n) for r, n in zip(rows, sizes)])
    many = np.concatenate([np.frombuffer(r["keys"], np.uint8, n, 4 * n) for r, n in zip(rows, sizes)])
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    total = np.add.reduceat(many[order].astype(np.int64), np.flatnonzero(new))
    codes = np.zeros(len(keys), np.uint8)
    codes[order] = np.floor(np.log2(total)).astype(np.uint8)[np.cumsum(new) - 1]
    return _answer(rows[0]["bucket"], [r["pack"] for r in rows], codes, sizes)


def _least_overlap(n: np.ndarray, share: Fraction) -> np.ndarray:
    """The smallest overlap with which a set of n shingles can link: n times the share, rounded up."""
    return -((-n * share.numerator) // share.denominator)


def _candidates(words: int, share: Fraction, buckets: int):
    def each(pack: Pack, answers: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        hashes, offsets = shingle_sets(pack, words)
        keys, where = np.unique(hashes, return_inverse=True)
        codes = np.zeros(len(keys), np.uint8)
        for bucket, a, b in _slices(keys, buckets):
            for got in answers.get(bucket, ()):
                codes[a:b] = np.frombuffer(got, np.uint8)
        classes = codes[where]
        size = np.diff(offsets)
        sums = np.concatenate([[0], np.cumsum(classes > 0)])
        shared = sums[offsets[1:]] - sums[offsets[:-1]]
        least = _least_overlap(size, share)
        key, prefix, tokens = [None] * len(size), [None] * len(size), [None] * len(size)
        seen: dict[bytes, int] = {}
        for i in np.argsort(pack.ids, kind="stable").tolist():
            if not size[i] or shared[i] < least[i]:
                continue
            mine, kind = hashes[offsets[i] : offsets[i + 1]], classes[offsets[i] : offsets[i + 1]]
            key[i] = np.array([mixed(mine).sum(), mixed(mine ^ U64(0x5851F42D4C957F2D)).sum() + U64(size[i])]).tobytes()
            if key[i] in seen:
                continue
            seen[key[i]] = i
            order = np.argsort(kind, kind="stable")
            order = order[int(size[i] - shared[i]) :]
            tokens[i] = mine[order].tobytes()
            prefix[i] = mine[order[: int(shared[i] - least[i]) + 1]].view(np.int64)
        nodes = (np.int64(pack.number) << 16) | np.arange(len(size))
        yield pa.RecordBatch.from_arrays(
            [pa.array(pack.ids), pa.array(size), pa.array(nodes), pa.array(key, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(tokens, pa.binary()), pa.array(shared)],
            [c.split()[0] for c in SETS.split(", ")],
        )

    return each


def overlaps(tokens: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two sets share: partial counts of each fragment of the order, summed."""
    m = len(tokens)
    total = np.zeros((m, m), np.int32)
    flat = np.concatenate(tokens) if m else np.zeros(0, U64)
    of = np.repeat(np.arange(m), [len(t) for t in tokens])
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.concatenate([starts, [len(flat)]]))
    for k in np.unique(sizes[sizes > 1]).tolist():
        at = starts[sizes == k]
        if k <= 24:  # rare tokens: the pairs of their few sets
            for i in range(k):
                for j in range(i + 1, k):
                    np.add.at(total, (of[at + i], of[at + j]), 1)
    common = np.flatnonzero(sizes > 24)
    for lo in range(0, len(common), FRAGMENT):
        part = common[lo : lo + FRAGMENT]
        present = np.zeros((m, len(part)), np.float32)
        for j, c in enumerate(part.tolist()):
            present[of[starts[c] : starts[c] + sizes[c]], j] = 1
        for at in range(0, m, ROWS):  # only what lies right of the diagonal
            total[at : at + ROWS, at:] += np.triu(present[at : at + ROWS] @ present[at:].T, 1).astype(np.int32)
    for at in range(0, m, ROWS):
        total[at:, at : at + ROWS] |= total[at : at + ROWS, at:].T
    return total


def linked(sizes: np.ndarray, tokens: list[np.ndarray], share: Fraction) -> np.ndarray:
    """The matrix of links."""
    both = overlaps(tokens)
    out = np.empty(both.shape, bool)
    for at in range(0, len(sizes), ROWS):
        some = both[at : at + ROWS].astype(np.int64)
        union = sizes[at : at + ROWS, None] + sizes[None, :] - some
        out[at : at + ROWS] = some * share.denominator >= union * share.numerator
    np.fill_diagonal(out, False)
    return out


def _roots(links: np.ndarray) -> np.ndarray:
    """The least index that each row reaches."""
    n = len(links)
    root, reach = np.arange(n), np.empty(n, np.int64)
    while True:
        for at in range(0, n, ROWS):
            reach[at : at + ROWS] = np.where(links[at : at + ROWS], root[None, :], n).min(axis=1, initial=n)
        fresh = np.minimum(root, reach)
        fresh = fresh[fresh]
        if (fresh == root).all():
            return root
        root = fresh


def _blocks(share: Fraction):
    def each(table: pa.Table) -> pa.Table:
        frame = table.select(["task", "block", "cross", "node", "n_shingles", "shared"]).to_pandas()
        nodes, roots, links = [], [], []
        for _, part in frame.groupby("task", sort=False):
            part = part.sort_values("node")
            node, block = part["node"].to_numpy(), part["block"].to_numpy()
            matrix = linked(part["n_shingles"].to_numpy(), [np.frombuffer(t, U64) for t in part["shared"]], share)
            if part["cross"].iloc[0]:
                matrix &= block[:, None] != block[None, :]
            root = _roots(matrix)
            nodes.append(node)
            roots.append(node[root])
            links.append(matrix.sum(axis=1))
        return pa.table([np.concatenate(nodes), np.concatenate(roots), np.concatenate(links).astype(np.int64)], ["a", "b", "links"])

    return each


def _bins(sized: DataFrame) -> int:
    """Bins of about BLOCK_BYTES, from blocks and tokens of the groups: each block of a group holds its sets once more."""
    total = sized.agg(F.sum(F.col("tokens").cast("double") * F.col("blocks"))).first()[0] or 0
    return max(8, int(total * 8 / BLOCK_BYTES) + 1)


def ngram_join(docs: DataFrame, words: int = 5, share: Fraction = Fraction(75, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (different linked sets) of every document.

    Defined results: words are runs of anything but space, tab, newline, vertical tab,
    form feed and return, with A-Z in lower case; a text of fewer words than a shingle is
    one shingle; a null or empty text has none and is linked with nothing; documents of
    equal sets are linked; rows with equal ids are separate documents; rows without an id
    are left out; other columns are ignored; an empty table gives an empty result."""
    packs = packed(docs, id_col, text_col)
    buckets = bucket_count(packs, 0.85)
    classes = packs.mapInArrow(_counts_out(words, buckets), MESSAGES).groupBy("bucket").applyInArrow(_classes, ANSWERS)
    sets = written(answered(packs, classes, _candidates(words, share, buckets), SETS), "sets")

    # one set for equal ones: the smallest document holds the shingles
    alike = sets.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.min(F.struct(F.col("shared").isNull().alias("none"), "doc_id", "node"))["node"].alias("node"))
    alike = written(alike, "alike")
    held = sets.where("shared is not null").join(alike.select("node"), "node", "left_semi")

    tokens = written(held.select("node", F.explode("prefix").alias("token")), "prefixes")
    hubs = tokens.groupBy("token").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("token", "hub")
    groups = components(tokens.join(hubs, "token").select(F.col("node").alias("a"), F.col("hub").alias("b")).where("a <> b").distinct())

    grouped = written(held.select("node", "n_shingles", "shared", "n_shared").join(groups, "node"), "grouped")
    sized = grouped.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n_shared").alias("tokens"))
    sized = sized.select("root", "tokens", F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("tokens") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    bins = _bins(sized)
    placed = grouped.join(sized.select("root", "blocks"), "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a set meets each block of its group; a block meets itself in (i, i)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = placed.select("root", "block", "node", "n_shingles", "shared", other)
    placed = placed.select(F.struct("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).alias("unit"), "block", (F.col("block") != F.col("other")).alias("cross"), "node", "n_shingles", "shared")
    placed = placed.withColumn("task", F.xxhash64("unit")).withColumn("bin", F.pmod("task", F.lit(bins)))
    found = written(placed.groupBy("bin").applyInArrow(_blocks(share), "a long, b long, links long"), "links")

    # links of one block pair are stars; over several pairs they are joined here
    roots = components(found.select("a", "b").where("a <> b"))
    named = alike.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component"))
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = named.join(least, "root").join(counts, "node", "left").select(F.col("key").alias("set_key"), "component", F.coalesce("links", F.lit(0)).alias("links"))
    return sets.join(named, sets["key"] == named["set_key"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links")
    )


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the smallest id of their group, with all their columns.

    Rows without an id stay; rows with equal ids stay or go together."""
    linked = ngram_join(docs, id_col=id_col, text_col=text_col)
    later = linked.groupBy("doc_id").agg(F.min("component_id").alias("least")).where("least < doc_id").select(F.col("doc_id").alias("_later"))
    return docs.join(later, docs[id_col] == F.col("_later"), "left_anti")


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))

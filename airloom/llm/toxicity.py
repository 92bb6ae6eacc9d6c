"""Toxicity by class-conditional Kneser-Ney models (operator 2).

Two bigram models are learned from labelled texts, one of toxic and one of ordinary
ones, over whole words (A-Z in lower case); of scripts that write no spaces, such as Han,
kana and Thai, each character is a word.  Counts are those of Kneser and Ney: a bigram
counts the different words before it, a word the different words before it, so copies of
a text add nothing.  What the two classes share is moved
to both alike: a class keeps an excess over the share that the company of a word lets expect
(so a language or topic that one class has more of tells nothing), and only where it is larger
than chance explains (a discount of some standard deviations; held-back rows choose from CHANCES).  Bigrams back off to the words of the class,
and these to how often each word stands in all documents, whatever their label; the
share of probability that goes to the backoff is the same for both classes.  A rare
expression therefore gets the same probability from both models, and only words that a
class has made its own tell them apart.  The score compares the two log-likelihoods,
divided by the number of words, and a logistic curve fitted on labelled texts that the
counts have not seen puts it between 0 and 1.

Bounds.  The class counts come from a sample of the labelled rows of about SAMPLE_WORDS
words of text, half of each class (whole texts, chosen by a hash of the id); so the tables
that every worker gets have a proven bound, which is checked before they are sent.
The shared counts cover every word of every document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.llm.arrays import BYTE_VALUES, LOWER, U64, Rolling, mixed, word_bounds
from airloom.llm.packs import text_buffers
from airloom.shipping import ship_package
from airloom.sources.scratch import written

#: Words of labelled text that the class counts are taken from, about.
SAMPLE_WORDS = 3_000_000
#: The excess of a class that chance may explain, in standard deviations; the curve's rows choose.
CHANCES = (1.0, 1.5, 2.0, 3.0, 4.0)
#: Neighbours of which a word's toxic share counts half.
COMPANY = 10.0
#: Bytes of texts that are scored at once.
PIECE = 2 << 20
#: The discount of the models.
DISCOUNT = 0.75
#: Anything but ASCII letters and bytes of other scripts parts words here.
PARTS = np.ones(256, bool)
PARTS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: First two bytes, from and to, of characters that are words of their own: Thai and Lao, Burmese, Khmer, kana and Han.
SINGLE = ((0xE0B8, 0xE0BB), (0xE180, 0xE182), (0xE19E, 0xE19F), (0xE380, 0xE9FF), (0xEFA4, 0xEFAB), (0xEFBD, 0xEFBE), (0xF0A0, 0xF0BF))
#: The same characters as code points, for the count of words in Spark.
_SINGLE_CHARS = r"[\x{E00}-\x{EFF}\x{1000}-\x{10BF}\x{1780}-\x{17FF}\x{3000}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF40}-\x{FFBF}\x{20000}-\x{2FFFF}]"
_WORD_RUN = r"[A-Za-z\x{80}-\x{10FFFF}]++"
_EDGE = U64(0)


def _single(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bounds of words, with each character of SINGLE apart."""
    lead = np.flatnonzero(data[:-1] >= 0xE0)
    first = data[lead].astype(np.int32) << 8 | data[lead + 1]
    lead = lead[np.logical_or.reduce([(first >= a) & (first <= b) for a, b in SINGLE])]
    if not len(lead):
        return starts, ends, cuts
    more = np.concatenate([lead, lead + np.where(data[lead] >= 0xF0, 4, 3)])
    of = np.searchsorted(starts, more, "right") - 1
    every = np.union1d(starts, more[more < ends[of]])
    last = ends[np.searchsorted(starts, every, "right") - 1]
    return every, np.minimum(np.append(every[1:], last[-1]), last), np.searchsorted(every, offsets)


def _words(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a text column, and the offsets of its rows."""
    data, offsets = text_buffers(array)
    data = LOWER[data]
    starts, ends, cuts = _single(data, offsets, *word_bounds(data, offsets, PARTS))
    return Rolling(BYTE_VALUES[data]).of(starts, ends), cuts


def _pairs(words: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The word before each word; none before the first of a text."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[cuts[:-1][np.diff(cuts) > 0]] = _EDGE
    return before


def _spot(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(before * U64(0x9E3779B97F4A7C15) + word)


def _alike(counts: np.ndarray) -> np.ndarray:
    """Counts of both classes (rows) on one scale."""
    sums = np.maximum(counts.sum(axis=1), 1)
    return counts * (sums.mean() / sums)[:, None]


def _moved(counts: np.ndarray, chance: float, share: np.ndarray) -> np.ndarray:
    """Counts of both classes on one scale, each excess over the expected toxic share less what chance explains."""
    counts = _alike(counts)
    total = counts.sum(axis=0)
    excess = counts[1] - total * share
    excess = np.sign(excess) * np.maximum(np.abs(excess) - chance * np.sqrt(total * share * (1 - share)), 0)
    excess = np.clip(excess, -total / 2, total / 2)
    return np.stack([total / 2 - excess, total / 2 + excess])


class Counts:
    """What the models are made of.  Rows of the arrays are the ordinary and the toxic class."""

    def __init__(self, bigrams: np.ndarray, before: np.ndarray, word: np.ndarray, kinds: np.ndarray):
        """Bigrams by ascending key, with the number of different words before each in each class."""
        self.bigrams, self.kinds = bigrams, kinds.astype(np.float64)
        self.words = np.unique(np.concatenate([word, before]))
        self.of_word, self.of_before = np.searchsorted(self.words, word), np.searchsorted(self.words, before)
        self.expected = self._company()

    def _company(self) -> np.ndarray:
        """The toxic share of each word's neighbours, on both sides; frequent ones say more.

        A word of a language or topic that one class has more of keeps the company of words with
        the same surplus, which is then expected; a word that stands out of its company is not."""
        n, kinds = len(self.words), _alike(self.kinds)
        pair, sides = kinds.sum(axis=0), (self.of_word, self.of_before)
        toxic, every = (sum(np.bincount(side, weights=k, minlength=n) for side in sides) for k in (kinds[1], pair))
        trust = np.where(self.words == _EDGE, 0.0, every / (every + COMPANY))
        expected = np.full(n, 0.5)
        for _ in range(2):  # a rare word's own share leans on what its neighbours let expect
            share = (toxic + COMPANY * expected) / (every + COMPANY)
            said, heard = np.zeros(n), np.zeros(n)
            for of, by in (sides, sides[::-1]):
                said += np.bincount(of, weights=pair * trust[by] * share[by], minlength=n)
                heard += np.bincount(of, weights=pair * trust[by], minlength=n)
            expected = np.clip((said + 0.05) / (heard + 0.1), 0.02, 0.98)
        return expected

    def model(self, counts: np.ndarray, total: float, chance: float) -> Model:
        """Both class models over the counts of all documents."""
        n = len(self.words)
        base = (counts + 1.0) / (total + n + 1.0)
        own = _moved(np.stack([np.bincount(self.of_word, weights=k > 0, minlength=n) for k in self.kinds]), chance, self.expected)
        every = np.maximum(own.sum(axis=1, keepdims=True), 1e-9)
        spread = np.minimum(own, DISCOUNT).sum() / max(own.sum(), 1e-9)
        lower = np.maximum(own - DISCOUNT, 0) / every + max(spread, 1e-3) * base
        pairs = _moved(self.kinds, chance, (self.expected[self.of_word] + self.expected[self.of_before]) / 2)
        history = np.stack([np.bincount(self.of_before, weights=k, minlength=n) for k in pairs])
        left = np.bincount(self.of_before, weights=np.minimum(pairs, DISCOUNT).sum(axis=0), minlength=n) / np.maximum(history.sum(axis=0), 1e-9)
        pair = np.maximum(pairs - DISCOUNT, 0) / np.maximum(history, 1e-9)[:, self.of_before] + np.maximum(left, 1e-3)[self.of_before] * lower[:, self.of_word]
        # a bigram that no class has made its own backs off to its word, and need not be sent
        own_say = np.abs(pairs[1] - pairs[0]) > 1e-9
        return Model(self.words, np.log(lower[1]) - np.log(lower[0]), self.bigrams[own_say], (np.log(pair[1]) - np.log(pair[0]))[own_say])


class Model:
    """Logarithms of the toxic over the ordinary probability, of words and of bigrams with a say."""

    def __init__(self, words: np.ndarray, single: np.ndarray, bigrams: np.ndarray, pair: np.ndarray):
        self.words, self.single = words, single.astype(np.float32)
        self.bigrams, self.pair = bigrams, pair.astype(np.float32)
        self.slope, self.level, self.empty = 1.0, 0.0, 0.0

    def gain(self, words: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By text: the toxic log-likelihood less the ordinary one, over the number of words; and that number."""
        before = _pairs(words, cuts)
        at, known = _spot(self.words, words)
        each = np.where(known, self.single[at], 0) if len(self.words) else np.zeros(len(words))
        if len(self.bigrams):
            pair, have = _spot(self.bigrams, _key(before, words))
            each = np.where(have, self.pair[pair], each)
        n = np.diff(cuts)
        sums = np.concatenate([[0.0], np.cumsum(each, dtype=np.float64)])
        return np.where(n > 0, (sums[cuts[1:]] - sums[cuts[:-1]]) / np.maximum(n, 1), self.empty), n

    def score(self, gain: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * gain + self.level, -50, 50)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different trigrams of each class in each batch of labelled texts."""
    for batch in batches:
        words, cuts = _words(batch.column(0))
        if not len(words):
            continue
        before = _pairs(words, cuts)
        toxic = np.repeat(batch.column(1).to_numpy(zero_copy_only=False) == 1, np.diff(cuts))
        pair = _key(before, words)
        trigram = _key(_pairs(before, cuts), pair) ^ toxic.astype(U64)
        _, first = np.unique(trigram, return_index=True)
        columns = [x[first].view(np.int64) for x in (trigram, pair, before, words)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(toxic[first].astype(np.int32))], ["trigram", "key", "before", "word", "toxic"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _word_count(text: F.Column) -> F.Column:
    """Runs of letters, and characters that are words of their own."""
    marks = F.regexp_replace(text, _WORD_RUN, "w")
    return F.length(marks) - F.length(F.replace(marks, F.lit("w"), F.lit(""))) + F.length(text) - F.length(F.regexp_replace(text, _SINGLE_CHARS, ""))


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def _fitted_curve(gains: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and level of the logistic curve, by Newton steps with a light prior on the slope.

    Both classes weigh the same in sum, so a score of 0.5 favours neither."""
    if not toxic.any() or toxic.all():
        return 1.0, (-10.0 if not toxic.any() else 10.0)
    scale = gains.std() or 1.0
    x = np.stack([gains / scale, np.ones_like(gains)], axis=1)
    weight = np.where(toxic, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean()))
    at, prior = np.zeros(2), np.diag([1e-2, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (weight * (p - toxic)) + prior @ at
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + prior, slope)
        at -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0] / scale), float(at[1])


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_words: int = SAMPLE_WORDS) -> Model:
    """The models, from labelled rows outside the held-out fifth and all texts.

    Of these rows a quarter (by hash) fits the curve only.  A row that `labels` names
    several times counts as toxic if one of its labels says so; null labels count as
    none."""
    spark = docs.sparkSession
    texts = _texts(docs, id_col, text_col)
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.where(~held_out())
    # ids and sizes only; the texts of the sample are read once it is chosen
    sizes = texts.select("doc_id", F.length("text").alias("letters"), _word_count(F.col("text")).alias("words")).where("letters > 0")
    rows = written(sizes.join(marks, "doc_id"), "labelled-sizes")
    # about as many words of each class, so that the rare words of neither weigh more
    found = {r["toxic"]: r["words"] for r in rows.groupBy("toxic").agg(F.sum("words").alias("words")).collect()}
    room = sample_words / 2
    if len(found) > 1:
        room = min(room, *found.values())
    share = F.create_map(*[F.lit(x) for k, v in found.items() for x in (k, min(1.0, room / max(v, 1)))]) if found else F.create_map(F.lit(0), F.lit(1.0))
    pick = (F.pmod(F.xxhash64("doc_id", F.lit("pick")), F.lit(1 << 30)) / (1 << 30)) < share[F.col("toxic")]
    curve = F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(4)) == 0
    chosen = rows.where(pick).select("doc_id", "toxic").distinct()
    sample = written(texts.join(F.broadcast(chosen), "doc_id").where(F.length("text") > 0), "sample")  # as bounded as the sample

    counted = sample.where(~curve).select("text", "toxic").mapInArrow(_counted, "trigram long, key long, before long, word long, toxic int")
    once = counted.groupBy("trigram", "toxic").agg(*[F.first(c).alias(c) for c in ("key", "before", "word")])
    kinds = [F.sum((F.col("toxic") == k).cast("long")).alias(name) for k, name in ((0, "ordinary"), (1, "toxic_kinds"))]
    table = once.groupBy("key").agg(F.first("before").alias("before"), F.first("word").alias("word"), *kinds)
    bigrams = table.limit(2 * sample_words).toArrow()
    if bigrams.num_rows >= 2 * sample_words:
        raise ValueError("the sample of labelled texts has more bigrams than its bound allows")
    col = lambda name: bigrams.column(name).to_numpy().view(U64)
    order = np.argsort(col("key"))
    counts = np.stack([bigrams.column("ordinary").to_numpy(), bigrams.column("toxic_kinds").to_numpy()])[:, order]
    made = Counts(col("key")[order], col("before")[order], col("word")[order], counts)

    # how often all documents have each known word: partial sums by task, added up by word
    known = spark.sparkContext.broadcast(made.words)

    def everywhere(batches):
        sums, total = np.zeros(len(known.value), np.int64), 0
        for batch in batches:
            words, _ = _words(batch.column(0))
            at, have = _spot(known.value, words)
            sums += np.bincount(at[have], minlength=len(sums))
            total += len(words)
        some = np.flatnonzero(sums)
        for lo in range(0, len(some), 100_000):
            part = some[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(sums[part])], ["at", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([total], pa.int64())], ["at", "n"])

    shared = texts.select("text").mapInArrow(everywhere, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    known.destroy()
    at, n = shared.column("at").to_numpy(), shared.column("n").to_numpy()
    counts = np.zeros(len(made.words))
    counts[at[at >= 0]] = n[at >= 0]
    total = float(n[at < 0].sum())

    # the curve's rows also say how much of an excess chance explains
    tried = [made.model(counts, total, chance) for chance in CHANCES]
    sent = spark.sparkContext.broadcast(tried)

    def gained(batches):
        for batch in batches:
            words, cuts = _words(batch.column(0))
            columns = [pa.array(m.gain(words, cuts)[0]) for m in sent.value]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], [*[f"g{i}" for i in range(len(columns))], "toxic"])

    schema = ", ".join(f"g{i} double" for i in range(len(tried))) + ", toxic int"
    seen = sample.where(curve).select("text", "toxic").mapInArrow(gained, schema).toArrow()
    sent.destroy()
    toxic = seen.column("toxic").to_numpy() == 1
    losses = []
    for i, model in enumerate(tried):
        gains = seen.column(f"g{i}").to_numpy()
        model.slope, model.level = _fitted_curve(gains, toxic)
        model.empty = float(np.median(gains[~toxic])) if not toxic.all() else 0.0
        p = np.clip(model.score(gains), 1e-6, 1 - 1e-6)
        losses.append(-np.mean(np.log(np.where(toxic, p, 1 - p))) if len(p) else 0.0)
    return tried[int(np.argmin(losses))]


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, gain (difference of the log-likelihoods a word) and score of every row.

    Defined results: a text without words is scored like the middle ordinary one; rows without
    an id stay; repeated rows each have their score; other columns are ignored."""
    texts = _texts(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        for batch in batches:
            gain, _ = sent.value.gain(*_words(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gain), pa.array(sent.value.score(gain))], ["doc_id", "gain", "score"])

    return texts.mapInArrow(each, "doc_id long, gain double, score double")


def nontoxic(docs: DataFrame, labels: DataFrame, cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose text scores under the cut, with all their columns; rows without an id stay.

    Each row is judged by its own text, also where several share an id; nothing is joined."""
    model = fitted(docs, labels, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        # a batch has a number of rows, not of bytes
        ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
        gains, at = [np.zeros(0)], 0
        while at < len(text):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
            gains.append(sent.value.gain(*_words(text.slice(at, end - at)))[0])
            at = end
        return pa.array(sent.value.score(np.concatenate(gains)))

    return docs.where(F.col(id_col).isNull() | (score(F.col(text_col).cast("string")) < cut))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity(docs, fitted(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "gain")

"""Question search from an index: postings of tokens, and character grams of the tokens.

The index is written once over whole texts, in segments: each task writes the postings of the
texts dealt to it as one file, sorted by token, so no posting is shuffled.  `postings` lists the texts of
each token, `grams` the tokens of each run of three characters (shorter at the end of a token).
Both are sorted by what they are asked by, so a question reads the pages of its buckets or grams
in each segment, and no text.  Tokens that contain a word of the question have all of its trigrams,
or a gram that begins with a shorter word; those that have them are checked
by the exact rule of `operators.search`.  Texts are read only for the bonus of a whole phrase, and
only those that hold a token for every word of the question.

A token of most texts has its rows in all segments.  Results equal `search.search`."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.functions.numeric import rounded
from airloom.operators.search import BITS, STOP_WORDS, _accepted, expanded, query_tokens
from airloom.sources.scratch import fresh_path, written
from airloom.sources.tables import fingerprint, table

GRAM = 3
#: Buckets of an index, letters of the texts of a segment (a row counts as ROW more), ranges of
#: grams that a question reads, and tokens of a question that are still broadcast.
BUCKETS, LETTERS, ROW, RANGES, FEW = 4096, 8 << 20, 64, 64, 500_000


@dataclass
class Index:
    """Paths of the tables, the texts they were made of and the names of their columns."""

    keys: str
    postings: str
    grams: str
    docs: DataFrame
    key: str
    text: str
    category: str


def _table(index: Index, name: str) -> DataFrame:
    """A sorted table of the index; one without rows has no files to tell its columns."""
    kind = lambda c: index.docs.schema[c].dataType.simpleString()
    columns = "gram string, token string" if name == "grams" else f"bucket int, token string, key {kind(index.key)}, category {kind(index.category)}"
    return index.docs.sparkSession.read.schema(columns).parquet(getattr(index, name))


def _bucket(column: str, buckets: int = BUCKETS):
    return F.expr(f"cast(pmod(xxhash64({column}), {buckets}) as int)")


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", category: str = "source", tasks: int | None = None) -> Index:
    """Write the index of `docs`.  Files may hold few, large row groups, so texts are dealt to `tasks` segments first."""
    spark = docs.sparkSession
    index = Index(*(fresh_path(spark, f"index-{n}") for n in ("keys", "postings", "grams")), docs, key, text, category)
    if not tasks:
        size = docs.agg(F.sum(F.coalesce(F.length(text), F.lit(0)).cast("long") + ROW)).first()[0] or 0
        tasks = max(spark.sparkContext.defaultParallelism, -(-size // LETTERS))
    clean = F.regexp_replace(F.lower(F.concat_ws(" ", text, category)), r"[^\w\s]+", "")
    # array_except leaves each token of a text once; a row that comes twice has its postings twice, which no mask shows
    tokens = F.array_except(F.split(clean, r"\s+"), F.array(*[F.lit(w) for w in ("", *STOP_WORDS)]))
    docs.select(F.col(key).alias("key"), F.col(category).alias("category")).distinct().write.parquet(index.keys)
    found = docs.repartition(tasks).select(F.col(key).alias("key"), F.col(category).alias("category"), F.explode(tokens).alias("token"))
    found.select(_bucket("token").alias("bucket"), "token", "key", "category").sortWithinPartitions("bucket", "token").write.parquet(index.postings)
    grams = f"transform(sequence(1, length(token)), i -> substring(token, i, {GRAM}))"
    pairs = _table(index, "postings").select("token").distinct().select(F.explode(F.array_distinct(F.expr(grams))).alias("gram"), "token")
    pairs.sortWithinPartitions("gram").write.parquet(index.grams)
    return index


def _having(index: Index, asked: list[str]) -> DataFrame:
    """(gram, token): the tokens that have some asked grams; one of less than GRAM characters begins others."""
    step = -(-len(asked) // RANGES)
    parts = [asked[i : i + step] for i in range(0, len(asked), step)]
    prefixes = [F.substring("gram", 1, n) for n in sorted({len(g) for g in asked})]
    # the ranges tell which pages to read, the set which of their rows
    read = reduce(or_, [F.col("gram").between(p[0], p[-1] + "~" * GRAM) for p in parts])
    rows = _table(index, "grams").filter(reduce(or_, [p.isin(asked) for p in prefixes]) & read)
    return rows.select(F.explode(F.array_distinct(F.array(*prefixes))).alias("gram"), "token")


def matches(index: Index, words: list[str]) -> DataFrame:
    """(token, mask0, ..): the tokens of the index that match words of a question, bit i of the masks for the i-th."""
    spark = index.docs.sparkSession
    place = {w: i for i, w in enumerate(words)}
    asked = [(w, g, len(gs)) for w in words if " " not in w for gs in [{w[i : i + GRAM] for i in range(max(1, len(w) - GRAM + 1))}] for g in sorted(gs)]
    inside = [(t, place[w]) for w in words for t in sorted(_accepted(w) - set(STOP_WORDS))]
    pairs = spark.createDataFrame(inside, "token string, place int")
    if asked:
        question = F.broadcast(spark.createDataFrame([(w, place[w], g, n) for w, g, n in asked], "word string, place int, gram string, n int"))
        having = _having(index, sorted({g for _, g, _ in asked})).join(question, "gram")
        having = having.groupBy("token", "word", "place", "n").agg(F.count(F.lit(1)).alias("grams"))
        pairs = pairs.unionByName(having.filter((F.col("grams") >= F.col("n")) & F.col("token").contains(F.col("word"))).select("token", "place"))
    masks = [F.bit_or(F.when(F.expr(f"place div {BITS}") == c, F.expr(f"shiftleft(1L, place % {BITS})")).otherwise(0)).alias(f"mask{c}") for c in range(-(-len(words) // BITS))]
    return written(pairs.groupBy("token").agg(*masks).withColumn("bucket", _bucket("token")), "matches")


def search_index(index: Index, query: str, least: float = 0.2) -> DataFrame:
    """Key, category and score of the texts that score above `least`, best first, as `search.search`."""
    spark, tokens = index.docs.sparkSession, query_tokens(query)
    named = [F.col("key").alias(index.key), F.col("category").alias(index.category)]
    keys = spark.read.parquet(index.keys)
    if not tokens:
        every = index.docs.select(index.key, index.category, F.lit(1.0).alias("score"))
        return (every.filter(F.col("score") > least) if query.strip() else every).orderBy(F.desc("score"), index.key)
    words = expanded(tokens)
    found = matches(index, words)
    buckets = [r[0] for r in found.select("bucket").distinct().collect()]
    few = F.broadcast(found) if found.count() <= FEW else found
    masks = [c for c in found.columns if c.startswith("mask")]
    hits = _table(index, "postings").filter(F.col("bucket").isin(buckets)).join(few, ["bucket", "token"])
    hits = hits.groupBy("key", "category").agg(*[F.bit_or(m).alias(m) for m in masks])
    hits = written(hits, "hits")
    # a word inside a stop word can be in a text that has no token for it
    sure = [i for i, w in enumerate(words) if w in tokens and not any(w in stop for stop in STOP_WORDS)]
    if not sure or least < 0 or not query.strip():
        rest = keys.join(hits, keys["key"].eqNullSafe(hits["key"]) & keys["category"].eqNullSafe(hits["category"]), "left_anti")
        hits = hits.unionByName(rest.select("*", *[F.lit(0).cast("long").alias(m) for m in masks]))
    all_there = F.lit(True)
    for i in sure:
        all_there = all_there & (F.col(f"mask{i // BITS}").bitwiseAND(F.lit(1 << (i % BITS))) != 0)
    phrase = _with_phrase(index, hits.filter(all_there), query)
    count = sum((F.bit_count(m) for m in masks[1:]), F.bit_count(masks[0]))
    scored = hits.join(phrase, hits["key"].eqNullSafe(phrase["_key"]) & hits["category"].eqNullSafe(phrase["_category"]), "left")
    scored = scored.select(*named, rounded(count / len(tokens) + F.coalesce("_phrase", F.lit(0)), 6).alias("score"))
    return (scored.filter(F.col("score") > least) if query.strip() else scored).orderBy(F.desc("score"), index.key)


def _with_phrase(index: Index, hits: DataFrame, query: str) -> DataFrame:
    """The texts among `hits` that hold the whole question."""
    spark, schema = hits.sparkSession, hits.schema
    kinds = f"_key {schema['key'].dataType.simpleString()}, _category {schema['category'].dataType.simpleString()}, _phrase int"
    if hits.isEmpty():
        return spark.createDataFrame([], kinds)
    texts = index.docs.select(F.col(index.key).alias("_key"), F.col(index.category).alias("_category"), F.col(index.text).alias("_text"))
    asked = hits.select("key", "category")
    same = asked["key"].eqNullSafe(texts["_key"]) & asked["category"].eqNullSafe(texts["_category"])
    return texts.join(asked, same, "left_semi").filter(F.lower("_text").contains(query.lower())).select("_key", "_category", F.lit(1).alias("_phrase")).distinct()


_built: dict[tuple, Index] = {}


def kept_index(spark: SparkSession, folder: str, name: str, key: str, text: str, category: str) -> Index:
    """The index of a table, built once per application and state of its files."""
    state = (spark.sparkContext.applicationId, folder, fingerprint(spark, folder, (name,)), key, text, category)
    if state not in _built:
        _built[state] = build(table(spark, folder, name), key, text, category)
    return _built[state]

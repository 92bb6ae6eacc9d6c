"""Mixing sources to target weights by systematic sampling.

Every source gets a target in words: all sources share a budget by weight, none above `most`
times its own size, and what is above is shared again among the others.  A document's copies
are the integers that the running sum of expected copies crosses, from one random offset a
source, so the copies of any run of documents are within one of what is expected.

The running sum goes by classes of size (powers of four), the longest documents first.  The
expected copies of a class are what is left of the target over the words left, 0 to `most`: a
long document that came or did not come is made up for by shorter ones, and a source misses
its target by about one of its shortest documents.  The documents themselves are numbered
once, whatever their class is given, so a class costs one sum a source.  Sums are of 32 binary
places, so no order of addition shows in them; the order among equal sizes and the offset
come from hashes with a seed.  A source that holds most rows is cut into sampled ranges like any
other (`operators.ranges`); texts are read once for their size and never shuffled.

Defined results: a null text has size 0; documents without words are taken like others and
add no words; a null source is a source of its own and comes last; null and repeated ids stay, each
row is sampled by itself; rows equal in id, source and text are alike, so any of them may get the
copy; a source without words has target 0 and is left out; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airloom.operators.ranges import numbered
from airloom.sources.scratch import written

_BLANK = " \t\n\x0b\f\r"
_WORD = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"
#: Binary places of an expected number of copies.
PLACES = 32
SEED = 11
#: Rows of a plan (a row for a source, or for a source and class) that are still broadcast: some
#: 20 MB.  Beyond, Spark shuffles both sides and splits the documents of a hot source by itself.
FEW = 200_000
WEIGHTS, BUDGET, MOST = (3, 1, 2), (3, 2), 2


def words(text: Column) -> Column:
    """The number of words: each one becomes one letter, which takes no list of words.  Without
    the white space at the end every match ends in a word, so no text takes more than one walk."""
    return F.length(F.regexp_replace(F.rtrim(F.coalesce(text, F.lit("")), F.lit(_BLANK)), _WORD, "w")).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: tuple[int, int] = BUDGET, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    `weights` repeat over the sources by code point, null last; `budget` is the share of all
    sizes to be taken, as a fraction; `most` is the largest target in sizes of the source.  Each
    round caps what is above and shares the rest again: a round only needs three sums."""
    totals = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    placed = numbered(totals, [], [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    weighed = written(placed.select("source", "source_size", weight.alias("weight")), "source-weights")
    upper, lower = budget
    wide = lambda c: F.col(c).cast("decimal(20,0)")

    def above(left: int, shares: int) -> Column:
        """Whether weight * left / shares, in parts of `lower`, is more than the cap."""
        return wide("weight") * F.lit(str(left)).cast("decimal(18,0)") >= wide("source_size") * F.lit(str(most * lower * shares)).cast("decimal(18,0)")

    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    left, shares, capped = upper * total["size"], total["weight"], -1
    while shares:
        over = above(left, shares)
        now = weighed.agg(
            F.count_if(over).alias("n"),
            F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)).alias("size"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("weight"),
        ).first()
        if now["n"] == capped:
            break
        left, shares, capped = upper * total["size"] - most * lower * now["size"], now["weight"], now["n"]
    cap = (F.col("source_size") * most).cast("double")
    shared = (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(lower * shares)) if shares else cap
    target = F.when(above(left, shares), cap).otherwise(shared) if shares else cap
    return weighed.select("source", "source_size", target.alias("target"))


def copies(docs: DataFrame, weights: Sequence[int] = WEIGHTS, budget: tuple[int, int] = BUDGET, most: int = MOST, seed: int = SEED, row: str | None = None) -> DataFrame:
    """(doc_id, row, size, source_size, target, copies) for every row of (doc_id, text, source).

    `row` names a column of numbers that tells rows of one id apart; without one a hash of
    the text does."""
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    size = words(text)
    rows = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), (F.col(row) if row else F.xxhash64(text)).alias("row"), size.alias("size"))
        .withColumn("_class", F.when(F.col("size") > 0, F.expr("(length(bin(size)) + 1) div 2")).otherwise(0).cast("int"))
        .withColumn("_dealt", _bits(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 15))
        .withColumn("_key", F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("source")))),
        "mix-sizes",
    )
    placed = written(numbered(rows.drop("source"), ["_key", "_class"], ["size", "_dealt", "doc_id", "row"], "_place"), "mix-places")
    classes = rows.groupBy("_key", "_class").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_words"))
    below = Window.partitionBy("_key").orderBy("_class")
    classes = written(classes.withColumn("_below", F.sum("_words").over(below)), "mix-classes")
    known = targets(rows, weights, budget, most).withColumn("_key", F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("source"))))
    sources = known.count()
    state = known.select("_key", "source_size", "target", F.lit(0).cast("long").alias("_taken"), _bits(seed, F.col("_key"), PLACES // 4).cast("decimal(38,0)").alias("_upto"))
    plans = []
    # at most 32 classes: sizes are 64-bit numbers
    for number in sorted((r["_class"] for r in classes.select("_class").distinct().collect()), reverse=True):
        left = F.col("target") - F.col("_taken").cast("double")
        rate = F.least(F.greatest(F.coalesce(F.try_divide(left, F.col("_below").cast("double")), F.lit(0.0)), F.lit(0.0)), F.lit(float(most)))
        plan = state.join(classes.filter(F.col("_class") == number), "_key", "left").withColumn("_step", F.floor(rate * float(1 << PLACES)).cast("long"))
        took = _copied(placed.filter(F.col("_class") == number), plan.select("_key", "_upto", "_step"), ["_key"], sources).groupBy("_key").agg(F.sum(F.col("size") * F.col("copies")).alias("_took"))
        plan = written(plan.join(took, "_key", "left"), "mix-plan")
        plans.append(plan.filter("_class is not null").select("_key", "_class", "source_size", "target", "_upto", "_step"))
        state = plan.select(
            "_key", "source_size", "target", (F.col("_taken") + F.coalesce("_took", F.lit(0))).alias("_taken"),
            (F.col("_upto") + F.coalesce(F.col("_n") * F.col("_step").cast("decimal(18,0)"), F.lit(0))).cast("decimal(38,0)").alias("_upto"),
        )
    if not plans:
        return rows.select("doc_id", "row", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("copies"))
    every = reduce(DataFrame.unionByName, plans)
    return _copied(placed, every, ["_key", "_class"], sources * len(plans)).select("doc_id", "row", "size", "source_size", "target", "copies")


def _copied(placed: DataFrame, plan: DataFrame, on: Sequence[str], rows: int) -> DataFrame:
    """The integers that each document's share of the running sum crosses, by a plan of at most `rows` rows."""
    upto = F.col("_upto") + F.col("_place") * F.col("_step").cast("decimal(18,0)")
    joined = placed.join(F.broadcast(plan) if rows <= FEW else plan, list(on)).withColumn("_to", upto.cast("decimal(38,0)"))
    crossed = lambda at: f"(({at}) div cast({1 << PLACES} as decimal(10,0)))"
    return joined.withColumn("copies", F.expr(f"{crossed('_to')} - {crossed('_to - _step')}"))


def _bits(seed: int, text: Column, digits: int) -> Column:
    """A number of `digits` hexadecimal digits from a seed and a text."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), text), 256), 1, digits), 16, 10).cast("long")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken, the number of the copy in `copy`.

    The rows are written once with a number of their own, so that each one meets its own copies."""
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
    taken = copies(rows, row="_row", **options).filter("copies > 0").select(F.col("row").alias("_row"), F.col("copies").alias("_copies"))
    out = rows.join(taken, "_row").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return out.select(*[rows[c] for c in docs.columns], "copy")


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")

"""The trie of conversation prefixes, by ROLLUP over positional columns of turns.

A turn at a place is a number, from a digest of the place, the role and the text (96 bits) and the
length of the text.  A conversation lies in blocks of `WIDTH` such columns; the key of a block is
the node that its conversation reached in the block before, which is the sum of the numbers up to
there.  One GROUP BY block, node, ROLLUP over the columns gives every prefix of every
conversation at once, and grouping_id tells the depth; nothing is done turn by turn, and
a conversation of any length is some rows more.  Texts are read once for digest and length.

What a subtree sums up comes from a second ROLLUP, over the nodes that two conversations or more
share; below those there are only single chains, which save nothing and have one leaf.  Sums of
deeper blocks are handed up in doubling steps over blocks: their number is the logarithm of the
longest shared prefix in blocks.

No task holds a node's children or a turn's copies: rows of a key meet as partial sums, the few
parents that have a thousandth of all nodes as children are joined by broadcast (at most a thousand
rows), and a conversation with most rows is numbered over sampled ranges.  The digest of the
conversations that end at a node runs over their sorted ids while these stream by.

Defined results: rows without a conversation id belong to none and are left out; null turns come
first, rows with equal turns go by role, then by digest of the text, repeated rows are turns like
others; a null role or text is empty; an empty table gives no node; other columns are ignored."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.operators.ranges import numbered, running
from airloom.shipping import ship_package
from airloom.sources.scratch import written

#: Turns of a block.
WIDTH = 8
#: A parent with this share of all nodes as children is one of at most so many.
HOT = 1000
_SPOTS = [f"t{i}" for i in range(WIDTH)]
_ID = "decimal(38,0)"


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, digest, n_chars) of every turn, in order of turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.length(text).cast("long").alias("n_chars"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    return numbered(written(turns, "turns"), ["conv_id"], order, "position").select("conv_id", "position", "digest", "n_chars")


def _blocks(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, block, node, t0..): the node reached before the block, and its turns in columns."""
    spot = F.sha2(F.concat(F.col("position").cast("string"), F.lit(":"), F.col("digest")), 256)
    half = lambda at: F.conv(F.substring(spot, at, 12), 16, 10).cast("decimal(20,0)")
    numbers = turns.select(
        "conv_id",
        F.expr(f"cast((position - 1) div {WIDTH} as int)").alias("block"),
        F.expr(f"cast((position - 1) % {WIDTH} as int)").alias("spot"),
        (half(1) * F.lit(1 << 48).cast("decimal(15,0)") + half(13)).cast("decimal(29,0)").alias("h"),
        "n_chars",
    )
    wide = numbers.groupBy("conv_id", "block").agg(
        F.sum("h").cast(_ID).alias("_sum"),
        *[F.max(F.when(F.col("spot") == i, F.col("h"))).alias(f"h{i}") for i in range(WIDTH)],
        *[F.max(F.when(F.col("spot") == i, F.col("n_chars"))).alias(f"n{i}") for i in range(WIDTH)],
    )
    spots = [F.when(F.col(f"h{i}").isNotNull(), F.struct(F.col(f"h{i}").alias("h"), F.col(f"n{i}").alias("n"))).alias(t) for i, t in enumerate(_SPOTS)]
    summed = running(written(wide.select("conv_id", "block", "_sum", *spots), "turn-blocks"), ["conv_id"], ["block"], F.col("_sum"), "_upto")
    blocks = summed.select("conv_id", "block", (F.col("_upto") - F.col("_sum")).cast(_ID).alias("node"), *_SPOTS)
    silent = ids.join(turns.select("conv_id").distinct(), "conv_id", "left_anti")
    empty = [F.lit(None).cast(blocks.schema[t].dataType).alias(t) for t in _SPOTS]
    return written(blocks.unionByName(silent.select("conv_id", F.lit(0).alias("block"), F.lit(0).cast(_ID).alias("node"), *empty)), "trie-blocks")


def _rolled(rows: DataFrame, sums: str) -> DataFrame:
    """One row for each prefix inside each block: (block, node, t0.., level, id) and `sums`."""
    spots = ", ".join(_SPOTS)
    grouped = rows.sparkSession.sql(
        f"select block, node, {spots}, {WIDTH} - cast(round(log2(grouping_id() + 1)) as int) as level, {sums} from {{rows}} group by block, node, rollup({spots})", rows=rows
    )
    # a null that was not rolled up is the end of a conversation; the top of a later block is a node of the one before
    last = F.element_at(F.array(*_SPOTS), F.greatest(F.col("level"), F.lit(1)))
    real = grouped.filter(F.when(F.col("level") == 0, F.col("block") == 0).otherwise(last.isNotNull()))
    return real.withColumn("id", _reached())


def _reached() -> Column:
    """The node at the end of a row's columns."""
    return sum((F.coalesce(F.col(f"{t}.h"), F.lit(0)) for t in _SPOTS), F.col("node")).cast(_ID)


def _handed_up(shared: DataFrame) -> DataFrame:
    """(id, below_leaves, below_saved): what the shared nodes in blocks below a node sum up to."""
    tops = shared.filter("block > 0").groupBy(F.col("node").alias("id")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    above = shared.filter(F.col("level") == WIDTH).select("id", F.when(F.col("block") > 0, F.col("node")).alias("up"))
    found = written(tops.join(above, "id"), "trie-tops")
    while not found.filter("up is not null").isEmpty():
        more = found.filter("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        next_ = found.select(F.col("id").alias("up"), F.col("up").alias("up_next"))
        found = written(
            found.join(more, "id", "left").join(next_, "up", "left").select(
                "id",
                (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
                F.col("up_next").alias("up"),
            ),
            "trie-tops",
        )
    return found.select("id", F.col("leaves").alias("below_leaves"), F.col("saved").alias("below_saved"))


def _end_digests(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256) from (id, conv_id): sorted ids stream through, none are held."""
    ship_package(ends.sparkSession)

    def each(batches):
        now, state = None, None
        for batch in batches:
            ids, convs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            done, start = [], 0
            for i in range(1, len(ids) + 1):
                if i < len(ids) and ids[i] == ids[start]:
                    continue
                text = ",".join(map(str, convs[start:i]))
                if ids[start] == now:
                    state.update(f",{text}".encode())
                else:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = ids[start], hashlib.sha256(text.encode())
                start = i
            if done:
                yield _digest_rows(done)
        if state is not None:
            yield _digest_rows([(now, state.hexdigest())])

    return ends.repartition("id").sortWithinPartitions("id", "conv_id").mapInArrow(each, f"id {_ID}, ends_sha256 string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    ids, digests = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.decimal128(38, 0)), pa.array(digests, pa.string())], ["id", "ends_sha256"])


def trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row a node, from (conv_id, position, digest, n_chars) with positions from 1 and the
    distinct conv_id of all conversations, with turns or without.

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256."""
    blocks = _blocks(turns, ids)
    last = F.element_at(F.array(*_SPOTS), F.greatest(F.col("level"), F.lit(1)))
    nodes = _rolled(blocks, "min(conv_id) as conv_id, count(*) as n_convs").select(
        "*",
        (F.col("block").cast("long") * WIDTH + F.col("level")).alias("depth"),
        F.when(F.col("level") > 0, last["n"]).otherwise(0).alias("n_chars"),
        F.when(F.col("level") > 0, (F.col("id") - last["h"]).cast(_ID)).alias("parent"),
    )
    nodes = written(nodes, "trie-nodes")
    every = nodes.count()
    slim = nodes.select("id", "parent", "depth", "conv_id", "n_convs", "n_chars")
    kids = slim.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("_single"))
    kids = written(kids, "trie-children")

    shared = nodes.filter("n_convs > 1").join(kids, "id", "left")
    shared = written(
        shared.select(
            "id", "block", "node", "level", *_SPOTS,
            F.coalesce("_single", F.lit(1)).alias("leaves"),
            ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved"),
        ),
        "trie-shared",
    )
    deeper = shared.join(_handed_up(shared), "id", "left").select(
        "block", "node", *_SPOTS, (F.col("leaves") + F.coalesce("below_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("below_saved", F.lit(0))).alias("saved")
    )
    sums = _rolled(deeper, "sum(leaves) as n_leaves, sum(saved) as saved_tokens").select("id", "n_leaves", "saved_tokens")

    lengths = blocks.groupBy("conv_id").agg(F.max("block").alias("block"))
    ends = _end_digests(blocks.join(lengths, ["conv_id", "block"]).select(_reached().alias("id"), "conv_id"))

    hot = F.col("n_children") * HOT >= max(every, 1)
    parents = slim.select("id", F.col("conv_id").alias("parent_conv_id")).join(kids, "id")
    few = F.broadcast(parents.filter(hot).select(F.col("id").alias("parent"), "parent_conv_id"))
    rest = parents.filter(~hot).select(F.col("id").alias("parent"), "parent_conv_id")
    # the root has no parent and meets none in either join
    named = slim.join(few, "parent").unionByName(slim.join(few, "parent", "left_anti").join(rest, "parent", "left").select(*slim.columns, "parent_conv_id"))
    out = named.join(kids.select("id", "n_children"), "id", "left").join(sums, "id", "left").join(ends, "id", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are, from rows of (conv_id, turn, role, text)."""
    turns = written(turn_rows(conversations), "trie-turns")
    return trie(turns, turns.select("conv_id").distinct())


def rebuilt(turns: DataFrame, group: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first one of their group: their turns, and all their ids.

    The first h turns come from the conversation whose id is the smallest of the group, the
    others are the conversation's own after its first h; h is a hash of the id, 0 to `most`.  A
    conversation lends at most `most` turns to each of the other ids of its group."""
    ids = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("head", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("long"))
    ids = written(ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % group), "trie-ids")
    lender = ids.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    heads = ids.join(lender, "base", "left").select("conv_id", "base", "head", F.least("head", F.coalesce("base_n", F.lit(0))).alias("lent"))
    lent = turns.filter(F.col("position") <= most).withColumnRenamed("conv_id", "base")
    first = heads.join(lent, "base").filter(F.col("position") <= F.col("head")).select("conv_id", "position", "digest", "n_chars")
    own = turns.join(heads, "conv_id").filter(F.col("position") > F.col("head"))
    after = own.select("conv_id", (F.col("lent") + F.col("position") - F.col("head")).alias("position"), "digest", "n_chars")
    return written(first.unionByName(after), "trie-rebuilt"), ids.select("conv_id")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = written(turn_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "trie-turns")
    return trie(*rebuilt(turns))

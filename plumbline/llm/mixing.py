"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over source blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm._spark import spool

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Blocks in the whole mix, at most: a block has total / MAX_BLOCKS words, 2048 at least. All that the tree holds is bounded by it.
MAX_BLOCKS = 1 << 20
MIN_BLOCK_WORDS = 2048
BLOCKS_PER_SHARD = 64
SOURCE_GROUPS = 128
ROWS_PER_SLOT = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, target: weights repeat over the sources by code point, null last. A target stops at most
    times its source's size; the excess goes to the others by weight until none is above.

    Each round is one aggregate over the table of sources: the level only rises, and a source once capped stays so.
    """
    spark = sized.sparkSession
    by = spool(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ordered = by.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex()
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("weight", T.DoubleType())])
    by = spool(spark.createDataFrame(ordered.map(lambda x: (x[0][0], x[0][1], float(weights[x[1] % len(weights)]))), schema), "sources")
    cap, total, level = F.col("source_size") * most, None, 0.0
    while True:
        capped = cap <= F.col("weight") * level
        whole, fixed, free = by.agg(F.sum("source_size"), F.sum(F.when(capped, cap).otherwise(0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        total = whole or 0
        now = (total - fixed) / free if free else level
        if now <= level:
            break
        level = now
    return by.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(level))))


def split_tree(colors: np.ndarray, sizes: np.ndarray, rng: np.random.Generator):
    """Deal sum(sizes) balls of the given colors to len(sizes) shards: yields (shard, its count of each color).

    Halves the shards again and again; what the left half gets is one multivariate hypergeometric draw.
    """
    todo = [(0, len(sizes), np.asarray(colors, np.int64))]
    while todo:
        a, b, have = todo.pop()
        if b - a == 1:
            yield a, have
        elif b > a:
            mid = (a + b) // 2
            left = rng.multivariate_hypergeometric(have, int(sizes[a:mid].sum()), method="marginals")
            todo += [(mid, b, have - left), (a, mid, left)]


def deal_blocks(targets: DataFrame, block_words: int, blocks_per_shard: int, seed: int) -> DataFrame:
    """name, block, shard: every block of every source's line goes to one shard.

    The tree runs twice: over the totals of SOURCE_GROUPS groups of sources on the driver, then in one task a group over
    its members. A multivariate hypergeometric draw of groups, then of members within them, is one of all sources.
    """
    blocks = targets.where("quota > 0").select("name", F.ceil(F.col("quota") / block_words).cast("long").alias("blocks"), F.pmod(F.xxhash64("name"), F.lit(SOURCE_GROUPS)).cast("int").alias("part"))
    totals = np.zeros(SOURCE_GROUPS, np.int64)
    for part, n in blocks.groupBy("part").agg(F.sum("blocks")).collect():  # SOURCE_GROUPS rows at most
        totals[part] = n
    shards = max(1, -(-int(totals.sum()) // blocks_per_shard))
    sizes = np.diff(np.arange(shards + 1) * int(totals.sum()) // shards)
    dealt = np.zeros((SOURCE_GROUPS, shards), np.int32)
    for shard, have in split_tree(totals, sizes, np.random.default_rng(seed)):
        dealt[:, shard] = have

    def members(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("name", ignore_index=True)
        part = int(pdf["part"][0])
        rng = np.random.default_rng([seed, part])
        counts = pdf["blocks"].to_numpy()
        of: list[list[np.ndarray]] = [[] for _ in counts]
        for shard, have in split_tree(counts, dealt[part], rng):
            for k in np.flatnonzero(have):
                of[k].append(np.full(have[k], shard, np.int32))
        rows = [pd.DataFrame({"name": pdf["name"][k], "block": rng.permutation(n), "shard": np.concatenate(of[k])}) for k, n in enumerate(counts)]
        return pd.concat(rows, ignore_index=True)

    return blocks.groupBy("part").applyInPandas(members, "name string, block long, shard int")


def mix(docs: DataFrame, row: str | None = None, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = 17, blocks_per_shard: int = BLOCKS_PER_SHARD) -> tuple[DataFrame, DataFrame]:
    """The mix of docs as (placements, sizes).

    sizes: row, doc_id, source, size, source_size, target for every row of docs. row: the column of that name that
    numbers them, or numbers given here.
    placements: row, doc_id, source, copy, start, words, shard, place: words of the document from word start on, in its
    copy-th use, belong to that shard, to be sorted by place there.

    A document's size is its number of words, 0 if its text is null. The documents of a source lie on a line in the
    order of a seeded hash; the mix takes the first round(target) words of that line repeated end to end, so each
    document is used floor or ceil(target / source_size) times and at most one a source is cut. The line is cut into
    blocks, which the splitting tree deals to the shards. A null source is a source of its own, last in order. Documents
    without words are placed nowhere. Rows of equal key, as of one doc_id, come by size, then by row. A text of any length
    is counted whole, and its blocks may lie in several shards. Equal rows are mixed as two documents; an empty table gives two empty tables.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), (F.col(row) if row else F.monotonically_increasing_id()).alias("row"))
    # name: the source as a key that is never null
    name = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))
    sized = spool(sized.withColumn("name", name), "sized")
    quota = F.least(F.col("source_size") * most, F.round("target").cast("long"))
    targets = source_targets(sized, weights, most).withColumn("quota", quota).withColumn("name", name)
    targets = spool(targets, "targets")
    rows, total = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    block_words = max(MIN_BLOCK_WORDS, -(-total // MAX_BLOCKS))

    # where each document begins on its source's line: sums of slots of some 20,000 rows first, then within a slot
    key, slots = F.xxhash64(F.lit(seed), "doc_id"), max(1, rows // ROWS_PER_SLOT)
    line = sized.where("size > 0").withColumn("key", key).withColumn("slot", F.pmod(key, F.lit(slots)))
    sums = line.groupBy("name", "slot").agg(F.sum("size").alias("in_slot"))
    before = sums.select("name", "slot", (F.sum("in_slot").over(Window.partitionBy("name").orderBy("slot")) - F.col("in_slot")).alias("before"))
    run = Window.partitionBy("name", "slot").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("upto", F.sum("size").over(run)).join(before, ["name", "slot"])
    line = line.withColumn("at", F.col("before") + F.col("upto") - F.col("size"))

    # the uses of each document, then the blocks that each use spans
    line = line.join(targets.select("name", "source_size", "quota"), "name").where("at < quota")
    uses = F.floor((F.col("quota") - 1 - F.col("at")) / F.col("source_size"))
    used = line.select("row", "doc_id", "source", "name", "size", "quota", F.explode(F.sequence(F.lit(0).cast("long"), uses)).alias("copy"), "at", "source_size")
    used = used.withColumn("lo", F.col("at") + F.col("copy") * F.col("source_size"))
    used = used.withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("quota")))
    span = F.sequence(F.floor(F.col("lo") / block_words), F.floor((F.col("hi") - 1) / block_words))
    pieces = used.withColumn("block", F.explode(span)).withColumn("cut", F.greatest("lo", F.col("block") * block_words))
    words = F.least(F.col("hi"), (F.col("block") + 1) * block_words) - F.col("cut")
    pieces = pieces.select("row", "doc_id", "source", "name", "block", "copy", (F.col("cut") - F.col("lo")).alias("start"), words.alias("words"))
    dealt = deal_blocks(targets, block_words, blocks_per_shard, seed)
    placed = pieces.join(dealt, ["name", "block"]).withColumn("place", F.xxhash64(F.lit(seed), "shard", "doc_id", "copy", "start"))
    whole = sized.join(targets.select("name", "source_size", "target"), "name")
    return placed.drop("name", "block"), whole.drop("name")


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs: the words of it that the mix uses, repeats counted;
    first_shard, last_shard: of the shards to which the splitting tree dealt its blocks (null: not used)."""
    placed, sizes = mix(docs, **options)
    used = placed.groupBy("row").agg(F.sum("words").alias("taken"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    return sizes.join(used, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard", "last_shard")


def query(spark, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""A corpus pipeline: toxic documents go, exact copies go, of near copies one stays, sources are mixed, the mix is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.ship import shipped
from plumbline.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from plumbline.llm._spark import fresh, numbered, spool, staged


#: All stages: null and empty texts are documents like others, texts of any length count whole, repeated rows count each,
#: an empty table gives an empty result, and columns besides doc_id, text and source may have any names and stay as they are.


@shipped
@staged
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator scores 0.5 or more go. A text without a letter has the rate of such examples,
    0.1 where there are none, so it stays; equal texts have equal scores, and a null doc_id changes nothing."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@shipped
@staged
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal texts the longest stays, then the smallest doc_id (null first), then one of them. All null
    and empty texts are one group."""
    rows, row = numbered(docs)
    kept = exact_dedup.exact_dedup(rows, row).where("kept").select(F.struct("row").alias(fresh(rows, "kept")))
    return rows.join(kept, F.col(row) == F.col(f"{kept.columns[0]}.row"), "left_semi").select([F.col(f"`{c}`") for c in docs.columns])


@shipped
@staged
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five words, a similarity of 0.8 or more) the document of the smallest doc_id stays
    (null last; of equal ones, one). A text without words is linked with nothing and stays."""
    rows, row = numbered(docs)
    members, _ = jaccard_join.jaccard_components(rows.select(F.col(row).alias("doc_id"), "text"), shingle=5, percent=80)
    ids = rows.select(F.col(row).alias("own"), F.col("doc_id").alias("id"))
    first = members.join(ids, members["doc_id"] == ids["own"]).groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("own"))).getField("own").alias("row"))
    kept = first.select(F.struct("row").alias(fresh(rows, "kept")))
    return rows.join(kept, F.col(row) == F.col(f"{kept.columns[0]}.row"), "left_semi").select([F.col(f"`{c}`") for c in docs.columns])


@shipped
@staged
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix uses them, in the order of its shards. Where it uses a part, the text is cut to that.

    A null source is a source of its own. A document without words has no part in any mix: null, empty and blank texts go.
    """
    rows, row = numbered(docs)
    placed, sizes = mixing.mix(rows, row)
    uses = placed.groupBy("row", "copy").agg(F.sum("words").alias("words"), F.min_by(F.struct("shard", "place"), "start").alias("to"))
    use = fresh(rows, "use")
    uses = uses.join(sizes.select("row", "size"), "row").select(F.struct(F.col("row"), "words", "size", "to").alias(use))
    used = rows.join(uses, F.col(row) == F.col(f"{use}.row"))
    part = F.col(f"{use}.words") < F.col(f"{use}.size")
    words = F.slice(F.regexp_extract_all("text", F.lit(f"({mixing.WORD})"), 1), F.lit(1), F.col(f"{use}.words").cast("int"))
    new = {"text": F.when(part, F.array_join(words, " ")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(part, F.length(new["text"])).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    used = used.repartition(f"{use}.to.shard").sortWithinPartitions(f"{use}.to.shard", f"{use}.to.place")
    return used.select([new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


@shipped
@staged
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences. A null or empty text is its end token alone; of pieces as long
    as each other, the one read first is placed first."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the scores, the draws of the mix and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

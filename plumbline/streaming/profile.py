"""A running numeric summary of a stream, batch by batch. The table profiler has no streams; this is an extension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.stats import unpivot


def sums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """name, n, missing, mean, m2, min, max of the columns: parts that merge."""
    long = unpivot(df, {c: F.col(f"`{c}`").cast("double") for c in columns})
    return long.groupBy("name").agg(
        F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"), F.avg("value").alias("mean"),
        (F.var_pop("value") * F.count("value")).alias("m2"), F.min("value").alias("min"), F.max("value").alias("max"),
    )


def merge(parts: DataFrame) -> DataFrame:
    """The summary of all batches from theirs: name, n, missing, mean, std, min, max."""
    whole = parts.groupBy("name").agg(F.sum("n").alias("n"), F.sum("missing").alias("missing"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"))
    apart = parts.join(whole.select("name", F.col("mean").alias("all")), "name").groupBy("name").agg(F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("all"), 2)).alias("m2"))
    return whole.join(apart, "name").select("name", "n", "missing", "mean", F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).otherwise(0.0).alias("std"), "min", "max")


def run(stream: DataFrame, columns: Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's parts under path, one folder a batch: a batch that runs again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        sums(batch, columns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

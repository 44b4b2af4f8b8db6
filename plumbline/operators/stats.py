"""Statistics of columns: a few narrow aggregates over one scan each."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import limits as L

#: Parts of an interval that one pass of a selection counts.
BINS = 2048


def unpivot(df: DataFrame, columns: dict[str, Column], order: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """[by,] name, value[, first] of every value of the columns, nulls included: one shuffle then serves all of them."""
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), c.alias("value")) for n, c in columns.items()))).alias("cell")
    first = [] if order is None else [order.alias("first")]
    return df.select(*by, cells, *first).select(*by, "cell.name", "cell.value", *(["first"] if first else []))


def selected(long: DataFrame, at: Sequence[float]) -> dict[str, list[float]]:
    """Of each name in name, value: its quantiles with linear interpolation, exactly. Names without values are left out.

    Selection by narrowing: a pass counts the values of BINS equal parts of every interval that still holds a wanted rank,
    with the smallest and largest value of each part, which bound the next interval. An interval of n values takes some
    log(n) / log(BINS) passes; only counts are shuffled, never values.
    """
    numbers = long.where("value is not null").select("name", F.col("value").cast("double").alias("value"))
    found: dict[str, dict[int, float]] = {}
    ranks: dict[str, int] = {}
    # unresolved: (name, low, high, values below, wanted ranks)
    open_: list[tuple[str, float, float, int, list[int]]] = []
    for r in numbers.groupBy("name").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n")).collect():  # one row a column
        ranks[r["name"]], found[r["name"]] = r["n"], {}
        wanted = sorted({min(r["n"] - 1, int((r["n"] - 1) * p) + k) for p in at for k in (0, 1)})
        open_.append((r["name"], r["low"], r["high"], 0, wanted))
    while open_:
        todo, spans = open_, []
        for k, (name, low, high, _, wanted) in enumerate(todo):
            if low == high:
                found[name] |= dict.fromkeys(wanted, low)
            else:
                spans.append((k, name, low, high))
        if not spans:
            break
        table = F.broadcast(long.sparkSession.createDataFrame(spans, "span int, of string, low double, high double"))  # two a column and quantile at most
        inside = numbers.join(table, (F.col("name") == F.col("of")) & F.col("value").between(F.col("low"), F.col("high")))
        # halves first: the width of the largest doubles' span is no double
        part = F.least(F.lit(BINS - 1), F.floor((F.col("value") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BINS)).cast("int")
        bins = inside.groupBy("span", part.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        of: dict[int, list] = {}
        for r in bins.collect():  # BINS rows a span at most
            of.setdefault(r["span"], []).append(r)
        open_ = []
        for k, name, *_ in spans:
            below, wanted = todo[k][3], todo[k][4]
            for r in sorted(of[k], key=lambda r: r["bin"]):
                own = [w for w in wanted if below <= w < below + r["n"]]
                # the ends of a part are known already
                found[name] |= {w: r["low"] for w in own if w == below} | {w: r["high"] for w in own if w == below + r["n"] - 1}
                rest = [w for w in own if w not in found[name]]
                if rest:
                    open_.append((name, r["low"], r["high"], below, rest))
                below += r["n"]
    out = {}
    for name, n in ranks.items():
        out[name] = []
        for p in at:
            k = int((n - 1) * p)
            a, b = found[name][k], found[name][min(k + 1, n - 1)]
            out[name].append(a + ((n - 1) * p - k) * (b - a) if b > a else a)
    return out


def numeric_summary(df: DataFrame, columns: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """One row per column (and group): n, missing, mean, std, min, q1, median, q3, max, skewness, kurtosis.

    Means come first; the second aggregate sums powers of the differences from them, so nothing cancels. Quantiles
    interpolate linearly. std is the sample's (0 for one value); skewness and excess kurtosis are the population's (0 if
    all values are equal).
    """
    long = unpivot(df, columns, by=by)
    keys = [*by, "name"]
    if by:
        quartiles = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    else:
        own = selected(long, [0.25, 0.5, 0.75])
        quartiles = F.lit(None).cast("array<double>")
        for name, q in own.items():
            quartiles = F.when(F.first("name") == name, F.array(*map(F.lit, q))).otherwise(quartiles)
    means = long.groupBy(*keys).agg(F.avg("value").alias("mean"))
    on = long.join(F.broadcast(means) if not by else means, keys)
    d = F.col("value") - F.col("mean")
    powers = on.groupBy(*keys).agg(
        F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"), F.first("mean").alias("mean"),
        F.sum(d * d).alias("s2"), F.sum(d * d * d).alias("s3"), F.sum(d * d * d * d).alias("s4"),
        F.min("value").alias("min"), F.max("value").alias("max"), quartiles.alias("q"),
    )
    n, m2 = F.col("n"), F.col("s2") / F.col("n")
    flat = F.col("s2") <= 0
    return powers.select(
        *keys, "n", "missing", "mean",
        F.when(n > 1, F.sqrt(F.try_divide(F.col("s2"), n - 1))).when(n == 1, 0.0).alias("std"),
        "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max",
        F.when(flat, 0.0).otherwise(F.col("s3") / n / F.pow(m2, 1.5)).alias("skewness"),
        F.when(flat, 0.0).otherwise(F.col("s4") / n / (m2 * m2) - 3).alias("kurtosis"),
    )


def quantiles(df: DataFrame, column: Column, at: Sequence[float]) -> DataFrame:
    """p, value: quantiles with linear interpolation."""
    got = selected(unpivot(df, {"x": column}), at).get("x", [None] * len(at))
    return df.sparkSession.createDataFrame(list(zip(at, got, strict=True)), "p double, value double")


def frequencies(df: DataFrame, columns: dict[str, Column], order: Column | None = None) -> DataFrame:
    """name, value, count, first of every distinct present value; first: its first place, or the value itself."""
    long = unpivot(df, columns, order).where("value is not null")
    first = F.min("first") if order is not None else F.first("value")
    return long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("count"), first.alias("first"))


def renamed(freq: DataFrame, columns: Sequence[str], fn: Callable[[Column], Column], ordered: bool) -> DataFrame:
    """Frequencies in which the named columns' values became fn(value): equal ones are added up."""
    own = freq.where(F.col("name").isin(list(columns))).groupBy("name", fn(F.col("value")).alias("value")).agg(F.sum("count").alias("count"), F.min("first").alias("first"))
    return freq.where(~F.col("name").isin(list(columns))).unionByName(own if ordered else own.withColumn("first", F.col("value")))


def unique_and_mode(freq: DataFrame) -> DataFrame:
    """name, unique, mode_rate: the most frequent value's share of the present ones."""
    return freq.groupBy("name").agg(F.count(F.lit(1)).alias("unique"), (F.max("count") / F.sum("count")).alias("mode_rate"))


def top_values(freq: DataFrame, limit: int = L.TOP_VALUES) -> DataFrame:
    """name, rank, value, count: most frequent first, then first seen."""
    w = Window.partitionBy("name").orderBy(F.desc("count"), "first", "value")
    return freq.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("name", "rank", "value", "count")


def sample_values(freq: DataFrame, limit: int = L.SAMPLE_VALUES) -> DataFrame:
    """name, rank, value: the first distinct values as they come."""
    w = Window.partitionBy("name").orderBy("first", "value")
    return freq.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("name", "rank", "value")


def class_distribution(df: DataFrame, column: Column) -> DataFrame:
    """value, count of every class."""
    return df.where(column.isNotNull()).groupBy(column.alias("value")).agg(F.count(F.lit(1)).alias("count"))


def bin_count(n: int) -> int:
    return min(L.MOST_BINS, math.ceil(math.log2(n)) + 1) if n > 0 else 0


def bin_of(value: Column, low, high, bins) -> Column:
    """The equal-width bin of a value: the last one takes the maximum."""
    low, high, bins = (x if isinstance(x, Column) else F.lit(x) for x in (low, high, bins))
    return F.least(bins - 1, F.floor((value - low) / ((high - low) / bins))).cast("int")


def histograms(df: DataFrame, columns: dict[str, Column], ranges: dict[str, tuple[float, float, int]], fine: int | None = None) -> dict[str, list[int]]:
    """Counts of each column's bins, given (min, max, n): one aggregate for all columns. fine: that many bins instead."""
    cells = {}
    for name, (low, high, n) in ranges.items():
        bins = fine or bin_count(n)
        c = columns[name]
        cells[name] = F.when(c.isNotNull(), F.lit(0) if high <= low else bin_of(c, float(low), float(high), bins))
    got = unpivot(df, cells).where("value is not null").groupBy("name", "value").agg(F.count(F.lit(1)).alias("n")).collect() if cells else []
    out = {name: [0] * (1 if high <= low else fine or bin_count(n)) for name, (low, high, n) in ranges.items()}
    for name, k, n in got:  # MOST_BINS or fine rows a column
        out[name][k] = n
    return out


def bin_edges(low: float, high: float, n: int) -> list[float]:
    if high <= low:
        return [low, high]
    bins = bin_count(n)
    width = (high - low) / bins
    return [*(low + k * width for k in range(bins)), high]


def density(fine: list[int], low: float, high: float, n: int, std: float, iqr: float, bin_width: float) -> list[tuple[float, float]] | None:
    """A Gaussian kernel estimate on the scale of the histogram's counts, from the counts of fine bins."""
    if n < L.DENSITY_LEAST or high <= low:
        return None
    spread = min(std, iqr / 1.349) if iqr > 0 else std
    h = 0.9 * spread * n**-0.2
    if h <= 0:
        return None
    width = (high - low) / len(fine)
    centres = [(low + (k + 0.5) * width, c) for k, c in enumerate(fine) if c]
    scale = bin_width / (h * math.sqrt(2 * math.pi))
    points = []
    for k in range(L.DENSITY_POINTS):
        x = low + (high - low) * k / (L.DENSITY_POINTS - 1)
        y = sum(c * math.exp(-0.5 * ((x - m) / h) ** 2) for m, c in centres if abs(x - m) <= L.DENSITY_CUTOFF * h)
        points.append((float(f"{x:.6g}"), float(f"{y * scale:.6g}")))
    return points


def duplicate_rows(df: DataFrame) -> DataFrame:
    """rows, duplicates: rows beyond the first of each group of equal ones; null equals null."""
    whole = df.select(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)).alias("h"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    return whole.groupBy("h", "row").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def memory_bytes(numbers: Sequence[Column], texts: Sequence[Column]) -> Column:
    """Aggregate: 8 bytes a number, 2 a UTF-16 code unit."""
    total = F.lit(8 * len(numbers)).cast("long") * F.count(F.lit(1))
    for c in texts:
        total = total + F.coalesce(F.sum(F.octet_length(F.encode(c, "UTF-16BE"))), F.lit(0))
    return total


def iqr_bounds(q1: float, q3: float) -> tuple[float, float]:
    return q1 - L.IQR_FACTOR * (q3 - q1), q3 + L.IQR_FACTOR * (q3 - q1)


def outside(value: Column, low, high) -> Column:
    """Aggregate: how many values lie strictly outside."""
    return F.count_if((value < low) | (value > high))


def iqr_outliers(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """name, lower, upper, count, rate of every column."""
    long = unpivot(df, columns)
    bounds = [(name, *iqr_bounds(*q)) for name, q in selected(long, [0.25, 0.75]).items()]
    q = df.sparkSession.createDataFrame(bounds, "name string, lower double, upper double")
    out = long.join(F.broadcast(q), "name").groupBy("name").agg(F.first("lower").alias("lower"), F.first("upper").alias("upper"), outside(F.col("value"), F.col("lower"), F.col("upper")).alias("count"), F.count("value").alias("n"))
    return out.select("name", "lower", "upper", "count", F.coalesce(F.try_divide("count", "n"), F.lit(0.0)).alias("rate"))


def zscore_outliers(df: DataFrame, columns: dict[str, Column], limit: float = L.Z_LIMIT) -> DataFrame:
    """name, count, rate of values more than limit standard deviations from the mean; none if the deviation is 0."""
    long = unpivot(df, columns)
    m = long.groupBy("name").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    far = (F.col("s") > 0) & (F.abs(F.col("value") - F.col("m")) > limit * F.col("s"))
    out = long.join(F.broadcast(m), "name").groupBy("name").agg(F.count_if(far).alias("count"), F.count("value").alias("n"))
    return out.select("name", "count", F.coalesce(F.try_divide("count", "n"), F.lit(0.0)).alias("rate"))

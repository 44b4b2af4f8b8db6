"""Relations between numeric columns: Pearson, Spearman, variance inflation, scatter samples."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import limits as L
from plumbline.operators.stats import unpivot

#: Pairs in one aggregate.
AT_A_TIME = 12
#: The least share of a column's variance that a first factor divides by.
PIVOT = 1e-13


def pearson_pairs(df: DataFrame, columns: dict[str, Column]) -> dict[tuple[str, str], float | None]:
    """Every pair's correlation over the rows where both are present: centred sums, after a pass for the pairs' means.

    None if fewer than two such rows, or if either column hardly varies over them.
    """
    pairs = list(combinations(columns, 2))
    out: dict[tuple[str, str], float | None] = {}
    for lo in range(0, len(pairs), AT_A_TIME):
        part = pairs[lo : lo + AT_A_TIME]
        both = [columns[a].isNotNull() & columns[b].isNotNull() for a, b in part]
        aggs = [f for k, (a, b) in enumerate(part) for f in (F.avg(F.when(both[k], columns[a])), F.avg(F.when(both[k], columns[b])), F.count_if(both[k]))]
        means = df.agg(*(c.alias(f"m{k}") for k, c in enumerate(aggs))).first()
        aggs = []
        for k, (a, b) in enumerate(part):
            x = F.when(both[k], columns[a] - F.lit(means[3 * k]))
            y = F.when(both[k], columns[b] - F.lit(means[3 * k + 1]))
            aggs += [F.sum(x * x), F.sum(y * y), F.sum(x * y)]
        sums = df.agg(*(c.alias(f"s{k}") for k, c in enumerate(aggs))).first()
        for k, pair in enumerate(part):
            xx, yy, xy = sums[3 * k : 3 * k + 3]
            out[pair] = None if means[3 * k + 2] < 2 or xx < L.EPSILON or yy < L.EPSILON else xy / (xx * yy) ** 0.5
    return out


def ranks_of(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """name, value, rank of every distinct value of each column, from counts: sorted ranges of values are summed apart, then offset."""
    counts = unpivot(df, columns).where("value is not null").groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    parts = counts.repartitionByRange("name", "value").withColumn("part", F.spark_partition_id())
    parts = parts.withColumn("upto", F.sum("n").over(Window.partitionBy("name", "part").orderBy("value")))
    sums = parts.groupBy("name", "part").agg(F.sum("n").alias("whole"), F.min("value").alias("least"))
    before = sums.withColumn("before", F.sum("whole").over(Window.partitionBy("name").orderBy("least")) - F.col("whole")).select("name", "part", "before")
    placed = parts.join(F.broadcast(before), ["name", "part"])  # a row for each partition, and one more a column at most
    return placed.select("name", "value", (F.col("before") + F.col("upto") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)).alias("rank"))


def ranks(df: DataFrame, column: Column) -> DataFrame:
    """value, rank of every distinct value."""
    return ranks_of(df, {"x": column}).select("value", "rank")


def present_in_both(df: DataFrame, n: int) -> np.ndarray:
    """Rows where both of two of the columns x0, x1, ... are present."""
    out = np.zeros((n, n), np.int64)
    cells = [(i, j) for i in range(n) for j in range(i, n)]
    for lo in range(0, len(cells), 3 * AT_A_TIME):
        part = cells[lo : lo + 3 * AT_A_TIME]
        got = df.agg(*(F.count_if(F.col(f"x{i}").isNotNull() & F.col(f"x{j}").isNotNull()).alias(f"n{k}") for k, (i, j) in enumerate(part))).first()
        for (i, j), x in zip(part, got, strict=True):
            out[i, j] = out[j, i] = x
    return out


def spearman_pairs(df: DataFrame, columns: dict[str, Column]) -> dict[tuple[str, str], float | None]:
    """Every pair's Pearson correlation of the average ranks over the rows where both are present.

    A column is ranked over all its rows for partners that are present wherever it is, and once for each other set of rows
    that its partners leave of them. All ranks come from one shuffle of distinct values; each column's are joined to the
    rows once, and all pairs read the rows ranked so. None as in pearson_pairs.
    """
    names = list(columns)
    if len(names) < 2:
        return {}
    data = df.select(*(columns[c].cast("double").alias(f"x{k}") for k, c in enumerate(names)))
    both = present_in_both(data, len(names))
    # columns that are present in the same rows as an earlier one
    like = [next(i for i in range(j + 1) if both[i, j] == both[i, i] == both[j, j]) for j in range(len(names))]
    rank = lambda i, j: f"r{i}" if both[i, j] == both[i, i] else f"r{i}_{like[j]}"
    wanted = {i: sorted({rank(i, j) for j in range(len(names)) if j != i}) for i in range(len(names))}
    cells = {}
    for i, own in wanted.items():
        for r in own:
            mask = r.partition("_")[2]
            cells[r] = F.when(F.col(f"x{mask}").isNotNull(), F.col(f"x{i}")) if mask else F.col(f"x{i}")
    found = ranks_of(data, cells).persist()
    ranked = data
    for i, own in wanted.items():
        of = found.where(F.col("name").isin(own)).groupBy(F.col("value").alias(f"v{i}")).agg(*(F.max(F.when(F.col("name") == r, F.col("rank"))).alias(f"of_{r}") for r in own))
        ranked = ranked.join(of, F.col(f"x{i}") == F.col(f"v{i}"), "left")
    # a value has a rank for a mask wherever it occurs: it counts in the rows that the mask holds
    ranked = ranked.select(*(F.when(cells[r].isNotNull(), F.col(f"of_{r}")).alias(r) for r in cells)).persist()
    out: dict[tuple[str, str], float | None] = {}
    try:
        pairs = list(combinations(range(len(names)), 2))
        for lo in range(0, len(pairs), AT_A_TIME):
            part, aggs = pairs[lo : lo + AT_A_TIME], []
            for i, j in part:
                mean = F.lit((int(both[i, j]) + 1) / 2)
                x, y = F.col(rank(i, j)) - mean, F.col(rank(j, i)) - mean
                aggs += [F.sum(x * x), F.sum(y * y), F.sum(x * y)]
            sums = ranked.agg(*(c.alias(f"s{k}") for k, c in enumerate(aggs))).first()
            for k, (i, j) in enumerate(part):
                xx, yy, xy = sums[3 * k : 3 * k + 3]
                out[names[i], names[j]] = None if both[i, j] < 2 or xx < L.EPSILON or yy < L.EPSILON else xy / (xx * yy) ** 0.5
    finally:
        ranked.unpersist()
        found.unpersist()
    return out


def spearman(df: DataFrame, a: Column, b: Column) -> float | None:
    return spearman_pairs(df, {"a": a, "b": b})["a", "b"]


def products(df: DataFrame, columns: Sequence[Column]) -> np.ndarray:
    """Sums of products of every two columns."""
    out = np.zeros((len(columns), len(columns)))
    rows = df.select(*(c.alias(f"d{k}") for k, c in enumerate(columns)))
    cells = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    for lo in range(0, len(cells), 3 * AT_A_TIME):
        part = cells[lo : lo + 3 * AT_A_TIME]
        for (i, j), s in zip(part, rows.agg(*(F.sum(F.col(f"d{i}") * F.col(f"d{j}")).alias(f"s{k}") for k, (i, j) in enumerate(part))).first(), strict=True):
            out[i, j] = out[j, i] = s
    return out


def cholesky(r: np.ndarray) -> np.ndarray:
    """The lower factor of a Gram matrix with diagonal 1. A pivot that rounding may have made is taken as PIVOT."""
    low = np.zeros_like(r)
    for j in range(len(r)):
        low[j:, j] = r[j:, j] - low[j:, :j] @ low[j, :j]
        low[j, j] = max(low[j, j], PIVOT) ** 0.5
        low[j + 1 :, j] /= low[j, j]
    return low


def factor(df: DataFrame, columns: dict[str, Column]) -> tuple[int, np.ndarray | None]:
    """Rows where all columns are present, and a square matrix whose rows have the products of the standardised columns.

    None if a column hardly varies. In a Gram matrix of doubles, what a column keeps beside the others is lost to rounding
    below some 1e-13 of its variance. So the columns are orthogonalised by a first such matrix, row by row, and a second
    one is taken of what is left (Cholesky QR, twice): its error counts against the remainder, not against the column.
    """
    whole = df.select(*(c.alias(f"x{k}") for k, c in enumerate(columns.values()))).dropna()
    n, *means = whole.agg(F.count(F.lit(1)), *(F.avg(f"x{k}") for k in range(len(columns)))).first()
    if not n:
        return 0, None
    centred = [F.col(f"x{k}") - F.lit(m) for k, m in enumerate(means)]
    first = products(whole, centred)
    s = np.sqrt(np.diag(first))
    if not np.isfinite(first).all() or (s * s < L.EPSILON).any():
        return n, None
    low = cholesky(first / np.outer(s, s))
    back = np.linalg.inv(low)
    left = [sum((F.lit(float(back[j, k] / s[k])) * centred[k] for k in range(j + 1)), F.lit(0.0)) for j in range(len(s))]
    second = products(whole, left)
    return n, None if not np.isfinite(second).all() else low @ second_root(second)


def second_root(g: np.ndarray) -> np.ndarray:
    """A square root of a Gram matrix whose diagonal may be far from 1."""
    s = np.sqrt(np.maximum(np.diag(g), np.finfo(float).tiny))
    return s[:, None] * cholesky(g / np.outer(s, s))


def inflation(rows: int, low: np.ndarray | None, k: int) -> list[float | None]:
    """1 / (1 - R2) of each of k columns on the others, from their factor.

    None where it is not defined: not more rows than columns, a column that hardly varies, 1 - R2 under EPSILON, or one of
    the others like that beside the rest of them.
    """
    if low is None or rows <= k:
        return [None] * k
    out: list[float | None] = []
    for i in range(k):
        u, s, v = np.linalg.svd(np.delete(low, i, axis=0), full_matrices=False)
        own = low[i] - v.T @ (v @ low[i])
        share = (own @ own) / (low[i] @ low[i])
        # the diagonal of the inverse: what each of the others keeps beside the rest of them
        rest = np.inf if s[-1] < np.finfo(float).eps else float(((u / s) ** 2).sum(axis=1).max())
        out.append(None if share < L.EPSILON or rest > 1 / L.EPSILON else float(1 / share))
    return out


def vif(df: DataFrame, columns: dict[str, Column]) -> dict[str, float | None]:
    if len(columns) < 2:
        return dict.fromkeys(columns)
    return dict(zip(columns, inflation(*factor(df, columns), len(columns)), strict=True))


def scatter(df: DataFrame, a: Column, b: Column, order: Sequence[Column], most: int = L.SCATTER_POINTS) -> DataFrame:
    """k, x, y: most points evenly spaced over the complete pairs in order, then by x and y, or all if there are no more.

    The rows are sorted once and kept, as ids of partition and place: ranges are cut by a sample, so the same rows sorted
    for a second query need not be cut at the same places. Counts by partition then tell where each point lies.
    """
    both = df.where(a.isNotNull() & b.isNotNull()).select(a.alias("x"), b.alias("y"), *(c.alias(f"o{k}") for k, c in enumerate(order)))
    row = F.monotonically_increasing_id()  # the partition above 33 bits of the place in it
    placed = both.sort(*(f"o{k}" for k in range(len(order))), "x", "y").select(F.shiftright(row, 33).alias("part"), row.bitwiseAND((1 << 33) - 1).alias("place"), "x", "y").persist()
    try:
        sizes = sorted(placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a partition
        n = sum(size for _, size in sizes)
        spots, before, k = [], 0, 0
        for part, size in sizes:
            while k < min(n, most) and (at := k if n <= most else k * n // most) < before + size:
                spots.append((k, part, at - before))
                k += 1
            before += size
        wanted = df.sparkSession.createDataFrame(spots, "k long, part long, place long")
        got = placed.join(F.broadcast(wanted), ["part", "place"]).select("k", "x", "y")
        return df.sparkSession.createDataFrame(got.collect(), got.schema)  # most rows
    finally:
        placed.unpersist()


def correlations(df: DataFrame, columns: dict[str, Column], order: Sequence[Column] | None = None, points: bool = True) -> list[dict]:
    """left, right, pearson, spearman, vif (of left), points of every pair, in column order; points for the strongest."""
    if len(columns) < 2:
        return []
    r = pearson_pairs(df, columns)
    rho = spearman_pairs(df, columns)
    v = vif(df, columns)
    out = [{"left": a, "right": b, "pearson": x, "spearman": rho[a, b], "vif": v[a]} for (a, b), x in r.items()]
    if points:
        for p in sorted((p for p in out if p["pearson"] is not None), key=lambda p: -abs(p["pearson"]))[: L.SCATTER_PAIRS]:
            got = scatter(df, columns[p["left"]], columns[p["right"]], order or [F.monotonically_increasing_id()]).collect()
            p["points"] = [[x, y] for _, x, y in sorted(got)]
    return out

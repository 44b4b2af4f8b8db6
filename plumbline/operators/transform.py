"""Recipes: cleaning steps that are fitted by one aggregate each and applied as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import limits as L
from plumbline.operators.recipe import STEP_ORDER
from plumbline.operators.stats import class_distribution, iqr_bounds, selected, unpivot
from plumbline.operators.views import View, views

#: Ordinal levels numbered by one task, and the most ranges of them.
LEVELS_A_RANGE = 50_000
MOST_RANGES = 200
#: A mapping of more ordinal levels than this is not listed in the parameters; all levels are coded all the same.
MAPPED_LEVELS = 100_000


@dataclass
class Fit:
    op: str
    column: str | None
    params: dict = field(default_factory=dict)
    note: str | None = None


def _quartiles(df: DataFrame, c: Column) -> tuple[float | None, ...]:
    return tuple(selected(unpivot(df, {"x": c}), [0.25, 0.5, 0.75]).get("x", (None, None, None)))


def _replace(df: DataFrame, name: str, c: Column) -> DataFrame:
    return df.select([c.alias(name) if n == name else F.col(f"`{n}`") for n in df.columns])


def mode(df: DataFrame, value: Column, order: Column | None = None):
    """The most frequent present value; of ties the first seen, or without an order the smallest."""
    counts = df.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(order if order is not None else value).alias("first"))
    got = counts.orderBy(F.desc("n"), "first").limit(1).collect()
    return got[0]["value"] if got else None


def drop_duplicates(df: DataFrame, step: dict, fit: Fit, keep: Sequence[str] = ()) -> DataFrame:
    """One row of each group of equal ones. keep: columns that do not count (a row number: its smallest stays)."""
    data = [c for c in df.columns if c not in keep]
    before = df.count()
    if keep:
        out = df.groupBy(*(F.col(f"`{c}`") for c in data)).agg(*(F.min(F.col(f"`{c}`")).alias(c) for c in keep)).select(*(F.col(f"`{c}`") for c in df.columns))
    else:
        out = df.dropDuplicates()
    fit.params["removedRows"] = before - out.count()
    return out


def drop_column(df: DataFrame, step: dict, fit: Fit) -> DataFrame:
    return df.drop(step["column"])


def impute(df: DataFrame, step: dict, fit: Fit, order: Column | None = None) -> DataFrame:
    v, method = _view(df, step["column"]), step.get("method")
    if v.stored == "numeric":
        method = method or "median"
        if method == "constant":
            fill = float(step["value"])
        elif method == "mean":
            fill = df.agg(F.avg(v.number)).first()[0]
        elif method == "mode":
            fill = mode(df, v.number, order)
        else:
            fill = _quartiles(df, v.number)[1]
        if fill is None:
            fit.note = "all values are missing"
            return df
        filled = F.coalesce(v.number, F.lit(float(fill)))
    else:
        fill = str(step["value"]) if method == "constant" else mode(df, v.text, order)
        if fill is None:
            fit.note = "all values are missing"
            return df
        filled = F.when(v.present, v.raw.cast("string")).otherwise(F.lit(fill))
    fit.params |= {"fill": fill, "filled": df.agg(F.count_if(~v.present)).first()[0]}
    return _replace(df, v.name, filled)


def outlier(df: DataFrame, step: dict, fit: Fit) -> DataFrame:
    v = _view(df, step["column"])
    q1, _, q3 = _quartiles(df, v.number) if v.stored == "numeric" else (None,) * 3
    if q1 is None:
        fit.note = "no numbers"
        return df
    lower, upper = iqr_bounds(q1, q3)
    far = (v.number < lower) | (v.number > upper)
    fit.params |= {"lower": lower, "upper": upper, "affected": df.agg(F.count_if(far)).first()[0]}
    if step.get("action") == "drop-rows":
        return df.where(~F.coalesce(far, F.lit(False)))
    clipped = F.when(v.number.isNotNull(), F.least(F.greatest(v.number, F.lit(lower)), F.lit(upper)))
    return _replace(df, v.name, clipped)


def log1p(df: DataFrame, step: dict, fit: Fit) -> DataFrame:
    v = _view(df, step["column"])
    least = df.agg(F.min(v.number)).first()[0] if v.stored == "numeric" else None
    if least is None or least <= -1:
        fit.note = "not applied: it needs numbers above -1"
        return df
    return _replace(df, v.name, F.log1p(v.number))


def _codes(df: DataFrame, value: Column) -> tuple[DataFrame, int]:
    """level, code for every distinct value, and their number. A code is the rank from 0 in order of UTF-16 code units, which are
    the order of big-endian UTF-16: levels are numbered in ranges apart, then offset."""
    levels = df.where(value.isNotNull()).select(value.alias("level")).distinct().withColumn("units", F.encode("level", "UTF-16BE"))
    n = levels.count()
    # bounds are levels chosen by hash, so a level's range is the same whenever it is read again
    ranges = min(MOST_RANGES, -(-n // LEVELS_A_RANGE))
    bounds = []
    if ranges > 1:
        some = levels.where(F.pmod(F.xxhash64("level"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, 20 * ranges / n)))
        bounds = sorted(bytes(r[0]) for r in some.select("units").collect())[::20][1:]
    bound = F.array(*(F.lit(x) for x in bounds)) if bounds else None
    levels = levels.withColumn("part", F.lit(0) if bound is None else F.size(F.filter(bound, lambda x: x <= F.col("units"))))
    placed = levels.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("units")))
    sums = levels.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    table = placed.join(F.broadcast(before), "part")  # one row a range
    return table.select("level", (F.col("before") + F.col("place") - 1).cast("double").alias("code")), n


def _coded(df: DataFrame, v: View, table: DataFrame) -> DataFrame:
    """df with v's values replaced by the second column of table, whose first holds the levels; null where it has none."""
    held = "coded"
    while held in df.columns:
        held = f"_{held}"
    level, code = table.columns
    packed = table.select(F.struct(F.col(level).alias("level"), F.col(code).alias("code")).alias(held))
    joined = df.join(packed, v.text == F.col(f"{held}.level"), "left")
    return joined.select([F.col(f"{held}.code").alias(v.name) if n == v.name else F.col(f"`{n}`") for n in df.columns])


def encode(df: DataFrame, step: dict, fit: Fit) -> DataFrame:
    v, method = _view(df, step["column"]), step.get("method") or "onehot"
    value = v.text
    if method == "frequency":
        counts = class_distribution(df, value).select(F.col("value").alias("level"), F.col("count").cast("double").alias("uses"))
        fit.params["levels"] = counts.count()
        # a table of levels may be large: Spark broadcasts it only if it is known to be small
        return _coded(df, v, counts)
    if method == "ordinal":
        table, n = _codes(df, value)
        if n > MAPPED_LEVELS:
            fit.params["levels"] = n
        else:
            fit.params["mapping"] = {r["level"]: int(r["code"]) for r in table.orderBy("code").collect()}
        return _coded(df, v, table)
    found = [r[0] for r in df.select(value.alias("x")).where("x is not null").distinct().limit(L.ONE_HOT_LEVELS + 1).collect()]
    levels = sorted(found, key=lambda s: s.encode("utf-16-be"))
    if len(levels) > L.ONE_HOT_LEVELS:
        fit.note = f"not applied: more than {L.ONE_HOT_LEVELS} levels"
        return df
    fit.params["levels"] = levels
    cells = [F.when(value == x, 1.0).otherwise(0.0).alias(f"{v.name}={x}") for x in levels]
    return df.select([c for n in df.columns for c in (cells if n == v.name else [F.col(f"`{n}`")])])


def scale(df: DataFrame, step: dict, fit: Fit) -> DataFrame:
    v, method = _view(df, step["column"]), step.get("method") or "standard"
    if v.stored != "numeric":
        fit.note = "no numbers"
        return df
    if method == "minmax":
        low, high = df.agg(F.min(v.number), F.max(v.number)).first()
        centre, spread = low, None if low is None else high - low
    elif method == "robust":
        q1, centre, q3 = _quartiles(df, v.number)
        spread = None if q1 is None else q3 - q1
    else:
        centre, spread = df.agg(F.avg(v.number), F.stddev_samp(v.number)).first()
        spread = 0.0 if centre is not None and spread is None else spread
    if centre is None:
        fit.note = "all values are missing"
        return df
    fit.params |= {"centre": centre, "spread": spread}
    if spread <= 0:
        fit.note = "no spread: all values become 0"
        return _replace(df, v.name, F.when(v.number.isNotNull(), 0.0))
    return _replace(df, v.name, (v.number - F.lit(float(centre))) / F.lit(float(spread)))


def _view(df: DataFrame, name: str) -> View:
    return next(v for v in views(df) if v.name == name)


OPS = {"drop-duplicates": drop_duplicates, "drop-column": drop_column, "impute": impute, "outlier": outlier, "log1p": log1p, "encode": encode, "scale": scale}


def apply(df: DataFrame, steps: Sequence[dict], order_column: str | None = None) -> tuple[DataFrame, list[Fit]]:
    """df after all steps, and what each was fitted to. Steps run by kind, each on what those before it left.

    Unknown steps and columns that are gone are left out, with a note. order_column numbers the rows: it breaks ties by
    first appearance and does not count for duplicates. df itself does not change.
    """
    log = []
    for step in sorted(steps, key=lambda s: STEP_ORDER.index(s["op"]) if s["op"] in STEP_ORDER else len(STEP_ORDER)):
        fit = Fit(step["op"], step.get("column"))
        log.append(fit)
        if step["op"] not in OPS:
            fit.note = "unknown step"
        elif step["op"] != "drop-duplicates" and step.get("column") not in df.columns:
            fit.note = "the column is gone"
        elif step["op"] == "drop-duplicates":
            df = drop_duplicates(df, step, fit, [order_column] if order_column else ())
        elif step["op"] == "impute":
            df = impute(df, step, fit, F.col(order_column) if order_column else None)
        else:
            df = OPS[step["op"]](df, step, fit)
    return df, log


def typed(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """df with the named text columns as doubles."""
    own = {v.name: v for v in views(df)}
    return df.select([own[n].number.alias(n) if n in numeric and not isinstance(df.schema[n].dataType, T.NumericType) else F.col(f"`{n}`") for n in df.columns])

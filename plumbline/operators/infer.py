"""Semantic types of columns and the counts that decide them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import limits as L
from plumbline.operators.stats import frequencies, unique_and_mode, unpivot
from plumbline.operators.views import View


def _parts(t: Column) -> Column:
    """What the counters look at in one trimmed, present text."""
    number = text.trimmed_number(t).isNotNull()
    return F.struct(
        number.alias("number"), (number & ~F.rlike(t, F.lit(text.LEADING_ZERO))).alias("plain"), text.trimmed_timestamp(t).isNotNull().alias("date"),
        F.lower(t).isin(*text.TRUE_FALSE).alias("boolean"), text.code_units(t).alias("length"), text.has_space(t).alias("spaced"),
    )


def value_counters(values: DataFrame) -> DataFrame:
    """name, present, numeric, plain, dates, booleans, length, spaced from name, value (trimmed text, null if missing) and
    count, the rows of that value. Each value is looked at once, however many rows and columns there are."""
    # a lambda's variable is computed once for all tests
    seen = values.select("name", "value", "count", F.get(F.transform(F.filter(F.array("value"), lambda x: x.isNotNull()), _parts), F.lit(0)).alias("p"))
    n = F.col("count")
    add = lambda test: F.coalesce(F.sum(F.when(test, n)), F.lit(0))
    return seen.groupBy("name").agg(
        add(F.col("value").isNotNull()).alias("present"), add(F.col("p.number")).alias("numeric"), add(F.col("p.plain")).alias("plain"), add(F.col("p.date")).alias("dates"),
        add(F.col("p.boolean")).alias("booleans"), F.coalesce(F.sum(F.col("p.length") * n), F.lit(0.0)).alias("length"), add(F.col("p.spaced")).alias("spaced"),
    )


def count_columns(df: DataFrame, views: Sequence[View], freq: DataFrame | None = None) -> tuple[int, dict[str, dict[str, float]]]:
    """Rows, and the counters of every column: one aggregate for missing values, and one over the distinct values of all text columns.

    freq: those values if they are known (name, value, count), those of other columns among them.
    """
    plain = [v for v in views if v.stored != "string"]
    got = df.agg(F.count(F.lit(1)), *(F.count_if(~v.present) for v in plain)).first()
    out = {v.name: {"missing": n} for v, n in zip(plain, got[1:], strict=True)}
    texts = {v.name: v.text for v in views if v.stored == "string"}
    if texts:
        values = freq.where(F.col("name").isin(list(texts))) if freq is not None else unpivot(df, texts).groupBy("name", "value").agg(F.count(F.lit(1)).alias("count"))
        empty = {"present": 0, "numeric": 0, "plain": 0, "dates": 0, "booleans": 0, "length": 0.0, "spaced": 0}
        found = {r["name"]: r.asDict() for r in value_counters(values).collect()}  # one row a column
        for name in texts:
            c = empty | {k: x for k, x in found.get(name, {}).items() if k != "name"}
            out[name] = {"missing": got[0] - c.pop("present")} | c
    return got[0], out


def stored_as_number(c: Mapping[str, float], rows: int) -> bool:
    """A text column is a numeric one if every present value is a number without a leading zero."""
    present = rows - c["missing"]
    return "numeric" in c and present > 0 and c["plain"] == present


def pick_type(c: Mapping[str, float], rows: int, unique: int) -> str:
    present = rows - c["missing"]
    if present == 0:
        return "text"
    for kind, n in (("boolean", c["booleans"]), ("numeric", c["plain"]), ("datetime", c["dates"])):
        if n / present >= L.MAJORITY:
            return kind
    share, mean = unique / present, c["length"] / present
    if share >= L.ID_UNIQUE_RATIO:
        return "id" if mean <= L.ID_MEAN_LENGTH and c["spaced"] / present <= L.ID_SPACE_RATIO else "text"
    return "text" if share >= L.TEXT_UNIQUE_RATIO and mean >= L.TEXT_MEAN_LENGTH else "categorical"


def invalid_count(c: Mapping[str, float], rows: int, kind: str, overridden: bool = False) -> int:
    """Present values that are none of the type; only numbers, dates and booleans can be invalid."""
    good = {"numeric": "numeric", "datetime": "dates", "boolean": "booleans"}.get(kind)
    if good is None or good not in c:
        return 0
    # the vote for numbers leaves out leading zeros, and so does the validity of an inferred type; a type that was set takes them
    return int(rows - c["missing"] - c["plain" if kind == "numeric" and not overridden else good])


def type_of(v: View, c: Mapping[str, float], rows: int, unique: int) -> str:
    if v.stored == "numeric" or v.stored == "string" and stored_as_number(c, rows):
        return "numeric"
    return "datetime" if v.stored == "datetime" else pick_type(c, rows, unique)


def profile_columns(df: DataFrame, views: Sequence[View]) -> DataFrame:
    """name, type, missing_count, missing_rate, invalid_count, invalid_rate, unique_count, mode_rate of every column."""
    freq = frequencies(df, {v.name: v.text for v in views}).persist()
    try:
        rows, counted = count_columns(df, views, freq)
        of = {r["name"]: r for r in unique_and_mode(freq).collect()}  # one row a column
    finally:
        freq.unpersist()
    out = []
    for v in views:
        c, r = counted[v.name], of.get(v.name)
        kind = type_of(v, c, rows, r["unique"] if r else 0)
        bad = invalid_count(c, rows, kind)
        share = lambda n: n / rows if rows else 0.0
        out.append((v.name, kind, int(c["missing"]), share(c["missing"]), bad, share(bad), r["unique"] if r else 0, r["mode_rate"] if r else 0.0))
    schema = "name string, type string, missing_count long, missing_rate double, invalid_count long, invalid_rate double, unique_count long, mode_rate double"
    return df.sparkSession.createDataFrame(out, schema)

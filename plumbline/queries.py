"""Queries of the profiler over the test tables, and SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import findings, infer, quality, recipe, relations, stats, transform
from plumbline.operators import limits as L
from plumbline.operators.views import views
from plumbline.plans import charts, profile
from plumbline.sources import csv, results

DIRTY = """
WITH base AS (
  SELECT o_orderkey AS row_id,
         concat('U', lpad(cast(o_orderkey AS string), 7, '0')) AS member_id,
         CASE WHEN o_orderkey % 25 = 0 THEN '' WHEN o_orderkey % 97 = 0 THEN 'n/a'
              ELSE cast(cast(round(o_totalprice) AS bigint) AS string) END AS amount,
         CASE WHEN o_orderkey % 50 = 1 THEN '  ' ELSE cast(cast(o_orderdate AS date) AS string) END AS joined,
         CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'No' END AS flag,
         concat('0', cast(6000 + o_orderkey % 900 AS string)) AS zip,
         o_orderpriority AS grade,
         CASE WHEN o_orderkey % 100 = 0 THEN 'JP' ELSE 'KR' END AS country,
         concat('note ', cast(o_orderkey AS string), ', nothing special happened') AS memo,
         CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS price,
         CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice * 2 + o_orderkey % 7 END AS price2,
         cast(o_orderkey % 5 AS double) AS rating
  FROM {orders})
SELECT * FROM base UNION ALL SELECT * FROM base WHERE row_id % 200 = 0
"""
WITH_DIRTY = f"WITH dirty AS ({DIRTY.format(orders='orders')})"

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        _queries[name] = fn
        if sql is not None:
            _sql[name] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def dirty(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(DIRTY, orders=table(spark, d, "orders"))


def number(df: DataFrame, *names: str) -> dict:
    own = {v.name: v for v in views(df)}
    return {n: own[n].number for n in names}


def rounded(df: DataFrame, digits: int = 4, *names: str) -> DataFrame:
    """Doubles rounded: the engines add up in different orders."""
    return df.select([F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" and (not names or c in names) else F.col(f"`{c}`") for c, t in df.dtypes])


def rows(spark: SparkSession, data: list, schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


def _summary_sql(source: str, columns: list[str], by: str = "") -> str:
    """The summary of the columns by plain SQL."""
    key = f"{by}, " if by else ""
    on = f" JOIN m USING ({by})" if by else ", m"
    parts = [
        f"""SELECT {key}'{c}' AS name, count(x) AS n, count(*) - count(x) AS missing, round(any_value(m.mean), 4) AS mean, round(CASE WHEN count(x) > 1 THEN stddev_samp(x) ELSE 0 END, 4) AS std,
            round(min(x), 4) AS min, round(quantile_cont(x, 0.25), 4) AS q1, round(quantile_cont(x, 0.5), 4) AS median, round(quantile_cont(x, 0.75), 4) AS q3, round(max(x), 4) AS max,
            round(CASE WHEN avg((x - m.mean) ** 2) <= 0 THEN 0 ELSE avg((x - m.mean) ** 3) / avg((x - m.mean) ** 2) ** 1.5 END, 4) AS skewness,
            round(CASE WHEN avg((x - m.mean) ** 2) <= 0 THEN 0 ELSE avg((x - m.mean) ** 4) / avg((x - m.mean) ** 2) ** 2 - 3 END, 4) AS kurtosis
            FROM (SELECT {key}cast({c} AS double) AS x FROM {source}) t{on.replace('m', f'(SELECT {key}avg(cast({c} AS double)) AS mean FROM {source}{f" GROUP BY {by}" if by else ""}) m', 1)}{f" GROUP BY {by}" if by else ""}"""
        for c in columns
    ]
    return " UNION ALL ".join(parts)


LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("numeric_summary", _summary_sql("lineitem", LINE))
def _(spark, d):
    df = table(spark, d, "lineitem")
    return rounded(stats.numeric_summary(df, number(df, *LINE)))


@query("numeric_summary_events", _summary_sql("events", ["value"]))
def _(spark, d):
    df = table(spark, d, "events")
    return rounded(stats.numeric_summary(df, number(df, "value")))


@query("numeric_summary_by_group", _summary_sql("lineitem", ["l_quantity", "l_extendedprice"], "l_returnflag"))
def _(spark, d):
    df = table(spark, d, "lineitem")
    return rounded(stats.numeric_summary(df, number(df, "l_quantity", "l_extendedprice"), by=["l_returnflag"]))


@query("dataset_overview", "SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicates FROM lineitem")
def _(spark, d):
    return stats.duplicate_rows(table(spark, d, "lineitem"))


@query("duplicate_rows", f"{WITH_DIRTY} SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicates FROM dirty")
def _(spark, d):
    return stats.duplicate_rows(dirty(spark, d))


@query("memory_estimate", f"{WITH_DIRTY} SELECT 8 * 4 * count(*) + sum(2 * (length(member_id) + length(amount) + length(joined) + length(flag) + length(zip) + length(grade) + length(country) + length(memo)))::BIGINT AS bytes FROM dirty")
def _(spark, d):
    df = dirty(spark, d)
    own = views(df)
    return df.agg(stats.memory_bytes([v.raw for v in own if v.stored != "string"], [v.raw for v in own if v.stored == "string"]).alias("bytes"))


TEXTS = ["member_id", "amount", "joined", "flag", "zip", "grade", "country", "memo"]
NUMERIC_SQL = r"regexp_matches(t, '^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$')"
DATE_SQL = r"try_cast(t AS date) IS NOT NULL"
_CELLS = " UNION ALL ".join(f"SELECT '{c}' AS name, row_id, nullif(trim({c}), '') AS t FROM dirty" for c in TEXTS)
_COUNTS = f"""{WITH_DIRTY}, cells AS ({_CELLS}),
freq AS (SELECT name, t, count(*) AS n, min(row_id) AS first FROM cells WHERE t IS NOT NULL GROUP BY name, t),
u AS (SELECT name, count(*) AS unique_count, max(n) * 1.0 / sum(n) AS mode_rate FROM freq GROUP BY name),
c AS (SELECT name, count(*) AS rows, count(*) - count(t) AS missing, count(*) FILTER (t IS NOT NULL AND {NUMERIC_SQL} AND NOT regexp_matches(t, '^[+-]?0[0-9]')) AS plain,
        count(*) FILTER (t IS NOT NULL AND {DATE_SQL}) AS dates, count(*) FILTER (lower(t) IN ('true','false','yes','no','y','n','t','f')) AS booleans,
        avg(length(t)) AS mean_length, avg(CASE WHEN contains(t, ' ') THEN 1.0 ELSE 0.0 END) FILTER (t IS NOT NULL) AS spaced FROM cells GROUP BY name),
kinds AS (SELECT c.*, u.unique_count, u.mode_rate, CASE WHEN rows = missing THEN 'text' WHEN booleans >= 0.9 * (rows - missing) THEN 'boolean' WHEN plain >= 0.9 * (rows - missing) THEN 'numeric'
        WHEN dates >= 0.9 * (rows - missing) THEN 'datetime'
        WHEN unique_count >= 0.99 * (rows - missing) THEN CASE WHEN mean_length <= 36 AND spaced <= 0.1 THEN 'id' ELSE 'text' END
        WHEN unique_count >= 0.5 * (rows - missing) AND mean_length >= 20 THEN 'text' ELSE 'categorical' END AS type FROM c JOIN u USING (name))"""


@query("missing_profile", f"{_COUNTS} SELECT name, missing AS missing_count, round(missing * 1.0 / rows, 6) AS missing_rate FROM kinds")
def _(spark, d):
    df = infer.profile_columns(_texts(spark, d), views(_texts(spark, d)))
    return rounded(df.select("name", "missing_count", "missing_rate"), 6)


def _texts(spark, d) -> DataFrame:
    return dirty(spark, d).select(*TEXTS)


@query("invalid_profile", f"{_COUNTS} SELECT name, CASE type WHEN 'numeric' THEN rows - missing - plain WHEN 'datetime' THEN rows - missing - dates WHEN 'boolean' THEN rows - missing - booleans ELSE 0 END AS invalid_count FROM kinds")
def _(spark, d):
    return infer.profile_columns(_texts(spark, d), views(_texts(spark, d))).select("name", "invalid_count")


@query("inferred_types", f"{_COUNTS} SELECT name, type FROM kinds")
def _(spark, d):
    return infer.profile_columns(_texts(spark, d), views(_texts(spark, d))).select("name", "type")


def _text_freq(spark, d) -> DataFrame:
    df = dirty(spark, d)
    return stats.frequencies(df, {v.name: v.text for v in views(df) if v.name in TEXTS}, F.col("row_id"))


@query("unique_mode_profile", f"{_COUNTS} SELECT name, unique_count AS \"unique\", round(mode_rate, 6) AS mode_rate FROM u")
def _(spark, d):
    return rounded(stats.unique_and_mode(_text_freq(spark, d)), 6)


@query("sample_values", f"{_COUNTS}, r AS (SELECT name, t AS value, row_number() OVER (PARTITION BY name ORDER BY first, t) AS rank FROM freq) SELECT name, cast(rank AS integer) AS rank, value FROM r WHERE rank <= 5")
def _(spark, d):
    return stats.sample_values(_text_freq(spark, d))


@query("top_values", f"{_COUNTS}, r AS (SELECT name, t AS value, n AS count, row_number() OVER (PARTITION BY name ORDER BY n DESC, first, t) AS rank FROM freq) SELECT name, cast(rank AS integer) AS rank, value, count FROM r WHERE rank <= 10")
def _(spark, d):
    return stats.top_values(_text_freq(spark, d))


@query("class_distribution", "SELECT o_orderpriority AS value, count(*) AS count FROM orders GROUP BY 1")
def _(spark, d):
    return stats.class_distribution(table(spark, d, "orders"), F.col("o_orderpriority"))


_MAGNITUDES = [(12345678.5, "12345678.5"), (1e7, "10000000"), (1e16, "10000000000000000"), (1e20, "100000000000000000000"), (1e21, "1e+21"), (1.5e300, "1.5e+300"), (1e-5, "0.00001"), (1e-6, "0.000001"), (1.5e-7, "1.5e-7"), (0.1, "0.1"), (-2.5, "-2.5"), (0.0, "0"), (-2.25e-6, "-0.00000225")]


@query("number_text", "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{t}')" for k, (_, t) in enumerate(_MAGNITUDES)) + ") v(id, text)")
def _(spark, d):
    return rows(spark, [(k, x) for k, (x, _) in enumerate(_MAGNITUDES)], "id int, x double").select("id", text.number_text(F.col("x")).alias("text"))


@query("type_override", f"{_COUNTS} SELECT name, type, missing AS missing_count, cast(0 AS bigint) AS invalid_count FROM (SELECT name, 'numeric' AS type, missing FROM c WHERE name = 'zip' UNION ALL SELECT name, 'categorical', missing FROM c WHERE name = 'flag')")
def _(spark, d):
    result = profile.profile(_texts(spark, d).select("zip", "flag"), type_overrides={"zip": "numeric", "flag": "categorical"})
    return rows(spark, [(c["name"], c["type"], c["missingCount"], c["invalidCount"]) for c in result["columns"]], "name string, type string, missing_count long, invalid_count long")


_LEVELS_SQL = "(SELECT o_orderkey AS level, concat('k', o_orderkey) AS code, o_orderkey % 7 AS uses FROM orders)"


@query("encode_many_levels", f"SELECT level, (dense_rank() OVER (ORDER BY code) - 1)::DOUBLE AS code, uses FROM {_LEVELS_SQL}")
def _(spark, d):
    df = table(spark, d, "orders").select(F.col("o_orderkey").alias("level"), F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("code"), (F.col("o_orderkey") % 7).alias("uses"))
    return transform.apply(df, [{"op": "encode", "column": "code", "method": "ordinal"}])[0]


@query("parse_number", f"{WITH_DIRTY} SELECT row_id, try_cast(nullif(trim(amount), '') AS double) AS amount_number FROM dirty")
def _(spark, d):
    return dirty(spark, d).select("row_id", text.to_number(F.col("amount")).alias("amount_number"))


@query("parse_date", f"{WITH_DIRTY} SELECT row_id, epoch_ms(try_cast(nullif(trim(joined), '') AS timestamp)) AS joined_ms FROM dirty")
def _(spark, d):
    return dirty(spark, d).select("row_id", text.to_epoch_ms(F.col("joined")).alias("joined_ms"))


@query("leading_zero", f"{WITH_DIRTY} SELECT zip, amount, regexp_matches(zip, '^[+-]?0[0-9]') AS zip_zero, regexp_matches(trim(amount), '^[+-]?0[0-9]') AS amount_zero FROM dirty")
def _(spark, d):
    return dirty(spark, d).select("zip", "amount", text.has_leading_zero(F.col("zip")).alias("zip_zero"), text.has_leading_zero(F.col("amount")).alias("amount_zero"))


@query("valid_for", f"""{WITH_DIRTY} SELECT row_id, trim(amount) = '' OR try_cast(nullif(trim(amount), '') AS double) IS NOT NULL AS amount_ok, trim(joined) = '' OR try_cast(nullif(trim(joined), '') AS date) IS NOT NULL AS joined_ok,
lower(flag) IN ('yes', 'no') AS flag_ok, true AS grade_ok FROM dirty""")
def _(spark, d):
    kinds = {"amount": "numeric", "joined": "datetime", "flag": "boolean", "grade": "categorical"}
    return dirty(spark, d).select("row_id", *(text.is_valid_for(F.col(c), k).alias(f"{c}_ok") for c, k in kinds.items()))


@query("quantiles_r7", "SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS p, round(unnest(quantile_cont(cast(value AS double), [0.05, 0.25, 0.5, 0.75, 0.95])), 6) AS value FROM events")
def _(spark, d):
    return rounded(stats.quantiles(table(spark, d, "events"), F.col("value").cast("double"), [0.05, 0.25, 0.5, 0.75, 0.95]), 6)


def _histogram(spark, df, columns) -> DataFrame:
    long = stats.unpivot(df, columns).where("value is not null")
    ranges = {r["name"]: (r["lo"], r["hi"], r["n"]) for r in long.groupBy("name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n")).collect()}
    got = stats.histograms(df, {n: columns[n] for n in ranges}, ranges)
    return rows(spark, [(n, k, c) for n, counts in got.items() for k, c in enumerate(counts) if c], "name string, bin int, count long")


def _histogram_sql(source: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{n}' AS name, cast(least(bins - 1, floor((x - lo) / ((hi - lo) / bins))) AS integer) AS bin, count(*) AS count
        FROM (SELECT {c} AS x FROM {source} WHERE {c} IS NOT NULL), (SELECT min({c}) AS lo, max({c}) AS hi, least(50, ceil(log2(count({c}))) + 1) AS bins FROM {source}) GROUP BY 1, 2"""
        for n, c in columns.items()
    )


@query("histogram_sturges", _histogram_sql("lineitem", {c: f"cast({c} AS double)" for c in LINE}))
def _(spark, d):
    df = table(spark, d, "lineitem")
    return _histogram(spark, df, number(df, *LINE))


@query("datetime_histogram", _histogram_sql("orders", {"o_orderdate": "cast(epoch_ms(cast(o_orderdate AS timestamp)) AS double)"}))
def _(spark, d):
    df = table(spark, d, "orders")
    return _histogram(spark, df, {"o_orderdate": F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("double")})


@query("density_curve", """WITH v AS (SELECT cast(value AS double) AS x FROM events WHERE value IS NOT NULL),
m AS (SELECT min(x) AS lo, max(x) AS hi, count(x) AS n, stddev_samp(x) AS std, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM v),
h AS (SELECT *, 0.9 * (CASE WHEN iqr > 0 THEN least(std, iqr / 1.349) ELSE std END) * n ** -0.2 AS h, (hi - lo) / least(50, ceil(log2(n)) + 1) AS width FROM m),
f AS (SELECT lo + (least(255, floor((x - lo) / ((hi - lo) / 256))) + 0.5) * ((hi - lo) / 256) AS mid, count(*) AS c FROM v, h GROUP BY 1),
g AS (SELECT lo + (hi - lo) * k / 63 AS x FROM h, (SELECT unnest(generate_series(0, 63)) AS k))
SELECT cast(printf('%.6g', x) AS double) AS x, cast(printf('%.6g', sum(CASE WHEN abs(x - mid) <= 4 * h THEN c * exp(-0.5 * ((x - mid) / h) ** 2) ELSE 0 END) * any_value(width / (h * sqrt(2 * pi())))) AS double) AS y
FROM g, f, h GROUP BY g.x""")
def _(spark, d):
    df = table(spark, d, "events")
    c = number(df, "value")
    r = stats.numeric_summary(df, c).first()
    fine = stats.histograms(df, c, {"value": (r["min"], r["max"], r["n"])}, L.FINE_BINS)["value"]
    edges = stats.bin_edges(r["min"], r["max"], r["n"])
    return rows(spark, stats.density(fine, r["min"], r["max"], r["n"], r["std"], r["q3"] - r["q1"], edges[1] - edges[0]), "x double, y double")


def _iqr_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS name, round(any_value(lo), 4) AS lower, round(any_value(hi), 4) AS upper, count(*) FILTER (x < lo OR x > hi) AS count, round(count(*) FILTER (x < lo OR x > hi) * 1.0 / count(x), 6) AS rate
        FROM (SELECT cast({c} AS double) AS x FROM {source}), (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont(cast({c} AS double), 0.25) AS q1, quantile_cont(cast({c} AS double), 0.75) AS q3 FROM {source}))"""
        for c in columns
    )


@query("iqr_outliers", _iqr_sql("lineitem", LINE))
def _(spark, d):
    df = table(spark, d, "lineitem")
    return rounded(rounded(stats.iqr_outliers(df, number(df, *LINE)), 4, "lower", "upper"), 6, "rate")


@query("zscore_outliers", " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) FILTER (s > 0 AND abs(x - m) > 3.0 * s) AS count, round(count(*) FILTER (s > 0 AND abs(x - m) > 3.0 * s) * 1.0 / count(x), 6) AS rate FROM (SELECT cast({c} AS double) AS x FROM {t}), (SELECT avg(cast({c} AS double)) AS m, stddev_samp(cast({c} AS double)) AS s FROM {t})" for t, c in (("events", "value"),)))
def _(spark, d):
    df = table(spark, d, "events")
    return rounded(stats.zscore_outliers(df, number(df, "value")), 6)


_PAIRS = [(a, b) for i, a in enumerate(LINE) for b in LINE[i + 1 :]]


@query("pearson_pairs", " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 6) AS pearson FROM lineitem" for a, b in _PAIRS))
def _(spark, d):
    df = table(spark, d, "lineitem")
    return rounded(rows(spark, [(*p, r) for p, r in relations.pearson_pairs(df, number(df, *LINE)).items()], "left string, right string, pearson double"), 6)


@query("pearson_pairwise_nulls", f"{WITH_DIRTY} SELECT 'price' AS \"left\", 'price2' AS \"right\", round(corr(price, price2), 6) AS pearson FROM dirty UNION ALL SELECT 'price', 'rating', round(corr(price, rating), 6) FROM dirty UNION ALL SELECT 'price2', 'rating', round(corr(price2, rating), 6) FROM dirty")
def _(spark, d):
    df = dirty(spark, d)
    return rounded(rows(spark, [(*p, r) for p, r in relations.pearson_pairs(df, number(df, "price", "price2", "rating")).items()], "left string, right string, pearson double"), 6)


@query("spearman_pairs", f"{WITH_DIRTY}, pairs AS (SELECT price, rating FROM dirty WHERE price IS NOT NULL AND rating IS NOT NULL), r AS (SELECT rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0 AS a, rank() OVER (ORDER BY rating) + (count(*) OVER (PARTITION BY rating) - 1) / 2.0 AS b FROM pairs) SELECT round(corr(a, b), 6) AS spearman FROM r")
def _(spark, d):
    df = dirty(spark, d)
    c = number(df, "price", "rating")
    return rounded(rows(spark, [(relations.spearman(df, c["price"], c["rating"]),)], "spearman double"), 6)


@query("average_ranks", "SELECT CAST(s_acctbal AS DOUBLE) AS value, CAST(min(r) AS DOUBLE) AS rank FROM (SELECT s_acctbal, rank() OVER (ORDER BY s_acctbal) + (count(*) OVER (PARTITION BY s_acctbal) - 1) / 2.0 AS r FROM supplier) GROUP BY 1")
def _(spark, d):
    return relations.ranks(table(spark, d, "supplier"), F.col("s_acctbal").cast("double"))


@query("vif", """WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c FROM lineitem)
SELECT 'l_quantity' AS name, round((1 - c*c) / (1 + 2*a*b*c - a*a - b*b - c*c), 6) AS vif FROM r UNION ALL SELECT 'l_extendedprice', round((1 - b*b) / (1 + 2*a*b*c - a*a - b*b - c*c), 6) FROM r UNION ALL SELECT 'l_discount', round((1 - a*a) / (1 + 2*a*b*c - a*a - b*b - c*c), 6) FROM r""")
def _(spark, d):
    df = table(spark, d, "lineitem")
    return rounded(rows(spark, list(relations.vif(df, number(df, "l_quantity", "l_extendedprice", "l_discount")).items()), "name string, vif double"), 6)


@query("scatter_sample", """WITH o AS (SELECT l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) - 1 AS place, count(*) OVER () AS n FROM lineitem)
SELECT k, x, y FROM o JOIN (SELECT unnest(generate_series(0, 199)) AS k) ON place = floor(k * n / 200.0)""")
def _(spark, d):
    df = table(spark, d, "lineitem")
    c = number(df, "l_quantity", "l_extendedprice")
    return relations.scatter(df, c["l_quantity"], c["l_extendedprice"], [F.col(x) for x in ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")])


@query("heatmap_cells", " UNION ALL ".join(f"SELECT {LINE.index(a)} AS \"row\", {LINE.index(b)} AS col, round(corr({a}, {b}), 6) AS value FROM lineitem" for a, b in _PAIRS))
def _(spark, d):
    df = table(spark, d, "lineitem")
    pairs = [{"left": a, "right": b, "pearson": r} for (a, b), r in relations.pearson_pairs(df, number(df, *LINE)).items()]
    spec = charts.heatmap(pairs, [{"name": n} for n in LINE])
    return rounded(rows(spark, [(c["row"], c["col"], c["value"]) for c in spec["data"]["cells"]], "row int, col int, value double"), 6)


def _facts(spark, d, df: DataFrame | None = None) -> tuple[list[dict], dict, list[dict]]:
    """Column summaries, dataset and pairs of a table, the dirty one unless another is given, for the rules."""
    df = dirty(spark, d).drop("row_id") if df is None else df
    own = views(df)
    out = []
    for r in infer.profile_columns(df, own).collect():
        out.append({"name": r["name"], "type": r["type"], "missingRate": r["missing_rate"], "invalidRate": r["invalid_rate"], "uniqueCount": r["unique_count"], "modeRate": r["mode_rate"], "stats": {}})
    numeric = {c["name"]: next(v for v in own if v.name == c["name"]).number for c in out if c["type"] == "numeric"}
    # numbers are parsed once for all that reads them
    parsed = df.select(*(c.alias(n) for n, c in numeric.items())).persist()
    numeric = {n: F.col(f"`{n}`") for n in numeric}
    summary = {r["name"]: r.asDict() for r in stats.numeric_summary(parsed, numeric).collect()}
    rates = {r["name"]: r["rate"] for r in stats.iqr_outliers(parsed, numeric).collect()}
    for c in out:
        if c["name"] in summary:
            c["stats"] = {k: summary[c["name"]][k] for k in ("std", "skewness", "kurtosis")} | {"outlierRate": rates[c["name"]]}
    n, repeated = stats.duplicate_rows(df).first()
    # the added row number made rows differ; without it they repeat where all else does
    v = relations.vif(parsed, numeric)
    pairs = [{"left": a, "right": b, "pearson": r, "vif": v[a]} for (a, b), r in relations.pearson_pairs(parsed, numeric).items()]
    parsed.unpersist()
    return out, {"rowCount": n, "duplicateRowCount": repeated}, pairs


ALL = [*TEXTS, "price", "price2", "rating"]
_NUMBERS = {"amount": f"CASE WHEN {NUMERIC_SQL.replace('t,', 'trim(amount),', 1)} THEN try_cast(trim(amount) AS double) END", "price": "price", "price2": "price2", "rating": "rating"}
_STATS = " UNION ALL ".join(
    f"""SELECT '{n}' AS name, avg((x - m) ** 3) / avg((x - m) ** 2) ** 1.5 AS skewness, avg((x - m) ** 4) / avg((x - m) ** 2) ** 2 - 3 AS kurtosis, stddev_samp(x) AS std,
    count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) * 1.0 / count(x) AS outlier_rate
    FROM (SELECT {x} AS x FROM dirty), (SELECT avg({x}) AS m, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM dirty)"""
    for n, x in _NUMBERS.items()
)
_MORE = " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows, count(*) - count({n}) AS missing, count(DISTINCT {n}) AS unique_count, (SELECT max(c) FROM (SELECT count(*) AS c FROM dirty WHERE {n} IS NOT NULL GROUP BY {n})) * 1.0 / count({n}) AS mode_rate, 'numeric' AS type, 0 AS invalid FROM dirty" for n in ("price", "price2", "rating"))
_RULES = f"""{_COUNTS}, s AS ({_STATS}),
cols AS (SELECT a.*, s.skewness, s.kurtosis, s.std, coalesce(s.outlier_rate, 0) AS outlier_rate FROM (
  SELECT name, rows, missing, unique_count, mode_rate, type, CASE type WHEN 'numeric' THEN rows - missing - plain WHEN 'datetime' THEN rows - missing - dates WHEN 'boolean' THEN rows - missing - booleans ELSE 0 END AS invalid FROM kinds
  UNION ALL {_MORE}) a LEFT JOIN s USING (name)),
dup AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(ALL)} FROM dirty)) AS n FROM dirty)"""


_PENALTIES = f"""{_RULES}, m AS (SELECT 'missing' AS key, avg(missing * 1.0 / rows) * 100 AS x, 25 AS cap FROM cols UNION ALL SELECT 'duplicate', (SELECT n FROM dup) * 300.0 / max(rows), 15 FROM cols
  UNION ALL SELECT 'constant', 5.0 * count(*) FILTER (type NOT IN ('id', 'text') AND mode_rate >= 0.95), 15 FROM cols
  UNION ALL SELECT 'cardinality', 5.0 * count(*) FILTER (type = 'categorical' AND unique_count >= 50 AND unique_count >= 0.5 * rows), 15 FROM cols
  UNION ALL SELECT 'outlier', avg(outlier_rate) FILTER (type = 'numeric') * 300, 15 FROM cols UNION ALL SELECT 'invalid', avg(invalid * 1.0 / rows) FILTER (type NOT IN ('id', 'text')) * 500, 15 FROM cols),
p AS (SELECT key, cast(floor(least(cap, x) + 0.5) AS integer) AS penalty FROM m)"""


@query("health_items", f"{_PENALTIES} SELECT * FROM p")
def _(spark, d):
    columns, dataset, _ = _facts(spark, d)
    return rows(spark, [(i["key"], i["penalty"]) for i in quality.health(columns, dataset)["items"]], "key string, penalty int")


@query("health_score", f"{_PENALTIES}, t AS (SELECT greatest(0, 100 - sum(penalty)) AS total FROM p) SELECT cast(total AS integer) AS total, CASE WHEN total >= 80 THEN 'good' WHEN total >= 50 THEN 'fair' ELSE 'poor' END AS grade FROM t")
def _(spark, d):
    columns, dataset, _ = _facts(spark, d)
    h = quality.health(columns, dataset)
    return rows(spark, [(h["total"], h["grade"])], "total int, grade string")


@query("findings_column", f"""{_RULES} SELECT type_ AS type, name FROM (
  SELECT 'F-MISSING-HIGH' AS type_, name FROM cols WHERE missing >= 0.2 * rows
  UNION ALL SELECT 'F-MISSING-IMPUTE', name FROM cols WHERE missing >= 0.05 * rows AND missing < 0.2 * rows AND abs(skewness) >= 1
  UNION ALL SELECT 'F-CONST-COL', name FROM cols WHERE mode_rate >= 0.95
  UNION ALL SELECT 'F-HIGH-CARD', name FROM cols WHERE type = 'categorical' AND unique_count >= 50 AND unique_count >= 0.5 * rows
  UNION ALL SELECT 'F-ID-COL', name FROM cols WHERE type = 'id' AND unique_count >= 0.99 * rows
  UNION ALL SELECT 'F-SKEW', name FROM cols WHERE type = 'numeric' AND abs(skewness) >= 2
  UNION ALL SELECT 'F-KURTOSIS', name FROM cols WHERE type = 'numeric' AND kurtosis >= 7
  UNION ALL SELECT 'F-OUTLIER-RATE', name FROM cols WHERE type = 'numeric' AND outlier_rate >= 0.05
  UNION ALL SELECT 'F-OUTLIER-ACTION', name FROM cols WHERE type = 'numeric' AND outlier_rate >= 0.01 AND abs(skewness) >= 1
  UNION ALL SELECT 'F-BIN-SENSITIVE', name FROM cols WHERE type = 'numeric' AND unique_count <= 20)""")
def _(spark, d):
    columns, dataset, _ = _facts(spark, d)
    found = findings.build(dataset, columns, [], fold=False)
    return rows(spark, [(f["type"], f["targets"][0]) for f in found if f["scope"] == "column"], "type string, name string")


@query("findings_dataset", f"""{_RULES}, r AS (SELECT corr(price, price2) AS pp FROM dirty) SELECT 'F-DUP-ROW' AS type FROM dup WHERE n >= 1
  UNION ALL SELECT 'F-CORR-METHOD' FROM (SELECT count(*) AS n FROM cols WHERE type = 'numeric' AND abs(skewness) >= 2) WHERE n >= 1 UNION ALL SELECT 'F-CORR-CAUSAL' FROM r WHERE abs(pp) >= 0.7""")
def _(spark, d):
    columns, dataset, pairs = _facts(spark, d)
    return rows(spark, [(f["type"],) for f in findings.build(dataset, columns, pairs, fold=False) if f["scope"] == "dataset"], "type string")


_R = " UNION ALL ".join(f"SELECT '{a}' AS l, '{b}' AS r, corr({_NUMBERS[a]}, {_NUMBERS[b]}) AS pearson FROM dirty" for i, a in enumerate(_NUMBERS) for b in list(_NUMBERS)[i + 1 :])
_WHOLE = "(SELECT {columns} FROM dirty WHERE {present})".format(columns=", ".join(f"{x} AS {n}" for n, x in _NUMBERS.items()), present=" AND ".join(f"({x}) IS NOT NULL" for x in _NUMBERS.values()))


def _minor(names: list[str]) -> str:
    """The determinant of the correlations of up to four columns of the table `whole`, by expansion along the first row."""
    r = lambda a, b: "1.0" if a == b else f"corr({a}, {b})"

    def det(left: list[str], top: list[str]) -> str:
        if not left:
            return "1.0"
        parts = [f"{'-' if k % 2 else '+'} {r(left[0], t)} * {det(left[1:], top[:k] + top[k + 1 :])}" for k, t in enumerate(top)]
        return f"({' '.join(parts)})"

    return det(names, names)


_VIF = " UNION ALL ".join(f"SELECT '{n}' AS name, {_minor([x for x in _NUMBERS if x != n])} / {_minor(list(_NUMBERS))} AS vif FROM whole" for n in _NUMBERS)
_MULTI = f"""{_RULES}, rs AS ({_R}), whole AS {_WHOLE}, vifs AS ({_VIF}), multi AS (SELECT l, r FROM rs JOIN vifs ON name = l WHERE abs(pearson) >= 0.8 OR vif >= 10)"""


@query("findings_pair", f"{_MULTI} SELECT 'F-MULTICOLLINEAR' AS type, l AS \"left\", r AS \"right\" FROM multi")
def _(spark, d):
    columns, dataset, pairs = _facts(spark, d)
    return rows(spark, [(f["type"], *f["targets"]) for f in findings.build(dataset, columns, pairs, fold=False) if f["scope"] == "pair"], "type string, left string, right string")


_FOUND = f"""{_MULTI}, column_rules AS (SELECT * FROM (
  SELECT 3 AS severity, 'F-MISSING-HIGH' AS finding, name FROM cols WHERE missing >= 0.2 * rows
  UNION ALL SELECT 2, 'F-MISSING-IMPUTE', name FROM cols WHERE missing >= 0.05 * rows AND missing < 0.2 * rows AND abs(skewness) >= 1
  UNION ALL SELECT 3, 'F-CONST-COL', name FROM cols WHERE mode_rate >= 0.95
  UNION ALL SELECT 2, 'F-HIGH-CARD', name FROM cols WHERE type = 'categorical' AND unique_count >= 50 AND unique_count >= 0.5 * rows
  UNION ALL SELECT 1, 'F-ID-COL', name FROM cols WHERE type = 'id' AND unique_count >= 0.99 * rows
  UNION ALL SELECT 2, 'F-SKEW', name FROM cols WHERE type = 'numeric' AND abs(skewness) >= 2
  UNION ALL SELECT 2, 'F-OUTLIER-RATE', name FROM cols WHERE type = 'numeric' AND outlier_rate >= 0.05
  UNION ALL SELECT 1, 'F-OUTLIER-ACTION', name FROM cols WHERE type = 'numeric' AND outlier_rate >= 0.01 AND abs(skewness) >= 1)),
steps AS (SELECT 2 AS severity, 0 AS targets, 'F-DUP-ROW' AS finding, 'drop-duplicates' AS op, NULL AS "column", '' AS how, 0 AS seq FROM dup WHERE n >= 1
  UNION ALL SELECT 3, 2, 'F-MULTICOLLINEAR', 'drop-column', unnest([l, r]), '', 0 FROM multi
  UNION ALL SELECT severity, 1, finding, 'drop-column', name, '', 1 FROM column_rules WHERE finding IN ('F-CONST-COL', 'F-ID-COL', 'F-HIGH-CARD', 'F-MISSING-HIGH')
  UNION ALL SELECT severity, 1, finding, 'impute', name, CASE WHEN type = 'numeric' THEN 'median' ELSE 'mode' END, 0 FROM column_rules JOIN cols USING (name) WHERE finding IN ('F-MISSING-HIGH', 'F-MISSING-IMPUTE')
  UNION ALL SELECT severity, 1, finding, 'encode', name, 'frequency', 0 FROM column_rules WHERE finding = 'F-HIGH-CARD'
  UNION ALL SELECT severity, 1, finding, 'outlier', name, 'clip', 0 FROM column_rules WHERE finding IN ('F-OUTLIER-RATE', 'F-OUTLIER-ACTION')
  UNION ALL SELECT severity, 1, finding, 'log1p', name, '', 0 FROM column_rules WHERE finding = 'F-SKEW')"""


@query("suggest_steps", f"""{_FOUND} SELECT concat(op, ':', coalesce("column", ''), ':', how) AS id, op, "column", finding
  FROM steps QUALIFY row_number() OVER (PARTITION BY op, "column" ORDER BY severity DESC, targets DESC, finding, seq) = 1""")
def _(spark, d):
    columns, dataset, pairs = _facts(spark, d)
    steps = recipe.normalize(recipe.suggest(findings.build(dataset, columns, pairs), columns))
    return rows(spark, [(s["id"], s["op"], s["column"], s["findingType"]) for s in steps], "id string, op string, column string, finding string")


WILD = """
SELECT CASE WHEN o_orderkey % 10 = 3 THEN NULL WHEN o_orderkey % 40 = 0 THEN cast(1000 + o_orderkey AS double) ELSE cast(o_orderkey % 10 AS double) END AS tail,
       cast(CASE WHEN o_orderkey % 14 = 0 THEN 1000 ELSE o_orderkey % 10 END AS double) AS far,
       cast(o_orderkey % 1000 AS double) / 100000 AS fine,
       concat('c', cast(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_orderkey - o_orderkey % 10 + 1 END AS string)) AS level
FROM {orders}
"""
_WILD_STATS = " UNION ALL ".join(
    f"""SELECT '{c}' AS name, count(*) AS rows, count(*) - count(x) AS missing, count(DISTINCT x) AS unique_count, stddev_samp(x) AS std, avg((x - m) ** 3) / avg((x - m) ** 2) ** 1.5 AS skewness,
    avg((x - m) ** 4) / avg((x - m) ** 2) ** 2 - 3 AS kurtosis, count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) * 1.0 / count(x) AS rate
    FROM (SELECT {c} AS x FROM wild), (SELECT avg({c}) AS m, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM wild)"""
    for c in ("tail", "far", "fine")
)
_WILD = f"""WITH wild AS ({WILD.format(orders="orders")}), s AS ({_WILD_STATS}), v AS (SELECT count(*) AS rows, count(DISTINCT level) AS unique_count FROM wild)"""


def _wild(spark, d) -> list[dict]:
    df = spark.sql(WILD, orders=table(spark, d, "orders"))
    columns, dataset, _ = _facts(spark, d, df)
    return findings.build(dataset, columns, [], "tail", fold=False)


@query("findings_skewed_table", f"""{_WILD} SELECT 'F-MISSING-HIGH' AS type, 'column' AS scope, name AS target FROM s WHERE missing >= 0.2 * rows
  UNION ALL SELECT 'F-MISSING-IMPUTE', 'column', name FROM s WHERE missing >= 0.05 * rows AND missing < 0.2 * rows AND abs(skewness) >= 1
  UNION ALL SELECT 'F-HIGH-CARD', 'column', 'level' FROM v WHERE unique_count >= 50 AND unique_count >= 0.5 * rows
  UNION ALL SELECT 'F-DUP-ROW', 'dataset', '' WHERE (SELECT count(*) FROM wild) > (SELECT count(*) FROM (SELECT DISTINCT * FROM wild))
  UNION ALL SELECT 'F-SKEW', 'column', name FROM s WHERE abs(skewness) >= 2 UNION ALL SELECT 'F-KURTOSIS', 'column', name FROM s WHERE kurtosis >= 7
  UNION ALL SELECT 'F-OUTLIER-RATE', 'column', name FROM s WHERE rate >= 0.05 UNION ALL SELECT 'F-OUTLIER-ACTION', 'column', name FROM s WHERE rate >= 0.01 AND abs(skewness) >= 1
  UNION ALL SELECT 'F-BIN-SENSITIVE', 'column', name FROM s WHERE unique_count <= 20
  UNION ALL SELECT 'F-CORR-METHOD', 'dataset', '' WHERE (SELECT count(*) FROM s WHERE abs(skewness) >= 2) > 0
  UNION ALL SELECT 'F-TARGET-SKEW', 'column', name FROM s WHERE name = 'tail' AND abs(skewness) >= 1
  UNION ALL SELECT 'F-SCALE-DIFF', 'dataset', '' FROM (SELECT max(std) / min(std) AS ratio FROM s WHERE std > 0) WHERE ratio >= 100""")
def _(spark, d):
    return rows(spark, [(f["type"], f["scope"], f["targets"][0] if f["scope"] == "column" else "") for f in _wild(spark, d)], "type string, scope string, target string")


@query("target_skew", f"{_WILD} SELECT name AS target, round(skewness, 6) AS skewness FROM s WHERE name = 'tail' AND abs(skewness) >= 1")
def _(spark, d):
    return rounded(rows(spark, [(f["targets"][0], f["metrics"]["skewness"]) for f in _wild(spark, d) if f["type"] == "F-TARGET-SKEW"], "target string, skewness double"), 6)


_GAPS = {f"c{k}": f"CASE WHEN o_orderkey % 3 <> 0 THEN cast(o_orderkey * {k} % 101 AS double) END" for k in range(1, 9)}


@query("findings_collapsed", f"""WITH gaps AS (SELECT {', '.join(f'{x} AS {n}' for n, x in _GAPS.items())} FROM orders),
m AS ({' UNION ALL '.join(f"SELECT '{n}' AS name, count(*) - count({n}) AS missing, count(*) AS rows FROM gaps" for n in _GAPS)}), r AS (SELECT name, row_number() OVER (ORDER BY name) AS k FROM m WHERE missing >= 0.2 * rows)
SELECT 'F-MISSING-HIGH' AS type, name AS targets, cast(0 AS integer) AS collapsed FROM r WHERE k <= 5 UNION ALL SELECT 'F-MISSING-HIGH', string_agg(name, ',' ORDER BY k), cast(count(*) AS integer) FROM r WHERE k > 5 HAVING count(*) > 0""")
def _(spark, d):
    df = table(spark, d, "orders").select(*(F.expr(x).alias(n) for n, x in _GAPS.items()))
    columns = [{"name": r["name"], "type": r["type"], "missingRate": r["missing_rate"], "invalidRate": r["invalid_rate"], "uniqueCount": r["unique_count"], "modeRate": r["mode_rate"], "stats": {}} for r in infer.profile_columns(df, views(df)).collect()]
    columns.sort(key=lambda c: df.columns.index(c["name"]))
    found = findings.build({"rowCount": stats.duplicate_rows(df).first()["rows"], "duplicateRowCount": 0}, columns, [])
    return rows(spark, [(f["type"], ",".join(f["targets"]), f["metrics"].get("collapsedCount", 0)) for f in found], "type string, targets string, collapsed int")


@query("result_json_roundtrip", f"{_COUNTS} SELECT name, type, missing AS missing_count, unique_count FROM kinds WHERE name IN ('flag', 'zip', 'amount')")
def _(spark, d):
    again = results.loads(results.dumps(profile.profile(_texts(spark, d).select("flag", "zip", "amount"))))
    return rows(spark, [(c["name"], c["type"], c["missingCount"], c["uniqueCount"]) for c in again["columns"]], "name string, type string, missing_count long, unique_count long")


def _shared_folder(spark) -> str:
    """A new folder that all executors see: in spark.checkpoint.dir, or a local one where all runs on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared or tempfile.gettempdir()}/{uuid.uuid4()}"


@query("csv_roundtrip", "SELECT cast(n_nationkey AS varchar) AS n_nationkey, n_name, cast(n_nationkey * 12345678.5 AS double) AS big, n_name || ', \"' || n_regionkey || '\"' AS quoted FROM nation")
def _(spark, d):
    df = table(spark, d, "nation").select("n_nationkey", "n_name", (F.col("n_nationkey") * F.lit(12345678.5)).alias("big"), F.concat("n_name", F.lit(', "'), F.col("n_regionkey").cast("string"), F.lit('"')).alias("quoted"))
    to = _shared_folder(spark)
    csv.write_csv(df, to)
    return csv.read_csv(spark, to + "/part-*", max_bytes=None)[0].select("n_nationkey", "n_name", text.to_number(F.col("big")).alias("big"), "quoted")


@query("target_imbalance", f"{WITH_DIRTY} SELECT country AS min_class, round(count(*) * 1.0 / (SELECT count(*) FROM dirty), 6) AS share FROM dirty GROUP BY country HAVING count(*) <= 0.1 * (SELECT count(*) FROM dirty)")
def _(spark, d):
    df = dirty(spark, d)
    classes = {r["value"]: r["count"] for r in stats.class_distribution(df, F.col("country")).collect()}
    column = {"name": "country", "type": "categorical", "missingRate": 0.0, "invalidRate": 0.0, "uniqueCount": len(classes), "modeRate": 0.0, "classDistribution": classes}
    found = findings.build({"rowCount": sum(classes.values()), "duplicateRowCount": 0}, [column], [], "country")
    return rounded(rows(spark, [(f["metrics"]["minClass"], f["metrics"]["minClassRatio"]) for f in found if f["type"] == "F-CLASS-IMBALANCE"], "min_class string, share double"), 6)


@query("target_leakage", f"{WITH_DIRTY} SELECT other, 'price' AS target FROM (SELECT 'price2' AS other, corr(price, price2) AS r FROM dirty UNION ALL SELECT 'amount', corr(price, try_cast(trim(amount) AS double)) FROM dirty) WHERE abs(r) >= 0.95")
def _(spark, d):
    columns, dataset, pairs = _facts(spark, d)
    return rows(spark, [tuple(f["targets"]) for f in findings.build(dataset, columns, pairs, "price") if f["type"] == "F-LEAKAGE"], "other string, target string")


@query("scale_diff", f"{_RULES} SELECT round(max(std) / min(std), 4) AS std_ratio FROM cols WHERE std > 0 HAVING max(std) / min(std) >= 100")
def _(spark, d):
    columns, dataset, pairs = _facts(spark, d)
    return rounded(rows(spark, [(f["metrics"]["stdRatio"],) for f in findings.build(dataset, columns, pairs, "price") if f["type"] == "F-SCALE-DIFF"], "std_ratio double"), 4)


def _step(**step):
    return lambda spark, d: transform.apply(dirty(spark, d), [step], "row_id")[0]


@query("drop_duplicates", f"{WITH_DIRTY} SELECT {', '.join(ALL)}, min(row_id) AS row_id FROM dirty GROUP BY ALL")
def _(spark, d):
    return _step(op="drop-duplicates")(spark, d)


@query("drop_column", f"{WITH_DIRTY} SELECT * EXCLUDE (memo) FROM dirty")
def _(spark, d):
    return _step(op="drop-column", column="memo")(spark, d)


_IMPUTED = {"median": "(SELECT quantile_cont(price, 0.5) FROM dirty)", "mean": "(SELECT avg(price) FROM dirty)", "constant": "0.5", "mode": "(SELECT price FROM dirty WHERE price IS NOT NULL GROUP BY price ORDER BY count(*) DESC, min(row_id) LIMIT 1)"}


def _impute(method: str, value: str) -> None:
    @query(f"impute_{method}", f"{WITH_DIRTY} SELECT row_id, round(coalesce(price, {value}), 4) AS price FROM dirty")
    def _(spark, d):
        return rounded(_step(op="impute", column="price", method=method, value=0.5)(spark, d).select("row_id", "price"))


for _method, _value in _IMPUTED.items():
    _impute(_method, _value)


@query("impute_text_mode", f"{WITH_DIRTY} SELECT row_id, CASE WHEN trim(joined) = '' THEN (SELECT trim(joined) FROM dirty WHERE trim(joined) <> '' GROUP BY 1 ORDER BY count(*) DESC, min(row_id) LIMIT 1) ELSE joined END AS joined FROM dirty")
def _(spark, d):
    return _step(op="impute", column="joined", method="mode")(spark, d).select("row_id", "joined")


_BOUNDS = "(SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM dirty))"


@query("outlier_clip", f"{WITH_DIRTY} SELECT row_id, CASE WHEN price IS NOT NULL THEN round(least(greatest(price, lo), hi), 4) END AS price FROM dirty, {_BOUNDS}")
def _(spark, d):
    return rounded(_step(op="outlier", column="price", action="clip")(spark, d).select("row_id", "price"))


@query("outlier_drop_rows", f"{WITH_DIRTY} SELECT row_id, price FROM dirty, {_BOUNDS} WHERE price IS NULL OR price BETWEEN lo AND hi")
def _(spark, d):
    return _step(op="outlier", column="price", action="drop-rows")(spark, d).select("row_id", "price")


@query("log1p_transform", f"{WITH_DIRTY} SELECT row_id, round(ln(1 + price), 6) AS price FROM dirty")
def _(spark, d):
    return rounded(_step(op="log1p", column="price")(spark, d).select("row_id", "price"), 6)


@query("onehot_encode", f"{WITH_DIRTY} SELECT row_id, CASE WHEN country = 'JP' THEN 1.0::DOUBLE ELSE 0.0 END AS \"country=JP\", CASE WHEN country = 'KR' THEN 1.0::DOUBLE ELSE 0.0 END AS \"country=KR\" FROM dirty")
def _(spark, d):
    return _step(op="encode", column="country", method="onehot")(spark, d).select("row_id", "country=JP", "country=KR")


@query("ordinal_encode", f"{WITH_DIRTY} SELECT row_id, (dense_rank() OVER (ORDER BY grade) - 1)::DOUBLE AS grade FROM dirty")
def _(spark, d):
    return _step(op="encode", column="grade", method="ordinal")(spark, d).select("row_id", "grade")


@query("frequency_encode", f"{WITH_DIRTY} SELECT row_id, CASE WHEN trim(joined) <> '' THEN (count(*) OVER (PARTITION BY trim(joined)))::DOUBLE END AS joined FROM dirty")
def _(spark, d):
    return _step(op="encode", column="joined", method="frequency")(spark, d).select("row_id", "joined")


_SCALED = {"standard": ("avg(price)", "stddev_samp(price)"), "minmax": ("min(price)", "max(price) - min(price)"), "robust": ("quantile_cont(price, 0.5)", "quantile_cont(price, 0.75) - quantile_cont(price, 0.25)")}


def _scale(method: str, centre: str, spread: str) -> None:
    @query(f"scale_{method}", f"{WITH_DIRTY} SELECT row_id, round((price - c) / s, 6) AS price FROM dirty, (SELECT {centre} AS c, {spread} AS s FROM dirty)")
    def _(spark, d):
        return rounded(_step(op="scale", column="price", method=method)(spark, d).select("row_id", "price"), 6)


for _method, (_centre, _spread) in _SCALED.items():
    _scale(_method, _centre, _spread)


@query("recipe_pipeline", f"""{WITH_DIRTY}, a AS (SELECT {', '.join(ALL)}, min(row_id) AS row_id FROM dirty GROUP BY ALL), b AS (SELECT row_id, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM a)) AS price FROM a),
c AS (SELECT row_id, least(greatest(price, lo), hi) AS price FROM b, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM b)))
SELECT row_id, round((price - (SELECT min(price) FROM c)) / (SELECT max(price) - min(price) FROM c), 6) AS price FROM c""")
def _(spark, d):
    steps = [{"op": "scale", "column": "price", "method": "minmax"}, {"op": "outlier", "column": "price", "action": "clip"}, {"op": "impute", "column": "price"}, {"op": "drop-duplicates"}]
    return rounded(transform.apply(dirty(spark, d), steps, "row_id")[0].select("row_id", "price"), 6)


@query("before_after_join", f"""{WITH_DIRTY}, after AS (SELECT coalesce(price, (SELECT quantile_cont(price, 0.5) FROM dirty)) AS price, rating FROM dirty)
SELECT 'price' AS name, round(avg(CASE WHEN price IS NULL THEN 1.0 ELSE 0.0 END), 6) AS before, (SELECT round(avg(CASE WHEN price IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM after) AS after FROM dirty
UNION ALL SELECT 'rating', round(avg(CASE WHEN rating IS NULL THEN 1.0 ELSE 0.0 END), 6), (SELECT round(avg(CASE WHEN rating IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM after) FROM dirty""")
def _(spark, d):
    df = dirty(spark, d).select("row_id", "price", "rating")
    after = transform.apply(df, [{"op": "impute", "column": "price"}], "row_id")[0]
    summary = lambda x: stats.numeric_summary(x, number(x, "price", "rating")).select("name", (F.col("missing") / (F.col("missing") + F.col("n"))).alias("rate"))
    both = summary(df).withColumnRenamed("rate", "before").join(summary(after).withColumnRenamed("rate", "after"), "name")
    return rounded(both, 6)


@query("profile_document")
def _(spark, d):
    result = profile.profile(dirty(spark, d), target="price", order_column="row_id")
    return rows(spark, [(profile.to_json({k: v for k, v in result.items() if k != "dataset"}),)], "document string")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)

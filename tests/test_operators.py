import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import findings, infer, quality, recipe, relations, stats, transform
from plumbline.operators.views import views
from plumbline.plans.profile import profile
from plumbline.queries import queries


def X():  # noqa: N802
    return {"x": F.col("x")}


def doubles(spark, xs):
    return spark.createDataFrame([(i, None if x is None else float(x)) for i, x in enumerate(xs)], "i int, x double")


def one_type(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x string")
    return infer.profile_columns(df, views(df)).first()


def test_types(spark):
    r = one_type(spark, [str(k) for k in range(19)] + ["미상"])
    assert (r["type"], r["invalid_count"], r["missing_count"]) == ("numeric", 1, 0)
    assert one_type(spark, ["yes", "no", "yes"])["type"] == "boolean"
    assert one_type(spark, ["0", "1", "0"])["type"] == "numeric"
    r = one_type(spark, list("ABACBA"))
    assert (r["type"], r["unique_count"]) == ("categorical", 3)
    assert one_type(spark, [f"USR-{k}" for k in range(200)])["type"] == "id"
    assert one_type(spark, [f"비고 {k}, 이상 없음" for k in range(50)])["type"] == "text"
    assert one_type(spark, ["06236", "03187", "07995"])["type"] != "numeric"
    r = one_type(spark, ["", " ", None])
    assert (r["type"], r["missing_rate"], r["unique_count"]) == ("text", 1.0, 0)


def test_summary(spark):
    r = stats.numeric_summary(doubles(spark, [1, 2, 3, 4, 5, None]), X()).first()
    assert (r["n"], r["missing"], r["mean"], r["q1"], r["median"], r["q3"]) == (5, 1, 3, 2, 3, 4)
    assert r["std"] == pytest.approx(math.sqrt(2.5)) and r["skewness"] == 0 and r["kurtosis"] == pytest.approx(-1.3)
    for same in ([7, 7, 7], [42]):
        r = stats.numeric_summary(doubles(spark, same), X()).first()
        assert (r["std"], r["skewness"], r["kurtosis"]) == (0, 0, 0)


def test_top_values_and_ties(spark):
    df = spark.createDataFrame(list(enumerate(["a", "b", "a", "", "c", "a", "b", "  "])), "i int, x string")
    freq = stats.frequencies(df, {"x": views(df)[1].text}, F.col("i"))
    assert [(r["value"], r["count"]) for r in stats.top_values(freq, 2).orderBy("rank").collect()] == [("a", 3), ("b", 2)]
    assert [r["value"] for r in stats.sample_values(freq).orderBy("rank").collect()] == ["a", "b", "c"]


def test_histogram_and_density(spark):
    assert stats.bin_count(100) == 8 and stats.bin_edges(5, 5, 3) == [5, 5]
    df = doubles(spark, range(10))
    assert sum(stats.histograms(df, X(), {"x": (0.0, 9.0, 10)})["x"]) == 10
    fine = stats.histograms(df, X(), {"x": (0.0, 9.0, 10)}, 256)["x"]
    curve = stats.density(fine, 0.0, 9.0, 10, 3.03, 4.5, 9 / 5)
    assert len(curve) == 64 and stats.density(fine, 0.0, 9.0, 4, 1, 1, 1) is None


def test_outliers(spark):
    r = stats.iqr_outliers(doubles(spark, [*range(1, 11), 100]), X()).first()
    assert (r["lower"], r["upper"], r["count"]) == (-4, 16, 1) and r["rate"] == pytest.approx(1 / 11)
    assert stats.zscore_outliers(doubles(spark, [10] * 30 + [11, 9, 1000]), X()).first()["count"] == 1


def test_duplicates_and_memory(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (2, None)], "a int, b string")
    assert stats.duplicate_rows(df).first()["duplicates"] == 2


def pair(spark, a, b):
    return spark.createDataFrame(list(zip(map(lambda v: None if v is None else float(v), a), map(lambda v: None if v is None else float(v), b), strict=True)), "a double, b double")


def AB():  # noqa: N802
    return {"a": F.col("a"), "b": F.col("b")}


def test_pearson_and_spearman(spark):
    r = lambda a, b: relations.pearson_pairs(pair(spark, a, b), AB())[("a", "b")]
    assert r([1, 2, 3, 4, 5], [2, 4, 6, 8, 10]) == pytest.approx(1)
    assert r([1, 2, 3, 4], [1, -1, 1, -1]) == pytest.approx(-2 / (2 * math.sqrt(5)))
    assert r([1, 2, None, 4, 5], [2, 4, 100, 8, None]) == pytest.approx(1)
    assert r([1, 1, 1], [1, 2, 3]) is None
    s = lambda a, b: relations.spearman(pair(spark, a, b), AB()["a"], AB()["b"])
    assert s([1, 2, 3, 4, 5], [math.exp(x) for x in (1, 2, 3, 4, 5)]) == pytest.approx(1)
    assert s([1, 2, 2, 3], [1, 2.5, 2.5, 4]) == pytest.approx(1)


def test_spearman_ranks_each_pair_over_its_own_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (400, 5)).astype(float)
    x[:, 3] += x[:, 0]
    x[:200, 1] = np.nan
    x[:200, 2] = np.nan  # in the same rows
    x[rng.random(400) < 0.3, 3] = np.nan
    names = list("abcde")
    frame = pd.DataFrame(x, columns=names)
    df = spark.createDataFrame([[None if v != v else v for v in r] for r in x.tolist()], ", ".join(f"{n} double" for n in names))
    got = relations.spearman_pairs(df, {n: F.col(n) for n in names})
    want = frame.corr(method="spearman")
    assert len(got) == 10
    for (a, b), r in got.items():
        assert r == pytest.approx(want.loc[a, b])
    assert relations.spearman_pairs(df.where("false"), {n: F.col(n) for n in names})[("a", "b")] is None


def test_counters_from_known_values_count_alike(spark):
    df = spark.createDataFrame([(" 1,000 ", "x"), ("1000", None), ("", "2023-01-02"), (None, "yes")], "a string, b string")
    own = views(df)
    known = stats.frequencies(df, {v.name: v.text for v in own})
    assert infer.count_columns(df, own, known) == infer.count_columns(df, own)
    merged = stats.renamed(known, ["a"], lambda t: text.number_text(text.trimmed_number(t)), False)
    assert {tuple(r)[1:] for r in merged.where("name = 'a'").collect()} == {("1000", 2, "1000")}


def test_vif(spark):
    assert relations.vif(pair(spark, [1, 2, 3, 4], [1, -1, 1, -1]), AB())["a"] == pytest.approx(1.25)
    df = pair(spark, [1, 2, 3, 4, 5], [2, 4, 1, 8, 5]).withColumn("c", F.col("a") + F.col("b"))
    assert relations.vif(df, AB() | {"c": F.col("c")})["a"] is None


def near_copies(spark):
    """Like the dirty table: a price, the price rounded, twice the price and a little, and a column of its own."""
    rng = np.random.default_rng(5)
    price = np.round(rng.uniform(1000, 400_000, 5000), 2)
    k = np.arange(5000)
    x = np.stack([np.round(price), price, price * 2 + k % 7, k % 5], axis=1)
    names = ["amount", "price", "price2", "rating"]
    return spark.createDataFrame(x.tolist(), ", ".join(f"{n} double" for n in names)), names, x


def test_vif_of_near_copies(spark):
    df, names, x = near_copies(spark)
    got = relations.vif(df, {n: F.col(n) for n in names})
    x = x - x.mean(axis=0)
    for i, n in enumerate(names):
        rest = np.delete(x, i, axis=1)
        rest = rest / rest.std(axis=0)
        own = x[:, i] - rest @ np.linalg.lstsq(rest, x[:, i], rcond=None)[0]
        assert got[n] == pytest.approx((x[:, i] @ x[:, i]) / (own @ own), rel=1e-3)
    assert got["amount"] > 1e11 and got["rating"] < 1.01
    # exact copies stay undefined, and so do the others beside them
    exact = df.withColumn("sum", F.col("price") + F.col("rating"))
    assert set(relations.vif(exact, {n: F.col(n) for n in ("price", "rating", "sum")}).values()) == {None}
    twice = relations.vif(exact.withColumn("twice", F.col("price") * 2), {n: F.col(n) for n in ("price", "twice", "rating")})
    assert set(twice.values()) == {None}
    assert relations.vif(df, {"price": F.col("price")}) == {"price": None} and relations.vif(df.where("false"), {n: F.col(n) for n in names})["price"] is None


def test_pairs_of_a_column_with_high_vif_are_found(spark):
    df, names, _ = near_copies(spark)
    columns = {n: F.col(n) for n in names}
    v = relations.vif(df, columns)
    pairs = [{"left": a, "right": b, "pearson": r, "vif": v[a]} for (a, b), r in relations.pearson_pairs(df, columns).items()]
    found = findings.build({"rowCount": 5000, "duplicateRowCount": 0}, [column(n) for n in names], pairs, fold=False)
    assert {tuple(f["targets"]) for f in found if f["type"] == "F-MULTICOLLINEAR"} == {(a, b) for k, a in enumerate(names) for b in names[k + 1 :]}


def test_scatter_is_even(spark):
    df = spark.range(1000).select(F.col("id"), F.col("id").cast("double").alias("a"), (F.col("id") * 2).cast("double").alias("b"))
    got = sorted(r["x"] for r in relations.scatter(df, F.col("a"), F.col("b"), [F.col("id")]).collect())
    assert got == [float(math.floor(k * 1000 / 200)) for k in range(200)]


def test_scatter_of_many_partitions_loses_no_point(spark, tmp_path):
    n = 300_000
    path = str(tmp_path / "rows")
    # wide rows: a plan that reads the keys only and one that reads all columns do not cut their ranges alike
    spark.range(n).select(F.col("id").alias("i"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("o"), F.col("id").cast("double").alias("a"), F.rand(1).alias("b")).write.parquet(path)
    df = spark.read.parquet(path)
    rows = sorted((r["o"], r["a"], r["b"]) for r in df.collect())
    got = sorted(tuple(r) for r in relations.scatter(df, F.col("a"), F.col("b"), [F.col("o")]).collect())
    assert got == [(k, *rows[k * n // 200][1:]) for k in range(200)]
    few = relations.scatter(df.where("i < 3"), F.col("a"), F.col("b"), [F.col("i")], most=3)
    assert sorted(tuple(r)[:2] for r in few.collect()) == [(0, 0.0), (1, 1.0), (2, 2.0)]
    assert relations.scatter(df.where("false"), F.col("a"), F.col("b"), [F.col("i")]).collect() == []
    # ties of the order go by x, then y
    tied = relations.scatter(df, F.col("a"), F.col("b"), [F.lit(0)], most=100).collect()
    assert sorted(tuple(r)[:2] for r in tied) == [(k, float(k * n // 100)) for k in range(100)]


def column(name="c", kind="numeric", **more):
    return {"name": name, "type": kind, "missingRate": 0.0, "invalidRate": 0.0, "uniqueCount": 100, "modeRate": 0.1, "stats": {}} | more


def test_health():
    data = {"rowCount": 100, "duplicateRowCount": 0}
    item = lambda cols, key, d=data: next(i for i in quality.health(cols, d)["items"] if i["key"] == key)
    assert item([column(missingRate=0.4), column()], "missing")["penalty"] == 20
    assert item([column(missingRate=0.9)] * 2, "missing")["penalty"] == 25
    assert item([column()], "duplicate", {"rowCount": 100, "duplicateRowCount": 2}) | {"evidence": ""} == {"key": "duplicate", "verdict": "warn", "penalty": 6, "evidence": ""}
    assert item([column(modeRate=0.97)] * 2 + [column()] * 3, "constant")["verdict"] == "bad"
    assert quality.health([column(kind="id", modeRate=1.0)], data)["total"] == 100


def test_findings_sort_and_fold():
    data = {"rowCount": 100, "duplicateRowCount": 1}
    cols = [column(f"c{k}", missingRate=0.2) for k in range(7)]
    found = findings.build(data, cols, [])
    high = [f for f in found if f["type"] == "F-MISSING-HIGH"]
    assert len(high) == 6 and high[-1]["id"] == "F-MISSING-HIGH#more" and high[-1]["targets"] == ["c5", "c6"]
    assert found[-1]["type"] == "F-DUP-ROW"


@pytest.mark.parametrize(("facts", "kind"), [({"modeRate": 0.95}, "F-CONST-COL"), ({"kind": "categorical", "uniqueCount": 50}, "F-HIGH-CARD"), ({"kind": "id", "uniqueCount": 99}, "F-ID-COL"), ({"stats": {"skewness": -2}}, "F-SKEW"), ({"stats": {"kurtosis": 7}}, "F-KURTOSIS"), ({"stats": {"outlierRate": 0.05}}, "F-OUTLIER-RATE"), ({"stats": {"outlierRate": 0.01, "skewness": 1}}, "F-OUTLIER-ACTION"), ({"uniqueCount": 20}, "F-BIN-SENSITIVE"), ({"missingRate": 0.05, "stats": {"skewness": 1}}, "F-MISSING-IMPUTE")])
def test_rule_boundaries(facts, kind):
    found = findings.build({"rowCount": 100, "duplicateRowCount": 0}, [column(**facts)], [])
    assert kind in {f["type"] for f in found}


def test_target_rules():
    cols = [column("t", "categorical", classDistribution={"a": 90, "b": 10}), column("x", stats={"std": 1.0}), column("y", stats={"std": 100.0})]
    found = {f["type"]: f for f in findings.build({"rowCount": 100, "duplicateRowCount": 0}, cols, [{"left": "x", "right": "t", "pearson": 0.95, "vif": None}], "t")}
    assert found["F-CLASS-IMBALANCE"]["metrics"]["minClass"] == "b" and found["F-LEAKAGE"]["targets"] == ["x", "t"] and "F-SCALE-DIFF" in found


def test_every_finding_has_a_step_or_a_reason():
    kinds = ["F-MISSING-HIGH", "F-MISSING-IMPUTE", "F-CONST-COL", "F-HIGH-CARD", "F-ID-COL", "F-DUP-ROW", "F-SKEW", "F-KURTOSIS", "F-OUTLIER-RATE", "F-OUTLIER-ACTION", "F-BIN-SENSITIVE", "F-CORR-METHOD", "F-MULTICOLLINEAR", "F-CORR-CAUSAL", "F-LEAKAGE", "F-CLASS-IMBALANCE", "F-TARGET-SKEW", "F-SCALE-DIFF"]
    for k in kinds:
        assert bool(recipe.suggest([{"type": k, "targets": ["c"]}], [column()])) != (k in recipe.NO_STEP)


def test_steps_for_every_column_of_a_pair(spark):
    df, names, _ = near_copies(spark)
    columns = [column(n) for n in names]
    pairs = relations.correlations(df, {n: F.col(n) for n in names}, points=False)
    steps = recipe.normalize(recipe.suggest(findings.build({"rowCount": 5000, "duplicateRowCount": 0}, columns, pairs), columns))
    # the sixth pair is folded into one row; its columns count as well
    assert {s["id"] for s in steps if s["findingType"] == "F-MULTICOLLINEAR"} == {f"drop-column:{n}:" for n in names}


def test_suggest_steps_query(spark, tmp_path):
    price = np.round(np.random.default_rng(7).uniform(1000, 400_000, 4000), 2)
    orders = [(k, float(x), f"2024-01-{k % 28 + 1:02d}", f"{k % 5 + 1}-LEVEL") for k, x in enumerate(price)]
    spark.createDataFrame(orders, "o_orderkey long, o_totalprice double, o_orderdate string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = queries()["suggest_steps"](spark, str(tmp_path)).collect()
    # rating goes with no column, but stands beside three whose VIFs are some 1e11
    near = {(f"drop-column:{n}:", "F-MULTICOLLINEAR") for n in ("amount", "price", "price2", "rating")}
    other = {("drop-duplicates::", "F-DUP-ROW"), ("drop-column:country:", "F-CONST-COL"), ("drop-column:member_id:", "F-ID-COL"), ("impute:price:median", "F-MISSING-HIGH"), ("impute:price2:median", "F-MISSING-HIGH")}
    assert len(got) == 9 and {(r["id"], r["finding"]) for r in got} == near | other


def table(spark):
    v = [*range(10), 1000, None]
    return spark.createDataFrame([(i, None if x is None else float(x), None if i == 11 else "가나"[i % 2], "7") for i, x in enumerate(v)], "row int, v double, g string, c string")


def run(spark, *steps):
    df, log = transform.apply(table(spark), list(steps), "row")
    return df.orderBy("row").collect(), log


def test_transforms(spark):
    got, log = run(spark, {"op": "impute", "column": "v"})
    assert got[11]["v"] == 5.0 and log[0].params["filled"] == 1
    got, _ = run(spark, {"op": "impute", "column": "g"})
    assert got[11]["g"] == "가"
    got, log = run(spark, {"op": "outlier", "column": "v"})
    assert len(got) == 12 and got[10]["v"] == log[0].params["upper"] and log[0].params["affected"] == 1
    got, _ = run(spark, {"op": "outlier", "column": "v", "action": "drop-rows"})
    assert len(got) == 11 and got[-1]["v"] is None
    got, _ = run(spark, {"op": "encode", "column": "g"})
    assert got[0]["g=가"] == 1.0 and got[11]["g=가"] == 0.0 and got[11]["g=나"] == 0.0
    got, _ = run(spark, {"op": "encode", "column": "g", "method": "frequency"})
    assert got[0]["g"] == 6.0 and got[11]["g"] is None
    got, log = run(spark, {"op": "encode", "column": "g", "method": "ordinal"})
    assert log[0].params["mapping"] == {"가": 0, "나": 1}
    got, log = run(spark, {"op": "scale", "column": "c"}, {"op": "fly", "column": "v"}, {"op": "log1p", "column": "gone"})
    assert [f.note for f in log] == ["the column is gone", "no numbers", "unknown step"]


def test_ordinal_codes_every_level(spark, monkeypatch):
    monkeypatch.setattr(transform, "LEVELS_A_RANGE", 20_000)
    n = 100_500
    df = spark.range(n).selectExpr("id", "concat('level ', id % 10, ' ', id) AS x").unionAll(spark.createDataFrame([(n, "\U0001f642"), (n + 1, "\uff01"), (n + 2, None)], "id long, x string"))
    out, log = transform.apply(df, [{"op": "encode", "column": "x", "method": "ordinal"}])
    got = {r["id"]: r["x"] for r in out.collect()}
    levels = sorted(((f"level {k % 10} {k}", k) for k in range(n)), key=lambda x: x[0])
    want = {k: float(i) for i, (_, k) in enumerate(levels)} | {n: float(n), n + 1: float(n + 1), n + 2: None}
    assert got == want and log[0].params == {"levels": n + 2}


def test_steps_run_in_order(spark):
    _, log = run(spark, {"op": "scale", "column": "v", "method": "minmax"}, {"op": "impute", "column": "v"})
    assert [f.op for f in log] == ["impute", "scale"]


def test_drop_duplicates(spark):
    df = spark.createDataFrame([("a b", "c"), ("a", "b c"), ("a", "b c")], "x string, y string")
    out, log = transform.apply(df, [{"op": "drop-duplicates"}])
    assert out.count() == 2 and log[0].params["removedRows"] == 1


def test_encode_keeps_columns_of_clashing_names(spark):
    rows = [("b", 1, 2, 3, "x"), ("a", 4, 5, 6, "y"), ("b", 7, 8, 9, None), (None, 0, 0, 0, "y")]
    df = spark.createDataFrame(rows, "level string, code int, uses int, _level int, coded string")
    for method, of_level, of_coded in (("ordinal", [1, 0, 1, None], [0, 1, None, 1]), ("frequency", [2, 1, 2, None], [1, 2, None, 2])):
        for column, want in (("level", of_level), ("coded", of_coded)):
            got, _ = transform.apply(df, [{"op": "encode", "column": column, "method": method}])
            assert got.columns == df.columns
            at = df.columns.index(column)
            expect = [r[:at] + (w,) + r[at + 1 :] for r, w in zip(rows, want, strict=True)]
            assert sorted(map(str, (tuple(None if x is None else float(x) if k == at else x for k, x in enumerate(r)) for r in got.collect()))) == sorted(map(str, (tuple(None if x is None else float(x) if k == at else x for k, x in enumerate(r)) for r in expect)))


def test_quantiles_by_narrowing(spark, monkeypatch):
    """Against sorting, with few parts a pass: ties, steep and tiny spans, infinities of scale, one value, none."""
    import random

    monkeypatch.setattr(stats, "BINS", 32)
    rng = random.Random(3)
    data = {"ties": [rng.choice([1.0, 2.0, 2.5]) for _ in range(200)], "steep": [10.0 ** rng.randint(-300, 300) for _ in range(9)], "wide": [-1.7e308, 1.7e308, 0.0, 5.0], "one": [3.0], "normal": [rng.gauss(0, 1) for _ in range(301)]}
    rows = [(n, v) for n, vs in data.items() for v in vs] + [("none", None), ("one", None)]
    at = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = stats.selected(spark.createDataFrame(rows, "name string, value double"), at)
    assert set(got) == set(data)
    for n, vs in data.items():
        vs = sorted(vs)
        for p, x in zip(at, got[n], strict=True):
            h = (len(vs) - 1) * p
            a, b = vs[int(h)], vs[min(int(h) + 1, len(vs) - 1)]
            want = a + (h - int(h)) * (b - a) if b > a else a
            assert x == want or abs(x - want) <= 1e-12 * abs(want)


def test_overridden_type_takes_leading_zeros(spark):
    df = spark.createDataFrame([("06236",), ("03187",), ("07995",), ("x",)], "zip string")
    column = profile(df, type_overrides={"zip": "numeric"})["columns"][0]
    assert (column["type"], column["invalidCount"]) == ("numeric", 1)

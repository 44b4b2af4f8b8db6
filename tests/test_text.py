import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.functions import formats, text


def values(spark, fn, data):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def test_numbers(spark):
    good = {"42": 42, "-3.5": -3.5, "1e3": 1000, "1,234,567.5": 1234567.5, " 7 ": 7, "+5": 5, ".5": 0.5, "5.": 5}
    assert values(spark, text.to_number, list(good)) == [float(x) for x in good.values()]
    assert values(spark, text.to_number, ["", "미상", "12,34", "1.2.3", "NaN", "Infinity", "1e999", "1d", None]) == [None] * 9


def test_dates(spark):
    ms = lambda *a: int(datetime.datetime(*a, tzinfo=datetime.UTC).timestamp() * 1000)
    good = {"2023-01-05": ms(2023, 1, 5), "2023/1/5": ms(2023, 1, 5), "2023.01.05": ms(2023, 1, 5), "2023년 1월 5일": ms(2023, 1, 5), "2023년 1월": ms(2023, 1, 1), "2023-01-05 09:30": ms(2023, 1, 5, 9, 30), "2023-01-05T09:30:15": ms(2023, 1, 5, 9, 30, 15)}
    assert values(spark, text.to_epoch_ms, list(good)) == list(good.values())
    assert values(spark, text.to_epoch_ms, ["2023-02-31", "2023-13-01", "2023-01-05 25:00", "123", "", "0050-01-01", None]) == [None] * 7


def test_trim_is_unicode(spark):
    assert values(spark, text.trim, [" a\t", "　b\n", "﻿c "]) == ["a", "b", "c"]


def test_leading_zero(spark):
    assert values(spark, text.has_leading_zero, ["06236", "007", "0", "0.5", "-01"]) == [True, True, False, False, True]


def test_code_units(spark):
    assert values(spark, text.code_units, ["😀가", ""]) == [3, 0]


def test_number_text(spark):
    df = spark.createDataFrame([(1.0,), (0.5,), (-3.0,)], "x double")
    assert [r[0] for r in df.select(text.number_text(F.col("x"))).collect()] == ["1", "0.5", "-3"]


@pytest.mark.parametrize(("got", "want"), [(formats.percent(0.1225), "12.3%"), (formats.percent(float("nan")), "—"), (formats.count(1234567), "1,234,567"), (formats.stat(1234.56), "1235"), (formats.stat(0.000123456), "0.0001235"), (formats.particle(10), "으로"), (formats.particle(2), "로"), (formats.byte_size(1536), "1.5 KB"), (formats.byte_size(-1), "—"), (formats.number(3.0), "3")])
def test_formats(got, want):
    assert got == want

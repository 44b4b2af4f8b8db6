"""Text rules as Spark columns: all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that trimming removes, and the tokens and formats that count as a value of a type.
SPACE = r"[\t\n\u000B\f\r    -     　﻿]"
TRUE_FALSE = ("true", "false", "yes", "no", "y", "n", "t", "f")
GROUPED = r"\A[+-]?\d{1,3}(,\d{3})+(\.\d+)?\z"
NUMBER = r"\A[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\z"
LEADING_ZERO = r"\A[+-]?0\d"
ISO_DATE = r"\A(\d{4})[-./](\d{1,2})[-./](\d{1,2})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2}))?)?\z"
KOREAN_DATE = r"\A(\d{4})년\s*(\d{1,2})월(?:\s*(\d{1,2})일)?\z"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def has_space(c: Column) -> Column:
    return F.rlike(c, F.lit(SPACE))


def has_leading_zero(c: Column) -> Column:
    return F.rlike(trim(c), F.lit(LEADING_ZERO))


def trimmed_number(t: Column) -> Column:
    """The finite number a trimmed text stands for, thousands separators allowed; else null."""
    t = F.when(F.rlike(t, F.lit(GROUPED)), F.replace(t, F.lit(","), F.lit(""))).otherwise(t)
    n = F.when(F.rlike(t, F.lit(NUMBER)), t.try_cast("double"))
    return F.when(F.abs(n) < float("inf"), n)


def trimmed_timestamp(t: Column) -> Column:
    """The UTC time a trimmed date text stands for; null if it has no known format or is no day of the calendar."""
    parts = F.when(F.rlike(t, F.lit(ISO_DATE)), F.split(F.regexp_replace(t, ISO_DATE, "$1 $2 $3 $4 $5 $6"), " "))
    parts = parts.when(F.rlike(t, F.lit(KOREAN_DATE)), F.split(F.regexp_replace(t, KOREAN_DATE, "$1 $2 $3   "), " "))

    def made(p: Column) -> Column:
        year, month, day, hour, minute, second = (F.coalesce(F.nullif(F.get(p, F.lit(k)), F.lit("")), F.lit(d)).cast("int") for k, d in enumerate("001000"))
        ok = (year >= 100) & (hour <= 23) & (minute <= 59) & (second <= 59)
        return F.when(ok, F.try_make_timestamp(year, month, day, hour, minute, second.cast("decimal(16,6)"), F.lit("UTC")))

    return once(parts, made)


def once(c: Column, fn) -> Column:
    """fn(c), with c computed once however often fn uses it: it is a lambda's variable there. Null if c is null."""
    return F.get(F.transform(F.filter(F.array(c), lambda x: x.isNotNull()), fn), F.lit(0))


def to_number(c: Column) -> Column:
    """The finite number a text stands for, thousands separators allowed; else null."""
    return once(trim(c), trimmed_number)


def to_timestamp(c: Column) -> Column:
    """The UTC time a date text stands for; null if it has no known format or is no day of the calendar."""
    return once(trim(c), trimmed_timestamp)


def to_epoch_ms(c: Column) -> Column:
    return F.unix_millis(to_timestamp(c))


def is_boolean(c: Column) -> Column:
    return F.lower(trim(c)).isin(*TRUE_FALSE)


def is_valid_for(c: Column, kind: str) -> Column:
    """Whether a present text is a value of the type; a blank one always is."""
    blank = trim(c) == ""
    test = {"numeric": to_number(c).isNotNull(), "datetime": to_timestamp(c).isNotNull(), "boolean": is_boolean(c)}.get(kind)
    return F.lit(True) if test is None else blank | test


def code_units(c: Column) -> Column:
    """Length in UTF-16 code units."""
    return F.octet_length(F.encode(c, "UTF-16BE")) / F.lit(2)


def number_text(c: Column) -> Column:
    """A number's shortest text: plain from 1e-6 up to below 1e21, else with an exponent (1e+21, 1.5e-7)."""

    def made(x: Column) -> Column:
        plain = (F.abs(x) < 1e21) & (F.abs(x) >= 1e-6) | (x == 0)
        short = F.regexp_replace(x.cast("string"), r"\.0(?=E|$)", "")  # the fewest digits that give the number back
        digits = F.regexp_replace(x.cast("string").cast("decimal(38,16)").cast("string"), r"\.?0*$", "")
        # beyond the 22 digits before the point, or the 16 behind it, that the decimal holds: move the point of the short text
        tiny = F.regexp_extract(short, r"^-?(\d)", 1)
        tail = F.regexp_extract(short, r"^-?\d\.?(\d*)E", 1)
        power = F.regexp_extract(short, r"E-(\d+)$", 1).try_cast("int")
        moved = F.concat(F.when(x < 0, "-").otherwise(""), F.lit("0."), F.repeat(F.lit("0"), power - 1), tiny, tail)
        fixed = F.when((x == F.floor(x)) & (F.abs(x) >= 1), digits).when(power.isNotNull(), moved).otherwise(F.when(short.contains("E"), digits).otherwise(short))
        exponent = F.regexp_replace(F.replace(short, F.lit("E"), F.lit("e")), r"e(\d)", "e+$1")
        return F.when(x == 0, "0").when(plain, fixed).otherwise(exponent)

    return once(c, made)

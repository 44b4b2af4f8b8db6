"""Strict CSV files: encoding and delimiter detection, whole-record parsing, and a writer that reads back the same."""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.formats import number
from plumbline.functions.ship import ship
from plumbline.functions.text import number_text
from plumbline.operators import limits as L

# The encodings and delimiters that are tried, in this order.
ENCODINGS = (("utf-8", "utf-8"), ("euc-kr", "cp949"))
DELIMITERS = (",", ";", "\t", "|")


class SourceError(ValueError):
    """code: ENCODING_UNDETECTED, FILE_TOO_LARGE, PARSE_FAILED or SCHEMA_MISMATCH; line: of the file, if known."""

    def __init__(self, code: str, reason: str, line: int | None = None):
        super().__init__(f"{code}: {reason}" + (f" (line {line})" if line else ""))
        self.code, self.line = code, line


def decode(data: bytes, forced: str | None = None) -> tuple[str, str]:
    """Text and encoding of a file: the first encoding in which all bytes are valid, or the forced one."""
    for name, codec in ENCODINGS:
        if forced in (None, name):
            try:
                return data.decode(codec).removeprefix("﻿"), name
            except UnicodeDecodeError:
                continue
    raise SourceError("ENCODING_UNDETECTED", "the bytes are valid in no known encoding")


def records(text: str, delimiter: str) -> Iterator[tuple[int, list[str]]]:
    """First line and fields of each record. A quote opens a quoted field only at its beginning."""
    csv.field_size_limit(sys.maxsize)
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)
    line = 1
    for fields in reader:
        yield line, fields or [""]
        line = reader.line_num + 1


def detect_delimiter(text: str) -> str:
    """The candidate that cuts the first lines into equally many fields; of several, the one with the most."""
    lines = [x for x in text.splitlines() if x.strip()][:10]
    best, top = ",", 0
    for d in DELIMITERS:
        sizes = [len(next(iter(records(x, d)))[1]) for x in lines]
        if sizes and sizes[0] >= 2:
            score = sizes[0] + 1000 * (len(set(sizes)) == 1)
            if score > top:
                best, top = d, score
    return best


def header(names: Sequence[str]) -> list[str]:
    """Trimmed names; blank ones are col_N, repeated ones get a number."""
    out: list[str] = []
    for k, name in enumerate(names, 1):
        name = name.strip() or f"col_{k}"
        own, n = name, 2
        while own in out:
            own, n = f"{name}_{n}", n + 1
        out.append(own)
    return out


def parse(text: str, delimiter: str | None = None) -> tuple[list[str], list[list[str]]]:
    """Names and rows. A record of another width fails the file. Blank lines are skipped, but in a file of one column
    they are missing values, except at its end."""
    rows = list(records(text, delimiter or detect_delimiter(text))) if text else []
    if not rows:
        raise SourceError("PARSE_FAILED", "the file is empty", 1)
    names, out = header(rows[0][1]), []
    for line, fields in rows[1:]:
        if len(names) > 1 and len(fields) == 1 and not fields[0].strip():
            continue
        if len(fields) != len(names):
            raise SourceError("PARSE_FAILED", f"{len(fields)} fields instead of {len(names)}", line)
        out.append(fields)
    while len(names) == 1 and out and not out[-1][0].strip():
        out.pop()
    return names, out


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, delimiter: str | None = None, max_bytes: int | None = L.FILE_BYTES) -> tuple[DataFrame, dict]:
    """A CSV file as text columns with a row number row_id, and {encoding, delimiter}. Parsed on an executor, as one whole."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path)
    if max_bytes is not None and (files.agg(F.max("length")).first()[0] or 0) > max_bytes:
        raise SourceError("FILE_TOO_LARGE", f"more than {max_bytes} bytes")

    def load(batches):
        import pandas as pd

        for b in batches:
            for data in b["content"]:
                try:
                    text, used = decode(bytes(data), encoding)
                    d = delimiter or detect_delimiter(text)
                    names, rows = parse(text, d)
                    yield pd.DataFrame({"place": range(-1, len(rows)), "fields": [names, *rows], "about": [f"{used} {d}"] + [None] * len(rows)})
                except SourceError as e:
                    yield pd.DataFrame({"place": [-2], "fields": [[e.code, str(e.args[0]), str(e.line or "")]], "about": [None]})

    parsed = files.select("content").mapInPandas(load, "place long, fields array<string>, about string").persist()
    first = parsed.where("place < 0").first()
    if first is None:
        raise SourceError("PARSE_FAILED", "no such file")
    if first["place"] == -2:
        code, reason, line = first["fields"]
        raise SourceError(code, reason, int(line) if line else None)
    names = first["fields"]
    used, d = first["about"].split(" ", 1)
    df = parsed.where("place >= 0").select(F.col("place").alias("row_id"), *(F.col("fields")[k].alias(n) for k, n in enumerate(names)))
    return df, {"encoding": used, "delimiter": d}


def read_csv_large(spark: SparkSession, path: str, names: Sequence[str], delimiter: str = ",", encoding: str = "utf-8") -> DataFrame:
    """A large well-formed file of known columns by Spark's own reader, which splits nothing inside quotes."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.schema(schema).csv(path, sep=delimiter, encoding=encoding, header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", emptyValue="", nullValue="")


def serialize(names: Sequence[str], rows: Sequence[Sequence], delimiter: str = ",") -> str:
    """CSV text with CRLF ends; fields are quoted only where they must be; missing ones are empty."""

    def cell(x) -> str:
        s = "" if x is None or isinstance(x, float) and x != x else number(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
        return '"' + s.replace('"', '""') + '"' if any(c in s for c in (delimiter, '"', "\r", "\n")) else s

    return "".join(delimiter.join(map(cell, row)) + "\r\n" for row in [names, *rows])


def write_csv(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """df as one CSV file in a folder: a header, CRLF ends, numbers as their shortest texts, quotes only where they must be.

    Lines are built as columns, so line feeds inside values stay as they are.
    """

    def cell(c):
        special = F.rlike(c, F.lit(rf'[\r\n"]|{re.escape(delimiter)}'))
        return F.coalesce(F.when(special, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c), F.lit(""))

    numeric = lambda f: number_text(F.nanvl(F.col(f"`{f.name}`").cast("double"), F.lit(None).cast("double")))
    cells = [cell(numeric(f) if isinstance(f.dataType, T.NumericType) else F.col(f"`{f.name}`").cast("string")) for f in df.schema.fields]
    lines = df.select(F.concat_ws(delimiter, *cells).alias("value"))
    top = df.sparkSession.createDataFrame([(serialize(df.columns, [], delimiter).removesuffix("\r\n"),)], "value string")
    top.coalesce(1).union(lines).coalesce(1).write.mode("overwrite").option("lineSep", "\r\n").text(path)

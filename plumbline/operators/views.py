"""Columns of a DataFrame as the profiler reads them: one text and, where there is one, one number a value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import text


@dataclass(frozen=True)
class View:
    """stored: numeric, datetime or string. Missing values of any kind are null in number and text."""

    name: str
    stored: str

    @property
    def raw(self) -> Column:
        return F.col(f"`{self.name}`")

    @property
    def present(self) -> Column:
        return (self.number if self.stored == "numeric" else self.text).isNotNull()

    @property
    def text(self) -> Column:
        """Trimmed text; null if blank."""
        if self.stored == "numeric":
            return text.number_text(self.number)
        if self.stored == "datetime":
            return F.date_format(self.raw.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
        return F.nullif(text.trim(self.raw.cast("string")), F.lit(""))

    @property
    def number(self) -> Column:
        """The value as a double: NaN and what is no number are null."""
        if self.stored == "numeric":
            return F.nanvl(self.raw.cast("double"), F.lit(None).cast("double"))
        return text.to_number(self.text)

    @property
    def epoch(self) -> Column:
        """The value as milliseconds since 1970 UTC."""
        if self.stored == "datetime":
            return F.unix_millis(self.raw.cast("timestamp"))
        return text.to_epoch_ms(self.text)


def views(df: DataFrame, as_text: set[str] = frozenset()) -> list[View]:
    """Numbers are numeric; dates and timestamps datetime; all else, and columns named in as_text, string."""
    out = []
    for f in df.schema.fields:
        stored = "string"
        if f.name not in as_text:
            if isinstance(f.dataType, T.NumericType):
                stored = "numeric"
            elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                stored = "datetime"
        out.append(View(f.name, stored))
    return out


def plain(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select([F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields])

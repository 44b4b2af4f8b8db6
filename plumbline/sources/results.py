"""Result documents: export, import with a version check, and a store of limited size."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from plumbline.operators import limits as L
from plumbline.sources.csv import SourceError


def dumps(result: dict) -> str:
    return json.dumps(result, ensure_ascii=False, default=str)


def loads(text: str) -> dict:
    """The document, if it has this schema's major version."""
    try:
        result = json.loads(text)
        major = str(result["schemaVersion"]).partition(".")[0]
    except (ValueError, KeyError, TypeError) as e:
        raise SourceError("SCHEMA_MISMATCH", "no result document") from e
    if major != L.SCHEMA_VERSION.partition(".")[0]:
        raise SourceError("SCHEMA_MISMATCH", f"schema version {result['schemaVersion']}")
    return result


def without_histograms(result: dict) -> dict:
    strip = lambda c: c | {"stats": {k: v for k, v in (c.get("stats") or {}).items() if k != "histogram"}}
    return result | {"columns": [strip(c) for c in result["columns"]]}


def only_strong_pairs(result: dict) -> dict:
    """Pairs that a finding can rest on, without their points."""
    strong = lambda p: abs(p["pearson"] or 0) >= L.CAUSAL_PEARSON or (p["vif"] or 0) >= L.COLLINEAR_VIF
    return result | {"correlations": [{k: v for k, v in p.items() if k != "points"} for p in result["correlations"] if strong(p)]}


def fit(result: dict, max_bytes: int | None) -> tuple[str | None, bool]:
    """The document's text within max_bytes, giving up histograms, then weak pairs; whether it was cut. None: too large."""
    for k, smaller in enumerate((lambda r: r, without_histograms, lambda r: only_strong_pairs(without_histograms(r)))):
        text = dumps(smaller(result))
        if max_bytes is None or len(text.encode()) <= max_bytes:
            return text, k > 0
    return None, True


def save(spark: SparkSession, result: dict, path: str, max_bytes: int | None = None) -> dict:
    text, cut = fit(result, max_bytes)
    if text is not None:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return {"saved": text is not None, "degraded": cut}


def load(spark: SparkSession, path: str) -> dict:
    return loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))

"""The profile of a table: a handful of jobs, whatever the number of columns, and one result document."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import findings, infer, quality, relations, stats, transform
from plumbline.operators import limits as L
from plumbline.operators.views import View, plain, views

STAGES = (("infer", 0.1), ("stats", 0.3), ("correlations", 0.5), ("quality", 0.75), ("findings", 0.9))


def _stats_of(r, rate: float, hist: dict) -> dict:
    out = {k: r[k] for k in ("mean", "median", "std", "min", "max", "q1", "q3", "skewness", "kurtosis")}
    return out | {"outlierRate": rate, "histogram": hist}


def profile(
    df: DataFrame, type_overrides: Mapping[str, str] | None = None, target: str | None = None, recipe: Sequence[dict] | None = None, order_column: str | None = None,
    encoding: str | None = None, delimiter: str | None = None, on_progress: Callable[[str, float], None] | None = None, is_cancelled: Callable[[], bool] | None = None,
) -> dict | None:
    """The result document of df: dataset, columns, health, findings, correlations. None if cancelled at a stage.

    order_column numbers the rows; it decides what comes first and is itself left out.
    """
    overrides = dict(type_overrides or {})
    stages = iter(STAGES)

    def enter() -> bool:
        if is_cancelled and is_cancelled():
            return False
        if on_progress:
            on_progress(*next(stages))
        return True

    if not enter():
        return None
    order = F.col(order_column) if order_column else None
    data = plain(df.drop(order_column) if order_column else df)
    whole = plain(df)
    cols = views(data, {n for n, t in overrides.items() if t != "numeric"})
    known = stats.frequencies(whole, {v.name: v.text for v in cols}, order).persist()
    rows, counted = infer.count_columns(data, cols, known)
    # text columns that hold only numbers are numbers from here on
    numbers = [v.name for v in cols if v.stored == "string" and infer.stored_as_number(counted[v.name], rows) and overrides.get(v.name, "numeric") == "numeric"]
    whole, data = transform.typed(whole, numbers), transform.typed(data, numbers)
    cols = [View(v.name, "numeric") if v.name in numbers else v for v in cols]
    freq = stats.renamed(known, numbers, lambda t: text.number_text(text.trimmed_number(t)), order is not None) if numbers else known
    try:
        unique = {r["name"]: r for r in stats.unique_and_mode(freq).collect()}
        samples: dict[str, list[str]] = {}
        for r in stats.sample_values(freq).orderBy("name", "rank").collect():
            samples.setdefault(r["name"], []).append(r["value"])
        out = []
        for k, v in enumerate(cols):
            c, u = counted[v.name], unique.get(v.name)
            guess = infer.type_of(v, c, rows, u["unique"] if u else 0)
            kind = overrides.get(v.name, guess)
            bad = infer.invalid_count(c, rows, kind, v.name in overrides) if v.stored == "string" else 0
            share = lambda n: n / rows if rows else 0.0
            out.append({
                "name": v.name, "index": k, "type": kind, "typeOverridden": kind != guess, "missingCount": int(c["missing"]), "missingRate": share(c["missing"]), "invalidCount": bad, "invalidRate": share(bad),
                "uniqueCount": u["unique"] if u else 0, "modeRate": u["mode_rate"] if u else 0.0, "sampleValues": samples.get(v.name, []),
            })
        if not enter():
            return None
        of = {v.name: v for v in cols}
        numeric = {c["name"]: of[c["name"]].number for c in out if c["type"] == "numeric"}
        dates = {c["name"]: of[c["name"]].epoch for c in out if c["type"] == "datetime"}
        classes = [c["name"] for c in out if c["type"] in ("categorical", "boolean")]
        top: dict[str, list] = {}
        for r in stats.top_values(freq.where(F.col("name").isin(classes))).orderBy("name", "rank").collect() if classes else []:
            top.setdefault(r["name"], []).append({"value": r["value"], "count": r["count"]})
    finally:
        known.unpersist()
    # numbers and dates are parsed once for all that reads them
    parsed = whole.select(*(c.alias(n) for n, c in (numeric | dates).items()), *([order] if order is not None else [])).persist()
    numeric, dates = ({n: F.col(f"`{n}`") for n in x} for x in (numeric, dates))
    summary = {r["name"]: r for r in stats.numeric_summary(parsed, numeric).collect()} if numeric else {}
    spans = {n: (r["min"], r["max"], r["n"]) for n, r in summary.items() if r["n"]}
    if dates:
        got = parsed.agg(*(f.alias(f"d{k}") for k, f in enumerate(f for c in dates.values() for f in (F.min(c), F.max(c), F.count(c))))).first()
        when = {n: tuple(got[3 * k : 3 * k + 3]) for k, n in enumerate(dates)}
    else:
        when = {}
    spans_all = spans | {n: s for n, s in when.items() if s[2]}
    counts = stats.histograms(parsed, numeric | dates, spans_all)
    fine = stats.histograms(parsed, numeric, spans, L.FINE_BINS)
    rates = {}
    if spans:
        bounds = {n: stats.iqr_bounds(summary[n]["q1"], summary[n]["q3"]) for n in spans}
        got = parsed.agg(*(stats.outside(numeric[n], *bounds[n]).alias(f"o{k}") for k, n in enumerate(spans))).first()
        rates = {n: got[k] / spans[n][2] for k, n in enumerate(spans)}
    for c in out:
        name = c["name"]
        if name in spans:
            low, high, n = spans[name]
            edges = stats.bin_edges(low, high, n)
            hist = {"binEdges": edges, "counts": counts[name]}
            r = summary[name]
            curve = stats.density(fine[name], low, high, n, r["std"], r["q3"] - r["q1"], edges[1] - edges[0])
            c["stats"] = _stats_of(r, rates[name], hist | ({"density": curve} if curve else {}))
        elif name in when and when[name][2]:
            low, high, n = when[name]
            c["stats"] = {"min": low, "max": high, "histogram": {"binEdges": stats.bin_edges(low, high, n), "counts": counts[name]}}
        elif name in classes:
            c["stats"] = {"topValues": top.get(name, [])}
        else:
            c["stats"] = {}
        if name == target and c["type"] in ("categorical", "boolean"):
            c["classDistribution"] = {r["value"]: r["count"] for r in stats.class_distribution(data, of[name].text).collect()}
    if not enter():
        parsed.unpersist()
        return None
    pairs = relations.correlations(parsed, numeric, [order] if order is not None else None)
    parsed.unpersist()
    repeated = stats.duplicate_rows(data).first()["duplicates"]
    memory = data.agg(stats.memory_bytes([v.raw for v in cols if v.stored != "string"], [F.coalesce(v.raw.cast("string"), F.lit("")) for v in cols if v.stored == "string"])).first()[0]
    dataset = {
        "rowCount": rows, "columnCount": len(cols), "duplicateRowCount": repeated, "memoryBytes": memory, "encoding": encoding, "delimiter": delimiter, "sampled": False,
        "createdAt": datetime.datetime.now(datetime.UTC).isoformat(),
    } | ({"recipe": list(recipe)} if recipe else {})
    if not enter():
        return None
    score = quality.health(out, dataset)
    if not enter():
        return None
    found = findings.build(dataset, out, pairs, target)
    for f in found:
        f.pop("seq", None)
    return {"schemaVersion": L.SCHEMA_VERSION, "dataset": dataset, "columns": out, "health": score, "findings": found, "correlations": pairs}


def preprocess(df: DataFrame, steps: Sequence[dict], order_column: str | None = None, **options) -> tuple[DataFrame, list[transform.Fit], dict]:
    """Apply a recipe and profile what it left. Types are inferred anew unless type_overrides are given."""
    after, log = transform.apply(df, steps, order_column)
    return after, log, profile(after, recipe=steps, order_column=order_column, **options)


def compare(before: dict, after: dict) -> dict:
    """Changes in health, rows, columns and duplicates, and of every column that both have."""
    old = {c["name"]: c for c in before["columns"]}
    measures = lambda c: {"missingRate": c["missingRate"], "skewness": c["stats"].get("skewness"), "outlierRate": c["stats"].get("outlierRate")}
    whole = {k: (before["dataset"][k], after["dataset"][k]) for k in ("rowCount", "columnCount", "duplicateRowCount")}
    columns = [{"name": c["name"]} | {k: (measures(old[c["name"]])[k], x) for k, x in measures(c).items()} for c in after["columns"] if c["name"] in old]
    return {"health": (before["health"]["total"], after["health"]["total"]), **whole, "columns": columns}


def to_json(result: dict) -> str:
    return json.dumps(result, ensure_ascii=False, default=str)
